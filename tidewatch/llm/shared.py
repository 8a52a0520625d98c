"""Tables and files in the folder that driver and executors share.

`spark.checkpoint.dir` names that folder. Where it is unset (tests, a laptop), a
temporary folder of the driver is used, which is right in local mode only.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_UNSET = {}
#: Folders of the tables that written() has returned.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the session's shared folder, as a URI or plain path."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _UNSET.setdefault("dir", None) or tempfile.mkdtemp(prefix="spark-shared-")
        _UNSET["dir"] = base
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[table] = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() has returned and that nothing will read any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(table))
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def drop_shared(spark: SparkSession) -> None:
    """Delete what this application has written below the shared folder; call it when its results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(shared_folder(spark, "x")))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """pyarrow file system and path of a URI; plain paths and file: are local or mounted."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: list[bytes]) -> None:
    """Write a file in one step: a repeated or lost attempt leaves either no file or the whole one."""
    files, path = filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(attempt) as out:
        for part in data:
            out.write(part)
    files.move(attempt, path)


def exists(uri: str) -> bool:
    from pyarrow import fs

    files, path = filesystem(uri)
    return files.get_file_info(path).type == fs.FileType.File


def mapped(uri: str):
    """The file's bytes, memory-mapped without a descriptor that stays open. A remote file is first copied to a local one that has no name any more."""
    import mmap

    from pyarrow import fs

    files, path = filesystem(uri)
    if isinstance(files, fs.LocalFileSystem):
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    with tempfile.TemporaryFile() as local, files.open_input_stream(path) as remote:
        while block := remote.read(1 << 22):
            local.write(block)
        local.flush()
        return mmap.mmap(local.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
