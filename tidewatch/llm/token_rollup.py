"""Token counts as delta-maintained rollups.

A batch of changes (insert a count, delete it, revise it) becomes signed deltas against the live
counts of the documents it names; these add up by source, language and tokenizer version to the
totals. Everything a batch does is two tables below `root`, named after its number and name: the new state of
the documents it touched and the deltas of the totals. Both count from the moment in which the batch is marked as committed; a batch
that is marked is never applied again, and one that failed half-way is applied anew.

Any number of writers may commit. A writer claims the next number, while no other claim is open, before it reads the state, and commits
by renaming its claim, so deltas are always taken against all numbers below. Who meets an open claim waits; a claim older than
`lease` seconds is taken for that of a lost writer and renamed to a void one. Only one of two renames of a claim can succeed, so a
writer that was slow and not lost finds its claim gone and starts anew. The lease has to be longer than a commit takes (a shorter one
costs repeated work, not right totals), and clocks of writers must agree within it. The folder's file system must
create and rename files in one step, as HDFS and POSIX ones do.

State lies in buckets of documents. A commit reads the buckets that its documents are in, and of those only the rows of these
documents are grouped. compact() writes the last state of all documents as one table, and the sums of all deltas, so
that a commit doesn't read the history of its buckets again and again; commit() calls it after every COMPACT batches. vacuum() deletes
what no reader needs any more.

Results for odd input: an insert or revision of a live count replaces it; a delete or revision of
what isn't live (a revision then inserts) changes nothing twice; of several changes to one document and
version in one batch the one with the largest `seq` counts, then the largest count, operation, source and language by code
point, a null being smallest, so the order of rows never matters; null source or language is a group of
its own; a null count is 0; a null id is a document of its own; an empty batch commits and changes nothing; extra columns are ignored.
"""

from __future__ import annotations

import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["doc_id", "tokenizer"]
GROUP = ["source", "lang", "tokenizer"]
STATE = "doc_id long, tokenizer string, source string, lang string, n_tokens long, live boolean, commit long, bucket int"
DELTA = "source string, lang string, tokenizer string, docs long, tokens long, commit long"
#: Buckets of the state, and commits after which it is compacted.
BUCKETS, COMPACT = 64, 16
#: Seconds after which a claim without a commit is void.
LEASE = 3600.0
_BASE = "base"


class Rollup:
    """Totals below a folder of a Hadoop file system that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, compact_after: int = COMPACT, lease: float = LEASE) -> None:
        self.spark, self.root, self.buckets, self.compact_after, self.lease = spark, root.rstrip("/"), buckets, compact_after, lease
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [x.getPath().getName() for x in self._files.listStatus(path)] if self._files.exists(path) else []

    def commits(self) -> dict[str, int]:
        """Committed batches and their numbers; the compacted tables count by the number that they hold."""
        void = set(map(int, self._names("void")))
        return {m[2]: int(m[1]) for x in self._names("committed") if (m := re.fullmatch(r"(\d+)-(.+)", x)) and int(m[1]) not in void}

    def _since(self) -> tuple[list[str], list[str]]:
        """The newest compacted tables, if any, with the batches after them; and all batches."""
        done = self.commits()
        bases = sorted((n, x) for x, n in done.items() if x.startswith(f"{_BASE}~"))
        held = int(bases[-1][1].split("~")[1]) if bases else 0
        batches = sorted((n, x) for x, n in done.items() if not x.startswith(f"{_BASE}~"))
        return [f"{n:09d}-{x}" for n, x in [*bases[-1:], *(b for b in batches if b[0] > held)]], [x for _, x in batches]

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{kind}/{name}" for name in self._since()[0]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = [self.spark.read.schema(schema).parquet(p) for p in paths]
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        return rows

    def _last(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEY).agg(F.max_by(F.struct("source", "lang", "n_tokens", "live"), "commit").alias("x"))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def state(self) -> DataFrame:
        """The live counts: doc_id, tokenizer, source, lang, n_tokens."""
        return self._last(self._read("state", STATE)).where("x.live").select(*KEY, "x.source", "x.lang", "x.n_tokens")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens; groups without documents are gone."""
        sums = self._read("delta", DELTA).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")

    def touched_state(self, keys: DataFrame) -> DataFrame:
        """State rows of these documents and versions, from the buckets that they are in."""
        buckets = [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # self.buckets numbers at most
        own = keys.select(*KEY).distinct().select(*(F.col(c).alias(f"of_{c}") for c in KEY))
        rows = self._read("state", STATE).where(F.col("bucket").isin(buckets))
        return rows.join(own, rows["doc_id"].eqNullSafe(own["of_doc_id"]) & rows["tokenizer"].eqNullSafe(own["of_tokenizer"]), "left_semi")

    def _renamed(self, old: str, new: str) -> bool:
        """Whether this call has renamed the file; False where another writer has been faster."""
        self._files.mkdirs(self._path(f"{self.root}/{new}").getParent())
        try:
            return self._files.rename(self._path(f"{self.root}/{old}"), self._path(f"{self.root}/{new}"))
        except Py4JJavaError as e:
            if "FileNotFound" not in str(e.java_exception.getClass().getName()):
                raise
            return False

    def _open_claims(self) -> list[tuple[int, float]]:
        """Numbers of open claims and their age in seconds."""
        path = self._path(f"{self.root}/claimed")
        files = self._files.listStatus(path) if self._files.exists(path) else []
        return [(int(f.getPath().getName()), time.time() - f.getModificationTime() / 1000) for f in files]

    def _taken(self) -> list[int]:
        return [*(int(x.split("-")[0]) for x in self._names("committed")), *map(int, self._names("void"))]

    def _claim(self) -> int:
        """A number of this writer's own, above all that are decided, with no other claim open."""
        pause = 0.05
        while True:
            waits = False
            for number, age in self._open_claims():
                waits = age < self.lease or not self._renamed(f"claimed/{number:09d}", f"void/{number:09d}") or waits
            if waits:
                time.sleep(pause)
                pause = min(5.0, pause * 2)
                continue
            number = max(self._taken(), default=0) + 1
            self._files.mkdirs(self._path(f"{self.root}/claimed"))
            try:
                self._files.create(self._path(f"{self.root}/claimed/{number:09d}"), False).close()
            except Py4JJavaError as e:
                if "AlreadyExists" not in str(e.java_exception.getClass().getName()):
                    raise
                continue
            # a claim of this number may have been decided after the numbers were read
            if max(self._taken(), default=0) < number:
                return number
            self._files.delete(self._path(f"{self.root}/claimed/{number:09d}"), False)

    def _settled(self, number: int, name: str) -> bool:
        """Commit a claimed number; False where the claim has been voided meanwhile."""
        return self._renamed(f"claimed/{number:09d}", f"committed/{number:09d}-{name}") and name in self.commits()

    def _write(self, number: int, name: str, state: DataFrame, deltas: DataFrame, attempt: str) -> None:
        """Both tables, below a folder that only this writer knows, and then in their place."""
        mine = f"{attempt}/{number:09d}"
        state.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{mine}/state")
        deltas.write.parquet(f"{mine}/delta")
        for kind in ("state", "delta"):
            self._files.mkdirs(self._path(f"{self.root}/{kind}"))
            self._files.rename(self._path(f"{mine}/{kind}"), self._path(f"{self.root}/{kind}/{number:09d}-{name}"))

    def _attempt(self) -> str:
        return f"{self.root}/attempt-{uuid.uuid4().hex}"

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch of doc_id, tokenizer, source, lang, op (insert, delete, revise), n_tokens, seq. False: it had been applied."""
        if not re.fullmatch(r"[\w.-]+", batch_id):
            raise ValueError("a batch is named by letters, digits, _, . and -")
        n = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long"))
        if batch_id in self.commits():
            return False
        attempt = self._attempt()
        # changes may be dear to compute, and are read several times from here on
        new = self._stored(changes.groupBy(*KEY).agg(F.max(F.struct("seq", n.alias("n_tokens"), "op", "source", "lang")).alias("new")), f"{attempt}/new")
        done = False
        while not done:
            number = self._claim()
            if batch_id in self.commits():
                self._renamed(f"claimed/{number:09d}", f"void/{number:09d}")
                break
            old = self._last(self.touched_state(new)).where("x.live").select(*(F.col(c).alias(f"of_{c}") for c in KEY), F.struct("x.source", "x.lang", "x.n_tokens").alias("old"))
            same = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & F.col("tokenizer").eqNullSafe(F.col("of_tokenizer"))
            touched = self._stored(new.join(old, same, "left").where("new.op <> 'delete' or old is not null").select(*KEY, "new", "old"), f"{attempt}/touched-{number}")
            state = touched.select(*KEY, "new.source", "new.lang", "new.n_tokens", (F.col("new.op") != "delete").alias("live"), F.lit(number).cast("long").alias("commit"))
            signed = touched.select(F.inline(F.filter(F.array(
                F.struct(*(F.col(f"old.{c}").alias(c) for c in ("source", "lang")), "tokenizer", F.lit(-1).cast("long").alias("docs"), (-F.col("old.n_tokens")).alias("tokens"), F.col("old").isNotNull().alias("counts")),
                F.struct(*(F.col(f"new.{c}").alias(c) for c in ("source", "lang")), "tokenizer", F.lit(1).cast("long").alias("docs"), F.col("new.n_tokens").alias("tokens"), (F.col("new.op") != "delete").alias("counts")),
            ), lambda x: x["counts"])))
            deltas = signed.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
            self._write(number, batch_id, state, deltas.withColumn("commit", F.lit(number).cast("long")), attempt)
            done = self._settled(number, batch_id)
        self._files.delete(self._path(attempt), True)
        if done and self.compact_after and len(self._since()[0]) > self.compact_after:
            self.compact()
        return done

    def _stored(self, rows: DataFrame, path: str) -> DataFrame:
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def compact(self) -> None:
        """The last live state and the totals as tables that stand for all batches so far."""
        number, attempt = self._claim(), self._attempt()
        held = max(self.commits().values(), default=0)
        state = self.state().select(*KEY, "source", "lang", "n_tokens", F.lit(True).alias("live"), F.lit(held).cast("long").alias("commit"))
        name = f"{_BASE}~{held}"
        self._write(number, name, state, self.totals().withColumn("commit", F.lit(held).cast("long")), attempt)
        # a claim that was voided leaves the batches as they are; the next commit compacts
        self._settled(number, name)
        self._files.delete(self._path(attempt), True)

    def vacuum(self) -> int:
        """Delete tables that the newest compacted ones stand for, those of void numbers, and attempts older than the lease; the tables that went.

        To be called when no reader is busy with what compaction has replaced.
        """
        needed, open_numbers, gone = set(self._since()[0]), {n for n, _ in self._open_claims()}, 0
        for kind in ("state", "delta"):
            for name in self._names(kind):
                if name not in needed and int(name.split("-")[0]) not in open_numbers:
                    gone += self._files.delete(self._path(f"{self.root}/{kind}/{name}"), True)
        for f in self._files.listStatus(self._path(self.root)) if self._files.exists(self._path(self.root)) else []:
            if f.getPath().getName().startswith("attempt-") and time.time() - f.getModificationTime() / 1000 > self.lease:
                self._files.delete(f.getPath(), True)
        return gone


def change(rows: DataFrame, op: str, tokenizer: str, n_tokens: Column, seq: int = 0) -> DataFrame:
    """Changes of one kind for rows with doc_id, source and lang."""
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(tokenizer).alias("tokenizer"), "source", "lang", F.lit(op).alias("op"), n_tokens.cast("long").alias("n_tokens"), F.lit(seq).alias("seq"))
