"""Exact top-k search over binary codes by incremental multi-index hashing.

A code's bits are cut into segments of 16. If two codes differ in at most m * (r + 1) - 1 bits, one of
their m segments differs in at most r. So the search looks up, in an index of (segment, value), all
values within radius r of a query's segments, verifies the whole Hamming distance of what it finds,
and raises r until the distance of the k-th best is within the bound above: nothing nearer can be missing.
From the first k found on, the join passes on only codes within the k-th distance.

Equal codes are one entry with their k smallest ids, so a vector that a third of all rows share is
one code to look at; map tasks limit such groups before the shuffle. Equal queries are searched once.

Results for odd input: ties go to the smaller id; a query finds itself; null or empty vectors have no
code and are neither searched nor found; a null element is a zero bit; shorter vectors count as
padded with zero bits; with fewer than k vectors all are returned; rows with equal ids count one by one;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.shared import written

SEGMENT = 16


def sign_code(vector: Column, dims: int) -> Column:
    """The signs of a vector as 64-bit words: bit i of word j is set where element 64 j + i is above zero."""

    def word(j: int) -> Column:
        bits = F.transform(F.slice(vector, 64 * j + 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return F.array(*(word(j) for j in range((dims + 63) // 64)))


def distance(a: str, b: str, words: int) -> Column:
    return sum((F.bit_count(F.col(a)[j].bitwiseXOR(F.col(b)[j])) for j in range(1, words)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def segments(code: Column, count: int) -> Column:
    values = [F.struct(F.lit(j).alias("segment"), F.shiftrightunsigned(code[j // 4], SEGMENT * (j % 4)).bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int").alias("value")) for j in range(count)]
    return F.inline(F.array(*values))


def search(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (1 is nearest), id, distance: the k nearest rows of df for each row of queries."""
    spark = df.sparkSession
    whole = F.size(F.col(vector_col)) > 0
    dims = df.where(whole).agg(F.max(F.size(vector_col))).first()[0] or 1
    words, count = (dims + 63) // 64, -(-dims // SEGMENT)
    coded = lambda x: x.where(whole).select(F.col(id_col).cast("long").alias("id"), sign_code(F.col(vector_col), dims).alias("code"))
    few = coded(df).withColumn("n", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("n") <= k)
    codes = written(few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    there = codes.agg(F.sum(F.size("ids"))).first()[0] or 0
    k = min(k, there)
    asked = written(coded(queries), "asked")
    index = written(codes.select("code", "ids", segments(F.col("code"), count)), "index")
    masks = spark.range(1 << SEGMENT).select(F.col("id").cast("int").alias("mask"), F.bit_count("id").cast("int").alias("radius"))
    active = written(asked.select(F.col("code").alias("query"), F.lit(64 * words).alias("most")).distinct(), "active")
    best, done = None, None
    for radius in range(SEGMENT + 1):
        if not there or active.isEmpty():
            break
        parts = active.select("query", "most", segments(F.col("query"), count)).withColumn("radius", F.lit(radius))
        probes = parts.join(F.broadcast(masks.where(F.col("radius") == radius)), "radius").select("query", "most", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        found = probes.join(index, ["segment", "value"]).withColumn("distance", distance("query", "code", words)).where(F.col("distance") <= F.col("most"))
        found = found.select("query", "code", "ids", "distance")
        if best is not None:
            found = found.unionByName(best.join(active.select("query"), "query", "left_semi"))
        # the k best ids are in the k best codes, each placed by its smallest id
        nearest = W.partitionBy("query").orderBy("distance", F.col("ids")[0])
        best = written(found.distinct().withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).drop("n"), f"best{radius}")
        ranked = best.select("query", "distance", F.explode("ids").alias("id"))
        ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))).where(F.col("rank") <= k)
        bound = count * (radius + 1) - 1 if radius < SEGMENT else 64 * words
        reached = ranked.groupBy("query").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n"))
        over = reached.where((F.col("n") >= k) & (F.col("far") <= bound)).select("query")
        ready = ranked.join(over, "query", "left_semi")
        done = ready if done is None else done.unionByName(ready)
        left = active.join(over, "query", "left_anti").drop("most").join(reached.where(F.col("n") >= k).select("query", F.col("far").alias("most")), "query", "left")
        active = written(left.select("query", F.coalesce("most", F.lit(64 * words)).alias("most")), f"active{radius}")
    if done is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, distance int")
    return asked.join(done.withColumnRenamed("query", "code").withColumnRenamed("id", "found"), "code").select(F.col("id").alias("query_id"), "rank", F.col("found").alias("id"), "distance")
