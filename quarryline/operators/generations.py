"""Generations of a graph in buckets with digests, and what changed between two of them (inventory N-06, K-05).

A generation is written by buckets of ids, with a digest of each bucket beside it that doesn't depend on the order of rows:
their number and two sums of 64-bit hashes of whole rows. Two generations are compared by their digests, a row per bucket;
only buckets whose digests differ are read, and their rows cancel out by counting, without a join.

Cases: repeated rows count, so one copy more or fewer of a row is told as added or removed; null ids are an id like others; generations
without rows, or that were never written, have no digests and differ from others in all that those have. Columns that only
one of the two has count as null in the other; a bucket that holds the same rows under another number of buckets can't be
told to be the same, so all generations of a path have one number of buckets, which is kept with the digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.errors import RepositoryError

BUCKETS = 64
DIGESTS = "what string, bucket int, n long, sum_a decimal(38,0), sum_b decimal(38,0), buckets int"


def _row(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})


def digests(rows: DataFrame, what: str, buckets: int = BUCKETS) -> DataFrame:
    """A row for each bucket of ids."""
    row, bucket = _row(rows.columns), F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    total = lambda c: F.sum(c.cast("decimal(20,0)")).cast("decimal(38,0)")
    said = rows.select(bucket.alias("bucket"), row.alias("row"))
    sums = said.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), total(F.xxhash64("row")).alias("sum_a"), total(F.xxhash64(F.lit(1), "row")).alias("sum_b"))
    return sums.select(F.lit(what).alias("what"), "bucket", "n", "sum_a", "sum_b", F.lit(buckets).alias("buckets"))


def store(parts: dict[str, DataFrame], version: str, path: str, buckets: int = BUCKETS) -> None:
    """K-05: replaces one generation, `parts` by name, each with a column id; the digests come last and make it count."""
    spark = next(iter(parts.values())).sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    at = fs_path(f"{path}/digests/graph_version={version}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    said = None
    for what, rows in parts.items():
        keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
        keyed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{what}/graph_version={version}")
        one = digests(spark.read.schema(rows.schema).parquet(f"{path}/{what}/graph_version={version}"), what, buckets)
        said = one if said is None else said.unionAll(one)
    said.coalesce(1).write.mode("overwrite").parquet(f"{path}/digests/graph_version={version}")


def _said(spark: SparkSession, path: str, version: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/digests/graph_version={version}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], DIGESTS)
    return spark.read.schema(DIGESTS).parquet(f"{path}/digests/graph_version={version}")


def differing(spark: SparkSession, path: str, before: str, after: str) -> DataFrame:
    """(what, bucket) of the buckets that aren't the same in both, from the digests alone; N-06: none after a rebuild."""
    a, b = _said(spark, path, before), _said(spark, path, after)
    if a.unionAll(b).agg(F.countDistinct("buckets")).first()[0] > 1:
        raise RepositoryError(f"generations {before} and {after} have other numbers of buckets")
    return a.unionAll(b).groupBy("what", "bucket", "n", "sum_a", "sum_b").count().where("count = 1").select("what", "bucket").distinct()


def changes(spark: SparkSession, path: str, what: str, before: str, after: str, schema: str) -> DataFrame:
    """id, change (added, removed, changed), the fields that changed, and the rows before and after; reads differing buckets only.

    The list of buckets comes to the driver: as many numbers as there are buckets at most.
    """
    named = [f.name for f in spark.createDataFrame([], schema).schema]
    buckets = sorted(r.bucket for r in differing(spark, path, before, after).where(F.col("what") == what).collect())
    known = {v for v in (before, after) if not _said(spark, path, v).isEmpty()}

    def side(version: str, sign: int) -> DataFrame:
        if version not in known:
            return spark.createDataFrame([], f"{schema}, sign int")
        # the buckets are folders, so the filter says which files are read
        rows = spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/{what}/graph_version={version}").where(F.col("bucket").isin(buckets))
        return rows.drop("bucket").withColumn("sign", F.lit(sign))

    left = side(before, -1).unionByName(side(after, 1)).groupBy(*named).agg(F.sum("sign").alias("n")).where("n <> 0")
    row = F.struct(*named)
    by_id = left.groupBy("id").agg(F.min(F.when(F.col("n") < 0, row)).alias("before"), F.min(F.when(F.col("n") > 0, row)).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    differs = [F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in sorted(named) if c != "id"]
    fields = F.when(change == "changed", F.array_compact(F.array(*differs)))
    return by_id.select("id", change.alias("change"), fields.alias("fields"), "before", "after")
