"""Retrieval metrics and benchmark runs (inventory M-01 to M-10, A-26).

Rankings: query_id, rank, object_id. Gold: query_id, object_id, gain (relevant if above 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)
GAINS = {"high": 3.0, "medium": 2.0, "low": 1.0}
IDENTITY = ("gold_fingerprint", "corpus_fingerprint", "index_version", "model_fingerprint", "strategy", "weights", "schema_version", "limit")


def _dcg(gain: Column, rank: Column) -> Column:
    return gain / F.log2(rank + 1)


def evaluate(rankings: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """M-01 to M-06: precision (over what was retrieved), recall, reciprocal rank and nDCG per query, rounded to 4 places.

    Queries of the gold set without a ranking score 0.
    """
    judged = gold.where("gain > 0").select("query_id", "object_id", "gain")
    hits = rankings.join(judged, ["query_id", "object_id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    per_k = []
    for k in ks:
        top = F.col("rank") <= k
        per_k += [F.count_if(top & (F.col("gain") > 0)).alias(f"hits_{k}"), F.count_if(top).alias(f"seen_{k}"), F.sum(F.when(top, _dcg(F.col("gain"), F.col("rank"))).otherwise(0.0)).alias(f"dcg_{k}")]
    found = hits.groupBy("query_id").agg(*per_k, F.min(F.when(F.col("gain") > 0, F.col("rank"))).alias("first"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "object_id"))
    ideal = judged.withColumn("rank", order).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"), *(F.sum(F.when(F.col("rank") <= k, _dcg(F.col("gain"), F.col("rank"))).otherwise(0.0)).alias(f"ideal_{k}") for k in ks))
    joined = gold.select("query_id").distinct().join(found, "query_id", "left").join(ideal, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share = lambda a, b: F.round(zero(F.when(F.col(b) > 0, F.col(a) / F.col(b))), 4)
    out = [F.round(zero(1 / F.col("first")), 4).alias("reciprocal_rank")]
    for k in ks:
        out += [share(f"hits_{k}", f"seen_{k}").alias(f"precision_{k}"), share(f"hits_{k}", "n_relevant").alias(f"recall_{k}"), share(f"dcg_{k}", f"ideal_{k}").alias(f"ndcg_{k}")]
    return joined.select("query_id", *out)


def macro(per_query: DataFrame) -> DataFrame:
    """A-26: means over queries, rounded to 4 places."""
    return per_query.agg(*(F.round(F.avg(c), 4).alias(c) for c in per_query.columns if c != "query_id"), F.count(F.lit(1)).alias("n_queries"))


def evidence_coverage(expected: DataFrame, found: DataFrame) -> DataFrame:
    """M-05: share of the expected evidence (query_id, evidence_id) that was found."""
    e = expected.distinct()
    got = e.join(found.select("query_id", "evidence_id").distinct(), ["query_id", "evidence_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("query_id").agg(F.count(F.lit(1)).alias("of")).join(got, "query_id", "left").select("query_id", F.round(F.coalesce("n", F.lit(0)) / F.col("of"), 4).alias("coverage"))


def run_benchmark(arms: dict[str, DataFrame | None], gold: DataFrame, reviewed: bool) -> tuple[DataFrame | None, list[str], bool]:
    """M-07: macro metrics by arm, the arms that gave nothing, and whether the figures may be cited (reviewed gold, no arm lost)."""
    out, lost = None, [a for a, df in arms.items() if df is None]
    for name, df in arms.items():
        if df is not None:
            row = macro(evaluate(df, gold)).withColumn("arm", F.lit(name))
            out = row if out is None else out.unionByName(row)
    return out, lost, reviewed and not lost


def comparable(a: dict, b: dict) -> list[str]:
    """M-08: identity fields in which two runs differ; they may be compared if there is none."""
    return [f for f in IDENTITY if a.get(f) != b.get(f)]


def ablate(component_results: DataFrame, gold: DataFrame, splits=((1.0, 0.0), (0.7, 0.3), (0.5, 0.5), (0.3, 0.7), (0.0, 1.0))) -> DataFrame:
    """M-09: macro metrics of weighted fusion for several weights of two components, and of rank fusion."""
    from quarryline.operators.retrieval import rrf, weighted_fusion

    names = [r.component for r in component_results.select("component").distinct().orderBy("component").limit(2).collect()]
    weighted = lambda w: component_results.drop("weight").withColumn("weight", F.when(F.col("component") == names[0], w[0]).otherwise(w[1]))
    runs = [(f"{w[0]}/{w[1]}", weighted_fusion(weighted(w))) for w in splits] + [("rrf", rrf(weighted((1.0, 1.0))))]
    out = None
    for name, fused in runs:
        row = macro(evaluate(fused.withColumnRenamed("id", "object_id"), gold)).withColumn("split", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def missing_gold(gold: DataFrame, objects: DataFrame) -> DataFrame:
    """M-10, U-05: judged objects that don't exist."""
    return gold.select("object_id").distinct().join(objects.select("object_id"), "object_id", "left_anti")
