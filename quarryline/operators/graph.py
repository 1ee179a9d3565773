"""Knowledge graph (inventory N-01 to N-06, J-12 to J-18, A-13 to A-16, A-24, F-15, Q-13, W-11).

Nodes: id, kind, name, paper_ids, evidence_ids, confidence. Edges: id, kind, source_id, target_id, grounded, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import ids
from quarryline.plans.shared import written

#: The kinds that an edge may join.
EDGE_TYPES = {
    "EVALUATED_ON": ("method", "dataset"),
    "MEASURED_BY": ("result", "metric"),
    "REPORTED_ON": ("result", "dataset"),
    "PRODUCED_BY": ("result", "method"),
    "LIMITS": ("limitation", "method"),
    "EXTENDS": ("future_work", "limitation"),
}
MAX_DEPTH = 3


def object_nodes(objects: DataFrame) -> DataFrame:
    """object_id and node_id."""
    return objects.select(F.col("id").alias("object_id"), ids.node_id(F.col("kind"), F.col("name"), F.col("paper_id")).alias("node_id"))


def merge_nodes(objects: DataFrame) -> DataFrame:
    """A-13: one node per id; papers and evidence united and sorted; the first object's confidence, and a signal of agreement
    for each further one: distinct papers so far, three agree fully.

    The running number of papers only matters up to three, so it follows from where the second and the third paper of a
    node first appear; no list of a node's objects is gathered.
    """
    keyed = objects.withColumn("node_id", ids.node_id(F.col("kind"), F.col("name"), F.col("paper_id")))
    firsts = keyed.groupBy("node_id", "paper_id").agg(F.min("ord").alias("seen"))
    nth = firsts.withColumn("nth", F.row_number().over(Window.partitionBy("node_id").orderBy("seen", "paper_id"))).where("nth <= 3")
    marks = nth.groupBy("node_id").agg(F.max(F.when(F.col("nth") == 2, F.col("seen"))).alias("second"), F.max(F.when(F.col("nth") == 3, F.col("seen"))).alias("third"))
    agreed = F.when(F.col("second").isNull() | (F.col("ord") < F.col("second")), 1 / 3).when(F.col("third").isNull() | (F.col("ord") < F.col("third")), 2 / 3).otherwise(1.0)
    first = F.min_by(F.struct("kind", "name", "confidence"), F.struct("ord", "id"))
    nodes = keyed.join(marks, "node_id").groupBy("node_id").agg(first.alias("f"), F.sum(agreed).alias("agreed"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("paper_id")).alias("paper_ids"))
    linked = keyed.select("node_id", F.explode("evidence_ids").alias("e")).groupBy("node_id").agg(F.array_sort(F.collect_set("e")).alias("evidence_ids"))
    none = F.array().cast("array<string>")
    # the first object counts with its own confidence instead of a signal of agreement
    confidence = F.round((F.col("f.confidence") + F.col("agreed") - 1 / 3) / F.col("n"), 6)
    return nodes.join(linked, "node_id", "left").select(F.col("node_id").alias("id"), "f.kind", F.substring("f.name", 1, 200).alias("name"), "paper_ids", F.coalesce("evidence_ids", none).alias("evidence_ids"), confidence.alias("confidence"))


def paper_nodes(papers: DataFrame) -> DataFrame:
    return papers.select(F.concat(F.lit("paper:"), "paper_id").alias("id"), F.lit("paper").alias("kind"), F.substring(F.coalesce("title", "paper_id"), 1, 200).alias("name"), F.array("paper_id").alias("paper_ids"), F.array().cast("array<string>").alias("evidence_ids"), F.lit(1.0).alias("confidence")).dropDuplicates(["id"])


def build_edges(objects: DataFrame, relations: DataFrame, contradictions: DataFrame) -> DataFrame:
    """J-12, A-14: mentions (first wins), relations (highest confidence), contradictions (last wins); ends that are missing or equal are dropped."""
    node = object_nodes(objects)
    o = objects.join(node, F.col("id") == F.col("object_id"))
    edge = lambda df, kind: df.withColumn("kind", kind).withColumn("id", ids.edge_id(F.col("source_id"), F.col("kind"), F.col("target_id")))
    grounded = F.size("evidence_ids") > 0
    mentions = edge(o.select(F.concat(F.lit("paper:"), "paper_id").alias("source_id"), F.col("node_id").alias("target_id"), grounded.alias("grounded"), "confidence", "ord"), F.lit("MENTIONS"))

    def ends(df: DataFrame, a: str, b: str) -> DataFrame:
        s, t = node.toDF(a, "source_id"), node.toDF(b, "target_id")
        return df.join(s, a).join(t, b).where("source_id <> target_id")

    related = edge(ends(relations, "subject_id", "object_id").select("source_id", "target_id", "grounded", "confidence", "ord", F.upper("predicate").alias("k")), F.col("k")).drop("k")
    against = edge(ends(contradictions, "left_id", "right_id").select("source_id", "target_id", "grounded", "confidence", "ord"), F.lit("CONTRADICTS"))
    worth = lambda value, place: F.struct(value.cast("double").alias("value"), place.cast("long").alias("place"))
    rank = F.when(F.col("kind") == "MENTIONS", worth(-F.col("ord"), -F.col("ord"))).when(F.col("kind") == "CONTRADICTS", worth(F.col("ord"), F.col("ord"))).otherwise(worth(F.col("confidence"), -F.col("ord")))
    every = mentions.unionByName(related).unionByName(against)
    return every.groupBy("id").agg(F.max_by(F.struct("kind", "source_id", "target_id", "grounded", "confidence"), rank).alias("e")).select("id", "e.*")


def edge_problem(kind: Column, source: Column, target: Column, grounded: Column | None = None) -> Column:
    """Q-13: why an edge is refused, null if it isn't; source and target are the kinds of its ends, null where there is none."""
    allowed = F.lit(None).cast("string")
    for k, (s, t) in EDGE_TYPES.items():
        allowed = F.when(kind == k, F.when(source != s, "source_kind_mismatch").when(target != t, "target_kind_mismatch")).otherwise(allowed)
    out = (
        F.when(source.isNull() | target.isNull(), "dangling_endpoint")
        .when((kind == "MENTIONS") & ((source != "paper") | (target == "paper")), "mentions_must_run_paper_to_knowledge")
        .when((kind == "CONTRADICTS") & ((source == "paper") | (target == "paper")), "contradiction_between_papers_not_knowledge")
        .when((kind == "CONTRADICTS") & (source != target), "contradiction_between_different_kinds")
        .when(kind.isin("MENTIONS", "CONTRADICTS"), None)
        .when(~kind.isin(*EDGE_TYPES), "unknown_edge_kind")
        .otherwise(allowed)
    )
    return out if grounded is None else F.coalesce(out, F.when(~grounded, "no_provenance"))


def validate_edges(edges: DataFrame, nodes: DataFrame, require_provenance: bool = True) -> DataFrame:
    """J-13: every edge with `reason`, null for those that are accepted."""
    s, t = nodes.select(F.col("id").alias("source_id"), F.col("kind").alias("source_kind")), nodes.select(F.col("id").alias("target_id"), F.col("kind").alias("target_kind"))
    joined = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    return joined.withColumn("reason", edge_problem(F.col("kind"), F.col("source_kind"), F.col("target_kind"), F.col("grounded") if require_provenance else None))


def rejections(validated: DataFrame) -> DataFrame:
    """A-24."""
    return validated.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def report(validated: DataFrame) -> DataFrame:
    """N-02, N-03: proposed, accepted and rejected edges, and the share with provenance."""
    return validated.agg(F.count(F.lit(1)).alias("proposed"), F.count_if(F.expr("reason IS NULL")).alias("accepted"), F.count_if(F.expr("reason IS NOT NULL")).alias("rejected"), F.round(F.avg(F.col("grounded").cast("double")), 6).alias("provenance_coverage"))


def version_of(objects: DataFrame, schema: int = 1, extraction: int = 1, relation: int = 1) -> DataFrame:
    """A-27: the version of a generation."""
    return objects.agg(F.collect_set("paper_id").alias("p"), F.count(F.lit(1)).alias("n")).select(ids.graph_version(schema, extraction, relation, ids.graph_fingerprint(F.col("p"), F.col("n"))).alias("version"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A-15: nodes and edges by kind, and their totals."""
    counted = nodes.select(F.lit("node").alias("what"), "kind").unionAll(edges.select(F.lit("edge").alias("what"), "kind"))
    return counted.rollup("what", "kind").agg(F.count(F.lit(1)).alias("n"))


def find_nodes(nodes: DataFrame, kind: str | None = None, name: str | None = None, limit: int | None = None) -> DataFrame:
    """F-15: by kind and part of the name, in either case."""
    out = nodes if kind is None else nodes.where(F.col("kind") == kind)
    out = out if name is None else out.where(F.lower("name").contains(name.lower()))
    return out.orderBy("id").limit(limit) if limit else out


def neighbours(edges: DataFrame, start: DataFrame, depth: int = 1) -> DataFrame:
    """J-14: nodes reached from `start` (start_id) in at most `depth` undirected steps, without the start, with their distance.

    Each step joins only the nodes that the last one found, and drops those that were there before.
    """
    depth = max(1, min(depth, MAX_DEPTH))
    links = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionAll(edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))).distinct()
    seen = start.select("start_id", F.col("start_id").alias("node_id"), F.lit(0).alias("distance"))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(links, front["node_id"] == links["a"]).select("start_id", F.col("b").alias("node_id")).distinct()
        front = written(step.join(seen, ["start_id", "node_id"], "left_anti").withColumn("distance", F.lit(d)), "front")
        seen = seen.unionByName(front)
    return seen.where("distance > 0")


def reachable(spark, edges_view: str, start: str, depth: int) -> DataFrame:
    """J-14 by a recursive query over a view (source_id, target_id): nodes and least distances."""
    return spark.sql(f"""
        WITH RECURSIVE hop(node_id, distance) AS (
          SELECT '{start}', 0
          UNION ALL
          SELECT e.b, h.distance + 1 FROM hop h JOIN (SELECT source_id a, target_id b FROM {edges_view} UNION SELECT target_id, source_id FROM {edges_view}) e ON e.a = h.node_id WHERE h.distance < {int(depth)}
        ) SELECT node_id, min(distance) AS distance FROM hop GROUP BY node_id""")


def edges_between(edges: DataFrame, a: str, b: str) -> DataFrame:
    """J-15: in either direction."""
    return edges.where(((F.col("source_id") == a) & (F.col("target_id") == b)) | ((F.col("source_id") == b) & (F.col("target_id") == a)))


def connected_entities(edges: DataFrame, nodes: DataFrame, kind: str, other_kind: str, edge_kind: str) -> DataFrame:
    """J-16: entities joined by one edge, the forward one if there is one, else the reverse: methods for a dataset, datasets for a method."""
    own = nodes.where(F.col("kind") == kind).select(F.col("id").alias("entity_id"))
    others = nodes.where(F.col("kind") == other_kind).select(F.col("id").alias("other_id"), F.col("name").alias("other_name"))
    e = edges.where(F.col("kind") == edge_kind)
    ways = e.select(F.col("source_id").alias("entity_id"), F.col("target_id").alias("other_id"), F.lit(0).alias("way"), "id").unionAll(e.select(F.col("target_id").alias("entity_id"), F.col("source_id").alias("other_id"), F.lit(1).alias("way"), "id"))
    return ways.join(own, "entity_id").join(others, "other_id").groupBy("entity_id", "other_id", "other_name").agg(F.min_by("id", F.struct("way", "id")).alias("edge_id"))


def metrics_for_method(edges: DataFrame) -> DataFrame:
    """J-17: method, result produced by it, metric it is measured by."""
    made = edges.where("kind = 'PRODUCED_BY'").select(F.col("source_id").alias("result_id"), F.col("target_id").alias("method_id"))
    measured = edges.where("kind = 'MEASURED_BY'").select(F.col("source_id").alias("result_id"), F.col("target_id").alias("metric_id"))
    return made.join(measured, "result_id").groupBy("method_id", "metric_id").agg(F.count(F.lit(1)).alias("n_results"))


def papers_using(edges: DataFrame) -> DataFrame:
    """J-18: papers that mention each entity."""
    return edges.where("kind = 'MENTIONS'").groupBy(F.col("target_id").alias("entity_id")).agg(F.countDistinct("source_id").alias("n_papers"))


def shared_entities(nodes: DataFrame, least: int = 2) -> DataFrame:
    """A-16, O-06: entities of at least `least` papers."""
    return nodes.where(F.col("kind") != "paper").select("id", "name", "kind", F.size("paper_ids").alias("n_papers")).where(F.col("n_papers") >= least).orderBy(F.desc("n_papers"), "name", "id")


def shared_datasets(edges: DataFrame, least: int = 2) -> DataFrame:
    """A-16: datasets that at least `least` methods are evaluated on."""
    return edges.where("kind = 'EVALUATED_ON'").groupBy(F.col("target_id").alias("dataset_id")).agg(F.countDistinct("source_id").alias("n_methods")).where(F.col("n_methods") >= least)


def contradictions(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'CONTRADICTS'")


def provenance_for(nodes: DataFrame, node_id: str) -> DataFrame:
    """N-05: papers and evidence behind a node."""
    return nodes.where(F.col("id") == node_id).select("id", "paper_ids", "evidence_ids")


def latest_version(versions: DataFrame) -> DataFrame:
    """W-11, O-08."""
    return versions.agg(F.max_by("version", F.struct("created_at", "version")).alias("version"))


def write_generation(nodes: DataFrame, edges: DataFrame, version: str, path: str) -> None:
    """K-05: replaces one generation, leaves the others; rebuilding it again changes nothing."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.withColumn("graph_version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_version").parquet(f"{path}/{name}")
