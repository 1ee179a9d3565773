"""Steps joined into chains: documents, source text, vetting of knowledge, evidence of trusted papers, the graph of a corpus, stored runs
(inventory X-09, X-10, T-19, W-13, G-06, E-05, E-06, U-02, U-06, J-01, N-01, N-04, S-12, S-13, S-17, K-11, K-12)."""

from __future__ import annotations

import json
import os
from dataclasses import fields, is_dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions.confidence import mean_of, signal, succeeds
from quarryline.operators import dedup, evidence, graph, grounding, layout, quality
from quarryline.operators.errors import ConfigurationError, RepositoryError
from quarryline.plans.shared import written

#: Characters of a paper's source text that go to an extractor, by default.
SOURCE_CHARS = 12_000


# --- documents ---


def document_parts(blocks: DataFrame) -> dict[str, DataFrame]:
    """X-09: blocks in reading order (document_id, ord, page, text, size, bold) to sections, paragraphs, references, citations, captions, metadata and statistics."""
    found = layout.headings(blocks)
    sections, paras = layout.sections(found), layout.paragraphs(found)
    in_references = sections.where("kind = 'references'").select("document_id", "section_id")
    listed = layout.entries(paras.join(in_references, ["document_id", "section_id"], "left_semi"))
    references = listed.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("ord", "pos"))).withColumn("ref_id", F.concat(F.lit("r"), F.lpad((F.col("place") - 1).cast("string"), 3, "0")))
    references = references.select("document_id", "ref_id", "marker", "raw", F.col("place").alias("ord"), layout.parse_entry(F.col("raw")).alias("parsed"))
    body = paras.join(in_references, ["document_id", "section_id"], "left_anti")
    cited = layout.resolve_citations(layout.citations(body), references.select("document_id", "marker", "ref_id", "ord"))
    return {"sections": sections, "paragraphs": paras, "references": references, "citations": cited, "captions": layout.captions(blocks), "metadata": layout.self_metadata(blocks), "statistics": layout.document_statistics(blocks, paras, cited)}


def document_outcomes(papers: DataFrame, blocks: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("parser_version", "source_bytes")) -> DataFrame:
    """X-10: what becomes of each paper: reused (done before in this form), not_retrievable, failed (no text) or processed; one paper's failure is a row, not an error."""
    known = done.select("document_id", *keys).distinct().withColumn("known", F.lit(True))
    text = blocks.groupBy("document_id").agg(F.sum(F.length(F.trim("text"))).alias("chars"))
    joined = papers.join(known, ["document_id", *keys], "left").join(text, "document_id", "left")
    outcome = F.when(F.col("known"), "reused").when(~F.col("retrievable"), "not_retrievable").when(F.coalesce("chars", F.lit(0)) == 0, "failed").otherwise("processed")
    return joined.select("document_id", outcome.alias("outcome"))


def source_text(paragraphs: DataFrame, sections: DataFrame, kinds: tuple[str, ...] = (), most_chars: int | None = SOURCE_CHARS) -> DataFrame:
    """T-19, W-13: per document the text of the sections of these kinds (else of all but references), as headed blocks in order.

    Blocks are taken while their running length stays within `most_chars` (None: all of them); the first that passes it
    is cut there. document_id, text, n_blocks and whole (nothing was left out).
    """
    wanted = sections.where(F.col("kind").isin(*kinds)) if kinds else sections.where("kind <> 'references'")
    held = paragraphs.groupBy("document_id", "section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_index", "text"))), lambda p: p.text), "\n\n").alias("body"))
    if kinds:  # a document without any such section gives its whole body
        none = sections.join(wanted.select("document_id").distinct(), "document_id", "left_anti").where("kind <> 'references'")
        wanted = wanted.unionByName(none)
    block = F.concat(F.lit("## "), F.col("title"), F.lit("\n"), F.col("body"))
    order = Window.partitionBy("document_id").orderBy("section_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = wanted.join(held, ["document_id", "section_id"]).select("document_id", "section_id", block.alias("block")).withColumn("upto", F.sum(F.length("block")).over(order))
    left = F.lit(most_chars) - (F.col("upto") - F.length("block")) if most_chars is not None else F.length("block")
    cut = placed.withColumn("left", left).withColumn("kept", F.when(F.col("left") > 0, F.substr("block", F.lit(1), F.least("left", F.length("block")).cast("int"))))
    return cut.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kept").isNotNull(), F.struct("section_id", "kept")))), lambda b: b.kept), "\n\n").alias("text"), F.count("kept").alias("n_blocks"), F.bool_and(F.length("kept") == F.length("block")).alias("whole"))


# --- knowledge and evidence ---


def vetted_objects(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G-06: objects that pass the completeness and evidence checks, one per name and kind, and a verdict for each paper.

    Objects have id, ord, paper_id, kind, name, description, quotes, n_located, confidence and evidence_ids.
    """
    complete = quality.completeness(objects).withColumnRenamed("issues", "found").withColumnRenamed("confidence", "c1").drop("success")
    judged = quality.object_evidence(complete).withColumn("all_issues", F.concat("found", "issues")).withColumn("passed", succeeds(F.col("all_issues")))
    kept = objects.join(judged.where("passed").select("id"), "id", "left_semi")
    merged = dedup.dedup_objects(kept)
    per_paper = judged.groupBy("paper_id").agg(F.count(F.lit(1)).alias("proposed"), F.count_if("passed").alias("accepted"), F.countDistinct(F.when(F.col("passed"), F.col("kind"))).alias("n_kinds"), F.sum(F.when(F.col("passed"), F.size("evidence_ids")).otherwise(0)).alias("n_evidence"))
    verdicts = quality.knowledge_coverage(per_paper.withColumn("n_objects", F.col("accepted")))
    return merged, verdicts.select("paper_id", "proposed", "accepted", "issues", "confidence", "success")


def vetted_relations(objects: DataFrame, by_name: list[tuple[DataFrame, str, str, str]], by_place: list[tuple[str, str, str]]) -> DataFrame:
    """G-06, G-08: relations among vetted objects, from names in results and from shared places, each once."""
    parts = [grounding.relate_by_name(results, objects, wanted, kind, predicate) for results, wanted, kind, predicate in by_name]
    parts += [grounding.relate_by_place(objects, left, right, predicate) for left, right, predicate in by_place]
    return grounding.unite_relations(*parts)


def trusted_evidence(quotes: DataFrame, wanted: DataFrame, knowledge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E-05: the evidence of wanted papers (paper_id) whose knowledge is there and trusted, and the papers that were skipped, with the reason."""
    known = wanted.distinct().join(knowledge.select("paper_id", "trusted"), "paper_id", "left")
    skipped = known.where("NOT coalesce(trusted, false)").select("paper_id", F.when(F.col("trusted").isNull(), "no_knowledge").otherwise("untrusted").alias("reason"))
    return evidence.index_evidence(quotes.join(known.where("trusted").select("paper_id"), "paper_id", "left_semi")), skipped


def bundle_by_id(bundles: DataFrame, bundle_id: str) -> DataFrame:
    """E-06."""
    return bundles.where(F.col("bundle_id") == bundle_id)


def bundles_for_question(bundles: DataFrame, question_id: str) -> DataFrame:
    """E-06."""
    return bundles.where(F.col("question_id") == question_id)


def bundle_evidence(rows: DataFrame, object_id=None, stance: str | None = None) -> DataFrame:
    """E-06: the evidence of a bundle, of one of its objects, or of one stance."""
    out = rows if object_id is None else rows.where(F.array_contains("object_ids", object_id))
    return out if stance is None else out.where(F.col("stance") == stance)


def bundle_objects(objects: DataFrame, kind: str) -> DataFrame:
    """E-06."""
    return objects.where(F.col("kind") == kind)


def conflicts(results: DataFrame, objects: DataFrame, attributes: tuple[tuple[str, str], ...], tolerance: float = 0.05) -> DataFrame:
    """U-02: conflicts of values and of stated attributes in one table: id, kind, about, left_id, right_id, confidence."""
    found = evidence.value_contradictions(results, tolerance).select("id", "kind", F.col("metric").cast("string").alias("about"), "left_id", "right_id", "confidence")
    for kind, attribute in attributes:
        found = found.unionByName(evidence.attribute_contradictions(objects, kind, attribute).select("id", "kind", F.col("name_key").alias("about"), "left_id", "right_id", "confidence"))
    return found


def conflict_counts(results: DataFrame, objects: DataFrame, attributes: tuple[tuple[str, str], ...], tolerance: float = 0.05) -> DataFrame:
    """U-02, counted: kind, n. Contradicting attributes are counted by aggregates, since their pairs grow with the square of a name's objects."""
    values = evidence.value_contradictions(results, tolerance).agg(F.count(F.lit(1)).alias("n"))
    stated = None
    for kind, attribute in attributes:
        part = evidence.attribute_conflict_count(objects, kind, attribute)
        stated = part if stated is None else stated.unionAll(part)
    out = values.select(F.lit("value_conflict").alias("kind"), "n")
    return out if stated is None else out.unionAll(stated.agg(F.sum("n").alias("n")).select(F.lit("attribute_conflict").alias("kind"), "n"))


def ordered_union(*parts: Column) -> Column:
    """U-06: the ids of several lists, each where it stands first."""
    return F.array_distinct(F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts)))


def resolved_hits(hits: DataFrame, objects: DataFrame, limit: int) -> DataFrame:
    """J-01: vector hits (id, score) whose object is still there and trusted, best first; a hit that can't be resolved is dropped."""
    known = objects.where("trusted").select("id", "kind", "paper_id")
    return hits.join(known, "id").orderBy(F.desc("score"), "id").limit(limit)


# --- graph ---


def corpus_graph(papers: DataFrame, objects: DataFrame, relations: DataFrame, contradictions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """N-01, N-02: nodes of papers and merged knowledge, the edges among them that are accepted, and the report."""
    nodes = graph.paper_nodes(papers).unionByName(graph.merge_nodes(objects))
    judged = graph.validate_edges(graph.build_edges(objects, relations, contradictions), nodes, require_provenance=False)
    return nodes, judged.where("reason IS NULL").select("id", "kind", "source_id", "target_id", "grounded", "confidence"), graph.report(judged)


def graph_versions(spark: SparkSession, path: str) -> list[str]:
    """N-04, S-17: the generations that are stored."""
    return sorted(r["graph_version"] for r in spark.read.parquet(f"{path}/nodes").select("graph_version").distinct().collect())


def read_generation(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, DataFrame]:
    """S-17: nodes and edges of one generation; only its partition is read."""
    return tuple(spark.read.parquet(f"{path}/{name}").where(F.col("graph_version") == version).drop("graph_version") for name in ("nodes", "edges"))


def delete_generation(spark: SparkSession, path: str, version: str) -> bool:
    """N-04: whether there was such a generation; the others stay."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    gone = False
    for name in ("nodes", "edges"):
        at = fs_path(f"{path}/{name}/graph_version={version}")
        gone = at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True) or gone
    return gone


# --- stored records, configuration, runs ---


def json_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """S-12: the records of a folder of JSON files, one each, and the files that are corrupt, which a listing tolerates."""
    raw = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("file", F.input_file_name())
    raw = written(raw, "records")  # parsed once, for both
    return raw.where("_corrupt IS NULL").drop("_corrupt", "file"), raw.where("_corrupt IS NOT NULL").select("file")


def json_record(spark: SparkSession, path: str, schema: str) -> dict | None:
    """S-12: one record by its path, null if there is none; here a corrupt file is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    good, bad = json_records(spark, path, schema)
    row = good.first()
    if row is None or not bad.isEmpty():
        raise RepositoryError(f"corrupt record {path}")
    return row.asDict(recursive=True)


@lru_cache(maxsize=64)
def load_config(path: str, schema: type):
    """S-13: a JSON file as a dataclass, read once; fields that are unknown, missing or of another type are an error."""
    if not is_dataclass(schema):
        raise ConfigurationError(f"{schema!r} is no dataclass")
    if not os.path.exists(path):
        raise ConfigurationError(f"no configuration {path}")
    try:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
    except ValueError as e:
        raise ConfigurationError(f"{path}: {e}") from e
    known = {f.name: f for f in fields(schema)}
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise ConfigurationError(f"{path}: unknown fields {', '.join(unknown)}")
    for name, value in given.items():
        kind = known[name].type if isinstance(known[name].type, type) else {"int": int, "float": float, "str": str, "bool": bool}.get(known[name].type)
        if kind and not isinstance(value, (int, float) if kind is float else kind):
            raise ConfigurationError(f"{path}: {name} must be {kind.__name__}")
    try:
        return schema(**given)
    except TypeError as e:
        raise ConfigurationError(f"{path}: {e}") from e


def index_library(records: DataFrame, papers: DataFrame, run_id: str, flags: list[str]) -> DataFrame:
    """K-11: all papers of the manual library upserted into the records."""
    new = papers.select(F.col("id").alias("paper_id"), *(F.lit(f in ("discovered", "downloaded")).alias(f) for f in flags), F.current_timestamp().alias("discovered_at"), F.col("local_path").alias("pdf_path"), F.array(F.lit(run_id)).alias("run_ids"))
    return dedup.upsert_records(records, new, flags)


class Checkpoints:
    """K-12: states of runs, kept in memory, or appended to a table at `path` if one is given."""

    def __init__(self, spark: SparkSession | None = None, path: str | None = None):
        self.spark, self.path, self.held = spark, path, {}

    def save(self, run_id: str, step: int, state: dict) -> None:
        self.held.setdefault(run_id, []).append((step, state))
        if self.path:
            self.spark.createDataFrame([(run_id, step, json.dumps(state, default=str))], "run_id string, step int, state string").write.mode("append").parquet(self.path)

    def latest(self, run_id: str) -> dict | None:
        if self.path:
            row = self.spark.read.schema("run_id string, step int, state string").parquet(self.path).where(F.col("run_id") == run_id).agg(F.max_by("state", "step").alias("state")).first()
            return json.loads(row["state"]) if row["state"] else None
        return max(self.held[run_id], key=lambda x: x[0])[1] if run_id in self.held else None


def run_confidence(parts: dict[str, Column]) -> Column:
    """A-01 over named parts."""
    return mean_of(F.array(*(signal(n, c) for n, c in parts.items())))
