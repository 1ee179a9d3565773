"""The supplied tables in the roles of the engine's own: objects, papers, quotes, results, graph and telemetry.

Each role is a DataFrame here and a SQL common table expression of the same name for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels (16 bytes each) are broadcast up to this number; more are joined by shuffle.
BROADCAST_LABELS = 1_000_000
KINDS = ("method", "dataset", "metric", "result", "limitation", "future_work")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as an object: its first line is the name, its second the description, all others its quotes; toxic ones aren't trusted."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels  # so that texts stay where they are
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    o = d.join(labels, "doc_id", "left").select("*", lines.alias("lines"))
    quotes = F.slice("lines", F.lit(3), F.greatest(F.size("lines") - 2, F.lit(0)))
    return o.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("ord"), F.get(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 6).cast("int")).alias("kind"),
        F.col("source").alias("paper_id"), F.get("lines", F.lit(0)).alias("name"), F.coalesce(F.get("lines", F.lit(1)), F.lit("")).alias("description"), quotes.alias("quotes"),
        (F.lit(0.3) + (F.col("doc_id") % 7) / 10).alias("confidence"), F.size(quotes).cast("long").alias("n_evidence"), (F.coalesce("toxic", F.lit(0)) == 0).alias("trusted"), "text",
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as a paper: its first line is the title, all others the abstract."""
    d = table(spark, sf_dir, "documents").withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    abstract = F.array_join(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))), "\n")
    return d.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.get("lines", F.lit(0)).alias("title"), abstract.alias("abstract"),
        F.when(F.col("doc_id") % 9 != 0, (2000 + F.col("doc_id") % 26).cast("int")).alias("year"), F.when(F.col("doc_id") % 7 != 0, F.col("n_chars") % 700).alias("citation_count"), F.array("lang", "source").alias("keywords"), F.col("source").alias("provider"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of an order as a reported value: the part is the metric, the supplier the dataset, the order the paper.

    Order and line number don't identify a line, so the order of a pair is that of (order, line, quantity, price).
    """
    li = table(spark, sf_dir, "lineitem")
    place = F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).cast("decimal(18,2)"))
    return li.select(name.alias("id"), place.alias("ord"), F.col("l_orderkey").cast("string").alias("paper_id"), F.col("l_partkey").cast("string").alias("metric"), F.col("l_suppkey").cast("string").alias("dataset"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))


def graph_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as methods that share 64 names, in as many papers as there are nations."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("ord"), F.lit("method").alias("kind"), F.col("p_name").alias("name"), F.concat(F.lit("n"), (F.col("p_partkey") % 25).cast("string")).alias("paper_id"), (F.lit(0.5) + (F.col("p_size") % 5) / 10).alias("confidence"), F.array(F.concat(F.lit("e"), (F.col("p_partkey") % 100).cast("string"))).alias("evidence_ids"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts evaluated on suppliers, suppliers limiting nations; every seventh pair has no provenance."""
    li, p, s = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    pairs = li.join(p, li["l_partkey"] == p["p_partkey"]).select("p_name", "l_suppkey").distinct()
    on = pairs.select(F.concat(F.lit("m:"), "p_name").alias("source_id"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("target_id"), F.lit("EVALUATED_ON").alias("kind"), (F.col("l_suppkey") % 7 != 0).alias("grounded"))
    of = s.select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("n:"), F.col("s_nationkey").cast("string")).alias("target_id"), F.lit("MENTIONS").alias("kind"), F.lit(True).alias("grounded"))
    made = p.select(F.concat(F.lit("r:"), F.col("p_partkey").cast("string")).alias("source_id"), F.concat(F.lit("m:"), "p_name").alias("target_id"), F.lit("PRODUCED_BY").alias("kind"), F.lit(True).alias("grounded"))
    by = p.select(F.concat(F.lit("r:"), F.col("p_partkey").cast("string")).alias("source_id"), F.concat(F.lit("k:"), "p_brand").alias("target_id"), F.lit("MEASURED_BY").alias("kind"), (F.col("p_size") % 2 == 0).alias("grounded"))
    every = on.unionByName(of).unionByName(made).unionByName(by)
    return every.select(F.concat_ws("--", "source_id", "kind", "target_id").alias("id"), "*")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of the edges; nations are left out, so edges to them dangle."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    named = lambda df, prefix, col, kind: df.select(F.concat(F.lit(prefix), F.col(col).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(col).cast("string").alias("name")).distinct()
    return named(p, "m:", "p_name", "method").unionByName(named(s, "s:", "s_suppkey", "dataset")).unionByName(named(p, "r:", "p_partkey", "result")).unionByName(named(p, "k:", "p_brand", "metric"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.operators.layout import page_blocks

    return page_blocks(table(spark, sf_dir, "pages"))


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks: short ones are set large, every fifth bold."""
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text"))
    size = F.when(F.length("text") < 25, 12.0).otherwise(10.0)
    return lines.select("document_id", "ord", (F.floor(F.col("ord") / 20) + 1).cast("int").alias("page"), "text", size.alias("size"), (F.col("ord") % 5 == 4).alias("bold"))


OBJECTS = """objects AS (
  SELECT 'd' || d.doc_id AS id, d.doc_id AS ord, ['method','dataset','metric','result','limitation','future_work'][CAST(d.doc_id % 6 + 1 AS INT)] AS kind, d.source AS paper_id,
    l[1] AS name, coalesce(l[2], '') AS description, l[3:] AS quotes, 0.3::DOUBLE + (d.doc_id % 7)::DOUBLE / 10 AS confidence, CAST(len(l[3:]) AS BIGINT) AS n_evidence, coalesce(t.toxic, 0) = 0 AS trusted, text
  FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d LEFT JOIN labels t USING (doc_id))"""

PAPERS = """papers AS (
  SELECT 'd' || doc_id AS id, l[1] AS title, array_to_string(l[2:], chr(10)) AS abstract, CASE WHEN doc_id % 9 <> 0 THEN CAST(2000 + doc_id % 26 AS INT) END AS year,
    CASE WHEN doc_id % 7 <> 0 THEN n_chars % 700 END AS citation_count, [lang, source] AS keywords, source AS provider
  FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"""

RESULTS = """results AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || CAST(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2)) AS VARCHAR) AS id, (l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate) AS ord,
    CAST(l_orderkey AS VARCHAR) AS paper_id, CAST(l_partkey AS VARCHAR) AS metric, CAST(l_suppkey AS VARCHAR) AS dataset, l_extendedprice / l_quantity AS value FROM lineitem)"""

GRAPH_OBJECTS = """gobjects AS (
  SELECT 'p' || p_partkey AS id, p_partkey AS ord, 'method' AS kind, p_name AS name, 'n' || (p_partkey % 25) AS paper_id, 0.5::DOUBLE + (p_size % 5)::DOUBLE / 10 AS confidence, ['e' || (p_partkey % 100)] AS evidence_ids FROM part)"""

GRAPH = """gedges AS (SELECT source_id || '--' || kind || '--' || target_id AS id, * FROM (
  SELECT DISTINCT 'm:' || p_name AS source_id, 's:' || l_suppkey AS target_id, 'EVALUATED_ON' AS kind, l_suppkey % 7 <> 0 AS grounded FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'MENTIONS', true FROM supplier
  UNION ALL SELECT 'r:' || p_partkey, 'm:' || p_name, 'PRODUCED_BY', true FROM part
  UNION ALL SELECT 'r:' || p_partkey, 'k:' || p_brand, 'MEASURED_BY', p_size % 2 = 0 FROM part)),
gnodes AS (SELECT DISTINCT 'm:' || p_name AS id, 'method' AS kind, p_name AS name FROM part UNION ALL SELECT 's:' || s_suppkey, 'dataset', CAST(s_suppkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'r:' || p_partkey, 'result', CAST(p_partkey AS VARCHAR) FROM part UNION ALL SELECT DISTINCT 'k:' || p_brand, 'metric', p_brand FROM part)"""

LINE_BLOCKS = """blocks AS (
  SELECT doc_id AS document_id, CAST(i - 1 AS INT) AS ord, CAST(floor((i - 1) / 20) + 1 AS INT) AS page, t AS text, CASE WHEN length(t) < 25 THEN 12.0::DOUBLE ELSE 10.0::DOUBLE END AS size, (i - 1) % 5 = 4 AS bold
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents))"""
