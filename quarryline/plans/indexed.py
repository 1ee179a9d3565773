"""Queries over a postings index: every text is read when the index is made, and the items of `benchmark` are the questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import StreamingQueryException

from quarryline.functions import text as T
from quarryline.functions.confidence import codes
from quarryline.operators import evidence, postings
from quarryline.plans import roles
from quarryline.plans.shared import shared_dir
from quarryline.plans.sqltext import norm, toks
from quarryline.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _index(spark, sf, *fields: str, batches: int = 1) -> postings.PostingsIndex:
    """The trusted objects with the fields that a query asks for, taken in by `batches` batches of whole sources."""
    o = roles.objects(spark, sf).where("trusted")
    body = F.concat_ws(" ", F.coalesce("description", F.lit("")), F.array_join("quotes", " "))
    rows = o.withColumn("body", body).select("id", *fields, "kind", "paper_id", "confidence", "n_evidence", T.normalise(F.col("name")).alias("name_key"))
    index = postings.PostingsIndex.create(spark)
    for k in range(batches):
        index.append(rows if batches == 1 else rows.where(F.pmod(F.xxhash64("paper_id"), F.lit(batches)) == k), f"batch {k}")
    return index


def _questions(spark, sf):
    return roles.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_WORDS = f"w AS (SELECT id, list_filter(string_split({norm('coalesce(text, chr(32))')}, ' '), lambda x: length(x) > 1) AS w FROM objects WHERE trusted)"

#: Shares of the questions' words in names and bodies, for all questions and objects.
_LEXICAL = f"""q AS (SELECT item_id AS query_id, {toks("coalesce(text, '')")} AS terms FROM benchmark),
o AS (SELECT *, {toks("name")} AS nw, {toks("description || ' ' || array_to_string(quotes, ' ')")} AS bw FROM objects WHERE trusted),
qt AS (SELECT query_id, unnest(terms) AS term FROM q),
nh AS (SELECT query_id, id, count(*) AS n FROM (SELECT id, unnest(nw) AS term FROM o) JOIN qt USING (term) GROUP BY ALL),
bh AS (SELECT query_id, id, count(*) AS n FROM (SELECT id, unnest(bw) AS term FROM o) JOIN qt USING (term) GROUP BY ALL),
base AS (SELECT q.query_id, o.id, o.kind, o.paper_id, o.name, o.confidence, o.n_evidence,
  coalesce(nh.n, 0) / greatest(len(terms), 1)::DOUBLE + 0.8::DOUBLE * (coalesce(bh.n, 0) / greatest(len(terms), 1)::DOUBLE) + 0.6::DOUBLE * o.confidence + 0.4::DOUBLE * least(o.n_evidence / 3::DOUBLE, 1) AS s
  FROM q CROSS JOIN o LEFT JOIN nh USING (query_id, id) LEFT JOIN bh USING (query_id, id)),
lx AS (SELECT *, round(least(s / 2.8::DOUBLE, 1), 6) AS score FROM base)"""

_CROSS = f"""wide AS (SELECT *, {norm("name")} AS k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM lx WHERE score > 0) WHERE rn <= 50),
ag AS (SELECT query_id, k, count(DISTINCT paper_id) AS n FROM wide GROUP BY ALL),
cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score2 DESC, id) AS rank FROM (SELECT w.*, round(least((s + 0.9::DOUBLE * least(n / 3::DOUBLE, 1)) / 3.7::DOUBLE, 1), 6) AS score2 FROM wide w JOIN ag USING (query_id, k))) WHERE rank <= 10)"""


@query(f"""WITH {roles.OBJECTS}, {_WORDS}, qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(list_filter(string_split({norm("text")}, ' '), lambda x: length(x) > 1)) AS term FROM benchmark) GROUP BY ALL),
st AS (SELECT count(*)::DOUBLE AS docs, avg(len(w)) AS mean FROM w), p AS (SELECT id, n, term, count(*) AS tf FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query_id, id, round(sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score FROM p JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL)
SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""")
def indexed_bm25(spark, sf):
    """R-02, R-12: every item of `benchmark` against all trusted texts."""
    return postings.bm25(_index(spark, sf, "text"), _questions(spark, sf))


@query(f"""WITH {roles.OBJECTS}, {_LEXICAL} SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lx WHERE score > 0) WHERE rank <= 10""")
def indexed_lexical(spark, sf):
    """R-01."""
    return postings.lexical(_index(spark, sf, "name", "body"), _questions(spark, sf)).select("query_id", "id", "score", "rank")


@query(f"""WITH {roles.OBJECTS}, {_LEXICAL}, {_CROSS} SELECT query_id, id, score2 AS score, CAST(rank AS INT) AS rank FROM cp""")
def indexed_cross_paper(spark, sf):
    """R-09."""
    return postings.cross_paper(_index(spark, sf, "name", "body"), _questions(spark, sf)).select("query_id", "id", "score", "rank")


@query(f"""WITH q AS (SELECT item_id AS query_id, {toks("coalesce(text, '')")} AS terms FROM benchmark), e AS (SELECT doc_id AS id, {toks("coalesce(text, '')")} AS w, doc_id % 5 AS precision FROM documents),
m AS (SELECT query_id, id, count(*) AS matched FROM (SELECT id, unnest(w) AS term FROM e) JOIN (SELECT query_id, unnest(terms) AS term FROM q) USING (term) GROUP BY ALL),
t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, id) <= 40),
s AS (SELECT query_id, id, matched, round(least((0.8::DOUBLE * (matched / len(terms)::DOUBLE) + 0.5::DOUBLE * least(precision / 4::DOUBLE, 1)) / 1.3::DOUBLE, 1), 6) AS score FROM t JOIN q USING (query_id) JOIN e USING (id))
SELECT query_id, id, matched, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""")
def indexed_evidence(spark, sf):
    """R-07: whole texts as quotes."""
    d = roles.table(spark, sf, "documents")
    quotes = d.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), (F.col("doc_id") % 5).cast("long").alias("precision"))
    index = postings.PostingsIndex.create(spark)
    index.append(quotes, "quotes")
    return postings.evidence_search(index, _questions(spark, sf)).select("query_id", "id", "matched", "score", "rank")


@query(f"""WITH {roles.OBJECTS}, {_WORDS} SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest(w) AS term FROM w) GROUP BY term""")
def indexed_terms(spark, sf):
    """A-28: the words of an index made by three batches."""
    return _index(spark, sf, "text", batches=3).terms()


@query(f"""WITH {roles.OBJECTS}, {_LEXICAL}, {_CROSS}, kept AS (SELECT * FROM cp WHERE score2 >= 0.05),
n AS (SELECT id, least(count(*) FILTER (trim(x) <> ''), 3) AS held FROM (SELECT id, unnest(quotes) AS x FROM objects) GROUP BY id),
c AS (SELECT k.*, coalesce(n.held, 0) AS e FROM kept k LEFT JOIN n USING (id)),
h AS (SELECT query_id, array_to_string(list_sort(list_distinct(array_agg(paper_id))), ',') AS papers, array_to_string(list_sort(list_distinct(array_agg(kind))), ',') AS kinds, count(*) AS n_objects, CAST(sum(e) AS BIGINT) AS n_evidence,
  count(*) FILTER (e > 0) AS with_evidence, count(*) FILTER (e = 0) AS without_evidence, avg(confidence) AS mean, count(DISTINCT paper_id) AS p FROM c GROUP BY query_id)
SELECT b.item_id AS query_id, CASE WHEN len({toks("coalesce(text, '')")}) = 0 THEN 'failed' WHEN n_objects IS NULL THEN 'empty' ELSE 'built' END AS status, papers, kinds, n_objects, n_evidence, with_evidence, without_evidence,
  round((mean + with_evidence / n_objects::DOUBLE + least(p / 3::DOUBLE, 1) + least(n_evidence / n_objects::DOUBLE / 2, 1)) / 4, 6) AS confidence,
  CASE WHEN n_objects IS NOT NULL THEN concat_ws(',', CASE WHEN n_evidence = 0 THEN 'bundle_without_evidence' END, CASE WHEN without_evidence > 0 AND n_evidence > 0 THEN 'objects_without_evidence' END, CASE WHEN p = 0 THEN 'no_supporting_papers' END, CASE WHEN p = 1 THEN 'single_source_coverage' END) END AS codes,
  sha1(CAST(b.item_id AS VARCHAR) || '|' || coalesce(text, '') || '||')[1:16] AS bundle_key
FROM benchmark b LEFT JOIN h ON h.query_id = b.item_id""")
def question_bundles(spark, sf):
    """E-01, E-04: a bundle for every item of `benchmark`; the lines of a document, from the third on, are the evidence of its object."""
    o = roles.objects(spark, sf)
    lines = o.select(F.col("id").alias("object_id"), F.posexplode("quotes").alias("at", "quote")).where(F.trim("quote") != "").withColumn("evidence_id", F.concat_ws(":", "object_id", "at"))
    found = lines.select("evidence_id", (F.col("at") % 5).alias("precision"))
    made = evidence.question_bundles(_index(spark, sf, "name", "body"), lines.select("object_id", "evidence_id"), found, _questions(spark, sf))["bundles"]
    key = F.regexp_extract("bundle_id", "([0-9a-f]+)$", 1)
    return made.select("query_id", "status", F.array_join("papers", ",").alias("papers"), F.array_join("kinds", ",").alias("kinds"), "n_objects", "n_evidence", "with_evidence", "without_evidence", "confidence", codes(F.col("issues")).alias("codes"), key.alias("bundle_key"))


@query("""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, source AS paper_id, doc_id % 3 AS run, sha256(coalesce(text, '')) AS sha, length(trim(coalesce(text, ''), ' ')) AS chars FROM documents),
p AS (SELECT paper_id, count(*) FILTER (chars > 0) AS n_documents, string_agg(DISTINCT 'run ' || run, ',' ORDER BY 'run ' || run) AS run_ids FROM d GROUP BY 1)
SELECT document_id, paper_id, sha, chars, CASE WHEN chars = 0 THEN 'failed' ELSE 'processed' END AS outcome, n_documents, run_ids FROM d JOIN p USING (paper_id)""")
def stream_equals_batch(spark, sf):
    """ST-01: documents that come in three parts through a stream, of which the second dies before it counts and is replayed."""
    d = roles.table(spark, sf, "documents")
    docs = d.select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("paper_id"), "text", F.concat(F.lit("run "), (F.col("doc_id") % 3).cast("string")).alias("run_id"))
    folder = shared_dir(spark)
    table, died = ingest.IngestTable(spark, f"{folder}/table"), []

    def dies_once(batch: int) -> None:
        if batch == 1 and not died:
            died.append(batch)
            raise RuntimeError("killed before it counts")

    for k in range(3):
        docs.where(F.col("run_id") == f"run {k}").write.parquet(f"{folder}/in/{k}")
        source = spark.readStream.schema(docs.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        try:
            table.drain(source, f"{folder}/checkpoint", dies_once)
        except StreamingQueryException:
            table.drain(source, f"{folder}/checkpoint", dies_once)
    papers = table.records().select("paper_id", "n_documents", F.array_join("run_ids", ",").alias("run_ids"))
    return table.outcomes().join(F.broadcast(papers) if papers.count() <= roles.BROADCAST_LABELS else papers, "paper_id")
