"""The registered queries of the engine's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions import ids
from quarryline.functions import text as T
from quarryline.functions.confidence import codes, level
from quarryline.operators import dedup, evaluation, evidence, graph, grounding, layout, loop, quality
from quarryline.operators import retrieval as R
from quarryline.plans import roles
from quarryline.plans.sqltext import STOP, norm, over, toks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
QUESTION = "the onion er thtion and reing that"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


LEXICAL = f"""q AS (SELECT {toks(f"'{QUESTION}'")} AS terms),
scored AS (SELECT o.*, round(least((1.0::DOUBLE * ({over(toks("name"), "terms")}) + 0.8::DOUBLE * ({over(toks("description || ' ' || array_to_string(quotes, ' ')"), "terms")}) + 0.6::DOUBLE * confidence + 0.4::DOUBLE * least(n_evidence::DOUBLE / 3, 1.0::DOUBLE)) / 2.8::DOUBLE, 1.0::DOUBLE), 6) AS score FROM objects o, q WHERE trusted)"""


# --- retrieval ---


@query(f"WITH {roles.OBJECTS}, {LEXICAL} SELECT id, score FROM scored WHERE score > 0 ORDER BY score DESC, id LIMIT 10")
def lexical_documents(spark, sf):
    return R.lexical(roles.objects(spark, sf), R.Query(QUESTION)).select("id", "score")


@query(f"""WITH {roles.OBJECTS}, {LEXICAL} SELECT id, kind, score FROM scored WHERE score > 0 AND kind IN ('method', 'dataset') AND confidence >= 0.5 ORDER BY score DESC, id LIMIT 10""")
def lexical_filtered(spark, sf):
    return R.lexical(roles.objects(spark, sf), R.Query(QUESTION, kinds=("method", "dataset"), min_confidence=0.5)).select("id", "kind", "score")


BM25 = f"""t AS (SELECT id, list_filter(string_split({norm("text")}, ' '), lambda w: length(w) > 1) AS w FROM objects WHERE trusted),
st AS (SELECT count(*)::DOUBLE AS docs, avg(len(w)) AS mean FROM t),
tf AS (SELECT id, len(w) AS n, term, times, len(list_filter(w, lambda x: x = term)) AS tf FROM t, (SELECT term, count(*) AS times FROM (SELECT unnest(list_filter(string_split({norm(f"'{QUESTION}'")}, ' '), lambda w: length(w) > 1)) AS term) GROUP BY term)),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
bm AS (SELECT id, round(sum(CASE WHEN tf > 0 THEN times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean)) ELSE 0 END), 6) AS score FROM tf JOIN df USING (term), st GROUP BY id)"""


@query(f"WITH {roles.OBJECTS}, {BM25} SELECT id, score FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 10")
def bm25_documents(spark, sf):
    return R.bm25(roles.objects(spark, sf), R.Query(QUESTION), F.col("text"))


def _bm25_queries(spark):
    return spark.createDataFrame([("q1", "the onion er"), ("q2", "thtion reing reing"), ("q3", "que les der")], "query_id string, text string")


@query(f"""WITH {roles.OBJECTS}, t AS (SELECT id, list_filter(string_split({norm("text")}, ' '), lambda w: length(w) > 1) AS w FROM objects),
qs(query_id, q) AS (VALUES ('q1', 'the onion er'), ('q2', 'thtion reing reing'), ('q3', 'que les der')),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(string_split(q, ' ')) AS term FROM qs) GROUP BY ALL),
st AS (SELECT count(*)::DOUBLE AS docs, avg(len(w)) AS mean FROM t),
p AS (SELECT id, n, term, count(*) AS tf FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query_id, id, round(sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score FROM p JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL)
SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""")
def bm25_many_queries(spark, sf):
    return R.bm25_batch(roles.objects(spark, sf), _bm25_queries(spark), F.col("text"))


def _vectors(spark, sf):
    return roles.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


ASKED = [1.0 if i % 3 == 0 else (0.5 if i % 3 == 1 else -0.25) for i in range(64)]


@query(f"""SELECT vec_id AS id, label, round((list_cosine_similarity(embedding::DOUBLE[], {ASKED}::DOUBLE[]) + 1) / 2, 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 10""")
def knn_cosine(spark, sf):
    return R.semantic(_vectors(spark, sf), ASKED, 10).select("id", "label", "score")


@query(f"""SELECT vec_id AS id, round((list_cosine_similarity(embedding::DOUBLE[], {ASKED}::DOUBLE[]) + 1) / 2, 6) AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, id LIMIT 5""")
def knn_filtered(spark, sf):
    return R.semantic(_vectors(spark, sf).where("label = 3"), ASKED, 5).select("id", "score")


COMPONENTS = f"""comp AS (SELECT 'q' AS query_id, 'lexical' AS component, 1.0::DOUBLE AS weight, id, score FROM (SELECT id, score FROM scored WHERE score > 0 ORDER BY score DESC, id LIMIT 30)
  UNION ALL SELECT 'q', 'bm25', 0.5::DOUBLE, id, score FROM (SELECT id, score FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 30))"""


def _components(spark, sf):
    o, q = roles.objects(spark, sf), R.Query(QUESTION, limit=30)
    part = lambda df, name, w: df.select(F.lit("q").alias("query_id"), F.lit(name).alias("component"), F.lit(w).alias("weight"), "id", "score")
    return part(R.lexical(o, q), "lexical", 1.0).unionByName(part(R.bm25(o, q, F.col("text")), "bm25", 0.5))


@query(f"""WITH {roles.OBJECTS}, {LEXICAL}, {BM25}, {COMPONENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY score DESC, id) AS rk FROM comp),
f AS (SELECT query_id, id, round(least(sum(weight / (60 + rk)) / (1.5::DOUBLE / 61), 1.0::DOUBLE), 6) AS score FROM r GROUP BY ALL)
SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""")
def rrf_fusion(spark, sf):
    return R.rrf(_components(spark, sf))


@query(f"""WITH {roles.OBJECTS}, {LEXICAL}, {BM25}, {COMPONENTS}, r AS (SELECT *, min(score) OVER (PARTITION BY component) AS lo, max(score) OVER (PARTITION BY component) AS hi FROM comp),
f AS (SELECT query_id, id, round(least(sum(weight * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0::DOUBLE END) / 1.5::DOUBLE, 1.0::DOUBLE), 6) AS score FROM r GROUP BY ALL)
SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""")
def weighted_fusion(spark, sf):
    return R.weighted_fusion(_components(spark, sf))


@query(f"""WITH {roles.OBJECTS}, k AS (SELECT id, {norm("name")} AS name_key, paper_id FROM objects), a AS (SELECT name_key, count(DISTINCT paper_id) AS n FROM k GROUP BY 1)
SELECT id, n AS n_papers, round(least(n::DOUBLE / 3, 1.0::DOUBLE), 6) AS agreement FROM k JOIN a USING (name_key)""")
def cross_doc_agreement(spark, sf):
    return R.agreement(roles.objects(spark, sf)).select("id", "n_papers", F.round("agreement", 6).alias("agreement"))


@query(f"""WITH {roles.OBJECTS}, {LEXICAL}, w AS (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, id LIMIT 50), a AS (SELECT {norm("name")} AS k, count(DISTINCT paper_id) AS n FROM w GROUP BY 1)
SELECT id, round(least((score0 + 0.9::DOUBLE * least(n::DOUBLE / 3, 1.0::DOUBLE)) / 3.7::DOUBLE, 1.0::DOUBLE), 6) AS score FROM (
  SELECT w.id, n, 1.0::DOUBLE * ({over(toks("name"), "terms")}) + 0.8::DOUBLE * ({over(toks("description || ' ' || array_to_string(quotes, ' ')"), "terms")}) + 0.6::DOUBLE * confidence + 0.4::DOUBLE * least(n_evidence::DOUBLE / 3, 1.0::DOUBLE) AS score0
  FROM w JOIN a ON {norm("name")} = k, q) ORDER BY score DESC, id LIMIT 10""")
def cross_paper(spark, sf):
    return R.cross_paper(roles.objects(spark, sf), R.Query(QUESTION)).select("id", "score")


def tk(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def rtoks(c: str) -> str:
    return f"list_distinct(list_filter(string_split({tk(c)}, ' '), lambda w: length(w) > 2 AND w NOT IN ({STOP})))"


@query(f"""WITH {roles.PAPERS}, q AS (SELECT {rtoks(f"'{QUESTION}'")} AS terms),
s AS (SELECT id, title, year, citation_count, round(0.35::DOUBLE * ({over(rtoks("title"), "terms")}), 6) AS a, round(0.25::DOUBLE * ({over(rtoks("abstract"), "terms")}), 6) AS b,
  round(0.15::DOUBLE * len(list_intersect(list_distinct(list_transform(keywords, lambda x: lower(x))), ['en', 'src1']))::DOUBLE / 2, 6) AS c,
  round(0.15::DOUBLE * CASE WHEN year IS NULL THEN 0.5 WHEN year >= 2026 THEN 1 ELSE exp(-(2026 - year)::DOUBLE / 4) END, 6) AS d,
  round(0.10::DOUBLE * CASE WHEN citation_count IS NULL THEN 0.5 WHEN citation_count <= 0 THEN 0 ELSE least(ln(1 + citation_count) / ln(501), 1) END, 6) AS e FROM papers, q)
SELECT id, least(round(a + b + c + d + e, 6), 1.0::DOUBLE) AS score FROM s ORDER BY score DESC, coalesce(citation_count, 0) DESC, coalesce(year, 0) DESC, title, id LIMIT 20""")
def paper_rank(spark, sf):
    ranked = R.rank_papers(roles.papers(spark, sf), QUESTION, ["en", "src1"], 2026)
    return ranked.orderBy(F.desc("score"), F.desc(F.coalesce("citation_count", F.lit(0))), F.desc(F.coalesce("year", F.lit(0))), "title", "id").limit(20).select("id", "score")


@query(f"""WITH {roles.PAPERS}, q AS (SELECT {toks(f"'{QUESTION}'")} AS terms) SELECT id, round(greatest({over(toks("title"), "terms")}, 0.01::DOUBLE), 6) AS score FROM papers, q ORDER BY score DESC, id LIMIT 10""")
def document_search(spark, sf):
    return R.document_search(roles.papers(spark, sf), R.Query(QUESTION)).select("id", "score")


@query(f"""WITH {roles.PAPERS} SELECT id, {toks("title")} IS NOT NULL AS ok, len({toks("title")}) AS n_tokens, len({rtoks("title")}) AS n_ranking_tokens, {tk("title")} AS title_key FROM papers""")
def title_normalise(spark, sf):
    p = roles.papers(spark, sf)
    return p.select("id", F.lit(True).alias("ok"), F.size(T.tokens(F.col("title"))).cast("long").alias("n_tokens"), F.size(T.ranking_tokens(F.col("title"))).cast("long").alias("n_ranking_tokens"), T.title_key(F.col("title")).alias("title_key"))


@query(f"""WITH {roles.PAPERS} SELECT id, round({over(toks("abstract"), toks("title"))}, 6) AS overlap FROM papers""")
def token_overlap(spark, sf):
    return roles.papers(spark, sf).select("id", F.round(T.overlap(T.tokens(F.col("abstract")), T.tokens(F.col("title"))), 6).alias("overlap"))


# --- evidence ---


@query("""SELECT h AS content_hash, min(doc_id) AS evidence_id, count(*) AS n FROM (SELECT doc_id, substr(sha1('paper|s000|' || 'None' || '|' || lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))), 1, 20) AS h FROM documents) GROUP BY h""")
def evidence_index_dedup(spark, sf):
    d = roles.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.lit("paper").alias("paper_id"), F.lit("s000").alias("section_id"), F.lit(None).cast("int").alias("paragraph_index"), F.coalesce("text", F.lit("")).alias("quote"), F.col("doc_id").cast("string").alias("object_id"))
    return evidence.index_evidence(d).select("content_hash", "evidence_id", "n")


@query("""SELECT object_id, evidence_id, quantity FROM (SELECT o_custkey AS object_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS evidence_id, l_quantity AS quantity, row_number() OVER (PARTITION BY o_custkey ORDER BY l_quantity DESC, l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn <= 3""")
def evidence_walk_top3(spark, sf):
    li, o = roles.table(spark, sf, "lineitem"), roles.table(spark, sf, "orders")
    links = o.select(F.col("o_custkey").alias("object_id"), F.col("o_orderkey"))
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    ev = li.select(name.alias("evidence_id"), F.col("l_orderkey"), F.col("l_quantity").alias("quantity"))
    return evidence.first_per_group(links.join(ev, F.col("o_orderkey") == F.col("l_orderkey")), ["object_id"], [F.desc("quantity"), "evidence_id"], 3).select("object_id", "evidence_id", "quantity")


@query(f"""WITH {roles.RESULTS} SELECT least(l.id, l.id) || '--vs--' || r.id AS id, l.metric, l.dataset, round(abs(l.value - r.value) / greatest(abs(l.value), abs(r.value), 1e-9), 6) AS difference,
  round((least(abs(l.value - r.value) / greatest(abs(l.value), abs(r.value), 1e-9), 1) + CASE WHEN l.paper_id <> r.paper_id THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END) / 2, 6) AS confidence
  FROM results l JOIN results r ON l.metric = r.metric AND l.dataset = r.dataset AND l.ord < r.ord WHERE abs(l.value - r.value) / greatest(abs(l.value), abs(r.value), 1e-9) >= 0.05""")
def value_contradictions(spark, sf):
    return evidence.value_contradictions(roles.results(spark, sf)).select("id", "metric", "dataset", "difference", "confidence")


@query("""WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS ord, lower(p_name) AS k, p_brand AS paper_id, p_size % 2 = 0 AS pub FROM part)
SELECT l.id || '--attr--' || r.id AS id, l.k AS name_key FROM s l JOIN s r ON l.k = r.k AND l.ord < r.ord AND l.pub <> r.pub AND l.paper_id <> r.paper_id""")
def attribute_contradictions(spark, sf):
    p = roles.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("ord"), F.lit("dataset").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("paper_id"), (F.col("p_size") % 2 == 0).alias("is_public"))
    return evidence.attribute_contradictions(p, "dataset", "is_public").select("id", "name_key")


@query("""SELECT l_suppkey AS bundle_id, count(*) AS n_evidence, count(*) FILTER (l_returnflag = 'N') AS supporting, count(*) FILTER (l_returnflag = 'R') AS contradicting, count(*) FILTER (l_returnflag = 'A') AS "unknown", count(DISTINCT l_partkey) AS n_papers, count(DISTINCT (l_partkey, l_linenumber)) AS n_pages FROM lineitem GROUP BY 1""")
def bundle_statistics(spark, sf):
    li = roles.table(spark, sf, "lineitem")
    stance = F.when(F.col("l_returnflag") == "N", "supporting").when(F.col("l_returnflag") == "R", "contradicting").otherwise("unknown")
    return evidence.statistics(li.select(F.col("l_suppkey").alias("bundle_id"), stance.alias("stance"), F.col("l_partkey").alias("paper_id"), F.col("l_linenumber").alias("page")))


@query(f"""WITH {roles.OBJECTS} SELECT paper_id AS bundle_id, array_to_string(list_sort(list_distinct(array_agg(kind))), ',') AS kinds, count(*) FILTER (n_evidence > 0) AS with_evidence, count(*) FILTER (n_evidence = 0) AS without_evidence FROM objects GROUP BY 1""")
def coverage_counts(spark, sf):
    c = evidence.coverage(roles.objects(spark, sf).withColumn("bundle_id", F.col("paper_id")))
    return c.select("bundle_id", F.array_join("kinds", ",").alias("kinds"), "with_evidence", "without_evidence")


@query(f"""WITH {roles.OBJECTS}, b AS (SELECT kind AS bundle_id, avg(confidence) AS mean, count(*)::DOUBLE AS n, (count(*) FILTER (n_evidence > 0))::DOUBLE AS w, count(DISTINCT paper_id)::DOUBLE AS p, sum(n_evidence)::DOUBLE AS e FROM objects GROUP BY 1)
SELECT bundle_id, round((mean + w / n + least(p / 3, 1) + least(e / n / 2, 1)) / 4, 6) AS confidence, CASE WHEN (mean + w / n + least(p / 3, 1) + least(e / n / 2, 1)) / 4 < 0.8 THEN 'medium' ELSE 'high' END AS level FROM b""")
def bundle_confidence(spark, sf):
    b = roles.objects(spark, sf).groupBy(F.col("kind").alias("bundle_id")).agg(F.avg("confidence").alias("mean"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_evidence") > 0).alias("w"), F.countDistinct("paper_id").alias("p"), F.sum("n_evidence").alias("e"))
    c = evidence.bundle_confidence(F.col("mean"), F.col("w"), F.col("n"), F.col("p"), F.col("e"))
    return b.select("bundle_id", c.alias("confidence"), level(c).alias("level"))


# --- graph ---


@query(f"""WITH {roles.GRAPH_OBJECTS}, k AS (SELECT *, 'method:' || regexp_replace(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')[1:60] || ':' || substr(sha1(lower(name)), 1, 10) AS node_id FROM gobjects),
f AS (SELECT *, row_number() OVER w AS rn, len(list_distinct(array_agg(paper_id) OVER w)) AS so_far FROM k WINDOW w AS (PARTITION BY node_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT node_id AS id, min_by(name, ord) AS name, array_to_string(list_sort(list_distinct(array_agg(paper_id))), ',') AS papers, array_to_string(list_sort(list_distinct(flatten(array_agg(evidence_ids)))), ',') AS evidence,
  round(avg(CASE WHEN rn = 1 THEN confidence ELSE least(so_far::DOUBLE / 3, 1) END), 6) AS confidence FROM f GROUP BY node_id""")
def graph_nodes_merge(spark, sf):
    return graph.merge_nodes(roles.graph_objects(spark, sf)).select("id", "name", F.array_join("paper_ids", ",").alias("papers"), F.array_join("evidence_ids", ",").alias("evidence"), "confidence")


@query(f"""WITH {roles.GRAPH}, j AS (SELECT e.*, s.kind AS sk, t.kind AS tk FROM gedges e LEFT JOIN gnodes s ON e.source_id = s.id LEFT JOIN gnodes t ON e.target_id = t.id)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN sk IS NULL OR tk IS NULL THEN 'dangling_endpoint' WHEN kind = 'MENTIONS' THEN CASE WHEN sk <> 'paper' OR tk = 'paper' THEN 'mentions_must_run_paper_to_knowledge' END
  WHEN kind = 'EVALUATED_ON' AND sk <> 'method' OR kind IN ('PRODUCED_BY', 'MEASURED_BY') AND sk <> 'result' THEN 'source_kind_mismatch' WHEN NOT grounded THEN 'no_provenance' END AS reason FROM j) WHERE reason IS NOT NULL GROUP BY 1""")
def edge_validation_reasons(spark, sf):
    return graph.rejections(graph.validate_edges(roles.graph_edges(spark, sf), roles.graph_nodes(spark, sf)))


@query(f"""WITH {roles.GRAPH} SELECT count(*) AS n_edges, round(avg(CAST(grounded AS INT)), 6) AS provenance_coverage FROM gedges""")
def provenance_coverage(spark, sf):
    return roles.graph_edges(spark, sf).agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.avg(F.col("grounded").cast("int")), 6).alias("provenance_coverage"))


@query(f"""WITH {roles.GRAPH}, both_ways AS (SELECT source_id AS a, target_id AS b FROM gedges UNION SELECT target_id, source_id FROM gedges),
h1 AS (SELECT DISTINCT b AS n FROM both_ways WHERE a = 's:1' AND b <> 's:1'), h2 AS (SELECT DISTINCT w.b AS n FROM h1 JOIN both_ways w ON w.a = h1.n WHERE w.b <> 's:1' AND w.b NOT IN (SELECT n FROM h1))
SELECT n AS node_id, 1 AS distance FROM h1 UNION ALL SELECT n, 2 FROM h2""")
def neighbours_depth2(spark, sf):
    start = spark.createDataFrame([("s:1",)], "start_id string")
    return graph.neighbours(roles.graph_edges(spark, sf), start, 2).select("node_id", "distance")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 's:' || s_suppkey AS a, 'n:' || s_nationkey AS b FROM supplier), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
hop(n, d) AS (SELECT 'n:1', 0 UNION ALL SELECT w.b, d + 1 FROM hop JOIN w ON w.a = hop.n WHERE d < 2) SELECT n AS node_id, min(d) AS distance FROM hop GROUP BY n""")
def recursive_reach(spark, sf):
    s = roles.table(spark, sf, "supplier")
    s.select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("n:"), F.col("s_nationkey").cast("string")).alias("target_id")).distinct().createOrReplaceTempView("quarryline_edges")
    return graph.reachable(spark, "quarryline_edges", "n:1", 2)


@query(f"""WITH {roles.GRAPH} SELECT e.source_id AS entity_id, e.target_id AS other_id, t.name AS other_name FROM gedges e JOIN gnodes t ON e.target_id = t.id WHERE e.kind = 'EVALUATED_ON'""")
def datasets_for_method(spark, sf):
    e, n = roles.graph_edges(spark, sf), roles.graph_nodes(spark, sf)
    return graph.connected_entities(e, n, "method", "dataset", "EVALUATED_ON").select("entity_id", "other_id", "other_name")


@query("""SELECT 'm:' || p_name AS method_id, 'k:' || p_brand AS metric_id, count(*) AS n_results FROM part GROUP BY ALL""")
def metrics_two_hop(spark, sf):
    return graph.metrics_for_method(roles.graph_edges(spark, sf))


@query(f"""WITH {roles.GRAPH_OBJECTS} SELECT name, count(DISTINCT paper_id) AS n_papers FROM gobjects GROUP BY 1 HAVING count(DISTINCT paper_id) >= 20""")
def shared_entities(spark, sf):
    return graph.shared_entities(graph.merge_nodes(roles.graph_objects(spark, sf)), 20).select("name", F.col("n_papers").cast("long").alias("n_papers"))


@query("""SELECT 's:' || l_suppkey AS dataset_id, count(DISTINCT p_name) AS n_methods FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT p_name) >= 2""")
def shared_datasets(spark, sf):
    return graph.shared_datasets(roles.graph_edges(spark, sf))


@query(f"""WITH {roles.GRAPH}, u AS (SELECT 'node' AS what, kind FROM gnodes UNION ALL SELECT 'edge', kind FROM gedges) SELECT what, kind, count(*) AS n FROM u GROUP BY ROLLUP (what, kind)""")
def graph_stats(spark, sf):
    return graph.stats(roles.graph_nodes(spark, sf), roles.graph_edges(spark, sf))


@query(f"""WITH {roles.GRAPH_OBJECTS} SELECT 's1-x1-r1-c' || substr(sha1(array_to_string(list_sort(list_distinct(array_agg(paper_id))), '|') || '#' || count(*)), 1, 12) AS version FROM gobjects""")
def graph_version_fingerprint(spark, sf):
    return graph.version_of(roles.graph_objects(spark, sf))


@query("""SELECT target_id AS entity_id, n_papers FROM (SELECT 'n:' || s_nationkey AS target_id, count(DISTINCT s_suppkey) AS n_papers FROM supplier GROUP BY 1)""")
def papers_using(spark, sf):
    return graph.papers_using(roles.graph_edges(spark, sf))


# --- document structure ---

HEADS = f"""{roles.LINE_BLOCKS}, bs AS (SELECT document_id, arg_max(size, (chars, -first)) AS body_size FROM (SELECT document_id, size, sum(length(text)) AS chars, min(ord) AS first FROM blocks GROUP BY ALL) GROUP BY 1)"""


@query(f"WITH {HEADS} SELECT document_id, body_size FROM bs")
def body_font_mode(spark, sf):
    return layout.body_size(roles.line_blocks(spark, sf))


@query(f"WITH {roles.LINE_BLOCKS} SELECT document_id, median(length(text)) AS median_chars FROM blocks GROUP BY 1")
def median_block(spark, sf):
    return layout.median_length(roles.line_blocks(spark, sf))


ISLANDS = f"""{HEADS}, b AS (SELECT *, trim(text) AS t, CAST(len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS INT) AS words FROM blocks JOIN bs USING (document_id) WHERE trim(text) <> ''),
h AS (SELECT *, (length(t) <= 120 AND words <= 12 AND (larger OR bold OR numbered) AND round(CASE WHEN larger THEN 0.35 ELSE 0 END + CASE WHEN bold THEN 0.25 ELSE 0 END + CASE WHEN numbered THEN 0.25 ELSE 0 END + CASE WHEN words <= 8 THEN 0.1 ELSE 0 END + CASE WHEN numbered OR NOT regexp_matches(t, '[.,;]$') THEN 0.05 ELSE 0 END, 4) >= 0.35
   AND regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[\\s.:]+$', '') <> '') AS is_heading FROM (SELECT *, body_size > 0 AND size >= body_size * 1.08 AS larger, regexp_matches(t, '^((\\d+(\\.\\d+)*)|([IVXLC]+)|([A-Z](\\.\\d+)*))[.)]?\\s+\\S') AS numbered FROM b)),
n AS (SELECT *, sum(CAST(is_heading AS INT)) OVER (PARTITION BY document_id ORDER BY ord ROWS UNBOUNDED PRECEDING) - 1 AS n FROM h)"""


@query(f"""WITH {ISLANDS} SELECT document_id, count(*) FILTER (is_heading) AS n_headings, count(*) FILTER (NOT is_heading AND n >= 0) AS n_inside, count(*) FILTER (n < 0) AS n_before FROM n GROUP BY 1""")
def section_islands(spark, sf):
    found = layout.headings(roles.line_blocks(spark, sf))
    n = F.sum(F.col("is_heading").cast("int")).over(Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return found.withColumn("n", n).groupBy("document_id").agg(F.count_if("is_heading").alias("n_headings"), F.count_if((~F.col("is_heading")) & (F.col("n") >= 0)).alias("n_inside"), F.count_if(F.expr("n < 0")).alias("n_before"))


@query()
def sections_of_pages(spark, sf):
    return layout.sections(layout.headings(roles.blocks(spark, sf)))


@query()
def paragraphs_of_pages(spark, sf):
    return layout.paragraphs(layout.headings(roles.blocks(spark, sf))).select("document_id", "section_id", "paragraph_index", "text")


@query()
def page_metadata(spark, sf):
    return layout.self_metadata(roles.blocks(spark, sf))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def strip_tags(spark, sf):
    return roles.table(spark, sf, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


CAPTIONED = "(CASE WHEN page_id % 3 = 0 THEN 'Figure ' || page_id || ': ' || regexp_extract(url, '://([^/]*)', 1) WHEN page_id % 3 = 1 THEN 'Table ' || page_id || '. A table of ' || page_id ELSE 'table lookups dominate' END)"


@query(f"""WITH c AS (SELECT page_id, {CAPTIONED} AS t FROM pages) SELECT CAST(page_id AS VARCHAR) AS document_id, CASE WHEN page_id % 3 = 0 THEN 'f000' ELSE 't000' END AS caption_id, CASE WHEN page_id % 3 = 0 THEN 'Figure ' ELSE 'Table ' END || page_id AS label,
  trim(regexp_replace(t, '^(Figure|Table) \\d+[.:] ', '')) AS caption FROM c WHERE page_id % 3 = 1""")
def captions_regex(spark, sf):
    """Captions begin with a capital or a figure, which host names don't."""
    p = roles.table(spark, sf, "pages")
    b = p.select(F.col("page_id").cast("string").alias("document_id"), F.lit(0).alias("ord"), F.lit(1).alias("page"), F.expr(CAPTIONED).alias("text"))
    return layout.captions(b).select("document_id", "caption_id", "label", "caption")


REFS = "'[' || n_nationkey || '] A. Author. A title of nation ' || n_name || ' (20' || lpad(CAST(n_nationkey AS STRING), 2, '0') || ') [' || (n_nationkey + 1) || '] Another, B. Second title here, 1999. doi 10.1000/x' || n_nationkey"


@query("""WITH r AS (SELECT n_nationkey, n_name FROM nation) SELECT n_nationkey AS document_id, CAST(n_nationkey AS VARCHAR) AS marker, 'A. Author. A title of nation ' || n_name || ' (20' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || ')' AS raw, CAST(2000 + n_nationkey AS INT) AS year, NULL AS doi FROM r
UNION ALL SELECT n_nationkey, CAST(n_nationkey + 1 AS VARCHAR), 'Another, B. Second title here, 1999. doi 10.1000/x' || n_nationkey, 1999, '10.1000/x' || n_nationkey FROM r""")
def reference_split(spark, sf):
    n = roles.table(spark, sf, "nation").select(F.col("n_nationkey").alias("document_id"), F.lit(0).alias("ord"), F.lit(1).alias("page"), F.expr(REFS).alias("text"))
    e = layout.entries(n).withColumn("p", layout.parse_entry(F.col("raw")))
    return e.select("document_id", "marker", "raw", "p.year", "p.doi")


@query("""WITH c AS (SELECT p_partkey, unnest([p_size, p_size + 1]) AS m FROM part), r AS (SELECT n_nationkey AS m, max(n_name) AS ref FROM nation GROUP BY 1) SELECT p_partkey AS document_id, CAST(c.m AS VARCHAR) AS marker, ref AS ref_id FROM c LEFT JOIN r ON c.m = r.m""")
def citation_resolution(spark, sf):
    p = roles.table(spark, sf, "part").select(F.col("p_partkey").alias("document_id"), F.lit("s").alias("section_id"), F.lit(0).alias("paragraph_index"), F.expr("'as shown [' || p_size || ', ' || (p_size + 1) || ']'").alias("text"))
    found = layout.citations(p)
    refs = roles.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("marker"), F.col("n_name").alias("ref_id"), F.col("n_nationkey").alias("ord"))
    # one list of references for all documents: the marker alone is the key
    last = layout.last_references(refs.withColumn("document_id", F.lit(0))).drop("document_id")
    return found.join(last, "marker", "left").select("document_id", "marker", "ref_id")


# --- text and identities ---


@query("""SELECT doc_id, 'https://doi.org/10.1/' || upper(source) || '.' || doc_id AS raw, '10.1/' || source || '.' || doc_id AS doi, '2401.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') AS arxiv_id FROM documents""")
def doi_normalise(spark, sf):
    d = roles.table(spark, sf, "documents")
    raw = F.concat(F.lit("https://doi.org/10.1/"), F.upper("source"), F.lit("."), F.col("doc_id").cast("string"))
    ax = F.concat(F.lit("arXiv:2401."), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"), F.lit("v2"))
    return d.select("doc_id", raw.alias("raw"), ids.doi(raw).alias("doi"), ids.arxiv(ax).alias("arxiv_id"))


@query("""SELECT p_partkey, p_name || ',' || p_brand AS cleaned FROM part""")
def clean_list(spark, sf):
    p = roles.table(spark, sf, "part")
    items = F.array(F.concat(F.lit("  "), "p_name"), F.upper("p_name"), F.lit(" "), F.col("p_brand"), F.lower("p_brand"))
    return p.select("p_partkey", F.array_join(T.clean_list(items, 5), ",").alias("cleaned"))


@query("""SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS rebuilt FROM documents""")
def inverted_index_rebuild(spark, sf):
    """All words of all texts, indexed by word and put together again."""
    from quarryline.sources.providers import inverted_index, rebuild_abstract

    d = roles.table(spark, sf, "documents")
    words = F.split(T.collapse(F.coalesce("text", F.lit(""))), " ")
    rows = inverted_index(d.select("doc_id", words.alias("words")), "words")
    return rows.select("doc_id", T.collapse(rebuild_abstract(F.col("index"))).alias("rebuilt"))


@query()
def nfkc_normalise(spark, sf):
    return roles.table(spark, sf, "documents").select("doc_id", T.normalise(F.coalesce("text", F.lit("")), fold=True).alias("text"))


# --- grounding, dedup, upserts ---


@query(f"""SELECT doc_id, item_id FROM (SELECT item_id, {norm("text")} AS q FROM benchmark) b JOIN (SELECT doc_id, {norm("coalesce(text, '')")} AS t FROM documents) d ON contains(t, q) WHERE length(q) >= 20""")
def quote_exact_grounding(spark, sf):
    return grounding.exact_quotes(roles.table(spark, sf, "benchmark"), roles.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def fuzzy_quotes(quotes, docs):
    """draft_id (document and item), paragraph_index and ratio of the quotes (item_id, text) that ground in docs (doc_id, text)."""
    paras = docs.select("doc_id", F.lit("s").alias("section_id"), F.posexplode(F.split("text", "\n")).alias("paragraph_index", "text")).withColumnRenamed("doc_id", "paper_id").withColumn("ord", F.col("paragraph_index"))
    near = grounding.seeded_paragraphs(quotes, paras).withColumn("draft_id", F.concat_ws("-", "paper_id", "item_id"))
    drafts = near.select("draft_id", "item_id").distinct().join(quotes.select("item_id", F.col("text").alias("quote")), "item_id").select("draft_id", F.col("draft_id").alias("paper_id"), "quote")
    return grounding.ground(drafts, near.withColumn("paper_id", F.col("draft_id"))).where("ratio IS NOT NULL").select("draft_id", "paragraph_index", "ratio")


@query()
def quote_fuzzy_grounding(spark, sf):
    """Whole passages against the paragraphs of all documents: the best place in each document that holds one, altered or not."""
    b, d = roles.table(spark, sf, "benchmark"), roles.table(spark, sf, "documents")
    return fuzzy_quotes(b, d)


@query("""SELECT 'g' AS g, round((sum(CASE WHEN l_linenumber <> 3 THEN l_quantity END) / sum(CASE WHEN l_linenumber <> 3 THEN l_quantity + 10 END)), 6) AS grounding_rate, count(*) FILTER (l_linenumber = 3) AS unmeasured FROM lineitem""")
def grounding_rates(spark, sf):
    li = roles.table(spark, sf, "lineitem")
    known = F.col("l_linenumber") != 3
    x = li.select(F.when(known, F.col("l_quantity") + 10).alias("proposed"), F.when(known, F.col("l_quantity")).alias("grounded"), F.lit(None).cast("double").alias("accepted"))
    return grounding.extraction_stats(x).select(F.lit("g").alias("g"), "grounding_rate", "unmeasured")


@query("""WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS s, p_brand AS pb, lower(p_type) AS w FROM part), n AS (SELECT DISTINCT p_brand AS pb, p_type AS name, lower(p_type) AS n FROM part)
SELECT s AS subject_id, name AS object_id FROM (SELECT s, name, row_number() OVER (PARTITION BY s ORDER BY length(n) DESC, n) AS rn FROM r JOIN n USING (pb) WHERE contains(w, n) OR contains(n, w)) WHERE rn = 1""")
def relate_results(spark, sf):
    p = roles.table(spark, sf, "part")
    results = p.select(F.col("p_brand").alias("paper_id"), F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("wanted"))
    named = p.select(F.col("p_brand").alias("paper_id"), F.col("p_type").alias("id"), F.col("p_type").alias("name")).distinct().withColumn("kind", F.lit("metric")).withColumn("ord", F.lower("name"))
    return grounding.relate_by_name(results, named, "wanted", "metric", "measured_by").select("subject_id", "object_id")


@query("""SELECT doc_id, keep FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY trim(regexp_replace(regexp_replace(lower(string_split(coalesce(text, ''), chr(10))[1]), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS keep FROM documents)""")
def paper_dedup_exact(spark, sf):
    p = roles.papers(spark, sf).select(F.substring("id", 2, 20).cast("long").alias("doc_id"), T.title_key(F.col("title")).alias("k"))
    first = p.groupBy("k").agg(F.min("doc_id").alias("keep"))
    return p.join(first, "k").select("doc_id", "keep")


@query()
def paper_dedup_near(spark, sf):
    p = roles.papers(spark, sf)
    none = F.lit(None).cast("string")
    x = p.select("id", F.substring("id", 2, 20).cast("long").alias("ord"), "title", "provider", "abstract", "keywords", F.col("citation_count").cast("double").alias("citation_count"), F.struct(*(none.alias(f) for f in dedup.MATCHED)).alias("identifiers"))
    return dedup.dedup_papers(x).select("id", F.size("members").alias("n_members"), F.array_join("also_seen_in", ",").alias("also_seen_in"))


@query(f"""WITH {roles.OBJECTS}, k AS (SELECT *, {norm("name")} AS nk FROM objects) SELECT paper_id, kind, nk AS name_key, arg_max(id, (confidence, -ord)) AS id, max(confidence) AS confidence, count(*) AS n FROM k GROUP BY ALL""")
def object_dedup(spark, sf):
    o = roles.objects(spark, sf).withColumn("evidence_ids", F.array("id"))
    return dedup.dedup_objects(o).select("paper_id", "kind", "name_key", "id", "confidence", "n")


@query("""WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus = 'F' AS d FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus = 'O' AS d FROM orders WHERE o_orderkey % 3 <> 1)
SELECT coalesce(o.k, n.k) AS paper_id, coalesce(o.d, false) OR coalesce(n.d, false) AS downloaded, CASE WHEN o.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'old' ELSE 'new,old' END AS runs FROM o FULL JOIN n ON o.k = n.k""")
def upsert_merge(spark, sf):
    o = roles.table(spark, sf, "orders")
    side = lambda where, s, run: o.where(where).select(F.col("o_orderkey").cast("string").alias("paper_id"), (F.col("o_orderstatus") == s).alias("downloaded"), F.col("o_orderdate").alias("discovered_at"), F.lit(None).cast("string").alias("pdf_path"), F.array(F.lit(run)).alias("run_ids"))
    return dedup.upsert_records(side("o_orderkey % 3 <> 0", "F", "old"), side("o_orderkey % 3 <> 1", "O", "new"), ["downloaded"]).select("paper_id", "downloaded", F.array_join("run_ids", ",").alias("runs"))


@query("""SELECT doc_id FROM documents WHERE NOT (doc_id % 4 <> 0)""")
def unchanged_anti_join(spark, sf):
    d = roles.table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    done = d.where("doc_id % 4 <> 0")
    return dedup.changed(d, done, ["doc_id", "sha"]).select("doc_id")


# --- quality ---


@query("""WITH d AS (SELECT doc_id, CAST(doc_id % 5 AS BIGINT) AS pages, n_chars AS chars, CAST(doc_id % 3 AS BIGINT) AS empty FROM documents), x AS (SELECT *, CASE WHEN pages > 0 THEN chars::DOUBLE / pages ELSE 0 END AS pp, CASE WHEN pages > 0 THEN empty::DOUBLE / pages ELSE 1.0::DOUBLE END AS er FROM d)
SELECT doc_id, concat_ws(',', CASE WHEN pages < 1 THEN 'pdf_no_pages' END, CASE WHEN chars = 0 THEN 'pdf_no_text' END, CASE WHEN chars > 0 AND pp < 200 THEN 'pdf_sparse_text' END, CASE WHEN er > 0.5 THEN 'pdf_many_empty_pages' END) AS codes,
  round((least(pp / 1000, 1) + (1 - er)) / 2, 6) AS confidence, pages >= 1 AND chars > 0 AS success FROM x""")
def validator_pdf(spark, sf):
    d = roles.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 5).alias("n_pages"), F.col("n_chars"), (F.col("doc_id") % 3).alias("n_empty"))
    return quality.pdf(d).select("doc_id", codes(F.col("issues")).alias("codes"), "confidence", "success")


@query(f"""WITH {roles.OBJECTS} SELECT id, concat_ws(',', CASE WHEN {norm("trim(name)")} IN ({", ".join(f"'{g}'" for g in quality.GENERIC_NAMES)}) THEN 'name_too_generic' END, CASE WHEN length(trim(name)) < 2 THEN 'name_too_short' END, CASE WHEN kind IN ('result', 'limitation', 'future_work') AND length(description) < 20 THEN 'claim_underspecified' END) AS codes,
  round((least(length(trim(name))::DOUBLE / 24, 1) + CASE WHEN trim(description) <> '' THEN 1.0::DOUBLE ELSE 0 END) / 2, 6) AS confidence FROM objects""")
def validator_completeness(spark, sf):
    return quality.completeness(roles.objects(spark, sf)).select("id", codes(F.col("issues")).alias("codes"), "confidence")


@query("""WITH d AS (SELECT doc_id, CAST(doc_id % 4 AS BIGINT) AS n, list_filter(['abstract', 'results', 'conclusion'], lambda x, i: i <= doc_id % 4) AS kinds, n_chars / 6 AS words FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN n < 1 THEN 'sections_missing' END, CASE WHEN n >= 1 AND len(kinds) = 0 THEN 'sections_unrecognised' END, CASE WHEN words < 500 THEN 'body_text_short' END) AS codes, round((len(kinds)::DOUBLE / 7 + 0.5 + least(words::DOUBLE / 2000, 1)) / 3, 6) AS confidence FROM d""")
def validator_sections(spark, sf):
    d = roles.table(spark, sf, "documents")
    kinds = F.slice(F.array(F.lit("abstract"), F.lit("results"), F.lit("conclusion")), F.lit(1), (F.col("doc_id") % 4).cast("int"))
    x = d.select("doc_id", (F.col("doc_id") % 4).alias("n_sections"), kinds.alias("kinds"), F.lit(0.5).alias("mean_detection"), (F.col("n_chars") / 6).alias("body_words"))
    return quality.sections(x).select("doc_id", codes(F.col("issues")).alias("codes"), "confidence")


@query("""SELECT source AS subject_id, sum(CASE WHEN n_chars < 500 THEN 1 ELSE 0 END) AS n_issues, bool_and(n_chars >= 500) AS success, sum(n_chars) AS duration_ms FROM documents GROUP BY 1""")
def verdict_aggregate(spark, sf):
    from quarryline.functions.confidence import issues, succeeds

    d = roles.table(spark, sf, "documents")
    v = d.select(F.col("source").alias("subject_id"), issues((F.col("n_chars") < 500, "short", "error")).alias("issues"), F.col("n_chars").alias("duration_ms")).withColumn("success", succeeds(F.col("issues")))
    return quality.combined(v, "subject_id").select("subject_id", F.size("issues").cast("long").alias("n_issues"), "success", "duration_ms")


# --- evaluation ---

RANKED = """rk AS (SELECT CAST(o_custkey AS VARCHAR) AS query_id, CAST(o_orderkey AS VARCHAR) AS object_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders),
gold AS (SELECT CAST(o_custkey AS VARCHAR) AS query_id, CAST(o_orderkey AS VARCHAR) AS object_id, CASE o_orderpriority WHEN '1-URGENT' THEN 3.0::DOUBLE WHEN '2-HIGH' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS gain FROM orders)"""


def _ranked(spark, sf):
    o = roles.table(spark, sf, "orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    key = [F.col("o_custkey").cast("string").alias("query_id"), F.col("o_orderkey").cast("string").alias("object_id")]
    gain = F.when(F.col("o_orderpriority") == "1-URGENT", 3.0).when(F.col("o_orderpriority") == "2-HIGH", 2.0).otherwise(0.0)
    return o.select(*key, rank.alias("rank")), o.select(*key, gain.alias("gain"))


METRICS = """j AS (SELECT query_id, rank, gain FROM rk JOIN gold USING (query_id, object_id)),
i AS (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS rank FROM gold WHERE gain > 0),
ideal AS (SELECT query_id, count(*) AS rel, sum(CASE WHEN rank <= 5 THEN gain / log2(rank + 1) ELSE 0 END) AS idcg FROM i GROUP BY 1),
m AS (SELECT query_id, round(coalesce(1.0::DOUBLE / min(CASE WHEN gain > 0 THEN rank END), 0), 4) AS reciprocal_rank, round((count(*) FILTER (gain > 0 AND rank <= 5))::DOUBLE / count(*) FILTER (rank <= 5), 4) AS precision_5,
  count(*) FILTER (gain > 0 AND rank <= 5) AS h, sum(CASE WHEN rank <= 5 THEN gain / log2(rank + 1) ELSE 0 END) AS dcg FROM j GROUP BY 1),
pq AS (SELECT query_id, reciprocal_rank, precision_5, round(coalesce(h::DOUBLE / rel, 0), 4) AS recall_5, round(coalesce(dcg / idcg, 0), 4) AS ndcg_5 FROM m LEFT JOIN ideal USING (query_id))"""


@query(f"WITH {RANKED}, {METRICS} SELECT * FROM pq")
def precision_recall_mrr_ndcg(spark, sf):
    return evaluation.evaluate(*_ranked(spark, sf), ks=(5,))


@query(f"WITH {RANKED}, {METRICS} SELECT round(avg(reciprocal_rank), 4) AS reciprocal_rank, round(avg(precision_5), 4) AS precision_5, round(avg(recall_5), 4) AS recall_5, round(avg(ndcg_5), 4) AS ndcg_5, count(*) AS n_queries FROM pq")
def macro_average(spark, sf):
    return evaluation.macro(evaluation.evaluate(*_ranked(spark, sf), ks=(5,)))


# --- loop ---

ASKED_QUESTIONS = """SELECT p_partkey AS ord, p_name AS question, CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority FROM part"""


@query(f"""WITH q AS ({ASKED_QUESTIONS}), f AS (SELECT arg_min(ord, ord) AS ord, arg_min(question, ord) AS question, arg_min(priority, ord) AS priority FROM q GROUP BY lower(question)),
r AS (SELECT *, row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, ord) AS rn FROM f) SELECT 'RQ' || rn AS id, question, priority FROM r WHERE rn <= 8""")
def question_priority(spark, sf):
    p = roles.table(spark, sf, "part")
    q = p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("question"), F.when(F.col("p_size") % 3 == 0, "high").when(F.col("p_size") % 3 == 1, "medium").otherwise("low").alias("priority"), F.array("p_brand").alias("keywords"))
    return loop.plan_questions(q).select("id", "question", "priority")


@query("""WITH c AS (SELECT o_orderkey AS claim_id, 0.95::DOUBLE AS stated, unnest([o_custkey, o_custkey + 1000000]) AS e FROM orders), k AS (SELECT c_custkey AS e, CAST(c_nationkey AS VARCHAR) AS p FROM customer WHERE c_acctbal > 0),
j AS (SELECT claim_id, stated, count(p) AS resolved, count(*) FILTER (p IS NULL) AS unresolved, count(DISTINCT p) AS papers FROM c LEFT JOIN k USING (e) GROUP BY ALL)
SELECT claim_id, resolved, unresolved, CASE WHEN resolved > 0 THEN 'claim' ELSE 'hypothesis' END AS status, round(least(stated, 0.5 + 0.25 * least(papers, 2)), 6) AS confidence FROM j""")
def citation_demotion(spark, sf):
    o, c = roles.table(spark, sf, "orders"), roles.table(spark, sf, "customer")
    claims = o.select(F.col("o_orderkey").alias("claim_id"), F.lit(0.95).alias("stated"), F.array("o_custkey", F.col("o_custkey") + 1000000).alias("evidence_ids"))
    known = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("evidence_id"), F.col("c_nationkey").cast("string").alias("paper_id"))
    return loop.resolve_claims(claims, known).select("claim_id", "resolved", "unresolved", "status", "confidence")


@query("""SELECT o_orderkey AS finding_id, CASE WHEN o_orderkey % 11 = 0 THEN 'unverifiable' WHEN v = 'verified' AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0) THEN 'partially_verified' WHEN v = 'contradicted' AND o_orderkey % 2 = 0 THEN 'insufficient_evidence' ELSE v END AS verdict
FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'contradicted' ELSE 'insufficient_evidence' END AS v FROM orders)""")
def verdict_resolution(spark, sf):
    k = F.col("o_orderkey")
    v = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "contradicted").otherwise("insufficient_evidence")
    return roles.table(spark, sf, "orders").select(k.alias("finding_id"), loop.resolve_verdict(v, F.when(k % 5 == 0, 0).otherwise(1), F.when(k % 2 == 0, 0).otherwise(1), k % 7 == 0, k % 11 != 0).alias("verdict"))


@query("""WITH m AS (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY 1) SELECT conv_id AS run_id, turn AS iteration, role AS agent FROM conversations JOIN m USING (conv_id) WHERE turn = t""")
def latest_round(spark, sf):
    c = roles.table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("iteration"), F.col("role").alias("agent"))
    return loop.latest_round(c).select("run_id", "iteration", "agent")


@query("""SELECT conv_id AS run_id, role AS agent, count(*) AS calls, CAST(sum(coalesce(CASE WHEN turn % 4 <> 3 THEN length(text) END, 0)) AS BIGINT) AS tokens, count(*) FILTER (turn % 4 = 3) AS unmeasured FROM conversations GROUP BY ALL""")
def budget_ledger(spark, sf):
    c = roles.table(spark, sf, "conversations")
    calls = c.select(F.concat_ws("-", "conv_id", "turn").alias("call_id"), F.col("conv_id").alias("run_id"), F.col("role").alias("agent"), F.when(F.col("turn") % 4 != 3, F.length("text")).cast("long").alias("tokens"))
    return loop.ledger(calls.unionAll(calls))


@query("""WITH f AS (SELECT conv_id, count(*) AS it, sum(length(text)) AS tok FROM conversations GROUP BY 1) SELECT conv_id AS run_id, CASE WHEN it >= 4 THEN 'iterations' WHEN it >= 3 THEN 'tool_calls' WHEN tok >= 500 THEN 'tokens' END AS exceeded FROM f""")
def budget_exceeded(spark, sf):
    c = roles.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("run_id")).agg(F.count(F.lit(1)).alias("iterations"), F.sum(F.length("text")).alias("tokens"))
    return loop.budget_exceeded(c.withColumn("tool_calls", F.col("iterations")).withColumn("elapsed_ms", F.lit(0)), 4, 3, 500, 10).select("run_id", "exceeded")


@query("""WITH f AS (SELECT c_nationkey AS run_id, count(*) AS n, count(*) FILTER (c_acctbal > 0 AND c_mktsegment <> 'BUILDING') AS accepted, round(avg(CASE WHEN c_acctbal <= 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS unsupported_rate FROM customer GROUP BY 1)
SELECT run_id, n, accepted, unsupported_rate, CASE WHEN accepted = 0 THEN 'reject' WHEN accepted = n THEN 'accept' ELSE 'revise' END AS decision FROM f""")
def review_gate(spark, sf):
    c = roles.table(spark, sf, "customer").select(F.col("c_nationkey").alias("run_id"), (F.col("c_acctbal") <= 0).cast("int").alias("n_errors"), F.lit(1.0).alias("completeness"), F.lit(2).alias("n_papers"), (F.col("c_mktsegment") == "BUILDING").alias("removed"))
    return loop.review(c).select("run_id", "n", "accepted", "unsupported_rate", "decision")


@query("""SELECT o.o_orderkey AS finding_id, c.c_name AS question, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS verdict, o_orderstatus <> 'P' AND c_name IS NOT NULL AND o_orderkey % 2 = 0 AS complete FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey""")
def audit_chain(spark, sf):
    o, c = roles.table(spark, sf, "orders"), roles.table(spark, sf, "customer")
    findings = o.select(F.col("o_orderkey").alias("finding_id"), F.col("o_custkey").alias("question_id"))
    questions = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("question"))
    verdicts = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("finding_id"), F.col("o_orderstatus").alias("verdict"), F.lit(1).alias("iteration"), F.lit(1).alias("seq"))
    reviews = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("finding_id"), F.lit("accept").alias("decision"))
    return loop.audit(findings, questions, verdicts, reviews).select("finding_id", "question", "verdict", "complete")


def _stream_queries() -> None:
    from quarryline.streaming import telemetry

    for name, (f, sql) in telemetry.QUERIES.items():
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql


def _relational_queries() -> None:
    from quarryline.plans import relational

    for name, (f, sql) in relational.QUERIES.items():
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql


def _further_queries() -> None:
    from quarryline.plans import further

    QUERIES.update(further.QUERIES)
    ORACLE_SQL.update(further.ORACLE_SQL)


def _indexed_queries() -> None:
    from quarryline.plans import indexed

    QUERIES.update(indexed.QUERIES)
    ORACLE_SQL.update(indexed.ORACLE_SQL)


def _loop_queries() -> None:
    from quarryline.plans import loops

    QUERIES.update(loops.QUERIES)
    ORACLE_SQL.update(loops.ORACLE_SQL)


_stream_queries()
_relational_queries()
_further_queries()
_indexed_queries()
_loop_queries()
