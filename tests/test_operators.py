"""Properties of the engine's own operators on small inline tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarryline.functions import confidence, ids
from quarryline.functions import text as T
from quarryline.operators import assembly, dedup, evaluation, evidence, graph, grounding, layout, loop, quality
from quarryline.operators import retrieval as R
from quarryline.sources import providers


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(*columns).first()


# --- text ---


def test_normalise_mends_what_extraction_breaks(spark):
    t = "The  “ﬁrst”\n distri-\n buted sys­tems’  Result"
    assert one(spark, T.normalise(F.lit(t)).alias("t")).t == 'the "first" distributed sys-tems\' result'
    assert one(spark, T.normalise(F.lit("Ｆｕｌｌ ½"), fold=True).alias("t")).t == "full 1⁄2"


def test_tokenisers_differ_on_purpose(spark):
    t = "The Systems. of systems, A/B tests; tests"
    r = one(spark, T.tokens(F.lit(t)).alias("a"), T.bm25_tokens(F.lit(t)).alias("b"), T.ranking_tokens(F.lit(t)).alias("c"))
    assert r.a == ["systems.", "systems,", "a/b", "tests;", "tests"]
    assert r.b == ["the", "systems.", "of", "systems,", "a/b", "tests;", "tests"]
    assert r.c == ["systems", "tests"]


def test_overlap_is_asymmetric_and_safe(spark):
    a, b, none = F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.array(F.lit("x"), F.lit("q")), F.array().cast("array<string>")
    assert one(spark, T.overlap(a, b).alias("v")).v == 0.5
    assert one(spark, T.overlap(none, b).alias("v")).v == 0.0 and one(spark, T.overlap(a, none).alias("v")).v == 0.0
    assert one(spark, T.symmetric_overlap(a, b).alias("v")).v == pytest.approx(1 / 3)


def test_lists_numbers_and_places(spark):
    r = one(
        spark,
        T.clean_list(F.array(F.lit(" A  b"), F.lit("a B"), F.lit(""), F.lit("c")), 2).alias("l"),
        T.clean_query(F.lit("   ")).alias("q"),
        T.first_number(F.lit("about 1,234.5 of 9")).alias("n"),
        T.all_numbers_in(F.lit("91.2 of 100"), F.lit("100 runs gave 91.2")).alias("ok"),
        T.location(F.lit("d"), F.lit(3), F.lit(None).cast("string"), F.lit(2)).alias("p"),
        T.parse_kinds(F.array(F.lit("method"), F.lit("bogus")), ("method", "dataset")).alias("k"),
        T.author_names(F.lit("Ada Lovelace, Grace Brewster Hopper and x, 12 Monkeys")).alias("a"),
    )
    assert (r.l, r.q, r.n, r.ok, r.p, r.k) == (["A b", "c"], None, 1234.5, True, "d p.3 ¶2", ["method"])
    assert r.a == ["Ada Lovelace", "Grace Brewster Hopper"]


def test_identities(spark):
    r = one(
        spark,
        ids.doi(F.lit("https://doi.org/10.1/ABC")).alias("doi"),
        ids.arxiv(F.lit("arXiv:2401.12345v2")).alias("ax"),
        ids.arxiv(F.lit("http://arxiv.org/pdf/2401.12345v3.pdf")).alias("pdf"),
        ids.storage_key(F.lit("doi:10.1/a b?")).alias("key"),
        ids.knowledge_id(F.lit("p"), F.lit("method"), F.lit("Circuit Breaker!"), F.lit(0)).alias("k"),
        ids.node_id(F.lit("dataset"), F.lit("X Y"), F.lit("p1")).alias("shared"),
        ids.node_id(F.lit("result"), F.lit("X Y"), F.lit("p1")).alias("own"),
        ids.content_hash(F.lit("p"), F.lit(None).cast("string"), F.lit(1), F.lit("A  b")).alias("h1"),
        ids.content_hash(F.lit("p"), F.lit(None).cast("string"), F.lit(1), F.lit("a b ")).alias("h2"),
    )
    assert (r.doi, r.ax, r.pdf, r.key, r.k) == ("10.1/abc", "2401.12345", "2401.12345", "doi-10.1-a-b", "p#method:circuit-breaker:0")
    assert r.shared.startswith("dataset:x-y:") and r.own.startswith("result:p1:x-y:") and r.h1 == r.h2 and len(r.h1) == 20


def test_confidence(spark):
    s = lambda *v: F.array(*(confidence.signal("s", F.lit(x), w) for x, w in v))
    none = F.array().cast("array<struct<name:string,value:double,weight:double>>")
    r = one(spark, confidence.mean_of(s((1.0, 3), (0.0, 1))).alias("a"), confidence.mean_of(none).alias("b"), confidence.combined(s((1.0, 1)), s((0.0, 1))).alias("c"), confidence.level(F.lit(0.8)).alias("d"))
    assert (r.a, r.b, r.c, r.d) == (0.75, 0.0, 0.5, "high")


# --- retrieval ---


def objects(spark):
    rows = [("a", "method", "p1", "circuit breaker", "stops cascades", ["a circuit breaker opens"], 0.8, 1, True), ("b", "method", "p2", "autoscaling", "adds nodes", ["scaling out"], 0.8, 1, True), ("c", "dataset", "p2", "Circuit Breaker", "", [], 0.9, 3, True), ("d", "method", "p3", "circuit breaker", "", [], 1.0, 3, False)]
    return spark.createDataFrame(rows, "id string, kind string, paper_id string, name string, description string, quotes array<string>, confidence double, n_evidence int, trusted boolean")


def test_lexical_ranks_matches_first_and_hides_the_untrusted(spark):
    got = [r.id for r in R.lexical(objects(spark), R.Query("circuit breaker")).collect()]
    assert got[0] == "a" and "d" not in got and len(got) == 3
    assert [r.id for r in R.lexical(objects(spark), R.Query("circuit", kinds=("dataset",))).collect()] == ["c"]


def test_bm25_batch_agrees_with_single_queries(spark):
    o = objects(spark).where("trusted")
    text = F.concat_ws(" ", "name", "description")
    single = [(r.id, r.score) for r in R.bm25(o, R.Query("circuit breaker nodes"), text).collect()]
    q = spark.createDataFrame([("q", "circuit breaker nodes")], "query_id string, text string")
    assert single == [(r.id, r.score) for r in R.bm25_batch(o, q, text).orderBy("rank").collect()]


def test_knn_batch_agrees_with_single_queries(spark):
    v = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.7071, 0.7071]), ("z", [0.0, 1.0]), ("w", [-1.0, 0.0])], "id string, vector array<float>")
    single = [(r.id, round(r.score, 4)) for r in R.semantic(v, [1.0, 0.0], 3).collect()]
    batch = [(r.id, round(r.score, 4)) for r in R.semantic_batch(v, [("q", [1.0, 0.0])], 3).orderBy("rank").collect()]
    assert single == batch == [("x", 1.0), ("y", 0.8536), ("z", 0.5)]


def test_fusion_weights(spark):
    rows = [("q", "l", 1.0, x, 4.0 - i) for i, x in enumerate("abcd")] + [("q", "d", 0.0, x, 4.0 - i) for i, x in enumerate("dcba")]
    c = spark.createDataFrame(rows, "query_id string, component string, weight double, id string, score double")
    for fuse in (R.rrf, R.weighted_fusion):
        assert [r.id for r in fuse(c).orderBy("rank").collect()] == list("abcd")
    assert R.rrf(c).where("rank = 1").first().score == 1.0
    lost = R.hybrid({"lexical": (1.0, None), "dense": (1.0, None)})
    assert lost == (None, ["lexical", "dense"])


def test_vectors_of_another_model_are_refused(spark):
    a = R.index_objects(objects(spark), "m/1", "v1")
    assert R.upsert_vectors(a, a).count() == 3
    with pytest.raises(ValueError, match="index_incompatible"):
        R.upsert_vectors(a, R.index_objects(objects(spark), "m/2", "v1"))


def test_paper_rank_treats_the_unknown_as_half(spark):
    p = spark.createDataFrame([("a", "circuit breaker", "", ["x"], 2026, 500), ("b", "circuit breaker", "", ["x"], None, None), ("c", "other", "", ["x"], 1990, 0)], "id string, title string, abstract string, keywords array<string>, year int, citation_count long")
    rows = {r.id: r for r in R.rank_papers(p, "circuit breaker", ["X"], 2026).collect()}
    assert rows["a"].recency == 0.15 and rows["b"].recency == 0.075 and rows["b"].citations == 0.05 and rows["a"].score > rows["b"].score > rows["c"].score


# --- evidence and graph ---


def test_contradictions(spark):
    rows = [("r1", 1, "p1", "f1", "d", 0.80), ("r2", 2, "p2", "f1", "d", 0.40), ("r3", 3, "p1", "f1", "d", 0.79), ("r4", 4, "p2", "f1", None, 0.1), ("r5", 5, "p2", None, "d", 0.1)]
    r = spark.createDataFrame(rows, "id string, ord int, paper_id string, metric string, dataset string, value double")
    got = {x.id: x.confidence for x in evidence.value_contradictions(r).collect()}
    assert got == {"r1--vs--r2": 0.75, "r2--vs--r3": pytest.approx((0.39 / 0.79 + 1) / 2, abs=1e-6)}
    o = spark.createDataFrame([("a", 1, "dataset", "Set", "p1", True), ("b", 2, "dataset", "set", "p1", False), ("c", 3, "dataset", "SET", "p2", False), ("d", 4, "dataset", "set", "p3", None)], "id string, ord int, kind string, name string, paper_id string, is_public boolean")
    assert [x.id for x in evidence.attribute_contradictions(o, "dataset", "is_public").collect()] == ["a--attr--c"]


def test_bundle_from_end_to_end(spark):
    o = objects(spark)
    links = spark.createDataFrame([("e1", "a"), ("e2", "a"), ("e3", "c"), ("e4", "a"), ("e5", "a")], "evidence_id string, object_id string")
    ev = spark.createDataFrame([(f"e{i}", i, f"quote {i}") for i in range(1, 6)], "evidence_id string, precision int, quote string")
    b = evidence.build_bundle(o, links, ev, None, None, R.Query("circuit breaker"))
    assert b["evidence"].groupBy("object_id").count().where("object_id = 'a'").first()["count"] == 3
    head = b["bundle"].first()
    assert head.papers == ["p1", "p2"] and head.n_objects == 3 and 0 < head.confidence < 1
    made, failed = evidence.build_bundles(o, links, ev, [R.Query("circuit"), R.Query("nodes", kinds=(1,))])
    assert made is not None and len(failed) <= 1


def test_edges_are_refused_for_the_right_reason(spark):
    nodes = spark.createDataFrame([("p", "paper"), ("m", "method"), ("d", "dataset"), ("r", "result")], "id string, kind string")
    cases = [("MENTIONS", "p", "m", True, None), ("MENTIONS", "m", "d", True, "mentions_must_run_paper_to_knowledge"), ("EVALUATED_ON", "m", "d", False, "no_provenance"), ("EVALUATED_ON", "d", "m", True, "source_kind_mismatch"), ("EVALUATED_ON", "m", "r", True, "target_kind_mismatch"), ("CONTRADICTS", "m", "d", True, "contradiction_between_different_kinds"), ("CONTRADICTS", "p", "p", True, "contradiction_between_papers_not_knowledge"), ("LIKES", "m", "d", True, "unknown_edge_kind"), ("MENTIONS", "p", "gone", True, "dangling_endpoint")]
    e = spark.createDataFrame([(str(i), k, s, t, g) for i, (k, s, t, g, _) in enumerate(cases)], "id string, kind string, source_id string, target_id string, grounded boolean")
    got = {int(r.id): r.reason for r in graph.validate_edges(e, nodes).collect()}
    assert got == {i: c[4] for i, c in enumerate(cases)}


def test_neighbours_leave_out_the_start_and_stop_at_the_depth(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "source_id string, target_id string")
    start = spark.createDataFrame([("a",), ("e",)], "start_id string")
    got = {(r.start_id, r.node_id, r.distance) for r in graph.neighbours(e, start, 2).collect()}
    assert got == {("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("e", "d", 1), ("e", "c", 2)}


def test_generations_are_replaced_one_by_one(spark, tmp_path):
    n = spark.createDataFrame([("a", "paper")], "id string, kind string")
    e = spark.createDataFrame([("x", "MENTIONS")], "id string, kind string")
    for version in ("v1", "v2", "v1"):
        graph.write_generation(n, e, version, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/nodes").groupBy("graph_version").count().orderBy("graph_version").collect() == [("v1", 1), ("v2", 1)]


# --- structure ---

PAGE = [
    ("A Study of Widgets", 20.0, True), ("Abstract", 12.0, True), ("We study widgets at length, in many words, so that this is the body of the page. [1, 2]", 10.0, False), ("1 Introduction", 12.0, True),
    ("Widgets are everywhere [3]-[4] and so on, as was said before by others who said it at length.", 10.0, False), ("1.1 Motivation", 12.0, True), ("More text here about the reasons that there are for this.", 10.0, False),
    ("2 Methods", 12.0, True), ("Figure 1: A widget.", 10.0, False), ("Table lookups dominate the cost.", 10.0, False), ("Table II. Results", 10.0, False), ("References", 12.0, True),
    ("[1] Ada Lovelace, Charles Babbage. On engines. 1843. doi 10.1000/abc. [2] B. Other. “A quoted title here” arXiv: 2401.12345v2, https://x.org/y.", 10.0, False),
]


def page(spark):
    return spark.createDataFrame([("d", i, 1 + i // 8, t, s, b) for i, (t, s, b) in enumerate(PAGE)], "document_id string, ord int, page int, text string, size double, bold boolean")


def test_sections(spark):
    s = {r.section_id: r for r in layout.sections(layout.headings(page(spark))).collect()}
    assert [(r.title, r.kind, r.level, r.parent_id) for _, r in sorted(s.items())] == [("A Study of Widgets", "other", 1, None), ("Abstract", "abstract", 1, None), ("1 Introduction", "introduction", 1, None), ("1.1 Motivation", "background", 2, "s002"), ("2 Methods", "methodology", 1, None), ("References", "references", 1, None)]
    bare = page(spark).where("size = 10").withColumn("bold", F.lit(False)).where("ord IN (2, 4)")
    assert [(r.section_id, r.title, r.confidence) for r in layout.sections(layout.headings(bare)).collect()] == [("s000", "Document", 0.0)]
    p = layout.paragraphs(layout.headings(page(spark))).where("section_id = 's004'").orderBy("paragraph_index").collect()
    assert [r.paragraph_index for r in p] == [0, 1, 2]


def test_captions_references_and_citations(spark):
    assert [(r.caption_id, r.label, r.caption) for r in layout.captions(page(spark)).orderBy("caption_id").collect()] == [("f000", "Figure 1", "A widget."), ("t000", "Table II", "Results")]
    e = layout.entries(page(spark).where("ord = 12").select("document_id", "ord", "page", "text")).withColumn("p", layout.parse_entry(F.col("raw"))).orderBy("pos").collect()
    assert [(r.marker, r.p.year, r.p.doi, r.p.arxiv_id, r.p.url) for r in e] == [("1", None, "10.1000/abc", None, None), ("2", None, None, "2401.12345v2", "https://x.org/y")]
    assert e[0].p.authors == ["Ada Lovelace", "Charles Babbage"] and e[1].p.title == "A quoted title here"
    lines = spark.createDataFrame([("d", 0, 1, "1. First author of the first entry\n   goes on here\n2) Second author of the second entry")], "document_id string, ord int, page int, text string")
    assert [(r.marker, r.raw) for r in layout.entries(lines).orderBy("pos").collect()] == [("1", "First author of the first entry goes on here"), ("2", "Second author of the second entry")]
    text = spark.createDataFrame([("d", "s1", 0, "see [1, 3] and [2]-[4] and [5-7]")], "document_id string, section_id string, paragraph_index int, text string")
    found = layout.citations(text)
    assert [r.marker for r in found.orderBy("pos").collect()] == ["1", "3", "2", "4", "5", "7"]
    refs = spark.createDataFrame([("d", "1", "r0", 0), ("d", "1", "r9", 9)], "document_id string, marker string, ref_id string, ord int")
    assert {r.marker: r.ref_id for r in layout.resolve_citations(found, refs).collect()}["1"] == "r9"


def test_self_metadata(spark):
    r = layout.self_metadata(page(spark)).first()
    assert r.title == "A Study of Widgets" and r.abstract.startswith("We study widgets")


# --- grounding, dedup ---


def test_grounding_takes_exact_before_alike_and_refuses_fragments(spark):
    paras = spark.createDataFrame([("p", "s1", 0, 0, "We show that the distributed cache lowers the latency by 40 % in all runs."), ("p", "s1", 1, 1, "Nothing else matters in this other paragraph, which is long.")], "paper_id string, section_id string, paragraph_index int, ord int, text string")
    drafts = spark.createDataFrame([("exact", "p", "the distri- buted cache lowers the latency"), ("alike", "p", "we show that the distributed cache lowered the latency by 40"), ("short", "p", "latency by 40"), ("made up", "p", "quantum chickens cross the road every single day")], "draft_id string, paper_id string, quote string")
    got = {r.draft_id: (r.paragraph_index, r.ratio) for r in grounding.ground(drafts, paras).collect()}
    assert got["exact"] == (0, 1.0) and got["alike"][0] == 0 and got["alike"][1] >= 0.85 and got["short"] == got["made up"] == (None, None)


def test_relations(spark):
    named = spark.createDataFrame([("p", "m1", "metric", "F1", 0), ("p", "m2", "metric", "F1 score", 1), ("q", "m3", "metric", "F1", 2)], "paper_id string, id string, kind string, name string, ord int")
    results = spark.createDataFrame([("p", "r1", "macro f1 score"), ("p", "r2", "recall")], "paper_id string, id string, metric_name string")
    assert [r.object_id for r in grounding.relate_by_name(results, named, "metric_name", "metric", "measured_by").collect()] == ["m2"]
    placed = spark.createDataFrame([("m", "method", "p", "s", 0), ("d", "dataset", "p", "s", 0), ("d", "dataset", "p", "s", 1), ("e", "dataset", "p", None, None)], "id string, kind string, paper_id string, section_id string, paragraph_index int")
    assert [r.id for r in grounding.relate_by_place(placed, "method", "dataset", "evaluated_on").collect()] == ["m--evaluated_on--d"]


def test_extractor_seam(spark):
    assert {r.kind for r in grounding.RuleExtractor(F.lit("t"), F.lit("Latency fell by 40 %. We call it Circuit Breaker.")).collect()} == {"result", "method"}


def papers(spark, rows):
    fields = ("doi", "arxiv_id", "pubmed_id", "openalex_id", "semantic_scholar_id", "corpus_id")
    full = [(i, n, t, p, a, k, c, tuple(x.get(f) for f in fields)) for n, (i, t, p, a, k, c, x) in enumerate(rows)]
    return spark.createDataFrame(full, "id string, ord int, title string, provider string, abstract string, keywords array<string>, citation_count double, identifiers struct<" + ",".join(f"{f}:string" for f in fields) + ">")


def test_papers_are_merged_by_identifier_and_title(spark):
    rows = [
        ("a", "Deep Widgets for Everyone", "arxiv", "short", ["x"], None, {"doi": "10.1/a"}),
        ("b", "Something Else Entirely", "openalex", "a longer abstract", ["X", "y"], 5.0, {"doi": "10.1/a", "arxiv_id": "1"}),
        ("c", "Deep Widgets for Everyone!", "crossref", None, None, 3.0, {}),
        ("d", "Deep Widgets for Everyone", "crossref", None, None, None, {"doi": "10.1/other"}),
        ("e", "Deep", "crossref", None, None, None, {}),
        ("f", "Deep Widgets for Everyones", "pubmed", None, None, None, {}),
        ("g", "An unrelated title", "pubmed", None, None, None, {"arxiv_id": "1"}),
    ]
    got = {r.id: r for r in dedup.dedup_papers(papers(spark, rows)).collect()}
    assert {k: sorted(v.members) for k, v in got.items()} == {"a": ["a", "b", "c", "f", "g"], "d": ["d"], "e": ["e"]}
    a = got["a"]
    assert a.abstract == "a longer abstract" and a.keywords == ["x", "y"] and a.citation_count == 5.0 and a.also_seen_in == ["crossref", "openalex", "pubmed"]


def test_upsert_never_falls_back(spark):
    schema = "paper_id string, discovered boolean, downloaded boolean, discovered_at timestamp, pdf_path string, run_ids array<string>"
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", True, True, t, "x.pdf", ["r1"]), ("b", True, False, t, None, ["r1"])], schema)
    new = spark.createDataFrame([("a", True, False, t + dt.timedelta(1), None, ["r2"]), ("c", None, None, t, None, None)], schema)
    got = {r.paper_id: r for r in dedup.upsert_records(old, new, ["discovered", "downloaded"]).withColumn("at", dedup.furthest_stage(["discovered", "downloaded"])).collect()}
    assert (got["a"].downloaded, got["a"].pdf_path, got["a"].run_ids, got["a"].discovered_at, got["a"].at) == (True, "x.pdf", ["r1", "r2"], t, "downloaded")
    assert got["c"].downloaded is False and got["c"]["at"] is None and got["b"]["at"] == "discovered"


# --- evaluation, loop ---


def test_metrics_by_hand(spark):
    rank = spark.createDataFrame([("q", i + 1, x) for i, x in enumerate("axby")], "query_id string, rank int, object_id string")
    gold = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 1.0), ("q", "c", 2.0), ("none", "z", 1.0)], "query_id string, object_id string, gain double")
    got = {r.query_id: r for r in evaluation.evaluate(rank, gold, (3, 10)).collect()}
    q = got["q"]
    assert (q.reciprocal_rank, q.precision_3, q.recall_3, q.precision_10, q.recall_10) == (1.0, 0.6667, 0.6667, 0.5, 0.6667)
    assert q.ndcg_3 == pytest.approx((3 + 1 / 2) / (3 + 2 / 1.58496 + 1 / 2), abs=1e-4)
    assert got["none"].recall_3 == got["none"].reciprocal_rank == 0.0
    table, lost, citable = evaluation.run_benchmark({"a": rank, "b": None}, gold, True)
    assert table.count() == 1 and lost == ["b"] and not citable
    assert evaluation.comparable({"limit": 1}, {"limit": 2}) == ["limit"]


def test_questions_are_planned(spark):
    q = spark.createDataFrame([(0, "What  now?", "low", ["a"]), (1, "what now?", "high", ["b"]), (2, "Why?", "high", ["k", "K"]), (3, " ", "high", [])], "ord int, question string, priority string, keywords array<string>")
    assert [(r.id, r.question, r.keywords) for r in loop.plan_questions(q).orderBy("id").collect()] == [("RQ1", "Why?", ["k"]), ("RQ2", "What now?", ["a"])]


def test_claims_verdicts_and_budgets(spark):
    claims = spark.createDataFrame([("c1", 0.9, ["e1", "gone"]), ("c2", 0.9, ["gone"]), ("c3", 0.9, [])], "claim_id string, stated double, evidence_ids array<string>")
    known = spark.createDataFrame([("e1", "p1")], "evidence_id string, paper_id string")
    got = {r.claim_id: (r.status, r.unresolved, r.confidence) for r in loop.resolve_claims(claims, known).collect()}
    assert got == {"c1": ("claim", 1, 0.75), "c2": ("hypothesis", 1, 0.5), "c3": ("hypothesis", 0, 0.5)}
    budget = loop.Budget(1)
    budget.reserve("search_knowledge")
    with pytest.raises(loop.BudgetExhausted):
        budget.reserve("search_graph")
    with pytest.raises(ValueError, match="unknown tool"):
        budget.reserve("rm")


def test_retries_and_stages():
    waits, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise loop.Retryable("busy", floor=2.0)
        return "done"

    assert loop.retry(call, sleep=waits.append) == "done" and waits == [2.0, 2.0]
    state, history = loop.run_stages([loop.Stage("a", lambda s: {"x": 1}), loop.Stage("b", lambda s: {}, needs=("y",)), loop.Stage("c", lambda s: {})], {})
    assert state == {"x": 1} and [(n, s) for n, s, _ in history] == [("a", "completed"), ("b", "blocked")]


def test_validators(spark):
    d = spark.createDataFrame([(0, 0, 0), (4, 100, 3), (2, 5000, 0)], "n_pages int, n_chars int, n_empty int")
    got = [(confidence_codes, ok) for confidence_codes, ok in quality.pdf(d).select(confidence.codes(F.col("issues")).alias("c"), "success").collect()]
    assert got == [("pdf_no_pages,pdf_no_text,pdf_many_empty_pages", False), ("pdf_sparse_text,pdf_many_empty_pages", True), ("", True)]
    f = spark.createDataFrame([(1, 0, 2, "verified", False, 0), (0, 1, 1, None, True, 1)], "n_citations int, n_unresolved int, n_papers int, verdict string, overclaims boolean, n_contradicting int")
    assert [r.success for r in quality.finding(f).collect()] == [True, False]


# --- sources ---


def payload(spark, text):
    return spark.createDataFrame([(text,)], "payload string")


def test_providers(spark):
    oa = providers.openalex(payload(spark, '{"results":[{"id":"https://openalex.org/W1","title":"T","doi":"https://doi.org/10.1/X","publication_year":2020,"type":"article","cited_by_count":3,"abstract_inverted_index":{"b":[1],"a":[0,2]}}]}')).first()
    assert (oa.abstract, oa.id, oa.publication_type) == ("a b a", "doi:10.1/x", "journal_article")
    cr = providers.crossref(payload(spark, '{"message":{"items":[{"DOI":"10.1/Y","title":["T"],"abstract":"<jats:p>Some <b>text</b></jats:p>","type":"odd","is-referenced-by-count":1,"issued":{"date-parts":[[2021,2]]}}]}}')).first()
    assert (cr.abstract, cr.year, cr.publication_type, cr.citation_count) == ("Some text", 2021, "unknown", 1)
    ss = providers.semantic_scholar(payload(spark, '{"data":[{"paperId":"s","title":"T","year":2019,"publicationTypes":["Conference"],"isOpenAccess":true,"openAccessPdf":{"url":"u"},"externalIds":{"ArXiv":"2401.1v2","CorpusId":"9"}}]}')).first()
    assert (ss.id, ss.identifiers.corpus_id, ss.pdf_url, ss.publication_type) == ("arxiv:2401.1", "9", "u", "conference_paper")
    ax = providers.arxiv(payload(spark, "<feed><entry><id>http://arxiv.org/abs/2401.00001v1</id><title>A\n title</title><summary> S </summary><published>2024-01-01</published></entry><entry><id>http://arxiv.org/abs/1001.00001</id><title>B</title><summary>S</summary><published>2010-01-01</published></entry></feed>"), 2020).collect()
    assert [(r.id, r.title, r.year) for r in ax] == [("arxiv:2401.00001", "A title", 2024)]
    pm = providers.pubmed(payload(spark, '<x><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label="AIM">One.</AbstractText><AbstractText Label="END">Two.</AbstractText></Abstract><Journal><JournalIssue><PubDate><Year>2001</Year></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle></x>')).first()
    assert (pm.id, pm.abstract, pm.year) == ("pmid:7", "AIM: One. END: Two.", 2001)


def test_local_files_and_downloads(spark, tmp_path):
    for n in ("01_[core]_A_first_paper.pdf", "plain name.pdf", "note.txt"):
        (tmp_path / n).write_bytes(b"x")
    lib = providers.manual_library(spark, str(tmp_path))
    assert sorted((r["index"], r.tag, r.title) for r in lib.collect() if r["index"]) == [(1, "core", "A first paper")]
    assert [r.title for r in providers.manual_search(lib, "the plain paper name", 5).collect()][0] == "plain name"
    p = spark.createDataFrame([("a", "x", None), ("b", None, "https://x"), ("c", None, None), ("d", None, "ftp://x"), ("e", None, "https://y")], "id string, local_path string, pdf_url string")
    done = spark.createDataFrame([("e",)], "paper_id string")
    assert {r.id: r.action for r in providers.download_plan(p, done).collect()} == {"a": "already_local", "b": "download", "c": "no_url", "d": "cannot_download", "e": "already_downloaded"}
    with pytest.raises(ValueError, match="unknown sources"):
        providers.enabled({"arxiv": {}, "bogus": {}})


def test_payload_source(spark):
    providers.register(spark, lambda q: iter([f"{q}-1", f"{q}-2"]))
    got = spark.read.format("quarryline_payloads").option("queries", "a|b").load().collect()
    assert sorted(r.payload for r in got) == ["a-1", "a-2", "b-1", "b-2"]


# --- the engine as one object ---


def test_engine_verbs(spark, tmp_path):
    from quarryline import engine, schemas

    o = objects(spark)
    links = spark.createDataFrame([("e1", "a")], "evidence_id string, object_id string")
    ev = spark.createDataFrame([("e1", "e1", "p1", "s1", "a circuit breaker opens", 4)], "id string, evidence_id string, paper_id string, section_id string, quote string, precision int")
    library = spark.createDataFrame([("p1", "On circuit breakers", "arxiv"), ("p2", "Other", "pubmed")], "id string, title string, provider string")
    records = spark.createDataFrame([("p1", True)], "paper_id string, downloaded boolean")
    nodes = spark.createDataFrame([("n1", "method", "Circuit Breaker", ["p1"], ["e1"])], "id string, kind string, name string, paper_ids array<string>, evidence_ids array<string>")
    results = spark.createDataFrame([("r1", 1, "p1", "f1", "d", 0.8), ("r2", 2, "p2", "f1", "d", 0.4)], "id string, ord int, paper_id string, metric string, dataset string, value double")
    e = engine.Engine(spark, {"objects": o, "links": links, "evidence": ev, "papers": library, "records": records, "nodes": nodes, "results": results})
    assert e.search_knowledge("circuit breaker").first().id == "a"
    assert e.retrieve_evidence(["a"]).count() == 1 and e.build_bundle("circuit breaker")["bundle"].count() == 1
    assert e.search_graph(name="breaker").count() == 1 and e.get_provenance("n1").first().paper_ids == ["p1"]
    assert e.find_contradictions().count() == 1 and e.get_paper_context("p2").first().n_objects == 2
    assert e.retrieve("evidence", R.Query("circuit breaker")).count() == 1 and e.retrieve("documents", R.Query("circuit")).count() == 2
    assert e.paper_evidence("p1").first().sections_covered == ["s1"] and len(e.budget.calls) == 7
    assert {(r.provider, r.n, r.downloaded, r.pending) for r in e.library_summary().collect()} == {("arxiv", 1, 1, 0), ("pubmed", 1, 0, 1), (None, 2, 1, 1)}
    assert e.library("arxiv", 5).count() == 1 and all(e.health().values())
    with pytest.raises(KeyError, match="prerequisite_not_met"):
        engine.Engine(spark, {}).search_knowledge("x")
    assert engine.load_prompts("## a\nSay {x}\n## b\ny\n") == {"a": "Say {x}", "b": "y"}
    assert engine.render("Say {x}", x="hi") == "Say hi"
    for bad in (lambda: engine.load_prompts("## a\nx\n## a\ny"), lambda: engine.render("{x}", y="1"), lambda: engine.ARMS.add("deterministic", None)):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "gold.json").write_text('{"query_id":"q","status":"reviewed","judgements":[{"object_id":"a","relevance":"high"},{"object_id":"b","relevance":"low"}]}\n')
    assert [r.gain for r in engine.load_gold(spark, str(tmp_path / "gold.json")).collect()] == [3.0, 1.0]
    for name in schemas.TABLES:
        assert schemas.empty(spark, name).count() == 0
    assert schemas.conform(library, "papers").columns[0] == "id" and schemas.outside(nodes, "kind", "node_kind").count() == 0


def test_altered_passages_are_found_in_documents_without_a_verbatim_one(spark):
    import random

    from quarryline.functions.text import normalise
    from quarryline.operators.grounding import LEAST_RATIO, best_window
    from quarryline.plans.catalog import fuzzy_quotes

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    items = [(k, some(24)) for k in range(6)]  # under 200 characters, from which difflib leaves out frequent ones

    def altered(text):
        w = text.split(" ")
        return " ".join("x" if i % 13 == 4 else x for i, x in enumerate(w))

    docs = []
    for k, text in items:
        docs += [(10 * k, f"{some(30)}\n{altered(text)}\n{some(20)}"), (10 * k + 1, f"{some(25)} {text} {some(9)}"), (10 * k + 2, some(90)), (10 * k + 3, " ".join(text.split(" ")[:12]) + " " + some(20))]
    docs.append((99, None))
    q, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    lines = [(i, p, line) for i, t in docs for p, line in enumerate((t or "").split("\n"))]
    norm = {r.text: r.n for r in spark.createDataFrame([(t,) for t in {x for *_, x in lines} | {t for _, t in items}], "text string").withColumn("n", normalise(F.col("text"))).collect()}
    expected = {}
    for k, text in items:
        for i in {i for i, _ in docs}:
            own = [(1.0 if norm[text] in norm[x] else best_window(norm[text], norm[x]), -p) for j, p, x in lines if j == i]
            ratio, place = max(own)
            if ratio >= LEAST_RATIO:
                expected[f"{i}-{k}"] = (-place, round(ratio, 6))
    got = {r.draft_id: (r.paragraph_index, r.ratio) for r in fuzzy_quotes(q, d).collect()}
    assert got == expected
    assert {f"{10 * k + j}-{k}" for k in range(6) for j in (0, 1)} <= set(got) and 1 > got["0-0"][1]


def test_contradictions_of_a_name_that_very_many_bear(spark):
    """Blocks of a hot name meet in tasks of their own, and their number is that of the pairs."""
    rows = [(f"o{n}", n // 2 if n % 10 == 0 else n, "dataset", "Same  name" if n % 3 else "other", f"p{n % 4}" if n % 11 else None, n % 5 < 2 if n % 7 else None) for n in range(400)]
    o = spark.createDataFrame(rows, "id string, ord int, kind string, name string, paper_id string, is_public boolean")
    said = [r for r in rows if r[5] is not None and r[4]]
    want = sorted((a[0], b[0]) for a in said for b in said if a[3] == b[3] and a[5] != b[5] and a[4] != b[4] and a[1] < b[1])
    found = evidence.attribute_contradictions(o, "dataset", "is_public", block=16, most=1000)
    assert sorted((r.left_id, r.right_id) for r in found.collect()) == want
    assert found.rdd.getNumPartitions() > len(want) // 1000
    assert evidence.attribute_conflict_count(o, "dataset", "is_public").first().n == len(want)


def test_counts_of_conflicts_make_no_pairs(spark):
    """200,000 objects of one name: 10 billion pairs, of which none is made; without any, the count is 0."""
    o = spark.range(200_000).select(F.col("id").cast("string").alias("id"), F.col("id").alias("ord"), F.lit("dataset").alias("kind"), F.lit("n").alias("name"), (F.col("id") % 10).cast("string").alias("paper_id"), (F.col("id") % 4 < 2).alias("is_public"))
    none = spark.createDataFrame([], "id string, ord long, paper_id string, metric string, dataset string, value double")
    want = 100_000**2 - sum(sum(1 for n in range(20) if n % 10 == p and n % 4 < 2) * sum(1 for n in range(20) if n % 10 == p and n % 4 >= 2) * 10_000**2 for p in range(10))
    assert {r.kind: r.n for r in assembly.conflict_counts(none, o, (("dataset", "is_public"),)).collect()} == {"value_conflict": 0, "attribute_conflict": want}
    assert {r.n for r in assembly.conflict_counts(none, o.limit(0), (("dataset", "is_public"),)).collect()} == {0}


def stored(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


@pytest.mark.parametrize("fuse", [R.rrf, R.weighted_fusion])
def test_fusion_reads_what_it_fuses_once(spark, tmp_path, fuse):
    rows = [("q", c, w, f"d{n}", float(n % 7)) for c, w in (("a", 1.0), ("b", 0.5)) for n in range(20)]
    out = fuse(stored(spark.createDataFrame(rows, "query_id string, component string, weight double, id string, score double"), tmp_path / "r"))
    assert out.count() == 10 and not any(str(tmp_path) in f for f in out.inputFiles())


def test_cross_paper_scores_texts_once(spark, tmp_path):
    rows = [(f"d{n}", "method", f"p{n % 4}", "Graph cache" if n % 2 else None, "fast cache" if n % 3 else None, ["a graph"] if n % 5 else [], 0.0 if n == 0 else 0.5, 0, True) for n in range(30)]
    o = stored(spark.createDataFrame(rows, "id string, kind string, paper_id string, name string, description string, quotes array<string>, confidence double, n_evidence long, trusted boolean"), tmp_path / "o")
    out = R.cross_paper(o, R.Query("graph cache"))
    assert out.count() == 10 and not any(str(tmp_path) in f for f in out.inputFiles())
    found = R.lexical(o, R.Query("graph cache", limit=50))
    assert found.count() == 29  # the one without words, confidence and evidence has a score of 0
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_intersect(") == 2
    assert one(spark, T.overlap(F.lit(None).cast("array<string>"), F.array(F.lit("x"))).alias("o")).o == 0.0


def test_inverted_index_shuffles_nothing(spark):
    texts = spark.createDataFrame([(1, "b a b c a b".split()), (2, [""]), (3, []), (4, None)], "id int, words array<string>")
    out = providers.inverted_index(texts, "words")
    assert {r.id: r["index"] for r in out.collect()} == {1: {"a": [1, 4], "b": [0, 2, 5], "c": [3]}, 2: {"": [0]}, 3: {}, 4: {}}
    assert one(spark, T.collapse(providers.rebuild_abstract(F.create_map(F.lit("b"), F.array(F.lit(0), F.lit(2)), F.lit("a"), F.array(F.lit(1))))).alias("t")).t == "b a b"
    from quarryline.plans.catalog import QUERIES

    assert "Exchange" not in QUERIES["inverted_index_rebuild"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_sections_read_pages_once(spark, tmp_path):
    html = "<html><title>T</title><h1>1 Introduction</h1><p> </p><p>Some text &amp; more.</p><h2>1.1 Method</h2><p>Last.</p></html>"
    pages = stored(spark.createDataFrame([(1, "u", html), (2, "u", "<p>bare</p>")], "page_id long, url string, html string"), tmp_path / "p")
    blocks = layout.page_blocks(pages)
    assert [(r.ord, r.text) for r in blocks.where("document_id = '1'").orderBy("ord").collect()] == [(0, "T"), (1, "1 Introduction"), (3, "Some text more."), (4, "1.1 Method"), (5, "Last.")]
    out = layout.sections(layout.headings(blocks))
    assert [(r.document_id, r.section_id, r.kind) for r in out.orderBy("document_id", "section_id").collect()][-2:] == [("1", "s002", "methodology"), ("2", "s000", "other")]
    assert not any(str(tmp_path / "p") in f for f in out.inputFiles())


def test_lines_of_a_finding_are_dealt_by_their_number(spark):
    from quarryline.plans import further
    from quarryline.plans.shared import tasks_for

    assert tasks_for(spark.range(100), rows=10) == 11 and tasks_for(spark.range(100)) == 4
    plan = further.validator_finding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan


def test_states_are_made_once_for_all_stages(spark):
    from quarryline.plans import loops

    out = loops.stage_admission(spark, "/root/testdata/sf0.001")
    assert not any("orders.parquet" in f or "customer.parquet" in f for f in out.inputFiles())


def test_conflict_groups_shuffle_results_once(spark, monkeypatch):
    """Papers are counted only where values differ; a key of both signs, one that agrees, single results and NaN."""
    plans, plain = {}, evidence.written
    monkeypatch.setattr(evidence, "written", lambda df, name="step": plans.__setitem__(name, df._jdf.queryExecution().executedPlan().toString()) or plain(df, name))
    nan = float("nan")
    rows = [("a", "m", "d", "p1", -4.0), ("b", "m", "d", "p1", 1.0), ("c", "m", "d", None, 5.0), ("e", "m", None, "p1", 2.0), ("f", "m", None, "p2", 3.0), ("g", "n", "d", "p1", 1.0), ("h", "n", "d", "p2", 1.01), ("i", "o", "d", "p1", 7.0), ("j", "o", "e", "p1", nan)]
    r = spark.createDataFrame([(i, n, p, m, d, v) for n, (i, m, d, p, v) in enumerate(rows)], "id string, ord int, paper_id string, metric string, dataset string, value double")
    got = {(x.metric, x.dataset): (x.n, x.n_papers, x.low_id, x.high_id, str(x.difference)) for x in evidence.value_conflict_groups(r).collect()}
    assert got == {("m", "d"): (3, 1, "a", "c", "1.8"), ("m", None): (2, 2, "e", "f", "0.333333"), ("o", "e"): (1, 1, "j", "j", "nan")}
    assert plans["groups"].count("Exchange hashpartitioning") == 1
