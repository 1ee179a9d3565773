"""The postings index: batches, replays, pruning and questions, against scoring every text."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import evidence, postings
from quarryline.operators import retrieval as R
from quarryline.operators.errors import PrerequisiteNotMet

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "the", "ra-") for b in ("x", "yy", "zzz", "w")]
SCHEMA = "id string, text string, name string, body string, kind string, paper_id string, confidence double, n_evidence long, name_key string"


def made(n, seed=1):
    rng = np.random.default_rng(seed)
    odds = 1 / np.arange(1, len(WORDS) + 1)
    say = lambda k: " ".join(rng.choice(WORDS, k, p=odds / odds.sum()))
    rows = []
    for i in range(n):
        name, body = say(2), say(int(rng.integers(0, 30)))
        rows.append((f"d{i}", f"{name}\n{body}", name, body, ["method", "dataset"][i % 2], f"p{i % 5}", 0.3 + (i % 7) / 10, i % 4, name))
    return rows


def brute_bm25(rows, question, limit=10):
    docs = [(r[0], [w for w in (r[1] or "").lower().split() if len(w) > 1]) for r in rows]
    mean = sum(len(w) for _, w in docs) / len(docs)
    asked, out = Counter(w for w in question.split() if len(w) > 1), []
    df = {t: sum(t in w for _, w in docs) for t in asked}
    for i, words in docs:
        c = Counter(words)
        s = sum(n * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(words) / mean)) for t, n in asked.items() if c[t])
        if s > 0:
            out.append((round(s, 6), i))
    return sorted(out, key=lambda x: (-x[0], x[1]))[:limit]


def filled(spark, rows, batches=1, **options):
    index = postings.PostingsIndex.create(spark, **options)
    for k in range(batches):
        index.append(spark.createDataFrame(rows[k::batches], SCHEMA), f"b{k}")
    return index


def contents(index):
    objects = index.objects()
    words = index.postings().join(objects, ["part", "place"]).select("term", "id", "count", "marks")
    return sorted(map(tuple, words.collect())), sorted(map(tuple, objects.drop("part", "place").select(*sorted(set(objects.columns) - {"part", "place"})).collect()))


def test_batches_give_the_same_index_as_a_rebuild(spark):
    rows = made(120)
    whole, parts = filled(spark, rows), filled(spark, rows, 3, buckets=5, part_objects=7)
    assert contents(whole) == contents(parts)
    assert whole.size() == parts.size() and sorted(map(tuple, whole.terms().collect())) == sorted(map(tuple, parts.terms().collect()))


def test_a_batch_taken_in_again_changes_nothing(spark):
    rows = made(30)
    index = filled(spark, rows[:20])
    before = contents(index)
    assert index.append(spark.createDataFrame(rows[:20], SCHEMA), "b0") is False
    # a batch that was killed before its manifest row: part of its segment is there, and doesn't count
    spark.createDataFrame(rows[:5], SCHEMA).selectExpr("1L AS part", "struct(id) AS object", "'object' AS kind_of_row", "0 AS bucket").write.partitionBy("kind_of_row", "bucket").parquet(f"{index.path}/segment=1")
    assert contents(index) == before
    assert index.append(spark.createDataFrame(rows[10:], SCHEMA), "b1") and contents(index) == contents(filled(spark, rows))
    assert index.append(spark.createDataFrame(rows, SCHEMA), "known ids only") and index.size()[0] == 30
    again = postings.PostingsIndex.create(spark, index.path, buckets=3)
    assert again.buckets == index.buckets and contents(again) == contents(index)


@pytest.mark.parametrize("part_objects, questions", [(2048, 500), (5, 3)])
def test_pruned_bm25_equals_scoring_everything(spark, monkeypatch, part_objects, questions):
    monkeypatch.setattr(postings, "QUESTIONS", questions)
    rows = made(150, 2) + [("e1", None, None, None, "method", None, 0.5, 0, None), ("e2", "", "", "", "method", None, 0.5, 0, "")]
    index = filled(spark, rows, 2, part_objects=part_objects)
    rng = np.random.default_rng(4)
    asked = [(i, " ".join(rng.choice([*WORDS, "unknown"], int(rng.integers(1, 6))))) for i in range(12)]
    got = {}
    for r in postings.bm25(index, spark.createDataFrame([*asked, (90, ""), (91, None), (92, "x ?")], "query_id int, text string"), 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.id))
    for q, text in asked:
        want = brute_bm25(rows, text, 7)
        assert [i for _, i in got.get(q, [])] == [i for _, i in want] and np.allclose([s for s, _ in got.get(q, [])], [s for s, _ in want], atol=2e-6)
    assert not {90, 91, 92} & set(got)


def test_filters_and_agreement_are_those_of_the_arms_over_texts(spark):
    rows = made(80, 3)
    index = filled(spark, rows, 2, part_objects=9)
    objects = spark.createDataFrame(rows, SCHEMA).withColumn("trusted", F.lit(True)).withColumn("description", F.lit("")).withColumn("quotes", F.array("body"))
    text = "kax the loyy nuzzz"
    for kinds, papers, least in (((), (), 0.0), (("method",), (), 0.5), ((), ("p1", "p3"), 0.0)):
        q = spark.createDataFrame([("q", text, list(kinds), list(papers), least)], "query_id string, text string, kinds array<string>, paper_ids array<string>, min_confidence double")
        query = R.Query(text, kinds=kinds, paper_ids=papers, min_confidence=least)
        for arm, plain in ((postings.lexical, R.lexical), (postings.cross_paper, R.cross_paper)):
            got = [(r.id, r.score) for r in arm(index, q).orderBy("rank").collect()]
            assert got == [(r.id, r.score) for r in plain(objects, query).collect()]


def test_bundles_of_many_questions(spark, monkeypatch):
    monkeypatch.setattr(postings, "QUESTIONS", 4)
    rows = made(60, 5)
    index = filled(spark, rows, 2, part_objects=9)
    links = spark.createDataFrame([(f"d{i}", f"e{i}-{k}") for i in range(60) for k in range(i % 6)], "object_id string, evidence_id string")
    found = spark.createDataFrame([(f"e{i}-{k}", k % 3) for i in range(60) for k in range(i % 6)], "evidence_id string, precision int")
    asked = [(i, " ".join(WORDS[i % 20 : i % 20 + 3])) for i in range(20)] + [(50, ""), (51, None), (52, "of the")]
    out = evidence.question_bundles(index, links, found, spark.createDataFrame(asked, "query_id int, text string"))
    bundles = {r.query_id: r for r in out["bundles"].collect()}
    assert {q: r.status for q, r in bundles.items()} == {i: "built" for i in range(20)} | {50: "failed", 51: "failed", 52: "failed"}
    held = out["evidence"].collect()
    objects = spark.createDataFrame(rows, SCHEMA).withColumn("trusted", F.lit(True)).withColumn("description", F.lit("")).withColumn("quotes", F.array("body"))
    for q in (0, 7, 19):
        one = evidence.build_bundle(objects, links, found, None, None, R.Query(asked[q][1], question_id=str(q)))
        header, b = one["bundle"].first(), bundles[q]
        assert (header.bundle_id, header.papers, header.kinds, header.n_evidence, header.confidence, header.issues) == (b.bundle_id, b.papers, b.kinds, b.n_evidence, b.confidence, b.issues)
        assert sorted((r.object_id, r.evidence_id) for r in one["evidence"].collect()) == sorted((r.object_id, r.evidence_id) for r in held if r.query_id == q)


def test_an_index_of_nothing(spark):
    index = postings.PostingsIndex.create(spark)
    with pytest.raises(PrerequisiteNotMet):
        index.objects()
    assert index.append(spark.createDataFrame([], SCHEMA), "b") and index.size() == (0, 0.0)
    index.append(spark.createDataFrame([("a", None, None, None, "method", None, 0.5, 0, None), (None, "", None, "", "method", None, 0.5, 0, None)], SCHEMA), "c")
    questions = spark.createDataFrame([(1, "some words")], "query_id int, text string")
    assert index.size() == (2, 0.0) and postings.bm25(index, questions).count() == 0 and postings.lexical(index, questions).count() == 2
    assert postings.evidence_search(index, questions).count() == 0 and postings.bm25(index, questions.limit(0)).count() == 0


def test_scores_of_a_part_are_held_for_few_questions_at_a_time(monkeypatch):
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    n, q = 4000, 200
    packed = lambda k: (np.arange(k, n, 7) | 2 << postings.PLACE_BITS).astype(np.int64).tobytes()
    objects = [{"id": f"d{i}", "place": i, "confidence": 0.5, "n_evidence": i % 4, "kind": "method", "paper_id": "p"} for i in range(n)]
    table = pa.Table.from_pylist(objects + [{"term": f"t{k}", "postings": packed(k)} for k in range(7)], schema=pa.schema([("id", pa.string()), ("place", pa.int32()), ("confidence", pa.float64()), ("n_evidence", pa.int64()), ("kind", pa.string()), ("paper_id", pa.string()), ("term", pa.string()), ("postings", pa.binary())]))
    rows = [SimpleNamespace(terms=[SimpleNamespace(term=f"t{i % 7}", times=1)], kinds=["method"] if i % 3 else None, paper_ids=None, min_confidence=None) for i in range(q)]
    tracemalloc.start()
    out = postings._matcher(rows, ["confidence"], 10, True)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n * q  # one matrix of doubles for all questions
    monkeypatch.setattr(postings, "QUESTIONS_AT_ONCE", q)
    assert out.to_pylist() == postings._matcher(rows, ["confidence"], 10, True)(table).to_pylist()
