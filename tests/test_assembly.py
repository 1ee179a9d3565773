"""Chains of steps: document parts, generations, stored records, configuration, runs, guards, retrieval arms."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from quarryline import engine
from quarryline.operators import assembly, errors, evidence
from quarryline.operators import retrieval as R


def test_parts_of_a_document(spark):
    lines = [("1 Introduction", 14.0, True), ("Latency matters, as shown in [2], for every system that is built today.", 10.0, False), ("Figure 1: Latency of the cache", 10.0, False), ("References", 14.0, True), ("[1] A. Author. A long title of a first work, 1999. [2] B. Other. The title of a second work, 2001.", 10.0, False)]
    blocks = spark.createDataFrame([("d", n, 1, t, s, b) for n, (t, s, b) in enumerate(lines)], "document_id string, ord int, page int, text string, size double, bold boolean")
    parts = assembly.document_parts(blocks)
    assert [r.kind for r in parts["sections"].orderBy("section_id").collect()] == ["introduction", "references"]
    assert [(r.ref_id, r.marker, r.parsed.year) for r in parts["references"].orderBy("ref_id").collect()] == [("r000", "1", 1999), ("r001", "2", 2001)]
    assert [(r.marker, r.ref_id) for r in parts["citations"].collect()] == [("2", "r001")]
    assert parts["captions"].count() == 1 and parts["statistics"].first().n_blocks == 5
    (r,) = assembly.source_text(parts["paragraphs"], parts["sections"], most_chars=30).collect()
    assert r.text == "## 1 Introduction\nLatency matter"[:30] and not r.whole
    (r,) = assembly.source_text(parts["paragraphs"], parts["sections"], most_chars=None).collect()
    assert r.whole and "[1]" not in r.text


def test_generations_are_replaced_listed_read_and_deleted(spark, tmp_path):
    from quarryline.operators import graph

    node = spark.createDataFrame([("a", "method", "A", ["p"], ["e"], 1.0)], "id string, kind string, name string, paper_ids array<string>, evidence_ids array<string>, confidence double")
    edge = spark.createDataFrame([("x", "MENTIONS", "p", "a", True, 1.0)], "id string, kind string, source_id string, target_id string, grounded boolean, confidence double")
    for version in ("v1", "v2", "v1"):
        graph.write_generation(node, edge, version, str(tmp_path))
    assert assembly.graph_versions(spark, str(tmp_path)) == ["v1", "v2"]
    nodes, edges = assembly.read_generation(spark, str(tmp_path), "v1")
    assert [tuple(r) for r in nodes.select(*node.columns).collect()] == [tuple(r) for r in node.collect()] and edges.count() == 1
    assert assembly.delete_generation(spark, str(tmp_path), "v1") and not assembly.delete_generation(spark, str(tmp_path), "v1")
    assert assembly.graph_versions(spark, str(tmp_path)) == ["v2"]


def test_json_records_tolerate_corrupt_files_in_listings_only(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "a", "n": 1}')
    (tmp_path / "b.json").write_text('{"id": "b", "n": ')
    good, bad = assembly.json_records(spark, str(tmp_path), "id string, n int")
    assert [tuple(r) for r in good.collect()] == [("a", 1)] and bad.first().file.endswith("b.json")
    assert assembly.json_record(spark, str(tmp_path / "a.json"), "id string, n int") == {"id": "a", "n": 1}
    assert assembly.json_record(spark, str(tmp_path / "c.json"), "id string, n int") is None
    with pytest.raises(errors.RepositoryError):
        assembly.json_record(spark, str(tmp_path / "b.json"), "id string, n int")


@dataclasses.dataclass
class Limits:
    most: int
    share: float = 0.5


def test_configuration_is_checked(tmp_path):
    def written(text):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(text)
        return str(path)

    good = written('{"most": 3, "share": 1}')
    assert assembly.load_config(good, Limits) == Limits(3, 1) and assembly.load_config(good, Limits) is assembly.load_config(good, Limits)
    for text in ('{"most": "3"}', '{"mots": 3}', "{}", "{"):
        with pytest.raises(errors.ConfigurationError):
            assembly.load_config(written(text), Limits)
    with pytest.raises(errors.ConfigurationError):
        assembly.load_config(str(tmp_path / "absent.json"), Limits)


def test_checkpoints_of_runs(spark, tmp_path):
    for held in (assembly.Checkpoints(), assembly.Checkpoints(spark, str(tmp_path / "runs"))):
        held.save("r", 1, {"plan": 1})
        held.save("r", 2, {"plan": 2})
        assert held.latest("r") == {"plan": 2} and held.latest("none") is None


def test_all_arms_answer(spark):
    rows = [("a", 0, "method", "p", "graph cache", "a cache of graphs", ["the graph cache"], 0.9, 1, True, "graph cache text", [1.0, 0.0]), ("b", 1, "dataset", "q", "other thing", "nothing here", ["no"], 0.5, 1, True, "other text", [0.0, 1.0]), ("c", 2, "method", "q", "graph cache", "hidden", [], 0.9, 0, False, "graph cache", [1.0, 0.0])]
    objects = spark.createDataFrame(rows, "id string, ord int, kind string, paper_id string, name string, description string, quotes array<string>, confidence double, n_evidence int, trusted boolean, text string, vector array<double>")
    assert engine.ARMS.names() == ["bm25", "cross_paper", "deterministic", "hybrid", "semantic"]
    for arm in engine.ARMS.names():
        got = [r.id for r in engine.ARMS.get(arm)(objects, R.Query("graph cache", options={"vector": [1.0, 0.1]})).collect()]
        assert got[0] == "a" and "c" not in got, arm
    with pytest.raises(errors.PrerequisiteNotMet):
        engine.ARMS.get("semantic")(objects, R.Query("graph cache"))
    e = engine.Engine(spark, {"objects": objects})
    with pytest.raises(ValueError, match="at most 50"):
        e.retrieve_evidence([str(k) for k in range(51)])


def test_the_manual_library_is_indexed(spark):
    flags = ["discovered", "downloaded", "parsed"]
    old = spark.createDataFrame([("m1", True, True, True, None, "old.pdf", ["r0"])], "paper_id string, discovered boolean, downloaded boolean, parsed boolean, discovered_at timestamp, pdf_path string, run_ids array<string>")
    papers = spark.createDataFrame([("m1", "new.pdf"), ("m2", "b.pdf")], "id string, local_path string")
    got = {r.paper_id: r for r in assembly.index_library(old, papers, "r1", flags).collect()}
    assert got["m1"].parsed and got["m1"].run_ids == ["r0", "r1"] and got["m1"].pdf_path == "new.pdf"
    assert got["m2"].downloaded and got["m2"].parsed is False


def test_bundles_are_found_by_id_question_and_kind(spark):
    b = spark.createDataFrame([("b1", "q1"), ("b2", "q1"), ("b3", "q2")], "bundle_id string, question_id string")
    assert assembly.bundle_by_id(b, "b2").count() == 1 and assembly.bundles_for_question(b, "q1").count() == 2
    assert assembly.bundle_objects(spark.createDataFrame([("o", "method"), ("p", "result")], "id string, kind string"), "method").first().id == "o"
    assert spark.range(1).select(assembly.run_confidence({"a": F.lit(0.5), "b": F.lit(1.0)}).alias("c")).first().c == 0.75


def test_conflict_groups_of_mixed_signs_equal_all_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [("a", -1.0), ("a", 1.0), ("a", 10.0), ("b", 0.0), ("b", 0.0), ("c", -5.0), ("c", 0.0), ("d", 100.0), ("d", 104.0), ("e", -1e-10), ("e", 5e-10), ("f", 2.0)]
    rows += [(f"k{rng.randrange(12)}", round(rng.choice([-1, 1, 1]) * rng.choice([0, 1e-10, 1, 3, 10]) * rng.uniform(0.9, 1.1), 12)) for _ in range(60)] + [(None, 1.0), (None, -1.0), ("a", None)]
    df = spark.createDataFrame([(f"r{i}", i, f"p{i % 4}", k, k and k[:1], v) for i, (k, v) in enumerate(rows)], "id string, ord int, paper_id string, metric string, dataset string, value double")
    want = {}
    for i, (k, v) in enumerate(rows):
        for w in (w for l, w in rows[:i] if l == k and k is not None and v is not None and w is not None):
            want[k] = max(want.get(k, 0), abs(v - w) / max(abs(v), abs(w), 1e-9))
    got = {r.metric: r for r in evidence.value_conflict_groups(df).collect()}
    assert set(got) == {k for k, d in want.items() if d >= 0.05}
    value = {f"r{i}": v for i, (_, v) in enumerate(rows)}
    for k, r in got.items():
        low, high = value[r.low_id], value[r.high_id]
        assert abs(r.difference - want[k]) < 2e-6 and abs(abs(high - low) / max(abs(low), abs(high), 1e-9) - want[k]) < 2e-6 and low <= high
