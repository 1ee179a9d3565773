"""Generations with digests: rebuilds are the same, changes are exactly what changed, only differing buckets are read."""

import random

import pytest

from quarryline.operators import errors, generations
from quarryline.plans.shared import shared_dir

SCHEMA = "id string, name string, papers array<string>"


def table(spark, rows):
    return {"nodes": spark.createDataFrame(rows, SCHEMA)}


def told(spark, path, a, b):
    rows = generations.changes(spark, path, "nodes", a, b, SCHEMA).collect()
    return sorted(((r.id, r.change, r.fields) for r in rows), key=repr)


def test_rebuild_and_changes(spark):
    path, rng = shared_dir(spark), random.Random(5)
    rows = [(f"n{k}", f"name {k % 7}", [f"p{k % 3}"]) for k in range(300)] + [(None, None, None), ("twice", "x", []), ("twice", "x", [])]
    generations.store(table(spark, rows), "a", path)
    again = list(rows)
    rng.shuffle(again)
    generations.store({"nodes": table(spark, again)["nodes"].repartition(7)}, "b", path)
    assert generations.differing(spark, path, "a", "b").count() == 0 and told(spark, path, "a", "b") == []
    changed = [(None, "named", None), ("twice", "x", []), ("n3", "name 3", ["p0", "p9"]), ("new", None, None)] + [r for r in rows if r[0] not in (None, "twice", "n3", "n4")]
    generations.store(table(spark, changed), "b", path)  # replaces it
    want = [(None, "changed", ["name"]), ("n3", "changed", ["papers"]), ("n4", "removed", None), ("new", "added", None), ("twice", "removed", None)]
    assert told(spark, path, "a", "b") == sorted(want, key=repr)
    assert generations.differing(spark, path, "a", "b").count() <= 5
    assert {c for _, c, _ in told(spark, path, "b", "a")} == {"added", "removed", "changed"}


def test_empty_and_absent(spark):
    path = shared_dir(spark)
    generations.store(table(spark, []), "empty", path)
    generations.store(table(spark, [("a", None, None)]), "one", path)
    assert told(spark, path, "empty", "one") == told(spark, path, "never", "one") == [("a", "added", None)]
    assert told(spark, path, "one", "never") == [("a", "removed", None)] and told(spark, path, "empty", "never") == []
    generations.store(table(spark, [("a", None, None)]), "other", path, buckets=8)
    with pytest.raises(errors.RepositoryError):
        generations.differing(spark, path, "one", "other")
