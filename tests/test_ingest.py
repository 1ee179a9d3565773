"""Ingest through a stream: killed, replayed and repeated batches against one batch."""

import pytest
from pyspark.errors import StreamingQueryException

from quarryline.operators import postings
from quarryline.plans.shared import shared_dir
from quarryline.streaming.ingest import IngestTable

SCHEMA = "document_id string, paper_id string, text string, run_id string"
ROWS = [("1", "a", "one two", "r0"), ("2", "a", None, "r0"), ("3", "b", "three", "r0"), ("4", "a", "four", "r1"), ("1", "a", "one two", "r1"), ("3", "b", "changed", "r2"), (None, None, "no id", "r2"), ("5", "c", "  ", "r2")]


def rows_of(table):
    return sorted(map(tuple, table.outcomes().drop("sha").collect()), key=repr), sorted(map(tuple, table.records().collect()), key=repr)


@pytest.mark.parametrize("dies", [[], [0], [1, 1], [0, 1, 2]])
def test_killed_batches_count_once(spark, dies):
    folder, left = shared_dir(spark), list(dies)
    index = postings.PostingsIndex.create(spark)
    table = IngestTable(spark, f"{folder}/table", index, lambda d: d.selectExpr("document_id AS id", "text"))

    def kill(batch):
        if batch in left:
            left.remove(batch)
            raise RuntimeError("killed")

    for k in range(3):
        spark.createDataFrame([r for r in ROWS if r[3] == f"r{k}"], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{k}")
        source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        for _ in range(4):
            try:
                table.drain(source, f"{folder}/checkpoint", kill)
                break
            except StreamingQueryException:
                assert k in dies
    assert table.batches() == [0, 1, 2] and not left
    outcomes, records = rows_of(table)
    assert outcomes == sorted([("1", "a", 7, "processed"), ("2", "a", 0, "failed"), ("3", "b", 5, "processed"), ("4", "a", 4, "processed"), ("1", "a", 7, "reused"), ("3", "b", 7, "processed"), (None, None, 5, "processed"), ("5", "c", 0, "failed")], key=repr)
    assert records == sorted([("a", True, "r0", ["r0", "r1"], 2), ("b", True, "r0", ["r0", "r2"], 2), ("c", False, "r2", ["r2"], 0), (None, True, "r2", ["r2"], 1)], key=repr)
    assert table.take_in(spark.createDataFrame(ROWS, SCHEMA), 1) is False and rows_of(table) == (outcomes, records)
    assert sorted(r.id for r in index.objects().collect() if r.id) == ["1", "3", "4"]


def test_empty_batches(spark):
    table = IngestTable(spark, f"{shared_dir(spark)}/table")
    assert table.batches() == [] and table.outcomes().count() == 0 and table.records().count() == 0
    assert table.take_in(spark.createDataFrame([], SCHEMA), 0) and table.batches() == [0] and table.records().count() == 0
