"""Incremental ingest (inventory ST-01, X-10, K-02): each batch of a stream counts once, however often it is attempted.

A batch is written to a folder of its own: what became of each document, what it adds to the records of papers, and, if
there is one, its objects in the postings index. It counts from the moment its manifest row is written, which is a single
file that appears by a rename. An attempt that dies before leaves a folder that doesn't count and is written over by the
next; one that is replayed after finds its number in the manifest and does nothing. Nothing is rewritten when a batch
comes: records are merged when they are read, by a merge whose result doesn't depend on the order of batches, but for the
path, of which the latest counts.

Documents have document_id, paper_id, text and run_id. A document that was processed before with the same text is reused,
one without text fails, each as a row and never as an error. Null text counts as empty, null ids are taken in like others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.postings import PostingsIndex

OUTCOMES = "document_id string, paper_id string, sha string, chars long, outcome string"
RECORDS = "paper_id string, processed boolean, first_seen string, run_ids array<string>, n_documents long"


@dataclass
class IngestTable:
    """What has been taken in, at `path`; `index`: a postings index that grows with it, from `objects_of` the new documents."""

    spark: SparkSession
    path: str
    index: PostingsIndex | None = None
    objects_of: Callable[[DataFrame], DataFrame] | None = None

    def _exists(self, folder: str) -> bool:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(folder)
        return at.getFileSystem(conf).exists(at)

    def batches(self) -> list[int]:
        """The numbers of the batches that count."""
        if not self._exists(f"{self.path}/manifest"):
            return []
        rows = self.spark.read.schema("batch long").option("recursiveFileLookup", "true").json(f"{self.path}/manifest")
        return sorted(r.batch for r in rows.collect())

    def _read(self, what: str, schema: str) -> DataFrame:
        folders = [f"{self.path}/batch={k}/{what}" for k in self.batches()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def outcomes(self) -> DataFrame:
        """A row for each document and batch that it came in."""
        return self._read("outcomes", OUTCOMES)

    def records(self) -> DataFrame:
        """K-02: one record per paper: flags never fall back, the earliest sight and all runs are kept."""
        return merged(self._read("records", RECORDS))

    def take_in(self, documents: DataFrame, batch: int, before_commit: Callable[[int], None] | None = None) -> bool:
        """Takes a batch in; False if it counts already. `before_commit` is called when all is written but the manifest row."""
        if batch in self.batches():
            return False
        folder = f"{self.path}/batch={batch}"
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        rows = documents.select(F.col("document_id").cast("string"), F.col("paper_id").cast("string"), F.sha2(text, 256).alias("sha"), F.length(F.trim(text)).cast("long").alias("chars"), F.col("run_id").cast("string"))
        done = self.outcomes().where("outcome = 'processed'").select(F.struct("document_id", "sha").alias("key")).distinct()
        known = rows.alias("r").join(done, F.col("r.document_id").eqNullSafe(F.col("key.document_id")) & (F.col("r.sha") == F.col("key.sha")), "left")
        outcome = F.when(F.col("key").isNotNull(), "reused").when(F.col("chars") == 0, "failed").otherwise("processed")
        known.select("r.*", outcome.alias("outcome")).write.mode("overwrite").parquet(f"{folder}/rows")
        told = self.spark.read.parquet(f"{folder}/rows")
        told.drop("run_id").write.mode("overwrite").parquet(f"{folder}/outcomes")
        new = told.groupBy("paper_id").agg(F.max(F.col("outcome") != "failed").alias("processed"), F.min("run_id").alias("first_seen"), _set(F.col("run_id")).alias("run_ids"), F.count_if(F.col("outcome") == "processed").alias("n_documents"))
        new.write.mode("overwrite").parquet(f"{folder}/records")
        if self.index is not None:
            fresh = documents.join(told.where("outcome = 'processed'").select("document_id").distinct(), documents["document_id"].cast("string").eqNullSafe(told["document_id"]), "left_semi")
            self.index.append(self.objects_of(fresh), f"batch {batch}")  # known by its name when it is tried again
        if before_commit is not None:
            before_commit(batch)
        self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{batch}")
        return True

    def drain(self, source: DataFrame, checkpoint: str, before_commit: Callable[[int], None] | None = None) -> None:
        """Takes in all that a stream has now; an attempt that was cut short goes on from `checkpoint`."""
        query = source.writeStream.foreachBatch(lambda rows, batch: self.take_in(rows, batch, before_commit) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def _set(c: Column) -> Column:
    return F.array_sort(F.collect_set(c))


def merged(records: DataFrame) -> DataFrame:
    """Records of several batches as one per paper."""
    return records.groupBy("paper_id").agg(F.max("processed").alias("processed"), F.min("first_seen").alias("first_seen"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("run_ids")))).alias("run_ids"), F.sum("n_documents").alias("n_documents"))
