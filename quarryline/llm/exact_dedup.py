"""Operator 10, exact dedup: a persistent digest index, bucketed and sorted by hash.

Texts are equal when their SHA-256 after deleting white space (0x20, 0x09-0x0D) is equal. A batch is deduplicated by a
sort-merge anti-join of its digests with the index, and its new digests are appended. Everything is DataFrame code.

Cases: a null text counts as empty; all empty and white-space texts are one group; equal lengths fall to the smallest
doc_id; a null doc_id sorts last and never stands for a group that has another; very long texts are hashed whole;
repeated rows are members of the group like any other, and all rows that have the id and the text of the one that stays
are `kept` in `ingest`, which can't tell them apart, while `without_copies` leaves exactly one of them; an empty batch
gives an empty result. Extra columns are not read, so their names can't clash.

A digest is stored with the id and the text hash of the row that stays, and a row is kept if it is that row. So a batch
that is taken in again, after a failure between the append and the writing of its result or for any other reason, adds
nothing and keeps the same rows; a copy under another id or with another text is dropped then as ever.

The number of buckets follows from the first batch (BUCKET_ROWS digests each, FEWEST at least) and is written beside the
index, where `open` finds it; `compact` rewrites the index so that each bucket is one sorted file again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import read_table, row_key, shared_dir, split_join, text_of, without_rows, written

#: The white space that is deleted before texts are compared.
WHITE_SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text):
    for c in WHITE_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, h (hash of the text as given), n_points (its code points), digest (32 bytes)."""
    text = text_of(docs, text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(text_col).alias("h"), F.length(text).cast("long").alias("n_points"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"))


#: Digests of the first batch for each bucket, and the least number of buckets.
BUCKET_ROWS, FEWEST = 2_000_000, 64


@dataclass
class DigestIndex:
    """Digests already taken in: a table of (digest, keep_id, keep_h, n_points), bucketed and sorted by digest.

    `buckets` is chosen when the first batch comes in, from its size, unless it is given.
    """

    spark: SparkSession
    table: str
    path: str
    buckets: int | None = None
    made: bool = False

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        """A new, empty index at `path` (by default a new folder in the shared one)."""
        return cls(spark, f"digest_index_{uuid.uuid4().hex}", path or f"{shared_dir(spark)}-digests", buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int | None = None) -> DigestIndex:
        """An index that an earlier session left at `path`; `buckets`, if given, must be the number it was made with."""
        held = spark.read.schema("buckets int").json(f"{path}-buckets").first()[0]
        if buckets not in (None, held):
            raise ValueError(f"the index at {path} has {held} buckets, not {buckets}")
        out = cls(spark, f"digest_index_{uuid.uuid4().hex}", path, held, True)
        out._table()
        return out

    def _table(self) -> None:
        self.spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, keep_h BIGINT, n_points BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {int(self.buckets or FEWEST)} BUCKETS LOCATION '{self.path}'")

    def _write(self, rows: DataFrame, mode: str) -> None:
        dealt = rows.select("digest", "keep_id", "keep_h", "n_points").repartition(self.buckets, "digest")
        dealt.write.format("parquet").mode(mode).bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)
        self.made = True

    def read(self) -> DataFrame:
        if not self.made:
            # rows of Python's, even none, would start Python workers
            return self.spark.range(0).selectExpr("CAST(null AS BINARY) AS digest", "CAST(null AS LONG) AS keep_id", "CAST(null AS LONG) AS keep_h", "CAST(null AS LONG) AS n_points")
        return self.spark.table(self.table)

    def append(self, groups: DataFrame, rows: int) -> None:
        """Adds one row per digest, `rows` of them; the rows are dealt by digest first, so that each bucket gets one sorted file."""
        if self.buckets is None:
            self.buckets = max(FEWEST, -(-rows // BUCKET_ROWS))
        if not self.made:
            self.spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.mode("overwrite").json(f"{self.path}-buckets")
        self._write(groups, "append" if self.made else "overwrite")
        self.spark.catalog.refreshTable(self.table)

    def compact(self, path: str | None = None) -> DigestIndex:
        """The same index in a new place, with one sorted file per bucket and as many buckets as its size asks for; the old one stays until it is dropped."""
        rows = self.read()
        n = rows.count()
        out = DigestIndex.create(self.spark, path)
        out.append(rows, n)
        return out

    def drop(self) -> None:
        """Takes the table out of the catalogue; the files stay at `path`."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def ingest(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicates a batch against the index and itself, appends what is new, and returns a row per document.

    Columns: doc_id, keep_id (of the row that stays: one taken in before, or else the longest of the batch), group_size
    (rows of the batch with this text), kept, text_sha256.
    """
    return _decided(docs, index, id_col, text_col).select("doc_id", "keep_id", "group_size", _stays().alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _stays():
    """Whether a row is the one that stands for its text, in the index or in this batch."""
    return F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h"))


def without_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """`docs` with exactly one row of each group of equal texts that the index doesn't know; what is new is appended."""
    rows = _decided(docs, index, "doc_id", "text")
    keys = written(rows.groupBy("doc_id", "h", "digest", _stays().alias("stays")).agg(F.count(F.lit(1)).alias("times")), "keys")
    return without_rows(docs, keys.where("NOT stays"), keys.where("stays AND times > 1"))


def _decided(docs: DataFrame, index: DigestIndex, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h, digest, keep_id, keep_h and group_size of every row; appends what is new."""
    rows = written(digests(docs, id_col, text_col), "digests")
    best = F.min(F.struct((-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "h"))
    groups = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select("digest", F.col("best.id").alias("keep_id"), F.col("best.h").alias("keep_h"), (-F.col("best.shorter")).alias("n_points"), "group_size")
    groups = written(groups, "groups")
    known = index.read().select("digest", F.col("keep_id").alias("known_id"), F.col("keep_h").alias("known_h"))
    new = written(groups.join(known.hint("merge"), "digest", "left_anti"), "new")
    decided = new
    if index.made:
        old = groups.join(known.hint("merge"), "digest").select("digest", F.col("known_id").alias("keep_id"), F.col("known_h").alias("keep_h"), "n_points", "group_size")
        decided = written(new.unionByName(old), "decided")
    index.append(new, new.count())
    # a text that very many rows have is joined where they are
    per_digest = decided.select("digest", "keep_id", "keep_h", "group_size", F.col("group_size").alias("held"))
    return split_join(rows.select("doc_id", "h", "digest"), per_digest, "digest", rows.count())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against a new index: doc_id, keep_id, group_size, kept, text_sha256."""
    index = DigestIndex.create(spark)
    out = ingest(read_table(spark, sf_dir, "documents"), index)
    index.drop()  # the query's index is its own; its files go with the shared folder
    return out


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), g AS (SELECT h, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""
