"""The corpus pipeline: five stages over `documents`, each of which works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the documents are written as Parquet and
read again. All stages but the last return the columns of `documents`, and extra columns pass through whatever their
names. Stages decide about rows, told apart by doc_id and text: a row without an id, or one that shares its id with
another text, is kept or dropped for its own text only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import decontamination, exact_dedup, language_id, near_dedup, sentencepiece
from quarryline.llm.common import bounded_batches, read_table, renamed, written

#: A prediction below this probability counts as no language.
LEAST_SCORE = 0.5
#: Words that a worker of the encoder remembers: fewer than it would alone, as the workers also hold what other stages left.
REMEMBERED = 40_000
#: Bytes of a batch that goes to a Python worker, at most: its buffers outside the heap grow by doubling, and what they have
#: taken stays with the executor through all stages.
BATCH_BYTES = 1 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: no text, no letter, or no language with LEAST_SCORE of the probability.

    Null and empty texts go. Very long texts are read whole; repeated rows, rows without an id and ties fare alike, as
    only the text counts. An empty table stays empty; with no labelled row at all no language is known, and all rows go.
    """
    docs = bounded_batches(docs, BATCH_BYTES)
    guess = language_id.guess(language_id.fit(language_id.labelled(docs)))
    rows, names, old = renamed(docs)
    said = rows.withColumn("guess", guess(names["text"]))
    return said.where((F.col("guess.lang_pred") != "und") & (F.col("guess.score") >= LEAST_SCORE)).select(*old)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each group of equal texts: the longest as given, then the smallest id.

    Null, empty and white-space texts are one group. A row without an id stays only where its group has no row with one.
    Rows that repeat id and text are one row afterwards. An empty table stays empty.
    """
    return exact_dedup.without_copies(docs, exact_dedup.DigestIndex.create(spark))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each component of near-duplicates: that with the smallest id.

    Null, empty and white-space texts are linked with nothing and stay. A row without an id stays only where its
    component has no row with one. Rows that repeat id and text are one row afterwards. An empty table stays empty.
    """
    return near_dedup.without_copies(bounded_batches(docs, BATCH_BYTES))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover a benchmark item; items without an id count too.

    Null and empty texts stay, and so does everything if the benchmark is empty; each row is judged by its own text,
    however long and however often it stands there. An empty table stays empty.
    """
    return decontamination.without_contaminated(bounded_batches(docs, BATCH_BYTES), read_table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ids, n_tokens and round_trip (whether the ids decode to the text), which replace columns of these names.

    Null and empty texts have no ids and round_trip true. Every row is encoded whole, also repeated ones and those
    without an id. An empty table stays empty.
    """
    rows, names, _ = renamed(bounded_batches(docs, BATCH_BYTES).drop("ids", "n_tokens", "round_trip"))
    out = sentencepiece.encoded(rows.withColumn(names["text"], F.col(names["text"]).cast("string")).withColumnRenamed(names["text"], "text"), remembered=REMEMBERED)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    kept = [F.col("text") if c == "text" else F.col(n).alias(c) for c, n in names.items()]
    return out.select(*kept, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminated),
    ("sentencepiece", encoded),
]

#: SQL can't express the language model or the encoder; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
