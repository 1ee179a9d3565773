"""Operator 3, language ID: multinomial naive Bayes over hashed character n-grams.

Counts are gathered on the executors (sparse counts per task and language, summed in SQL); the log-probability matrix,
at most MAX_LANGUAGES x BUCKETS, is broadcast; texts are scored in numpy a block at a time: the block's sparse matrix of
texts and buckets times the matrix, language by language. Long texts are counted piece by piece; nothing is cut off.

Cases: a null text, or one without a letter, gets `und` with score 0; a null or empty language is never learned; with
no labelled row at all, or an empty table, no language is known and every text gets `und`; ties fall to the language
that sorts first; repeated rows count as often as they occur; very long texts are read whole; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import bounded_batches, learned_from, read_table

#: Hash buckets of n-grams, longest n-gram, code points handled at a time.
BUCKETS, LONGEST, PIECE = 1 << 13, 3, 1 << 16
#: Labelled rows that are learned from, at most; which ones follows from a hash of the id. All rows are scored.
MAX_TRAINING_ROWS = 20_000
#: Languages that are learned, at most: those with the most rows, of equals those that sort first.
MAX_LANGUAGES = 1_000


def _letters() -> np.ndarray:
    """Class of each code point of the basic plane: 1 for letters; others are folded to a space. Planes above count as letters where Python says so."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letters()
    return _LETTERS


def _buckets(points: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and bucket numbers of the 1- to 3-grams that end in a letter, from place `skip` on; non-letters are one space."""
    points = np.where(letters()[points], points, np.uint32(32))
    h, out = np.zeros(len(points) - skip, np.uint32), []
    for n in range(LONGEST):
        h = (h ^ points[skip - n : len(points) - n]) * np.uint32(0x85EBCA6B) + np.uint32(n + 1)
        out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    at = np.flatnonzero(points[skip:] != 32)
    return np.tile(at, LONGEST), np.concatenate([x[at] for x in out])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sparse_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, buckets and counts of a sparse matrix of texts and buckets, in blocks of about PIECE code points; a row may come in several blocks."""
    pad, at = " " * (LONGEST - 1), 0
    while at < len(texts):
        if len(texts[at] or "") > PIECE:  # a long text goes alone, a piece at a time, and is added up
            text, total = texts[at] or "", np.zeros(BUCKETS, np.int64)
            for begin in range(0, len(text), PIECE):
                piece = (text[begin - LONGEST + 1 : begin] if begin else pad).lower()
                total += np.bincount(_buckets(_points(piece + text[begin : begin + PIECE].lower()), len(piece))[1], minlength=BUCKETS)
            used = np.flatnonzero(total)
            yield np.full(len(used), at), used, total[used]
            at += 1
            continue
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= PIECE):
            size += len(texts[stop] or "")
            stop += 1
        lowered = [pad + (t or "").lower() for t in texts[at:stop]]
        ends = np.cumsum([len(t) for t in lowered])
        place, bucket = _buckets(_points("".join(lowered)), LONGEST - 1)
        row = np.searchsorted(ends, place + LONGEST - 1, "right")
        key, n = np.unique(row * BUCKETS + bucket, return_counts=True)
        yield key // BUCKETS + at, key % BUCKETS, n
        at = stop


def counts(text: str) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for _, bucket, n in sparse_counts([text]):
        np.add.at(total, bucket, n)
    return total


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # languages x BUCKETS
    log_prior: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The number of the best language of each text (-1: none) and its probability."""
        total, read = np.tile(self.log_prior, (len(texts), 1)), np.zeros(len(texts), bool)
        for row, bucket, n in sparse_counts(texts) if self.languages else ():
            read[row] = True
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(row, weights=n * self.log_prob[k, bucket], minlength=len(texts))
        if not read.any():
            return np.full(len(texts), -1), np.zeros(len(texts))
        best = total.argmax(1)
        share = 1 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(1)
        return np.where(read, best, -1), np.where(read, share, 0.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        best, share = self.scores([text])
        return self.languages[best[0]] if best[0] >= 0 else "und", float(share[0])


def fit(docs: DataFrame, max_rows: int = MAX_TRAINING_ROWS, smoothing: float = 0.5, max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Learns from rows with a language, at most `max_rows` of them (those whose id hashes lowest)."""
    rank = F.xxhash64("doc_id", F.col("text"))
    cut = docs.select(rank.alias("r")).orderBy("r").limit(max_rows).agg(F.max("r")).first()[0]
    if cut is None:
        return LanguageModel((), np.zeros((0, BUCKETS)), np.zeros(0))

    def gather(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            names, number = np.unique(langs, return_inverse=True)
            keys, sums = [number * (BUCKETS + 1) + BUCKETS], [np.ones(len(langs), np.int64)]
            for row, bucket, n in sparse_counts(batch.column(1).to_pylist()):
                keys.append(number[row] * (BUCKETS + 1) + bucket)
                sums.append(n)
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate(sums)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names[key // (BUCKETS + 1)], pa.string()), pa.array((key % (BUCKETS + 1)).astype(np.int32)), pa.array(n)], ["lang", "bucket", "n"])

    taken = bounded_batches(docs).where(rank <= cut).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    known = [r.lang for r in taken.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()]
    sums = taken.where(F.col("lang").isin(known)).mapInArrow(gather, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = tuple(sorted(known))
    number, table = {x: i for i, x in enumerate(langs)}, np.zeros((len(langs), BUCKETS + 1))
    for r in sums.toLocalIterator():  # at most languages x (BUCKETS + 1) rows
        table[number[r.lang], r.bucket] = r.n
    rows_of, table = table[:, -1], table[:, :-1] + smoothing
    return LanguageModel(langs, np.log(table / table.sum(1, keepdims=True)), np.log((rows_of + smoothing) / (rows_of + smoothing).sum()))


def guess(model: LanguageModel):
    """A column function: (lang_pred, score) of a text; the model is broadcast."""
    known = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predicted(texts: pa.Array) -> pa.Array:
        best, share = known.value.scores(texts.to_pylist())
        names = np.array([*known.value.languages, "und"], object)
        return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(share, pa.float64())], ["lang_pred", "score"])

    return lambda text: predicted(F.col(text).cast("string"))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    said = bounded_batches(docs).select("doc_id", guess(model)("text").alias("guess"))
    return said.select("doc_id", "guess.lang_pred", "guess.score")


def labelled(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: outside the held-out third, with a language."""
    return docs.where(learned_from() & F.col("lang").isNotNull() & (F.col("lang") != "") & (F.col("lang") != "und")).select("doc_id", "lang", "text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, lang_pred, score."""
    docs = read_table(spark, sf_dir, "documents")
    out = identify(docs, fit(labelled(docs)))
    return out.select("doc_id", (~learned_from()).alias("held_out"), "lang_pred", "score")
