"""Operator 2, toxicity: compression distance to zstandard dictionaries of toxic and of ordinary text.

Labelled training rows are divided by a hash of the id: two thirds give the two dictionaries, the rest calibrate. Toxic
texts are mostly made of ordinary words, and two dictionaries trained on whole texts differ mostly by chance. So each
dictionary is a front of what only its label has above what all texts share: zstandard trains the shared part, up to
BASE_BYTES, on ordinary texts; the toxic front holds the words that toxic texts have more often than ordinary ones would
let expect (a G-test), the ordinary front is ordinary text of the same length. The shared part is nearer to what is
compressed, so a window without toxic words is as long with either.

A text, lower-cased and reduced to its words, is cut into windows of about WINDOW bytes; what the toxic dictionary saves
over the ordinary one is a window's evidence. A document's features are its strongest windows, their sum, and the number
and share of windows above a threshold calibrated on ordinary windows; a logistic curve over these, calibrated on the
rows kept back, is the score.

Training takes at most MAX_DOCS rows of either label (those whose id hashes lowest); every text is learned from and
scored whole. Words are counted and windows measured on the executors; of the rows kept back only how often each
saving occurs comes to the driver, of the others the telling words and the ordinary texts that zstandard trains on.
Labels, language, source and id are not inputs of a score.

Cases: null and empty texts get the score that the calibration gives to no evidence at all; documents with several
labels count with each; with no labelled row of one kind, every score is 0; repeated rows are scored alike; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import bounded_batches, learned_from, read_table, slices, utf8, written

WINDOW, LEVEL, BASE_BYTES, FRONT_BYTES = 96, 9, 120_000, 1 << 14
MAX_DOCS = 2_000
#: A document is called toxic from this score on.
THRESHOLD = 0.7
#: Share of ordinary windows above the window threshold; windows that count as a document's strongest.
FALSE_WINDOWS, STRONGEST = 0.001, 3
#: G value from which a word counts as more frequent in toxic texts.
G_LEAST = 24.0
#: Triples of words, of one or more texts, that a worker holds at a time.
TRIPLES = 1 << 15


_WORDS = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


class Compressor:
    """Compressed lengths of windows with one dictionary, used as the text before a window."""

    def __init__(self, dictionary: bytes):
        import zstandard as z

        p = z.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=len(dictionary), write_checksum=False, write_content_size=False, write_dict_id=False)
        d = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        self.compress = z.ZstdCompressor(dict_data=d, compression_params=p).compress

    def size(self, window: bytes) -> int:
        return len(self.compress(window))


def reduced(data: bytes) -> bytes:
    """The words of a lower-cased text, with single spaces between and around them."""
    return b" " + b" ".join(_WORDS.findall(data)) + b" "


def windows(data: bytes) -> list[bytes]:
    """Windows of a reduced text, cut at spaces (a longer word is cut as it is); the space belongs to both sides."""
    out, at, last = [], 0, len(data) - 1
    while at < last:
        end = at + WINDOW
        if end <= last:
            space = data.rfind(b" ", at + WINDOW // 2, end)
            end = space + 1 if space > 0 else end
        out.append(data[at:end])
        at = end - 1 if data[end - 1 : end] == b" " else end
    return out


def evidence(data: bytes, toxic: Compressor, ordinary: Compressor) -> np.ndarray:
    """What the toxic dictionary saves on each window of a lower-cased text, in bytes."""
    return np.array([ordinary.size(w) - toxic.size(w) for w in windows(reduced(data))], np.float64)


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    window_threshold: float
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def features(self, saved: np.ndarray) -> np.ndarray:
        if not len(saved):
            return np.zeros(5)
        strongest, above = np.sort(saved)[-STRONGEST:], saved > self.window_threshold
        return np.array([strongest.mean(), strongest[-1], np.log1p(above.sum()), np.sqrt(above.mean()), saved.sum() / np.sqrt(len(saved))])

    def score(self, saved: np.ndarray) -> float:
        x = (self.features(saved) - self.centre) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, both labels weighing the same in all."""
    x = np.hstack([np.ones((len(x), 1)), x])
    each = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * len(y)
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (each * p * (1 - p))[:, None]).T @ x + penalty
        w = w - np.linalg.solve(h, x.T @ (each * (p - y)) + penalty @ w)
    return w


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """toxic, part, data and doc_id of the labelled rows that are learned from, whole, as a written table; part 2 calibrates."""
    own = labels.where(learned_from() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    rank = F.xxhash64("doc_id", F.lit("toxicity"))
    taken = None
    for label in (0, 1):
        part = own.where(F.col("toxic") == label).orderBy(rank, "doc_id").limit(max_docs)
        taken = part if taken is None else taken.unionAll(part)
    texts = docs.select("doc_id", F.encode(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), "utf-8").alias("data"))
    rows = texts.join(F.broadcast(taken), "doc_id").select("toxic", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)).cast("int").alias("part"), "data", "doc_id")
    return written(rows, "labelled")


def triples(rows: DataFrame) -> DataFrame:
    """toxic, key of the text, word, and the word between its neighbours, of every word of the texts."""
    kind = dict(rows.dtypes)["doc_id"]

    def split(batches):
        import pyarrow as pa

        def batch_of(toxic, doc_id, digest, held):
            word, triple = zip(*held, strict=True)
            n = len(word)
            return pa.RecordBatch.from_arrays([pa.array([toxic] * n, pa.int32()), pa.repeat(doc_id, n), pa.array([digest] * n, pa.int64()), pa.array(word, pa.binary()), pa.array(triple, pa.binary())], ["toxic", "doc_id", "digest", "word", "triple"])

        for b in batches:
            for i in range(b.num_rows):
                toxic, doc_id, digest, data = b.column(0)[i].as_py(), b.column(1)[i], b.column(2)[i].as_py(), b.column(3)[i].as_py()
                held, before, word = set(), b"", None
                for after in chain((m[0] for m in _WORDS.finditer(data)), (b"",)):
                    if word is not None:
                        held.add((word, before + b" " + word + b" " + after))
                        before = word
                        if len(held) >= TRIPLES:
                            yield batch_of(toxic, doc_id, digest, held)
                            held = set()
                    word = after
                if held:
                    yield batch_of(toxic, doc_id, digest, held)

    texts = bounded_batches(rows.select("toxic", "doc_id", F.xxhash64("data").alias("digest"), "data"))
    return texts.mapInArrow(split, f"toxic int, doc_id {kind}, digest long, word binary, triple binary").select("toxic", F.struct("doc_id", "digest").alias("key"), "word", "triple")


def telling_words(rows: DataFrame, least: float = G_LEAST, most_bytes: int = FRONT_BYTES) -> list[bytes]:
    """Words that stand in more toxic texts than ordinary ones would let expect; if they need more than `most_bytes`, those of the highest G.

    A text counts for a word only if it has it between a pair of neighbours that no text before had, so copies and
    repeated passages don't count again, and long texts count once.
    """
    first = triples(rows).groupBy("toxic", "word", "triple").agg(F.min("key").alias("key"))
    own = written(first.select("toxic", "word", "key").distinct(), "words")
    totals = dict.fromkeys((0, 1), 0) | {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count_distinct("key").alias("n")).collect()}
    share = totals[1] / max(sum(totals.values()), 1)
    if not 0 < share < 1:
        return []
    counts = own.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("ordinary"))
    n, term = F.col("toxic") + F.col("ordinary"), lambda c, s: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * s))).otherwise(0.0)
    g = counts.where(F.col("toxic") > n * share).select("word", (2 * (term("toxic", F.lit(share)) + term("ordinary", F.lit(1 - share)))).alias("g"))
    out, left = [], most_bytes
    for r in g.where(F.col("g") >= least).orderBy(F.desc("g"), "word").limit(most_bytes // 3).collect():
        if len(r.word) + 2 <= left:
            out.append(bytes(r.word))
            left -= len(r.word) + 2
    return sorted(out)


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; where there is too little text to train on, the text itself."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def savings(rows: DataFrame, toxic: bytes, ordinary: bytes) -> list[tuple[int, np.ndarray]]:
    """(label, evidence of all windows, in order of size) of each text: executors count how often each saving occurs."""

    def count(batches):
        import pyarrow as pa

        by = Compressor(toxic), Compressor(ordinary)
        for batch in batches:
            for i in range(batch.num_rows):
                values, counts = np.unique(evidence(batch.column(1)[i].as_py(), *by).astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([values]), pa.array([counts])], ["toxic", "saved", "n"])

    found = bounded_batches(rows.select("toxic", "data")).mapInArrow(count, "toxic int, saved array<int>, n array<long>").collect()
    return sorted(((r.toxic, np.repeat(np.array(r.saved, np.float64), np.array(r.n, np.int64))) for r in found), key=lambda x: (x[0], x[1].tolist()))


def fit(rows: DataFrame, base_bytes: int = BASE_BYTES, front_bytes: int = FRONT_BYTES) -> ToxicityModel | None:
    """Dictionaries and calibration from `training_rows`; None if one of the labels is missing."""
    seen = rows.groupBy("toxic", (F.col("part") == 2).alias("held"), (F.length("data") > 0).alias("said")).count().collect()
    taught, held_rows = rows.where("part != 2"), rows.where("part = 2")
    if len({r.toxic for r in seen if not r.held and r.said}) < 2 or len({r.toxic for r in seen if r.held}) < 2:
        taught = held_rows = rows
    if len({r.toxic for r in seen if r.said}) < 2:
        return None
    # whole texts, so that zstandard has all of them to train on
    plain = [reduced(bytes(r.data)) for r in taught.where("toxic = 0").select("doc_id", "data").orderBy("doc_id", "data").toLocalIterator()]
    toxic_front = b"".join(b" " + w + b" " for w in telling_words(taught, most_bytes=front_bytes))
    if not toxic_front:
        for r in taught.where("toxic = 1").select("doc_id", "data").orderBy("doc_id", "data").toLocalIterator():
            toxic_front = (toxic_front + reduced(bytes(r.data)))[:front_bytes]
    ordinary_front = (b"".join(plain) or b" ")[: len(toxic_front)].ljust(len(toxic_front))
    base = trained(plain, base_bytes)
    model = ToxicityModel(toxic_front + base, ordinary_front + base, 0.0, np.zeros(6), np.zeros(5), np.ones(5))
    held = savings(held_rows, model.toxic, model.ordinary)
    model.window_threshold = float(np.quantile(np.concatenate([np.zeros(1), *(s for y, s in held if y == 0)]), 1 - FALSE_WINDOWS))
    x, y = np.array([model.features(s) for _, s in held]), np.array([y for y, _ in held])
    model.centre, model.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    model.weights = logistic((x - model.centre) / model.scale, y)
    return model


def scored(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id and score of every row."""

    def score(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        toxic, ordinary = (Compressor(model.toxic), Compressor(model.ordinary)) if model else (None, None)
        for batch in (part for b in batches for part in slices(b, 1)):
            data, offsets = utf8(pc.utf8_lower(pc.fill_null(batch.column(1), "")))
            raw = data.tobytes() if len(offsets) > 1 else b""
            out = [model.score(evidence(raw[a:b], toxic, ordinary)) if model else 0.0 for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return bounded_batches(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, score, predicted."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = scored(docs, fit(training_rows(docs, labels)))
    return out.select("doc_id", (~learned_from()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
