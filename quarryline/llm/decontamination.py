"""Operator 5, benchmark decontamination: greedy string tiling.

1. Seeds: the runs of MIN_MATCH words of every test item. A bitmap of their hashes, of at most 2 ** MOST_BITS bits, goes
   to the executors, and one pass over the documents gathers the seeds of each text that the bitmap knows.
2. These are joined with the items' seeds. A pair of text and item goes on if the item's words that its shared seeds
   cover could reach the coverage; seeds that very many texts have are joined by broadcast.
3. Greedy string tiling of the pairs that are left: the longest run of equal words that is free in both is marked, again
   and again, until no run of MIN_MATCH words is left. The longest length is found by bisection over rolled Karp-Rabin
   hashes of all free windows, and all runs of that length are marked in one sweep, so the memory is that of the two
   word lists however often their words repeat.
4. The share of the item's words that are marked, in whatever order the text has them, decides.

Words are maximal runs of letters, digits and non-ASCII characters, lower-cased, so punctuation and layout don't hide a
passage. The documents are read once, whatever the size of the benchmark, and those that share seeds once more.

Cases: null and empty texts match nothing; an item of fewer than MIN_MATCH words is found where it stands whole, and is
reported by `matches`, while `without_contaminated` passes over items of fewer than FEWEST_WORDS, which clean texts hold
by chance; an item without words matches nothing; an item without an id is searched like any other and reported with a
null id; repeated items count once; ties between equally long runs fall to the first place in the text, then in the
item; very long texts are read whole; repeated rows, and rows without an id, are reported as often as they occur; an
empty documents or benchmark table gives an empty result; extra columns pass through `without_contaminated` untouched,
whatever their names, and are not read by `matches`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import BROADCAST_KEYS, ByteWords, bounded_batches, mix, not_alphanumeric, read_table, rolled, row_key, shingle_hashes, slices, split_join, utf8, without_rows, written

MIN_MATCH = 5
#: Share of an item's words that must be covered.
COVERAGE = 0.5
#: Words of an item from which it takes a document out of a corpus.
FEWEST_WORDS = 3
#: The bitmap of seeds has 32 bits for each seed, at least and at most these powers of two (128 MB).
LEAST_BITS, MOST_BITS = 12, 30


def lowered_words(column, words: ByteWords):
    import pyarrow.compute as pc

    data, offsets = utf8(pc.utf8_lower(pc.fill_null(column, "")))
    h, _, _, first = words.hashes(data, offsets)
    return h, first


def seeds_of(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; runs of another width have other hashes."""
    return mix(shingle_hashes(words, width) + np.uint64(width))


def _regions(text: np.ndarray, item: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of the text that stand in a seed of the item, and their places; a place of -1 divides two regions."""
    at = np.flatnonzero(np.isin(shingle_hashes(text, least), shingle_hashes(item, least)))
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + least, -1)
    places = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    gaps = np.flatnonzero(np.diff(places) > 1) + 1
    return np.insert(text[places], gaps, 0), np.insert(places, gaps, -1)


def tiles(text: np.ndarray, item: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling of two lists of word hashes: (place in the text, place in the item, words) of each tile."""
    if min(len(text), len(item)) < least:
        return []
    text, places = _regions(text, item, least)
    text_free, item_free = places >= 0, np.ones(len(item), bool)
    in_text, in_item = rolled(text), rolled(item)

    def windows(free: np.ndarray, n: int) -> np.ndarray:
        """Where windows of n free words begin."""
        taken = np.concatenate([[0], np.cumsum(~free)])
        return np.flatnonzero(taken[n:] == taken[:-n]) if n <= len(free) else np.zeros(0, np.int64)

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = windows(text_free, n), windows(item_free, n)
        ha, hb = in_text(n)[a], in_item(n)[b]
        a_in, b_in = np.isin(ha, hb), np.isin(hb, ha)
        return a[a_in], ha[a_in], b[b_in], hb[b_in]

    out: list[tuple[int, int, int]] = []
    top = min(len(text), len(item))
    while len(common(least)[0]):
        low, high = least, top
        while low < high:
            mid = (low + high + 1) // 2
            if len(common(mid)[0]):
                low = mid
            else:
                high = mid - 1
        top = low
        a, ha, b, hb = common(top)
        # places in the item by hash, the first one last, so that it is popped first
        held: dict[int, list[int]] = {}
        for j, h in zip(b[::-1].tolist(), hb[::-1].tolist(), strict=True):
            held.setdefault(h, []).append(j)
        free_from = 0
        for i, h in zip(a.tolist(), ha.tolist(), strict=True):
            if i < free_from:
                continue
            places_of = held[h]
            while places_of and not (item_free[places_of[-1]] and item_free[places_of[-1] + top - 1]):
                places_of.pop()
            if places_of:
                j = places_of.pop()
                item_free[j : j + top] = False
                text_free[i : i + top] = False
                free_from = i + top
                out.append((int(places[i]), j, top))
    return out


def items_of(benchmark: DataFrame) -> DataFrame:
    """k (a number of its own), item_id and text of the distinct items, as a written table."""
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    return written(items.withColumn("k", F.monotonically_increasing_id()), "items")


def item_seeds(items: DataFrame, least: int) -> DataFrame:
    """seed, k, n (how often it stands in the item), words (of the item) and width."""

    def cut(batches):
        import pyarrow as pa

        words = ByteWords(not_alphanumeric())
        for batch in (part for b in batches for part in slices(b, 1)):
            h, first = lowered_words(batch.column(1), words)
            for i in range(batch.num_rows):
                own = h[first[i] : first[i + 1]]
                width = min(least, len(own))
                if width:
                    seed, n = np.unique(seeds_of(own, width).view(np.int64), return_counts=True)
                    same = lambda v, kind=pa.int64(): pa.array(np.full(len(seed), v), kind)
                    yield pa.RecordBatch.from_arrays([pa.array(seed), same(batch.column(0)[i].as_py()), pa.array(n), same(len(own)), same(width)], ["seed", "k", "n", "words", "width"])

    return bounded_batches(items.select("k", "text")).mapInArrow(cut, "seed long, k long, n long, words long, width long")


def bitmap(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """Words of a bitmap of all seeds, made on the executors, and by how much a hash is shifted to its bit."""
    bits = max(LEAST_BITS, min(MOST_BITS, seeds.count().bit_length() + 5))
    at = F.shiftrightunsigned("seed", 64 - bits)
    rows = seeds.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(shiftrightunsigned(seed, %d), 64) as int))" % (64 - bits)).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for r in rows.toLocalIterator():
        out[r["word"]] = np.int64(r["bits"]).view(np.uint64)
    return out, 64 - bits


def candidates(docs: DataFrame, items: DataFrame, coverage: float, least: int) -> DataFrame:
    """doc_id, h and k of the texts and items whose shared seeds could reach the coverage."""
    seeds = written(item_seeds(items, least), "seeds")
    widths = [r["width"] for r in seeds.select("width").distinct().collect()]  # at most `least` rows
    held, shift = bitmap(seeds)
    known = docs.sparkSession.sparkContext.broadcast(held)
    id_type = dict(docs.dtypes)["doc_id"]

    def scan(batches):
        import pyarrow as pa

        words, table = ByteWords(not_alphanumeric()), known.value
        for batch in (part for b in batches for part in slices(b, 1)):
            h, first = lowered_words(batch.column(1), words)
            rows, found = [], []
            for width in widths:
                s = seeds_of(h, width)
                at = s >> np.uint64(shift)
                hit = np.flatnonzero((table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
                text = np.searchsorted(first, hit, "right") - 1
                inside = hit + width <= first[text + 1]
                rows.append(text[inside])
                found.append(s[hit[inside]].view(np.int64))
            if rows and sum(map(len, rows)):
                both = np.unique(np.stack([np.concatenate(rows), np.concatenate(found)]), axis=1)
                text = pa.array(both[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(text), batch.column(2).take(text), pa.array(both[1])], ["doc_id", "h", "seed"])

    texts = bounded_batches(docs.select("doc_id", F.col("text").cast("string").alias("text"), row_key().alias("h")))
    hits = written(texts.mapInArrow(scan, f"doc_id {id_type}, h long, seed long").distinct(), "hits")
    often = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("held"))
    per_seed = written(seeds.groupBy("seed").agg(F.collect_list(F.struct("k", "n", "words")).alias("items")).join(often, "seed"), "per_seed")
    pairs = split_join(hits, per_seed, "seed", hits.count()).select("doc_id", "h", F.inline("items"))
    # each place of a seed covers at most `least` words
    return pairs.groupBy("doc_id", "h", "k", "words").agg(F.sum("n").alias("n")).where(F.col("n") * least >= F.lit(coverage) * F.col("words")).select("doc_id", "h", "k")


def _matches(docs: DataFrame, benchmark: DataFrame, coverage: float, least: int) -> DataFrame:
    """`matches` with h, the hash of the text."""
    items = items_of(benchmark)
    id_type = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, h long, item_id long, n_tiles int, words_covered long, item_words long, coverage double"
    pairs = written(candidates(docs, items, coverage, least), "pairs")
    asked = pairs.join(items, "k").groupBy(F.col("doc_id").alias("of_doc"), F.col("h").alias("of_text")).agg(F.collect_list(F.struct("item_id", "text")).alias("items"))

    def compare(batches):
        import pyarrow as pa

        words = ByteWords(not_alphanumeric())
        for batch in (part for b in batches for part in slices(b, 2)):
            h, first = lowered_words(batch.column(2), words)
            rows = []
            for i in range(batch.num_rows):
                asked_of = batch.column(3)[i].as_py()
                ih, ifirst = lowered_words(pa.array([x["text"] for x in asked_of], pa.string()), words)
                for x, a, b in zip(asked_of, ifirst[:-1], ifirst[1:], strict=True):
                    n = int(b - a)
                    got = tiles(h[first[i] : first[i + 1]], ih[a:b], min(least, n))
                    covered = sum(t[2] for t in got)
                    if covered and covered >= coverage * n:
                        rows.append((i, x["item_id"], len(got), covered, n, covered / n))
            at, item, tiled, covered, n, share = zip(*rows, strict=True) if rows else ((),) * 6
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(item, pa.int64()), pa.array(tiled, pa.int32()), pa.array(covered, pa.int64()), pa.array(n, pa.int64()), pa.array(share, pa.float64())], ["doc_id", "h", "item_id", "n_tiles", "words_covered", "item_words", "coverage"])

    keys = written(pairs.select(F.struct(F.col("doc_id").alias("i"), F.col("h").alias("h")).alias("key")).distinct(), "keys")
    few = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    texts = own.join(few, F.col("doc_id").eqNullSafe(F.col("key.i")) & (row_key() == F.col("key.h")), "left_semi")
    rows = texts.select("doc_id", row_key().alias("h"), "text").join(asked, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("h") == F.col("of_text"))).select("doc_id", "h", "text", "items")
    return bounded_batches(rows).mapInArrow(compare, schema)


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_MATCH) -> DataFrame:
    """A row per document and item that it covers: doc_id, item_id, n_tiles, words_covered, item_words, coverage."""
    return _matches(docs, benchmark, coverage, least).drop("h")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_MATCH, fewest: int = FEWEST_WORDS) -> DataFrame:
    """The rows of `docs` that cover no item of `fewest` words or more, with all their columns."""
    found = _matches(docs, benchmark, coverage, least).where(F.col("item_words") >= fewest)
    return without_rows(docs, found.select("doc_id", "h"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item; the pairs that reach the coverage."""
    return matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
