"""A persistent inverted index, and retrieval from it for tables of questions (inventory R-01, R-02, R-07, R-09, R-12, A-28).

Texts are read once, when they are taken in. Each task deals its objects into parts of PART_OBJECTS, and writes a block for
each word of a part: which objects of the part have it, how often their text has it, and whether their name or body does;
with the block go its largest count and its shortest text, from which a bound of every BM25 contribution follows. Blocks
are dealt to buckets by word and sorted by word; a word that stands in very many parts is spread over SPREAD buckets. So a
question reads the buckets of its words and, in them, the row groups that have them. Objects are a table of their own.

A batch becomes a segment, which counts from the moment its manifest row is written: a batch that failed midway is written
over, one that is taken in twice is known by its name and changes nothing, and objects whose id is known stay as they are.

Questions are answered part by part, in tasks that hold one part's blocks for the words asked: a matrix of questions and
objects of the part, of which each question's best rows leave the task. For BM25 the heads of the blocks bound what a part
can give a question; a few of the most promising parts are scored first, and only parts whose bound reaches the limit-th
best score found there are scored afterwards. The result is that of scoring everything.

Objects have id, text, name and body (null counts as empty), and the carried columns. Questions have query_id and text,
and may have kinds, paper_ids (empty or null: all) and min_confidence, which lexical retrieval heeds. Questions are worked
on in blocks of QUESTIONS. Equal scores are ordered by id. A null id is taken in like any other; of repeated ids in one
batch each is an object of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarryline.functions import text as T
from quarryline.functions.confidence import weighted_score
from quarryline.operators.errors import PrerequisiteNotMet
from quarryline.plans.shared import shared_dir, written

#: Objects of a part, and words of a part's texts in sum, at most (one longer text is a part of its own).
PART_OBJECTS, PART_WORDS = 1 << 13, 2_000_000
#: Bits of a place in a part.
PLACE_BITS = 13
#: Buckets of a segment, and buckets that one word may be spread over.
BUCKETS, SPREAD = 64, 16
#: Questions that are answered together, and parts in which each looks first.
QUESTIONS, FIRST = 250, 4
#: Texts that are Python strings at a time, and questions whose scores are held at a time in a part.
TEXTS_AT_ONCE, QUESTIONS_AT_ONCE = 500, 25
#: Distinct words of a block of questions that are broadcast; more are joined by shuffle.
BROADCAST_WORDS = 1_000_000
#: What the arms read of an object besides its words.
CARRIED = ("kind", "paper_id", "confidence", "n_evidence", "name_key", "precision")


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class _Part:
    """The objects and words of one part, while it is gathered."""

    def __init__(self):
        self.words, self.found, self.lengths, self.size = _Numbers(), [], [], 0

    def add(self, *texts: str) -> None:
        """Text, name and body of an object; the length is that of the text."""
        own = len(self.lengths)
        for mark, said in enumerate(texts):
            numbers = np.array([self.words[w] for w in said.split(" ") if len(w) > 1], np.int64)
            if mark == 0:
                self.lengths.append(len(numbers))
            self.size += len(numbers)
            word, n = np.unique(numbers, return_counts=True)
            if len(word):
                self.found.append((word * PART_OBJECTS + own, n.astype(np.int32) if mark == 0 else np.zeros(len(n), np.int32), np.full(len(n), mark, np.int8)))

    def blocks(self):
        """The words and, of each, its postings (8 bytes: place, marks and count) and the head: n_docs, most, shortest, total."""
        import pyarrow as pa

        if not self.found:
            return None
        keys, counts, marks = (np.concatenate(x) for x in zip(*self.found, strict=True))
        self.found = []
        order = np.argsort(keys, kind="stable")
        keys, counts, marks = keys[order], counts[order], marks[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))  # text, name and body that share a word
        keys, counts, marks = keys[starts], np.add.reduceat(counts, starts), np.add.reduceat(marks, starts)
        word, own = keys // PART_OBJECTS, keys % PART_OBJECTS
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        packed = own | (marks.astype(np.int64) << PLACE_BITS) | (counts.astype(np.int64) << PLACE_BITS + 2)
        offsets = (np.append(starts, len(word)) * 8).astype(np.int32)
        postings = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed.tobytes())])
        names = pa.array(list(self.words), pa.string()).take(pa.array(word[starts]))
        counted, length = counts > 0, np.array(self.lengths, np.int32)[own]
        heads = [np.add.reduceat(counted.astype(np.int32), starts), np.maximum.reduceat(counts, starts), np.minimum.reduceat(np.where(counted, length, np.iinfo(np.int32).max), starts), np.add.reduceat(counts.astype(np.int64), starts)]
        return [names, postings, *(pa.array(h) for h in heads)]


def unpacked(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow column of postings: the places, counts and marks of all rows one after the other, and the end of each row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.frombuffer(b"".join(column.to_pylist()), np.int64)
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)) // 8
    return flat & (PART_OBJECTS - 1), flat >> PLACE_BITS + 2, (flat >> PLACE_BITS) & 3, ends


#: What a block has besides its part.
BLOCK = "term string, postings binary, n_docs int, most int, shortest int, total long"


def _rows(objects: DataFrame, segment: int, carried: list[str], part_objects: int) -> DataFrame:
    """Objects (term null) and blocks (object null) of a batch, in one pass over its texts; a column that isn't there is empty."""
    said = lambda c: T.normalise(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in objects.columns else F.lit("")
    read = objects.select("id", said("text").alias("text"), said("name").alias("name"), said("body").alias("body"), *carried)
    own = ", ".join(f"{c}: {objects.schema[c].dataType.simpleString()}" for c in ["id", *carried])
    schema = f"part long, object struct<{own}, place: int, n: int>, {BLOCK}"
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def gather(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part_field, object_field, *block_fields = fields

        def told(number: int, arrays):
            for at in range(0, len(arrays[0]), 20_000):
                n = len(arrays[0][at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.nulls(n, object_field.type), *(x.slice(at, n).cast(f.type) for x, f in zip(arrays, block_fields, strict=True))], schema=fields)

        first, seq, part = (segment << 44) | (TaskContext.get().partitionId() << 20), 0, _Part()
        for batch in (b.slice(k, TEXTS_AT_ONCE) for b in batches for k in range(0, b.num_rows, TEXTS_AT_ONCE)):
            texts = [batch.column(i).to_pylist() for i in (1, 2, 3)]
            at = 0
            while at < batch.num_rows:
                start, begun = at, len(part.lengths)
                while at < batch.num_rows and len(part.lengths) < part_objects and part.size < PART_WORDS:
                    part.add(*(t[at] for t in texts))
                    at += 1
                n = at - start
                columns = [batch.column(0), *batch.columns[4:]]
                held = [*(c.slice(start, n) for c in columns), pa.array(np.arange(begun, begun + n, dtype=np.int32)), pa.array(part.lengths[begun:], pa.int32())]
                struct = pa.StructArray.from_arrays([x.cast(f.type) for x, f in zip(held, object_field.type, strict=True)], fields=list(object_field.type))
                yield pa.RecordBatch.from_arrays([pa.array([first + seq] * n, pa.int64()), struct, *(pa.nulls(n, f.type) for f in block_fields)], schema=fields)
                if len(part.lengths) >= part_objects or part.size >= PART_WORDS:
                    yield from told(first + seq, part.blocks() or [[]])
                    part, seq = _Part(), seq + 1
        if part.lengths:
            yield from told(first + seq, part.blocks() or [[]])

    return read.mapInArrow(gather, schema)


@dataclass
class PostingsIndex:
    """The index at `path`; `buckets` are the same for all its segments, and `part_objects` (PART_OBJECTS at most) may change."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    part_objects: int = PART_OBJECTS

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS, part_objects: int = PART_OBJECTS) -> PostingsIndex:
        """A new, empty index (by default in a new folder in the shared one), or the one that is at `path`, with its buckets."""
        out = cls(spark, path or f"{shared_dir(spark)}-postings", buckets, min(part_objects, PART_OBJECTS))
        held = {r.buckets for r in out.manifest()}
        out.buckets = held.pop() if held else buckets
        return out

    def manifest(self) -> list:
        """A row for each batch that counts: batch, segment, objects, words, buckets."""
        if not self._exists(f"{self.path}/manifest"):
            return []
        found = self.spark.read.schema("batch string, segment long, objects long, words long, buckets int").option("recursiveFileLookup", "true").json(f"{self.path}/manifest")
        return sorted(found.collect(), key=lambda r: r.segment)

    def append(self, objects: DataFrame, batch: str) -> bool:
        """Takes a batch in under its name; False if it is known. Objects whose id is known stay as they are."""
        known = self.manifest()
        if any(r.batch == batch for r in known):
            return False
        segment = max((r.segment for r in known), default=-1) + 1
        if any(r.objects for r in known):
            objects = objects.join(self.objects().select("id").distinct(), "id", "left_anti")
        carried = [c for c in CARRIED if c in objects.columns]
        rows = _rows(objects, segment, carried, self.part_objects)
        spread = F.when(F.col("term").isNull(), F.xxhash64("part")).otherwise(F.xxhash64("term", F.pmod("part", F.lit(SPREAD))))
        bucket = F.pmod(spread, F.lit(self.buckets)).cast("int")
        dealt = rows.repartition(self.buckets, bucket).withColumn("kind_of_row", F.when(F.col("term").isNull(), "object").otherwise("block")).withColumn("bucket", bucket)
        folder = f"{self.path}/segment={segment}"
        dealt.sortWithinPartitions("kind_of_row", "bucket", "term", "part").write.mode("overwrite").partitionBy("kind_of_row", "bucket").parquet(folder)
        size = self.spark.read.parquet(folder).where("kind_of_row = 'object'").agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("object.n"), F.lit(0)).alias("words")).first() if self._exists(f"{folder}/kind_of_row=object") else None
        row = (batch, segment, size.objects if size else 0, size.words if size else 0, self.buckets)
        self.spark.createDataFrame([row], "batch string, segment long, objects long, words long, buckets int").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{segment}")
        return True

    def _exists(self, folder: str) -> bool:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(folder)
        return at.getFileSystem(conf).exists(at)

    def _read(self, kind: str, *columns: str) -> DataFrame | None:
        folders = [f"{self.path}/segment={r.segment}/kind_of_row={kind}" for r in self.manifest() if r.objects]
        out = None
        for f in filter(self._exists, folders):
            part = self.spark.read.parquet(f).select(*columns)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def objects(self) -> DataFrame:
        """part, id, the carried columns, place and n (words of the text) of every object."""
        found = self._read("object", "part", "object.*")
        if found is None:
            raise PrerequisiteNotMet("the index is empty")
        return found

    def blocks(self) -> DataFrame:
        """part, bucket, term, postings, n_docs, most, shortest and total of every block."""
        found = self._read("block", "part", "bucket", *[c.split()[0] for c in BLOCK.split(", ")])
        return found if found is not None else self.spark.createDataFrame([], f"part long, bucket int, {BLOCK}")

    def postings(self) -> DataFrame:
        """term, part, place, count (in the text) and marks (1: in the name, 2: in the body) of every posting."""

        def unpack(batches):
            import pyarrow as pa

            for batch in batches:
                places, counts, marks, ends = unpacked(batch.column(2))
                row = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(np.append(0, ends))))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(places.astype(np.int32)), pa.array(counts), pa.array(marks.astype(np.int32))], ["term", "part", "place", "count", "marks"])

        return self.blocks().select("term", "part", "postings").mapInArrow(unpack, "term string, part long, place int, count long, marks int")

    def terms(self) -> DataFrame:
        """A-28: term, df (objects whose text has it), cf (how often), from the heads of the blocks."""
        return self.blocks().groupBy("term").agg(F.sum("n_docs").alias("df"), F.sum("total").alias("cf")).where("df > 0")

    def size(self) -> tuple[int, float]:
        """Objects, and mean words of a text."""
        rows = self.manifest()
        objects = sum(r.objects for r in rows)
        return objects, sum(r.words for r in rows) / objects if objects else 0.0

    def of_words(self, words: DataFrame, number: int) -> DataFrame:
        """The blocks of `number` words (term): only their buckets are read."""
        wanted = sorted({r[0] for r in words.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda i: F.pmod(F.xxhash64("term", i.cast("long")), F.lit(self.buckets)).cast("int")))).distinct().collect()})
        few = F.broadcast(words) if number <= BROADCAST_WORDS else words
        return self.blocks().where(F.col("bucket").isin(wanted)).join(few, "term", "left_semi")


def _blocks_of(questions: DataFrame, tokens) -> Iterator[tuple[list, DataFrame, int]]:
    """The questions in blocks: rows (query_id, terms as (term, times), filters), their distinct words, and how many."""
    every = lambda c, kind: (F.col(c) if c in questions.columns else F.lit(None)).cast(kind).alias(c)
    counted = F.transform(F.array_distinct("t"), lambda w: F.struct(w.alias("term"), F.size(F.filter("t", lambda x: x == w)).alias("times")))
    asked = questions.select("query_id", tokens(F.coalesce(F.col("text"), F.lit(""))).alias("t"), every("kinds", "array<string>"), every("paper_ids", "array<string>"), every("min_confidence", "double"))
    asked = written(asked.select("query_id", counted.alias("terms"), "kinds", "paper_ids", "min_confidence"), "asked")
    n = -(-asked.count() // QUESTIONS)
    for block in range(n):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block)
        words = written(own.select(F.explode("terms.term").alias("term")).distinct(), "words")
        yield own.collect(), words, words.count()


def _by_term(rows: list) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each word the numbers of the questions that have it, and how often they do."""
    out: dict[str, tuple[list, list]] = {}
    for q, r in enumerate(rows):
        for t in r.terms:
            own = out.setdefault(t.term, ([], []))
            own[0].append(q)
            own[1].append(t.times)
    return {t: (np.array(q), np.array(n, np.float64)) for t, (q, n) in out.items()}


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def _halves(table):
    """The objects of a part in the order of their places, and its blocks: word, places, counts, marks."""
    import pyarrow.compute as pc

    own, held = table.filter(pc.is_null(table["term"])).sort_by("place"), table.filter(pc.is_valid(table["term"]))
    places, counts, marks, ends = unpacked(held["postings"]) if held.num_rows else ([],) * 4
    starts = [0, *list(ends)[:-1]]
    return own, [(t, places[a:b], counts[a:b], marks[a:b]) for t, a, b in zip(held["term"].to_pylist(), starts, ends, strict=False)]


def _best(score: np.ndarray, ids: list, limit: int):
    """For each row of a matrix the places of its best positive scores, ties by id (null first), as row and column numbers."""
    rank = np.empty(len(ids), np.int64)
    rank[sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0))] = np.arange(len(ids))
    rows, columns = [], []
    for q, s in enumerate(score):
        least = np.partition(s, len(s) - limit)[len(s) - limit] if len(s) > limit else 0
        found = np.flatnonzero((s >= least) & (s > 0))
        found = found[np.lexsort((rank[found], -s[found]))][:limit]
        rows.append(np.full(len(found), q))
        columns.append(found)
    return np.concatenate(rows), np.concatenate(columns)


def _grouped(index: PostingsIndex, blocks: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Objects and blocks, of all parts or of those in `parts` (part, active), with `active`."""
    objects = index.objects()
    every = objects.unionByName(blocks.select("part", "term", "postings"), allowMissingColumns=True)
    return every.join(parts, "part") if parts is not None else every.withColumn("active", F.lit(None).cast("array<int>"))


def _named(rows: list, found: DataFrame, spark: SparkSession, kind: str) -> DataFrame:
    """Results with the ids of the questions instead of their numbers."""
    names = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(rows)], f"q int, query_id {kind}")
    return found.join(F.broadcast(names), "q").drop("q")


def ranked(scored: DataFrame, limit: int, by: str = "score") -> DataFrame:
    """W-01: the best rows of each question with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _scorer(asked: dict, n: int, limit: int, mean: float, k1: float, b: float):
    """A function that gives the best BM25 scores in a part of those of `n` questions that are active there."""

    def score(table):
        import pyarrow as pa

        own, held = _halves(table)
        active = np.sort(np.array(own["active"][0].as_py() if own.num_rows else [], np.int64))
        row = np.full(n, -1)
        row[active] = np.arange(len(active))
        total, length = np.zeros((len(active), own.num_rows)), own["n"].to_numpy()
        for term, at, counts, _ in held:
            q, w = asked.get(term, (active[:0], None))
            use = row[q] >= 0
            if use.any():
                tf = counts.astype(np.float64)
                total[row[q[use]][:, None], at] += w[use][:, None] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[at] / (mean or 1.0))))
        q, at = _best(_rounded(total), own["id"].to_pylist(), limit) if len(active) else (np.zeros(0, np.int64),) * 2
        return pa.table({"q": pa.array(active[q], pa.int32()), "id": own["id"].take(pa.array(at)), "score": _rounded(total)[q, at] if len(active) else pa.array([], pa.float64())})

    return score


def bm25(index: PostingsIndex, questions: DataFrame, limit: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """R-02 for a table of questions: query_id, id, score and rank of the best objects of each."""
    n_objects, mean = index.size()
    kind, out = questions.schema["query_id"].dataType.simpleString(), None
    id_kind = index.objects().schema["id"].dataType.simpleString()
    for rows, words, n_words in _blocks_of(questions, T.bm25_tokens):
        blocks = index.of_words(words, n_words)
        heads = written(blocks.select("term", "part", "n_docs", "most", "shortest").where("n_docs > 0"), "heads")
        df = {r.term: r.df for r in heads.groupBy("term").agg(F.sum("n_docs").alias("df")).collect()}  # the words of a block of questions
        idf = {t: math.log(1 + (n_objects - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        asked = {t: (q, times * idf[t]) for t, (q, times) in _by_term(rows).items() if t in idf}
        weights = index.spark.createDataFrame([(t, int(i), float(w)) for t, (q, ws) in asked.items() for i, w in zip(q, ws, strict=True)], "term string, q int, weight double")
        part = lambda count, length: F.col(count) * (k1 + 1) / (F.col(count) + k1 * (1 - b + b * F.col(length) / (mean or 1.0)))
        bounds = heads.join(F.broadcast(weights) if n_words <= BROADCAST_WORDS else weights, "term").groupBy("q", "part").agg(F.sum(F.col("weight") * part("most", "shortest")).alias("bound"))
        bounds = written(bounds, "bounds")

        score = _scorer(asked, len(rows), limit, mean, k1, b)

        def scored(of: DataFrame, blocks=blocks, score=score) -> DataFrame:
            parts = of.groupBy("part").agg(F.collect_set("q").alias("active"))  # the questions of a block at most
            return _grouped(index, blocks, parts).groupBy("part").applyInArrow(score, f"q int, id {id_kind}, score double")

        looked = Window.partitionBy("q").orderBy(F.desc("bound"), "part")
        first = written(bounds.withColumn("place", F.row_number().over(looked)).where(F.col("place") <= FIRST).drop("place"), "first")
        found = written(scored(first), "found")
        kth = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("rank") == limit).select("q", F.col("score").alias("kth"))
        # a bound is compared with room for rounding
        rest = bounds.join(first.select("q", "part"), ["q", "part"], "left_anti").join(F.broadcast(kth), "q", "left").where("kth IS NULL OR bound >= kth - 0.00001")
        found = _named(rows, found.unionByName(scored(written(rest, "rest"))), index.spark, kind)
        out = found if out is None else out.unionByName(found)
    return ranked(out, limit) if out is not None else _nothing(index, kind, "score double, rank int")


def _nothing(index: PostingsIndex, kind: str, more: str) -> DataFrame:
    return index.spark.createDataFrame([], f"query_id {kind}, id {index.objects().schema['id'].dataType.simpleString()}, {more}")


#: Weights of the lexical signals, in the order in which they are added up.
LEXICAL = (1.0, 0.8, 0.6, 0.4)


def _matcher(rows: list, carried: list[str], limit: int, lexical: bool):
    """A function that gives each question's best objects of a part, by lexical score or by matching words of the body.

    Scores are held for QUESTIONS_AT_ONCE questions at a time, so a task's memory doesn't grow with all questions.
    """
    blocks = [(at, _by_term(rows[at : at + QUESTIONS_AT_ONCE]), [len(r.terms) for r in rows[at : at + QUESTIONS_AT_ONCE]]) for at in range(0, len(rows), QUESTIONS_AT_ONCE)]
    filters = [(r.kinds, r.paper_ids, r.min_confidence) for r in rows]

    def match(table):
        import pyarrow as pa

        own, held = _halves(table)
        ids = own["id"].to_pylist()

        def best(first: int, asked: dict, sizes: np.ndarray):
            names, bodies = (np.zeros((len(sizes), own.num_rows), np.int32) for _ in range(2))
            for term, at, _, marks in held:
                if term in asked:
                    q = asked[term][0]
                    names[q[:, None], at] += marks & 1
                    bodies[q[:, None], at] += marks >> 1
            if lexical:
                column = lambda c: own[c].to_numpy(zero_copy_only=False).astype(np.float64)
                share = np.maximum(sizes, 1)[:, None]
                parts = (names / share, bodies / share, column("confidence")[None], np.minimum(column("n_evidence") / 3, 1.0)[None])
                score = _rounded(np.minimum(sum(v * w for v, w in zip(parts, LEXICAL, strict=True)) / sum(LEXICAL), 1.0))
                for q, (kinds, papers, least) in enumerate(filters[first : first + len(sizes)]):
                    for allowed, c in ((kinds, "kind"), (papers, "paper_id")):
                        if allowed:
                            score[q, ~np.isin(np.array(own[c].to_pylist(), object), allowed)] = 0
                    if least is not None:
                        score[q, column("confidence") < least] = 0
            else:
                score = bodies.astype(np.float64)
            q, at = _best(score, ids, limit) if own.num_rows else (np.zeros(0, np.int64),) * 2
            numbers = {"score": score[q, at], "in_name": pa.array(names[q, at], pa.int32()), "in_body": pa.array(bodies[q, at], pa.int32()), "n_terms": pa.array(sizes[q], pa.int32())}
            return pa.table({"q": pa.array(first + q, pa.int32()), **{c: own[c].take(pa.array(at)) for c in ["id", *carried]}, **numbers})

        return pa.concat_tables([best(first, asked, np.array(sizes, np.int64)) for first, asked, sizes in blocks])

    return match


def _matched(index: PostingsIndex, questions: DataFrame, limit: int, lexical: bool) -> DataFrame | None:
    """The best objects of each question by lexical score, or else by the number of matching words of the body, with these numbers."""
    kind, out = questions.schema["query_id"].dataType.simpleString(), None
    id_kind = index.objects().schema["id"].dataType.simpleString()
    for rows, words, n_words in _blocks_of(questions, T.tokens):
        objects = index.objects()
        carried = [c for c in CARRIED if c in objects.columns]
        own = ", ".join(f"{c} {objects.schema[c].dataType.simpleString()}" for c in carried)
        schema = f"q int, id {id_kind}, {own}, score double, in_name int, in_body int, n_terms int"
        match = _matcher(rows, carried, limit, lexical)
        found = _grouped(index, index.of_words(words, n_words)).groupBy("part").applyInArrow(match, schema)
        found = _named(rows, found, index.spark, kind)
        out = found if out is None else out.unionByName(found)
    return ranked(out, limit) if out is not None else None


def lexical(index: PostingsIndex, questions: DataFrame, limit: int = 10) -> DataFrame:
    """R-01 for a table of questions: query_id, id, score, rank, the carried columns, and how many words match where."""
    found = _matched(index, questions, limit, True)
    return found if found is not None else _nothing(index, questions.schema["query_id"].dataType.simpleString(), "score double, rank int")


def cross_paper(index: PostingsIndex, questions: DataFrame, limit: int = 10) -> DataFrame:
    """R-09 for a table of questions: five times as many lexical results, scored again with the agreement of papers on a name."""
    wide = written(lexical(index, questions, 5 * limit), "wide")
    papers = wide.groupBy("query_id", "name_key").agg(F.countDistinct("paper_id").alias("n_papers"))
    key = F.col("w.name_key").eqNullSafe(F.col("p.name_key")) & F.col("w.query_id").eqNullSafe(F.col("p.query_id"))
    both = wide.alias("w").join(papers.alias("p"), key).select("w.*", "n_papers")
    return ranked(both.withColumn("score", weighted_score({**_signals(), "agreement": (F.least(F.col("n_papers") / 3, F.lit(1.0)), 0.9)})).drop("rank"), limit)


def _signals() -> dict[str, tuple[Column, float]]:
    share = lambda c: F.col(c) / F.greatest("n_terms", F.lit(1))
    parts = (share("in_name"), share("in_body"), F.col("confidence"), F.least(F.col("n_evidence") / 3, F.lit(1.0)))
    return dict(zip(("name_match", "text_match", "validation_confidence", "evidence_density"), zip(parts, LEXICAL, strict=True), strict=True))


def evidence_search(index: PostingsIndex, questions: DataFrame, limit: int = 10) -> DataFrame:
    """R-07 for a table of questions, over an index whose bodies are quotes: the 4 * limit with the most matching words, then quote overlap and precision of the place."""
    wide = _matched(index, questions, 4 * limit, False)
    if wide is None:
        return _nothing(index, questions.schema["query_id"].dataType.simpleString(), "score double, rank int")
    precision = F.coalesce(F.col("precision"), F.lit(0)) if "precision" in wide.columns else F.lit(0)  # unknown places count as none
    score = weighted_score({"quote": (F.col("in_body") / F.greatest("n_terms", F.lit(1)), 0.8), "precision": (F.least(precision / 4, F.lit(1.0)), 0.5)})
    return ranked(wide.withColumn("matched", F.col("in_body").cast("long")).withColumn("score", score).where("score > 0").drop("rank"), limit)
