"""Operator 6, MinHash near-dedup: bottom-k sketches from one hash function.

1. Each text becomes the set of its distinct 5-word shingles, 64-bit hashes; the K smallest are its sketch.
2. Equal sets are collapsed to one representative each, so copies never meet as pairs; its id is its smallest doc_id,
   or a hash of the set where that is missing or another set has it too.
3. Inverted lists: a document is listed under its rarest retained values only, as many as two linked documents can't
   all miss. Linked documents (Jaccard 0.75 or more) share about three quarters of their retained values, and at least
   half of them but for a chance of about one in a million; so half of the values and one more, in one order common to
   all documents, are enough. Passages that very many documents share come last in that order.
4. Overlaps come from the lists without making all pairs of one: each list sends its members to a leader, links are
   verified, components formed, and only members that are still in another component than the largest of their list
   go on. For documents of the lists that are still open at the end, lists are made anew from whole sets, where the
   rarest quarter is an exact prefix, and who is left is compared with every member of its list that is in another
   component, if the places of the first shared value leave room for enough overlap. That last test is exact too, and
   drops copies that differ too much before they become pairs.
5. The union of two sketches estimates the Jaccard value; pairs that can't reach the threshold go.
6. The exact Jaccard value of the whole sets decides.

Cases: null, empty and white-space texts have no shingles, are linked with nothing and keep themselves; fewer than
five words make one shingle; repeated rows, ties and equal texts are one component under the smallest doc_id; very long
texts are hashed in segments and their sets are whole; rows without doc_id are linked like others, and a component of
such rows only is null; an empty table gives an empty result; extra columns are not read. `without_copies` keeps one row
of each component, also where rows repeat an id or have none, and every row without words.

Hot values: a list value or a node with more than a thousandth of all rows is joined by broadcast (fewer than a thousand
such rows exist), so no task gathers the documents that hold a common passage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import ByteWords, bounded_batches, gathered, list_array, mix, read_table, row_key, shingle_hashes, slices, split_join, utf8, white_space, without_rows, written
from quarryline.llm.components import connected

WIDTH, K = 5, 64
#: Links have 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
#: Ids of documents that are verified are broadcast up to this number (8 bytes each); beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Rows with a sketch, and rows with whole sets, that a task works on at most, if their number is known beforehand.
TASK_SKETCHES, TASK_SETS = 1 << 14, 1 << 12


def shingle_set(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingles of a text's words, as signed 64-bit numbers; a short text is one shingle."""
    if len(words) == 0:
        return np.zeros(0, np.int64)
    if len(words) < width:
        h = shingle_hashes(words, len(words))
        return mix(h + np.uint64(len(words))).view(np.int64)
    return np.unique(shingle_hashes(words, width).view(np.int64))


def text_sets(batch_column, width: int):
    """The shingle set of each text of an Arrow column."""
    data, offsets = utf8(batch_column)
    words, _, _, first = ByteWords(white_space()).hashes(data, offsets)
    for i in range(len(offsets) - 1):
        yield shingle_set(words[first[i] : first[i + 1]], width)


def sketches(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """doc_id, h (hash of the text), n (size of the set), s1 and s2 (a signature of the whole set), sketch (its k smallest hashes)."""

    def sketch(batches):
        import pyarrow as pa

        for batch in (part for b in batches for part in slices(b, 1)):
            n, s1, s2, kept = [], [], [], []
            for s in text_sets(batch.column(1), width):
                u = s.view(np.uint64)
                n.append(len(s))
                s1.append(u.sum(dtype=np.uint64))
                s2.append(mix(u).sum(dtype=np.uint64))
                kept.append(s[:k])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in kept])])
            flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), list_array(flat, offsets)], ["doc_id", "h", "n", "s1", "s2", "sketch"])

    return bounded_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key().alias("h"))).mapInArrow(sketch, "doc_id long, h long, n long, s1 long, s2 long, sketch array<bigint>")


#: What tells sets apart: their size and two sums of their hashes.
SET = ["n", "s1", "s2"]


def whole_sets(docs: DataFrame, rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """id and the whole set, for one document of each set in `rows` (id, doc_id, h)."""

    def sets(batches):
        import pyarrow as pa

        for part in (part for b in batches for part in slices(b, 1)):
            found = list(text_sets(part.column(1), width))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            yield pa.RecordBatch.from_arrays([part.column(0), list_array(np.concatenate(found), offsets)], ["id", "items"])

    rows = rows.select(F.col("id").alias("of_set"), F.col("doc_id").alias("of_doc"), F.col("h").alias("of_text"))
    if rows.count() <= BROADCAST_IDS:
        rows = F.broadcast(rows)
    own = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text"))
    texts = own.join(rows, F.col("d").eqNullSafe(F.col("of_doc")) & (row_key() == F.col("of_text"))).select(F.col("of_set").alias("id"), "text")
    # a row that stands twice gives its set twice
    return bounded_batches(texts).mapInArrow(sets, "id long, items array<bigint>")


def _sizes_fit(n1, n2, threshold: int):
    return (100 * F.least(n1, n2)) >= threshold * F.greatest(n1, n2)


def prefixes(values: DataFrame, share_floor, most: int) -> DataFrame:
    """Lists (v, id, n, place) of each document's rarest values, from at most `most` rows (v, id, n, s); s: how many values the document has.

    `share_floor` maps s to the least number of values that a linked document shares; a document is listed under its
    s - share_floor + 1 rarest values. Values that one document has alone come first and are never listed.
    """
    often = written(gathered(values.groupBy("v").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1"), most), "often")
    total = often.agg(F.sum("freq")).first()[0] or 0
    listed = split_join(values, often.withColumn("held", F.col("freq")), "v", total)
    mine = Window.partitionBy("id")
    place = F.col("s") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("freq", "v"))
    kept = listed.select("v", "id", "n", "s", place.alias("place")).where(F.col("place") <= F.col("s") - share_floor(F.col("s")) + 1)
    return gathered(kept.select("v", "id", "n", "place"), total)


class _Linker:
    """Verifies pairs of documents and keeps the components that the links found so far give."""

    def __init__(self, reps: DataFrame, sets: DataFrame, k: int, threshold: int):
        self.reps, self.sets, self.k, self.threshold = reps, sets, k, threshold
        self.tested: DataFrame | None = None
        self.components: DataFrame | None = None
        self.nodes = 0

    def test(self, pairs: DataFrame, most: int | None = None) -> None:
        """Adds the links among `pairs` (a, b; at most `most`, if known), each pair once."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = written(pairs if most is None else gathered(pairs, most), "pairs")
        n = pairs.count()
        r = self.reps.select("id", "n", "sketch")
        both = pairs.join(r.toDF("a", "na", "ka"), "a").join(r.toDF("b", "nb", "kb"), "b")
        # the k smallest of the union; if both sketches are whole sets, this is the union itself
        union = F.slice(F.array_sort(F.array_union("ka", "kb")), 1, self.k)
        shared = F.size(F.array_intersect(F.array_intersect("ka", "kb"), union))
        whole = (F.col("na") <= self.k) & (F.col("nb") <= self.k) & (F.size(F.array_union("ka", "kb")) <= self.k)
        floor = F.when(whole, F.lit(self.threshold)).otherwise(F.lit(self.threshold - 25))
        both = both.where(_sizes_fit(F.col("na"), F.col("nb"), self.threshold)).where(100 * shared >= floor * F.size(union))
        near = written(gathered(both.select("a", "b", "na", "nb"), n, TASK_SKETCHES), "near")
        s = self.sets.join(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
        exact = near.join(s.toDF("a", "ia"), "a").join(s.toDF("b", "ib"), "b")
        common = F.size(F.array_intersect("ia", "ib"))
        exact = exact.where(100 * common >= self.threshold * (F.col("na") + F.col("nb") - common)).select("a", "b")
        found = written(gathered(exact, near.count(), TASK_SETS), "links")
        self.tested = pairs if self.tested is None else self.tested.unionAll(pairs)
        new = found.count()
        if new or self.components is None:
            # the links so far count as their stars
            edges = found if self.components is None else found.unionAll(self.components.where("node <> component").toDF("a", "b"))
            self.components = connected(edges, rows=self.nodes + new)
            self.nodes = self.components.count()

    def placed(self, lists: DataFrame, total: int) -> DataFrame:
        """The lists, of at most `total` rows, with each member's component, without lists that lie in one component; `major`: the list's largest component."""
        comps = self.components.withColumnRenamed("node", "id")
        now = written(gathered(lists.join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), total), "placed")
        sizes = now.groupBy("v", "comp").agg(F.count(F.lit(1)).alias("c"))
        major = sizes.groupBy("v").agg(F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("c").alias("held")).where("comps > 1").select("v", F.col("top.comp").alias("major"), "held")
        return written(gathered(split_join(now, written(gathered(major, total), "major"), "v", total), total), "open")


def led(rows: DataFrame, order, total: int) -> DataFrame:
    """The rows of lists with `lead`, the least of `order` in their list."""
    leaders = written(gathered(rows.groupBy("v").agg(F.min(order).alias("lead"), F.count(F.lit(1)).alias("held")), total), "leaders")
    return split_join(rows, leaders, "v", total)


def components_of(docs: DataFrame, reps: DataFrame, most: int, width: int, k: int, threshold: int) -> DataFrame:
    """The components (node, component) of `reps` (id, n, sketch), at most `most` rows."""
    values = reps.select("id", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    lists = written(prefixes(values, lambda s: F.ceil(s / 2), k * most), "lists")
    total = lists.count()
    listed = lists.select("id").distinct()
    sets = whole_sets(docs, reps.join(listed, "id", "left_semi"), width).dropDuplicates(["id"])
    sets = written(gathered(sets, most, TASK_SETS), "sets")
    linker = _Linker(reps, sets, k, threshold)
    with_lead = led(lists, F.struct("id", "n"), total)
    linker.test(with_lead.where(_sizes_fit(F.col("n"), F.col("lead.n"), threshold)).select(F.col("lead.id").alias("a"), F.col("id").alias("b")), total)
    open_lists = linker.placed(lists, total)
    for round_ in range(2):  # other leaders, of the largest component of each list
        total = open_lists.count()
        if not total:
            return linker.components
        order = F.struct(F.xxhash64("v", "id", F.lit(round_)).alias("h"), "id", "n")
        leaders = open_lists.groupBy("v").agg(F.min(F.when(F.col("comp") == F.col("major"), order)).alias("lead"), F.count(F.lit(1)).alias("held"))
        leaders = written(gathered(leaders, total), "leaders")
        rest = split_join(open_lists.where("comp <> major"), leaders, "v", total).where(_sizes_fit(F.col("n"), F.col("lead.n"), threshold))
        linker.test(rest.select(F.col("lead.id").alias("a"), F.col("id").alias("b")), total)
        open_lists = linker.placed(open_lists.select("v", "id", "n", "place"), total)
    again = open_lists.select("id", "n").distinct()
    from_sets = again.join(sets, "id").select("id", "n", F.col("n").alias("s"), F.explode("items").alias("v"))
    finer = written(prefixes(from_sets, lambda s: F.ceil(s * threshold / 100), again.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), "finer")
    finer = linker.placed(finer, finer.count())
    rest = finer.where("comp <> major").select("v", F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("comp").alias("ca"))
    every = finer.select("v", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("comp").alias("cb"))
    # where the first shared value stands, the rest of both sets must still be enough for the overlap that a link needs
    needed = F.ceil(F.lit(threshold) * (F.col("na") + F.col("nb")) / (100 + threshold))
    enough = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= needed
    cross = rest.join(every, "v").where((F.col("ca") != F.col("cb")) & _sizes_fit(F.col("na"), F.col("nb"), threshold) & enough)
    linker.test(cross.select("a", "b"))
    return linker.components


def representatives(sketched: DataFrame, most: int) -> DataFrame:
    """One row per set of at most `most` rows: id (unique), doc_id and h of one of its rows, held (how many it has), sketch, and what tells it apart."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h"))
    reps = sketched.where("n > 0").groupBy(*SET).agg(first.alias("row"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("held"))
    reps = written(gathered(reps.select(*SET, "sketch", "held", "row.doc_id", "row.h"), most, TASK_SKETCHES), "reps")
    shared = reps.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.struct("doc_id").alias("shared"))
    shared = written(gathered(shared, most), "shared")
    if shared.isEmpty():
        return reps.withColumn("id", F.col("doc_id"))
    found = reps.join(shared, F.col("doc_id").eqNullSafe(F.col("shared.doc_id")), "left")
    return written(found.withColumn("id", F.when(F.col("shared").isNotNull(), F.xxhash64(*SET)).otherwise(F.col("doc_id"))).drop("shared"), "reps")


def members(docs: DataFrame, width: int = WIDTH, k: int = K, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, h, n and comp of every row: `comp` stands for the row's component, null without words."""
    sketched = written(sketches(docs, width, k), "sketches")
    rows = sketched.count()
    reps = representatives(sketched, rows)
    found = components_of(docs, reps, rows, width, k, threshold).withColumnRenamed("node", "id")
    placed = reps.select("id", "held", *SET).join(found, "id", "left").select(*SET, "held", F.coalesce("component", "id").alias("comp"))
    placed = written(gathered(placed, rows), "placed")
    own = sketched.select("doc_id", "h", *SET)
    linked = split_join(own.where("n > 0"), placed, SET, rows).select("doc_id", "h", "n", "comp")
    return gathered(linked.unionByName(own.where("n = 0").select("doc_id", "h", "n", F.lit(None).cast("long").alias("comp"))), rows)


def near_components(docs: DataFrame, width: int = WIDTH, k: int = K, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = written(members(docs, width, k, threshold), "members")
    total = rows.count()
    least = rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("held"))
    least = written(gathered(least, total), "least")
    linked = split_join(rows.where("comp IS NOT NULL"), least, "comp", total).select("doc_id", "n", F.col("least").alias("component"))
    out = linked.unionByName(rows.where("comp IS NULL").select("doc_id", "n", F.col("doc_id").alias("component")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("component").eqNullSafe(F.col("doc_id")).alias("kept"))


def without_copies(docs: DataFrame, width: int = WIDTH, k: int = K, threshold: int = THRESHOLD) -> DataFrame:
    """`docs` with one row of each component: that with the smallest id, of several such rows that with the smallest text hash."""
    rows = written(members(docs, width, k, threshold).where("comp IS NOT NULL"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    total = rows.count()
    keys = written(gathered(rows.groupBy("comp", "doc_id", "h").agg(F.count(F.lit(1)).alias("times")), total), "keys")
    best = written(gathered(keys.groupBy("comp").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("held")), total), "best")
    judged = split_join(keys, best, "comp", total).withColumn("stays", F.col("best").eqNullSafe(order))
    return without_rows(docs, judged.where("NOT stays"), judged.where("stays AND times > 1"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_shingles, component_id, kept."""
    return near_components(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w
), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, md5(unnest(sh)) AS v FROM s),
f AS (SELECT v FROM e GROUP BY v HAVING count(*) > 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN f USING (v) JOIN e y USING (v) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n_shingles + nb.n_shingles - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m USING (doc_id)
"""
