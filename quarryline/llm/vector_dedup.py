"""Operator 12, embedding near-dedup: sorted projection passes.

1. Equal vectors of a label are collapsed to one representative that stands for their number.
2. A pass draws 64 random hyperplanes and orders the representatives of a label by the concatenated signs. Each is
   compared with the WINDOW before it in that order, in blocks of a matrix product as the sorted rows stream by; the
   windows across the borders of partitions are made from the outer rows of each partition.
3. Vectors at the threshold agree in a sign with probability 1 - angle / pi, and stand in one window if they agree in
   the first bits, of which there are as many as leave WINDOW vectors to a value. The number of passes follows from that
   and the size of the largest label, so that a pair is missed by all passes with probability MISSED at most.
4. Of the verified pairs, a pass writes those that are needed to connect what the windows connect (a pair goes if both
   ends are linked with the vector that stands between them), so a dense group gives about one row per vector. The pairs
   of all passes are united into components.
5. A link never leaves a component, so the windows' bound is lifted there: within each component all cosines are taken,
   block against block, and counted. A vector's number of links is exact if its component is whole, however dense it is;
   only counts leave a task, and a large component is dealt out over pairs of blocks.

Cases: labels must be equal and not null; vectors that are null, empty, zero or hold null, NaN or infinite components are
linked with nothing, and vectors of different lengths aren't linked with each other. Vectors are scaled by a power of
two, so very large and very small components neither overflow nor vanish. Rows that repeat a vec_id are vectors of their
own and count as links of each other if they're near; a component of rows without vec_id has none (null), and such a row
is kept only there. An empty table gives an empty result. Extra columns are not read, so their names can't clash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import bounded_batches, read_table, split_join, written
from quarryline.llm.components import connected
from quarryline.llm.vector_codes import finite

#: Vectors are linked from this cosine on.
LEAST = 0.98
#: Neighbours that a vector is compared with on either side, and the chance that all passes miss a pair at LEAST.
WINDOW, MISSED = 64, 1e-4
#: Rows compared at once, and rows of a sorted partition, about.
CHUNK, PARTITION_ROWS = 512, 500_000
#: Vectors in a block of a component: between these, by the number of linked vectors for each shuffle partition.
BLOCKS = (64, 4096)


def passes_for(n: int, least: float = LEAST, window: int = WINDOW, missed: float = MISSED) -> int:
    """How many passes find a pair at `least` among `n` vectors with a probability of 1 - `missed`, but eight at least."""
    bits = max(0, math.ceil(math.log2(max(1, n) / window)))
    together = (1 - math.acos(least) / math.pi) ** bits
    return max(8, 1 if together >= 1 else math.ceil(math.log(missed) / math.log1p(-together)))


def vectors_of(rows: DataFrame) -> DataFrame:
    """key (label and length; null if the row is linked with nothing), vec_id and v (scaled by a power of two) of every row."""
    v = F.col("embedding").cast("array<double>")
    usable = finite(v) & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull()
    key = F.when(usable, F.concat_ws(":", F.size(v), F.col("label").cast("string")))

    def scale(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            ends, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(ends) - ends
            most = np.maximum.reduceat(np.abs(flat), starts) if len(flat) else flat
            flat = np.ldexp(flat, -np.repeat(np.frexp(most)[1], ends)) + 0.0  # minus zero is zero
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)).astype(np.int32)), pa.array(flat)), batch.column(2)], ["key", "v", "vec_id"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    out = rows.select(key.alias("key"), v.alias("v"), "vec_id")
    scaled = bounded_batches(out.where("key IS NOT NULL")).mapInArrow(scale, f"key string, v array<double>, vec_id {kind}")
    return scaled.unionByName(out.where("key IS NULL"))


def _matrix(column) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def runs(batch, columns: int):
    """Slices of a sorted batch whose first `columns` columns are equal."""
    import pyarrow.compute as pc

    if batch.num_rows:
        new = np.zeros(batch.num_rows, bool)
        for c in batch.columns[:columns]:
            if batch.num_rows > 1:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / np.outer(np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1)))


def linked_in_order(ids: np.ndarray, x: np.ndarray, new: int, window: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids that connect what links each row from `new` on with the `window` rows before it."""
    a, b = [], []
    for at in range(new, len(ids), CHUNK):
        upto, low = min(len(ids), at + CHUNK), max(0, at - window)
        near = cosines(x[low:upto], x[low:upto]) >= least
        i, j = np.nonzero(near[at - low :])
        i += at - low
        inside = (j < i) & (i - j <= window)
        i, j = i[inside], j[inside]
        # of two links of a row that follow each other, the farther one goes if their other ends are linked themselves
        spare = np.zeros(len(i), bool)
        spare[:-1] = (i[:-1] == i[1:]) & near[j[1:], j[:-1]]
        a.append(ids[low + i[~spare]])
        b.append(ids[low + j[~spare]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _signed(reps: DataFrame, number: int) -> DataFrame:
    """reps with `sig`, the signs on 64 hyperplanes that the number of the pass gives, as a number that sorts like them."""

    def sign(batches):
        import pyarrow as pa

        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            column, sig = batch.column(1), np.zeros(batch.num_rows, np.uint64)
            sizes = np.diff(column.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                if size not in planes:
                    planes[size] = np.random.default_rng([number, size]).standard_normal((size, 64))
                bits = (_matrix(column.take(pa.array(own))) @ planes[size]) >= 0
                sig[own] = np.packbits(bits, axis=1).view(">u8")[:, 0]
            order = (sig ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(order), batch.column(2), column], ["key", "sig", "id", "v"])

    return bounded_batches(reps.select("key", "v", "id")).mapInArrow(sign, "key string, sig long, id long, v array<double>")


def one_pass(reps: DataFrame, number: int, partitions: int, window: int = WINDOW, least: float = LEAST) -> DataFrame:
    """Pairs (a, b) that connect the vectors linked within a window of the order of this pass."""
    fields = "a long, b long, p int, place long, total long, key string, id long, v array<double>"

    def sweep(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        seen, head, tail, ids, x, key = 0, [], [], np.zeros(0, np.int64), None, None
        for batch in batches:
            for run in runs(batch, 1):
                now, own, m = run.column(0)[0].as_py(), run.column(1).to_numpy(), _matrix(run.column(2))
                old = 0 if now != key else len(ids)
                ids, x, key = (np.concatenate([ids, own]), np.concatenate([x, m]), key) if old else (own, m, now)
                a, b = linked_in_order(ids, x, old, window, least)
                if len(a):
                    none = pa.nulls(len(a))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[none.cast(t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64()))]], ["a", "b", "p", "place", "total", "key", "id", "v"])
                ids, x = ids[-window:], x[-window:]
            # the first and the last rows of the partition meet those of the partitions beside it
            places = np.arange(seen, seen + batch.num_rows)
            placed = pa.Table.from_arrays([pa.array(places), *batch.columns], ["place", "key", "id", "v"])
            if seen < window:
                head.append(placed.slice(0, window - seen))
            kept = max(0, window - seen)
            tail.append(placed.slice(min(kept, placed.num_rows)))
            seen += batch.num_rows
            while len(tail) > 1 and sum(t.num_rows for t in tail[1:]) >= window:
                tail.pop(0)
        edge = pa.concat_tables([*head, *tail]) if head else None
        if edge is not None and seen:
            edge = edge.filter(pa.array((edge["place"].to_numpy() < window) | (edge["place"].to_numpy() >= seen - window)))
            n, p = edge.num_rows, TaskContext.get().partitionId()
            whole = pa.Table.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([p] * n, pa.int32()), edge["place"], pa.array([seen] * n, pa.int64()), edge["key"], edge["id"], edge["v"]], ["a", "b", "p", "place", "total", "key", "id", "v"])
            yield from whole.to_batches()

    order = ["key", "sig", "id"]
    dealt = _signed(reps, number).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    found = written(bounded_batches(dealt.select("key", "id", "v")).mapInArrow(sweep, fields), "pass")
    pairs, edges = found.where("a IS NOT NULL").select("a", "b"), found.where("p IS NOT NULL")
    sizes = edges.groupBy("p").agg(F.max("total").alias("total")).orderBy("p").collect()  # a row for each partition
    if len(sizes) < 2:
        return pairs
    numbers = np.array([r.p for r in sizes])
    first = np.concatenate([[0], np.cumsum([r.total for r in sizes])])  # rank of each partition's first row

    def beside(batches):
        import pyarrow as pa

        for batch in batches:
            rank = first[np.searchsorted(numbers, batch.column(0).to_numpy())] + batch.column(1).to_numpy()
            # the borders that have this row among their `window` rows on either side
            low = np.searchsorted(first[1:-1], rank - window, "right")
            high = np.searchsorted(first[1:-1], rank + window, "right")
            times = np.maximum(high - low, 0)
            row = np.repeat(np.arange(batch.num_rows), times)
            border = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(border), pa.array(rank[row]), *[c.take(take) for c in batch.columns[2:]]], ["border", "rank", "key", "id", "v"])

    def across(table):
        import pyarrow as pa

        table = table.sort_by("rank").combine_chunks()
        out = [linked_in_order(run.column(1).to_numpy(), _matrix(run.column(2)), 0, window, least) for batch in table.select(["key", "id", "v"]).to_batches() for run in runs(batch, 1)]
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *[a for a, _ in out]]), "b": np.concatenate([none, *[b for _, b in out]])})

    met = edges.select("p", "place", "key", "id", "v").mapInArrow(beside, "border long, rank long, key string, id long, v array<double>")
    return pairs.unionByName(met.groupBy("border").applyInArrow(across, "a long, b long"))


def link_counts(reps: DataFrame, comps: DataFrame, least: float = LEAST) -> DataFrame:
    """id and linked (vectors that it is linked with, not counting those equal to it) of every representative in `comps` (id, component)."""
    sizes = written(comps.groupBy("component").agg(F.count(F.lit(1)).alias("held")).withColumn("size", F.col("held")), "sizes")
    total = comps.count()
    spread = int(comps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = min(max(BLOCKS[0], total // (2 * spread)), BLOCKS[1])
    blocks = F.ceil(F.col("size") / block)
    own = split_join(comps, sizes, "component", total).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id")
    rows = dealt.join(reps.select("id", F.col("held").alias("w"), "v"), "id").select("component", "i", "j", "block", "id", "w", "v")

    def count(batches):
        import pyarrow as pa

        def counted(held):
            block, ids, w = (np.concatenate([r.column(c).to_numpy() for r in held]) for c in (3, 4, 5))
            x, i, j = np.concatenate([_matrix(r.column(6)) for r in held]), held[0].column(1)[0].as_py(), held[0].column(2)[0].as_py()
            if i == j:
                near = cosines(x, x) >= least
                np.fill_diagonal(near, False)
                return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ w)], ["id", "linked"])
            left = block == i
            near = cosines(x[left], x[~left]) >= least
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[left], ids[~left]])), pa.array(np.concatenate([near @ w[~left], near.T @ w[left]]))], ["id", "linked"])

        held, now = [], None
        for batch in batches:
            for run in runs(batch, 3):
                key = tuple(run.column(c)[0].as_py() for c in range(3))
                if held and key != now:
                    yield counted(held)
                    held = []
                now = key
                held.append(run)
        if held:
            yield counted(held)

    order = ["component", "i", "j"]
    sorted_ = written(rows, "blocks").repartitionByRange(spread, *order).sortWithinPartitions(*order)
    return bounded_batches(sorted_).mapInArrow(count, "id long, linked long").groupBy("id").agg(F.sum("linked").alias("linked"))


def linked(rows: DataFrame, least: float = LEAST, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row (vec_id, embedding, label)."""
    spark = rows.sparkSession
    own = written(vectors_of(rows), "vectors")
    same = own.where("key IS NOT NULL").groupBy("key", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("held"))
    reps = written(same.withColumn("id", F.monotonically_increasing_id()), "reps")
    n = reps.count()
    largest = reps.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    partitions = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (8 * window)), n // PARTITION_ROWS)
    links = None
    for number in range(passes_for(largest, least, window)) if n else ():
        found = one_pass(reps, number, partitions, window, least)
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
    comps = written(connected(links).select(F.col("node").alias("id"), "component"), "components")
    counts = written(link_counts(reps, comps, least), "counts")
    placed = reps.join(comps, "id", "left").join(counts, "id", "left")
    placed = written(placed.select("key", "v", "held", "least", F.coalesce("component", "id").alias("component"), (F.col("held") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "placed")
    lowest = written(placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("held")), "lowest")
    per_vector = written(split_join(placed.drop("least").withColumnRenamed("held", "rows"), lowest, "component", n).select("key", "v", "n_links", "component_id", F.col("rows").alias("held")), "per_vector")
    usable = split_join(own.where("key IS NOT NULL"), per_vector, ["key", "v"], own.count()).select("vec_id", "n_links", "component_id")
    out = usable.unionByName(own.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of `embeddings`: vec_id, n_links, component_id, kept."""
    return linked(read_table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.98),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)
"""
