"""Operator 11, vector code compression: product codes from Lloyd rounds that are maintained by differences.

A vector's components become integers, floor(1024 * x); it is cut into 4 consecutive parts, and each part position has a
codebook of up to 256 entries. The state is a written table with the assignments of every vector, and a written table of
running sums: a count and a componentwise sum for each part and entry. A round reads the state, assigns anew, and writes
the next state; of the vectors only the parts whose assignment changed are read again, and only their contributions
(minus for the entry left, plus for the entry taken up) are added up in each task, shuffled and merged into the running
sums. So a late round, in which little moves, shuffles little. Everything is exact integer arithmetic, so neither the
order of rows nor a task that is run again changes a result.

The codebooks and sums have 4 * 256 rows at most, whatever the data; only these come to the driver and go to the tasks.

Cases: rows whose vector is null or holds null, NaN or infinite components are dropped. Components beyond 16384 in
magnitude count as 16384, so that no distance leaves 64 bits. Vectors that are shorter than the longest one, and a
longest one whose length 4 doesn't divide, are filled up with zeros; an empty vector is all zeros. Rows that repeat a
vec_id are vectors of their own, in the order of their components where the order of ids matters; a null vec_id comes
last. With fewer than 256 vectors there are as many entries as vectors; an empty table gives an empty result. Equal
distances fall to the lower index. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import bounded_batches, read_table, split_join, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: The largest magnitude of an integer component.
LARGEST = 1 << 24
#: Vectors whose distances to all entries are held together.
ROWS_AT_ONCE = 2048


def finite(vector):
    """True for vectors that are not null and hold finite components only."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def integers(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label and x (the integer components, all of the same number) of the rows that are kept, and the width of a part."""
    v = F.col("embedding").cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    rows = vectors.where(finite(v)).select("vec_id", "label", whole.alias("x"))
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-longest // PARTS))
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0), F.lit(PARTS * width) - F.size("x")))), width


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of the nearest entry (the lower one of equals) and its squared distance, exactly."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    # sums of products below 2**53 are exact as doubles, in whatever order they are added
    kind = np.float64 if x.shape[1] * (2 * largest) ** 2 < 1 << 53 else np.int64
    b, index, distance = book.astype(kind), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    own = (b * b).sum(1)
    for at in range(0, len(x), ROWS_AT_ONCE):
        part = x[at : at + ROWS_AT_ONCE].astype(kind)
        all_ = (part * part).sum(1)[:, None] - 2 * (part @ b.T) + own
        best = all_.argmin(1)
        index[at : at + len(part)] = best
        distance[at : at + len(part)] = all_[np.arange(len(part)), best].astype(np.int64)
    return index, distance


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, PARTS, width)


def assigned(state: DataFrame, books: np.ndarray) -> DataFrame:
    """The rows of a state (vec_id, label, x, code) with the new `code`, the old one as `before`, and `error`."""
    width = books.shape[2]

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column(2), width)
            found = [nearest(x[:, p], books[p]) for p in range(PARTS)]
            code = np.stack([i for i, _ in found], 1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0, dtype=np.int64)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PARTS), len(x), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], raw, batch.column(3), pa.array(error)], ["vec_id", "label", "x", "code", "before", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, x array<int>, code binary, before binary, error long"
    return bounded_batches(state.select("vec_id", "label", "x", "code")).mapInArrow(assign, schema)


def changes(state: DataFrame, width: int) -> DataFrame:
    """part, entry, n and sums: what the parts that have moved add to and take from the running sums, added up in each task."""

    def tally(batches):
        import pyarrow as pa

        n, sums = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, width), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, PARTS)
            known = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            before = np.frombuffer(b"".join(v or bytes(PARTS) for v in batch.column(2).to_pylist()), np.uint8).reshape(-1, PARTS)
            for p in range(PARTS):
                moved = ~known | (code[:, p] != before[:, p])
                left = moved & known
                for rows, entry, sign in ((moved, code, 1), (left, before, -1)):
                    np.add.at(n[p], entry[rows, p], sign)
                    np.add.at(sums[p], entry[rows, p], sign * x[rows, p])
        part, entry = np.nonzero((n != 0) | (sums != 0).any(2))
        if len(part):
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(sums[part, entry].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), flat], ["part", "entry", "n", "sums"])

    moved = state.where(F.col("before").isNull() | (F.col("code") != F.col("before")))
    return bounded_batches(moved.select("x", "code", "before")).mapInArrow(tally, "part int, entry int, n long, sums array<bigint>")


def merged(sums: DataFrame, width: int) -> DataFrame:
    """Running sums and changes as one row for each part and entry."""
    return sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))


def learned(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame | None, np.ndarray]:
    """The last state, assigned to the final codebooks, and the codebooks (4, entries, width); None without vectors."""
    rows, width = integers(vectors)
    state = written(rows.withColumn("code", F.lit(None).cast("binary")), "vectors")
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(min(entries, ENTRIES)).collect()
    if not first:
        return None, np.zeros((PARTS, 0, width), np.int64)
    books = np.array([r.x for r in first], np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()
    running = None
    for _ in range(rounds):
        state = written(assigned(state, books), "state")
        new = changes(state, width)
        running = written(merged(new if running is None else running.unionByName(new), width), "sums")
        for r in running.where("n > 0").collect():  # 4 * 256 rows at most
            books[r.part, r.entry] = [s // r.n for s in r.sums]
    return written(assigned(state, books), "state"), books


def fingerprint(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (hex), error, label_error (of all rows with this label) and codebooks_sha256 of every vector kept."""
    state, books = learned(vectors, rounds)
    if state is None:
        return vectors.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = state.select("vec_id", key.alias("key"), F.lower(F.hex("code")).alias("code"), "error")
    by_label = written(rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("held")), "labels")
    total = by_label.agg(F.sum("held")).first()[0]
    return split_join(rows, by_label, "key", total).select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of `embeddings`: vec_id, code, error, label_error, codebooks_sha256."""
    return compressed(read_table(spark, sf_dir, "embeddings"))


def _rounds(n: int) -> str:
    """The SQL of n rounds and the last assignment; distances are sums of integers below 2**53, so doubles hold them exactly."""
    out = []
    for k in range(n + 1):
        out.append(f"""a{k} AS MATERIALIZED (
  SELECT i, part, arg_min(e, d * 256 + e) AS e, min(d) AS d
  FROM (SELECT x.i, x.part, c.e, CAST(list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, c.v) + list_dot_product(c.v, c.v) AS BIGINT) AS d FROM x JOIN c{k} c USING (part)) GROUP BY i, part
)""")
        if k < n:
            out.append(f"""s{k} AS (
  SELECT part, e, pos, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, e, unnest(v) AS y, generate_subscripts(v, 1) AS pos FROM a{k} JOIN x USING (i, part)) GROUP BY part, e, pos
), c{k + 1} AS MATERIALIZED (
  SELECT part, e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT part, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY pos) AS v FROM s{k} GROUP BY part, e) m USING (part, e)
)""")
    return ",\n".join(out)


SQL = f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (SELECT i, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS v FROM k, (SELECT unnest(range(4)) AS part)),
c0 AS MATERIALIZED (SELECT part, i AS e, v FROM x WHERE i < 256),
{_rounds(ROUNDS)},
r AS (SELECT i, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY i),
h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, pos)) AS h FROM (SELECT part, e, unnest(v) AS y, generate_subscripts(v, 1) AS pos FROM c{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.h AS codebooks_sha256 FROM r JOIN k USING (i), h
"""
