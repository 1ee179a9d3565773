"""What the training-data operators share: table reads, the shared folder, and byte-level word hashing.

Word hashing works on the UTF-8 bytes of a whole Arrow column at once, so no Python string is made for a word.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes hashed at a time; a longer text is cut at separators, so memory stays bounded for texts of any length.
SEGMENT_BYTES = 1 << 19
#: Bytes of texts that are worked on together (one longer text goes alone).
SLICE_BYTES = 1 << 21


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors see, which the cluster names in spark.checkpoint.dir.

    Where that is unset, a session on one machine gets a folder below its warehouse; on a cluster it is an error, since a
    local folder would be another one on each machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get()
    return f"{root.rstrip('/')}/quarryline-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage, and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task writes of a table whose number of rows is known beforehand, at most.
TASK_ROWS = 1 << 17


def gathered(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """`df`, which has at most `rows` rows and comes from a shuffle, in no more partitions than it needs.

    Those are one for each `each` rows, but as many as there are cores, and never more than it has. So a step on few rows
    costs neither a task nor a file for every shuffle partition, and one on many rows stays dealt out.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


#: Bytes of a batch that goes to a Python worker, at most; Spark's own bound is 64 MB, for either direction and each task.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """`df`, with the session's batches to Python workers bounded; a smaller bound is left as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.match(r"\d+", str(df.sparkSession.conf.get(key)))
    if not held or not 0 < int(held[0]) <= most:
        df.sparkSession.conf.set(key, str(most))
    return df


def text_of(df: DataFrame, column: str = "text"):
    """The text column, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often it is used, also within functions over arrays."""
    return F.element_at(F.transform(F.array(value), body), 1)


def learned_from(doc_id: str = "doc_id"):
    """True for rows that a classifier may learn labels from: crc32 of the id as text, mod 3, is not 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3, F.lit(0)) != 1


#: Keys of rows that are taken out are broadcast up to this number (16 bytes each); beyond it they are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def row_key(text: str = "text"):
    """What tells rows with the same doc_id apart: a hash of the text as it is (null as empty)."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list]:
    """`docs` under names that no column of a caller has, the new name of each column, and what gives the old ones back."""
    names = {c: f"_quarryline_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names, [F.col(n).alias(c) for c, n in names.items()]


def without_rows(docs: DataFrame, gone: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """`docs` without the rows of `gone`, and with one row for each key of `repeated`; both have doc_id and h (`row_key`).

    Rows are told apart by id and text, so neither a missing nor a shared id takes out another text. Of rows that are
    equal in both, the one whose columns come first as JSON stays. Texts aren't shuffled, but for those of `repeated`.
    """
    rows, names, old = renamed(docs)
    own, h = F.col(names["doc_id"]), row_key(names["text"])
    apart = lambda keys: keys.select(F.struct(F.col("doc_id").alias("i"), F.col("h").alias("h")).alias("key")).distinct()
    on = own.eqNullSafe(F.col("key.i")) & (h == F.col("key.h"))
    small = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    out = rows.join(small(written(apart(gone), "gone")), on, "left_anti")
    repeated = None if repeated is None else written(apart(repeated), "repeated")
    if repeated is not None and not repeated.isEmpty():
        whole = F.struct(*names.values())
        held = out.join(small(repeated), on, "left_semi").groupBy(own.alias("i"), h.alias("h")).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
        out = out.join(small(repeated), on, "left_anti").unionByName(held)
    return out.select(*old)


#: A key is hot if more than one in HOT of all rows have it, so there are fewer than HOT of them, whatever the data.
HOT = 1000


def split_join(rows: DataFrame, per_key: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` joined with one row per key, which says in `held` how many of at most `total` rows have the key.

    Rows with a hot key meet a broadcast of fewer than HOT rows where they are, so no task gathers them; the others are
    joined by shuffle. `held` is dropped.
    """
    hot = F.col("held") * HOT > total
    many, few = per_key.where(hot).drop("held"), per_key.where(~hot).drop("held")
    rest = rows.join(F.broadcast(many.select(key)), key, "left_anti")
    return rows.join(F.broadcast(many), key, how).unionByName(rest.join(few, key, how))


# --- byte-level words ---------------------------------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of products become well spread hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class ByteWords:
    """Words of texts given as bytes: maximal runs of bytes that `separator` doesn't mark, A-Z lower-cased."""

    def __init__(self, separator: np.ndarray):
        self.separator = separator
        fold = np.arange(256, dtype=np.uint64) + np.uint64(1)
        fold[65:91] = np.arange(97, 123, dtype=np.uint64) + np.uint64(1)
        self.fold = fold
        self.pow = _powers(_P, 1 << 12)
        self.inv = _powers(_P_INV, 1 << 12)

    def _grow(self, n: int) -> None:
        if n >= len(self.pow):
            self.pow, self.inv = _powers(_P, n), _powers(_P_INV, n)

    def _segment(self, data: np.ndarray, base: int, bounds: np.ndarray):
        """Hashes, starts and ends of the words of one segment; bounds: text starts inside it, relative to it."""
        n = len(data)
        self._grow(n)
        word = ~self.separator[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        cut = bounds[(bounds > 0) & (bounds < n)]
        first[cut] = word[cut]
        last = word.copy()
        last[:-1] &= ~word[1:]
        last[cut - 1] |= word[cut - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.fold[data] * self.pow[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inv[starts]), starts + base, ends + base

    def hashes(self, data: np.ndarray, offsets: np.ndarray):
        """Word hashes, their byte starts and ends, and for each text the index of its first word (one more at the end)."""
        at, end, parts = int(offsets[0]), int(offsets[-1]), []
        while at < end:
            upto = min(end, at + SEGMENT_BYTES)
            if upto < end:
                k = int(np.searchsorted(offsets, upto, "right")) - 1
                if offsets[k] > at:
                    upto = int(offsets[k])
                else:  # one long text: cut where a separator is, or take the whole run
                    gaps = np.flatnonzero(self.separator[data[at:upto]])
                    stop = int(offsets[k + 1])
                    if len(gaps):
                        upto = at + int(gaps[-1]) + 1
                    else:
                        while upto < stop and not len(gaps):
                            ahead = min(stop, upto + SEGMENT_BYTES)
                            gaps = np.flatnonzero(self.separator[data[upto:ahead]])
                            upto = upto + int(gaps[0]) if len(gaps) else ahead
            inside = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, upto, "left")] - at
            parts.append(self._segment(data[at:upto], at, inside))
            at = upto
        if not parts:
            z = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
        h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
        return h, s, e, np.searchsorted(s, offsets, "left")


def white_space() -> np.ndarray:
    """Marks the bytes 0x20 and 0x09 to 0x0D."""
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def not_alphanumeric() -> np.ndarray:
    """Marks ASCII bytes that are neither letters nor digits; bytes of other characters belong to words."""
    out = np.zeros(256, bool)
    out[:128] = [not chr(i).isalnum() for i in range(128)]
    return out


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; empty if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, k = np.zeros(n, np.uint64), np.uint64(0xD6E8FEB86659FD93)
    for i in range(width):
        out = (out + words[i : i + n]) * k
    return mix(out)


def rolled(words: np.ndarray):
    """A function that gives the hashes of all runs of n words (Karp-Rabin), for any n, in time that doesn't depend on n."""
    up, down = _powers(_P, len(words)), _powers(_P_INV, len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words) * up[:-1], out=sums[1:])
    return lambda n: mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def utf8(column):
    """Bytes and offsets of an Arrow string column; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offs else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slices(batch, column: int, most: int | None = None):
    """A record batch in pieces of at most `most` bytes of text, or of one row."""
    import pyarrow.compute as pc

    most = SLICE_BYTES if most is None else most
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def list_array(values: np.ndarray, offsets: np.ndarray):
    """An Arrow list column from flat values."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
