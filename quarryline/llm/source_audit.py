"""Operator 13, source divergence audit: which sources of a language use words unlike the others, and which words.

1. Texts are cut into terms and counted by language, source and term in each task, before anything is shuffled: a row
   for each language and term, with its sources and their counts.
2. These rows are dealt to shards by a hash of language and term, so that a shard knows all about its terms. DuckDB adds
   them up in each shard and leaves out the terms that stand in too few documents.
3. Spark adds up the totals of each (language, source) and language, a row each, and every shard gets them beside its
   counts. DuckDB makes partial sums for each pair of sources, and the best terms of each source, of its shard.
4. Spark adds up the partial sums and ranks.

In a shard a pair of sources only meets at terms that both have. What the others add depends on one source's count, so it
comes from the numbers of terms with each count; terms that neither has are all alike, and their value is added to the
merged sum. All arithmetic is exact: 128-bit integers in DuckDB, decimals in Spark. DuckDB keeps to MEMORY in each task
and goes to the task's own temporary files beyond that.

Cases: null text, language and source count as ''. A text without a term, also an empty one, still makes its group occur.
Rows that repeat an id are documents of their own. Very long texts are worked on in pieces. A language with one source
has no pairs; one that keeps no term has pairs of value 0 and no terms. Equal values are ranked by their item in the order
of UTF-8. An empty table gives an empty result. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import bounded_batches, read_table, slices, text_of, utf8, written

#: A term is kept if so many documents of its language have it, and terms are reported up to this rank.
FEWEST_DOCUMENTS, BEST = 3, 200
#: What a task holds before it passes its counts on: distinct terms, and terms of documents (each times 8) in sum.
HELD, HELD_OF_DOCUMENTS = 400_000, 8
#: Bytes of a text that are cut into terms at once, and rows of a batch.
PIECE_BYTES, ROWS = 1 << 20, 20_000
#: What DuckDB may hold in a task.
MEMORY = "256MB"

#: Bytes of terms as they are, A-Z lower-cased; all others become a space.
_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _pieces(text: bytes):
    """Parts of a text that end between terms."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class _Language:
    """The terms of one language that a task has seen."""

    def __init__(self):
        self.terms, self.sources, self.parts = _Numbers(), _Numbers(), {}

    def add(self, source: str, text: bytes) -> int:
        """Counts a document's terms; says how many distinct ones it has."""
        own = self.parts.setdefault(self.sources[source], [])
        found = [np.array([self.terms[w] for w in piece.split()], np.int64) for piece in _pieces(text)]
        terms, times = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        own.append((terms.astype(np.int32), times.astype(np.int32)))
        return len(terms)

    def batches(self, lang: str):
        """A row for each term: its documents, sources and counts; first one without a term, for the sources."""
        import pyarrow as pa

        names, fields = pa.array(list(self.sources), pa.string()), ["lang", "term", "docs", "sources", "counts"]
        none = pa.ListArray.from_arrays([0, len(names)], pa.array([0] * len(names), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.nulls(1, pa.string()), pa.array([0], pa.int64()), pa.ListArray.from_arrays([0, len(names)], names), none], fields)
        size, docs, term, source, n = len(self.terms), 0, [], [], []
        for k, parts in self.parts.items():
            t, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            docs = docs + np.bincount(t, minlength=size)
            sums = np.bincount(t, weights=c, minlength=size).astype(np.int64)  # exact below 2**53
            term.append(np.flatnonzero(sums))
            n.append(sums[term[-1]])
            source.append(np.full(len(n[-1]), k))
        term, source, n = (np.concatenate(x) for x in (term, source, n))
        order = np.argsort(term, kind="stable")
        ends, words = np.searchsorted(term[order], np.arange(size + 1)), list(self.terms)
        for at in range(0, size, ROWS):
            upto = min(size, at + ROWS)
            own, offsets = order[ends[at] : ends[upto]], pa.array((ends[at : upto + 1] - ends[at]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, names.take(pa.array(source[own]))), pa.ListArray.from_arrays(offsets, pa.array(n[own]))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (upto - at)), pa.array(words[at:upto], pa.binary()).cast(pa.string()), pa.array(docs[at:upto]), *lists], fields)


def tallied(docs: DataFrame, most: int = HELD) -> DataFrame:
    """lang, term, docs (documents that have it), sources and counts, added up for each task; a row with null term names sources.

    A task passes on what it has when it holds about `most` distinct terms.
    """

    def tally(batches):
        held, size = {}, 0
        for batch in (part for b in batches for part in slices(b, 2)):
            data, offsets = utf8(batch.column(2))
            for i, (lang, source) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                text = data[offsets[i] : offsets[i + 1]].tobytes().translate(_TERMS)
                size += held.setdefault(lang, _Language()).add(source, text)
                if size > HELD_OF_DOCUMENTS * most or sum(len(x.terms) for x in held.values()) > most:
                    for name, language in held.items():
                        yield from language.batches(name)
                    held, size = {}, 0
        for name, language in held.items():
            yield from language.batches(name)

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty("lang").alias("lang"), empty("source").alias("source"), text_of(docs).alias("text"))
    return bounded_batches(rows).mapInArrow(tally, "lang string, term string, docs long, sources array<string>, counts array<bigint>")


def in_shards(rows: DataFrame, shards: int, by: list[str], sql: str, schema: str) -> DataFrame:
    """The result of DuckDB's `sql` over each shard's rows, which it knows as `t` and reads once."""

    def run(batches):
        import itertools
        import tempfile

        import duckdb
        import pyarrow as pa

        first = next(batches, None)
        if first is not None:
            with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": spill, "preserve_insertion_order": False}) as db:
                db.register("t", pa.RecordBatchReader.from_batches(first.schema, itertools.chain([first], batches)))
                yield from db.sql(sql).to_arrow_reader(ROWS)

    return bounded_batches(rows.repartition(shards, *by)).mapInArrow(run, schema)


#: Counts of the terms that are kept; `first` marks one row for each term. Rows without a term name the sources that occur.
_COUNTS = f"""
WITH r AS MATERIALIZED (SELECT * FROM t),
k AS MATERIALIZED (SELECT lang, term FROM r WHERE term IS NOT NULL GROUP BY lang, term HAVING sum(docs) >= {FEWEST_DOCUMENTS}),
u AS (SELECT lang, term, unnest(sources) AS source, unnest(counts) AS n FROM r SEMI JOIN k USING (lang, term))
SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS INT) AS first FROM u GROUP BY lang, source, term
UNION ALL SELECT DISTINCT lang, unnest(sources), NULL, 0, 0 FROM r WHERE term IS NULL
"""

#: Partial sums of pairs, less what a term adds that neither source has, and the best terms of each source. A task may have
#: several shards, and with them the totals several times.
_VALUES = f"""
WITH r AS MATERIALIZED (SELECT * FROM t),
g AS MATERIALIZED (SELECT DISTINCT lang, source, n_group + n_terms AS m, n_lang + n_terms AS lm, 1 + 1000000000 // (n_group + n_terms) AS p0 FROM r WHERE term IS NULL),
c AS MATERIALIZED (SELECT lang, source, term, r.n, CAST(1 + (1000000000::HUGEINT * (r.n + 1)) // g.m AS BIGINT) AS p, g.p0, g.lm FROM r JOIN g USING (lang, source) WHERE term IS NOT NULL),
l AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (sum(n) + 1)) // any_value(lm) AS BIGINT) AS q FROM c GROUP BY lang, term),
h AS MATERIALIZED (SELECT lang, source, p, p0, count(*) AS k FROM c GROUP BY lang, source, p, p0),
met AS (
  SELECT a.lang, a.source AS a, b.source AS b, sum((a.p - b.p) * (a.p - b.p) // b.p - (a.p - b.p0) * (a.p - b.p0) // b.p0 - (a.p0 - b.p) * (a.p0 - b.p) // b.p + (a.p0 - b.p0) * (a.p0 - b.p0) // b.p0) AS v
  FROM c a JOIN c b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, b.source, sum(k * CAST((a.p - b.p0) * (a.p - b.p0) // b.p0 - (a.p0 - b.p0) * (a.p0 - b.p0) // b.p0 AS HUGEINT)) FROM h a JOIN g b ON a.lang = b.lang AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT b.lang, a.source, b.source, sum(k * CAST((a.p0 - b.p) * (a.p0 - b.p) // b.p - (a.p0 - b.p0) * (a.p0 - b.p0) // b.p0 AS HUGEINT)) FROM h b JOIN g a ON a.lang = b.lang AND a.source <> b.source GROUP BY ALL
)
SELECT lang, a AS source, 'pair' AS part, b AS item, CAST(sum(v) AS DECIMAL(38, 0)) AS value FROM met GROUP BY lang, a, b
UNION ALL
SELECT lang, source, 'term', term, CAST(f AS DECIMAL(38, 0)) FROM (SELECT lang, source, term, (p - q) * (p - q) // q AS f FROM c JOIN l USING (lang, term) WHERE p > q)
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f DESC, term) <= {BEST}
"""


def audited(docs: DataFrame, shards: int | None = None, most: int = HELD) -> DataFrame:
    """lang, source, part, item, value and rank, as the module says."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = written(in_shards(tallied(docs, most), shards, ["lang", "term"], _COUNTS, "lang string, source string, term string, n long, first int"), "counts")
    by_lang = counts.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("first").alias("n_terms"))
    totals = written(counts.groupBy("lang", "source").agg(F.sum("n").alias("n_group")).join(by_lang, "lang"), "totals")
    some = totals.where("n_terms > 0")
    everywhere = some.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")
    rows = counts.where("term IS NOT NULL").select("lang", "source", "term", "n", shard.alias("shard"))
    rows = rows.unionByName(everywhere, allowMissingColumns=True)
    values = written(in_shards(rows, shards, ["shard"], _VALUES, "lang string, source string, part string, item string, value decimal(38,0)"), "values")
    neither = F.expr("CAST((p - q) * (p - q) div q AS DECIMAL(38, 0)) * n_terms")
    smallest = totals.withColumn("p0", F.expr("CASE WHEN n_terms > 0 THEN 1 + 1000000000 div (n_group + n_terms) ELSE 1 END"))
    pairs = smallest.select("lang", "source", "n_terms", F.col("p0").alias("p")).join(smallest.select("lang", F.col("source").alias("item"), F.col("p0").alias("q")), "lang").where("source <> item")
    met = values.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("met"))
    pairs = pairs.join(met, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("met", F.lit(0)) + neither).cast("long").alias("value"))
    found = pairs.unionByName(values.where("part = 'term'").withColumn("value", F.col("value").cast("long")))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= BEST)).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All languages and sources of `documents`: lang, source, part, item, value, rank."""
    return audited(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
gs AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
gn AS (SELECT lang, source, coalesce(sum(n), 0) AS m FROM gs LEFT JOIN c USING (lang, source) GROUP BY lang, source),
ln AS (SELECT lang, sum(n) AS m FROM c GROUP BY lang),
p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (gn.m + v.v) AS BIGINT) AS p
  FROM gn JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), q AS (SELECT lang, term, CAST(1 + (1000000000 * (sum(n) + 1)) // (any_value(ln.m) + any_value(v.v)) AS BIGINT) AS q FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term),
r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.f, 0) AS value FROM gs x JOIN gs y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source) f
    ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM r QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
"""
