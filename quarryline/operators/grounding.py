"""Grounding and relations (inventory G-01 to G-09, J-06, J-07, A-05)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, StringType, StructType

from quarryline.functions.confidence import rate
from quarryline.functions.text import all_numbers_in, normalise

LEAST_QUOTE, LEAST_RATIO = 20, 0.85


def best_window(quote: str, text: str, floor: float = 0.0) -> float:
    """G-03: highest similarity of the quote with windows of its length, one every half length; cheap bounds come first."""
    from difflib import SequenceMatcher

    if not quote or not text:
        return 0.0
    best, matcher = floor, SequenceMatcher(None, b=quote)
    for at in range(0, max(1, len(text) - len(quote) + 1 + len(quote) // 2), max(1, len(quote) // 2)):
        matcher.set_seq1(text[at : at + len(quote)])
        if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best:
            best = max(best, matcher.ratio())
    return best if best > floor else 0.0


@F.pandas_udf(DoubleType())
def window_similarity(quotes: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([best_window(q or "", t or "") for q, t in zip(quotes, texts, strict=True)])


def ground(drafts: DataFrame, paragraphs: DataFrame, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """G-02, G-04: drafts (draft_id, paper_id, quote) with the paragraph that holds their quote, or null.

    The first paragraph that holds the quote word for word counts; only drafts without one are compared window by
    window. Quotes of under 20 normalised characters ground nothing. The whole paragraph is the grounded quote.
    """
    d = drafts.withColumn("q", normalise(F.col("quote"))).where(F.length("q") >= LEAST_QUOTE)
    p = paragraphs.select("paper_id", "section_id", "paragraph_index", "ord", F.col("text").alias("paragraph"), normalise(F.col("text")).alias("p"))
    pairs = d.join(p, "paper_id")
    place = F.struct("ord", "section_id", "paragraph_index", "paragraph")
    exact = pairs.where("instr(p, q) > 0").groupBy("draft_id").agg(F.min(place).alias("place"), F.lit(1.0).alias("ratio"))
    open_ = pairs.join(exact.select("draft_id"), "draft_id", "left_anti").withColumn("ratio", window_similarity("q", "p")).where(F.col("ratio") >= least_ratio)
    fuzzy = open_.groupBy("draft_id").agg(F.max_by(place, F.struct("ratio", -F.col("ord"))).alias("place"), F.max("ratio").alias("ratio"))
    found = exact.unionByName(fuzzy)
    return drafts.join(found, "draft_id", "left").select("draft_id", "paper_id", "place.section_id", "place.paragraph_index", F.col("place.paragraph").alias("grounded_quote"), F.round("ratio", 6).alias("ratio"))


def exact_quotes(quotes: DataFrame, texts: DataFrame, seed_words: int = 6) -> DataFrame:
    """Quotes (item_id, text) found word for word in texts (doc_id, text), after normalisation.

    A quote can only be in a text that has its first `seed_words` words in a row; these seeds are joined, and only the
    pairs they give are compared. Quotes of fewer words seed with all they have.
    """
    q = quotes.select("item_id", normalise(F.col("text")).alias("q")).where(F.length("q") >= LEAST_QUOTE)
    words = lambda c: F.split(c, " ")
    q = q.select("item_id", "q", F.least(F.size(words(F.col("q"))) - 1, F.lit(seed_words)).alias("k"))
    # the first word may be the end of a longer one in the text, and the last the start of one: seeds leave both out
    q = q.withColumn("seed", F.array_join(F.slice(words(F.col("q")), 2, F.greatest(F.col("k") - 1, F.lit(1))), " "))
    sizes = [r.n for r in q.select(F.greatest(F.col("k") - 1, F.lit(1)).alias("n")).distinct().collect()]  # at most seed_words values
    t = texts.select("doc_id", normalise(F.col("text")).alias("t"))
    cut = t.select("doc_id", words(F.col("t")).alias("w"))  # a column of its own, so that it is split once and not for each run
    every = None
    for n in sizes:
        own = q.where(F.greatest(F.col("k") - 1, F.lit(1)) == n).select("item_id", "seed")
        part = cut.select("doc_id", F.explode(F.array_distinct(_runs(F.col("w"), n))).alias("seed")).join(own, "seed").select("doc_id", "item_id").distinct()
        every = part if every is None else every.unionAll(part)
    if every is None:
        return texts.select("doc_id", F.lit(None).cast("long").alias("item_id")).limit(0)
    return every.join(q.select("item_id", "q"), "item_id").join(t, "doc_id").where("instr(t, q) > 0").select("doc_id", "item_id")


def seeded_paragraphs(quotes: DataFrame, paragraphs: DataFrame, seed_words: int = 3) -> DataFrame:
    """Quotes (item_id, text) with the paragraphs that share a run of `seed_words` words with them anywhere, after normalisation: item_id and the paragraph's columns.

    A quote that is altered in places is found by what stands between them: only one without any such run left is missed.
    Quotes of fewer words seed with single words.
    """
    words = lambda c: F.split(normalise(F.col(c)), " ")
    seeds = lambda n: F.explode(F.array_distinct(_runs(F.col("w"), n))).alias("seed")
    q = quotes.select("item_id", words("text").alias("w")).withColumn("n", F.when(F.size("w") >= seed_words, seed_words).otherwise(1))
    cut = paragraphs.select("paper_id", "section_id", "paragraph_index", words("text").alias("w"))
    key, every = ["paper_id", "section_id", "paragraph_index"], None
    for n in (seed_words, 1):
        own = q.where(F.col("n") == n).select("item_id", seeds(n))
        part = cut.select(*key, seeds(n)).join(own, "seed").select("item_id", *key)
        every = part if every is None else every.unionAll(part)
    return every.distinct().join(paragraphs, key)


def _runs(words: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))


def draft_problem(kind: Column, name: Column, summary: Column, metric: Column, value: Column, quote: Column) -> Column:
    """G-05: why a draft is refused, null if it isn't."""
    return (
        F.when(kind.isin("method", "dataset", "metric") & (F.trim(F.coalesce(name, F.lit(""))) == ""), "nameless")
        .when(kind.isin("limitation", "future_work") & (F.length(F.trim(F.coalesce(summary, F.lit("")))) < 15), "summary_too_short")
        .when((kind == "result") & (F.coalesce(metric, F.lit("")) == ""), "no_metric")
        .when((kind == "result") & (F.coalesce(value, F.lit("")) == ""), "no_value")
        .when((kind == "result") & ~all_numbers_in(value, quote), "value_not_in_quote")
    )


def extraction_stats(per_paper: DataFrame) -> DataFrame:
    """A-05, G-07: rates over papers that were measured; null where none was."""
    return per_paper.agg(F.round(rate(F.col("grounded"), F.col("proposed")), 6).alias("grounding_rate"), F.round(rate(F.col("accepted"), F.col("grounded")), 6).alias("acceptance_rate"), F.count_if(F.expr("proposed IS NULL")).alias("unmeasured"))


def kept_share(proposed: Column, kept: Column) -> Column:
    """G-09."""
    return F.when(proposed > 0, kept / proposed).otherwise(0.0)


def relate_by_name(results: DataFrame, named: DataFrame, wanted: str, kind: str, predicate: str) -> DataFrame:
    """J-06: results to the metric or dataset of their paper that they name: either string holds the other, the longest name counts, then the first."""
    r = results.select("paper_id", F.col("id").alias("subject_id"), normalise(F.col(wanted)).alias("w")).where("w <> ''")
    n = named.where(F.col("kind") == kind).select("paper_id", F.col("id").alias("object_id"), "ord", normalise(F.col("name")).alias("n")).where("n <> ''")
    hits = r.join(n, "paper_id").where(F.col("w").contains(F.col("n")) | F.col("n").contains(F.col("w")))
    first = Window.partitionBy("subject_id").orderBy(F.desc(F.length("n")), "ord")
    return hits.withColumn("place", F.row_number().over(first)).where("place = 1").select(F.concat_ws("--", "subject_id", F.lit(predicate), "object_id").alias("id"), F.lit(predicate).alias("predicate"), "subject_id", "object_id", F.lit(1.0).alias("strength"))


def relate_by_place(objects: DataFrame, left: str, right: str, predicate: str) -> DataFrame:
    """J-07: objects of two kinds with evidence in one paragraph; rows (id, kind, paper_id, section_id, paragraph_index) per piece of evidence."""
    placed = objects.where("section_id IS NOT NULL AND paragraph_index IS NOT NULL")
    key = ["paper_id", "section_id", "paragraph_index"]
    a = placed.where(F.col("kind") == left).select(*key, F.col("id").alias("subject_id")).distinct()
    b = placed.where(F.col("kind") == right).select(*key, F.col("id").alias("object_id")).distinct()
    return a.join(b, key).select("subject_id", "object_id").distinct().select(F.concat_ws("--", "subject_id", F.lit(predicate), "object_id").alias("id"), F.lit(predicate).alias("predicate"), "subject_id", "object_id", F.lit(0.6).alias("strength"))


def unite_relations(*parts: DataFrame) -> DataFrame:
    """U-03, A-14: the strongest of each."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("id").agg(F.max_by(F.struct("predicate", "subject_id", "object_id", "strength"), "strength").alias("r")).select("id", "r.*")


@udtf(returnType=StructType().add("kind", StringType()).add("name", StringType()).add("value", StringType()).add("quote", StringType()))
class RuleExtractor:
    """G-01 without a model: numbers with a unit become results, capitalised phrases become names. A seam for other extractors."""

    def eval(self, title: str, text: str) -> Iterator[tuple]:
        for sentence in re.split(r"(?<=[.!?])\s+", text or ""):
            for m in re.finditer(r"(\d+(?:\.\d+)?)\s?(%|ms|s|points?)", sentence):
                yield "result", (title or "")[:80], m[1], sentence
            for m in re.finditer(r"\b[A-Z]\w+(?: [A-Z]\w+)+", sentence):
                yield "method", m[0], None, sentence


def with_model(texts: DataFrame, complete: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """G-01 with a model: `complete` maps a batch of {title, text} to drafts; it runs once per batch on the executors."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame(complete(f.to_dict("records")))

    return texts.mapInPandas(batches, schema)
