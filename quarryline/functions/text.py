"""Text normalisers and tokenisers as column functions (inventory T-01 to T-22, and the scalar needs of 2.10).

There are four tokenisers on purpose: retrieval and BM25 keep punctuation, titles and ranking strip it.
Only Unicode compatibility folding has no Spark function; it runs as an Arrow UDF, and only on texts that need it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Words that carry no topic.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "for",
    "from", "how", "in", "into", "is", "it", "its", "of", "on", "or", "our", "that",
    "the", "their", "there", "these", "this", "those", "to", "via", "we", "what",
    "which", "why", "with",
)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def collapse(c: Column) -> Column:
    """White space collapsed to single spaces, and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise(c: Column, fold: bool = False) -> Column:
    """T-01: quotes, hyphens, broken words and white space made uniform, lower case. `fold` adds NFKC (a UDF)."""
    c = nfkc(c) if fold else c
    c = F.translate(c, "“”‘’­‐‑", "\"\"''---")
    for ligature, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        c = F.replace(c, F.lit(ligature), F.lit(letters))
    return F.lower(collapse(F.regexp_replace(c, r"(?U)(\w)-\s+(\w)", "$1$2")))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def tokens(c: Column, fold: bool = False) -> Column:
    """T-02: distinct words of more than two characters outside the stop list; punctuation stays on them."""
    return F.array_distinct(F.filter(_words(normalise(c, fold)), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)))


def bm25_tokens(c: Column, fold: bool = False) -> Column:
    """T-03: words of more than one character, repeats kept."""
    return F.filter(F.split(normalise(c, fold), " "), lambda w: F.length(w) > 1)


def split_words(c: Column) -> Column:
    """All that stands between spaces of the normalised text, to be met with tokens: a word that is none meets nothing."""
    return F.split(normalise(c), " ")


def title_key(c: Column) -> Column:
    """T-04: lower case, punctuation to spaces, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def ranking_tokens(c: Column) -> Column:
    """T-05: T-02 over title keys."""
    return F.array_distinct(F.filter(_words(title_key(c)), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)))


def overlap(candidate: Column, reference: Column) -> Column:
    """T-06: share of the reference's words that the candidate has; 0 if either is empty."""
    # the candidate stands here once, so that its words are made once; without any it shares none
    return F.when(F.size(reference) > 0, F.greatest(F.size(F.array_intersect(candidate, reference)), F.lit(0)) / F.size(reference)).otherwise(F.lit(0.0))


def symmetric_overlap(a: Column, b: Column) -> Column:
    """T-07: shared words over the larger number of words."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).otherwise(F.lit(0.0))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """T-08: Ratcliff-Obershelp similarity with the library's defaults (frequent characters of long strings are ignored)."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def represent(name: Column, kind: Column, description: Column, quotes: Column, n_quotes: int = 2, quote_chars: int = 400) -> Column:
    """T-09: the text an object is indexed by; blank parts are left out."""
    parts = F.concat(F.array(name, F.replace(kind, F.lit("_"), F.lit(" ")), description), F.transform(F.slice(quotes, 1, n_quotes), lambda q: F.substring(q, 1, quote_chars)))
    return F.array_join(F.filter(parts, lambda p: F.trim(F.coalesce(p, F.lit(""))) != ""), " \n")


def searchable(title: Column, abstract: Column, keywords: Column, venue: Column) -> Column:
    """T-10."""
    return F.concat_ws(" ", title, abstract, F.array_join(keywords, " "), venue)


def search_terms(text: Column, terms: Column) -> Column:
    """T-11: words of the text, then the terms."""
    return F.concat(_words(collapse(text)), terms)


def location(doc: Column, page: Column, section: Column, paragraph: Column) -> Column:
    """T-12: a readable place; parts that are null are left out."""
    return F.concat_ws(" ", doc, F.concat(F.lit("p."), page.cast("string")), F.concat(F.lit("§"), section), F.concat(F.lit("¶"), paragraph.cast("string")))


def precision(*parts: Column) -> Column:
    """T-13: how many of the parts of a location are known."""
    return sum((p.isNotNull().cast("int") for p in parts), F.lit(0))


def clean_list(items: Column, most: int | None = None) -> Column:
    """T-14: collapsed, without blanks, first of those equal but for case, at most `most`."""
    tidy = F.filter(F.transform(items, collapse), lambda x: x != "")
    lower = F.transform(tidy, F.lower)
    firsts = F.filter(F.transform(tidy, lambda x, i: F.struct(x.alias("x"), (F.array_position(lower, F.lower(x)) == i + 1).alias("first"))), lambda s: s["first"])
    out = F.transform(firsts, lambda s: s["x"])
    return F.slice(out, 1, most) if most is not None else out


def clean_query(c: Column, most: int = 500) -> Column:
    """T-15: collapsed and cut; null when nothing is left."""
    out = F.substring(collapse(c), 1, most)
    return F.when(out != "", out)


def parse_kinds(items: Column, domain: tuple[str, ...]) -> Column:
    """T-16: unknown values are dropped."""
    return F.array_intersect(items, F.array(*map(F.lit, domain)))


def clamp(c: Column, ceiling: int) -> Column:
    """T-17."""
    return F.greatest(F.lit(1), F.least(c, F.lit(ceiling)))


def digits(c: Column) -> Column:
    """T-18."""
    return F.regexp_replace(c, "[^0-9]", "")


def first_number(c: Column) -> Column:
    """T-18: null when there is none."""
    found = F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0)
    return F.when(found != "", found.cast("double"))


def all_numbers_in(value: Column, quote: Column) -> Column:
    """T-18: whether every number of the value stands in the quote."""
    return F.forall(F.regexp_extract_all(value, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), quote.contains)


def paragraphs_text(paragraphs: Column) -> Column:
    """T-20: paragraphs joined by blank lines."""
    return F.array_join(paragraphs, "\n\n")


def word_count(c: Column) -> Column:
    """T-20."""
    return F.size(_words(collapse(c)))


def author_names(c: Column) -> Column:
    """T-21: two to five words, capitalised, 4 to 60 characters."""
    parts = F.transform(F.split(c, r",|;|\band\b|&|\n"), collapse)
    return F.filter(parts, lambda p: F.length(p).between(4, 60) & F.size(F.split(p, " ")).between(2, 5) & p.rlike(r"^\p{Lu}[^\s]*(?: \p{Lu}[^\s]*)*$"))


def fill_gaps(mine: Column, other: Column, fields: tuple[str, ...]) -> Column:
    """T-22: a struct with the gaps of `mine` filled from `other`."""
    return F.struct(*(F.coalesce(mine[f], other[f]).alias(f) for f in fields))


def strip_tags(c: Column) -> Column:
    """Markup out, white space collapsed."""
    return collapse(F.regexp_replace(c, "<[^>]+>", " "))
