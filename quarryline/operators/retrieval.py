"""Retrieval (inventory R-01 to R-16, W-01 to W-03, O-01 to O-03).

Objects have id, kind, paper_id, name, description, quotes, confidence, n_evidence and trusted. Every arm returns
(id, score) or (query_id, id, score), best first; equal scores are ordered by id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.functions.confidence import weighted_score
from quarryline.plans.shared import written


@dataclass(frozen=True)
class Query:
    """One request; empty filters let everything pass."""

    text: str
    kinds: tuple[str, ...] = ()
    paper_ids: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    min_confidence: float = 0.0
    limit: int = 10
    question_id: str | None = None
    year_from: int | None = None
    options: dict = field(default_factory=dict)

    @property
    def all_terms(self) -> str:
        return " ".join([*self.text.split(), *self.terms])


def candidates(objects: DataFrame, query: Query) -> DataFrame:
    """F-01 to F-05: trusted objects that pass the filters of the query."""
    out = objects.where("trusted").where(F.col("confidence") >= query.min_confidence)
    if query.kinds:
        out = out.where(F.col("kind").isin(*query.kinds))
    if query.paper_ids:
        out = out.where(F.col("paper_id").isin(*query.paper_ids))
    if query.year_from is not None and "year" in objects.columns:
        out = out.where(F.col("year").isNull() | (F.col("year") >= query.year_from))
    return out


def best(scored: DataFrame, limit: int) -> DataFrame:
    """O-01: by score, then id."""
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def lexical_signals(query: Query) -> dict[str, tuple[Column, float]]:
    terms = T.tokens(F.lit(query.all_terms))
    text = F.concat_ws(" ", F.coalesce("description", F.lit("")), F.array_join("quotes", " "))
    return {
        "name_match": (T.overlap(T.split_words(F.col("name")), terms), 1.0),
        "text_match": (T.overlap(T.split_words(text), terms), 0.8),
        "validation_confidence": (F.col("confidence"), 0.6),
        "evidence_density": (F.least(F.col("n_evidence") / 3, F.lit(1.0)), 0.4),
    }


def lexical(objects: DataFrame, query: Query) -> DataFrame:
    """R-01: weighted word overlap, confidence and evidence density; scores above 0."""
    found = candidates(objects, query).select("*", weighted_score(lexical_signals(query)).alias("score"))
    # the best first, then those above 0: the other way round the filter would make the score a second time
    return best(found, query.limit).where("score > 0")


def bm25(objects: DataFrame, query: Query, text: Column, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """R-02: BM25 over the filtered candidates; repeated words of the query count again.

    One pass over the texts counts the query's words in each (no row per word): a text's words are gone through once to
    find those of the query, however many these are. What it counted is written, and the corpus figures are one row of it.
    """
    words = candidates(objects, query).sparkSession.range(1).select(T.bm25_tokens(F.lit(query.all_terms)).alias("w")).first().w
    terms = sorted(set(words))
    if not terms:
        return objects.select("id", F.lit(0.0).alias("score")).limit(0)
    tokens = T.bm25_tokens(text)
    counted = candidates(objects, query).select("id", tokens.alias("t"))
    counted = counted.select("id", F.size("t").alias("n"), F.filter("t", lambda w: w.isin(*terms)).alias("t"))
    counted = counted.select("id", "n", *(F.size(F.filter("t", _equals(q))).alias(f"tf{i}") for i, q in enumerate(terms)))
    counted = written(counted, "bm25")
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms)))).first()
    score = F.lit(0.0)
    for i, q in enumerate(terms):
        df = stats[f"df{i}"] or 0
        idf = math.log(1 + ((stats.docs or 0) - df + 0.5) / (df + 0.5))
        tf = F.col(f"tf{i}")
        norm = tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("n") / F.lit(float(stats["mean"] or 1)))
        score = score + F.when(tf > 0, F.lit(words.count(q) * idf) * tf * F.lit(k1 + 1) / norm).otherwise(0.0)
    return best(counted.select("id", F.round(score, 6).alias("score")).where("score > 0"), query.limit)


def _equals(word: str):
    return lambda x: x == word


def bm25_batch(objects: DataFrame, queries: DataFrame, text: Column, k1: float = 1.5, b: float = 0.75, limit: int = 10) -> DataFrame:
    """R-02 for many queries (query_id, text) at once: postings of the words that some query has, joined on the word."""
    asked = queries.select("query_id", F.explode(T.bm25_tokens(F.col("text"))).alias("word")).groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("times"))
    tokens = objects.select("id", T.bm25_tokens(text).alias("t"))
    sizes = tokens.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("t")).alias("mean")).first()
    wanted = asked.select("word").distinct()
    postings = tokens.select("id", F.size("t").alias("n"), F.explode("t").alias("word")).join(wanted, "word", "left_semi").groupBy("word", "id", "n").agg(F.count(F.lit(1)).alias("tf"))
    postings = written(postings, "postings")
    df = postings.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(float(sizes.docs or 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.lit(float(sizes["mean"] or 1))))
    scored = postings.join(df, "word").join(asked, "word").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return ranked(scored, limit)


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """W-01: rank within each query; the best `limit` of each."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def cosine(a: Column, b: Column) -> Column:
    """Between -1 and 1; 0 for vectors of different length or without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms))).otherwise(F.lit(0.0))


def semantic(vectors: DataFrame, query_vector: Sequence[float], limit: int, vector: str = "vector") -> DataFrame:
    """R-03, O-02: nearest vectors by cosine, mapped to 0..1."""
    asked = F.array(*(F.lit(float(x)) for x in query_vector))
    found = vectors.select("*", F.round((cosine(F.col(vector), asked) + 1) / 2, 6).alias("score"))
    return best(found, limit)


def semantic_batch(vectors: DataFrame, queries: list[tuple[str, Sequence[float]]], limit: int, block: int = 512) -> DataFrame:
    """R-03 for a given list of query vectors: each task multiplies its vectors with a block of queries and keeps its own best.

    The queries are the caller's, so their number is known; they go out in blocks of `block`.
    """
    out = None
    for at in range(0, len(queries), block):
        names = [q for q, _ in queries[at : at + block]]
        asked = np.array([v for _, v in queries[at : at + block]], np.float64)
        asked /= np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)

        def nearest(batches, names=names, asked=asked):
            for batch in batches:
                m = np.stack(batch["vector"].to_numpy()).astype(np.float64)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                score = np.round((np.clip(asked @ m.T, -1, 1) + 1) / 2, 6)
                ids = batch["id"].to_numpy()
                for q, row in zip(names, score, strict=True):
                    top = np.lexsort((ids, -row))[:limit]
                    yield pd.DataFrame({"query_id": q, "id": ids[top], "score": row[top]})

        part = vectors.select("id", "vector").mapInPandas(nearest, f"query_id string, id {dict(vectors.dtypes)['id']}, score double")
        out = part if out is None else out.unionAll(part)
    return ranked(out, limit)


def normalised_by_best(scored: DataFrame) -> DataFrame:
    """W-03."""
    return scored.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))


def rrf(results: DataFrame, k: int = 60, limit: int = 10) -> DataFrame:
    """R-04: reciprocal rank fusion of rows (query_id, component, weight, id, score); weights of 0 are left out."""
    results = written(results, "results")  # used twice; each use would score all texts again
    order = Window.partitionBy("query_id", "component").orderBy(F.desc("score"), "id")
    usable = results.withColumn("rank", F.row_number().over(order))
    total = usable.select("query_id", "component", "weight").distinct().groupBy("query_id").agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("total"))
    fused = usable.where("weight > 0").groupBy("query_id", "id").agg(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))).alias("sum"))
    return ranked(fused.join(total, "query_id").select("query_id", "id", F.round(F.least(F.col("sum") / (F.col("total") / (k + 1)), F.lit(1.0)), 6).alias("score")), limit)


def weighted_fusion(results: DataFrame, limit: int = 10) -> DataFrame:
    """R-05, W-02: scores stretched to 0..1 within each component, then a weighted mean."""
    results = written(results, "results")
    own = Window.partitionBy("query_id", "component")
    low, span = F.min("score").over(own), F.max("score").over(own) - F.min("score").over(own)
    stretched = results.withColumn("s", F.when(span > 0, (F.col("score") - low) / span).otherwise(1.0))
    total = results.select("query_id", "component", "weight").distinct().groupBy("query_id").agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("total"))
    fused = stretched.where("weight > 0").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("s")).alias("sum"))
    return ranked(fused.join(total, "query_id").select("query_id", "id", F.round(F.least(F.col("sum") / F.col("total"), F.lit(1.0)), 6).alias("score")), limit)


def hybrid(arms: dict[str, tuple[float, DataFrame | None]], strategy: str = "rrf", limit: int = 10, k: int = 60) -> tuple[DataFrame | None, list[str]]:
    """R-06: fuses the arms that returned something usable; the second value names those that didn't."""
    lost = [name for name, (_, df) in arms.items() if df is None]
    parts = [df.select(F.lit("q").alias("query_id"), F.lit(name).alias("component"), F.lit(float(w)).alias("weight"), "id", "score") for name, (w, df) in arms.items() if df is not None]
    if not parts:
        return None, lost
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = rrf(every, k, limit) if strategy == "rrf" else weighted_fusion(every, limit)
    return fused.drop("query_id"), lost


def agreement(objects: DataFrame) -> DataFrame:
    """A-12: papers that name the same thing; three agree fully. Distinct papers are counted by aggregation, then joined back."""
    key = T.normalise(F.col("name"))
    keyed = objects.withColumn("name_key", key)
    papers = keyed.groupBy("name_key").agg(F.countDistinct("paper_id").alias("n_papers"))
    return keyed.join(papers, "name_key").withColumn("agreement", F.least(F.col("n_papers") / 3, F.lit(1.0)))


def cross_paper(objects: DataFrame, query: Query) -> DataFrame:
    """R-09: a wider lexical result, scored again with the agreement of papers."""
    wide = Query(**{**query.__dict__, "limit": min(5 * query.limit, 500)})
    found = agreement(written(lexical(objects, wide).drop("score"), "wide"))  # used twice; each use would score all texts again
    return best(found.withColumn("score", weighted_score({**lexical_signals(query), "agreement": (F.col("agreement"), 0.9)})), query.limit)


def evidence_search(evidence: DataFrame, query: Query) -> DataFrame:
    """R-07: evidence with matching words (O-05, four times the limit), then quote overlap and precision of the place."""
    terms = T.tokens(F.lit(query.all_terms))
    words = T.tokens(F.col("quote"))
    wide = evidence.withColumn("matched", F.size(F.array_intersect(words, terms))).where("matched > 0").orderBy(F.desc("matched"), "id").limit(4 * query.limit)
    score = weighted_score({"quote": (T.overlap(words, terms), 0.8), "precision": (F.least(F.col("precision") / 4, F.lit(1.0)), 0.5)})
    return best(wide.withColumn("score", score).where("score > 0"), query.limit)


def document_search(papers: DataFrame, query: Query) -> DataFrame:
    """R-08: title overlap; asked papers always come back, with 0.01 at least."""
    terms = T.tokens(F.lit(query.all_terms))
    asked = papers.where(F.col("id").isin(*query.paper_ids)) if query.paper_ids else papers
    return best(asked.withColumn("score", F.round(F.greatest(T.overlap(T.tokens(F.col("title")), terms), F.lit(0.01)), 6)), query.limit)


def papers_mentioning(objects: DataFrame, name: str) -> DataFrame:
    """R-10: papers of the 200 best objects whose name holds the given one or is held by it."""
    key, own = T.normalise(F.lit(name)), T.normalise(F.col("name"))
    return lexical(objects, Query(name, limit=200)).where(own.contains(key) | key.contains(own)).select("paper_id").distinct()


def stored_bundles(bundles: DataFrame, query: Query) -> DataFrame:
    """R-11: mean of query overlap and the bundle's confidence; of one question if the query has it."""
    own = bundles.where(F.col("question_id") == query.question_id) if query.question_id else bundles
    score = F.round((T.overlap(T.tokens(F.col("query_text")), T.tokens(F.lit(query.all_terms))) + F.col("confidence")) / 2, 6)
    return best(own.withColumn("score", score), query.limit)


def hash_embedding(dimensions: int = 64):
    """R-14: a deterministic bag-of-words embedding, for use without a model server; a seam for any text -> vector function."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text):
            v = np.zeros(dimensions)
            for w in (text or "").lower().split():
                v[int.from_bytes(hashlib.sha1(w.encode()).digest()[:4], "big") % dimensions] += 1
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return texts.map(one)

    return embed


def index_objects(objects: DataFrame, fingerprint: str, version: str, dimensions: int = 64) -> DataFrame:
    """R-12: vectors of trusted objects, with the metadata that filters need."""
    text = T.represent(F.col("name"), F.col("kind"), F.col("description"), F.col("quotes"))
    return objects.where("trusted").select("id", hash_embedding(dimensions)(text).alias("vector"), "paper_id", "kind", "name", "confidence", F.lit(fingerprint).alias("fingerprint"), F.lit(version).alias("index_version"))


def upsert_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """K-06: replaces by id; vectors of another model are refused."""
    prints = [r.fingerprint for r in stored.select("fingerprint").unionAll(new.select("fingerprint")).distinct().limit(2).collect()]
    if len(prints) > 1:
        raise ValueError(f"index_incompatible: {sorted(prints)}")
    return stored.join(new.select("id"), "id", "left_anti").unionByName(new)


def rank_papers(papers: DataFrame, topic_terms: str, keywords: Sequence[str], as_of_year: int, limit: int | None = None) -> DataFrame:
    """R-15, O-03: title, abstract and keyword overlap, recency and citations; what is unknown counts half."""
    terms = T.ranking_tokens(F.lit(topic_terms))
    asked = F.array_distinct(F.transform(F.array(*map(F.lit, keywords)), F.lower)) if keywords else F.array().cast("array<string>")
    age = F.lit(as_of_year) - F.col("year")
    recency = F.when(F.col("year").isNull(), 0.5).when(age <= 0, 1.0).otherwise(F.exp(-age / 4))
    cited = F.when(F.col("citation_count").isNull(), 0.5).when(F.col("citation_count") <= 0, 0.0).otherwise(F.least(F.log1p(F.col("citation_count")) / math.log1p(500), F.lit(1.0)))
    own_keywords = F.array_distinct(F.transform("keywords", F.lower))
    parts = {
        "title_match": 0.35 * T.overlap(T.ranking_tokens(F.col("title")), terms),
        "abstract_match": 0.25 * T.overlap(T.ranking_tokens(F.coalesce("abstract", F.lit(""))), terms),
        "keyword_overlap": 0.15 * T.overlap(own_keywords, asked),
        "recency": 0.15 * recency,
        "citations": 0.10 * cited,
    }
    out = papers.select("*", *(F.round(v, 6).alias(k) for k, v in parts.items()))
    out = out.withColumn("score", F.least(F.round(sum((F.col(k) for k in parts), F.lit(0.0)), 6), F.lit(1.0)))
    out = out.orderBy(F.desc("score"), F.desc(F.coalesce("citation_count", F.lit(0))), F.desc(F.coalesce("year", F.lit(0))), "title")
    return out.limit(limit) if limit is not None else out


#: R-13: arms by name.
ARMS = {"deterministic": lexical, "bm25": bm25, "semantic": semantic, "hybrid": hybrid, "cross_paper": cross_paper}
