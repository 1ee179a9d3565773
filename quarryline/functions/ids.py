"""Deterministic identities (inventory 1.5) as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.text import collapse, title_key

CLAIM_LIKE = ("result", "limitation", "future_work")


def doi(c: Column) -> Column:
    """Without URL or scheme prefix, lower case; null when nothing is left."""
    out = F.regexp_replace(F.lower(F.trim(c)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    return F.when(out != "", out)


def arxiv(c: Column) -> Column:
    """Without URL, scheme, `.pdf` and version."""
    out = F.regexp_replace(F.lower(F.trim(c)), r"^(?:https?://arxiv\.org/(?:abs|pdf)/|arxiv:\s*)", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\.pdf$", ""), r"v\d+$", "")
    return F.when(out != "", out)


def slug(c: Column, most: int) -> Column:
    words = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    return F.substring(words, 1, most)


def paper_id(identifiers: Column, provider: Column, title: Column) -> Column:
    """First identifier that is known, else a hash of the title."""
    known = [("doi", "doi:"), ("arxiv_id", "arxiv:"), ("pubmed_id", "pmid:"), ("openalex_id", "openalex:"), ("semantic_scholar_id", "s2:")]
    return F.coalesce(*(F.concat(F.lit(p), identifiers[f]) for f, p in known), F.concat(provider, F.lit(":"), F.substring(F.sha1(title_key(title)), 1, 16)))


def storage_key(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", ""), 1, 180)


def knowledge_id(paper: Column, kind: Column, name: Column, index: Column) -> Column:
    return F.concat(paper, F.lit("#"), kind, F.lit(":"), slug(name, 48), F.lit(":"), index.cast("string"))


def content_hash(paper: Column, section: Column, paragraph: Column, quote: Column) -> Column:
    """Null parts count as the word None."""
    parts = [F.coalesce(x.cast("string"), F.lit("None")) for x in (paper, section, paragraph)]
    return F.substring(F.sha1(F.concat_ws("|", *parts, F.lower(collapse(quote)))), 1, 20)


def bundle_id(question: Column, text: Column, kinds: Column, papers: Column) -> Column:
    key = F.concat_ws("|", F.coalesce(question, F.lit("")), text, F.array_join(F.array_sort(kinds), ","), F.array_join(F.array_sort(papers), ","))
    return F.concat(F.lit("bundle:"), F.coalesce(question, F.lit("query")), F.lit(":"), F.substring(F.sha1(key), 1, 16))


def node_id(kind: Column, name: Column, paper: Column) -> Column:
    """Claim-like kinds are scoped to their paper, others are shared by name."""
    own = kind.isin(*CLAIM_LIKE)
    scope = F.when(own, F.concat_ws("|", paper, F.lower(name))).otherwise(F.lower(name))
    return F.when(kind == "paper", F.concat(F.lit("paper:"), paper)).otherwise(F.concat_ws(":", kind, F.when(own, paper), slug(name, 60), F.substring(F.sha1(scope), 1, 10)))


def edge_id(source: Column, kind: Column, target: Column) -> Column:
    return F.concat_ws("--", source, kind, target)


def graph_fingerprint(papers: Column, n_objects: Column) -> Column:
    """Of a generation: its papers, sorted, and the number of its objects."""
    return F.substring(F.sha1(F.concat(F.array_join(F.array_sort(papers), "|"), F.lit("#"), n_objects.cast("string"))), 1, 12)


def graph_version(schema: int, extraction: int, relation: int, fingerprint: Column) -> Column:
    return F.concat(F.lit(f"s{schema}-x{extraction}-r{relation}-c"), fingerprint)


def model_fingerprint(provider: str, model: str, dimension: int, preparation: int) -> str:
    return f"{provider}/{model}/d{dimension}/p{preparation}"


def index_version(schema: int, model: str, dimension: int, representation: int) -> str:
    return f"{schema}-{model.replace(':', '_').replace('/', '_')}-d{dimension}-r{representation}"
