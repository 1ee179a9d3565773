"""Operator 7, URL filters: a weighted vocabulary searched by Aho-Corasick, beside explicit host and path rules.

Each term has a weight: strict ones that of a rejection, soft ones a share of it. A hit counts only between boundaries
(no ASCII letter or digit on either side), and once a term. A URL is rejected if its distinct hits weigh REJECT or more:
one strict term does it, and so do 1 / SOFT distinct soft ones. An explicit rule, where one fits, goes before the
vocabulary. The automaton is built once for each worker.

Cases: a null URL, or one without `://`, has an empty host and path, so no rule fits it; a null or empty URL has no
hits and is allowed; very long URLs are read whole; repeated rows and ties are judged alike; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Weights: from REJECT on a URL is rejected.
REJECT, SOFT = 1.0, 0.5
#: Terms that reject alone.
STRICT_TERMS = (
    "adult", "adultery", "bdsm", "blackjack", "blowjob", "botnet", "camgirls", "camsex", "casino", "cialis", "cracked", "creampie", "cumshot", "escort", "escorts", "exploitkit", "fetish", "gangbang", "hardcore",
    "hentai", "honeypot", "incest", "jailbait", "keylogger", "levitra", "malware", "milf", "nudes", "onlinecasino", "phishing", "porn", "porno", "pornhub", "pornstar", "ransomware", "roulette", "sexcam", "sexchat", "sexshop",
    "slots", "spam", "sportsbook", "spyware", "striptease", "tramadol", "trojan", "viagra", "warez", "xanax", "xnxx", "xvideos", "xxx",
)
#: Terms that several together reject.
SOFT_TERMS = (
    "ads", "advert", "affiliate", "babes", "banner", "bet", "bets", "betting", "bingo", "bonus", "cam", "cams", "cash", "cheap", "cheat", "click", "clickbait", "coupon", "crack", "crypto",
    "dating", "deal", "deals", "discount", "doubleclick", "erotic", "farm", "forex", "free", "gamble", "gambling", "generic", "girls", "hack", "hookup", "hot", "instant", "jackpot", "keygen", "lingerie",
    "loan", "loans", "lottery", "lotto", "miracle", "nude", "odds", "payday", "pharma", "pharmacy", "pill", "pills", "pirate", "poker", "popup", "prize", "promo", "rx", "sale", "seo",
    "serial", "sex", "sexy", "singles", "slimming", "spin", "sponsored", "teen", "tits", "torrent", "torrents", "track", "tracker", "tracking", "traffic", "webcam", "weightloss", "win", "winner", "winners",
)
VOCABULARY = {**dict.fromkeys(STRICT_TERMS, REJECT), **dict.fromkeys(SOFT_TERMS, SOFT)}
#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


@lru_cache(maxsize=8)
def automaton(terms: tuple[str, ...]):
    """Finds (number of the term, its length) for each occurrence."""
    import ahocorasick

    finder = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        finder.add_word(term, (i, len(term)))
    finder.make_automaton()
    return finder


def boundary_hits(urls: Iterable[str | None], terms: tuple[str, ...]) -> Iterator[set[int]]:
    """For each URL the numbers of the distinct terms that stand between boundaries."""
    finder, word, fold = automaton(terms), frozenset(LOWER + "0123456789"), str.maketrans(UPPER, LOWER)
    for url in urls:
        text = (url or "").translate(fold)
        yield {i for end, (i, n) in finder.iter(text) if (end - n < 0 or text[end - n] not in word) and (end + 1 == len(text) or text[end + 1] not in word)}


def judge(pages: DataFrame, rules=RULES, vocabulary: dict[str, float] = VOCABULARY, url_col: str = "url") -> DataFrame:
    """page_id and the URL with host, path, rule, n_strict, n_soft (distinct terms), weight and verdict."""
    terms = tuple(t for t, w in vocabulary.items() if w > 0)
    weights = [float(vocabulary[t]) for t in terms]

    @F.pandas_udf("n_strict int, n_soft int, weight double")
    def hits(urls: pd.Series) -> pd.DataFrame:
        found = [[weights[i] for i in sorted(seen)] for seen in boundary_hits(urls, terms)]
        return pd.DataFrame([(sum(w >= REJECT for w in f), sum(w < REJECT for w in f), float(sum(f))) for f in found], columns=["n_strict", "n_soft", "weight"])

    url = F.col(url_col)
    after = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.translate(F.regexp_extract(url, after, 1), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, after, 2), F.lit(""))
    out = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"), hits(url).alias("hits"))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, ruled = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    by_terms = F.when(F.col("hits.weight") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "url", "host", "path", rule.alias("rule"), F.col("hits.n_strict").alias("n_strict"), F.col("hits.n_soft").alias("n_soft"), F.col("hits.weight").alias("weight"), F.coalesce(ruled, by_terms).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: page_id, host, path, rule, verdict, n_strict, n_soft."""
    return judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def _count_sql(terms: Sequence[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"CAST(len(list_intersect([{listed}], list_distinct(regexp_split_to_array(u, '[^a-z0-9]')))) AS INT)"


def _rules_sql(pick) -> str:
    fits = "WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}'"
    return "CASE " + " ".join(fits.format(h=h, p=p, v=pick(v, h, p)) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"


SQL = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), c AS (SELECT *, {_count_sql(STRICT_TERMS)} AS n_strict, {_count_sql(SOFT_TERMS)} AS n_soft FROM p)
SELECT page_id, host, path, {_rules_sql(lambda v, h, p: h + p)} AS rule, n_strict, n_soft,
  coalesce({_rules_sql(lambda v, h, p: v)}, CASE WHEN n_strict * {REJECT} + n_soft * {SOFT} >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict FROM c
"""
