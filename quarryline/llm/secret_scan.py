"""Operator 1, secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model describes random strings, the other ordinary identifiers; both are first-order chains over letters, digits
and `+_=-/`, trained from labelled samples. A long run of such characters that no pattern covers is a secret if its mean
log-likelihood ratio reaches the threshold. Everything that runs over the documents is DataFrame code; the table of
ratios is a literal of fixed size.

Patterns, leftmost and without overlap within a kind; spans are of the whole match, in code points, end exclusive:
- assign: a keyword in either case, an optional quote, `:` or `=`, an optional quote, a value of 6 characters or more;
- access: `AKIA` and capitals or digits, 20 characters or more;
- hex: 24 or more of 0-9 and a-f;
- markov: what the models add, runs of 20 characters or more of at least two of the classes lower, upper and digit,
  not overlapping any of the above. Keys in standard base 64 have slashes, and so have paths with a key in them: a run
  with its slashes comes first, and where it isn't a secret as a whole, the runs between its slashes.

Cases: null and empty texts have no spans (the hash is of the empty string); a value that is too short is dropped after
it has been matched, so it still uses up its place; repeated rows get equal results; an empty table gives an empty
result; extra columns are not read; the number of spans in a text has no limit.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import let, read_table, text_of

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short has no longer run inside, so for these two the least length can be part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+_=-/"
RUN = r"(?<![A-Za-z0-9+_=/-])[A-Za-z0-9+_=/-]{20,}+"
PIECE = r"(?<![A-Za-z0-9+_=-])[A-Za-z0-9+_=-]{20,}+"
#: Mean log-likelihood ratio per character pair, in hundredths, from which a run counts as random.
THRESHOLD = 40


def random_samples(n: int = 3000) -> list[str]:
    """Labelled 1: strings as key generators make them, from hashes of a counter: base 64 of either form, base 62, lower case and digits."""
    out = []
    for i in range(n):
        raw = hashlib.sha512(f"sample {i}".encode()).digest()
        letters = (ALPHABET[:62], ALPHABET[26:62], ALPHABET[:66], ALPHABET[:62] + "+/")[i % 4]
        out.append("".join(letters[b % len(letters)] for b in raw[: 20 + i % 44]))
    return out


#: Words that programmers put names together from.
WORDS = (
    "abstract", "accept", "access", "account", "action", "add", "address", "after", "all", "append", "application", "apply", "argument", "array", "assert", "async", "attribute", "await", "base", "batch",
    "before", "begin", "body", "bool", "break", "buffer", "builder", "button", "byte", "cache", "call", "cancel", "card", "case", "catch", "channel", "char", "check", "child", "class",
    "client", "close", "code", "collection", "column", "command", "commit", "common", "compare", "compile", "component", "config", "connection", "constant", "container", "content", "context", "continue", "controller", "copy",
    "count", "create", "current", "customer", "data", "date", "debug", "decode", "default", "delete", "description", "dictionary", "directory", "disable", "document", "double", "download", "element", "enable", "encode",
    "endpoint", "entity", "enumerate", "error", "event", "exception", "execute", "export", "factory", "field", "file", "filter", "finally", "float", "folder", "format", "frame", "function", "generate", "get",
    "global", "group", "handler", "hash", "header", "height", "identifier", "image", "import", "index", "init", "input", "instance", "integer", "interface", "internal", "item", "iterator", "join", "json",
    "kernel", "language", "length", "level", "library", "limit", "list", "load", "local", "lock", "logger", "lookup", "main", "manager", "map", "maximum", "memory", "message", "method", "minimum",
    "model", "module", "name", "network", "next", "node", "number", "object", "offset", "open", "option", "order", "output", "package", "page", "parameter", "parent", "parse", "path", "pattern",
    "payment", "port", "position", "previous", "print", "process", "product", "property", "provider", "public", "query", "queue", "quick", "random", "range", "read", "record", "request", "response", "result",
    "return", "root", "row", "schedule", "schema", "search", "select", "service", "session", "size", "source", "status", "string", "system", "thread", "update", "user", "value", "version", "window",
)


def ordinary_samples() -> list[str]:
    """Labelled 0: names as programmers make them from common words, alone and joined as identifiers and paths are."""
    names = list(WORDS)
    words = names + names[::-1] + names[::3] + names[1::3] + names[2::3]
    joined = []
    for i in range(len(words) - 2):
        a, b, c = words[i], words[(i * 7 + 3) % len(words)], words[(i * 13 + 5) % len(words)]
        joined += [f"{a}_{b}_{c}", f"{a}-{b}-{c}", a + b.capitalize() + c.capitalize(), f"{a}_{b}_{i % 100}", a + b + c, f"{a}_{b}_{c}".upper(), (a + b + c).capitalize()]
        joined += [f"{a}/{b}/{c}", f"/{a}/{b}_{c}/{i % 100}", f"{a}/{b.capitalize()}{c.capitalize()}/{a.capitalize()}", f"/{2000 + i % 30}/{1 + i % 12:02}/{a}-{b}-{c}"]
    return names + joined


def train(random: Iterable[str], ordinary: Iterable[str], smoothing: float = 0.5) -> list[int]:
    """log P(b | a, random) - log P(b | a, ordinary) in hundredths, for every pair of characters, row by row."""
    size = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    tables = []
    for sample in (random, ordinary):
        t = [[smoothing] * size for _ in range(size)]
        for s in sample:
            for a, b in zip(s, s[1:], strict=False):
                if a in place and b in place:
                    t[place[a]][place[b]] += 1
        tables.append([[math.log(x / sum(row)) for x in row] for row in t])
    return [round(100 * (x - y)) for r, o in zip(*tables, strict=True) for x, y in zip(r, o, strict=True)]


def _code(c: Column) -> Column:
    """Place of an ASCII character in the alphabet."""
    a = F.ascii(c)
    return (
        F.when(a.between(65, 90), a - 65)
        .when(a.between(97, 122), a - 71)
        .when(a.between(48, 57), a + 4)
        .otherwise(F.when(c == "+", 62).when(c == "_", 63).when(c == "=", 64).when(c == "-", 65).otherwise(66))
    )


def ratio(run: Column, table: list[int]) -> Column:
    """Mean ratio of a run of alphabet characters, in hundredths."""
    ratios = F.from_json(F.lit(str(table)), "array<int>")
    codes = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), _code)
    pairs = F.zip_with(F.slice(codes, 1, F.length(run) - 1), F.slice(codes, 2, F.length(run) - 1), lambda a, b: F.get(ratios, a * len(ALPHABET) + b))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x) / (F.length(run) - 1)


#: Spans whose places are summed up in one go; longer lists are summed block by block, so the work stays in proportion.
_BLOCK = 512


def placed(text: Column, pattern: str, found: Column) -> Column:
    """(start, end, hit) of each match in `found`, all matches of `pattern` in `text`: the gaps between them add up.

    What several steps use is bound with `let`, so the text is split once and not again for each block.
    """
    zero, kind = F.lit(0).cast("long"), "array<struct<start:bigint,end:bigint,hit:string>>"

    def sized(gaps: Column) -> Column:
        return F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), m.alias("hit")))

    def in_blocks(sizes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")), lambda b: F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK)))

    def walk(b: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), F.array().cast(kind).alias("out"))
        step = lambda s, x: F.struct((s["at"] + x.gap + x.size).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x.gap).alias("start"), (s["at"] + x.gap + x.size).alias("end"), x.hit.alias("hit")))).alias("out"))
        return F.aggregate(b, first, step)["out"]

    def walked(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, x: s + x.gap + x.size))
        starts = F.aggregate(totals, F.array(zero), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), walk))

    spans = let(sized(F.split(text, pattern, -1)), lambda sizes: let(in_blocks(sizes), walked))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(kind))


def apart(spans: Column, others: Column) -> Column:
    """The spans, sorted and without overlap among themselves, that overlap none of the others.

    As many others overlap a span as begin before its end less those that end by its start. Both counts are read off a
    sorted list of places, so the work grows with the number of spans and not with its square.
    """

    def before(place, other, tie: int) -> Column:
        """For each span, how many of the others' places come before its own; `tie`: whether equal ones do."""
        own = F.transform(spans, lambda x: F.struct(place(x).alias("at"), F.lit(tie).alias("tag")))
        events = F.array_sort(F.concat(own, F.transform(others, lambda y: F.struct(other(y).alias("at"), F.lit(1 - tie).alias("tag")))))
        held = F.filter(F.transform(events, lambda e, i: F.struct(e["tag"].alias("tag"), i.alias("i"))), lambda e: e["tag"] == tie)
        return F.transform(held, lambda e, j: e["i"] - j)

    begun, over = before(lambda x: x.end, lambda y: y.start, 0), before(lambda x: x.start, lambda y: y.end, 1)
    judged = F.arrays_zip(spans.alias("span"), begun.alias("begun"), over.alias("over"))
    free = F.transform(F.filter(judged, lambda z: z["begun"] == z["over"]), lambda z: z["span"])
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), free).otherwise(spans)


def spans_of(docs: DataFrame, table: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id and the spans of each kind: assign, access, hex and markov, arrays of (start, end, hit)."""
    table = table or train(random_samples(), ordinary_samples())
    t = F.col("t")
    found = docs.select(F.col(id_col).alias("doc_id"), text_of(docs, text_col).alias("t"))
    found = found.select(
        "doc_id", "t",
        F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(0)).alias("m_assign"),
        F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)).alias("m_access"),
        F.regexp_extract_all(t, F.lit(HEX), F.lit(0)).alias("m_hex"),
        F.regexp_extract_all(t, F.lit(RUN), F.lit(0)).alias("m_runs"),
        F.regexp_extract_all(t, F.lit(PIECE), F.lit(0)).alias("m_pieces"),
    )
    mixed = lambda r: (F.when(r.rlike("[a-z]"), 1).otherwise(0) + F.when(r.rlike("[A-Z]"), 1).otherwise(0) + F.when(r.rlike("[0-9]"), 1).otherwise(0)) >= 2
    random = lambda x: F.when(mixed(x.hit), ratio(x.hit, table) >= threshold).otherwise(F.lit(False))
    places = found.select("doc_id", *(placed(t, p, F.col(m)).alias(m[2:]) for m, p in (("m_assign", ASSIGN), ("m_access", ACCESS), ("m_hex", HEX), ("m_runs", RUN), ("m_pieces", PIECE))))
    value = F.regexp_extract
    long_enough = lambda x: F.length(value(x.hit, ASSIGN, 1)) >= 6
    kept = places.select("doc_id", F.filter("assign", long_enough).alias("assign"), "access", "hex", F.filter("runs", random).alias("runs"), F.filter("pieces", random).alias("pieces"))
    base = F.concat("assign", "access", "hex")
    found = kept.select("doc_id", "assign", "access", "hex", apart(F.col("runs"), base).alias("runs"), apart(F.col("pieces"), base).alias("pieces"))
    return found.select("doc_id", "assign", "access", "hex", F.array_sort(F.concat("runs", apart(F.col("pieces"), F.col("runs")))).alias("markov"))


def joined(*kinds: tuple[str, str]) -> Column:
    """kind:start:end of the spans in the named columns, by start, then kind as listed, joined by commas."""

    def said(i: int, kind: str):
        return lambda x: F.struct(x.start.alias("start"), F.lit(i).alias("order"), F.concat_ws(":", F.lit(kind), x.start, x.end).alias("said"))

    every = F.concat(*(F.transform(c, said(i, k)) for i, (k, c) in enumerate(kinds)))
    return F.array_join(F.transform(F.array_sort(every), lambda x: x.said), ",")


KINDS = (("assign", "assign"), ("access", "access"), ("hex", "hex"), ("markov", "markov"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    s = spans_of(read_table(spark, sf_dir, "documents"))
    counts = [F.size(c).cast("long").alias(f"n_{k}") for k, c in KINDS]
    return s.select("doc_id", *counts, F.sha2(joined(*KINDS[:3]), 256).alias("base_sha256"), joined(*KINDS).alias("spans"))
