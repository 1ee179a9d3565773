"""The text functions of the engine as DuckDB SQL, for the oracle."""

from __future__ import annotations

from quarryline.functions.text import STOPWORDS

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def norm(c: str) -> str:
    return rf"""lower(trim(regexp_replace(regexp_replace(translate({c}, '“”‘’­‐‑', '""''''---'), '([\p{{L}}\p{{N}}_])-\s+([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '\s+', ' ', 'g')))"""


def toks(c: str) -> str:
    return f"list_distinct(list_filter(string_split({norm(c)}, ' '), lambda w: length(w) > 2 AND w NOT IN ({STOP})))"


def over(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len({b}) ELSE 0.0::DOUBLE END"
