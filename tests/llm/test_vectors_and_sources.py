"""Vector codes, vector near-dedup and the source audit against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.oracle import spark_rows, sql_rows

from quarryline.llm import source_audit, vector_codes, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


# --- operator 11 --------------------------------------------------------------------------------------------------


def lloyd(rows):
    """The contract, in Python integers: rows are (vec_id, vector, label), all usable and of one length."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    width = len(rows[0][1]) // 4
    parts = [[[int(np.floor(1024 * np.float64(np.float32(x)))) for x in v[p * width : (p + 1) * width]] for _, v, _ in rows] for p in range(4)]
    books = [[list(x) for x in parts[p][:256]] for p in range(4)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p])) for x in parts[p]] for p in range(4)]

    for _ in range(4):
        for p, found in enumerate(assign()):
            for e in range(len(books[p])):
                own = [x for x, (_, f) in zip(parts[p], found, strict=True) if f == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = assign()
    errors = [sum(last[p][i][0] for p in range(4)) for i in range(len(rows))]
    by_label = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for p in range(4) for c in books[p] for x in c).encode()).hexdigest()
    return sorted((r[0], "".join(f"{last[p][i][1]:02x}" for p in range(4)), errors[i], by_label[r[2]], sha) for i, r in enumerate(rows))


@pytest.mark.parametrize("n", [3, 600])
def test_vector_codes_equal_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=16) * 0.3 + (i % 7))], None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(n)]
    rows += [(n, rows[0][1], 1), (n + 1, rows[0][1], 1)]  # equal vectors
    odd = [(n + 2, None, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [float("inf")] + [0.0] * 15, 1), (n + 5, [None] + [0.0] * 15, 1)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows + odd], SCHEMA + ", code string, error int").repartition(3)
    got = sorted(tuple(r) for r in vector_codes.compressed(df).collect())
    assert got == lloyd(rows)


def test_vector_codes_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vector_codes.compressed(none).collect() == []
    assert vector_codes.compressed(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
    rows = [(1, [], 1), (1, [1.0, 2.0, 3.0], 1), (None, [1e30, -1e30, 0.0, 1.0, 5.0], None)]
    got = vector_codes.compressed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3 and all(r.error == 0 for r in got) and got[0].codebooks_sha256 == got[2].codebooks_sha256


def test_rounds_shuffle_changes_only(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(2000)], SCHEMA)
    x, width = vector_codes.integers(rows)
    state, books = vector_codes.learned(rows, 3)
    again = vector_codes.assigned(state, books)  # nothing moves under the same codebooks
    assert vector_codes.changes(again.select("vec_id", "label", "x", "code", "before"), width).count() == 0
    moved = vector_codes.changes(state, width).collect()
    assert sum(r.n for r in moved) == 0 and sum(sum(r.sums) for r in moved) == 0
    parts = state.where("code <> before").count()
    assert 0 < parts < 2000


def test_nearest_is_exact_for_large_components():
    rng = np.random.default_rng(1)
    x, book = rng.integers(-(1 << 24), 1 << 24, (50, 300)), rng.integers(-(1 << 24), 1 << 24, (9, 300))
    index, distance = vector_codes.nearest(x, book)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)), e) for e, c in enumerate(book)) for r in x]
    assert [(int(d), int(i)) for i, d in zip(index, distance, strict=True)] == want


# --- operator 12 --------------------------------------------------------------------------------------------------


def linked(rows, least=0.98):
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    unit = {i: np.ldexp(np.float64(np.float32(rows[i][1])), -np.frexp(np.abs(np.float32(rows[i][1])).max())[1]) for i in ok}
    groups = defaultdict(list)
    for i in ok:
        groups[rows[i][2], len(rows[i][1])].append(i)
    for own in groups.values():
        m = np.stack([unit[i] / np.linalg.norm(unit[i]) for i in own])
        for a, b in zip(*np.nonzero(m @ m.T >= least), strict=True):
            if a != b:
                links[own[a]].add(own[b])
    comp = {}
    for i in range(len(rows)):
        if i not in comp:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            comp |= dict.fromkeys(seen, min(ids) if ids else None)
    return sorted(((r[0], len(links[i]), comp[i], r[0] == comp[i]) for i, r in enumerate(rows)), key=repr)


def planted(rng, dims=24):
    """A dense group that no window holds, chains, copies, pairs at the threshold, and what links with nothing."""
    rows, base = [], rng.normal(size=dims)
    rows += [base + rng.normal(size=dims) * 0.06 for _ in range(400)]
    step = rng.normal(size=dims)
    rows += [rng.normal(size=dims) * 0 + base * -1 + step * 0.12 * k for k in range(30)]
    rows += [np.full(dims, 0.5)] * 150
    for _ in range(60):
        v = rng.normal(size=dims)
        rows += [v, v + rng.normal(size=dims) * 0.19 * np.linalg.norm(v) / np.sqrt(dims)]
    rows += [rng.normal(size=dims) for _ in range(300)]
    out = [(int(i), [float(x) for x in np.float32(v)], int(i % 2) if k >= 580 else 3) for (k, v), i in zip(enumerate(rows), rng.permutation(len(rows)) + 10, strict=True)]
    n = len(out) + 50
    out += [(n, [0.0] * dims, 3), (n + 1, None, 3), (n + 2, [None] * dims, 3), (n + 3, [float("nan")] * dims, 3), (n + 4, [], 3), (n + 5, out[0][1], None)]
    out += [(n + 6, [1e30, 1e30], 1), (n + 7, [1e-30, 1e-30], 1), (n + 7, [1e-30, 1e-30], 1), (None, out[0][1], 3), (None, [3.0, 1.0, 9.0], 8)]
    return out


@pytest.mark.parametrize("partitions", ["4", "40"])
def test_vector_links_equal_brute_force(spark, partitions):
    rows = planted(np.random.default_rng(7))
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], SCHEMA + ", id int, v string").repartition(5)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted((tuple(r) for r in vector_dedup.linked(df, window=8 if partitions == "40" else 64).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert got == linked(rows)


def test_vector_links_of_nothing(spark):
    assert vector_dedup.linked(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in vector_dedup.linked(spark.createDataFrame([(4, None, 1)], SCHEMA)).collect()] == [(4, 0, 4, True)]


def test_passes_grow_with_the_table():
    assert [vector_dedup.passes_for(n) for n in (0, 64, 10_000)] == [8, 8, 11] and vector_dedup.passes_for(10**9) > 30


def test_recall_of_pairs_at_the_threshold(spark):
    """Every pair stands alone, just above the threshold, among many vectors: nothing but the passes can find it."""
    rng, rows, n = np.random.default_rng(3), [], 3000
    for i in range(n):
        v = rng.normal(size=64)
        v /= np.linalg.norm(v)
        o = rng.normal(size=64)
        o -= (o @ v) * v
        c = rng.uniform(0.9801, 0.985)
        rows += [(2 * i, v.tolist(), 0), (2 * i + 1, (c * v + np.sqrt(1 - c * c) * o / np.linalg.norm(o)).tolist(), 0)]
    got = {r.vec_id: r for r in vector_dedup.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(8)).collect()}
    queries = [i for i in got if i % 20 == 0]
    hit = sum(got[i].n_links == 1 and got[i + 1].component_id == i for i in queries)
    assert hit >= 0.99 * len(queries) and all(r.n_links <= 1 for r in got.values())


# --- operator 13 --------------------------------------------------------------------------------------------------


def audit(rows):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = [re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", t.translate(lower)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(r[2], t) for r, t in zip(rows, terms, strict=True) if r[1] == lang]
        docs = Counter(w for _, t in own for w in set(t))
        kept = {w for w in docs if docs[w] >= 3}
        counts = {s: Counter() for s, _ in own}
        for s, t in own:
            counts[s].update(w for w in t if w in kept)
        p = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        ps, q = {s: p(c) for s, c in counts.items()}, p(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(sum(f(ps[s][w], ps[o][w]) for w in kept), o) for o in counts if o != s]
            best = [(f(ps[s][w], q[w]), w) for w in kept if counts[s][w] and ps[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", best)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < 200]
    return sorted(out)


@pytest.mark.parametrize("most", [5, source_audit.HELD])
def test_source_audit_equals_brute_force(spark, most):
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in ("Wort", "été", "Ä", "x", "Żó") for b in "abcdefghijkl"] + ["İst", "K", "ſ"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 40))) + "-A_b1c", ["de", "fr", None][int(rng.integers(3))], [f"s{rng.integers(4)}", None][int(rng.integers(5) == 0)]) for _ in range(120)]
    rows += [(None, "de", "only nulls"), ("", "en", "a"), ("one two", "en", "b"), ("1 2 3", "it", "z"), ("uno dos uno", "es", "x"), ("uno dos", "es", "x"), ("dos uno", "es", "x"), ("A " * 700_000 + "zz", "de", "s1")]
    df = spark.createDataFrame([(*r, i, "t", 5) for i, r in enumerate(rows)], "text string, lang string, source string, doc_id long, term string, n int").repartition(3)
    got = sorted(tuple(r) for r in source_audit.audited(df, most=most).collect())
    assert got == audit(rows)


def test_source_audit_of_nothing(spark):
    assert source_audit.audited(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
    assert source_audit.audited(spark.createDataFrame([(None, None, None)], "text string, lang string, source string")).collect() == []


@pytest.mark.parametrize("query, sql", [(vector_codes.op11_vector_codes, vector_codes.SQL), (vector_dedup.op12_vector_near_dedup, vector_dedup.SQL), (source_audit.op13_source_divergence, source_audit.SQL)])
def test_sql(spark, sf_dir, query, sql):
    assert spark_rows(query(spark, sf_dir)) == sql_rows(sql, sf_dir)
