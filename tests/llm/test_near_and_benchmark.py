"""Near-dedup, decontamination, license scans: against brute force on small tables."""

import random

import numpy as np
import pytest

from quarryline.llm import components, decontamination, license_scan, near_dedup


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).split(None) if text else []
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    keys = list(sets)
    for n, i in enumerate(keys):
        for j in keys[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {(i, len(sets[i]), root(i), root(i) == i) for i in sets}


def made_up(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    common = [word() for _ in range(60)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\ttwo"), (6, "one two three"), (7, "x " * 3000)]
    n = 10
    for _ in range(40):  # texts that share a long passage, alike or not
        rows.append((n, " ".join([word() for _ in range(rng.randint(0, 80))] + common)))
        n += 1
    for size in (2, 3, 60):  # groups of copies with more and more words changed
        base = [word() for _ in range(rng.randint(40, 400))]
        for k in range(size):
            copy = list(base)
            for _ in range(k % 25):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
            if k % 7 == 0:
                rows.append((n, "  ".join(copy).upper() if "é" not in " ".join(copy) else "  ".join(copy)))
                n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_brute_force(spark, seed):
    rows = made_up(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS sketch")
    assert {tuple(r) for r in near_dedup.near_components(df.repartition(3)).collect()} == brute_components(rows)


def test_chains_are_one_component(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[8 * k : 8 * k + 100])) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in near_dedup.near_components(df).collect()}
    assert got == brute_components(rows) and len({c for _, _, c, _ in got}) == 1


def test_near_dedup_of_nothing_repeated_rows_and_missing_ids(spark):
    schema = "doc_id long, text string"
    assert near_dedup.near_components(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "q r s t u"), (None, None)], schema)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_components(rows).collect()) == [("1", 2, "1", True), ("1", 2, "1", True), ("None", 0, "None", True), ("None", 1, "None", True)]


def test_connected_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)], "a long, b long")
    assert {tuple(r) for r in components.connected(edges).collect()} == {(k, 1) for k in (1, 2, 3, 7, 8, 9)} | {(20, 20), (21, 20)}


def test_long_texts_are_hashed_like_short_ones(monkeypatch):
    from quarryline.llm import common

    data = np.frombuffer("Ab cd  ef\ngh ij kl mn op qr ".encode() * 20, np.uint8)
    offsets = np.array([0, 7, 7, 200, len(data)])
    whole = common.ByteWords(common.white_space()).hashes(data, offsets)
    monkeypatch.setattr(common, "SEGMENT_BYTES", 16)
    cut = common.ByteWords(common.white_space()).hashes(data, offsets)
    for a, b in zip(whole, cut, strict=True):
        assert (a == b).all()


# --- decontamination ---


def brute_tiling(text, item, least):
    """Greedy string tiling as published: scan for the longest free match, mark it, until none of `least` words is left."""
    a_free, b_free, covered = [True] * len(text), [True] * len(item), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                k = 0
                while i + k < len(text) and j + k < len(item) and text[i + k] == item[j + k] and a_free[i + k] and b_free[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        n, i, j = best
        if n < least:
            return covered
        for k in range(n):
            a_free[i + k] = b_free[j + k] = False
        covered += n


def words(t):
    import re

    return re.findall(r"[a-z0-9]+", (t or "").lower())


def test_tiling_covers_what_brute_force_covers(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 40)))) for k in range(6)]
    texts = []
    for k in range(30):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))]
        w = words(items[k % 6][1])
        cut = rng.randint(0, len(w))
        parts += [" ".join(w[cut:]), "x y", " ".join(w[:cut])]  # passages in another order
        texts.append((k, " ".join(parts)))
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.words_covered for r in decontamination.matches(d, b, coverage=0.0).collect()}
    want = {(i, j): c for i, t in texts for j, s in items if (c := brute_tiling(words(t), words(s), 5))}
    assert got == want


def test_decontamination_cases(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    w = item.split()
    other = " ".join(w[8:]) + ". Then, " + " ".join(w[:8])
    rows = [(1, item.upper()), (2, other), (3, None), (4, ""), (5, "clean text of other words only, nothing more"), (6, "x " * 50_000 + item.replace(" ", "\n-- ")), (7, " ".join(w[:6])), (1, item)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS item_id", "'z' AS coverage")
    b = spark.createDataFrame([(10, item), (11, "too short"), (12, None), (None, "x")], "item_id long, text string")
    # the item of one word is found where it stands whole, but takes out no text
    assert sorted(((r.doc_id, r.item_id, r.n_tiles) for r in decontamination.matches(d, b).collect()), key=str) == [(1, 10, 1), (1, 10, 1), (2, 10, 2), (6, 10, 1), (6, None, 1)]
    assert sorted(r.doc_id for r in decontamination.without_contaminated(d, b.where("item_id IS NULL")).collect()) == [1, 1, 2, 3, 4, 5, 6, 7]
    assert sorted(r.doc_id for r in decontamination.without_contaminated(d, b).collect()) == [3, 4, 5, 7]
    assert decontamination.without_contaminated(d, b).columns == d.columns
    assert decontamination.matches(d, b.limit(0)).count() == 0 and decontamination.matches(d.limit(0), b).count() == 0
    assert decontamination.without_contaminated(d, b.limit(0)).count() == len(rows)


def test_words_that_repeat_cost_no_more_than_others(spark):
    d = spark.createDataFrame([(1, "the " * 100_000), (2, "the " * 8_000 + "end")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "the " * 2_000), (2, "the " * 100_000)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_tiles, r.words_covered) for r in decontamination.matches(d, b, coverage=0.0).collect()}
    assert got == {(1, 1): (1, 2_000), (1, 2): (1, 100_000), (2, 1): (1, 2_000), (2, 2): (1, 8_000)}


def test_short_items_are_matched_whole(spark):
    d = spark.createDataFrame([(1, "Who wrote, Hamlet? nobody"), (2, "who wrote it, hamlet"), (None, "they asked who wrote hamlet")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "who wrote Hamlet"), (1, "who wrote Hamlet"), (2, "hamlet")], "item_id long, text string")
    assert sorted(((r.doc_id, r.item_id) for r in decontamination.matches(d, b).collect()), key=str) == sorted([(1, 1), (1, 2), (2, 2), (None, 1), (None, 2)], key=str)
    assert [r.doc_id for r in decontamination.without_contaminated(d, b).collect()] == [2]


def test_tiles_are_those_of_brute_force():
    rng = random.Random(1)
    hashed = lambda x: np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(12345)
    for _ in range(200):
        v = rng.randint(1, 6)
        t, i = ([rng.randrange(v) for _ in range(rng.randint(0, n))] for n in (60, 40))
        t += [9, *i[len(i) // 2 :], 9, *i[: len(i) // 2]]
        assert sum(x[2] for x in decontamination.tiles(hashed(t), hashed(i), 5)) == brute_tiling(t, i, 5)


def test_items_without_an_id_are_searched(spark):
    passage = "seven grey herons stood along the river bank and watched the slow barges go by"
    docs = spark.createDataFrame([(1, f"before it {passage} after it"), (2, "nothing of the kind is in this text at all")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage), (None, None), (7, "an item that none of the documents has any words of")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.coverage) for r in decontamination.matches(docs, items).collect()] == [(1, None, 1.0)]
    assert [r.doc_id for r in decontamination.without_contaminated(docs, items).collect()] == [2]


# --- licenses ---


def brute_licenses(text):
    w = words_utf8(text)
    have = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    out = set()
    for name, t in license_scan.TEMPLATES.items():
        tw = words_utf8(t)
        s = {tuple(tw[i : i + 3]) for i in range(len(tw) - 2)}
        if s <= have:
            out.add(name)
    return out


def held_share(text, template):
    three = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    wanted = three(words_utf8(template))
    return len(wanted & three(words_utf8(text))) / len(wanted)


def words_utf8(t):
    import re

    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())


def test_licenses_that_stand_whole_are_found(spark):
    rng = random.Random(3)
    noise = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(n))
    rows = [(0, None), (1, ""), (2, "MIT"), (3, noise(500))]
    for k, t in enumerate(license_scan.TEMPLATES.values()):
        for n in (0, 1, 7, 300, 5000):
            rows.append((100 * k + n + 10_000, f"{noise(n)} {t.upper() if n % 2 else t} {noise(n)}"))
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS license")
    got = {}
    for r in license_scan.scan(d.repartition(3)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    for i, t in rows:
        assert brute_licenses(t) <= got.get(i, set()), i
    assert not got.keys() & {0, 1, 2, 3}
    assert license_scan.scan(d.limit(0)).count() == 0
    for i, names in got.items():  # the other way: what is reported is there, but for at most a fifth of its shingles
        assert all(max(held_share(t, license_scan.TEMPLATES[n]) for j, t in rows if j == i) >= license_scan.CONTAINMENT for n in names), i


def test_licenses_of_the_small_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {(r.doc_id, r.license) for r in license_scan.op8_license_scan(spark, sf_dir).collect()}
    assert {(i, n) for i, t in texts.items() for n in brute_licenses(t)} <= got
    assert got and all(held_share(texts[i], license_scan.TEMPLATES[n]) >= license_scan.CONTAINMENT for i, n in got)
    doubled = spark.createDataFrame([(1, license_scan.TEMPLATES["MIT/notice"])] * 2, "doc_id long, text string")
    assert [r.n_matches for r in license_scan.scan(doubled).collect()] == [1, 1]


def test_licenses_with_words_put_in_are_found_at_every_place(spark):
    rows, expected = [], {}
    for name, inserted in (("ISC/text", 16), ("ISC/text", 30), ("BSD-2-Clause/text", 30)):
        t = license_scan.TEMPLATES[name].split()
        for before in range(64):
            words = [f"a{i}" for i in range(before)] + t[: len(t) // 2] + [f"b{i}" for i in range(inserted)] + t[len(t) // 2 :] + [f"c{i}" for i in range(150)]
            expected[len(rows)] = name
            rows.append((len(rows), " ".join(words)))
    got = {(r.doc_id, r.license): r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not [i for i, name in expected.items() if (i, name) not in got]
    assert all(got[i, name].containment > 0.9 and got[i, name].n_matches == 1 for i, name in expected.items())


def test_two_copies_count_twice(spark):
    t = license_scan.TEMPLATES["MIT/notice"]
    d = spark.createDataFrame([(1, t + " filler" * 50 + " " + t)], "doc_id long, text string")
    assert [(r.license, r.n_matches) for r in license_scan.scan(d).collect()] == [("MIT/notice", 2)]


def test_few_links_cost_few_files(spark, monkeypatch):
    rows, files, keep = made_up(5), [], {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keep}

    def counted(df, name="step", write=near_dedup.written):
        out = write(df, name)
        files.append((name, len(out.inputFiles())))
        return out

    for module in (near_dedup, components):
        monkeypatch.setattr(module, "written", counted)
    try:
        for k, v in keep.items():
            spark.conf.set(k, v)
        out = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(4))
        assert {tuple(r) for r in out.collect()} == brute_components(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # only the pairs of still open lists, whose number isn't known beforehand, may have a file for each shuffle partition
    assert sum(n > spark.sparkContext.defaultParallelism for _, n in files) <= 1
    # links are judged once, and stars are not gone over again
    assert len(files) < 80
