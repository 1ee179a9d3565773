"""Exact dedup, URL filters, language ID."""

import hashlib
import re

import pytest

from quarryline.llm import exact_dedup, language_id, url_filter


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{extra}")


def brute_dedup(rows):
    groups = {}
    for i, t in rows:
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
        groups.setdefault(key, []).append((-len(t or ""), i))
    return {(i, min(g)[1], len(g), i == min(g)[1], k) for k, g in groups.items() for _, i in g}


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n"), (7, "é\x0bß"), (8, "éß"), (9, "AB"), (10, "x" * 200_000)]


def test_exact_dedup_is_the_brute_force_result(spark):
    found = exact_dedup.ingest(docs(spark, ROWS), exact_dedup.DigestIndex.create(spark))
    assert {tuple(r) for r in found.collect()} == brute_dedup(ROWS)


def test_exact_dedup_keeps_what_came_first_over_batches(spark):
    index = exact_dedup.DigestIndex.create(spark, buckets=4)
    exact_dedup.ingest(docs(spark, [(1, "a b"), (2, "c")]), index).collect()
    second = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.ingest(docs(spark, [(3, "a    b"), (4, "d"), (5, "d")]), index).collect()}
    assert second == {3: (1, False), 4: (4, True), 5: (4, False)}
    again = exact_dedup.DigestIndex.open(spark, index.path, buckets=4)
    assert again.read().count() == 3
    assert {r.doc_id: r.keep_id for r in exact_dedup.ingest(docs(spark, [(9, "d")]), again).collect()} == {9: 4}


def test_exact_dedup_reads_no_clashing_columns_and_takes_empty_tables(spark):
    odd = docs(spark, [(1, "a", "z", 5), (2, "a", "z", 6)], ", digest string, n_points long")
    assert exact_dedup.ingest(odd, exact_dedup.DigestIndex.create(spark)).where("kept").count() == 1
    assert exact_dedup.ingest(docs(spark, []), exact_dedup.DigestIndex.create(spark)).count() == 0
    null_id = exact_dedup.ingest(docs(spark, [(None, "a"), (3, "a")]), exact_dedup.DigestIndex.create(spark)).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in null_id} == {(None, 3, False), (3, 3, True)}


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, ("", "", None, "allow")),
        ("", ("", "", None, "allow")),
        ("no scheme/casino", ("", "", None, "block")),
        ("http://A.Example.COM/en/1?x#y", ("a.example.com", "/en/1", "example.com/en/", "block")),
        ("http://www.example.com/en/1", ("www.example.com", "/en/1", "www.example.com/en/", "allow")),
        ("http://x.com", ("x.com", "", None, "allow")),
        ("http://x.com/", ("x.com", "/", "com/", "allow")),
        ("http://casino.com/", ("casino.com", "/", "com/", "allow")),
        ("http://notexample.com.net/fr/", ("notexample.com.net", "/fr/", "net/fr/", "block")),
        ("http://a.org/cheap-pills", ("a.org", "/cheap-pills", None, "block")),
        ("http://a.org/cheap", ("a.org", "/cheap", None, "allow")),
        ("http://a.org/cheap/cheap", ("a.org", "/cheap/cheap", None, "allow")),
        ("http://a.org/casinos", ("a.org", "/casinos", None, "allow")),
        ("http://a.org?q=://b", ("a.org", "", None, "allow")),
        ("http://é.org/CASINO", ("é.org", "/CASINO", None, "block")),
    ],
)
def test_url_verdicts(spark, url, want):
    pages = spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")
    r = url_filter.judge(pages).first()
    assert (r.host, r.path, r.rule, r.verdict) == want


def test_url_filter_on_an_empty_table_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://casino.org/"), (1, "http://casino.org/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(pages).collect()] == ["block", "block"]
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_language_of_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.op3_language_id(spark, "/root/testdata/sf0.01")
    held = out.where("held_out").join(d.select("doc_id", "lang"), "doc_id")
    assert held.where("lang = lang_pred").count() / held.count() > 0.97
    assert out.where("score < 0 OR score > 1").count() == 0


def test_language_id_without_letters_labels_or_rows(spark):
    rows = [(1, "der die das", "de"), (2, "the of and", "en"), (3, None, "en"), (4, "123 !", "de"), (5, "", None), (6, "the and the", None), (7, "der " * 100_000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS lang_pred")
    model = language_id.fit(d.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text"))
    found = {r.doc_id: r.lang_pred for r in language_id.identify(d, model).collect()}
    assert found == {1: "de", 2: "en", 3: "und", 4: "und", 5: "und", 6: "en", 7: "de"}
    nothing = language_id.fit(d.limit(0).select("doc_id", "lang", "text"))
    assert {r.lang_pred for r in language_id.identify(d, nothing).collect()} == {"und"}


def test_grams_don_t_depend_on_where_a_text_is_cut(monkeypatch):
    text = "Ärger über das Überqueren, niño! " * 50
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "PIECE", 37)
    assert (language_id.counts(text) == whole).all()


def test_scores_are_those_of_naive_bayes_written_out(spark):
    import math

    def grams(text):
        padded, out = "  " + "".join(c if c.isalpha() else " " for c in text.lower()), []
        for i in range(2, len(padded)):
            h = 0
            for n in range(3 if padded[i] != " " else 0):
                h = ((h ^ ord(padded[i - n])) * 0x85EBCA6B + n + 1) % 2**32
                out.append(((h ^ (h >> 15)) * 0xC2B2AE35 % 2**32) >> (32 - 13))
        return out

    rows = [(k, t, lang) for k, (t, lang) in enumerate([("Der Hund läuft", "de"), ("the dog runs", "en"), ("the cat, the dog", "en"), ("el perro y la casa", "es"), ("Σ οδός", "el")] * 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = ["der dog", "la casa the", "Hund Σ", "the the the", "x", None, "12", ""]
    langs = sorted({r[2] for r in rows})
    tables = {x: [0.5] * language_id.BUCKETS for x in langs}
    for _, t, x in rows:
        for g in grams(t):
            tables[x][g] += 1
    n_rows = {x: sum(r[2] == x for r in rows) + 0.5 for x in langs}
    model = language_id.fit(d)
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(list(enumerate(asked)) + [(0, asked[0])], "doc_id long, text string"), model).collect()}
    for k, text in enumerate(asked):
        g = grams(text or "")
        if not g:
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        score = {x: math.log(n_rows[x] / sum(n_rows.values())) + sum(math.log(tables[x][i] / sum(tables[x])) for i in g) for x in langs}
        best = max(langs, key=score.get)
        assert got[k].lang_pred == best and got[k].score == pytest.approx(1 / sum(math.exp(s - score[best]) for s in score.values()))
    assert language_id.fit(d, max_languages=2).languages == ("de", "en")


@pytest.mark.parametrize(("url", "verdict"), [("https://royal-blackjack.io/table", "block"), ("https://news.site.io/betting/odds", "block"), ("https://news.site.io/odds", "allow"), ("https://essex.ac.uk/sussex", "allow"), ("https://cheap.io/cheap", "allow"), ("https://a.io/" + "x/" * 100_000 + "porn", "block")])
def test_urls_that_the_vocabulary_was_not_made_from(spark, url, verdict):
    assert url_filter.judge(spark.createDataFrame([(1, url)], "page_id long, url string")).first().verdict == verdict


def test_a_batch_taken_in_again_keeps_the_same_rows(spark):
    rows = [(1, "a b"), (2, "ab"), (2, "ab "), (3, "c"), (None, "d"), (None, "d d")]
    index = exact_dedup.DigestIndex.create(spark, buckets=4)
    first = sorted(map(tuple, exact_dedup.ingest(docs(spark, rows), index).collect()), key=repr)
    size = index.read().count()
    # the append is done and the result lost: the next session opens the index and takes the batch in again
    again = exact_dedup.DigestIndex.open(spark, index.path)
    assert sorted(map(tuple, exact_dedup.ingest(docs(spark, rows), again).collect()), key=repr) == first
    assert again.read().count() == size and again.buckets == 4
    kept = sorted(map(tuple, exact_dedup.without_copies(docs(spark, rows), again).collect()), key=repr)
    assert kept == sorted(map(tuple, exact_dedup.without_copies(docs(spark, rows), exact_dedup.DigestIndex.create(spark)).collect()), key=repr) and kept
    assert exact_dedup.without_copies(docs(spark, [(9, "a b"), (1, "ab")]), again).count() == 0  # copies of what was kept


def test_an_index_tells_its_number_of_buckets(spark):
    index = exact_dedup.DigestIndex.create(spark, buckets=3)
    exact_dedup.ingest(docs(spark, [(1, "a")]), index)
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex.open(spark, index.path, buckets=5)
