"""Secret scans, PII, SentencePiece, toxicity, the pipeline."""

import hashlib
import random
import re
from functools import reduce

import pytest

from quarryline.llm import pii_surrogates, secret_scan, sentencepiece, toxicity

# --- secrets ---

PATTERNS = (
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
)


def brute_base(text):
    out = []
    for order, (kind, p) in enumerate(PATTERNS):
        for m in p.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


TABLE = secret_scan.train(secret_scan.random_samples(), secret_scan.ordinary_samples())


def brute_markov(text, base):
    taken = [tuple(map(int, s.split(":")[1:])) for s in base]
    place = {c: i for i, c in enumerate(secret_scan.ALPHABET)}
    out = []
    for m in re.finditer(r"[A-Za-z0-9+_=-]{20,}", text or ""):
        s = m[0]
        if sum(bool(re.search(k, s)) for k in ("[a-z]", "[A-Z]", "[0-9]")) < 2:
            continue
        mean = sum(TABLE[place[a] * len(place) + place[b]] for a, b in zip(s, s[1:], strict=False)) / (len(s) - 1)
        if mean >= secret_scan.THRESHOLD and not any(m.start() < e and b < m.end() for b, e in taken):
            out.append(f"markov:{m.start()}:{m.end()}")
    return out


HEX = hashlib.sha256(b"x").hexdigest()
TEXTS = [
    None, "", "no secrets here", "PassWord = 'hunter2xyz'", 'api_key: "abcdef', "secret: token: abcdefgh", "token=abc token = abcdef", "token ==abcdefg", "AKIA" + "A1" * 8, "AKIA" + "A" * 15,
    f"é😀 {HEX} token='{HEX}' {HEX[:23]} {HEX[:24]}", "AKIAAKIA" + "Z9" * 10 + f" apikey={HEX}", "keys: Zq8Xw3Lk9Pv2Rt7Yb4Nm6Jd1 and some_ordinary_identifier_name_of_code anotherOrdinaryIdentifierName",
    " ".join(f"token={HEX[:k % 40 + 1]}" for k in range(1500)), "ſecret=abcdefgh toKen=abcdefgh",
]


def test_secret_spans_are_those_of_brute_force(spark):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS hex", "2 AS assign")
    s = secret_scan.spans_of(df)
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in s.select("doc_id", secret_scan.joined(*secret_scan.KINDS[:3]).alias("base"), secret_scan.joined(*secret_scan.KINDS).alias("spans"), F.size("assign").alias("n")).collect()}
    for i, t in rows:
        base = brute_base(t)
        assert got[i].base == ",".join(base), t
        assert set(got[i].spans.split(",")) - {""} == set(base) | set(brute_markov(t, base)), t
    assert got[12].spans.count("markov") == 1
    assert secret_scan.spans_of(df.limit(0)).count() == 0


def test_markov_models_tell_random_from_ordinary():
    table, size = TABLE, len(secret_scan.ALPHABET)
    place = {c: i for i, c in enumerate(secret_scan.ALPHABET)}
    mean = lambda s: sum(table[place[a] * size + place[b]] for a, b in zip(s, s[1:], strict=False)) / (len(s) - 1)
    rng = random.Random(9)
    fresh = ["".join(rng.choice(secret_scan.ALPHABET[:62]) for _ in range(32)) for _ in range(500)]
    plain = ["get_user_account_by_identifier", "theQuickBrownFoxJumpsOverTheDog", "MAXIMUM_ALLOWED_CONNECTIONS_2024", "configuration-service-endpoint-v2", "Donaudampfschifffahrtsgesellschaft1"]
    assert sum(mean(s) >= secret_scan.THRESHOLD for s in fresh) > 490
    assert all(mean(s) < secret_scan.THRESHOLD for s in plain)


def test_standard_base64_is_found_whole_and_paths_are_not(spark):
    import base64

    rng = random.Random(17)
    keys = [base64.b64encode(rng.randbytes(n)).decode() for n in (18, 24, 30) for _ in range(100)]
    slashed = [k for k in keys if "/" in k]
    paths = ["/usr/local/lib/python3/dist-packages/numpy", "src/main/java/com/Example/UserAccountService2", "/2024/03/15/the-quick-brown-fox-jumps", "docs/Reference/Configuration/Settings", "assets/images/HeaderBackground_2"]
    inside = "services/configuration/production/Zq8Xw3Lk9Pv2Rt7Yb4Nm6Jd1"
    texts = [f"key {k} here" for k in slashed] + paths + [inside, "AKIA" + "A1" * 8 + "/Zq8Xw3Lk9Pv2Rt7Yb4Nm6Jd1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(x.start, x.end) for x in r.markov] for r in secret_scan.spans_of(rows).collect()}
    n = len(slashed)
    assert n > 100 and sum(got[i] == [(4, 4 + len(k))] for i, k in enumerate(slashed)) >= 0.97 * n
    assert not any(got[n + i] for i in range(len(paths)))
    at, end = (got[n + len(paths)] or [(0, 0)])[0]
    assert at <= inside.index("Zq8") < end == len(inside)
    assert got[n + len(paths) + 1] == [(21, 21 + 24)]


def test_secret_query_over_the_small_table(spark, sf_dir):
    rows = {r.doc_id: r for r in secret_scan.op1_secret_scan(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        base = ",".join(brute_base(r.text))
        assert rows[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()


# --- PII ---


def test_surrogates_keep_type_format_gender_and_coreference(spark):
    text = "Mr John Smith met Mrs. Maria Garcia; mail John.Smith@corp.co.uk or JOHN.SMITH@CORP.CO.UK, +44 20 7946 0958, (212) 555-1234, DE89 3704 0044 0532 0130 00, 10.0.0.1, 4111-1111-1111-1111, 4111111111111111"
    rows = [(1, text), (2, "Иван Петров. Mr Smith. Ελένη Παπαδοπούλου"), (3, None), (4, ""), (5, "nothing at 12:30, version 1.2.3.4.5, total 123"), (1, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'h' AS hits", "9 AS n_entities")
    out = pii_surrogates.pseudonymised(df)
    assert out.columns == ["doc_id", "text", "hits", "n_entities"]
    got = [tuple(r) for r in out.orderBy("doc_id").collect()]
    a, b = got[0][1], got[2][1]
    assert got[0] == got[1] and got[0][3] == 10
    for part in ("John", "Smith", "Maria", "Garcia", "7946", "555-1234", "0532", "10.0.0.1", "4111", "corp"):
        assert part not in a
    m = re.match(r"Mr (\w+) (\w+) met Mrs\. (\w+) (\w+); mail (\S+) or (\S+), \+4\d \d\d \d{4} \d{4}, \(\d{3}\) \d{3}-\d{4}, DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d, (\d+\.){3}\d+, (\d{4})-(\d{4})-(\d{4})-(\d{4}), (\d{16})$", a)
    assert m, a
    assert m[1] in pii_surrogates.GIVEN["male latin"] and m[3] in pii_surrogates.GIVEN["female latin"]
    assert m[6] == m[5].upper() and m[5].endswith(".uk") and m[12] == m[8] + m[9] + m[10] + m[11]
    assert f"Mr {m[2]}." in b and re.match(r"[А-Я][а-я]+ [А-Я][а-я]+\. ", b) and re.search(r"[Ͱ-Ͽἀ-῿]+ [Ͱ-Ͽ]+$", b)
    assert [g[1] for g in got[3:]] == [None, "", rows[4][1]]
    assert pii_surrogates.pseudonymised(df.limit(0)).count() == 0


def test_colliding_surrogates_make_another_attempt(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = pii_surrogates._hash
    # the first attempt is the same for all, so all but one collide
    monkeypatch.setattr(pii_surrogates, "_hash", lambda key, kind, canon, attempt: F.when(attempt == 0, F.sha2(F.lit("same"), 256)).otherwise(real(key, kind, canon, attempt)))
    rows = [(k, f"host 10.1.{k}.7 and 10.1.0.7") for k in range(20)]
    out = pii_surrogates.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ips = [re.findall(r"\d+(?:\.\d+){3}", r.text) for r in out]
    assert len({b for _, b in ips}) == 1 and len({a for a, _ in ips}) == 20
    assert not {a for p in ips for a in p} & {f"10.1.{k}.7" for k in range(20)}


def test_no_entity_of_the_small_table_is_left(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    new = {r.doc_id: r for r in pii_surrogates.op4_pii_surrogates(spark, sf_dir).collect()}
    seen = 0
    for r in d.collect():
        for found in re.findall(r"[\w.]+@[\w.]+\w|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+\d \(\d{3}\) \d{3}-\d{4}|(?<!\w)\d{16}(?!\w)", r.text):
            seen += 1
            assert found not in new[r.doc_id].text
        if not new[r.doc_id].n_entities:
            assert r.text == new[r.doc_id].text
    assert seen


# --- SentencePiece ---

HARD = [None, "", " ", "   ", "a", " lead", "trail ", "two  spaces   three", "line\nbreak\ttab", "▁ mark", "ünïcødé ﬁ 漢字 😀 \u0000x", "x" * 5000, "the " * 3000, "<s> </s> <unk> <0x41>", "a b　c", "aaaaaaaaaaaaaaaa" * 9]


def test_ids_are_those_of_the_library(spark, sf_dir):
    import sentencepiece as library

    lib = library.SentencePieceProcessor(model_file=sentencepiece.default_model())
    texts = HARD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS ids")
    rows = sentencepiece.encoded(df).collect()
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.ids == lib.encode(t), t[:40]
        assert r.decoded == lib.decode(r.ids), t[:40]
        assert r.decoded == t or "▁" in t
    back = sentencepiece.decoded(spark.createDataFrame([(1, [0, 1, 5000, 3]), (2, None), (3, [])], "k long, ids array<int>")).collect()
    assert back[1].decoded is None and back[2].decoded == ""
    assert sentencepiece.encoded(df.limit(0)).count() == 0


def test_ids_of_made_up_words_are_those_of_the_library():
    import sentencepiece as library

    lib = library.SentencePieceProcessor(model_file=sentencepiece.default_model())
    p, rng = sentencepiece.Pieces(sentencepiece.default_model()), random.Random(4)
    pieces = [n for n in p.id_of if "▁" not in n]
    words = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(20_000)]
    words += ["".join(rng.choice("aeéiouthnrsß.,'0\n") for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    text = " ".join(words)
    assert p.encode_batch([text])[0].tolist() == lib.encode(text)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(sentencepiece, "REMEMBERED_WORDS", 3)
    p = sentencepiece.Pieces(sentencepiece.default_model())
    texts = ["one two three four", "five six one", "  seven one"]
    first = [x.tolist() for t in texts for x in p.encode_batch([t])]
    monkeypatch.setattr(sentencepiece, "REMEMBERED_WORDS", 10**6)
    assert [x.tolist() for x in sentencepiece.Pieces(sentencepiece.default_model()).encode_batch(texts)] == first


def test_unigram_walk_is_viterbi():
    p = sentencepiece.Pieces(sentencepiece.default_model(), kind="unigram")

    def best(word):
        top = {0: (0.0, ())}
        for i in range(1, len(word) + 1):
            options = [(top[j][0] + p.score[word[j:i]], (*top[j][1], word[j:i])) for j in range(max(0, i - 16), i) if word[j:i] in p.score and j in top]
            options.append((top[i - 1][0] + p.unknown_score, (*top[i - 1][1], word[i - 1])))
            top[i] = max(options, key=lambda x: x[0])
        return top[len(word)][0]

    words = ["▁hello", "▁help", "▁helping", "▁unbelievable", "▁😀x", "▁"]
    for w, ids in p.walk(words).items():
        got = reduce(lambda s, i: s + (p.score[p.names[i]] if not p.names[i].startswith("<0x") else 0), ids, 0.0)
        assert got == pytest.approx(best(w)) or "😀" in w


# --- toxicity ---


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = [r for r in out if r.predicted]
    assert sum(r.toxic for r in hit) / len(hit) > 0.85
    assert sum(r.predicted for r in out if r.toxic) / sum(r.toxic for r in out) > 0.6


def test_toxicity_cases(spark):
    rng = random.Random(2)
    plain = lambda: " ".join(rng.choice(["the", "house", "river", "green", "walks", "slowly"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["you", "awful", "idiot", "moron", "the", "house"]) for _ in range(60))
    rows = [(k, bad() if k % 2 else plain()) for k in range(300)]
    d = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, bad() * 200), (1003, plain() * 200), (1, rows[1][1])], "doc_id long, text string").selectExpr("*", "0.5 AS score", "'x' AS data")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(d, labels))
    got = {r.doc_id: r.score for r in toxicity.scored(d, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert got[1002] > 0.7 > got[1003] and got[1000] == got[1001] < 0.7
    assert toxicity.fit(toxicity.training_rows(d, labels.where("toxic = 0"))) is None
    assert {r.score for r in toxicity.scored(d, None).collect()} == {0.0}
    assert toxicity.scored(d.limit(0), model).count() == 0


def test_toxic_passages_are_learned_wherever_they_stand(spark):
    rng = random.Random(5)
    some = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    plain = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["awful", "idiot", "moron"] * 130 + plain  # among others, so that they have new neighbours in every text
    rows = [(k, some(plain, 3500) + " " + some(bad if k % 2 else plain, 60)) for k in range(120)]
    assert min(len(t) for _, t in rows) > (1 << 14) + 400
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, toxic int")
    taught = toxicity.training_rows(d, labels)
    assert {b"idiot", b"moron"} <= set(toxicity.telling_words(taught))
    got = {r.doc_id: r.score for r in toxicity.scored(d, toxicity.fit(taught)).collect()}
    assert all((got[k] > 0.7) == (k % 2 == 1) for k in range(120))


# --- pipeline ---


def test_pipeline_is_its_stages_by_brute_force(spark, sf_dir):
    import corpus_pipeline
    from tests.llm.test_exact_and_urls import brute_dedup
    from tests.llm.test_near_and_benchmark import brute_components, brute_tiling, words_utf8

    from quarryline.llm import language_id

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(language_id.labelled(source))
    kept = {i for i, r in docs.items() if (p := model.predict(r.text))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE}
    assert len(kept) >= 0.98 * len(docs)
    kept = {r[0] for r in brute_dedup([(i, docs[i].text) for i in kept]) if r[3]}
    kept = {r[0] for r in brute_components([(i, docs[i].text) for i in kept]) if r[3]}
    items = [words_utf8(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seeds = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in items]

    def leaks(text):
        t = words_utf8(text)
        at = {}
        for k in range(len(t) - 4):
            at.setdefault(tuple(t[k : k + 5]), []).append(k)
        for w, s in zip(items, seeds, strict=True):
            shared = at.keys() & s
            if 5 * len(w) * len(shared) and 5 * sum(tuple(w[k : k + 5]) in shared for k in range(len(w) - 4)) >= 0.5 * len(w):
                # only words that stand in a shared run of five can be marked; what divides them is like no other word
                inside = sorted({k + j for x in shared for k in at[x] for j in range(5)})
                reduced = [x for n, k in enumerate(inside) for x in ([("gap", n)] if n and inside[n - 1] != k - 1 else []) + [t[k]]]
                if brute_tiling(reduced, w, 5) >= 0.5 * len(w):
                    return True
        return False

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == {i for i in kept if not leaks(docs[i].text)}
    assert all(r.round_trip and r.text == docs[i].text for i, r in got.items())
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


ODD = [(3, "dup  text of five words", "a"), (5, "dup text of five words", "b"), (5, "only copy of this other text", "c"), (1, "same same same same same", "d"), (1, "same same same same same", "e"), (None, "no id stands here at all", "f"), (None, "no id stands here at all", "g"), (None, None, "h"), (9, "", None)]


def odd_docs(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS gone_id", "2 AS ids", "3 AS n_tokens", "4 AS row", "5 AS h", "6 AS key", "7 AS guess", "8 AS decoded")


def test_stages_keep_one_row_of_each_group_whatever_the_ids(spark, sf_dir):
    import corpus_pipeline

    d = odd_docs(spark)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        out = stage(spark, d, sf_dir)
        assert out.columns == d.columns
        got = sorted((str(r.doc_id), r.text or "") for r in out.collect())
        want = [("1", ODD[3][1]), ("5", ODD[2][1]), ("None", ODD[5][1])]
        # exact: the longer of the copies, and one empty text; near: the smaller id, and all texts without words
        want += [("3", ODD[0][1]), ("9", "")] + ([("None", "")] if stage is corpus_pipeline.near else [])
        assert got == sorted(want), stage
        assert stage(spark, d.limit(0), sf_dir).count() == 0


def test_stages_that_judge_rows_alone(spark, sf_dir):
    import corpus_pipeline

    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    d = odd_docs(spark, [*ODD, (None, f"before {item} after", "x")])
    clean = corpus_pipeline.decontaminated(spark, d, sf_dir)
    assert clean.columns == d.columns and sorted(map(str, clean.collect())) == sorted(map(str, odd_docs(spark).collect()))
    out = corpus_pipeline.encoded(spark, d, sf_dir).collect()
    assert len(out) == len(ODD) + 1 and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    spoken = corpus_pipeline.language(spark, d, sf_dir)
    assert spoken.columns == d.columns and spoken.where("text IS NULL OR text = ''").count() == 0
    assert corpus_pipeline.language(spark, d.limit(0), sf_dir).count() == corpus_pipeline.encoded(spark, d.limit(0), sf_dir).count() == 0


def test_stages_leave_little_in_an_executor(spark, sf_dir):
    import corpus_pipeline

    from quarryline.llm import exact_dedup

    # an empty index is not made of rows of Python's, which need workers of their own
    assert "ExistingRDD" not in exact_dedup.DigestIndex.create(spark).read()._jdf.queryExecution().toString()
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50).coalesce(1)
    for stage in (corpus_pipeline.near, corpus_pipeline.decontaminated, corpus_pipeline.encoded, corpus_pipeline.language):
        spark.conf.unset(key)
        assert stage(spark, docs, sf_dir).count() > 0
        assert int(spark.conf.get(key)) <= 1 << 20, stage


# --- robustness of scans and surrogates ---


def test_many_spans_in_one_text(spark):
    import time

    text = " ".join(f"token=abcdefgh{k} Zq8Xw3Lk9Pv2Rt7Yb4Nm6Jd{k % 10}" for k in range(50_000))
    began = time.time()
    r = secret_scan.spans_of(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(r["assign"]) == 50_000 and len(r.markov) > 45_000 and time.time() - began < 60


def test_surrogates_of_hard_texts(spark):
    long_host = "x@" + "a." * 500_000 + "com"
    rows = [
        (1, "Dr Priya Raman and Wei Zhang met Smith. Mr Smith spoke. SMITH said so to Zhang; my name is Bob Marley"),
        (2, long_host),
        (None, "mail someone@corp.com, Mr Jones\x01\x02 Jones \x02\x04"),
        (4, "Under the Apache License and in New York nobody is named."),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'kept' AS hits", "1 AS attempts", "2 AS of_doc", "3 AS row", "4 AS new")
    out = pii_surrogates.pseudonymised(d)
    assert out.columns == [*d.columns, "n_entities"]
    got = {r.doc_id: r for r in out.collect()}
    assert not re.search(r"(?i)Priya|Raman|Wei|Zhang|Smith|Bob|Marley", got[1].text) and got[1].hits == "kept"
    again = re.match(r"Dr (\w+) (\w+) and (\w+) (\w+) met (\w+)\. Mr (\w+) spoke\. (\w+) said so to (\w+); my name is", got[1].text)
    assert again and again[5] == again[6] and again[7] == again[5].upper() and again[8] == again[4]
    assert len(got[2].text) == len(long_host) and got[2].text.endswith(".com") and got[2].text[:100] != long_host[:100]
    assert re.fullmatch(r"mail \w+@\w+\.com, Mr (\w+)\x01\x02 \1 \x02\x04", got[None].text) and "Jones" not in got[None].text
    assert got[4].text == rows[3][1] and got[4].n_entities == 0
