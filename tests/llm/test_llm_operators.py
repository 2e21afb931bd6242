"""The training-data operators against brute force, round trips and held-out labels, and on odd inputs."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import chosen_path, common, hamming_index, packing, pii, quotations, spotsigs, toxicity, warc, word_table, wrappers

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "a b"), (4, "A b!"), (5, "the cat and the dog sat on a mat " * 400), (6, "\x1c x y z"), (7, "a b"), (7, "a b")]


@pytest.fixture(scope="session", autouse=True)
def _ready(spark):
    common.prepare(spark)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, repeated rows and extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, 0.5, "x") for i, t in ODD], "doc_id long, text string, score double, rec string")


@pytest.mark.parametrize("query", [spotsigs.query, word_table.query, packing.query, chosen_path.query, pii.query])
def test_empty_tables_give_no_rows(odd, query):
    assert query(odd.limit(0)).count() == 0


def test_warc_matches_sql_and_reads_back(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{DATA}/pages.parquet'")
    assert sorted(map(tuple, warc.query(spark, pages).collect())) == sorted(con.execute(warc.ORACLE).fetchall())


def test_warc_odd_rows(spark):
    rows = [(1, "u", "x"), (2, None, "x"), (2, None, "x"), (3, "b\nc", None), (4, "d", ""), (None, "q", "x")]
    got = warc.query(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got)
    assert kinds == sorted([("1", "revisit", 2), ("2", "response", None), ("2", "revisit", 2), ("3", "revisit", 4), ("4", "response", None), ("None", "revisit", 2)], key=str)
    assert warc.query(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archive_round_trip():
    records = [warc._record(i, f"http://h/{i}", "D", b"<p>" + bytes([65 + i % 26]) * (10 * i), False, None) for i in range(300)]
    blob = warc.encode_archive(records)
    assert blob[:4] == struct.pack("<I", warc.SKIPPABLE_MAGIC)
    back = list(warc.decode_archive(blob))
    assert [h["WARC-Record-ID"] for h, _ in back] == [f"<urn:page:{i}:0>" for i in range(300)]
    assert all(b.endswith(bytes([65 + i % 26]) * (10 * i)) for i, (_, b) in enumerate(back))


def test_spotsigs_edited_texts_and_order(docs):
    texts = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    after = {texts[i][0]: texts[(i + 1) % len(texts)][1] for i in range(len(texts))}
    text, got = dict(texts), spotsigs.query(docs).collect()
    assert len(got) == len(texts)
    prints = {}
    for r in got:
        a = text[r["doc_id"]]
        half = len(a) // 2
        e = a[: len(a) - half] + after[r["doc_id"]][:half]
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["near_edited"] == spotsigs.likeness(spotsigs.signatures(a), spotsigs.signatures(e))
        assert r["near_next"] == spotsigs.likeness(spotsigs.signatures(a), spotsigs.signatures(after[r["doc_id"]]))
        assert prints.setdefault(a, r["fingerprint"]) == r["fingerprint"]
    assert np.mean([r["near_edited"] for r in got]) > 0.25 > np.mean([r["near_next"] for r in got])


def test_spotsigs_odd_rows(odd):
    got = spotsigs.query(odd).collect()
    assert len(got) == len(ODD)
    assert spotsigs.query(odd.where("doc_id = 3")).first()["near_next"] == 1.0


def test_wrappers_leave_out_boilerplate(spark):
    page = "<html><body><nav><a>menu</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>T&amp;x</h1><p>One\n two<p>{}<br>three</article><div id=comments>hi</div><footer>f</footer>"
    rows = [(i, f"http://h{i % 2}/x", page.format("<b>more</b>" * (i % 3))) for i in range(12)] + [(20, None, None), (21, "http://h1/y", "plain &lt;text&gt; <!-- no"), (22, "http://h1/y", "")]
    got = {r["page_id"]: r for r in wrappers.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0]["text"] == "T&x\nOne two\nthree" and got[4]["text"] == "T&x\nOne two\nmore\nthree"
    assert got[20]["text"] == "" and got[21]["text"] == "plain <text>" and got[0]["n_chars"] == len(got[0]["text"])
    assert got[0]["by_wrapper"]


def test_word_table_equals_the_tokenizer(spark, docs, odd):
    t = word_table.tokenizer(word_table.vocabulary_path())
    more = spark.createDataFrame([(100 + i, f"a{chr(c)}b {chr(c)}") for i, c in enumerate([9, 0x1C, 0x85, 0xA0, 0x180E, 0x200B, 0x2028, 0x3000, 0x301])] + [(200, "<|endoftext|>x <|ENDOFTEXT|>"), (201, "İIi ΑΣ it's don't'll")], "doc_id long, text string")
    every = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(more)
    want = sorted((i, t.encode(x or "", add_special_tokens=False).ids) for i, x in every.collect())
    got = sorted((r["doc_id"], list(struct.unpack(f"<{r['n_tokens']}I", r["ids"]))) for r in word_table.encode(every).collect())
    assert got == want
    decoded = word_table.decode(spark.createDataFrame(want[:50], "doc_id long, ids array<long>")).collect()
    assert all(r["decoded"] == t.decode(r["ids"], skip_special_tokens=False) for r in decoded)


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    pos, neg = ([r["score"] for r in rows if r["toxic"] == t] for t in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.85 and np.mean([n >= toxicity.THRESHOLD for n in neg]) < 0.05


def test_toxicity_odd_rows(spark, odd):
    m = toxicity.train([("you are an idiot", 1), ("a fine day", 0)] * 6)
    got = toxicity.score(odd.drop("score"), m).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.train([]).share == 0.5 and toxicity.score(odd.limit(0), m).count() == 0
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.query(odd, labels).count() == len(ODD)


def test_packing_places_every_token_once(docs, odd):
    t = word_table.tokenizer(word_table.vocabulary_path())
    for table in (docs, odd.where("doc_id < 7")):
        want = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in table.collect()}
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for r in packing.query(table).collect():
            by_doc[r["doc_id"]].append(r)
            by_seq[r["sequence_id"]].append(r)
        assert set(by_doc) == set(want)
        for k, pieces in by_doc.items():
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                ids = want[k][at : at + p["length"]]
                assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(want[k]), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
                at += p["length"]
            assert at == len(want[k])
        for pieces in by_seq.values():
            at = 0
            for p in sorted(pieces, key=lambda p: p["offset"]):
                assert p["offset"] == at
                at += p["length"]
            assert at <= packing.WINDOW
    assert packing.query(odd).where("doc_id = 7").count() == 2


def test_nnls_meets_a_solvable_system():
    rng = np.random.default_rng(0)
    a, x = rng.integers(0, 3, (12, 8)).astype(float), np.array([0, 3, 0, 1, 2, 0, 5, 0.5])
    assert np.allclose(packing.nnls(a, a @ x, 20000), x, atol=1e-3)
    plan = packing.solve({64: 400, 85: 301, 86: 155, 100: 10, 128: 9})
    used = defaultdict(int)
    for r, n in plan:
        assert sum(r) <= 256
        for k in r:
            used[k] += n
    assert used[64] <= 400 and used[85] > 280 and used[128] == 8


def _brute_links(rows, threshold=0.8):
    sets = [(i, set(chosen_path.shingles(t).tolist())) for i, t in rows]
    links, root = defaultdict(int), {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if (not a and not b) or (a and b and len(a & b) >= threshold * len(a | b)):
                links[x] += 1
                links[y] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((i, find(i), links[k]) for k, (i, _) in enumerate(sets))


def _sql_links(rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    return sorted(con.execute(chosen_path.ORACLE).fetchall(), key=str)


def test_chosen_path_and_its_sql_equal_brute_force_on_repeated_ids(spark):
    rng = np.random.default_rng(9)
    words = [f"w{x}" for x in rng.integers(0, 900, 400)]
    rows = []
    for i in range(60):
        w = words[5 * (i % 12) : 5 * (i % 12) + 60]
        if i % 3:
            w[int(rng.integers(0, len(w)))] = f"y{i}"
        rows += [(int(rng.integers(0, 40)), " ".join(w))] * (1 + i % 4)
    rows += [(50, None), (50, ""), (51, "one two"), (52, "One, two!"), (53, "x_y é")]
    got = sorted(map(tuple, chosen_path.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    want = _brute_links(rows)
    assert sorted((i, n) for i, _, n in got) == sorted((i, n) for i, _, n in want)
    assert sorted(got, key=str) == _sql_links(rows)
    nulls = [*rows[:6], (None, rows[0][1]), (None, None)]
    assert sorted(map(tuple, chosen_path.query(spark.createDataFrame(nulls, "doc_id long, text string")).collect()), key=str) == _sql_links(nulls)


def test_chosen_path_over_several_blocks(spark, monkeypatch):
    """A class of more records than a block holds."""
    monkeypatch.setattr(chosen_path, "BLOCK", 48)
    monkeypatch.setattr(chosen_path, "SMALL_BLOCK", 16)
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(170):
        w = list(base)
        w[int(rng.integers(0, 120))] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = sorted(map(tuple, chosen_path.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == _brute_links(rows) and max(n for _, _, n in got) > 100


def test_chosen_path_equals_brute_force(docs, odd):
    for table in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        assert sorted(map(tuple, chosen_path.query(table).collect())) == _brute_links(rows)


def test_chosen_path_splits_large_groups(spark, monkeypatch):
    """Near copies beyond the small bucket size, and as many texts that share a passage only."""
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    base, shared = words(150), words(60)
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.integers(0, 150, 2):
            w[at] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(shared + words(100))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(chosen_path, "SMALL", 16)
    assert sorted(map(tuple, chosen_path.query(df).collect())) == _brute_links(rows)


def test_chosen_path_keeps_one_of_each_class(odd):
    kept = sorted(r["doc_id"] for r in chosen_path.keep_one(odd).collect())
    assert kept == [1, 3, 5, 6]


def test_chosen_path_repeated_first_id_beside_a_near_copy(spark):
    words = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "x"]), "quite another text of seven words"
    table = [(1, text), (1, text), (2, near)]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, chosen_path.query(df(table)).collect())) == _brute_links(table) == [(1, 1, 2), (1, 1, 2), (2, 1, 2)]
    assert sorted(map(tuple, chosen_path.keep_one(df(table)).collect())) == [(1, text)]
    # other texts that share a doc_id: 1 stays twice, 2 only with its own class
    table += [(1, other), (1, other), (2, "a text that stands alone here"), (3, None), (None, text)]
    kept = chosen_path.keep_one(df(table)).collect()
    assert sorted(map(str, kept)) == sorted(map(str, df([(1, text), (1, other), (2, "a text that stands alone here"), (3, None), (None, text)]).collect()))


def test_pii_equals_the_plain_expressions(spark, docs):
    extra = ["a@b.c_d@e.f x@y.z.w@q.r a@b@c.d", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.4", "4111 1111 1111 1111-2 4111-1111-1111-1111", "+1 (555) 123-4567 +1+12345678901", "é€😀a@b.co", None, "", "1" * 50000, "a" * 100000, "+1" + "(" * 50000, "a." * 30000 + "@x.y"]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(s):
        d = [int(c) for c in s if c.isdigit()]
        return 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0

    good = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": luhn, "phone": lambda s: 9 <= sum(c.isdigit() for c in s) <= 15}
    text = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    for r in pii.query(table).collect():
        t = text[r["doc_id"]]
        if t[:5] == "aaaaa":  # the plain expression takes quadratic time here; there is nothing to find
            assert r["n_email"] == 0
            continue
        spans = {k: [m.span() for m in re.finditer(f, t) if good[k](m[0])] for k, f in forms.items()}
        listed = ",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert all(r[f"n_{k}"] == len(v) for k, v in spans.items())


def test_pii_redaction_and_iban(spark):
    df = spark.createDataFrame([(1, "iban GB82 WEST 1234 5698 7654 32 ok", "k"), (2, "GB82 WEST 1234 5698 7654 33", "k"), (3, "a@b.co, é +1 555 123 4567!", "k"), (4, None, "k")], "doc_id long, text string, spans string")
    assert [r["text"] for r in pii.redact(df).orderBy("doc_id").collect()] == ["iban [IBAN] ok", "GB82 WEST 1234 5698 7654 33", "[EMAIL], é [PHONE]!", None]


def test_pii_ibans_end_where_their_country_says(spark):
    de, gb = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    texts = {f"{de} Please pay": "[IBAN] Please pay", f"{gb} 12 March": "[IBAN] 12 March", f"IBAN: {de} BIC: X": "IBAN: [IBAN] BIC: X", f"{de} {gb}": "[IBAN] [IBAN]", f"{gb}, {de}": "[IBAN], [IBAN]"}
    texts |= {f"BE71 {de[:4]} 3704 0044 0532 0130 00 A": "BE71 [IBAN] A", f"x{de}": f"x{de}", f"{de}0": f"{de}0", "NO93 8601 1117 947 NO9386011117947": "[IBAN] [IBAN]", "é😀 " + de: "é😀 [IBAN]", "bank ZZ8112345678901 ABC": "bank [IBAN] ABC", "banked? ship ZZ8112345678901 ABC": "banked? ship [IBAN] ABC", "embanked ZZ8112345678901 ABC": "embanked ZZ8112345678901 ABC"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(df).orderBy("doc_id").collect()] == list(texts.values())
    spans = {r["doc_id"]: r["spans"] for r in pii.query(df).collect()}
    assert spans[3].endswith("iban:0:22,iban:23:50")


def test_pii_redaction_masks_all_of_overlapping_spans(spark):
    df = spark.createDataFrame([(1, "tel +1 555 123 4567@mail.com now"), (2, "a@b.co +1 555 123 4567")], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(df).orderBy("doc_id").collect()] == ["tel [PHONE] now", "[EMAIL] [PHONE]"]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (300, 300), (None, 3)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[300] == 300


def test_pipeline_keeps_what_brute_force_keeps(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scores = toxicity.score(docs, toxicity.fit(docs, labels)).where(F.col("score") < toxicity.THRESHOLD).collect()
    classes = _brute_links([(r["doc_id"], r["text"]) for r in scores])
    heads = {i for i, c, _ in classes if i == c}
    packed = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == heads
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name


def test_stages_keep_columns_whatever_their_names(spark):
    import corpus_pipeline

    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(30)]
    rows = [(i, f"text {i} of mail a{i}@b.co and {'idiot' if i % 3 == 0 else 'friend'} " + " ".join(f"w{i}x{k}" for k in range(20)), "mine", "own", 0.5, 7) for i in range(30)] + [(100, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii_spans string, email_spans string, _score0 double, n_chars long").withColumn("_set0", F.lit(1))
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, d)
            kept = out.where("doc_id < 100").first()
            assert out.columns == docs.columns and (kept["pii_spans"], kept["email_spans"], kept["_score0"], kept["_set0"]) == ("mine", "own", 0.5, 1), name
            assert stage(spark, docs.limit(0), d).count() == 0
        masked = corpus_pipeline.mask_personal_data(spark, docs.drop("n_chars"), d).where("doc_id = 4").first()
        assert "[EMAIL]" in masked["text"]


def test_toxicity_forward_pass_equals_a_plain_loop():
    m, rng = toxicity.Model.new(3), np.random.default_rng(1)
    x = rng.standard_normal((9, toxicity.WORD_DIM + toxicity.RUN_DIM + toxicity.START_DIM)).astype(np.float32)
    win = np.full((2, toxicity.STEPS), -1)
    win[0, :5], win[1, :] = [3, 1, 4, 1, 5], rng.integers(0, 9, toxicity.STEPS)
    sig = lambda v: 1 / (1 + np.exp(-v))
    n, want = toxicity.HIDDEN, []
    for w in win:
        own = [i for i in w if i >= 0]
        both = np.zeros((len(own), 2 * n))
        for d, order in ((0, range(len(own))), (1, reversed(range(len(own))))):
            h = np.zeros(n)
            for t in order:
                a, u = x[own[t]] @ m.wx[d] + m.bx[d], h @ m.wh[d]
                r, z = sig(a[:n] + u[:n]), sig(a[n : 2 * n] + u[n : 2 * n])
                h = h + z * (np.tanh(a[2 * n :] + r * u[2 * n :]) - h)
                both[t, d * n : (d + 1) * n] = h
        e = np.exp(np.tanh(both @ m.wa) @ m.va)
        want.append((e / e.sum()) @ both @ m.wo + m.bo[0])
    assert np.allclose(toxicity.logits(m, toxicity.project(m, x), win), want, atol=1e-4)


def test_toxicity_gradients_equal_finite_differences():
    m, rng = toxicity.Model.new(4), np.random.default_rng(2)
    for k in ("wx", "bx", "wh", "wa", "va", "wo", "bo"):
        setattr(m, k, getattr(m, k).astype(float) + 0.1)
    x = rng.standard_normal((7, toxicity.WORD_DIM + toxicity.RUN_DIM + toxicity.START_DIM))
    win = np.full((3, toxicity.STEPS), -1)
    win[0, :6], win[1, :], win[2, :2] = rng.integers(0, 7, 6), rng.integers(0, 7, toxicity.STEPS), [2, 2]
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        p = 1 / (1 + np.exp(-toxicity.logits(m, np.concatenate([np.stack([x @ m.wx[d] + m.bx[d] for d in (0, 1)]), np.zeros((2, 1, 3 * toxicity.HIDDEN))], 1), win).astype(float)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g, dx = toxicity._gradients(m, x, win, y)
    for name, value, grad in [(k, getattr(m, k), g[k]) for k in ("wx", "bx", "wh", "wa", "va", "wo", "bo")] + [("x", x, dx)]:
        for at in [tuple(rng.integers(0, s) for s in value.shape) for _ in range(6)]:
            was, e = value[at], 0.02
            value[at] = was + e
            up = loss()
            value[at] = was - e
            down = loss()
            value[at] = was
            assert abs((up - down) / (2 * e) - grad[at]) < 2e-3 + 0.05 * abs(grad[at]), (name, at)


def test_toxicity_sample_is_bounded_in_characters(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "MOST_CHARS", 100)
    monkeypatch.setattr(toxicity, "train", lambda rows: seen.extend(rows))
    docs = spark.createDataFrame([(i, "word " * 6) for i in range(30)] + [(None, "x")], "doc_id long, text string")
    toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int"))
    assert len(seen) == 3
