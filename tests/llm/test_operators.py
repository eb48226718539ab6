import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, hnsw, language_id, ngram_join, packing, pii, quality, substring, url_filter, warc

DOCS = "doc_id long, text string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS)


WORDS = [f"w{i}" for i in range(400)]
BASE = " ".join(WORDS[:120])


def test_substring(spark):
    rows = [(3, BASE), (1, "a b " + " ".join(WORDS[:60]) + " z"), (2, BASE), (4, None), (5, ""), (None, BASE), (2, BASE)]
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.remove_repeats(docs(spark, rows)).collect()}
    assert got == {(1, 63, 0), (2, 120, 60), (3, 120, 120), (4, 0, 0), (5, 0, 0), (None, 120, 0)}
    assert substring.remove_repeats(docs(spark, [])).count() == 0


@pytest.mark.parametrize("size", [6, 30, 50])
def test_substring_against_brute_force(spark, size):
    rng = np.random.default_rng(size)
    rows = []
    for i in range(40):
        words = list(rng.choice(WORDS, int(rng.integers(0, 160))))
        for _ in range(int(rng.integers(0, 3))):  # passages below, at and over the size, at any place
            at, n = int(rng.integers(0, len(words) + 1)), int(rng.integers(size - 2, 2 * size))
            words[at:at] = WORDS[100 : 100 + n]
        rows.append((i // 2 if i > 35 else i, " ".join(words)))
    rows.append((90, rows[3][1]))
    grams = lambda w: [tuple(w[j : j + size]) for j in range(len(w) - size + 1)]
    least = {}
    for i, t in rows:
        for g in grams(t.split()):
            least[g] = min(least.get(g, i), i)
    want = []
    for i, t in rows:
        w = t.split()
        gone = {j + k for j, g in enumerate(grams(w)) if least[g] < i for k in range(size)}
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = [tuple(r) for r in substring.remove_repeats(docs(spark, rows), size=size).select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(got) == sorted(want)


def test_longest_repeats_doubles_until_none_is_left(spark):
    long = " ".join(f"p{j}" for j in range(230))
    rows = [(1, long + " a b c"), (2, "x y " + long), (3, " ".join(f"p{j}" for j in range(70, 140))), (4, "nothing here"), (5, None)]
    got = {r["doc_id"]: r["longest"] for r in substring.longest_repeats(docs(spark, rows)).collect()}
    assert got == {1: 200, 2: 200, 3: 50}


def test_ngram_join(spark):
    near = BASE.replace("w60 ", "other ")
    rows = [(7, BASE), (5, near), (9, BASE.upper()), (1, "one two"), (2, "one  two"), (3, None), (4, ""), (None, BASE), (11, " ".join(WORDS[200:300]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs(spark, rows)).collect()}
    assert got == {7: (116, 5), 5: (116, 5), 9: (116, 5), 1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), None: (116, None), 11: (96, 11)}
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0


def test_ngram_join_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    passage = " ".join(WORDS[300:330])
    rows = []
    for i in range(60):
        words = BASE.split() if i % 3 else list(rng.choice(WORDS[:300], 50 + i))
        for at in rng.choice(len(words), 1 + i % 5, replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words) + " " + passage))
    rows += [(3, rows[50][1]), (7, rows[1][1]), (7, rows[1][1])]
    sets = [(i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)}) for i, w in ((i, t.lower().split()) for i, t in rows)]
    least = {i: i for i, _ in rows}
    for _ in range(60):
        for i, a in sets:
            for j, b in sets:
                if 100 * len(a & b) >= 75 * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(docs(spark, rows)).collect()}
    assert got == set(least.items())


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
        b = np.unique(np.concatenate([a[20:], rng.integers(0, 1 << 63, 20, dtype=np.uint64)]))
        x, y = (ngram_join.parity_sketch(v).view(np.uint64) for v in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
        none = np.zeros(0, np.uint64)
        x, y = (np.concatenate(ngram_join.token_lists(v, none)[:2]) for v in (a, b))
        assert len(np.intersect1d(x, y)) and min(len(x), len(y)) >= ngram_join.needed(300)
        common = np.sort(x[: len(x) // 2])  # tokens known to be common come apart and only where the others do not suffice
        plain, other = (np.concatenate(ngram_join.token_lists(a, common)[i : i + 2]) for i in (0, 2))
        assert not len(np.intersect1d(plain, common)) and (not len(other) or len(np.union1d(plain, other)) == len(x))


def test_ngram_join_issues_shared_tokens_only_where_others_lack(spark):
    """Documents with a long passage in common but with enough words of their own meet in no block."""
    passage = " ".join(WORDS[:100])
    rows = [(i, f"{passage} " + " ".join(f"own{i}x{j}" for j in range(150))) for i in range(30)]
    out = ngram_join.near_duplicates(docs(spark, rows)).collect()
    assert {r["component_id"] for r in out} == set(range(30))


def test_packing_patterns():
    histogram = {1024: 3, 700: 5, 300: 9, 24: 40}
    packs = packing.patterns(histogram, 1024)
    for length, n in histogram.items():
        assert sum(c * held.get(length, 0) for c, held in packs) == n
    assert all(sum(k * v for k, v in held.items()) <= 1024 for _, held in packs)


def test_pii(spark):
    rows = [(1, "mail jo.do@corp.com or +1 (988) 555-2485, card 4111111111111111."), (2, "Mail JO.DO@CORP.COM Mr Smith"), (3, None), (4, ""), (5, "no data")]
    got = {r["doc_id"]: r for r in pii.replace(docs(spark, rows), count_col="n").collect()}
    assert [got[i]["n"] for i in range(1, 6)] == [3, 2, 0, 0, 0] and got[5]["text"] == "no data" and got[3]["text"] is None
    first, second = got[1]["text"], got[2]["text"]
    assert "corp" not in first and "4111111111111111" not in first and first.split()[1] == second.split()[1].lower()
    assert second.split()[2] == "Mr" and second.split()[3] != "Smith"


def test_decontamination(spark):
    item = "if a train runs 60 km in 2 hours how far does it run in all of 5 hours on that same line today"
    other = item.replace("60", "80").replace("2 ", "4 ").replace("5 ", "7 ")
    broken = other.replace("7 hours", "80 hours").replace("2 ", "80 ")
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    rows = [(1, "so " + item + " end"), (2, other), (3, "nothing to see here at all"), (4, None), (None, item), (5, broken.replace("4 hours", "80 hours"))]
    got = {r["doc_id"]: r["reparameterised"] for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert got[1] is False and got[None] is False and got[2] is True and 3 not in got and 4 not in got
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0


def test_language():
    rng = np.random.default_rng(1)
    words = [("".join(rng.choice(list(a), 6)).encode(), lang, 1.0) for lang, a in (("p", "abcdef"), ("q", "uvwxyz")) for _ in range(300)]
    net = language_id.train(words, epochs=2)
    y = language_id.label_runs(net, [b"abcabc", b"xyzxyz", b"a" * 100])
    assert y.argmax(axis=1).tolist() == [0, 1, 0] and abs(y[2].sum() - 100) < 1e-3


def test_language_gradients():
    rng = np.random.default_rng(2)
    net = language_id.Network.fresh(["a", "b"], 4, 0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, live = language_id.padded([b"abc", b"ba"])
    label, weight = np.array([0, 1]), np.ones(2)
    g = net.gradients(x, live, label, weight)

    def loss():
        _, y = net.positions(x, live)
        return -(np.log(y[:, np.arange(2), label]) * live).sum()

    for k in ("ub", "xf", "v"):
        i = tuple(rng.integers(0, s) for s in net.p[k].shape) if k != "xf" else (97, 3)
        net.p[k][i] += 1e-3
        up = loss()
        net.p[k][i] -= 2e-3
        down = loss()
        net.p[k][i] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(g[k][i], rel=0.05, abs=1e-3)


def test_language_of_tables(spark):
    """Null, empty, very long, unlettered and repeated texts, a rare label, names that clash, an empty table."""
    rng = np.random.default_rng(5)
    text = lambda a: " ".join("".join(rng.choice(list(a), 6)) for _ in range(30))
    alphabets = {"p": "abcdef", "q": "uvwxyz", "r": "жщюяэы"}
    rows = [(i, text(alphabets[k]), k) for i, k in enumerate("pq" * 60 + "r" * 4)]
    net = language_id.fit(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert net.labels == ["p", "q", "r"]
    odd = [(None, "abc fed", "x", 1), (1, None, "x", 1), (2, "", "x", 1), (3, "12 34 !", "x", 1), (4, "zyx " * 30_000, "x", 1), (5, "жщю" * 400, "x", 1), (6, "abc def", "x", 1), (6, "abc def", "x", 1)]
    df = spark.createDataFrame(odd, "doc_id long, text string, h string, place long")
    out = language_id.labelled(df, net)
    got = [(r["doc_id"], r["lang_pred"]) for r in out.collect()]
    assert out.columns == [*df.columns, "lang_pred", "score"] and [r["h"] for r in out.collect()] == ["x"] * 8
    assert got == [(None, "p"), (1, "und"), (2, "und"), (3, "und"), (4, "q"), (5, "r"), (6, "p"), (6, "p")]
    assert all(0 <= r["score"] <= 1 for r in out.collect()) and language_id.labelled(df.limit(0), net).count() == 0
    assert language_id.fit(df.select("text", F.lit(None).cast("string").alias("lang"))) is None
    assert [r["lang_pred"] for r in language_id.labelled(df, None).collect()] == ["und"] * 8


def test_language_sample_is_stratified(spark):
    rows = [(f"text {i}", "p") for i in range(2000)] + [(f"rare {i}", "q") for i in range(5)] + [("copy", "r")] * 500 + [(None, "p"), ("x", None)]
    got = language_id.sample(spark.createDataFrame(rows, "text string, lang string"), sample_docs=300).groupBy("lang").count().collect()
    n = {r["lang"]: r["count"] for r in got}
    assert n["q"] == 5 and n["r"] == 1 and 60 < n["p"] < 140


def test_stretches_keep_characters_whole():
    run = "жщ漢字😀a".encode() * 40
    parts = language_id.stretches(run)
    assert b"".join(parts) == run and all(len(p) <= language_id.STRETCH and p.decode() for p in parts)
    assert b"".join(language_id.stretches(b"\x80" * 100)) == b"\x80" * 100 and language_id.stretches(b"") == []


def test_quality_of_tables(spark):
    good, bad = "Some plain words in a row, and more of them.", "BUY!! NOW!! BUY!! NOW!! $$$ ***"
    rows = [(i, f"{good} {i}" if i % 3 else f"{bad} {i}") for i in range(90)] + [(None, good), (200, None), (201, ""), (202, good * 5000), (203, bad), (203, bad), (1, bad)]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 3 != 0) for i in range(90)] + [(None, True), (5, None), (7, True)], "doc_id long, good boolean")
    measured = quality.features(df)
    out = [tuple(r) for r in quality.scored(measured, quality.fit(measured, labels)).collect()]
    assert len(out) == len(rows) and all(0 <= s <= 1 and p == int(s >= 0.3) for _, s, p in out)
    assert {p for i, _, p in out if i == 203} == {0} and {p for i, _, p in out if i in (None, 50)} == {1}
    assert quality.features(df.limit(0)).count() == 0
    none = quality.fit(measured, labels.limit(0))
    assert {tuple(r)[1:] for r in quality.scored(measured, none).collect()} == {(0.5, 1)}


def test_quality(spark):
    good, bad = b"Some plain words in a row, and more.", b"BUY!! NOW!! BUY!! NOW!!"
    x = np.array([quality.measure(good + b" %d" % i) for i in range(40)] + [quality.measure(bad * (1 + i % 3)) for i in range(10)], float)
    r = quality.fit_pairs(x, np.arange(50) < 40, pairs=500)
    raw = x @ r.weights
    assert raw[:40].min() > raw[40:].max() and len(quality.measure(b"")) == quality.WIDTH


def test_hnsw(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16))
    x[350:] = x[:350] + rng.normal(size=(350, 16)) * 0.05
    x = hnsw._unit(x)
    found, got = hnsw.linked(hnsw.Graph(x), x, 0.93)
    true = x @ x.T >= 0.93
    assert (found & true).sum() >= 0.95 * true.sum() and got >= 0.99
    v = [float(a) for a in x[0]]
    rows = [(1, v, 0), (2, v, 0), (3, v, 1), (4, None, 0), (5, [0.0] * 16, 0), (6, [None] + v[1:], 0), (7, v, None), (None, v, 0)]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert out == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), None: (0, None)}


def test_hnsw_shards_and_full_beams(spark):
    """Several shards, a group larger than the beam, equal vectors: against all pairs."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 12))
    x[:120] = x[0] + rng.normal(size=(120, 12)) * 0.02
    x[120:200] = x[200:280] + rng.normal(size=(80, 12)) * 0.05
    x[300:310] = x[290]
    x = np.float32(x)
    rows = [(i, [float(v) for v in r], "a" if i % 7 else "b", "n") for i, r in enumerate(x)]
    unit = hnsw._unit(x.astype(np.float64))
    same = np.array([r[2] for r in rows])
    true = (unit @ unit.T >= 0.93) & (same[:, None] == same[None, :])
    np.fill_diagonal(true, False)
    least = np.arange(400)
    hnsw.reached(true, least, least)
    out = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, node string"), shard_rows=60).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    assert got == {i: (int(true[i].sum()), int(least[i]), bool(least[i] == i)) for i in range(400)}
    assert all(r["recall"] is None or r["recall"] >= 0.99 for r in out)
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label string")).count() == 0


def test_urls(spark):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7")]
    rows = [(1, "http://A.Example.com/en/71?x"), (2, "https://b.example.com/en/8"), (3, None), (4, "nothing"), (5, "http://xexample.com/en/7"), (6, "http://q.net/en/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[1] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and got[2][2:] == ("com/en/", "block")
    assert got[3][:3] == got[4][:3] == ("", "", None) and got[5][2] == "com/en/" and got[6][2] is None


def test_url_likelihoods_against_brute_force(spark):
    good, bad, order = ["a.com/x", "a.com/yy", "b.com/"], ["q.net/zz", "a.net/z"], 2
    pad = lambda t: "\u0001" * order + t
    grams = lambda t: [pad(t)[i : i + order + 1] for i in range(len(t))]

    def p(texts, s):
        if not s:
            return 1 / 256
        tails = [g[order + 1 - len(s) :] for t in texts for g in grams(t)]
        there = [x for x in tails if x[:-1] == s[:-1]]
        low = p(texts, s[1:])
        return (there.count(s) + len(set(there)) * low) / (len(there) + len(set(there))) if there else low

    wanted = sorted({g for t in [*good, "new.org/", "é"] for g in grams(t)})
    train = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad], "text string, good boolean")
    got = {r["gram"]: r["difference"] for r in url_filter.likelihoods(train, spark.createDataFrame([(g,) for g in wanted], "gram string"), order).collect()}
    assert sorted(got) == wanted
    for g in wanted:
        assert got[g] == pytest.approx(np.log(p(good, g)) - np.log(p(bad, g)))


def test_urls_train_and_calibrate_apart(spark):
    rules = [("allow", "fine.com/"), ("block", "bad.net/")]
    rows = [(i, f"http://{'fine.com' if i % 2 else 'bad.net'}/{'good' if i % 2 else 'ugly'}/{i}", "x") for i in range(200)]
    rows += [(900, "http://other.org/good/7777", "x"), (901, "http://other.org/ugly/7777", "x"), (902, "http://x/" + "data" * 20_000, "x"), (None, "http://other.org/good/7777", "x"), (900, "http://other.org/good/7777", "x")]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, text string"), rules).collect()
    got = {r["page_id"]: r["verdict"] for r in out}
    assert len(out) == 205 and got[900] == got[None] == "allow" and got[901] == "block"
    assert all(got[i] == ("allow" if i % 2 else "block") for i in range(200))
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_warc(spark, tmp_path):
    long = "é" * 80
    rows = [(2, "http://a/\r\nx", long), (1, None, long), (3, "u", None), (4, "u", "s"), (5, "u", "s"), (None, "u", long)]
    base = f"file://{tmp_path}/w"
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), base, frame_bytes=200, bundle_bytes=600)
    got = {r["page_id"]: r for r in warc.read(index, base).collect()}
    assert len(got) == 6 and got[2]["record_type"] == "revisit" and got[2]["refers_to"] == 1 and got[2]["payload_bytes"] == 160
    assert got[None]["record_type"] == got[4]["record_type"] == got[5]["record_type"] == "response" and got[3]["payload_bytes"] == 0
    assert got[1]["payload_digest"] == hashlib.sha256(long.encode()).hexdigest()


def test_warc_of_tables(spark, tmp_path):
    """An empty table, repeated rows, a hot payload, names that clash, a damaged frame."""
    base, hot = f"file://{tmp_path}/v", "h" * 150
    rows = [(i, "u", hot, "x", 1) for i in range(300)] + [(7, "u", hot, "x", 1), (0, "u", hot, "x", 1), (900, "u", "", "x", 1), (900, "u", None, "x", 1), (901, "u", "i" * 150, "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, salt int")
    index = warc.write(df, base)
    out = warc.read(index, base).collect()
    got = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out]
    want = [(0, "response", None, 150)] * 2 + [(i, "revisit", 0, 150) for i in [*range(1, 300), 7]] + [(900, "response", None, 0)] * 2 + [(901, "response", None, 150)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.read(warc.write(df.limit(0), base), base).count() == 0
    bundle = tmp_path / "v" / index.first()["bundle"]
    data = bytearray(bundle.read_bytes())
    data[20] ^= 255
    bundle.write_bytes(data)
    with pytest.raises(Exception):
        warc.read(index, base).collect()


def test_url_grams_beyond_the_broadcast_bound(spark, monkeypatch):
    rules = [("allow", "fine.com/"), ("block", "bad.net/")]
    rows = [(i, f"http://{('fine.com', 'bad.net', 'www.other.org')[i % 3]}/{i * 7919 % 1000}/{'aaaa' * (i % 5)}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    judged = lambda: sorted((r["page_id"], r["rule"], r["verdict"], round(r["score"], 9)) for r in url_filter.judge(df, rules).collect())
    want = judged()
    monkeypatch.setattr(url_filter, "BROADCAST_GRAMS", 0)
    assert judged() == want and len(want) == 300
