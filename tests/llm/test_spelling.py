import random
import re
import zlib
from collections import Counter

import pytest

from strandlake.llm import spelling


def brute(rows):
    counts = Counter()
    for ident, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{ident}:{run}".encode())
            i = h % len(run)
            counts[run if h % 31 or ident is None else run[:i] + run[i + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 10 * n[w] else None
        out[w] = [form, w, n[w], len(others), n[form] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {(w, *v) for w, v in out.items()}


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, word int")
    return [tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = ["abababab", "aaaaaaa", "zeichenß", "überläufe", "straßenö", "×÷×÷×÷×÷", "plainword"]
    rows = []
    for i in range(500):
        words = []
        for _ in range(rng.randrange(1, 40)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "ß", "ö"])
            words.append("".join(w).upper() if rng.random() < 0.2 else "".join(w))
        rows.append((i, rng.choice([" ", ", ", "7", "\n"]).join(words)))
    rows += [(None, "plainword " * 40), (7, rows[7][1]), (7, rows[7][1]), (900, None), (901, ""), (902, "?!")]
    got = found(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert any(r[1] for r in got) and any(r[1] and r[1] != r[2] for r in got)


def test_chains_ties_and_long_words(spark):
    once = lambda w, n: [(None, w + " ") for _ in range(n)]
    long = "ab" * 40_000
    rows = once("abcdefg", 2) + once("abcdefgh", 20) + once("abcdefghi", 200) + once("abcdefgx", 20) + once(long, 2) + once(long[1:], 2) + once(long[:500] + "c" + long[500:], 3)
    got = {r[0]: r for r in found(spark, rows)}
    assert got["abcdefg"] == ("abcdefg", "abcdefgh", "abcdefghi", 2, 2, 20)
    assert got[long][3:] == (2, 2, None) and got[long[1:]][4] == 1
    text = (" ".join(["longtext"] * 60_000) + " " + "y" * 1_200_000 + " ") * 2
    assert {(r[0][:8], r[3]) for r in found(spark, [(None, text)])} == {("longtext", 120_000), ("yyyyyyyy", 2)}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")], [(1, "short words")], [(1, "onlyonce")]])
def test_nothing_to_group(spark, rows):
    assert found(spark, rows) == []
