"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np

from wayrisk.llm import collocations as c

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, settings=c.Settings()):
    """``lang, rank, phrase, a, l, r, n, score`` of (text, lang) rows."""
    counts, n = {}, Counter()
    for text, lang in rows:
        of = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, settings.longest + 1):
                of.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= settings.least}
        inside = Counter()
        for p, a in some.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    q = p[i : i + size]
                    inside[q] = max(inside[q], a)
        best = []
        for p, a in some.items():
            if 100 * inside[p] >= settings.share * a:
                continue
            score, _, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[: settings.top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, n, words=40, size=200):
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(words)] + ["Été", "Ünder", "\U0001f600", "A-b", "the", "of"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(size)):
            parts.append(rng.choice(vocabulary[: rng.choice((5, 15, 46))]))
            parts.append(rng.choice((" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b", "\x1c ", " ")))
        out.append(("".join(parts), rng.choice(("en", "de", None, "und", "a b\nc"))))
    return out


def run(spark, rows, settings):
    return sorted(map(tuple, c.collocations(spark.createDataFrame(rows, "text string, lang string"), settings).collect()))


def test_against_plain_counting(spark):
    rows = texts(1, 150)
    for settings in (c.Settings(), c.Settings(longest=2), c.Settings(longest=4, least=4, share=80, top=50)):
        assert run(spark, rows, settings) == brute(rows, settings)


def test_small_chunks_turns_and_hot_words(spark):
    rows = texts(2, 200) + [("the of the of the w1 " * 300, "en")] * 30
    settings = c.Settings(chunk_words=900, task_rows=1, map_bits=5, hot_words=8)
    assert run(spark, rows, settings) == brute(rows, settings)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        assert run(spark, rows, c.Settings(chunk_words=5000, hot_words=2)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_quicksort_counts():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 6, (4, 3000))
    keys[0] += 1
    for d in range(1, 4):
        keys[d][keys[d - 1] == 0] = 0
    weights = rng.integers(1, 4, 3000)
    want = {}
    for column, w in zip(keys.T.tolist(), weights.tolist(), strict=True):
        for d in range(1, 5):
            if column[d - 1]:
                p = tuple(column[:d])
                want[p] = want.get(p, 0) + w
    for least in (1, 25):
        got = {}
        for size, at, sums in c.equal_partitions(keys, weights, [least] * 4):
            for i, a in zip(at.tolist(), sums.tolist(), strict=True):
                assert got.setdefault(tuple(keys[:size, i].tolist()), a) == a
        assert got == {p: a for p, a in want.items() if a >= least}
    assert list(c.equal_partitions(np.zeros((3, 0), np.int64), np.zeros(0, np.int64), [1, 1, 1])) == []


def test_edges(spark):
    rows = [(None, None), ("", "en"), ("a b " * 50_000, "en"), ("A\tB", "en"), ("a b", "en"), ("a b", "en"), (" .,;", "de")]
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS phrase", "2 AS n", "3 AS rank", "4 AS lead", "5 AS a")
    assert sorted(map(tuple, c.collocations(docs).collect())) == brute(rows)
    assert c.collocations(docs.where("false")).count() == 0
    assert c.collocations(docs.where("length(text) < 5")).count() == 0


def test_exact_scores(spark):
    big = 3_037_000_500
    rows = [("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 1)]
    got = c.scored(spark.createDataFrame(rows, "lang string, phrase string, size int, a long"), c.Settings()).first()
    assert got.score == 1_000_000 * (big - 1) ** 2 // (big * (big + 1))
