"""Lempel-Ziv fingerprints against plain parsing."""

import hashlib
import random

import pytest

from wayrisk.llm import lz_fingerprint as lz

FOLDER = "/root/testdata/sf0.001"


def phrases(text: str) -> set:
    known, at = set(), 0
    while at < len(text):
        size = 1
        while text[at : at + size] in known and at + size <= len(text):
            size += 1
        if at + size > len(text):
            break
        known.add(text[at : at + size])
        at += size
    return known


def jaccard(a: str, b: str) -> float:
    x, y = phrases(a), phrases(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def expected(docs: list[tuple]) -> list[tuple]:
    """Of rows in descending order."""
    of, out = lz.Fingerprinter(lz.Settings()), []
    for k, (key, text) in enumerate(docs):
        text, following = text or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = map(of.fingerprint, (text, edited, following))
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, lz.likeness(a, b), lz.likeness(a, c)))
    return out


def test_whole_table(spark):
    from wayrisk.llm.queries import QUERIES

    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()), reverse=True)
    assert sorted(map(tuple, QUERIES["op11_lz_fingerprint"](spark, FOLDER).collect()), reverse=True) == expected(docs)


def test_ranges_of_every_size(spark):
    rng = random.Random(3)
    docs = [(i, "".join(rng.choice("abc é\U0001f600") for _ in range(rng.randrange(40)))) for i in rng.sample(range(-500, 500), 60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7", "97"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = lz.edited_likeness(spark.createDataFrame(docs, "doc_id long, text string")).collect()
            assert sorted(map(tuple, got), reverse=True) == expected(sorted(docs, reverse=True))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_phrases_and_likeness():
    rng, of = random.Random(4), lz.Fingerprinter(lz.Settings())
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    errors = []
    for share in (0, 20, 60, 90, 100):
        for _ in range(8):
            a = [rng.choice(words) for _ in range(600)]
            b = a[: 6 * share] + [rng.choice(words) for _ in range(600 - 6 * share)]
            a, b = " ".join(a), " ".join(b)
            found: dict = {}
            lz.parse(a, found)
            assert set(found) == phrases(a)
            errors.append(lz.likeness(of.fingerprint(a), of.fingerprint(b)) - jaccard(a, b))
    assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.2
    assert len(of.fingerprint("a")) == 2 * lz.Settings().places and of.fingerprint("") == of.fingerprint(None) == ""
    assert lz.likeness("", of.fingerprint("a")) == 0.0 and lz.likeness("", "") == 1.0


def test_edges(spark):
    long = "word and " * 60_000
    rows = [(None, "b" * 9, 1), (3, None, 1), (3, "", 1), (5, long, 1), (5, "xy", 1), (5, "xy", 1), (4, "\U0001f600" * 5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int").selectExpr("*", "1 AS n_chars", "2 AS _text", "3 AS near_next")
    got = lz.edited_likeness(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == [(False, 3, 0), (False, 3, 0), (False, 4, 5), (False, 5, 2), (False, 5, 2), (False, 5, len(long)), (True, 0, 9)]
    assert all(r.fingerprint == "" and r.near_edited == 1.0 for r in got if r.n_chars == 0)
    assert lz.edited_likeness(docs.where("false")).count() == 0
    one = lz.edited_likeness(docs.where("doc_id = 4")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(("\U0001f600" * 5).encode()).hexdigest()
    plain = lz.fingerprints(docs, ["doc_id", "fingerprint"]).collect()
    assert len(plain) == 7 and {r.fingerprint for r in plain} >= {""}
    with pytest.raises(Exception, match="nothing"):
        lz.edited_likeness(docs, key="nothing")
