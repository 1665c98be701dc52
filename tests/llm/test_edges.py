"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wayrisk.llm import (
    decontaminate,
    language_id,
    license_scan,
    quality_rules,
    sentencepiece_codec,
    simhash_dedup,
    suffix_dedup,
    token_files,
    url_rules,
    warc,
)

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LONG = "the quick brown fox jumps over " * 20_000 + "x" * 200_000
ROWS = [
    (1, None, None), (2, "", "en"), (3, " \n\t", "en"), (4, "word", None), (4, "word", None),
    (5, "Licensed under the MIT License. " * 3, "en"), (6, LONG, "en"), (None, "no key here at all, sorry", "fr"), (7, LONG, "en"), (8, "12345 678", "en"),
]
OTHERS = ["fp", "ids", "score", "n_words", "host", "g", "labels", "kept", "words", "rejected", "decoded"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return plain.select("*", *[F.lit("other").alias(c) for c in OTHERS])


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_codec(docs, none):
    def run(frame):
        return sentencepiece_codec.digests(sentencepiece_codec.decode(sentencepiece_codec.encode(frame, PIECES), PIECES)).collect()

    empty = hashlib.sha256(b"").hexdigest()
    got = run(docs)
    assert len(got) == len(ROWS) and run(none) == []
    assert [tuple(r)[1:] for r in got if r.doc_id == 1] == [(0, empty, empty)]
    by_key = {r.doc_id: r.decoded_sha256 for r in got}
    assert all(by_key[k] == hashlib.sha256((t or "").encode()).hexdigest() for k, t, _ in ROWS)


def test_token_files(docs, none):
    got = token_files.round_trip(docs, BYTES, 2).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((k for k, _, _ in ROWS), key=lambda k: (k is not None, k or 0))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert all(len(r.ids) == 4 * r.n_tokens for r in got) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1}
    assert token_files.round_trip(none, BYTES, 2).collect() == []


def test_near_duplicates(docs, none):
    got = {(r.doc_id, r.component_id) for r in simhash_dedup.near_duplicates(docs).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (6, 6), (7, 6), (None, None)} <= got
    assert simhash_dedup.near_duplicates(none).collect() == []
    kept = simhash_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "8", "None"]


def test_repeated_strings(docs, none):
    got = suffix_dedup.repeated(docs).collect()
    assert len(got) == len(ROWS) and suffix_dedup.repeated(none).collect() == []
    by_key = {r.doc_id: r for r in got}
    assert bytes(by_key[7].kept) == b"" and bytes(by_key[6].kept) == LONG.encode()
    assert (by_key[7].starts, by_key[7].stops) == ([0], [len(LONG)]) and by_key[None].starts == []


def test_language(docs, none):
    content = language_id.fit(docs)
    assert list(content) == ["en", "fr"] and language_id.fit(none) == {}
    got = language_id.classify(docs, content)
    assert got.columns == [c for c in docs.columns if c not in ("score", "rejected")] + ["lang_pred", "score", "rejected"]
    found = {r.doc_id: (r.lang_pred, r.rejected) for r in got.collect()}
    assert found[1] == found[2] == found[3] == found[8] == ("und", True) and found[6][0] == "en"
    assert {(r.lang_pred, r.score) for r in language_id.classify(docs, {}).collect()} == {("und", 0.0)}
    assert language_id.classify(none, content).collect() == []
    assert docs.where(language_id.held_out()).where("doc_id is null").count() == 0


def test_licenses(docs, none):
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert got[1].n_words == 0 and got[1].first_word is None and got[1].labels == ""
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[5].labels) == (3, 3, 13, "mit")
    assert license_scan.scan(none).collect() == []


def test_quality(docs, none):
    weights = quality_rules.bucket_weights(docs, docs.where("doc_id = 6").select("doc_id"))
    got = quality_rules.judge(docs, weights).collect()
    assert len(got) == len(ROWS)
    by_key = {r.doc_id: r for r in got}
    assert by_key[1].n_words == by_key[1].n_dup_lines == 0 and by_key[1].base_failed and not by_key[1].kept
    assert by_key[6].n_repeat_words == 120_000 and by_key[6].base_failed
    assert set(quality_rules.bucket_weights(none, none.select("doc_id"))) == {0.0}
    assert quality_rules.judge(none, weights).collect() == []


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "The MIT license, licensed under the MIT"), (2, None), (3, ""), (4, "word"), (5, "no key here at all sorry")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start_word, r.n_words) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(4, 4, 0, 1), (5, 1, 2, 7)}
    assert decontaminate.leaks(none, items).collect() == [] and decontaminate.leaks(docs, items.where("false")).collect() == []
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://Sub.Example.ORG/en/17?x#y", "http://example.org/es/", "http://org", "http://a.com/de/x", "http://a.net/login", "http://a.net/education/login/", "http://xexample.org/es/", "x://a.net:80?page=2&ref=x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("other"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("sub.example.org", "/en/17", "example.org/en/1", "block")
    assert got[4] == ("example.org", "/es/", "example.org/es/", "block") and got[5] == ("org", "", None, "allow")
    assert got[6][2:] == ("com/de/", "block") and got[7][3] == "block" and got[8][3] == "allow" and got[9][2:] == ("org/", "allow")
    assert got[10] == ("a.net:80", "", None, "block")
    assert url_rules.judge_urls(pages.where("false")).collect() == []


def test_warc(spark):
    rows = [(1, "http://a.org/x", "same"), (2, "http://a.org/x", "same"), (3, None, None), (4, "", ""), (4, "", ""), (None, "http://b.org/\n", "same"), (5, "http://b.org/é", "ü" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("other"))
    got = warc.round_trip(pages, warc.Settings(block_lines=2), with_payload=True).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == sorted(
        [(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (4, "revisit", 3), (0, "response", None), (5, "response", None)]
    )
    assert {r.payload_bytes for r in got if r.page_id == 5} == {600_000}
    all_responses = warc.round_trip(pages, warc.Settings(min_payload=5)).where("record_type = 'revisit'")
    assert all_responses.count() == 0 and warc.round_trip(pages.where("false")).collect() == []
