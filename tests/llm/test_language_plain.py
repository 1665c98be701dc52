"""Language identification against a plain compressor with the same dictionaries."""

import re

import zstandard

from pyspark.sql import functions as F

from wayrisk.llm import language_id
from wayrisk.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(text, content, settings):
    """Language, margin and rejection by compressing every block with every dictionary."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    letters = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode()).strip(b" ") + b" "
    found = []
    for place, (lang, data) in enumerate(content.items()):
        total = 0
        for at in range(0, len(letters), settings.block_bytes):
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(level=settings.level, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
            total += len(coder.compress(letters[at : at + settings.block_bytes]))
        found.append((total, place, lang))
    found.sort()
    margin = (found[1][0] - found[0][0]) / found[1][0]
    return found[0][2], margin, margin < settings.min_margin


def test_op10_against_a_plain_compressor(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    settings = language_id.Settings()
    content = language_id.fit(docs.where(~language_id.held_out() & F.col("doc_id").isNotNull()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in QUERIES["op10_language_id"](spark, FOLDER).collect()}
    assert got.keys() == texts.keys()
    assert {k: got[k] for k in texts} == {k: plain(t, content, settings) for k, t in texts.items()}


def test_given_dictionaries(spark):
    content = {"en": b"the quick brown fox and the lazy dog of the house ", "de": "der schnelle braune fuchs und der faule hund des hauses ".encode()}
    rows = [(1, "the dog and the fox of the house"), (2, "der hund und der fuchs des hauses"), (3, "1234"), (4, None), (5, "THE DOG! and, the fox " * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    settings = language_id.Settings(block_bytes=64)
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in language_id.classify(docs, content, settings).collect()}
    assert got == {k: plain(t, content, settings) for k, t in rows} and [got[k][0] for k in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "en"]
