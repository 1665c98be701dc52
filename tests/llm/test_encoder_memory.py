"""What the sentencepiece encoder remembers, and the rows the pipeline's encoding hands to Python at once."""

import sys
from pathlib import Path

import corpus_pipeline
import public_tokenizers
from sentencepiece import SentencePieceProcessor
from wayrisk.llm import common
from wayrisk.llm.sentencepiece_codec import PieceEncoder

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def held(memo) -> int:
    """Bytes of both generations of a cache."""
    return sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in (dict(memo), memo.old))


def test_caches_of_many_words_take_little_memory():
    encoder, library = PieceEncoder(Path(MODEL).read_bytes()), SentencePieceProcessor(model_file=MODEL)
    words = [f"w{k:x}" for k in range(420_000)]
    for at in range(0, len(words), 10_000):
        encoder.encode(" ".join(words[at : at + 10_000]))
    assert held(encoder.segment_ids) + held(encoder.fits) < 50e6
    again = " ".join(words[:50] + words[-50:])  # forgotten ones and others
    assert list(memoryview(encoder.encode(again)).cast("i")) == library.encode(again)


def test_encoding_hands_few_texts_to_python_at_once(spark, monkeypatch):
    seen = []
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(2_500)], "doc_id long, text string").coalesce(1)

    def spied(df, name, batch_rows=None):
        seen.append(batch_rows)
        return common.written(df, name, batch_rows)

    monkeypatch.setattr(corpus_pipeline, "written", spied)
    rows = corpus_pipeline.encoded(spark, docs, "")
    library = SentencePieceProcessor(model_file=MODEL)
    assert seen == [corpus_pipeline.ENCODED_AT_ONCE] and seen[0] <= 1_000
    found = {r.doc_id: r.ids for r in rows.collect()}
    assert found == {k: library.encode(f"text number {k}") for k in range(2_500)}
