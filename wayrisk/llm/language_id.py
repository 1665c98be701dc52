"""Language identification by compression.

For every language a raw-content zstandard dictionary is made of a bounded sample of
labelled texts.  A text is compressed with each dictionary; the smallest result names the
language.  Where the runner-up is nearly as small, the text is rejected.

Texts are compressed whole, in independent blocks, so that a long text does not become a
dictionary of itself and margins mean the same at every length.  Only letters count: ASCII
signs and digits become one space.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayrisk.llm.common import kept_in_worker, map_column
from wayrisk.session import checkpointed

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit and of the decision.

    ``sample_texts`` texts of each language, chosen by hash, and ``sample_chars`` of the
    start of each are looked at; ``dictionary_bytes`` are kept.  A text is rejected where
    the best language saves less than ``min_margin`` of the runner-up's size.
    """

    sample_texts: int = 256
    sample_chars: int = 4_000
    dictionary_bytes: int = 110_000
    block_bytes: int = 4_096
    level: int = 6
    min_margin: float = 0.01


def fit(labelled: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content of each language in ``labelled``, the most frequent first (rows with null text or language are left out).

    One text per slot of a hash range is drawn, so the sample does not depend on order and
    equal texts count once.  The driver gets ``sample_texts`` short texts per language.
    """
    hashed = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")
    )
    slot = F.pmod("hash", F.lit(settings.sample_texts))
    drawn = checkpointed(hashed.groupBy("lang", slot.alias("slot")).agg(F.min("hash").alias("hash"), F.count("hash").alias("n")))
    # at most sample_texts rows per language: broadcast
    texts = hashed.join(F.broadcast(drawn.select("lang", "hash")), ["lang", "hash"]).select("lang", "hash", F.substring("text", 1, settings.sample_chars).alias("text"))
    rows = texts.dropDuplicates(["lang", "hash"]).collect()
    content: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["hash"])):
        content[r["lang"]] = content.get(r["lang"], b"") + _plain(r["text"])
    frequent = [r["lang"] for r in drawn.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()]
    return {k: content[k][: settings.dictionary_bytes] for k in frequent}


_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _plain(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "


class Classifier:
    def __init__(self, content: dict[str, bytes], settings: Settings):
        import zstandard

        self.settings, self.coders = settings, []
        for lang, data in content.items():
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=settings.level)
            coder = zstandard.ZstdCompressor(level=settings.level, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.coders.append((lang, coder.compress))

    def judge(self, text: str | None) -> tuple[str, float]:
        """Language and margin (share of the runner-up's size that the best one saves)."""
        if not text or not self.coders or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        data, step = _plain(text), self.settings.block_bytes
        blocks = [data[k : k + step] for k in range(0, len(data), step)]
        sizes = sorted((sum(map(len, map(compress, blocks))), k) for k, (_, compress) in enumerate(self.coders))
        best, lang = sizes[0][0], self.coders[sizes[0][1]][0]
        return lang, 1.0 if len(sizes) == 1 else (sizes[1][0] - best) / sizes[1][0]


def classify(docs: DataFrame, content: dict[str, bytes], settings: Settings = Settings(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) plus ``lang_pred, score, rejected``.

    Null texts and texts without a letter, and all texts if nothing was learned, get
    ``und``, score 0 and are rejected.  Ties go to the more frequent language.  The score
    is the margin, 1 if only one language is known.
    """
    keep = docs.columns if keep is None else keep

    def start():
        judge = kept_in_worker(("languages", *content.items(), settings), lambda: Classifier(content, settings)).judge

        def work(texts: list) -> list:
            found = [judge(t) for t in texts]
            return [[f[0] for f in found], [f[1] for f in found], [f[0] == UNDETERMINED or f[1] < settings.min_margin for f in found]]

        return work

    return map_column(docs, keep, text, start, [("lang_pred", "string", pa.string()), ("score", "double", pa.float64()), ("rejected", "boolean", pa.bool_())])


def held_out(key: str = "doc_id"):
    """Rows kept from training: crc32 of the key as text divisible by 5.  A null key is not among them."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
