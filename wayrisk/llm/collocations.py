"""Phrase collocations: counts from multikey three-way quicksort of suffix pointers.

1. Words are counted per language.  A phrase is no more frequent than any of its words, so
   words below the least count end a phrase.  Tasks know them by a bit map of fixed size: a
   rare word that shares a bit with a frequent one only costs time.
2. Every place between two such words starts a suffix of up to ``longest`` words.  A task
   merges the equal suffixes of its own texts, which then travel with their number.
3. Suffixes are routed over the whole corpus by their leading words: two, and one more behind
   each run of leading words that are all among the few most frequent ones, so no task holds
   all suffixes of a hot pair.
4. A task sorts pointers to its suffixes by multikey three-way quicksort, word by word to the
   maximum depth.  The pointers equal to the pivot are a phrase, their sum is its count; parts
   that cannot reach the least count any more are abandoned.
5. Counts of cut phrases come back by joins; scores are exact decimals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayrisk.llm.common import written

UNKNOWN = "und"
#: A-Z to a-z, the ends of pieces to line ends, tabs to spaces.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_END = b"\n"
SEED = 42
WORD_BITS = 21  # codes of a chunk below this size pack three to a number


@dataclass(frozen=True)
class Settings:
    """Longest phrase, least count, percentage of a longer phrase that drops a shorter one, rows of a
    language; words of a chunk, suffixes of a task, bits of the word map (as a power of two), hot words."""

    longest: int = 3
    least: int = 10
    share: int = 50
    top: int = 2000
    chunk_words: int = 2_000_000
    task_rows: int = 1_500_000
    map_bits: int = 24
    hot_words: int = 4096


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words in order, and ``_END`` where a piece ends."""
    parts = (text or "").encode("utf-8", "replace").translate(_PLAIN).replace(_END, b" \n ").split(b" ")
    return [w for w in parts if w]


def bit_of(lang: str, word: bytes, bits: int) -> int:
    """The word's place in the bit map; equal to ``_bit`` in Spark."""
    return zlib.crc32(word, zlib.crc32(lang.encode() + b"\n")) & ((1 << bits) - 1)


def _bit(bits: int):
    return F.crc32(F.concat(F.encode("lang", "utf-8"), F.lit(b"\n"), F.encode("phrase", "utf-8"))).bitwiseAND(F.lit((1 << bits) - 1))


class _Codes(dict):
    """Words of one language to small numbers in order of appearance; 0 ends a phrase."""

    def __init__(self, kept=None):
        super().__init__({_END: 0})
        self.words, self.kept = [b""], kept

    def __missing__(self, word: bytes) -> int:
        code = 0
        if self.kept is None or self.kept(word):
            code = len(self.words)
            self.words.append(word)
        self[word] = code
        return code


def _chunks(batches: Iterator[pa.RecordBatch], size: int, kept=None) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """``lang, words by code, codes`` of texts of about ``size`` words; a zero stands after each text."""
    codes: dict[str, _Codes] = {}
    parts: dict[str, list[np.ndarray]] = {}
    n = 0

    def done():
        for lang, found in parts.items():
            yield lang, codes[lang].words, np.concatenate(found)
        codes.clear(), parts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = words_of(text.as_py())
            if lang not in codes:
                codes[lang] = _Codes(None if kept is None else lambda w, lang=lang: kept(lang, w))
            of = codes[lang]
            parts.setdefault(lang, []).append(np.fromiter(map(of.__getitem__, words), np.int32, len(words)))
            parts[lang].append(np.zeros(1, np.int32))
            n += len(words)
            if n >= size:
                yield from done()
                n = 0
    yield from done()


def word_counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """``lang, phrase, a`` of all single words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, codes in _chunks(batches, settings.chunk_words):
            n = np.bincount(codes, minlength=len(words))[1:]
            langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), pa.array([lang])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs, pa.array(words[1:], pa.binary()).cast(pa.string()), pa.array(n)], names=["lang", "phrase", "n"])

    made = docs.mapInArrow(run, "lang string, phrase string, n long")
    return made.groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def word_map(frequent: DataFrame, bits: int) -> np.ndarray:
    """The bit map of the frequent words; its size is fixed."""
    bit = _bit(bits) + 1  # Spark's bit maps count from one
    rows = frequent.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    out = np.zeros(1 << bits, bool)
    for r in rows.collect():  # at most 2 ** bits / 32768 rows of 4 kB
        found = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        at = (r["part"] - 1) * len(found)
        out[at : at + len(found)] = found[: len(out) - at]
    return out


def _merged(columns: list[np.ndarray], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct row of codes, and how often it stands."""
    key, room = columns[0].astype(np.int64), n_words
    for column in columns[1:]:
        if room * n_words >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            room = len(key) + 1
        key, room = key * n_words + column, room * n_words
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    return at, n


def suffixes(docs: DataFrame, bitmap: np.ndarray, hot: set[tuple[str, bytes]], settings: Settings) -> DataFrame:
    """``lang, phrase, lead, n``: suffixes of 2 to ``longest`` words, merged a chunk, and how many
    leading words route them."""
    packed, bits, longest = np.packbits(bitmap), settings.map_bits, settings.longest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept(lang: str, word: bytes) -> bool:
            bit = bit_of(lang, word, bits)
            return bool(packed[bit >> 3] >> (7 - (bit & 7)) & 1)

        for lang, words, codes in _chunks(batches, settings.chunk_words, kept):
            ahead = np.append(codes, np.zeros(longest, np.int32))
            at = np.flatnonzero((codes > 0) & (ahead[1 : len(codes) + 1] > 0))
            columns = [codes[at]]
            for k in range(1, longest):
                columns.append(np.where(columns[-1] > 0, ahead[at + k], 0))
            at, n = _merged(columns, len(words))
            is_hot = np.array([(lang, w) in hot for w in words])
            table = pa.array(words, pa.binary()).cast(pa.string())
            some, lead, run_on = [], np.full(len(at), 2), np.ones(len(at), bool)
            for k, column in enumerate(columns):
                column = column[at]
                some.append(table.take(pa.array(column, mask=column == 0)))
                run_on &= is_hot[column]
                if 1 <= k < longest - 1:
                    lead += run_on
            phrase = pc.binary_join_element_wise(*some, " ", null_handling="skip")
            langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), pa.array([lang])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs, phrase, pa.array(lead, pa.int32()), pa.array(n)], names=["lang", "phrase", "lead", "n"])

    return docs.mapInArrow(run, "lang string, phrase string, lead int, n long")


def equal_partitions(keys: np.ndarray, weights: np.ndarray, least: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers to the columns of ``keys``, all parts of a round at once.

    ``keys[d]`` is the word at depth d, 0 where the suffix has ended.  Yields ``d + 1, pointers,
    sums``: a pointer of each part whose first ``d + 1`` words are equal, and the sum of its weights.
    Parts whose sum is below ``least[d]`` are abandoned before they are sorted on.
    """
    longest, n = keys.shape
    flat, least = keys.ravel(), np.array(least, np.float64)
    order, sizes, depth = np.arange(n), np.array([n][: int(n > 0)]), np.zeros(int(n > 0), np.int64)
    random = np.random.default_rng(SEED)
    while len(sizes):
        part = np.repeat(np.arange(len(sizes)), sizes)
        first = np.cumsum(sizes) - sizes
        pivot = flat[depth * n + order[first + (random.random(len(sizes)) * sizes).astype(np.int64)]]
        key, middle = flat[np.repeat(depth * n, sizes) + order], np.repeat(pivot, sizes)
        side = (key >= middle).astype(np.int64) + (key > middle)
        slot = 3 * part + side
        n_slots = 3 * len(sizes)
        new_sizes = np.bincount(slot, minlength=n_slots)
        sums = np.bincount(slot, weights[order], n_slots)
        starts = np.cumsum(new_sizes) - new_sizes
        moved = np.empty_like(order)
        for k in range(3):
            those = np.flatnonzero(side == k)
            own = new_sizes[k::3]
            moved[np.repeat(starts[k::3] - (np.cumsum(own) - own), own) + np.arange(len(those))] = order[those]
        at_depth, equal = np.repeat(depth, 3), np.tile([False, True, False], len(sizes))
        alive = (new_sizes > 0) & (sums >= least[at_depth]) & ~(equal & (np.repeat(pivot, 3) == 0))
        for d in np.unique(depth).tolist():
            found = np.flatnonzero(alive & equal & (at_depth == d))
            if len(found):
                yield d + 1, moved[starts[found]], sums[found].astype(np.int64)
        at_depth = at_depth + equal
        alive &= at_depth < longest
        order = moved[np.repeat(alive, new_sizes)]
        sizes, depth = new_sizes[alive], at_depth[alive]


def _counted(rows: pa.Table, settings: Settings) -> Iterator[pa.RecordBatch]:
    """``lang, phrase, a`` of the suffixes of one task."""
    split = pc.split_pattern(rows["phrase"].combine_chunks(), " ")
    words = pc.dictionary_encode(split.flatten())
    begins = split.offsets.to_numpy()[:-1]
    lengths = np.diff(split.offsets.to_numpy())
    codes = words.indices.to_numpy().astype(np.int64) + 1
    langs = pc.dictionary_encode(rows["lang"].combine_chunks())
    keys = np.zeros((settings.longest, len(begins)), np.int64)
    for k in range(settings.longest):
        there = lengths > k
        keys[k, there] = codes[begins[there] + k]
    keys[0] += langs.indices.to_numpy().astype(np.int64) * (len(words.dictionary) + 1)
    weights, lead = rows["n"].to_numpy(), rows["lead"].to_numpy()
    for leading in np.unique(lead).tolist():
        own = np.flatnonzero(lead == leading)
        # what is routed by more words than a phrase has is only a part of its count
        least = [1 if d + 1 < leading else settings.least for d in range(settings.longest)]
        for size, at, a in equal_partitions(np.ascontiguousarray(keys[:, own]), weights[own], least):
            if size < 2:
                continue
            at = own[at]
            cut = [words.dictionary.take(pa.array(codes[begins[at] + k] - 1)) for k in range(size)]
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(langs.indices.to_numpy()[at])), pc.binary_join_element_wise(*cut, " "), pa.array(np.full(len(at), size, np.int32)), pa.array(a)],
                names=["lang", "phrase", "size", "a"],
            )


def phrase_counts(found: DataFrame, n_suffixes: int, settings: Settings) -> DataFrame:
    """``lang, phrase, size, a`` of all phrases of 2 and more words that reach the least count."""
    needed = max(1, -(-n_suffixes // settings.task_rows))
    shuffled = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(needed, max(4000, shuffled)), min(shuffled, -(-n_suffixes // 50_000)), 1)
    turns = -(-needed // tasks)
    leading = F.expr("substring_index(phrase, ' ', lead)")
    dealt = found.repartition(tasks, "lang", leading)
    turn = F.pmod(F.xxhash64("lang", leading), F.lit(turns)).cast("int") if turns > 1 else F.lit(0)
    dealt = dealt.select("lang", "phrase", "lead", "n", turn.alias("turn"))
    if turns > 1:
        dealt = dealt.sortWithinPartitions("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            turns_of = batch.column(4).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(turns_of)) + 1).tolist(), len(turns_of)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and turns_of[a] != at:
                    yield from _counted(pa.Table.from_batches(held), settings)
                    held = []
                at = turns_of[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from _counted(pa.Table.from_batches(held), settings)

    made = dealt.mapInArrow(run, "lang string, phrase string, size int, a long")
    return made.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).where(F.col("a") >= settings.least)


def scored(phrases: DataFrame, settings: Settings) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the candidates (``lang, phrase, size, a`` with single words)
    that no longer candidate drops."""
    words = F.split("phrase", " ")
    some = phrases.where("size > 1").withColumn("words", words)
    part = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    cuts = some.select("lang", "phrase", "size", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)"), whole("l") * whole("r"))
    lowest = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score)
    lowest = lowest.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a longer phrase is no more frequent than the phrases inside it: those one word longer decide
    inside = some.where("size > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left")
    dropped = 100 * F.col("longer").cast("decimal(19,0)") >= settings.share * F.col("a").cast("decimal(19,0)")
    return kept.where(~F.coalesce(dropped, F.lit(False))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def ranked(candidates: DataFrame, top: int) -> DataFrame:
    """With ``rank``: the first ``top`` of each language; dealt to salted groups before a language meets."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = Window.partitionBy("lang", "_salt").orderBy(*order)
    some = candidates.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(32))).withColumn("_place", F.row_number().over(dealt)).where(F.col("_place") <= top)
    last = Window.partitionBy("lang").orderBy(*order)
    return some.drop("_salt", "_place").withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first phrases of each language.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two sides of its lowest-scoring cut,
    ``n`` all words of the language, ``score`` floor(1000000 a a / (l r)).  Null languages count as
    ``und``; null and empty texts have no words; repeated rows count each time; an empty table gives
    no rows.  Other columns are left out.
    """
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    words = written(word_counts(docs, settings), "collocation-words")
    frequent = words.where(F.col("a") >= settings.least)
    total = frequent.agg(F.sum("a")).first()[0] or 0
    busy = frequent.where(F.col("a") > total // settings.hot_words)  # fewer than ``hot_words``
    hot = {(r["lang"], r["phrase"].encode()) for r in busy.select("lang", "phrase").collect()}
    found = suffixes(docs, word_map(frequent, settings.map_bits), hot, settings)
    counted = phrase_counts(found, total, settings)
    singles = frequent.select("lang", "phrase", F.lit(1).alias("size"), "a")
    phrases = written(singles.unionByName(counted), "collocation-phrases")
    sums = words.groupBy("lang").agg(F.sum("a").alias("n"))
    best = ranked(scored(phrases, settings), settings.top)
    return best.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
