"""Token-id files: frequency-ranked ids in byte-aligned variable-length code.

Files hold documents in ascending key order.  An id is stored as its place among all ids
by falling frequency, so frequent ids take one byte.  The lengths (1 to 4 bytes, two bits
each) stand in control bytes of their own, four values to a byte, before the data bytes;
a reader looks the control bytes up in a table and gathers all values at once.

A file is a run of blocks, a block holds whole documents:

    int64 documents, int64 ids, int64 data bytes
    int64 key of each document, int64 number of ids of each document
    control bytes, data bytes

Null keys are stored as the smallest int64 and sort first.  The ranking is a file of its
own (`ranking.bin`, uint32 ids by rank).
"""

from __future__ import annotations

import gc
import json
import re
import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayrisk.llm.common import kept_in_worker, open_store, shared_folder, written

WORDS_REMEMBERED = 1_000_000
CHUNK_BYTES = 4 << 20  # of text in one look-up of words
BLANK_FIRST = r"^(?:$|[\s\x0b\x1c-\x1f\x{85}\p{Z}])"  # what Python takes for blanks, or nothing
BLOCK_IDS = 1 << 20  # a block ends after the document that reaches this
FILE_IDS = 1 << 26  # a file ends after the block that reaches this
NULL_KEY = -(1 << 63)


# --- code -------------------------------------------------------------------
def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    sizes = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = sizes - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < sizes[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


SIZES = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)  # of the four values of a control byte


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of ``pack``."""
    sizes = SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(sizes) - sizes
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# --- tokenising --------------------------------------------------------------
class WordTokenizer:
    """Ids of texts, word by word.

    Byte-level tokenizers of this family put one space at most in front of a word and
    join nothing across it, so a text may be cut before every space that does not stand
    between two others.  The words of many texts are told apart by Arrow, so each is looked
    up once, and the texts' ids are gathered from those of their words.

    A new word is cut further where the tokenizer's own splitter always cuts: at single line
    ends and before closing signs.  What is left of it goes to the library many at a time, a
    space or line end before each: the ids that begin with it are the cuts.  Odd words go one by one.
    """

    def __init__(self, definition: str, kind: str):
        from tokenizers import Tokenizer

        self.library, self.kind = Tokenizer.from_str(definition), kind
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        self.wide = re.compile(r"\s \s")
        self.alone = re.compile(r"(?<=\S) (?=\S)")
        added = [t["content"] for t in json.loads(definition).get("added_tokens") or []]
        split = self.library.pre_tokenizer and self.library.pre_tokenizer.pre_tokenize_str
        space = split(" a")[0][0][0] if split else " "
        # signs that end an added token would hide it; an apostrophe may belong to the letters before it
        closing = "".join(c for c in string.punctuation if c != "'" and not any(t.endswith(c) for t in added))
        apart = split is not None and all(len(split(" a" + c + d)) == 2 for c in closing for d in closing)
        self.closing = closing if apart else ""
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.begins = np.zeros(1 + max(self.library.get_vocab().values()), bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(space)]] = True
        line = self._ids("\n")
        lines_apart = split is not None and len(split("a\nb")) == 3 and len(line) == 1 and not any("\n" in t for t in added)
        self.ends = np.zeros(len(self.begins), bool)
        if lines_apart:
            self.ends[line] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)

    def _lines(self, word: str) -> list[str]:
        """The word up to its first line end, then each line; a space, which no word begins with, stands for the line end before it."""
        first, *lines = word.split("\n")
        if not self.ends.any() or not all(x and not x[0].isspace() and not x[-1].isspace() for x in (first, *lines)):
            return [word]
        return [first, *[" " + x for x in lines]]

    def _together(self, parts: list[str], line: bool) -> None:
        """Many parts at once; those that hold something of their own between the cuts stay unknown."""
        before, first = ("\n", self.ends) if line else (" ", self.begins)
        for at in range(0, len(parts), 1000):
            some = parts[at : at + 1000]
            bare = [w[1:] for w in some] if line else some
            text = before + before.join(bare)
            if text.split() != bare:  # a blank inside
                fine = [w for w, x in zip(some, bare, strict=True) if x.split() == [x]]
                if len(fine) < len(some):
                    self._together(fine, line)
                    continue
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            starts = np.flatnonzero(first[ids])
            if len(starts) != len(some) or starts[0] != 0:
                continue
            data, cuts = ids.tobytes(), [*(starts * ids.itemsize).tolist(), ids.nbytes]
            self.known.update(zip(some, map(data.__getitem__, map(slice, cuts, cuts[1:])), strict=True))

    def _learn_parts(self, parts: list[str]) -> None:
        """Make parts known: words, or lines after a line end."""
        closing, whole, signed = self.closing, [], []
        for w in parts:
            base = w.rstrip(closing) if closing else w
            if len(base) < len(w) and base and base[-1].isalpha():
                signed.append((w, base))
            else:
                whole.append(w)
        wanted = {*whole, *[base for _, base in signed]} - self.known.keys()
        again = wanted & self.old.keys()
        self.known.update((w, self.old[w]) for w in again)
        wanted -= again
        lines = [w for w in wanted if w[:1] == " "]
        self._together(lines, True)
        self._together(list(wanted.difference(lines)), False)
        for w in wanted - self.known.keys():
            self.known[w] = self._ids("\n" + w[1:] if w[:1] == " " else " " + w).tobytes()
        if len(self.signs) > WORDS_REMEMBERED // 10:
            self.signs.clear()
        for w, base in signed:
            last = w[len(base) :]
            if last not in self.signs:
                self.signs[last] = self._ids(last).tobytes()
            self.known[w] = self.known[base] + self.signs[last]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words that are not known, a space before each."""
        lines = {w: self._lines(w) for w in words if "\n" in w}
        parts = [w for w in words if w not in lines] if lines else words
        self._learn_parts([*parts, *{x for cut in lines.values() for x in cut}])
        known = self.known
        return [known[w] if w not in lines else b"".join([known[x] for x in lines[w]]) for w in words]

    def _coded(self, words: list[str]) -> list[bytes]:
        """Ids of words, a space before each."""
        if len(self.known) > WORDS_REMEMBERED:
            self.known, self.old = {}, self.known
        coded = list(map(self.known.get, words))
        new = [i for i, ids in enumerate(coded) if ids is None]
        for i, ids in zip(new, self._learn([words[i] for i in new]), strict=True):
            coded[i] = ids
        return coded

    def _whole(self, text: str) -> bytes:
        """Ids of a text with runs of blanks."""
        first, *words = self.alone.split(text)
        return self._ids(first).tobytes() + b"".join(self._coded(words))

    def encode(self, texts: pa.Array, end: int) -> pa.Array:
        """Ids of each text (null: empty) and ``end``, as binary."""
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        words = lists.flatten()
        firsts = words.take(pa.array(at[:-1])).to_pylist()
        told = words.dictionary_encode()
        places = told.indices.to_numpy().astype(np.int64)
        # no word holds a space, so joining and splitting is the short way to Python strings
        distinct = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(told.dictionary)], pa.int32()), told.dictionary), " ")[0].as_py().split(" ")
        coded = self._coded(distinct)
        blank = pc.match_substring_regex(told.dictionary, BLANK_FIRST).to_numpy(zero_copy_only=False)
        keep = np.ones(len(places), bool)
        with_blanks = set(np.unique(np.searchsorted(at, np.flatnonzero(blank[places]), "right") - 1).tolist())
        for row, first in enumerate(firsts):
            if row in with_blanks and self.wide.search(text := texts[row].as_py()):
                ids = self._whole(text)
                keep[at[row] + 1 : at[row + 1]] = False
            else:
                ids = self._ids(first).tobytes()
            places[at[row]] = len(coded)
            coded.append(ids)
        last = len(coded)
        coded.append(np.array([end], self.kind).tobytes())
        kept = np.append(0, np.cumsum(keep))[at]
        places = np.insert(places[keep], kept[1:], last)
        flat = np.frombuffer(b"".join(coded), self.kind)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // flat.itemsize
        starts = np.cumsum(sizes) - sizes
        counts = sizes[places]
        ends = np.cumsum(counts)
        ids = flat[np.repeat(starts[places] - ends + counts, counts) + np.arange(ends[-1])]
        bounds = np.append(0, ends)[kept + np.arange(len(kept))] * flat.itemsize
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ids)])


def tokenized(docs: DataFrame, definition: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, ids`` (binary, see ``id_kind``) of every whole text plus the end id, in ascending key order.

    Null texts count as empty; rows with equal keys stay, ordered by text; null keys first.
    """
    kind = id_kind(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_in_worker(("words", definition), lambda: WordTokenizer(definition, kind))
        gc.disable()  # the remembered words are no cycles: looking through them is work for nothing
        try:
            for batch in batches:
                sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
                begin = 0
                while begin < batch.num_rows:  # whole texts up to CHUNK_BYTES, one at least
                    before = sizes[begin - 1] if begin else 0
                    stop = max(begin + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES, "right")))
                    part = batch.slice(begin, stop - begin)
                    yield pa.RecordBatch.from_arrays([part.column(0), words.encode(part.column(1), end_id)], names=[key, "ids"])
                    begin = stop
        finally:
            gc.enable()

    ordered = docs.select(key, text).repartitionByRange(key).sortWithinPartitions(key, text)
    return ordered.mapInArrow(run, f"`{key}` {ordered.schema[0].dataType.simpleString()}, ids binary")


def id_kind(definition: str) -> str:
    """Two bytes an id where the vocabulary allows."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_str(definition).get_vocab_size() <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame, kind: str) -> DataFrame:
    """``id, n`` over all documents; at most one row per vocabulary entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                found = np.bincount(np.frombuffer(ids.as_buffer(), kind))
                if len(found) > len(total):
                    total = np.pad(total, (0, len(found) - len(total)))
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# --- files -------------------------------------------------------------------
class _Writer:
    """Blocks of one file; created at the first document."""

    def __init__(self, folder: str, place: int):
        store, root = open_store(folder)
        self.path = f"{folder}/ids-{place:016d}-{uuid.uuid4().hex[:8]}.bin"
        self.file = store.open_output_stream(f"{root}/{self.path.rsplit('/', 1)[1]}")
        self.place, self.total = place, 0
        self.keys, self.counts, self.ranks, self.open = [], [], [], 0

    def add(self, key: int | None, ranks: np.ndarray) -> None:
        self.keys.append(NULL_KEY if key is None else key)
        self.counts.append(len(ranks))
        self.ranks.append(ranks)
        self.open += len(ranks)
        if self.open >= BLOCK_IDS:
            self.flush()

    def flush(self) -> None:
        if not self.keys:
            return
        control, data = pack(np.concatenate(self.ranks))
        head = np.array([len(self.keys), self.open, len(data), *self.keys, *self.counts], "<i8")
        for part in (head.tobytes(), control, data):
            self.file.write(part)
        self.total += self.open
        self.keys, self.counts, self.ranks, self.open = [], [], [], 0

    def close(self) -> tuple[str, int, int]:
        self.flush()
        self.file.close()
        return self.path, self.place, self.total


def write_files(tokens: DataFrame, folder: str, ranking: np.ndarray, kind: str, key: str = "doc_id") -> DataFrame:
    """Write ``tokens`` (``key, place, ids``; ``place`` numbers the rows in order, without
    gaps inside a file) and return ``path, place, n_ids`` of the files that count.

    A retried task writes files of new names; only those of its finished attempt are returned.
    """
    rank_of = np.zeros(int(ranking.max(initial=0)) + 1, np.uint32)
    rank_of[ranking] = np.arange(len(ranking), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, writer, expected = [], None, None
        for batch in batches:
            for k, place, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if writer is not None and (place != expected or writer.total >= FILE_IDS):
                    done.append(writer.close())
                    writer = None
                writer = writer or _Writer(folder, place)
                writer.add(k, rank_of[np.frombuffer(ids.as_buffer(), kind)])
                expected = place + 1
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "place", "n_ids"), d, strict=True)) for d in done], pa.schema([("path", pa.string()), ("place", pa.int64()), ("n_ids", pa.int64())]))

    return written(tokens.select(F.col(key).cast("long"), "place", "ids").mapInArrow(run, "path string, place long, n_ids long"), "token-files")


def read_files(files: DataFrame, ranking: np.ndarray, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids`` (binary, little-endian uint32) of the documents in the files.

    ``start`` is the number of ids of all documents before, in the order of the files.
    One row per file decides the starts, so that window is as small as the list of files.
    """
    starts = files.withColumn("start", F.sum("n_ids").over(Window.orderBy("place")) - F.col("n_ids"))
    table = ranking.astype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = open_store(path)
                with store.open_input_stream(place) as file:
                    while head := file.read(24):
                        n, n_ids, n_data = np.frombuffer(head, "<i8").tolist()
                        keys, counts = np.frombuffer(file.read(16 * n), "<i8").reshape(2, n)
                        ids = table[unpack(file.read(-(-n_ids // 4)), file.read(n_data), n_ids)].tobytes()
                        ends = np.cumsum(counts)
                        offsets = pa.array(np.append(0, ends * 4), pa.int64())
                        lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, offsets.buffers()[1], pa.py_buffer(ids)])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys, mask=keys == NULL_KEY), pa.array(start + ends - counts), pa.array(counts), lists.cast(pa.binary())],
                            names=[key, "start", "n_tokens", "ids"],
                        )
                        start += n_ids

    spread = starts.select("path", "start").repartition(max(1, files.count()), "path")
    return spread.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokenise, rank, write files to the shared folder and read them back (see ``read_files``).

    Ids are counted over all documents; the ranking has at most one entry per vocabulary
    entry, so the driver may hold it.  Tokens are stored once between the two passes.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    spark, kind = docs.sparkSession, id_kind(definition)
    tokens = tokenized(docs, definition, end_id, text, key).withColumn("place", F.monotonically_increasing_id())
    tokens = written(tokens, "tokens")
    counted = id_counts(tokens, kind).orderBy(F.desc("n"), "id").collect()
    ranking = np.array([r["id"] for r in counted], np.int64)
    folder = shared_folder(spark, "token-files")
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/ranking.bin") as file:
        file.write(ranking.astype("<u4").tobytes())
    return read_files(write_files(tokens, folder, ranking, kind, key), ranking, key)
