"""SentencePiece merge models: exact encoding by backtracking, and decoding.

A text is cut where no piece can reach across (before a run of spaces, around characters
without a piece), and every segment is tokenised on its own:

1. Aho-Corasick gives the longest piece that starts at each place.
2. The tokeniser takes the longest piece that keeps two promises: its end is not marked
   as failed in a bit field, and merging it together with the piece before it gives these
   two pieces again.  Otherwise it tries the next shorter prefix; with none left it marks
   the position as failed and takes the last piece back.

Adjacent pieces that survive re-merging pairwise are the merge result itself, so the ids
equal those of the sentencepiece library.  Pieces of equal score (runs of spaces in the
usual models) have no order of their own, so segments with two spaces in a row are merged
step by step.  Only models with byte fallback, without normalisation, are taken.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayrisk.llm.common import Memo, int_lists, kept_in_worker, map_column

SPACE = "▁"
SEGMENTS_REMEMBERED = 100_000  # in each of two generations, about 150 bytes an entry in every worker
PAIRS_REMEMBERED = 100_000
LONGEST_REMEMBERED = 64
LONGEST_PLAIN_MERGE = 40


class PieceModel:
    """Pieces, ranks and ids of a merge model read from its serialised form."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_proto=model)
        ids = range(library.get_piece_size())
        self.pieces = [library.id_to_piece(i) for i in ids]
        self.byte_ids = [0] * 256
        self.control = {i for i in ids if library.is_control(i)}
        self.unknown = library.unk_id()
        self.ids: dict[str, int] = {}
        score: dict[str, float] = {}
        n_bytes = 0
        for i in ids:
            if library.is_byte(i):
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
                n_bytes += 1
            elif i not in self.control and i != self.unknown and not library.is_unused(i):
                self.ids[self.pieces[i]] = i
                score[self.pieces[i]] = library.get_score(i)
        if n_bytes != 256:
            raise ValueError("the model has no byte fallback")
        places = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: places[s] for p, s in score.items()}

    def merged(self, text: str) -> list[str]:
        """Pieces by plain merging: best rank first, leftmost first among equals."""
        if len(text) > LONGEST_PLAIN_MERGE:
            return self._merged_long(text)
        parts, rank = list(text), self.rank.get
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                r = rank(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merged_long(self, text: str) -> list[str]:
        parts: list[str | None] = list(text)
        n, rank = len(parts), self.rank.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k, c) for k in range(n - 1) if (r := rank(c := text[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, both = heapq.heappop(heap)
            right = after[k]
            if parts[k] is None or right >= n or parts[k] + parts[right] != both:
                continue
            parts[k], parts[right] = both, None
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (r := rank(c := parts[left] + parts[after[left]])) is not None:
                    heapq.heappush(heap, (r, left, c))
        return [p for p in parts if p is not None]


class PieceEncoder:
    """Text to ids by longest matches and backtracking."""

    def __init__(self, model: bytes):
        import ahocorasick

        self.model = model = PieceModel(model)
        whole = [p for p in model.ids if len(p) == 1 or model.merged(p) == [p]]
        self.usable = set(whole)
        self.matches = ahocorasick.Automaton()
        for p in whole:
            self.matches.add_word(p, p)
        self.matches.make_automaton()
        self.single = {p for p in whole if len(p) == 1}
        self.coded = {p: i.to_bytes(4, "little") for p, i in model.ids.items()}
        self.within = {c for p in model.ids for c in p}
        across = any(SPACE in p.lstrip(SPACE) for p in model.ids)
        self.cut = re.compile("(?s).+" if across else " +[^ \n]*|[^ \n]+|\n" if "\n" not in self.within else " +[^ ]*|[^ ]+")
        self.split = {p: self._last_merge(p) for p in whole}
        self.shorter = Memo(self._shorter)
        self.fits = Memo(self._fits, PAIRS_REMEMBERED)
        self.segment_ids = Memo(self._segment_ids, SEGMENTS_REMEMBERED, LONGEST_REMEMBERED)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian int32, without begin or end ids; null and empty: none."""
        if not text:
            return b""
        return b"".join(map(self.segment_ids.__getitem__, self.cut.findall(" " + text.replace(SPACE, " "))))

    def _shorter(self, piece: str) -> str:
        return next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.usable), "")

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that merging joins last; None for one character."""
        rank, left = self.model.rank, None
        for k in range(1, len(piece)):
            a, b = piece[:k], piece[k:]
            if (len(a) == 1 or a in rank) and (len(b) == 1 or b in rank) and self.model.merged(a) == [a] and self.model.merged(b) == [b]:
                if left is not None:  # more than one way: decided by merging
                    return self._simulated(piece)
                left = a, b
        return left

    def _simulated(self, piece: str) -> tuple[str, str]:
        parts, rank = list(piece), self.model.rank.get
        while len(parts) > 2:
            _, at = min((r, k) for k in range(len(parts) - 1) if (r := rank(parts[k] + parts[k + 1])) is not None)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether merging both together gives these two pieces again.

        The merges along the border are undone from the last one back.  As long as two parts meet
        there that would have merged before either was made, the pieces cannot stand side by side.
        Equal ranks are decided by merging.
        """
        left, right = pair
        rank, split = self.model.rank.get, self.split
        made_left, made_right = rank(left, -1) if len(left) > 1 else -1, rank(right, -1) if len(right) > 1 else -1
        ended = None  # rank of the merge undone last: what joined the border then came before it
        while True:
            joined = rank(left + right)
            if joined is not None and (ended is None or joined <= ended):
                if joined == ended or joined == made_left or joined == made_right:
                    return self.model.merged(pair[0] + pair[1]) == [*pair]
                return False
            if made_left == made_right:
                if made_left < 0:
                    return True
                return self.model.merged(pair[0] + pair[1]) == [*pair]
            if made_left > made_right:
                ended, left = made_left, split[left][1]
                made_left = rank(left) if len(left) > 1 else -1
            else:
                ended, right = made_right, split[right][0]
                made_right = rank(right) if len(right) > 1 else -1

    def _segment_ids(self, segment: str) -> bytes:
        segment = segment.replace(" ", SPACE)
        pieces = self.model.merged(segment) if SPACE * 2 in segment else self.tokens(segment)
        try:
            return b"".join([self.coded[p] for p in pieces])
        except KeyError:
            pass
        for p in pieces:
            if p not in self.coded:  # a character without a piece
                self.coded[p] = b"".join([self.model.byte_ids[b].to_bytes(4, "little") for b in p.encode()])
        return b"".join([self.coded[p] for p in pieces])

    def tokens(self, segment: str) -> list[str]:
        if self.single.issuperset(segment):
            return self._backtrack(segment)
        if any(c in self.within and c not in self.single for c in segment):
            return self.model.merged(segment)
        out, start = [], 0  # characters without a piece: cuts
        for k, c in enumerate(segment):
            if c not in self.single:
                if start < k:
                    out += self._backtrack(segment[start:k])
                out.append(c)
                start = k + 1
        return out + (self._backtrack(segment[start:]) if start < len(segment) else [])

    def _backtrack(self, text: str) -> list[str]:
        n, search, fits = len(text), self.matches.iter_long, self.fits
        longest, k = [p for _, p in search(text)], 0  # from each place that the one before ends
        for k, pair in enumerate(zip(longest, longest[1:]), 1):
            if not fits[pair]:
                break
        else:
            return longest
        failed = bytearray((n >> 3) + 1)  # bit k is set if no valid tokens lead on from k
        out, piece, ahead = longest[:k], longest[k], None
        at = sum(map(len, out))
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or fits[out[-1], piece]):
                out.append(piece)
                at = end
                if at == n:
                    return out
                if ahead is None:
                    ahead = search(text, at)
                piece = next(ahead)[1]
                continue
            ahead = None
            piece = self.shorter[piece]
            while not piece:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    return self.model.merged(text)
                taken = out.pop()
                at -= len(taken)
                piece = self.shorter[taken]


def _each_wrong_byte(error):
    return "�" * (error.end - error.start), error.end


class PieceDecoder:
    """Ids to text, as the library's decode(ids): one leading space goes, wrong bytes become U+FFFD."""

    def __init__(self, model: bytes):
        model = PieceModel(model)
        self.table = [p.replace(SPACE, " ").encode() for p in model.pieces]
        for b, i in enumerate(model.byte_ids):
            self.table[i] = bytes([b])
        for i in model.control:
            self.table[i] = b""
        self.table[model.unknown] = " ⁇ ".encode()
        self.control = model.control
        n = len(self.table)
        self.is_control, self.is_spaced = np.zeros(n, bool), np.zeros(n, bool)
        self.is_control[list(self.control)] = True
        self.is_spaced[[i for p, i in model.ids.items() if p.startswith(SPACE)]] = True
        self.sizes = np.fromiter(map(len, self.table), np.int64, n)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.table), np.uint8)
        codecs.register_error("each-wrong-byte", _each_wrong_byte)

    def decode(self, ids: list[int] | None) -> str:
        return self.decode_all([np.array(ids or [], np.int32)])[0]

    def decode_all(self, several: list[np.ndarray]) -> list[str]:
        """Texts of several arrays of ids: the pieces' bytes are gathered for all at once."""
        ids = np.concatenate([*several, np.zeros(0, np.int32)])
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        data = self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        out, at, done = [], 0, 0
        for one in several:
            begin, at = done, at + len(one)
            done = int(ends[at - 1]) if at else 0
            first = one[0] if len(one) else -1
            if self.is_control[first] if first >= 0 else False:
                first = next((i for i in one.tolist() if i not in self.control), -1)
            skip = 1 if first >= 0 and self.is_spaced[first] else 0
            out.append(data[begin + skip : done].decode("utf-8", "each-wrong-byte"))
        return out


def encode(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, ids`` (array of int) of every whole text; null and empty texts have no ids.

    Repeated and null keys are kept as rows of their own; other columns are left out.
    The model is read once on the driver and travels with the tasks.
    """
    model = Path(model_path).read_bytes()

    def start() -> Callable[[list], list]:
        encoder = kept_in_worker(("pieces", model), lambda: PieceEncoder(model))
        return lambda texts: [int_lists([encoder.encode(t) for t in texts])]

    return map_column(docs, [key], text, start, [("ids", "array<int>", pa.list_(pa.int32()))])


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all of them by default) plus ``decoded``; null ids give an empty text."""
    model = Path(model_path).read_bytes()
    keep = encoded.columns if keep is None else keep

    def start() -> Callable[[list], list]:
        decoder = PieceDecoder(model)
        return lambda lists: [decoder.decode_all([np.array(x or [], np.int32) for x in lists])]

    return map_column(encoded, keep, ids, start, [("decoded", "string", pa.string())])


def round_trip(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, ids, decoded``: ``encode`` and ``decode`` of its ids, in one pass over the texts."""
    model = Path(model_path).read_bytes()

    def start() -> Callable[[list], list]:
        encoder, decoder = kept_in_worker(("both ways", model), lambda: (PieceEncoder(model), PieceDecoder(model)))

        def work(texts: list) -> list:
            coded = [encoder.encode(t) for t in texts]
            return [int_lists(coded), decoder.decode_all([np.frombuffer(c, "<i4") for c in coded])]

        return work

    return map_column(docs, [key], text, start, [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())])


def digests(coded: DataFrame, key: str = "doc_id", more: list[str] | None = None) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of encoded and decoded rows, and columns ``more``."""
    return coded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(more or []),
    )
