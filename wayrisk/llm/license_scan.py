"""License scan: identifier tags, notice phrases and license expressions.

One Aho-Corasick automaton over the words of a text finds notice phrases and identifier
tags; phrases may be broken by any punctuation or line end.  What follows a tag is read by
a shunting-yard parser for and / or / with, and evaluated to the licenses it names and the
duties they bring: the mildest side of an `or`, the strictest of an `and`.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from wayrisk.llm.common import kept_in_worker, map_column

# --- fixed values -------------------------------------------------------------
#: Phrases every scan looks for, with their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices, with labels of their own.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit-style",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "proprietary",
    "released into the public domain": "public-domain",
}
TAG = "spdx license identifier"
#: Start of a license id, with the duties it brings; the first that fits counts.
DUTIES = {
    "agpl": 3, "gpl": 3, "cc-by-nc": 3, "cc-by-nd": 3, "proprietary": 4, "lgpl": 2, "mpl": 2, "epl": 2, "cc-by-sa": 2,
    "mit": 1, "apache": 1, "bsd": 1, "isc": 1, "bsl": 1, "cc-by": 1, "zlib": 1, "cc0": 0, "unlicense": 0, "public-domain": 0,
}
DUTY_NAMES = ("none", "attribution", "weak copyleft", "strong", "reserved")
# --------------------------------------------------------------------------------
UNKNOWN_DUTY = 3
EXCEPTION_RELIEF = 1  # an exception ("with") takes a duty down by one, to attribution at least

_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_TAGGED = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*)")
_BINDS = {"with": 3, "and": 2, "or": 1}


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


def expression(text: str) -> list[str]:
    """The longest license expression at the start of ``text`` in postfix order, empty if none."""
    out: list[str] = []
    waiting: list[str] = []
    best: list[str] = []
    operand_next, at, depth = True, 0, 0
    while m := _TOKEN.match(text, at):
        token, at = m[1], m.end()
        low = token.lower()
        if token == "(" and operand_next:
            waiting.append(token)
            depth += 1
        elif token == ")" and not operand_next and depth:
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
        elif low in _BINDS and not operand_next:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand_next = True
        elif token not in "()" and low not in _BINDS and operand_next:
            out.append(low.rstrip("."))
            operand_next = False
        else:
            break
        if not operand_next and not depth:  # what is read so far stands on its own
            best = out + waiting[::-1]
    return best


def duty(license_id: str) -> int:
    found = [p for p in DUTIES if license_id.startswith(p)]
    return DUTIES[max(found, key=len)] if found else UNKNOWN_DUTY


def evaluate(postfix: list[str]) -> tuple[list[str], int]:
    """Licenses named (exceptions are not licenses) and the duty of the whole."""
    stack: list[tuple[list[str], int]] = []
    for token in postfix:
        if token not in _BINDS:
            stack.append(([token], duty(token)))
            continue
        (names, right), (left_names, left) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left_names, max(min(left, 1), left - EXCEPTION_RELIEF)))
        else:
            stack.append((left_names + names, (max if token == "and" else min)(left, right)))
    return stack[0] if stack else ([], 0)


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str]):
        import ahocorasick

        self.base, self.notices = base, notices
        self.automaton = ahocorasick.Automaton()
        for phrase in {**base, **notices, TAG: ""}:
            self.automaton.add_word(f" {phrase} ", phrase)
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, labels, expressions, duties, score."""
        found = words(text)
        line = b" ".join([b"", *found, b""]).decode("utf-8")
        starts, own, labels, evidence, duties, expressions = [], set(), set(), 0, [], []
        tagged = False
        for end, phrase in self.automaton.iter(line):
            if phrase in self.base:
                starts.append(line.count(" ", 0, end - len(phrase)) - 1)
                own.add(self.base[phrase])
            if phrase in self.notices:
                labels.add(self.notices[phrase])
            tagged |= phrase == TAG
            evidence += 1
        duties += [duty(label) for label in own | labels]
        for m in _TAGGED.finditer(text) if tagged else ():
            if postfix := expression(m[1]):
                names, needed = evaluate(postfix)
                labels.update(names)
                duties.append(needed)
                expressions.append(" ".join(postfix))
                evidence += 2
        return (
            len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)),
            ",".join(sorted(own | labels)), expressions, DUTY_NAMES[max(duties)] if duties else None, 1 - 0.5**evidence,
        )


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """Columns ``keep`` plus what the scan finds in every whole text.

    ``n_words``; ``n_base``, ``first_word``, ``last_word``: places of base phrases and the
    smallest and largest word they start at (null without one); ``base_labels``, ``labels``:
    distinct, sorted, comma-joined; ``expressions``: those behind identifier tags, in postfix
    order; ``duties``: the strictest of all that was found; ``score``: 1 - 0.5^evidence, a
    phrase or tag counting once, a readable expression twice more.  Null texts count as empty.
    """
    base, notices = BASE_PHRASES if base is None else base, NOTICES if notices is None else notices

    def start():
        scanner = kept_in_worker(("licenses", *base.items(), *notices.items()), lambda: Scanner(base, notices))

        def work(texts: list) -> list:
            return [list(c) for c in zip(*map(scanner.scan, texts), strict=True)] if texts else [[]] * 9

        return work

    kinds = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("expressions", "array<string>"), ("duties", "string"), ("score", "double")]
    arrow = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "double": pa.float64()}
    return map_column(docs, docs.columns if keep is None else keep, text, start, [(n, t, arrow[t]) for n, t in kinds])
