"""Plain single-process versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

LOWER = {c: c + 32 for c in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def simhash(text, k=3):
    from xxhash import xxh64_intdigest

    words = SPACED.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: dict, radius=3) -> dict:
    """Smallest id reachable over pairs of close fingerprints."""
    ids = sorted(fps)
    out, open_ids = {}, set(ids)
    for first in ids:
        if first not in open_ids:
            continue
        open_ids.remove(first)
        todo = [first]
        while todo:
            at = todo.pop()
            out[at] = first
            near = {i for i in open_ids if (fps[at] ^ fps[i]).bit_count() <= radius}
            open_ids -= near
            todo += near
    return out


def repeated(rows: dict, length=50) -> dict:
    """Bytes that stay and number of removed runs, by id."""
    first = {}
    for i in sorted(rows):
        for k in range(len(rows[i]) - length + 1):
            first.setdefault(rows[i][k : k + length], i)
    out = {}
    for i, data in rows.items():
        cover = np.zeros(len(data) + 1, int)
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < i:
                cover[k] += 1
                cover[k + length] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (np.frombuffer(data, np.uint8)[~gone].tobytes(), runs)
    return out


def grams(words, k=5):
    k = min(k, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def leaks(docs: dict, items: dict, similarity=0.8) -> dict:
    """(doc, item): best similarity and the starts that reach it, of item-sized windows that share a shingle."""
    known = {i: (w, grams(w)) for i, t in items.items() if (w := PLAIN.findall((t or "").lower()))}
    having = defaultdict(set)
    for i, (_, g) in known.items():
        for s in g:
            having[s].add(i)
    best = {}
    for d, text in docs.items():
        words = PLAIN.findall((text or "").lower())
        for at in range(len(words) - 4):
            for i in having.get(tuple(words[at : at + 5]), ()):
                own, g = known[i]
                n = len(own)
                for start in range(max(0, at - n + 1), max(1, min(at, len(words) - n) + 1)):
                    window = grams(words[start : start + n])
                    both = sum((window & g).values())
                    found = both / (sum(window.values()) + sum(g.values()) - both)
                    if found >= similarity and found >= best.get((d, i), (0,))[0]:
                        same = best[d, i][1] if best.get((d, i), (0,))[0] == found else set()
                        best[d, i] = (found, same | {start})
    return best


def licenses(text, phrases):
    words, starts, labels = PLAIN.findall((text or "").translate(LOWER)), [], set()
    for phrase, label in phrases.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def quality(text):
    text = text or ""
    words, seen, dup = SPACED.findall(text), set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(tri), set()
    for i, t in enumerate(tri):
        if count[t] > 1:
            covered |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed
