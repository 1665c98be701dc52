"""The radius of decontamination turns away no window that reaches the similarity."""

import random

import brute

from wayrisk.llm import decontaminate


def test_safe_radius():
    own = decontaminate.Settings()
    assert own.bits == decontaminate.safe_radius(0.8, 4) == 23
    assert decontaminate.safe_radius(0.9, 4) < own.bits and decontaminate.Settings(radius=3).bits == 3


def test_no_leak_near_the_threshold_is_lost(spark):
    rng = random.Random(8)
    items, docs = {}, {}
    for g in range(40):
        item = [f"w{rng.randrange(10_000)}" for _ in range(49)]
        items[g] = " ".join(item)
        for k in range(25):  # five shingles of 45 changed by one word within: similarity 0.8
            words = list(item)
            words[rng.randrange(4, 45)] = f"x{g}q{k}"
            docs[100 * g + k] = " ".join([f"y{rng.randrange(99)}" for _ in range(rng.randrange(9))] + words)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    known = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontaminate.leaks(frame, known).collect()}
    want = brute.leaks(docs, items)
    assert len(want) == 1000 and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] in want[k][1] for k in got)
    narrow = decontaminate.leaks(frame, known, decontaminate.Settings(radius=15)).count()
    print("recall at 0.8, radius 15:", narrow / len(want), "radius 23:", len(got) / len(want))
    assert narrow < len(want)
