"""Leaks whose parts changed places, keys of archives, and sides that are too large to broadcast."""

import random

from pyspark.sql import functions as F

import brute

from wayrisk.llm import common, decontaminate, warc


def test_rearranged_items_are_found(spark):
    rng = random.Random(21)
    items, docs = {}, {}
    for g in range(30):
        item = [f"w{rng.randrange(10_000)}" for _ in range(rng.choice((60, 100, 140)))]
        items[g] = " ".join(item)
        n = len(item)
        cut, third = rng.randrange(n // 3, 2 * n // 3), n // 3
        forms = [
            item[cut:] + item[:cut],
            item[cut:] + ["and"] + item[:cut],
            item[: n // 2] + item[: n // 2] + item[n // 2 :],  # a half doubled
            item[third : 2 * third] + item[:third] + item[2 * third :],
            [w for a, b in zip(item[: n // 2], item[n // 2 :], strict=False) for w in (a, b)],  # interleaved: nothing shared
        ]
        for k, words in enumerate(forms):
            docs[10 * g + k] = " ".join([f"y{rng.randrange(99)}" for _ in range(rng.randrange(30))] + words + ["end"] * rng.randrange(5))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    known = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontaminate.leaks(frame, known).collect()}
    want = brute.leaks(docs, items)
    assert got.keys() == want.keys() and len(want) > 60
    assert all(got[k][0] == want[k][0] and got[k][1] in want[k][1] for k in got)


def test_repeated_shingles(spark):
    """Windows of many equal shingles, for which the radius is not derived."""
    rng = random.Random(22)
    items, docs = {}, {}
    for g in range(40):
        words = [f"w{rng.randrange(9_000)}" for _ in range(6)]
        item = (words * 12)[: rng.randrange(30, 60)]
        items[g] = " ".join(item)
        for k in range(5):
            edited = list(item)
            for at in rng.sample(range(len(item)), k % 2):
                edited[at] = "other"
            docs[10 * g + k] = " ".join([f"y{rng.randrange(99)}" for _ in range(9)] + edited)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    known = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(frame, known).collect()}
    want = {k: v[0] for k, v in brute.leaks(docs, items).items()}
    print("windows of equal shingles found:", len(got), "of", len(want))
    assert got.items() <= want.items() and len(got) >= 0.99 * len(want) > 100


def test_pages_without_an_id_stand_apart(spark):
    rows = [(None, "http://a.b/x", "one"), (-1, "http://a.b/x", "two"), (None, "http://a.b/x", "three"), (0, "http://a.b/x", "one")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), with_payload=True).collect()
    assert sorted((str(r.page_id), bytes(r.payload) if r.payload is not None else None) for r in got) == [("-1", b"two"), ("0", b"one"), ("None", b"one"), ("None", b"three")]


def test_host_is_behind_the_first_separator(spark):
    urls = ["http://Web.example.net/x?u=http://other.org/y", "https://a.b", "no scheme", None, "http://h.i/://z"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(warc.surt(F.col("url"))).collect()]
    assert got == ["net,example,web)/x?u=http://other.org/y", "b,a)", "no scheme", "", "i,h)/://z"]


def test_sides_are_checked_by_bytes(spark):
    rows = spark.range(100).select("id", F.expr("repeat('x', 1000)").alias("t"), F.expr("array_repeat(1L, 100)").alias("a"))
    plan = lambda side: spark.range(100).join(side, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(common.checked_side(rows)) and "broadcast" not in plan(common.checked_side(rows, max_bytes=100_000))
    assert "broadcast" not in plan(common.checked_side(rows, max_rows=99)) and "broadcast" in plan(common.checked_side(rows.where("false")))
