"""The numbered queries and the pipeline against plain versions, on the small test folders."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

import brute
import corpus_pipeline

from wayrisk.llm import decontaminate, language_id, license_scan, quality_rules, sentencepiece_codec, simhash_dedup, suffix_dedup, token_files
from test_near_copies import groups, shingles
from wayrisk.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def rows(spark, name, folder=FOLDER):
    return [tuple(r) for r in QUERIES[name](spark, folder).collect()]


def test_op1(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    want = brute.leaks(texts, items)
    tables = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontaminate.leaks(*tables).collect()}
    assert want and same_leaks(got, want)
    assert {(r[0], r[1]): r[3] for r in rows(spark, "op1_decontaminate")} == {k: v[0] for k, v in got.items()}


def same_leaks(got, want):
    return got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] in want[k][1] for k in got)


def test_op1_edited_and_shifted_copies(spark):
    rng = random.Random(3)
    item = [f"w{rng.randrange(10_000)}" for _ in range(55)]
    edited = {}
    for k in range(60):
        words = list(item)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(55)] = "other"
        for _ in range(k % 4):
            words.insert(rng.randrange(55), "more")
        edited[k] = " ".join([f"x{rng.randrange(99)}" for _ in range(rng.randrange(40))] + words + ["end"] * rng.randrange(9))
    docs = spark.createDataFrame(list(edited.items()), "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontaminate.leaks(docs, items).collect()}
    assert same_leaks(got, brute.leaks(edited, {7: " ".join(item)})) and len(got) > 20


def test_op2(spark, texts):
    fps = {i: brute.simhash(t) for i, t in texts.items()}
    want = brute.components(fps)
    assert {r[0]: (r[1], r[2]) for r in rows(spark, "op2_simhash_dedup")} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_op2_crowded_files_keep_every_link():
    rng = np.random.default_rng(1)
    fp = np.unique(np.bitwise_xor.reduce(np.int64(1) << rng.integers(0, 12, (400, 4)), axis=1))
    a, b = simhash_dedup.spanning_links(np.zeros(len(fp), np.int64), fp, 1)
    linked = brute.components({int(f): int(f) for f in fp}, 1)
    root = {int(f): int(f) for f in fp}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[x] = y
    for f in root:
        while root[f] != root[root[f]]:
            root[f] = root[root[f]]
    assert root == linked


def test_op2_chunks(spark):
    rng = random.Random(2)
    fps = sorted({sum(1 << b for b in rng.sample(range(16), 3)) for _ in range(300)} | {rng.getrandbits(63) for _ in range(50)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash_dedup.close_links(frame, simhash_dedup.Settings(chunk=16)).collect()
    near = {f: {f} for f in fps}
    for x, y in links:
        assert (x ^ y).bit_count() >= 0
        joined = near[x] | near[y]
        for f in joined:
            near[f] = joined
    want = brute.components({f: f for f in fps})
    assert {f: min(near[f]) for f in fps} == want and len(set(want.values())) < len(fps)


def test_op3(spark, texts):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PIECES)
    want = {}
    for i, t in texts.items():
        ids = library.encode(t or "")
        want[i] = (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids)))
    assert {r[0]: r[1:] for r in rows(spark, "op3_sentencepiece")} == want


def test_op3_odd_texts():
    from sentencepiece import SentencePieceProcessor

    with open(PIECES, "rb") as file:
        model = file.read()
    library, encoder, decoder = SentencePieceProcessor(model_proto=model), sentencepiece_codec.PieceEncoder(model), sentencepiece_codec.PieceDecoder(model)
    rng, signs = random.Random(1), "abtheinr  \n\t▁éß中😀<s>0x0A>"
    cases = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(3000)]
    cases += [" " * k + "x" + " " * (40 - k) for k in range(41)] + ["a" * 300, "=-" * 100, " " * 1000, "x\0<s></s>"]
    for text in cases:
        ids = np.frombuffer(encoder.encode(text), "<i4").tolist()
        assert ids == library.encode(text) and decoder.decode(ids) == library.decode(ids)
    for _ in range(1000):
        ids = [rng.choice([rng.randrange(3, 300), rng.randrange(32_000)]) for _ in range(rng.randrange(12))]
        assert decoder.decode(ids) == library.decode(ids)


def test_op4(spark, texts):
    from tokenizers import Tokenizer

    library, want, at = Tokenizer.from_file(BYTES), {}, 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r[0]: r[1:] for r in rows(spark, "op4_token_files")} == want


def test_op4_code_and_odd_texts():
    from tokenizers import Tokenizer

    values = np.concatenate([np.random.default_rng(1).integers(0, 2**k, 500) for k in (1, 8, 9, 16, 17, 24, 25, 32)]).astype(np.uint32)
    for n in (0, 1, 3, 4, 5, len(values)):
        assert (token_files.unpack(*token_files.pack(values[:n]), n) == values[:n]).all()
    with open(BYTES, encoding="utf-8") as file:
        definition = file.read()
    words, library, rng = token_files.WordTokenizer(definition, "<u2"), Tokenizer.from_str(definition), random.Random(2)
    signs = ["a", "the", "'s", " ", " ", "  ", "\n", "\t", " ", "é", "1", ".", "<|endoftext|>", "😀", "　", "\r"]
    signs += ["B", "<", ">", "|", "#", "$$", "?!", "'", "_", "日", "\u0301", "\x1c", "\u2028", "\n\n"]
    for _ in range(60):  # small tables, so that words are new, known and in other company
        cases = [None, "", *["".join(rng.choices(signs, k=rng.randrange(25))) for _ in range(150)]]
        for case, got in zip(cases, words.encode(pa.array(cases, pa.string()), 2).to_pylist(), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == [*library.encode(case or "", add_special_tokens=False).ids, 2]


def test_op4_forgotten_words(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "WORDS_REMEMBERED", 20)
    with open(BYTES, encoding="utf-8") as file:
        definition = file.read()
    words, library, rng = token_files.WordTokenizer(definition, "<u2"), Tokenizer.from_str(definition), random.Random(3)
    for _ in range(50):
        cases = [" ".join(rng.choice(["ab", "cd,", "ef.\nGh!", "x"]) + rng.choice("klmno") for _ in range(12)) for _ in range(5)]
        for case, got in zip(cases, words.encode(pa.array(cases), 2).to_pylist(), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == [*library.encode(case, add_special_tokens=False).ids, 2]


def test_op6(spark, texts):
    got = {r[0]: r[1:6] for r in rows(spark, "op6_license_scan")}
    assert got == {i: brute.licenses(t, license_scan.BASE_PHRASES) for i, t in texts.items()}


def test_op6_expressions():
    read = lambda x: license_scan.evaluate(license_scan.expression(x))
    assert read("(MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0 for all") == (["mit", "gpl-2.0-only", "apache-2.0"], 1)
    assert read("GPL-3.0-only AND MIT") == (["gpl-3.0-only", "mit"], 3) and read("MIT OR") == (["mit"], 1)
    assert read("( MIT") == read("AND MIT") == read("") == ([], 0) and read("GPL-2.0 WITH x-exception") == (["gpl-2.0"], 2)


def test_op7(spark, texts):
    from xxhash import xxh64_intdigest

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1").collect()
    trusted, own = {r.doc_id for r in labels}, quality_rules.Settings()

    def buckets(text):
        hashes = [xxh64_intdigest(w.encode(), 42) for w in brute.SPACED.findall(text or "")]
        as_long = [h.to_bytes(8, "little") for h in hashes]
        pairs = [xxh64_intdigest(b, xxh64_intdigest(a, 42)) for a, b in zip(as_long, as_long[1:], strict=False)]
        return [(h - (h >> 63 << 64)) % own.buckets for h in hashes + pairs]

    raw, target = Counter(), Counter()
    for i, t in texts.items():
        raw.update(buckets(t))
        if i in trusted:
            target.update(buckets(t))
    n_raw, n_target = sum(raw.values()) + own.buckets, sum(target.values()) + own.buckets
    weight = {b: math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in range(own.buckets)}
    for row in QUERIES["op7_quality_rules"](spark, FOLDER).collect():
        base, found = brute.quality(texts[row.doc_id]), buckets(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == base
        score = sum(weight[b] for b in found) / len(found) if found else 0.0
        assert row.score == pytest.approx(score, abs=1e-9) and row.kept == (not base[5] and row.score >= own.min_score)


def test_op8(spark, texts):
    data = {i: (t or "").encode() for i, t in texts.items()}
    want = {i: (len(data[i]), len(data[i]) - len(kept), runs, brute.sha(kept)) for i, (kept, runs) in brute.repeated(data).items()}
    assert {r[0]: r[1:] for r in rows(spark, "op8_suffix_dedup")} == want


def test_op8_index_on_repetitive_strings():
    rng = random.Random(4)
    base = [bytes(rng.choices(b"ab\0", k=120)) for _ in range(3)]
    strings = list({bytes(a[:k] + b[k : k + 90]) for a in base for b in base for k in (10, 40, 70)})
    first = np.array([rng.randrange(1000) for _ in strings])
    seen = {}
    for s, f in zip(strings, first.tolist(), strict=True):
        for k in range(len(s) - 49):
            seen[s[k : k + 50]] = min(f, seen.get(s[k : k + 50], f))
    got = suffix_dedup.window_firsts(strings, np.zeros(len(strings), np.uint64), first, 50)
    for s, g in zip(strings, got, strict=True):
        assert g.tolist() == [seen[s[k : k + 50]] for k in range(len(s) - 49)]


def test_op8_groups_of_copies_over_many_groups(spark):
    rng = random.Random(6)
    words = [bytes(rng.choices(b"abcdefgh", k=6)).decode() for _ in range(40)]
    make = lambda: " ".join(rng.choices(words, k=60))
    passages = [make() for _ in range(5)]
    docs = {i: rng.choice([make(), rng.choice(passages), make()[:100] + rng.choice(passages) + "é" * 30, "ab" * 100]) for i in range(120)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    settings = suffix_dedup.Settings(group_bytes=4000, piece_windows=16)
    got = {r.doc_id: (bytes(r.kept), len(r.starts)) for r in suffix_dedup.repeated(frame, settings).collect()}
    assert got == brute.repeated({i: t.encode() for i, t in docs.items()})


def test_op9(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    first, want = {}, {}
    for i in sorted(pages):
        f = first.setdefault(pages[i], i)
        want[i] = (len(pages[i]), base64.b32encode(hashlib.sha1(pages[i]).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)
    assert {r[0]: r[1:] for r in rows(spark, "op9_warc")} == want


def test_op10_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = [r for r in QUERIES["op10_language_id"](spark, folder).collect() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in langs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in held) and sum(r.rejected for r in held) <= 0.03 * len(held)


def test_pipeline(spark, texts):
    from sentencepiece import SentencePieceProcessor

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    learned = language_id.fit(docs.where(~language_id.held_out()))
    judge, least = language_id.Classifier(learned, language_id.Settings()).judge, language_id.Settings().min_margin
    left = {i: t for i, t in texts.items() if (found := judge(t))[0] != "und" and found[1] >= least}
    first = groups({i: shingles(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if first[i] == i}
    cut = brute.repeated({i: t.encode() for i, t in left.items()})
    left = {i: kept.decode("utf-8", "ignore") if runs else left[i] for i, (kept, runs) in cut.items()}
    left = {i: t for i, t in left.items() if brute.SPACED.search(t) or not cut[i][1]}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    leaking = {d for d, _ in brute.leaks(left, items)}
    library = SentencePieceProcessor(model_file=PIECES)
    want = {}
    for i in left.keys() - leaking:
        ids = library.encode(left[i])
        want[i] = (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids)), ids)
    assert {r[0]: tuple(r)[1:] for r in corpus_pipeline.run(spark, FOLDER).collect()} == want
    assert len(want) < len(texts) and [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "repeated_strings", "decontamination", "encoding"]


def test_pipeline_edges(spark):
    text = "the quick brown fox jumps over the lazy dog and runs into the deep forest again. "
    rows = [(1, text * 3, "en", "s", 3), (1, text * 3, "en", "s", 3), (None, text * 3, None, None, None), (2, None, "en", "s", 0), (3, "", None, "s", 0), (4, "123", "en", None, 3), (5, text * 3, "fr", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS fp", "2 AS left", "3 AS rejected")
    for frame in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, FOLDER)
            if name != "encoding":
                assert out.columns == corpus_pipeline.COLUMNS
            kept = out.count()
            assert kept <= frame.count()
            if name == "near_dedup" and frame is docs:
                assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "4"]


def test_pipeline_keeps_rows_apart(spark):
    """Several texts of one id, and rows without an id, are judged and cut row by row."""
    rng = random.Random(11)
    words = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    p, q, a, b, c = words(30), words(30), words(30), words(30), words(30)
    rows = [(0, f"{p} {q}"), (1, f"{a} {p}"), (1, b), (None, f"{c} {q}"), (None, f"{words(9)} {item}"), (2, words(20)), (2, item), (3, b + " more"), (None, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert sorted((str(r.doc_id), r.text) for r in one.collect()) == sorted((str(i), t) for i, t in rows[:7])
    cut = corpus_pipeline.repeated_strings(spark, one, FOLDER)
    got = sorted((str(r.doc_id), r.text, r.n_chars) for r in cut.collect())
    order = sorted(range(7), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, hashlib.sha256(rows[k][1].encode()).hexdigest()))
    plain = brute.repeated({at: rows[k][1].encode() for at, k in enumerate(order)})
    assert got == sorted((str(rows[k][0]), (t := plain[at][0].decode()), len(t)) for at, k in enumerate(order) if plain[at][0].strip())
    assert len(got) == 7 and (("1", b, len(b)) in got) and all(t != f"{a} {p}" for _, t, _ in got)
    clean = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.without_benchmark(spark, one, FOLDER).collect())
    assert clean == sorted((str(i), t) for i, t in rows[:7] if item not in t)
    twice = corpus_pipeline.repeated_strings(spark, docs.unionByName(docs), FOLDER)
    assert twice.count() == 2 * corpus_pipeline.repeated_strings(spark, docs, FOLDER).count()
