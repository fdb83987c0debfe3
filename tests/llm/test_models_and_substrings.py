"""Quality classifier, language model, chunks, suffix arrays."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm_tables import pairs

from scrubline.llm import chunk_dedup, lm, nbsvm, suffix_dedup


def test_dual_coordinate_descent_finds_the_optimum():
    """Primal and dual objective meet."""
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(20, 5, replace=False)) for _ in range(60)]
    values = [rng.normal(size=5) for _ in rows]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    cost = np.full(60, 0.5)
    old, nbsvm.PASSES = nbsvm.PASSES, 2000
    try:
        w, b = nbsvm.dual_coordinate_descent(rows, values, y, cost, 20)
    finally:
        nbsvm.PASSES = old

    def objective(w, b):
        slack = [max(0.0, 1 - s * (w[r] @ v + b)) for r, v, s in zip(rows, values, y)]
        return (w @ w + b * b) / 2 + (cost * slack).sum()

    best = objective(w, b)
    for _ in range(300):
        assert objective(w + rng.normal(size=20) * 0.01, b + rng.normal() * 0.01) >= best - 1e-3


def test_ratio_of_counts():
    rows, y = [np.array([1, 2]), np.array([2]), np.array([3])], np.array([True, True, False])
    ratio = nbsvm.log_count_ratio(rows, y)
    assert ratio[1] > 0 > ratio[3] and ratio[2] > ratio[1]


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = nbsvm.fit(docs, labels, "quality", learn=~held_out)
    rows = nbsvm.score(docs, model).join(labels, "doc_id").filter(held_out).collect()
    right = [(r["score"] >= 0.7) == (r["quality"] == 1) for r in rows]
    assert len(rows) > 50 and np.mean(right) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_odd_inputs(spark, odd, empty, repeated):
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = nbsvm.fit(odd, labels, "quality")
    for df in (odd, repeated, empty):
        rows = nbsvm.score(df, model).collect()
        assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = nbsvm.fit(odd, labels.filter("false"), "quality")
    assert {r["score"] for r in nbsvm.score(odd, none).collect()} == {0.5}
    one = nbsvm.fit(odd, labels.filter("quality = 1"), "quality")
    assert min(r["score"] for r in nbsvm.score(odd, one).collect()) > 0.9
    assert len(nbsvm.features(b"")) == 0


def token_list(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))] + [b""]


@pytest.mark.parametrize("table,frequent", [("odd", 1 << 19), ("documents", 1 << 19), ("documents", 50)])
def test_language_model(request, table, frequent, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    df = request.getfixturevalue(table)
    held_out = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    counts = Counter(w for k, t in pairs(df) if not held_out(k) for w in token_list(t))
    n, v = sum(counts.values()), len(counts)
    got = lm.score(df, F.crc32(F.col("doc_id").cast("string")) % 7 != 2).collect()
    assert len(got) == df.count()
    texts = dict(pairs(df))
    for r in got:
        words = token_list(texts[r["doc_id"]])
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-6, rel=1e-9) and r["score"] < 0
    if table == "documents":
        unseen = [r for r in got if held_out(r["doc_id"])]
        assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_model_is_a_distribution():
    """Class chances add up to one, and words with the unknown share add up to their class."""
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32)
    keys, sizes = lm.Words().tokens([b"the cat sat", b"", b"a b c d e"])
    rows = lm.rows_of(keys, sizes)
    assert rows.max() < lm.ROWS and sizes.tolist() == [4, 1, 6]
    assert np.allclose(lm.class_chances(weights, rows).sum(axis=1), 1, atol=1e-5)
    assert rows[:, 0].tolist() == rows[:, 4].tolist() == rows[:, 5].tolist()  # texts start alike


def test_gradient_lowers_the_loss():
    texts = [b"red fox runs " * 30, b"blau wal schwimmt " * 30] * 20
    keys, sizes = lm.Words().tokens(texts)
    learner = lm.Learner(np.zeros((lm.ROWS, lm.CLASSES), np.float32))
    own = (keys & np.uint64(lm._MASK)).astype(np.int64)

    def loss():
        chances = lm.class_chances(learner.weights, lm.rows_of(keys, sizes))
        return -np.log(chances[np.arange(len(own)), own]).mean()

    before = loss()
    for _ in range(20):
        learner.learn(keys, sizes)
    assert loss() < before / 4


def test_context_tells_words_of_one_class(spark):
    """Two words of one class and equal counts: which one follows is told by the word before."""
    rows = [(k, "left boat " * 40 if k % 2 else "right coat " * 40) for k in range(60)]
    probes = [(100, "left boat"), (101, "left coat"), (102, "right boat"), (103, "right coat")]
    df = spark.createDataFrame(rows + probes, "doc_id long, text string").coalesce(2)
    got = {r["doc_id"]: r["score"] for r in lm.score(df, F.col("doc_id") < 100).collect()}
    assert got[100] > got[101] + 0.5 and got[103] > got[102] + 0.5


@pytest.mark.parametrize("frequent", [1 << 19, 40])
def test_word_chances_add_up(spark, monkeypatch, frequent):
    """After a context, the chances of all words, with one unknown for each shared slot, are one."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "abcdefghijkl" for b in ("ing", "tion", "er", "x", "yy", "zzz")] * 2 + ["the"] * 50
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(200))) for k in range(40)]
    words = sorted({w for _, t in rows for w in t.split()})
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    made = []
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda blocks, slots, hashed: made.append((slots, hashed, train(blocks, slots, hashed))) or made[0][2])
    got = lm.score(df, F.lit(True)).collect()
    slots, hashed, weights = made[0]
    counts = Counter(w for _, t in rows for w in token_list(t))

    def chance(before, key, n):
        """By brute force, one word at a time."""
        keys, sizes = np.array([*before, key], np.uint64), np.array([len(before) + 1])
        kind, slot = int(key) & 31, int(slots.of(keys)[-1])
        outer = lm.class_chances(weights[0], lm.rows_of(keys, sizes, hashed))[-1, kind]
        inner = lm.class_chances(weights[1], lm.rows_of(keys, sizes, hashed, True))[-1, slot]
        own = slot < lm.OWN
        total = n + 1 if own else 1 + sum(
            counts[w] + 1 for w, k in zip(all_words, all_keys) if int(k) & 31 == kind and slots.of(np.array([k]))[0] == slot
        )
        return float(outer) * float(inner) * (n + 1) / total

    all_words = [*(w.encode() for w in words), b""]
    all_keys = lm.word_keys(all_words, lm.Endings())
    before = [all_keys[all_words.index(b"the")], all_keys[0]]
    sum_known = sum(chance(before, k, counts[w]) for w, k in zip(all_words, all_keys))
    unknown = [np.uint64(c | s << lm.CLASS_BITS | 1 << 60) for c in range(lm.CLASSES) for s in range(lm.SHARED)]
    assert sum_known + sum(chance(before, k, 0) for k in unknown) == pytest.approx(1, abs=1e-4)
    # score is the sum of these over a text
    text = token_list(rows[0][1])
    keys = [all_keys[all_words.index(w)] for w in text]
    brute = sum(math.log10(chance(keys[max(0, i - 2) : i], k, counts[w])) for i, (w, k) in enumerate(zip(text, keys)))
    assert {r["doc_id"]: r["score"] for r in got}[0] == pytest.approx(brute, rel=1e-4)


def test_hashed_rows_grow(spark, monkeypatch):
    assert [lm.hashed_rows(n) for n in (0, 10**8, 2 * 10**8, 4 * 10**9)] == [4096, 4096, 8192, 32768]
    df = spark.createDataFrame([(k, f"some words {k % 7} in a row") for k in range(50)], "doc_id long, text string")
    monkeypatch.setattr(lm, "ROWS_FROM_TOKENS", 4)
    sizes = []
    weights = lm.Slots.weights
    monkeypatch.setattr(lm.Slots, "weights", lambda self, hashed: sizes.append(hashed) or weights(self, hashed))
    assert all(r["score"] > r["base_score"] for r in lm.score(df, F.lit(True)).collect())
    assert sizes == [4096 * 8]


def test_language_model_odd_inputs(empty, repeated):
    assert lm.score(empty, F.lit(True)).count() == 0
    assert lm.score(repeated, F.lit(True)).count() == repeated.count()
    nothing = lm.score(repeated, F.lit(False)).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in nothing} == {(0, 0)}


# -- chunks -----------------------------------------------------------------------------


def gear(data):
    out, h = [], 0
    for b in data:
        h = ((h << 1) + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_gear_hash_rolls():
    data = random.Random(1).randbytes(500)
    assert chunk_dedup.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == gear(data)


def test_cuts():
    rng = random.Random(2)
    for n in (1, 5, 64, 65, 300, 5000):
        data = bytes(rng.choice(b"abcdef ") for _ in range(n))
        parts = list(chunk_dedup.chunks(data))
        assert b"".join(data[s:e] for s, e, _ in parts) == data
        assert all(chunk_dedup.REACH < e - s <= chunk_dedup.MAX_CHUNK for s, e, _ in parts[1:-1])
        order = [((h * 0x9E3779B1) & 0xFFFFFFFF) | 1 for h in gear(data)]
        ends = {
            i + 1
            for i in range(n)
            if all(order[i] > order[j] for j in range(max(0, i - 32), min(n, i + 33)) if j != i)
        }
        assert ends <= {e for _, e, _ in parts}
    assert all(e - s <= chunk_dedup.MAX_CHUNK for s, e, _ in chunk_dedup.chunks(b"a" * 9000))
    assert list(chunk_dedup.chunks(b"")) == []


def test_insertions_move_near_cuts_only():
    data = " ".join(f"w{k * 7919 % 1000}" for k in range(600)).encode()
    chunks_of = lambda d: {d[s:e] for s, e, _ in chunk_dedup.chunks(d)}
    before, after = chunks_of(data), chunks_of(data[:1000] + b"inserted" + data[1000:])
    assert len(before - after) <= 3


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_chunk_dedup(request, table):
    df = request.getfixturevalue(table)
    first, want = {}, {}
    for k, t in sorted(pairs(df)):
        data, kept = (t or "").encode(), []
        for s, e, _ in chunk_dedup.chunks(data):
            if e - s <= chunk_dedup.REACH or first.setdefault(data[s:e], (k, s)) == (k, s):
                kept.append(data[s:e])
        want[k] = b"".join(kept)
    got = chunk_dedup.drop_repeats(df).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == want and len(got) == len(want)
    for r in got:
        assert r["n_removed"] == r["n_bytes"] - len(want[r["doc_id"]])
        assert all(k < r["doc_id"] for k in r["first_keys"] or ())


def test_passages_are_caught(spark, empty, repeated):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    passages = [prose(52) for _ in range(30)]
    rows = [(k, prose(40) + " " + p + " " + prose(40)) for k, p in enumerate(passages)]
    rows += [(100 + k, prose(33) + " " + p + prose(10)) for k, p in enumerate(passages)]
    rows += [(200 + k, prose(150)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["n_removed"] for r in chunk_dedup.drop_repeats(df).collect()}
    assert all((got[k] > 0) == (100 <= k < 200) for k in got)
    assert chunk_dedup.drop_repeats(empty).count() == 0
    assert chunk_dedup.drop_repeats(repeated).count() == repeated.count()


# -- suffix arrays ----------------------------------------------------------------------


def test_suffix_array():
    rng = random.Random(1)
    for trial in range(150):
        letters = rng.choice([b"a", b"ab", b"abcdefgh \n", bytes(range(256))])
        raw = bytes(rng.choice(letters) for _ in range(rng.randint(1, 250)))
        raw = raw + raw[: len(raw) // 2] + raw if trial % 3 == 0 else raw
        order = suffix_dedup.suffix_array(np.frombuffer(raw, np.uint8), 50)
        assert sorted(order.tolist()) == list(range(len(raw)))
        heads = [raw[i : i + 50] for i in order]
        assert heads == sorted(heads)
        shared = suffix_dedup.common_prefixes(np.frombuffer(raw, np.uint8), order, 50)
        for k in range(1, len(order)):
            a, b = (raw[order[j] :] + bytes(60) for j in (k, k - 1))
            assert shared[k] == next((c for c in range(50) if a[c] != b[c]), 50)


def test_suffix_array_of_some_places():
    """Only wanted suffixes are sorted, and those that their order is found from."""
    rng = random.Random(2)
    for _ in range(150):
        letters = rng.choice([b"a", b"ab", b"abcdefgh \n", bytes(range(256))])
        raw = bytes(rng.choice(letters) for _ in range(rng.randint(1, 250)))
        raw = np.frombuffer(raw + raw[: len(raw) // 2], np.uint8)
        wanted = np.array([rng.random() < rng.choice([0.05, 0.5]) for _ in raw])
        order = suffix_dedup.suffix_array(raw, 50, wanted)
        assert len(set(order.tolist())) == len(order) and set(np.flatnonzero(wanted)) <= set(order.tolist())
        heads = [raw.tobytes()[i : i + 50] for i in order]
        assert heads == sorted(heads)
    text = np.frombuffer(b"".join(rng.choice([b"thein", b"onand", b" of", b"ly"]) for _ in range(3000)), np.uint8)
    wanted = np.arange(len(text)) % 67 < 18
    assert len(suffix_dedup.suffix_array(text, 50, wanted)) < 1.2 * wanted.sum()


def test_suffix_dedup_sorts_only_what_is_disputed(spark, monkeypatch):
    """Runs that are copies of each other are settled without a suffix array, those across a passage's ends are not."""
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = some(3000)
    rows = [(k, some(200) + passage + some(200)) for k in range(2)]
    runs = [(text, start, count, mark) for text, start, count, mark in zip(*suffix_dedup.runs([t.encode() for _, t in rows], 50))]
    contexts = [rows[text][1].encode()[start : start + count + 49] for text, start, count, _ in runs]
    strings, which = suffix_dedup.numbered(contexts)
    least, later = suffix_dedup._later(which, np.array([r[0] for r in runs]), len(strings))
    marks = np.zeros(len(strings), np.uint64)
    marks[which] = [r[3] for r in runs]
    disputed = suffix_dedup._disputed(marks, least)
    assert 0 < len(disputed) < 10 < len(strings) and later.sum() > 100
    context, offset = suffix_dedup.covered([strings[k] for k in disputed], least[disputed], 50)
    all_context, all_offset = suffix_dedup.covered(strings, least, 50)
    found = sorted(zip(disputed[context].tolist(), offset.tolist()))
    assert found == sorted(zip(all_context.tolist(), all_offset.tolist())) and found
    want = removed([(k, t.encode()) for k, t in rows], 50)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in suffix_dedup.drop_repeats(df).collect():
        assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))] == want[r["doc_id"]]


def removed(docs, length):
    """Brute force over all strings of the length; docs: (order, text)."""
    least = {}
    for k, t in docs:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            least[w] = min(k, least.get(w, k))
    out = defaultdict(list)
    for k, t in docs:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < k:
                gone[i : i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) > 0).sum())
        out[k].append((len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


LAST = (1 << 63) - 1


@pytest.mark.parametrize("table", ["odd", "documents", "repeated"])
def test_suffix_dedup(request, table):
    df = request.getfixturevalue(table)
    want = removed([(LAST if k is None else k, (t or "").encode()) for k, t in pairs(df)], 50)
    got = suffix_dedup.drop_repeats(df).collect()
    assert len(got) == df.count() and any(r["n_removed"] for r in got)
    for r in got:
        key = LAST if r["doc_id"] is None else r["doc_id"]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) in want[key]


def test_suffix_dedup_of_a_passage_in_most_rows(spark, monkeypatch):
    """Runs across the ends of a passage differ in every row and have the passage's marks; no bucket takes them all."""
    monkeypatch.setattr(suffix_dedup, "SUFFIX_BUCKET_BYTES", 4_000)
    made = []
    by_bucket = F.sum(F.length("texts")).alias("bytes")
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = some(150)
    rows = [(k, some(60) + passage + some(60) if k % 3 else some(100)) for k in range(300)]
    rows += [(300 + k, rows[k][1][20:]) for k in range(40)]  # and some repeat across the ends
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blobs = suffix_dedup._blobs
    monkeypatch.setattr(suffix_dedup, "_blobs", lambda *a: made.append(blobs(*a)) or made[0])
    want = removed([(k, t.encode()) for k, t in rows], 50)
    for r in suffix_dedup.drop_repeats(df).collect():
        assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))] == want[r["doc_id"]]
    largest = made[0].filter("bucket >= 0").groupBy("bucket").agg(by_bucket).agg(F.max("bytes")).first()[0]
    assert 0 < largest < 2 * suffix_dedup.SUFFIX_BUCKET_BYTES


def test_suffix_dedup_of_one_window_many_times(spark, monkeypatch):
    """The bytes of a window that a row has in many places are sent once."""
    monkeypatch.setattr(suffix_dedup, "SUFFIX_BUCKET_BYTES", 4_000)
    made = []
    blobs = suffix_dedup._blobs
    monkeypatch.setattr(suffix_dedup, "_blobs", lambda *a: made.append(blobs(*a)) or made[0])
    rows = [(k, "x" * (900 + 10 * k) + f"end {k}") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = removed([(k, t.encode()) for k, t in rows], 50)
    for r in suffix_dedup.drop_repeats(df).collect():
        assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))] == want[r["doc_id"]]
    assert made[0].agg(F.sum(F.length("texts"))).first()[0] < 30_000


@pytest.mark.parametrize("copies", [100, 400])
def test_suffix_dedup_of_near_copies_makes_few_ranges(spark, monkeypatch, copies):
    """What a slice settles of a text is told as whole ranges, not as one for each run or window."""
    monkeypatch.setattr(suffix_dedup, "SUFFIX_BUCKET_BYTES", 4_000)
    made = []
    settle = suffix_dedup._settle
    monkeypatch.setattr(suffix_dedup, "_settle", lambda *a: made.append(settle(*a)) or made[0])
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    text = some(900)
    rows = [(k, text + some(30)) for k in range(copies)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = removed([(k, t.encode()) for k, t in rows], 50)
    for r in suffix_dedup.drop_repeats(df).collect():
        assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))] == want[r["doc_id"]]
    slices = spark.conf.get("spark.sql.shuffle.partitions")
    # one range for each text, and a few per window for what slices still ask of each other
    assert made[0].count() < 2 * copies + 900 * int(slices)


def test_merged_ranges():
    rng = np.random.default_rng(2)
    row, start = rng.integers(-(1 << 62), 1 << 62, 5)[rng.integers(0, 5, 300)], rng.integers(0, 900, 300)
    end = start + rng.integers(1, 9, 300)
    points = lambda *r: {(n, k) for n, s, e in zip(*(x.tolist() for x in r)) for k in range(s, e)}
    found = suffix_dedup.merged(row, start, end)
    assert points(*found) == points(row, start, end) and len(found[0]) < 300
    ends = {(n, e) for n, _, e in zip(*(x.tolist() for x in found))}
    assert not any((n, s) in ends for n, s, _ in zip(*(x.tolist() for x in found)))
    assert [len(x) for x in suffix_dedup.merged(*np.zeros((3, 0), np.int64))] == [0, 0, 0]


def test_suffix_dedup_many_buckets(spark, monkeypatch, empty):
    monkeypatch.setattr(suffix_dedup, "MARK_BUCKET_BYTES", 300)
    monkeypatch.setattr(suffix_dedup, "SUFFIX_BUCKET_BYTES", 200)
    monkeypatch.setattr(suffix_dedup, "RUN_WINDOWS", 5)
    rng = random.Random(5)
    parts = ["".join(rng.choice("abcd \n") for _ in range(rng.randint(0, 200))) for _ in range(20)]
    rows = [(k, rng.choice(parts) + rng.choice(parts)[10:] + rng.choice(parts)) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = removed([(k, t.encode()) for k, t in rows], 20)
    for r in suffix_dedup.drop_repeats(df, length=20).collect():
        assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))] == want[r["doc_id"]]
    assert suffix_dedup.drop_repeats(empty).count() == 0


