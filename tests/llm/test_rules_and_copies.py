"""Quality rules, exact copies, near copies."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_tables import pairs

from scrubline.llm import exact_dedup, quality_rules, simhash
from scrubline.llm.common import roots
from scrubline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(5)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
        len(inside),
    )


@pytest.mark.parametrize("table", ["odd", "repeated", "documents"])
def test_rules(request, table):
    df = request.getfixturevalue(table)
    got = Counter(tuple(r)[:7] for r in quality_rules.judge(df).collect())
    want = Counter()
    for k, t in pairs(df):
        f = figures(t)
        want[(k, *f, f[0] < 10 or 100 * f[4] > 20 * f[0])] += 1
    assert got == want


def test_rules_order_and_filter(odd, empty):
    measured = quality_rules.measure_rules(odd)
    assert [m["gain"] for m in measured] == sorted((m["gain"] for m in measured), reverse=True)
    assert {m["rule"] for m in measured} == set(quality_rules.RULES)
    kept = {r["doc_id"] for r in quality_rules.judge(odd).filter("kept").collect()}
    rows = quality_rules.keep_good(odd)
    assert rows.columns == odd.columns
    assert {r["doc_id"] for r in rows.collect()} == kept
    assert quality_rules.keep_good(empty).count() == 0 and quality_rules.judge(empty).count() == 0
    backwards = quality_rules.RULES[::-1]
    assert {r["doc_id"] for r in quality_rules.keep_good(odd, rules=backwards).collect()} == kept


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("upto", [None, -1, 10**6, 50])
def test_exact_groups(odd, upto):
    groups = defaultdict(list)
    for k, t in pairs(odd):
        groups[normal(t)].append(k)
    want = {
        (k, min(ks), len(ks), k == min(ks), hashlib.sha256(t.encode()).hexdigest())
        for t, ks in groups.items()
        for k in ks
    }
    got = exact_dedup.exact_groups(odd, history_upto=upto).drop("historical").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(pairs(odd))


def test_exact_rows(odd, repeated, empty):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    firsts = {}
    for k, t in pairs(odd):
        firsts[normal(t)] = min(k, firsts.get(normal(t), k))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(firsts.values())
    got = pairs(exact_dedup.drop_copies(repeated))
    assert len(got) == len({normal(t) for _, t in pairs(repeated)}) == len({normal(t) for _, t in got})
    groups = exact_dedup.exact_groups(repeated).collect()
    assert len(groups) == repeated.count() and sum(r["kept"] for r in groups) == len(got)
    assert exact_dedup.drop_copies(empty).count() == 0 and exact_dedup.exact_groups(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 20_000])
def test_perfect_hash(n):
    digests = np.random.default_rng(n).integers(0, 256, (n, 32), dtype=np.uint8)
    index = exact_dedup.PerfectHash.build(digests)
    assert sorted(index.slots(digests).tolist()) == list(range(n))
    other = np.random.default_rng(n + 1).integers(0, 256, (50, 32), dtype=np.uint8)
    slot = index.slots(other)
    assert ((slot >= -1) & (slot < max(n, 1))).all()


def fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints: dict[int, int], radius: int) -> dict[int, int]:
    """The least key reachable, by flooding."""
    out: dict[int, int] = {}
    for k in sorted(prints):
        if k in out:
            continue
        stack = [k]
        out[k] = k
        while stack:
            a = stack.pop()
            for b in prints:
                if b not in out and (prints[a] ^ prints[b]).bit_count() <= radius:
                    out[b] = k
                    stack.append(b)
    return out


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_near_groups(request, table):
    df = request.getfixturevalue(table)
    prints = {k: fingerprint(t) for k, t in pairs(df)}
    want = classes(prints, 2)
    got = simhash.near_groups(df).collect()
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("radius, bucket_rows", [(0, 1), (1, 1), (2, simhash.BUCKET_ROWS), (2, 1), (2, 8), (5, 2)])
def test_links_of_close_fingerprints(spark, radius, bucket_rows):
    """Also with buckets dealt out again as soon as they have company."""
    rng = np.random.default_rng(radius)
    values = set()
    for _ in range(40):  # clusters and chains
        v = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(int(rng.integers(1, 25))):
            values.add(v)
            for _ in range(int(rng.integers(0, radius + 2))):
                v ^= 1 << int(rng.integers(0, 64))
    prints = {v: v for v in values}
    want = classes(prints, radius)
    df = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long").repartition(4)
    got = {r["node"] % 2**64: r["root"] % 2**64 for r in components(simhash.links(df, radius, bucket_rows)).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert {g for g in groups(want) if len(g) > 1} == groups(got)


def test_finer_buckets_are_bounded():
    for mask in simhash.block_masks(2):
        for finer in simhash.finer_masks(mask, 2):
            assert finer & mask == mask and 64 - finer.bit_count() <= 14


def test_hot_bucket():
    """All fingerprints in one bucket, more than a word of lanes."""
    rng = np.random.default_rng(3)
    values = np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    found = simhash.spanning_links(np.zeros(500, np.int64), values[:, None], 2)
    assert len(found) == 499 and (roots(500, found[:, 0], found[:, 1]) == 0).all()
    assert len(simhash.spanning_links(np.arange(500), values[:, None], 2)) == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)} | {300: 200, 200: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_rows_and_nulls(repeated, empty):
    got = simhash.near_groups(repeated).collect()
    assert len(got) == repeated.count()
    by_print = defaultdict(set)
    for r in got:
        by_print[r["fp"]].add(r["component_id"])
    assert all(len(v) == 1 for v in by_print.values())
    assert simhash.near_groups(empty).count() == 0


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (WORD.findall(a), WORD.findall(b)))
    return len(a & b) / len(a | b)


def test_similar_texts(spark, empty):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base[:20]):  # 1 to 4 words changed: 0.87 to 0.97 similar
        for c in range(3):
            words = t.split()
            for at in rng.choice(300, 1 + c, replace=False):
                words[at] = f"new{k}_{c}"
            rows.append((1000 + 10 * k + c, " ".join(words)))
    assert all(jaccard(base[(k - 1000) // 10], t) > 0.85 for k, t in rows if k >= 1000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in simhash.drop_similar(df).collect()}
    assert set(range(40)) <= kept  # unrelated texts stay
    assert len(kept - set(range(40))) <= 1  # similar ones go
    assert simhash.drop_similar(empty).count() == 0
    assert simhash.drop_similar(empty).columns == empty.columns


def test_similarity_is_that_of_the_sets(spark):
    """Pairs from 0.70 to 0.85, against brute force over the shingle sets."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(150):
        words = [f"w{x}" for x in rng.integers(0, 100_000, 240)]
        rows.append((2 * k, " ".join(words)))
        for at in np.linspace(3, 230, int(rng.integers(4, 10))).astype(int):
            words[at] = "new"
        rows.append((2 * k + 1, " ".join(words)))
    rows += [(1000, "a b c d e " + "x " * 300), (1001, "f g h i j " + "x " * 300)]  # much the same words, few shingles
    alike = {k: jaccard(rows[2 * k][1], rows[2 * k + 1][1]) for k in range(151)}
    assert sum(0.7 < x < 0.8 for x in alike.values()) > 20 < sum(0.8 <= x < 0.85 for x in alike.values())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in simhash.drop_similar(df).collect()}
    want = {r[0] for r in rows} - {rows[2 * k + 1][0] for k, x in alike.items() if x >= 0.8}
    assert kept == want


def test_checked_pairs_join_what_similar_pairs_join():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 10**6, 60).astype(np.uint64))]
    for _ in range(120):  # each from some one before: chains and branches
        x = sets[int(rng.integers(len(sets)))].copy()
        x[rng.integers(0, len(x), int(rng.integers(1, 12)))] = rng.integers(0, 10**6, 1).astype(np.uint64)
        sets.append(np.unique(x))
    bits = np.zeros((len(sets), 8), np.uint64)
    near = np.array([(i, j) for i in range(121) for j in range(i) if len({*sets[i].tolist()} & {*sets[j].tolist()})
                     >= 0.8 * len({*sets[i].tolist()} | {*sets[j].tolist()})])
    got = np.array(simhash.checked_pairs(bits, sets, 512, 0.8))
    assert (roots(121, got[:, 0], got[:, 1]) == roots(121, near[:, 0], near[:, 1])).all()
    assert 1 < len(np.unique(roots(121, got[:, 0], got[:, 1]))) < 121


def test_large_groups_of_similar_texts_are_sliced(spark, monkeypatch):
    """Near copies of a few templates that share most shingles, in one bucket and group: never in one task."""
    monkeypatch.setattr(simhash, "SLICE_ROWS", 16, raising=False)
    monkeypatch.setattr(simhash, "REPRESENTATIVES", 2, raising=False)
    met = []
    checked = simhash.checked
    monkeypatch.setattr(simhash, "checked", lambda m, *a: met.append(m.groupBy("key").count().agg({"count": "max"}).first()[0]) or checked(m, *a), raising=False)
    rng = np.random.default_rng(11)
    shared = [f"s{k}" for k in range(200)]
    rows = []
    for family in range(5):  # 0.66 similar to one another
        own = shared + [f"f{family}_{k}" for k in range(45)]
        for c in range([120, 60, 3, 3, 2][family]):
            words = own.copy()
            for at in rng.choice(245, int(rng.integers(0, 4)), replace=False):
                words[at] = f"x{family}_{c}_{at}"
            rows.append((len(rows), " ".join(words)))
    texts = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    near = np.array([(i, j) for i in range(len(rows)) for j in range(i) if len(texts[i] & texts[j]) >= 0.8 * len(texts[i] | texts[j])])
    root = roots(len(rows), near[:, 0], near[:, 1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in simhash.drop_similar(df).collect()}
    assert kept == set(root.tolist())
    assert len(met) == 2 and max(met) < 90
