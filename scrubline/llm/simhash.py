"""Near-duplicates by SimHash, compared bit-sliced.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values
have it set. Fingerprints that differ in at most ``radius`` bits are linked;
classes are the connected components of these links.

Candidates: the 64 bits are cut into ``radius + 3`` blocks. Two fingerprints
within the radius differ in at most ``radius`` blocks, so they agree in some three
of them; each fingerprint goes to one bucket for every three blocks. Rows of
one bucket meet in sorted order in one task. There the fingerprints are stored
bit-sliced: plane k holds bit k of 64 fingerprints in one word. For one
fingerprint against a word of 64, the mismatches of all 64 lanes are added up by
carry-save counters (ones, twos, over), and a word is given up as soon as all its
lanes are beyond the radius. A bucket yields a spanning set of links, not its
pairs.

Equal fingerprints are one row before they are compared, so a text that a third of
all rows share costs one row. A bucket of more than ``BUCKET_ROWS`` fingerprints, as near
copies make it, is dealt out again: its members differ only in the other blocks, which are cut
into ``radius + 2`` parts, and those within the radius agree in some two of them. What agrees in
three blocks and two parts has few bits left to differ in (at most 14 at radius 2), so the
fingerprints of such a bucket are bounded (16,384) at any size of the table.

Defined results: a null text is empty; a text without words has fingerprint zero
and is linked like any other; one of fewer words than a shingle is one shingle; a
null key is no class id, but its row has a class; repeated rows get the same
class; an empty table gives an empty table; other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import record, roots, slices, written
from scrubline.llm.components import components

SEED = 42

#: Bits of the fingerprints that tell a similarity, and the bands of least values that buckets come from.
WIDE_BITS, BANDS, BAND_ROWS = 512, 20, 4

#: Standard deviations by which the fingerprints of similar texts may be further apart than expected.
DEVIATIONS = 5

#: Fingerprints of a bucket beyond which it is dealt out by finer keys.
BUCKET_ROWS = 8_192

#: Similar texts: rows and bytes of text of a group beyond which it is dealt out in slices, and about how many
#: of its rows are in each slice besides.
SLICE_ROWS, SLICE_TEXT, REPRESENTATIVES = 2_048, 32_000_000, 16

#: Words of 64 lanes that are compared at once.
PAIRS_AT_ONCE = 1 << 18

#: Bit planes between two looks at which words can be given up.
ABANDON_EVERY = 8


def shingle_hashes(data: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words; of all words if they are fewer."""
    words = data.lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :])], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that over half of the rows have set; rows are of one or more 64-bit words."""
    rows = np.ascontiguousarray(hashes, "<u8").reshape(len(hashes), -1).view(np.uint8)
    counts = np.zeros(8 * rows.shape[1], np.int64)
    for at in range(0, len(rows), 255):  # sums of up to 255 bits fit a byte
        counts += np.unpackbits(rows[at : at + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(rows), bitorder="little").view("<u8")


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """The 64 bits of a text; zero if it has no words."""
    hashes = shingle_hashes(data, shingle)
    return int(majority(hashes)[0]) if len(hashes) else 0


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of ``df``: key and fp, the 64 bits as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                values = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                yield record(key=part.column(0), fp=values)

    kind = dict(df.dtypes)[key]
    return (
        df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        .mapInArrow(work, f"key {kind}, fp long")
        .withColumnRenamed("key", key)
    )


def _agreeing(bits: list[int], blocks: int, some: int) -> list[int]:
    """Cut bit numbers into blocks; for every choice of ``some`` of them, the mask of their bits."""
    edges = [len(bits) * k // blocks for k in range(blocks + 1)]
    masks = [sum(1 << b for b in bits[edges[k] : edges[k + 1]]) for k in range(blocks)]
    return [sum(chosen) for chosen in combinations(masks, some)]


def block_masks(radius: int) -> list[int]:
    """For every choice of three blocks, the mask of their bits."""
    return _agreeing(list(range(64)), radius + 3, 3)


def finer_masks(mask: int, radius: int) -> list[int]:
    """The masks that deal out what agrees in ``mask``: two parts of the other bits besides."""
    rest = [b for b in range(64) if not mask >> b & 1]
    return [mask | part for part in _agreeing(rest, radius + 2, 2)]


def close_pairs(values: np.ndarray, last: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Pairs (i, j), i < j < last[i], of fingerprints within the radius, found bit-sliced.

    ``values`` has one row per fingerprint, of one or more 64-bit words; ``last[i]`` is
    the end of i's bucket. Yields (n, 2) arrays.
    """
    n, bits = len(values), 64 * values.shape[1]
    padded = np.zeros((-(-n // 64) * 64, values.shape[1]), "<u8")
    padded[:n] = values
    planes = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little").T  # (bits, lanes)
    planes = np.ascontiguousarray(np.packbits(planes, axis=1, bitorder="little")).view("<u8")  # (bits, words of 64 lanes)
    words = (last - 1) // 64 - np.arange(n) // 64 + 1  # from i's own word to its bucket's last
    words[last - np.arange(n) < 2] = 0
    ends = np.cumsum(words)
    counter_bits = max(1, int(radius).bit_length())
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
        some = words[start:stop]
        query = np.repeat(np.arange(start, stop), some)
        word = query // 64 + np.arange(len(query)) - np.repeat(np.cumsum(some) - some, some)
        counters = [np.zeros(len(query), np.uint64) for _ in range(counter_bits)]
        over = np.zeros(len(query), np.uint64)
        for k in range(bits):
            if not len(query):
                break
            own = (values[query, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            carry = planes[k][word] ^ (np.uint64(0) - own)
            for c in range(counter_bits):
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
            over |= carry
            if k % ABANDON_EVERY == ABANDON_EVERY - 1:
                alive = (over | _beyond(counters, radius)) != ~np.uint64(0)
                if not alive.all():
                    query, word, over = query[alive], word[alive], over[alive]
                    counters = [c[alive] for c in counters]
        if len(query):
            near = ~(over | _beyond(counters, radius))
            hit = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(hit)
            i, j = query[row], word[row] * 64 + lane
            good = (j > i) & (j < last[i])
            yield np.stack([i[good], j[good]], axis=1)
        start = stop


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """The lanes whose counter is above the radius, compared bit by bit from the top."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def spanning_links(keys: np.ndarray, values: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of rows that join what is within the radius in each bucket; keys are sorted."""
    n = len(keys)
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    size = np.diff(edge)
    last, many = np.repeat(edge[1:], size), np.repeat(size > 1, size)
    at = np.flatnonzero(many)
    tree = np.zeros((0, 2), np.int64)
    if not len(at):
        return tree
    place = np.cumsum(many) - 1  # among the rows that have company
    for pairs in close_pairs(values[at], place[last[at] - 1] + 1, radius):
        both = np.concatenate([tree, pairs])
        root = roots(len(at), both[:, 0], both[:, 1])
        moved = np.flatnonzero(root != np.arange(len(at)))
        tree = np.stack([moved, root[moved]], axis=1)
    return at[tree]


def compared(dealt: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between rows (node, key, bits) of one bucket: a spanning set of those within the radius.

    ``bits`` is the fingerprint, a multiple of eight bytes. Rows are sorted by bucket,
    and a task holds one Arrow batch and one bucket at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []  # rows of the last bucket, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(batch.num_rows, -1)
            rest.append([batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits])
            if rest[0][1][0] != rest[-1][1][-1]:
                rows = [np.concatenate(x) for x in zip(*rest)]
                cut = int(np.searchsorted(rows[1], rows[1][-1]))
                rest = [[x[cut:] for x in rows]]
                yield linked(*[x[:cut] for x in rows])
        if rest:
            yield linked(*[np.concatenate(x) for x in zip(*rest)])

    def linked(node: np.ndarray, key: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        found = spanning_links(key, bits, radius)
        return record(a=node[found[:, 0]], b=node[found[:, 1]])

    return (
        dealt.select("node", "key", "bits")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(work, "a long, b long")
    )


def links(distinct: DataFrame, radius: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between the fingerprints (fp) that give the same components as all links.

    Buckets of more than ``bucket_rows`` are found by counting and dealt out by finer keys.
    """
    fp = F.col("fp")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    bucket = lambda m, *tag: F.xxhash64(*map(F.lit, tag), fp.bitwiseAND(F.lit(signed(m))))
    masks = block_masks(radius)
    coarse = F.array(*[F.struct(F.lit(k).alias("k"), bucket(m, k).alias("key")) for k, m in enumerate(masks)])
    dealt = distinct.select("fp", F.inline(coarse))
    full = dealt.groupBy("key").count().filter(F.col("count") > bucket_rows).select("key", F.lit(True).alias("full"))
    finer = F.array(
        *[F.array(*[bucket(f, k, j) for j, f in enumerate(finer_masks(m, radius))]) for k, m in enumerate(masks)]
    )
    keys = F.when(F.col("full"), F.get(finer, F.col("k"))).otherwise(F.array("key"))
    little = F.unhex(F.concat(*[F.substring(F.lpad(F.hex("fp"), 16, "0"), k, 2) for k in range(15, 0, -2)]))
    buckets = dealt.join(full, "key", "left").select(
        fp.alias("node"), little.alias("bits"), F.explode(keys).alias("key")
    )
    return compared(buckets, radius)


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``df``: key, fp, and component_id, the smallest key reachable over links."""
    prints = written(fingerprints(df, key, text, shingle), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(key).alias("least")), "distinct-fingerprints")
    root = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    classes = nodes.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(key, "fp", "component_id")


# -- similar texts --------------------------------------------------------------------


def similarity_radius(similarity: float) -> int:
    """How many of the WIDE_BITS bits differ, at most, between texts of that Jaccard similarity.

    The angle between two shingle sets of similarity s has cosine 2s / (1 + s); each bit
    differs with probability angle / pi. ``DEVIATIONS`` standard deviations are added: this only
    leaves out pairs that need not be checked.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(WIDE_BITS * share + DEVIATIONS * math.sqrt(WIDE_BITS * share * (1 - share)))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


#: Odd factors; each gives another order of the shingles.
_FACTORS = np.array([_mixed(np.zeros(1, np.uint64), k)[0] | np.uint64(1) for k in range(BANDS * BAND_ROWS)], np.uint64)


def shingle_set(data: bytes, shingle: int) -> np.ndarray:
    """The distinct shingle hashes in order; a text without words has one, zero."""
    hashes = np.unique(shingle_hashes(data, shingle))
    return hashes if len(hashes) else np.zeros(1, np.uint64)


def sketch(data: bytes, shingle: int) -> tuple[int, bytes, list[int]]:
    """The hash of a text's shingle set, its wide fingerprint, and its bucket keys: bands of least shingle values."""
    hashes = shingle_set(data, shingle)
    bits = majority(np.stack([_mixed(hashes, k) for k in range(WIDE_BITS // 64)], axis=1))
    least = (hashes[:, None] * _FACTORS).min(axis=0).reshape(BANDS, BAND_ROWS)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least)]
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63), bits.tobytes(), keys


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two shingle sets, in order, have at least that Jaccard similarity."""
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    common = int(np.count_nonzero(a[at] == b))
    return common / (len(a) + len(b) - common) >= similarity


def checked_pairs(
    bits: np.ndarray,
    sets: list[np.ndarray],
    radius: int,
    similarity: float,
    label: np.ndarray | None = None,
    asks: np.ndarray | None = None,
) -> list[tuple[int, int]]:
    """Similar pairs that join all rows that similar pairs join.

    Every pair is compared by its shingle sets, unless other pairs have joined it
    already, or its sizes or fingerprints show that it is not similar. Rows of equal ``label`` count
    as joined; with ``asks``, pairs are of a row that asks and one that does not.
    """
    label, found = np.arange(len(sets)) if label is None else label.copy(), []
    size = np.array([len(x) for x in sets], np.int64)
    for i in range(len(sets) - 1) if asks is None else np.flatnonzero(asks).tolist():
        other = label != label[i]
        if asks is None:
            other[:i] = False
        else:
            other &= ~asks
        at = np.flatnonzero(other)
        at = at[np.minimum(size[at], size[i]) / np.maximum(size[at], size[i]) >= similarity]
        at = at[np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1) <= radius]
        for j in at.tolist():
            if label[j] != label[i] and similar(sets[i], sets[j], similarity):
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


def checked(members: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) that join the similar rows of each group.

    ``members`` are rows (key, node, bits, label, asks, text); ``asks`` is null where all pairs of a group count.
    """
    radius = similarity_radius(similarity)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = [], None
        for batch in batches:
            for part, texts in slices(batch, 5):
                a, b = [], []
                for k, *row, t in zip(*(part.column(c).to_pylist() for c in range(5)), texts):
                    if k != key:
                        joined(group, a, b)
                        group, key = [], k
                    group.append((*row, shingle_set(t, shingle)))
                yield record(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))
        a, b = [], []
        joined(group, a, b)
        yield record(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

    def joined(group: list, a: list[int], b: list[int]) -> None:
        if len(group) > 1:
            node, bits, label, asks, sets = zip(*group)
            bits = np.frombuffer(b"".join(bits), "<u8").reshape(len(node), -1)
            asks = None if asks[0] is None else np.array(asks)
            for i, j in checked_pairs(bits, sets, radius, similarity, np.array(label), asks):
                a.append(node[i])
                b.append(node[j])

    return (
        members.select("key", "node", "bits", "label", "asks", "text")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(work, "a long, b long")
    )


def candidate_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect whatever may be similar; ``nodes`` are rows (node, bits, keys).

    A bucket of more than ``SLICE_ROWS`` is not compared, but linked whole: its rows are then checked in slices.
    """
    dealt = nodes.select("node", "bits", F.explode("keys").alias("key"))
    full = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub"))
    dealt = dealt.join(full.filter(F.col("n") > SLICE_ROWS).drop("n"), "key", "left")
    whole = dealt.filter("hub is not null and hub != node").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return compared(dealt.filter("hub is null"), radius).union(whole)


def _parts() -> Column:
    rows, size = F.count("*") / SLICE_ROWS, F.sum("bytes") / SLICE_TEXT
    return F.ceil(F.greatest(rows, size, F.lit(1))).cast("int")


def full_groups(candidates: DataFrame) -> DataFrame:
    """(root, n, parts) of the groups that are dealt out; there are at most rows / SLICE_ROWS, or by text size."""
    return candidates.groupBy("root").agg(F.count("*").alias("n"), _parts().alias("parts")).filter("parts > 1")


def _part(tag: int, parts: str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(tag)), F.col(parts)).cast("int")


def first_round(candidates: DataFrame, full: DataFrame) -> DataFrame:
    """``candidates`` with ``to`` [(key, asks)]: a group, or a slice of a full one; some rows are in all slices."""
    everywhere = F.pmod(F.xxhash64("node", F.lit(2)), "n") < REPRESENTATIVES
    some = F.when(everywhere, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(_part(1, "parts")))
    place = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(some)
    to = F.transform(place, lambda k: F.struct(F.xxhash64("root", k).alias("key"), F.lit(None).cast("boolean").alias("asks")))
    return candidates.join(F.broadcast(full), "root", "left").withColumns({"to": to, "label": F.col("node")})


def second_round(candidates: DataFrame, full: DataFrame, label: DataFrame) -> DataFrame:
    """Rows of full groups with ``to`` [(key, asks)], where what is not connected yet meets.

    ``label`` (node, root) is what the first round connected. In each group, most rows have one label; the
    others are cut into chunks, and each chunk meets each slice of the group.
    """
    label = label.withColumnRenamed("root", "label")
    rows = candidates.join(F.broadcast(full), "root").join(label, "node", "left")
    rows = written(rows.withColumn("label", F.coalesce("label", "node")), "full-groups")
    labels = rows.groupBy("root", "label").agg(F.count("*").alias("many"))
    main = labels.groupBy("root").agg(F.max_by("label", F.struct("many", "label")).alias("main"))
    rows = rows.join(F.broadcast(main), "root")
    apart = F.col("label") != F.col("main")
    chunks = rows.filter(apart).groupBy("root").agg(_parts().alias("chunks"))
    key = lambda s, c, asks: F.struct(F.xxhash64("root", s, c).alias("key"), F.lit(asks).alias("asks"))
    met = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: key(_part(1, "parts"), c, False))
    asking = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda s: key(s, _part(3, "chunks"), True))
    to = F.when(apart, F.concat(met, asking)).otherwise(met)
    return rows.join(F.broadcast(chunks), "root").withColumn("to", to)


def _similar_rows(rows: DataFrame, key: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """(_row, key, component_id) of the rows, numbered by ``_row``, that are similar to another one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 2):
                nodes, bits, keys = zip(*(sketch(t, shingle) for t in texts))
                size = np.array([len(t) for t in texts], np.int64)
                yield record(
                    row=part.column(0), key=part.column(1), node=pa.array(nodes, pa.int64()),
                    bits=pa.array(bits, pa.binary()), keys=pa.array(keys, pa.list_(pa.int64())), bytes=size,
                )

    rows = rows.select(
        F.col("_row").alias("row"), F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")
    ).filter("key is not null")
    sketches = rows.mapInArrow(work, "row long, key long, node long, bits binary, keys array<long>, bytes long")
    sketches = written(sketches, "sketches")
    same = [F.first(c).alias(c) for c in ("bits", "keys")]
    nodes = sketches.groupBy("node").agg(*same, F.min(F.struct("row", "bytes")).alias("of")).select("*", "of.*")
    group = components(candidate_links(nodes, similarity_radius(similarity)))
    candidates = written(nodes.drop("keys", "of").join(group, "node"), "candidates")
    full = full_groups(candidates)

    def links_of(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("row", "node", "bits", "label", "to").hint("shuffle_hash")
        members = rows.select("row", "text").join(dealt, "row").select("*", F.inline("to"))
        return written(checked(members, shingle, similarity), "checked-links")

    found = links_of(first_round(candidates, full))
    root = components(found)
    if not full.isEmpty():
        root = components(found.union(links_of(second_round(candidates, full, root))))
    classes = sketches.groupBy("node").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    classes = classes.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n")).filter("n > 1")
    classes = classes.select("node", "root").join(least.drop("n"), "root")
    return sketches.select(F.col("row").alias("_row"), "key", "node").join(classes, "node").drop("node", "root")


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with a number ``_row`` for each row, written once."""
    return written(df.withColumn("_row", F.monotonically_increasing_id()), "rows")


def similar_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """(key, component_id) of the rows that are similar to another one, or reach it over similar ones.

    Two texts are similar if their sets of shingles, of words as in ``near_groups``, have at
    least that Jaccard similarity. Candidates share a band of least shingle values, which texts
    of the similarity do all but surely (all but 3 of 100,000 pairs right at 0.8), and their
    fingerprints are not too far apart, compared bit-sliced as above. What candidates connect meets
    in one group, where links are checked by the shingle sets themselves.

    No task holds a group of any size. A bucket or group that is too large is dealt out in slices, which share
    some rows: what near copies connect is one component then. Rows outside the largest component of
    their group meet all slices once more, one chunk of them and one slice in a task.
    Equal sets are one row before that. Rows with a null key are left out.
    """
    found = _similar_rows(_numbered(df.select(key, text)), key, text, shingle, similarity)
    return found.select(F.col("key").alias(key), "component_id")


def drop_similar(
    df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``df`` with one row of each class of similar texts: that of the smallest key, all columns as they are."""
    rows = _numbered(df)
    drop = _similar_rows(rows, key, text, shingle, similarity).filter(F.col("key") > F.col("component_id"))
    return rows.join(drop.select("_row").hint("shuffle_hash"), "_row", "left_anti").select(*df.columns)
