"""Repeated substrings by suffix arrays, sorted in two stages.

A byte goes when a string of ``length`` bytes covers it that also starts in a row of a
smaller key. A suffix array over everything would sort far more than repeats, so the work is
cut down first, without losing a repeat:

1. Every window of ``length`` bytes is marked by the least hash among its 16-byte grams. Equal
   windows have equal marks, and neighbouring windows mostly share one, so a text becomes a few
   runs of windows. Only marks that occur in several rows can hold a repeat. Marks are
   compared in buckets of bounded size; a task first settles what repeats within its own slice and
   then asks once per mark, so a passage that a third of all rows share is asked about once per slice.
2. The runs with such marks are cut out of their texts and dealt by mark; equal runs of a slice
   are settled there. Where the runs of one mark exceed a bucket, as those across the ends of a passage that
   many rows share do, the windows of each run are dealt by their own hashes instead. In each bucket a suffix array is built
   over the distinct runs whose mark also has runs of another least key (of one key's runs no window goes): suffixes
   smaller than their successor are sorted directly, the others are induced from them by scanning
   the buckets of first bytes in order. Adjacent common prefixes of ``length`` bytes group
   equal windows, and each group's least key tells which of the windows go.
3. The covered byte ranges are gathered per row and taken out of its text.

Of equal texts, the one of the least key takes part in this; the others go whole. A text's 64-bit hash
stands for it in the exchanges, as a key would.

Defined results: a null text is empty; rows of equal keys do not count as smaller than each
other; a null key is larger than all others; an empty table gives an empty table; other columns
take no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import record, slices, written

GRAM = 16

#: Text bytes whose windows are hashed together (or one text); with their hashes they stay in a core's cache.
HASHED_BYTES = 1 << 17

#: Windows in one run, at most.
RUN_WINDOWS = 4096

#: Text bytes per bucket of marks, and bytes of runs per bucket of suffixes, about.
MARK_BUCKET_BYTES, SUFFIX_BUCKET_BYTES = 24_000_000, 3_000_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LAST = (1 << 63) - 1  # stands for a null key


# -- runs of windows with one mark ------------------------------------------------------


def words_at(raw: np.ndarray, n: int, kind: str) -> np.ndarray:
    """The eight bytes from each of the first n positions on, as a number; ``raw`` is padded by 8."""
    out = np.empty(n, np.uint64)
    for k in range(8):
        count = len(range(k, n, 8))
        out[k::8] = np.frombuffer(raw.data, kind, count, k)
    return out


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, mark) of each run of windows with the same mark.

    Hashes take several dozen bytes per byte of text, so texts are gone through a few at a time.
    """
    found, first = [], 0
    while first < len(texts):
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) <= HASHED_BYTES:
            size += len(texts[last])
            last += 1
        text, *rest = _runs(texts[first:last], length)
        found.append((text + first, *rest))
        first = last
    return tuple(np.concatenate(c) for c in zip(*found)) if found else _runs([], length)


def _runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum())
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    raw = np.frombuffer(b"".join(texts) + bytes(GRAM + 8), np.uint8)
    eight = words_at(raw, n + 8, "<u8")
    mark = (eight[:n] * _A) ^ ((eight[8 : n + 8] + _C) * _B)
    mark = (mark ^ (mark >> np.uint64(31))) * _C
    mark ^= mark >> np.uint64(32)
    width, grams = 1, length - GRAM + 1
    while width < grams:
        step = min(width, grams - width)
        mark = np.minimum(mark[:-step], mark[step:])
        width += step
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(mark)]
    inside = np.arange(len(mark)) + length <= ends[text]
    at = np.flatnonzero(inside)
    mark, text = mark[at], text[at]
    new = np.r_[True, (mark[1:] != mark[:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    if len(count) and count.max() > RUN_WINDOWS:
        parts = -(-count // RUN_WINDOWS)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, left = np.repeat(first, parts) + nth * RUN_WINDOWS, np.repeat(count, parts) - nth * RUN_WINDOWS
        count = np.minimum(left, RUN_WINDOWS)
    start = at[first] - (ends - sizes)[text[first]]
    return text[first], start, count, mark[first]


def _bucket(mark: np.ndarray, n: int) -> np.ndarray:
    return ((mark * _A) >> np.uint64(20)).astype(np.int64) % n


def _dealt(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of the entries of each bucket."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1)) if n < len(bucket) else None
    if edges is None:
        for b in np.unique(bucket).tolist():
            yield b, np.flatnonzero(bucket == b)
        return
    for b in range(n):
        if edges[b] < edges[b + 1]:
            yield b, order[edges[b] : edges[b + 1]]


_ASKED = "bucket long, marks binary, many binary, rows binary, starts binary, counts binary"


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same byte ranges with those of a row joined where they touch or overlap."""
    if not len(row):
        return row, start, end
    by = np.lexsort((start, row))
    row, start, end = row[by], start[by], end[by]
    _, text = np.unique(row, return_inverse=True)
    shift = text * (int(end.max()) + 2)  # rows lie apart on one line, so one running maximum serves all
    reach = np.maximum.accumulate(end + shift)
    first = np.flatnonzero(np.r_[True, start[1:] + shift[1:] > reach[:-1]])
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], reach[last] - shift[last]


def text_id(data: bytes) -> int:
    """What Spark's xxhash64 gives for the text, unsigned."""
    return xxhash.xxh64_intdigest(data, 42)


def _ask(rows: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Runs (row, mark, start, count) whose mark occurs in several distinct texts.

    ``rows`` has a text column; ``row`` is the text's id, so equal texts are one, and a run may be told of
    more than once.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, 0):
                texts = list(dict.fromkeys(texts))
                text, start, count, mark = runs(texts, length)
                if not len(mark):
                    continue
                row = np.array([text_id(t) for t in texts], np.uint64).view(np.int64)[text]
                order = np.argsort(mark, kind="stable")
                mark, row, start, count = mark[order], row[order], start[order], count[order]
                edge = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
                size = np.diff(np.append(edge, len(mark)))
                several = np.maximum.reduceat(row, edge) != np.minimum.reduceat(row, edge)
                # every run of a mark of one row asks; of a mark of several rows, one entry says so
                settled = np.repeat(several, size)
                asks = ~settled
                asks[edge[several]] = True
                many = settled & asks
                found = np.flatnonzero(settled)
                for k, chosen in enumerate(np.array_split(found, 1 + len(found) // 50_000)):
                    yield _entries(-1 - k, mark, many, row, start, count, chosen)
                places = np.flatnonzero(asks)
                for b, some in _dealt(_bucket(mark[places], n_buckets), n_buckets):
                    yield _entries(b, mark, many, row, start, count, places[some])

    def _entries(bucket, mark, many, row, start, count, some) -> pa.RecordBatch:
        return record(
            bucket=[bucket], marks=[mark[some].tobytes()], many=[np.packbits(many[some]).tobytes()],
            rows=[row[some].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()],  # high bytes compress
            starts=[start[some].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()],
            counts=[count[some].astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()],
        )

    def planes(parts: list[bytes], kind: str) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.concatenate(
            [np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(size, -1).T).view(kind).ravel() for p in parts]
        )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, group in _by_bucket(batches):
            mark = np.concatenate([np.frombuffer(r["marks"], np.uint64) for r in group])
            row, start, count = (
                planes([r[c] for r in group], kind) for c, kind in (("rows", "<i8"), ("starts", "<u4"), ("counts", "<u2"))
            )
            chosen = np.ones(len(mark), bool)
            if bucket >= 0:
                many = np.concatenate(
                    [np.unpackbits(np.frombuffer(r["many"], np.uint8))[: len(r["marks"]) // 8] for r in group]
                ).astype(bool)
                order = np.argsort(mark, kind="stable")
                mark, row, start, count, many = mark[order], row[order], start[order], count[order], many[order]
                edge = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
                size = np.diff(np.append(edge, len(mark)))
                several = np.maximum.reduceat(row, edge) != np.minimum.reduceat(row, edge)
                several |= np.logical_or.reduceat(many, edge)
                chosen = np.repeat(several, size) & ~many
            yield record(
                row=row[chosen], mark=mark[chosen].view(np.int64), start=start[chosen].astype(np.int32),
                count=count[chosen].astype(np.int32),
            )

    asked = rows.mapInArrow(ask, _ASKED)
    spread = F.when(F.col("bucket") < 0, F.xxhash64("rows")).otherwise(F.col("bucket"))
    return (
        asked.withColumn("to", spread)
        .repartition("to")
        .drop("to")
        .sortWithinPartitions("bucket")
        .mapInArrow(answer, "row long, mark long, start int, count int")
    )


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each bucket; they come sorted by bucket. Rows of a negative bucket come one by one."""
    held: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            r = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
            if held and held[0]["bucket"] != r["bucket"]:
                yield held[0]["bucket"], held
                held = []
            if r["bucket"] < 0:
                yield r["bucket"], [r]
            else:
                held.append(r)
    if held:
        yield held[0]["bucket"], held


# -- suffix arrays ----------------------------------------------------------------------


def suffix_array(raw: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of ``raw`` in order of their first ``depth`` bytes at least, sorted in two stages.

    With ``wanted``, a mask, only these suffixes and what their order is found from: after each of them, up to the
    next suffix that is smaller than its successor.

    Stage one sorts the suffixes that are smaller than their successor. Stage two goes through the
    buckets of first bytes in order: each suffix met puts the one before it, if that one is larger than
    its successor, at the end of the front part of its own bucket.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(np.r_[raw[1:] != raw[:-1], True])  # last place of each run of one byte
    follows = np.append(raw[1:], 0)
    smaller = np.repeat(raw[change] < follows[change], np.diff(np.r_[-1, change]))
    smaller[change[-1] - (change[-1] - (change[-2] if len(change) > 1 else -1)) + 1 :] = False  # the last run: the end is less
    needed = np.ones(n, bool) if wanted is None else _through(wanted, smaller)
    direct = _sorted_directly(raw, np.flatnonzero(smaller & needed), depth)
    induced = needed & ~smaller
    bounds = np.searchsorted(raw[direct], np.arange(257))
    front: list[list[np.ndarray]] = [[] for _ in range(256)]
    if induced[n - 1]:
        front[raw[n - 1]].append(np.array([n - 1]))  # its successor is the empty suffix
    out = []
    for c in range(256):
        wave = np.concatenate(front[c]) if front[c] else np.zeros(0, np.int64)
        here = []
        while len(wave):  # runs of the byte itself
            here.append(wave)
            before = wave[wave > 0] - 1
            before = before[raw[before] == c]
            wave = before[induced[before]]
        here.append(direct[bounds[c] : bounds[c + 1]])
        met = np.concatenate(here)
        out.append(met)
        before = met[met > 0] - 1
        before = before[(raw[before] > c) & induced[before]]
        byte = raw[before]
        order = np.argsort(byte, kind="stable")
        byte, before = byte[order], before[order]
        edges = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]]) if len(byte) else np.zeros(0, np.int64)
        for s, e in zip(edges, np.append(edges[1:], len(byte))):
            front[byte[s]].append(before[s:e])
    return np.concatenate(out)


def _through(wanted: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The wanted places, and those after each up to the next stop, which is one of them."""
    first = np.flatnonzero(np.r_[True, stop[:-1]])  # of the stretches that end at a stop
    so_far = np.cumsum(wanted)
    return so_far > np.repeat(so_far[first] - wanted[first], np.diff(np.append(first, len(wanted))))


def _padded(raw: np.ndarray, depth: int) -> np.ndarray:
    return np.concatenate([raw, np.zeros(depth + 16, np.uint8)])


def _sorted_directly(raw: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the ``depth`` bytes from them on, at most eight at a time; only ties are looked at again."""
    words = words_at(_padded(raw, depth), len(raw) + depth, ">u8")
    order = np.argsort(words[at])
    at = at[order]
    todo, key, skip = np.arange(len(at)), words[at], 8
    while skip < depth and len(todo):
        new = np.r_[True, key[1:] != key[:-1]]
        tied = ~(new & np.append(new[1:], True))
        todo, group = todo[tied], (np.cumsum(new[tied]) - 1).astype(np.uint64)
        if not len(todo):
            break
        # ties' numbers and the bytes that fit beside them are sorted as one number
        taken = min(7, (64 - int(group[-1]).bit_length()) // 8)
        key = words[at[todo] + skip] >> np.uint64(64 - 8 * taken) | group << np.uint64(8 * taken)
        order = np.argsort(key)
        at[todo], key = at[todo][order], key[order]
        skip += taken
    return at


def common_prefixes(raw: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order, how many bytes it shares with the one before, up to ``depth``."""
    words = words_at(_padded(raw, depth), len(raw) + depth, ">u8")
    shared = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for skip in range(0, depth, 8):
        if not len(alive):
            break
        differ = words[order[alive] + skip] ^ words[order[alive - 1] + skip]
        some = differ != 0
        high = np.frexp(differ[some].astype(np.float64))[1]  # bits; rounding up is harmless but at a byte's edge
        high = np.where(differ[some] >> np.minimum(high - 1, 63).astype(np.uint64) == 0, high - 1, high)
        shared[alive[some]] += (64 - high) // 8
        shared[alive[~some]] += 8
        alive = alive[~some]
    return np.minimum(shared, depth)


# -- covered ranges ---------------------------------------------------------------------


def covered(contexts: list[bytes], least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of each window whose string starts in a smaller key than the context's own least one."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    ends = np.cumsum(sizes)
    whole = np.arange(len(raw)) + length <= np.repeat(ends, sizes)  # windows only
    order = suffix_array(raw, length, whole)
    order = order[whole[order]]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = common_prefixes(raw, order, length) < length
    first[0] = True
    key = least[owner[order]]
    lowest = np.minimum.reduceat(key, np.flatnonzero(first))[np.cumsum(first) - 1]
    hit = order[lowest < key]
    return owner[hit], hit - (ends - sizes)[owner[hit]]


_RUNS = "bucket long, texts binary, sizes binary, tags binary, orders binary, rows binary, starts binary"


def numbered(strings: Iterable[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct strings, and which of them each one is."""
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(s, len(number)) for s in strings], np.int64)
    return list(number), which


def _later(which: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least key of each of n strings, and which places have a larger one than their string's."""
    least = np.full(n, _LAST)
    np.minimum.at(least, which, order)
    return least, order > least[which]


def _blobs(rows: DataFrame, length: int, n_buckets: int, full: frozenset[int]) -> DataFrame:
    """Runs by bucket, as in _RUNS; a bucket below zero has what is settled already. ``full`` are overfull marks."""

    def blob(bucket: int, texts: bytes, sizes, tags, orders, rows, starts) -> pa.RecordBatch:
        pack = lambda x, kind: [x.astype(kind).tobytes()]
        return record(
            bucket=[bucket], texts=[texts], sizes=pack(sizes, "<u4"), tags=pack(tags, "<u4"), orders=pack(orders, "<i8"),
            rows=pack(rows, "<i8"), starts=pack(starts, "<u4"),
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 2):
                flat = part.column(3).flatten()
                mark, start, count = (flat.field(i).to_numpy() for i in range(3))
                text = np.repeat(np.arange(len(texts)), part.column(3).value_lengths().to_numpy())
                row, order = part.column(0).to_numpy()[text], part.column(1).to_numpy()[text]
                end = start + count - 1 + length
                contexts, which = numbered(
                    texts[k][s:e] for k, s, e in zip(text.tolist(), start.tolist(), end.tolist())
                )
                _, later = _later(which, order, len(contexts))  # a smaller key has all of these
                done = [(row[later], start[later], end[later])]
                wide = ~later & np.isin(mark, np.array(list(full), np.int64))
                kept = ~later & ~wide
                asked = [(which[kept], mark[kept].view(np.uint64), order[kept], row[kept], start[kept])]
                if wide.any():
                    place = np.repeat(np.flatnonzero(wide), count[wide])
                    nth = np.arange(len(place)) - np.repeat(np.cumsum(count[wide]) - count[wide], count[wide])
                    at = start[place] + nth
                    windows, which = numbered(
                        texts[k][s : s + length] for k, s in zip(text[place].tolist(), at.tolist())
                    )
                    _, later = _later(which, order[place], len(windows))
                    done.append((row[place][later], at[later], at[later] + length))
                    own = np.array([xxhash.xxh64_intdigest(w) for w in windows], np.uint64)[which]
                    place, at, which, own = place[~later], at[~later], which[~later], own[~later]
                    asked.append((which + len(contexts), own, order[place], row[place], at))
                    contexts += windows
                # neighbouring runs overlap: a text that is settled whole is one range
                held, low, high = merged(*(np.concatenate(c).astype(np.int64) for c in zip(*done)))
                for at in range(0, len(held), 50_000):
                    to = slice(at, at + 50_000)
                    yield blob(-1 - at, b"", (high - low)[to], held[:0], np.zeros(len(held[to])), held[to], low[to])
                which, mark, order, row, start = (np.concatenate(c) for c in zip(*asked))
                by = np.argsort(which, kind="stable")
                which, mark, order, row, start = which[by], mark[by], order[by], row[by], start[by]
                size = np.array([len(c) for c in contexts], np.int64)
                tag = (mark * _B) >> np.uint64(32)
                for b, some in _dealt(_bucket(mark, n_buckets), n_buckets):
                    # places of one context follow one another; its bytes are sent once, with a size of zero after that
                    context = which[some]
                    new = np.r_[True, context[1:] != context[:-1]]
                    yield blob(
                        b, b"".join([contexts[k] for k in context[new].tolist()]), size[context] * new, tag[some][new],
                        order[some], row[some], start[some],
                    )

    return rows.mapInArrow(cut, _RUNS)


def _disputed(tag: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The contexts, in order, that may share windows with one of another key.

    Equal windows have equal marks, so they lie in runs of equal tags; where all runs of a tag have one least
    key, as copies of one run do, no window of theirs goes.
    """
    by = np.lexsort((least, tag))
    edge = np.flatnonzero(np.r_[True, tag[by][1:] != tag[by][:-1]])
    last = np.append(edge[1:], len(by))
    differ = least[by][edge] != least[by][last - 1]
    return np.sort(by[np.repeat(differ, last - edge)])


def _settle(rows: DataFrame, length: int, n_buckets: int, full: frozenset[int] = frozenset()) -> DataFrame:
    """Covered byte ranges (row, start, end); rows: (row, order, text, runs), order being the key's."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, group in _by_bucket(batches):
            size, order, row, start = (
                np.concatenate([np.frombuffer(r[c], kind) for r in group]).astype(np.int64)
                for c, kind in (("sizes", "<u4"), ("orders", "<i8"), ("rows", "<i8"), ("starts", "<u4"))
            )
            if bucket < 0:
                yield record(row=row, start=start.astype(np.int32), end=(start + size).astype(np.int32))
                continue
            texts, tag = b"".join(r["texts"] for r in group), np.concatenate([np.frombuffer(r["tags"], "<u4") for r in group])
            sent = size > 0  # a size of zero: as the one before
            size, each = size[sent], np.cumsum(sent) - 1
            ends = np.cumsum(size)
            contexts, which = numbered(texts[e - s : e] for s, e in zip(size.tolist(), ends.tolist()))
            tag_of = np.empty(len(contexts), tag.dtype)
            tag_of[which] = tag
            size, which = size[each], which[each]
            least, later = _later(which, order, len(contexts))
            disputed = _disputed(tag_of, least)
            context, offset = covered([contexts[k] for k in disputed.tolist()], least[disputed], length)
            context = disputed[context]
            # windows of a context, merged to ranges
            by = np.lexsort((offset, context))
            context, offset = context[by], offset[by]
            new = np.r_[True, (context[1:] != context[:-1]) | (offset[1:] > offset[:-1] + 1)][: len(context)]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(context))[: len(first)] - 1
            range_of, low, high = context[first], offset[first], offset[last] + length
            # for every place where such a context is the least key's
            at = np.flatnonzero(~later)
            edges = np.searchsorted(range_of, np.arange(len(contexts) + 1))
            n_ranges = np.diff(edges)[which[at]]
            place = np.repeat(at, n_ranges)
            nth = np.arange(len(place)) - np.repeat(np.cumsum(n_ranges) - n_ranges, n_ranges)
            chosen = edges[which[place]] + nth
            row, start, end = merged(
                np.concatenate([row[later], row[place]]),
                np.concatenate([start[later], start[place] + low[chosen]]),
                np.concatenate([(start + size)[later], start[place] + high[chosen]]),
            )
            yield record(row=row, start=start.astype(np.int32), end=end.astype(np.int32))

    spread = F.when(F.col("bucket") < 0, F.xxhash64("rows")).otherwise(F.col("bucket"))
    return (
        _blobs(rows, length, n_buckets, full)
        .withColumn("to", spread)
        .repartition("to")
        .drop("to")
        .sortWithinPartitions("bucket")
        .mapInArrow(settle, "row long, start int, end int")
    )


def _full_marks(found: DataFrame, length: int) -> tuple[frozenset[int], int]:
    """The marks whose runs exceed a bucket, and the bytes that are dealt, windows of such marks each on their own.

    There is at most one such mark for each SUFFIX_BUCKET_BYTES of runs.
    """
    sizes = found.groupBy("mark").agg(F.sum(F.col("count") + length - 1).alias("runs"), F.sum("count").alias("windows"))
    over = F.col("runs") > SUFFIX_BUCKET_BYTES
    total = sizes.agg(F.sum(F.when(over, F.col("windows") * length).otherwise(F.col("runs")))).first()[0] or 0
    return frozenset(r["mark"] for r in sizes.filter(over).select("mark").collect()), total


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row of ``df``."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    rows = df.select(
        F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("order"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).withColumn("row", F.xxhash64("text"))
    ids = written(rows.select("row", "order", F.octet_length("text").alias("bytes")), "text-ids")
    total = ids.agg(F.sum("bytes")).first()[0] or 0
    found = written(_ask(rows.select("text"), length, 1 + total // MARK_BUCKET_BYTES), "repeated-marks")
    by_row = found.groupBy("row").agg(F.collect_set(F.struct("mark", "start", "count")).alias("runs"))
    # the text of the least key stands for all that equal it; with the key, they are no hot spot
    first = ids.groupBy("row").agg(F.min("order").alias("order"))
    asked = by_row.join(first, "row").hint("shuffle_hash")
    met = rows.select("row", "order", "text").join(asked, ["row", "order"])
    full, size = _full_marks(found, length)
    settled = _settle(met.select("row", "order", "text", "runs"), length, 1 + size // SUFFIX_BUCKET_BYTES, full)
    ranges = written(settled, "covered").groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    first = first.join(ranges, "row", "left").withColumn("first", F.lit(True)).hint("shuffle_hash")
    whole = rows.join(first, ["row", "order"], "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                kept, spans = [], []
                lists, is_first = part.column(2), part.column(3)
                for k, t in enumerate(texts):
                    if not is_first[k].is_valid and len(t) >= length:  # a smaller key has the whole text
                        kept.append(b"")
                        spans.append(1)
                        continue
                    if not lists[k].is_valid:
                        kept.append(t)
                        spans.append(0)
                        continue
                    flat = lists[k].values
                    low, high = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                    edge = np.zeros(len(t) + 1, np.int32)
                    np.add.at(edge, low, 1)
                    np.add.at(edge, high, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept.append(np.frombuffer(t, np.uint8)[~gone].tobytes())
                    spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) > 0)))
                n = np.array([len(t) for t in texts], np.int64)
                yield record(
                    key=part.column(0), n_bytes=n, n_removed=n - np.array([len(x) for x in kept], np.int64),
                    n_spans=np.array(spans, np.int64), kept=pa.array(kept, pa.binary()),
                )

    kind = dict(df.dtypes)[key]
    return (
        whole.select("key", "text", "ranges", "first")
        .mapInArrow(remove, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
        .withColumnRenamed("key", key)
    )


