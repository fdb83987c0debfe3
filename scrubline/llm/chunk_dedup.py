"""Repeated substrings by content-defined chunking with a gear rolling hash.

The gear hash of a position depends on the 32 bytes up to it. A chunk ends where that hash
is the strict maximum among the ``REACH`` positions on either side, so cuts depend on nearby
bytes alone: an insertion moves the cuts beside it and no others, chunks are longer than
``REACH``, and any passage that two texts share is cut alike but at its ends. A run without
such a maximum is cut every ``MAX_CHUNK`` bytes.

Chunks are told apart by a 128-bit digest. Of equal ones, the first (least key, then first in the
text) stays. Repeats within a text are found beside the text; across texts, the least key of
a digest is a grouped minimum, pre-aggregated on the map side, and only digests that occur in
several texts are joined back, which adaptive execution splits where a digest is hot.

Defined results: a null text is empty and has no chunks; pieces of ``REACH`` bytes or fewer
(ends of texts) always stay; rows with equal keys count as one text's parts: each keeps what is
first in itself; rows with a null key are left as they are; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import record, slices, written

REACH = 32
MAX_CHUNK = 1024


def _gear() -> np.ndarray:
    """A random-looking number for each byte, by a fixed rule (splitmix64)."""
    z = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + GEAR[raw[i]] in 32 bits, for all i at once by doubling the window."""
    h = GEAR[raw]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def cuts(raw: np.ndarray) -> np.ndarray:
    """The ends of the chunks of a text of one byte or more."""
    n, h = len(raw), gear_hashes(raw) * np.uint32(0x9E3779B1)
    h |= np.uint32(1)  # above the padding
    padded = np.zeros(n + 2 * REACH, np.uint32)
    padded[REACH:-REACH] = h
    ahead = padded  # ahead[i]: the maximum of padded[i : i + width]
    width = 1
    while width < REACH:
        step = min(width, REACH - width)
        ahead = np.maximum(ahead[:-step], ahead[step:])
        width += step
    at = np.flatnonzero((h > ahead[:n]) & (h > ahead[REACH + 1 : REACH + 1 + n])) + 1
    ends = np.unique(np.append(at, n))
    starts = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - starts > MAX_CHUNK)
    if len(long):
        more = [np.arange(starts[k] + MAX_CHUNK, ends[k], MAX_CHUNK) for k in long]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def chunks(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of each chunk."""
    start, digest = 0, hashlib.blake2b
    for end in cuts(np.frombuffer(data, np.uint8)).tolist() if data else ():
        yield start, end, digest(data[start:end], digest_size=16).digest()
        start = end


def _table(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per text and distinct chunk of more than REACH bytes: key, digest, first start and end."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                row, start, digest = [], [], []
                for r, t in enumerate(texts):
                    seen = set()
                    for s, e, d in chunks(t):
                        if e - s > REACH and d not in seen:
                            seen.add(d)
                            row.append(r)
                            start.append(s)
                            digest.append(d)
                halves = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                yield record(
                    key=part.column(0).take(pa.array(row, pa.int64())),
                    start=pa.array(start, pa.int32()),
                    high=halves[:, 0].copy(),
                    low=halves[:, 1].copy(),
                )

    return (
        df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
        .filter("key is not null")
        .mapInArrow(work, "key long, start int, high long, low long")
    )


def repeated_chunks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per key that repeats chunks of smaller keys: key, starts, and first_keys, who has the first copies."""
    table = _table(df, key, text)
    firsts = (
        table.groupBy("high", "low")
        .agg(F.min("key").alias("first"), F.max("key").alias("last"))
        .filter("first < last")
        .select("high", "low", "first")
    )
    return (
        table.join(firsts, ["high", "low"])
        .filter("key > first")
        .groupBy("key")
        .agg(F.collect_list("start").alias("starts"), F.array_sort(F.collect_set("first")).alias("first_keys"))
        .withColumnRenamed("key", key)
    )


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kept (the text without repeated chunks), n_bytes, n_removed, n_chunks, n_repeated and first_keys."""
    found = written(repeated_chunks(df, key, text).withColumnRenamed(key, "_key"), "repeated-chunks")
    texts = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = texts.join(found, F.col("key") == F.col("_key"), "left").select("key", "text", "starts", "first_keys")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                kept, sizes, count, repeated = [], [], [], []
                for t, starts in zip(texts, part.column(2).to_pylist()):
                    drop, seen, out, n, r = set(starts or ()), {}, [], 0, 0
                    for s, e, d in chunks(t):
                        long = e - s > REACH
                        first = seen.setdefault(d, s) if long else s
                        gone = long and (first != s or s in drop or first in drop)
                        n, r = n + 1, r + gone
                        if not gone:
                            out.append(t[s:e])
                    kept.append(b"".join(out))
                    sizes.append(len(t))
                    count.append(n)
                    repeated.append(r)
                removed = np.array(sizes, np.int64) - np.array([len(k) for k in kept], np.int64)
                yield record(
                    key=part.column(0), kept=pa.array(kept, pa.binary()), n_bytes=pa.array(sizes, pa.int64()),
                    n_removed=removed, n_chunks=pa.array(count, pa.int64()), n_repeated=pa.array(repeated, pa.int64()),
                    first_keys=part.column(3),
                )

    kind = dict(df.dtypes)[key]
    return rows.mapInArrow(
        work,
        f"key {kind}, kept binary, n_bytes long, n_removed long, n_chunks long, n_repeated long, first_keys array<long>",
    ).withColumnRenamed("key", key)
