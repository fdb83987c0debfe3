"""Packing token sequences: dominance reduction, then best fit.

Pieces of at most ``capacity`` tokens are packed into sequences of that size. How
many pieces there are of each length is all that a plan depends on, so the plan is
made over at most ``capacity`` counts, whatever the number of documents:

* Martello-Toth reduction: a set of pieces that provably dominates every other set
  with the same longest piece is fixed for good, as often as the counts allow;
* the remainder is packed by best fit, longest piece first, equal pieces at once.

The plan is a list of patterns (lengths in a sequence) with their counts. A
piece's rank among those of its length tells its sequence and its place. Ranks come
from windows over cells of bounded size, so a length that a third of all
pieces have is no hot spot.

Defined results: a null text is empty, and a document of no tokens still has its
end id; a document of more than ``capacity`` tokens is cut into pieces of that
size, the first of which may be shorter; repeated rows are packed each; an empty
table gives an empty table; other columns take no part.
"""

from __future__ import annotations

import functools
import json
from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.common import record, slices, written

#: Pieces that are ranked in one window, about.
CELL_PIECES = 2_000

#: Longer runs of white space, or words, go the slower, surer way.
LONG_RUN = 20_000


# -- tokens ---------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: bytes):
    """Encodes by a byte-level BPE file, given whole, as its own library does by default.

    Merges of such a file are ranked as their results are numbered, which is checked
    here; then the same ids come four times as fast from a merge table of bytes.
    Texts with very long runs, or with the string of an added token, take the file's own library.
    """
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_buffer(vocabulary)
    model = json.loads(vocabulary)["model"]
    letters = _byte_letters()
    special = {t.content for t in whole.get_added_tokens_decoder().values()}
    ranks = {bytes(letters[c] for c in s): i for s, i in model["vocab"].items() if s not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"]["".join(m)] for m in merges]
    if made != sorted(made):
        raise ValueError("merges are not ranked by id")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    long_run = regex.compile(rf"\s{{{LONG_RUN}}}|[^\s]{{{LONG_RUN}}}")

    def encode(text: str) -> np.ndarray:
        if any(t in text for t in special) or (len(text) >= LONG_RUN and long_run.search(text)):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be short of the capacity."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], n])]


def token_pieces(
    df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0
) -> DataFrame:
    """One row per piece: key, piece, start, length, and ids (little-endian unsigned 32-bit).

    ``vocabulary`` is a file that only the driver need see: its bytes go to the tasks.
    """
    content = Path(vocabulary).read_bytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(content)
        for batch in batches:
            for part, texts in slices(batch, 1):
                row, piece, start, length, ids = [], [], [], [], []
                for r, t in enumerate(texts):
                    tokens = np.append(encode(t.decode("utf-8", "replace")), np.uint32(end_id)).astype("<u4")
                    for p, (s, n) in enumerate(cut(len(tokens), capacity)):
                        row.append(r)
                        piece.append(p)
                        start.append(s)
                        length.append(n)
                        ids.append(tokens[s : s + n].tobytes())
                yield record(
                    key=part.column(0).take(pa.array(row, pa.int64())),
                    piece=pa.array(piece, pa.int32()),
                    start=pa.array(start, pa.int64()),
                    length=pa.array(length, pa.int64()),
                    ids=pa.array(ids, pa.binary()),
                )

    kind = dict(df.dtypes)[key]
    return (
        df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        .mapInArrow(work, f"key {kind}, piece int, start long, length long, ids binary")
        .withColumnRenamed("key", key)
    )


# -- plan -----------------------------------------------------------------------------


def reduce_counts(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Patterns that are fixed for good, and the counts that are left.

    For the longest piece j, with room r beside it, and k the longest piece that fits:
    {j} dominates if nothing fits; {j, k} dominates if k fills r; if no two others fit
    in r; or if no three others do and no two together exceed k.
    """
    left = {n: c for n, c in counts.items() if c}
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(pattern: tuple[int, ...], times: int) -> None:
        fixed.append((pattern, times))
        for n in pattern:
            left[n] -= times
            if not left[n]:
                del left[n]
                lengths.remove(n)

    def smallest(k: int) -> int:
        total = 0
        for n in lengths:
            take = min(k, left[n])
            total, k = total + take * n, k - take
            if not k:
                return total
        return capacity + 1

    def best_two(room: int) -> int:
        low, high, best = 0, bisect_right(lengths, room) - 1, 0
        while low <= high:
            total = lengths[low] + lengths[high]
            if total > room or (low == high and left[lengths[low]] < 2):
                high -= 1
            else:
                best, low = max(best, total), low + 1
        return best

    lengths = sorted(left)
    for j in sorted(left, reverse=True):
        while left.get(j, 0):
            room = capacity - j
            left[j] -= 1  # the one that is looked at
            fits = [n for n in lengths[: bisect_right(lengths, room)] if left[n]] if room else []
            k = fits[-1] if fits else 0
            dominates = bool(k) and (
                k == room or smallest(2) > room or (smallest(3) > room and best_two(room) <= k)
            )
            left[j] += 1
            if not k:
                fix((j,), left[j])
            elif dominates:
                fix((j, k), left[j] // 2 if j == k else min(left[j], left[k]))
            else:
                break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of best fit by decreasing length, equal pieces at once."""
    open_by_room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for n in sorted(counts, reverse=True):
        todo = counts[n]
        while todo:
            room = next((r for r in range(n, capacity + 1) if open_by_room[r]), None)
            pattern, bins = open_by_room[room].pop() if room is not None else ((), todo)
            room = capacity if room is None else room
            each = min(room // n, todo)  # the fullest bin that fits stays the fullest
            used = min(bins, todo // each)
            if used < bins and pattern:
                open_by_room[room].append((pattern, bins - used))
            open_by_room[room - each * n].append((pattern + (n,) * each, used))
            todo -= used * each
    return [x for found in open_by_room for x in found]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence) with how many sequences have them."""
    fixed, left = reduce_counts(counts, capacity)
    return fixed + best_fit(left, capacity)


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of a length go, by rank: from ``rank`` on, ``sequence`` on, at ``offset``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 4).T.copy()))


# -- packing --------------------------------------------------------------------------


def pack(pieces: DataFrame, order: list[str], capacity: int = 2048, length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset; ``order`` names columns that tell pieces apart.

    ``pieces`` should read from a file or a table: it is read three times.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most one row per length
    if any(n is None or not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    slots = slot_table(plan(counts, capacity))

    cells = spark.createDataFrame(
        [(n, 1 + c // CELL_PIECES) for n, c in counts.items()], f"`{length}` long, _cells long"
    )
    cell = F.pmod(F.xxhash64(*order), F.col("_cells"))
    dealt = pieces.join(F.broadcast(cells), length).withColumn("_cell", cell).drop("_cells")
    sizes = dealt.groupBy(length, "_cell").agg(F.count("*").alias("_n"))
    by_length = Window.partitionBy(length).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(length, "_cell", F.coalesce(F.sum("_n").over(by_length), F.lit(0)).alias("_before"))
    in_cell = Window.partitionBy(length, "_cell").orderBy(*order)
    ranked = (
        dealt.withColumn("_rank", F.row_number().over(in_cell) - 1)
        .join(before, [length, "_cell"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .select(*pieces.columns, "_rank")
    )
    at = pieces.columns.index(length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.searchsorted(slots["length"], np.arange(capacity + 2))
        span = int(slots["rank"].max(initial=0)) + 1
        codes = slots["length"] * span + slots["rank"]
        for batch in batches:
            n = batch.column(at).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            k = np.searchsorted(codes, n * span + np.minimum(rank, span - 1), "right") - 1
            assert (k >= edges[n]).all()
            names = [*batch.schema.names[:-1], "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(slots["sequence"][k] + rank - slots["rank"][k]),
                    pa.array(slots["offset"][k]),
                ],
                names=names,
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(
    df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0
) -> DataFrame:
    """Documents as pieces in sequences: key, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(df, vocabulary, key, text, capacity, end_id)
    pieces = written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack(pieces, [key, "piece"], capacity)
