"""Spelling variants: words one edit apart, by dense prefix-suffix tiling.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. That is so
exactly if their common prefix and suffix together reach the longer length less one. Where the shorter
word of a near pair has m code points and these are cut into segments, the edit lies in one segment
and all outside of it agree; so words meet in buckets named by (m, segment, hash of what is outside):
each word in those of its own length and of the length below. Buckets of more than ``BUCKET_ROWS``
words have their segment halved, again and again, until they are small or the segment is a single
code point wide, where an alphabet bounds them. A pair is told in the one bucket whose segment
holds the place where its common prefix ends, so no pair is told twice.

A task reads its buckets in order and lays their words into padded code-point matrices, aligned left
and aligned right, of at most ``TILE_ROWS`` rows. Block pairs that share a bucket are compared position by
position; no pair leaves the task, only each word's number of near words and its best one.

Defined results: null texts have no words, a null doc_id counts as empty, repeated rows count each,
extra columns are ignored, an empty table gives an empty result. Words may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import record, written

#: Buckets beyond this are dealt again by finer segments.
BUCKET_ROWS = 2048
#: Rows of a block, fewer if the words are long: a matrix has at most TILE_CELLS cells.
TILE_ROWS, TILE_CELLS = 256, 4_000_000
#: Words compared at a time, at least, so that small buckets share blocks.
CHUNK_ROWS = 8192

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, run) for every maximal run of letters in every text, A-Z lower-cased."""
    lowered = F.translate(F.col(text).cast("string"), UPPER, LOWER)
    found = F.regexp_extract_all(lowered, F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("run"))


def misspelt(found: DataFrame, one_in: int = 97) -> DataFrame:
    """The runs as ``word``, one in ``one_in`` of (key, run) without one of its code points, chosen by crc32."""
    h = F.crc32(F.concat_ws(":", F.coalesce("key", F.lit("")), "run"))
    place = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.lit(2**31 - 1)))
    return found.select("run", h.alias("h")).select(
        F.when(F.col("h") % one_in == 0, less).otherwise(F.col("run")).alias("word")
    )


def count_words(found: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of the words long and frequent enough."""
    long_enough = found.filter(F.char_length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _bucket(m: Column, low: Column, high: Column) -> Column:
    """What places a word in the bucket of shorter length ``m`` and segment ``low`` to ``high``."""
    after = m - high
    ending = F.when(after > 0, F.substring("word", -after, after)).otherwise("")
    return F.struct(
        m.cast("int").alias("m"), low.cast("int").alias("low"), high.cast("int").alias("high"),
        F.xxhash64(m, low, high, F.substring("word", F.lit(1), low), ending).alias("bucket"),
    )


def _placed(rows: DataFrame, buckets: list[Column]) -> DataFrame:
    return rows.select("word", "n", F.explode(F.array(*buckets)).alias("b")).select("word", "n", "b.*")


def _halved(m: Column, low: Column, high: Column) -> list[Column]:
    middle = F.floor((low + high) / 2).cast("int")
    return [_bucket(m, low, middle), _bucket(m, middle, high)]


def _dealt(words: DataFrame) -> DataFrame:
    """Every word in its buckets: word, n, m, low, high, bucket."""
    length, zero = F.char_length("word"), F.lit(0)
    own, below = _halved(length, zero, length), _halved(length - 1, zero, length - 1)
    rows = written(_placed(words, own + below).filter("m > 0"), "word-buckets")
    done = None
    while True:
        full = rows.filter("high - low > 1").groupBy("m", "low", "bucket").count().filter(F.col("count") > BUCKET_ROWS)
        full = written(full.drop("count"), "full-buckets")
        small = rows if full.isEmpty() else rows.join(full, ["m", "low", "bucket"], "left_anti").select(rows.columns)
        done = small if done is None else done.union(small)
        if small is rows:
            return done
        within = rows.join(full, ["m", "low", "bucket"], "left_semi")
        rows = written(_placed(within, _halved(F.col("m"), F.col("low"), F.col("high"))), "word-buckets")


class _Block:
    """Words of some buckets as padded matrices of code points, one row per position."""

    def __init__(self, words: list[str], rows: slice, columns: dict):
        part = words[rows]
        width = max(map(len, part))
        self.rows, self.columns = rows, {c: v[rows] for c, v in columns.items()}
        self.left = self._matrix(part, width)
        self.right = self._matrix([w.rjust(width, "\0") for w in part], width)[::-1]

    @staticmethod
    def _matrix(words: list[str], width: int) -> np.ndarray:
        codes = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width).T
        return np.ascontiguousarray(codes.astype(np.min_scalar_type(codes.max())))

    def __getitem__(self, c: str) -> np.ndarray:
        return self.columns[c]


def _common(a: np.ndarray, b: np.ndarray, same: np.ndarray, most: int) -> np.ndarray:
    """How many first rows of the matrices agree, for each pair of ``same``; at most ``most``."""
    alive, reached = same.copy(), np.zeros(same.shape, np.min_scalar_type(most))
    for k in range(min(len(a), len(b), most)):
        alive &= a[k][:, None] == b[k][None, :]
        reached += alive
        if k % 4 == 3 and not alive.any():
            break
    return reached


def _near(x: _Block, y: _Block) -> np.ndarray:
    """Which pairs of the two blocks are one edit apart and belong to be told in their bucket."""
    same = x["number"][:, None] == y["number"][None, :]
    longer = np.maximum(x["length"][:, None], y["length"][None, :])
    shorter = np.minimum(x["length"][:, None], y["length"][None, :])
    same &= shorter == x["m"][:, None]
    if x.rows == y.rows:
        same &= np.tri(len(x["m"]), k=-1, dtype=bool).T
    if not same.any():
        return same
    most = int(x["m"].max())
    prefix = _common(x.left, y.left, same, most).astype(np.int32)
    suffix = _common(x.right, y.right, same, most)
    place = np.minimum(prefix, shorter - 1)
    same &= (prefix + suffix >= longer - 1) & (prefix < longer)
    return same & (place >= x["low"][:, None]) & (place < x["high"][:, None])


def _tiled(words: list[str], n: np.ndarray, columns: dict) -> pa.RecordBatch:
    """Number of near words and the best of them, for the words of whole buckets in order."""
    many, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    by_word = np.empty(len(words), np.int64)
    by_word[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((by_word, -n))  # most frequent first, then by code points
    columns["wish"] = np.empty(len(words), np.int64)
    columns["wish"][order] = np.arange(len(words))
    height = max(1, min(TILE_ROWS, TILE_CELLS // int(columns["length"].max())))
    blocks = [_Block(words, slice(k, min(k + height, len(words))), columns) for k in range(0, len(words), height)]
    for i, x in enumerate(blocks):
        for y in blocks[i:]:
            if y["number"][0] > x["number"][-1]:
                break
            near = _near(x, y)
            if near.any():
                many[x.rows] += near.sum(axis=1)
                many[y.rows] += near.sum(axis=0)
                wishes = np.where(near, y["wish"][None, :], len(words)).min(axis=1)
                best[x.rows] = np.minimum(best[x.rows], wishes)
                wishes = np.where(near, x["wish"][:, None], len(words)).min(axis=0)
                best[y.rows] = np.minimum(best[y.rows], wishes)
    told = np.flatnonzero(many)
    chosen = order[best[told]]
    return record(
        word=pa.array([words[k] for k in told], pa.string()), n_near=many[told], best_n=n[chosen],
        best=pa.array([words[k] for k in chosen], pa.string()),
    )


def _numbered(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, dict]:
    words = batch.column("word").to_pylist()
    columns = {c: batch.column(c).to_numpy() for c in ("m", "low", "high", "bucket")}
    change = np.zeros(len(words), bool)
    for c in ("m", "low", "bucket"):
        change[1:] |= columns[c][1:] != columns[c][:-1]
    columns["number"] = np.cumsum(change)
    columns["length"] = np.fromiter(map(len, words), np.int64, len(words))
    return words, batch.column("n").to_numpy(), columns


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets at a time: what follows the last change of bucket waits for more rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < CHUNK_ROWS:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        words, n, columns = _numbered(rows)
        cut = int(np.searchsorted(columns["number"], columns["number"][-1]))
        if cut:
            yield _tiled(words[:cut], n[:cut], {c: v[:cut] for c, v in columns.items()})
        held = [rows.slice(cut)]
    if held and sum(b.num_rows for b in held):
        words, n, columns = _numbered(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        yield _tiled(words, n, columns)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, best and best_n (the near word of largest n, ties by code points) of all words."""
    schema = "word string, n_near long, best_n long, best string"
    rows = _dealt(words).repartition("m", "low", "bucket").sortWithinPartitions("m", "low", "bucket")
    told = rows.mapInArrow(_compare, schema).withColumn("n", F.lit(None).cast("long"))
    nothing = [F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n")]
    every = words.select("word", "n", *nothing, F.lit(None).cast("string").alias("best"))
    wish = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("minus"), "best"))
    return (
        told.unionByName(every)
        .groupBy("word")
        .agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(wish).alias("wish"))
        .select("word", "n", "n_near", F.col("wish.best").alias("best"), (-F.col("wish.minus")).alias("best_n"))
    )


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): links (word, root) followed to their ends, by doubling.

    A form is at least twice as frequent as its word, so chains are short and hold no circle.
    """
    links = written(links, "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = links.join(ahead, "root", "left")
        moved = F.col("next").isNotNull().alias("moved")
        links = written(step.select("word", F.coalesce("next", "root").alias("root"), moved), "forms")
        if links.filter("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root of all words (word, n).

    A word's form is its best near word if that is at least ``ratio`` (2 or more) times as frequent.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = written(words, "words")
    formed = F.col("best_n") >= ratio * F.col("n")
    table = written(
        near_words(words).select(
            "word", "n", "n_near", F.when(formed, F.col("best")).alias("form"),
            F.when(formed, F.col("best_n")).alias("form_n"),
        ),
        "variants",
    )
    roots = _roots(table.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return table.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
