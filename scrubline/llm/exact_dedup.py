"""Exact duplicates by a minimal perfect hash over historical digests.

Texts are equal when they are identical after each run of white space is one
space; the row with the smallest key stays. Rows up to a key count as history,
the rest as newly arrived. The history's distinct digests are dealt into shards,
and each shard gets a minimal perfect hash: levels of bit arrays in which a
digest owns the bit that it alone maps to; the bit's rank is its slot. A slot
holds the whole digest and the locator of the row that stays. New digests are
looked up in their shard: the slot's digest is compared byte by byte, so a member
is proven and joins the historical group; nonmembers are grouped on their own.

Digests are grouped before they meet their shard (partial sums on the map side),
so a text that a third of all rows share is one row there. Rows get their answer
by a join on the digest, which adaptive execution splits where it is skewed.

Defined results: a null text is empty; among equal texts with equal keys one
(any) row stays; a null key comes after all others; an empty table gives an empty
table; other columns take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import SPACE, whole_text, written

#: Digests in a shard of the index, about; with slots of 64 bytes some 3 MB.
SHARD_DIGESTS = 50_000

#: Bits per digest in each level of a shard's hash.
GAMMA = 2.0

_LAST = (1 << 63) - 1  # stands for a null key
_DIGEST = 32


class PerfectHash:
    """Maps n distinct 32-byte digests to 0..n-1 without gaps.

    Level by level, a digest that shares its bit with no other one of the level
    owns that bit; the others go on to the next level.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ranks = np.cumsum(bits) - bits

    @staticmethod
    def _words(digests: np.ndarray) -> np.ndarray:
        """(n, 4) words of a digest; they are uniform already."""
        return np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)

    @staticmethod
    def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = words[:, level % 4] ^ (words[:, (level + 1) % 4] * np.uint64(2 * level + 1))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(16)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        left, sizes, levels = cls._words(digests), [], []
        while len(left):
            size = max(8, int(GAMMA * len(left)))
            place = cls._place(left, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[place]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; of a digest not built in, any slot or -1."""
        words = self._words(digests)
        out, start, todo = np.full(len(words), -1), 0, np.arange(len(words))
        for level, size in enumerate(self.sizes):
            at = start + self._place(words[todo], level, size)
            found = self.bits[at]
            out[todo[found]] = self.ranks[at[found]]
            todo, start = todo[~found], start + size
        return out


def _matrix(digests) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, digests)), np.uint8).reshape(-1, _DIGEST)


def digest(text: str = "text"):
    """SHA-256 (binary) of the text with its white space normalised."""
    return F.unhex(F.sha2(F.regexp_replace(whole_text(text), SPACE, " "), 256))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(
        F.min(F.struct("order", "row")).alias("first"), F.count("*").alias("copies")
    ).select("digest", F.col("first.order").alias("order"), F.col("first.row").alias("row"), "copies")


def _shards(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(n)))


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard: the perfect hash, and its slots (digest, locator, copies).

    ``history`` has one row per distinct digest: digest, order, row, copies.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        digests = _matrix(pdf["digest"])
        index = PerfectHash.build(digests)
        slot = index.slots(digests)
        by_slot = np.empty(len(slot), np.int64)
        by_slot[slot] = np.arange(len(slot))
        locators = pdf[["order", "row", "copies"]].to_numpy(np.int64)[by_slot]
        return pd.DataFrame(
            {
                "shard": [pdf["shard"].iloc[0]],
                "sizes": [np.array(index.sizes, np.int64).tobytes()],
                "bits": [np.packbits(index.bits).tobytes()],
                "digests": [digests[by_slot].tobytes()],
                "locators": [locators.tobytes()],
            }
        )

    return _shards(history, n_shards).groupBy("shard").applyInPandas(
        build, "shard long, sizes binary, bits binary, digests binary, locators binary"
    )


def look_up(index: DataFrame, arrived: DataFrame, n_shards: int) -> DataFrame:
    """The groups after ``arrived`` came: one row per distinct digest.

    ``arrived`` has one row per distinct digest, as the history had.
    """

    def meet(key, shard: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        out = {c: [] for c in ("digest", "order", "row", "copies", "historical")}
        digests, fresh = np.zeros((0, _DIGEST), np.uint8), np.ones(len(new), bool)
        copies = new["copies"].to_numpy(np.int64)
        if len(shard):
            s = shard.iloc[0]
            sizes = np.frombuffer(s["sizes"], np.int64).tolist()
            bits = np.unpackbits(np.frombuffer(s["bits"], np.uint8))[: sum(sizes)].astype(bool)
            digests = np.frombuffer(s["digests"], np.uint8).reshape(-1, _DIGEST)
            locators = np.frombuffer(s["locators"], np.int64).reshape(-1, 3).copy()
            if len(new):
                asked = _matrix(new["digest"])
                slot = PerfectHash(sizes, bits).slots(asked)
                member = (slot >= 0) & (digests[slot] == asked).all(axis=1)
                locators[slot[member], 2] += copies[member]
                fresh = ~member
            out["digest"] += [d.tobytes() for d in digests]
            for k, c in enumerate(("order", "row", "copies")):
                out[c] += locators[:, k].tolist()
        rest = new[fresh]
        out["digest"] += list(rest["digest"])
        for c in ("order", "row", "copies"):
            out[c] += rest[c].tolist()
        out["historical"] = [True] * len(digests) + [False] * len(rest)
        return pd.DataFrame(out)

    return (
        index.groupBy("shard")
        .cogroup(_shards(arrived, n_shards).groupBy("shard"))
        .applyInPandas(meet, "digest binary, order long, row long, copies long, historical boolean")
    )


def _winners(rows: DataFrame, upto=None) -> DataFrame:
    """One row per distinct digest of ``rows`` (digest, order, row): who stays, and how many there are."""
    if upto is None:
        upto = rows.agg(F.percentile_approx("order", 0.5, 1000)).first()[0]
    old = F.lit(False) if upto is None else F.col("order") <= F.lit(upto)
    history = written(_grouped(rows.filter(old)), "history")
    arrived = written(_grouped(rows.filter(~old)), "arrived")
    n_shards = 1 + max(history.count(), arrived.count()) // SHARD_DIGESTS
    index = written(build_index(history, n_shards), "digest-index")
    return look_up(index, arrived, n_shards)


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """digest, order and a row number for each row, written once."""
    return written(
        df.select(
            F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("order"), digest(text).alias("digest")
        ).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", history_upto: int | None = None) -> DataFrame:
    """One row per row of ``df``: key, keep_id (key of the row that stays), group_size, kept, text_sha256.

    Rows with a key up to ``history_upto`` (default: about half) make the index.
    """
    rows = _rows(df, key, text)
    winners = _winners(rows, history_upto).withColumnsRenamed({"order": "best", "row": "best_row"})
    known = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return rows.join(winners, "digest").select(
        known("order").alias(key),
        known("best").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("row") == F.col("best_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "historical",
    )


def drop_copies(df: DataFrame, key: str = "doc_id", text: str = "text", history_upto: int | None = None) -> DataFrame:
    """``df`` with one row of each group of equal texts, all columns as they are.

    The texts are shuffled by digest and key together, so no group of copies is
    a hot spot.
    """
    rows = _rows(df, key, text)
    winners = written(_winners(rows, history_upto), "winners")
    names = {"_digest": digest(text), "_order": F.coalesce(F.col(key).cast("long"), F.lit(_LAST))}
    stay = winners.select(F.col("digest").alias("_digest"), F.col("order").alias("_order")).hint("shuffle_hash")
    out = df.withColumns(names).join(stay, ["_digest", "_order"], "left_semi")
    same = rows.join(winners.withColumnRenamed("row", "best"), ["digest", "order"]).filter("row != best")
    if not same.isEmpty():  # equal keys as well: one of them is enough
        out = out.dropDuplicates(["_digest", "_order"])
    return out.drop("_digest", "_order")
