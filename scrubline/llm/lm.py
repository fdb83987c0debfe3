"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

A token's chance is the chance of its class given the two tokens before it, times the chance of its
slot within the class given the same, times its share of the slot. Classes come from a word's last two
bytes. The ``OWN`` most frequent words of a class have a slot each, so for them the share is one; the
others are dealt over the remaining slots by their hash, with the word's smoothed share of its slot,
which is the maximum-entropy solution with one weight per word.

Both factors are log-linear models: features are the previous token, the one before (a skip), the pair
of both, and the pair of their classes, hashed to rows of a weight matrix with a column per class. For
slots the features are taken together with the token's own class (and the previous token's class stands
for the pair of classes), with a column per slot; they start from the slots' shares of their class. The
softmax runs over the classes, and over the slots of one class.

Training reads each training text once. In each of ``ROUNDS`` rounds every partition takes one
slice of its texts through gradient steps from the common weights (AdaGrad, minibatches), and the
moves are averaged per row, weighted by how often each partition met the row. Moves are summed by
Spark, block by block. The hashed rows of a feature grow as the square root of the training tokens.

Texts are cut into tokens once and written as numbers; counting, training and scoring read these.

Word counts cover all training tokens. Words are told apart by 64-bit hashes. The most
frequent words, at most ``FREQUENT`` of them, go to every task; all other words of a
text are looked up by a join, so any vocabulary is exact.

Defined results: a null text is empty; an empty text is one end token; rows with a null key are
scored but not learnt from; without training tokens every base chance is one and every class equally
likely; repeated rows get the same score; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import LARGE_ROWS, record, slices, written

CLASS_BITS = 5
CLASSES = 1 << CLASS_BITS

#: Slots of a class: for its most frequent words, one each, and for its other words by hash.
OWN, SHARED = CLASSES // 2, CLASSES // 2

#: Hashed rows of each of three features; twice as many for each fourfold of so many training tokens.
HASHED_ROWS, ROWS_FROM_TOKENS = 4096, 100_000_000

#: Rows of a factor's weights: one per pair of classes, and the hashed ones.
ROWS = CLASSES * CLASSES + 3 * HASHED_ROWS

ROUNDS, BATCH_TOKENS, RATE = 3, 8_192, 0.1

#: Weight rows that are summed together.
BLOCK_ROWS = 512

#: Bound on the words that are sent to every task (16 bytes each).
FREQUENT = 1 << 19

#: Text bytes whose tokens are written together (or one text).
BLOCK_BYTES = 2_000_000

#: Words that a task remembers before it starts over; bounds its memory.
REMEMBERED = 300_000

_MASK = CLASSES - 1
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SALT = np.uint64(0xD6E8FEB86659FD93)
_NOTHING = np.uint64(1 << 63)  # stands before the first token


class Endings(dict):
    """The class of each ending of two bytes; the end token is the empty word, of class 0."""

    def __missing__(self, ending: bytes) -> int:
        self[ending] = kind = 1 + xxhash.xxh32_intdigest(ending) % (CLASSES - 1) if ending else 0
        return kind


def word_keys(words: list[bytes], endings: Endings) -> np.ndarray:
    """The 64-bit keys of words; their low bits are their classes."""
    keys = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    kinds = np.fromiter(map(endings.__getitem__, [w[-2:] for w in words]), np.uint64, len(words))
    return keys & np.uint64((1 << 64) - CLASSES) | kinds


class Words:
    """Keys of words; remembers them."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.keys = np.zeros(0, np.uint64)
        self.endings = Endings()

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all tokens of the texts, and how many tokens each text has."""
        words, sizes, codes = self.numbered(texts)
        return words[codes], sizes

    def numbered(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys of the texts' distinct words, how many tokens each text has, and which of the words each token is."""
        if len(self.known) > REMEMBERED:
            self.__init__()
        words: list[bytes] = []
        sizes = []
        for t in texts:
            found = t.lower().split()
            words += found
            words.append(b"")
            sizes.append(len(found) + 1)
        known, before = self.known, len(self.known)
        codes = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(codes < 0)
        codes[unknown] = [known.setdefault(words[k], len(known)) for k in unknown.tolist()]
        new = list(islice(known, before, None))
        self.keys = np.concatenate([self.keys, word_keys(new, self.endings)])
        used = np.zeros(len(self.keys), bool)
        used[codes] = True
        own = np.flatnonzero(used)
        place = np.empty(len(self.keys), np.int64)
        place[own] = np.arange(len(own))
        return self.keys[own], np.array(sizes, np.int64), place[codes]


def hashed_rows(tokens: int) -> int:
    """The hashed rows of a feature when so many tokens are learnt from."""
    return HASHED_ROWS << (tokens // ROWS_FROM_TOKENS).bit_length() // 2


def rows_of(keys: np.ndarray, sizes: np.ndarray, hashed: int = HASHED_ROWS, inside: bool = False) -> np.ndarray:
    """(4, tokens): the weight rows of each token's features; with ``inside`` those for its slot within its class."""
    start = np.cumsum(sizes) - sizes
    one = np.concatenate([[_NOTHING], keys[:-1]])
    one[start] = _NOTHING
    two = np.concatenate([[_NOTHING], one[:-1]])
    two[start] = _NOTHING
    mask, shift = np.uint64(_MASK), np.uint64(64 - (hashed.bit_length() - 1))
    base, a, b = CLASSES * CLASSES, one * _A, two * _B
    other = two
    if inside:
        own = keys & mask
        other, salt = own, (own + np.uint64(1)) * _SALT
        a, b = a ^ salt, b ^ salt
        both = a ^ b ^ salt
    else:
        both = a ^ b
    return np.stack(
        [
            ((one & mask) * np.uint64(CLASSES) + (other & mask)).astype(np.int64),
            base + ((a ^ a >> np.uint64(32)) * _C >> shift).astype(np.int64),
            base + hashed + ((b ^ b >> np.uint64(32)) * _A >> shift).astype(np.int64),
            base + 2 * hashed + ((both ^ both >> np.uint64(32)) * _B >> shift).astype(np.int64),
        ]
    )


def class_chances(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(tokens, columns): the softmax over classes, or over the slots of a class."""
    logits = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        logits += weights.take(r, axis=0)
    if logits.size:
        top = logits.max()
        # one maximum serves all tokens if none is left without a chance by it
        logits -= top if top - logits.min() < 60 else logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


class Learner:
    """Gradient steps on one partition's texts."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.squares = weights.copy(), np.full(weights.shape, 1e-2, np.float32)
        self.met = np.zeros(len(weights), np.float64)
        self.hashed = (len(weights) - CLASSES * CLASSES) // 3

    def learn(self, keys: np.ndarray, sizes: np.ndarray, slot: np.ndarray | None = None) -> None:
        """Learns the tokens' classes, or their slots within these."""
        rows = rows_of(keys, sizes, self.hashed, slot is not None)
        target = (keys & np.uint64(_MASK)).astype(np.int64) if slot is None else slot
        number = np.empty(len(self.weights), np.int64)
        for at in range(0, len(keys), BATCH_TOKENS):
            some, own = rows[:, at : at + BATCH_TOKENS], target[at : at + BATCH_TOKENS]
            error = class_chances(self.weights, some)
            error[np.arange(len(own)), own] -= 1
            by_column = np.ascontiguousarray(error.T, np.float64)
            met = np.bincount(some.ravel(), minlength=len(self.weights))
            self.met += met
            for r in some:  # each feature has rows of its own
                here = np.zeros(len(met), bool)
                here[r] = True
                row = np.flatnonzero(here)
                number[row] = np.arange(len(row))
                place, sums = number[r], np.empty((CLASSES, len(row)), np.float32)
                for c in range(CLASSES):
                    sums[c] = np.bincount(place, by_column[c], len(row))
                gradient = np.ascontiguousarray(sums.T)
                squares = self.squares[row] + gradient * gradient
                self.squares[row] = squares
                gradient /= np.sqrt(squares, out=squares)
                self.weights[row] -= np.float32(RATE) * gradient


class Slots:
    """Which slot of its class each word has, and the logarithm (base 10) of what the words of a slot weigh."""

    def __init__(self, frequent: np.ndarray, n_frequent: np.ndarray, shared: Iterable[tuple[int, int, int]]):
        """``frequent`` are sorted keys; ``shared`` has (class and shared slot as one number, tokens, words) of all words."""
        order = np.argsort(-n_frequent, kind="stable")
        kind = (frequent[order] & np.uint64(_MASK)).astype(np.int64)
        order = order[np.argsort(kind, kind="stable")]  # by class, the most frequent first
        kind = np.sort(kind)
        rank = np.arange(len(kind)) - np.searchsorted(kind, kind)
        at, kind, rank = order[rank < OWN], kind[rank < OWN], rank[rank < OWN]
        weigh = np.ones((CLASSES, CLASSES))  # one for a word never met, which an own slot has not
        for place, n, v in shared:
            weigh[place % CLASSES, OWN + place // CLASSES] += n + v
        np.subtract.at(weigh, (kind, OWN + _shared_slot(frequent[at])), n_frequent[at] + 1.0)
        weigh[kind, rank] = n_frequent[at] + 1.0
        by_key = np.argsort(frequent[at])
        self.keys, self.slot = frequent[at][by_key], rank[by_key]
        self.log = np.log10(weigh)
        self.start = np.log(weigh)
        empty = np.ones((CLASSES, OWN), bool)
        empty[kind, rank] = False
        self.start[:, :OWN][empty] = -30.0  # no word has them

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = OWN + _shared_slot(keys)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        if len(self.keys):
            slot = np.where(self.keys[at] == keys, self.slot[at], slot)
        return slot

    def weights(self, hashed: int) -> np.ndarray:
        """(2, rows, columns): those of classes, all alike, and those of slots, by what the slots weigh."""
        weights = np.zeros((2, CLASSES * CLASSES + 3 * hashed, CLASSES), np.float32)
        weights[1, : CLASSES * CLASSES] = np.tile(self.start, (CLASSES, 1))  # row: previous class, own class
        return weights


def _shared_slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(CLASS_BITS)).astype(np.int64) & (SHARED - 1)


# -- tokens as numbers ------------------------------------------------------------------

_BLOCK = "lots binary, sizes binary, words binary, codes binary"


def blocks_of(df: DataFrame, text: str, key: str, learn: Column, rounds: int) -> DataFrame:
    """Slices of rows as (keys, lots, sizes, words, codes): each row's round (none: -1) and tokens, the slice's distinct
    words, and which of them each token is."""
    kind = dict(df.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part, texts in slices(batch, 1, BLOCK_BYTES):
                keys, sizes, codes = words.numbered(texts)
                yield record(
                    keys=pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), part.column(0)),
                    lots=[np.array(part.column(2).to_pylist(), np.int8).tobytes()], sizes=[sizes.astype("<u4").tobytes()],
                    words=[keys.tobytes()], codes=[codes.astype("<u4").tobytes()],
                )

    lot = F.when(learn & F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(rounds))).otherwise(-1).cast("int")
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), lot.alias("lot"))
    return rows.mapInArrow(work, f"keys array<{kind}>, {_BLOCK}")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array | None, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, lots, sizes, words, codes) of each block; keys only where they were read."""
    for batch in batches:
        for k in range(batch.num_rows):
            raw = {n: batch.column(n)[k] for n in batch.schema.names}
            arrays = (np.frombuffer(raw[n].as_py(), t) for n, t in (("lots", "i1"), ("sizes", "<u4"), ("words", "<u8"), ("codes", "<u4")))
            lots, sizes, words, codes = arrays
            yield raw["keys"].values if "keys" in raw else None, lots, sizes.astype(np.int64), words, codes


def count_words(blocks: DataFrame) -> DataFrame:
    """(word, n): how often each token occurs in all texts to learn from; ``word`` is its key as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lots, sizes, words, codes in _read(batches):
            n = np.bincount(codes[np.repeat(lots >= 0, sizes)], minlength=len(words))
            yield record(word=words[n > 0].view(np.int64), n=n[n > 0])

    rows = blocks.drop("keys").mapInArrow(work, "word long, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def train(blocks: DataFrame, slots: Slots, hashed: int, rounds: int = ROUNDS) -> np.ndarray:
    """The weights (2, rows, columns) of classes and of slots, fitted to all texts to learn from."""
    weights = slots.weights(hashed)
    rows = weights.shape[1]
    for k in range(rounds):

        def learn(batches: Iterator[pa.RecordBatch], weights=weights, k=k) -> Iterator[pa.RecordBatch]:
            learners = [Learner(w) for w in weights]
            for _, lots, sizes, words, codes in _read(batches):
                chosen = lots == k
                codes = codes[np.repeat(chosen, sizes)]
                if len(codes):
                    keys = words[codes]
                    learners[0].learn(keys, sizes[chosen])
                    learners[1].learn(keys, sizes[chosen], slots.of(words)[codes])
            for f, learner in enumerate(learners):
                for at in range(0, rows, BLOCK_ROWS):
                    met = learner.met[at : at + BLOCK_ROWS]
                    row = np.flatnonzero(met)
                    if len(row):
                        move = (learner.weights - weights[f])[at : at + BLOCK_ROWS][row] * met[row, None]
                        yield record(
                            factor=[f], block=[at], rows=[row.astype(np.int32).tobytes()], met=[met[row].tobytes()],
                            move=[move.astype(np.float32).tobytes()],
                        )

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for r in batch.to_pylist():
                    met, move = sums.setdefault(
                        (r["factor"], r["block"]), (np.zeros(BLOCK_ROWS), np.zeros((BLOCK_ROWS, CLASSES), np.float64))
                    )
                    row = np.frombuffer(r["rows"], np.int32)
                    met[row] += np.frombuffer(r["met"], np.float64)
                    move[row] += np.frombuffer(r["move"], np.float32).reshape(-1, CLASSES)
            for (factor, block), (met, move) in sums.items():
                mean = (move / np.maximum(met, 1)[:, None]).astype(np.float32)
                yield record(factor=[factor], block=[block], mean=[mean.tobytes()])

        moves = blocks.drop("keys").mapInArrow(learn, "factor long, block long, rows binary, met binary, move binary")
        sums = moves.repartition("factor", "block").mapInArrow(add, "factor long, block long, mean binary")
        weights = weights.copy()
        for r in sums.collect():  # one row per block: the size of the weights
            mean = np.frombuffer(r["mean"], np.float32).reshape(-1, CLASSES)
            weights[r["factor"], r["block"] : r["block"] + BLOCK_ROWS] += mean[: rows - r["block"]]
    return weights


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of the words that occur at least as often as the least power of two
    that at most FREQUENT words reach."""
    by_power = counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("words")).collect()
    total, least = 0, 64
    for r in sorted(by_power, key=lambda r: -r["power"]):
        total += r["words"]
        if total > FREQUENT:
            break
        least = r["power"]
    table = counts.filter(F.col("n") >= F.lit(1 << min(least, 62))).toArrow()
    keys = table.column("word").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table.column("n").to_numpy()[order]


def score(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, n_tokens, n_known, train_tokens, base_score and score (log10).

    Learns from the rows for which ``learn`` holds.
    """
    blocks = written(blocks_of(df, text, key, learn, ROUNDS), "tokens", **LARGE_ROWS)
    counts = written(count_words(blocks), "word-counts")
    # a row per shared slot of each class
    kind, slot = F.col("word").bitwiseAND(_MASK), F.shiftrightunsigned("word", CLASS_BITS).bitwiseAND(SHARED - 1)
    shared = [
        (r["place"], r["n"], r["v"])
        for r in counts.groupBy((slot * CLASSES + kind).alias("place"))
        .agg(F.sum("n").alias("n"), F.count("*").alias("v"))
        .collect()
    ]
    n_all, v_all = sum(n for _, n, _ in shared), sum(v for _, _, v in shared)
    frequent, n_frequent = _frequent(counts)
    slots, hashed = Slots(frequent, n_frequent, shared), hashed_rows(n_all)
    weights = train(blocks, slots, hashed)
    log_frequent = np.log10(n_frequent + 1.0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, _, sizes, distinct, code in _read(batches):
            keys, slot = distinct[code], slots.of(distinct)[code]
            ends = np.cumsum(sizes)
            start = ends - sizes
            own = (keys & np.uint64(_MASK)).astype(np.int64)
            log = -slots.log[own, slot]
            for w, target, inside in ((weights[0], own, False), (weights[1], slot, True)):
                rows = rows_of(keys, sizes, hashed, inside)
                for at in range(0, len(keys), BATCH_TOKENS):
                    to = slice(at, at + BATCH_TOKENS)
                    chances = class_chances(w, rows[:, to])
                    log[to] += np.log10(chances[np.arange(len(chances)), target[to]] + 1e-30)
            model = np.add.reduceat(log, start)
            at = np.searchsorted(frequent, distinct)
            known = np.zeros(len(distinct), bool)
            inside = at < len(frequent)
            known[inside] = frequent[at[inside]] == distinct[inside]
            value = np.zeros(len(distinct))
            value[known] = log_frequent[at[known]]
            is_known = known[code]
            rare = np.flatnonzero(~is_known)
            offsets = np.concatenate([[0], np.searchsorted(rare, ends)])
            yield record(
                key=names, n_tokens=sizes, model=model,
                frequent=np.add.reduceat(value[code], start),
                n_frequent=np.add.reduceat(is_known.astype(np.int64), start),
                rare=pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[rare].view(np.int64))),
            )

    kind = dict(df.dtypes)[key]
    scored = blocks.mapInArrow(
        work, f"key {kind}, n_tokens long, model double, frequent double, n_frequent long, rare array<long>"
    )
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts, "word")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("log"), F.count("*").alias("n_rare"))
    common = F.col("frequent") + F.coalesce("log", F.lit(0.0))
    return scored.drop("rare").join(rare, "row", "left").select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (common - F.col("n_tokens") * F.lit(math.log10(n_all + v_all + 1))).alias("base_score"),
        (F.col("model") + common).alias("score"),
    )
