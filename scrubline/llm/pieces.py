"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the model's compiled character map: at each position the longest
prefix in the map's trie is replaced, or else one character is kept, and every byte
written remembers the byte offset it came from. The normalised text is encoded by the
model's merges, best score first and leftmost among equals, and each piece is projected through
these offsets to the bytes of the original that it stands for.

Merges never cross the start of a word (no piece has a space mark after another character;
that is checked), so each distinct word is encoded once per task and batches of words are
merged together in numpy. Characters outside the vocabulary become byte pieces.

Defined results: a null text is empty; an empty text has no pieces (but the end id, if
asked for); repeated rows are encoded alike; an empty table gives an empty table; other columns
take no part.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import record, slices

SPACE_MARK = "▁"

#: Words that a task remembers before it starts over; bounds its memory.
REMEMBERED = 500_000

#: Longer words are merged one by one with a heap.
LONG_WORD = 48

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """The compiled map: a double-array trie of byte strings and the texts that replace them."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        self.first = {b for b in range(256) if self.units and self._child(0, b) is not None}

    def _base(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _child(self, node: int, byte: int) -> int | None:
        at = self._base(node) ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes consumed) of the longest key at this position."""
        node, found = 0, None
        for end in range(at, len(data)):
            node = self._child(node, data[end])
            if node is None:
                break
            if self.units[node] >> 8 & 1:
                found = self.units[self._base(node)] & 0x7FFFFFFF, end + 1 - at
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]


class PieceModel:
    """A BPE model with byte pieces, read from the bytes of its file."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2 as formats

        proto = formats.ModelProto()
        proto.ParseFromString(blob)
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        kinds = [p.type for p in proto.pieces]
        if trainer.model_type != 2 or not trainer.byte_fallback or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("only byte-pair models with byte pieces and no user-defined or unused ones are read")
        if trainer.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("spaces must be marked in front of words")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.pieces = [p.piece for p in proto.pieces]
        self.end_id = next(i for i, p in enumerate(self.pieces) if p == (trainer.eos_piece or "</s>"))
        normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in normal):
            raise ValueError("a piece has a space mark inside")
        self.byte_id = np.zeros(256, np.int32)
        self.byte_of = np.full(len(kinds), -1)
        for i, (p, k) in enumerate(zip(self.pieces, kinds)):
            if k == BYTE:
                self.byte_id[int(p[3:5], 16)], self.byte_of[i] = i, int(p[3:5], 16)
        marked = SPACE_MARK.encode()
        texts = [
            bytes([self.byte_of[i]]) if k == BYTE else p.encode().replace(marked, b" ") if k == NORMAL else b""
            for i, (p, k) in enumerate(zip(self.pieces, kinds))
        ]  # as decoded
        self.norm_len = np.array(
            [1 if k == BYTE else len(p.encode()) if k == NORMAL else 0 for p, k in zip(self.pieces, kinds)]
        )
        self.orig_len = np.array([len(b) for b in texts])
        self.text_start = np.cumsum(self.orig_len) - self.orig_len
        self.texts = np.frombuffer(b"".join(texts), np.uint8)
        scores = np.array([p.score for p in proto.pieces], np.float64)
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)  # equal scores share one
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.size = len(kinds)
        pairs = {
            normal[p[:c]] * self.size + normal[p[c:]]: i
            for p, i in normal.items()
            for c in range(1, len(p))
            if p[:c] in normal and p[c:] in normal
        }
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pair.tolist()] + [0], np.int64)
        self.pair = np.append(self.pair, np.int64(1) << 62)

    # -- normalising ------------------------------------------------------------------

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them, and their end, the offset it came from."""
        mark = SPACE_MARK.encode()
        steps, at = [], 0
        while at < len(data):
            found = self.map.longest(data, at) if data[at] in self.map.first else None
            if found is None:
                width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                found = data[at : at + width], width
            steps.append((found[0], at))
            at += found[1]
        begin = 0
        if self.squeeze:
            while begin < len(steps) and steps[begin][0] == b" ":
                begin += 1
        out, source = [], []
        if begin == len(steps):
            return b"", np.array([len(data)], np.int64)

        def write(piece: bytes, offset: int) -> None:
            out.append(piece)
            source.extend([offset] * len(piece))

        if self.dummy:
            write(mark, steps[begin][1])
        after_space = self.squeeze
        for piece, offset in steps[begin:]:
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                write(piece.replace(b" ", mark), offset)
                after_space = piece.endswith(b" ")
            after_space = after_space and self.squeeze
        text, end = b"".join(out), len(data)
        if self.squeeze:
            while text.endswith(mark):
                text = text[: -len(mark)]
                end = source[len(text)]
        return text, np.array([*source[: len(text)], end], np.int64)

    # -- merging ----------------------------------------------------------------------

    def _merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.merged[at], -1)

    def _ranks(self, merged: np.ndarray) -> np.ndarray:
        return np.where(merged >= 0, self.rank[merged], 1 << 40)

    def _merge_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the words in the rows of a matrix; gives the rows and how many pieces each has.

        Negative entries stand for characters that take part in no merge; -1 is no entry.
        """
        out, count = rows.copy(), (rows != -1).sum(axis=1)
        active = np.arange(len(rows))
        sym = np.concatenate([rows, np.full((len(rows), 1), -1, rows.dtype)], axis=1)
        merged = self._merge(sym[:, :-1], sym[:, 1:])
        rank = self._ranks(merged)
        cols = np.arange(sym.shape[1])
        while len(active):
            best = rank.argmin(axis=1)
            line = np.arange(len(active))
            going = rank[line, best] < 1 << 40
            if not going.all():
                out[active[~going]] = sym[~going, :-1]
                active, sym, merged, rank = active[going], sym[going], merged[going], rank[going]
                best, line = best[going], np.arange(len(active))
                if not len(active):
                    break
            made = merged[line, best]
            shift = np.minimum(cols + (cols > best[:, None]), cols[-1])
            sym = np.take_along_axis(sym, shift, axis=1)
            merged = np.take_along_axis(merged, shift[:, :-1].clip(max=merged.shape[1] - 1), axis=1)
            rank = np.take_along_axis(rank, shift[:, :-1].clip(max=rank.shape[1] - 1), axis=1)
            merged[:, -1], rank[:, -1] = -1, 1 << 40
            sym[line, best] = made
            count[active] -= 1
            for place in (best - 1, best):
                ok = (place >= 0) & (place < merged.shape[1])
                where, place = line[ok], place[ok]
                new = self._merge(sym[where, place], sym[where, place + 1])
                merged[where, place], rank[where, place] = new, self._ranks(new)
        return out, count

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """Merges one long word with a heap of pairs."""
        sym, n = list(symbols), len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(lefts: list[int], rights: list[int]) -> None:
            made = self._merge(np.array([sym[i] for i in lefts]), np.array([sym[i] for i in rights]))
            for a, b, m in zip(lefts, rights, made.tolist()):
                if m >= 0:
                    heapq.heappush(heap, (int(self.rank[m]), a, sym[a], sym[b], m))

        offer(list(range(n - 1)), list(range(1, n)))
        while heap:
            _, a, left, right, made = heapq.heappop(heap)
            b = after[a]
            if sym[a] != left or b < 0 or sym[b] != right:
                continue
            sym[a], sym[b], after[a] = made, None, after[b]
            if after[b] >= 0:
                before[after[b]] = a
            lefts = [x for x in (before[a], a) if x >= 0 and after[x] >= 0]
            if lefts:
                offer(lefts, [after[x] for x in lefts])
        return [s for s in sym if s is not None]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.char_id[points].astype(np.int64)
        symbols = np.where(symbols < 0, -2 - points, symbols)  # an unknown character, kept as such
        start = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        count, parts, at = np.zeros(len(words), np.int64), [], 0
        while at < len(order):
            width = int(sizes[order[at]])
            width = width if width <= 12 else 16 if width <= 16 else 24 if width <= 24 else LONG_WORD
            end = int(np.searchsorted(sizes[order], width, "right"))
            some = order[at : max(end, at + 1)]
            at += len(some)
            if sizes[some[0]] > LONG_WORD:
                ids = np.array(self._merge_long(symbols[start[some[0]] :][: sizes[some[0]]].tolist()))
                count[some] = len(ids)
            else:
                place = start[some][:, None] + np.arange(width)
                inside = np.arange(width) < sizes[some][:, None]
                rows = np.where(inside, symbols[np.minimum(place, len(symbols) - 1)], -1)
                rows, count[some] = self._merge_rows(rows)
                ids = rows[np.arange(width) < count[some][:, None]]
            parts.append(ids)
        flat = np.concatenate([np.zeros(0, np.int64), *parts])  # in order of size
        sorted_count = count[order]
        first = np.zeros(len(words), np.int64)
        first[order] = np.cumsum(sorted_count) - sorted_count
        flat = flat[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(flat))]
        if len(flat) and flat.min() < 0:  # unknown characters as bytes
            unknown = np.flatnonzero(flat < 0)
            pieces = [self.byte_id[np.frombuffer(chr(-2 - i).encode(), np.uint8)] for i in flat[unknown].tolist()]
            longer = np.ones(len(flat), np.int64)
            longer[unknown] = [len(x) for x in pieces]
            word = np.repeat(np.arange(len(words)), count)
            count = np.bincount(word, longer, len(words)).astype(np.int64)
            known, flat = flat, np.repeat(flat, longer)
            flat[np.repeat(known, longer) < 0] = np.concatenate(pieces)
        return flat.astype(np.int32), count

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The pieces' text one after the other, and where each piece ends in it."""
        size = self.orig_len[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.text_start[ids] - (ends - size), size) + np.arange(int(size.sum()))
        return self.texts[at].tobytes(), ends


@functools.lru_cache(maxsize=1)
def _encoder(blob: bytes) -> Encoder:
    """A worker keeps the words it knows from one task to the next."""
    return Encoder(blob)


class Encoder:
    """Encodes texts; remembers words."""

    def __init__(self, blob: bytes):
        self.model = PieceModel(blob)
        newline = "" if self.model.char_id[10] >= 0 else "\n"  # an unknown character splits words
        self._words = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}{newline}]+|{SPACE_MARK}+" + (newline and f"|{newline}"))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.decoded: list[bytes] = []

    def _codes(self, words: list[str]) -> list[int]:
        known, before = self.known, len(self.known)
        codes = [known.setdefault(w, len(known)) for w in words]
        if len(known) > before:
            ids, count = self.model.encode_words(list(islice(known, before, None)))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
            self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count])
            text, ends = self.model.decode(ids)
            end = np.concatenate([[0], ends])[np.cumsum(count)].tolist()
            self.decoded += [text[s:e] for s, e in zip([0, *end], end)]
        return codes

    def encode(self, texts: list[bytes], end_id: bool) -> dict[str, np.ndarray | list[bytes]]:
        """ids, begins, ends (all texts one after the other), offsets (of the texts), and decoded."""
        model, mark = self.model, SPACE_MARK
        words, n_words, maps = [], [], []
        for data in texts:
            if not data:
                found, source = [], None
            elif model.squeeze or not model.dummy or model.map.first or SPACE_MARK.encode() in data:
                text, source = model.normalize(data)
                found = self._words.findall(text.decode())
            else:  # nothing but spaces changes
                source = None
                found = self._words.findall(mark + data.decode("utf-8", "replace").replace(" ", mark))
            words += found
            n_words.append(len(found))
            maps.append(source)
        codes = self._codes(words)
        decoded = list(map(self.decoded.__getitem__, codes))
        codes = np.array(codes, np.int64)
        count = self.count[codes]
        total = int(count.sum())
        ids = self.ids[np.repeat(self.start[codes] - (np.cumsum(count) - count), count) + np.arange(total)]
        word_ends = np.cumsum(n_words)
        ends_of_words = np.concatenate([[0], np.cumsum(count)])
        edges = ends_of_words[np.concatenate([[0], word_ends])]

        # projected to the original bytes: lengths where only spaces changed, else through the map
        width = model.orig_len[ids]
        high = np.flatnonzero(model.byte_of[ids] >= 0xC0)
        for at in high.tolist():  # the last byte piece of a character stands for all of it
            lead = int(model.byte_of[ids[at]])
            n = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            width[at : at + n] = [0] * (n - 1) + [n]
        ends = np.cumsum(width)
        begins = ends - width
        texts_out, word_at = [], 0
        for k, n in enumerate(n_words):
            lo, hi = edges[k], edges[k + 1]
            text = b"".join(decoded[word_at : word_at + n])
            if n and model.dummy and words[word_at].startswith(mark):
                text = text[1:]
            texts_out.append(text)
            word_at += n
            if lo == hi:
                continue
            if maps[k] is None:  # the first mark was put there
                base = begins[lo] + 1
                begins[lo:hi] -= base
                ends[lo:hi] -= base
                begins[lo] = 0
            else:
                written_to = np.cumsum(model.norm_len[ids[lo:hi]])
                ends[lo:hi] = maps[k][written_to]
                begins[lo:hi] = maps[k][np.concatenate([[0], written_to[:-1]])]
        if len(self.known) > REMEMBERED:
            self._forget()
        if end_id:
            sizes = np.array([len(t) for t in texts], np.int64)
            ids = np.insert(ids, edges[1:], model.end_id)
            begins, ends = np.insert(begins, edges[1:], sizes), np.insert(ends, edges[1:], sizes)
            edges = edges + np.arange(len(edges))
        return {"ids": ids, "begins": begins, "ends": ends, "offsets": edges, "decoded": texts_out}


def encode(
    df: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", end_id: bool = True
) -> DataFrame:
    """One row per row of ``df``: key, ids, begins and ends (byte spans of the pieces), decoded (the pieces' text).

    ``model`` is the content of a model file.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            for part, texts in slices(batch, 1):
                found = encoder.encode(texts, end_id)
                offsets = pa.array(found["offsets"], pa.int32())
                lists = {
                    c: pa.ListArray.from_arrays(offsets, pa.array(found[c].astype(np.int32)))
                    for c in ("ids", "begins", "ends")
                }
                yield record(key=part.column(0), **lists, decoded=pa.array(found["decoded"], pa.binary()))

    kind = dict(df.dtypes)[key]
    return (
        df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        .mapInArrow(work, f"key {kind}, ids array<int>, begins array<int>, ends array<int>, decoded binary")
        .withColumnRenamed("key", key)
    )
