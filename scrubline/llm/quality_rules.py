"""Quality rules as a short-circuit cascade.

Every rule may reject a text. On a sample each rule's cost (seconds a text) and
selectivity (share of texts it rejects) are measured; the cascade then tries the
rules by rejections per second, and the first rejection ends the work on a text.
The order changes only the time: a text is kept when no rule rejects it.

Defined results: a null text is empty; an empty text has no words and is
rejected; repeated rows are judged alike; an empty table gives an empty table;
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import as_bytes, record, slices

#: Texts that the order of the rules is measured on, about. It steers time, never results.
SAMPLE_TEXTS = 400

WINDOW = 5
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_NO_WORD_CHARS = _SPACE + bytes(range(0x80, 0xC0))  # space, and bytes that continue a code point


class Text:
    """One text; each figure is worked out when a rule first asks for it."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.data.translate(None, _NO_WORD_CHARS))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.data.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a window of five words that the text has twice or more."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in self.words], np.int64)
        if len(seen) == len(ids):
            return 0
        pair = _numbered(ids[:-1] * len(seen) + ids[1:])
        four = _numbered(pair[:-2] * (int(pair.max()) + 1) + pair[2:])
        window = _numbered(four[:n] * len(seen) + ids[WINDOW - 1 :])
        twice = np.bincount(window)[window] > 1
        edges = np.zeros(self.n_words + 1, np.int32)
        edges[:n] += twice
        edges[WINDOW : WINDOW + n] -= twice
        return int(np.count_nonzero(np.cumsum(edges[:-1])))


def _numbered(codes: np.ndarray) -> np.ndarray:
    return np.unique(codes, return_inverse=True)[1]


@dataclass(frozen=True)
class Rule:
    """``rejects(text)`` is true for texts to drop."""

    name: str
    rejects: Callable[[Text], bool]


#: The rules that fix ``base_failed``.
BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 10),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
)

#: Further rules of the cascade. Their limits lie far outside ordinary prose.
MORE_RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 25 * t.n_words),
    Rule("repeated_lines", lambda t: 100 * t.n_dup_lines > 30 * len(t.lines)),
    Rule("no_letters", lambda t: 10 * sum(w.isdigit() for w in t.words) > 5 * t.n_words),
)

RULES = BASE_RULES + MORE_RULES


def measure_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> list[dict]:
    """Cost and selectivity of each rule on a sample, best first.

    The sample is drawn by Spark from the whole table; a few numbers per rule
    reach the driver.
    """
    total = df.count()
    fraction = min(1.0, SAMPLE_TEXTS / max(1, total))
    sample = df.select(F.col(text).alias("text")).sample(fraction, seed=11)

    def time_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, 0):
                for k, rule in enumerate(rules):
                    start = time.perf_counter()
                    rejected = sum(bool(rule.rejects(Text(t))) for t in texts)
                    spent = time.perf_counter() - start
                    yield record(rule=[k], seconds=[spent], rejected=[rejected], texts=[len(texts)])

    found = (
        sample.mapInArrow(time_rules, "rule long, seconds double, rejected long, texts long")
        .groupBy("rule")
        .agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"), F.sum("texts").alias("texts"))
        .collect()
    )
    by_rule = {r["rule"]: r for r in found}
    out = []
    for k, rule in enumerate(rules):
        r = by_rule.get(k)
        cost = max(r["seconds"] / r["texts"], 1e-9) if r else 1.0
        rejects = r["rejected"] / r["texts"] if r else 0.0
        out.append({"rule": rule, "cost": cost, "rejects": rejects, "gain": rejects / cost})
    return sorted(out, key=lambda x: (-x["gain"], x["cost"]))


def cascade(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules in the order in which the cascade tries them."""
    return tuple(x["rule"] for x in measure_rules(df, text, rules))


def _kept(text: Text, order: tuple[Rule, ...]) -> bool:
    return not any(rule.rejects(text) for rule in order)


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text no rule rejects, all columns as they are."""
    order, at = cascade(df, text, rules), df.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(at))
            yield batch.filter(pa.array([_kept(Text(t), order) for t in texts], pa.bool_()))

    return df.mapInArrow(keep, df.schema)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``df``: its key, its figures, and the verdicts."""
    order = cascade(df, text, rules)
    more = tuple(r for r in order if r not in BASE_RULES)
    base = tuple(r for r in order if r in BASE_RULES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                docs = [Text(t) for t in texts]
                failed = [not _kept(t, base) for t in docs]
                figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
                columns = {f: pa.array([getattr(t, f) for t in docs], pa.int64()) for f in figures}
                kept = [not f and _kept(t, more) for t, f in zip(docs, failed)]
                yield record(key=part.column(0), **columns, base_failed=failed, kept=kept)

    kind = dict(df.dtypes)[key]
    return (
        df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        .mapInArrow(
            measure,
            f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
            "n_repeat_words long, base_failed boolean, kept boolean",
        )
        .withColumnRenamed("key", key)
    )
