"""Personal data: candidate spans, boosted trees, calibrated thresholds. DataFrame functions only.

Base spans come from four fixed patterns with checks (address, network address, card,
phone) and always stay. Beside them, looser generators propose candidate spans, which may
overlap: addresses with "[at]" and "dot", network addresses with bracketed dots, cards of any
length, phones of any spacing. A candidate is verified if, its spelling undone, it passes a check that
needs no base span (Luhn, address with a known kind of domain, four octets, numbering plan), and is
described by a few features of its format and context, each with a handful of values,
which do not tell the check's outcome. So there are at most ``CODES`` kinds of candidates.

Their counts, by whether they are verified, are taken over the whole table, and boosted trees are
fitted to these counts on the driver: the trees learn where checks pass more often than by
accident. Scores are calibrated on rows that the trees did not see. From the calibrated share v of
verified candidates of a code and the share r of unrelated text that passes the kind's check by
accident (one in ten for Luhn), the share of real ones among the verified is
(v - r) / ((1 - r) v); a verified candidate is a span when that is ``REAL`` or more. One that fails its check
(a typing error) is a span only where nearly all such candidates are verified (``PRECISION``). Candidates that overlap
a base span, or one already accepted for an earlier kind, are dropped.

Positions: the text is split at the matches, and lengths of the parts add up to
code-point offsets, end exclusive; context is what lies between a match and the one before. All
patterns match possessively and start only where a run starts. Spark copies what a fold gathers at every step, so
nothing gathers in one: running sums and extremes come from blocks, and time grows with the text and its matches.

Defined results: a null text is empty; an empty text has no spans; repeated rows have the same
spans; an empty table gives an empty table; a table without candidates has base spans
only; other columns take no part (``redact`` passes them through).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.frames import named
from scrubline.llm.common import whole_text, written

KINDS = ("email", "ip", "card", "phone")

# fixed values: what the base patterns match, written so that no match is searched twice
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Generators: what looks like it might be one.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++"
    r"(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]++)*+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:(?:\.|\[\.\]|\x20\.\x20)[0-9]++){3,5}+",
    "card": r"[0-9](?:[\x20.-]?[0-9]){11,}+",
    "phone": r"(?:\G|(?<![0-9+(]))(?:\+|00)?+[(]?+[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
}

#: A text without any of these has no base span of the kind.
_HAS_BASE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

#: A text without any of these has no candidate of the kind.
_HAS = {
    "email": r"@|[\[(]at[\])]|\x20dot\x20",
    "ip": r"[0-9]\x20?\[?\.",
    "card": r"[0-9][\x20.-]?[0-9][\x20.-]?[0-9]",
    "phone": r"[0-9][\x20().-]{0,2}[0-9]",
}

#: Words before a candidate that speak for its kind.
CUES = {
    "email": "mail|contact|write|reach",
    "ip": "ip|host|server|address|from|login",
    "card": "card|visa|master|credit|pay|account",
    "phone": "tel|phone|call|fax|mobil|cell|dial",
}

#: Features and how many values each has. Together they make a candidate's code.
FEATURES = {"kind": 4, "size": 5, "parts": 4, "left": 4, "right": 4, "cue": 2, "shape": 3}
CODES = int(np.prod(list(FEATURES.values())))

#: A code is accepted, verified or not, when its calibrated chance to be verified is at least this.
PRECISION = 0.98

ROUNDS, RATE, DEPTH, L2 = 60, 0.3, 3, 1.0

#: A verified candidate is a span when the calibrated share of real ones among its like is at least this.
REAL = 0.9

#: How much of what is no personal data passes the check of a kind by accident: Luhn's digit, and two
#: digits of 2 to 9; for addresses a guess on the safe side.
CHANCE = {"email": 0.05, "ip": 0.05, "card": 0.1, "phone": 0.64}

#: Values of a block of running sums.
RUN_BLOCK = 64

#: Code points of a block of text in which pieces are looked up.
TEXT_BLOCK_BITS = 12
CONTEXT = 24  # code points before a candidate in which cues are looked for

_SPAN = "struct<s:int,e:int,m:string,b:string,a:string>"


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, start: int, op) -> Column:
    """For each integer of the array, ``op`` over ``start`` and all before it, block by block."""
    first = F.lit(start)
    fold = lambda v: F.aggregate(v, first, lambda a, b: op(a, b))

    def of(blocks: Column, totals: Column) -> Column:
        def block(x: Column, b: Column) -> Column:
            inside = lambda so_far: F.transform(x, lambda v, i: op(so_far, fold(F.slice(x, F.lit(1), i))))
            return _let(fold(F.slice(totals, F.lit(1), b)), inside)

        return F.flatten(F.transform(blocks, block))

    def cut(v: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), (F.size(v) / RUN_BLOCK).cast("int")),
            lambda b: F.slice(v, b * RUN_BLOCK + 1, F.lit(RUN_BLOCK)),
        )

    return _let(_let(values, cut), lambda blocks: _let(F.transform(blocks, fold), lambda totals: of(blocks, totals)))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _matches(text: Column, pattern: str, has: str) -> Column:
    """[(s, e, m, b, a)]: the pattern's matches, leftmost and non-overlapping, with what stands before and after."""

    def one(x: Column) -> Column:
        s = x["at"] + F.length(x["g"])
        before, after = F.substring(x["g"], -CONTEXT, CONTEXT), F.substring(x["next"], 1, 1)
        e = s + F.length(x["m"])
        return F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), before.alias("b"), after.alias("a"))

    def placed(parts: Column) -> Column:
        sizes = F.transform(parts, lambda x: F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0)))
        at = lambda x, k: F.struct(
            x["g"].alias("g"), x["m"].alias("m"), x["next"].alias("next"), k.alias("at")
        )
        return F.transform(
            F.filter(F.zip_with(parts, _running(sizes, 0, _sum), at), lambda x: x["m"].isNotNull()), one
        )

    def found(gaps: Column) -> Column:
        zipped = F.arrays_zip(
            gaps.alias("g"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
            F.slice(gaps, 2, F.size(gaps)).alias("next"),
        )
        return _let(zipped, placed)

    return F.when(text.rlike(has), _let(F.split(text, pattern, -1), found)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, x).when(x < 5, 2 * x).otherwise(2 * x - 9)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":

        def small(part: Column) -> Column:
            value = F.regexp_replace(part, "^0+", "")
            return F.when(F.length(value) > 3, False).otherwise(F.coalesce(value.try_cast("int"), F.lit(0)) <= 255)

        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        return F.when(n.between(16, 19), _let(_digits(m), _luhn)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _checked(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda x: _valid(kind, x["m"]))


def base_spans(text: Column) -> dict[str, Column]:
    """[(s, e, m)] per kind: the matches of the base patterns that pass their check."""
    return {k: _checked(k, _matches(text, BASE[k], _HAS_BASE[k])) for k in KINDS}


def _class(char: Column) -> Column:
    """0 nothing or space, 1 letter, 2 digit, 3 other."""
    return (
        F.when(char.rlike(r"^\s?$"), 0).when(char.rlike(r"^[\p{L}_]$"), 1).when(char.rlike(r"^[0-9]$"), 2).otherwise(3)
    )


# fixed values: how an address is spelt out, and the ends of domains that a spelt one may have
AT, DOT = r"\x20?[\[(]at[\])]\x20?|\x20at\x20", r"\x20?[\[(]dot[\])]\x20?|\x20dot\x20"
ENDS = "[A-Za-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|dev|app"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
NATIONAL = r"^(?:1[\x20.-])?[(]?[2-9][0-9]{2}[)]?[\x20.-]{1,2}[2-9][0-9]{2}[\x20.-][0-9]{4}$"
ABROAD = r"^(?:\+|00)[(]?[1-9]"


def _verified(kind: str, m: Column, d: Column) -> Column:
    """Whether a candidate ``m`` with the digits ``d`` passes the check of its kind once its spelling is undone."""
    n = F.length(d)
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(m, AT, "@"), DOT, ".")
        name = r"^[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@(?:[A-Za-z0-9-]++\.)+"
        return F.when(F.length(m) <= 320, plain.rlike(f"{name}(?:{ENDS})$")).otherwise(F.lit(False))
    if kind == "ip":
        return F.regexp_replace(m, r"\[\.\]|\x20\.\x20", ".").rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(d)).otherwise(F.lit(False))
    abroad = m.rlike(ABROAD) & F.when(m.startswith("00"), n.between(10, 17) & m.rlike("[^0-9]")).otherwise(n.between(8, 15))
    return abroad | m.rlike(NATIONAL)


def _code(kind: str, x: Column) -> Column:
    """The candidate's features as one number below CODES."""
    m, k = x["m"], KINDS.index(kind)
    n = F.length(x["d"])
    groups = F.size(F.split(m, r"[^0-9]+"))
    if kind == "email":
        local = F.regexp_extract(m, r"^[A-Za-z0-9._%+-]+", 0)
        size = F.least(F.length(local) / 6, F.lit(4)).cast("int")
        parts = F.least(F.size(F.split(m, r"\.|dot")), F.lit(4)) - 1
        shape = F.when(m.contains("@"), 0).when(m.rlike(r"[\[(]"), 1).otherwise(2)
    elif kind == "ip":
        size = F.least(n / 4, F.lit(4)).cast("int")
        parts = F.least(groups, F.lit(7)) - 4
        shape = F.when(m.rlike(r"[\[\x20]"), 1).when(m.rlike("[0-9]{4}"), 2).otherwise(0)
    elif kind == "card":
        size = F.when(n < 13, 0).when(n < 16, 1).when(n == 16, 2).when(n < 20, 3).otherwise(4)
        parts = F.when(groups == 1, 0).when(m.rlike(r"^([0-9]{4}[^0-9]){3}[0-9]+$"), 1).when(groups < 6, 2).otherwise(3)
        shape = F.when(m.rlike("^4"), 0).when(m.rlike("^[356]"), 1).otherwise(2)
    else:
        size = F.when(n < 9, 0).when(n < 11, 1).when(n == 11, 2).when(n < 16, 3).otherwise(4)
        parts = F.least(groups, F.lit(4)) - 1
        shape = F.when(m.contains("("), 0).when(groups > 2, 1).otherwise(2)
    cue = F.lower(x["b"]).rlike(CUES[kind]).cast("int")
    values = {
        "kind": F.lit(k), "size": size, "parts": parts, "left": _class(F.substring(x["b"], -1, 1)), "right": _class(x["a"]),
        "cue": cue, "shape": shape,
    }
    code = F.lit(0)
    for name, n_values in FEATURES.items():
        code = code * n_values + F.greatest(F.least(values[name].cast("int"), F.lit(n_values - 1)), F.lit(0))
    return code


def candidate_spans(text: Column) -> dict[str, Column]:
    """[(s, e, code, ok)] per kind; ``ok`` tells a verified one."""

    def of(kind: str) -> Column:
        fields = ("s", "e", "m", "b", "a")
        spans = F.transform(
            _matches(text, LOOSE[kind], _HAS[kind]),
            lambda x: F.struct(*[x[f].alias(f) for f in fields], _digits(x["m"]).alias("d")),
        )
        return F.transform(
            spans,
            lambda x: F.struct(
                x["s"].alias("s"), x["e"].alias("e"), _code(kind, x).alias("code"),
                F.coalesce(_verified(kind, x["m"], x["d"]), F.lit(False)).alias("ok"),
            ),
        )

    return {k: of(k) for k in KINDS}


# -- boosted trees over counts ----------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """``chance[code]`` is the calibrated chance that such a candidate is verified; ``real[code]`` the share of
    personal data among the verified. Codes in ``accepted`` are spans in any case, those in ``if_verified`` when verified.
    """

    chance: np.ndarray
    real: np.ndarray
    accepted: tuple[int, ...]
    if_verified: tuple[int, ...]


def _table() -> np.ndarray:
    """(CODES, features): the feature values of every code."""
    return np.stack(np.unravel_index(np.arange(CODES), tuple(FEATURES.values())), axis=1)


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, inside: np.ndarray, every: np.ndarray, depth: int, out):
    """Adds a regression tree's leaf values to ``out`` (over every code), grown on the codes in ``inside``."""
    g, h = grad[inside].sum(), hess[inside].sum()
    best, gain = None, 1e-6
    if depth:
        for f in range(x.shape[1]):
            values = x[inside, f]
            gs = np.bincount(values, grad[inside], FEATURES_N[f])
            hs = np.bincount(values, hess[inside], FEATURES_N[f])
            for kind, left_g, left_h in (("is", gs, hs), ("upto", np.cumsum(gs), np.cumsum(hs))):
                score = left_g**2 / (left_h + L2) + (g - left_g) ** 2 / (h - left_h + L2) - g * g / (h + L2)
                score[(left_h <= 1e-9) | (h - left_h <= 1e-9)] = 0
                v = int(score.argmax())
                if score[v] > gain:
                    best, gain = (f, kind, v), score[v]
    if best is None:
        out[every] += -RATE * g / (h + L2)
        return
    f, kind, v = best
    side = (lambda rows: x[rows, f] == v) if kind == "is" else (lambda rows: x[rows, f] <= v)
    _tree(x, grad, hess, inside[side(inside)], every[side(every)], depth - 1, out)
    _tree(x, grad, hess, inside[~side(inside)], every[~side(every)], depth - 1, out)


FEATURES_N = list(FEATURES.values())
_KIND_OF = _table()[:, 0]


def _chance(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def boost(seen: np.ndarray, confirmed: np.ndarray) -> np.ndarray:
    """Scores of all codes by gradient-boosted trees fitted to the counts of codes."""
    x, everything = _table(), np.arange(CODES)
    score, inside = np.zeros(CODES), np.flatnonzero(seen)
    for _ in range(ROUNDS if len(inside) else 0):
        p = _chance(score)
        _tree(x, seen * p - confirmed, seen * p * (1 - p), inside, everything, DEPTH, score)
    return score


def calibrate(score: np.ndarray, seen: np.ndarray, confirmed: np.ndarray) -> np.ndarray:
    """Chances by a logistic curve of the score (Platt), fitted to held-out counts."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _chance(a * score + b)
        r, w = seen * p - confirmed, seen * p * (1 - p) + 1e-12 * (seen > 0)
        g = np.array([(r * score).sum() + 1e-3 * (a - 1), r.sum() + 1e-3 * b])
        h = np.array([[(w * score * score).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-3]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - move[0], b - move[1]
    return _chance(a * score + b)


def fit(counts: np.ndarray) -> Model:
    """``counts[held_out, verified, code]``: how many candidates of the whole table were such."""
    seen, verified = counts.sum(axis=1), counts[:, 1]
    score = boost(seen[0].astype(float), verified[0].astype(float))
    chance = calibrate(score, seen[1].astype(float), verified[1].astype(float))
    if not verified.sum():
        chance = np.zeros(CODES)
    total, x, met_at_all = verified.sum(axis=0), _table(), seen.sum(axis=0) > 0
    by_accident = np.array([CHANCE[k] for k in KINDS])[x[:, 0]]
    real = np.clip((chance - by_accident) / ((1 - by_accident) * np.maximum(chance, 1e-9)), 0, 1)
    # What fails its check rides on a format in which passing is the norm: each of its code's values must have been
    # verified for the kind, and codes met often but never verified do not count on their neighbours' account.
    known = np.ones(CODES, bool)
    for f in range(1, x.shape[1]):
        met = np.zeros((FEATURES_N[0], FEATURES_N[f]))
        np.add.at(met, (x[:, 0], x[:, f]), total)
        known &= met[x[:, 0], x[:, f]] > 0
    never = (seen.sum(axis=0) >= 5) & (total == 0)
    accepted = np.flatnonzero((chance >= PRECISION) & known & ~never & met_at_all)
    return Model(chance, real, tuple(accepted.tolist()), tuple(np.flatnonzero((real >= REAL) & met_at_all).tolist()))


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, base spans b_<kind>, candidates c_<kind>. Written once, without the texts.
    """
    t = F.col("_text")
    rows = df.select(F.col(key), whole_text(text).alias("_text"))
    bare = lambda v: F.transform(v, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    found = rows.select(
        key,
        *[bare(v).alias(f"b_{k}") for k, v in base_spans(t).items()],
        *[v.alias(f"c_{k}") for k, v in candidate_spans(t).items()],
    )
    return written(found, "candidates")


def train(found: DataFrame, key: str = "doc_id") -> Model:
    """Fits the model to the counts of all candidates; every second row by hash is held out from the trees."""
    def verified(kind: str) -> Column:
        return F.transform(f"c_{kind}", lambda x: F.struct(x["code"].alias("code"), x["ok"].cast("int").alias("y")))

    parts = [verified(k) for k in KINDS]
    held_out = F.pmod(F.xxhash64(key, *[f"c_{k}" for k in KINDS]), F.lit(2)).alias("held_out")
    rows = found.select(held_out, F.explode(F.concat(*parts)).alias("c"))
    counts = np.zeros((2, 2, CODES))
    for r in rows.groupBy("held_out", "c.code", "c.y").count().collect():  # at most 4 * CODES rows
        counts[r["held_out"], r["y"], r["code"]] = r["count"]
    return fit(counts)


def _of_kind(spans: Column, kind: str) -> Column:
    return F.transform(
        spans, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
    )


def _base() -> Column:
    return F.concat(*[_of_kind(F.col(f"b_{k}"), k) for k in KINDS])


_LAST = 2**31 - 1


def _free(spans: Column, kept: Column) -> Column:
    """Those of ``spans`` (kind, s, e) that overlap none of ``kept``."""
    order = lambda taken: lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), F.lit(taken).alias("taken"), x["kind"].alias("kind")
    )

    def of(both: Column) -> Column:
        ends = F.transform(both, lambda x: F.when(x["taken"], x["e"]).otherwise(F.lit(0)))
        starts = F.transform(F.reverse(both), lambda x: F.when(x["taken"], x["s"]).otherwise(F.lit(_LAST)))
        around = F.arrays_zip(
            both.alias("x"),
            _running(ends, 0, F.greatest).alias("end"),
            F.reverse(_running(starts, _LAST, F.least)).alias("start"),
        )
        free = F.filter(around, lambda y: ~y["x"]["taken"] & (y["end"] <= y["x"]["s"]) & (y["start"] >= y["x"]["e"]))
        return F.transform(
            free, lambda y: F.struct(*[y["x"][f].alias(f) for f in ("kind", "s", "e")])
        )

    both = F.array_sort(F.concat(F.transform(kept, order(True)), F.transform(spans, order(False))))
    return F.when(F.size(spans) > 0, _let(both, of)).otherwise(F.slice(spans, 1, 0))


def _with_spans(found: DataFrame, model: Model) -> DataFrame:
    """``found`` and "spans", [(kind, s, e)]: base spans and accepted candidates that overlap neither them nor those
    of earlier kinds. Kinds are columns one after another, as Spark resolves nested functions a level at a time.
    """

    def passed(kind: str) -> Column:
        of = lambda codes: F.array(
            *[F.lit(c) for c in codes if _KIND_OF[c] == KINDS.index(kind)]
        ).cast("array<int>")
        always, verified = of(model.accepted), of(model.if_verified)
        good = lambda x: F.array_contains(always, x["code"]) | (x["ok"] & F.array_contains(verified, x["code"]))
        return _of_kind(F.filter(f"c_{kind}", good), kind)

    kept = found.withColumn("spans", _base())
    for kind in KINDS:
        kept = kept.withColumn("passed", passed(kind))
        kept = kept.withColumn("spans", F.concat("spans", _free(F.col("passed"), F.col("spans")))).drop("passed")
    return kept.withColumn("spans", F.array_sort("spans"))


def find(found: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, base and spans: arrays of (kind, s, e) in order of kind and start."""
    rows = found.select(F.col(key).alias("key"), *[f"{x}_{k}" for x in "bc" for k in KINDS])
    return _with_spans(rows, model).select(F.col("key").alias(key), _base().alias("base"), "spans")


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str | None = None) -> DataFrame:
    """``df`` with each span replaced by its kind in brackets; ``n_chars`` names a length column to refresh.

    The model is fitted to ``df`` itself. Spans are found again beside the text, so no
    text is shuffled. The row rides along as one struct, so its columns may have any names.
    """
    model = train(candidates(df, key, text), key)
    t = F.col("t")
    rows = df.select(F.struct(*[named(c) for c in df.columns]).alias("row"), whole_text(text).alias("t"))
    found = _with_spans(
        rows.withColumns(
            {f"b_{k}": v for k, v in base_spans(t).items()} | {f"c_{k}": v for k, v in candidate_spans(t).items()}
        ),
        model,
    ).withColumn("spans", F.array_sort(F.transform("spans", lambda x: F.struct(x["s"], x["e"], x["kind"]))))
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    end = F.struct(F.length(t).alias("s"), F.length(t).alias("e"), F.lit(-1).alias("kind"))

    def gaps(spans: Column) -> Column:
        ends = F.transform(spans, lambda x: x["e"])
        gap = lambda x, a: F.struct(a.alias("a"), x["s"].alias("b"), x["kind"].alias("kind"))
        return F.zip_with(spans, _running(ends, 0, F.greatest), gap)

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        mask = (1 << TEXT_BLOCK_BITS) - 1
        i, j = F.shiftright(a, TEXT_BLOCK_BITS), F.shiftright(b, TEXT_BLOCK_BITS)
        first = F.substring(F.get(blocks, i), a.bitwiseAND(mask) + 1, b - a)
        last = F.coalesce(F.substring(F.get(blocks, j), F.lit(1), b.bitwiseAND(mask)), F.lit(""))
        many = F.concat(first, F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), last)
        return F.when(b <= a, "").when(i == j, first).otherwise(many)

    def without(blocks: Column) -> Column:
        cuts = _let(F.concat("spans", F.array(end)), gaps)
        mark = lambda x: F.when((x["kind"] >= 0) & (x["b"] >= x["a"]), F.get(label, x["kind"])).otherwise("")
        return F.array_join(F.transform(cuts, lambda x: F.concat(piece(blocks, x["a"], x["b"]), mark(x))), "")

    blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{1 << TEXT_BLOCK_BITS}}}"), F.lit(0))
    clean = F.when(F.size("spans") > 0, _let(blocks, without)).otherwise(F.col("row")[text])
    out = found.select("row", clean.alias("clean"))
    columns = {c: F.col("row")[c] for c in df.columns} | {text: F.col("clean")}
    if n_chars is not None:
        columns[n_chars] = F.length("clean").cast(dict(df.dtypes)[n_chars])
    return out.select(*[v.alias(c) for c, v in columns.items()])
