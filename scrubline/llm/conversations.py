"""Conversation structure repair with a suffix-shared automaton.

A conversation's rows, in order of their turn, become a signature: one letter per row that tells the
initial of its role and its fault. Conversations with one signature need the same edits, so only
distinct signatures are worked on. They are dealt and sorted by their reversed letters, so signatures
with a common ending follow each other: a node of the automaton stands for one ending, is made when
it is first met, and is shared by all signatures that end so. Per node and grammar state it holds the
least cost of the rows from there on and the first letter of the best audit; letters, not audits, are
kept, with ranks that order the audits of a node, so a node's size does not depend on its depth.

Edits: keep (0), give the role user or assistant (3), delete (4; the only way for blank rows and
duplicates), insert an empty turn (3). Truncated rows that stay add 3. The roles left over read
``(s?(ua)+)?`` by their initials; of equally cheap edits the one with the ASCII-least audit wins.

Defined results:

* Null conv_ids make one conversation; null turns come first; null roles and texts are one space.
* Rows of one turn are ordered by role and then by the MD5 of their text; repeated rows are
  duplicates. Texts count as equal when their 128-bit MD5 digests are.
* Extra columns are ignored. An empty table gives an empty result.
* The hash and the repaired rows of one conversation come out of one task, since a SHA-256 is
  made in order. Rows stream through it after Spark's spilling sort; a conversation costs that task
  one byte a row for its signature and audit, and the automaton some 50 bytes a row of its longest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scrubline.llm.common import written

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: Grammar states: 0 nothing yet, 1 after the system turn, 2 a user turn is open, 3 answered.
N_STATES, ACCEPTED = 4, (0, 3)
#: Where a role's initial leads from each state (-1: nowhere).
STEP = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1), "x": (-1, -1, -1, -1)}
#: The role that an edited or inserted turn must have in each state, and where it leads.
WANTED, NEXT = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
SPACE_CHARS = " \t\n\x0b\f\r"


def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(df: DataFrame, cycle: int = 20) -> DataFrame:
    """The rows of ``df`` (conv_id, turn, role, text) with repeatable faults, by crc32 of ``conv_id:turn``.

    Of the remainders 0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes
    it the user's.
    """
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = df.select(
        "conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"),
        (F.crc32(F.concat_ws(":", _spaced("conv_id"), _spaced("turn"))) % cycle).alias("kind"),
    ).filter(kind != 0)
    times = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times
    ).drop("col")


def _turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and digest of every row."""
    return df.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"), _spaced("text").alias("text")
    ).withColumn("digest", F.unhex(F.md5("text")))


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _figures_schema(df: DataFrame) -> StructType:
    out = StructType([StructField("conv_id", df.schema["conv_id"].dataType)])
    for c in FIGURES:
        out = out.add(c, "long")
    return out.add("signature", StringType())


def signatures(df: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal and signature of every conversation.

    ``conversations`` (conv_id) names those to list even if no row of theirs is in ``df``. Texts
    are not shuffled, only their digests and faults.
    """
    bare = F.rtrim("text", F.lit(SPACE_CHARS))
    fault = F.when(bare == "", 1).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 2).otherwise(0)
    turns = _turns(df).select("conv_id", "turn", "role", "digest", fault.alias("fault"))
    listed = (conversations if conversations is not None else df).select("conv_id").distinct()
    rows = turns.unionByName(listed, allowMissingColumns=True).repartition("conv_id")
    order = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    rows = rows.select(
        "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "role", "digest",
        F.row_number().over(order).alias("nth"),
    ).sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest", "nth")
    rows = rows.select("conv_id", "turn", "initial", "fault", "nth")
    return rows.mapInArrow(_read_signatures, _figures_schema(df))


class _Conversation:
    """What one pass over a conversation's rows, in order, finds out."""

    def __init__(self, key):
        self.key, self.letters, self.before = key, bytearray(), None
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, initial: str, fault: int, nth: int) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if self.letters:
            self.illegal += (self.before, initial) not in LEGAL
        self.before = initial
        letter = initial if initial in STEP and initial != "x" else "x"
        if fault == 1:
            self.blank, letter = self.blank + 1, "d"
        elif nth > 1:
            self.duplicate, letter = self.duplicate + 1, "d"
        elif fault == 2:
            self.truncated, letter = self.truncated + 1, letter.upper()
        self.letters += letter.encode()

    def row(self) -> tuple:
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.turns
        return (
            self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.letters.decode(),
        )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _read_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, schema = None, None
    for batch in batches:
        fields = [pa.field("conv_id", batch.schema.field(0).type)]
        schema = pa.schema(fields + [pa.field(c, pa.int64()) for c in FIGURES] + [pa.field("signature", pa.string())])
        done = []
        for key, turn, initial, fault, nth in zip(*(c.to_pylist() for c in batch.columns)):
            if current is None or key != current.key:
                if current is not None:
                    done.append(current.row())
                current = _Conversation(key)
            if initial is not None:
                current.add(turn, initial, fault, nth)
        yield _batch(done, schema)
    if current is not None:
        yield _batch([current.row()], schema)


def _ranked(keys: list[tuple]) -> tuple:
    places = {k: n for n, k in enumerate(sorted(set(keys)))}
    return tuple(places[k] for k in keys)


class SuffixAutomaton:
    """The endings of the signature last added, each with cost and best first edit per grammar state.

    ``grow`` adds the node for one more letter in front. What it adds depends only on the letter and
    on the costs (relative to the least) and ranks of the node behind, of which there are few kinds,
    so each kind is worked out once.
    """

    def __init__(self):
        self.kinds: dict = {}
        self.made = 0
        cost, first = [0 if q in ACCEPTED else None for q in range(N_STATES)], [""] * N_STATES
        self.nodes = [(0, *self._with_inserts(cost, first, [()] * N_STATES))]
        self.signature = ""

    @staticmethod
    def _with_inserts(cost: list, first: list, key: list) -> tuple:
        """Costs, first edits and ranks once inserted turns are allowed before what is there."""
        changed = True
        while changed:
            changed = False
            for q in range(N_STATES):
                behind = cost[NEXT[q]]
                if behind is not None and (cost[q] is None or (behind + INSERT, "I") < (cost[q], first[q])):
                    cost[q], first[q], changed = behind + INSERT, "I", True
        for q in range(N_STATES):
            tail, at = (), q
            while first[at] == "I":
                tail, at = (*tail, "I"), NEXT[at]
            key[q] = (*tail, *key[at]) if tail else key[q]
        return tuple(cost), tuple(first), _ranked(key)

    def _grown(self, letter: str, costs: tuple, ranks: tuple) -> tuple:
        role, extra = letter.lower(), CUT_OFF if letter.isupper() else 0
        cost, first, key = [], [], []
        for q in range(N_STATES):
            ways = [(DELETE + costs[q], "D", ranks[q])]
            if letter != "d":
                ways.append((REROLE + extra + costs[NEXT[q]], "R", ranks[NEXT[q]]))
                if (to := STEP[role][q]) >= 0:
                    ways.append((KEEP + extra + costs[to], "K", ranks[to]))
            best = min(ways)
            cost.append(best[0]), first.append(best[1]), key.append(best[1:])
        cost, first, ranks = self._with_inserts(cost, first, key)
        least = min(cost)
        return least, tuple(c - least for c in cost), first, ranks

    def grow(self, letter: str) -> None:
        base, costs, _, ranks = self.nodes[-1]
        kind = (letter, costs, ranks)
        if kind not in self.kinds:
            self.kinds[kind] = self._grown(*kind)
        least, costs, first, ranks = self.kinds[kind]
        self.nodes.append((base + least, costs, first, ranks))
        self.made += 1

    def add(self, signature: str) -> None:
        """Signatures come in order of their reversed letters; what they share with the last is kept."""
        last, n = self.signature, min(len(signature), len(self.signature))
        shared, step = 0, 4096
        while shared < n and step:  # whole stretches first, then the rest of them letter by letter
            a, b = (s[len(s) - shared - step : len(s) - shared] for s in (last, signature))
            if shared + step <= n and a == b:
                shared += step
            else:
                step //= 2
        del self.nodes[shared + 1 :]
        for letter in reversed(signature[: len(signature) - shared]):
            self.grow(letter)
        self.signature = signature

    def best(self) -> tuple[int, str]:
        """Cost and audit of the signature last added."""
        base, costs, *_ = self.nodes[-1]
        q, at, audit = 0, len(self.nodes) - 1, []
        while edit := self.nodes[at][2][q]:
            audit.append(edit)
            if edit == "K":
                q = STEP[self.signature[len(self.signature) - at].lower()][q]
            elif edit in "RI":
                q = NEXT[q]
            at -= edit != "I"
        return base + costs[0], "".join(audit)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = SuffixAutomaton()
    schema = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
    for batch in batches:
        rows = []
        for signature in batch.column(0).to_pylist():
            automaton.add(signature)
            rows.append((signature, *automaton.best()))
        yield _batch(rows, schema)


def solutions(found: DataFrame) -> DataFrame:
    """signature, cost and audit for each distinct signature of ``found``."""
    ending = F.reverse("signature")
    distinct = found.select("signature").distinct()
    spread = distinct.repartitionByRange(ending).sortWithinPartitions(ending)
    return spread.mapInArrow(_solve, "signature string, cost long, audit string")


def audits(df: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Figures, cost and audit of every conversation."""
    found = written(signatures(df, conversations), "signatures")
    return found.join(solutions(found), "signature").select("conv_id", *FIGURES, "cost", "audit")


class _Repair:
    """Reads one conversation's rows after its audit and tells what is left of them."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _inserted(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield "I", WANTED[self.state], ""
            self.state, self.at = NEXT[self.state], self.at + 1

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield edit, role, text
            self.state = STEP[role[:1]][self.state]
        elif edit == "R":
            yield edit, WANTED[self.state], text
            self.state = NEXT[self.state]

    def end(self) -> Iterator[tuple]:
        yield from self._inserted()


def _with_audits(df: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit row, then its rows in order; one shuffle of the texts."""
    rows = _turns(df).withColumn("kind", F.lit(1))
    heads = found.select("*", F.lit(0).alias("kind"))
    both = heads.unionByName(rows, allowMissingColumns=True).repartition("conv_id")
    order = (F.asc_nulls_first("conv_id"), "kind", F.asc_nulls_first("turn"), "role", "digest")
    return both.sortWithinPartitions(*order).select("conv_id", "kind", *FIGURES, "cost", "audit", "role", "text")


def _walk_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head, repair, digest, written_any, schema = None, None, None, False, None

    def take(turns: Iterator[tuple]) -> None:
        nonlocal written_any
        for _, role, text in turns:
            digest.update(f"{chr(10) if written_any else ''}{role}:{text}".encode())
            written_any = True

    def finish() -> tuple:
        take(repair.end())
        return (*head, digest.hexdigest())

    for batch in batches:
        names = ["conv_id", *FIGURES, "cost", "audit"]
        fields = [pa.field(c, batch.column(c).type) for c in names]
        schema = pa.schema([*fields, pa.field("repaired_sha256", pa.string())])
        done = []
        for row in zip(*(batch.column(c).to_pylist() for c in ["kind", "role", "text", *names])):
            if row[0] == 0:
                if head is not None:
                    done.append(finish())
                head, repair, digest, written_any = row[3:], _Repair(row[-1]), hashlib.sha256(), False
            else:
                take(repair.row(row[1], row[2]))
        yield _batch(done, schema)
    if head is not None:
        yield _batch([finish()], schema)


def _walk_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, repair, place, schema = None, None, 0, None
    for batch in batches:
        schema = pa.schema(
            [("conv_id", batch.column("conv_id").type), ("place", pa.int64())]
            + [(c, pa.string()) for c in ("edit", "role", "text")]
        )
        out = []

        def take(turns: Iterator[tuple], to: list = out) -> None:
            nonlocal place
            for edit, role, text in turns:
                to.append((key, place, edit, role, text))
                place += 1

        for conv, kind, audit, role, text in zip(
            *(batch.column(c).to_pylist() for c in ("conv_id", "kind", "audit", "role", "text"))
        ):
            if kind == 0:
                if repair is not None:
                    take(repair.end())
                key, repair, place = conv, _Repair(audit), 0
            else:
                take(repair.row(role, text))
        yield _batch(out, schema)
    if repair is not None:
        rest = [(key, place + n, *turn) for n, turn in enumerate(repair.end())]
        yield _batch(rest, schema)


def repair_digests(df: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: figures, cost, audit and SHA-256 of its repaired ``role:text`` lines."""
    found = written(audits(df, conversations), "audits")
    schema = StructType(found.schema.fields).add("repaired_sha256", StringType())
    return _with_audits(df, found).mapInArrow(_walk_digests, schema)


def repair(df: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), edit (K, R or I), role, text."""
    found = written(audits(df), "audits")
    schema = StructType([StructField("conv_id", df.schema["conv_id"].dataType)]).add("place", "long")
    for c in ("edit", "role", "text"):
        schema = schema.add(c, StringType())
    return _with_audits(df, found).mapInArrow(_walk_turns, schema)
