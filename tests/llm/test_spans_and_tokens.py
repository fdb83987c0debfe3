"""Personal data, SentencePiece, packing."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm_tables import FOLDER, pairs

from scrubline.llm import packing, pieces, pii
from scrubline.llm.queries import QUERIES, tokenizer_path

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [
        (k, m.start(), m.end())
        for k, kind in enumerate(pii.KINDS)
        for m in re.finditer(PATTERNS[kind], text or "")
        if valid(kind, m[0])
    ]


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_base_spans(request, table):
    df = request.getfixturevalue(table)
    found = pii.candidates(df)
    got = pii.find(found, pii.train(found)).collect()
    want = {k: base(t) for k, t in pairs(df)}
    assert {r["doc_id"]: [tuple(x) for x in r["base"]] for r in got} == want
    assert sum(map(len, want.values())) > 5
    for r in got:
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))


def test_no_python_in_plan(documents):
    found = pii.candidates(documents)
    for df in (found, pii.find(found, pii.train(found)), pii.redact(documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_model_adds_spans_that_look_alike(spark):
    """Cards with a typing error, in a table where what looks like a card mostly is one."""
    rng = random.Random(2)

    def card():
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(body + c for c in "0123456789" if luhn(body + c))

    rows = [(k, f"pay with card {card()} now") for k in range(2000)]
    wrong = card()
    wrong = wrong[:-1] + str((int(wrong[-1]) + 1) % 10)
    rows += [(5000, f"pay with card {wrong} now"), (5001, f"id x{wrong}9999999 in a list"), (5002, "nothing here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.candidates(df)
    spans = {r["doc_id"]: r["spans"] for r in pii.find(found, pii.train(found)).filter("doc_id >= 5000").collect()}
    assert [tuple(x) for x in spans[5000]] == [(2, 14, 30)]
    assert spans[5001] == [] and spans[5002] == []


def planted(n, seed):
    """Texts with forms that no base pattern finds, and look-alikes: (rows, wanted spans per row)."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghklmnoprstu") for _ in range(rng.randint(4, 9)))

    def card():
        body = rng.choice("3456") + digits(rng.choice([11, 12, 13]))
        return next(body + c for c in "0123456789" if luhn(body + c))

    makers = [
        (0, lambda: (f"mail {word()} at the office, or ", f"{word()} [at] {word()} [dot] com", " for more")),
        (0, lambda: ("contact ", f"{word()}.{word()}(at){word()}(dot)org", " today")),
        (1, lambda: ("login from ", "[.]".join(str(rng.randint(1, 255)) for _ in range(4)), " refused")),
        (2, lambda: ("pay by card ", card(), " please")),
        (3, lambda: ("call ", f"({rng.randint(2, 9)}{digits(2)}) {rng.randint(2, 9)}{digits(2)}-{digits(4)}", " now")),
        (None, lambda: (f"order id {digits(14)} has page {digits(3)} at {word()} and ", "", "nothing else")),
        (None, lambda: ("look at " + word() + " in 12.5.1999, row " + digits(13), "", " of the list")),
    ]
    rows, want = [], {}
    for k in range(n):
        kind, make = makers[k % len(makers)]
        a, m, b = make()
        rows.append((k, a + m + b))
        want[k] = [] if kind is None else [(kind, len(a), len(a + m))]
    return rows, want


def test_planted_forms_beyond_the_base_patterns(spark):
    rows, want = planted(1400, 5)
    assert not any(base(t) for _, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.candidates(df)
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in pii.find(found, pii.train(found)).collect()}
    true = {(k, *s) for k, spans in want.items() for s in spans}
    ours = {(k, *s) for k, spans in got.items() for s in spans}
    assert len(true & ours) >= 0.95 * len(true) and len(true & ours) >= 0.95 * len(ours)
    clean = dict(rows)[0]
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert redacted[0] == clean[: want[0][0][1]] + "[EMAIL]" + clean[want[0][0][2] :]


def test_many_matches_in_one_text(spark):
    rows = [(1, " ".join(f"é{k}x@mail{k}.org 10.0.0.{k % 300}" for k in range(6000))), (2, "z" * 50_000 + " a@b.de")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.candidates(df)
    got = {r["doc_id"]: r for r in pii.find(found, pii.train(found)).collect()}
    for key, text in rows:
        assert [tuple(x) for x in got[key]["base"]] == base(text)
        assert {tuple(x) for x in got[key]["spans"]} >= set(base(text))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    for key, text in rows:
        parts, at = [], 0
        for kind, s, e in sorted(map(tuple, got[key]["spans"]), key=lambda x: x[1]):
            parts += [text[at:s], f"[{pii.KINDS[kind].upper()}]"]
            at = e
        assert clean[key] == "".join(parts) + text[at:]


def test_checks_of_spelt_forms(spark):
    forms = [
        ("email", "jane [at] example [dot] com", True), ("email", "jane at home", False),
        ("email", "jane at example dot matrix", False), ("ip", "1[.]2[.]3[.]4", True), ("ip", "1[.]2[.]3[.]999", False),
        ("card", "378282246310005", True), ("card", "378282246310006", False), ("card", "4222222222222", True),
        ("phone", "(555) 234-5678", True), ("phone", "155-123-4567", False), ("phone", "0049 30 1234567", True),
        ("phone", "00493012345678", False),
    ]
    df = spark.createDataFrame([(k, m, w) for k, m, w in forms], "kind string, m string, want boolean")
    for kind in pii.KINDS:
        digits = F.regexp_replace("m", "[^0-9]", "")
        for r in df.filter(F.col("kind") == kind).withColumn("got", pii._verified(kind, F.col("m"), digits)).collect():
            assert r["got"] == r["want"], r["m"]


def test_phones_of_any_spacing(spark):
    df = spark.createDataFrame([(1, "call +1   2   3   4   5   6   7   8 now")], "doc_id long, text string")
    found = pii.candidates(df)
    assert [tuple(x) for x in pii.find(found, pii.train(found)).first()["base"]] == [(3, 5, 35)]


def test_redacted_rows_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "_text", "b_email", "c_card", "_spans", "row", "t", "spans", "clean", "a.b"]
    df = spark.createDataFrame([("k", "to a@b.de now", *"stuvwxyz1")], ", ".join(f"`{n}` string" for n in names))
    assert pii.redact(df).columns == names
    assert tuple(pii.redact(df).first()) == ("k", "to [EMAIL] now", *"stuvwxyz1")


def test_boosting_separates_codes():
    rng = np.random.default_rng(0)
    table, seen = pii._table(), np.zeros(pii.CODES)
    chosen = rng.choice(pii.CODES, 600, replace=False)
    seen[chosen] = 50
    truth = (table[:, 1] == 2) & (table[:, 5] == 1)
    score = pii.boost(seen, seen * truth)
    assert score[truth].min() > score[~truth].max()
    chance = pii.calibrate(score, seen, seen * truth)
    assert chance[truth].min() > 0.9 and chance[~truth].max() < 0.1


def test_redact(spark, odd, empty, repeated):
    df = spark.createDataFrame(
        [(1, "to a.b@c.de, +1 (555) 123-4567.", 31, "x"), (2, None, None, "y"), (3, "é 10.0.0.1é", 11, None)],
        "doc_id long, text string, n_chars long, lang string",
    )
    got = {r["doc_id"]: tuple(r) for r in pii.redact(df, n_chars="n_chars").collect()}
    assert got == {
        1: (1, "to [EMAIL], [PHONE].", 20, "x"), 2: (2, None, None, "y"), 3: (3, "é [IP]é", 7, None),
    }
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == odd.count()
    assert pii.redact(empty).count() == 0 and pii.redact(repeated).count() == repeated.count()
    for r in pii.redact(odd).collect():
        assert not [x for x in base(r["text"]) if x[0] == 0]


# -- SentencePiece ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return Path(tokenizer_path("piece_bpe_32k.model")).read_bytes()


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


@pytest.mark.parametrize("table", ["odd", "documents", "repeated", "empty"])
def test_pieces(request, table, model, library):
    df = request.getfixturevalue(table)
    want = defaultdict(list)
    for k, t in pairs(df):
        spans = [(p.begin, p.end) for p in library.encode(t or "", return_type="proto").pieces]
        ids = library.encode(t or "", add_eos=True)
        want[k].append((ids, spans, library.decode(ids)))
    got = pieces.encode(df, model).collect()
    assert len(got) == df.count()
    for r in got:
        spans = list(zip(r["begins"], r["ends"]))
        assert (r["ids"], spans[:-1], bytes(r["decoded"]).decode()) in want[r["doc_id"]]


def test_pieces_of_random_texts(model, library):
    rng = random.Random(4)
    letters = "abcdehtionrs ,.\n\t▁éñß日本🙂   THE　"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(1500)]
    texts += ["ab" * 400, "x" * 3000, "é" * 200, " " * 100 + "a"]
    found = pieces.Encoder(model).encode([t.encode() for t in texts], True)
    edges = found["offsets"]
    for k, t in enumerate(texts):
        assert found["ids"][edges[k] : edges[k + 1]].tolist() == library.encode(t, add_eos=True)


def test_character_map(library, model):
    """Longest prefixes and their sources, against the library's own normaliser."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as formats

    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = formats.ModelProto()
    proto.ParseFromString(normalizer.serialized_model_proto())
    blob = proto.normalizer_spec.precompiled_charsmap
    assert len(blob) > 1000
    changed = formats.ModelProto()
    changed.ParseFromString(model)
    changed.normalizer_spec.precompiled_charsmap = blob
    changed.normalizer_spec.remove_extra_whitespaces = True
    content = changed.SerializeToString()
    mapped, encoder = sentencepiece.SentencePieceProcessor(model_proto=content), pieces.Encoder(content)
    rng = random.Random(8)
    letters = "abc ﬁ①ＡＢ㌔ｶﾞ½é́é​\t  　ñ日ΐ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", "  ", "ﬁ"]
    found = encoder.encode([t.encode() for t in texts], False)
    for k, t in enumerate(texts):
        lo, hi = found["offsets"][k], found["offsets"][k + 1]
        proto = mapped.encode(t, return_type="proto")
        assert found["ids"][lo:hi].tolist() == mapped.encode(t), t
        spans = list(zip(found["begins"][lo:hi].tolist(), found["ends"][lo:hi].tolist()))
        assert spans == [(p.begin, p.end) for p in proto.pieces], t


# -- packing ----------------------------------------------------------------------------


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)])])
def test_cut(n, want):
    assert packing.cut(n, 8) == want


def fewest(lengths, capacity):
    """The least number of bins, by branching."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        tried = set()
        for b, room in enumerate(bins):
            if room >= lengths[k] and room not in tried:
                tried.add(room)
                place(k + 1, [*bins[:b], room - lengths[k], *bins[b + 1 :]])
        place(k + 1, [*bins, capacity - lengths[k]])

    place(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(6)
    for _ in range(150):
        capacity = rng.randint(5, 40)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = {n: lengths.count(n) for n in lengths}
        fixed, left = packing.reduce_counts(counts, capacity)
        rest = [n for n, c in left.items() for _ in range(c)]
        used = sorted(rest + [n for p, t in fixed for n in p * t])
        assert used == sorted(lengths) and all(sum(p) <= capacity for p, _ in fixed)
        assert sum(t for _, t in fixed) + fewest(rest, capacity) == fewest(lengths, capacity)


def test_plan_is_best_fit():
    rng = random.Random(7)
    for _ in range(100):
        capacity = rng.randint(5, 60)
        counts = {n: rng.randint(1, 30) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        rooms = []  # one at a time
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - n)
        patterns = packing.best_fit(counts, capacity)
        assert sorted(capacity - sum(p) for p, t in patterns for _ in range(t)) == sorted(rooms)


@pytest.mark.parametrize("table", ["odd", "documents", "repeated"])
def test_packed(request, table):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    df, capacity = request.getfixturevalue(table), 64
    want = defaultdict(int)
    for k, t in pairs(df):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for p, (s, n) in enumerate(packing.cut(len(ids), capacity)):
            want[(k, p, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))] += 1
    rows = packing.pack_documents(df, path, capacity=capacity).collect()
    got, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        got[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(n * c for (_, _, _, n, _), c in want.items())
    assert len(bins) <= 1.03 * total / capacity + 1


def test_long_runs_take_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    encode, tokenizer = packing._encoder(Path(path).read_bytes()), Tokenizer.from_file(path)
    assert len(encode("a <|endoftext|> b")) == 4
    for t in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> <|endoftext", "a " + " " * 30_000 + "b", "x" * 30_000, "word " * 9000, "it's  <|end of|> ñ\n\n  "):
        assert encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_pack_small_cells(spark, monkeypatch, empty):
    monkeypatch.setattr(packing, "CELL_PIECES", 3)
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7 + 1).alias("length")).repartition(4)
    bins = defaultdict(list)
    for r in packing.pack(df, ["id"], capacity=10).collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(map(len, bins.values())) == 500
    assert all(sum(n for _, n in b) <= 10 and len({o for o, _ in b}) == len(b) for b in bins.values())
    assert packing.pack_documents(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_after = stage(spark, docs, FOLDER).cache()
        assert docs_after.columns == docs.columns and docs_after.dtypes == docs.dtypes
        assert 0 < docs_after.count() <= docs.count()
        docs = docs_after
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    texts = [r["text"] for r in docs.collect()]
    assert len(set(texts)) == len(texts) and not any(base(t) for t in texts)
    got = corpus_pipeline.run(spark, FOLDER)
    assert {r["doc_id"] for r in got.collect()} == ids
    assert got.columns == QUERIES["op9_packing"](spark, FOLDER).columns
