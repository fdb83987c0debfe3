import random
import re

import pytest

from scrubline import operators as ops
from scrubline.functions import text
from scrubline.frames import named


def test_trim_all_unicode_space(table, values):
    given = [" a ", "\tb", "c ", " d\x1f", "   ", "", None, "e f"]
    want = ["a", "b", "c", "d", None, None, None, "e f"]
    assert values(ops.trim_spaces(table("s string", given), "s"), "s") == want


def test_batch_leaves_other_types(table, values):
    df = table("s string, n bigint", [(" a", 1)])
    out = ops.trim_spaces_batch(df, ["s", "n", "nope"])
    assert values(out, "s") == ["a"] and values(out, "n") == [1]


TITLES = ["o'neil-smith", "hello wORLD", "a1b2", "", "ÉCOLE élan", "x_y z", "123 abc", "中a文b"]


def test_title_like_python(table, values):
    out = ops.standardize_case(table("s string", TITLES), "s", "title")
    assert values(out, "s") == [t.title() for t in TITLES]


def test_case_refuses_unknown(table):
    with pytest.raises(ValueError):
        ops.standardize_case(table("s string", ["a"]), "s", "camel")


SAMPLES = ["", "a", "A", "aB", "1", "é", "É", " x", " ", "ß", "a b", "Ab\n", "\n", "x\x1f", "中"]


def test_predicates_like_python(table):
    df = table("s string", SAMPLES)
    rows = df.select(
        "s",
        text.is_lower(named("s")).alias("lower"),
        text.is_upper(named("s")).alias("upper"),
        text.has_edge_space(named("s")).alias("edge"),
        text.starts_spaced(named("s")).alias("start"),
        text.is_blank(named("s")).alias("blank"),
    ).collect()
    for r in rows:
        s = r["s"]
        if s != "ß":  # its upper case is two letters long
            assert r["lower"] == s.islower() and r["upper"] == s.isupper(), repr(s)
        assert r["edge"] == (s != s.strip()), repr(s)
        assert r["start"] == (s != s.lstrip()), repr(s)
        assert r["blank"] == (s.strip() == ""), repr(s)


@pytest.mark.parametrize("width", [0, 3, 4, 7, 8])
@pytest.mark.parametrize("side", ["left", "right", "both"])
def test_pad_like_python(table, values, side, width):
    given = ["", "a", "ab", "abc", "abcd", "abcdefghij", None]
    pad = {"left": str.rjust, "right": str.ljust, "both": str.center}[side]
    out = ops.pad_string(table("s string", given), "s", width, "*", side)
    assert values(out, "s") == [None if g is None else pad(g, width, "*") for g in given]


def test_pad_refusals(table):
    df = table("s string", ["a"])
    with pytest.raises(TypeError):
        ops.pad_string(df, "s", 5, "ab")
    with pytest.raises(ValueError):
        ops.pad_string(df, "s", 5, "a", "middle")


@pytest.mark.parametrize("start, end", [(0, None), (0, 3), (2, 5), (-3, None), (-4, -1), (1, -1),
                                        (4, 2), (-99, 99), (99, None), (0, 0), (-2, 1)])
def test_slice_like_python(table, values, start, end):
    given = ["hello", "ab", "", "日本語テキスト"]
    out = ops.slice_string(table("s string", given), "s", start, end)
    assert values(out, "s") == [g[start:end] or None for g in given]


def test_replace_is_literal(table, values):
    df = table("s string", ["a.b.c", "...", None])
    assert values(ops.replace_text(df, "s", ".", ""), "s") == ["abc", None, None]
    with pytest.raises(ValueError):
        ops.replace_text(df, "s", "", "x")


def test_special_characters(table, values):
    given = ["a!b@c#", "#!", "é ñ", "x y", "tab\tline\n", "_-"]
    want = [re.sub(r"[^a-zA-Z0-9\s]", "", g) or None for g in given]
    assert values(ops.remove_special_chars(table("s string", given), "s"), "s") == want


REGEXES = [
    (r"\d+", "#"), (r"(\w+)@(\w+)", r"\2 at \1"), (r"(?P<first_name>\w+) (?P<b>\w+)", r"\g<b>, \g<first_name>"),
    (r"^\s+|\s+$", ""), (r"a$", "$5"), (r"[\[\]&&x]", "_"), (r"(a)(b)?", r"<\1\2>"), (r"x*", "-"),
    (r"(?i)HELLO", r"\\"), (r"(\w)(?P<q>\w)(?P=q)", r"\g<1>0"), (r"[^]a]", "."), (r"b\Z", "!"), (r".", "·"),
    (r"\bfoo\b", "bar\\n"), (r"(?<=a)b", "B"), (r"[a-c&&[b]]", "?"),
]
REGEX_TEXTS = ["ab12 cd3", "joe@site x@y", "john smith", "  pad  ", "banana", "a[b]&x&&y", "ab a",
               "Hello hello", "book keeper", "]a]b", "line1\nline2 b", "foo food", "café ٣", "é "]


@pytest.mark.parametrize("pattern, replacement", REGEXES)
def test_regex_like_python(table, values, pattern, replacement):
    out = ops.replace_text_regex(table("s string", REGEX_TEXTS), "s", pattern, replacement)
    assert values(out, "s") == [re.sub(pattern, replacement, t) or None for t in REGEX_TEXTS]


@pytest.mark.parametrize("pattern, replacement", [("(", ""), (r"\p{L}", ""), ("a", r"\g<2>"), ("a", r"\q")])
def test_regex_refusals(table, pattern, replacement):
    with pytest.raises(ValueError):
        ops.replace_text_regex(table("s string", ["a"]), "s", pattern, replacement)


def test_affixes(table, values):
    df = table("s string", ["a", "", None])
    assert values(ops.add_prefix_suffix(df, "s", "<", ">"), "s") == ["<a>", "<>", None]


def test_random_texts_strip_like_python(table, values):
    rng = random.Random(3)
    alphabet = "ab \t\n  \x1cZ"
    given = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 8))) for _ in range(300)]
    out = ops.trim_spaces(table("s string", given), "s")
    assert values(out, "s") == [g.strip() or None for g in given]
