"""Text expressions with Python's string rules, built from JVM functions."""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column, functions as F

# Every character Python's str.strip removes (derived, not listed).
WHITESPACE = "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())

# \s in Java's Unicode mode lacks the four separator controls Python counts.
# (Spelled out character by character the class is several times slower.)
_SPACE_CLASS = r"\s\x1c-\x1f"
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """Nothing but white space."""
    return text.rlike(f"(?U)^[{_SPACE_CLASS}]*\\z")


def starts_spaced(text: Column) -> Column:
    return F.substring(text, 1, 1).rlike(f"(?U)[{_SPACE_CLASS}]")


def has_edge_space(text: Column) -> Column:
    """White space first or last; only those two characters are looked at."""
    edges = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return edges.rlike(f"(?U)[{_SPACE_CLASS}]")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def is_lower(text: Column) -> Column:
    """At least one cased character and none of them upper."""
    return (text == F.lower(text)) & (text != F.upper(text))


def is_upper(text: Column) -> Column:
    return (text == F.upper(text)) & (text != F.lower(text))


def title(text: Column) -> Column:
    """Capitalise after every non-letter, not only after spaces."""
    runs = F.regexp_extract_all(text, F.lit(f"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1))
    worded = F.transform(
        runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))
    )
    return F.array_join(worded, "")


def keep_alphanumeric(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)[^a-zA-Z0-9{_SPACE_CLASS}]+", "")


def pad(text: Column, width: int, fill: str, side: str) -> Column:
    """Pad to ``width``; longer text is left whole."""
    size = F.length(text)
    if side == "left":
        padded = F.lpad(text, width, fill)
    elif side == "right":
        padded = F.rpad(text, width, fill)
    else:
        total = F.lit(width) - size
        # an odd surplus goes left only when the width is odd too
        left = F.floor(total / 2).cast("int") + total.bitwiseAND(F.lit(width)).bitwiseAND(F.lit(1))
        padded = F.concat(
            F.repeat(F.lit(fill), left), text, F.repeat(F.lit(fill), total - left)
        )
    return F.when(size >= width, text).otherwise(padded)


def python_slice(text: Column, start: int, end: int | None) -> Column:
    """``text[start:end]`` with negative positions counted from the end."""
    size = F.length(text)

    def position(p: int) -> Column:
        return F.least(F.lit(p), size) if p >= 0 else F.greatest(size + p, F.lit(0))

    first = position(start)
    last = size if end is None else position(end)
    return F.substr(text, first + 1, F.greatest(last - first, F.lit(0)))


def split_literal(text: Column, delimiter: str) -> Column:
    """Split on a literal delimiter, trailing empties kept."""
    quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.split(text, quoted, -1)


# ---- Python regular expressions on Java's engine ----

# Character classes and case-blind matching follow Unicode, at a price.
_NEEDS_UNICODE = re.compile(r"\\[wWdDsSbB]|\(\?[a-zA-Z]*i")

_UNSUPPORTED = ("(?(", "(?a", "(?L", "(?u")


def java_pattern(pattern: str) -> str:
    """The Java spelling of a Python pattern.

    Unicode classes and newline-only line ends are switched on to match Python;
    named groups become numbered ones.
    """
    try:
        names = re.compile(pattern).groupindex
    except re.error as error:
        raise ValueError(f"invalid pattern {pattern!r}: {error}") from error
    for token in _UNSUPPORTED:
        if token in pattern:
            raise ValueError(f"pattern syntax {token!r} is not supported")
    out, i, in_class, class_start = [], 0, False, -1
    while i < len(pattern):
        rest = pattern[i:]
        if rest[0] == "\\":
            pair = rest[:2]
            out.append(r"\z" if pair == r"\Z" and not in_class else pair)
            i += 2
        elif in_class:
            if rest[0] == "]" and i != class_start:
                in_class = False
                out.append("]")
            else:
                # these nest, intersect or end the class in Java; here they are literal
                out.append("\\" + rest[0] if rest[0] in "[&]" else rest[0])
            i += 1
        elif rest[0] == "[":
            in_class = True
            opener = "[^" if rest.startswith("[^") else "["
            out.append(opener)
            i += len(opener)
            class_start = i
        elif (match := re.match(r"\(\?P<\w+>", rest)) is not None:
            out.append("(")
            i += match.end()
        elif (match := re.match(r"\(\?P=(\w+)\)", rest)) is not None:
            out.append(f"(?:\\{names[match.group(1)]})")
            i += match.end()
        else:
            out.append(rest[0])
            i += 1
    flags = "(?Ud)" if _NEEDS_UNICODE.search(pattern) else "(?d)"
    return flags + "".join(out)


def java_replacement(pattern: str, replacement: str) -> str:
    """The Java spelling of a Python replacement template."""
    compiled = re.compile(pattern)
    escapes = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "b": "\b", "\\": "\\\\"}
    out, i, after_group = [], 0, False
    while i < len(replacement):
        rest = replacement[i:]
        match = re.match(r"\\g<(\w+)>|\\([1-9]\d?)", rest)
        if match:
            name = match.group(1) or match.group(2)
            index = int(name) if name.isdigit() else compiled.groupindex.get(name, -1)
            if not 0 <= index <= compiled.groups:
                raise ValueError(f"invalid group reference {name!r}")
            out.append(f"${index}")
            i += match.end()
            after_group = True
            continue
        if rest[0] == "\\":
            if len(rest) < 2 or rest[1] not in escapes:
                raise ValueError(f"bad escape in replacement {replacement!r}")
            out.append(escapes[rest[1]])
            i += 2
        else:
            literal = rest[0]
            needs_escape = literal == "$" or (after_group and literal.isdigit())
            out.append("\\" + literal if needs_escape else literal)
            i += 1
        after_group = False
    return "".join(out)


def regex_replace(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, java_pattern(pattern), java_replacement(pattern, replacement))
