"""Date expressions: strptime formats, format guessing, time arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The date formats tried when a column's type is inferred, in order.
INFERENCE_FORMATS = ["%Y-%m-%d", "%d-%m-%Y", "%m/%d/%Y", "%Y/%m/%d"]

# directive -> (pattern of its text, part name) for the all-digit directives
_DIGITS = {
    "Y": (r"\d{4}", "year"),
    "y": (r"\d{2}", "year2"),
    "m": (r"\d{1,2}", "month"),
    "d": (r"\d{1,2}", "day"),
    "H": (r"\d{1,2}", "hour"),
    "M": (r"\d{1,2}", "minute"),
    "S": (r"\d{1,2}", "second"),
    "f": (r"\d{1,6}", "fraction"),
    "z": (r"Z|[+-]\d{2}:?\d{2}", "zone"),
}

# directive -> Spark datetime pattern, for formats that spell things out
_SPARK = {
    "Y": "yyyy", "m": "M", "d": "d", "H": "H", "M": "m", "S": "s", "f": "SSSSSS",
    "b": "MMM", "B": "MMMM", "I": "h", "p": "a", "j": "D",
}


def _tokens(fmt: str) -> list[tuple[str, str]]:
    """Split a strptime format into ('directive', letter) and ('text', run)."""
    parts = []
    for directive, text in re.findall(r"%(.)|([^%]+)", fmt):
        if directive == "%":
            parts.append(("text", "%"))
        elif directive:
            parts.append(("directive", directive))
        else:
            parts.append(("text", text))
    return parts


def parse_format(text: Column, fmt: str) -> Column:
    """Text to timestamp without time zone by a strptime format, else null."""
    tokens = _tokens(fmt)
    letters = [t for kind, t in tokens if kind == "directive"]
    unknown = [t for t in letters if t not in _DIGITS and t not in _SPARK]
    if unknown or not letters:
        raise ValueError(f"unsupported date format {fmt!r}")
    if all(t in _DIGITS for t in letters) and len(set(letters)) == len(letters):
        return _parse_digits(text, tokens)
    return _parse_named(text, tokens, fmt)


def _parse_digits(text: Column, tokens: list[tuple[str, str]]) -> Column:
    """One regex rewrites the text to ISO order, which then casts directly.

    A text of the wrong shape never reaches the cast, so misses cost one failed
    anchored match and no time zone is involved.
    """
    shape, groups = "", {}
    # a run of directives with nothing between them must have full-width fields
    for i, (kind, token) in enumerate(tokens):
        if kind == "text":
            shape += "".join(r"\s+" if c.isspace() else re.escape(c) for c in token)
            continue
        pattern, part = _DIGITS[token]
        touching = (i > 0 and tokens[i - 1][0] == "directive") or (
            i + 1 < len(tokens) and tokens[i + 1][0] == "directive"
        )
        if touching and pattern == r"\d{1,2}":
            pattern = r"\d{2}"
        groups[part] = len(groups) + 1
        # digits beyond microseconds are cut
        shape += f"({pattern})" + (r"\d{0,3}" if part == "fraction" else "")
    shape = f"^{shape}\\z"
    year = groups.get("year", groups.get("year2"))
    fields = [
        f"${year}" if year else "1900",
        f"${groups['month']}" if "month" in groups else "1",
        f"${groups['day']}" if "day" in groups else "1",
    ]
    clock = [f"${groups[p]}" if p in groups else "0" for p in ("hour", "minute", "second")]
    iso = "-".join(fields) + " " + ":".join(clock)
    if "fraction" in groups:
        iso += f".${groups['fraction']}"
    ordered = F.regexp_replace(text, shape, iso)
    if "year2" in groups:
        ordered = F.concat(F.when(ordered >= "69", "19").otherwise("20"), ordered)
    moment = ordered.try_cast("timestamp_ntz")
    if "zone" in groups:  # moved to UTC
        zone = F.regexp_extract(text, shape, groups["zone"])
        minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, -2, 2).try_cast("int")
        ahead = F.when(zone == "Z", 0).when(zone.startswith("-"), -minutes).otherwise(minutes)
        moment = F.timestamp_add("MINUTE", -ahead, moment)
    return F.when(text.rlike(shape), moment)


def _parse_named(text: Column, tokens: list[tuple[str, str]], fmt: str) -> Column:
    pattern = ""
    for kind, token in tokens:
        if kind == "text":
            pattern += "'" + token.replace("'", "''") + "'"
        elif token in _SPARK:
            pattern += _SPARK[token]
        else:
            raise ValueError(f"unsupported date format {fmt!r}")
    # month names and AM/PM match in any case
    return F.try_to_timestamp(F.initcap(text) if "%p" not in fmt else _upper_marker(text), F.lit(pattern)).cast(
        "timestamp_ntz"
    )


def _upper_marker(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.initcap(text), r"(?i)am\z", "AM"), r"(?i)pm\z", "PM")


_CLOCKS = [
    (r"", ""),
    (r"([ T])\d{1,2}:\d{2}", "{0}%H:%M"),
    (r"([ T])\d{1,2}:\d{2}:\d{2}", "{0}%H:%M:%S"),
    (r"([ T])\d{1,2}:\d{2}:\d{2}\.\d{1,9}", "{0}%H:%M:%S.%f"),
    (r"([ T])\d{1,2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:?\d{2})", "{0}%H:%M:%S%z"),
    (r"([ T])\d{1,2}:\d{2}:\d{2}\.\d{1,9}(?:Z|[+-]\d{2}:?\d{2})", "{0}%H:%M:%S.%f%z"),
    (r"( )\d{1,2}:\d{2} [AaPp][Mm]", "{0}%I:%M %p"),
    (r"( )\d{1,2}:\d{2}:\d{2} [AaPp][Mm]", "{0}%I:%M:%S %p"),
]

_MONTH_NAME = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_LONG_MONTH = "(?:january|february|march|april|may|june|july|august|september|october|november|december)"
_NAMED_DAYS = [
    (rf"(?i:\d{{1,2}}([ -]){_MONTH_NAME}\1\d{{4}})", "%d{sep}%b{sep}%Y"),
    (rf"(?i:\d{{1,2}}([ -]){_LONG_MONTH}\1\d{{4}})", "%d{sep}%B{sep}%Y"),
    (rf"(?i:{_MONTH_NAME}( )\d{{1,2}}, \d{{4}})", "%b %d, %Y"),
    (rf"(?i:{_LONG_MONTH}( )\d{{1,2}}, \d{{4}})", "%B %d, %Y"),
]


def _guess_day(text: str) -> list[str]:
    """Formats of the date part of one value, best first; month before day."""
    if re.fullmatch(r"\d{8}", text):
        return ["%Y%m%d"]
    if match := re.fullmatch(r"\d{4}([-/.])(\d{1,2})\1(\d{1,2})", text):
        sep = match.group(1)
        return [f"%Y{sep}%m{sep}%d"] if int(match.group(2)) <= 12 else [f"%Y{sep}%d{sep}%m"]
    if match := re.fullmatch(r"\d{4}([-/])(\d{1,2})", text):
        return [f"%Y{match.group(1)}%m"] if 1 <= int(match.group(2)) <= 12 else []
    if match := re.fullmatch(r"(\d{1,2})([-/.])(\d{1,2})\2\d{4}", text):
        first, sep, second = int(match.group(1)), match.group(2), int(match.group(3))
        if first <= 12:
            return [f"%m{sep}%d{sep}%Y"]
        return [f"%d{sep}%m{sep}%Y"] if second <= 12 else []
    for pattern, fmt in _NAMED_DAYS:
        if match := re.fullmatch(pattern, text):
            return [fmt.format(sep=match.group(1))]
    return []


def guess_format(text: str) -> str | None:
    """The strptime format of one value, or None when it is no known date."""
    for pattern, clock in _CLOCKS:
        match = re.fullmatch(rf"(.*?){pattern}", text)
        if match and (days := _guess_day(match.group(1))):
            return days[0] + (clock.format(match.group(2)) if clock else "")
    return None


def parse_each(text: Column) -> Column:
    """Parse every value on its own, month first where that is ambiguous."""
    days = ["%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y%m%d"]
    days += [f"{a}{sep}{b}{sep}%Y" for a, b in (("%m", "%d"), ("%d", "%m")) for sep in "/-."]
    clocks = ["", " %H:%M:%S", "T%H:%M:%S", " %H:%M", " %H:%M:%S.%f", "T%H:%M:%S.%f"]
    formats = [day + clock for clock in clocks for day in days]
    formats += [f"%Y-%m-%d{t}%H:%M:%S{f}%z" for t in "T " for f in ("", ".%f")] + ["%Y-%m"]
    return F.coalesce(*[parse_format(text, f) for f in formats])


DAY_MICROS = 86_400_000_000


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def whole_days(micros: Column) -> Column:
    """Days rounded toward minus infinity, in integer arithmetic."""
    return F.call_function("div", micros - F.pmod(micros, F.lit(DAY_MICROS)), F.lit(DAY_MICROS))


def epoch_micros(moment: Column) -> Column:
    """Order-preserving number for a time stamp or date, free of time zones."""
    return F.timestamp_diff(
        "MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), moment.cast("timestamp_ntz")
    )


def from_epoch_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz"))
