"""Numeric expressions and the driver-side arithmetic of equal-width bins."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, functions as F

# Text read as a number; the anchored pattern also keeps out '1d' and '1f',
# which a plain cast would accept.
NUMBER_TEXT = r"(?i)^\s*[+-]?(inf|infinity|(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?)\s*$"

_WHOLE = float(2**53)  # doubles this large have no fraction left


def parse_number(text: Column) -> Column:
    """Text to double, null where it is not a number."""
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def round_scaled(number: Column, decimals: int, method: str) -> Column:
    """Round on the scaled double: half to even, down or up."""
    number = number.cast("double")
    factor = float(10 ** abs(decimals))
    scaled = number * factor if decimals >= 0 else number / factor
    step = {"round": F.rint, "floor": F.floor, "ceil": F.ceil}[method]
    whole = F.when(F.abs(scaled) < _WHOLE, step(scaled).cast("double")).otherwise(scaled)
    return whole / factor if decimals >= 0 else whole * factor


def clip(number: Column, lower, upper) -> Column:
    """Bound a number on either side; null stays null."""
    if lower is None and upper is None:
        return number
    branches = F
    if lower is not None:
        branches = branches.when(number < F.lit(lower), F.lit(lower))
    if upper is not None:
        branches = branches.when(number > F.lit(upper), F.lit(upper))
    return branches.otherwise(number)


# ---- equal-width, right-closed bins ----


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    """``bins + 1`` edges; the outer ones are widened so both ends fall inside."""
    if not (math.isfinite(low) and math.isfinite(high)):
        raise ValueError("bins of equal width need finite values; replace infinite ones first")
    if low == high:
        margin = 0.001 * abs(low) if low != 0 else 0.001
        return [float(e) for e in np.linspace(low - margin, high + margin, bins + 1)]
    edges = np.linspace(low, high, bins + 1)
    edges[0] -= 0.001 * (high - low)
    return [float(e) for e in edges]


def _shown(edge: float, digits: int) -> float:
    """Round to decimals, or to significant digits when below one."""
    if not math.isfinite(edge) or edge == 0:
        return edge
    fraction, whole = math.modf(edge)
    if whole == 0:
        digits = -math.floor(math.log10(abs(fraction))) - 1 + digits
    return float(np.around(edge, digits))


def label_digits(edges: Sequence[float]) -> int:
    """The fewest digits, from three, that keep all printed edges apart."""
    for digits in range(3, 20):
        if len({_shown(e, digits) for e in edges}) == len(edges):
            return digits
    return 3


def bin_labels(edges: Sequence[float], lower_first: bool = False) -> list[str]:
    """Interval text ``(a, b]`` per bin."""
    digits = label_digits(edges)
    shown = [_shown(e, digits) for e in edges]
    if lower_first:
        shown[0] = _shown(shown[0] - 10.0**-digits, digits)
    return [f"({a}, {b}]" for a, b in zip(shown, shown[1:])]


def bin_index(number: Column, edges: Sequence[float]) -> Column:
    """0-based bin of a value in constant time: estimate from the bin width,
    then step over an edge where rounding put the estimate one off."""
    bins = len(edges) - 1
    low = edges[1] - (edges[-1] - edges[1]) / (bins - 1) if bins > 1 else edges[0]
    width = (edges[-1] - low) / bins
    array = F.array(*[F.lit(e) for e in edges])
    number = number.cast("double")
    guess = F.least(
        F.greatest(F.ceil((number - low) / width) - 1, F.lit(0)), F.lit(bins - 1)
    ).cast("int")
    below = F.get(array, guess)
    above = F.get(array, guess + 1)
    return F.when(
        (number > edges[0]) & (number <= edges[-1]),
        F.when(number <= below, guess - 1).when(number > above, guess + 1).otherwise(guess),
    )
