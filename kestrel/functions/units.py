"""Durations, epochs, and numbers as text."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of each unit.
UNIT_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity|nan)$"


def duration_ns(text: str, bare_seconds: bool = True) -> int:
    """``5m``, ``1.5s``, ``250ms``, or a bare number of seconds; negative and malformed ones are errors."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)(ms|s|m|h|d)?", text.strip())
    if not m or (m[2] is None and not bare_seconds) or (m[2] == "ms" and "." in m[1]):
        raise ValueError(f"not a duration: {text!r}")
    return round(float(m[1]) * UNIT_MS[m[2] or "s"] * 1_000_000) if "." in m[1] else int(m[1]) * UNIT_MS[m[2] or "s"] * 1_000_000


def epoch_ns(value: str | float) -> int:
    """Log timestamps: the magnitude tells nanoseconds, microseconds, milliseconds and seconds apart."""
    text = str(value)
    if re.fullmatch(r"[+-]?\d+", text):
        n = int(text)
        return n if n > 10**18 else n * 1000 if n > 10**15 else n * 10**6 if n > 10**12 else n * 10**9
    x = float(text)
    if not math.isfinite(x):
        raise ValueError(f"not a time: {text}")
    return int(x * 1e9)


def epoch_ms(value: str | float) -> int:
    """Metric timestamps: above 1e15 nanoseconds, above 1e12 milliseconds, else seconds."""
    text = str(value)
    if re.fullmatch(r"[+-]?\d+", text):
        n = int(text)
        return n // 10**6 if n > 10**15 else n if n > 10**12 else n * 1000
    x = float(text)
    if not math.isfinite(x):
        raise ValueError(f"not a time: {text}")
    return int(x * 1000)


def trace_epoch_ns(n: int) -> int:
    """Trace search times: below 1e11 seconds, below 1e14 milliseconds, else nanoseconds."""
    return n * 10**9 if n < 10**11 else n * 10**6 if n < 10**14 else n


def floor_div(a: Column, n: int) -> Column:
    """Integer division that rounds down, without doubles."""
    return F.call_function("div", a - F.pmod(a, F.lit(n)), F.lit(n).cast("long"))


def ceil_div(a: Column, n: int) -> Column:
    return -floor_div(-a, n)


def to_number(s: Column) -> Column:
    """A double, or null if the trimmed text is not a number."""
    return F.get(F.transform(F.array(F.trim(s)), lambda t: F.when(t.rlike(NUMBER), t.try_cast("double"))), F.lit(0))  # ``s`` is computed once


def number_text(x: float) -> str:
    """A number as the query API prints it: shortest digits, no exponent, ``+Inf``, ``-Inf``, ``NaN``."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    if x == int(x) and abs(x) < 1e22:
        return str(int(x))
    out = repr(x)
    if "e" in out:
        out = f"{x:.400f}".rstrip("0").rstrip(".") if abs(x) < 1 else str(int(x))
    return out
