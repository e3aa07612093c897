"""The formula function set as JVM-side Column builders.

Domain behaviour follows Spark (NaN / NULL / Infinity instead of Python
exceptions); ``strict=True`` reproduces the error for out-of-domain input with
``raise_error`` (still codegen'd, no Python in the plan).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXACT = 2.0**53


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(f"`{x}`") if "." in x and not x.startswith("`") else F.col(x)
    return F.lit(float(x))


def _guard(cond: Column, value: Column, message: str, strict: bool) -> Column:
    return F.when(cond, F.raise_error(F.lit(message))).otherwise(value) if strict else value


def abs_(x) -> Column:
    return F.abs(_c(x).cast("double"))


fabs = abs_


def sqrt(x, strict: bool = False) -> Column:
    x = _c(x)
    return _guard(x < 0, F.sqrt(x), "math domain error: sqrt of a negative number", strict)


def sin(x) -> Column:
    return F.sin(_c(x))


def cos(x) -> Column:
    return F.cos(_c(x))


def tan(x) -> Column:
    return F.tan(_c(x))


def log(x, base=None, strict: bool = False) -> Column:
    """``log(x)`` natural, ``log(x, base)``; note the reference argument order (Spark's ``log`` takes base first)."""
    x = _c(x)
    if base is None:
        value = F.ln(x)
    elif isinstance(base, Column):
        value = F.ln(x) / F.ln(base)
    else:
        value = F.log(float(base), x)
    return _guard(x <= 0, value, "math domain error: log of a non-positive number", strict)


def exp(x, strict: bool = False) -> Column:
    x = _c(x)
    value = F.exp(x)
    return _guard(F.isnotnull(x) & (value == float("inf")) & (x != float("inf")), value, "math range error: exp overflow", strict)


def asin(x, strict: bool = False) -> Column:
    x = _c(x)
    return _guard(F.abs(x) > 1, F.asin(x), "math domain error: asin outside [-1, 1]", strict)


def acos(x, strict: bool = False) -> Column:
    x = _c(x)
    return _guard(F.abs(x) > 1, F.acos(x), "math domain error: acos outside [-1, 1]", strict)


def atan(x) -> Column:
    return F.atan(_c(x))


def floor(x) -> Column:
    """Floor as double; values beyond 2^53 (already integral), NaN and infinities pass through."""
    x = _c(x).cast("double")
    return F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x)


def ceil(x) -> Column:
    x = _c(x).cast("double")
    return F.when(F.abs(x) < _EXACT, F.ceil(x).cast("double")).otherwise(x)


def min_(*xs) -> Column:
    if len(xs) == 1:
        return _c(xs[0]).cast("double")
    return F.least(*[_c(x).cast("double") for x in xs])


def max_(*xs) -> Column:
    if len(xs) == 1:
        return _c(xs[0]).cast("double")
    return F.greatest(*[_c(x).cast("double") for x in xs])


# Operators on plain numbers with Python semantics.
def power(a, b) -> Column:
    return F.pow(_c(a), _c(b))


def floordiv(a, b) -> Column:
    """``a // b`` as Python has it: what is left after the remainder, divided exactly."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    q = (a - pymod(a, b)) / b
    down = floor(q)
    return F.when(q - down > 0.5, down + 1).otherwise(down)


def pymod(a, b) -> Column:
    """``a % b`` with the sign of the divisor (Python): Spark's remainder, moved by one divisor where the signs differ."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    r = a % b
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def neg(a) -> Column:
    return -_c(a)


def pos(a) -> Column:
    return _c(a)


# The registered function names (case-sensitive) -> builder.
FUNCTIONS = {
    "abs": abs_,
    "sqrt": sqrt,
    "sin": sin,
    "cos": cos,
    "tan": tan,
    "log": log,
    "exp": exp,
    "fabs": fabs,
    "asin": asin,
    "acos": acos,
    "atan": atan,
    "floor": floor,
    "ceil": ceil,
    "min": min_,
    "max": max_,
}
