"""columns derived from an integer cycle index (no simulator loop).

``sim_time = start + cycle * cycle_time``; the time text is formatted from a
zone-less timestamp, so the session time zone never shifts it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.operators.sampling import sample_flag  # noqa: F401  (F5 lives with sampling)
from tagloom.schema import DEFAULT_CYCLE_TIME, WARN_EXEC_FRACTION

# Strftime directive -> Java DateTimeFormatter pattern.
STRFTIME_TO_JAVA = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%%": "%",
}


def strftime_to_java(fmt: str) -> str:
    """Translate a strftime format into a Spark datetime pattern (literal text quoted)."""
    out, lit, i = [], [], 0

    def flush():
        if lit:
            text = "".join(lit).replace("'", "''")
            out.append(f"'{text}'" if any(ch.isalpha() for ch in text) or "'" in text else text)
            lit.clear()

    while i < len(fmt):
        tok = fmt[i : i + 2]
        if tok in STRFTIME_TO_JAVA:
            flush()
            out.append(STRFTIME_TO_JAVA[tok])
            i += 2
        elif fmt[i] == "%":
            raise ValueError(f"unsupported strftime directive {tok!r}")
        else:
            lit.append(fmt[i])
            i += 1
    flush()
    return "".join(out)


def seconds_to_ntz(seconds: Column) -> Column:
    """Epoch seconds (double) -> TIMESTAMP_NTZ, microsecond resolution, truncated toward -inf."""
    us = F.floor(seconds * F.lit(1_000_000)).cast("long")
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def sim_time(cycle: str | Column, cycle_time: float = DEFAULT_CYCLE_TIME, start: float = 0.0) -> Column:
    """simulated epoch seconds of a cycle."""
    c = F.col(cycle) if isinstance(cycle, str) else cycle
    return F.lit(float(start)) + c.cast("double") * F.lit(float(cycle_time))


def time_text(seconds: Column, time_format: str | None = None) -> Column:
    """F6 label: strftime-formatted text of epoch seconds, or ISO text when no format is given."""
    ts = seconds_to_ntz(seconds)
    if time_format:
        return F.date_format(ts, strftime_to_java(time_format))
    # whole seconds decided arithmetically: one date_format per row, not two
    whole_second = F.pmod(F.floor(seconds * F.lit(1_000_000)).cast("long"), F.lit(1_000_000)) == 0
    return F.when(whole_second, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def overrun_flags(exec_seconds: Column, cycle_time: float = DEFAULT_CYCLE_TIME) -> list[Column]:
    """``exec_ratio = min(exec/cycle, 1)``, warn above 60 % of the cycle, overrun at >= cycle."""
    ct = F.lit(float(cycle_time))
    return [
        F.least(exec_seconds / ct, F.lit(1.0)).alias("exec_ratio"),
        (exec_seconds > ct * F.lit(WARN_EXEC_FRACTION)).alias("warn"),
        (exec_seconds >= ct).alias("overrun"),
    ]
