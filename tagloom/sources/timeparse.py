"""Times as text, read by formats that are induced from the column itself.

A text is reduced to its *shape*: what kind of run stands where (a year, one or two
digits, a month's name, ...). One aggregate by the texts' *masks* (every digit as 0; a
shape follows from the mask) finds the distinct shapes of the column
and the greatest first and second number of each; every shape gets one format, day
against month settled by those numbers, and a row is parsed once, by the format of
its shape. Text of no known shape is NULL, as is a date that does not exist.

Known are dates by year, month, day with any of ``- / .`` or blanks between, by day
or month first, with month names, or as eight digits; times with or without seconds,
fraction, and AM/PM, after a blank or ``T``, or as four or six digits. A weekday in
front is ignored; a trailing ``Z``, ``UTC`` or offset is taken off and applied, so
that the result is the wall clock of UTC. Two numbers that may both be months mean
month first, unless a row of the shape has a first number above 12 and none a second
one; if both occur, each row goes by its own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English names of months and weekdays.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

_ZONE = r"(?i) ?(?:z|utc|gmt|([+-])(\d\d):?(\d\d))$"
#: runs of digits by length: one or two, a year, HHmmss, yyyyMMdd, yyyyMMddHHmmss
_RUNS = ((r"\d{14}", "F"), (r"\d{8}", "E"), (r"\d{6}", "H"), (r"\d{4}", "Y"), (r"\d{1,2}", "D"))
#: masks of texts whose shape is known by the mask alone, the most frequent ones; others go by their own shape
USUAL = 256
_TIME = r"(?:(?P<gap>T| |, ?)(?:(?P<clock>D:D(?P<sec>:D(?P<frac>[.,]#+)?)?)(?P<half> ?P)?|(?P<packed>H|Y)))?"
_DATES = (
    (r"Y(?P<s>[-/. ])D(?P=s)D", "yyyy{s}M{s}d"),
    (r"D(?P<s>[-/. ])D(?P=s)Y", "{a}{s}{b}{s}yyyy"),
    (r"D(?P<s>[-/.])D(?P=s)D", "{a}{s}{b}{s}yy"),
    (r"D(?P<s>[-/ ])(?P<m>[MN])(?P<t>[-/ ]|, ?)Y", "d{s}{m}{t}yyyy"),
    (r"(?P<m>[MN])(?P<s>\.? )D(?P<t>,? )Y", "{m}{s}d{t}yyyy"),
    (r"Y(?P<s>[-/ ])(?P<m>[MN])(?P=s)D", "yyyy{s}{m}{s}d"),
    (r"E", "yyyyMMdd"),
    (r"F", "yyyyMMddHHmmss"),
)


def _plain(text: Column) -> Column:
    """The text without surplus blanks, a weekday in front, and a zone behind a time."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    t = F.regexp_replace(t, r"(?i)^(?:" + "|".join(f"{d[:3]}(?:{d[3:]})?" for d in WEEKDAYS) + r")\.?,? ", "")
    return F.when(F.instr(t, ":") > 0, F.regexp_replace(t, _ZONE, "")).otherwise(t)


def _offset_minutes(text: Column) -> Column:
    """Minutes that the zone behind a time is ahead of UTC."""
    t = F.trim(text)
    sign = F.regexp_extract(t, _ZONE, 1)
    minutes = F.regexp_extract(t, _ZONE, 2).try_cast("int") * 60 + F.regexp_extract(t, _ZONE, 3).try_cast("int")
    return F.when((F.instr(t, ":") == 0) | (sign == ""), F.lit(0)).when(sign == "-", -minutes).otherwise(minutes)


def shape_of(plain: Column) -> Column:
    """Shape of a text that :func:`_plain` gave."""
    s = F.regexp_replace(F.lower(plain), r"(?<=:\d{1,2}[.,]\d{0,8})\d", "#")
    for run, mark in _RUNS:
        s = F.regexp_replace(s, rf"(?<!\d){run}(?!\d)", mark)
    s = F.regexp_replace(s, r"(?<![a-z])(?:" + "|".join(MONTHS) + r")(?![a-z])", "N")
    s = F.regexp_replace(s, r"(?<![a-z])(?:" + "|".join(m[:3] for m in MONTHS) + r")(?![a-z])", "M")
    s = F.regexp_replace(s, r"(?<=D ?)[ap]m$", "P")
    # May is its own abbreviation
    s = F.when(F.instr(F.lower(plain), "may") > 0, F.replace(s, F.lit("N"), F.lit("M"))).otherwise(s)
    return F.regexp_replace(s, r"(?<=[DEY])t(?=[DHY])", "T")


def format_of(shape: str, day_first: bool = False) -> str | None:
    """Java pattern of a shape, None if it is not a time's."""
    for date, pattern in _DATES:
        found = re.fullmatch(date + ("" if date == "F" else _TIME), shape)
        if not found:
            continue
        g = found.groupdict()
        name = {"M": "MMM", "N": "MMMM"}.get(g.get("m") or "", "")
        out = pattern.format(s=g.get("s") or "", t=g.get("t") or "", m=name, a="d" if day_first else "M", b="M" if day_first else "d")
        if g.get("gap"):
            out += "'T'" if g["gap"] == "T" else g["gap"]
        if g.get("packed"):
            out += "HHmmss" if g["packed"] == "H" else "HHmm"
        if g.get("clock"):
            out += ("h" if g["half"] else "H") + ":m"
            out += ":s" if g["sec"] else ""
            out += g["frac"].replace("#", "S") if g["frac"] else ""
            out += g["half"].replace("P", "a") if g["half"] else ""
        return out
    return None


class Formats(dict):
    """Formats by shape; ``usual`` maps the most frequent masks of texts that are plain already to their shapes."""

    usual: dict[str, str] = {}


def _mask(text: Column) -> Column:
    """The text with every digit as 0: it tells all but the numbers, and a column has few of them."""
    return F.translate(text, "123456789", "0" * 9)


def induce(df: DataFrame, column: str) -> Formats:
    """Formats of every time's shape in the column; two where only a row itself tells day from month. One aggregate, by mask."""
    text = F.col(f"`{column}`").cast("string")
    number = lambda i: F.max(F.regexp_extract("plain", r"^(\d{1,2})\D+(\d{1,2})", i).try_cast("int"))
    masks = df.select(_mask(text).alias("mask"), _plain(text).alias("plain")).groupBy("mask").agg(F.count("*").alias("rows"), number(1).alias("one"), number(2).alias("two"))
    plain = _plain(F.col("mask"))
    masks = masks.withColumn("shape", shape_of(plain)).withColumn("is_plain", plain == F.col("mask")).persist()
    try:
        shaped = masks.where(F.col("shape").rlike(r"^[-DEFHYMNPT#:/., ]+$"))
        out = Formats()
        for r in shaped.groupBy("shape").agg(F.max("one").alias("one"), F.max("two").alias("two")).collect():
            first, second = (r["one"] or 0) > 12, (r["two"] or 0) > 12
            orders = [False, True] if first and second else [first]
            if formats := list(dict.fromkeys(f for f in (format_of(r["shape"], o) for o in orders) if f)):
                out[r["shape"]] = formats
        usual = shaped.where(F.col("is_plain") & F.col("shape").isin(list(out))).orderBy(F.desc("rows"), "mask").limit(USUAL)
        out.usual = {r["mask"]: r["shape"] for r in usual.select("mask", "shape").collect()}
    finally:
        masks.unpersist()
    return out


def parse(text: Column, formats: dict[str, list[str]]) -> Column:
    """Zone-less time of a text by the formats of its shape."""
    # read as UTC and taken back to a wall clock by its microseconds: the session's zone, with its gaps, plays no part
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def read(plain: Column, conditions: dict[str, Column], otherwise: Column) -> Column:
        for s, known in conditions.items():
            instants = [F.try_to_timestamp(F.concat(plain, F.lit(" UTC")), F.lit(p + " VV")) for p in formats[s]]
            otherwise = F.when(known, F.timestamp_add("MICROSECOND", F.unix_micros(F.coalesce(*instants)), epoch)).otherwise(otherwise)
        return otherwise

    text = text.cast("string")
    plain = _plain(text)
    shape = shape_of(plain)
    out = read(plain, {s: shape == s for s in formats}, F.lit(None).cast("timestamp_ntz"))
    out = F.timestamp_add("MINUTE", -_offset_minutes(text), out)
    # a text with a usual mask needs no look at its shape: it is plain, without a zone, and the mask names the shape
    usual: dict[str, list[str]] = {}
    for mask, s in getattr(formats, "usual", {}).items():
        usual.setdefault(s, []).append(mask)
    return read(text, {s: _mask(text).isin(masks) for s, masks in usual.items()}, out)


def parse_times(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the zone-less time of ``column``'s text in ``out``; one aggregate while the plan is built."""
    return df.withColumn(out, parse(F.col(f"`{column}`"), induce(df, column)))
