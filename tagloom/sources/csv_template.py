"""Template CSV export and scan.

Export plan: keep sampled rows, project ``time text + one text column per
tag`` (JVM expressions only), add the 1 or 2 header rows as rows with a lower
order key, range-partition by that key and sort inside partitions. Part files
then hold consecutive row ranges in name order, so they concatenate into the
one CSV (header rows in the first part); ``single_file=True`` coalesces to one
task for small exports.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators.clock import seconds_to_ntz, strftime_to_java, time_text
from tagloom.schema import METADATA_KEYS
from tagloom.sources import timeparse

# The second header row texts.
DEFAULT_TIME_DESCRIPTION = "时间戳"
DEFAULT_PARAM_DESCRIPTION = "某工业数据"


@dataclass(frozen=True)
class ExportTemplate:
    name: str
    time_column_name: str = "timeStamp"
    time_format: str = "%Y/%m/%d %H:%M:%S"
    header_rows: int = 1
    uppercase_column_names: bool = True

    def __post_init__(self):
        if self.header_rows not in (1, 2):
            raise ValueError(f"a template has one header row or two, not {self.header_rows!r}")


# The shipped templates.
TEMPLATES = {
    "ai_loop_tuning": ExportTemplate("ai_loop_tuning", "Timestamp", "%Y/%m/%d %H:%M:%S", 1),
    "pid_loop_tuning": ExportTemplate("pid_loop_tuning", "时间", "%Y-%m-%d %H:%M:%S", 1),
    "prediction": ExportTemplate("prediction", "timeStamp", "%Y-%m-%d %H:%M:%S", 2),
}
def template_from_mapping(name: str, data: dict) -> ExportTemplate:
    """Template of a parsed mapping: its known settings, whatever else it holds; absent ones keep their defaults."""
    known = {f.name for f in fields(ExportTemplate)} - {"name"}
    return ExportTemplate(name, **{k: v for k, v in data.items() if k in known})


def _scalar(text: str) -> object:
    if text[:1] in ("'", '"') and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    text = text.split(" #")[0].rstrip()
    known = {"true": True, "false": False, "null": None, "~": None, "": None}
    return known[text.lower()] if text.lower() in known else int(text) if text.lstrip("-").isdigit() else text


def template_from_file(path: str) -> ExportTemplate:
    """Template of a settings file on the driver: one ``key: value`` a line, ``#`` comments; deeper or other lines are not settings.

    The name is the file's, unless a ``name`` setting says otherwise.
    """
    with open(path, encoding="utf-8") as lines:
        pairs = [line.rstrip("\n").partition(":") for line in lines if line[:1].strip() and line[0] not in "#-"]
    data = {key.strip(): _scalar(value.strip()) for key, colon, value in pairs if colon}
    return template_from_mapping(data.get("name") or os.path.splitext(os.path.basename(path))[0], {k: v for k, v in data.items() if v is not None})


def register_template(template: ExportTemplate) -> ExportTemplate:
    """Make a template known by its name; replaces one of the same name."""
    TEMPLATES[template.name] = template
    return template


def load_template(name: str) -> ExportTemplate:
    if name not in TEMPLATES:
        raise FileNotFoundError(f"no export template named {name!r}")
    return TEMPLATES[name]


def list_templates() -> list[str]:
    return sorted(TEMPLATES)


def template_exists(name: str) -> bool:
    return name in TEMPLATES


def py_text_from_java(s: Column) -> Column:
    """Python ``str(float)`` text from Java's double text ``s`` (JVM only).

    Python prints plain decimals for 1e-4 <= |x| < 1e16 and ``d.ddde+XX``
    outside; Java switches at 1e-3 and 1e7, and spells NaN / Infinity
    differently. Java text without an exponent is already Python's; the rest is
    re-laid out from Java's digits (Java 17 can, in rare cases, print one digit
    more than the shortest round-trip form).
    """
    pat = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    sign = F.regexp_extract(s, pat, 1)
    d0 = F.regexp_extract(s, pat, 2)
    frac = F.regexp_replace(F.regexp_extract(s, pat, 3), "0+$", "")
    e = F.regexp_extract(s, pat, 4).cast("int")
    digits = F.concat(d0, frac)
    nd = F.length(digits)
    # 1e7 <= |x| < 1e16: plain decimal
    big = F.when(nd <= e + 1, F.concat(sign, F.rpad(digits, e + 1, "0"), F.lit(".0"))).otherwise(
        F.concat(sign, F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2))
    )
    # 1e-4 <= |x| < 1e-3: plain decimal
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    # scientific: mantissa d[.ddd] and a two-digit signed exponent
    mant = F.when(F.length(frac) == 0, d0).otherwise(F.concat(d0, F.lit("."), frac))
    exp_txt = F.concat(F.when(e < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(e).cast("string"), 2, "0"))
    sci = F.concat(sign, mant, F.lit("e"), exp_txt)
    return (
        F.when(s.isNull(), F.lit(None).cast("string"))
        .when(F.instr(s, "E") == 0, F.when(s == "NaN", F.lit("nan")).when(s == "Infinity", F.lit("inf")).when(s == "-Infinity", F.lit("-inf")).otherwise(s))
        .when((e >= 7) & (e < 16), big)
        .when(e == -4, small)
        .otherwise(sci)
    )


def py_double_text(x: Column) -> Column:
    """Python ``str(float)`` text of a double column."""
    return py_text_from_java(x.cast("double").cast("string"))


def value_text(col: Column, dtype: T.DataType) -> Column:
    """``str(value)`` as Python writes it into the CSV; NULL -> empty field."""
    if isinstance(dtype, T.BooleanType):
        return F.when(col, F.lit("True")).when(~col, F.lit("False"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return py_double_text(col.cast("double"))
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType)):
        return col.cast("string")
    return col.cast("string")


def export_columns(wide: DataFrame, extra_excluded: Sequence[str] = ()) -> list[str]:
    """Tag columns of the export, in schema order (all but metadata)."""
    skip = set(METADATA_KEYS) | set(extra_excluded)
    return [c for c in wide.columns if c not in skip]


def _sampled_rows(wide: DataFrame, template: ExportTemplate, exclude: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Sampled rows (missing/NULL ``need_sample`` = false) with the tag columns and ``_order`` = sim time."""
    if "need_sample" in wide.columns:
        rows = wide.filter(F.coalesce(F.col("need_sample").cast("boolean"), F.lit(False)))
    else:
        rows = wide.filter(F.lit(False))
    tags = export_columns(wide, exclude)
    names = [t.upper() if template.uppercase_column_names else t for t in tags]
    if len(set(names)) != len(names):
        raise ValueError("export column names collide after upper-casing")
    sim = F.coalesce(F.col("sim_time").cast("double"), F.lit(0.0)) if "sim_time" in wide.columns else F.lit(0.0)
    cycle = F.col("cycle_count").cast("long") if "cycle_count" in wide.columns else F.lit(0).cast("long")
    return rows.select(*[F.expr(_quoted(t)) for t in tags], sim.alias("_order"), cycle.alias("_tie")), tags, names


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text_rows(rows: DataFrame, types: dict, tags: list[str], names: list[str], template: ExportTemplate) -> DataFrame:
    """Text projection: time column first, then one text column per tag, plus ``_order``."""
    cols = [F.date_format(seconds_to_ntz(F.col("_order")), strftime_to_java(template.time_format)).alias(template.time_column_name)]
    # Doubles are formatted by one lambda over an array of all double tags: the
    # text rule exists once in the plan whatever the tag count. Inlined per
    # column it exceeds the generated-method size limit (slow fallback), and
    # per-column lambdas cost a row copy each (measured: 1.5x slower).
    doubles = [t for t in tags if isinstance(types[t], (T.DoubleType, T.FloatType))]
    pos = {t: i for i, t in enumerate(doubles)}
    staged = rows
    if doubles:
        # as SQL text: a call to the JVM each for hundreds of columns would cost more than a small export
        java_text = F.expr("array(" + ", ".join(f"cast({_quoted(t)} AS double)" for t in doubles) + ")").cast("array<string>")  # compiled
        staged = rows.withColumn("_dtxt", F.transform(java_text, py_text_from_java))
    for t, n in zip(tags, names):
        if t in pos:
            cols.append(F.expr(f"_dtxt[{pos[t]}] AS {_quoted(n)}"))
        else:
            cols.append(value_text(F.col(f"`{t}`"), types[t]).alias(n))
    return staged.select(*cols, "_order", *(["_tie"] if "_tie" in rows.columns else []))


def export_projection(wide: DataFrame, template: ExportTemplate, exclude: Sequence[str] = ()) -> DataFrame:
    """S11 rows as text, time first (columns ``[time_column_name, TAG1, ...]`` + ``_order``)."""
    rows, tags, names = _sampled_rows(wide, template, exclude)
    return _text_rows(rows.drop("_tie"), {t: wide.schema[t].dataType for t in tags}, tags, names, template)


def export_csv(wide: DataFrame, path: str, template: ExportTemplate | str, single_file: bool = False, exclude: Sequence[str] = (), num_partitions: int | None = None) -> int:
    """Write the template CSV under ``path``; returns 0 when there is nothing to export (no file), else 1.

    Plan: sampled raw rows are range-partitioned and sorted by sim time (the
    range sampling job only evaluates the cheap raw rows); text is built after
    the exchange, once. The header rows are a one-partition frame unioned in
    front: a union keeps its children's partition order, so part files in
    name order concatenate into the CSV (header first). ``single_file`` builds the
    text in all tasks and sorts and writes it in one.
    """
    template = load_template(template) if isinstance(template, str) else template
    rows, tags, names = _sampled_rows(wide, template, exclude)
    if rows.isEmpty():
        return 0
    spark = wide.sparkSession
    n = 1 if single_file else (num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    types = {f.name: f.dataType for f in wide.schema.fields}
    if n == 1:  # the text is made by all tasks, before the rows meet in one
        text = _text_rows(rows, types, tags, names, template).repartition(1).sortWithinPartitions("_order", "_tie")
    else:
        text = _text_rows(rows.repartitionByRange(n, "_order", "_tie").sortWithinPartitions("_order", "_tie"), types, tags, names, template)
    text = text.drop("_order", "_tie")
    if single_file and template.header_rows == 1:
        out = text.toDF(template.time_column_name, *names).write.option("header", True)  # one file has one header: the writer's
    else:
        # literals over a range: a frame made of Python rows costs a third of a small export
        titles = [template.time_column_name, *names]
        described = [DEFAULT_TIME_DESCRIPTION] + [DEFAULT_PARAM_DESCRIPTION] * len(names)
        header = spark.range(0, template.header_rows, 1, 1)
        hdr = header.select(*[F.when(F.col("id") == 0, F.lit(t)).otherwise(F.lit(d)).alias(t) for t, d in zip(titles, described)])
        allrows = hdr.union(text)
        out = (allrows.coalesce(1) if single_file else allrows).write.option("header", False)
    out.mode("overwrite").options(escape='"', emptyValue="", nullValue="", lineSep="\r\n", encoding="UTF-8").csv(path)
    return 1


# Time formats tried, in order, when reading a time column.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_time(col: Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """First format that parses wins; unparseable -> NULL (NaT)."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)).cast("timestamp_ntz") for f in formats])


def to_number(col: Column) -> Column:
    """Numeric coercion, bad text -> NULL."""
    return F.trim(col).try_cast("double")


def read_template_csv(spark: SparkSession, path: str, template: ExportTemplate | str | None = None) -> DataFrame:
    """Scan a template CSV: header row, optional description row dropped, time parsed, tags numeric.

    Works for one file or a folder of ordered part files (Spark's ``header``
    option would drop the first line of *every* part): columns are named from
    the first line of the first file; that line and, for a template with two
    header rows, the second line of that file are left out, however often data
    repeats their text. The time column comes from the template if present in the
    header, else the first column; its formats are induced from its texts
    (:mod:`tagloom.sources.timeparse`). Returns ``time`` (TIMESTAMP_NTZ, NULL when
    unparseable), the time text as ``time_text``, then every tag as DOUBLE.
    """
    template = load_template(template) if isinstance(template, str) else template
    opts = {"header": False, "ignoreLeadingWhiteSpace": True, "encoding": "UTF-8", "inferSchema": False}
    raw = spark.read.options(**opts).csv(path)
    width = len(raw.columns)
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    # the first file that is not empty, by the files' sizes; by their rows only if it holds none
    listed = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).agg(F.min("_metadata.file_path")).first()[0]
    top = raw.filter((F.col("_file") == listed) & (F.col("_block") == 0)).head(2)
    first = listed if top else raw.agg(F.min("_file")).first()[0]
    if first is None:
        raise FileNotFoundError(path)
    top = top or raw.filter((F.col("_file") == first) & (F.col("_block") == 0)).head(2)
    names = [str(v).strip() if v is not None else f"_c{i}" for i, v in enumerate(top[0][:width])]
    heads = top[: 2 if template is not None and template.header_rows == 2 else 1]
    # Rows of the first block that read like a header row: as many as there are header rows go. More of them are data;
    # they all have the same text, so any of them can be put back.
    wanted = Counter(tuple(row[:width]) for row in heads)
    same = [reduce(and_, [F.col(raw.columns[i]).eqNullSafe(F.lit(row[i])) for i in range(width)]) for row in wanted]
    opening = (F.col("_file") == first) & (F.col("_block") == 0)
    found = raw.filter(opening).agg(*[F.count_if(x) for x in same]).first()
    columns = raw.columns[:width]
    raw = raw.filter(~(opening & reduce(or_, same))).select(*columns)
    for (row, headers), there in zip(wanted.items(), found):
        if there > headers:
            raw = raw.unionByName(spark.range(there - headers).select(*[F.lit(v).cast("string").alias(c) for c, v in zip(columns, row)]))
    raw = raw.toDF(*names)
    time_col = template.time_column_name if template and template.time_column_name in names else names[0]
    tc = F.col(f"`{time_col}`")
    tags = [c for c in names if c != time_col]
    return raw.select(
        timeparse.parse(tc, timeparse.induce(raw, time_col)).alias("time"),
        tc.alias("time_text"),
        *[to_number(F.col(f"`{t}`")).alias(t) for t in tags],
    )


__all__ = [
    "ExportTemplate",
    "TEMPLATES",
    "export_csv",
    "export_projection",
    "load_template",
    "parse_time",
    "read_template_csv",
    "time_text",
    "to_number",
    "value_text",
]
