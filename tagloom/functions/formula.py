"""Formula columns evaluated in listed order.

Users write Spark SQL expressions (or Column objects); there is no custom
grammar. ``style="python"`` takes Python expressions instead, read by Python's
own ``ast`` module: the registered function names with their argument order,
``**``, ``//`` and ``%`` with Python's results, dotted tags and ``x[-2]`` lags.
For SQL text lagged inputs are declared up front and materialised by the chunked
series ``lag`` as columns named ``<tag>[-N]`` (write them back-quoted in SQL).
Consecutive ``withColumn`` projections collapse into one Project in Catalyst.
"""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import math as M
from tagloom.functions.registry import function
from tagloom.operators.series import SeriesSpec, lag_many


def lag_name(tag: str, n: int) -> str:
    return f"{tag}[-{abs(int(n))}]"


def resolve(df: DataFrame, name: str) -> str:
    """A bare instance name means its ``.out`` tag when only that exists."""
    if name in df.columns:
        return name
    if f"{name}.out" in df.columns:
        return f"{name}.out"
    raise KeyError(f"no column {name!r} or {name + '.out'!r}")


def with_bare_outputs(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add bare-name aliases ``X`` for every ``X.out`` column that has no ``X`` column."""
    added = []
    for c in df.columns:
        if c.endswith(".out"):
            bare = c[: -len(".out")]
            if bare and bare not in df.columns and bare not in added:
                df = df.withColumn(bare, F.col(f"`{c}`"))
                added.append(bare)
    return df, added


def _mentions(expr: str, name: str) -> bool:
    return re.search(r"(?<![\w.`])`?" + re.escape(name) + r"`?(?![\w`])", expr) is not None


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: M.floordiv, ast.Mod: M.pymod, ast.Pow: M.power}


def _tag_of(node: ast.expr) -> str:
    if isinstance(node, ast.Attribute):
        return f"{_tag_of(node.value)}.{node.attr}"
    if isinstance(node, ast.Name):
        return node.id
    raise ValueError(f"not a tag: {ast.unparse(node)}")


def python_column(text: str, df: DataFrame) -> Column:
    """Column of a Python expression over the tags of ``df`` and the registered functions."""

    def build(node: ast.expr) -> Column:
        match node:
            case ast.Constant(value=int() | float()):
                return F.lit(float(node.value))
            case ast.Name() | ast.Attribute():
                return F.col(f"`{resolve(df, _tag_of(node))}`")
            case ast.Subscript():
                return F.col(f"`{lag_name(_tag_of(node.value), ast.literal_eval(node.slice))}`")
            case ast.UnaryOp(op=ast.USub()):
                return -build(node.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return build(node.operand)
            case ast.BinOp() if type(node.op) in _BINARY:
                return _BINARY[type(node.op)](build(node.left), build(node.right))
            case ast.Call(func=ast.Name(), keywords=[]):
                return function(node.func.id)(*[build(a) for a in node.args])
        raise ValueError(f"not allowed in a formula: {ast.unparse(node)}")

    return build(ast.parse(text, mode="eval").body)


def python_lags(text: str) -> list[tuple[str, int]]:
    """(tag, n) of every ``tag[-n]`` in a Python expression."""
    return [(_tag_of(n.value), abs(ast.literal_eval(n.slice))) for n in ast.walk(ast.parse(text, mode="eval")) if isinstance(n, ast.Subscript)]


def formula_columns(
    df: DataFrame,
    formulas: Sequence[tuple[str, str | Column]],
    spec: SeriesSpec | None = None,
    lags: Mapping[str, Sequence[int]] | None = None,
    lag_default: float = 0.0,
    keep_lags: bool = False,
    style: str = "sql",
) -> DataFrame:
    """Add ``name = expr`` columns in order; a later formula sees earlier ones.

    A formula that mentions a formula defined *after* it is rejected (the
    reference silently reads the previous cycle's value there; write an
    explicit lag instead). ``lags={"x": [2]}`` provides column ``x[-2]``.
    """
    names = [n for n, _ in formulas]
    for i, (name, expr) in enumerate(formulas):
        if isinstance(expr, str):
            for later in names[i + 1 :]:
                if later not in df.columns and _mentions(expr, later):
                    raise ValueError(f"formula {name!r} refers to {later!r}, which is defined later")
    out, bare = with_bare_outputs(df)
    wanted = {(tag, abs(int(n))) for tag, ns in (lags or {}).items() for n in ns}
    if style == "python":
        wanted |= {x for _, expr in formulas if isinstance(expr, str) for x in python_lags(expr)}
    if wanted and spec is None:
        raise ValueError("lags need a SeriesSpec (series key and order)")
    lag_cols = [lag_name(tag, n) for tag, n in sorted(wanted)]
    if wanted:  # all of them in one pass
        out = lag_many(out, spec, [(resolve(out, tag), n, lag_name(tag, n)) for tag, n in sorted(wanted)], default=lag_default)
    for name, expr in formulas:
        col = expr if isinstance(expr, Column) else python_column(expr, out) if style == "python" else F.expr(expr)
        out = out.withColumn(name, col.cast("double"))
    drop = bare + ([] if keep_lags else lag_cols)
    return out.drop(*drop) if drop else out
