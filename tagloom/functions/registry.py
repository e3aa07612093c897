"""User extension points.

U1 ``register_function``: a scalar float -> float function. Column builders
(JVM expressions) are preferred; a plain Python callable becomes a vectorised
pandas UDF (Arrow batches), also registered for SQL formulas.

U2 ``register_algorithm`` / ``register_model``: a keyed step function
``step(state, row) -> (state, outputs)`` with defaults; run over a series chunk
after chunk by :mod:`tagloom.operators.program` (batch) or by
``transformWithState`` (streams). A program that can say what a row does to the
state as an element of an associative operation (``lift``, ``combine``, ``act``)
runs on all chunks at once. Names are case-insensitive.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.math import FUNCTIONS

_FUNCTIONS: dict[str, Callable[..., Column]] = dict(FUNCTIONS)
_PROGRAMS: dict[str, "Program"] = {}


def register_function(name: str, fn: Callable, spark: SparkSession | None = None, column_builder: bool = False) -> Callable[..., Column]:
    """Register ``name`` (case-sensitive). ``column_builder=True``: ``fn`` maps Columns to a Column.

    Otherwise ``fn`` is a float function; it is vectorised with ``numpy.vectorize``
    inside a pandas UDF, and registered in the session for SQL when given.
    """
    if not name or not callable(fn):
        raise ValueError("register_function needs a name and a callable")
    if column_builder:
        builder = fn
    else:
        import numpy as np

        vec = np.vectorize(fn, otypes=[float])

        @F.pandas_udf("double")
        def udf(*cols: pd.Series) -> pd.Series:
            return pd.Series(vec(*[c.to_numpy(dtype=float) for c in cols]))

        if spark is not None:
            spark.udf.register(name, udf)

        def builder(*args):
            return udf(*[a if isinstance(a, Column) else F.lit(float(a)) for a in args])

    _FUNCTIONS[name] = builder
    return builder


def function(name: str) -> Callable[..., Column]:
    return _FUNCTIONS[name]


def functions() -> list[str]:
    return sorted(_FUNCTIONS)


@dataclass(frozen=True)
class Program:
    """A keyed step program: ``step(state, inputs, params) -> (state, outputs)``.

    Associative form (optional, all three or none): ``lift(inputs, params)`` is the
    element of a row, ``combine(a, b)`` the element of ``a``'s rows followed by
    ``b``'s, ``act(state, element)`` the state that the rows of ``element`` lead to.
    Elements and states are JSON values; ``act(s, combine(a, b))`` must equal
    ``act(act(s, a), b)``, and ``act`` of a row's element what ``step`` does.
    """

    name: str
    kind: str  # "algorithm" | "model"
    step: Callable
    init: Callable[[Mapping[str, float]], object]
    outputs: tuple[str, ...]
    defaults: Mapping[str, float] = field(default_factory=dict)
    stored_attributes: tuple[str, ...] = ()
    lift: Callable | None = None
    combine: Callable | None = None
    act: Callable | None = None

    def __post_init__(self):
        if len({f is None for f in (self.lift, self.combine, self.act)}) > 1:
            raise ValueError(f"{self.name}: an associative program needs lift, combine and act")

    def params(self, **overrides) -> dict[str, float]:
        p = dict(self.defaults)
        p.update(overrides)
        return p


def _register(kind: str, program: Program) -> Program:
    key = program.name.upper()
    _PROGRAMS[key] = replace(program, kind=kind)
    return _PROGRAMS[key]


def register_algorithm(program: Program) -> Program:
    return _register("algorithm", program)


def register_model(program: Program) -> Program:
    return _register("model", program)


def _load_builtins() -> None:
    # built-in programs (VALVE, LAG, SAMPLER, TOTAL) register on import; imported
    # lazily because that module itself imports this registry
    import tagloom.streaming.programs  # noqa: F401


def program(name: str) -> Program:
    _load_builtins()
    return _PROGRAMS[name.upper()]


def programs() -> list[str]:
    _load_builtins()
    return sorted(_PROGRAMS)
