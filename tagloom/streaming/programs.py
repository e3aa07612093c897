"""Built-in keyed step programs (U2) used by the streaming state operator (T5).

Each program is ``step(state, row, params) -> (state, outputs)`` over one
series, rows in event-time order; state is JSON-serialisable.
"""

from __future__ import annotations

from tagloom.functions.registry import Program, register_algorithm, register_model
from tagloom.operators.fold import limited_step, travel_per_cycle


def _valve_init(p):
    return [p["initial_opening"], p["initial_opening"]]


def _valve_step(state, row, p):
    opening, goal = state
    lo, hi = p["min_opening"], p["max_opening"]
    if (wanted := row["target"]) is not None:
        goal = hi if wanted != wanted else min(max(wanted, lo), hi)  # NaN is the largest value, as in the batch operator
    opening = limited_step(opening, goal, lo, hi, travel_per_cycle(lo, hi, p["full_travel_time"], p["cycle_time"]))
    return [opening, goal], {"current_opening": opening}


# Valve defaults.
VALVE = register_model(
    Program(
        "VALVE",
        "model",
        _valve_step,
        _valve_init,
        ("current_opening",),
        {"min_opening": 0.0, "max_opening": 100.0, "full_travel_time": 10.0, "initial_opening": 0.0, "cycle_time": 0.5},
        ("current_opening", "min_opening", "max_opening", "full_travel_time", "initial_opening", "target_opening"),
    )
)


def _lag_init(p):
    return {"buf": []}


def _lag_step(s, row, p):
    n = int(abs(p["n"]))
    buf = s["buf"]
    out = row["value"] if n == 0 else (buf[-n] if len(buf) >= n else p.get("default", 0.0))
    buf.append(row["value"])
    if len(buf) > max(n, 1):
        del buf[: len(buf) - max(n, 1)]
    return s, {"lagged": out}


LAG = register_algorithm(Program("LAG", "algorithm", _lag_step, _lag_init, ("lagged",), {"n": 1, "default": 0.0}))


def _sampler_init(p):
    return {"last": None}


def _sampler_step(s, row, p):
    t = row["us"]
    keep = s["last"] is None or t - s["last"] >= p["interval_us"]
    if keep:
        s["last"] = t
    return s, {"kept": keep}


SAMPLER = register_algorithm(Program("SAMPLER", "algorithm", _sampler_step, _sampler_init, ("kept",), {"interval_us": 1_000_000}))


def _total_lift(row, p):
    return (row["value"] or 0.0) * p["dt"]


def _total_step(state, row, p):
    state += _total_lift(row, p)
    return state, {"total": state}


def _add(a, b):
    return a + b


# the integral of a value over the cycles (a null adds nothing)
TOTAL = register_algorithm(Program("TOTAL", "algorithm", _total_step, lambda p: 0.0, ("total",), {"dt": 0.5}, lift=_total_lift, combine=_add, act=_add))
