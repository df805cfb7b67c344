"""Spark SQL text for the heavy per-pair and per-sentence expressions.

Higher-order functions written with Python lambdas cost thousands of client
calls to build; the same expressions as SQL text are parsed once in the JVM.
Lambda variable names are unique per nesting level.
"""

from __future__ import annotations

WS = r"'(?U)\\s+'"   # SQL literal of the regex (?U)\s+


def words(x: str) -> str:
    return f"filter(split({x}, {WS}, -1), w_ -> w_ <> '')"


def overlap(a: str, b: str) -> str:
    """Size of the multiset intersection of two word arrays: per common word,
    the smaller of its two counts (what ``array_remove`` takes away)."""
    return (f"aggregate(array_intersect({a}, {b}), 0, (acc_o, u_o) -> acc_o + least("
            f"size({a}) - size(array_remove({a}, u_o)), size({b}) - size(array_remove({b}, u_o))))")


def dbl(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def plain(t: str, objs: str | None = None) -> str:
    """E6 text of a tuple ``t`` (optionally with another object list)."""
    objs = objs or f"{t}.objs"
    return (f"trim(concat({t}.subj, ' ', CASE WHEN size({t}.auxi) > 0 THEN concat(array_join({t}.auxi, ' '), ' ') "
            f"ELSE '' END, {t}.pred, ' ', array_join(transform({objs}, o_p -> concat(o_p.prep, ' ', o_p.obj)), ' ')))")


def all_orders(n: str) -> str:
    """Every order of 0..n-1 (n! arrays)."""
    return (f"CASE WHEN {n} > 0 THEN aggregate(sequence(1, {n}), array(CAST(array() AS ARRAY<INT>)), "
            f"(acc_q, i_q) -> flatten(transform(acc_q, p_q -> transform(filter(sequence(0, {n} - 1), "
            f"k_q -> NOT array_contains(p_q, k_q)), k2_q -> array_append(p_q, k2_q))))) "
            f"ELSE array(CAST(array() AS ARRAY<INT>)) END")


def let(value: str, var: str, body: str) -> str:
    """Evaluate ``value`` once as ``var`` inside ``body``."""
    return f"get(transform(array({value}), {var} -> {body}), 0)"
