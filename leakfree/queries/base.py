"""Query registry: a callable on Spark and, where SQL can say it, an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CUT = 0.4913

CTES: dict[str, str] = {}
CTE_NEEDS: dict[str, tuple[str, ...]] = {}


def cte(name: str, text: str, needs: tuple[str, ...] = ()) -> None:
    CTES[name] = text
    CTE_NEEDS[name] = needs


def sql(body: str, *needs: str) -> str:
    """``body`` preceded by the named common table expressions and what they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for n in CTE_NEEDS[name]:
            visit(n)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    head = ",\n".join(f"{n} as ({CTES[n]})" for n in ordered)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"


def query(name: str, oracle: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def r6(c: Column | str, digits: int = 6) -> Column:
    """Snap to a decimal grid, so that sums taken in another order give the same doubles.

    The cut points lie off the halves, where means of decimals often fall exactly.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = float(10**digits)
    return F.floor(c * F.lit(s) + F.lit(CUT)).cast("double") / F.lit(s)


def q6(expr: str, digits: int = 6) -> str:
    """SQL text of :func:`r6`."""
    s = f"{10**digits}.0::double"
    return f"(floor(({expr}) * {s} + {CUT}::double)::double / {s})"


def even(expr: str, digits: int) -> str:
    """SQL text of half-to-even rounding on the binary value."""
    return f"round_even(({expr})::double, {digits})"
