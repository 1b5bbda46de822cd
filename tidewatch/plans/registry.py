"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, Callable[[], str]] = {}

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# Halving a four-digit decimal often ends exactly between two six-digit values;
# both sides add this before rounding, so the last bit of a sum does not decide.
NUDGE = 1e-9
_REAL = (T.FloatType, T.DoubleType, T.DecimalType)


def tidy(df: DataFrame) -> DataFrame:
    """Plain comparable columns: whole numbers as long, reals rounded to six digits."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _WHOLE):
            c = c.cast("long")
        elif isinstance(f.dataType, _REAL):
            c = F.round(c.cast("double") + NUDGE, 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def as_text(df: DataFrame, columns: str) -> DataFrame:
    """Booleans that may be null, as "true"/"false"/null."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns.split()})


def query(name: str, sql: Callable[[], str] | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(configure(spark), sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# --- SQL building blocks ----------------------------------------------------

_BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, body: str, *needs: str) -> None:
    _BLOCKS[name] = (needs, body)


def sql(body: str, *needs: str, reals: str = "", flags: str = "") -> Callable[[], str]:
    """``body`` with the named blocks as CTEs; columns in ``reals`` rounded to six digits.

    ``flags`` are three-valued booleans, compared as text (see ``as_text``).  Resolved on demand, so blocks may be registered in any order.
    """
    def build() -> str:
        ordered: list[str] = []

        def visit(n: str) -> None:
            if n not in ordered:
                for d in _BLOCKS[n][0]:
                    visit(d)
                ordered.append(n)

        for n in needs:
            visit(n)
        ctes = [f"{n} AS ({_BLOCKS[n][1].strip()})" for n in ordered] + [f"final_ AS ({body.strip()})"]
        fixes = ", ".join(f"round(CAST({c} AS DOUBLE) + 1e-9, 6) + 0 AS {c}" for c in reals.split())
        texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in flags.split())
        fixes = ", ".join(x for x in (fixes, texts) if x)
        star = f"* REPLACE ({fixes})" if fixes else "*"
        return "WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT {star} FROM final_"

    return build
