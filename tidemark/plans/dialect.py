"""One SQL text for two engines: `[[spark::duckdb]]` marks the few places where they spell things differently."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_MARK = re.compile(r"\[\[(.*?)::(.*?)\]\]", re.S)
#: Plain decimal literals are read as doubles by both.
_DECIMAL = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])")
#: Added before rounding, so that values on a rounding boundary fall on one side in both engines.
NUDGE = "1.7e-10"


def spark_text(sql: str) -> str:
    return _DECIMAL.sub(r"\1e0", _MARK.sub(r"\1", sql))


def duckdb_text(sql: str) -> str:
    return _DECIMAL.sub(r"\1e0", _MARK.sub(r"\2", sql))


def either(spark: str, duckdb: str) -> str:
    """A query that Spark answers in another way than its SQL says: both whole, their marks resolved."""
    spark, duckdb = spark_text(spark), duckdb_text(duckdb)
    assert "::" not in spark and "]]" not in duckdb, "these end a mark"
    return f"[[{spark}::{duckdb}]]"


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The query over the Parquet tables it names; views are read lazily, so scans keep their pruning and pushdown."""
    text = spark_text(sql)
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text)


def query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, sql)


# --- expressions that both engines read alike -------------------------------------------------------------------


def div(a: str, b: str) -> str:
    """a / b, null where b is 0."""
    return f"(({a}) / nullif(({b}), 0))"


def within(fn: str, x: str, w: int, part: str = "symbol") -> str:
    """An aggregate over the wall-clock window (t - w, t]."""
    return f"{fn}({x}) OVER (PARTITION BY {part} ORDER BY t RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def rows(fn: str, x: str, n: int, part: str = "symbol") -> str:
    """An aggregate over the last n present rows."""
    return f"{fn}({x}) OVER (PARTITION BY {part} ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rows_full(fn: str, x: str, n: int, least: int | None = None) -> str:
    """The same, null until `least` (n by default) values are there."""
    return f"CASE WHEN {rows('count', x, n)} >= {least or n} THEN {rows(fn, x, n)} END"


def lag(x: str, k: int = 1, part: str = "symbol") -> str:
    """The value k present rows before."""
    return f"lag({x}, {k}) OVER (PARTITION BY {part} ORDER BY t)"


def lead(x: str, k: int = 1, part: str = "symbol") -> str:
    return f"lead({x}, {k}) OVER (PARTITION BY {part} ORDER BY t)"


def at_lag(x: str, k: int, part: str = "symbol") -> str:
    """The value exactly k time units before, or null: a one-value range frame instead of a self-join."""
    return f"max({x}) OVER (PARTITION BY {part} ORDER BY t RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)"


def so_far(fn: str, x: str, part: str) -> str:
    """A cumulative aggregate within a session."""
    return f"{fn}({x}) OVER (PARTITION BY {part} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def across(fn: str, x: str, part: str = "t") -> str:
    """An aggregate over the cross-section."""
    return f"{fn}({x}) OVER (PARTITION BY {part})"


def average_rank(x: str, part: str = "t") -> str:
    """Rank with ties averaged, of non-null values only."""
    rank = f"rank() OVER (PARTITION BY {part}, {x} IS NULL ORDER BY {x})"
    return f"CASE WHEN {x} IS NOT NULL THEN {rank} + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0 END"


def where(cond: str, x: str, other: str = "NULL") -> str:
    return f"CASE WHEN {cond} THEN {x} ELSE {other} END"


def root(x: str) -> str:
    """sqrt, with rounding below zero taken as zero."""
    return f"sqrt(CASE WHEN ({x}) < 0 THEN 0.0 ELSE ({x}) END)"


def paren(x: str) -> str:
    return f"({x})"


def log(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN ln({x}) END"


class Ols:
    """Guarded least squares over a window from six sums.

    Rows without x or y don't count. A variance under a relative floor of its sums is none: then slope, correlation and
    the residual are null. Two points lie on their line.
    """

    def __init__(self, name: str, x: str, y: str, w: int, over: Callable[[str, str, int], str] = within):
        self.p = f"{name}_{w}"
        ok = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL"
        parts = {"n": "1.0", "sx": x, "sy": y, "sxx": f"({x})*({x})", "syy": f"({y})*({y})", "sxy": f"({x})*({y})"}
        self.sums = {f"{self.p}_{k}": over("sum", where(ok, v), w) for k, v in parts.items()}

    def _(self, k: str) -> str:
        return f"{self.p}_{k}"

    @property
    def derived(self) -> dict[str, str]:
        n, sx, sy, sxx, syy, sxy = (self._(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy"))
        vx, vy = f"({n}*{sxx}-{sx}*{sx})", f"({n}*{syy}-{sy}*{sy})"
        return {
            self._("vx"): f"CASE WHEN {n} >= 2 AND {vx} > 1e-12*{sx}*{sx} AND {vx} > 1e-9*{n}*{sxx} THEN {vx} END",
            self._("vy"): f"CASE WHEN {n} >= 2 AND {vy} > 1e-12*{sy}*{sy} AND {vy} > 1e-9*{n}*{syy} THEN {vy} END",
            self._("cxy"): f"({n}*{sxy}-{sx}*{sy})",
        }

    @property
    def slope(self) -> str:
        return f"({self._('cxy')}/{self._('vx')})"

    @property
    def corr(self) -> str:
        c, vx, vy = self._("cxy"), self._("vx"), self._("vy")
        return f"CASE WHEN {vx} IS NULL OR {vy} IS NULL THEN NULL WHEN {self._('n')} = 2 THEN sign({c}) ELSE {c}/sqrt({vx}*{vy}) END"

    @property
    def r2(self) -> str:
        c, vx, vy = self._("cxy"), self._("vx"), self._("vy")
        return f"CASE WHEN {vx} IS NULL OR {vy} IS NULL THEN NULL WHEN {self._('n')} = 2 THEN 1.0 ELSE {c}*{c}/({vx}*{vy}) END"

    @property
    def mean_y(self) -> str:
        return f"({self._('sy')}/{self._('n')})"

    @property
    def residual_std(self) -> str:
        """Population standard deviation of the residuals, from four points on and above a relative floor."""
        n, c, vx = self._("n"), self._("cxy"), self._("vx")
        vy = f"({n}*{self._('syy')}-{self._('sy')}*{self._('sy')})"
        var = f"(({vy} - {c}*{c}/{vx})/({n}*{n}))"
        return f"CASE WHEN {n} >= 4 AND {var} > ({self.mean_y}*1e-6)*({self.mean_y}*1e-6) THEN sqrt({var}) END"


class Group:
    """A feature group: layers of named expressions over a keyed frame, each reading those before, and its outputs."""

    def __init__(self, name: str, frame: str, layers: Iterable[dict[str, str]], outputs: dict[str, str], keys: tuple[str, ...] = ("symbol", "t"), digits: int = 6):
        self.name, self.frame, self.layers, self.outputs, self.keys, self.digits = name, frame, [x for x in layers if x], outputs, keys, digits

    @property
    def features(self) -> list[str]:
        return list(self.outputs)

    def compute(self, frame: DataFrame) -> DataFrame:
        """The group's features on any frame with its columns."""
        for layer in self.layers:
            frame = frame.selectExpr("*", *(f"{spark_text(e)} AS {n}" for n, e in layer.items()))
        return frame.selectExpr(*self.keys, *(f"{spark_text(e)} AS {n}" for n, e in self.outputs.items()))

    def rounded(self, frame: DataFrame) -> DataFrame:
        out = self.compute(frame)
        return out.selectExpr(*self.keys, *(f"round(CAST({n} AS double) + {NUDGE}, {self.digits}) AS {n}" for n in self.outputs))

    def sql(self, frames: dict[str, str]) -> str:
        """The same for DuckDB, over the frame's own SQL."""
        text, last = f"WITH l0 AS ({duckdb_text(frames[self.frame])})", "l0"
        for k, layer in enumerate(self.layers, 1):
            text += f", l{k} AS (SELECT *, {', '.join(f'{duckdb_text(e)} AS {n}' for n, e in layer.items())} FROM {last})"
            last = f"l{k}"
        inner = f"SELECT {', '.join(self.keys)}, {', '.join(f'{duckdb_text(e)} AS {n}' for n, e in self.outputs.items())} FROM {last}"
        return f"{text} SELECT {', '.join(self.keys)}, {', '.join(f'round(CAST({n} AS DOUBLE) + {NUDGE}, {self.digits}) AS {n}' for n in self.outputs)} FROM ({inner})"
