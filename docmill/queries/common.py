"""Shared parts of the queries: table access, rendered texts and the query book."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docmill.operators.sizing import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query and, when plain SQL can state its result, that SQL."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table for costly per-row work: only the named columns, on all cores."""
    df = table(spark, sf_dir, name)
    return spread(df.select(*columns) if columns else df)


# Names without digits: the letters A-J stand for 0-9.  The same text works in both SQL dialects.
def code(expr: str, width: int = 9) -> str:
    return f"translate(lpad(cast({expr} as varchar(20)), {width}, '0'), '0123456789', 'ABCDEFGHIJ')"


def padded(expr: str, width: int) -> str:
    return f"lpad(cast({expr} as varchar(20)), {width}, '0')"


def day(expr: str, start: str = "1950-01-01", span: int = 20000) -> str:
    """A date spread by key; the same text works in both SQL dialects."""
    return f"(date '{start}' + cast(({expr}) * 37 % {span} as int))"


def iso(date: str) -> str:
    """ISO text of a date, in either dialect."""
    return f"cast({date} as varchar(10))"


_MONTHS = (
    "'Januari','Februari','Maret','April','Mei','Juni','Juli','Agustus','September','Oktober','November','Desember'"
)


def dmy(date: str, sep: str = "-") -> str:
    """Day-first text of a date (Spark)."""
    return f"date_format({date}, 'dd{sep}MM{sep}yyyy')"


def worded(date: str) -> str:
    """``d Month yyyy`` with the Indonesian month (Spark)."""
    return f"concat(day({date}), ' ', element_at(array({_MONTHS}), month({date})), ' ', year({date}))"


def lines(*parts: str) -> str:
    """Text of several lines; a null part leaves its line out (Spark)."""
    return f"concat_ws('\\n', {', '.join(parts)})"


def with_line_ends(key: str, text: str) -> str:
    """CRLF line ends on every tenth key, trailing blanks on another tenth (Spark)."""
    return (
        f"case {key} % 10 when 5 then replace({text}, '\\n', '\\r\\n') "
        f"when 6 then replace({text}, '\\n', '\\t \\n') else {text} end"
    )
