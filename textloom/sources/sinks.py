"""Sinks. Exports for people may be one file; all else is written by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jsonl(rows: DataFrame, path: str, single: bool = False, mode: str = "errorifexists") -> None:
    (rows.coalesce(1) if single else rows).write.mode(mode).json(path)


def by_value(rows: DataFrame, path: str, cols: list[str], fmt: str = "json", mode: str = "errorifexists") -> None:
    """One folder for each value; rows are dealt by value first, so each has few files."""
    rows.repartition(*[F.col(c) for c in cols]).write.mode(mode).partitionBy(*cols).format(fmt).save(path)


def parquet(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).parquet(path)


def csv(rows: DataFrame, path: str, single: bool = False, mode: str = "errorifexists") -> None:
    (rows.coalesce(1) if single else rows).write.mode(mode).option("header", True).csv(path)


def append(rows: DataFrame, path: str, fmt: str = "json") -> None:
    rows.write.mode("append").format(fmt).save(path)


def report(table: DataFrame, /, **counters: Column) -> DataFrame:
    """Counters of a table as one row."""
    return table.agg(*[c.alias(k) for k, c in counters.items()])


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown, for reports; more than ``most`` rows raise."""
    shown = rows.limit(most + 1).collect()
    if len(shown) > most:
        raise ValueError(f"more than {most} rows: no table for a report")
    cells = lambda xs: "| " + " | ".join("" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x) for x in xs) + " |"
    return "\n".join([cells(rows.columns), cells(["---"] * len(rows.columns)), *[cells(r) for r in shown]])
