"""Writing tables: partitioned Parquet, JSON lines, and a markdown report."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_tables(tables: dict[str, DataFrame], folder: str, by: list[str] | None = None) -> None:
    """Parquet by name; partition columns must have few values (not the workbook)."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(*by) if by else w).parquet(f"{folder}/{name}")


def write_json(documents: DataFrame, folder: str) -> None:
    """One JSON document a line, from a column json."""
    documents.select("json").write.mode("overwrite").text(folder)


def report(metrics: DataFrame) -> str:
    """Markdown of the small table of stage metrics."""
    rows = metrics.orderBy("stage", "metric").collect()
    return "\n".join(["| stage | metric | value |", "|---|---|---|", *(f"| {r['stage']} | {r['metric']} | {r['value']:g} |" for r in rows)])
