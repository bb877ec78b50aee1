"""The build's report as Markdown (K05), from sums over its tables: nothing that grows with documents reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.convert import markdown_table


def report(tables: dict[str, DataFrame], title: str = "Corpus build", most: int = 20) -> str:
    """Totals by split and source, reasons, copies, the lines cut most often and the worst leaks."""
    book = tables["ledger"]
    text = lambda v: f"{v:,}" if isinstance(v, int) else f"{v:.3f}" if isinstance(v, float) else str(v)

    def block(name: str, rows: DataFrame) -> list[str]:
        found = [[text(v) for v in r] for r in rows.limit(1000).collect()]
        return [f"## {name}", markdown_table([rows.columns, *found], most_rows=1000) if found else "none"]

    sums = [F.count("*").alias("documents"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens")]
    live = book.filter("status <> 'skipped'")
    parts = [f"# {title}"]
    parts += block("Splits", live.groupBy("status").agg(*sums).orderBy("status"))
    parts += block("Sources", live.groupBy("source", "status").agg(*sums).orderBy("source", "status"))
    parts += block("Left out", book.filter("status = 'skipped'").groupBy("source", "reason").agg(F.count("*").alias("documents")).orderBy("source", F.desc("documents"), "reason"))
    if "duplicates" in tables:
        parts += block("Copies", tables["duplicates"].groupBy("kind").agg(F.count("*").alias("documents"), F.count_distinct("kept").alias("originals")).orderBy("kind"))
    if "boilerplate" in tables:
        parts += block("Repeated lines", tables["boilerplate"].orderBy(F.desc("documents"), "source", "key").limit(most))
    if "leakage" in tables:
        parts += block("Overlap of validation with training", tables["leakage"].orderBy(F.desc("overlap"), "id").limit(most))
    return "\n\n".join(parts) + "\n"
