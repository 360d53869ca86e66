"""Result tables as CSV, JSON, LaTeX and plain text.  Results are aggregates, a row a system, so the texts are made by the driver."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import put_text

#: Columns of the results' table, and the places that they are written with.
RESULTS = {"system": None, "dataset": None, "scale": None, "difficulty": None, "recall_1": 4, "recall_10": 4, "recall_100": 4, "mrr": 4, "ndcg_10": 4, "ndcg_100": 4, "latency_mean_ms": 2, "latency_p99_ms": 2, "build_s": 2, "memory_mb": 1}
PARETO = {"system": None, "dataset": None, "scale": None, "ef": None, "recall_10": 4, "latency_mean_ms": 2, "qps": 1}


def formatted(results: DataFrame, columns: Mapping[str, int | None]) -> DataFrame:
    """Those columns as text, numbers with fixed places."""
    return results.select(*[(F.format_string(f"%.{n}f", F.col(c).cast("double")) if n is not None else F.col(c).cast("string")).alias(c) for c, n in columns.items()])


def write_csv(results: DataFrame, path: str, columns: Mapping[str, int | None] = RESULTS) -> None:
    formatted(results, columns).coalesce(1).write.option("header", True).csv(path)


def write_json(results: DataFrame, path: str) -> None:
    """A line a row, with all columns."""
    results.write.json(path)


def write_curves(points: DataFrame, path: str) -> None:
    """A line a system and dataset: {dataset, algorithm, curve: [{recall, qps}]} in order of recall, as index benchmarks have it."""
    curve = F.array_sort(F.collect_list(F.struct("recall", "qps")))  # a point a parameter
    points.groupBy("dataset", F.col("system").alias("algorithm")).agg(curve.alias("curve")).write.json(path)


def latex(rows: Sequence[Mapping], columns: Mapping[str, str], caption: str, label: str) -> str:
    """A table of rows, columns by name and heading; nulls are dashes."""
    cell = lambda x: "$-$" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x).replace("_", r"\_").replace("&", r"\&").replace("%", r"\%")
    head = " & ".join(columns.values())
    body = "\n".join(" & ".join(cell(r[c]) for c in columns) + r" \\" for r in rows)
    kinds = "l" + "c" * (len(columns) - 1)
    return "\n".join([r"\begin{table}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{kinds}}}", r"\toprule", head + r" \\", r"\midrule", body, r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def plain(rows: Sequence[Mapping], columns: Sequence[str]) -> str:
    """Columns in line, for terminals."""
    cells = [list(columns), *[["" if r[c] is None else f"{r[c]:.3f}" if isinstance(r[c], float) else str(r[c]) for c in columns] for r in rows]]
    width = [max(len(line[i]) for line in cells) for i in range(len(columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, width)).rstrip() for line in cells)


def write_report(results: DataFrame, folder: str, columns: Mapping[str, int | None] = RESULTS, caption: str = "Retrieval quality") -> None:
    """CSV, JSON, LaTeX and plain text of one table of results, which is small."""
    spark = results.sparkSession
    write_csv(results, f"{folder}/csv", columns)
    write_json(results.select(*columns), f"{folder}/json")
    rows = [r.asDict() for r in results.select(*columns).orderBy(*list(columns)[:2]).collect()]  # a row a system
    put_text(spark, f"{folder}/table.tex", latex(rows, {c: c.replace("_", " ") for c in columns}, caption, "tab:main"))
    put_text(spark, f"{folder}/table.txt", plain(rows, list(columns)))
    put_text(spark, f"{folder}/rows.json", json.dumps(rows))
