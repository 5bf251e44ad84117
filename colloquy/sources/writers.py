"""Sinks: turn logs, reports, crosswalks, and small driver-side files."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.features import DIMENSIONS, ITEMS


def write_jsonl(turns: DataFrame, path: str, keep_nulls: bool = False) -> None:
    """One object a line; null fields are left out unless asked for."""
    turns.write.mode("overwrite").option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A small report as one CSV file; lists as JSON."""
    from pyspark.sql import functions as F

    flat = report.select(*(F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in report.dtypes))
    flat.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_crosswalk(crosswalk: DataFrame, path: str) -> None:
    """Apart from the corpus, as it undoes the pseudonyms."""
    crosswalk.write.mode("overwrite").csv(path, header=True)


def put(spark: SparkSession, text: str, path: str) -> None:
    """A text file by Spark's file systems, so that it lies beside the tables that Spark writes."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(value: object, path: str) -> None:
    Path(path).write_text(json.dumps(value, indent=2, default=str), encoding="utf-8")


def latex_table(rows: list[dict], caption: str, label: str) -> str:
    escape = lambda x: "".join("\\" + c if c in "&%$#_{}" else c for c in str(x))
    cols = list(rows[0]) if rows else []
    body = [" & ".join(escape(r[c]) for c in cols) + r" \\" for r in rows]
    head = " & ".join(escape(c) for c in cols) + r" \\"
    return "\n".join([r"\begin{table}", rf"\caption{{{escape(caption)}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(cols)}}}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}", r"\end{table}"])


def lavaan(items: DataFrame, folder: str) -> str:
    """The items as CSV and an R script that fits five factors and one to ordered items and tests them; its path."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    with (out / "items.csv").open("w", newline="") as f:
        w = csv.writer(f)
        w.writerow(ITEMS)
        for row in items.select(*ITEMS).toLocalIterator():
            w.writerow(row)
    model = "\n".join(f"{d} =~ " + " + ".join(f"{d}_i{k}" for k in range(1, 6)) for d in DIMENSIONS)
    script = f"""library(lavaan)
items <- read.csv("items.csv")
model <- '
{model}
'
fit <- cfa(model, data = items, ordered = names(items), estimator = "WLSMV")
print(fitMeasures(fit, c("cfi.scaled", "tli.scaled", "rmsea.scaled", "srmr")))
summary(fit, standardized = TRUE)
single <- cfa(paste("G =~", paste(names(items), collapse = " + ")), data = items, ordered = names(items), estimator = "WLSMV")
print(lavTestLRT(single, fit))
"""
    (out / "model.R").write_text(script)
    return str(out / "model.R")
