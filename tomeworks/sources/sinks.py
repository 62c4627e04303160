"""Sinks: ranked lists, logs, judgments, reports, tables for print. All take a path of any store Spark can write to."""

from __future__ import annotations

import csv
import datetime
import io
import json
import unicodedata
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeworks.session import write_text
from tomeworks.sources.readers import LOG_SCHEMA


def list_lines(results: DataFrame) -> DataFrame:
    """query_nr, model, rank, value: lines of five tab-separated fields."""
    snippet = F.translate(F.coalesce("snippet", F.lit("")), "\t\r\n", "   ")
    start = F.coalesce(F.col("start_line").cast("string"), F.lit(""))
    value = F.concat_ws("\t", F.col("rank").cast("string"), "gutenberg_id", F.format_string("%.6f", "score"), snippet, start)
    return results.select("query_nr", "model", "rank", value.alias("value"))


def write_lists(results: DataFrame, path: str) -> None:
    """Distributed form: a folder for each query and model, lines in order of rank."""
    lines = list_lines(results).repartition("query_nr", "model").sortWithinPartitions("query_nr", "model", "rank")
    lines.select("query_nr", "model", "value").write.mode("overwrite").partitionBy("query_nr", "model").text(path)


def write_list_files(results: DataFrame, folder: str, expected: list[tuple[int, str]], most: int = 100) -> None:
    """One file <query>_<model>.tsv for each expected list, of at most so many lines, also where there are none."""
    out = {k: [] for k in expected}
    for r in list_lines(results.where(F.col("rank") <= most)).orderBy("query_nr", "model", "rank").toLocalIterator():
        out.setdefault((r["query_nr"], r["model"]), []).append(r["value"])
    for (query, model), lines in out.items():
        write_text(results.sparkSession, f"{folder}/{query}_{model}.tsv", "".join(x + "\n" for x in lines))


def append_log(spark: SparkSession, path: str, entries: Iterable[dict[str, object]]) -> None:
    """One line of JSON for each query, in a folder of such files."""
    now = datetime.datetime.now(datetime.UTC).isoformat(timespec="milliseconds")
    names = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
    rows = [tuple({"timestamp": now, **e}.get(n) for n in names) for e in entries]
    spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").json(path)


def append_judgments(spark: SparkSession, path: str, rows: list[tuple[str, str, int, str, int]]) -> None:
    """query_nr, model, rank, gutenberg_id, label, in a folder of CSV files with a header each."""
    judged = spark.createDataFrame(rows, "query_nr string, model string, rank int, gutenberg_id string, label int")
    judged.coalesce(1).write.mode("append").option("header", True).csv(path)


def write_report(spark: SparkSession, path: str, values: dict[str, object]) -> None:
    write_text(spark, path, json.dumps(values, indent=2, ensure_ascii=False) + "\n")


def write_table(df: DataFrame, path: str) -> list:
    """A CSV file of a table that is small by nature (a row for each list, or fewer); the rows are returned."""
    rows = df.collect()
    text = io.StringIO()
    out = csv.writer(text, lineterminator="\n")
    out.writerow(df.columns)
    out.writerows(["" if v is None else v for v in r] for r in rows)
    write_text(df.sparkSession, path, text.getvalue())
    return rows


def write_missing(missing: DataFrame, path: str) -> None:
    ids = missing.select(F.col("gutenberg_id").cast("string"))
    ids.sort(F.col("gutenberg_id").cast("long")).write.mode("overwrite").text(path)


def write_catalogue(flagged: DataFrame, path: str) -> None:
    """The merged catalogue in order of the numbers."""
    number = F.col("gutenberg_id").cast("long")
    flagged.withColumn("_n", number).repartitionByRange("_n").sortWithinPartitions("_n").drop("_n").write.mode("overwrite").parquet(path)


BUILD_UNITS = {"bytes": (1e6, "MB"), "seconds": (1, "s"), "second": (1, "per s"), "mb": (1, "MB")}


def performance_rows(build: DataFrame) -> DataFrame:
    """metric, value, unit: every filled number of a build report by its own name, bytes as megabytes, in order of name."""
    rows = []
    for name in sorted(build.columns):
        scale, unit = next((BUILD_UNITS[p] for p in reversed(name.split("_")) if p in BUILD_UNITS), (1, ""))
        number = F.col(name).cast("double") / scale
        shown = F.format_string("%.0f", number) if build.schema[name].dataType.simpleString() == "bigint" and scale == 1 else F.format_string("%.2f", number)
        rows.append(F.struct(F.lit(name).alias("metric"), F.when(F.col(name).isNotNull(), shown).alias("value"), F.lit(unit).alias("unit")))
    return build.select(F.inline(F.array(*rows))).where("value is not null")


def latency_rows(log: DataFrame) -> DataFrame:
    return log.select(
        "query",
        "model",
        F.format_string("%.2f", "elapsed_ms").alias("elapsed_ms"),
        "topk",
        "candidates_scored",
        F.col("phrase_fallback_used").alias("phrase_fallback")
    )


# Signs with a meaning of their own in print, and accents by their combining mark.
PRINT_SIGNS = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"} | {c: "\\" + c for c in "{}$&#_%"}
PRINT_ACCENTS = {"\u0300": "`", "\u0301": "'", "\u0302": "^", "\u0303": "~", "\u0308": '"', "\u030a": "r ", "\u030c": "v ", "\u0327": "c "}


def _printed(sign: str) -> str:
    base, mark = (unicodedata.normalize("NFD", sign) + "\0")[:2]
    return f"{{\\{PRINT_ACCENTS[mark]}{base}}}" if mark in PRINT_ACCENTS else PRINT_SIGNS.get(sign, sign)


def latex_escape(text: str) -> str:
    return "".join(map(_printed, unicodedata.normalize("NFC", text)))


def latex_table(header: Sequence[str], rows: Iterable[Sequence[object]], caption: str, label: str, group_by: int | None = None) -> str:
    """A table for print; a rule stands between groups of rows with one value in the grouping column."""
    body: list[str] = []
    before = None
    for row in rows:
        group = None if group_by is None else row[group_by]
        if body and group != before:
            body.append(r"\midrule")
        before = group
        body.append(" & ".join("" if v is None else latex_escape(str(v)) for v in row) + r" \\")
    lines = [
        r"\begin{table}[h]",
        r"\centering",
        rf"\caption{{{latex_escape(caption)}}}",
        rf"\label{{{label}}}",
        rf"\begin{{tabular}}{{{'l' * len(header)}}}",
        r"\toprule"
    ]
    lines += [" & ".join(map(latex_escape, header)) + r" \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"]
    return "\n".join(lines) + "\n"
