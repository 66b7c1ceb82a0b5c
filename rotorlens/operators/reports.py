"""Reports as Markdown: rows (at, line) made from metric tables, so that a report is a query like any other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fusion import number


def lines(spark, texts: list[str], at: int = 0) -> DataFrame:
    return spark.createDataFrame([(at + k, t) for k, t in enumerate(texts)], "at long, line string")


def table(rows: DataFrame, columns: dict[str, Column], order: list, at: int) -> DataFrame:
    """A Markdown table of rows in order; columns: heading to cell (a string column)."""
    from pyspark.sql import Window

    head = lines(rows.sparkSession, ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)], at)
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("—")) for c in columns.values()]), F.lit(" |"))
    # A table that people read is short.
    return head.unionByName(rows.select((F.row_number().over(Window.orderBy(*order)) + at + 1).cast("long").alias("at"), cells.alias("line")))


def confusion(counts: DataFrame, labels: list[str], at: int) -> DataFrame:
    """Rows are truth, columns prediction, with the recall; counts: truth, pred, n by place in labels."""
    names = F.array(*[F.lit(x) for x in labels])
    wide = counts.groupBy("truth").agg(*[F.sum(F.when(F.col("pred") == k, F.col("n"))).alias(f"p{k}") for k in range(len(labels))])
    whole = reduce(lambda a, b: a + b, [F.col(f"p{k}") for k in range(len(labels))])
    hit = F.get(F.array(*[F.col(f"p{k}") for k in range(len(labels))]), F.col("truth"))
    cell = lambda k: F.format_string("%,d", F.col(f"p{k}"))
    recall = F.format_string("%.3f", F.when(whole > 0, hit / whole).otherwise(0.0))
    return table(wide, {"": F.concat(F.lit("**"), F.get(names, F.col("truth")), F.lit("**")), **{x: cell(k) for k, x in enumerate(labels)}, "recall": recall}, ["truth"], at)


def section(spark, title: str, level: int, at: int, text: str = "") -> DataFrame:
    return lines(spark, ["", "#" * level + " " + title, *([text] if text else []), ""], at)


def joined(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def figures(pooled: DataFrame, by_unit: DataFrame, curve: DataFrame, counts: DataFrame, labels: list[str], title: str) -> DataFrame:
    """The report of a group-holdout run. pooled: n, accuracy, macro_f1, majority_baseline, recordings, recording_acc;
    by_unit: unit, n, accuracy, reason; curve: pooled, accuracy; counts: truth, pred, n."""
    spark = pooled.sparkSession
    spread = by_unit.agg(F.avg("accuracy").alias("m"), F.stddev_samp("accuracy").alias("s"), F.count("accuracy").alias("k"))
    one = pooled.join(F.broadcast(spread))
    shown = {
        "Window accuracy": number(F.col("accuracy")), "Macro-F1": number(F.col("macro_f1")), "Per-recording accuracy": number(F.col("recording_acc")),
        "Majority-class baseline": number(F.col("majority_baseline")), "Windows / recordings": F.format_string("%,d / %,d", "n", "recordings"),
        "Per-group accuracy": F.concat(number(F.col("m")), F.lit(" ± "), number(F.col("s")), F.lit(" (SEM "), number(F.col("s") / F.sqrt("k")), F.lit(", n="), F.col("k").cast("string"), F.lit(")")),
    }
    metric = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("name"), value.alias("value")) for k, (name, value) in enumerate(shown.items())]))
    head = one.select(metric.alias("m")).select("m.*")
    return joined(
        section(spark, title, 1, 0), table(head, {"Metric": F.col("name"), "Value": F.col("value")}, ["k"], 10),
        section(spark, "Confusion matrix", 2, 100, "Rows are truth, columns are prediction."), confusion(counts, labels, 110),
        section(spark, "By group", 2, 1000), table(by_unit, {"Group": F.col("unit").cast("string"), "Windows": F.format_string("%,d", "n"), "Accuracy": number(F.col("accuracy")), "Note": F.coalesce("reason", F.lit(""))}, [F.asc_nulls_last("accuracy"), "unit"], 1010),
        section(spark, "Pooling recordings", 2, 1_000_000), table(curve, {"Recordings": F.col("pooled").cast("string"), "Accuracy": number(F.col("accuracy"))}, ["pooled"], 1_000_010),
    )


def controls(found: DataFrame, at: int) -> DataFrame:
    """Table of batch_control(): what the same features tell about a row's batch."""
    split = F.when(F.col("leaky"), "shuffled **(leaky reference)**").otherwise("leave-one-group-out")
    cells = {"Target": F.col("target"), "Split": split, "Accuracy": number(F.col("accuracy")), "Macro-F1": number(F.col("macro_f1")), "Baseline": number(F.col("majority_baseline"))}
    return table(found, cells, ["target", "leaky"], at)


def compared(a: DataFrame, b: DataFrame, names: tuple[str, str], margin: float, at: int) -> DataFrame:
    """Two learners on the same protocols (protocol, accuracy, macro_f1) and whether the first is ahead by a margin."""
    met = a.select("protocol", F.col("macro_f1").alias("fa")).join(b.select("protocol", F.col("macro_f1").alias("fb")), "protocol", "full_outer")
    verdict = F.when(F.col("fa").isNull() | F.col("fb").isNull(), "NOT RUN").when(F.col("fa") - F.col("fb") > margin, names[0]).when(F.col("fb") - F.col("fa") > margin, names[1]).otherwise("no difference")
    return table(met, {"Protocol": F.col("protocol"), names[0]: number(F.col("fa")), names[1]: number(F.col("fb")), "Ahead": verdict}, ["protocol"], at)


def spliced(document: str, heading: str, text: str, anchor: str) -> str:
    """document with the section `heading` (up to the anchor) replaced by text, or with text put before the anchor."""
    if anchor not in document:
        raise ValueError(f"no anchor {anchor!r}")
    start = document.find(heading)
    end = document.index(anchor, max(start, 0))
    return document[: start if start >= 0 else end] + text.rstrip() + "\n\n" + document[end:]


def text_of(report: DataFrame) -> str:
    """The report as one string; reports are short."""
    return "\n".join(r["line"] for r in report.orderBy("at").collect())
