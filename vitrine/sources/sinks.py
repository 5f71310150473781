"""Report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.rounding import exact_round


def _has_binary(t: T.DataType) -> bool:
    if isinstance(t, T.BinaryType):
        return True
    if isinstance(t, T.ArrayType):
        return _has_binary(t.elementType)
    if isinstance(t, T.StructType):
        return any(_has_binary(f.dataType) for f in t.fields)
    return False


def response_rows(reports: DataFrame, key: str = "merchant_id") -> DataFrame:
    """A8. (key, response): the row as JSON without binary columns, NULLs kept."""
    fields = [f.name for f in reports.schema.fields if not _has_binary(f.dataType)]
    return reports.select(key, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("response"))


def _fixed(column: str, digits: int) -> Column:
    """Fixed-point text; ties are decided on the exact value before formatting."""
    return F.format_string(f"%.{digits}f", exact_round(F.col(column), digits))


def metric_lines(metrics: DataFrame) -> DataFrame:
    """A7. Markdown table rows of method metrics (J4, J5), one text line per method."""
    one, three = (lambda c: _fixed(c, 1)), (lambda c: _fixed(c, 3))
    whole = lambda c: F.col(c).cast("string")
    cells: list[Column] = [
        F.concat(F.lit("**"), "method", F.lit("**")),
        F.concat(F.lit("**"), one("accuracy_pct"), F.lit("%** ("), whole("correct_cases"), F.lit("/"), whole("total_cases"), F.lit(")")),
        three("precision_macro"),
        three("recall_macro"),
        three("f1_macro"),
        F.concat(F.lit("**"), one("false_positive_rate_pct"), F.lit("%** ("), whole("clean_fp_count"), F.lit("/"), whole("clean_total"), F.lit(")")),
        F.concat(one("false_negative_rate_pct"), F.lit("% ("), whole("suspicious_fn_count"), F.lit("/"), whole("suspicious_total"), F.lit(")")),
    ]
    return metrics.select("method", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def case_lines(comparison: DataFrame, methods: list[str], final: str) -> DataFrame:
    """A7. Markdown row per case (J8) with the final decision and its tier."""
    mark = F.when(F.col(f"{final}_correct"), "✓").otherwise("~")
    others = [F.concat(F.lit("`"), F.col(m), F.lit("`")) for m in methods if m != final]
    code = lambda c: F.concat(F.lit("`"), F.col(c).cast("string"), F.lit("`"))
    cells = [code("case_id"), code("ground_truth"), code("case_type"), *others,
             F.concat(code(final), F.lit(" ("), _fixed("final_score", 1), F.lit(")")),
             F.concat(mark, F.lit(" "), "status_tier")]
    return comparison.select("case_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def write_report(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write report rows as JSON lines, in parallel, replacing the target."""
    writer = rows.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def write_lines(lines: DataFrame, path: str, order_by: str) -> None:
    """Write the ``line`` column as text; files and lines follow ``order_by``."""
    lines.orderBy(order_by).select("line").write.mode("overwrite").text(path)
