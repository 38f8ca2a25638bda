"""String diagnostics: empty, blank and padded values, non-ASCII characters, and values that differ by case alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.functions.render import table_text
from ledgerframe.functions.types import check_columns, check_frame, class_name, name

#: White space by Unicode.
SPACE = r"[\t\n\f\r\p{Z}]"
EXAMPLES = 3
COUNTS = ("n_total", "n_na", "n_empty", "n_whitespace_only", "n_leading_ws", "n_trailing_ws", "n_non_ascii")


def string_counts_df(df: DataFrame, column: str) -> DataFrame:
    """The counts as one row, lazily. Padding is counted among values that are neither empty nor blank."""
    s = name(column).cast("string")
    blank = s.rlike(f"^{SPACE}+$")
    content = (s != "") & ~blank
    return df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(s.isNull()).alias("n_na"),
        F.count_if(s == "").alias("n_empty"),
        F.count_if(blank).alias("n_whitespace_only"),
        F.count_if(content & s.rlike(f"^{SPACE}")).alias("n_leading_ws"),
        F.count_if(content & s.rlike(f"{SPACE}$")).alias("n_trailing_ws"),
        F.count_if(s.rlike(r"[^\x00-\x7F]")).alias("n_non_ascii"),
    )


def case_variants_df(df: DataFrame, column: str) -> DataFrame:
    """lower, n_variants and examples (the least EXAMPLES) of each group of content values that differ by case alone.

    Distinct values come first, so repeated ones are combined before they are grouped by their lower case. Groups of one are told by their
    least and greatest value. Examples are ranked with a limit, which Spark keeps before the shuffle too: a task sends EXAMPLES values of a
    group at most, and no group's spellings are ever held together."""
    s = name(column).cast("string")
    content = df.select(s.alias("s")).where((F.col("s") != "") & ~F.col("s").rlike(f"^{SPACE}+$")).distinct().select("s", F.lower("s").alias("lower"))
    groups = content.groupBy("lower").agg(F.count(F.lit(1)).alias("n_variants"), F.min("s").alias("low"), F.max("s").alias("high"))
    groups = groups.where("low <> high").select("lower", "n_variants")
    rank = F.row_number().over(Window.partitionBy("lower").orderBy("s"))
    least = content.withColumn("rank", rank).where(F.col("rank") <= EXAMPLES)
    least = least.groupBy("lower").agg(F.concat_ws(", ", F.array_sort(F.collect_list("s"))).alias("examples"))
    return groups.join(least, "lower")


@dataclass(frozen=True)
class StringReport:
    name: str
    n_total: int
    n_na: int
    n_empty: int
    n_whitespace_only: int
    n_leading_ws: int
    n_trailing_ws: int
    n_non_ascii: int
    n_case_variant_groups: int
    n_case_variants: int
    case_variants: DataFrame

    def to_df(self) -> DataFrame:
        return self.case_variants

    def __str__(self) -> str:
        rows = [(k, getattr(self, k)) for k in (*COUNTS, "n_case_variant_groups", "n_case_variants")]
        found = [tuple(r) for r in self.case_variants.orderBy("lower").limit(5).collect()] if self.n_case_variant_groups else []
        text = table_text(f"Strings: {self.name}", ("Item", "Count"), rows)
        return text + ("\n\n" + table_text("Case variants", ("lower", "n_variants", "examples"), found) if found else "")


def diagnose_strings(df: DataFrame, column: str, label: str | None = None) -> StringReport:
    check_frame(df)
    check_columns(df, [column], "column")
    if class_name(df.schema[column]) not in ("character", "factor"):
        raise TypeError(f"{column!r} must be a string column")
    variants = case_variants_df(df, column)
    groups = variants.agg(F.count(F.lit(1)).alias("g"), F.coalesce(F.sum("n_variants"), F.lit(0)).alias("v")).first()
    return StringReport(label or column, *string_counts_df(df, column).first(), groups.g, groups.v, variants)
