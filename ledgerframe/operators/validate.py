"""Validation of joins, keys and relationships, from counts of keys: the join itself is never made.

Both sides are stacked and counted by key in one shuffle, combined on the map side, so that a hot key arrives as one row from each
task. Duplicate and unmatched keys stay lazy frames."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ledgerframe.functions.types import check_columns, check_frame, class_name, free_name, is_missing, is_numeric, name, present, rate
from ledgerframe.functions.render import table_text

By = str | Sequence[str | tuple[str, str]] | Mapping[str, str]


def key_pairs(by: By) -> list[tuple[str, str]]:
    """Names of equal keys on both sides: a name, names, pairs, or a mapping from x to y."""
    if isinstance(by, str):
        return [(by, by)]
    pairs = list(by.items()) if isinstance(by, Mapping) else [(b, b) if isinstance(b, str) else tuple(b) for b in by]
    if not pairs or any(len(p) != 2 or not all(isinstance(c, str) for c in p) for p in pairs):
        raise ValueError("by must name at least one key column")
    return pairs


def common_columns(x: DataFrame, y: DataFrame) -> list[str]:
    found = [c for c in x.columns if c in y.columns]
    if not found:
        raise ValueError("the tables have no columns in common; give by")
    return found


def _checked_stat(df: DataFrame, stat: str | None, side: str) -> None:
    if stat is not None:
        check_columns(df, [stat], f"stat column of {side}")
        if not is_numeric(df.schema[stat]):
            raise TypeError(f"stat column {stat!r} of {side} must be numeric")


def _side(df: DataFrame, keys: list[str], side: str, stats: dict[str, str | None]) -> DataFrame:
    """Keys as k<i>, and for each side a count and its stat: those of the other side are absent."""
    columns = [name(k).alias(f"k{i}") for i, k in enumerate(keys)]
    for s, stat in stats.items():
        columns.append((F.lit(1).cast("long") if s == side else F.lit(None).cast("long")).alias(f"n_{s}"))
        if stat is not None:
            field = df.schema[stat] if s == side else None
            columns.append((present(name(stat), field).cast("double") if field else F.lit(None).cast("double")).alias(f"s_{s}"))
            columns.append((is_missing(name(stat), field).cast("long") if field else F.lit(None).cast("long")).alias(f"m_{s}"))
    return df.select(*columns)


def stacked_counts(x: DataFrame, y: DataFrame, by: By, stat_x: str | None = None, stat_y: str | None = None) -> DataFrame:
    """One row for each key of either side: the key as k0, k1 and so on, n_x and n_y (null where absent), and the stats' sums.

    Both sides are stacked and grouped once: one shuffle of combined counts, where missing keys fall together by themselves and nothing
    is joined."""
    pairs = key_pairs(by)
    stats = {"x": stat_x, "y": stat_y}
    both = _side(x, [a for a, _ in pairs], "x", stats).union(_side(y, [b for _, b in pairs], "y", stats))
    return both.groupBy(*[f"k{i}" for i in range(len(pairs))]).agg(*[F.sum(c).alias(c) for c in both.columns if not c.startswith("k")])


def with_key_names(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """counts, whose first columns are keys, with these names for them; a count or sum that a key is called like gets a longer name."""
    out = list(names)
    for c in counts.columns[len(names) :]:
        out.append(free_name(c, out))
    return counts.toDF(*out)


def key_counts(x: DataFrame, y: DataFrame, by: By, stat_x: str | None = None, stat_y: str | None = None) -> DataFrame:
    """`stacked_counts` with the keys by x's names."""
    return with_key_names(stacked_counts(x, y, by, stat_x, stat_y), [a for a, _ in key_pairs(by)])


def _total(part: str, where: Column | None = None) -> Column:
    value = F.col(part) if where is None else F.when(where, F.col(part))
    return F.coalesce(F.sum(value), F.lit(0))


def validate_join_df(x: DataFrame, y: DataFrame, by: By, stat_x: str | None = None, stat_y: str | None = None) -> DataFrame:
    """The metrics of validate_join as one row, lazily."""
    counts = stacked_counts(x, y, by, stat_x, stat_y)
    both, only_x, only_y = F.col("n_x").isNotNull() & F.col("n_y").isNotNull(), F.col("n_y").isNull(), F.col("n_x").isNull()
    aggregates = [
        _total("n_x").cast("long").alias("x_rows"),
        _total("n_y").cast("long").alias("y_rows"),
        F.count("n_x").alias("x_unique"),
        F.count("n_y").alias("y_unique"),
        F.count_if(both).alias("n_key_overlap"),
        F.coalesce(F.sum(F.col("n_x").cast("double") * F.col("n_y")), F.lit(0.0)).alias("n_matched_pairs"),
        _total("n_x", only_x).cast("long").alias("n_only_x"),
        _total("n_y", only_y).cast("long").alias("n_only_y"),
        F.coalesce(F.max("n_x") > 1, F.lit(False)).alias("x_has_dups"),
        F.coalesce(F.max("n_y") > 1, F.lit(False)).alias("y_has_dups"),
        F.count_if(F.col("n_x") > 1).alias("n_dup_keys_x"),
        F.count_if(F.col("n_y") > 1).alias("n_dup_keys_y"),
    ]
    for side, stat in (("x", stat_x), ("y", stat_y)):
        if stat is not None:
            aggregates += [_total(f"s_{side}").alias(f"stat_{side}_total"), _total(f"s_{side}", both).alias(f"stat_{side}_matched"), _total(f"m_{side}").cast("long").alias(f"stat_{side}_n_na")]
    row = counts.agg(*aggregates)
    relation = F.when(F.col("n_key_overlap") == 0, F.lit("no matches")).when(F.col("x_has_dups") & F.col("y_has_dups"), F.lit("many-to-many"))
    relation = relation.when(F.col("x_has_dups"), F.lit("many-to-one")).when(F.col("y_has_dups"), F.lit("one-to-many")).otherwise(F.lit("one-to-one"))
    more = {"relation": relation, "match_rate_x": rate(F.col("x_rows") - F.col("n_only_x"), F.col("x_rows")), "match_rate_y": rate(F.col("y_rows") - F.col("n_only_y"), F.col("y_rows"))}
    for side, stat in (("x", stat_x), ("y", stat_y)):
        if stat is not None:
            more[f"stat_{side}_only"] = F.col(f"stat_{side}_total") - F.col(f"stat_{side}_matched")
            more[f"stat_{side}_rate"] = rate(F.col(f"stat_{side}_matched"), F.col(f"stat_{side}_total"))
    return row.withColumns(more)


@dataclass(frozen=True)
class JoinValidation:
    """Metrics of a join that was not made, and the keys in question as lazy frames: the keys by x's names, n_x and n_y, and the stats' sums
    (s_x, m_x and so on); where a key has such a name itself, the count's gets underscores."""

    by: list[tuple[str, str]]
    metrics: Row
    counts: DataFrame
    stat_x: str | None
    stat_y: str | None

    def __getattr__(self, key: str):  # noqa: ANN204
        try:
            return self.__dict__["metrics"][key]
        except (KeyError, ValueError):
            raise AttributeError(key) from None

    def _keys(self, which: str) -> DataFrame:
        return with_key_names(self.counts.where(which), [a for a, _ in self.by])

    @property
    def duplicates_x(self) -> DataFrame:
        return self._keys("n_x > 1")

    @property
    def duplicates_y(self) -> DataFrame:
        return self._keys("n_y > 1")

    @property
    def keys_only_in_x(self) -> DataFrame:
        return self._keys("n_y is null")

    @property
    def keys_only_in_y(self) -> DataFrame:
        return self._keys("n_x is null")

    def summary(self) -> list[tuple[str, str]]:
        m, pct = self.metrics, lambda v: "N/A" if v is None else f"{v:.2f}%"
        return [
            ("Relation", m.relation),
            ("Key(s)", ", ".join(a if a == b else f"{a} = {b}" for a, b in self.by)),
            ("Rows in x", f"{m.x_rows:,}"),
            ("Rows in y", f"{m.y_rows:,}"),
            ("Unique keys in x", f"{m.x_unique:,}"),
            ("Unique keys in y", f"{m.y_unique:,}"),
            ("Keys in both", f"{m.n_key_overlap:,}"),
            ("Matched pairs", f"{m.n_matched_pairs:,.0f}"),
            ("Rows only in x", f"{m.n_only_x:,}"),
            ("Rows only in y", f"{m.n_only_y:,}"),
            ("Match rate x", pct(m.match_rate_x)),
            ("Match rate y", pct(m.match_rate_y)),
            ("Duplicated keys", f"x: {m.n_dup_keys_x:,}, y: {m.n_dup_keys_y:,}"),
        ]

    def __str__(self) -> str:
        rows = self.summary()
        for side, stat in (("x", self.stat_x), ("y", self.stat_y)):
            if stat is not None:
                share = self.metrics[f"stat_{side}_rate"]
                text = f"matched {self.metrics[f'stat_{side}_matched']:,.2f} of {self.metrics[f'stat_{side}_total']:,.2f} ({'N/A' if share is None else f'{share:.2f}%'}), {self.metrics[f'stat_{side}_n_na']:,} missing"
                rows.append((f"{stat} in {side}", text))
        return table_text("Join validation", ("Item", "Value"), rows)


def validate_join(x: DataFrame, y: DataFrame, by: By | None = None, stat: str | None = None, stat_x: str | None = None, stat_y: str | None = None) -> JoinValidation:
    """What a join of x and y by these keys would do. stat names a measure of both tables; stat_x and stat_y one of either. Missing keys match each other."""
    check_frame(x, "x"), check_frame(y, "y")
    pairs = key_pairs(common_columns(x, y) if by is None else by)
    check_columns(x, [a for a, _ in pairs], "keys of x")
    check_columns(y, [b for _, b in pairs], "keys of y")
    stat_x, stat_y = stat_x or stat, stat_y or stat
    _checked_stat(x, stat_x, "x"), _checked_stat(y, stat_y, "y")
    metrics = validate_join_df(x, y, pairs, stat_x, stat_y).first()
    return JoinValidation(pairs, metrics, stacked_counts(x, y, pairs, stat_x, stat_y), stat_x, stat_y)


def primary_key_df(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n_rows, n_unique_keys, n_duplicate_keys, has_missing_key and is_primary_key as one row, lazily."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | is_missing(name(k), df.schema[k])
    counts = df.groupBy(*[name(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"), F.bool_or(missing).alias("missing"))
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_unique_keys"), F.count_if(F.col("n") > 1).alias("n_duplicate_keys"), F.coalesce(F.bool_or("missing"), F.lit(False)).alias("has_missing_key"))
    return row.withColumn("is_primary_key", (F.col("n_rows") == F.col("n_unique_keys")) & ~F.col("has_missing_key"))


def duplicate_keys_df(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number n (n_ where a key is called n)."""
    counts = df.groupBy(*[name(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return with_key_names(counts, list(keys))


@dataclass(frozen=True)
class KeyValidation:
    keys: list[str]
    n_rows: int
    n_unique_keys: int
    n_duplicate_keys: int
    is_primary_key: bool
    has_missing_key: bool
    duplicate_keys: DataFrame

    def __str__(self) -> str:
        rows = [("Key(s)", ", ".join(self.keys)), ("Rows", f"{self.n_rows:,}"), ("Unique keys", f"{self.n_unique_keys:,}"), ("Duplicated keys", f"{self.n_duplicate_keys:,}"), ("Missing keys", "yes" if self.has_missing_key else "no"), ("Primary key", "YES" if self.is_primary_key else "NO")]
        return table_text("Primary key validation", ("Item", "Value"), rows)


def validate_primary_keys(df: DataFrame, keys: str | Sequence[str]) -> KeyValidation:
    """Whether the columns identify rows: unique and never missing. An empty table passes. Floating-point keys are warned of."""
    check_frame(df)
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not keys:
        raise ValueError("keys must name at least one column")
    check_columns(df, keys, "keys")
    if floats := [k for k in keys if class_name(df.schema[k]) == "numeric"]:
        warnings.warn(f"floating-point key columns may not compare exactly: {', '.join(floats)}", stacklevel=2)
    row = primary_key_df(df, keys).first()
    return KeyValidation(keys, row.n_rows, row.n_unique_keys, row.n_duplicate_keys, row.is_primary_key, row.has_missing_key, duplicate_keys_df(df, keys))


def var_relationship_df(df: DataFrame, var1: str, var2: str) -> DataFrame:
    """n_combinations, var1_unique, var2_unique, var1_has_dups, var2_has_dups and relation as one row, lazily. Missing is a value."""
    pairs = df.select(name(var1).alias("a"), name(var2).alias("b")).distinct()
    one = pairs.groupBy("a").count().agg(F.count(F.lit(1)).alias("var1_unique"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_combinations"), F.coalesce(F.max("count") > 1, F.lit(False)).alias("var1_has_dups"))
    two = pairs.groupBy("b").count().agg(F.count(F.lit(1)).alias("var2_unique"), F.coalesce(F.max("count") > 1, F.lit(False)).alias("var2_has_dups"))
    # Two rows of one each.
    row = one.withColumn("k", F.lit(0)).join(two.withColumn("k", F.lit(0)), "k").drop("k")
    relation = F.when(F.col("var1_has_dups") & F.col("var2_has_dups"), F.lit("many-to-many")).when(F.col("var1_has_dups"), F.lit("one-to-many")).when(F.col("var2_has_dups"), F.lit("many-to-one")).otherwise(F.lit("one-to-one"))
    return row.select("n_combinations", "var1_unique", "var2_unique", "var1_has_dups", "var2_has_dups", relation.alias("relation"))


@dataclass(frozen=True)
class VarRelationship:
    var1: str
    var2: str
    n_combinations: int
    var1_unique: int
    var2_unique: int
    var1_has_dups: bool
    var2_has_dups: bool
    relation: str

    def __str__(self) -> str:
        rows = [("Variables", f"{self.var1}, {self.var2}"), ("Combinations", f"{self.n_combinations:,}"), (f"Values of {self.var1}", f"{self.var1_unique:,}"), (f"Values of {self.var2}", f"{self.var2_unique:,}"), ("Relation", self.relation)]
        return table_text("Variable relationship", ("Item", "Value"), rows)


def validate_var_relationship(df: DataFrame, var1: str, var2: str) -> VarRelationship:
    """How the values of two columns of class character, integer or factor map to each other."""
    check_frame(df)
    check_columns(df, [var1, var2], "variables")
    for v in (var1, var2):
        if class_name(df.schema[v]) not in ("character", "integer", "factor"):
            raise TypeError(f"{v!r} must be character, integer or factor, not {class_name(df.schema[v])}")
    return VarRelationship(var1, var2, **var_relationship_df(df, var1, var2).first().asDict())
