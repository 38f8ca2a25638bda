"""The registered queries of the diagnostics operators, and the same in SQL.

The tables have no missing values and agree with each other, so queries make holes and changes in values by the remainder of a key, which
both sides share. No rows are left out to save work: each query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.operators import columns, compare, joins, strings, tabulate, transform, validate
from ledgerframe.operators.diff import audit_diff
from ledgerframe.operators.filters import filter_diagnostics, filter_drop, filter_keep, filter_out_tap, filter_tap
from ledgerframe.operators.joins import join_frames, left_join_tap
from ledgerframe.operators.trail import audit_tap, audit_trail
from ledgerframe.plans.profile import snapshot_df
from ledgerframe.sources.serialize import trail_to_df

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Callable[[str], DataFrame]], DataFrame]], None]:
    """Registers a function of a table reader, with its SQL."""

    def register(make: Callable[[Callable[[str], DataFrame]], DataFrame]) -> None:
        QUERIES[name] = lambda spark, sf_dir: make(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql is not None:
            ORACLES[name] = sql

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to so many digits: sums are added up in another order by another engine."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Snapshots and trails


def _profile_sql(source: str, fields: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, kind) in enumerate(fields):
        if kind in ("integer", "numeric"):
            q = [f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 4)" for p in ("0", "0.25", "0.5", "0.75", "1")]
            stats = f"{q[0]} AS min, {q[1]} AS q25, {q[2]} AS median, round(avg(CAST({c} AS DOUBLE)), 4) AS mean, {q[3]} AS q75, {q[4]} AS max"
        else:
            stats = ", ".join(f"CAST(NULL AS DOUBLE) AS {s}" for s in ("min", "q25", "median", "mean", "q75", "max"))
        parts.append(f"SELECT {i} AS position, '{c}' AS \"column\", '{kind}' AS type, count(*) FILTER ({c} IS NULL) AS n_na, {stats} FROM t")
    return f"WITH t AS ({source}) " + " UNION ALL ".join(parts)


_LINEITEM = [("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"), ("l_linenumber", "integer"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"), ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "character"), ("l_linestatus", "character"), ("l_shipdate", "POSIXct")]
_HOLES = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, o_orderdate FROM orders"


def _holes(read: Callable[[str], DataFrame]) -> DataFrame:
    """Orders with missing values."""
    hole = lambda c, k: F.when(F.col("o_orderkey") % k != 0, F.col(c)).alias(c)
    return read("orders").select("o_orderkey", hole("o_totalprice", 5), hole("o_orderstatus", 7), "o_orderpriority", "o_orderdate")


@query("snapshot_lineitem", _profile_sql("SELECT * FROM lineitem", _LINEITEM))
def _(read):
    return rounded(snapshot_df(read("lineitem")))


@query("snapshot_with_nulls", _profile_sql(_HOLES, [("o_orderkey", "integer"), ("o_totalprice", "numeric"), ("o_orderstatus", "character"), ("o_orderpriority", "character"), ("o_orderdate", "POSIXct")]))
def _(read):
    return rounded(snapshot_df(_holes(read)))


@query("snapshot_with_nan", _profile_sql("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS value FROM events", [("event_id", "integer"), ("value", "numeric")]))
def _(read):
    return rounded(snapshot_df(read("events").select("event_id", F.when(F.col("event_id") % 6 == 0, float("nan")).otherwise(F.col("value")).alias("value"))))


@query(
    "diff_raw_filtered",
    f"""WITH a AS ({_HOLES}), b AS (SELECT * FROM a WHERE o_totalprice > 100000),
        r AS (SELECT (SELECT count(*) FROM a) AS ra, (SELECT count(*) FROM b) AS rb, (SELECT count(*) FILTER (o_totalprice IS NULL) FROM a) AS pa, (SELECT count(*) FILTER (o_orderstatus IS NULL) FROM a) AS sa,
                     (SELECT count(*) FILTER (o_orderstatus IS NULL) FROM b) AS sb, (SELECT avg(o_totalprice) FROM a) AS ma, (SELECT avg(o_totalprice) FROM b) AS mb, (SELECT avg(o_orderkey) FROM a) AS ka, (SELECT avg(o_orderkey) FROM b) AS kb)
        SELECT 'rows' AS kind, NULL AS "column", round(CAST(rb - ra AS DOUBLE), 3) AS delta FROM r
        UNION ALL SELECT 'columns', NULL, 0.0 FROM r
        UNION ALL SELECT 'missing values', NULL, CAST(sb - pa - sa AS DOUBLE) FROM r
        UNION ALL SELECT 'missing values of a column', 'o_totalprice', CAST(-pa AS DOUBLE) FROM r
        UNION ALL SELECT 'missing values of a column', 'o_orderstatus', CAST(sb - sa AS DOUBLE) FROM r
        UNION ALL SELECT 'mean', 'o_totalprice', round(mb - ma, 3) FROM r
        UNION ALL SELECT 'mean', 'o_orderkey', round(kb - ka, 3) FROM r""",
)
def _(read):
    trail = audit_trail("diff")
    raw = audit_tap(_holes(read), trail, "raw")
    filter_tap(raw, "o_totalprice > 100000", trail=trail, label="large", quiet=True)
    return rounded(audit_diff(trail, "raw", "large").to_df(raw.sparkSession).select("kind", "column", "delta"), 3)


@query(
    "tap_trail",
    """WITH o AS (SELECT * FROM orders), j AS (SELECT o.*, c.c_mktsegment FROM o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0),
       f AS (SELECT * FROM j WHERE o_totalprice > 100000), g AS (SELECT * FROM f WHERE NOT coalesce(c_mktsegment = 'BUILDING', false))
       SELECT 1 AS "index", 'raw' AS label, 'tap' AS type, count(*) AS nrow, 6 AS ncol, CAST(0 AS BIGINT) AS total_nas FROM o
       UNION ALL SELECT 2, 'joined', 'join', count(*), 7, count(*) FILTER (c_mktsegment IS NULL) FROM j
       UNION ALL SELECT 3, 'large', 'filter', count(*), 7, count(*) FILTER (c_mktsegment IS NULL) FROM f
       UNION ALL SELECT 4, 'rest', 'filter', count(*), 7, count(*) FILTER (c_mktsegment IS NULL) FROM g""",
)
def _(read):
    trail = _trail(read)
    return trail_to_df(trail, read("region").sparkSession).select("index", "label", "type", "nrow", "ncol", "total_nas")


def _trail(read):
    """Orders through a join tap and two filter taps."""
    trail = audit_trail("orders")
    orders = audit_tap(read("orders"), trail, "raw")
    customers = read("customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    joined = left_join_tap(orders, customers, {"o_custkey": "c_custkey"}, trail=trail, label="joined", stat="o_totalprice", numeric_summary=False)
    large = filter_tap(joined, "o_totalprice > 100000", trail=trail, label="large", stat="o_totalprice", quiet=True, numeric_summary=False)
    filter_out_tap(large, "c_mktsegment = 'BUILDING'", trail=trail, label="rest", quiet=True, numeric_summary=False)
    return trail


# Filters

_NULLED = "SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM events"


def _nulled(read):
    return read("events").withColumn("v", F.when(F.col("event_id") % 4 != 0, F.col("value")))


@query("filter_keep_rows", "SELECT * FROM orders WHERE o_totalprice > 150000 AND o_orderstatus <> 'F'")
def _(read):
    return filter_keep(read("orders"), "o_totalprice > 150000", "o_orderstatus <> 'F'", quiet=True)


@query("filter_drop_rows", f"SELECT event_id, event_type, v FROM ({_NULLED}) WHERE NOT coalesce(v > 50 AND event_type <> 'view', false)")
def _(read):
    return filter_drop(_nulled(read), "v > 50", "event_type <> 'view'", quiet=True).select("event_id", "event_type", "v")


def _filter_sql(source: str, predicate: str, stat: str, drop: bool = False) -> str:
    keep = f"NOT coalesce({predicate}, false)" if drop else f"coalesce({predicate}, false)"
    return f"""WITH t AS ({source}), f AS (SELECT *, {keep} AS k, {stat} AS s, ({predicate}) IS NULL AS u FROM t)
        SELECT count(*) AS n_total, count(*) FILTER (NOT k) AS n_dropped, round(100.0 * count(*) FILTER (NOT k) / nullif(count(*), 0), 4) AS pct_dropped, count(*) FILTER (u) AS n_na_in_filter,
               round(CAST(sum(s) AS DOUBLE), 2) AS stat_total, round(CAST(sum(s) - coalesce(sum(s) FILTER (k), 0) AS DOUBLE), 2) AS stat_dropped FROM f"""


def _filter_row(df):
    return df.withColumns({"pct_dropped": F.round("pct_dropped", 4), "stat_total": F.round("stat_total", 2), "stat_dropped": F.round("stat_dropped", 2)})


@query("filter_tap_diag", _filter_sql("SELECT * FROM lineitem", "l_quantity > 25 AND l_returnflag <> 'R'", "l_extendedprice * (1 - l_discount)"))
def _(read):
    return _filter_row(filter_diagnostics(read("lineitem"), "l_quantity > 25", "l_returnflag <> 'R'", stat="l_extendedprice * (1 - l_discount)"))


@query("filter_out_tap_diag", _filter_sql("SELECT * FROM orders", "o_orderstatus = 'O'", "o_totalprice", True))
def _(read):
    return _filter_row(filter_diagnostics(read("orders"), "o_orderstatus = 'O'", stat="o_totalprice", drop=True))


@query("filter_na_count", _filter_sql(_NULLED, "v > 50 AND event_type <> 'view'", "value"))
def _(read):
    return _filter_row(filter_diagnostics(_nulled(read), "v > 50", "event_type <> 'view'", stat="value"))


# Joins

_X = "SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey END AS k, o_totalprice FROM orders"
_Y = "SELECT nullif(c_custkey, (SELECT min(c_custkey) FROM customer WHERE c_acctbal > 0)) AS k, c_mktsegment FROM customer WHERE c_acctbal > 0"


def _x(read):
    return read("orders").select("o_orderkey", F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey")).alias("k"), "o_totalprice")


def _y(read):
    return _good_customers(read).select("k", "c_mktsegment")


def _good_customers(read):
    """Customers with a positive balance, of whom the first has no key."""
    good = read("customer").where("c_acctbal > 0")
    return good.join(good.agg(F.min("c_custkey").alias("first")), F.col("c_custkey") == F.col("first"), "left").withColumn("k", F.when(F.col("first").isNull(), F.col("c_custkey")))


_ON = "x.k IS NOT DISTINCT FROM y.k"
for _kind, _sql in {
    "left": f"SELECT x.o_orderkey, x.k, x.o_totalprice, y.c_mktsegment FROM x LEFT JOIN y ON {_ON}",
    "right": f"SELECT x.o_orderkey, y.k, x.o_totalprice, y.c_mktsegment FROM x RIGHT JOIN y ON {_ON}",
    "inner": f"SELECT x.o_orderkey, x.k, x.o_totalprice, y.c_mktsegment FROM x JOIN y ON {_ON}",
    "full": f"SELECT x.o_orderkey, coalesce(x.k, y.k) AS k, x.o_totalprice, y.c_mktsegment FROM x FULL JOIN y ON {_ON}",
    "anti": f"SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE {_ON})",
    "semi": f"SELECT * FROM x WHERE EXISTS (SELECT 1 FROM y WHERE {_ON})",
}.items():
    query(f"{_kind}_join_tap", f"WITH x AS ({_X}), y AS ({_Y}) {_sql}")(lambda read, kind=_kind: getattr(joins, f"{kind}_join_tap")(_x(read), _y(read), "k", trail=audit_trail("joins"), numeric_summary=False))


@query("theta_join_tap", "SELECT s.s_suppkey, s.s_nationkey, n.n_nationkey, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey % 5 = n.n_regionkey AND s.s_nationkey >= n.n_nationkey")
def _(read):
    return join_frames(read("supplier").select("s_suppkey", "s_nationkey"), read("nation"), how="inner_join", on="x.s_nationkey % 5 = y.n_regionkey AND x.s_nationkey >= y.n_nationkey").drop("n_regionkey")


@query("range_join", "SELECT c.c_custkey, c.c_acctbal, s.s_suppkey, s.s_acctbal FROM customer c JOIN supplier s ON c.c_acctbal BETWEEN s.s_acctbal - 50 AND s.s_acctbal + 50")
def _(read):
    x, y = read("customer").select("c_custkey", "c_acctbal"), read("supplier").select("s_suppkey", "s_acctbal")
    return join_frames(x, y, how="inner_join", on="x.c_acctbal BETWEEN y.s_acctbal - 50 AND y.s_acctbal + 50")


@query("range_join_unmatched", "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM part WHERE o_totalprice > p_retailprice * 100 AND o_totalprice <= p_retailprice * 100 + p_size)")
def _(read):
    return join_frames(read("orders").select("o_orderkey", "o_totalprice"), read("part"), how="anti_join", on="x.o_totalprice > y.p_retailprice * 100 AND x.o_totalprice <= y.p_retailprice * 100 + y.p_size")


@query("overlap_join", "SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_acctbal - 20 <= s.s_acctbal + 5 AND s.s_acctbal - 5 <= c.c_acctbal + 20 AND c.c_nationkey <> s.s_nationkey")
def _(read):
    x, y = read("customer").selectExpr("c_custkey", "c_nationkey", "c_acctbal - 20 AS low", "c_acctbal + 20 AS high"), read("supplier").selectExpr("s_suppkey", "s_nationkey", "s_acctbal - 5 AS since", "s_acctbal + 5 AS until")
    return join_frames(x, y, how="inner_join", on="x.low <= y.until AND y.since <= x.high AND x.c_nationkey <> y.s_nationkey").select("c_custkey", "s_suppkey")


@query("join_suffix", "SELECT a.conv_id, a.turn, a.role AS role_x, a.text AS text_x, b.role AS role_y, b.text AS text_y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn")
def _(read):
    return join_frames(read("conversations"), read("conversations"), ["conv_id", "turn"], "inner_join")


@query("natural_join", "SELECT d.doc_id, l.quality, l.toxic, d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(read):
    return join_frames(read("documents").select("doc_id", "lang"), read("labels"), None, "inner_join")


# Validation


def _validation_sql(x: str, y: str, kx: str, ky: str, sx: str, sy: str) -> str:
    return f"""WITH x AS ({x}), y AS ({y}), xc AS (SELECT {kx} AS k, count(*) AS nx, sum({sx}) AS sx FROM x GROUP BY ALL), yc AS (SELECT {ky} AS k, count(*) AS ny, sum({sy}) AS sy FROM y GROUP BY ALL),
        c AS (SELECT nx, ny, sx, sy FROM xc FULL JOIN yc ON xc.k IS NOT DISTINCT FROM yc.k),
        m AS (SELECT CAST(coalesce(sum(nx), 0) AS BIGINT) AS x_rows, CAST(coalesce(sum(ny), 0) AS BIGINT) AS y_rows, count(nx) AS x_unique, count(ny) AS y_unique, count(*) FILTER (nx > 0 AND ny > 0) AS n_key_overlap,
              coalesce(sum(CAST(nx AS DOUBLE) * ny), 0) AS n_matched_pairs, CAST(coalesce(sum(nx) FILTER (ny IS NULL), 0) AS BIGINT) AS n_only_x, CAST(coalesce(sum(ny) FILTER (nx IS NULL), 0) AS BIGINT) AS n_only_y,
              coalesce(max(nx) > 1, false) AS x_has_dups, coalesce(max(ny) > 1, false) AS y_has_dups, count(*) FILTER (nx > 1) AS n_dup_keys_x, count(*) FILTER (ny > 1) AS n_dup_keys_y,
              sum(sx) AS tx, coalesce(sum(sx) FILTER (ny > 0), 0) AS mx, sum(sy) AS ty, coalesce(sum(sy) FILTER (nx > 0), 0) AS my FROM c)
        SELECT x_rows, y_rows, x_unique, y_unique, n_key_overlap, n_matched_pairs, n_only_x, n_only_y, x_has_dups, y_has_dups, n_dup_keys_x, n_dup_keys_y,
               CASE WHEN n_key_overlap = 0 THEN 'no matches' WHEN x_has_dups AND y_has_dups THEN 'many-to-many' WHEN x_has_dups THEN 'many-to-one' WHEN y_has_dups THEN 'one-to-many' ELSE 'one-to-one' END AS relation,
               round(100.0 * (x_rows - n_only_x) / nullif(x_rows, 0), 4) AS match_rate_x, round(100.0 * (y_rows - n_only_y) / nullif(y_rows, 0), 4) AS match_rate_y,
               round(tx, 2) AS stat_x_total, round(mx, 2) AS stat_x_matched, CAST(0 AS BIGINT) AS stat_x_n_na, round(tx - mx, 2) AS stat_x_only, round(100 * mx / tx, 2) AS stat_x_rate,
               round(ty, 2) AS stat_y_total, round(my, 2) AS stat_y_matched, CAST(0 AS BIGINT) AS stat_y_n_na, round(ty - my, 2) AS stat_y_only, round(100 * my / ty, 2) AS stat_y_rate FROM m"""


def _validation(df):
    return df.select(*[F.round(c, 4 if c.startswith("match_rate") else 2).alias(c) if c.startswith(("stat", "match_rate")) and t == "double" else F.col(c) for c, t in df.dtypes])


@query("validate_join_orders_lineitem", _validation_sql("SELECT * FROM orders WHERE o_orderstatus <> 'F'", "SELECT * FROM lineitem", "o_orderkey", "l_orderkey", "o_totalprice", "l_quantity"))
def _(read):
    return _validation(validate.validate_join_df(read("orders").where("o_orderstatus <> 'F'"), read("lineitem"), {"o_orderkey": "l_orderkey"}, "o_totalprice", "l_quantity"))


@query("validate_join_null_keys", _validation_sql(_X, _Y.replace("c_mktsegment", "c_mktsegment, c_acctbal"), "k", "k", "o_totalprice", "c_acctbal"))
def _(read):
    return _validation(validate.validate_join_df(_x(read), _good_customers(read).select("k", "c_acctbal"), "k", "o_totalprice", "c_acctbal"))


@query("validate_join_composite", _validation_sql("SELECT * FROM lineitem", "SELECT * FROM lineitem WHERE l_quantity > 40", "(l_partkey, l_suppkey)", "(l_partkey, l_suppkey)", "l_tax", "l_tax"))
def _(read):
    return _validation(validate.validate_join_df(read("lineitem"), read("lineitem").where("l_quantity > 40"), ["l_partkey", "l_suppkey"], "l_tax", "l_tax"))


@query("validate_join_dup_keys", "SELECT o_custkey, count(*) AS n_x FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def _(read):
    return validate.key_counts(read("orders"), read("customer"), {"o_custkey": "c_custkey"}).where("n_x > 1").select("o_custkey", "n_x")


@query("validate_join_only_x", "SELECT o_orderkey, count(*) AS n_x FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def _(read):
    return validate.key_counts(read("orders"), read("lineitem"), {"o_orderkey": "l_orderkey"}).where("n_y is null").select("o_orderkey", "n_x")


def _key_sql(table: str, keys: str, missing: str = "false") -> str:
    return f"""WITH c AS (SELECT count(*) AS n, bool_or({missing}) AS m FROM {table} GROUP BY {keys})
        SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique_keys, count(*) FILTER (n > 1) AS n_duplicate_keys, bool_or(m) AS has_missing_key, sum(n) = count(*) AND NOT bool_or(m) AS is_primary_key FROM c"""


@query("validate_pk_orders", _key_sql("orders", "o_orderkey"))
def _(read):
    return validate.primary_key_df(read("orders"), ["o_orderkey"])


@query("validate_pk_lineitem", _key_sql("lineitem", "l_orderkey, l_linenumber"))
def _(read):
    return validate.primary_key_df(read("lineitem"), ["l_orderkey", "l_linenumber"])


@query("validate_pk_missing", _key_sql(f"({_X})", "o_orderkey, k", "k IS NULL"))
def _(read):
    return validate.primary_key_df(_x(read), ["o_orderkey", "k"])


@query("pk_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(read):
    return validate.duplicate_keys_df(read("lineitem"), ["l_orderkey", "l_linenumber"])


def _relationship_sql(table: str, a: str, b: str) -> str:
    return f"""WITH p AS (SELECT DISTINCT {a} AS a, {b} AS b FROM {table}), x AS (SELECT count(*) AS n FROM p GROUP BY a), y AS (SELECT count(*) AS n FROM p GROUP BY b),
        r AS (SELECT (SELECT count(*) FROM p) AS n_combinations, (SELECT count(*) FROM x) AS var1_unique, (SELECT count(*) FROM y) AS var2_unique, (SELECT max(n) > 1 FROM x) AS var1_has_dups, (SELECT max(n) > 1 FROM y) AS var2_has_dups)
        SELECT *, CASE WHEN var1_has_dups AND var2_has_dups THEN 'many-to-many' WHEN var1_has_dups THEN 'one-to-many' WHEN var2_has_dups THEN 'many-to-one' ELSE 'one-to-one' END AS relation FROM r"""


for _name, (_table, _a, _b) in {"nation": ("nation", "n_nationkey", "n_regionkey"), "nation_names": ("nation", "n_nationkey", "n_name"), "orders": ("orders", "o_orderstatus", "o_orderpriority"), "customer": ("customer", "c_nationkey", "c_custkey")}.items():
    query(f"var_relationship_{_name}", _relationship_sql(_table, _a, _b))(lambda read, t=_table, a=_a, b=_b: validate.var_relationship_df(read(t), a, b))

# Comparison

_OLD = "SELECT o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE) AS rank, o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 20000"
_NEW = """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + o_orderkey % 97 WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
          CASE WHEN o_orderkey % 17 = 0 THEN o_custkey + 0.01 ELSE CAST(o_custkey AS DOUBLE) END AS rank,
          CASE WHEN o_orderkey % 19 = 0 THEN 'X' WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT'"""
_PAIR = f"WITH x AS ({_OLD}), y AS ({_NEW}), m AS (SELECT o_orderkey, x.o_totalprice AS px, y.o_totalprice AS py, x.rank AS rx, y.rank AS ry, x.o_orderstatus AS sx, y.o_orderstatus AS sy, x.o_orderpriority AS ox, y.o_orderpriority AS oy FROM x JOIN y USING (o_orderkey))"
_TOL = 0.05


def _plan(read, **options):
    old = read("orders").where("o_totalprice > 20000").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("rank"), "o_orderstatus", "o_orderpriority")
    new = read("orders").where("o_orderpriority <> '1-URGENT'").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + o_orderkey % 97 WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
        "CASE WHEN o_orderkey % 17 = 0 THEN o_custkey + 0.01D ELSE CAST(o_custkey AS DOUBLE) END AS rank",
        "CASE WHEN o_orderkey % 19 = 0 THEN 'X' WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
        "o_orderpriority",
    )
    return compare.plan_comparison(old, new, ["o_orderkey"], tol=_TOL, **options)


def _numeric_sql(c: str, a: str, b: str) -> str:
    q = [f"round(quantile_cont(abs({a} - {b}), {p}), 4) AS {n}" for p, n in (("0", "min"), ("0.25", "q25"), ("0.5", "median"), ("0.75", "q75"), ("1", "max"))]
    return f"SELECT '{c}' AS \"column\", count(abs({a} - {b})) AS n, {', '.join(q)}, count(*) FILTER (abs({a} - {b}) > {_TOL} OR ({a} IS NULL) <> ({b} IS NULL)) AS n_over_tol FROM m"


@query("compare_numeric_summary", f"{_PAIR} {_numeric_sql('o_totalprice', 'px', 'py')} UNION ALL {_numeric_sql('rank', 'rx', 'ry')}")
def _(read):
    return rounded(compare.numeric_summary_df(_plan(read)))


def _categorical_sql(c: str, a: str, b: str) -> str:
    return f"""SELECT '{c}' AS "column", count(*) FILTER ({a} IS NOT NULL OR {b} IS NOT NULL) AS n_compared, count(*) FILTER ({a} IS DISTINCT FROM {b}) AS n_mismatched,
        round(count(*) FILTER ({a} IS DISTINCT FROM {b}) / count(*) FILTER ({a} IS NOT NULL OR {b} IS NOT NULL), 6) AS pct_mismatched, count(*) FILTER (({a} IS NULL) <> ({b} IS NULL)) AS n_na_mismatch FROM m"""


@query("compare_categorical_summary", f"{_PAIR} {_categorical_sql('o_orderstatus', 'sx', 'sy')} UNION ALL {_categorical_sql('o_orderpriority', 'ox', 'oy')}")
def _(read):
    return rounded(compare.categorical_summary_df(_plan(read)), 6)


_BAD = f"(coalesce(abs(px - py) > {_TOL}, false) OR (px IS NULL) <> (py IS NULL) OR coalesce(abs(rx - ry) > {_TOL}, false) OR sx IS DISTINCT FROM sy OR ox IS DISTINCT FROM oy)"


@query(
    "compare_match_summary",
    f"""{_PAIR}, c AS (SELECT count(*) AS n, count(*) FILTER ({_BAD}) AS bad FROM m)
        SELECT (SELECT count(*) FROM x WHERE o_orderkey NOT IN (SELECT o_orderkey FROM y)) AS only_x, (SELECT count(*) FROM y WHERE o_orderkey NOT IN (SELECT o_orderkey FROM x)) AS only_y,
               n - bad AS matched_no_disc, bad AS matched_with_disc, round((n - bad) / n, 6) AS pct_no_disc, round(bad / n, 6) AS pct_with_disc FROM c""",
)
def _(read):
    return rounded(compare.match_summary_df(_plan(read)), 6)


@query("compare_key_overlap", f"{_PAIR} SELECT (SELECT count(*) FROM m) AS matches, (SELECT count(*) FROM x WHERE o_orderkey NOT IN (SELECT o_orderkey FROM y)) AS only_x, (SELECT count(*) FROM y WHERE o_orderkey NOT IN (SELECT o_orderkey FROM x)) AS only_y, false AS dups")
def _(read):
    return compare.key_overlap_df(_plan(read))


@query(
    "compare_discrepancies_topn",
    f"""{_PAIR}, u AS (SELECT o_orderkey, 'o_totalprice' AS c, px AS a, py AS b FROM m UNION ALL SELECT o_orderkey, 'rank', rx, ry FROM m),
        d AS (SELECT *, abs(a - b) AS d FROM u WHERE coalesce(abs(a - b) > {_TOL}, false) OR (a IS NULL) <> (b IS NULL)),
        r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d DESC NULLS LAST, o_orderkey) AS rn FROM d)
        SELECT o_orderkey, c AS "column", round(a, 4) AS value_x, round(b, 4) AS value_y, round(d, 4) AS abs_diff, round(d / greatest(abs(a), abs(b)), 6) AS pct_diff FROM r WHERE rn <= 25 AND c = 'o_totalprice'""",
)
def _(read):
    df = compare.discrepancies_df(_plan(read, top_n=25, compare_cols=["o_totalprice"]), True)
    return df.select("o_orderkey", "column", *[F.round(c, 6 if c == "pct_diff" else 4).alias(c) for c in ("value_x", "value_y", "abs_diff", "pct_diff")])


@query("compare_discrepancies_categorical", f"{_PAIR} SELECT o_orderkey, 'o_orderstatus' AS \"column\", sx AS value_x, sy AS value_y FROM m WHERE sx IS DISTINCT FROM sy")
def _(read):
    return compare.discrepancies_df(_plan(read), False)


@query(
    "compare_tidy",
    f"""{_PAIR} SELECT o_orderkey, 'o_totalprice' AS "column", 'numeric' AS type, round(abs(px - py), 4) AS abs_diff FROM m WHERE coalesce(abs(px - py) > {_TOL}, false) OR (px IS NULL) <> (py IS NULL)
        UNION ALL SELECT o_orderkey, 'o_orderstatus', 'categorical', NULL FROM m WHERE sx IS DISTINCT FROM sy""",
)
def _(read):
    return rounded(compare.tidy_df(_plan(read)).select("o_orderkey", "column", "type", "abs_diff"))


@query("compare_type_mismatches", "SELECT 'n_regionkey' AS \"column\", 'integer' AS type_x, 'character' AS type_y")
def _(read):
    nation = read("nation")
    p = compare.plan_comparison(nation, nation.withColumn("n_regionkey", F.col("n_regionkey").cast("string")), ["n_nationkey"])
    return nation.sparkSession.createDataFrame([tuple(m.values()) for m in p.type_mismatches], "column string, type_x string, type_y string")


@query(
    "compare_row_index",
    """WITH x AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_index, o_totalprice AS v FROM orders), y AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_index, o_totalprice AS v FROM orders WHERE o_totalprice > 2000)
       SELECT row_index, 'v' AS "column", round(x.v, 2) AS value_x, round(y.v, 2) AS value_y, round(abs(x.v - y.v), 2) AS abs_diff FROM x JOIN y USING (row_index) WHERE abs(x.v - y.v) > 1""",
)
def _(read):
    orders = read("orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    p = compare.plan_comparison(orders, orders.where("v > 2000"), [], tol=1, compare_cols=["v"], order_by=["v", "o_orderkey"])
    return rounded(compare.discrepancies_df(p, True).drop("pct_diff"), 2)


# Tables


def _tab_sql(source: str, v: str, measure: str = "count(*)", order: str = "key", where: str = "true", cutoff: str | None = None) -> str:
    """One-way table; cutoff: which rows, by rn and running share, are kept."""
    return f"""WITH f AS (SELECT {v} AS key, {measure} AS freq FROM ({source}) WHERE {where} GROUP BY 1),
        r AS (SELECT *, row_number() OVER w AS rn, coalesce(sum(freq) OVER (ORDER BY freq DESC, key NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(freq) OVER () AS before FROM f WINDOW w AS (ORDER BY freq DESC, key NULLS LAST)),
        g AS (SELECT CASE WHEN {cutoff or 'true'} THEN CASE WHEN key IS NULL THEN 1 ELSE 0 END ELSE 2 END AS special, CASE WHEN {cutoff or 'true'} THEN key END AS key, freq, CASE WHEN {cutoff or 'true'} THEN 0 ELSE 1 END AS o FROM r),
        h AS (SELECT special, key, sum(freq) AS freq, CAST(sum(o) AS BIGINT) AS n_other FROM g GROUP BY 1, 2),
        p AS (SELECT *, round(100.0::DOUBLE * freq / sum(freq) OVER (), 1) AS percent, row_number() OVER (ORDER BY special, {order}) AS position FROM h)
        SELECT CAST(position AS INTEGER) AS position, CASE special WHEN 2 THEN '(Other)' WHEN 1 THEN '<NA>' ELSE CAST(key AS VARCHAR) END AS value, {'CAST(freq AS BIGINT)' if measure == 'count(*)' else 'round(freq, 2)'} AS freq, percent,
               least(round(sum(percent) OVER (ORDER BY position), 1), 100.0) AS cum_percent, n_other, special FROM p"""


_STATUS = "SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS v FROM orders"


def _status(read):
    return read("orders").withColumn("v", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")))


for _name, _options, _sql in (
    ("tab_segment", {}, {}),
    ("tab_sorted_value_desc", {"sort": "value_desc"}, {"order": "key DESC"}),
    ("tab_sorted_freq_desc", {"sort": "freq_desc"}, {"order": "freq DESC, key"}),
    ("tab_sorted_freq_asc", {"sort": "freq_asc"}, {"order": "freq, key"}),
    ("tab_na_exclude", {"na": "exclude"}, {"where": "v IS NOT NULL"}),
    ("tab_na_only", {"na": "only"}, {"where": "v IS NULL"}),
    ("tab_cutoff_n", {"cutoff": 3}, {"cutoff": "rn <= 3"}),
    ("tab_cutoff_prop", {"cutoff": 0.6}, {"cutoff": "rn = 1 OR before < 0.6"}),
    ("tab_weighted", {"wt": "o_totalprice"}, {"measure": "sum(o_totalprice)"}),
):
    query(_name, _tab_sql(_STATUS, "v", **_sql))(lambda read, o=_options: rounded(tabulate.tab_df(_status(read), "v", **o), 2))


@query("tab_numeric_order", _tab_sql("SELECT * FROM part", "p_size"))
def _(read):
    return tabulate.tab_df(read("part"), "p_size")


@query("tab_top_parts", _tab_sql("SELECT * FROM lineitem", "l_partkey", cutoff="rn <= 20", order="freq DESC, key"))
def _(read):
    return tabulate.tab_df(read("lineitem"), "l_partkey", cutoff=20, sort="freq_desc")


def _crosstab_sql(source: str, a: str, b: str, measure: str = "count(*)", where: str = "true") -> str:
    return f"""WITH c AS (SELECT {a} AS a, {b} AS b, {measure} AS n FROM ({source}) WHERE {where} GROUP BY 1, 2)
        SELECT coalesce(CAST(a AS VARCHAR), '<NA>') AS row_value, coalesce(CAST(b AS VARCHAR), '<NA>') AS col_value, {'n' if measure == 'count(*)' else 'round(n, 2) AS n'}, round(100.0 * n / sum(n) OVER (PARTITION BY a), 4) AS row_pct,
               round(100.0 * n / sum(n) OVER (PARTITION BY b), 4) AS col_pct, round(100.0 * n / sum(n) OVER (), 4) AS total_pct FROM c"""


def _cells(df):
    return df.select("row_value", "col_value", F.round("n", 2).alias("n"), *[F.round(c, 4).alias(c) for c in ("row_pct", "col_pct", "total_pct")])


@query("xtab_counts", _crosstab_sql(_STATUS, "o_orderstatus", "v"))
def _(read):
    return _cells(tabulate.crosstab_df(_status(read), "o_orderstatus", "v"))


@query("xtab_na_exclude", _crosstab_sql(_STATUS, "v", "o_orderstatus", where="v IS NOT NULL"))
def _(read):
    return _cells(tabulate.crosstab_df(_status(read), "v", "o_orderstatus", na="exclude"))


@query("xtab_weighted", _crosstab_sql("SELECT * FROM lineitem", "l_returnflag", "l_linestatus", "sum(l_quantity)"))
def _(read):
    return _cells(tabulate.crosstab_df(read("lineitem"), "l_returnflag", "l_linestatus", wt="l_quantity"))


@query(
    "xtab_cutoff",
    f"""WITH t AS ({_STATUS}), top AS (SELECT v FROM t WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 2),
        c AS (SELECT CASE WHEN v IS NULL THEN '<NA>' WHEN v IN (SELECT v FROM top) THEN v ELSE '(Other)' END AS a, o_orderstatus AS b, count(*) AS n FROM t GROUP BY 1, 2)
        SELECT a AS row_value, b AS col_value, n, round(100.0 * n / sum(n) OVER (PARTITION BY a), 4) AS row_pct, round(100.0 * n / sum(n) OVER (PARTITION BY b), 4) AS col_pct, round(100.0 * n / sum(n) OVER (), 4) AS total_pct FROM c""",
)
def _(read):
    return _cells(tabulate.crosstab_df(_status(read), "v", "o_orderstatus", cutoff=2))


# Columns


def _missing_sql(source: str, names: list[str]) -> str:
    return f"WITH t AS ({source}) " + " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS variable, count(*) FILTER ({c} IS NULL) AS n_na, round(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 1) AS pct_na, count({c}) AS n_valid FROM t" for i, c in enumerate(names))


@query("diagnose_nas", _missing_sql(_HOLES, ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate"]))
def _(read):
    return columns.missing_df(_holes(read))


@query(
    "summary_table_numeric",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, 'numeric' AS type, count(DISTINCT {c}) AS n_unique, count(*) FILTER ({c} IS NULL) AS missing, round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS missing_share, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd,
            round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM ({s})"""
        for c, s in (("o_totalprice", _HOLES), ("p_size", "SELECT * FROM part"), ("p_retailprice", "SELECT * FROM part"))
    ),
)
def _(read):
    rows = columns.summary_df(_holes(read), ["o_totalprice"]).unionByName(columns.summary_df(read("part"), ["p_size", "p_retailprice"]))
    rows = rows.withColumns({"min": F.col("min").cast("double"), "max": F.col("max").cast("double")})
    return rounded(rows.select("variable", "type", "n_unique", "missing", F.round("missing_share", 6).alias("missing_share"), "mean", "sd", "min", "q25", "q50", "q75", "max").withColumn("missing_share", F.col("missing_share").cast("string"))).withColumn("missing_share", F.col("missing_share").cast("double"))


@query(
    "summary_table_text",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, 'character' AS type, count(DISTINCT {c}) AS n_unique, count(*) FILTER ({c} IS NULL) AS missing, (SELECT {c} FROM ({s}) WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_frequent, min({c}) AS min, max({c}) AS max,
            min({c}) AS example1, max({c}) AS example2 FROM ({s})"""
        for c, s in (("o_orderstatus", _HOLES), ("o_orderpriority", _HOLES), ("p_brand", "SELECT * FROM part"), ("p_type", "SELECT * FROM part"))
    ),
)
def _(read):
    rows = columns.summary_df(_holes(read), ["o_orderstatus", "o_orderpriority"]).unionByName(columns.summary_df(read("part"), ["p_brand", "p_type"]))
    return rows.select("variable", "type", "n_unique", "missing", "most_frequent", "min", "max", "example1", "example2")


@query("most_frequent", "SELECT l_partkey AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 1")
def _(read):
    return columns.most_frequent_df(read("lineitem"), "l_partkey")


# Strings

_STRINGS = """SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN '' WHEN c_custkey % 10 = 2 THEN '  ' WHEN c_custkey % 10 = 3 THEN concat(' ', c_mktsegment) WHEN c_custkey % 10 = 4 THEN concat(c_mktsegment, chr(160))
              WHEN c_custkey % 10 = 5 THEN lower(c_mktsegment) WHEN c_custkey % 10 = 6 THEN concat(c_mktsegment, 'é') ELSE c_mktsegment END AS s FROM customer"""


def _strings(read):
    return read("customer").selectExpr(
        """CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN '' WHEN c_custkey % 10 = 2 THEN '  ' WHEN c_custkey % 10 = 3 THEN concat(' ', c_mktsegment) WHEN c_custkey % 10 = 4 THEN concat(c_mktsegment, '\\u00A0')
           WHEN c_custkey % 10 = 5 THEN lower(c_mktsegment) WHEN c_custkey % 10 = 6 THEN concat(c_mktsegment, 'é') ELSE c_mktsegment END AS s"""
    )


_BLANK = r"regexp_full_match(s, '[\t\n\f\r\pZ]+')"


@query(
    "diagnose_strings",
    rf"""WITH t AS ({_STRINGS}) SELECT count(*) AS n_total, count(*) FILTER (s IS NULL) AS n_na, count(*) FILTER (s = '') AS n_empty, count(*) FILTER ({_BLANK}) AS n_whitespace_only,
        count(*) FILTER (s <> '' AND NOT {_BLANK} AND regexp_matches(s, '^[\t\n\f\r\pZ]')) AS n_leading_ws, count(*) FILTER (s <> '' AND NOT {_BLANK} AND regexp_matches(s, '[\t\n\f\r\pZ]$')) AS n_trailing_ws, count(*) FILTER (regexp_matches(s, '[^\x00-\x7F]')) AS n_non_ascii FROM t""",
)
def _(read):
    return strings.string_counts_df(_strings(read), "s")


@query("diagnose_strings_documents", r"SELECT count(*) AS n_total, count(*) FILTER (text IS NULL) AS n_na, count(*) FILTER (text = '') AS n_empty, count(*) FILTER (regexp_full_match(text, '[\t\n\f\r\pZ]+')) AS n_whitespace_only, count(*) FILTER (regexp_matches(text, '^[\t\n\f\r\pZ]')) AS n_leading_ws, count(*) FILTER (regexp_matches(text, '[\t\n\f\r\pZ]$')) AS n_trailing_ws, count(*) FILTER (regexp_matches(text, '[^\x00-\x7F]')) AS n_non_ascii FROM documents")
def _(read):
    return strings.string_counts_df(read("documents"), "text")


@query("case_variants", rf"WITH t AS ({_STRINGS}), d AS (SELECT DISTINCT s FROM t WHERE s <> '' AND NOT {_BLANK}) SELECT lower(s) AS lower, count(*) AS n_variants, array_to_string(list_slice(list_sort(list(s)), 1, 3), ', ') AS examples FROM d GROUP BY 1 HAVING count(*) > 1")
def _(read):
    return strings.case_variants_df(_strings(read), "s")


# Transformations


def _counts_sql(b: str, a: str, more: str, source: str) -> str:
    return f"""WITH t AS (SELECT {b} AS b, {a} AS a FROM ({source})) SELECT count(*) AS n_total, count(*) FILTER (a IS DISTINCT FROM b) AS n_changed, count(*) FILTER (a IS NOT DISTINCT FROM b) AS n_unchanged,
        round(100.0 * count(*) FILTER (a IS DISTINCT FROM b) / count(*), 4) AS pct_changed, count(*) FILTER (b IS NULL) AS n_na_before, count(*) FILTER (a IS NULL) AS n_na_after{more} FROM t"""


_MOMENTS = "".join(f", round(avg({c}), 4) AS mean_{s}, round(stddev_samp({c}), 4) AS sd_{s}, round(min({c}), 4) AS min_{s}, round(quantile_cont({c}, 0.5), 4) AS median_{s}, round(max({c}), 4) AS max_{s}, CAST(0 AS BIGINT) AS n_nan_{s}, CAST(0 AS BIGINT) AS n_inf_{s}" for c, s in (("b", "before"), ("a", "after")))


@query("transform_numeric", _counts_sql("l_extendedprice", "CASE WHEN l_quantity > 45 THEN NULL WHEN l_quantity > 20 THEN l_extendedprice * 2 ELSE l_extendedprice END", _MOMENTS + ", round(avg(abs(a - b)) FILTER (a IS DISTINCT FROM b), 4) AS mean_abs_delta, count(*) FILTER (abs(a - b) > 1.4901161193847656e-08) AS n_beyond_tol, round(100.0 * count(*) FILTER (abs(a - b) > 1.4901161193847656e-08) / count(abs(a - b)), 4) AS pct_beyond_tol", "SELECT * FROM lineitem"))
def _(read):
    after = F.when(F.col("l_quantity") > 45, None).when(F.col("l_quantity") > 20, F.col("l_extendedprice") * 2).otherwise(F.col("l_extendedprice"))
    return rounded(transform.transform_df(read("lineitem"), "l_extendedprice", after))


@query("transform_text", _counts_sql("s", "trim(upper(s), ' ')", "", _STRINGS))
def _(read):
    return rounded(transform.transform_df(_strings(read), "s", lambda c: F.trim(F.upper(c))))


@query("transform_examples", f"WITH t AS (SELECT s AS b, trim(upper(s), ' ') AS a FROM ({_STRINGS})) SELECT b AS before, a AS after, count(*) AS n FROM t WHERE a IS DISTINCT FROM b GROUP BY 1, 2 ORDER BY n DESC, before, after LIMIT 10")
def _(read):
    return transform.changed_examples_df(_strings(read), "s", lambda c: F.trim(F.upper(c)))


@query("transform_date", _counts_sql("CAST(o_orderdate AS DATE)", "CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS DATE) + 30 ELSE CAST(o_orderdate AS DATE) END", "".join(f", CAST(min({c}) AS VARCHAR) AS min_{s}, CAST(max({c}) AS VARCHAR) AS max_{s}, CAST(date_diff('day', min({c}), max({c})) AS DOUBLE) AS span_days_{s}" for c, s in (("b", "before"), ("a", "after"))), "SELECT * FROM orders"))
def _(read):
    day = read("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return rounded(transform.transform_df(day, "day", F.when(F.col("o_orderkey") % 6 == 0, F.date_add("day", 30)).otherwise(F.col("day"))))


@query("transform_logical", _counts_sql("o_totalprice > 150000", "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_totalprice > 120000 END", ", count(*) FILTER (b) AS n_true_before, count(*) FILTER (NOT b) AS n_false_before, count(*) FILTER (a) AS n_true_after, count(*) FILTER (NOT a) AS n_false_after", "SELECT * FROM orders"))
def _(read):
    flagged = read("orders").withColumn("flag", F.col("o_totalprice") > 150000)
    return rounded(transform.transform_df(flagged, "flag", F.when(F.col("o_orderkey") % 8 != 0, F.col("o_totalprice") > 120000)))


@query("transform_levels", f"WITH t AS (SELECT v AS b, CASE WHEN v LIKE '1%' THEN 'TOP' ELSE v END AS a FROM ({_STATUS})), b AS (SELECT b AS l, count(*) AS n FROM t GROUP BY 1), a AS (SELECT a AS l, count(*) AS n FROM t GROUP BY 1) SELECT coalesce(b.l, a.l) AS level, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after FROM b FULL JOIN a ON b.l IS NOT DISTINCT FROM a.l")
def _(read):
    return transform.level_counts_df(_status(read), "v", lambda c: F.when(c.like("1%"), "TOP").otherwise(c))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through taps, joins and filters: the trail as a frame."""
    return QUERIES["trail_df"](spark, sf_dir)


import ledgerframe.trail_queries  # noqa: E402, F401  registers its own
