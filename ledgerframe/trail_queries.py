"""Registered queries of what trails, taps and result objects hold, and the same in SQL.

They go through the public functions: taps are taken, trails written and read, comparisons and tables made, and what these hold becomes rows."""

from __future__ import annotations

import json
import tempfile
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.operators import columns, compare, joins, validate
from ledgerframe.operators.diff import audit_diff
from ledgerframe.operators.filters import filter_keep, filter_tap
from ledgerframe.operators.tabulate import tab, tab_tap
from ledgerframe.operators.trail import audit_tap, audit_trail
from ledgerframe.queries import _HOLES, _NEW, _OLD, _ON, _STATUS, _TOL, _X, _Y, Query, _good_customers, _holes, _status, _trail, _validation_sql, _x, _y, query, rounded
from ledgerframe.sources.log import TrailLog
from ledgerframe.sources.serialize import list_to_trail, read_trail, trail_to_df, trail_to_list, write_trail

Read = Callable[[str], DataFrame]
_KINDS = ("left", "right", "inner", "full", "anti", "semi")
_JOINED = {
    "left": f"SELECT count(*) FROM x LEFT JOIN y ON {_ON}",
    "right": f"SELECT count(*) FROM x RIGHT JOIN y ON {_ON}",
    "inner": f"SELECT count(*) FROM x JOIN y ON {_ON}",
    "full": f"SELECT count(*) FROM x FULL JOIN y ON {_ON}",
    "anti": f"SELECT count(*) FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE {_ON})",
    "semi": f"SELECT count(*) FROM x WHERE EXISTS (SELECT 1 FROM y WHERE {_ON})",
}


def _session(read: Read) -> SparkSession:
    return read("region").sparkSession


# Join taps

_METRICS = _validation_sql(_X, _Y.replace("c_mktsegment", "c_mktsegment, c_acctbal"), "k", "k", "o_totalprice", "c_acctbal")


@query(
    "join_taps_enriched",
    f"""WITH x AS ({_X}), y AS ({_Y}), v AS ({_METRICS}), n AS ({" UNION ALL ".join(f"SELECT '{k}_join' AS join_type, ({_JOINED[k]}) AS nrow" for k in _KINDS)})
        SELECT join_type, nrow, relation, match_rate_x, match_rate_y, n_only_x, n_only_y, n_key_overlap, x_has_dups, y_has_dups, stat_x_total, stat_x_matched, stat_x_rate FROM n, v""",
)
def _(read):
    rows = []
    for kind in _KINDS:
        trail = audit_trail(kind)
        getattr(joins, f"{kind}_join_tap")(_x(read), _y(read), "k", trail=trail, stat="o_totalprice", numeric_summary=False)
        s = trail.snapshots[-1]
        d, stat = s.diagnostics, s.diagnostics["stat"]
        rows.append((d["join_type"], s.nrow, d["relation"], round(d["match_rate"]["x"], 4), round(d["match_rate"]["y"], 4), d["n_only_x"], d["n_only_y"], d["n_key_overlap"], d["x_has_dups"], d["y_has_dups"], round(stat["stat_x_total"], 2), round(stat["stat_x_matched"], 2), round(stat["stat_x_rate"], 2)))
    return _session(read).createDataFrame(rows, "join_type string, nrow long, relation string, match_rate_x double, match_rate_y double, n_only_x long, n_only_y long, n_key_overlap long, x_has_dups boolean, y_has_dups boolean, stat_x_total double, stat_x_matched double, stat_x_rate double")


@query("join_without_trail", f"WITH x AS ({_X}), y AS ({_Y}) SELECT x.o_orderkey, x.k, y.c_mktsegment FROM x LEFT JOIN y ON {_ON}")
def _(read):
    return joins.left_join_tap(_x(read), _y(read), "k").select("o_orderkey", "k", "c_mktsegment")


@query("join_multiple_any", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer")
def _(read):
    one = joins.join_frames(read("customer").select("c_custkey"), read("orders").select("o_custkey", "o_orderkey"), {"c_custkey": "o_custkey"}, multiple="any")
    return one.select("c_custkey", F.col("o_orderkey").isNotNull().alias("has_orders"))


@query("join_errors", "SELECT * FROM (VALUES ('multiple', true), ('unmatched', true), ('neither', false)) t(asked, raised)")
def _(read):
    orders, customers = read("orders").select("o_custkey"), read("customer").select("c_custkey")

    def raised(x: DataFrame, y: DataFrame, **options) -> bool:
        try:
            joins.join_frames(x, y, [(x.columns[0], y.columns[0])], **options)
        except ValueError:
            return True
        return False

    few = customers.where("c_custkey < 10")
    rows = [("multiple", raised(customers, orders, multiple="error")), ("unmatched", raised(orders, few, unmatched="error")), ("neither", raised(orders, customers, multiple="error", unmatched="error"))]
    return _session(read).createDataFrame(rows, "asked string, raised boolean")


# Trails

_STEPS = """o AS (SELECT * FROM orders), j AS (SELECT o.*, c.c_mktsegment FROM o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0),
       f AS (SELECT * FROM j WHERE o_totalprice > 100000), g AS (SELECT * FROM f WHERE NOT coalesce(c_mktsegment = 'BUILDING', false)),
       s AS (SELECT 1 AS "index", 'raw' AS label, 'tap' AS type, count(*) AS nrow, 6 AS ncol, CAST(0 AS BIGINT) AS total_nas FROM o
       UNION ALL SELECT 2, 'joined', 'join', count(*), 7, count(*) FILTER (c_mktsegment IS NULL) FROM j
       UNION ALL SELECT 3, 'large', 'filter', count(*), 7, count(*) FILTER (c_mktsegment IS NULL) FROM f
       UNION ALL SELECT 4, 'rest', 'filter', count(*), 7, count(*) FILTER (c_mktsegment IS NULL) FROM g)"""
_COLUMNS = "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority"


@query(
    "trail_df",
    f"""WITH {_STEPS} SELECT s.*, CASE WHEN "index" = 1 THEN '{_COLUMNS}' ELSE '{_COLUMNS},c_mktsegment' END AS all_columns, CASE WHEN "index" = 1 THEN 3 END AS summarised,
        nrow - lag(nrow) OVER w AS row_delta, CAST(ncol - lag(ncol) OVER w AS INTEGER) AS col_delta, total_nas - lag(total_nas) OVER w AS na_delta, CASE "index" WHEN 2 THEN 'c_mktsegment' WHEN 1 THEN NULL ELSE '' END AS cols_added,
        CASE WHEN type = 'filter' THEN lag(nrow) OVER w - nrow END AS n_dropped, CASE label WHEN 'large' THEN 'keep' WHEN 'rest' THEN 'drop' END AS filter_type, CASE WHEN type = 'join' THEN 'many-to-one' END AS relation,
        type <> 'tap' AS limited, 'orders' AS trail_name FROM s WINDOW w AS (ORDER BY "index")""",
)
def _(read):
    rows = trail_to_df(_trail(read), _session(read))
    told = lambda key: F.get_json_object("diagnostics", f"$.{key}")
    more = [F.array_join("all_columns", ",").alias("all_columns"), F.when(F.col("numeric_summary").isNotNull(), F.size("numeric_summary")).alias("summarised")]
    more += ["changes.row_delta", "changes.col_delta", "changes.na_delta", F.array_join("changes.cols_added", ",").alias("cols_added")]
    more += [told("n_dropped").cast("long").alias("n_dropped"), told("filter_type").alias("filter_type"), told("relation").alias("relation"), (~F.col("controls.numeric_summary")).alias("limited"), "trail_name"]
    return rows.select("index", "label", "type", "nrow", "ncol", "total_nas", *more)


_FORMS = ("list", "json", "parquet", "trail", "log")


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; of this machine on a local master alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/trails-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp()


@query("trail_round_trips", f"""WITH {_STEPS} SELECT form, s.*, true AS same FROM s, (VALUES {", ".join(f"('{f}')" for f in _FORMS)}) t(form)""")
def _(read):
    spark, trail, out = _session(read), _trail(read), None
    for form in _FORMS:
        if form == "list":
            back = list_to_trail(json.loads(json.dumps(trail_to_list(trail))))
        else:
            # JSON is a file of the driver's; Spark's own form goes to the folder that executors share, where the cluster names one.
            path = f"{tempfile.mkdtemp() if form == 'json' else _folder(spark)}/trail.{form}"
            write_trail(trail, path, spark=spark)
            back = read_trail(path, spark=spark)
        same = F.lit(trail_to_list(back) == trail_to_list(trail))
        rows = trail_to_df(back, spark).select(F.lit(form).alias("form"), "index", "label", "type", "nrow", "ncol", "total_nas", same.alias("same"))
        out = rows if out is None else out.union(rows)
    return out


@query("trail_custom_frame", "SELECT form, o_orderstatus AS status, count(*) AS n FROM orders, (VALUES ('json'), ('parquet'), ('log')) t(form) GROUP BY ALL")
def _(read):
    spark, trail, out = _session(read), audit_trail("frames"), None
    audit_tap(read("orders"), trail, fns={"by status": lambda df: df.groupBy("o_orderstatus").count()}, numeric_summary=False)
    for form in ("json", "parquet", "log"):
        path = f"{tempfile.mkdtemp() if form == 'json' else _folder(spark)}/trail.{form}"
        write_trail(trail, path, spark=spark)
        found = read_trail(path, spark=spark).snapshots[0].custom["by status"]
        rows = TrailLog(path, spark).frame(found) if form == "log" else spark.createDataFrame(found["rows"], "status string, n long")
        rows = rows.toDF("status", "n").select(F.lit(form).alias("form"), "status", "n")
        out = rows if out is None else out.union(rows)
    return out


@query(
    "tap_pipeline",
    """WITH n AS (SELECT count(*) AS nrow FROM (SELECT * FROM orders WHERE o_totalprice > 100000) o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey),
       s(position, step) AS (VALUES (1, 'read orders'), (2, 'read customer'), (3, 'filter o_totalprice > 100000'), (4, 'filter c_acctbal > 0'), (5, 'left join on o_custkey = c_custkey')) SELECT position, step, nrow FROM s, n""",
)
def _(read):
    trail = audit_trail("pipeline")
    large, good = read("orders").where("o_totalprice > 100000"), read("customer").where("c_acctbal > 0")
    audit_tap(large.join(good, F.col("o_custkey") == F.col("c_custkey"), "left"), trail, numeric_summary=False)
    s = trail.snapshots[0]
    return _session(read).createDataFrame([(i, step, s.nrow) for i, step in enumerate(s.pipeline, 1)], "position int, step string, nrow long")


@query("diff_any_two", f"""WITH {_STEPS} SELECT 'rows' AS kind, CAST(b.nrow - a.nrow AS DOUBLE) AS delta FROM s a, s b WHERE a."index" = 1 AND b.label = 'rest' UNION ALL SELECT 'columns', CAST(b.ncol - a.ncol AS DOUBLE) FROM s a, s b WHERE a."index" = 1 AND b.label = 'rest'
        UNION ALL SELECT 'missing values', CAST(b.total_nas - a.total_nas AS DOUBLE) FROM s a, s b WHERE a."index" = 1 AND b.label = 'rest'""")
def _(read):
    found = audit_diff(_trail(read), 1, "rest").to_df(_session(read))
    return found.where("kind in ('rows', 'columns', 'missing values')").select("kind", F.col("delta").cast("double").alias("delta"))


@query(
    "tap_chosen_columns",
    f"""WITH t AS ({_HOLES}) SELECT 'include' AS given, 'o_totalprice' AS "column", 'numeric' AS type, count(*) FILTER (o_totalprice IS NULL) AS n_na, true AS summarised FROM t
        UNION ALL SELECT 'include', 'o_orderstatus', 'character', count(*) FILTER (o_orderstatus IS NULL), false FROM t
        UNION ALL SELECT 'exclude', 'o_orderkey', 'integer', 0, true UNION ALL SELECT 'exclude', 'o_orderpriority', 'character', 0, false UNION ALL SELECT 'exclude', 'o_orderdate', 'POSIXct', 0, false""",
)
def _(read):
    rows = []
    for given, options in (("include", {"cols_include": ["o_totalprice", "o_orderstatus"]}), ("exclude", {"cols_exclude": ["o_totalprice", "o_orderstatus"]})):
        trail = audit_trail(given)
        audit_tap(_holes(read), trail, **options)
        s = trail.snapshots[0]
        rows += [(given, c["column"], c["type"], c["n_na"], c["column"] in [m["column"] for m in s.numeric_summary or ()]) for c in s.schema]
    return _session(read).createDataFrame(rows, "given string, column string, type string, n_na long, summarised boolean")


@query(
    "tap_custom_diagnostics",
    """SELECT 'by a column' AS name, CAST(sum(o_totalprice > 100000) AS BIGINT) AS value FROM orders UNION ALL SELECT 'by a function', count(DISTINCT o_custkey) FROM orders""",
)
def _(read):
    trail = audit_trail("custom")
    audit_tap(read("orders"), trail, fns={"by a column": F.count_if(F.col("o_totalprice") > 100000), "by a function": lambda df: df.select("o_custkey").distinct().count()}, numeric_summary=False)
    return _session(read).createDataFrame(list(trail.snapshots[0].custom.items()), "name string, value long")


# Filters


@query(
    "filter_tap_recorded",
    """WITH t AS (SELECT *, l_quantity > 25 AND l_returnflag <> 'R' AS k FROM lineitem)
       SELECT 'keep' AS filter_type, 'l_quantity > 25 & l_returnflag <> ''R''' AS expr_label, count(*) FILTER (NOT k) AS n_dropped, count(*) AS n_total, round(100.0 * count(*) FILTER (NOT k) / count(*), 4) AS pct_dropped,
              round(sum(l_extendedprice) - sum(l_extendedprice) FILTER (k), 2) AS stat_dropped, round(sum(l_extendedprice), 2) AS stat_total, 'l_extendedprice' AS stat_col, CAST(0 AS BIGINT) AS n_na_in_filter, count(*) FILTER (k) AS nrow FROM t""",
)
def _(read):
    trail = audit_trail("filter")
    filter_tap(read("lineitem"), "l_quantity > 25", "l_returnflag <> 'R'", trail=trail, stat="l_extendedprice", quiet=True, numeric_summary=False)
    s = trail.snapshots[0]
    d = {**s.diagnostics, "nrow": s.nrow}
    d |= {"pct_dropped": round(d["pct_dropped"], 4), "stat_dropped": round(d["stat_dropped"], 2), "stat_total": round(d["stat_total"], 2)}
    return _session(read).createDataFrame([tuple(d.values())], "filter_type string, expr_label string, n_dropped long, n_total long, pct_dropped double, stat_dropped double, stat_total double, stat_col string, n_na_in_filter long, nrow long")


@query("filter_thresholds", "SELECT t AS threshold, (SELECT count(*) FILTER (NOT o_totalprice > 100000) / count(*) FROM orders) > t AS warned FROM (VALUES (0.01::DOUBLE), (0.5::DOUBLE), (0.99::DOUBLE)) v(t)")
def _(read):
    rows = []
    for threshold in (0.01, 0.5, 0.99):
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            filter_keep(read("orders"), "o_totalprice > 100000", quiet=True, warn_threshold=threshold)
        rows.append((threshold, any("exceeds threshold" in str(w.message) for w in seen)))
    return _session(read).createDataFrame(rows, "threshold double, warned boolean")


# Validation


@query(
    "validate_join_summary",
    f"""WITH v AS ({_METRICS}) SELECT 'Relation' AS item, relation AS value FROM v UNION ALL SELECT 'Key(s)', 'k' UNION ALL SELECT 'Rows in x', format('{{:,}}', x_rows) FROM v UNION ALL SELECT 'Rows in y', format('{{:,}}', y_rows) FROM v
        UNION ALL SELECT 'Unique keys in x', format('{{:,}}', x_unique) FROM v UNION ALL SELECT 'Unique keys in y', format('{{:,}}', y_unique) FROM v UNION ALL SELECT 'Keys in both', format('{{:,}}', n_key_overlap) FROM v
        UNION ALL SELECT 'Matched pairs', format('{{:,}}', CAST(n_matched_pairs AS BIGINT)) FROM v UNION ALL SELECT 'Rows only in x', format('{{:,}}', n_only_x) FROM v UNION ALL SELECT 'Rows only in y', format('{{:,}}', n_only_y) FROM v
        UNION ALL SELECT 'Match rate x', format('{{:.2f}}%', match_rate_x) FROM v UNION ALL SELECT 'Match rate y', format('{{:.2f}}%', match_rate_y) FROM v
        UNION ALL SELECT 'Duplicated keys', format('x: {{:,}}, y: {{:,}}', n_dup_keys_x, n_dup_keys_y) FROM v""",
)
def _(read):
    found = validate.validate_join(_x(read), _good_customers(read).select("k", "c_acctbal"), "k", stat_x="o_totalprice", stat_y="c_acctbal")
    return _session(read).createDataFrame(found.summary(), "item string, value string")


# Comparison

_AUTO = f"""WITH x AS ({_OLD}), y AS ({_NEW}), m AS (SELECT x.o_totalprice AS px, y.o_totalprice AS py, x.rank AS rx, y.rank AS ry FROM x JOIN y ON x.o_orderkey = y.o_orderkey AND x.o_orderstatus IS NOT DISTINCT FROM y.o_orderstatus AND x.o_orderpriority = y.o_orderpriority),
    n AS (SELECT count(*) AS n, count(*) FILTER (coalesce(abs(px - py) > {_TOL}, false) OR (px IS NULL) <> (py IS NULL)) AS a, count(*) FILTER (coalesce(abs(rx - ry) > {_TOL}, false)) AS b FROM m)"""


def _pair(read: Read) -> tuple[DataFrame, DataFrame]:
    old = read("orders").where("o_totalprice > 20000").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("rank"), "o_orderstatus", "o_orderpriority")
    new = read("orders").where("o_orderpriority <> '1-URGENT'").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + o_orderkey % 97 WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
        "CASE WHEN o_orderkey % 17 = 0 THEN o_custkey + 0.01D ELSE CAST(o_custkey AS DOUBLE) END AS rank",
        "CASE WHEN o_orderkey % 19 = 0 THEN 'X' WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
        "o_orderpriority",
    )
    return old, new


@query("compare_auto_keys", f"""{_AUTO} SELECT 'o_orderkey,o_orderstatus,o_orderpriority' AS keys, 'o_totalprice,rank' AS compared, 'keys' AS comparison_method, n AS matched, a + b AS total_discrepancies, (SELECT count(*) FROM x) AS rows_x, (SELECT count(*) FROM y) AS rows_y FROM n""")
def _(read):
    found = compare.compare_tables(*_pair(read), tol=_TOL)
    m = found.match_summary
    row = (",".join(found.plan.keys), ",".join(found.plan.values), found.comparison_method, m["matched_no_disc"] + m["matched_with_disc"], found.total_discrepancies, *found.n_rows)
    return _session(read).createDataFrame([row], "keys string, compared string, comparison_method string, matched long, total_discrepancies long, rows_x long, rows_y long")


@query("compare_excluded", f"""WITH x AS ({_OLD}), y AS ({_NEW}) SELECT 'o_totalprice,o_orderstatus' AS compared, count(*) FILTER (coalesce(abs(x.o_totalprice - y.o_totalprice) > {_TOL}, false) OR (x.o_totalprice IS NULL) <> (y.o_totalprice IS NULL)) + count(*) FILTER (x.o_orderstatus IS DISTINCT FROM y.o_orderstatus) AS total_discrepancies FROM x JOIN y USING (o_orderkey)""")
def _(read):
    found = compare.compare_tables(*_pair(read), key_cols=["o_orderkey"], tol=_TOL, exclude_cols=["rank", "o_orderpriority"], quantiles="sorted")
    return _session(read).createDataFrame([(",".join(found.plan.values), found.total_discrepancies)], "compared string, total_discrepancies long")


# Tables and columns


@query("tab_tap_recorded", f"WITH t AS ({_STATUS}) SELECT coalesce(v, '<NA>') AS value, count(*) AS freq, round(100.0 * count(*) / (SELECT count(*) FROM t), 1) AS percent FROM t GROUP BY 1")
def _(read):
    trail = audit_trail("tab")
    tab_tap(_status(read), "v", trail=trail, numeric_summary=False)
    rows = trail.snapshots[0].custom["tab(v)"].rows
    return _session(read).createDataFrame([(r["value"], r["freq"], r["percent"]) for r in rows], "value string, freq long, percent double")


@query(
    "xtab_matrix_order",
    f"""WITH t AS ({_STATUS}), d AS (SELECT 'row' AS side, coalesce(v, '<NA>') AS label, v IS NULL AS none, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'col', o_orderstatus, false, count(*) FROM t GROUP BY ALL)
        SELECT side, label, row_number() OVER (PARTITION BY side ORDER BY none, n DESC, label) AS position FROM d""",
)
def _(read):
    down, across, _ = tab(_status(read), "v", "o_orderstatus", sort="freq_desc").matrix()
    rows = [(side, label, i) for side, labels in (("row", down), ("col", across)) for i, label in enumerate(labels, 1)]
    return _session(read).createDataFrame(rows, "side string, label string, position long")


def _class_sql(variable: str, kind: str, value: str, source: str, text: str, mean: bool, span: bool) -> str:
    return f"""SELECT '{variable}' AS variable, '{kind}' AS type, count(DISTINCT v) AS n_unique, count(*) FILTER (v IS NULL) AS missing, (SELECT {text} FROM (SELECT {value} AS v FROM {source}) WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1) AS most_frequent,
        {"round(avg(CAST(v AS INTEGER)), 6)" if mean else "CAST(NULL AS DOUBLE)"} AS mean, {"CAST(min(v) AS VARCHAR)" if span else "CAST(NULL AS VARCHAR)"} AS min, {"CAST(max(v) AS VARCHAR)" if span else "CAST(NULL AS VARCHAR)"} AS max FROM (SELECT {value} AS v FROM {source})"""


def _classes(read: Read) -> DataFrame:
    hole = F.col("o_orderkey") % 13 != 0
    return read("orders").select(F.when(hole, F.col("o_orderdate").cast("date")).alias("day"), F.when(hole, F.col("o_totalprice") > 150000).alias("large"), F.when(hole, F.date_trunc("month", "o_orderdate")).alias("month"))


def _class(variable: str) -> Query:
    return lambda read: rounded(columns.get_summary_table(_classes(read), [variable]).select("variable", "type", "n_unique", "missing", "most_frequent", "mean", "min", "max"), 6)


_HOLE = "CASE WHEN o_orderkey % 13 <> 0 THEN {} END"
query("summary_table_date", _class_sql("day", "Date", _HOLE.format("CAST(o_orderdate AS DATE)"), "orders", "CAST(v AS VARCHAR)", False, True))(_class("day"))
query("summary_table_logical", _class_sql("large", "logical", _HOLE.format("o_totalprice > 150000"), "orders", "CAST(v AS VARCHAR)", True, False))(_class("large"))
query("summary_table_time", _class_sql("month", "POSIXct", _HOLE.format("CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)"), "orders", "strftime(v, '%Y-%m-%d %H:%M:%S')", False, False))(_class("month"))


@query(
    "transform_sorted_median",
    "SELECT count(*) AS n_total, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_before, round(quantile_cont(l_extendedprice * (1 - l_discount), 0.5), 4) AS median_after FROM lineitem",
)
def _(read):
    from ledgerframe.operators.transform import transform_df

    row = transform_df(read("lineitem"), "l_extendedprice", F.col("l_extendedprice") * (1 - F.col("l_discount")), quantiles="sorted")
    return rounded(row.select("n_total", "median_before", "median_after"))
