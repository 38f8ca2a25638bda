"""Audit trails and data diagnostics for DataFrame pipelines on Spark."""

from ledgerframe.functions.types import as_factor
from ledgerframe.operators.columns import diagnose_nas, get_summary_table, summarize_column
from ledgerframe.operators.compare import compare_tables
from ledgerframe.operators.diff import audit_diff
from ledgerframe.operators.filters import filter_drop, filter_keep, filter_out_tap, filter_tap
from ledgerframe.operators.joins import anti_join_tap, full_join_tap, inner_join_tap, left_join_tap, right_join_tap, semi_join_tap
from ledgerframe.operators.report import audit_report
from ledgerframe.operators.strings import diagnose_strings
from ledgerframe.operators.tabulate import tab, tab_tap
from ledgerframe.operators.trail import AuditTrail, Snapshot, audit_tap, audit_trail
from ledgerframe.operators.transform import audit_transform
from ledgerframe.operators.validate import validate_join, validate_primary_keys, validate_var_relationship
from ledgerframe.sources.html import audit_export
from ledgerframe.sources.log import open_trail
from ledgerframe.sources.serialize import read_trail, trail_to_df, trail_to_list, write_trail

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("functions", "operators", "plans", "sources", "streaming")]
