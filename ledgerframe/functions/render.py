"""Plain-text tables for reports."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any


def shown(value: Any) -> str:
    if value is None:
        return "NA"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return f"{value:,}"
    if isinstance(value, float):
        return f"{value:,.0f}" if value == int(value) and abs(value) < 1e15 else f"{value:,.4g}" if abs(value) < 1e4 else f"{value:,.2f}"
    return str(value)


def table_text(title: str, header: Sequence[str], rows: Sequence[Sequence[Any]], foot: Sequence[str] = ()) -> str:
    """A title, a table with aligned columns, and lines below."""
    cells = [list(map(str, header)), *[[shown(v) for v in r] for r in rows]]
    widths = [max(len(r[k]) for r in cells) for k in range(len(header))]
    numeric = [bool(rows) and all(isinstance(r[k], (int, float)) and not isinstance(r[k], bool) or r[k] is None for r in rows) for k in range(len(header))]
    line = lambda r: "  ".join(v.rjust(w) if n else v.ljust(w) for v, w, n in zip(r, widths, numeric, strict=True)).rstrip()
    rule = "-" * max(len(title), sum(widths) + 2 * (len(widths) - 1))
    return "\n".join([title, rule, line(cells[0]), *map(line, cells[1:]), *([rule, *foot] if foot else [])])


def signed(value: float) -> str:
    return f"{value:+,}" if isinstance(value, int) else f"{value:+,.4g}"


def shortened(text: str, size: int = 60) -> str:
    return text if len(text) <= size else text[:size] + "..."
