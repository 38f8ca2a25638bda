"""A trail as one self-contained HTML page: a flow of snapshots, details of the one that is picked, and the change on each edge."""

from __future__ import annotations

import json
import os
import tempfile

from ledgerframe.operators.trail import AuditTrail, check_trail
from ledgerframe.sources.serialize import trail_to_list

_PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>Audit trail</title>
<style>
:root{--paper:#fbfaf7;--ink:#22303c;--soft:#8793a0;--line:#d5d9de;--mark:#1f6f8b;--loss:#a8402f}
.night{--paper:#16202a;--ink:#e4e9ee;--soft:#8fa0b0;--line:#33424f;--mark:#6cc3de;--loss:#f0917f}
body{margin:0;background:var(--paper);color:var(--ink);font:15px/1.5 system-ui,sans-serif}
header{display:flex;gap:1em;align-items:baseline;padding:1em 1.5em;border-bottom:1px solid var(--line)}
header h1{font-size:1.2em;margin:0;flex:1}button{font:inherit;color:inherit;background:none;border:1px solid var(--line);border-radius:5px;padding:.2em .7em;cursor:pointer}
main{display:grid;grid-template-columns:minmax(260px,360px) 1fr;gap:1.5em;padding:1.5em}
svg text{fill:var(--ink);font-size:13px}svg .soft{fill:var(--soft)}svg rect{fill:none;stroke:var(--line);stroke-width:1.5;cursor:pointer}svg .picked rect{stroke:var(--mark);stroke-width:3}
svg path{stroke:var(--soft);fill:none}svg .edge{cursor:pointer}svg .edge:hover text{fill:var(--mark)}
table{border-collapse:collapse;margin:.5em 0 1.2em}td,th{padding:.15em .8em .15em 0;text-align:left;border-bottom:1px solid var(--line)}td.n{text-align:right;font-variant-numeric:tabular-nums}
h2{font-size:1.1em}h3{font-size:.95em;color:var(--soft);margin-bottom:0}pre{white-space:pre-wrap;border:1px solid var(--line);padding:1em}.loss{color:var(--loss)}
</style></head><body>
<header><h1 id="title"></h1><button id="numbers">Numeric summary</button><button id="source">JSON</button><button id="copy">Copy</button><button id="theme">Light / dark</button></header>
<main><div id="flow"></div><section id="panel"></section></main>
<script type="application/json" id="trail">@@TRAIL@@</script>
<script>
"use strict";
const trail = JSON.parse(document.getElementById("trail").textContent);
const steps = Object.values(trail.snapshots), panel = document.getElementById("panel");
let view = {kind: "step", at: steps.length - 1}, numbers = true;
const make = (tag, text, cls) => { const e = document.createElement(tag); if (text !== undefined && text !== null) e.textContent = text; if (cls) e.className = cls; return e; };
const say = v => v === null || v === undefined ? "NA" : typeof v === "number" ? v.toLocaleString("en", {maximumFractionDigits: 4}) : typeof v === "object" ? JSON.stringify(v) : String(v);
function grid(heading, rows, heads) {
  if (!rows.length) return;
  panel.append(make("h3", heading));
  const t = make("table");
  if (heads) { const r = make("tr"); heads.forEach(h => r.append(make("th", h))); t.append(r); }
  rows.forEach(row => { const r = make("tr"); row.forEach(v => r.append(make("td", say(v), typeof v === "number" ? "n" : ""))); t.append(r); });
  panel.append(t);
}
const records = list => (list || []).map(Object.values);
function showStep(s) {
  panel.append(make("h2", `${s.index}. ${s.label} (${s.type})`));
  grid("Size", [["Rows", s.nrow], ["Columns", s.ncol], ["Missing values", s.total_nas], ["Recorded", s.timestamp]]);
  if (s.diagnostics) grid("Diagnostics", Object.entries(s.diagnostics));
  if (s.custom) grid("Custom diagnostics", Object.entries(s.custom));
  grid("Columns", records(s.schema), ["column", "class", "missing"]);
  if (numbers && s.numeric_summary) grid("Numeric summary", records(s.numeric_summary), Object.keys(s.numeric_summary[0]));
  if (s.pipeline) grid("Plan", s.pipeline.map(p => [p]));
}
function showEdge(i) {
  const a = steps[i - 1], b = steps[i], c = b.changes;
  panel.append(make("h2", `${a.label} to ${b.label}`));
  grid("Change", [["Rows", a.nrow, b.nrow, c.row_delta], ["Columns", a.ncol, b.ncol, c.col_delta], ["Missing values", a.total_nas, b.total_nas, c.na_delta]], ["", "before", "after", "delta"]);
  grid("Columns added", c.cols_added.map(x => [x]));
  grid("Columns removed", c.cols_removed.map(x => [x]));
  grid("Classes changed", records(c.type_changes), ["column", "before", "after"]);
  const old = Object.fromEntries((a.numeric_summary || []).map(x => [x.column, x.mean]));
  grid("Means", (b.numeric_summary || []).filter(x => x.column in old).map(x => [x.column, old[x.column], x.mean]), ["column", "before", "after"]);
}
function draw() {
  document.getElementById("title").textContent = `${trail.name} · ${steps.length} snapshots · ${trail.created_at}`;
  const flow = document.getElementById("flow"), ns = "http://www.w3.org/2000/svg";
  flow.textContent = ""; panel.textContent = "";
  if (!steps.length) { panel.append(make("p", "This trail has no snapshots yet.")); return; }
  const svg = document.createElementNS(ns, "svg"), gap = 110;
  svg.setAttribute("viewBox", `0 0 320 ${steps.length * gap}`);
  const put = (parent, tag, attributes, text) => { const e = document.createElementNS(ns, tag); Object.entries(attributes).forEach(([k, v]) => e.setAttribute(k, v)); if (text) e.textContent = text; parent.append(e); return e; };
  steps.forEach((s, i) => {
    const y = i * gap + 5;
    if (i) {
      const g = put(svg, "g", {class: "edge"});
      put(g, "path", {d: `M160 ${y - 45}V${y - 4}`});
      const d = s.changes.row_delta;
      put(g, "text", {x: 170, y: y - 20, class: "soft"}, `${d > 0 ? "+" : ""}${d.toLocaleString("en")} rows`);
      g.addEventListener("click", () => { view = {kind: "edge", at: i}; draw(); });
    }
    const g = put(svg, "g", {class: view.kind === "step" && view.at === i ? "picked" : ""});
    put(g, "rect", {x: 10, y, width: 300, height: 60, rx: 8});
    put(g, "text", {x: 24, y: y + 25}, `${s.index}. ${s.label}`);
    put(g, "text", {x: 24, y: y + 46, class: "soft"}, `${s.type} · ${s.nrow.toLocaleString("en")} rows × ${s.ncol}`);
    g.addEventListener("click", () => { view = {kind: "step", at: i}; draw(); });
  });
  flow.append(svg);
  if (view.kind === "json") panel.append(make("pre", JSON.stringify(trail, null, 2)));
  else if (view.kind === "edge") showEdge(view.at);
  else showStep(steps[view.at]);
}
document.getElementById("theme").onclick = () => document.body.classList.toggle("night");
document.getElementById("numbers").onclick = () => { numbers = !numbers; draw(); };
document.getElementById("source").onclick = () => { view = {kind: "json"}; draw(); };
document.getElementById("copy").onclick = () => navigator.clipboard && navigator.clipboard.writeText(JSON.stringify(trail, null, 2));
draw();
</script></body></html>
"""


def audit_export(trail: AuditTrail, file: str | None = None) -> str:
    """Writes the page (to a new temporary file without a name) and returns its path."""
    check_trail(trail)
    data = json.dumps(_without_nan(trail_to_list(trail)), ensure_ascii=False, default=str)
    page = _PAGE.replace("@@TRAIL@@", data.replace("</", "<\\/"))
    if file is None:
        handle, file = tempfile.mkstemp(suffix=".html", prefix="audit_trail_")
        os.close(handle)
    with open(file, "w", encoding="utf-8") as out:
        out.write(page)
    return file


def _without_nan(value):  # noqa: ANN001, ANN202
    """NaN and infinities as text, which JSON has no numbers for."""
    if isinstance(value, dict):
        return {k: _without_nan(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_without_nan(v) for v in value]
    return str(value) if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))) else value
