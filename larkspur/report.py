"""A scan of one project as a page: totals, flagged packages with their signals, findings with call paths, upgrades, warnings.

Only what the page shows is collected, and every value is escaped.
"""

from __future__ import annotations

import html
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import vulns
from .projects import Scan

#: Rows of a section: packages, signals of each, reachable findings, call paths, other findings, upgrades, warnings.
PACKAGES, SIGNALS, REACHABLE, PATHS, OTHERS, ACTIONS, WARNINGS = 25, 10, 60, 10, 40, 20, 15
REASONS = {
    "not_analysed": "no source of the application was analysed",
    "not_imported": "no module of the application imports the package",
    "assumed_reachable": "the package is imported, and nothing rules its code out",
    "reachable": "the application calls the vulnerable code on a path from where it starts",
    "symbol_not_called": "the package is imported, but no reachable code calls the vulnerable symbols",
}


def _text(value: object) -> str:
    return html.escape("" if value is None else str(value))


def _table(head: list[str], rows: Iterable[Iterable[object]]) -> str:
    cells = "".join("<tr>" + "".join(f"<td>{_text(v)}</td>" for v in row) + "</tr>" for row in rows)
    return "<table><tr>" + "".join(f"<th>{_text(h)}</th>" for h in head) + f"</tr>{cells}</table>"


def page(scan: Scan, project: str, scores: DataFrame | None = None, signals: DataFrame | None = None) -> str:
    """The page of one project. scores: package, version, score, verdict; signals: package, code, severity, rank, occurrences, first_path."""
    mine = lambda t: t.where(F.col("project") == project)
    packages = mine(scan.packages).agg(F.count(F.lit(1)).alias("all"), F.count_if("is_direct").alias("direct")).first()
    findings = mine(scan.findings)
    totals = findings.agg(F.count(F.lit(1)).alias("all"), F.count_if("reachable").alias("reachable"), F.count_if(F.col("verdict") == "not_analysed").alias("unseen")).first()
    ruled_out = totals["all"] - totals["reachable"]
    out = [f"<!doctype html><meta charset='utf-8'><title>{_text(project)}</title><h1>{_text(project)}</h1>"]
    out.append(_table(["packages", "direct", "advisories", "reachable", "ruled out"], [(packages["all"], packages["direct"], totals["all"], totals["reachable"], f"{ruled_out / totals['all']:.0%}" if totals["all"] else "0%")]))
    if totals["unseen"]:
        out.append("<p>No source was analysed, so every advisory is reported as reachable.</p>")
    out.append("<h2>Flagged packages</h2>")
    flagged = []
    if scores is not None:
        flagged = scores.where("verdict <> 'benign'").join(mine(scan.packages).select(F.col("name").alias("package"), "version"), ["package", "version"], "left_semi").orderBy(F.desc("score"), "package").limit(PACKAGES).collect()
    if not flagged:
        out.append("<p>None.</p>")
    for p in flagged:
        out.append(f"<h3>{_text(p['package'])}@{_text(p['version'])} {_text(p['verdict'])} {p['score']:.3f}</h3>")
        if signals is not None:
            rows = signals.where(F.col("package") == p["package"]).orderBy(F.desc("rank"), F.desc("occurrences"), "code").limit(SIGNALS).collect()
            out.append(_table(["severity", "signal", "times", "place"], [(r["severity"], r["code"], r["occurrences"], r["first_path"]) for r in rows]))
    out.append("<h2>Reachable vulnerabilities</h2>")
    urgent = findings.where("reachable").orderBy(F.desc("priority"), "package", "id").limit(REACHABLE).collect()
    name = lambda r: r["cve"] or r["id"]
    out.append(_table(["advisory", "package", "severity", "score", "fixed in", "why"], [(name(r), f"{r['package']}@{r['version']}", r["severity"], r["cvss"], r["fixed"], REASONS[r["verdict"]]) for r in urgent]) if urgent else "<p>None.</p>")
    for r in [r for r in urgent if r["steps"]][:PATHS]:
        out.append(f"<h3>{_text(name(r))}: {_text(r['package'])}</h3><ol>" + "".join(f"<li>{_text(s['caller'])} → {_text(s['callee'])} ({_text(s['file'])}:{_text(s['line'])})</li>" for s in r["steps"]) + "</ol>")
    others = findings.where("NOT reachable").orderBy(F.coalesce("cvss", F.lit(0.0)).desc(), "package", "id").limit(OTHERS).collect()
    if others:
        out.append(f"<h2>Not reachable ({ruled_out})</h2>" + _table(["advisory", "package", "severity", "why"], [(name(r), r["package"], r["severity"], REASONS[r["verdict"]]) for r in others]))
    plan = mine(scan.plan).orderBy(F.desc("reachable_fixes"), F.desc("fixes"), "package").limit(ACTIONS).collect()
    if plan:
        out.append("<h2>Upgrades</h2>" + _table(["package", "from", "to", "fixes", "reachable", "highest", "advisories"], [(r["package"], r["version"], r["upgrade_to"], r["fixes"], r["reachable_fixes"], vulns.RANKS[r["worst"]], ", ".join(r["ids"])) for r in plan]))
    said = mine(scan.warnings).orderBy("warning").limit(WARNINGS).collect()
    if said:
        out.append("<h2>Warnings</h2><ul>" + "".join(f"<li>{_text(r['warning'])}</li>" for r in said) + "</ul>")
    return "\n".join(out)
