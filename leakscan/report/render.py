"""Reports of findings: terminal, JSON, SARIF and HTML; none holds a plain secret. Here rows stream through the driver one by one;
sink.py writes the last three on the executors."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row

from ..operators.score import SEVERITIES, severity_counts, worst_first
from . import sarif
from .frame import Frame

FIELDS = ["detector_type", "file_path", "line_number", "severity", "points", "exposure", "commit_hash", "redacted", "redacted_context", "rationale", "entropy_score", "file_class", "verified", "remediation_steps", "occurrences", "history_commits"]
NOTHING = "No leaked credentials, but for placeholders."
COLORS = {4: "\033[1;31m", 3: "\033[31m", 2: "\033[33m", 1: "\033[36m"}


def shown(r: Row) -> dict:
    return {f: r[f] if f in r else None for f in FIELDS} | {"severity": SEVERITIES[r["severity"] - 1]}


def rows(found: DataFrame) -> Iterator[dict]:
    return map(shown, worst_first(found).toLocalIterator())


def counts(found: DataFrame) -> dict[str, int]:
    return {r["label"]: r["findings"] for r in sorted(severity_counts(found).collect(), key=lambda r: -r["severity"])}


def where(r: dict) -> str:
    if r["exposure"] != "working_tree":
        return "history"
    return "LIVE +history" if r["history_commits"] else "LIVE"


def exposure(r: dict) -> str:
    """Where a secret can be read, in words."""
    commits = r["history_commits"] or []
    if r["exposure"] != "working_tree":
        return f"in {len(commits)} commits of the history, no longer in the tree" if len(commits) > 1 else f"in commit {r['commit_hash']} of the history, no longer in the tree"
    return f"in the working tree and, from {commits[0]} on, in {len(commits)} commit(s)" if commits else "in the working tree, in no commit"


def terminal(found: DataFrame, color: bool = False) -> Iterator[str]:
    per = counts(found)
    if not sum(per.values()):
        yield NOTHING
        return
    yield "\n".join([f"{sum(per.values())} leaked credential(s)", "  ".join(f"{k}: {v}" for k, v in per.items()), ""])
    for r in rows(found):
        out = [""]
        tag = f"[{r['severity'].upper():8}]"
        tag = f"{COLORS[SEVERITIES.index(r['severity']) + 1]}{tag}\033[0m" if color else tag
        seen = f", x{r['occurrences']}" if r["occurrences"] > 1 else ""
        out += [f"{tag} {r['file_path']}:{r['line_number']}  ({r['detector_type']}, {where(r)}{seen})", f"    {r['redacted']}   {r['redacted_context']}", f"    -> {r['rationale']}", ""]
        if r["remediation_steps"]:
            out += ["    fix:", *[f"      {i}. {s}" for i, s in enumerate(r["remediation_steps"], 1)]]
        yield "\n".join(out)


def json_item(r: Row) -> str:
    return json.dumps(shown(r), indent=2)


def script_json(value: object) -> str:
    """JSON that may stand inside a script element: nothing in it can end the element or start another one."""
    text = json.dumps(value)  # ASCII only
    for c in "<>&":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def json_frame(found: DataFrame) -> Frame:
    return Frame("[", "\n]", ",", json_item, "]", "\n")


def html_item(r: Row) -> str:
    r = shown(r)
    e = {k: html.escape(str(v)) for k, v in r.items() if not isinstance(v, list)}
    steps = "".join(f"<li>{html.escape(s)}</li>" for s in r["remediation_steps"] or [])
    return f"""<article class="{e['severity'].lower()}" data-band="{e['severity']}" data-file="{e['file_path']}" data-entropy="{r['entropy_score'] or 0}" data-points="{e['points']}">
<h2>{e['severity']} &middot; {e['detector_type']}</h2><p><code>{e['file_path']}:{e['line_number']}</code> &middot; {html.escape(exposure(r))} &middot; x{e['occurrences']}</p>
<pre>{e['redacted_context']}</pre><p>{e['rationale']}</p><ol>{steps}</ol><script type="application/json">{script_json(r)}</script></article>"""


def html_frame(found: DataFrame) -> Frame:
    per = counts(found)
    tiles = "".join(f'<button class="tile {k.lower()}" data-band="{k}"><b>{v}</b> {k}</button>' for k, v in per.items())
    head = f"""<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Leaked credentials</title><style>
body{{font:16px system-ui;margin:2rem auto;max-width:60rem}}article{{border-left:.4rem solid #999;padding:.2rem 1rem;margin:1rem 0;background:#f6f6f6}}
article.critical{{border-color:#b00020}}article.high{{border-color:#d9480f}}article.medium{{border-color:#e0a800}}pre{{white-space:pre-wrap}}.off{{display:none}}</style></head><body>
<h1>{sum(per.values())} leaked credential(s)</h1><p>{tiles} <select id="sort"><option value="points">points</option><option value="file">file</option><option value="entropy">entropy</option></select></p>
<main>"""
    # only fixed text stands inside the script: nothing of a finding can end it
    tail = """</main><script>
const main=document.querySelector("main"),cards=[...main.querySelectorAll("article")];
document.querySelectorAll(".tile").forEach(t=>t.onclick=()=>{const on=t.classList.toggle("on");document.querySelectorAll(".tile").forEach(x=>x!==t&&x.classList.remove("on"));cards.forEach(c=>c.classList.toggle("off",on&&c.dataset.band!==t.dataset.band))});
document.querySelector("#sort").onchange=e=>{const k=e.target.value;cards.sort((a,b)=>k==="file"?a.dataset.file.localeCompare(b.dataset.file):b.dataset[k]-a.dataset[k]).forEach(c=>main.append(c))};
</script></body></html>"""
    return Frame(head, tail, "", html_item, f"<p>{NOTHING}</p>" + tail)


#: Of each format that has one row for each finding: its frame, and the ordered rows.
FRAMES = {"json": (json_frame, worst_first), "sarif": (sarif.frame, sarif.ordered), "html": (html_frame, worst_first)}


def report(found: DataFrame, kind: str = "terminal", path: str | None = None, color: bool = False) -> str:
    """The report as text, or, written to a file as its rows come in, an empty text."""
    kind = kind.lower()
    if kind not in (*FRAMES, "terminal", "text", "cli"):
        raise ValueError(f"unknown format {kind!r}")
    chunks = FRAMES[kind][0](found).chunks(FRAMES[kind][1](found).toLocalIterator()) if kind in FRAMES else terminal(found, color)
    if not path:
        return "".join(chunks)
    with open(path, "w", encoding="utf-8") as f:
        for chunk in chunks:
            f.write(chunk)
    return ""
