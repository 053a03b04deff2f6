"""Run reports as JSON, Markdown and self-contained HTML, and a tracker that writes JSON lines."""

from __future__ import annotations

import html
import json
import re
from pathlib import Path

from ..errors import InputError


def save_report(report: dict, path: str, overwrite: bool = False) -> None:
    p = Path(path)
    if p.exists() and not overwrite:
        raise InputError(f"{path} exists")
    p.write_text(json.dumps(report, indent=1, default=str, sort_keys=True))


def sections(report: dict) -> list[tuple[str, list[list]]]:
    """Titles and tables, the first row of each being its head."""
    board = [["rank", "model", "score", "in band"]] + [[r["rank"], r["model_id"], f"{r['score']:.6g}", "yes" if r["in_band"] else "no"] for r in report["leaderboard"]]
    head = [["key", "value"]] + [[k, report.get(k)] for k in ("task", "metric", "winner", "holdout_score", "significance", "run_fingerprint")]
    out = [("Run", head), ("Leaderboard", board)]
    if report.get("failed"):
        out.append(("Failed", [["model", "reason"]] + [[f["model_id"], f["reason"]] for f in report["failed"]]))
    if report.get("feature_selection"):
        out.append(("Features kept", [["feature"]] + [[f] for f in report["feature_selection"]["kept"]]))
    if report.get("ensemble"):
        out.append(("Ensemble", [["key", "value"]] + [[k, v] for k, v in report["ensemble"].items()]))
    out.append(("Seconds", [["stage", "seconds"]] + [[k, v] for k, v in report["timings"].items()]))
    return out


def render(report: dict, form: str = "md") -> str:
    """Cells are escaped; the HTML needs nothing else."""
    if form == "md":
        cell = lambda x: re.sub(r"([|\\`*_<>\[\]])", r"\\\1", str(x)).replace("\n", " ")
        parts = []
        for title, (head, *rows) in sections(report):
            parts.append(f"## {title}\n\n| " + " | ".join(map(cell, head)) + " |\n|" + "-|" * len(head) + "\n" + "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in rows))
        return "# Run report\n\n" + "\n\n".join(parts) + "\n"
    if form != "html":
        raise InputError(f"form {form!r} is neither md nor html")
    row = lambda r, tag: "<tr>" + "".join(f"<{tag}>{html.escape(str(x))}</{tag}>" for x in r) + "</tr>"
    body = "".join(f"<h2>{html.escape(t)}</h2><table>{row(head, 'th')}{''.join(row(r, 'td') for r in rows)}</table>" for t, (head, *rows) in sections(report))
    return f"<!doctype html><meta charset=utf-8><title>Run report</title><style>td,th{{padding:2px 8px;border:1px solid #ccc}}</style><h1>Run report</h1>{body}"


def flatten(d: dict, prefix: str = "") -> dict:
    """Nested keys joined by dots, other characters than letters, digits and ._- replaced."""
    out = {}
    for k, v in d.items():
        key = re.sub(r"[^\w.\-]", "_", f"{prefix}{k}")
        out |= flatten(v, f"{key}.") if isinstance(v, dict) else {key: v}
    return out


class JsonLinesTracker:
    """One line a run: parameters, metrics and tags."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)

    def log_run(self, report: dict) -> None:
        metrics = {f"score.{r['model_id']}": r["score"] for r in report["leaderboard"]} | ({"holdout_score": report["holdout_score"]} if report["holdout_score"] is not None else {})
        line = {"params": flatten(report["config"]), "metrics": metrics, "tags": {"winner": report["winner"], "task": report["task"], "fingerprint": report["run_fingerprint"]}}
        with self.path.open("a") as f:
            f.write(json.dumps(line, default=str) + "\n")
