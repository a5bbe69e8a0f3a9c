"""Small results as text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any


def table(rows: Iterable[Sequence[Any]], head: Sequence[str]) -> str:
    """Aligned columns, numbers to the right; `(none)` without rows."""
    cells = [[f"{c:.4f}" if isinstance(c, float) else "" if c is None else str(c) for c in r] for r in rows]
    if not cells:
        return "(none)"
    number = [all(isinstance(r[k], (int, float)) for r in rows) for k in range(len(head))] if isinstance(rows, list) else [False] * len(head)
    wide = [max(len(h), *(len(r[k]) for r in cells)) for k, h in enumerate(head)]
    line = lambda r: "  ".join(c.rjust(w) if n else c.ljust(w) for c, w, n in zip(r, wide, number)).rstrip()
    return "\n".join([line(head), *map(line, cells)])


def sweep_table(rows: list, by: Sequence[str]) -> str:
    """Settings of a sweep in the order given."""
    head = [*by, "n_clusters", "noise_fraction", "largest_cluster_fraction", "top_cluster_sizes"]
    return table([[r[c] if c != "top_cluster_sizes" else ",".join(map(str, r[c])) for c in head] for r in rows], head)


def clusters(rows: list, texts: str = "exemplar_sentences") -> str:
    """Clusters with their sizes and sentences, one a line."""
    if not rows:
        return "(no clusters)"
    wide = max(len(str(r["cluster_id"])) for r in rows), max(len(str(r["size"])) for r in rows)
    out = []
    for r in rows:
        said = list(r[texts]) or [""]
        out.append(f"{r['cluster_id']:>{wide[0]}}  {r['size']:>{wide[1]}}  {said[0]}")
        out += [" " * (sum(wide) + 4) + s for s in said[1:]]
    return "\n".join(out)


def sweep_exemplars(rows: list, by: Sequence[str]) -> str:
    """Typical sentences of the largest clusters of each expanded setting."""
    out: list[str] = []
    shown = None
    for r in sorted(rows, key=lambda r: ([r[c] for c in by], -r["size"], r["cluster_id"], r["rank"])):
        if (setting := ", ".join(f"{c}={r[c]}" for c in by)) != shown:
            out.append(setting)
            shown = setting
        head = f"{r['cluster_id']} ({r['size']})" if r["rank"] == 1 else ""
        out.append(f"  {head:<14}{r['sentence']}")
    return "\n".join(out) or "(no settings expanded)"
