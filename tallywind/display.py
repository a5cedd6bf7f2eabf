"""Small tables as text."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

LONG = 10


def cell(v: Any) -> str:
    if v is None:
        return "NA"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return "%.6g" % v
    return str(v)


def grid(names: Sequence[str], rows: Sequence[Sequence[Any]], right: Sequence[bool], markdown: bool = False) -> str:
    """Aligned columns; numbers to the right."""
    texts = [[cell(v) for v in r] for r in rows]
    width = [max([len(n), 3 * markdown, *(len(r[i]) for r in texts)]) for i, n in enumerate(names)]
    line = lambda r: [t.rjust(w) if a else t.ljust(w) for t, w, a in zip(r, width, right)]
    if markdown:
        rule = ["-" * (w - 1) + ":" if a else "-" * w for w, a in zip(width, right)]
        return "\n".join("| " + " | ".join(r) + " |" for r in [line(names), rule, *map(line, texts)])
    return "\n".join("  ".join(line(r)).rstrip() for r in [list(names), *texts])
