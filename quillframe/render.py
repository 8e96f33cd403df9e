"""Results as text: plain, boxed, CSV or a Markdown table."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Sequence

#: Cells of the plain and boxed forms are cut to this many characters.
CELL = 30

Rows = Sequence[Sequence[str]]
Renderer = Callable[[Sequence[str], Rows], str]


def clip(text: str) -> str:
    return text if len(text) <= CELL else text[: CELL - 1] + "…"


def simple(headers: Sequence[str], rows: Rows) -> str:
    """Columns two spaces apart. A tab ends a cell and a line break a row, as in any tabbed text."""
    table = [list(headers), ["-" * len(h.encode()) for h in headers], *([clip(c) for c in r] for r in rows)]
    lines = [line.split("\t") for row in table for line in "\t".join(row).split("\n")]
    out: list[str] = []
    at = 0
    # A column reaches over the lines in a row that have a cell after it; each run has its own width.
    widths: dict[tuple[int, int], int] = {}
    for column in range(max((len(x) for x in lines), default=0)):
        at = 0
        while at < len(lines):
            end = at
            while end < len(lines) and len(lines[end]) > column + 1:
                end += 1
            width = max((len(lines[i][column]) for i in range(at, end)), default=0) + 2
            for i in range(at, end):
                widths[i, column] = width
            at = max(end, at + 1)
    for i, cells in enumerate(lines):
        out.append("".join(c.ljust(widths[i, j]) for j, c in enumerate(cells[:-1])) + cells[-1])
    return "".join(line + "\n" for line in out)


def full(headers: Sequence[str], rows: Rows) -> str:
    """A box around every cell."""
    cells = [[clip(c) for c in r][: len(headers)] for r in rows]
    widths = [max([len(h), *(len(r[i]) for r in cells if i < len(r))]) for i, h in enumerate(headers)]

    def rule(left: str, middle: str, right: str) -> str:
        return left + middle.join("─" * (w + 2) for w in widths) + right

    def line(row: Sequence[str]) -> str:
        padded = [*row, *[""] * (len(widths) - len(row))]
        return "│" + "".join(f" {c.ljust(w)} │" for c, w in zip(padded, widths))

    lines = [rule("┌", "┬", "┐"), line(headers), rule("├", "┼", "┤"), *map(line, cells), rule("└", "┴", "┘")]
    return "\n".join(lines) + "\n"


def comma_separated(headers: Sequence[str], rows: Rows) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(headers)
    writer.writerows(rows)
    return out.getvalue()


def markdown(headers: Sequence[str], rows: Rows) -> str:
    lines = [headers, ["---"] * len(headers), *rows]
    return "".join("| " + " | ".join(c.replace("|", r"\|") for c in row) + " |\n" for row in lines)


RENDERERS: dict[str, Renderer] = {"": simple, "simple": simple, "full": full, "csv": comma_separated, "markdown": markdown, "md": markdown}


def renderer(name: str) -> Renderer:
    if name not in RENDERERS:
        raise ValueError(f"unknown format {name!r}: must be simple, csv, markdown, or full")
    return RENDERERS[name]


def footer(count: int, hidden: int = 0, mutation: bool = False) -> str:
    out = "" if mutation else "(1 row)\n" if count == 1 else f"({count} rows)\n"
    return out + (f"({hidden} more column(s) hidden; raise --max-columns to show)\n" if hidden else "")
