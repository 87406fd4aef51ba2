"""Blocks as text and HTML.

Each sheet's blocks and cells come sorted to one place, once: a task streams the cells by row, keeps those of the blocks that are open there, and renders a
block when its last row has passed.  A block's places exist only while it is rendered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.a1 import letters_of as letters
from .by_sheet import by_sheet, numbered
from .layout import KEY, segment, segment_input, segments_of

#: Text columns are no wider.  In a block of more places, rows and columns that have no cell at all are left out; no cell is.
WIDEST, MOST_PLACES = 30, 200_000
HEADED = ("table", "assumptions_table")
_BLOCK = ["block_index", "block_type", "r1", "c1", "r2", "c2"]
_CELL = {"row": "int", "col": "int", "shown": "string", "is_formula": "boolean", "num": "double", "bold": "boolean", "fill": "string", "font_size": "double", "is_slave": "boolean", "row_span": "int", "col_span": "int"}


def rect(r1: int, c1: int, r2: int, c2: int) -> str:
    first, last = f"{letters(c1)}{r1}", f"{letters(c2)}{r2}"
    return first if first == last else f"{first}:{last}"


def escape(text: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = text.replace(raw, safe)
    return text


def css(cell: dict) -> str:
    parts = ["font-weight:bold"] if cell["bold"] else []
    if cell["font_size"] is not None:
        parts.append(f"font-size:{cell['font_size']}pt")
    if cell["fill"] is not None and not cell["fill"].startswith(("theme:", "indexed:")):
        parts.append(f"background-color:#{cell['fill']}")
    return ";".join(parts)


class Block:
    """A rectangle and the cells in it, by row and column."""

    def __init__(self, sheet: str, block: dict, hidden_rows: set[int], hidden_cols: set[int]):
        self.sheet, self.rows = sheet, {}
        self.kind, self.r1, self.c1, self.r2, self.c2 = block["block_type"], block["r1"], block["c1"], block["r2"], block["c2"]
        self.index, self.hidden_rows, self.hidden_cols = block["block_index"], hidden_rows, hidden_cols

    def add(self, cell: dict) -> None:
        if self.c1 <= cell["col"] <= self.c2:
            self.rows.setdefault(cell["row"], {})[cell["col"]] = cell

    def places(self) -> tuple[list[int], list[int]]:
        if (self.r2 - self.r1 + 1) * (self.c2 - self.c1 + 1) > MOST_PLACES:
            rows, cols = sorted(self.rows), sorted({c for r in self.rows.values() for c in r})
        else:
            rows, cols = range(self.r1, self.r2 + 1), range(self.c1, self.c2 + 1)
        return [r for r in rows if r not in self.hidden_rows], [c for c in cols if c not in self.hidden_cols]

    def text(self) -> str | None:
        """Formula cells are marked [=]; numbers that the mark makes too wide turn to scientific notation."""
        rows, cols = self.places()
        if not rows or not cols:
            return None
        names = [letters(c) for c in cols]
        at, longest = {c: k for k, c in enumerate(cols)}, [0] * len(cols)
        for r in rows:
            for c, cell in self.rows.get(r, {}).items():
                if c in at:
                    longest[at[c]] = max(longest[at[c]], len(cell["shown"]))
        widths = [min(WIDEST, max(n, len(x))) for n, x in zip(longest, names, strict=True)]
        blank = [" " * w for w in widths]
        empty = "| " + " | ".join(blank) + " |"
        lines = []
        for r in rows:
            if r not in self.rows:
                lines.append(empty)
                continue
            line = list(blank)
            for c, cell in self.rows[r].items():
                if c in at:
                    k, value = at[c], cell["shown"]
                    if cell["is_formula"] and not value.startswith("="):
                        value += " [=]"
                    if len(value) > widths[k] and cell["num"] is not None:
                        value = f"{cell['num']:.6e}"
                    line[k] = value.ljust(widths[k])
            lines.append("| " + " | ".join(line) + " |")
        rule = "|-" + "-|-".join("-" * w for w in widths) + "-|"
        if self.kind in HEADED:
            lines[0] += "\n" + rule
        head = f"[{self.sheet}!{rect(self.r1, self.c1, self.r2, self.c2)}] ({self.kind.replace('_', ' ')})"
        return "\n".join([head, "| " + " | ".join(x.ljust(w) for x, w in zip(names, widths, strict=True)) + " |", rule, *lines])

    def html(self) -> str | None:
        """Places that a merge covers are left out; masters have their spans."""
        rows, cols = self.places()
        names, headed, lines = [letters(c) for c in cols], self.kind in HEADED, []
        for r in rows:
            tag, there, line = "th" if headed and r == self.r1 else "td", self.rows.get(r, {}), ["<tr>"]
            for c, name in zip(cols, names, strict=True):
                cell = there.get(c)
                if cell is None:
                    line.append(f'<{tag} data-ref="{name}{r}"></{tag}>')
                elif not cell["is_slave"]:
                    more = "".join(f' {n}="{cell[x]}"' for n, x in (("rowspan", "row_span"), ("colspan", "col_span")) if cell[x] is not None and cell[x] > 1)
                    style = css(cell)
                    line.append(f'<{tag} data-ref="{name}{r}"{more}' + (f' style="{style}"' if style else "") + f">{escape(cell['shown'])}</{tag}>")
            if len(line) > 1:
                lines.append("\n".join([*line, "</tr>"]))
        if not lines:
            return None
        start = f'<table data-sheet="{escape(self.sheet)}" data-range="{rect(self.r1, self.c1, self.r2, self.c2)}" data-block-type="{self.kind}">'
        if headed:
            lines[0] = f"<thead>\n{lines[0]}\n</thead>"
            if len(lines) > 1:
                lines[1] = "<tbody>\n" + lines[1]
        return "\n".join([start, *lines, "</tbody>\n</table>" if headed and len(lines) > 1 else "</table>"])


_RENDERED = "wb string, sheet string, block_index int, block_type string, r1 int, c1 int, r2 int, c2 int, render_text string, render_html string"


def _in_one_pass(cells: DataFrame, with_text: bool, with_html: bool) -> DataFrame:
    """As rendered, of the blocks that segment finds: whole sheets are segmented and rendered where their cells lie."""
    needed = ["shown", "is_formula", "num"] + (["bold", "fill", "font_size", "is_slave", "row_span", "col_span"] if with_html else [])
    value = F.coalesce(*([F.col("display")] if "display" in cells.columns else []), F.col("raw"), F.lit(""))
    more = {"shown": value, "is_formula": F.col("formula").isNotNull(), "has_num": F.col("num").isNotNull()} | {n: F.col(n) if n in cells.columns else F.lit(None).cast(_CELL[n]) for n in needed[2:]}

    def f(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x = segments_of(pdf)
        line = numbered(pdf, KEY) * (1 << 22) + pdf["row"].to_numpy()
        col, row = pdf["col"].to_numpy(), pdf["row"].tolist()
        cols = col.tolist()
        columns = [pdf["_" + n].astype(object).where(pdf["_" + n].notna(), None).tolist() for n in needed]
        columns[2] = [v if there else None for v, there in zip(pdf["_num"].tolist(), pdf["_has_num"].tolist(), strict=True)]
        sid, c1, c2 = (x[c].to_numpy() for c in ("sid", "c1", "c2"))
        low, high = (np.searchsorted(line, sid * (1 << 22) + x[c].to_numpy() + k) for c, k in (("r1", 0), ("r2", 1)))
        done: list[tuple] = []
        size = 0
        for k, (wb, sheet, *b) in enumerate(zip(x["wb"], x["sheet"], *(x[c].tolist() for c in _BLOCK), strict=True)):
            block = Block(sheet, dict(zip(_BLOCK, b, strict=True)), set(), set())
            there = (low[k] + np.flatnonzero((col[low[k] : high[k]] >= c1[k]) & (col[low[k] : high[k]] <= c2[k]))).tolist()
            for i in there:
                block.rows.setdefault(row[i], {})[cols[i]] = {n: c[i] for n, c in zip(needed, columns, strict=True)}
            text, html = block.text() if with_text else None, block.html() if with_html else None
            done.append((wb, sheet, *b, text, html))
            size += len(text or "") + len(html or "")
            if size > 1 << 23:
                yield pd.DataFrame(done, columns=[*KEY, *_BLOCK, "render_text", "render_html"])
                done, size = [], 0
        if done:
            yield pd.DataFrame(done, columns=[*KEY, *_BLOCK, "render_text", "render_html"])

    return by_sheet(segment_input(cells, None, *(v.alias("_" + n) for n, v in more.items())), KEY, f, _RENDERED, ["row", "col"])


def rendered(blocks: DataFrame | None, cells: DataFrame, hidden: DataFrame | None = None, with_text: bool = True, with_html: bool = True) -> DataFrame:
    """wb, sheet, block_index, block_type, r1, c1, r2, c2, render_text, render_html; null where nothing of a block is visible.

    hidden: wb, sheet, hidden_rows, hidden_cols.  Without blocks, those that segment finds are rendered, in the same pass.
    """
    if blocks is None:
        if hidden is None:
            return _in_one_pass(cells, with_text, with_html)
        blocks = segment(cells)
    null = lambda kind: F.lit(None).cast(kind)
    ints = {"r1": "int", "c1": "int", "r2": "int", "c2": "int", "block_index": "int"}
    names = [*KEY, "part", *_BLOCK, "hidden_rows", "hidden_cols", *_CELL]
    kinds = {"part": "int", "block_type": "string", "hidden_rows": "array<int>", "hidden_cols": "array<int>"} | ints | _CELL
    shaped = lambda df, part: df.withColumn("part", F.lit(part)).select(*KEY, *((F.col(n) if n in df.columns or n == "part" else null(kinds[n])).cast(kinds[n]).alias(n) for n in names[2:]))
    value = F.coalesce(*([F.col("display")] if "display" in cells.columns else []), F.col("raw"), F.lit(""))
    slim = cells.withColumn("shown", value).withColumn("is_formula", F.col("formula").isNotNull())
    x = shaped(blocks.select(*KEY, *_BLOCK), 1).unionByName(shaped(slim.select(*KEY, *(n for n in _CELL if n in slim.columns)), 2))
    if hidden is not None:
        x = x.unionByName(shaped(hidden.select(*KEY, "hidden_rows", "hidden_cols"), 0))
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that little data isn't rendered by few tasks
    x = x.withColumn("top", F.coalesce("r1", "row", F.lit(0))).repartition(parts, *KEY).sortWithinPartitions(*KEY, "part", "top", "block_index", "col").drop("top")
    out_names = [*KEY, *_BLOCK, "render_text", "render_html"]
    out_types = [pa.string(), pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.string()]

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, waiting, open_, hidden_rows, hidden_cols, done, size = None, [], [], set(), set(), [], 0

        def close(ready: list[Block]) -> None:
            nonlocal size
            for b in ready:
                text, html = b.text() if with_text else None, b.html() if with_html else None
                size += len(text or "") + len(html or "")
                done.append((*now, b.index, b.kind, b.r1, b.c1, b.r2, b.c2, text, html))
                b.rows = {}

        def flush() -> pa.RecordBatch:
            nonlocal size
            columns = [*zip(*done, strict=True)] or [()] * len(out_names)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out_types, strict=True)], out_names)
            done.clear()
            size = 0
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = batch.to_pydict()
            cell_columns = [(n, columns[n]) for n in _CELL]
            for k, (wb, sheet, part) in enumerate(zip(columns["wb"], columns["sheet"], columns["part"], strict=True)):
                if (wb, sheet) != now:
                    if now is not None:
                        close([*open_, *waiting])
                    now, waiting, open_, hidden_rows, hidden_cols = (wb, sheet), [], [], set(), set()
                if part == 0:
                    hidden_rows |= set(columns["hidden_rows"][k] or [])
                    hidden_cols |= set(columns["hidden_cols"][k] or [])
                elif part == 1:
                    waiting.append(Block(sheet, {n: columns[n][k] for n in _BLOCK}, hidden_rows, hidden_cols))
                else:
                    row = columns["row"][k]
                    if open_ and min(b.r2 for b in open_) < row:
                        close([b for b in open_ if b.r2 < row])
                        open_ = [b for b in open_ if b.r2 >= row]
                    while waiting and waiting[0].r1 <= row:
                        open_.append(waiting.pop(0))
                    if open_:
                        cell = {n: c[k] for n, c in cell_columns}
                        for b in open_:
                            if b.r1 <= row <= b.r2:
                                b.add(cell)
                if size > 1 << 23:
                    yield flush()
        if now is not None:
            close([*open_, *waiting])
        if done:
            yield flush()

    return x.mapInArrow(run, _RENDERED)


def text(blocks: DataFrame | None, cells: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """wb, sheet, block_index, render_text."""
    return rendered(blocks, cells, hidden, with_html=False).where("render_text IS NOT NULL").select(*KEY, "block_index", "render_text")


def html(blocks: DataFrame | None, cells: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """wb, sheet, block_index, render_html."""
    return rendered(blocks, cells, hidden, with_text=False).where("render_html IS NOT NULL").select(*KEY, "block_index", "render_html")
