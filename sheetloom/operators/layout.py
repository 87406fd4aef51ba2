"""Recovering layout from sparse cells: islands, style splits, classification, title merge, bounding boxes.

Every function takes and returns DataFrames and is partitioned by (wb, sheet).  Gaps-and-islands windows replace any walk over a dense grid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import a1
from .by_sheet import by_sheet, numbered

KEY = ["wb", "sheet"]
DENSE, TITLE_ROWS, KEY_CELLS = 0.9, 3, 20
ASSUMPTION = "assumption|input|parameter|scenario"


def used_range(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*KEY).agg(F.min("row").alias("r1"), F.min("col").alias("c1"), F.max("row").alias("r2"), F.max("col").alias("c2"), F.count("*").alias("cells"))


def totals(cells: DataFrame) -> DataFrame:
    """Cells and formulas of sheets and of workbooks (sheet null) in one pass."""
    out = cells.rollup("wb", "sheet").agg(F.count("*").alias("cells"), F.count("formula").alias("formulas"), F.grouping_id().alias("g"))
    return out.where("wb IS NOT NULL").select("wb", "sheet", "cells", "formulas")


def with_gap(cells: DataFrame) -> DataFrame:
    """row_gap: blank rows that separate islands; 2 on sheets that are more than nine tenths full."""
    # in the order of the first window of islands, so that both share a sort
    w = Window.partitionBy(*KEY).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    area = (F.max("row").over(w) - F.min("row").over(w) + 1).cast("double") * (F.max("col").over(w) - F.min("col").over(w) + 1)
    return cells.withColumn("row_gap", F.when(F.count("*").over(w) / area > DENSE, 2).otherwise(1))


def islands(cells: DataFrame) -> DataFrame:
    """row_island and, in each, col_island, both from 0.  The row gap is that of cells if it has one, else of these cells."""
    cells = cells if "row_gap" in cells.columns else with_gap(cells)
    rows = Window.partitionBy(*KEY).orderBy("row")
    far = (F.col("row") - F.lag("row").over(rows) - 1 >= F.col("row_gap")).cast("int")
    out = cells.withColumn("_new", F.coalesce(far, F.lit(0)))
    out = out.withColumn("row_island", F.sum("_new").over(rows.rangeBetween(Window.unboundedPreceding, 0)).cast("int"))
    cols = Window.partitionBy(*KEY, "row_island").orderBy("col")
    out = out.withColumn("_new", F.coalesce((F.col("col") - F.lag("col").over(cols) - 1 >= 1).cast("int"), F.lit(0)))
    return out.withColumn("col_island", F.sum("_new").over(cols.rangeBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def style_split(cells: DataFrame) -> DataFrame:
    """style_part: a component of more than 5 rows is cut where the rows' fills change for at least 3 rows, with 3 rows on either side."""
    comp = [*KEY, "row_island", "col_island"]
    rows = cells.groupBy(*comp, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("fill", F.lit("")).alias("f")))), lambda x: x["f"]), ";").alias("sig"))
    w = Window.partitionBy(*comp).orderBy("row")
    rows = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*comp)))
    cut = (F.col("n") > 5) & (F.col("i") >= 3) & (F.col("i") < F.col("n") - 2) & (F.col("sig") != F.lag("sig").over(w)) & (F.lead("sig", 1).over(w) == F.col("sig")) & (F.lead("sig", 2).over(w) == F.col("sig"))
    rows = rows.withColumn("style_part", F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(w).cast("int"))
    return cells.join(rows.select(*comp, "row", "style_part"), [*comp, "row"])


def outside_tables(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Cells in no declared table: an equi-join on the sheet with the rectangles as condition."""
    t = tables.select("wb", "sheet", "r1", "c1", "r2", "c2").alias("t")
    c = cells.alias("c")
    on = (F.col("c.wb") == F.col("t.wb")) & (F.col("c.sheet") == F.col("t.sheet")) & a1.inside("c.row", "c.col", "t.r1", "t.c1", "t.r2", "t.c2")
    return c.join(t, on, "left_anti")


def table_blocks(cells: DataFrame, tables: DataFrame) -> DataFrame:
    c, t = cells.alias("c"), tables.alias("t")
    on = (F.col("c.wb") == F.col("t.wb")) & (F.col("c.sheet") == F.col("t.sheet")) & a1.inside("c.row", "c.col", "t.r1", "t.c1", "t.r2", "t.c2")
    merged = F.max("c.merged") if "merged" in cells.columns else F.lit(False)
    by = [F.col(f"t.{x}") for x in ("wb", "sheet", "table_name", "r1", "c1", "r2", "c2")]
    return t.join(c, on, "left").groupBy(*by).agg(F.count("c.row").alias("cell_count"), F.count("c.formula").alias("formula_count"), F.coalesce(merged, F.lit(False)).alias("has_merges"))


def _key_cells(keep) -> F.Column:
    """The first 20 in reading order, as A1 texts joined by commas."""
    spots = F.slice(F.array_sort(F.collect_list(F.when(keep, F.struct("row", "col")))), 1, KEY_CELLS)
    return F.array_join(F.transform(spots, lambda x: a1.coord(x["row"], x["col"])), ",")


def components(cells: DataFrame) -> DataFrame:
    """Islands after the style split, classified: the input of the title merge."""
    comp = [*KEY, "row_island", "col_island", "style_part"]
    x = cells.withColumn("top", F.min("row").over(Window.partitionBy(*comp)))
    merged = F.max("merged") if "merged" in cells.columns else F.lit(False)
    bold = F.coalesce(F.col("bold"), F.lit(False))
    out = x.groupBy(*comp).agg(
        F.min("row").alias("r1"), F.min("col").alias("c1"), F.max("row").alias("r2"), F.max("col").alias("c2"),
        F.count("*").alias("cell_count"), F.count("formula").alias("formula_count"), F.coalesce(merged, F.lit(False)).alias("has_merges"),
        F.max(bold | F.col("fill").isNotNull() | F.col("number_format").isNotNull() | F.col("font_size").isNotNull()).alias("has_formatting"),
        F.max(bold & (F.col("row") == F.col("top"))).alias("bold_first"),
        F.max(bold | F.col("fill").isNotNull()).alias("has_key"),
        F.max(F.coalesce((F.col("kind") == "s") & F.lower("raw").rlike(ASSUMPTION), F.lit(False))).alias("keyword"),
        F.min((F.col("kind") == "s") | F.col("raw").isNull()).alias("all_text"),
        _key_cells(bold | F.col("fill").isNotNull()).alias("key_cells"),
    )
    n, f = F.col("cell_count"), F.col("formula_count")
    kind = (
        F.when((F.col("r1") == F.col("r2")) & F.col("bold_first") & (f == 0), "header")
        .when(F.col("keyword") & (f < n * 0.3), "assumptions_table")
        .when((f > n * 0.5) & F.col("has_key") & F.col("bold_first"), "results_block")
        .when(f > n * 0.5, "calculation_block")
        .when(F.col("bold_first") & (n > 3), "table")
        .when(F.col("all_text"), "text_block")
        .otherwise("mixed")
    )
    return out.withColumn("block_type", kind)


_BLOCK = ["table_name", "r1", "c1", "r2", "c2", "cell_count", "formula_count", "has_merges", "has_formatting", "block_type", "key_cells"]


def merge_titles(blocks: DataFrame) -> DataFrame:
    """A left fold over a sheet's blocks in reading order: a small title above a taller block that shares columns is taken into it.

    The fold carries the blocks that are done and the current one, so a block that has grown is judged by its new height.
    """
    fields = F.struct(*_BLOCK)
    listed = blocks.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("r1", "c1", F.when(F.col("table_name").isNull(), 1).otherwise(0).alias("t"), "r2", "c2", fields.alias("b")))).alias("x"))
    kind = listed.schema["x"].dataType.elementType["b"].dataType.simpleString()
    rest = F.transform(F.slice("x", F.lit(2), F.size("x")), lambda y: y["b"])
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.element_at("x", 1)["b"].alias("now"))

    def step(acc, nxt):
        b = acc["now"]
        height = b["r2"] - b["r1"] + 1
        gap = nxt["r1"] - b["r2"] - 1
        title = (height <= TITLE_ROWS) & (b["formula_count"] == 0) & b["table_name"].isNull() & b["block_type"].isin("header", "text_block", "table", "mixed")
        near = gap <= F.when(b["block_type"] == "header", 1).otherwise(0)
        taller = nxt["r2"] - nxt["r1"] + 1 > height
        shared = ~((b["c2"] < nxt["c1"]) | (b["c1"] > nxt["c2"]))
        keys = F.array_join(F.slice(F.filter(F.concat(F.split(b["key_cells"], ","), F.split(nxt["key_cells"], ",")), lambda k: k != ""), 1, KEY_CELLS), ",")
        grown = F.struct(
            nxt["table_name"].alias("table_name"), F.least(b["r1"], nxt["r1"]).alias("r1"), F.least(b["c1"], nxt["c1"]).alias("c1"), F.greatest(b["r2"], nxt["r2"]).alias("r2"),
            F.greatest(b["c2"], nxt["c2"]).alias("c2"), (b["cell_count"] + nxt["cell_count"]).alias("cell_count"), nxt["formula_count"].alias("formula_count"),
            (b["has_merges"] | nxt["has_merges"]).alias("has_merges"), (b["has_formatting"] | nxt["has_formatting"]).alias("has_formatting"), nxt["block_type"].alias("block_type"), keys.alias("key_cells"),
        )
        take = title & near & taller & shared
        return F.when(take, F.struct(acc["done"].alias("done"), grown.cast(kind).alias("now"))).otherwise(F.struct(F.concat(acc["done"], F.array(b)).alias("done"), nxt.alias("now")))

    folded = listed.withColumn("y", F.aggregate(rest, start, step)).select(*KEY, F.posexplode(F.concat("y.done", F.array("y.now"))).alias("block_index", "b"))
    return folded.select(*KEY, "block_index", "b.*")


def raw_blocks(cells: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Declared tables and classified components, before the title merge."""
    gapped = with_gap(cells)
    free = gapped if tables is None else outside_tables(gapped, tables)
    blocks = components(style_split(islands(free))).withColumn("table_name", F.lit(None).cast("string"))
    blocks = blocks.select(*KEY, *_BLOCK)
    if tables is not None:
        t = table_blocks(cells, tables).withColumn("has_formatting", F.lit(True)).withColumn("block_type", F.lit("table")).withColumn("key_cells", F.lit(""))
        blocks = blocks.unionByName(t.select(*KEY, *_BLOCK))
    return blocks


#: What blocks need to know of a cell, a bit each.
FORMULA, FORMATTED, BOLD, MARKED, KEYWORD, MERGED, TEXT, OTHER = (1 << k for k in range(8))
SEGMENTS = (
    "wb string, sheet string, block_index int, table_name string, r1 int, c1 int, r2 int, c2 int, cell_count long, formula_count long, has_merges boolean, "
    "has_formatting boolean, block_type string, key_cells string"
)


def segment_input(cells: DataFrame, tables: DataFrame | None = None, *more) -> DataFrame:
    """Cells (part 1) as segments_of takes them, after the declared tables (part 0) of their sheet; more columns of cells only without tables."""
    bold, text = F.coalesce(F.col("bold"), F.lit(False)), (F.col("kind") == "s") | F.col("raw").isNull()
    flags = {
        FORMULA: F.col("formula").isNotNull(), FORMATTED: bold | F.col("fill").isNotNull() | F.col("number_format").isNotNull() | F.col("font_size").isNotNull(), BOLD: bold,
        MARKED: bold | F.col("fill").isNotNull(), KEYWORD: (F.col("kind") == "s") & F.lower("raw").rlike(ASSUMPTION), TEXT: text, OTHER: ~text,
    }
    if "merged" in cells.columns:
        flags[MERGED] = F.col("merged")
    bits = sum((F.when(v, bit).otherwise(0) for bit, v in flags.items()), F.lit(0))
    x = cells.select(*KEY, F.lit(1).alias("part"), "row", "col", bits.alias("flags"), F.coalesce("fill", F.lit("")).alias("fill"), *(F.lit(0).alias(c) for c in ("r2", "c2")), F.lit(None).cast("string").alias("table_name"), *more)
    if tables is not None:
        x = x.unionByName(tables.select(*KEY, F.lit(0).alias("part"), F.col("r1").alias("row"), F.col("c1").alias("col"), F.lit(0).alias("flags"), F.lit("").alias("fill"), "r2", "c2", "table_name"))
    return x


def _parts(sid: np.ndarray, row: np.ndarray, col: np.ndarray, fill: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Order of cells by component after the style split, row and column; where in it the components begin; and their row_island, col_island and style_part.  Cells are in reading order; gap: blank rows between islands, by sheet."""
    first = np.zeros(len(sid), bool)
    first[0] = True
    first[1:] = (sid[1:] != sid[:-1]) | (row[1:] - row[:-1] - 1 >= gap[sid[1:]])
    island = np.cumsum(first)
    across = np.lexsort((col, island))
    new = np.ones(len(sid), bool)
    new[1:] = (island[across][1:] != island[across][:-1]) | (np.diff(col[across]) > 1)
    comp = np.empty(len(sid), int)
    comp[across] = np.cumsum(new)
    order = np.argsort(comp, kind="stable")
    comp, row, fill = comp[order], row[order], fill[order]
    new[1:] = (comp[1:] != comp[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)  # of a component's rows
    of, size = comp[start], np.diff(np.append(start, len(sid)))
    alike = np.zeros(len(start), bool)  # has the fills of the component's row before
    alike[1:] = (of[1:] == of[:-1]) & (size[1:] == size[:-1])
    at = np.arange(len(sid))
    back = np.where(np.repeat(alike, size), at - np.repeat(size, size), at)
    alike &= np.logical_and.reduceat(fill == fill[back], start)
    low, high = np.searchsorted(of, of, "left"), np.searchsorted(of, of, "right")
    i, n = np.arange(len(start)) - low, high - low
    next_ = lambda k: np.append(alike, [False] * k)[k:]
    cut = (n > 5) & (i >= 3) & (i < n - 2) & ~alike & next_(1) & next_(2)
    start = start[cut | (i == 0)]
    within = lambda ids, of: ids - ids[np.searchsorted(of, of, "left")]
    comp, island = comp[start], island[order][start]
    return order, start, {"row_island": within(island, sid[order][start]), "col_island": within(comp, island), "style_part": within(np.arange(len(start)), comp)}


def raw_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """As raw_blocks of some sheets of segment_input, in reading order; sid numbers the sheet."""
    every = numbered(pdf, KEY)
    is_cell = (pdf["part"] == 1).to_numpy()
    spot, declared, sid, tid = pdf[is_cell], pdf[~is_cell], every[is_cell], every[~is_cell]
    wb, sheet = pdf["wb"].to_numpy(), pdf["sheet"].to_numpy()
    row, col, flags = (spot[c].to_numpy().astype(np.int64) for c in ("row", "col", "flags"))
    here = np.unique(every, return_index=True)[1]
    known = {"sid": [], "table_name": [], "r1": [], "c1": [], "r2": [], "c2": [], "cell_count": [], "formula_count": [], "flags": [], "block_type": [], "key_cells": []}
    free = np.ones(len(spot), bool)
    line = sid * (1 << 22) + row
    for s, r1, c1, r2, c2, name in zip(tid.tolist(), *(declared[c].tolist() for c in ("row", "col", "r2", "c2", "table_name")), strict=True):
        low, high = np.searchsorted(line, (s * (1 << 22) + r1, s * (1 << 22) + r2 + 1))
        there = low + np.flatnonzero((col[low:high] >= c1) & (col[low:high] <= c2))
        free[there] = False
        marks = int(np.bitwise_or.reduce(flags[there])) & MERGED if len(there) else 0
        for k, v in zip(known, (s, name, r1, c1, r2, c2, len(there), int((flags[there] & FORMULA).sum()), marks | FORMATTED, "table", ""), strict=True):
            known[k].append(v)
    parts = [pd.DataFrame(known)] if known["sid"] else []
    if free.any():
        n = np.bincount(sid, minlength=len(here))
        some = np.flatnonzero(n)
        begin = np.searchsorted(sid, some)
        span = lambda v: np.maximum.reduceat(v, begin) - np.minimum.reduceat(v, begin) + 1
        gap = np.ones(len(here), int)
        gap[some] = np.where(n[some] / (span(row).astype(float) * span(col)) > DENSE, 2, 1)
        sid, row, col, flags = sid[free], row[free], col[free], flags[free]
        order, start, numbers = _parts(sid, row, col, pd.factorize(spot["fill"].to_numpy()[free])[0], gap)
        sid, row, col, flags = sid[order], row[order], col[order], flags[order]
        end = np.append(start[1:], len(sid))
        of = np.repeat(np.arange(len(start)), end - start)
        top = row[start]
        first_bold = np.bitwise_or.reduceat(np.where(row == top[of], flags & BOLD, 0), start) > 0
        marks, n, f = np.bitwise_or.reduceat(flags, start), end - start, np.add.reduceat(flags & FORMULA, start)
        marked = np.flatnonzero(flags & MARKED)
        rank = np.arange(len(marked)) - np.searchsorted(of[marked], of[marked], "left")
        marked = marked[rank < KEY_CELLS]
        keys: list[list[str]] = [[] for _ in start]
        for k, r, c in zip(of[marked].tolist(), row[marked].tolist(), col[marked].tolist(), strict=True):
            keys[k].append(f"{a1.letters_of(c)}{r}")
        kind = np.select(
            [(row[end - 1] == top) & first_bold & (f == 0), (marks & KEYWORD > 0) & (f < n * 0.3), (f > n * 0.5) & (marks & MARKED > 0) & first_bold, f > n * 0.5, first_bold & (n > 3), (marks & TEXT > 0) & (marks & OTHER == 0)],
            ["header", "assumptions_table", "results_block", "calculation_block", "table", "text_block"], "mixed",
        ).astype(object)
        parts.append(pd.DataFrame({"sid": sid[start], "table_name": None, "r1": top, "c1": np.minimum.reduceat(col, start), "r2": row[end - 1], "c2": np.maximum.reduceat(col, start), "cell_count": n, "formula_count": f, "flags": marks, "block_type": kind, "key_cells": list(map(",".join, keys)), "bold_first": first_bold} | numbers))
    out = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
    if len(parts) > 1:
        out = out.assign(loose=out["table_name"].isna(), named=out["table_name"].fillna("")).sort_values(["sid", "r1", "c1", "loose", "r2", "c2", "named"], kind="stable", ignore_index=True)
    else:
        out = out.iloc[np.lexsort([out[c].to_numpy() for c in ("c2", "r2", "c1", "r1", "sid")])].reset_index(drop=True)
    at = here[out["sid"].to_numpy()]
    return out.assign(wb=wb[at], sheet=sheet[at])


COMPONENTS = (
    "wb string, sheet string, row_island int, col_island int, style_part int, r1 int, c1 int, r2 int, c2 int, cell_count long, formula_count long, has_merges boolean, "
    "has_formatting boolean, bold_first boolean, has_key boolean, keyword boolean, all_text boolean, key_cells string, block_type string"
)


def classified(cells: DataFrame) -> DataFrame:
    """As components of the islands after the style split, in one pass over sorted sheets."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        x = raw_of(pdf)
        has = lambda bit: (x["flags"] & bit) > 0
        return x.assign(has_merges=has(MERGED), has_formatting=has(FORMATTED), has_key=has(MARKED), keyword=has(KEYWORD), all_text=has(TEXT) & ~has(OTHER))

    return by_sheet(segment_input(cells), KEY, f, COMPONENTS, ["part", "row", "col"])


def merged_of(x: pd.DataFrame) -> pd.DataFrame:
    """As merge_titles of raw_of: the fold over each sheet's blocks."""
    names = ["sid", "r1", "c1", "r2", "c2", "cell_count", "formula_count", "flags", "block_type", "key_cells", "table_name"]
    values = {c: x[c].tolist() for c in names}
    loose = x["table_name"].isna().tolist()
    s, r1, c1, r2, c2, n, formulas, flags, kind, keys, _ = values.values()
    gone = np.zeros(len(x), bool)
    for k in range(len(x) - 1):
        m = k + 1
        height = r2[k] - r1[k] + 1
        if height > TITLE_ROWS or s[k] != s[m] or formulas[k] or not loose[k] or r2[m] - r1[m] + 1 <= height or c2[k] < c1[m] or c1[k] > c2[m] or kind[k] not in ("header", "text_block", "table", "mixed"):
            continue
        if r1[m] - r2[k] - 1 <= (kind[k] == "header"):
            gone[k] = True
            r1[m], c1[m], r2[m], c2[m], n[m] = min(r1[k], r1[m]), min(c1[k], c1[m]), max(r2[k], r2[m]), max(c2[k], c2[m]), n[k] + n[m]
            flags[m] |= flags[k] & (MERGED | FORMATTED)
            keys[m] = ",".join([t for t in f"{keys[k]},{keys[m]}".split(",") if t][:KEY_CELLS])
    out = x.assign(**values)[~gone]
    sid = out["sid"].to_numpy()
    return out.assign(block_index=np.arange(len(out)) - np.searchsorted(sid, sid, "left"), has_merges=(out["flags"] & MERGED) > 0, has_formatting=(out["flags"] & FORMATTED) > 0)


def segments_of(pdf: pd.DataFrame) -> pd.DataFrame:
    return merged_of(raw_of(pdf))


def segment(cells: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Blocks of every sheet in reading order: as merge_titles of raw_blocks, in one pass over sorted sheets."""
    return by_sheet(segment_input(cells, tables), KEY, segments_of, SEGMENTS, ["part", "row", "col"])


def absorbed(cells: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """How many blocks of a sheet the title merge takes into others, where it does."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        x = raw_of(pdf)
        kept = merged_of(x)["sid"].to_numpy()
        sid, at, n = np.unique(x["sid"].to_numpy(), return_index=True, return_counts=True)
        n = n - np.bincount(kept, minlength=sid[-1] + 1)[sid]
        return pd.DataFrame({"wb": x["wb"].to_numpy()[at], "sheet": x["sheet"].to_numpy()[at], "absorbed": n})[n > 0]

    return by_sheet(segment_input(cells, tables), KEY, f, "wb string, sheet string, absorbed long", ["part", "row", "col"])


def merge_flags(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells with merged, is_master, is_slave, row_span, col_span: rectangles are expanded to places and joined by equality."""
    spots = merges.withColumn("row", F.explode(F.sequence("r1", "r2"))).withColumn("col", F.explode(F.sequence("c1", "c2")))
    spots = spots.select(*KEY, "row", "col", ((F.col("row") == F.col("r1")) & (F.col("col") == F.col("c1"))).alias("is_master"), (F.col("r2") - F.col("r1") + 1).alias("row_span"), (F.col("c2") - F.col("c1") + 1).alias("col_span"))
    out = cells.join(spots, [*KEY, "row", "col"], "left").withColumn("merged", F.col("is_master").isNotNull())
    master = F.coalesce("is_master", F.lit(False))
    return out.withColumn("is_slave", F.col("merged") & ~master).withColumn("is_master", master).withColumn("row_span", F.when(master, F.col("row_span"))).withColumn("col_span", F.when(master, F.col("col_span")))


def recover_masters(cells: DataFrame, merges: DataFrame, values: DataFrame) -> DataFrame:
    """Empty masters of merges take the first value in the rectangle in reading order, the master's own place last."""
    spots = merges.withColumn("row", F.explode(F.sequence("r1", "r2"))).withColumn("col", F.explode(F.sequence("c1", "c2")))
    there = spots.join(values.where("raw IS NOT NULL").select(*KEY, "row", "col", "raw"), [*KEY, "row", "col"])
    own = (F.col("row") == F.col("r1")) & (F.col("col") == F.col("c1"))
    found = there.groupBy(*KEY, F.col("r1").alias("row"), F.col("c1").alias("col")).agg(F.min_by("raw", F.struct(own, "row", "col")).alias("recovered"))
    return cells.join(found, [*KEY, "row", "col"], "left").withColumn("raw", F.coalesce("raw", F.when(F.col("formula").isNull(), F.col("recovered")))).drop("recovered")


def bounding_boxes(blocks: DataFrame, sizes: DataFrame | None = None, height: float = 15.0, width: float = 8.43 * 7.5) -> DataFrame:
    """x, y, w, h in points: defaults times counts, plus what sized rows and columns (wb, sheet, axis row or col, at, points) differ."""
    out = blocks
    plain = {"y": (F.col("r1") - 1) * height, "h": (F.col("r2") - F.col("r1") + 1) * height, "x": (F.col("c1") - 1) * width, "w": (F.col("c2") - F.col("c1") + 1) * width}
    if sizes is None:
        return out.select("*", *(v.alias(k) for k, v in plain.items()))
    s = sizes.withColumn("more", F.col("points") - F.when(F.col("axis") == "row", height).otherwise(width))
    s = s.groupBy("wb", "sheet").agg(F.collect_list(F.struct("axis", "at", "more")).alias("s"))
    out = out.join(s, KEY, "left")

    def extra(axis, low, high):
        inside = F.filter(F.coalesce("s", F.array().cast("array<struct<axis:string,at:int,more:double>>")), lambda x: (x["axis"] == axis) & (x["at"] >= low) & (x["at"] <= high))
        return F.aggregate(inside, F.lit(0.0), lambda acc, x: acc + x["more"])

    more = {"y": extra("row", F.lit(1), F.col("r1") - 1), "h": extra("row", F.col("r1"), F.col("r2")), "x": extra("col", F.lit(1), F.col("c1") - 1), "w": extra("col", F.col("c1"), F.col("c2"))}
    return out.select(*blocks.columns, *((plain[k] + more[k]).alias(k) for k in plain))
