"""The dependency graph of formulas: typed edges, bounded traversal, cycles, summaries of blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import a1, refs
from .by_sheet import by_sheet, numbered, pairs
from .layout import KEY


def edges(cells: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row for each distinct reference of each formula cell.  names (wb, name): with it, other words that are defined names become edges, too."""
    f = cells.where("formula IS NOT NULL").select(*KEY, "row", "col", "formula")
    out = f.withColumn("ref", F.explode(refs.references("formula")))
    book = F.regexp_extract("ref", r"^\[([^\]]+)\]", 1)
    table = ~F.col("ref").contains("!") & F.col("ref").endswith("]")
    sheet = F.regexp_extract("ref", r"^(?:\[[^\]]+\])?(?:'([^']+)'|([A-Za-z0-9_]+))!", 1)
    bare = F.regexp_extract("ref", r"^(?:\[[^\]]+\])?(?:'([^']+)'|([A-Za-z0-9_]+))!", 2)
    out = out.withColumn("book", F.when(book != "", book)).withColumn("table_name", F.when(table & (book == ""), F.substring_index("ref", "[", 1)))
    out = out.withColumn("target_sheet", F.when(F.col("table_name").isNull() & (F.concat(sheet, bare) != ""), F.concat(sheet, bare)))
    body = F.regexp_replace(F.col("ref"), r"^(?:\[[^\]]+\])?(?:(?:'[^']+'|[A-Za-z0-9_]+)!)?", "")
    out = out.withColumn("at", F.when(F.col("table_name").isNull(), a1.parse(F.regexp_replace(body, r":(?:'[^']+'|[A-Za-z0-9_]+)!", ":")))).drop("formula")
    ranged = F.col("table_name").isNull() & body.contains(":")
    kind = (
        F.when(F.col("book").isNotNull(), "external").when(F.col("table_name").isNotNull(), "structured_ref")
        .when(F.col("target_sheet") != F.col("sheet"), "cross_sheet").when(ranged, "cell_to_range").otherwise("cell_to_cell")
    )
    out = out.select(*KEY, "row", "col", "ref", "target_sheet", "book", "table_name", "at.*", ranged.alias("is_range"), kind.alias("edge_type"))
    if names is not None:
        words = f.withColumn("ref", F.explode(F.array_distinct(F.regexp_extract_all("formula", F.lit(r"\b[A-Za-z_][A-Za-z0-9_.]+\b"), F.lit(0)))))
        named = words.join(names.select("wb", F.col("name").alias("ref")).distinct(), ["wb", "ref"])
        blank = [F.lit(None).cast(t).alias(c) for c, t in (("target_sheet", "string"), ("book", "string"), ("table_name", "string"), ("r1", "int"), ("c1", "int"), ("r2", "int"), ("c2", "int"))]
        out = out.unionByName(named.select(*KEY, "row", "col", "ref", *blank, F.lit(False).alias("is_range"), F.lit("named_range").alias("edge_type")))
    return out


def hops(edges: DataFrame) -> DataFrame:
    """Edges between single cells of one workbook: (wb, sheet, row, col) -> (wb, to_sheet, to_row, to_col)."""
    e = edges.where(_SINGLE)
    return e.select(*KEY, "row", "col", F.coalesce("target_sheet", "sheet").alias("to_sheet"), F.col("r1").alias("to_row"), F.col("c1").alias("to_col"), "ref", "edge_type").distinct()


_SINGLE = "book IS NULL AND table_name IS NULL AND NOT is_range AND r1 IS NOT NULL"


def _slim(edges: DataFrame) -> DataFrame:
    """Edges with the cell that they point at, if it is one of the workbook, as _keyed takes them; to_row is 0 if not."""
    return edges.select(*KEY, "row", "col", "ref", "edge_type", F.coalesce("target_sheet", "sheet").alias("to_sheet"), *(F.when(F.expr(_SINGLE), F.col(c)).otherwise(0).alias(n) for c, n in (("r1", "to_row"), ("c1", "to_col"))))


def _keyed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A number for each edge's cell and the cell that it points at (-1 if none): workbook and sheet, 21 bits of row, 15 of column."""
    code, sheets = pd.factorize(np.concatenate([pdf["sheet"].to_numpy(), pdf["to_sheet"].to_numpy()]))
    book = numbered(pdf, ["wb"]) * len(sheets)
    key = lambda c, row, col: (book + c) << 36 | pdf[row].to_numpy().astype(np.int64) << 15 | pdf[col].to_numpy().astype(np.int64)
    return key(code[: len(pdf)], "row", "col"), np.where(pdf["to_row"].to_numpy() > 0, key(code[len(pdf) :], "to_row", "to_col"), -1)


def _above(src: np.ndarray, dst: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all steps from 1 to depth: an edge of the start, the edge that is reached from it, and the step."""
    order = np.argsort(src, kind="stable")
    by_src = src[order]
    hop = np.flatnonzero(dst >= 0)
    hop = hop[np.unique(np.stack([src[hop], dst[hop]]), axis=1, return_index=True)[1]] if len(hop) else hop
    of = np.unique(src, return_index=True)[1]  # an edge of each start
    at, out = src[of], []
    hop = hop[np.argsort(src[hop], kind="stable")]
    for step in range(1, depth + 1):
        i, j = pairs(at, by_src)
        out.append((of[i], order[j], np.full(len(i), step)))
        i, j = pairs(at, src[hop])
        of, at = of[i], dst[hop][j]
        if len(of):
            of, at = np.unique(np.stack([of, at]), axis=1)
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _texts(c) -> tuple[np.ndarray, int]:
    code, known = pd.factorize(c.to_numpy())
    return code, len(known)


def upstream(edges: DataFrame, depth: int = 2) -> DataFrame:
    """Edges within depth steps above each formula cell: start cell, ref, edge_type and the least step; breadth first, over some workbooks at once."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        start, edge, step = _above(*_keyed(pdf), depth)
        (ref, n), (kind, m) = _texts(pdf["ref"]), _texts(pdf["edge_type"])
        least = np.unique((start * n + ref[edge]) * m + kind[edge], return_index=True)[1]  # steps come in order
        start, edge, step = start[least], edge[least], step[least]
        own, there = pdf[[*KEY, "row", "col"]].iloc[start].reset_index(drop=True), pdf[["ref", "edge_type"]].iloc[edge].reset_index(drop=True)
        return own.assign(ref=there["ref"], edge_type=there["edge_type"], step=step)

    return by_sheet(_slim(edges), ["wb"], f, "wb string, sheet string, row int, col int, ref string, edge_type string, step int", ["sheet", "row", "col"])


def downstream(edges: DataFrame, depth: int = 1) -> DataFrame:
    """Cells within depth steps below each cell that a formula points at: (wb, sheet, row, col), user cell, least step."""
    h = hops(edges).select("wb", F.col("to_sheet").alias("sheet"), F.col("to_row").alias("row"), F.col("to_col").alias("col"), F.col("sheet").alias("user_sheet"), F.col("row").alias("user_row"), F.col("col").alias("user_col")).distinct()
    out, front = h.withColumn("step", F.lit(1)), h
    for step in range(2, depth + 1):
        nxt = h.select("wb", *(F.col(c).alias("user_" + c) for c in ("sheet", "row", "col")), *(F.col("user_" + c).alias("next_" + c) for c in ("sheet", "row", "col")))
        front = front.join(nxt, ["wb", "user_sheet", "user_row", "user_col"]).select(*KEY, "row", "col", *(F.col("next_" + c).alias("user_" + c) for c in ("sheet", "row", "col"))).distinct()
        out = out.unionByName(front.withColumn("step", F.lit(step)))
    return out.groupBy(*KEY, "row", "col", "user_sheet", "user_row", "user_col").agg(F.min("step").alias("step"))


def _cycles(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes of strongly connected components of two or more, or with a loop; Tarjan's algorithm without recursion, over some workbooks."""
    a = list(zip(pdf["wb"], pdf["sheet"], pdf["row"].tolist(), pdf["col"].tolist(), strict=True))
    b = list(zip(pdf["wb"], pdf["to_sheet"], pdf["to_row"].tolist(), pdf["to_col"].tolist(), strict=True))
    following: dict[tuple, list[tuple]] = {}
    for x, y in zip(a, b, strict=True):
        following.setdefault(x, []).append(y)
    index: dict[tuple, int] = {}
    low: dict[tuple, int] = {}
    stack, on, out = [], set(), []
    for root in following:
        if root in index:
            continue
        work = [(root, iter(following[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for y in rest:
                if y not in index:
                    index[y] = low[y] = len(index)
                    stack.append(y)
                    on.add(y)
                    work.append((y, iter(following.get(y, ()))))
                    break
                if y in on:
                    low[node] = min(low[node], index[y])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        part.append(x)
                        if x == node:
                            break
                    if len(part) > 1 or node in following.get(node, ()):
                        out += part
    return pd.DataFrame(sorted(out), columns=["wb", "sheet", "row", "col"])


def cycles(edges: DataFrame) -> DataFrame:
    """Cells in circular references."""
    h = hops(edges).select(*KEY, "row", "col", "to_sheet", "to_row", "to_col").distinct()
    return by_sheet(h, ["wb"], _cycles, "wb string, sheet string, row int, col int", [*h.columns[1:]])


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.where("book IS NULL AND NOT is_range AND r1 IS NOT NULL").groupBy("wb", F.coalesce("target_sheet", "sheet").alias("sheet"), F.col("r1").alias("row"), F.col("c1").alias("col")).agg(F.count("*").alias("in_degree"))


def _looped(pdf: pd.DataFrame, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Numbers of cells in cycles.  Edges from or to nothing are dropped some times before the search."""
    left = np.flatnonzero(dst >= 0)
    for _ in range(16):
        kept = left[np.isin(dst[left], src[left]) & np.isin(src[left], dst[left])]
        if len(kept) == len(left):
            break
        left = kept
    if not len(left):
        return np.zeros(0, np.int64)
    loops = set(zip(*(_cycles(pdf.iloc[left])[c].tolist() for c in (*KEY, "row", "col")), strict=True))
    there = [k for k, p in zip(left.tolist(), zip(*(pdf[c].to_numpy()[left].tolist() for c in (*KEY, "row", "col")), strict=True), strict=True) if p in loops]
    return np.unique(src[there])


def summary(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each block: references of its formulas up to two steps above (50 of them), users one step below (50), cross-sheet references (20), whether it has a cell in a cycle.  Sorted texts joined by commas."""
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    zero = lambda *c: [F.lit(0).alias(x) for x in c]
    e = _slim(edges).select(*KEY, F.lit(1).alias("part"), "row", "col", "ref", "edge_type", "to_sheet", "to_row", "to_col", *zero("r2", "c2", "block_index"))
    b = blocks.select(*KEY, F.lit(0).alias("part"), F.col("r1").alias("row"), F.col("c1").alias("col"), null("ref", "string"), null("edge_type", "string"), F.col("sheet").alias("to_sheet"), *zero("to_row", "to_col"), "r2", "c2", "block_index")
    return by_sheet(e.unionByName(b), ["wb"], _summary, "wb string, sheet string, block_index int, upstream string, downstream string, cross_sheet string, has_circular boolean", ["part", "sheet", "row", "col"])


def _summary(pdf: pd.DataFrame) -> pd.DataFrame:
    key, to = _keyed(pdf)
    is_edge = (pdf["part"] == 1).to_numpy()
    b, e = pdf[~is_edge].reset_index(drop=True), pdf[is_edge].reset_index(drop=True)
    src, dst = key[is_edge], to[is_edge]
    place, height = key[~is_edge], (b["r2"] - b["row"] + 1).to_numpy()
    c1, c2 = b["col"].to_numpy(), b["c2"].to_numpy()
    block = np.repeat(np.arange(len(b)), height)
    line = np.repeat(place >> 15, height) + np.arange(len(block)) - np.repeat(np.cumsum(height) - height, height)
    order = np.argsort(line, kind="stable")
    block, line = block[order], line[order]

    def inside(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places i of cells and the blocks that hold them."""
        i, j = pairs(cell >> 15, line)
        col = cell[i] & 0x7FFF
        held = (col >= c1[block[j]]) & (col <= c2[block[j]])
        return i[held], block[j[held]]

    def listed(of: np.ndarray, code: np.ndarray, texts: np.ndarray, most: int) -> list[str]:
        """The first texts, sorted, of each block."""
        out: list[list[str]] = [[] for _ in range(len(b))]
        both = np.unique(of * max(len(texts), 1) + code)
        for k, t in zip((both // max(len(texts), 1)).tolist(), texts[both % max(len(texts), 1)].tolist(), strict=True):
            out[k].append(t)
        return [",".join(sorted(x)[:most]) for x in out]

    up = down = cross = [""] * len(b)
    circular = np.zeros(len(b), bool)
    if len(e):
        cell = np.unique(src)
        i, of = inside(cell)
        start, edge, _ = _above(src, dst, 2)
        ref, refs_ = pd.factorize(e["ref"].to_numpy())
        r, k = pairs(src[start], cell[i])  # cells are sorted, and so are those inside blocks
        code = ref[edge][r]
        up = listed(of[k], code, np.asarray(refs_, object), 50)
        other = (e["edge_type"] == "cross_sheet").to_numpy()[edge][r]
        cross = listed(of[k][other], code[other], np.asarray(refs_, object), 20)
        users = np.flatnonzero(dst >= 0)
        u, k = pairs(dst[users], cell[i])
        user, first = np.unique(src[users][u], return_inverse=True)
        at = e.iloc[np.unique(src, return_index=True)[1][np.searchsorted(cell, user)]]
        names = [f"{s}!{a1.letters_of(c)}{r}" for s, r, c in zip(at["sheet"], at["row"].tolist(), at["col"].tolist(), strict=True)]
        down = listed(of[k], first, np.asarray(names, object), 50)
        circular[inside(_looped(e, src, dst))[1]] = True
    return pd.DataFrame({"wb": b["wb"], "sheet": b["sheet"], "block_index": b["block_index"], "upstream": up, "downstream": down, "cross_sheet": cross, "has_circular": circular})
