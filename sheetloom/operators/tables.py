"""Tables from label and data blocks: candidates, assembly, light blocks, similarity, groups, patterns, tree."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import a1
from .annotate import flood, slim
from .by_sheet import by_sheet, connected, numbered, pairs
from .layout import KEY

HEADER_GAP, FOOTER_GAP, LABEL_GAP, OVERLAP = 0, 1, 0, 0.5
LIGHT_DENSITY, LIGHT_DISTANCE = 0.8, 3
SIMILAR = 0.7
STABLE, LEAST_ROWS = 0.8, 4
#: Pairs of structures that are compared at once.
PAIRS = 1 << 19
RECT = ["r1", "c1", "r2", "c2"]
ROLES = ["header", "row_label", "footer"]
STRUCTURES = "wb string, sheet string, structure int, body int, header int, row_label int, footer int, r1 int, c1 int, r2 int, c2 int"
ATTACHED = "wb string, sheet string, block_index int, structure int, role string, distance int"
SIMILARITY = "wb string, sheet string, a int, b int, similarity double"


def candidates(blocks: DataFrame) -> DataFrame:
    """Pairs of a label block and a data block of one sheet, with role header, row_label or footer; a pair can have several."""
    part = lambda p, kind: blocks.where(F.col("annotation") == kind).select(*KEY, *(F.col(c).alias(p + c) for c in ("block_index", "r1", "c1", "r2", "c2")))
    x = part("l_", "label").join(part("d_", "data"), KEY)
    shared = lambda a, b: F.greatest(F.lit(0), F.least(f"l_{b}", f"d_{b}") - F.greatest(f"l_{a}", f"d_{a}") + 1) / (F.col(f"l_{b}") - F.col(f"l_{a}") + 1)
    x = x.withColumn("cols", shared("c1", "c2")).withColumn("rows", shared("r1", "r2"))
    above, left, below = F.col("d_r1") - F.col("l_r2") - 1, F.col("d_c1") - F.col("l_c2") - 1, F.col("l_r1") - F.col("d_r2") - 1
    header = above.between(0, HEADER_GAP) & (F.col("cols") >= OVERLAP)
    label = left.between(0, LABEL_GAP) & (F.col("rows") >= OVERLAP)
    footer = below.between(0, FOOTER_GAP) & (F.col("cols") >= OVERLAP)
    roles = F.array_compact(F.array(F.when(header, "header"), F.when(label, "row_label"), F.when(footer, "footer")))
    return x.withColumn("role", F.explode(roles))


def _chosen(sid: np.ndarray, b: dict[str, np.ndarray], labels: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """For each block the place of its header, row label and footer, or -1: data blocks in order take the first free label block of each role.

    A label's gap to its data block names the row or column where that must begin or end, so candidates meet by equality, not all by all.
    """
    out = {r: np.full(len(sid), -1) for r in ROLES}
    found = []
    for rank, (mine, theirs, gaps, low, high) in enumerate((("r2", "r1", range(HEADER_GAP + 1), "c1", "c2"), ("c2", "c1", range(LABEL_GAP + 1), "r1", "r2"), ("r1", "r2", range(FOOTER_GAP + 1), "c1", "c2"))):
        at = lambda x, c: sid[x] * (1 << 22) + b[c][x]
        d = data[np.argsort(at(data, theirs), kind="stable")]
        for gap in gaps:
            i, j = pairs(at(labels, mine) + (-1 - gap if rank == 2 else 1 + gap), at(d, theirs))
            i, j = labels[i], d[j]
            shared = np.maximum(0, np.minimum(b[high][i], b[high][j]) - np.maximum(b[low][i], b[low][j]) + 1) / (b[high][i] - b[low][i] + 1)
            near = shared >= OVERLAP
            found.append((j[near], np.full(near.sum(), rank), i[near]))
    used = set()
    for j, rank, i in sorted(zip(*(np.concatenate(x).tolist() for x in zip(*found, strict=True)), strict=True)):
        if out[ROLES[rank]][j] < 0 and i not in used:
            used.add(i)
            out[ROLES[rank]][j] = i
    return out


def structures_of(blocks: pd.DataFrame) -> pd.DataFrame:
    """Structures of some sheets' blocks, which are in order; sid numbers the sheet, places (at_) are rows of blocks, -1 where there is none."""
    sid, b = numbered(blocks, KEY), {c: blocks[c].to_numpy().astype(np.int64) for c in RECT}
    labels, body = (np.flatnonzero((blocks["annotation"] == kind).to_numpy()) for kind in ("label", "data"))
    at = _chosen(sid, b, labels, body)
    index = blocks["block_index"].to_numpy()
    out = {"wb": blocks["wb"].to_numpy()[body], "sheet": blocks["sheet"].to_numpy()[body], "structure": index[body], "body": index[body]}
    for r in ROLES:
        of = at[r][body]
        out[r] = pd.array(np.where(of >= 0, index[of], 0), "Int32")
        out[r][of < 0] = pd.NA
        out["at_" + r] = of
    for c, f in (("r1", np.minimum), ("c1", np.minimum), ("r2", np.maximum), ("c2", np.maximum)):
        v = b[c][body]
        for r in ROLES:
            of = at[r][body]
            v = np.where(of >= 0, f(v, b[c][of]), v)
        out[c] = v
    return pd.DataFrame(out | {"sid": sid[body], "at_body": body})


def assemble(blocks: DataFrame) -> DataFrame:
    """One structure for each data block: indices of its blocks by role, and the range of all.  The greedy choice is a fold, so a sheet is one task's work."""
    return by_sheet(blocks.select(*KEY, "block_index", "annotation", *RECT), KEY, structures_of, STRUCTURES, ["block_index"])


def assembled(annotated: DataFrame) -> DataFrame:
    """As assemble of all regions, in one pass over the cells."""
    return by_sheet(slim(annotated), KEY, lambda cells: structures_of(flood(cells)), STRUCTURES, ["row", "col"])


def light(blocks: DataFrame) -> DataFrame:
    """Blocks that fill less than 0.8 of their rectangle and are no declared tables."""
    free = F.col("table_name").isNull() if "table_name" in blocks.columns else F.lit(True)
    return blocks.where((F.col("density") < LIGHT_DENSITY) & free)


def nearest(lights: DataFrame, structures: DataFrame) -> DataFrame:
    """The nearest structure within 3 of each light block, by gaps of rows and columns, ties to the first; with the role that its place gives.  A block's own structure doesn't count."""
    a = lights.select(*KEY, "block_index", *(F.col(c).alias("a" + c) for c in ("r1", "c1", "r2", "c2")))
    b = structures.select(*KEY, "structure", *(F.col(c).alias("b" + c) for c in ("r1", "c1", "r2", "c2")))
    gap = lambda p, q: F.greatest(F.lit(0), F.greatest(F.col(f"a{p}") - F.col(f"b{q}"), F.col(f"b{p}") - F.col(f"a{q}")) - 1)
    x = a.join(b, KEY).where("block_index != structure").withColumn("distance", gap("r1", "r2") + gap("c1", "c2")).where(F.col("distance") <= LIGHT_DISTANCE)
    role = F.when(F.col("ar1") > F.col("br2"), "footer").when(F.col("ar2") < F.col("br1"), "header").when(F.col("ac2") < F.col("bc1"), "row_label").otherwise("footer")
    best = x.withColumn("role", role).groupBy(*KEY, "block_index").agg(F.min(F.struct("distance", "structure", "role")).alias("m"))
    return best.select(*KEY, "block_index", "m.distance", "m.structure", "m.role")


def _attach_one(rows: list[tuple], ids: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
    """Light blocks (wb, sheet, id, range) of a sheet in order; a structure's range grows by what it takes before the next block looks for its nearest.

    ids and place: numbers of structures, sorted, and their ranges.
    """
    s = place.copy()
    for wb, sheet, own, *a in rows:
        d = np.maximum(0, np.maximum(a[0] - s[:, 2], s[:, 0] - a[2]) - 1) + np.maximum(0, np.maximum(a[1] - s[:, 3], s[:, 1] - a[3]) - 1)
        d[ids == own] = LIGHT_DISTANCE + 1
        k = int(d.argmin()) if len(d) else -1
        if k < 0 or d[k] > LIGHT_DISTANCE:
            continue
        b = place[k]
        role = "footer" if a[0] > b[2] else "header" if a[2] < b[0] else "row_label" if a[3] < b[1] else "footer"
        s[k] = min(s[k][0], a[0]), min(s[k][1], a[1]), max(s[k][2], a[2]), max(s[k][3], a[3])
        yield wb, sheet, own, int(ids[k]), role, int(d[k])


def attached_of(lights: pd.DataFrame, structures: pd.DataFrame) -> pd.DataFrame:
    """lights (id) and structures (structure) of some sheets, numbered by sid, each in order."""
    sid, ids, place = structures["sid"].to_numpy(), structures["structure"].to_numpy(), structures[RECT].to_numpy()
    rows = list(zip(lights["wb"], lights["sheet"], lights["id"].tolist(), *(lights[c].tolist() for c in RECT), strict=True))
    new, cuts = np.unique(lights["sid"].to_numpy(), return_index=True)
    low, high = np.searchsorted(sid, new, "left"), np.searchsorted(sid, new, "right")
    out = [x for k, (i, j) in enumerate(zip(low, high, strict=True)) for x in _attach_one(rows[cuts[k] : cuts[k + 1] if k + 1 < len(cuts) else None], ids[i:j], place[i:j])]
    return pd.DataFrame(out, columns=["wb", "sheet", "block_index", "structure", "role", "distance"])


def _attach(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.assign(sid=numbered(pdf, KEY))
    return attached_of(pdf[pdf["what"] == "light"], pdf[pdf["what"] == "structure"].rename(columns={"id": "structure"}))


def attach_light(blocks: DataFrame, structures: DataFrame) -> DataFrame:
    """As nearest, one light block after the other, with growing structures."""
    cols = ["r1", "c1", "r2", "c2"]
    both = light(blocks).select(*KEY, F.lit("light").alias("what"), F.col("block_index").alias("id"), *cols).unionByName(structures.select(*KEY, F.lit("structure").alias("what"), F.col("structure").alias("id"), *cols))
    return by_sheet(both, KEY, _attach, ATTACHED, ["id"])


def attached(annotated: DataFrame) -> DataFrame:
    """As attach_light of all regions and their structures, in one pass over the cells."""

    def f(cells: pd.DataFrame) -> pd.DataFrame:
        blocks = flood(cells)
        lights = blocks[blocks["density"] < LIGHT_DENSITY].rename(columns={"block_index": "id"})
        return attached_of(lights, structures_of(blocks))

    return by_sheet(slim(annotated), KEY, f, ATTACHED, ["row", "col"])


def features(structures: DataFrame, blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Structures with headers (set of header texts) and formula_ratio of the body."""
    part = blocks.select(*KEY, "block_index", F.explode(F.sequence("r1", "r2")).alias("row"), F.col("c1").alias("xc1"), F.col("c2").alias("xc2"))
    c = cells.select(*KEY, "row", "col", "raw", "formula")
    of = lambda role: structures.select(*KEY, "structure", F.col(role).alias("block_index")).join(part, [*KEY, "block_index"]).join(c, [*KEY, "row"]).where(F.col("col").between(F.col("xc1"), F.col("xc2")))
    heads = of("header").where("raw IS NOT NULL").groupBy(*KEY, "structure").agg(F.array_sort(F.collect_set(a1.normal("raw"))).alias("headers"))
    ratio = of("body").groupBy(*KEY, "structure").agg((F.count("formula") / F.count("*")).alias("formula_ratio"))
    out = structures.join(heads, [*KEY, "structure"], "left").join(ratio, [*KEY, "structure"], "left")
    return out.withColumn("headers", F.coalesce("headers", F.array().cast("array<string>"))).withColumn("formula_ratio", F.coalesce("formula_ratio", F.lit(0.0)))


def featured_of(structures: pd.DataFrame, blocks: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
    """structures_of some sheets with headers and formula_ratio; cells (word: the text without white space around, in lower case) are in reading order."""
    line = numbered(cells, KEY) * (1 << 22) + cells["row"].to_numpy()
    col, formula, word = cells["col"].to_numpy(), cells["is_formula"].to_numpy(), cells["word"].to_numpy()
    b = {c: blocks[c].to_numpy() for c in RECT}
    sid = blocks["sid"].to_numpy()

    def within(k: int) -> np.ndarray:
        low, high = np.searchsorted(line, (sid[k] * (1 << 22) + b["r1"][k], sid[k] * (1 << 22) + b["r2"][k] + 1))
        return low + np.flatnonzero((col[low:high] >= b["c1"][k]) & (col[low:high] <= b["c2"][k]))

    body, head = structures["at_body"].to_numpy(), structures["at_header"].to_numpy()
    n, formulas = blocks["cell_count"].to_numpy()[body].astype(float), blocks["formula_count"].to_numpy()[body].astype(float)
    area = (b["r2"] - b["r1"] + 1).astype(np.int64) * (b["c2"] - b["c1"] + 1)
    once = not ((line[1:] == line[:-1]) & (col[1:] == col[:-1])).any()  # then a full rectangle holds no cell of another block
    for k in np.flatnonzero(n != area[body]) if once else range(len(body)):
        there = within(body[k])
        n[k], formulas[k] = len(there), formula[there].sum()
    heads = [frozenset(w for w in word[within(k)] if w is not None) if k >= 0 else frozenset() for k in head.tolist()]
    return structures.assign(headers=heads, formula_ratio=formulas / n)


def similar_of(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """All pairs of structures of a sheet, some at a time; similarity isn't rounded yet."""
    sid, s, r1, c1 = (x[c].to_numpy() for c in ("sid", "structure", "r1", "c1"))
    wide, ratio = (x["c2"] - x["c1"] + 1).to_numpy(), x["formula_ratio"].to_numpy()
    words = list(map(frozenset, x["headers"]))
    named = np.array([len(w) for w in words], int)
    wb, sheet = x["wb"].to_numpy(), x["sheet"].to_numpy()
    left = np.searchsorted(sid, sid, "right") - np.arange(len(sid)) - 1  # later ones of the sheet
    upto, start = np.cumsum(left), 0
    while start < len(sid):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
        n = left[start:end]
        i = np.repeat(np.arange(start, end), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        start = end
        if not len(i):
            continue
        cols = 1 - np.abs(wide[i] - wide[j]) / np.maximum(wide[i], wide[j])
        heads = np.where((named[i] == 0) & (named[j] == 0), 0.5, 0.0)
        for k in np.flatnonzero((named[i] > 0) & (named[j] > 0)).tolist():
            p, q = words[i[k]], words[j[k]]
            heads[k] = len(p & q) / len(p | q)
        align = (r1[i] == r1[j]) * 0.5 + (c1[i] == c1[j]) * 0.5
        formulas = 1 - np.abs(ratio[i] - ratio[j])
        yield pd.DataFrame({"wb": wb[i], "sheet": sheet[i], "a": s[i], "b": s[j], "similarity": 0.3 * cols + 0.3 * heads + 0.2 * align + 0.2 * formulas, "i": i, "j": j})


def similarity(featured: DataFrame) -> DataFrame:
    """Pairs of structures of one sheet (a < b) and how alike they are: columns .3, header words .3, alignment .2, formulas .2."""
    x = featured.select(*KEY, "structure", *RECT, "headers", "formula_ratio")
    return by_sheet(x, KEY, lambda pdf: similar_of(pdf.assign(sid=numbered(pdf, KEY))), SIMILARITY, ["structure"]).withColumn("similarity", F.round("similarity", 6))


def _with_words(annotated: DataFrame) -> DataFrame:
    return slim(annotated, a1.normal("raw").alias("word"))


def _featured(cells: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    blocks = flood(cells)
    return blocks, featured_of(structures_of(blocks), blocks, cells)


def similar(annotated: DataFrame) -> DataFrame:
    """As similarity of all regions' structures, in one pass over the cells."""
    return by_sheet(_with_words(annotated), KEY, lambda cells: similar_of(_featured(cells)[1]), SIMILARITY, ["row", "col"]).withColumn("similarity", F.round("similarity", 6))


GROUPS = "wb string, sheet string, structure int, table_group int"


def groups_of(x: pd.DataFrame, least: float = SIMILAR) -> pd.DataFrame:
    """Featured structures of some sheets that have a group, with it and its first structure's place (at_group)."""
    edges = []
    for p in similar_of(x):
        v = p["similarity"].to_numpy()
        alike = v >= least
        for k in np.flatnonzero(np.abs(v - least) < 1e-6).tolist():  # as if rounded to six digits
            alike[k] = round_half_up(v[k]) >= Decimal(str(least))
        edges.append((p["i"].to_numpy()[alike], p["j"].to_numpy()[alike]))
    i, j = (np.concatenate(e) for e in zip(*edges, strict=True)) if edges else (np.zeros(0, int), np.zeros(0, int))
    root = connected(len(x), i, j)
    some = np.unique(np.concatenate([i, j]))
    out = x.iloc[some]
    return pd.DataFrame({"wb": out["wb"], "sheet": out["sheet"], "structure": out["structure"], "table_group": x["structure"].to_numpy()[root[some]], "at": some})


def round_half_up(v: float) -> Decimal:
    from decimal import ROUND_HALF_UP

    return Decimal(repr(float(v))).quantize(Decimal("0.000001"), ROUND_HALF_UP)


def grouped(annotated: DataFrame, least: float = SIMILAR) -> DataFrame:
    """As groups of all regions' structures, in one pass over the cells."""
    return by_sheet(_with_words(annotated), KEY, lambda cells: groups_of(_featured(cells)[1], least), GROUPS, ["row", "col"])


def _groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest members of the components of pairs a, b of some sheets."""
    sid = numbered(pdf, KEY)
    ends = [sid * (1 << 32) + pdf[c].to_numpy() for c in ("a", "b")]
    node, of = np.unique(np.concatenate(ends), return_inverse=True)
    root = connected(len(node), of[: len(pdf)], of[len(pdf) :])
    first = np.searchsorted(sid, node >> 32)
    return pd.DataFrame({"wb": pdf["wb"].to_numpy()[first], "sheet": pdf["sheet"].to_numpy()[first], "structure": node & 0xFFFFFFFF, "table_group": node[root] & 0xFFFFFFFF})


def groups(pairs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Structures that belong together, by the smallest of their group; those alone have no row."""
    return pairs.where(F.col("similarity") >= least).select(*KEY, "a", "b").transform(lambda x: by_sheet(x, KEY, _groups, GROUPS, ["a", "b"]))


def stability(bodies: DataFrame, cells: DataFrame) -> DataFrame:
    """For bodies (wb, sheet, body, r1, c1, r2) of 4 rows or more: every factor of their height and how stable the first column's labels are with that period."""
    rows = bodies.where(F.col("r2") - F.col("r1") + 1 >= LEAST_ROWS).withColumn("n", F.col("r2") - F.col("r1") + 1)
    lined = rows.withColumn("row", F.explode(F.sequence("r1", "r2")))
    seen = lined.join(cells.select(*KEY, "row", F.col("col").alias("c1"), a1.normal("raw").alias("v")), [*KEY, "row", "c1"], "left").withColumn("v", F.coalesce("v", F.lit("")))
    # a prime height has no factor
    f = seen.withColumn("factor", F.explode(F.filter(F.sequence(F.lit(2), F.col("n") - 1), lambda k: F.pmod(F.col("n"), k) == 0)))
    f = f.withColumn("offset", F.pmod(F.col("row") - F.col("r1"), F.col("factor"))).withColumn("period", F.floor((F.col("row") - F.col("r1")) / F.col("factor")))
    first = F.first("v").over(Window.partitionBy(*KEY, "body", "factor", "offset").orderBy("period"))
    out = f.withColumn("same", (F.col("v") == first).cast("int")).where("period > 0")
    return out.groupBy(*KEY, "body", "factor").agg(F.round(F.avg("same"), 6).alias("stability"))


def pattern_split(bodies: DataFrame, cells: DataFrame) -> DataFrame:
    """Sub-tables of bodies whose most stable factor (the smallest of equals) is stable enough."""
    best = stability(bodies, cells).groupBy(*KEY, "body").agg(F.max(F.struct("stability", (-F.col("factor")).alias("f"))).alias("m")).where(F.col("m.stability") >= STABLE)
    x = bodies.join(best.select(*KEY, "body", (-F.col("m.f")).cast("int").alias("factor")), [*KEY, "body"])
    x = x.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("r2") - F.col("r1") + 1) / F.col("factor")).cast("int") - 1)))
    return x.select(*KEY, "body", "factor", "part", (F.col("r1") + F.col("part") * F.col("factor")).cast("int").alias("r1"), "c1", (F.col("r1") + (F.col("part") + 1) * F.col("factor") - 1).cast("int").alias("r2"), "c2")


def varying_labels(split: DataFrame, cells: DataFrame) -> DataFrame:
    """Places of the first column whose label varies between periods; they become data with confidence 0.5."""
    x = split.withColumn("row", F.explode(F.sequence("r1", "r2"))).withColumn("offset", F.col("row") - F.col("r1"))
    x = x.join(cells.select(*KEY, "row", F.col("col").alias("c1"), a1.normal("raw").alias("v")), [*KEY, "row", "c1"])
    many = x.groupBy(*KEY, "body", "offset").agg(F.countDistinct("v").alias("n")).where("n > 1")
    return x.join(many, [*KEY, "body", "offset"]).select(*KEY, "row", F.col("c1").alias("col"), F.lit("data").alias("annotation"), F.lit(0.5).alias("confidence"))


def tree(blocks: DataFrame, structures: DataFrame, grouped: DataFrame) -> DataFrame:
    """Nodes sheet, group, table, block with parent and depth.  A table node exists where a structure has more than its body."""
    sid = F.concat_ws("|", "wb", "sheet", F.lit("sheet"))
    many = structures.where("header IS NOT NULL OR row_label IS NOT NULL OR footer IS NOT NULL")
    of = many.select(*KEY, "structure", F.explode(F.array_compact(F.array("body", "header", "row_label", "footer"))).alias("block_index"))
    g = grouped.select(*KEY, "structure", "table_group")
    name = lambda kind, c: F.concat_ws("|", "wb", "sheet", F.lit(kind), F.col(c).cast("string"))
    tables = many.select(*KEY, "structure").join(g, [*KEY, "structure"], "left")
    t = tables.select(*KEY, name("table", "structure").alias("node"), F.lit("table").alias("node_type"), F.coalesce(F.when(F.col("table_group").isNotNull(), name("group", "table_group")), sid).alias("parent"), F.when(F.col("table_group").isNull(), 1).otherwise(2).alias("depth"))
    b = blocks.select(*KEY, "block_index").join(of, [*KEY, "block_index"], "left").join(g, [*KEY, "structure"], "left")
    own = b.join(g.select(*KEY, F.col("structure").alias("block_index"), F.col("table_group").alias("own_group")), [*KEY, "block_index"], "left")
    parent = F.when(F.col("structure").isNotNull(), name("table", "structure")).when(F.col("own_group").isNotNull(), name("group", "own_group")).otherwise(sid)
    depth = F.when(F.col("structure").isNotNull(), F.when(F.col("table_group").isNull(), 2).otherwise(3)).when(F.col("own_group").isNotNull(), 2).otherwise(1)
    leaves = own.select(*KEY, name("block", "block_index").alias("node"), F.lit("block").alias("node_type"), parent.alias("parent"), depth.alias("depth"))
    gs = g.select(*KEY, "table_group").distinct().select(*KEY, name("group", "table_group").alias("node"), F.lit("group").alias("node_type"), sid.alias("parent"), F.lit(1).alias("depth"))
    roots = blocks.select(*KEY).distinct().select(*KEY, sid.alias("node"), F.lit("sheet").alias("node_type"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    return roots.unionByName(gs).unionByName(t).unionByName(leaves)


def trees(annotated: DataFrame) -> DataFrame:
    """As tree of all regions, their structures and groups, in one pass over the cells."""
    kinds = ["sheet", "group", "table", "block"]

    def f(cells: pd.DataFrame) -> pd.DataFrame:
        blocks, x = _featured(cells)
        g = groups_of(x)
        group = np.full(len(x), -1)
        group[g["at"].to_numpy()] = g["table_group"].to_numpy()
        of, own = np.full(len(blocks), -1), np.full(len(blocks), -1)  # the structure of a block, and the group of it as a structure
        body = x["at_body"].to_numpy()
        own[body] = group
        many = np.flatnonzero((x[["at_" + r for r in ROLES]] >= 0).any(axis=1).to_numpy())
        of[body[many]] = many
        for r in ROLES:
            at = x["at_" + r].to_numpy()[many]
            of[at[at >= 0]] = many[at >= 0]
        wb, sheet, structure = blocks["wb"].to_numpy(), blocks["sheet"].to_numpy(), x["structure"].to_numpy()
        first = np.unique(blocks["sid"].to_numpy(), return_index=True)[1]
        inner = np.append(group, -1)[of]  # the group of the block's structure
        kept = g.drop_duplicates(["wb", "sheet", "table_group"])
        parts = [
            (wb[first], sheet[first], 0, -1, -1, -1, 0), (kept["wb"].to_numpy(), kept["sheet"].to_numpy(), 1, kept["table_group"].to_numpy(), 0, -1, 1),
            (wb[body[many]], sheet[body[many]], 2, structure[many], np.where(group[many] >= 0, 1, 0), group[many], np.where(group[many] >= 0, 2, 1)),
            (wb, sheet, 3, blocks["block_index"].to_numpy(), np.where(of >= 0, 2, np.where(own >= 0, 1, 0)), np.where(of >= 0, np.append(structure, -1)[of], own), np.where(of >= 0, np.where(inner >= 0, 3, 2), np.where(own >= 0, 2, 1))),
        ]
        return pd.concat([pd.DataFrame(dict(zip(("wb", "sheet", "kind", "id", "up", "up_id", "depth"), p, strict=True))) for p in parts], ignore_index=True)

    out = by_sheet(_with_words(annotated), KEY, f, "wb string, sheet string, kind int, id int, up int, up_id int, depth int", ["row", "col"])
    kind = lambda c: F.element_at(F.array(*map(F.lit, kinds)), F.col(c) + 1)
    name = lambda k, i: F.concat_ws("|", "wb", "sheet", kind(k), F.when(F.col(k) > 0, F.col(i).cast("string")))
    return out.select(*KEY, name("kind", "id").alias("node"), kind("kind").alias("node_type"), F.when(F.col("up") >= 0, name("up", "up_id")).alias("parent"), "depth")
