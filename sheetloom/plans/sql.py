"""DuckDB SQL of the grid queries: named common table expressions, put together as each query needs them."""

from __future__ import annotations

import re


def letters(n: str) -> str:
    digit = lambda x: f"chr((65 + ({x}) % 26)::INT)"
    return f"(CASE WHEN {n} > 702 THEN {digit(f'(({n}) - 27) // 676 - 1')} ELSE '' END || CASE WHEN {n} > 26 THEN {digit(f'(({n}) - 1) // 26 - 1')} ELSE '' END || {digit(f'({n}) - 1')})"


def coord(row: str, col: str) -> str:
    return f"({letters(col)} || ({row})::VARCHAR)"


def rect(p: str = "") -> str:
    a, b = coord(f"{p}r1", f"{p}c1"), coord(f"{p}r2", f"{p}c2")
    return f"(CASE WHEN {p}r1 = {p}r2 AND {p}c1 = {p}c2 THEN {a} ELSE {a} || ':' || {b} END)"


def _cell(row: str, col: int, kind: str, raw="NULL", num="NULL", formula="NULL", bold="false", fill="NULL", size="NULL", fmt="NULL") -> str:
    return f"({row})::INT AS row, {col}::INT AS col, {kind!r} AS kind, ({raw})::VARCHAR AS raw, ({num})::DOUBLE AS num, ({formula})::VARCHAR AS formula, {bold} AS bold, ({fill})::VARCHAR AS fill, ({size})::DOUBLE AS font_size, ({fmt})::VARCHAR AS number_format"


_FILL = "CASE o_orderstatus WHEN 'F' THEN 'FFC7CE' WHEN 'O' THEN 'C6EFCE' END"
_MONEY = "'$#,##0.00'"
_ORDERS = [
    _cell("row", 1, "i", "o_orderkey", "o_orderkey", fill=_FILL),
    _cell("row", 2, "s", "o_orderstatus", fill=_FILL),
    _cell("row", 3, "f", "printf('%.2f', o_totalprice)", "round(o_totalprice, 2)", fill=_FILL, fmt="'#,##0.00'"),
    _cell("row", 4, "s", "strftime(o_orderdate, '%Y-%m-%d')", fill=_FILL),
    _cell("row", 5, "s", "o_orderpriority", fill=_FILL),
    _cell("row", 7, "n", formula="'C' || row || '*summary!B4'", fmt=_MONEY),
    _cell("row", 8, "n", formula="CASE WHEN first THEN 'C' || row ELSE 'H' || (row - 1) || '+C' || row END", bold="last", fmt=_MONEY),
]
_HEAD = [_cell("1", k, "s", f"'{t}'", bold="true") for k, t in ((1, "order id"), (2, "status"), (3, "price"), (4, "date"), (5, "priority"), (7, "tax"), (8, "total"))]
_ABOUT = [
    *(_cell(str(k), 1, "s", f"'{t}'", bold="true") for k, t in ((1, "customer name"), (2, "account balance"), (3, "orders total"), (4, "tax rate assumption"), (5, "exchange rate"), (6, "segment"))),
    _cell("1", 2, "s", "c_name", size="14"),
    _cell("2", 2, "f", "printf('%.2f', bal)", "bal", fmt=_MONEY),
    _cell("3", 2, "n", formula="'SUM(orders!C2:C' || last_row || ')'", bold="true", fmt=_MONEY),
    _cell("4", 2, "f", "'0.1'", "0.1", fmt="'0.0%'"),
    _cell("5", 2, "n", formula="'[rates.xlsx]Daily!B2+SUM(Sales[price])'"),
    _cell("6", 2, "s", "c_mktsegment"),
]
_LOOP = [_cell("1", 4, "n", formula="'D2+1'"), _cell("2", 4, "n", formula="'E2'"), _cell("2", 5, "n", formula="'D1'"), _cell("3", 4, "n", formula="'D3'")]

CTE: dict[str, str] = {}


def _define(name: str, body: str) -> None:
    CTE[name] = body.strip()


_define("orow", """
SELECT *, (1 + rn + 2 * run)::INT AS row FROM (
  SELECT *, coalesce(sum(nw) OVER w, 0)::INT AS run, coalesce(nw, 1) = 1 AS first, coalesce(lead(nw) OVER w, 1) = 1 AS last FROM (
    SELECT *, row_number() OVER w AS rn, (o_orderstatus != lag(o_orderstatus) OVER w)::INT AS nw FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))""")
_define("per", "SELECT o_custkey, max(row) AS last_row FROM orow GROUP BY o_custkey")
_define("who", "SELECT o_custkey, last_row, c_name, round(c_acctbal, 2) AS bal, c_mktsegment FROM per JOIN customer ON c_custkey = o_custkey")
_define("cells", " UNION ALL ".join(
    [f"SELECT 'c' || o_custkey AS wb, 'orders' AS sheet, {c} FROM orow" for c in _ORDERS]
    + [f"SELECT 'c' || o_custkey, 'orders', {c} FROM per" for c in _HEAD]
    + [f"SELECT 'c' || o_custkey, 'summary', {c} FROM who" for c in _ABOUT]
    + [f"SELECT 'c' || o_custkey, 'summary', {c} FROM who WHERE bal < 0" for c in _LOOP]
    + [f"SELECT 'c' || o_custkey, 'summary', {_cell('1', 4, 'n', formula=repr('B2*2'))} FROM who WHERE bal >= 0"]))
_define("merges", "SELECT 'c' || o_custkey AS wb, 'orders' AS sheet, min(row) AS r1, 2 AS c1, max(row) AS r2, 2 AS c2 FROM orow GROUP BY o_custkey, run HAVING count(*) > 1")
_define("tables", "SELECT 'c' || o_custkey AS wb, 'orders' AS sheet, 'done' || run AS table_name, min(row) AS r1, 1 AS c1, max(row) AS r2, 5 AS c2 FROM orow WHERE o_orderstatus = 'F' GROUP BY o_custkey, run")
_define("used", "SELECT wb, sheet, min(row) AS r1, min(col) AS c1, max(row) AS r2, max(col) AS c2, count(*) AS cells FROM cells GROUP BY ALL")
_define("gapped", """
SELECT c.*, CASE WHEN u.cells / ((u.r2 - u.r1 + 1)::DOUBLE * (u.c2 - u.c1 + 1)) > 0.9 THEN 2 ELSE 1 END AS row_gap FROM cells c JOIN used u USING (wb, sheet)""")
_ISLANDS = """
SELECT *, sum(nc) OVER (PARTITION BY wb, sheet, row_island ORDER BY col RANGE UNBOUNDED PRECEDING)::INT AS col_island FROM (
  SELECT *, coalesce((col - lag(col) OVER (PARTITION BY wb, sheet, row_island ORDER BY col) > 1)::INT, 0) AS nc FROM (
    SELECT *, sum(nr) OVER (PARTITION BY wb, sheet ORDER BY row RANGE UNBOUNDED PRECEDING)::INT AS row_island FROM (
      SELECT *, coalesce((row - lag(row) OVER (PARTITION BY wb, sheet ORDER BY row) - 1 >= row_gap)::INT, 0) AS nr FROM {0})))"""
_define("isl", _ISLANDS.format("gapped"))
_define("free", "SELECT * FROM gapped g WHERE NOT EXISTS (SELECT 1 FROM tables t WHERE t.wb = g.wb AND t.sheet = g.sheet AND g.row BETWEEN t.r1 AND t.r2 AND g.col BETWEEN t.c1 AND t.c2)")
_define("fisl", _ISLANDS.format("free"))
_STYLE = """
SELECT i.*, p.style_part FROM {0} i JOIN (
  SELECT wb, sheet, row_island, col_island, row, sum(cut::INT) OVER w::INT AS style_part FROM (
    SELECT *, coalesce(n > 5 AND i >= 3 AND i < n - 2 AND sig != lag(sig) OVER w AND lead(sig) OVER w = sig AND lead(sig, 2) OVER w = sig, false) AS cut FROM (
      SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY wb, sheet, row_island, col_island) AS n FROM (
        SELECT wb, sheet, row_island, col_island, row, string_agg(coalesce(fill, ''), ';' ORDER BY col) AS sig FROM {0} GROUP BY ALL)
      WINDOW w AS (PARTITION BY wb, sheet, row_island, col_island ORDER BY row))
    WINDOW w AS (PARTITION BY wb, sheet, row_island, col_island ORDER BY row))
  WINDOW w AS (PARTITION BY wb, sheet, row_island, col_island ORDER BY row)) p USING (wb, sheet, row_island, col_island, row)"""
_define("styled", _STYLE.format("isl"))
_define("fstyled", _STYLE.format("fisl"))
_CLASSES = """
SELECT *, CASE WHEN r1 = r2 AND bold_first AND formula_count = 0 THEN 'header' WHEN keyword AND formula_count < cell_count * 0.3 THEN 'assumptions_table'
  WHEN formula_count > cell_count * 0.5 AND has_key AND bold_first THEN 'results_block' WHEN formula_count > cell_count * 0.5 THEN 'calculation_block'
  WHEN bold_first AND cell_count > 3 THEN 'table' WHEN all_text THEN 'text_block' ELSE 'mixed' END AS block_type FROM (
  SELECT wb, sheet, row_island, col_island, style_part, min(row) AS r1, min(col) AS c1, max(row) AS r2, max(col) AS c2, count(*) AS cell_count, count(formula) AS formula_count,
    false AS has_merges, bool_or(bold OR fill IS NOT NULL OR number_format IS NOT NULL OR font_size IS NOT NULL) AS has_formatting, bool_or(bold AND row = top) AS bold_first,
    bool_or(bold OR fill IS NOT NULL) AS has_key, bool_or(coalesce(kind = 's' AND regexp_matches(lower(raw), 'assumption|input|parameter|scenario'), false)) AS keyword,
    bool_and(kind = 's' OR raw IS NULL) AS all_text,
    coalesce(array_to_string(list_transform(list_sort(list(struct_pack(r := row, c := col)) FILTER (WHERE bold OR fill IS NOT NULL))[1:20], lambda x: {1}), ','), '') AS key_cells
  FROM (SELECT *, min(row) OVER (PARTITION BY wb, sheet, row_island, col_island, style_part) AS top FROM {0}) GROUP BY ALL)"""
_define("comps", _CLASSES.format("styled", coord("x.r", "x.c")))
_define("fcomps", _CLASSES.format("fstyled", coord("x.r", "x.c")))
_define("tstats", """
SELECT t.wb, t.sheet, t.table_name, t.r1, t.c1, t.r2, t.c2, count(c.row) AS cell_count, count(c.formula) AS formula_count
FROM tables t LEFT JOIN cells c ON c.wb = t.wb AND c.sheet = t.sheet AND c.row BETWEEN t.r1 AND t.r2 AND c.col BETWEEN t.c1 AND t.c2 GROUP BY ALL""")
_BLOCK = "table_name, r1, c1, r2, c2, cell_count, formula_count, has_formatting, block_type, key_cells"
_define("rawb", f"""
SELECT *, row_number() OVER (PARTITION BY wb, sheet ORDER BY r1, c1, table_name IS NULL, r2, c2) AS i FROM (
  SELECT wb, sheet, NULL::VARCHAR AS table_name, r1, c1, r2, c2, cell_count, formula_count, has_formatting, block_type, key_cells FROM fcomps
  UNION ALL SELECT wb, sheet, table_name, r1, c1, r2, c2, cell_count, formula_count, true, 'table', '' FROM tstats)""")
_TAKE = """f.r2 - f.r1 + 1 <= 3 AND f.formula_count = 0 AND f.table_name IS NULL AND f.block_type IN ('header', 'text_block', 'table', 'mixed')
  AND n.r1 - f.r2 - 1 <= CASE WHEN f.block_type = 'header' THEN 1 ELSE 0 END AND n.r2 - n.r1 > f.r2 - f.r1 AND NOT (f.c2 < n.c1 OR f.c1 > n.c2)"""
_define("fold", f"""
SELECT wb, sheet, i, {_BLOCK}, false AS took FROM rawb WHERE i = 1
UNION ALL
SELECT n.wb, n.sheet, n.i, n.table_name, CASE WHEN t THEN least(f.r1, n.r1) ELSE n.r1 END, CASE WHEN t THEN least(f.c1, n.c1) ELSE n.c1 END, CASE WHEN t THEN greatest(f.r2, n.r2) ELSE n.r2 END,
  CASE WHEN t THEN greatest(f.c2, n.c2) ELSE n.c2 END, CASE WHEN t THEN f.cell_count + n.cell_count ELSE n.cell_count END, n.formula_count, CASE WHEN t THEN f.has_formatting OR n.has_formatting ELSE n.has_formatting END,
  n.block_type, CASE WHEN t THEN array_to_string(list_filter(string_split(f.key_cells || ',' || n.key_cells, ','), lambda k: k != '')[1:20], ',') ELSE n.key_cells END, t
FROM (SELECT f AS f, n AS n, ({_TAKE}) AS t FROM fold f JOIN rawb n ON n.wb = f.wb AND n.sheet = f.sheet AND n.i = f.i + 1)""")
_define("blocks", f"""
SELECT wb, sheet, (row_number() OVER (PARTITION BY wb, sheet ORDER BY i) - 1)::INT AS block_index, {_BLOCK} FROM (
  SELECT *, lead(took) OVER (PARTITION BY wb, sheet ORDER BY i) AS gone FROM fold) WHERE gone IS NOT true""")

_KEYWORDS = "amount|assumption|average|balance|category|cost|count|date|description|fy|gross|header|id|index|input|key|label|margin|max|min|month|name|net|parameter|period|price|profit|q1|q2|q3|q4|quantity|quarter|rate|revenue|scenario|subtotal|sum|tax|title|total|type|year"
_define("scored", f"""
SELECT c.*, (bold::INT * 0.25 + coalesce(kind = 's' AND regexp_matches(lower(raw), '{_KEYWORDS}'), false)::INT * 0.2 + 0 * 0.15
  + (CASE WHEN raw IS NULL THEN 0.5 WHEN kind = 's' AND length(trim(raw)) <= 50 THEN 0.7 WHEN kind = 's' THEN 0.4 WHEN kind = 'b' THEN 0.3 WHEN kind IN ('i', 'f') THEN 0.1 ELSE 0.3 END) * 0.15
  + ((CASE WHEN (row - u.r1)::DOUBLE / (u.r2 - u.r1 + 1) < 0.1 THEN 0.8 WHEN (row - u.r1)::DOUBLE / (u.r2 - u.r1 + 1) > 0.9 THEN 0.6 ELSE 0.3 END)
     + (CASE WHEN (col - u.c1)::DOUBLE / (u.c2 - u.c1 + 1) < 0.1 THEN 0.7 ELSE 0.3 END)) / 2 * 0.1
  + (CASE WHEN formula IS NULL THEN 0.5 ELSE 0 END) * 0.05) / 0.9 AS base0, round(base0, 9) AS base FROM cells c JOIN used u USING (wb, sheet)""")
_define("ann", """
SELECT s.*, CASE WHEN final >= 0.5 THEN 'label' ELSE 'data' END AS annotation, round(abs(final - 0.5) * 2, 4) AS confidence FROM (
  SELECT s.wb, s.sheet, s.row, s.col, any_value(s.raw) AS raw, any_value(s.kind) AS kind, any_value(s.formula) AS formula, any_value(s.bold) AS bold, any_value(s.base) AS base,
    round(any_value(s.base) * 0.9 + coalesce(avg((n.base >= 0.5)::INT), 0.5) * 0.1, 9) AS final
  FROM scored s LEFT JOIN scored n ON n.wb = s.wb AND n.sheet = s.sheet AND ((abs(n.row - s.row) = 1 AND n.col = s.col) OR (abs(n.col - s.col) = 1 AND n.row = s.row))
  GROUP BY s.wb, s.sheet, s.row, s.col) s""")


def build(select: str, recursive: bool = False, **extra: str) -> str:
    """A query with the expressions that it (or they) name, in their order of definition."""
    known = CTE | extra
    need: set[str] = set()

    def walk(text: str) -> None:
        for name in known:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                walk(known[name])

    walk(select)
    parts = ", ".join(f"{n} AS ({known[n]})" for n in known if n in need)
    if not parts:
        return select
    return f"WITH {'RECURSIVE ' if 'fold' in need or recursive else ''}{parts} {select}"

# names of later chains must be known before build is used, so they are defined on import
_define("reach", """
SELECT wb, sheet, row, col, annotation, row AS row0, col AS col0 FROM ann
UNION SELECT a.wb, a.sheet, a.row, a.col, a.annotation, r.row0, r.col0 FROM reach r JOIN ann a ON a.wb = r.wb AND a.sheet = r.sheet AND a.annotation = r.annotation
  AND ((a.row = r.row AND a.col BETWEEN r.col - 1 AND r.col + 1) OR (a.col = r.col AND a.row BETWEEN r.row - 1 AND r.row + 1))""")
_define("member", "SELECT wb, sheet, row, col, annotation, min(struct_pack(r := row0, c := col0)) AS reg FROM reach GROUP BY wb, sheet, row, col, annotation")
_define("regions", f"""
SELECT *, (row_number() OVER (PARTITION BY wb, sheet ORDER BY r1, c1, reg_row, reg_col) - 1)::INT AS block_index, round(cell_count / ((r2 - r1 + 1) * (c2 - c1 + 1)), 4) AS density FROM (
  SELECT m.wb, m.sheet, reg.r AS reg_row, reg.c AS reg_col, min(m.row) AS r1, min(m.col) AS c1, max(m.row) AS r2, max(m.col) AS c2, count(*) AS cell_count, any_value(m.annotation) AS annotation,
    count(a.formula) AS formula_count, coalesce(array_to_string(list_transform(list_sort(list(struct_pack(r := m.row, c := m.col)) FILTER (WHERE a.bold))[1:20], lambda x: {coord('x.r', 'x.c')}), ','), '') AS key_cells
  FROM member m JOIN ann a USING (wb, sheet, row, col) GROUP BY m.wb, m.sheet, reg)""")
_define("cand", """
SELECT l.wb, l.sheet, l.block_index AS l_block_index, d.block_index AS d_block_index, unnest(list_filter([
  CASE WHEN d.r1 - l.r2 - 1 = 0 AND cols >= 0.5 THEN 'header' END, CASE WHEN d.c1 - l.c2 - 1 = 0 AND rws >= 0.5 THEN 'row_label' END,
  CASE WHEN l.r1 - d.r2 - 1 BETWEEN 0 AND 1 AND cols >= 0.5 THEN 'footer' END], lambda x: x IS NOT NULL)) AS role
FROM (SELECT l, d, greatest(0, least(l.c2, d.c2) - greatest(l.c1, d.c1) + 1) / (l.c2 - l.c1 + 1)::DOUBLE AS cols, greatest(0, least(l.r2, d.r2) - greatest(l.r1, d.r1) + 1) / (l.r2 - l.r1 + 1)::DOUBLE AS rws
      FROM regions l JOIN regions d ON l.wb = d.wb AND l.sheet = d.sheet AND l.annotation = 'label' AND d.annotation = 'data')""")

_SHEET, _AT = r"(?:''[^'']+''|[A-Za-z0-9_]+)", r"\$?[A-Z]{1,3}\$?[0-9]{1,7}"
_define("frefs", rf"""
SELECT wb, sheet, row, col, unnest(list_distinct(
  regexp_extract_all(formula, '\[[^\]]+\]{_SHEET}!{_AT}(?::{_AT})?') || list_filter(regexp_extract_all(formula, '[A-Za-z_][A-Za-z0-9_.]*\[[^\]]*\]'), lambda x: upper(string_split(x, '[')[1]) NOT IN ('SUM', 'IF', 'INDEX'))
  || list_filter(regexp_extract_all(formula, '\]?(?:{_SHEET}!)?{_AT}(?::(?:{_SHEET}!)?{_AT})?'), lambda x: NOT starts_with(x, ']')))) AS ref FROM cells WHERE formula IS NOT NULL""")
_NUM = "list_reduce(list_prepend(0, list_transform(string_split({0}, ''), lambda x: ascii(x) - 64)), lambda a, x: a * 26 + x)"
_define("edges", r"""
SELECT *, CASE WHEN book IS NOT NULL THEN 'external' WHEN table_name IS NOT NULL THEN 'structured_ref' WHEN target_sheet != sheet THEN 'cross_sheet' WHEN is_range THEN 'cell_to_range' ELSE 'cell_to_cell' END AS edge_type FROM (
  SELECT wb, sheet, row, col, ref, book, table_name, CASE WHEN table_name IS NULL AND instr(body, '!') > 0 THEN string_split(body, '!')[1] END AS target_sheet, table_name IS NULL AND instr(ref, ':') > 0 AS is_range,
    CASE WHEN table_name IS NULL THEN regexp_extract(place, '^[A-Z]+([0-9]+)', 1)::INT END AS r1, CASE WHEN table_name IS NULL THEN """ + _NUM.format("regexp_extract(place, '^([A-Z]+)', 1)") + r"""::INT END AS c1
  FROM (SELECT *, regexp_replace(body, '^.*!', '') AS place FROM (
    SELECT *, nullif(regexp_extract(ref, '^\[([^\]]+)\]', 1), '') AS book, CASE WHEN ref LIKE '%]' THEN string_split(ref, '[')[1] END AS table_name, regexp_replace(ref, '^\[[^\]]+\]', '') AS body FROM frefs)))""")
_define("hops", "SELECT DISTINCT wb, sheet, row, col, coalesce(target_sheet, sheet) AS to_sheet, r1 AS to_row, c1 AS to_col FROM edges WHERE book IS NULL AND table_name IS NULL AND NOT is_range")
_define("up2", """
SELECT wb, sheet, row, col, ref, edge_type, min(step)::INT AS step FROM (
  SELECT wb, sheet, row, col, ref, edge_type, 1 AS step FROM edges
  UNION ALL SELECT h.wb, h.sheet, h.row, h.col, e.ref, e.edge_type, 2 FROM hops h JOIN edges e ON e.wb = h.wb AND e.sheet = h.to_sheet AND e.row = h.to_row AND e.col = h.to_col) GROUP BY ALL""")
_define("paths", """
SELECT wb, sheet, row, col, to_sheet, to_row, to_col FROM hops
UNION SELECT p.wb, p.sheet, p.row, p.col, h.to_sheet, h.to_row, h.to_col FROM paths p JOIN hops h ON h.wb = p.wb AND h.sheet = p.to_sheet AND h.row = p.to_row AND h.col = p.to_col""")
_define("loops", "SELECT DISTINCT wb, sheet, row, col FROM paths WHERE sheet = to_sheet AND row = to_row AND col = to_col")
_define("degree", "SELECT wb, coalesce(target_sheet, sheet) AS sheet, r1 AS row, c1 AS col, count(*) AS in_degree FROM edges WHERE book IS NULL AND NOT is_range AND r1 IS NOT NULL GROUP BY ALL")
