"""Canonical tables as DDL.  Keys: wb (workbook), sheet; cells are sparse, ranges are closed rectangles, both counted from 1."""

CELLS = (
    "wb string, sheet string, row int, col int, kind string, raw string, num double, formula string, bold boolean, fill string, "
    "font_size double, number_format string"
)
MERGES = "wb string, sheet string, r1 int, c1 int, r2 int, c2 int"
TABLES = "wb string, sheet string, table_name string, r1 int, c1 int, r2 int, c2 int"
BLOCKS = (
    "wb string, sheet string, block_index int, block_type string, table_name string, r1 int, c1 int, r2 int, c2 int, cell_count long, "
    "formula_count long, has_merges boolean, has_formatting boolean, key_cells string"
)
EDGES = (
    "wb string, sheet string, row int, col int, ref string, target_sheet string, book string, table_name string, r1 int, c1 int, r2 int, "
    "c2 int, is_range boolean, edge_type string"
)
WORKBOOKS = "wb string, path string, filename string, size long, has_macros boolean, date_system string, title string, creator string, error string"
SHEETS = (
    "wb string, sheet string, sheet_index int, hidden boolean, freeze string, autofilter string, protected boolean, default_height double, "
    "default_width double, row_heights map<int,double>, col_widths map<int,double>, hidden_rows array<int>, hidden_cols array<int>, print_area string"
)
NAMES = "wb string, name string, ref string, scope_sheet string, hidden boolean"
CF_RULES = "wb string, sheet string, ranges array<string>, rule_type string, operator string, formula string, priority int, stop boolean"
DV_RULES = "wb string, sheet string, ranges array<string>, rule_type string, operator string, formula1 string, formula2 string, allow_blank boolean"
CHARTS = (
    "wb string, sheet string, chart_index int, chart_type string, title string, x_title string, y_title string, from_row int, from_col int, "
    "to_row int, to_col int, series array<struct<name:string,values_ref:string,categories_ref:string>>"
)
EDGE_TYPES = ("external", "structured_ref", "named_range", "cross_sheet", "cell_to_range", "cell_to_cell")
BLOCK_TYPES = ("header", "assumptions_table", "results_block", "calculation_block", "table", "text_block", "mixed", "label_block", "data_block", "light_block")
