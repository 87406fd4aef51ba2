"""References in formula texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHEET, _CELL = r"(?:'[^']+'|[A-Za-z0-9_]+)", r"\$?[A-Z]{1,3}\$?[0-9]{1,7}"
EXTERNAL = rf"\[[^\]]+\]{_SHEET}!{_CELL}(?::{_CELL})?"
STRUCTURED = r"[A-Za-z_][A-Za-z0-9_.]*\[[^\]]*\]"
#: With the bracket that would end a book's name, so that those can be dropped.
PLAIN = rf"\]?(?:{_SHEET}!)?{_CELL}(?::(?:{_SHEET}!)?{_CELL})?"
FUNCTIONS = (
    "ABS ADDRESS AND ARRAYTOTEXT AVERAGE CEILING CELL CHOOSE COLUMN COLUMNS CONCAT CONCATENATE COUNT COUNTA COUNTIF COUNTIFS DATE DATEVALUE DAY DOLLAR EXP FALSE "
    "FILTER FIND FIXED FLOOR FV HLOOKUP HOUR HYPERLINK IF IFERROR IFNA IFS INDEX INDIRECT INFO IRR ISBLANK ISERROR ISLOGICAL ISNA ISNUMBER ISREF ISTEXT LAMBDA "
    "LARGE LEFT LEN LET LN LOG LOWER MAP MATCH MAX MEDIAN MID MIN MINUTE MINVERSE MMULT MOD MODE MONTH N NA NOT NOW NPER NPV NUMBERVALUE OFFSET OR PERCENTILE PI "
    "PMT POWER PV RAND RANDBETWEEN RANK RATE REDUCE REPLACE REPT RIGHT ROUND ROUNDDOWN ROUNDUP ROW ROWS SEARCH SECOND SEQUENCE SMALL SORT SQRT STDEV SUBSTITUTE "
    "SUM SUMIF SUMIFS SUMPRODUCT SWITCH TEXT TEXTJOIN TIMEVALUE TODAY TRANSPOSE TRIM TRUE TYPE UNIQUE UPPER VALUE VALUETOTEXT VAR VLOOKUP XLOOKUP XMATCH YEAR"
).split()


def external(formula) -> Column:
    return F.regexp_extract_all(formula, F.lit(EXTERNAL), F.lit(0))


def structured(formula) -> Column:
    known = F.array(*map(F.lit, FUNCTIONS))
    return F.filter(F.regexp_extract_all(formula, F.lit(STRUCTURED), F.lit(0)), lambda x: ~F.array_contains(known, F.upper(F.substring_index(x, "[", 1))))


def plain(formula) -> Column:
    return F.filter(F.regexp_extract_all(formula, F.lit(PLAIN), F.lit(0)), lambda x: ~x.startswith("]"))


def references(formula) -> Column:
    """All references, each once: external, structured, then plain ones, in order of place."""
    return F.array_distinct(F.concat(external(formula), structured(formula), plain(formula)))
