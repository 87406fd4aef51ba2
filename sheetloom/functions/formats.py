"""Displayed values by number format.  Rounding is half to even on the binary value, which no built-in function does, so this is an Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def shown(value: float | None, number_format: str | None) -> str | None:
    """A number as a sheet shows it: percent, thousands and fixed decimals; General floats with six significant digits."""
    if value is None or value != value:
        return None
    fmt = number_format or "General"
    decimals = sum(c in "0#" for c in fmt.rpartition(".")[2]) if "." in fmt else 0
    if "%" in fmt:
        return f"{value * 100:.{decimals}f}%"
    if "#,##" in fmt:
        return f"{value:,.{decimals}f}"
    if fmt not in ("General", "@") and "0" in fmt:
        return f"{value:.{decimals}f}"
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else f"{value:g}"


@F.pandas_udf(StringType())
def display(value: pd.Series, number_format: pd.Series) -> pd.Series:
    return pd.Series([shown(None if pd.isna(v) else v, f) for v, f in zip(value, number_format, strict=True)], dtype=object)


def fixed2(value) -> Column:
    """As printf's %.2f, which rounds the binary value half to even, where format_string rounds its decimal text half up.

    Whole and fraction, and the fraction's upper and lower bits times 100, are exact doubles, so the comparison with a half is exact.  From 9e18 on, format_string says.
    """
    x = F.col(value) if isinstance(value, str) else value
    a = F.abs(x)
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    small = F.when(a < 9e18, a)
    whole = F.floor(small)
    fraction = small - whole.cast("double")
    high = F.floor(fraction * (1 << 26)).cast("double") / (1 << 26)
    low = (fraction - high) * 100
    cents = F.floor(high * 100)
    rest = F.lit(0.5) - (high * 100 - cents.cast("double"))
    cents = cents + F.when((low > rest) | ((low == rest) & (cents % 2 == 1)), 1).otherwise(0)
    exact = F.concat(sign, (whole + F.when(cents == 100, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(F.isnan(x), "nan").when(a == float("inf"), F.concat(sign, F.lit("inf"))).when(a < 9e18, exact).when(x.isNotNull(), F.format_string("%.2f", x))


def round2(value) -> Column:
    """To two places as DuckDB does: the product with 100, half away from zero."""
    return F.round((F.col(value) if isinstance(value, str) else value) * 100) / 100


@F.pandas_udf(StringType())
def xxh64_id(text: pd.Series) -> pd.Series:
    """16 hexadecimal digits of XXH64 with seed 0; the built-in function has another seed."""
    import xxhash

    return text.map(lambda t: None if t is None else xxhash.xxh64(t.encode()).hexdigest())
