"""Display functions of the dashboard: money, numbers, metric rows, alerts, trading days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(c: Column) -> Column:
    """Compact dollars: one place and T, B, M or K."""
    out = F.when(c.isNull(), F.lit("N/A"))
    for size, sign in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")):
        out = out.when(F.abs(c) >= size, F.format_string(f"$%.1f{sign}", c / size))
    return out.otherwise(F.format_string("$%.2f", c))


def signed(c: Column, digits: int = 2) -> Column:
    """Fixed decimals with a plus before what is above zero; null for what is no finite number."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(finite, F.concat(F.when(c > 0, "+").otherwise(""), F.format_string(f"%.{digits}f", c)))


def price_change(delta: Column, percent: Column) -> Column:
    """``$+1.00 (+2.00%)``, or the side that there is."""
    d, p = signed(delta), signed(percent)
    return F.when(d.isNull() & p.isNull(), "Change not reported").when(d.isNull(), F.concat(p, F.lit("%"))).when(p.isNull(), F.concat(F.lit("$"), d)).otherwise(F.concat(F.lit("$"), d, F.lit(" ("), p, F.lit("%)")))


def volume_delta(c: Column) -> Column:
    return F.concat(F.lit("Volume delta "), signed(c * 100, 1), F.lit("%"))


def metrics(df: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """One row for each metric that has a value."""
    return df.select(key, *[F.col(n).cast("double") for n in names]).unpivot([key], list(names), "metric", "value").where(F.col("value").isNotNull())


def alert(status: Column) -> Column:
    """The kind of notice that a section's status asks for; null for none."""
    return F.when(status == "unavailable", "error").when(status.isin("fallback", "partial", "stale"), "warning").when(status == "cached", "info")


def trading_day(at: Column) -> Column:
    """The date in New York of a UTC time."""
    return F.to_date(F.from_utc_timestamp(at, "America/New_York"))
