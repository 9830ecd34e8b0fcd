"""Market features from daily bars; a ticker's series is worked on in blocks, so that one ticker has many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number
from . import blocks

HISTORY = 32


def _by_date():
    return Window.partitionBy("ticker").orderBy("date")


def deltas(bars: DataFrame, w: Window | None = None) -> DataFrame:
    """Each bar with change to the bar before and volume against the mean of up to five bars before; ``w`` is the window of a ticker's bars in order."""
    w = _by_date() if w is None else w
    prior = F.avg("volume").over(w.rowsBetween(-5, -1))
    df = bars.withColumns({"previous_close": F.coalesce(F.lag("close").over(w), F.col("close")), "average_volume": F.coalesce(prior, F.col("volume").cast("double"))})
    change = F.col("close") - F.col("previous_close")
    return df.withColumns({
        "price_delta_24h": change,
        "percent_change_24h": F.when(F.col("previous_close") != 0, change / F.col("previous_close") * 100).otherwise(0.0),
        "volume_delta": F.when(F.col("average_volume") != 0, (F.col("volume") - F.col("average_volume")) / F.col("average_volume")).otherwise(0.0),
    }).drop("average_volume")


def delta_series(bars: DataFrame, size: int = blocks.SIZE) -> DataFrame:
    """:func:`deltas` of whole series, in blocks that see five bars of the block before."""
    return blocks.own(deltas(blocks.blocked(bars, ["ticker"], ["date"], 5, size), blocks.in_block("ticker")))


def latest(df: DataFrame, *extra: Column) -> DataFrame:
    """The newest row of each ticker; ``extra`` orders rows of one date."""
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc(), *extra))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def snapshot(bars: DataFrame) -> DataFrame:
    """One row for each ticker. Six bars of a ticker are all that the newest needs, so older ones go before the deltas."""
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc()))
    recent = bars.withColumn("__rank", rank).where("__rank <= 6").drop("__rank")
    out = latest(deltas(recent)).withColumnRenamed("close", "price")
    return out.select(
        "ticker", "date", "price", F.when(F.col("high").isNull() | (F.col("high") == 0), F.col("price")).otherwise(F.col("high")).alias("day_high"),
        "volume", "price_delta_24h", "percent_change_24h", "volume_delta",
        F.when(F.col("price") > 0, "live").otherwise("unavailable").alias("status"),
    )


def normalized_snapshot(df: DataFrame) -> DataFrame:
    """Defaults for a stored snapshot: day high from the price, status and source from price above zero, deltas as numbers or null."""
    price = F.coalesce(number(F.col("price")), F.lit(0.0))
    high = number(F.col("day_high"))
    return df.withColumn("price", price).withColumns({
        "day_high": F.when(high.isNull() | (high == 0), F.col("price")).otherwise(high),
        "volume": F.coalesce(F.col("volume").try_cast("bigint"), F.lit(0).cast("bigint")),
        "status": F.coalesce(F.nullif("status", F.lit("")), F.when(F.col("price") > 0, "cached").otherwise("unavailable")),
        "source": F.coalesce(F.nullif("source", F.lit("")), F.when(F.col("price") > 0, "Pipeline market snapshot").otherwise("unavailable")),
        **{c: number(F.col(c)) for c in ("price_delta_24h", "percent_change_24h", "volume_delta")},
    })


def history(bars: DataFrame, limit: int = HISTORY) -> DataFrame:
    """The last ``limit`` bars of each ticker that have a close, close at two places."""
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc()))
    kept = bars.where(F.col("close").isNotNull() & ~F.isnan("close")).withColumn("back", rank).where(F.col("back") <= limit)
    return kept.select("ticker", "date", F.round("close", 2).alias("close"), "volume", "back")


def period_change(points: DataFrame) -> DataFrame:
    """First to last close, least, most and range of each ticker's points."""
    out = points.groupBy("ticker").agg(F.min_by("close", "date").alias("first_close"), F.max_by("close", "date").alias("last_close"), F.min("close").alias("low"), F.max("close").alias("high"))
    change = F.when(F.col("first_close") != 0, (F.col("last_close") - F.col("first_close")) / F.col("first_close") * 100).otherwise(0.0)
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") * 0.01, F.lit(1.0)))
    return out.withColumns({"change_pct": change, "span": span, "tone": F.when(change >= 0, "up").otherwise("down")})


def fractional_delta(percents: list[Column], deltas: list[Column]) -> Column:
    """The first percent change that is a number, as a fraction; else the first raw delta; else zero."""
    return F.coalesce(*[number(p) / 100 for p in percents], *[number(d) for d in deltas], F.lit(0.0))


def first_number(sources: list[list[Column]]) -> Column:
    """The first number, source by source and key by key."""
    return F.coalesce(*[number(c) for source in sources for c in source])


def indicators(bars: DataFrame, short: int = 5, long: int = 20, width: float = 2.0, size: int = blocks.SIZE) -> DataFrame:
    """Moving averages, Bollinger bands and an average-based strength index, over row frames in blocks; the longest frame and one move more are a block's halo."""
    w = blocks.in_block("ticker")
    bars = blocks.blocked(bars.select("ticker", "date", "close"), ["ticker"], ["date"], max(short, long, 14) + 1, size)

    def frame(n: int):
        return w.rowsBetween(-(n - 1), 0)

    move = F.col("close") - F.lag("close").over(w)
    df = bars.withColumns({"up": F.greatest(move, F.lit(0.0)), "down": F.greatest(-move, F.lit(0.0))})
    up, down = F.avg("up").over(frame(14)), F.avg("down").over(frame(14))
    middle, spread = F.avg("close").over(frame(long)), F.stddev_pop("close").over(frame(long))
    out = df.select(
        "ticker", "date", F.avg("close").over(frame(short)).alias("sma_short"), middle.alias("sma_long"),
        (middle + width * spread).alias("band_high"), (middle - width * spread).alias("band_low"),
        F.when(up + down > 0, 100 * up / (up + down)).otherwise(50.0).alias("strength"), "number", "block", "own",
    )
    return blocks.own(out)


def as_of(events: DataFrame, bars: DataFrame, size: int = blocks.SIZE) -> DataFrame:
    """Each event with the last bar of its ticker on or before its date.

    What an event gets depends on its ticker and date alone, so the different
    dates are matched (a row a day, however many events), in blocks of a ticker's
    days, and the events join the result by equality.
    """
    left = events.select("ticker", "date").where("ticker IS NOT NULL AND date IS NOT NULL").distinct().select("ticker", "date", F.lit(None).cast("struct<date: string, close: double>").alias("bar"), F.lit(1).alias("side"))
    right = bars.select("ticker", "date", F.struct("date", "close").alias("bar"), F.lit(0).alias("side"))
    both = blocks.last_before(blocks.blocked(left.unionByName(right), ["ticker"], ["date", "side"], size=size), ["ticker"], "bar")
    found = both.where("side = 1").select("ticker", "date", F.col("bar.date").alias("bar_date"), F.col("bar.close").alias("bar_close"))
    return events.select("ticker", "date", "event_id").join(found, ["ticker", "date"], "left")


TREND = "ticker string, date string, ema_short double, ema_long double, macd double, macd_signal double, wilder_strength double"


def _scan(values, decay: float):
    """``y[t] = values[t] + decay * y[t - 1]``, by doubling."""
    y, step = values.copy(), 1
    while step < len(y):
        y[step:] = y[step:] + decay * y[:-step]
        step, decay = 2 * step, decay * decay
    return y


def trend(bars: DataFrame, short: int = 12, long: int = 26, signal: int = 9, period: int = 14, size: int = 1 << 12) -> DataFrame:
    """Exponential means, their difference and its mean, and Wilder's strength index.

    Each value goes on from the day before, which no window frame can say. It
    is linear in that value, so a block of days is an affine map: all blocks make
    theirs from nothing, a small table composes the maps of a ticker in order,
    and each block is made again from the state that reaches it. The first close
    starts each mean; days without a close are left out.
    """
    import numpy as np
    import pandas as pd

    fast, slow, smooth, wilder = 1 - 2 / (short + 1), 1 - 2 / (long + 1), 1 - 2 / (signal + 1), 1 - 1 / period

    def series(rows, state):
        """The five means of a block, from the state before it; and what that state's first two add to the third's last."""
        rows = rows.sort_values("number")
        x, before = rows["close"].to_numpy(), rows["before"].to_numpy()
        t = np.arange(1, len(x) + 1)
        a = _scan((1 - fast) * x, fast) + state[0] * fast**t
        b = _scan((1 - slow) * x, slow) + state[1] * slow**t
        g = _scan((1 - smooth) * (a - b), smooth) + state[2] * smooth**t
        u = _scan((1 - wilder) * np.maximum(x - before, 0.0), wilder) + state[3] * wilder**t
        d = _scan((1 - wilder) * np.maximum(before - x, 0.0), wilder) + state[4] * wilder**t
        return rows, (a, b, g, u, d)

    def summary(key, rows):
        _, made = series(rows, (0.0,) * 5)
        t = np.arange(1, len(rows) + 1)
        more = [_scan((1 - smooth) * f**t, smooth)[-1] for f in (fast, slow)]
        return pd.DataFrame([[*key, len(rows), rows.loc[rows["number"].idxmin(), "close"], *(m[-1] for m in made), *more]])

    def compose(key, rows):
        out, state = [], None
        for r in rows.sort_values("block").itertuples(index=False):
            state = (r.first, r.first, 0.0, 0.0, 0.0) if state is None else state
            out.append((key[0], r.block, *state))
            a, b, g, u, d = state
            state = (
                r.a + a * fast**r.n, r.b + b * slow**r.n, r.g + g * smooth**r.n + r.ka * a - r.kb * b, r.u + u * wilder**r.n, r.d + d * wilder**r.n,
            )
        return pd.DataFrame(out)

    def values(key, rows):
        rows, (a, b, g, u, d) = series(rows, rows[["a", "b", "g", "u", "d"]].iloc[0].to_numpy())
        moves = u + d
        strength = np.divide(100 * u, moves, out=np.full(len(u), 50.0), where=moves > 0)
        return pd.DataFrame({"ticker": rows["ticker"].to_numpy(), "date": rows["date"].to_numpy(), "ema_short": a, "ema_long": b, "macd": a - b, "macd_signal": g, "wilder_strength": strength})

    days = blocks.blocked(bars.where(F.col("close").isNotNull() & F.col("ticker").isNotNull()).select("ticker", "date", "close"), ["ticker"], ["date", "close"], 1, size)
    days = days.withColumn("before", F.coalesce(F.lag("close").over(blocks.in_block("ticker")), "close")).where("own")
    days = days.select("ticker", "block", "number", "date", "close", "before").checkpoint()
    state = "a double, b double, g double, u double, d double"
    maps = days.groupBy("ticker", "block").applyInPandas(summary, f"ticker string, block bigint, n bigint, first double, {state}, ka double, kb double")
    states = maps.groupBy("ticker").applyInPandas(compose, f"ticker string, block bigint, {state}")
    return days.join(states, ["ticker", "block"]).groupBy("ticker", "block").applyInPandas(values, TREND)
