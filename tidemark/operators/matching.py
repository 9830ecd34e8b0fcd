"""Ticker mapping and copy rules. Tables of patterns become literal expressions, so no join is planned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import any_phrase


def matches(text: Column, alias: fixed.Alias) -> Column:
    """Does an item name this ticker: no exclusion, and a direct term, or a contextual one with context."""
    contextual = {c.casefold() for c in alias.contextual}
    names = (alias.ticker, alias.cashtag, alias.company, *alias.strong)
    direct = tuple(t for t in names if t.casefold() not in contextual)
    excluded = any_phrase(text, alias.exclusions)
    weak = any_phrase(text, alias.contextual) & any_phrase(text, alias.context)
    return ~excluded & (any_phrase(text, direct) | weak)


def with_tickers(df: DataFrame, text_col: str = "text", aliases: tuple[fixed.Alias, ...] = fixed.ALIASES) -> DataFrame:
    """``matched`` tickers and ``outcome``: assigned, ambiguous or unmatched."""
    found = F.array_compact(F.array(*[F.when(matches(F.col(text_col), a), F.lit(a.ticker)) for a in aliases]))
    size = F.size("matched")
    return df.withColumn("matched", found).withColumn("outcome", F.when(size > 1, "ambiguous").when(size == 1, "assigned").otherwise("unmatched"))


def expression(kind: str, pattern: str) -> str:
    return rf"(?iU)(?<![A-Za-z0-9])\Q{pattern}\E(?![A-Za-z0-9])" if kind == "literal" else f"(?iU){pattern}"


def categories(text: Column, rules: tuple[tuple[str, str, str], ...] = fixed.RULES) -> Column:
    """The sorted categories whose rules a text breaks."""
    names = sorted({r[0] for r in rules})
    tests = []
    for name in names:
        broken = F.lit(False)
        for category, kind, pattern in rules:
            if category == name:
                broken = broken | text.rlike(expression(kind, pattern))
        tests.append(F.when(F.coalesce(broken, F.lit(False)), F.lit(name)))
    return F.array_compact(F.array(*tests))


def lint(df: DataFrame, scope: Column, text_col: str = "text") -> DataFrame:
    """``categories`` of generated copy; raw publisher text has none; an unknown scope is an error."""
    none = F.array().cast("array<string>")
    unknown = F.raise_error(F.concat(F.lit("unknown content scope: "), F.coalesce(scope, F.lit("null")))).cast("array<string>")
    found = F.when(scope.isin(*fixed.GENERATED_SCOPES), categories(F.col(text_col))).when(scope.isin(*fixed.RAW_SCOPES), none).otherwise(unknown)
    return df.withColumn("categories", found)
