"""Text functions as columns: trimming, word counts, bounded phrases, URLs; counts of signs as a table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != ""))


def term_hits(c: Column, terms: tuple[str, ...]) -> Column:
    """How many different terms occur anywhere in the text, inside words too."""
    low = F.lower(c)
    total = F.lit(0)
    for t in terms:
        total = total + F.contains(low, F.lit(t)).cast("int")
    return total


def word_hits(c: Column, terms: tuple[str, ...]) -> Column:
    """How many different terms occur as words of their own, with no ASCII letter or digit beside them."""
    total = F.lit(0)
    for t in terms:
        total = total + c.rlike(bounded(t)).cast("int")
    return total


def sign_counts(df: DataFrame, key: str, text: str, sets: tuple[str, ...]) -> DataFrame:
    """``key, signs, counts``: how many signs a text has, and how many of each set of ASCII signs (no sign in two of them); null for a null text.

    One pass over the bytes serves all sets; a pattern for each stops at every sign.
    """
    import numpy as np

    kinds = np.zeros(256, np.uint8)
    kinds[0x80:0xC0] = 255  # the bytes of a sign behind its first
    for k, signs in enumerate(sets, 1):
        kinds[list(signs.encode("ascii"))] = k

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for value in batch[text].cast(pa.large_binary()):
                if not value.is_valid:
                    rows.append((None, None))
                    continue
                own = kinds[np.frombuffer(value.as_buffer(), np.uint8)]
                rows.append((np.count_nonzero(own != 255), [np.count_nonzero(own == k) for k in range(1, len(sets) + 1)]))
            yield pa.RecordBatch.from_arrays([batch[key], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=[key, "signs", "counts"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, signs bigint, counts array<bigint>")


def bounded(phrase: str) -> str:
    """A pattern for a phrase that no ASCII letter or digit touches, in any case."""
    return rf"(?iU)(?<![A-Za-z0-9])\Q{phrase}\E(?![A-Za-z0-9])"


def any_phrase(c: Column, phrases: tuple[str, ...]) -> Column:
    if not phrases:
        return F.lit(False)
    body = "|".join(rf"\Q{p}\E" for p in phrases)
    return F.coalesce(c.rlike(rf"(?iU)(?<![A-Za-z0-9])(?:{body})(?![A-Za-z0-9])"), F.lit(False))


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def number(c: Column) -> Column:
    """A double, or null if the text is none; never an error."""
    return c.try_cast("double")


def number_or(c: Column, default: Column | float) -> Column:
    """``c``, but ``default`` where it is null or zero."""
    c = number(c) if not isinstance(c, (int, float)) else F.lit(c)
    return F.when(c.isNull() | (c == 0), default).otherwise(c)


def percent(c: Column) -> Column:
    return F.format_string("%+.1f%%", c * 100)


TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking parameters, the others sorted, no slash at the end."""
    plain = F.regexp_replace(strip(c), "#.*$", "")
    base = F.regexp_replace(F.regexp_extract(plain, r"^([^?]*)", 1), "/+$", "")
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    path = F.substring(base, F.length(host) + 1, F.length(base))
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    names = "|".join(map(re.escape, TRACKING))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(rf"(?i)^(?:{names})(?:=|$)")))
    return F.concat(F.lower(host), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
