"""Small column helpers shared by the text functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NOT_BEFORE = "(?<![A-Za-z0-9_])"
NOT_AFTER = "(?![A-Za-z0-9_])"
#: ASCII word boundary; the JVM's own is Unicode-aware and would differ on accented text.
BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def word(alternatives: str, ignore_case: bool = True) -> str:
    """Regex for whole ASCII words out of ``a|b|c``."""
    return ("(?i)" if ignore_case else "") + f"{NOT_BEFORE}(?:{alternatives}){NOT_AFTER}"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove white space (not only blanks) from both ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def lines(c) -> Column:
    return F.split(col(c), "\n")


def nonblank(arr: Column) -> Column:
    return F.filter(arr, lambda x: x.rlike(r"\S"))


def is_blank(c) -> Column:
    c = col(c)
    return c.isNull() | ~c.rlike(r"\S")


def words_ws(c) -> Column:
    """Lower-cased words split on white space, empty ones dropped."""
    return F.filter(F.split(F.lower(col(c)), r"\s+"), lambda w: w != "")


def in_list(w: Column, values) -> Column:
    return w.isin(*values)


def has_any(arr: Column, values) -> Column:
    return F.arrays_overlap(arr, F.array(*[F.lit(v) for v in values]))


def extract_all(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def count_of(c, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern)).cast("bigint")


def first_group(c, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null (not '') when nothing matches."""
    c = col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def tokens_of(c) -> Column:
    """Search tokens: lower case, split on anything but ASCII letters and digits."""
    return F.filter(F.split(F.lower(col(c)), "[^a-z0-9]+"), lambda w: w != "")


def nth(arr: Column, i: int) -> Column:
    """Element by 0-based position, null past the end (safe under ANSI)."""
    return F.get(arr, F.lit(i))


def round6(c) -> Column:
    return F.round(col(c), 6)


def valid_json(c) -> Column:
    """The whole text is one JSON value.

    The JSON parser stops after the first value, so the text is parsed inside an
    array and inside an object: what follows a first value breaks one of them.
    """
    c = col(c)
    ok = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"a":'), c, F.lit("}"))).isNotNull()
    return F.when(c.rlike(r'^\s*[\[{"tfn0-9-]'), ok).otherwise(False)
