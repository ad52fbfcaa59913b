"""Query-side text functions: dates, keywords, entities and intents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K
from .text import NOT_AFTER, NOT_BEFORE, col, extract_all, first_group, has_any, word, words_ws

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000}


def parse_relative_date(text, as_of) -> Column:
    """"yesterday", "last week/month", "n unit ago" (a month is 30 days), ISO text; else null."""
    t, now = F.lower(F.trim(col(text))), F.unix_micros(col(as_of))
    back = lambda seconds: F.timestamp_micros(now - seconds * F.lit(1000000).cast("bigint"))
    rel = r"^(\d+)\s+(second|minute|hour|day|week|month)s?\s+ago$"
    n = F.coalesce(F.regexp_extract(t, rel, 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    unit = F.regexp_extract(t, rel, 2)
    secs = F.lit(0).cast("bigint")
    for name, s in _UNIT_SECONDS.items():
        secs = F.when(unit == name, F.lit(s).cast("bigint")).otherwise(secs)
    day = F.lit(86400).cast("bigint")
    return (F.when(t == "yesterday", back(day)).when(t == "last week", back(day * 7)).when(t == "last month", back(day * 30))
            .when(t.rlike(rel), back(n * secs)).otherwise(F.trim(col(text)).try_cast("timestamp")))


_DAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
_NUMBER_WORDS = ["two", "three", "four", "five", "six", "seven", "eight"]


def _date_terms(d: Column, year: bool, abbr: bool) -> Column:
    parts = [F.lower(F.date_format(d, "MMMM")), F.dayofmonth(d).cast("string")]
    if year:
        parts.append(F.year(d).cast("string"))
    if abbr:
        parts.append(F.lower(F.date_format(d, "MMM")))
    return F.array(*parts)


def temporal_keywords(query, ref_date) -> Column:
    """Calendar words (month, day, year) for the relative dates a query mentions."""
    q, ref = F.lower(col(query)), F.to_date(col(ref_date))
    none = F.array().cast("array<string>")
    ago = r"(\d+)\s+(days?|weeks?|months?)\s+ago"
    n = F.coalesce(F.regexp_extract(q, ago, 1).try_cast("int"), F.lit(0))
    unit = F.regexp_extract(q, ago, 2)
    d1 = (F.when(unit.startswith("day"), F.date_sub(ref, n)).when(unit.startswith("week"), F.date_sub(ref, n * 7))
          .otherwise(F.add_months(ref, -n)))
    leg1 = F.when(q.rlike(ago), _date_terms(d1, True, True)).otherwise(none)
    lastday = r"last\s+(sunday|monday|tuesday|wednesday|thursday|friday|saturday)"
    target = F.coalesce(F.array_position(F.array(*[F.lit(d) for d in _DAYS]), F.regexp_extract(q, lastday, 1)), F.lit(1)).cast("int")
    diff = F.dayofweek(ref) - target
    diff = F.when(diff <= 0, diff + 7).otherwise(diff)
    leg2 = F.when(q.rlike(lastday), _date_terms(F.date_sub(ref, diff), True, False)).otherwise(none)
    leg3 = F.when(q.rlike("couple (of )?days ago"), _date_terms(F.date_sub(ref, 2), False, False)).otherwise(none)
    leg4 = F.when(q.rlike(f"{NOT_BEFORE}a\\s+week\\s+ago{NOT_AFTER}"), _date_terms(F.date_sub(ref, 7), False, False)).otherwise(none)
    ww = NOT_BEFORE + "(" + "|".join(_NUMBER_WORDS) + ")\\s+weeks?\\s+ago" + NOT_AFTER
    k = F.array_position(F.array(*[F.lit(w) for w in _NUMBER_WORDS]), F.regexp_extract(q, ww, 1)).cast("int") + 1
    leg5 = F.when(q.rlike(ww), _date_terms(F.date_sub(ref, k * 7), False, False)).otherwise(none)
    return F.concat(leg1, leg2, leg3, leg4, leg5)


def search_keywords(query) -> Column:
    cleaned = F.regexp_replace(F.lower(col(query)), r"[^\w\s]", " ")
    return F.filter(F.split(cleaned, r"\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(*K.SEARCH_STOP_WORDS))


_MON = ("(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|"
        "Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)")


def query_entities(query) -> Column:
    """Proper nouns, dates, months, years, weekdays and numbers with units, in that order."""
    q = col(query)
    w = lambda p, g=0, ic=True: extract_all(q, ("(?i)" if ic else "") + NOT_BEFORE + p + NOT_AFTER, g)
    first = F.regexp_extract(q, r"^[A-Z][a-z]+", 0)
    lead = F.when((first != "") & ~F.lower(first).isin(*K.SEARCH_STOP_WORDS), F.array(first)).otherwise(F.array().cast("array<string>"))
    parts = [
        extract_all(q, r"(?<=\s)[A-Z][a-z]+(?:\s[A-Z][a-z]+)*", 0), lead,
        w(r"\d{1,2}\s+" + _MON + r"\s*,?\s*\d{2,4}"), w(_MON + r"\s+\d{1,2}\s*,?\s*\d{2,4}"), w(_MON + r"\s+\d{4}"),
        w("(?:January|February|March|April|May|June|July|August|September|October|November|December)"),
        w(r"(?:19|20)\d{2}", ic=False), w("(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"),
        w(r"\d+\s+(?:days?|weeks?|months?|years?|hours?|minutes?)"),
    ]
    return F.filter(F.concat(*parts), lambda e: F.length(e) >= 2)


def search_intent(query) -> Column:
    ws = words_ws(query)
    return (F.when(has_any(ws, K.CAUSAL_SIGNALS), "causal").when(has_any(ws, K.TEMPORAL_SIGNALS), "temporal")
            .when(has_any(ws, K.RECOMMENDATION_SIGNALS) | col(query).rlike(word(r"should\s+i")), "recommendation")
            .when(has_any(ws, K.LOOKUP_SIGNALS), "lookup").otherwise("general"))


def type_boost(intent, type_) -> Column:
    out = F.lit(0.0)
    for name, boosts in K.INTENT_BOOSTS.items():
        for t, b in boosts.items():
            out = F.when((col(intent) == name) & (col(type_) == t), b).otherwise(out)
    return out


def question_intent(question) -> Column:
    q = F.lower(col(question))
    out = F.lit("general")
    for w in reversed(["what", "when", "who", "why", "how"]):
        out = F.when(q.startswith(w) | F.contains(q, F.lit(w + " ")), w).otherwise(out)
    return out


def question_terms(question) -> Column:
    cleaned = F.regexp_replace(F.lower(col(question)), r"[?!.,;:'\"()\[\]{}]", "")
    return F.filter(F.split(cleaned, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*K.QUESTION_STOP_WORDS))
