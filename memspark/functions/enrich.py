"""Per-row enrichment: redaction, importance, signal, topics, tiers, text cuts.

Everything here is a column expression (or a projection over one frame): no
shuffle, and whole texts only.
"""

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import constants as K
from .text import (BOUNDARY, NOT_AFTER, NOT_BEFORE, col, count_of, extract_all, is_blank, lines, nonblank, nth, strip, valid_json, word)


def redact(df: DataFrame, text: str, disabled=(), custom=(), strip_tags: bool = True) -> DataFrame:
    """Add ``cleaned``, ``n_redactions`` and ``had_private``.

    Steps run in order, each on the result of the one before; every replacement
    counts once. ``custom`` patterns are case-insensitive.
    """
    steps = []
    if strip_tags:
        steps.append((r"(?i)<private>[\s\S]*?</private>", "", "<"))
        steps.append((r"(?i)<redact>[\s\S]*?</redact>", "[REDACTED]", "<"))
    for name, pattern, put, literal in K.REDACTIONS:
        if name not in disabled:
            steps.append((pattern.replace(r"\b", BOUNDARY), put, literal))
    for p in custom:
        steps.append(("(?i)" + p.removeprefix("(?i)"), "[REDACTED]", None))
    out = df.withColumns({"cleaned": F.col(text), "n_redactions": F.lit(0).cast("bigint")})
    if strip_tags:
        out = out.withColumn("had_private", F.col(text).rlike(steps[0][0]))
    else:
        out = out.withColumn("had_private", F.lit(False))
    for pattern, put, literal in steps:
        # the literal test lets rows that cannot match skip the regex altogether
        may = F.lit(True) if literal is None else F.contains(F.col("cleaned"), F.lit(literal))
        out = out.withColumns({
            "n_redactions": F.col("n_redactions") + F.when(may, count_of("cleaned", pattern)).otherwise(0),
            "cleaned": F.when(may, F.regexp_replace("cleaned", pattern, put)).otherwise(F.col("cleaned")),
        })
    return out


def privacy_level(had_private, n_redactions) -> Column:
    return F.when(col(had_private), "private").when(col(n_redactions) > 0, "redacted").otherwise("public")


def importance(content, type_, has_entities) -> Column:
    """Score in [0, 1], rounded to 2 places; blank text scores 0.5."""
    c, t = col(content), col(type_)
    base = F.lit(K.DEFAULT_TYPE_SCORE)
    for name, score in K.TYPE_SCORES.items():
        base = F.when(t == name, score).otherwise(base)
    plus = lambda cond, n: F.when(cond, n).otherwise(0.0)
    score = (base + plus(c.rlike(word(K.IMPORTANCE_KEYWORDS)), 0.2) + plus(c.rlike(word(K.RESOLUTION_KEYWORDS)), 0.15)
             + plus(col(has_entities), 0.1) + plus(F.length(c) > 2000, 0.1))
    return F.when(is_blank(c), 0.5).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 2))


def significance_flags(content) -> Column:
    c = col(content)
    return F.array_compact(F.array(*[F.when(c.rlike(word(p)), f) for f, p in K.FLAG_KEYWORDS.items()]))


def pinned(flags) -> Column:
    return F.arrays_overlap(col(flags), F.array(*[F.lit(f) for f in K.PINNING_FLAGS]))


def signal_score(content) -> Column:
    """0.3 unique-line share + 0.3 character variety + 0.4 vocabulary richness."""
    c = col(content)
    ls = F.filter(F.transform(lines(c), lambda x: strip(x)), lambda x: x != "")
    repetition = F.when(F.size(ls) > 0, F.size(F.array_distinct(ls)) / F.size(ls)).otherwise(1.0)
    chars = F.array_distinct(F.filter(F.split(F.regexp_replace(c, r"\s", ""), ""), lambda x: x != ""))
    variety = F.least(F.lit(1.0), F.size(chars) / F.lit(40.0))
    ws = extract_all(F.lower(c), f"{NOT_BEFORE}[a-z]{{3,}}{NOT_AFTER}")
    rich = F.when(F.size(ws) > 0, F.least(F.lit(1.0), F.size(F.array_distinct(ws)) / F.sqrt(F.size(ws)))).otherwise(0.0)
    return repetition * 0.3 + variety * 0.3 + rich * 0.4


def penalised(importance_, signal) -> Column:
    """Noisy text (signal below 0.3) keeps half of its importance."""
    return F.when(col(signal) < 0.3, col(importance_) * 0.5).otherwise(col(importance_))


def _is_word_list(alternatives: str) -> bool:
    return all(w.isalnum() for w in alternatives.split("|"))


def topics(content) -> Column:
    """array<struct<topic, confidence, n>>; confidence = min(1, 0.5 + 0.1 per match).

    The text is cut into ASCII words once and only dictionary words are kept;
    topics made of plain words count in that short list, the few with phrases
    or punctuation search the text.
    """
    c = col(content)
    known = sorted({w for alts in K.TOPIC_KEYWORDS.values() if _is_word_list(alts) for w in alts.split("|")})
    parts = sorted({w for alts in K.TOPIC_KEYWORDS.values() if not _is_word_list(alts) for w in re.findall("[a-z0-9]+", alts)})
    words = F.filter(F.split(F.lower(c), "[^a-z0-9_]+"), lambda w: w.isin(*known, *parts) | F.endswith(w, F.lit("env")))

    def count(w, alts):
        if _is_word_list(alts):
            return F.size(F.filter(w, lambda x: x.isin(*alts.split("|"))))
        # phrases search the text, but only when one of their words is there; an
        # alternative that may start with a blank needs the full boundary test
        pattern = f"(?i){BOUNDARY}(?:{alts}){BOUNDARY}" if "|." in alts else word(alts)
        may = F.exists(w, lambda x: x.isin(*re.findall("[a-z0-9]+", alts)) | F.endswith(x, F.lit("env")))
        return F.when(may, F.regexp_count(c, F.lit(pattern))).otherwise(0)

    names = F.array(*[F.lit(t) for t in K.TOPIC_KEYWORDS])
    # transform over a one-element array evaluates the word list once for all topics
    counts = F.flatten(F.transform(F.array(words), lambda w: F.array(*[count(w, a) for a in K.TOPIC_KEYWORDS.values()])))
    every = F.zip_with(names, counts, lambda t, n: F.struct(t.alias("topic"), F.least(F.lit(1.0), F.lit(0.5) + n * 0.1).alias("confidence"), n.alias("n")))
    return F.filter(every, lambda s: s["n"] > 0)


def estimate_tokens(content) -> Column:
    return F.ceil(F.octet_length(col(content)) / F.lit(4.0)).cast("bigint")


def tool_tokens(tool, bytes_in, bytes_out) -> Column:
    """Tools that only bring text in are charged for their input alone."""
    only_in = col(tool).isin("Read", "Write", "WebFetch", "Agent")
    total = F.when(only_in, col(bytes_in)).otherwise(col(bytes_in) + col(bytes_out))
    return F.ceil(total / F.lit(4.0)).cast("bigint")


def days_between(earlier, as_of) -> Column:
    """Age in days with fractions."""
    return (F.unix_micros(col(as_of)) - F.unix_micros(col(earlier))) / F.lit(86400000000.0)


def tier_index(age_days, importance_, pinned_, light=7, medium=30, distilled=90) -> Column:
    a = col(age_days)
    i = F.when(a < light, 0).when(a < medium, 1).when(a < distilled, 2).otherwise(3)
    i = F.when((col(importance_) >= 0.8) & (i > 0), i - 1).otherwise(i)
    return F.when(col(pinned_), 0).otherwise(i)


def tier_name(index) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in K.TIERS]), col(index) + 1)


def sentences(c) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def compress(content, summary, tier) -> Column:
    """Text of one tier, always derived from the original content and summary."""
    c, s, t = col(content), col(summary), col(tier)
    keep = word(K.KEEP_KEYWORDS)

    def of_paragraph(p):
        ss = nonblank(sentences(p))
        return F.filter(F.transform(ss, lambda x, i: F.when((i == 0) | x.rlike(keep), strip(x))), lambda x: x.isNotNull())

    light = F.array_join(F.flatten(F.transform(nonblank(F.split(c, r"\n\s*\n")), of_paragraph)), " ")
    has_summary = s.isNotNull() & (s != "")
    medium = F.when(has_summary, s).otherwise(F.substring(c, 1, 200))
    source = F.when(has_summary, s).otherwise(c)
    ss = F.filter(sentences(source), lambda x: F.length(strip(x)) > 10)
    facts = F.slice(F.filter(ss, lambda x: x.rlike(keep)), 1, 3)
    bullets = F.array_join(F.transform(facts, lambda x: F.concat(F.lit("• "), strip(x))), "\n")
    distilled = (F.when(F.size(ss) == 0, F.substring(source, 1, 100)).when(F.size(facts) > 0, bullets)
                 .otherwise(F.concat(F.lit("• "), strip(nth(ss, 0)))))
    return F.when(t == "verbatim", c).when(t == "light", light).when(t == "medium", medium).otherwise(distilled)


def is_binary(content) -> Column:
    """More than 10 % control characters in the first 512."""
    head = F.substring(col(content), 1, 512)
    n = F.regexp_count(head, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    return (F.length(head) > 0) & (n / F.greatest(F.length(head), F.lit(1)) > 0.1)


def binary_digest(content) -> Column:
    c = col(content)
    return F.concat(F.lit("[Binary content] sha256:"), F.sha2(c, 256), F.lit(" ("), F.octet_length(c).cast("string"), F.lit(" bytes)"))


def _describe(value, depth=0):
    """Shape of a parsed JSON value, at most four levels deep."""
    if depth > 3:
        return "..."
    if isinstance(value, list):
        return f"array[{len(value)}] of {_describe(value[0], depth + 1)}" if value else "array[0]"
    if isinstance(value, dict):
        if not value:
            return "object{}"
        shown = ", ".join(f"{k}: {_describe(v, depth + 1)}" for k, v in list(value.items())[:10])
        more = len(value) - 10
        return "{" + shown + (f", +{more} more" if more > 0 else "") + "}"
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return "string" if isinstance(value, str) else "number"


def json_shape(content) -> Column:
    """Arrow-batched description of JSON rows; rows that are not JSON pass as null."""
    @F.pandas_udf("string")
    def shape(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else _describe(json.loads(t)))

    c = col(content)
    return shape(F.when(valid_json(c), c))


_PASSING = r"(?i)Tests:|Test Suites:|passed|failed|PASS|FAIL|total"
_NPM = r"(?i)added|removed|npm warn|npm ERR!|up to date|packages? in"


def truncate_cascade(df: DataFrame, text: str, aggressive: bool = False) -> DataFrame:
    """Add ``tier`` (4 binary, 1 JSON, 2 known tool output, 3 head and tail) and ``truncated``."""
    c = F.col(text)
    total = 400 if aggressive else 1000
    head, tail = int(total * 0.6), total - int(total * 0.6)
    ls = lines(c)
    is_test = c.rlike(r"(?i)Tests:\s.*total|PASS|FAIL|test suites?:")
    is_diff = c.rlike(r"(?m)^(diff --git|---|\+\+\+|@@)")
    is_npm = c.rlike(r"added \d+ packages?|npm warn|npm ERR!")
    top = lambda p: F.slice(F.filter(ls, lambda x: x.rlike(p)), 1, 10)
    test_text = F.concat(F.lit("[Test output summary]\n"), F.array_join(top(_PASSING), "\n"))
    changes = F.filter(ls, lambda x: x.startswith("diff --git") | x.startswith("---") | x.startswith("+++"))
    stats = F.filter(ls, lambda x: x.rlike(r"^\d+ files? changed"))
    half = F.size(changes) / F.lit(2)
    half_text = F.when(F.size(changes) % 2 == 0, (F.size(changes) / 2).cast("int").cast("string")).otherwise(half.cast("string"))
    diff_text = F.concat(F.lit("[Diff summary] "), half_text, F.lit(" files\n"), F.array_join(F.slice(changes, 1, 20), "\n"),
                         F.lit("\n"), F.array_join(stats, "\n"))
    npm_text = F.concat(F.lit("[npm output]\n"), F.array_join(top(_NPM), "\n"))
    n, chars = F.size(ls), F.length(c)
    cut_chars = F.concat(F.substring(c, 1, head * 8), F.lit("\n... ("), (chars - total * 8).cast("string"),
                         F.lit(" chars omitted) ...\n"), F.right(c, F.lit(tail * 8)))
    cut_lines = F.concat(F.lit("["), n.cast("string"), F.lit(" lines total]\n"), F.array_join(F.slice(ls, 1, head), "\n"),
                         F.lit("\n... ("), (n - total).cast("string"), F.lit(" lines omitted) ...\n"),
                         F.array_join(F.slice(ls, F.greatest(n - tail + 1, F.lit(1)), F.lit(tail)), "\n"))
    t3 = F.when(n > total, cut_lines).when(chars <= total * 8, c).otherwise(cut_chars)
    df = df.withColumn("_shape", json_shape(text))
    tier = F.when(is_binary(c), 4).when(F.col("_shape").isNotNull(), 1).when(is_test | is_diff | is_npm, 2).otherwise(3)
    body = (F.when(is_binary(c), binary_digest(c))
            .when(F.col("_shape").isNotNull(), F.concat(F.lit("[JSON schema] "), F.col("_shape")))
            .when(is_test, test_text).when(is_diff, diff_text).when(is_npm, npm_text).otherwise(t3))
    return df.withColumns({"tier": tier, "truncated": body}).drop("_shape")


def best_snippet(text, query, max_len: int = 300) -> Column:
    """The sentence with the most query words (first wins), for texts past ``max_len``."""
    t, q = col(text), col(query)
    terms = F.filter(F.split(F.lower(q), r"\s+"), lambda w: F.length(w) > 2)
    ss = F.filter(F.split(t, r"[.!?\n]+"), lambda s: F.length(strip(s)) > 10)
    scored = F.transform(ss, lambda s, i: F.struct(
        F.size(F.filter(terms, lambda w: F.contains(F.lower(s), w))).alias("n"), (-i).alias("p"), s.alias("s")))
    best = F.array_max(scored)["s"]
    head = F.substring(t, 1, max_len)
    return (F.when(t.isNull(), "").when(F.length(t) <= max_len, t).when((F.size(terms) == 0) | (F.size(ss) == 0), head)
            .otherwise(F.substring(strip(best), 1, max_len)))


def context_snippet(text, query, threshold: int = 350, around: int = 120) -> Column:
    """Up to ``around`` characters each side of the earliest query-word hit."""
    t, q = col(text), col(query)
    words = F.filter(F.split(F.lower(q), r"\s+"), lambda w: F.length(w) > 2)
    hits = F.filter(F.transform(words, lambda w: F.position(w, F.lower(t))), lambda p: p > 0)
    at = F.coalesce(F.array_min(hits) - 1, F.lit(0))
    start = F.greatest(F.lit(0), at - around)
    end = F.least(F.length(t), at + around)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substr(t, start + 1, end - start),
                   F.when(end < F.length(t), "...").otherwise(""))
    return F.when(F.length(t) <= threshold, t).otherwise(cut)


def event_priority(event_type) -> Column:
    out = F.lit(K.DEFAULT_EVENT_PRIORITY)
    for name, p in K.EVENT_PRIORITIES.items():
        out = F.when(col(event_type) == name, p).otherwise(out)
    return out


def decay(age_days, half_life) -> Column:
    """0.5 to the number of half-lives passed."""
    return F.pow(F.lit(0.5), col(age_days) / F.lit(float(half_life)))
