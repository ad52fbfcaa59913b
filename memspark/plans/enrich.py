"""Registered queries: per-row enrichment (P), custom surfaces (U1, U2)."""

from pyspark.sql import functions as F

from ..functions import constants as K, enrich as E, entities as N, language as L
from ..functions.text import count_of, round6
from ..operators import content_types as CT
from ..session import spread
from ..views import AS_OF, events, observations, pick, table, ts
from .registry import query, sql

W = lambda alts: rf"(?i)\b(?:{alts})\b"
q = lambda s: s.replace("'", "''")
vals = lambda xs: ", ".join(f"'{q(x)}'" for x in xs)
vlist = lambda xs: "[" + vals(xs) + "]"


def docs(spark, sf, *cols):
    return spread(table(spark, sf, "documents").select("doc_id", "text", *cols), "doc_id")


def obs(spark, sf):
    return spread(observations(spark, sf), "id")


def _redact_sql(custom=(), disabled=()):
    steps = [("(?i)<private>[\\s\\S]*?</private>", ""), ("(?i)<redact>[\\s\\S]*?</redact>", "[REDACTED]")]
    steps += [(p, r.replace("$1", "\\1")) for n, p, r, _ in K.REDACTIONS if n not in disabled]
    steps += [("(?i)" + p, "[REDACTED]") for p in custom]
    ctes, prev = ["r0 AS (SELECT doc_id, text AS c, 0 AS n FROM documents)"], "r0"
    for i, (p, r) in enumerate(steps, 1):
        ctes.append(f"r{i} AS (SELECT doc_id, regexp_replace(c, '{q(p)}', '{q(r)}', 'g') AS c, "
                    f"n + len(regexp_extract_all(c, '{q(p)}')) AS n FROM r{i - 1})")
        prev = f"r{i}"
    return ctes, prev


_ct, _last = _redact_sql()


@query("p1_redact", "WITH " + ",\n".join(_ct) + f"""
SELECT r.doc_id, sha256(c) AS cleaned_sha, CAST(n AS BIGINT) AS n_redactions,
       regexp_matches(text, '(?i)<private>[\\s\\S]*?</private>') AS had_private
FROM {_last} r JOIN documents d USING (doc_id)""")
def p1(spark, sf):
    r = E.redact(docs(spark, sf), "text")
    return r.select("doc_id", F.sha2("cleaned", 256).alias("cleaned_sha"), "n_redactions", "had_private")


@query("p2_privacy_level", "WITH " + ",\n".join(_ct) + f"""
SELECT CASE WHEN regexp_matches(text, '(?i)<private>[\\s\\S]*?</private>') THEN 'private' WHEN n > 0 THEN 'redacted' ELSE 'public' END AS level,
       count(*) AS docs, CAST(sum(n) AS BIGINT) AS redactions
FROM {_last} r JOIN documents d USING (doc_id) GROUP BY 1""")
def p2(spark, sf):
    r = E.redact(docs(spark, sf), "text")
    return (r.select(E.privacy_level("had_private", "n_redactions").alias("level"), "n_redactions")
            .groupBy("level").agg(F.count("*").alias("docs"), F.sum("n_redactions").alias("redactions")))


_ct2, _last2 = _redact_sql(custom=[r"th[a-z]{2}ing"], disabled=["ip_address"])


@query("u2_redact_custom", "WITH " + ",\n".join(_ct2) + f"""
SELECT doc_id, sha256(c) AS cleaned_sha, CAST(n AS BIGINT) AS n_redactions FROM {_last2}""")
def u2(spark, sf):
    r = E.redact(docs(spark, sf), "text", disabled=["ip_address"], custom=[r"th[a-z]{2}ing"])
    return r.select("doc_id", F.sha2("cleaned", 256).alias("cleaned_sha"), "n_redactions")


_IMP = ("CASE WHEN NOT regexp_matches(content, '\\S') THEN 0.5 ELSE round(least(1.0, greatest(0.0, "
        + "CASE type " + " ".join(f"WHEN '{t}' THEN {s}" for t, s in K.TYPE_SCORES.items()) + " ELSE 0.5 END"
        + f" + CASE WHEN regexp_matches(content, '{W(K.IMPORTANCE_KEYWORDS)}') THEN 0.2 ELSE 0 END"
        + f" + CASE WHEN regexp_matches(content, '{W(K.RESOLUTION_KEYWORDS)}') THEN 0.15 ELSE 0 END"
        + " + CASE WHEN {ent} THEN 0.1 ELSE 0 END + CASE WHEN length(content) > 2000 THEN 0.1 ELSE 0 END)), 2) END")
_HAS_VERSION = r"\bv?(\d+\.\d+(?:\.\d+)?(?:-[\w.]+)?)\b"


@query("p3_importance", sql(f"SELECT id, type, CAST({_IMP.format(ent=f'''regexp_matches(content, '{_HAS_VERSION}')''')} AS DOUBLE) AS importance FROM v_observations",
                            "v_observations"))
def p3(spark, sf):
    o = obs(spark, sf)
    has = count_of("content", N.VERSION_REF) > 0
    return o.select("id", "type", E.importance("content", "type", has).alias("importance"))


_FLAGS = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(content, '{W(p)}') THEN '{f}' END" for f, p in K.FLAG_KEYWORDS.items()) + "], lambda x: x IS NOT NULL)"


@query("p4_significance_flags", sql(f"""
SELECT id, array_to_string(f, ',') AS flags, list_has_any(f, ['DECISION', 'MILESTONE']) AS pinned
FROM (SELECT id, {_FLAGS} AS f FROM v_observations)""", "v_observations"))
def p4(spark, sf):
    o = obs(spark, sf).select("id", E.significance_flags("content").alias("f"))
    return o.select("id", F.array_join("f", ",").alias("flags"), E.pinned("f").alias("pinned"))


_SIG = """SELECT doc_id, lower(text) AS lt, regexp_replace(text, '\\s', '', 'g') AS nosp, text,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls,
  regexp_extract_all(lower(text), '\\b[a-z]{3,}\\b') AS ws FROM documents"""
_SIG2 = f"""SELECT doc_id, text,
  0.3e0 * CASE WHEN len(ls) > 0 THEN len(list_distinct(ls)) / len(ls)::DOUBLE ELSE 1 END
  + 0.3e0 * least(1.0e0, len(list_distinct(list_filter(string_split(nosp, ''), lambda x: x <> ''))) / 40.0e0)
  + 0.4e0 * CASE WHEN len(ws) > 0 THEN least(1.0e0, len(list_distinct(ws)) / sqrt(len(ws)::DOUBLE)) ELSE 0 END AS sig FROM ({_SIG})"""


@query("p5_signal_score", f"SELECT doc_id, round(sig, 6) AS signal, sig < 0.3e0 AS noisy FROM ({_SIG2})")
def p5(spark, sf):
    d = docs(spark, sf).select("doc_id", E.signal_score("text").alias("s"))
    return d.select("doc_id", round6("s").alias("signal"), (F.col("s") < 0.3).alias("noisy"))


_TOPIC = "\nUNION ALL\n".join(
    f"SELECT doc_id, '{t}' AS topic, len(regexp_extract_all(text, '{W(p)}')) AS n FROM documents" for t, p in K.TOPIC_KEYWORDS.items())


@query("p6_topics", f"SELECT doc_id, topic, round(least(1.0e0, 0.5e0 + n * 0.1e0), 6) AS confidence FROM ({_TOPIC}) WHERE n > 0")
def p6(spark, sf):
    d = docs(spark, sf).select("doc_id", F.explode(E.topics("text")).alias("t"))
    return d.select("doc_id", "t.topic", round6("t.confidence").alias("confidence"))


_ALIAS_ROWS = {n.lower(): n for n in K.TECHNOLOGIES}
_ALIAS_ROWS.update({a.lower(): n for n, many in K.TECHNOLOGY_ALIASES.items() for a in many})
_ALIAS_SQL = "alias(a, canon) AS (VALUES " + ", ".join(f"('{q(a)}', '{q(c)}')" for a, c in _ALIAS_ROWS.items()) + ")"


def _ent_leg(prio, type_, expr, flt="true"):
    return (f"SELECT doc_id, {prio} AS prio, '{type_}' AS type, u.x AS name, u.i AS pos FROM "
            f"(SELECT doc_id, {expr} AS l FROM documents) t, LATERAL (SELECT unnest(l) AS x, unnest(range(len(l))) AS i) u WHERE {flt}")


_ENT = ",\n".join([_ALIAS_SQL, "raw AS (" + "\nUNION ALL\n".join([
    _ent_leg(1, "library", r"""regexp_split_to_array(text, '[\s,;:()\[\]{}"''`]+')""", "length(u.x) >= 2"),
    _ent_leg(2, "file", r"regexp_extract_all(text, '(?:^|\s)((?:\.?\.?/)?(?:[\w\-.]+/)+[\w\-.]+(?:\.\w+)?)', 1)", "length(u.x) >= 4"),
    _ent_leg(3, "module", r"regexp_extract_all(text, '\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b', 1)", f"u.x NOT IN ({vals(K.CAMEL_CASE_SKIP)})"),
    _ent_leg(4, "config", r"regexp_extract_all(text, '\b([A-Z][A-Z0-9_]{2,})\b', 1)", f"u.x NOT IN ({vals(K.ALL_CAPS_SKIP)})"),
    _ent_leg(5, "bug", r"list_transform(regexp_extract_all(text, '(?i)(?:#|(?:issue|bug|ticket)[-\s]?)(\d+)', 1), lambda x: concat('#', x))"),
    _ent_leg(6, "service", rf"list_transform(regexp_extract_all(text, '{_HAS_VERSION}', 1), lambda x: concat('v', x))"),
    _ent_leg(7, "person", r"regexp_extract_all(text, '\b([A-Z][a-z]{2,}\s+[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})?)\b', 1)"),
]) + ")", """best AS (
  SELECT doc_id, prio, type, CASE WHEN type = 'library' THEN canon ELSE name END AS name, pos
  FROM raw LEFT JOIN alias ON lower(name) = a
  WHERE CASE WHEN type = 'library' THEN canon IS NOT NULL WHEN type IN ('module', 'config', 'person') THEN canon IS NULL ELSE true END)"""])
_CONF = "CASE type " + " ".join(f"WHEN '{t}' THEN {c}" for t, c in K.ENTITY_CONFIDENCE.items()) + " END"


@query("p7_entities", f"""WITH {_ENT}
SELECT doc_id AS id, name, type, CAST({_CONF} AS DOUBLE) AS confidence FROM best
QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY prio, pos) = 1""")
def p7(spark, sf):
    return N.entities(docs(spark, sf), "doc_id", "text")


@query("p8_resolve_alias", f"""WITH {_ALIAS_SQL}, w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS name FROM documents)
SELECT name, coalesce(canon, name) AS canonical, coalesce(lower(canon) <> lower(name), false) AS is_alias
FROM w LEFT JOIN alias ON lower(name) = a WHERE name <> ''""")
def p8(spark, sf):
    names = docs(spark, sf).select(F.explode(F.split("text", r"\s+")).alias("name")).where("name <> ''").distinct()
    return N.resolve_alias(names, "name")


_TAGW = (r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\w\s-]', ' ', 'g'), '\s+'), "
         f"lambda w: length(w) >= 3 AND NOT list_contains({vlist(K.TAG_STOP_WORDS)}, w))")


def _top_sql(k):
    return f"""SELECT doc_id, string_agg(w, '{{sep}}' ORDER BY rk) AS words FROM (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS rk FROM (
    SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({_TAGW}) AS w FROM documents) GROUP BY ALL)) WHERE rk <= {k} GROUP BY doc_id"""


@query("p9_tags", "SELECT doc_id AS id, words AS tags FROM (" + _top_sql(5).format(sep=",") + ")")
def p9(spark, sf):
    return N.generate_tags(docs(spark, sf), "doc_id", "text")


@query("p9_titles", f"""WITH top AS ({_top_sql(5).format(sep=' ')}),
b AS (SELECT doc_id, text, regexp_replace(regexp_extract(text, '^[^.!?\\n]+[.!?]?'), '^\\s+|\\s+$', '', 'g') AS f FROM documents)
SELECT b.doc_id AS id, CASE WHEN length(f) BETWEEN 10 AND 80 THEN f WHEN words IS NOT NULL THEN substr(words, 1, 80)
  ELSE regexp_replace(regexp_replace(substr(text, 1, 80), '\\s+\\S*$', ''), '^\\s+|\\s+$', '', 'g') END AS title
FROM b LEFT JOIN top USING (doc_id)""")
def p9t(spark, sf):
    return N.generate_title(docs(spark, sf), "doc_id", "text")


@query("p10_tokens", "SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS tokens FROM documents")
def p10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", E.estimate_tokens("text").alias("tokens"))


_TOOLS = ["Read", "Write", "Edit", "Bash", "Agent"]


@query("p11_tool_tokens", """SELECT tool, CAST(sum(ceil(CASE WHEN tool IN ('Read','Write','WebFetch','Agent') THEN b ELSE b + c END / 4.0)) AS BIGINT) AS tokens
FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'Read' WHEN 1 THEN 'Write' WHEN 2 THEN 'Edit' WHEN 3 THEN 'Bash' ELSE 'Agent' END AS tool,
      octet_length(encode(props)) AS b, user_id AS c FROM events) GROUP BY tool""")
def p11(spark, sf):
    e = table(spark, sf, "events").select(pick(F.col("event_id") % 5, *_TOOLS).alias("tool"), "props", "user_id")
    t = e.select("tool", E.tool_tokens("tool", F.octet_length("props").cast("bigint"), "user_id").alias("t"))
    return t.groupBy("tool").agg(F.sum("t").alias("tokens"))


_AGE = f"(epoch(TIMESTAMP '{AS_OF}') - epoch(indexed_at)) / 86400.0e0"
_TIER = "CASE WHEN age < 7 THEN 0 WHEN age < 30 THEN 1 WHEN age < 90 THEN 2 ELSE 3 END"
_TIERED = sql(f"""tier_in AS (SELECT id, type, content, {_AGE} AS age, CAST({_IMP.format(ent='false')} AS DOUBLE) AS imp,
  list_has_any({_FLAGS}, ['DECISION', 'MILESTONE']) AS pinned FROM v_observations),
tiered AS (SELECT *, {vlist(K.TIERS)}[1 + CASE WHEN pinned THEN 0 WHEN imp >= 0.8 AND {_TIER} > 0 THEN {_TIER} - 1 ELSE {_TIER} END] AS tier FROM tier_in)
""", "v_observations").replace("\ntier_in", ",\ntier_in", 1)


def tiered(spark, sf):
    o = obs(spark, sf)
    o = o.withColumns({"age": E.days_between("indexed_at", ts(AS_OF)), "imp": E.importance("content", "type", F.lit(False)),
                       "pinned": E.pinned(E.significance_flags("content"))})
    return o.withColumn("tier", E.tier_name(E.tier_index("age", "imp", "pinned")))


@query("p12_compression_tier", _TIERED + "SELECT id, tier, pinned FROM tiered")
def p12(spark, sf):
    return tiered(spark, sf).select("id", "tier", "pinned")


_KEEP = W(K.KEEP_KEYWORDS)
_STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_SENT = lambda x: rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_LIGHT = (rf"array_to_string(flatten(list_transform(list_filter(regexp_split_to_array(content, '\n\s*\n'), lambda p: regexp_matches(p, '\S')), "
          rf"lambda p: list_filter(list_transform(list_filter({_SENT('p')}, lambda s: regexp_matches(s, '\S')), "
          rf"lambda s, i: CASE WHEN i = 1 OR regexp_matches(s, '{_KEEP}') THEN {_STRIP('s')} END), lambda s: s IS NOT NULL))), ' ')")
_DSENT = f"list_filter({_SENT('content')}, lambda s: length({_STRIP('s')}) > 10)"
_FACTS = f"list_slice(list_filter({_DSENT}, lambda s: regexp_matches(s, '{_KEEP}')), 1, 3)"
_DIST = (f"CASE WHEN len({_DSENT}) = 0 THEN substr(content, 1, 100) WHEN len({_FACTS}) > 0 THEN "
         f"array_to_string(list_transform({_FACTS}, lambda s: concat('• ', {_STRIP('s')})), chr(10)) ELSE concat('• ', {_STRIP(f'({_DSENT})[1]')}) END")


@query("p13_compress", _TIERED + f"""SELECT id, tier, sha256(body) AS body_sha, length(body) AS n_chars FROM (
SELECT id, tier, CASE tier WHEN 'verbatim' THEN content WHEN 'light' THEN {_LIGHT} WHEN 'medium' THEN substr(content, 1, 200) ELSE {_DIST} END AS body FROM tiered)""")
def p13(spark, sf):
    t = tiered(spark, sf).withColumn("body", E.compress("content", F.lit(None).cast("string"), "tier"))
    return t.select("id", "tier", F.sha2("body", 256).alias("body_sha"), F.length("body").cast("bigint").alias("n_chars"))


_BIN = r"len(regexp_extract_all(substr(text, 1, 512), '[\x00-\x08\x0b\x0c\x0e-\x1f]')) / greatest(length(substr(text, 1, 512)), 1)::DOUBLE > 0.1"
_T3 = """CASE WHEN n > {t} THEN concat('[', n, ' lines total]', chr(10), array_to_string(list_slice(ls, 1, {h}), chr(10)), chr(10), '... (', n - {t}, ' lines omitted) ...', chr(10),
    array_to_string(list_slice(ls, n - {l} + 1, n), chr(10)))
  WHEN length(text) <= {t} * 8 THEN text
  ELSE concat(substr(text, 1, {h} * 8), chr(10), '... (', length(text) - {t} * 8, ' chars omitted) ...', chr(10), right(text, {l} * 8)) END"""
_KNOWN = r"""regexp_matches(text, '(?i)Tests:\s.*total|PASS|FAIL|test suites?:') OR regexp_matches(text, '(?m)^(diff --git|---|\+\+\+|@@)')
 OR regexp_matches(text, 'added \d+ packages?|npm warn|npm ERR!')"""


def _trunc_sql(t):
    h = int(t * .6)
    return f"""SELECT doc_id, tier, CASE WHEN tier IN (3, 4) THEN sha256(body) END AS body_sha FROM (
SELECT doc_id, CAST(CASE WHEN {_BIN} THEN 4 WHEN coalesce(json_valid(text), false) THEN 1 WHEN {_KNOWN} THEN 2 ELSE 3 END AS INTEGER) AS tier,
 CASE WHEN {_BIN} THEN concat('[Binary content] sha256:', sha256(text), ' (', octet_length(encode(text)), ' bytes)') ELSE {_T3.format(t=t, h=h, l=t - h)} END AS body
FROM (SELECT *, string_split(text, chr(10)) AS ls, len(string_split(text, chr(10))) AS n FROM documents))"""


def _trunc(spark, sf, aggressive):
    t = E.truncate_cascade(docs(spark, sf), "text", aggressive)
    return t.select("doc_id", "tier", F.when(F.col("tier").isin(3, 4), F.sha2("truncated", 256)).alias("body_sha"))


@query("p14_truncate", _trunc_sql(1000))
def p14(spark, sf):
    return _trunc(spark, sf, False)


@query("p14_truncate_aggressive", _trunc_sql(400))
def p14a(spark, sf):
    return _trunc(spark, sf, True)


@query("p14_json_shape", """SELECT '[JSON schema] {k: number}' AS shape, count(*) AS n FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE')""")
def p14j(spark, sf):
    e = spread(table(spark, sf, "events").select("event_id", "props"), "event_id")
    return E.truncate_cascade(e, "props").groupBy(F.col("truncated").alias("shape")).agg(F.count("*").alias("n"))


def mixed_texts(spark, sf):
    """Documents and web pages as one corpus of (id, content)."""
    d = docs(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.col("text").alias("content"))
    p = spread(table(spark, sf, "pages"), "page_id").select(F.concat(F.lit("p"), F.col("page_id")).alias("id"), F.col("html").alias("content"))
    return d.unionByName(p)


@query("p15_content_type")
def p15(spark, sf):
    return mixed_texts(spark, sf).select("id", CT.content_type("content").alias("content_type"))


@query("u1_custom_summarizer", """
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, '\\| ') THEN 'pipe-table' ELSE 'other' END AS kind FROM documents
 UNION ALL SELECT CASE WHEN regexp_matches(html, '\\| ') THEN 'pipe-table' ELSE 'other' END FROM pages) GROUP BY kind""")
def u1(spark, sf):
    registry = CT.builtin().register("pipe-table", 50, detect=lambda c: c.rlike(r"\| "), apply=lambda c: F.substring(c, 1, 80))
    t = mixed_texts(spark, sf).select(registry.classify("content").alias("t"))
    return t.select(F.when(F.col("t") == "pipe-table", "pipe-table").otherwise("other").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_QTEXT = "on the whole thtionst estion"
_SNIP_SQL = rf"""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN len(ss) = 0 THEN substr(text, 1, 300)
 ELSE substr({_STRIP("list_reduce(list_transform(ss, lambda s, i: {'n': n_of[i], 'p': -i, 's': s}), lambda a, b: CASE WHEN b.n > a.n THEN b ELSE a END).s")}, 1, 300) END AS snippet
FROM (SELECT *, list_transform(ss, lambda s: CAST(contains(lower(s), 'the') AS INT) + CAST(contains(lower(s), 'whole') AS INT) + CAST(contains(lower(s), 'thtionst') AS INT)
   + CAST(contains(lower(s), 'estion') AS INT)) AS n_of
 FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[.!?\n]+'), lambda s: length({_STRIP('s')}) > 10) AS ss FROM documents))"""


@query("p16_best_snippet", _SNIP_SQL)
def p16(spark, sf):
    return docs(spark, sf).select("doc_id", E.best_snippet("text", F.lit(_QTEXT)).alias("snippet"))


@query("p17_context_snippet", """SELECT doc_id, CASE WHEN length(text) <= 350 THEN text ELSE
 concat(CASE WHEN st > 0 THEN '...' ELSE '' END, substr(text, st + 1, en - st), CASE WHEN en < length(text) THEN '...' ELSE '' END) END AS snippet
FROM (SELECT *, greatest(0, a - 120) AS st, least(length(text), a + 120) AS en FROM (
  SELECT doc_id, text, coalesce(list_min(list_filter([strpos(lower(text), w) FOR w IN ['the', 'whole', 'thtionst', 'estion']], lambda x: x > 0)) - 1, 0) AS a FROM documents))""")
def p17(spark, sf):
    return docs(spark, sf).select("doc_id", E.context_snippet("text", F.lit(_QTEXT)).alias("snippet"))


_PRIO = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {p}" for t, p in K.EVENT_PRIORITIES.items()) + " ELSE 4 END"


@query("p18_event_filter", sql(f"""SELECT id, session_id, event_type, CAST(epoch_us(ts) AS BIGINT) AS ts_us FROM v_events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-12 00:00:00' AND event_type IN ('error', 'file_modify') AND {_PRIO} <= 2""", "v_events"))
def p18(spark, sf):
    e = events(spark, sf)
    e = e.where((F.col("ts") >= ts("2024-01-05 00:00:00")) & (F.col("ts") <= ts("2024-01-12 00:00:00")))
    e = e.where(F.col("event_type").isin("error", "file_modify") & (E.event_priority("event_type") <= 2))
    return e.select("id", "session_id", "event_type", F.unix_micros("ts").alias("ts_us"))


@query("p18_timeline_filter", sql("""SELECT id, type, session_id FROM v_observations WHERE indexed_at >= TIMESTAMP '2024-02-01 00:00:00'
AND indexed_at <= TIMESTAMP '2024-03-01 00:00:00' AND type = 'error'""", "v_observations"))
def p18t(spark, sf):
    o = observations(spark, sf)
    o = o.where((F.col("indexed_at") >= ts("2024-02-01 00:00:00")) & (F.col("indexed_at") <= ts("2024-03-01 00:00:00")) & (F.col("type") == "error"))
    return o.select("id", "type", "session_id")


_UNITS = ["seconds", "minute", "hours", "day", "weeks", "month"]


@query("p19_relative_date", f"""SELECT event_id, CAST(epoch_us(CASE WHEN m = 6 THEN ts - INTERVAL 1 DAY WHEN m = 7 THEN ts - INTERVAL 7 DAY WHEN m = 8 THEN ts - INTERVAL 30 DAY
 WHEN m = 9 THEN TIMESTAMP '2024-01-15 10:00:00' WHEN m = 10 THEN NULL
 ELSE ts - INTERVAL 1 SECOND * (user_id * [1, 60, 3600, 86400, 604800, 2592000][m + 1]) END) AS BIGINT) AS at_us
FROM (SELECT event_id, ts, user_id, event_id % 11 AS m FROM events)""")
def p19(spark, sf):
    e = table(spark, sf, "events")
    m, n = F.col("event_id") % 11, F.col("user_id").cast("string")
    rel = F.concat(n, F.lit(" "), pick(m, *_UNITS), F.lit(" ago"))
    text = (F.when(m == 6, " Yesterday").when(m == 7, "last week").when(m == 8, "Last Month").when(m == 9, "2024-01-15 10:00:00")
            .when(m == 10, "some day").otherwise(rel))
    return e.select("event_id", F.unix_micros(L.parse_relative_date(text, "ts")).alias("at_us"))


_TQ = ["{n} days ago", "{n} weeks ago", "{n} months ago", "what did we do last Friday", "a couple of days ago",
       "was it a week ago", "three weeks ago", "nothing here"]


@query("p20_temporal_keywords", """WITH e AS (SELECT event_id, CAST(ts AS DATE) AS d, user_id % 40 AS n, event_id % 8 AS m FROM events),
t AS (SELECT event_id, m, CASE m WHEN 0 THEN d - CAST(n AS INTEGER) WHEN 1 THEN d - CAST(n * 7 AS INTEGER) WHEN 2 THEN CAST(d - INTERVAL 1 MONTH * n AS DATE)
  WHEN 3 THEN d - CAST(CASE WHEN dayofweek(d) - 5 <= 0 THEN dayofweek(d) + 2 ELSE dayofweek(d) - 5 END AS INTEGER)
  WHEN 4 THEN d - 2 WHEN 5 THEN d - 7 WHEN 6 THEN d - 21 END AS x FROM e)
SELECT event_id, CASE WHEN m = 7 THEN '' WHEN m <= 2 THEN lower(strftime(x, '%B')) || ',' || day(x) || ',' || year(x) || ',' || lower(strftime(x, '%b'))
 WHEN m = 3 THEN lower(strftime(x, '%B')) || ',' || day(x) || ',' || year(x) ELSE lower(strftime(x, '%B')) || ',' || day(x) END AS terms FROM t""")
def p20(spark, sf):
    e = table(spark, sf, "events")
    n = (F.col("user_id") % 40).cast("string")
    text = pick(F.col("event_id") % 8, *_TQ)
    text = F.when(F.contains(text, F.lit("{n}")), F.concat(n, F.substring(text, 4, 100))).otherwise(text)
    return e.select("event_id", F.array_join(L.temporal_keywords(text, "ts"), ",").alias("terms"))


_KW = (r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\w\s]', ' ', 'g'), '\s+'), "
       f"lambda w: length(w) >= 3 AND NOT list_contains({vlist(K.SEARCH_STOP_WORDS)}, w))")


@query("p21_search_keywords", f"SELECT item_id, array_to_string({_KW}, ' ') AS keywords FROM benchmark")
def p21(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(L.search_keywords("text"), " ").alias("keywords"))


_MN = L._MON
_QE = r"""list_filter(flatten([
 list_transform(regexp_extract_all(text, '\s([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)', 1), lambda x: x),
 CASE WHEN regexp_extract(text, '^[A-Z][a-z]+') <> '' AND NOT list_contains({stop}, lower(regexp_extract(text, '^[A-Z][a-z]+'))) THEN [regexp_extract(text, '^[A-Z][a-z]+')] ELSE []::VARCHAR[] END,
 regexp_extract_all(text, '(?i)\b\d{{1,2}}\s+{m}\s*,?\s*\d{{2,4}}\b'), regexp_extract_all(text, '(?i)\b{m}\s+\d{{1,2}}\s*,?\s*\d{{2,4}}\b'),
 regexp_extract_all(text, '(?i)\b{m}\s+\d{{4}}\b'),
 regexp_extract_all(text, '(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\b'),
 regexp_extract_all(text, '\b(?:19|20)\d{{2}}\b'), regexp_extract_all(text, '(?i)\b(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)\b'),
 regexp_extract_all(text, '(?i)\b\d+\s+(?:days?|weeks?|months?|years?|hours?|minutes?)\b')]), lambda e: length(e) >= 2)""".format(
    stop=vlist(K.SEARCH_STOP_WORDS), m=_MN)


@query("p21_query_entities", f"SELECT conv_id, turn, array_to_string({_QE}, '|') AS entities FROM conversations")
def p21e(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(L.query_entities("text"), "|").alias("entities"))


_LEADS = ["Why did it fail:", "when was", "Which one is best", "how to find", "Tell me of", "should I use"]
_LEADED = "(SELECT item_id, concat(" + vlist(_LEADS) + "[item_id % 6 + 1], ' ', text) AS t, text FROM benchmark)"
_ANYW = lambda ws: f"list_has_any(ws, {vlist(ws)})"


def leaded(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.concat(pick(F.col("item_id") % 6, *_LEADS), F.lit(" "), F.col("text")).alias("t"))


@query("p22_search_intent", rf"""SELECT item_id, CASE WHEN {_ANYW(K.CAUSAL_SIGNALS)} THEN 'causal' WHEN {_ANYW(K.TEMPORAL_SIGNALS)} THEN 'temporal'
 WHEN {_ANYW(K.RECOMMENDATION_SIGNALS)} OR regexp_matches(t, '(?i)\bshould\s+i\b') THEN 'recommendation' WHEN {_ANYW(K.LOOKUP_SIGNALS)} THEN 'lookup' ELSE 'general' END AS intent
FROM (SELECT item_id, t, regexp_split_to_array(lower(t), '\s+') AS ws FROM {_LEADED})""")
def p22(spark, sf):
    return leaded(spark, sf).select("item_id", L.search_intent("t").alias("intent"))


_QI = "CASE " + " ".join(f"WHEN lower(t) LIKE '{w}%' OR contains(lower(t), '{w} ') THEN '{w}'" for w in ["what", "when", "who", "why", "how"]) + " ELSE 'general' END"
_QT = (r"list_filter(regexp_split_to_array(regexp_replace(lower(t), '[?!.,;:''\"()\[\]{}]', '', 'g'), '\s+'), "
       f"lambda w: length(w) > 2 AND NOT list_contains({vlist(K.QUESTION_STOP_WORDS)}, w))")


@query("p23_question_intent", f"SELECT item_id, {_QI} AS intent, array_to_string({_QT}, ' ') AS terms FROM {_LEADED}")
def p23(spark, sf):
    return leaded(spark, sf).select("item_id", L.question_intent("t").alias("intent"), F.array_join(L.question_terms("t"), " ").alias("terms"))


@query("p24_event_priority", sql(f"""SELECT priority, count(*) AS n, CAST(sum(b) AS BIGINT) AS context_bytes FROM (
 SELECT CAST({_PRIO} AS INTEGER) AS priority, b FROM v_events JOIN (SELECT event_id, octet_length(encode(props)) AS b FROM events) ON id = event_id) GROUP BY priority""", "v_events"))
def p24(spark, sf):
    e = events(spark, sf, "props").select(E.event_priority("event_type").alias("priority"), F.octet_length("props").cast("bigint").alias("b"))
    return e.groupBy("priority").agg(F.count("*").alias("n"), F.sum("b").alias("context_bytes"))


def actions(spark, sf):
    """Tool actions derived from line items: a tool, and a path or a command."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    m = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    path = F.concat(F.lit("src/s"), F.col("l_suppkey"), F.lit("/"), F.lower("l_returnflag"), F.lit("/p"), F.col("l_partkey"), F.lit(".ts"))
    tool = pick(m, "Read", "Edit", "Write", "Bash", "Agent")
    cmd = pick(F.col("l_partkey") % 3, "npm test", "npm run build", "ls -la")
    return li.select("l_orderkey", "l_linenumber", tool.alias("tool"), F.when(m < 3, path).alias("path"), F.when(m == 3, cmd).alias("command"))


@query("p25_file_query", """SELECT query, count(*) AS n FROM (SELECT CASE WHEN m < 2 THEN concat('p', l_partkey, ' s', l_suppkey, ' ', lower(l_returnflag))
 WHEN m = 2 THEN concat('conventions s', l_suppkey, ' ', lower(l_returnflag))
 WHEN m = 3 AND l_partkey % 3 = 0 THEN 'test failures known issues' WHEN m = 3 AND l_partkey % 3 = 1 THEN 'build errors dependencies' END AS query
FROM (SELECT *, (l_orderkey + l_linenumber) % 5 AS m FROM lineitem)) GROUP BY query""")
def p25(spark, sf):
    from ..functions.actions import file_query

    a = actions(spark, sf)
    return a.groupBy(file_query("tool", "path", "command").alias("query")).agg(F.count("*").alias("n"))
