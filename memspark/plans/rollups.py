"""Registered queries: text roll-ups (X).

Where the tables hold no text of a format, Spark writes it from their rows, one
line or one report per row, so the work still grows with the tables.
"""

from pyspark.sql import functions as F

from ..functions.text import lines
from ..operators import rollups as R
from ..session import spread
from ..views import pick, table
from .registry import query

c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


_TEMPL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line,
 '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?', '<TIMESTAMP>', 'g'), '\d{4}-\d{2}-\d{2}', '<DATE>', 'g'),
 '\d{2}:\d{2}:\d{2}(?:\.\d+)?', '<TIME>', 'g'), '\b\d{10,13}\b', '<TS>', 'g'), '^\s+|\s+$', '', 'g')"""
_LINES = "l AS (SELECT doc_id AS doc, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"


@query("x1_log_templates", f"""WITH {_LINES} SELECT sha256(t) AS template_sha, count(*) AS n FROM (SELECT {_TEMPL} AS t FROM l) GROUP BY t""")
def x1(spark, sf):
    t = R.template_counts(R.explode_lines(docs(spark, sf), "doc_id", "text"), [])
    return t.select(F.sha2("template", 256).alias("template_sha"), "n")


@query("x1_log_digest", f"""WITH {_LINES}, t AS (SELECT doc, {_TEMPL} AS t, count(*) AS n, min(pos) AS p, arg_min(line, pos) AS f FROM l GROUP BY 1, 2)
SELECT doc, sha256(string_agg(CASE WHEN n > 1 THEN concat('[×', n, '] ', f) ELSE f END, chr(10) ORDER BY p)) AS digest_sha FROM t GROUP BY doc""")
def x1d(spark, sf):
    return R.template_text(R.explode_lines(docs(spark, sf), "doc_id", "text")).select("doc", F.sha2("digest", 256).alias("digest_sha"))


_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH"]
_STATUS = ["200", "201", "304", "404", "500"]


def access_lines(spark, sf):
    e = table(spark, sf, "events")
    line = c("10.0.", (F.col("user_id") % 256).cast("string"), ".7 - - [", F.date_format("ts", "dd/MM/yyyy:HH:mm:ss"), ' +0000] "',
             pick(F.col("user_id") % 5, *_METHODS), " /", F.col("event_type"), "/", (F.col("user_id") % 40).cast("string"), ' HTTP/1.1" ',
             pick(F.col("event_id") % 5, *_STATUS), " ", (F.col("event_id") * 13 % 5000).cast("string"), ' "-" "ua"')
    return e.select(F.lit(0).alias("doc"), F.col("event_id").alias("pos"), line.alias("line"))


_ACC = f"""a AS (SELECT {_METHODS!r}[user_id % 5 + 1] AS m, concat('/', event_type, '/', user_id % 40) AS p, {_STATUS!r}[event_id % 5 + 1] AS s, event_id * 13 % 5000 AS b FROM events)"""


@query("x2_access_log", f"""WITH {_ACC}, e AS (SELECT concat(m, ' ', p) AS key, count(*) AS n FROM a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
SELECT 'method' AS dimension, m AS key, count(*) AS n FROM a GROUP BY m UNION ALL SELECT 'status', concat(s[1], 'xx'), count(*) FROM a GROUP BY 2
UNION ALL SELECT 'endpoint', key, n FROM e UNION ALL SELECT 'bytes', 'total', CAST(sum(b) AS BIGINT) FROM a""")
def x2(spark, sf):
    return R.access_log(access_lines(spark, sf))


@query("x3_network", f"""WITH {_ACC}
SELECT 'method' AS dimension, m AS key, count(*) AS n FROM a GROUP BY m UNION ALL SELECT 'status', concat(s[1], 'xx'), count(*) FROM a GROUP BY 2
UNION ALL SELECT 'unique_endpoints', 'total', count(DISTINCT concat('/api', p)) FROM a""")
def x3(spark, sf):
    e = table(spark, sf, "events")
    line = c("[", pick(F.col("user_id") % 5, *_METHODS), "] ", pick(F.col("user_id") % 5, *_METHODS), " /api/", F.col("event_type"), "/",
             (F.col("user_id") % 40).cast("string"), " => [", pick(F.col("event_id") % 5, *_STATUS), "]")
    # each method is printed twice (as a tag and before its path): halve the tag by matching path lines only
    line = F.regexp_replace(line, r"^\[[A-Z]+\] ", "> ")
    return R.network(e.select(line.alias("line")))


_ERR_TYPES = ["TypeError", "ValueError", "RangeError"]


def stack_texts(spark, sf):
    """One error report per order: two stack styles and a plain one."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    k, m = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 3
    et = pick(F.col("o_custkey") % 3, *_ERR_TYPES)
    js = c(et, ": bad value ", k, "\n    at f1 (/app/a", k, ".js:1:2)\n    at f2 (/app/b.js:3:4)\n    at f3 (/app/c.js:5:6)\n    at f4 (/app/d.js:7:8)")
    py = c("Traceback (most recent call last):\n  File \"/app/m", k, ".py\", line 3, in f\n    g()\n  File \"/app/n.py\", line 9, in g\n", et, ": no ", k, "\n")
    plain = c("starting\nsome error in step ", k, "\nend")
    return o.select("o_orderkey", F.when(m == 0, js).when(m == 1, py).otherwise(plain).alias("text"))


@query("x4_error_digest", f"""SELECT o_orderkey AS id, ['stacktrace','traceback','error'][m + 1] AS style, CASE WHEN m < 2 THEN et END AS error_type,
 CASE m WHEN 0 THEN concat('bad value ', o_orderkey) WHEN 1 THEN concat('no ', o_orderkey) ELSE concat('some error in step ', o_orderkey) END AS message,
 CASE m WHEN 0 THEN concat('at f1 (/app/a', o_orderkey, '.js:1:2) | at f2 (/app/b.js:3:4) | at f3 (/app/c.js:5:6)')
  WHEN 1 THEN concat('File "/app/m', o_orderkey, '.py", line 3, in f | File "/app/n.py", line 9, in g') ELSE '' END AS frames
FROM (SELECT o_orderkey, o_orderkey % 3 AS m, {_ERR_TYPES!r}[o_custkey % 3 + 1] AS et FROM orders)""")
def x4(spark, sf):
    return R.error_digest(stack_texts(spark, sf), "o_orderkey", "text")


@query("x4_errors_by_type", f"""SELECT style, error_type, count(*) AS n FROM (SELECT ['stacktrace','traceback','error'][o_orderkey % 3 + 1] AS style,
 CASE WHEN o_orderkey % 3 < 2 THEN {_ERR_TYPES!r}[o_custkey % 3 + 1] END AS error_type FROM orders) GROUP BY ALL""")
def x4b(spark, sf):
    return R.error_digest(stack_texts(spark, sf), "o_orderkey", "text").groupBy("style", "error_type").agg(F.count("*").alias("n"))


@query("x5_compiler_errors", """WITH f AS (SELECT concat('src/s', l_suppkey, '.ts') AS key, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
k AS (SELECT concat('TS', 2000 + l_partkey % 37) AS key, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT 'file' AS dimension, * FROM f UNION ALL SELECT 'code', * FROM k""")
def x5(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", "l_returnflag")
    bad = c("src/s", F.col("l_suppkey").cast("string"), ".ts(", F.col("l_partkey").cast("string"), ",", F.col("l_linenumber").cast("string"),
            "): error TS", (F.col("l_partkey") % 37 + 2000).cast("string"), ": Type '", F.col("l_returnflag"), "' is not assignable.")
    return R.compiler_errors(li.select(F.when(F.col("l_returnflag") != "N", bad).otherwise("Found no errors here.").alias("line")))


@query("x6_test_runs", """SELECT o_orderkey AS id, o_custkey % 50 AS passed, o_orderkey % 4 AS failed, o_orderkey % 3 AS skipped, o_custkey % 50 + o_orderkey % 4 + o_orderkey % 3 AS total,
 o_orderkey % 7 AS suites, concat(o_custkey % 9, '.5 s') AS duration, CASE WHEN o_orderkey % 4 > 0 THEN concat('suite/t', o_custkey, '.test.ts') ELSE '' END AS failed_names FROM orders""")
def x6(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    s = lambda e: e.cast("string")
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    text = c(F.when(k % 4 > 0, c("FAIL suite/t", s(u), ".test.ts\n")).otherwise("PASS all\n"), "Test Suites: ", s(k % 2), " failed, ", s(k % 7), " total\nTests: ",
             s(k % 4), " failed, ", s(k % 3), " skipped, ", s(u % 50), " passed, ", s(u % 50 + k % 4 + k % 3), " total\nTime: ", s(u % 9), ".5 s\n")
    return R.test_run(o.select("o_orderkey", text.alias("text")), "o_orderkey", "text")


@query("x6_test_totals", """SELECT CAST(sum(o_custkey % 50) AS BIGINT) AS passed, CAST(sum(o_orderkey % 4) AS BIGINT) AS failed, count(*) AS runs FROM orders""")
def x6t(spark, sf):
    return x6(spark, sf).agg(F.sum("passed").alias("passed"), F.sum("failed").alias("failed"), F.count("*").alias("runs"))


@query("x7_build_output", """SELECT p_partkey AS id, concat(p_size, '.2 s') AS build_time, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS warnings,
 concat('/a', p_size, '|/b') AS routes, concat('main.js: ', p_size, ' kB|vendor.js: 12.5 MB') AS bundles FROM part""")
def x7(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    s = F.col("p_size").cast("string")
    text = c("Compiling\nwarning: old\n", F.when(F.col("p_size") % 2 == 0, "Warning: older\n").otherwise(""), "Route /a", s, "\nRoute /b\nGET /a", s,
             "\nmain.js - ", s, " kB\nvendor.js: 12.5 MB\nbuilt in ", s, ".2 s\n")
    return R.build_output(p.select("p_partkey", text.alias("text")), "p_partkey", "text")


_TYPES = ["feat", "fix", "docs", "chore", "refactor"]


def commit_lines(spark, sf):
    """Four lines per order, newest order first, one log per order status."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    body = F.array(c("commit ", F.sha1(k.cast("string"))), c("Author: u", (F.col("o_custkey") % 25).cast("string"), " <x>"),
                   c("Date:   ", F.date_format("o_orderdate", "yyyy-MM-dd")), c("    ", pick(k % 5, *_TYPES), ": change ", k.cast("string")))
    return o.select(F.col("o_orderstatus").alias("doc"), (-k * 4).alias("base"), F.posexplode(body).alias("i", "line")).select(
        "doc", (F.col("base") + F.col("i")).alias("pos"), "line")


@query("x8_commit_log", """SELECT o_orderstatus AS doc, count(*) AS commits, count(DISTINCT o_custkey % 25) AS authors,
 strftime(arg_min(o_orderdate, o_orderkey), '%Y-%m-%d') AS from_date, strftime(arg_max(o_orderdate, o_orderkey), '%Y-%m-%d') AS to_date FROM orders GROUP BY 1""")
def x8(spark, sf):
    return R.commit_log(commit_lines(spark, sf), ["doc"])


@query("x8_commit_types", f"""SELECT o_orderstatus AS doc, {_TYPES!r}[o_orderkey % 5 + 1] AS type, count(*) AS n FROM orders GROUP BY ALL""")
def x8t(spark, sf):
    return R.commit_types(commit_lines(spark, sf), ["doc"])


@query("x9_csv_profile", """WITH l AS (SELECT l_returnflag AS doc, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_linestatus) AS rk,
 concat(l_orderkey, ',', l_linenumber, ',', l_linestatus) AS line FROM lineitem)
SELECT doc, count(*) AS rows, 3::BIGINT AS columns, replace(max(CASE WHEN rk = 1 THEN line END), ',', ' | ') AS headers, string_agg(line, '|' ORDER BY rk) FILTER (rk BETWEEN 2 AND 4) AS sample
FROM l GROUP BY doc""")
def x9(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_linestatus")
    return R.csv_profile(li.select(F.col("l_returnflag").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
                                   F.concat_ws(",", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "l_linestatus").alias("line")))


@query("x10_json_profile", """SELECT path, type, NULL::BIGINT AS length, n FROM (VALUES ('$', 'object'), ('$.k', 'number')) t(path, type) CROSS JOIN (SELECT count(*) AS n FROM events)""")
def x10(spark, sf):
    return R.json_profile(table(spark, sf, "events").select("props"), "props")


@query("x10_json_nested", """SELECT path, type, NULL::BIGINT AS length, n FROM (VALUES ('$', 'object'), ('$.id', 'number'), ('$.cust', 'object'), ('$.cust.id', 'number'), ('$.status', 'string')) t(path, type) CROSS JOIN (SELECT count(*) AS n FROM orders)
UNION ALL SELECT '$.cust.tags', 'array', o_orderkey % 4, count(*) FROM orders GROUP BY o_orderkey % 4
UNION ALL SELECT '$.rows', 'array', o_custkey % 3, count(*) FROM orders GROUP BY o_custkey % 3
UNION ALL SELECT path, type, length, n FROM (VALUES ('$.rows.n', 'number', NULL::BIGINT), ('$.rows.l', 'array', 2)) t(path, type, length) CROSS JOIN (SELECT count(*) AS n FROM orders WHERE o_custkey % 3 > 0)""")
def x10n(spark, sf):
    """Objects, arrays of several lengths, empty ones too, and arrays of objects with arrays."""
    o = table(spark, sf, "orders")
    tags = F.array_repeat("o_orderpriority", (F.col("o_orderkey") % 4).cast("int"))
    rows = F.array_repeat(F.struct(F.lit(1).alias("n"), F.array(F.lit(1), F.lit(2)).alias("l")), (F.col("o_custkey") % 3).cast("int"))
    j = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("id"), tags.alias("tags")).alias("cust"), F.col("o_orderstatus").alias("status"), rows.alias("rows")))
    return R.json_profile(o.select(j.alias("j")), "j")


@query("x11_html_outline", r"""WITH h AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?i)<h1[^>]*>.*?</h1>|<h2[^>]*>.*?</h2>|<h3[^>]*>.*?</h3>|<h4[^>]*>.*?</h4>|<h5[^>]*>.*?</h5>|<h6[^>]*>.*?</h6>'),
  lambda x: concat('h', x[3], ': ', regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g'))) AS hs,
 list_transform(regexp_extract_all(html, '(?i)<nav[^>]*>([\s\S]*?)</nav>', 1), lambda x: substr(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 200)) AS nv FROM pages)
SELECT p.page_id AS id, CASE WHEN regexp_matches(html, '(?i)<title[^>]*>(.*?)</title>') THEN regexp_replace(regexp_extract(html, '(?i)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g') ELSE '(no title)' END AS title,
 array_to_string(hs, '|') AS headings, array_to_string(nv, '|') AS nav, len(regexp_extract_all(html, '(?i)<form[\s>]'))::BIGINT AS forms, length(html) AS n_chars FROM pages p JOIN h USING (page_id)""")
def x11(spark, sf):
    return R.html_outline(spread(table(spark, sf, "pages").select("page_id", "html"), "page_id"), "page_id", "html")


def markdown_texts(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    k = F.col("o_orderkey").cast("string")
    t = c("intro ", k, "\n# Title ", k, "\ntext [a](b", k, ") and [c](d)\n## Part ", F.col("o_orderpriority"), "\n```js\nx = 1\n```\n", F.when(F.col("o_custkey") % 2 == 0, "#not a heading\n").otherwise(""), "end")
    return o.select("o_orderkey", t.alias("text"))


@query("x12_markdown_outline", """SELECT o_orderkey AS id, concat('Title ', o_orderkey) AS title, concat('# Title ', o_orderkey, '|## Part ', o_orderpriority) AS headings,
 1::BIGINT AS code_blocks, 2::BIGINT AS links, CASE WHEN o_custkey % 2 = 0 THEN 9 ELSE 8 END::BIGINT AS lines FROM orders""")
def x12(spark, sf):
    return R.markdown_outline(markdown_texts(spark, sf), "o_orderkey", "text")


def code_texts(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    js = c("import a from 'a", k, "'\nexport function f", k, "(x) {\n  return x\n}\nconst v = ", s, "\n  const inner = 1\nclass K", k, " extends B {\n}\n")
    py = c("import os\n@cached\n@traced\ndef f", k, "(a: int) -> int:\n    return a\n@lonely\nx = ", s, "\nclass K", k, ":\n    pass\n")
    return p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, js).otherwise(py).alias("text"))


@query("x13_code_outline", """SELECT p_partkey AS doc, language, CAST(pos AS INTEGER) AS pos, replace(sig, '#', CAST(p_partkey AS VARCHAR)) AS signature
FROM part JOIN (VALUES (0, 'js-ts', 0, 'import a from ''a#'''), (0, 'js-ts', 1, 'export function f#(x) {'), (0, 'js-ts', 4, NULL), (0, 'js-ts', 6, 'class K# extends B {'),
 (1, 'python', 0, 'import os'), (1, 'python', 1, '@cached'), (1, 'python', 2, '@traced'), (1, 'python', 3, 'def f#(a: int) -> int:'), (1, 'python', 7, 'class K#:')) t(m, language, pos, s)
ON p_partkey % 2 = m, LATERAL (SELECT coalesce(s, concat('const v = ', p_size)) AS sig)""")
def x13(spark, sf):
    return R.code_outline(R.explode_lines(code_texts(spark, sf), "p_partkey", "text"))


@query("x14_head_tail", """SELECT doc_id, sha256(CASE WHEN n < 20 THEN text ELSE concat('[', n, ' lines total]', chr(10), array_to_string(list_slice(ls, 1, 10), chr(10)), chr(10), '... (', n - 20, ' lines omitted) ...', chr(10),
 array_to_string(list_slice(ls, n - 9, n), chr(10))) END) AS digest_sha FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls, len(string_split(text, chr(10))) AS n FROM documents)""")
def x14(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(R.head_tail("text"), 256).alias("digest_sha"))


@query("x15_binary_digest", r"""SELECT doc_id, concat('[binary content] sha256:', sha256(text), ' size:', octet_length(encode(text)), ' bytes') AS digest FROM documents
WHERE len(regexp_extract_all(substr(text, 1, 512), '[^\t\n\r -~]')) / greatest(length(substr(text, 1, 512)), 1)::DOUBLE > 0.1""")
def x15(spark, sf):
    return docs(spark, sf).select("doc_id", R.unprintable_digest("text").alias("digest")).where("digest is not null")
