"""Roll-ups of logs and tool output, as corpus jobs over lines.

Inputs are frames of lines ``(doc, pos, line)``; :func:`explode_lines` makes one
from whole texts, ``spark.read.text`` from files. Everything is extract, filter
and two-phase aggregation, so a single hot document or template is combined on
the map side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions.text import NOT_AFTER, NOT_BEFORE, col, extract_all, first_group, lines, strip, valid_json, word
from .content_types import ACCESS_LINE


def explode_lines(df: DataFrame, id_: str, text: str) -> DataFrame:
    return df.select(F.col(id_).alias("doc"), F.posexplode(lines(text)).alias("pos", "line"))


def log_template(line) -> Column:
    """The line with date-times, dates, times and epoch numbers replaced by placeholders."""
    c = col(line)
    for pattern, put in [
        (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?", "<TIMESTAMP>"),
        (r"\d{4}-\d{2}-\d{2}", "<DATE>"), (r"\d{2}:\d{2}:\d{2}(?:\.\d+)?", "<TIME>"),
        (f"{NOT_BEFORE}\\d{{10,13}}{NOT_AFTER}", "<TS>"),
    ]:
        c = F.regexp_replace(c, pattern, put)
    return strip(c)


def template_counts(ls: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and template: count, first line and where it was first seen."""
    ls = ls.withColumn("template", log_template("line"))
    return ls.groupBy(*keys, "template").agg(
        F.count("*").alias("n"), F.min(F.struct("pos", "line")).alias("f"),
    ).select(*keys, "template", "n", F.col("f.line").alias("first_line"), F.col("f.pos").alias("first_pos"))


def template_text(ls: DataFrame) -> DataFrame:
    """Each document's templates in first-seen order, repeats marked with their count."""
    t = template_counts(ls, ["doc"])
    shown = F.when(F.col("n") > 1, F.concat(F.lit("[×"), F.col("n"), F.lit("] "), F.col("first_line"))).otherwise(F.col("first_line"))
    rows = F.array_sort(F.collect_list(F.struct("first_pos", shown.alias("t"))))
    return t.groupBy("doc").agg(F.array_join(F.transform(rows, lambda s: s["t"]), "\n").alias("digest"))


def _top(counts: DataFrame, key: str, n: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), key).limit(n)


def counts_by(df: DataFrame, dims: dict[str, Column], limits: dict[str, int] | None = None) -> DataFrame:
    """(dimension, key, n) for several dimensions from one scan of the lines."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), c.alias("key")) for d, c in dims.items()])
    c = (df.select(F.explode(pairs).alias("p")).select("p.*").where("key is not null")
         .groupBy("dimension", "key").agg(F.count("*").alias("n")))
    if not limits:
        return c
    w = Window.partitionBy("dimension").orderBy(F.desc("n"), "key")
    cap = F.lit(None).cast("int")
    for d, k in limits.items():
        cap = F.when(F.col("dimension") == d, k).otherwise(cap)
    # a constant bound, so that every task keeps only so many keys of a dimension before they meet
    best = c.where(F.col("dimension").isin(*limits)).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= max(limits.values())).where(F.col("rk") <= cap).drop("rk")
    rest = [d for d in dims if d not in limits]
    return best.unionByName(c.where(F.col("dimension").isin(*rest))) if rest else best


def access_log(ls: DataFrame, top: int = 20) -> DataFrame:
    """Requests by method, status class and endpoint (``top``), and bytes moved."""
    g = lambda i: F.regexp_extract("line", ACCESS_LINE, i)
    hit = ls.where(F.col("line").rlike(ACCESS_LINE)).select(
        g(1).alias("method"), g(2).alias("path"), g(3).alias("status"), g(4).cast("bigint").alias("bytes"))
    dims = counts_by(hit, {
        "method": F.col("method"), "status": F.concat(F.substring("status", 1, 1), F.lit("xx")),
        "endpoint": F.concat_ws(" ", "method", "path")}, {"endpoint": top})
    total = hit.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).select(F.lit("bytes").alias("dimension"), F.lit("total").alias("key"), "n")
    return dims.unionByName(total)


def network(ls: DataFrame) -> DataFrame:
    """Methods, status classes and unique endpoints found anywhere in the text."""
    methods = extract_all("line", NOT_BEFORE + "(GET|POST|PUT|DELETE|PATCH)" + NOT_AFTER, 1)
    statuses = F.transform(extract_all("line", NOT_BEFORE + r"([2-5]\d{2})" + NOT_AFTER, 1), lambda s: F.concat(F.substring(s, 1, 1), F.lit("xx")))
    ends = extract_all("line", r"(?:GET|POST|PUT|DELETE|PATCH)\s+(/\S+)", 1)
    tag = lambda d, a: F.transform(a, lambda k: F.struct(F.lit(d).alias("dimension"), k.alias("key")))
    c = (ls.select(F.explode(F.concat(tag("method", methods), tag("status", statuses), tag("endpoint", ends))).alias("p"))
         .select("p.*").groupBy("dimension", "key").agg(F.count("*").alias("n")))
    unique = c.where("dimension = 'endpoint'").agg(F.count("*").alias("n")).select(
        F.lit("unique_endpoints").alias("dimension"), F.lit("total").alias("key"), "n")
    return c.where("dimension <> 'endpoint'").unionByName(unique)


def error_digest(df: DataFrame, id_: str, text: str, max_frames: int = 3) -> DataFrame:
    """(id, style, error_type, message, frames): both stack styles, else the first error-like line."""
    c = F.col(text)
    ls = F.transform(lines(c), lambda x: strip(x))
    py = c.rlike(r"Traceback \(most recent call last\):")
    js = c.rlike(r"(?m)^\s+at\s+")
    full = F.filter(ls, lambda x: x != "")
    py_line = F.coalesce(F.try_element_at(full, F.lit(-1)), F.lit(""))
    js_line = F.coalesce(F.get(F.filter(ls, lambda x: x.rlike(r"^\w*Error[:\s]")), F.lit(0)), F.get(ls, F.lit(0)))
    plain = F.coalesce(F.get(F.filter(ls, lambda x: x.rlike("(?i)error|exception|fatal|panic")), F.lit(0)), F.get(ls, F.lit(0)))
    py_re, js_re = r"^(\w+(?:Error|Exception|Warning|Interrupt|Exit)):\s*(.*)", r"^(\w*Error):\s*(.*)"
    frames = F.when(py, F.filter(ls, lambda x: x.rlike(r'^File ".+", line \d+'))).otherwise(F.filter(ls, lambda x: x.rlike(r"^at\s+")))
    return df.select(
        F.col(id_).alias("id"),
        F.when(py, "traceback").when(js, "stacktrace").otherwise("error").alias("style"),
        F.when(py, F.coalesce(first_group(py_line, py_re, 1), F.lit("Exception")))
        .when(js, F.coalesce(first_group(js_line, js_re, 1), F.lit("Error"))).alias("error_type"),
        F.when(py, F.coalesce(first_group(py_line, py_re, 2), py_line))
        .when(js, F.coalesce(first_group(js_line, js_re, 2), js_line)).otherwise(plain).alias("message"),
        F.when(py | js, F.array_join(F.slice(frames, 1, max_frames), " | ")).otherwise("").alias("frames"),
    )


COMPILER_LINE = r"^(.+?)\(\d+,\d+\):\s*error (TS\d+):\s*(.+)$"


def compiler_errors(ls: DataFrame, top: int = 10) -> DataFrame:
    hit = ls.where(F.col("line").rlike(COMPILER_LINE))
    return counts_by(hit, {"file": F.regexp_extract("line", COMPILER_LINE, 1), "code": F.regexp_extract("line", COMPILER_LINE, 2)},
                     {"file": top, "code": top})


def test_run(df: DataFrame, id_: str, text: str) -> DataFrame:
    """Counts of one run per text; ``failed_names`` keeps the first ten."""
    c = F.col(text)
    line = F.coalesce(first_group(c, r"(?m)^Tests:\s*(.+)$", 1), c)
    n = lambda src, p: F.coalesce(first_group(src, p, 1).cast("bigint"), F.lit(0).cast("bigint"))
    out = df.select(
        F.col(id_).alias("id"), n(line, r"(?i)(\d+)\s+passed").alias("passed"), n(line, r"(?i)(\d+)\s+failed").alias("failed"),
        n(line, r"(?i)(\d+)\s+(?:skipped|pending|todo)").alias("skipped"), first_group(line, r"(?i)(\d+)\s+total", 1).cast("bigint").alias("_t"),
        n(c, r"(?i)Test Suites:\s*.*?(\d+)\s+total").alias("suites"),
        F.coalesce(first_group(c, r"(?i)Time:\s*([\d.]+\s*(?:ms|s|m))", 1), F.lit("unknown")).alias("duration"),
        F.array_join(F.slice(F.transform(extract_all(c, r"(?:FAIL|✕|✗|×)\s+(.+)", 1), lambda x: strip(x)), 1, 10), "|").alias("failed_names"))
    return out.withColumn("total", F.coalesce("_t", F.col("passed") + F.col("failed") + F.col("skipped"))).drop("_t")


def build_output(df: DataFrame, id_: str, text: str) -> DataFrame:
    c = F.col(text)
    sizes = r"(?i)(\S+)\s*[\-:]\s*([\d.]+\s*(?:kB|KB|MB|B|bytes))"
    names, amounts = extract_all(c, sizes, 1), extract_all(c, sizes, 2)
    return df.select(
        F.col(id_).alias("id"),
        F.coalesce(first_group(c, r"(?i)(?:built|compiled|bundled|done)\s+in\s+([\d.]+\s*(?:ms|s|m|min))", 1), F.lit("unknown")).alias("build_time"),
        F.regexp_count(c, F.lit(word("warning"))).cast("bigint").alias("warnings"),
        F.array_join(F.array_distinct(extract_all(c, r"(?i)(?:Route|GET|POST|PUT|DELETE|PATCH)\s+(/\S+)", 1)), "|").alias("routes"),
        F.array_join(F.zip_with(names, amounts, lambda a, b: F.concat(a, F.lit(": "), b)), "|").alias("bundles"))


CONVENTIONAL = "(?i)" + NOT_BEFORE + r"(feat|fix|refactor|test|docs|chore|style|perf|ci|build|revert)[\s(:]"


def commit_log(ls: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: commits, authors, first and last date line and counts of conventional types."""
    line = F.col("line")
    full = line.rlike(r"^commit [a-f0-9]{40}")
    short = line.rlike(r"^[a-f0-9]{7,}\s")
    date = first_group("line", r"^Date:\s*(.+)$", 1)
    return ls.groupBy(*keys).agg(
        F.when(F.sum(full.cast("bigint")) > 0, F.sum(full.cast("bigint"))).otherwise(F.sum(short.cast("bigint"))).alias("commits"),
        F.countDistinct(F.trim(first_group("line", r"^Author:\s*(.+)$", 1))).alias("authors"),
        F.trim(F.max_by(date, F.when(date.isNotNull(), F.col("pos")))).alias("from_date"),
        F.trim(F.min_by(date, F.when(date.isNotNull(), F.col("pos")))).alias("to_date"))


def commit_types(ls: DataFrame, keys: list[str]) -> DataFrame:
    t = ls.select(*keys, F.explode(extract_all("line", CONVENTIONAL, 1)).alias("type"))
    return t.groupBy(*keys, F.lower("type").alias("type")).agg(F.count("*").alias("n"))


def csv_profile(ls: DataFrame) -> DataFrame:
    """Per document: rows, columns, headers and three sample rows (blank lines dropped)."""
    full = ls.where(F.col("line").rlike(r"\S"))
    first = full.groupBy("doc").agg(F.count("*").alias("rows"), F.min(F.struct("pos", "line")).alias("h"))
    w = Window.partitionBy("doc").orderBy("pos", "line")
    top = full.withColumn("rk", F.row_number().over(w)).where("rk <= 4 and rk > 1")
    sample = top.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "|").alias("sample"))
    head = F.transform(F.split("h.line", ","), lambda x: strip(x))
    return first.join(sample, "doc", "left").select(
        "doc", "rows", F.size(head).cast("bigint").alias("columns"), F.array_join(head, " | ").alias("headers"), "sample")


def json_profile(df: DataFrame, text: str, max_depth: int = 3) -> DataFrame:
    """(path, type, length, n) of a JSON corpus, the root and paths down to ``max_depth``.

    Arrays are described by their first element and have a row for each length that occurs; ``length`` is null
    for all other types.
    """
    level = df.select(F.lit("$").alias("path"), F.col(text).alias("j")).where(valid_json("j"))
    described = lambda d: d.select("path", _json_type("j").alias("type"), F.when(F.col("j").rlike(r"^\s*\["), F.json_array_length("j")).cast("bigint").alias("length"))
    out = described(level)
    level = level.select("path", F.when(F.col("j").rlike(r"^\s*\["), F.get_json_object("j", "$[0]")).otherwise(F.col("j")).alias("j")).where(F.col("j").isNotNull())
    for depth in range(1, max_depth + 1):
        is_obj = F.col("j").rlike(r"^\s*\{")
        fields = level.where(is_obj).select("path", F.explode(F.from_json("j", "map<string,string>")).alias("k", "v"))
        fields = fields.select(F.concat("path", F.lit("."), "k").alias("path"), "k", F.col("v").alias("j"))
        out = out.unionByName(described(fields))
        first = F.when(F.col("j").rlike(r"^\s*\["), F.get_json_object("j", "$[0]")).otherwise(F.col("j"))
        level = fields.select("path", first.alias("j")).where(F.col("j").isNotNull())
    return out.groupBy("path", "type", "length").agg(F.count("*").alias("n"))


def _json_type(v) -> Column:
    c = col(v)
    return (F.when(c.isNull() | (c == "null"), "null").when(c.rlike(r"^\s*\{"), "object").when(c.rlike(r"^\s*\["), "array")
            .when(c.isin("true", "false"), "boolean").when(c.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), "number").otherwise("string"))


def html_outline(df: DataFrame, id_: str, html: str) -> DataFrame:
    c = F.col(html)
    h = r"(?i)<h([1-6])[^>]*>(.*?)</h\1>"
    bare = lambda x: strip(F.regexp_replace(x, "<[^>]*>", ""))
    heads = F.zip_with(extract_all(c, h, 1), extract_all(c, h, 2), lambda n, t: F.concat(F.lit("h"), n, F.lit(": "), bare(t)))
    nav = F.transform(extract_all(c, r"(?i)<nav[^>]*>([\s\S]*?)</nav>", 1),
                      lambda x: F.substring(strip(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " ")), 1, 200))
    return df.select(
        F.col(id_).alias("id"), F.coalesce(strip(first_group(c, r"(?i)<title[^>]*>(.*?)</title>", 1)), F.lit("(no title)")).alias("title"),
        F.array_join(heads, "|").alias("headings"), F.array_join(nav, "|").alias("nav"),
        F.regexp_count(c, F.lit(r"(?i)<form[\s>]")).cast("bigint").alias("forms"), F.length(c).cast("bigint").alias("n_chars"))


def markdown_outline(df: DataFrame, id_: str, text: str) -> DataFrame:
    c = F.col(text)
    ls = lines(c)
    heads = F.filter(ls, lambda x: x.rlike(r"^#{1,6}\s"))
    fences = F.size(F.filter(ls, lambda x: strip(x).startswith("```")))
    title = F.coalesce(strip(F.regexp_replace(F.get(heads, F.lit(0)), r"^#+\s", "")), F.lit(""))
    return df.select(
        F.col(id_).alias("id"), F.when(title == "", "(untitled)").otherwise(title).alias("title"),
        F.array_join(F.transform(heads, lambda x: strip(x)), "|").alias("headings"),
        F.floor(fences / 2).cast("bigint").alias("code_blocks"),
        F.regexp_count(c, F.lit(r"\[([^\]]*)\]\([^)]*\)")).cast("bigint").alias("links"), F.size(ls).cast("bigint").alias("lines"))


JS_SIGNATURE = r"^(export|function|class|interface|type|import|const|let|var)\s+"
PY_SIGNATURE = r"^\s*(def|class|import|from)\s+"
DECORATOR = r"^\s*@\w+"


def code_outline(ls: DataFrame, bucket_lines: int = 10000) -> DataFrame:
    """(doc, language, pos, signature): signature lines, and in one family the decorators above them.

    A decorator is kept when the next line that is not one is a signature; that
    line is found across line buckets, so a very long file is not one task.
    """
    from .ordered import neighbours

    line = F.col("line")
    has = lambda p: F.max(line.rlike(p).cast("int"))
    js = [r"function\s+\w+", r"class\s+\w+", r"export\s+", r"import\s+", r"const\s+\w+\s*="]
    py = [r"def\s+\w+", r"class\s+\w+", r"^import\s+", r"^from\s+\w+"]
    add = lambda ps: sum((has(p) for p in ps), F.lit(0))
    lang = ls.groupBy("doc").agg(add(js).alias("js"), add(py).alias("py"), (has(py[0]) + has(py[3])).alias("own")).select(
        "doc", F.when((F.col("own") >= 1) | (F.col("py") > F.col("js")), "python").otherwise("js-ts").alias("language"))
    deco = line.rlike(DECORATOR)
    nxt = neighbours(ls, ["doc"], ["pos"], bucket=F.floor(F.col("pos") / bucket_lines), after={"_next": "line"}, where=~deco)
    rows = nxt.join(lang, "doc")
    is_py = F.col("language") == "python"
    py_keep = line.rlike(PY_SIGNATURE) | (deco & F.coalesce(F.col("_next").rlike(PY_SIGNATURE), F.lit(False)))
    js_keep = line.rlike(JS_SIGNATURE)
    upto_colon = F.regexp_extract(line, r"^(.*:)", 1)
    py_text = F.when(deco | line.rlike(r"^\s*(import|from)\s+") | (upto_colon == ""), line).otherwise(upto_colon)
    brace = line.rlike(r"function\s+\w+|class\s+\w+") & F.contains(line, F.lit("{"))
    js_text = F.when(brace, F.concat(F.rtrim(F.regexp_extract(line, r"^([^{]*)\{", 1)), F.lit(" {"))).otherwise(line)
    return rows.where(F.when(is_py, py_keep).otherwise(js_keep)).select(
        "doc", "language", "pos", F.when(is_py, py_text).otherwise(js_text).alias("signature"))


def head_tail(text, keep: int = 10, minimum: int = 20) -> Column:
    c = col(text)
    ls = lines(c)
    n = F.size(ls)
    cut = F.concat(F.lit("["), n.cast("string"), F.lit(" lines total]\n"), F.array_join(F.slice(ls, 1, keep), "\n"), F.lit("\n... ("),
                   (n - 2 * keep).cast("string"), F.lit(" lines omitted) ...\n"),
                   F.array_join(F.slice(ls, F.greatest(n - keep + 1, F.lit(1)), F.lit(keep)), "\n"))
    return F.when(n < minimum, c).otherwise(cut)


def unprintable_digest(text) -> Column:
    """Digest line of a text whose first 512 characters are mostly outside printable ASCII, else null."""
    from .content_types import _is_unprintable

    c = col(text)
    return F.when(_is_unprintable(c), F.concat(F.lit("[binary content] sha256:"), F.sha2(c, 256), F.lit(" size:"),
                                               F.octet_length(c).cast("string"), F.lit(" bytes")))
