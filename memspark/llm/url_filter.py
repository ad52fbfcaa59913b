"""URL filter: rules first, then a character language-model ratio.

URLs that a rule accepts and URLs that a rule rejects each train a smoothed
character model of variable order (up to two characters of context, Witten-Bell
interpolation down to the single character). A URL without a rule is judged by the
difference of its two log-likelihoods per character, against the threshold that
best separates the decided URLs kept out of training.

Everything is DataFrame and SQL functions. Characters fall into 31 classes (letters,
digit, four marks, the rest), so a model is a table of 32 x 32 x 32 log ratios whatever
the input's size; it is read as one array by a scalar subquery, and scoring is a
projection of the scan. Log ratios are whole millionths, so sums are exact.

Defined cases: a null URL or one without "://" has empty host and path, fits no rule and
scores 0; URLs of any length are scored whole; repeated rows are counted and answered
one by one; without decided URLs of both kinds the threshold is 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .batches import cut

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: The class of a character is its place here, from 1; 0 stands for the start.
CLASSES = LOWER + "0./-_"
SIZE = 32
MICRO = 1_000_000

#: (verdict, host, path prefix): the longest that fits wins.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls. ``rules`` is a short list."""
    rule = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def character_triples(text: Column) -> Column:
    """For each character, one number for it and the two before it."""
    plain = F.regexp_replace(F.translate(text, UPPER + DIGITS, LOWER + "0" * 10), "[^a-z0./-]", "_")
    codes = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.instr(F.lit(CLASSES), c))
    padded = F.concat(F.array(F.lit(0), F.lit(0)), codes)
    return F.transform(codes, lambda c, i: (F.get(padded, i) * SIZE + F.get(padded, i + 1)) * SIZE + c)


def held_back(url: Column) -> Column:
    """About a fifth of the URLs, by content: they set the threshold and train no model."""
    return F.substring(F.md5(url), 1, 1).isin("0", "1", "2")


def log_ratios(counts: DataFrame) -> DataFrame:
    """One row with ``model``: the log ratio of every triple in millionths, from ``counts(t, allow, block)``."""
    spark = counts.sparkSession
    full = spark.range(SIZE ** 3).select(F.col("id").cast("int").alias("t"))
    full = full.join(F.broadcast(counts), "t", "left").select("t", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("allow", "block")])
    full = full.withColumns({"ab": F.expr(f"t div {SIZE}"), "b": F.expr(f"t div {SIZE} % {SIZE}"), "bc": F.expr(f"t % {SIZE ** 2}"), "c": F.expr(f"t % {SIZE}")})

    def sums(key: str, of: DataFrame, names: dict[str, str]) -> DataFrame:
        return of.groupBy(key).agg(*[F.sum(k).alias(v) for k, v in names.items()])

    kinds = ("allow", "block")
    two = full.groupBy("bc").agg(F.first("b").alias("b"), F.first("c").alias("c"), *[F.sum(k).alias(f"{k}2") for k in kinds])
    one = sums("c", two, {f"{k}2": f"{k}1" for k in kinds})
    of_b = two.groupBy("b").agg(*[F.sum(f"{k}2").alias(f"{k}_nb") for k in kinds], *[F.sum((F.col(f"{k}2") > 0).cast("int")).alias(f"{k}_tb") for k in kinds])
    of_ab = full.groupBy("ab").agg(*[F.sum(k).alias(f"{k}_nab") for k in kinds], *[F.sum((F.col(k) > 0).cast("int")).alias(f"{k}_tab") for k in kinds])
    total = one.agg(*[F.sum(f"{k}1").alias(f"{k}0") for k in kinds]).withColumn("one", F.lit(1))
    at = full.join(two.drop("b", "c"), "bc").join(one, "c").join(of_b, "b").join(of_ab, "ab").withColumn("one", F.lit(1)).join(total, "one")

    def p(k: str) -> Column:
        p1 = (F.col(f"{k}1") + 1) / (F.col(f"{k}0") + SIZE)
        p2 = F.when(F.col(f"{k}_nb") > 0, (F.col(f"{k}2") + F.col(f"{k}_tb") * p1) / (F.col(f"{k}_nb") + F.col(f"{k}_tb"))).otherwise(p1)
        return F.when(F.col(f"{k}_nab") > 0, (F.col(k) + F.col(f"{k}_tab") * p2) / (F.col(f"{k}_nab") + F.col(f"{k}_tab"))).otherwise(p2)

    ratio = F.round((F.log(p("allow")) - F.log(p("block"))) * MICRO).cast("bigint").alias("r")
    return at.select("t", ratio).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "r"))), lambda x: x["r"]).alias("model"))


def _score(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Adds ``score``: millionths of the log ratio per character."""
    rows = rows.withColumn("model", model.select("model").scalar())
    total = F.aggregate("triples", F.lit(0).cast("bigint"), lambda s, t: s + F.get("model", t))
    return rows.withColumn("score", F.when(F.size("triples") > 0, total / F.size("triples")).otherwise(0.0)).drop("model")


def threshold(scored: DataFrame) -> DataFrame:
    """One row ``cut``: what best separates ``scored(verdict, score)`` in steps of 0.01.

    It lies midway between the lowest bin above it and the next bin below; of equally good cuts the lowest is taken.
    """
    step = MICRO // 100
    bins = scored.select(F.floor(F.col("score") / step).alias("bin"), "verdict").groupBy("bin").agg(
        F.sum((F.col("verdict") == "allow").cast("int")).alias("good"), F.sum((F.col("verdict") == "block").cast("int")).alias("bad"))
    # at most a few thousand bins, as log ratios are bounded
    lists = bins.agg(F.array_sort(F.collect_list(F.struct("bin", "good", "bad"))).alias("bins"), F.sum("good").alias("goods"), F.sum("bad").alias("bads"))
    options = lists.where("goods > 0 AND bads > 0").select(F.posexplode("bins").alias("i", "x"), "bins", "goods", "bads").select(
        F.col("x.bin").alias("bin"),
        F.floor((F.when(F.col("i") > 0, F.get("bins", F.col("i") - 1)["bin"] + 1).otherwise(F.col("x.bin")) + F.col("x.bin")) / 2).alias("middle"),
        (F.aggregate("bins", F.lit(0).cast("bigint"), lambda s, y: s + F.when(y["bin"] >= F.col("x.bin"), y["good"]).otherwise(0)) * F.col("bads")
         + F.aggregate("bins", F.lit(0).cast("bigint"), lambda s, y: s + F.when(y["bin"] < F.col("x.bin"), y["bad"]).otherwise(0)) * F.col("goods")).alias("gain"))
    return options.agg((F.coalesce(F.max_by("middle", F.struct("gain", -F.col("bin"))), F.lit(0)) * step).alias("cut"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; ``score`` in nats per character."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"), character_triples(F.concat("host", "path")).alias("triples"))
    decided = rows.where(F.col("verdict").isNotNull())
    train = decided.where(~held_back("url")).select("verdict", F.explode("triples").alias("t"))
    counts = train.groupBy("t").agg(F.sum((F.col("verdict") == "allow").cast("int")).alias("allow"), F.sum((F.col("verdict") == "block").cast("int")).alias("block"))
    model = cut(log_ratios(counts), "url-model")
    limit = cut(threshold(_score(decided.where(held_back("url")), model)), "url-threshold")
    out = _score(rows, model).withColumn("cut", limit.scalar())
    says = F.coalesce("verdict", F.when(F.col("score") >= F.col("cut"), "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", says.alias("verdict"), (F.col("score") / MICRO).alias("score"))


def oracle() -> str:
    """The query over ``pages`` in SQL, for :data:`RULES`."""
    fits = "\n".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN struct_pack(rule := '{h}{p}', verdict := '{v}')"
                     for v, h, p in sorted(RULES, key=lambda r: (len(r[1] + r[2]), r), reverse=True))
    def per(k):
        p1 = f"(({k}1 + 1) / ({k}0 + {SIZE}))"
        p2 = f"(CASE WHEN {k}_nb > 0 THEN ({k}2 + {k}_tb * {p1}) / ({k}_nb + {k}_tb) ELSE {p1} END)"
        return f"(CASE WHEN {k}_nab > 0 THEN ({k} + {k}_tab * {p2}) / ({k}_nab + {k}_tab) ELSE {p2} END)"
    return f"""
WITH a AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, url, coalesce(translate(h, '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*'), '') AS path FROM b),
d AS (SELECT page_id, url, host, path, CASE {fits} END AS f,
      list_transform(list_filter(string_split(regexp_replace(translate(concat(host, path), '{UPPER}{DIGITS}', '{LOWER}0000000000'), '[^a-z0./-]', '_', 'g'), ''), lambda x: x <> ''), lambda x: instr('{CLASSES}', x)) AS codes FROM c),
e AS (SELECT page_id, url, host, path, f.rule AS rule, f.verdict AS verdict, left(md5(url), 1) IN ('0', '1', '2') AS held,
      list_transform(codes, lambda x, i: (list_concat([0, 0], codes)[i] * {SIZE} + list_concat([0, 0], codes)[i + 1]) * {SIZE} + x) AS ts FROM d),
tr AS (SELECT verdict, unnest(ts) AS t FROM e WHERE verdict IS NOT NULL AND NOT held),
n AS (SELECT t, count(*) FILTER (verdict = 'allow') AS allow, count(*) FILTER (verdict = 'block') AS block FROM tr GROUP BY t),
g AS (SELECT r.range AS t, coalesce(allow, 0) AS allow, coalesce(block, 0) AS block, r.range // {SIZE} AS ab, r.range // {SIZE} % {SIZE} AS b, r.range % {SIZE ** 2} AS bc, r.range % {SIZE} AS c FROM range({SIZE ** 3}) r LEFT JOIN n ON n.t = r.range),
two AS (SELECT bc, b, c, sum(allow) AS allow2, sum(block) AS block2 FROM g GROUP BY bc, b, c),
one AS (SELECT c, sum(allow2) AS allow1, sum(block2) AS block1 FROM two GROUP BY c),
ofb AS (SELECT b, sum(allow2) AS allow_nb, sum(block2) AS block_nb, count(*) FILTER (allow2 > 0) AS allow_tb, count(*) FILTER (block2 > 0) AS block_tb FROM two GROUP BY b),
ofab AS (SELECT ab, sum(allow) AS allow_nab, sum(block) AS block_nab, count(*) FILTER (allow > 0) AS allow_tab, count(*) FILTER (block > 0) AS block_tab FROM g GROUP BY ab),
tot AS (SELECT sum(allow1) AS allow0, sum(block1) AS block0 FROM one),
m AS (SELECT g.t, CAST(round((ln({per('allow')}) - ln({per('block')})) * {MICRO}) AS BIGINT) AS r FROM g JOIN (SELECT bc, allow2, block2 FROM two) USING (bc) JOIN one USING (c) JOIN ofb USING (b) JOIN ofab USING (ab), tot),
ml AS (SELECT list(r ORDER BY t) AS model FROM m),
s AS (SELECT page_id, host, path, rule, verdict, held, CASE WHEN len(ts) > 0 THEN list_sum(list_transform(ts, lambda t: model[t + 1])) / len(ts) ELSE 0 END AS score FROM e, ml),
bins AS (SELECT floor(score / {MICRO // 100}) AS bin, count(*) FILTER (verdict = 'allow') AS good, count(*) FILTER (verdict = 'block') AS bad FROM s WHERE held AND verdict IS NOT NULL GROUP BY 1),
gains AS (SELECT bin, floor((coalesce(lag(bin) OVER (ORDER BY bin) + 1, bin) + bin) / 2) AS middle, sum(good) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * sum(bad) OVER () + coalesce(sum(bad) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * sum(good) OVER () AS gain,
          sum(good) OVER () > 0 AND sum(bad) OVER () > 0 AS usable FROM bins),
cut AS (SELECT coalesce((SELECT middle FROM gains WHERE usable ORDER BY gain DESC, bin LIMIT 1), 0) * {MICRO // 100} AS edge)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score >= (SELECT edge FROM cut) THEN 'allow' ELSE 'block' END) AS verdict, score / {MICRO} AS score FROM s"""
