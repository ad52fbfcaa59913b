"""Registered queries: retrieval evaluation (E), with the flagship passage task."""

from pyspark.sql import functions as F

from ..functions.text import round6
from ..operators import evaluate as EV, index as I, retrieval as R, search as S
from ..session import cut, run_dir, spread
from ..views import queries, table
from .registry import query
from .retrieval import HITS, OR_CL, PHRASES, Q_PLAIN, TK, WORDS_ONLY, docs, or_form, searchable

_RUN = f"""{Q_PLAIN}, {TK}, {OR_CL}, {HITS}, run AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc QUALIFY rank <= 10),
ql AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(trim(b.text)))),
rc AS (SELECT query_id, count(*) AS relevant, count(rank) AS hits FROM ql LEFT JOIN run USING (query_id, id) GROUP BY query_id)"""


def run10(spark, sf):
    r = R.bm25_any(searchable(spark, sf, PHRASES), or_form(queries(spark, sf)), 10)
    return r.select("query_id", "id", "rank")


def qrels(spark, sf):
    """A document is relevant to a passage it holds word for word."""
    return S.contains_text(docs(spark, sf), "id", ["content"], queries(spark, sf), searchable(spark, sf, WORDS_ONLY))


@query("e1_passage_recall", f"WITH {_RUN} SELECT count(*) AS queries, CAST(sum(relevant) AS BIGINT) AS relevant, CAST(sum(hits) AS BIGINT) AS hits, round(avg(CASE WHEN hits > 0 THEN 1.0e0 ELSE 0 END), 6) AS recall_any, round(avg(CASE WHEN hits = relevant THEN 1.0e0 ELSE 0 END), 6) AS recall_all FROM rc")
def e1(spark, sf):
    r = EV.recall(run10(spark, sf), qrels(spark, sf), 10)
    return r.agg(F.count("*").alias("queries"), F.sum("relevant").alias("relevant"), F.sum("hits").alias("hits"), round6(F.avg("recall_any")).alias("recall_any"), round6(F.avg("recall_all")).alias("recall_all"))


@query("e2_ndcg", f"""WITH {_RUN}, g AS (SELECT query_id, sum(CASE WHEN ql.id IS NOT NULL THEN 1 ELSE 0 END / log2(rank + 1)) AS dcg, count(ql.id) AS n FROM run LEFT JOIN ql USING (query_id, id) GROUP BY query_id)
SELECT query_id, round(dcg, 6) AS dcg, round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM g""")
def e2(spark, sf):
    return EV.ndcg(run10(spark, sf), qrels(spark, sf), 10).select("query_id", round6("dcg").alias("dcg"), round6("ndcg").alias("ndcg"))


@query("e3_capped_recall", f"WITH {_RUN} SELECT query_id, round(hits / least(relevant, 10)::DOUBLE, 6) AS recall_capped FROM rc")
def e3(spark, sf):
    return EV.recall(run10(spark, sf), qrels(spark, sf), 10).select("query_id", round6("recall_capped").alias("recall_capped"))


_EVID = r"""ev AS (SELECT query_id, no, ss[no] AS text FROM (SELECT query_id, ss, unnest(range(1, len(ss) + 1)) AS no FROM (SELECT query_id, list_filter(regexp_split_to_array(text, '[.]\s*'), lambda x: length(x) > 10) AS ss FROM q))),
ef AS (SELECT query_id, no, max(CASE WHEN contains(d.text, ev.text) OR contains(ev.text, d.text) OR (len(ws) >= 3 AND len(list_filter(ws, lambda w: contains(d.text, w))) / greatest(len(ws), 1)::DOUBLE >= 0.6) THEN 1 ELSE 0 END) AS f
 FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) > 3) AS ws FROM ev) ev JOIN run USING (query_id) JOIN documents d ON d.doc_id = run.id GROUP BY query_id, no),
er AS (SELECT query_id, count(*) AS evidence, sum(f) AS found, sum(f) / count(*)::DOUBLE AS recall FROM ef GROUP BY query_id)"""


def evidence(spark, sf):
    r = cut(run10(spark, sf), "run")
    got = r.join(docs(spark, sf), "id").select("query_id", F.col("content").alias("text"))
    ev = queries(spark, sf).select("query_id", F.posexplode(F.filter(F.split("text", r"[.]\s*"), lambda x: F.length(x) > 10)).alias("no", "text"))
    return EV.evidence_recall(ev, got)


@query("e4_evidence_recall", f"WITH {_RUN}, {_EVID} SELECT query_id, evidence, CAST(found AS BIGINT) AS found, round(recall, 6) AS recall FROM er")
def e4(spark, sf):
    return evidence(spark, sf).select("query_id", "evidence", "found", round6("recall").alias("recall"))


@query("e5_metric_rollup", f"""WITH {_RUN}, {_EVID}, c AS (SELECT CAST(query_id % 5 AS VARCHAR) AS category, avg(recall) AS mean, count(*) FILTER (recall >= 1) AS perfect, count(*) AS n FROM er GROUP BY 1)
SELECT category, round(mean, 6) AS mean, perfect, n FROM (SELECT * FROM c UNION ALL SELECT '(micro)', avg(recall), count(*) FILTER (recall >= 1), count(*) FROM er UNION ALL SELECT '(macro)', avg(mean), CAST(sum(perfect) AS BIGINT), CAST(sum(n) AS BIGINT) FROM c)""")
def e5(spark, sf):
    s = cut(evidence(spark, sf), "scores").withColumn("c", F.col("query_id") % 5)  # read three times; one row a query
    return EV.by_category(s, "c", "recall").select("category", round6("mean").alias("mean"), "perfect", "n")


@query("e6_turn_to_session", "SELECT CAST(user_id AS BIGINT) AS query_id, event_type AS id, count(*) AS n, min(event_id) AS first_rank FROM events GROUP BY ALL")
def e6(spark, sf):
    r = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.concat("event_type", F.lit("_turn_"), F.col("event_id").cast("string")).alias("id"), F.col("event_id").alias("rank"))
    return EV.to_sessions(r).groupBy("query_id", "id").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"))


@query("e7_load_qrels", "SELECT CAST(doc_id AS VARCHAR) AS query_id, concat('d', doc_id) AS id FROM labels WHERE quality > 0")
def e7(spark, sf):
    """Labels written as a qrels file in the shared folder and loaded back."""
    path = run_dir(spark, "qrels")
    rows = table(spark, sf, "labels").select(F.col("doc_id").cast("string"), F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("quality").cast("string"))
    rows.write.csv(path, sep="\t")
    return EV.load_qrels(spark, path)


@query("e7_load_texts", "SELECT CAST(item_id AS VARCHAR) AS id, concat('p ', text) AS text FROM benchmark")
def e7t(spark, sf):
    path = run_dir(spark, "texts")
    table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("_id"), F.lit("p").alias("title"), "text").write.json(path)
    return EV.load_texts(spark, path)
