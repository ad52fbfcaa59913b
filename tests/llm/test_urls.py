from memspark.llm import url_filter as U
from memspark.llm.queries import ORACLES, QUERIES
from tests.compare import connect, diff

CASES = [  # url, host, path, rule
    (None, "", "", None), ("", "", "", None), ("no scheme", "", "", None), ("http://", "", "", None), ("http://X.COM", "x.com", "", None), ("http://X.COM/", "x.com", "/", "com/"),
    ("a://b.net/es/1?x=/fr/", "b.net", "/es/1", "net/es/"), ("http://net/fr/#://c.com/", "net", "/fr/", "net/fr/"), ("http://m.example.com/en/?q", "m.example.com", "/en/", "example.com/en/"),
    ("http://www.example.com/en/a", "www.example.com", "/en/a", "www.example.com/en/"), ("http://a.www.example.com/en/a", "a.www.example.com", "/en/a", "www.example.com/en/"), ("http://badexample.com/en/", "badexample.com", "/en/", "com/"),
    ("http://example.com/EN/", "example.com", "/EN/", "com/"), ("http://É.net?/es/", "É.net", "", None), ("http://h.net:80/es/", "h.net:80", "/es/", None), ("x\ny://é.org/\n/z", "é.org", "/\n/z", None),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, c[0], "clash", "clash", 1) for i, c in enumerate(CASES)], "page_id int, url string, host string, verdict string, score int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(df).collect()}
    for i, (_, host, path, rule) in enumerate(CASES):
        assert got[i][:3] == (host, path, rule)
        if rule:
            assert got[i][3] == {h + p: v for v, h, p in U.RULES}[rule]
    assert {v[3] for v in got.values()} <= {"allow", "block"}


def test_query_equals_sql(spark, sf):
    assert diff(QUERIES["op9_url_filter"](spark, sf), connect(sf), ORACLES["op9_url_filter"]) is None


def test_rejected_kind_without_a_rule_is_blocked(spark):
    rows = [(i, f"http://shop{i}.net/es/sale{i}") for i in range(300)] + [(1000 + i, f"http://lib{i}.com/archive/book{i}") for i in range(300)]
    rows += [(5000, "http://shop9.org/es/sale7"), (5001, "http://lib5.org/archive/book1"), (5001, "http://lib5.org/archive/book1"), (None, "http://lib5.org/archive/book1")]
    got = [(r["page_id"], r["verdict"]) for r in U.judge(spark.createDataFrame(rows, "page_id int, url string")).where("rule IS NULL").collect()]
    assert sorted(got, key=str) == sorted([(5000, "block"), (5001, "allow"), (5001, "allow"), (None, "allow")], key=str)


def test_empty_and_long(spark):
    assert U.judge(spark.createDataFrame([], "page_id int, url string")).count() == 0
    assert U.judge(spark.createDataFrame([(1, "http://a.org/" + "x" * 200_000)], "page_id int, url string")).count() == 1


def test_plan_is_native(spark, sf):
    plan = QUERIES["op9_url_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
