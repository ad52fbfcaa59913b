"""Hand-made texts with the expected result beside them."""

from pyspark.sql import functions as F

from memspark.functions import enrich as E, entities as N, language as L
from memspark.operators import content_types as CT


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr).first()[0]


def test_redaction_detectors(spark):
    rows = [
        ("key AKIA" + "A" * 16 + " end", "key [AWS_KEY_REDACTED] end", 1),
        ("AWS_SECRET_ACCESS_KEY= " + "a" * 40, "AWS_SECRET_ACCESS_KEY= [AWS_SECRET_REDACTED]", 1),
        ("ghp_" + "x" * 36, "[GITHUB_TOKEN_REDACTED]", 1),
        ("xoxb-12-ab", "[SLACK_TOKEN_REDACTED]", 1),
        ("eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10, "[JWT_REDACTED]", 1),
        ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "[PRIVATE_KEY_REDACTED]", 1),
        ("API_KEY='" + "k" * 20 + "'", "API_KEY='[API_KEY_REDACTED]'", 1),
        ("mail a.b@c.org, c@d.io", "mail [EMAIL_REDACTED], [EMAIL_REDACTED]", 2),
        ("at 10.0.0.1 and 999.1.1.1", "at [IP_REDACTED] and 999.1.1.1", 1),
        ("a<private>x\ny</private>b<REDACT>z</REDACT>", "ab[REDACTED]", 2),
        ("nothing", "nothing", 0),
    ]
    df = E.redact(spark.createDataFrame([(r[0],) for r in rows], "t string"), "t")
    got = {r["t"]: (r["cleaned"], r["n_redactions"], r["had_private"]) for r in df.collect()}
    for text, cleaned, n in rows:
        assert got[text] == (cleaned, n, "<private>" in text)


def test_disabled_and_custom(spark):
    df = E.redact(spark.createDataFrame([("a@b.org SECRET-12",)], "t string"), "t", disabled=["email"], custom=["(?i)secret-\\d+"])
    assert df.first()["cleaned"] == "a@b.org [REDACTED]"


def test_importance_and_flags(spark):
    t = "We decided: this bug is critical and was resolved"
    assert one(spark, t, E.importance("t", F.lit("log"), F.lit(False))) == 0.65
    assert one(spark, "  ", E.importance("t", F.lit("error"), F.lit(True))) == 0.5
    assert one(spark, t, E.significance_flags("t")) == ["DECISION", "PROBLEM"]
    assert one(spark, t, E.pinned(E.significance_flags("t"))) is True


def test_topics(spark):
    got = {r["topic"]: round(r["confidence"], 6) for r in one(spark, "Login token for the API; json config in .env, CI/CD on jenkins", E.topics("t"))}
    assert got == {"auth": 0.7, "api": 0.6, "deployment": 0.7, "config": 0.7, "ci-cd": 0.7}


def test_entities(spark):
    text = "Use reactjs with PostgreSQL, see src/app/main.ts and UserService in MAX_SIZE mode, bug 12, v1.2.3 by Jane Smith"
    df = N.entities(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t")
    got = {(r["name"], r["type"]) for r in df.collect()}
    assert got == {("React", "library"), ("PostgreSQL", "library"), ("src/app/main.ts", "file"), ("UserService", "module"), ("MAX_SIZE", "config"), ("#12", "bug"),
                   ("v1.2.3", "service"), ("Jane Smith", "person")}


def test_tiers_and_compression(spark):
    tier = lambda age, imp, pin: one(spark, "x", E.tier_name(E.tier_index(F.lit(age), F.lit(imp), F.lit(pin))))
    assert [tier(1.0, .5, False), tier(10.0, .5, False), tier(40.0, .5, False), tier(100.0, .5, False)] == ["verbatim", "light", "medium", "distilled"]
    assert tier(100.0, .9, False) == "medium" and tier(100.0, .1, True) == "verbatim" and tier(10.0, .8, False) == "verbatim"
    text = "First one here. Noise follows it. We decided to go.\n\nSecond part. More noise."
    none = F.lit(None).cast("string")
    assert one(spark, text, E.compress("t", none, F.lit("light"))) == "First one here. We decided to go. Second part."
    assert one(spark, text, E.compress("t", none, F.lit("distilled"))) == "• We decided to go."
    assert one(spark, text, E.compress("t", F.lit("short"), F.lit("medium"))) == "short"


def test_truncation(spark):
    f = lambda text: E.truncate_cascade(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert f('{"a": [1, {"b": null}], "c": {"d": {"e": {"f": 1}}}}')["truncated"] == "[JSON schema] {a: array[2] of number, c: {d: {e: {f: ...}}}}".replace("{f: ...}", "{f: ...}")
    assert f("\x01\x02\x03abc")["tier"] == 4
    assert f("diff --git a b\n--- a\n+++ b\n@@ x")["truncated"].startswith("[Diff summary] 1.5 files")
    long = "\n".join(str(i) for i in range(1200))
    r = f(long)
    assert r["tier"] == 3 and "... (200 lines omitted) ..." in r["truncated"] and r["truncated"].startswith("[1200 lines total]\n0\n")


def test_content_types(spark):
    cases = {
        "src/a.ts(1,2): error TS1005: x": "typescript-error", "Tests: 1 failed, 3 total": "test-output", "Compiling app": "build-output", "commit " + "a" * 40: "git-log",
        "ValueError: no": "error", '{"a": 1}': "json", "\n".join("a,b,c" for _ in range(6)): "csv", "# A\ntext\n## B\n": "markdown", "<html><body>": "html",
        "\n".join(f"2024-01-01 12:00:0{i % 10} INFO x" for i in range(12)): "log", "\n".join(f"row {i}" for i in range(25)): "shell", "é" * 20: "binary", "plain": "text",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", CT.content_type("t").alias("k"))
    assert {r["t"]: r["k"] for r in df.collect()} == cases


def test_custom_kind_order(spark):
    kinds = CT.builtin().register("mine", 50, lambda c: c.contains("Compiling"), lambda c: F.lit("short")).register("late", 950, lambda c: c.contains("plain"))
    df = spark.createDataFrame([("Compiling app",), ("plain",), ("other",)], "t string").select(kinds.classify("t"), kinds.summarise("t"))
    assert [tuple(r) for r in df.collect()] == [("mine", "short"), ("late", "plain"), ("text", "other")]


def test_dates_and_intents(spark):
    at = lambda s: str(one(spark, s, L.parse_relative_date("t", F.lit("2024-03-31 12:00:00").cast("timestamp"))))
    assert at("2 days ago") == "2024-03-29 12:00:00" and at("last month") == "2024-03-01 12:00:00" and at("nonsense") == "None"
    words = lambda s: one(spark, s, L.temporal_keywords("t", F.lit("2026-04-08").cast("date")))
    assert words("10 days ago") == ["march", "29", "2026", "mar"] and words("last monday") == ["april", "6", "2026"] and words("plain") == []
    intent = lambda s: one(spark, s, L.search_intent("t"))
    assert [intent(s) for s in ("why did it", "when was", "best tool", "how to", "misc")] == ["causal", "temporal", "recommendation", "lookup", "general"]
    assert one(spark, "How do we deploy?", L.question_intent("t")) == "how"
