"""Import of conversation exports: five text formats to one message table.

Every parser maps a frame to ``(conv, turn, role, speaker, ts_ms, text)`` with
roles human / assistant / system. Line formats come from ``spark.read.text``,
document formats from ``spark.read.text(wholetext=True)`` (one file, one row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import nonblank, strip, valid_json
from ..operators.ordered import running

MESSAGE = ["conv", "turn", "role", "speaker", "ts_ms", "text"]


def read_exports(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """(conv, text) or (conv, pos, line): the file name is the conversation."""
    df = spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_name").alias("conv"), F.col("value").alias("text"))
    return df if whole else df.withColumn("pos", F.monotonically_increasing_id()).withColumnRenamed("text", "line")


def _messages(df: DataFrame, conv="conv", turn="turn", role=None, speaker=None, ts_ms=None, text=None) -> DataFrame:
    none = F.lit(None)
    return df.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), role.alias("role"), (none.cast("string") if speaker is None else speaker).alias("speaker"),
                     (none if ts_ms is None else ts_ms).cast("bigint").alias("ts_ms"), text.alias("text"))


def parse_lines(df: DataFrame) -> DataFrame:
    """One JSON object per line, with role and content; malformed lines are skipped."""
    j = df.withColumn("m", F.from_json("line", "role string, content string, timestamp bigint, created_at bigint"))
    ok = (F.col("m.role") != "") & (F.col("m.content") != "")
    role = F.when(F.col("m.role") == "user", "human").when(F.col("m.role") == "assistant", "assistant").otherwise("system")
    return _messages(j.where(ok), turn="pos", role=role, ts_ms=F.coalesce("m.timestamp", "m.created_at"), text=F.col("m.content"))


def parse_sender_export(df: DataFrame) -> DataFrame:
    """``chat_messages`` or ``messages`` with sender, text (or content) and an ISO time."""
    msg = "array<struct<sender:string, text:string, content:string, created_at:string>>"
    j = df.withColumn("d", F.from_json("text", f"chat_messages {msg}, messages {msg}"))
    m = j.select("conv", F.posexplode(F.coalesce("d.chat_messages", "d.messages")).alias("turn", "m"))
    text = F.coalesce(F.when(F.col("m.text") != "", F.col("m.text")), "m.content")
    role = F.when(F.col("m.sender").isin("human", "user"), "human").otherwise("assistant")
    return _messages(m.where(text.rlike(r"\S")), role=role, speaker=F.col("m.sender"), ts_ms=F.unix_millis(F.col("m.created_at").try_cast("timestamp")), text=text)


def parse_message_tree(df: DataFrame) -> DataFrame:
    """``mapping`` of nodes; user and assistant messages with their parts joined by line breaks; times in seconds."""
    node = "struct<message:struct<author:struct<role:string>, content:struct<parts:array<string>>, create_time:double>>"
    body = F.when(F.trim("text").startswith("["), F.col("text")).otherwise(F.concat(F.lit("["), "text", F.lit("]")))
    j = df.withColumn("d", F.from_json(body, f"array<struct<mapping:map<string,{node}>>>"))
    c = j.select("conv", F.posexplode("d").alias("c", "one")).select("conv", "c", F.posexplode(F.map_entries("one.mapping")).alias("i", "n"))
    m = F.col("n.value.message")
    text = strip(F.array_join(m["content"]["parts"], "\n"))
    role = m["author"]["role"]
    out = c.withColumn("turn", F.col("c") * 1000000 + F.col("i")).where(role.isin("user", "assistant") & (text != ""))
    return _messages(out, role=F.when(role == "user", "human").otherwise("assistant"), ts_ms=F.floor(m["create_time"] * 1000), text=text)


def parse_channel(df: DataFrame) -> DataFrame:
    """An array of messages, or an object holding one; joins and leaves are dropped, everyone is human."""
    msg = "array<struct<user:string, username:string, text:string, ts:string, subtype:string>>"
    is_array = F.trim("text").startswith("[")
    arr = F.when(is_array, F.from_json("text", msg)).otherwise(F.from_json("text", f"messages {msg}")["messages"])
    m = df.select("conv", F.posexplode(arr).alias("turn", "m"))
    keep = (F.col("m.text") != "") & ~F.coalesce(F.col("m.subtype").isin("channel_join", "channel_leave"), F.lit(False))
    return _messages(m.where(keep), role=F.lit("human"), speaker=F.coalesce("m.user", "m.username"), ts_ms=F.floor(F.col("m.ts").try_cast("decimal(20,6)") * 1000), text=F.col("m.text"))


#: Prefixes that start a message in a plain-text transcript.
HUMAN_PREFIX = r"^(?:> human|Human:|User:)"
ASSISTANT_PREFIX = r"^(?:assistant|Assistant:|Claude:)"


def parse_plain(df: DataFrame) -> DataFrame:
    """Blank-line blocks; a block without a role prefix continues the message before it."""
    b = df.select("conv", F.posexplode(F.transform(nonblank(F.split("text", r"\n\s*\n")), lambda x: strip(x))).alias("pos", "b"))
    human, bot = F.col("b").rlike(HUMAN_PREFIX), F.col("b").rlike(ASSISTANT_PREFIX)
    body = (F.when(human, F.regexp_replace(F.regexp_replace("b", r"(?i)^>\s*human\s*", ""), r"(?i)^(Human|User):\s*", ""))
            .when(bot, F.regexp_replace("b", r"(?i)^(?:assistant:?|claude:)\s*", "")).otherwise(F.col("b")))
    b = b.withColumns({"start": human | bot, "role": F.when(human, "human").when(bot, "assistant"), "body": strip(body)})
    b = b.where(~F.col("start") | (F.col("body") != "")).withColumn("_s", F.col("start").cast("bigint"))
    r = running(b, ["conv"], ["pos"], F.floor(F.col("pos") / 10000), sums={"msg": "_s"}).where("msg > 0")
    g = r.groupBy("conv", "msg").agg(F.max("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda s: s["body"]), "\n").alias("t"))
    return _messages(g.withColumn("turn", F.col("msg") - 1), role=F.col("role"), text=F.col("t"))


def detect_format(text, filename=None) -> Column:
    """jsonl, tree, sender, channel or plain: by extension, first line, structure, then prefixes."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    first = F.split(t, "\n")[0]
    has = lambda j, path: F.get_json_object(j, path).isNotNull()
    valid = valid_json(t)
    out = (F.when(F.contains(t, F.lit("\n")) & t.startswith("{") & valid_json(first) & has(first, "$.role") & has(first, "$.content"), "jsonl")
           .when(valid & (has(t, "$[0].mapping") | has(t, "$.mapping")), "tree")
           .when(valid & (has(t, "$.chat_messages") | (has(t, "$.uuid") & has(t, "$.messages"))), "sender")
           .when(valid & ((has(t, "$[0].ts") & has(t, "$[0].text")) | has(t, "$.messages[0].ts")), "channel").otherwise("plain"))
    return out if filename is None else F.when(F.endswith(F.col(filename), F.lit(".jsonl")), "jsonl").otherwise(out)


def parse_any(df: DataFrame) -> DataFrame:
    """Documents of mixed formats: each goes to the parser its text asks for."""
    d = df.withColumn("_f", detect_format("text"))
    of = lambda f: d.where(F.col("_f") == f)
    as_lines = of("jsonl").select("conv", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    out = parse_lines(as_lines)
    for f, parser in (("tree", parse_message_tree), ("sender", parse_sender_export), ("channel", parse_channel), ("plain", parse_plain)):
        out = out.unionByName(parser(of(f)))
    return out


def chunk_exchanges(messages: DataFrame, bucket_turns: int = 10000) -> DataFrame:
    """(conv, exchange, type, text): a new exchange starts at each human message; type context when an assistant speaks."""
    m = messages.withColumn("_h", (F.col("role") == "human").cast("bigint"))
    m = running(m, ["conv"], ["turn"], F.floor(F.col("turn") / bucket_turns), sums={"_n": "_h"}, count="_i")
    # messages before the first human one form the first exchange
    first = m.groupBy("conv").agg(F.min_by("_h", "turn").alias("_f"))
    m = m.join(first, "conv").withColumn("exchange", F.col("_n") - F.col("_f"))
    line = F.concat("role", F.lit(": "), "text")
    g = m.groupBy("conv", "exchange").agg(F.max((F.col("role") == "assistant").cast("int")).alias("_a"),
                                          F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda s: s["l"]), "\n\n").alias("text"))
    return g.select("conv", "exchange", F.when(F.col("_a") == 1, "context").otherwise("log").alias("type"), "text")
