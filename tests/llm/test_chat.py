import random
from itertools import product

import numpy as np

from memspark.llm import chat_format as C
from memspark.llm.queries import QUERIES


def brute(codes):
    best = None
    for path in product(range(C.STATES), repeat=len(codes)):
        with np.errstate(invalid="ignore"):
            s = C.START[path[0]] + C.EMIT[codes[0], path[0]] + sum(C.STEP[a, b] + C.EMIT[c, b] for a, b, c in zip(path, path[1:], codes[1:]))
        if best is None or s > best[0] + 1e-12:
            best = (s, path)
    return best


def score(codes, path):
    return C.START[path[0]] + C.EMIT[codes[0], path[0]] + sum(C.STEP[a, b] + C.EMIT[c, b] for a, b, c in zip(path, path[1:], codes[1:]))


def test_blocks_give_the_best_path():
    r = random.Random(2)
    for _ in range(25):
        codes = [r.randrange(C.EMPTY + 1) for _ in range(5)]
        want = brute(codes)[0]
        for cuts in ([5], [2, 5], [1, 2, 5]):
            blocks = [codes[a:b] for a, b in zip([0, *cuts], cuts)]
            mats = [C.fold_block(b, i == 0) for i, b in enumerate(blocks)]
            v, back = mats[0][0], []
            for m in mats[1:]:
                back.append((v[:, None] + m).argmax(0))
                v = (v[:, None] + m).max(0)
            state, path = int(v.argmax()), []
            for i in range(len(blocks) - 1, -1, -1):
                before = int(back[i - 1][state]) if i else -1
                path = C.best_path(blocks[i], before, state) + path
                state = before
            assert abs(score(codes, path) - want) < 1e-9


def test_markers():
    for text, role in (("User: hi", 1), ("### Assistant", 2), ("**Q:** what", 1), ("[system] be kind", 0), ("<|assistant|> ok", 2), ("AI > yes", 2), ("Usability: no", -1), ("a user said", -1)):
        assert C.observe(text)[0] // 2 - 1 == role


def test_transcript_with_missing_marker(spark):
    text = "User: What is it?\nIt puzzles me.\n\nA lamp.\nIt shines.\nUser: Thanks\n### Assistant\nWelcome"
    got = C.parse(spark.createDataFrame([(1, 0, text, "clash")], "conv_id int, part int, text string, role string")).orderBy("turn").collect()
    assert [(r["turn"], r["role"], r["text"]) for r in got] == [(0, "user", "What is it?\nIt puzzles me."), (1, "assistant", "A lamp.\nIt shines."), (2, "user", "Thanks"), (3, "assistant", "Welcome")]
    assert got[1]["rendered"] == "<|assistant|>\nA lamp.\nIt shines.\n<|end|>\n"


def test_roles_of_the_tables(spark, sf):
    got = {(r["conv_id"], r["turn"]): r["role"] for r in QUERIES["op8_chat_format"](spark, sf).collect()}
    want = {(r["conv_id"], r["turn"]): r["role"] for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    assert sum(got.get(k) == v for k, v in want.items()) > 0.95 * len(want)


def test_cut_conversations_give_the_same_turns(spark, sf):
    raw = C.raw_transcripts(spark.read.parquet(f"{sf}/conversations.parquet"))
    assert sorted(map(str, C.parse(raw, parts=1).collect())) == sorted(map(str, C.parse(raw).collect()))


def test_messy(spark):
    rows = [(1, 0, "User: a"), (1, 0, "User: a"), (1, None, "System: s"), (1, 5, None), (1, 6, ""), (2, 0, None), (None, 0, "Assistant: x"), (None, 1, "User: y"), (3, 0, "line\n" * 20_000), (3, 1, "User: " + "z" * 100_000)]
    df = spark.createDataFrame([(*r, 9, "c") for r in rows], "conv_id bigint, part int, text string, turn int, block string")
    got = C.parse(df).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["turn"]):
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"][:3]))
    assert by[1] == [("system", "s"), ("user", "a"), ("user", "a")] and by[None] == [("assistant", "x"), ("user", "y")] and 2 not in by
    assert by[3][-1] == ("user", "zzz")
    assert C.parse(df.limit(0)).count() == 0
