"""Chat formatting: roles of raw transcripts by a hidden Markov model, then canonical turns.

A transcript comes in parts (conv_id, part, text), read in order as lines. A state
is a role together with "begins a turn" or "goes on"; a line is observed as its speaker
marker (if any) and whether a blank line precedes it. Viterbi finds the best states,
and the turns are rendered in one form.

A conversation of any length is spread: a block of parts is folded into a matrix of best
scores from each entering to each leaving state, blocks are chained per conversation
on these small matrices alone, and each block then finds its own path between the states so
fixed. The result is the best path of the whole conversation.

Defined cases: a null or empty part has no lines, a conversation without lines no turns;
parts of equal number are read in order of their text, repeated rows are repeated lines;
null conversation ids form one conversation, a null part is the first; an empty
table gives an empty result; other columns are ignored. Ties go to the state listed first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .batches import cut

ROLES = ["system", "user", "assistant"]
#: Names that speak for each role.
NAMES = {
    "system": "system instruction instructions context",
    "user": "user human question q customer prompt me",
    "assistant": "assistant ai bot answer a model response gpt",
}
ROLE_OF = {n: ROLES.index(r) for r, names in NAMES.items() for n in names.split()}
_ANY = "|".join(sorted(ROLE_OF, key=lambda n: (-len(n), n)))
MARKER = re.compile(rf"\s*(?:(?:\*\*|#+ )?({_ANY})(?:\*\*)? ?:(?:\*\*)?|#+ ({_ANY}):?\s*$|\[({_ANY})\]:?|<\|?({_ANY})\|?>|({_ANY}) ?>)[ \t]*", re.IGNORECASE)
#: Parts of a conversation that one task reads together.
PARTS = 64

# States: role * 2 begins a turn, role * 2 + 1 goes on.
STATES = 2 * len(ROLES)
#: How often a role follows a role, in the order of ROLES.
FOLLOWS = np.array([[0.02, 0.85, 0.13], [0.03, 0.07, 0.90], [0.02, 0.93, 0.05]])
FIRST = np.array([0.25, 0.65, 0.10])
GOES_ON = 0.75
#: Marker of its own role, none, or another role's: for beginnings and for other lines.
BEGIN, ON = (0.80, 0.15, 0.025), (0.01, 0.97, 0.01)
BLANK_BEFORE = (0.5, 0.2)
#: Observations: (marker + 1) * 2 + blank before; an empty line is the last one.
EMPTY = 2 * (len(ROLES) + 1)


def _model() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log start, log transitions, log emissions by observation)."""
    step = np.zeros((STATES, STATES))
    emit = np.zeros((EMPTY + 1, STATES))
    for r in range(len(ROLES)):
        for on in (0, 1):
            s = 2 * r + on
            step[s, 2 * r + 1] = GOES_ON
            step[s, 0::2] = (1 - GOES_ON) * FOLLOWS[r]
            own, none, other = ON if on else BEGIN
            for marker in range(-1, len(ROLES)):
                p = none if marker < 0 else own if marker == r else other
                for blank in (0, 1):
                    emit[(marker + 1) * 2 + blank, s] = p * (BLANK_BEFORE[on] if blank else 1 - BLANK_BEFORE[on])
            emit[EMPTY, s] = 0.5 if on else 1e-6
    start = np.zeros(STATES)
    start[0::2] = FIRST
    with np.errstate(divide="ignore"):
        return np.log(start), np.log(step), np.log(emit)


START, STEP, EMIT = _model()


def observe(text: str | None) -> list[int]:
    """One observation per line of a part."""
    out, blank = [], 0
    for line in (text or "").split("\n") if text else []:
        if not line.strip():
            out.append(EMPTY)
            blank = 1
            continue
        m = MARKER.match(line)
        marker = ROLE_OF[m.group(m.lastindex).lower()] if m else -1
        out.append((marker + 1) * 2 + blank)
        blank = 0
    return out


def fold_block(codes: list[int], first: bool) -> np.ndarray:
    """Best score from each entering state to each state of the last line (one row for a first block)."""
    if not codes:
        return START[None, :] if first else np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
    m = (START[None, :] if first else STEP) + EMIT[codes[0]]
    for c in codes[1:]:
        m = (m[:, :, None] + STEP[None]).max(1) + EMIT[c]
    return m


def best_path(codes: list[int], entering: int, leaving: int) -> list[int]:
    """States of a block's lines; ``entering`` is -1 before the first line of a conversation."""
    if not codes:
        return []
    score = (START if entering < 0 else STEP[entering]) + EMIT[codes[0]]
    back = []
    for c in codes[1:]:
        options = score[:, None] + STEP
        back.append(options.argmax(0))
        score = options.max(0) + EMIT[c]
    path = [leaving]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _out(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*order)


def parse(transcripts: DataFrame, conv_col: str = "conv_id", part_col: str = "part", text_col: str = "text", parts: int = PARTS) -> DataFrame:
    """(conv_id, turn, role, text, rendered): the recovered turns of every conversation."""
    raw = transcripts.select(F.coalesce(F.concat(F.lit("="), F.col(f"`{conv_col}`").cast("string")), F.lit("")).alias("conv"), F.coalesce(F.col(f"`{part_col}`").cast("bigint"), F.lit(-1)).alias("part"), F.col(f"`{text_col}`").cast("string").alias("text"))
    raw = raw.withColumn("block", F.expr(f"floor(part / {parts})"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bytes(observe(t)) for t in b.column(2).to_pylist()], pa.binary())], ["conv", "part", "text", "block", "codes"])

    coded = cut(raw.mapInArrow(code, "conv string, part bigint, text string, block bigint, codes binary"), "chat-lines")
    blocks = coded.where(F.octet_length("codes") > 0).select("conv", "block", "part", "text", "codes")
    # the conversation's first block with lines starts the chain
    firsts = blocks.groupBy("conv").agg(F.min("block").alias("first"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv, block, first), rows in groupby(_rows(batches), key=lambda r: r[:3]):
            codes = [c for r in rows for c in r[4]]
            out.append((conv, block, fold_block(codes, block == first).ravel().tolist()))
            if len(out) >= 1000:
                yield _out(out, ["conv", "block", "matrix"], [pa.string(), pa.int64(), pa.list_(pa.float64())])
                out = []
        yield _out(out, ["conv", "block", "matrix"], [pa.string(), pa.int64(), pa.list_(pa.float64())])

    lines = blocks.join(firsts, "conv").select("conv", "block", "first", "part", "codes")
    folded = _dealt(lines, ["conv", "block"], ["conv", "block", "first", "part", "codes"]).mapInArrow(fold, "conv string, block bigint, matrix array<double>")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["conv", "block", "entering", "leaving"], [pa.string(), pa.int64(), pa.int32(), pa.int32()]
        out = []
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            score, ids, back = None, [], []
            for _, block, flat in rows:
                m = np.array(flat).reshape(-1, STATES)
                options = m if score is None else score[:, None] + m
                ids.append(block)
                back.append(options.argmax(0).astype(np.int8))
                score = options.max(0)
            state = int(score.argmax())
            for block, b in zip(reversed(ids), reversed(back)):
                before = int(b[state])
                out.append((conv, block, -1 if block == ids[0] else before, state))
                state = before
            if len(out) >= 10_000:
                yield _out(out, names, types)
                out = []
        yield _out(out, names, types)

    ends = _dealt(folded, ["conv"], ["conv", "block"]).mapInArrow(chain, "conv string, block bigint, entering int, leaving int")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["conv", "block", "nth", "begins", "role", "text"], [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
        out, size = [], 0
        for (conv, block, entering, leaving), rows in groupby(_rows(batches), key=lambda r: r[:4]):
            rows = list(rows)
            codes = [c for r in rows for c in r[6]]
            texts = [t for r in rows for t in (r[5] or "").split("\n")]
            nth, begins, some, role = 0, False, [], max(entering, 0) // 2
            for c, line, state in zip(codes, texts, best_path(codes, entering, leaving)):
                if state % 2 == 0:
                    if some:
                        out.append((conv, block, nth, begins, ROLES[role], "\n".join(some)))
                    nth, begins, role, some = nth + 1, True, state // 2, []
                    if c < EMPTY and c >= 2:
                        line = line[MARKER.match(line).end():]
                some.append(line)
                size += len(line)
            if some:
                out.append((conv, block, nth, begins, ROLES[role], "\n".join(some)))
            if size > 4 << 20:
                yield _out(out, names, types)
                out, size = [], 0
        yield _out(out, names, types)

    placed = blocks.join(ends, ["conv", "block"]).select("conv", "block", "entering", "leaving", "part", "text", "codes")
    pieces = cut(_dealt(placed, ["conv", "block"], ["conv", "block", "entering", "leaving", "part", "text"]).mapInArrow(
        decode, "conv string, block bigint, nth bigint, begins boolean, role string, text string"), "chat-pieces")
    return _turns(pieces, transcripts.schema[conv_col].dataType.simpleString())


def _turns(pieces: DataFrame, kind: str) -> DataFrame:
    """Joins pieces of turns that a block's edge cut, and numbers the turns of each conversation from 0."""
    in_block = pieces.groupBy("conv", "block").agg(F.sum(F.col("begins").cast("int")).alias("n"))
    # one small row per block, in order of the blocks
    before = in_block.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = pieces.join(before.select("conv", "block", "before"), ["conv", "block"]).withColumn("turn", F.col("before") + F.col("nth") - 1)
    whole = at.groupBy("conv", "turn").agg(F.min_by("role", F.struct("block", "nth")).alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "nth", "text"))), lambda x: x["text"]), "\n").alias("text"))
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    return whole.select(F.when(F.col("conv") != "", F.expr("substr(conv, 2)")).cast(kind).alias("conv_id"), "turn", "role", text.alias("text"), render(F.col("role"), text).alias("rendered"))


def render(role: Column, text: Column) -> Column:
    """The canonical form of a turn."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


#: Ways in which transcripts mark their speakers, in the order of ROLES.
STYLES = [("System:", "User:", "Assistant:"), ("Context:", "Human:", "AI:"), ("### System\n", "### User\n", "### Assistant\n"), ("[system]", "[user]", "[assistant]"), ("**System:**", "**Q:**", "**A:**")]


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, text): messages as raw transcripts, each conversation in one of several styles.

    A tenth of the assistants' turns has no marker, only a blank line before it.
    """
    style = F.pmod(F.coalesce(F.crc32(F.col("conv_id").cast("string")), F.lit(0)), F.lit(len(STYLES)))
    marker = F.lit("")
    for k, names in enumerate(STYLES):
        for role, name in zip(ROLES, names):
            marker = F.when((style == k) & (F.col("role") == role), name if name.endswith("\n") else name + " ").otherwise(marker)
    bare = (F.col("role") == "assistant") & (F.pmod(F.crc32(F.coalesce("text", F.lit(""))), F.lit(10)) == 0)
    return conversations.select("conv_id", F.col("turn").alias("part"), F.concat(F.when(bare, "\n").otherwise(marker), F.coalesce("text", F.lit(""))).alias("text"))
