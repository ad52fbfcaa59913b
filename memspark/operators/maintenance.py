"""Knowledge maintenance: each step maps (state, facts, as_of) to a new state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from ..functions import enrich as E
from ..functions.text import col
from .analytics import sessions_per_entry

SOURCE_WEIGHTS = {"explicit": 1.0, "inferred": 0.6, "observed": 0.3}       # fixed values: authority
CONFIDENCE_WEIGHTS = {"explicit": 1.0, "inferred": 0.6, "observed": 0.4}   # fixed values: confidence


def _source(weights, default):
    out = F.lit(default)
    for k, v in weights.items():
        out = F.when(F.col("source_type") == k, v).otherwise(out)
    return out


def older_than(column, days, as_of):
    return E.days_between(column, as_of) > days


def mark_stale(k: DataFrame, as_of, days: int = 30) -> DataFrame:
    return k.withColumn("stale", F.col("stale") | (~F.col("archived") & older_than("last_accessed", days, as_of)))


def archive_old(k: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Entries nobody stated explicitly are archived once unused for ``days``."""
    return k.withColumn("archived", F.col("archived") | ((F.col("source_type") != "explicit") & older_than("last_accessed", days, as_of)))


def prune(k: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Entries past ``days`` get 0.9^weeks · log2(access + 1); below 0.1 they are archived."""
    age = E.days_between("created_at", as_of)
    rel = F.pow(F.lit(0.9), age / 7) * F.log2(F.col("access_count") + 1)
    old = ~F.col("archived") & (age > days)
    return k.withColumns({"relevance_score": F.when(old, rel).otherwise(F.col("relevance_score")), "archived": F.col("archived") | (old & (rel < 0.1))})


def authority(source_weight, sessions, access_count, age_days):
    """Softmax-weighted mean of source, session breadth, access density and recency."""
    age = F.greatest(F.lit(0.0), col(age_days))
    parts = [col(source_weight), F.log2(col(sessions) + 1) / 5,
             F.least(F.lit(1.0), F.when(age > 0, col(access_count) / F.when(age > 0, age)).otherwise(col(access_count)) / 10), E.decay(age, 7)]
    z = sum((F.exp(p) for p in parts[1:]), F.exp(parts[0]))
    mean = sum((F.exp(p) * p for p in parts[1:]), F.exp(parts[0]) * parts[0]) / z
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))


def with_sessions(k: DataFrame, access: DataFrame) -> DataFrame:
    s = sessions_per_entry(access).withColumnRenamed("knowledge_id", "_k")
    return k.join(s, F.col("id").cast("string") == F.col("_k").cast("string"), "left").drop("_k").withColumn("sessions", F.coalesce("sessions", F.lit(0)).cast("bigint"))


def with_authority(k: DataFrame, access: DataFrame, as_of) -> DataFrame:
    return with_sessions(k, access).withColumn("authority", authority(_source(SOURCE_WEIGHTS, 0.3), "sessions", "access_count", E.days_between("created_at", as_of)))


def with_confidence(k: DataFrame, access: DataFrame, as_of) -> DataFrame:
    fresh = E.decay(E.days_between("created_at", as_of), 14)
    use = F.least(F.lit(1.0), F.log2(F.col("access_count") + 2) / 10)
    spread = F.least(F.lit(1.0), F.col("sessions") / 5.0)
    clean = F.when(F.col("stale"), 0.3).when(F.col("contradiction_count") > 0, 0.5).otherwise(1.0)
    c = _source(CONFIDENCE_WEIGHTS, 0.4) * 0.3 + fresh * 0.25 + use * 0.2 + spread * 0.15 + clean * 0.1
    return with_sessions(k, access).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def promotion_candidates(k: DataFrame, access: DataFrame, sessions: int = 3) -> DataFrame:
    k = with_sessions(k.where(~F.col("archived") & ~F.col("auto_promoted") & F.col("shareable")), access)
    return k.where(F.col("sessions") >= sessions)


def promote(k: DataFrame, project, as_of) -> DataFrame:
    """Redacted copies for the shared store, with counters reset."""
    t = E.redact(k, "title").withColumn("title", F.col("cleaned")).drop("cleaned", "n_redactions", "had_private")
    c = E.redact(t, "content").withColumn("content", F.col("cleaned")).drop("cleaned", "n_redactions", "had_private")
    return c.withColumns({"source_project": col(project), "access_count": F.lit(0).cast("bigint"), "relevance_score": F.lit(1.0), "created_at": col(as_of)})


def boost_corroborated(k: DataFrame, access: DataFrame, sessions: int = 3) -> DataFrame:
    """Entries used in several sessions and below 3 gain 15 %, never past 5."""
    hit = (F.col("sessions") >= sessions) & ~F.col("archived") & (F.col("relevance_score") < 3)
    return with_sessions(k, access).withColumn("relevance_score", F.when(hit, F.least(F.lit(5.0), F.col("relevance_score") * 1.15)).otherwise(F.col("relevance_score")))


def apply_resolutions(k: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new state, merged entries, edges) from a table of decisions ``(entry_id, other_id, action, merged_content)``.

    supersede / archive_old archive the other entry, merge archives both and
    adds a merged one, keep_both tags both as reviewed.
    """
    tag = lambda *xs: F.array(*xs)
    a = r.select(F.col("entry_id").alias("id"), (F.col("action") == "merge").alias("gone"),
                 F.when(F.col("action") == "supersede", tag(F.concat(F.lit("supersedes:"), "other_id")))
                 .when(F.col("action") == "keep_both", tag(F.lit("reviewed"), F.lit("non-contradicting"))).otherwise(F.array().cast("array<string>")).alias("more"))
    b = r.select(F.col("other_id").alias("id"), F.col("action").isin("supersede", "archive_old", "merge").alias("gone"),
                 F.when(F.col("action") == "keep_both", tag(F.lit("reviewed"), F.lit("non-contradicting"))).otherwise(F.array().cast("array<string>")).alias("more"))
    m = a.unionByName(b).groupBy("id").agg(F.max("gone").alias("_gone"), F.flatten(F.collect_set("more")).alias("_more"))
    state = k.join(m, "id", "left").withColumns({
        "archived": F.col("archived") | F.coalesce("_gone", F.lit(False)),
        "tags": F.array_union("tags", F.coalesce("_more", F.array().cast("array<string>")))}).drop("_gone", "_more")
    x, y = k.alias("x"), k.select(F.col("id").alias("_o"), F.col("tags").alias("_ot"), F.col("title").alias("_oti"))
    full = r.join(k, F.col("entry_id") == F.col("id")).join(y, F.col("other_id") == F.col("_o"))
    merged = full.where("action = 'merge'").select(F.concat_ws("+", "entry_id", "other_id").alias("id"), "category", "title", F.col("merged_content").alias("content"),
                                                   F.array_union(F.array_union("tags", "_ot"), tag(F.lit("merged"))).alias("tags"))
    edges = full.where(F.col("action").isin("supersede", "keep_both")).select(
        F.col("title").alias("src"), F.col("_oti").alias("dst"), F.when(F.col("action") == "supersede", "supersedes").otherwise("contradicts").alias("type"),
        F.when(F.col("action") == "supersede", 1.0).otherwise(0.3).alias("weight"))
    return state, merged, edges


def add_suggestions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert-or-ignore by (local_id, global_id): what is there stays, of new repeats the earliest (then the smallest id)."""
    key = ["local_id", "global_id"]
    rest = [c for c in incoming.columns if c not in key]
    first = incoming.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("created_at", "id")).alias("s")).select(*key, "s.*")
    return existing.unionByName(first.withColumn("status", F.lit("pending")).join(existing.select(*key), key, "left_anti"))


def set_suggestion_status(suggestions: DataFrame, changes: DataFrame) -> DataFrame:
    """The last of ``changes(id, status, at, nth)`` per suggestion wins; changes of unknown ids are ignored."""
    last = changes.groupBy("id").agg(F.max_by("status", F.struct("at", "nth")).alias("_status"))
    return suggestions.join(last, "id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def list_suggestions(suggestions: DataFrame, status: str = "pending", limit: int = 10) -> DataFrame:
    """The newest ``limit`` suggestions of a status, or of any ("all")."""
    rows = suggestions if status == "all" else suggestions.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), "id").limit(limit)


def save_with_validity(existing: DataFrame, incoming: DataFrame, contradictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, outcome): new facts are blocked by what they contradict unless they are forced.

    ``existing(id, entity, valid_from, valid_to, superseded_by)``, ``incoming(id, entity, valid_from, force)``,
    ``contradictions(id, other_id)``. A forced fact closes the open facts that it contradicts at its
    own start; if several forced facts contradict one, the earliest (then the smallest id) closes it.
    """
    against = contradictions.groupBy("id").agg(F.count("*").alias("n"))
    outcome = incoming.join(against, "id", "left").withColumn("status", F.when(F.col("n").isNull(), "saved").when(F.col("force"), "forced").otherwise("blocked")).drop("n")
    closing = contradictions.join(outcome.where("status = 'forced'").select("id", "valid_from"), "id").groupBy(F.col("other_id").alias("id")).agg(
        F.min(F.struct(F.col("valid_from").alias("at"), F.col("id").alias("by"))).alias("c"))
    closes = F.col("valid_to").isNull() & F.col("c").isNotNull()
    old = existing.join(closing, "id", "left").select("id", "entity", "valid_from", F.when(closes, F.col("c.at")).otherwise(F.col("valid_to")).alias("valid_to"),
                                                      F.when(closes, F.col("c.by")).otherwise(F.col("superseded_by")).alias("superseded_by"))
    kinds = dict(existing.dtypes)
    new = outcome.where("status <> 'blocked'").select("id", "entity", "valid_from", F.lit(None).cast(kinds["valid_to"]).alias("valid_to"), F.lit(None).cast(kinds["superseded_by"]).alias("superseded_by"))
    return old.unionByName(new), outcome.select("id", "status")


def loss_risk(obs: DataFrame, know: DataFrame, as_of, limit: int | None = None) -> DataFrame:
    """1 - survival for unpinned observations and live knowledge, with the reasons; highest first."""
    def score(df, importance):
        age = E.days_between(F.col("at"), as_of)
        s = importance * 0.4 + E.decay(age, 14) * 0.3 + F.log2(F.greatest(F.lit(1), F.col("access_count") + 1)) / 5 * 0.2 + F.when(F.col("useful"), 0.5).otherwise(0.0) * 0.1
        return df.withColumns({"risk": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - s)), 2), "_age": age, "importance": importance})
    days = F.concat(F.floor(F.col("_age") + 0.5).cast("string"), F.lit(" days old"))
    o = score(obs.where("not pinned"), F.col("importance"))
    o = o.select(F.lit("observation").alias("kind"), "id", "risk", F.array_compact(F.array(
        F.when(F.col("importance") < 0.4, "low importance"), F.when(F.col("_age") > 30, days), F.when(F.col("access_count") == 0, "never accessed"),
        F.when(~F.col("useful"), "never marked useful"))).alias("reasons"))
    k = score(know.where("not archived"), F.least(F.lit(1.0), F.col("relevance_score")))
    k = k.select(F.lit("knowledge").alias("kind"), "id", "risk", F.array_compact(F.array(
        F.when(F.col("importance") < 0.5, "low relevance"), F.when(F.col("_age") > 60, days), F.when(F.col("access_count") == 0, "never accessed"))).alias("reasons"))
    every = o.unionByName(k)
    return every.orderBy(F.desc("risk"), "kind", "id").limit(limit) if limit else every


def retain(rows: DataFrame, as_of, ttl_days: int, max_rows: int, preserve, at: str = "ts", id_: str = "id") -> DataFrame:
    """Drop rows past the TTL, then the oldest over the cap; preserved types are never dropped.

    The number over the cap is one count; the oldest rows are found by bucketed positions.
    """
    from .ordered import bucket_width, running

    live = rows.where((F.unix_micros(at) >= F.unix_micros(as_of) - F.lit(ttl_days * 86400 * 1000000).cast("bigint")) | F.col("type").isin(*preserve))
    excess = live.agg(F.greatest(F.count("*") - max_rows, F.lit(0).cast("bigint")).alias("x"))
    may = running(live.where(~F.col("type").isin(*preserve)), [], [at, id_], F.floor(F.unix_timestamp(at) / bucket_width(rows, at)), count="_pos")
    gone = may.withColumn("_x", excess.scalar()).where(F.col("_pos") <= F.col("_x")).select(id_)
    return live.join(gone, id_, "left_anti")


def cleanup_sessions(rows: DataFrame, ended: DataFrame) -> DataFrame:
    """Rows ``(session_id, privacy_level, ...)`` without the private ones of the sessions ``ended(session_id)``."""
    gone = ended.select("session_id", F.lit("private").alias("privacy_level")).distinct()
    return rows.join(gone, ["session_id", "privacy_level"], "left_anti")


def highlights(obs: DataFrame, by: list[str], most: int = 5) -> DataFrame:
    """The newest decisions and errors of each group, 200 characters of each."""
    w = Window.partitionBy(*by).orderBy(F.desc("indexed_at"), F.desc("id"))
    top = obs.where(F.col("type").isin("decision", "error")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return top.select(*by, "rank", "id", "type", F.substring("content", 1, 200).alias("text"))


def open_tasks(events: DataFrame, by: list[str], most: int = 5) -> DataFrame:
    """(by, names): tasks ``item`` that were started and not completed, the newest first; ``events(by, id, event_type, ts, item)``."""
    done = events.where("event_type = 'task_complete'").select(*by, "item").distinct()
    started = events.where("event_type = 'task_start'").groupBy(*by, "item").agg(F.max(F.struct("ts", "id")).alias("_at")).join(done, [*by, "item"], "left_anti")
    w = Window.partitionBy(*by).orderBy(F.desc("_at"))
    top = started.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "item"))), lambda s: s["item"]).alias("names"))


def consolidate(topics: DataFrame, obs: DataFrame, patterns: DataFrame, min_observations: int = 6, take: int = 10, at_least: int = 5) -> DataFrame:
    """One entry per busy topic without a pattern: its ten most important observations joined, cut at 500 characters."""
    n = topics.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") >= min_observations)
    free = n.join(patterns, "topic", "left_anti")
    w = Window.partitionBy("topic").orderBy(F.desc("importance"), "id")
    t = topics.join(free.select("topic"), "topic").join(obs.select("id", "importance", F.substring("content", 1, 100).alias("line")), "id")
    t = t.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= take)
    g = t.groupBy("topic").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "line"))), lambda s: s["line"]), "; ").alias("j"))
    return g.where(F.col("n") >= at_least).select(F.concat("topic", F.lit(" knowledge (consolidated)")).alias("title"), F.concat(
        F.lit("Consolidated from "), F.col("n").cast("string"), F.lit(" observations on "), "topic", F.lit(": "), F.substring("j", 1, 500)).alias("content"))


def lines_per(df: DataFrame, by: list[str], rank: str, line: str, sep: str, out: str) -> DataFrame:
    """Already cut top-k rows of each group joined in rank order."""
    return df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, line))), lambda s: s[line]), sep).alias(out))


def profile(k: DataFrame, by: list[str]) -> DataFrame:
    """Top titles per section as text: decisions, patterns, tech and recent issues."""
    c = F.col("category")
    section = F.when(c == "decision", 0).when(c == "pattern", 1).when(c.isin("api", "component"), 2).when(c == "error", 3)
    key = F.when(c.isin("decision", "error"), F.unix_micros("created_at")).otherwise(F.col("access_count"))
    k = k.where(section.isNotNull()).withColumns({"_s": section, "_k": key})
    w = Window.partitionBy(*by, "_s").orderBy(F.desc("_k"), "id")
    top = k.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.when(F.col("_s") < 2, 5).otherwise(3))
    label = F.element_at(F.array(*[F.lit(x) for x in ("Decisions: ", "Patterns: ", "Tech: ", "Recent issues: ")]), F.col("_s") + 1)
    t = lines_per(top, [*by, "_s"], "_r", "title", ", ", "_t").withColumn("_t", F.concat(label, "_t"))
    return lines_per(t, by, "_s", "_t", "\n", "profile")


def critical_lines(k: DataFrame, by: list[str], as_of, budget: int, take: int = 10) -> DataFrame:
    """The primer's critical layer: of all entries the top ones by relevance·(1 + log2(access+1))·recency, within a token budget."""
    age = F.greatest(F.lit(0.0), E.days_between(F.coalesce("last_accessed", "created_at"), as_of))
    s = F.col("relevance_score") * (1 + F.log2(F.greatest(F.lit(1), F.col("access_count") + 1))) * E.decay(age, 7)
    pool = k.withColumns({"score": s, "line": F.concat(F.lit("- "), "title", F.lit(": "), F.substring("content", 1, 120))})
    w = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), "id")
    pool = pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= take)
    pool = pool.withColumn("used", F.sum(E.estimate_tokens("line")).over(w))
    return pool.where(F.col("used") <= budget)


def narrative(o: DataFrame, by: list[str], style: str, patterns: DataFrame | None = None, people: DataFrame | None = None, tasks: DataFrame | None = None) -> DataFrame:
    """One text per group in a style: pr, standup, adr or onboarding.

    Newest ten decisions, five errors and ten changes per group feed the text;
    ``patterns`` / ``people`` (group, names) feed onboarding, ``tasks`` (group, names) the standup's next steps.
    """
    t = F.col("type")
    kind = F.when(t == "decision", "d").when(t == "error", "e").when(t.isin("code", "commit"), "c")
    w = Window.partitionBy(*by, "_k").orderBy(F.desc("indexed_at"), "id")
    o = o.withColumn("_k", kind).where("_k is not null").withColumn("_r", F.row_number().over(w))
    o = o.where(F.col("_r") <= F.when(F.col("_k") == "e", 5).otherwise(10)).withColumn("_l", F.substring("content", 1, 150))
    item = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") == k, F.struct("_r", "_l")))), lambda s: s["_l"])
    g = o.groupBy(*by).agg(item("d").alias("d"), item("e").alias("e"), item("c").alias("c"))
    for name, extra in (("p", patterns), ("w", people), ("t", tasks)):
        g = g.join(extra.withColumnRenamed("names", name), by, "left") if extra is not None else g.withColumn(name, F.array().cast("array<string>"))
    bullets = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n")
    or_else = lambda a, text: F.when(F.size(a) > 0, bullets(a)).otherwise(text)
    part = lambda title, a: F.when(F.size(a) > 0, F.concat(F.lit(f"\n\n{title}\n"), bullets(a))).otherwise("")
    top = lambda c, n: F.slice(F.col(c), 1, n)
    d, e, c = F.col("d"), F.col("e"), F.col("c")
    if style == "pr":
        text = F.concat(F.lit("## Summary\n"), or_else(c, "No code changes recorded."), part("## Decisions", d), part("## Issues Resolved", e),
                        F.lit("\n\n## Test Plan\n- [ ] Verify changes work as expected\n- [ ] Run existing test suite"))
    elif style == "standup":
        text = F.concat(F.lit("**Done:**\n"), or_else(top("c", 3), "- No changes recorded"), F.lit("\n\n**Next:**\n"), or_else(F.coalesce("t", F.array().cast("array<string>")), "- Continue current work"), F.lit("\n\n**Blockers:**\n"), or_else(top("e", 2), "- None"))
    elif style == "adr":
        text = F.concat(F.lit("# "), F.coalesce(F.get(d, F.lit(0)), F.lit("Untitled Decision")), F.lit("\n\n## Context\n"), or_else(e, "- Context not recorded"),
                        F.lit("\n\n## Decision\n"), or_else(d, "- Decision not recorded"), F.lit("\n\n## Consequences\n"), or_else(top("c", 3), "- Consequences not yet observed"))
    else:
        text = F.concat(F.lit("# Project Overview"), part("## Architecture & Patterns", F.col("p")), part("## Key Decisions", d), part("## Team", F.col("w")))
    return g.select(*by, text.alias("text"))


#: Snapshot categories and their priority.
SNAPSHOT_PRIORITY = {"files": 1, "tasks": 1, "rules": 1, "changes": 1, "decisions": 2, "errors": 2, "cwd": 2, "git": 2, "env": 2, "plan": 2,
                     "mcp_tools": 3, "intent": 3, "knowledge": 3, "stats": 3, "search_history": 3, "correlations": 3}


def snapshot_categories(obs: DataFrame, events: DataFrame, tokens: DataFrame, know: DataFrame) -> DataFrame:
    """(session_id, category, priority, content): every category a session has something for.

    ``obs(session_id, id, type, summary, file_path, edited, tool, correlation_id, indexed_at)``,
    ``events(session_id, id, event_type, ts, item)``, ``tokens(session_id, tokens_in, tokens_out)``.
    """
    newest = lambda df, k, at="indexed_at": df.withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc(at), F.desc("id")))).where(F.col("_r") <= k)
    text = lambda df, line, sep="\n": lines_per(df.withColumn("_l", line), ["session_id"], "_r", "_l", sep, "content")
    dash = lambda c: F.concat(F.lit("- "), c)
    out = {}
    # counts are over all rows of the session; files and tools are then ranked
    f = obs.where("file_path is not null")
    per = f.groupBy("session_id", "file_path").agg(F.max(F.struct("indexed_at", "id")).alias("_last"), F.sum((~F.col("edited")).cast("int")).alias("r"), F.sum(F.col("edited").cast("int")).alias("w"))
    per = per.withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("_last")))).where("_r <= 10")
    out["files"] = text(per, F.concat(F.lit("- "), "file_path", F.lit(" (read:"), F.col("r").cast("string"), F.lit(", write:"), F.col("w").cast("string"), F.lit(")")))
    done = events.where("event_type = 'task_complete'").select("session_id", "item").distinct()
    out["tasks"] = text(newest(events.where("event_type = 'task_start'").join(done, ["session_id", "item"], "left_anti"), 20, "ts"), dash(F.col("item")))
    rules = obs.where(F.col("file_path").rlike("rules|CLAUDE.md|GEMINI.md")).select("session_id", "file_path").distinct()
    rules = rules.withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy("file_path"))).where("_r <= 5")
    out["rules"] = text(rules, dash(F.col("file_path")))
    ch = newest(obs.where(F.col("tool").isin("Edit", "Write") & F.col("file_path").isNotNull()), 15)
    short = F.array_join(F.slice(F.split("file_path", "/"), F.greatest(F.size(F.split("file_path", "/")) - 1, F.lit(1)), F.lit(2)), "/")
    out["changes"] = text(ch, F.concat(F.lit("- "), "tool", F.lit(" "), short, F.lit(": "), F.substring(F.trim(F.regexp_replace(F.substring("summary", 1, 150), "\n", " ")), 1, 100)))
    for name, kind, k in (("decisions", "decision", 5), ("errors", "error", 3), ("git", "commit", 3)):
        out[name] = text(newest(obs.where(F.col("type") == kind), k), dash(F.coalesce("summary", F.lit("(no summary)"))))
    out["cwd"] = text(newest(events.where("event_type = 'cwd_change'"), 1, "ts"), F.col("item"))
    out["env"] = text(newest(events.where("event_type = 'dependency_change'"), 5, "ts"), dash(F.coalesce("item", "event_type")))
    out["plan"] = text(newest(events.where("event_type = 'plan'"), 1, "ts"), F.coalesce("item", F.lit("Active plan exists")))
    ev = events.groupBy("session_id", "event_type").agg(F.count("*").alias("n"))
    ev = ev.withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "event_type"))).where("_r <= 8")
    out["mcp_tools"] = text(ev, F.concat_ws(":", "event_type", "n"), ", ")
    ty = obs.groupBy("session_id", "type").agg(F.count("*").alias("n"))
    ty = ty.withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "type")))
    mode = F.when(F.col("type") == "error", "investigating").when(F.col("type") == "code", "implementing").when(F.col("type") == "decision", "reviewing").otherwise("general")
    head = ty.where("_r = 1").select("session_id", mode.alias("mode"))
    out["intent"] = text(ty, F.concat_ws(":", "type", "n"), ", ").join(head, "session_id").select("session_id", F.concat(F.lit("Mode: "), "mode", F.lit(" ("), "content", F.lit(")")).alias("content"))
    kn = know.orderBy(F.desc("created_at"), "id").limit(5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.unix_micros("created_at"), "id", "category", "title"))),
                                                               lambda s: F.concat(F.lit("- ["), s["category"], F.lit("] "), s["title"])), "\n").alias("c"))
    out["knowledge"] = obs.select("session_id").distinct().withColumn("content", kn.scalar())
    st = tokens.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("tokens_in").alias("i"), F.sum("tokens_out").alias("o"))
    saved = F.greatest(F.lit(0), F.col("i") - F.col("o"))
    out["stats"] = st.select("session_id", F.concat(F.lit("Observations: "), F.col("n").cast("string"), F.lit(", Tokens saved: "), saved.cast("string"), F.lit(" ("),
                                                    F.when(F.col("i") > 0, F.floor(saved / F.when(F.col("i") > 0, F.col("i")) * 100 + 0.5)).otherwise(0).cast("string"), F.lit("%)")).alias("content"))
    out["search_history"] = text(newest(events.where("event_type = 'search'"), 5, "ts"), F.concat(F.lit('- "'), F.coalesce("item", F.lit("?")), F.lit('"')))
    co = obs.where("correlation_id is not null").groupBy("session_id", "correlation_id").agg(F.count("*").alias("n"))
    co = co.withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "correlation_id"))).where("_r <= 5")
    out["correlations"] = text(co, F.concat(F.lit("- "), "correlation_id", F.lit(" ("), F.col("n").cast("string"), F.lit(" observations)")))
    every = None
    for name, df in out.items():
        one = df.select("session_id", F.lit(name).alias("category"), F.lit(SNAPSHOT_PRIORITY[name]).alias("priority"), "content")
        every = one if every is None else every.unionByName(one)
    return every


def as_maps(cats: DataFrame) -> DataFrame:
    """(session_id, snapshot): the categories of a session as a map."""
    return cats.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "content")))).alias("snapshot"))


def restore(snapshots: DataFrame, as_of, stale_days: int = 7) -> DataFrame:
    """Snapshots older than a week keep only their first-priority categories and the stats."""
    old = older_than("created_at", stale_days, as_of)
    first = [c for c, p in SNAPSHOT_PRIORITY.items() if p == 1] + ["stats"]
    return snapshots.withColumns({"condensed": old, "snapshot": F.when(old, F.map_filter("snapshot", lambda k, v: k.isin(*first))).otherwise(F.col("snapshot"))})


#: Continuation sections in order.
CONTINUATION = [("changes", "### Recent changes"), ("files", "### Active files"), ("tasks", "### Pending tasks"), ("decisions", "### Key decisions"),
                ("errors", "### Recent errors"), ("plan", "### Active plan")]


def continuation(snapshots: DataFrame, as_of, summary: str | None = None):
    """Hand-off text: a dated heading, the chain summary, then the snapshot's sections."""
    def section(title, body):
        return F.when(body.isNotNull() & (body != ""), F.concat(F.lit(title + "\n"), body, F.lit("\n\n"))).otherwise("")
    parts = [F.concat(F.lit("## Session Handoff — "), F.date_format(col(as_of), "yyyy-MM-dd HH:mm"), F.lit("\n\n"))]
    if summary:
        parts.append(section("### Summary", F.col(summary)))
    parts += [section(title, F.col("snapshot")[name]) for name, title in CONTINUATION]
    return snapshots.withColumn("text", F.rtrim(F.concat(*parts), F.lit("\n")))


def append_chain(chains: DataFrame, new: DataFrame) -> DataFrame:
    """New sessions take the chain of their parent, else start their own; one level per call (deeper levels: chain_walk)."""
    parent = chains.select(F.col("session_id").alias("parent_session"), "chain_id")
    n = new.join(chains.select("session_id"), "session_id", "left_anti").join(parent, "parent_session", "left")
    return n.withColumn("chain_id", F.coalesce("chain_id", F.concat(F.lit("chain-"), F.col("session_id").cast("string"))))
