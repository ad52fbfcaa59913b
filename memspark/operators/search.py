"""Search products built from the strategies: knowledge, chunks, browse, prompts, related context."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from ..functions import language as L
from ..functions.enrich import context_snippet, decay
from ..functions.text import words_ws
from ..session import cut
from . import index as I, query_forms as Q, retrieval as R


def raw_words(text="text"):
    """Words of a query with the operator characters of a search box removed."""
    t = F.regexp_replace(F.col(text), r'["*()\-^:+{}\[\]]', " ")
    t = F.regexp_replace(t, r"(?i)(?<![A-Za-z0-9_])(?:AND|OR|NOT|NEAR)(?![A-Za-z0-9_])", " ")
    return F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")


def box_words(text="text"):
    """Words of a query with all punctuation but hyphens dropped."""
    return F.filter(F.split(F.regexp_replace(F.trim(F.col(text)), r"[^\w\s-]", ""), r"\s+"), lambda w: w != "")


def knowledge_search(know: DataFrame, index, queries: DataFrame, as_of, limit: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """Full text, else trigram, else whole-query substring; scored by age and use.

    ``know(id, title, content, source_type, created_at, access_count[, relevance_score])``; ``index`` holds its title and content
    as one text. The first leg that finds anything for a query answers it, and all that it finds is scored. ``allowed(id)``
    (for example the facts valid at a time) is applied before that.
    """
    keep = (lambda d: d) if allowed is None else (lambda d: d.join(allowed.select("id"), "id", "left_semi"))
    matched = keep(R.score_clauses(index, Q.all_words(queries, raw_words())))
    # a leg decides who needs the next one: written once, not recomputed
    leg1 = cut(matched.select("query_id", "id", F.lit(1).alias("leg")), "leg")
    left2 = queries.select("query_id", F.array_join(raw_words(), " ").alias("text")).join(leg1, "query_id", "left_anti")
    leg2 = cut(keep(contains_all(index, left2)).select("query_id", "id", F.lit(2).alias("leg")), "leg")
    left3 = queries.join(leg1, "query_id", "left_anti").join(leg2, "query_id", "left_anti")
    leg3 = keep(contains_text(know, "id", ["title", "content"], left3, index)).select("query_id", "id", F.lit(3).alias("leg"))
    hits = leg1.unionByName(leg2).unionByName(leg3).join(know, "id")
    age = (F.unix_micros(as_of) - F.unix_micros("created_at")) / 86400e6
    age = F.when(F.col("source_type") == "explicit", age * 0.8).otherwise(age)
    rel = F.coalesce(F.col("relevance_score"), F.lit(1.0)) if "relevance_score" in know.columns else F.lit(1.0)
    score = rel * (0.5 + 0.3 * decay(age, 14) + 0.2 * (F.log2(F.col("access_count") + 2) / 10))
    return R.top_k(hits.withColumn("score", score), limit).select("query_id", "id", "leg", "score", "rank")


def contains_all(source, queries: DataFrame) -> DataFrame:
    """(query_id, id): texts that hold every query word of 3 characters or more as a substring.

    ``source`` is a written index, or ``R.WordRows`` of a table without one.
    """
    terms = cut(queries.select("query_id", F.explode(F.array_distinct(words_ws("text"))).alias("term")).where(F.length("term") >= 3), "terms")
    pairs = cut(R.substring_pairs(source, terms.select("term").distinct()), "pairs")
    terms = R.answerable(pairs, terms)
    pairs = pairs.join(terms.select("term").distinct(), "term", "left_semi")
    post = cut(source.word_postings(pairs.select("word")).select("id", "word"), "words")
    return R.holding_all(post, pairs, terms)


def contains_text(df: DataFrame, id_: str, texts: list[str], queries: DataFrame, index=None) -> DataFrame:
    """(query_id, id): some text column holds the whole query (without case).

    The inner words of the query must occur as whole words of the text, so the
    rarest of them picks the candidates; only those pairs read the text. Queries without an inner
    word fall back to matching on their trigrams. ``index`` is a written index over the columns joined by white space.
    """
    body = df.select(F.col(id_).alias("id"), F.lower(F.concat_ws("\n", *texts)).alias("_body"), *[F.lower(t).alias(f"_c{i}") for i, t in enumerate(texts)])
    source = R.WordRows(body, "id", "_body") if index is None else index
    q = cut(queries.select("query_id", F.lower(F.trim("text")).alias("_q")), "queries")
    words = F.split("_q", r"\s+")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    terms = q.where(F.size(inner) > 0).select("query_id", F.explode(F.array_distinct(inner)).alias("word"))
    post = cut(source.word_postings(terms.select("word")).select("id", "word"), "words")
    freq = post.groupBy("word").agg(F.count("*").alias("f"))
    rare = terms.join(freq, "word", "left").groupBy("query_id").agg(F.min_by("word", F.struct(F.coalesce("f", F.lit(0)), "word")).alias("word"))
    cand = rare.join(post, "word").select("query_id", "id")
    cand = cand.unionByName(contains_all(source, q.where(F.size(inner) == 0).select("query_id", F.col("_q").alias("text"))))
    # few as a rule: written, so that the planner sees their size and need not shuffle the texts to meet them
    full = cut(cand, "candidates").join(body, "id").join(q, "query_id")
    hit = F.lit(False)
    for i in range(len(texts)):
        hit = hit | F.contains(F.col(f"_c{i}"), F.col("_q"))
    return full.where(hit).select("query_id", "id")


def knowledge_list(know: DataFrame, index, substring_index, queries: DataFrame, limit: int = 50) -> DataFrame:
    """Entries that hold some word of the search box, the most used first; a box without a word is looked for as it is.

    ``index`` answers words, ``substring_index`` (title and content) substrings; ``know(id, title, content, access_count)``.
    """
    words = box_words()
    form = Q.any_word(queries, words)
    use = know.select("id", "access_count")
    # the first entries of a query are among the first of some word of it
    ranked = I.phrase_hits(index, form).select("phrase", "id").join(use, "id").withColumn(
        "rank", F.dense_rank().over(Window.partitionBy("phrase").orderBy(F.desc("access_count"), "id")))
    first = cut(ranked.where(F.col("rank") <= limit).select("phrase", "id").distinct(), "first")
    matched = first.join(form.select("query_id", "phrase"), "phrase").select("query_id", "id")
    blank = contains_text(know, "id", ["title", "content"], queries.where(F.size(words) == 0), substring_index)
    found = matched.unionByName(blank).distinct().join(use, "id")
    w = Window.partitionBy("query_id").orderBy(F.desc("access_count"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def category_list(know: DataFrame, limit: int = 20) -> DataFrame:
    """The newest entries of each category that are not archived; ``know(id, category, created_at, archived, ...)``."""
    w = Window.partitionBy("category").orderBy(F.desc("created_at"), F.desc("id"))
    return know.where("not archived").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def chunk_search(chunks: DataFrame, index, queries: DataFrame, limit: int = 5, budget: int = 1536) -> DataFrame:
    """OR search over heading + content with identifiers split, filled up to a byte budget.

    ``chunks(id, heading, content, has_code)``; ``index`` holds heading and content as one text. Text chunks show a snippet; the
    first one that overflows is cut to the room left (or dropped below 100
    bytes) and ends the list; code is never cut.
    """
    base = raw_words()
    flat = F.array_join(base, " ")
    split = F.filter(F.split(F.regexp_replace(F.replace(flat, F.lit("_"), F.lit(" ")), "([a-z])([A-Z])", "$1 $2"), r"\s+"), lambda w: w != "")
    q = queries.select("query_id", F.array_distinct(F.concat(base, split)).alias("ws"))
    top = R.bm25_any(index, Q.any_word(q, F.col("ws")), limit)
    r = top.join(chunks, "id").join(queries.select("query_id", "text"), "query_id")
    r = r.withColumn("shown", F.when(F.col("has_code"), F.col("content")).otherwise(context_snippet("content", "text")))
    r = r.withColumn("bytes", F.octet_length("shown").cast("bigint"))
    w = Window.partitionBy("query_id").orderBy("rank")  # at most `limit` rows per query
    r = r.withColumn("used", F.sum("bytes").over(w) - F.col("bytes"))
    over = ~F.col("has_code") & (F.col("used") + F.col("bytes") > budget)
    r = r.withColumn("_over", over).withColumn("_first", F.sum(F.col("_over").cast("int")).over(w))
    room = budget - F.col("used")
    r = r.where((F.col("_first") == 0) | ((F.col("_first") == 1) & F.col("_over") & (room > 100)))
    return r.select("query_id", "id", "rank", "score", F.when(F.col("_over"), F.concat(F.substr("shown", F.lit(1), room.cast("int")), F.lit("..."))).otherwise(
        F.col("shown")).alias("shown"))


def browse(rows: DataFrame, by: str, limit: int) -> DataFrame:
    """Importance first, then newest, per browsed value; ``rows`` already carries that value."""
    w = Window.partitionBy(by).orderBy(F.desc("importance"), F.desc("indexed_at"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def prompt_memories(know: DataFrame, know_index, obs: DataFrame, obs_index, prompts: DataFrame, budget: int = 1200, max_terms: int = 10, lines: int = 3) -> DataFrame:
    """Up to ``lines`` knowledge rows by relevance, filled with observations by importance, within a character budget.

    ``know(id, title, content, relevance_score)``, ``obs(id, type, content, importance, indexed_at)``; the indexes hold title and content, and content.
    A prompt asks for its first ``max_terms`` terms: more words of a long prompt, all of which must match, would find nothing.
    """
    terms = prompts.select("query_id", F.slice(L.question_terms("text"), 1, max_terms).alias("ws"))
    kw = R.score_clauses(know_index, Q.all_words(terms, F.col("ws"))).select("query_id", "id").join(know, "id").select(
        "query_id", "id", F.lit("knowledge").alias("kind"), F.col("title"), F.substring("content", 1, 200).alias("body"),
        F.col("relevance_score").alias("s"), F.lit(None).cast("timestamp").alias("t"))
    ob = R.score_clauses(obs_index, Q.all_words(terms, F.col("ws"))).select("query_id", "id").join(obs, "id").select(
        "query_id", "id", F.lit("observation").alias("kind"), F.col("type").alias("title"), F.substring("content", 1, 200).alias("body"),
        F.col("importance").alias("s"), F.col("indexed_at").alias("t"))
    w = Window.partitionBy("query_id").orderBy(F.when(F.col("kind") == "knowledge", 0).otherwise(1), F.desc("s"), F.desc("t"), "id")
    m = kw.unionByName(ob).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= lines)
    label = F.when(F.col("kind") == "knowledge", "Knowledge: ").otherwise("Observation: ")
    m = m.withColumn("line", F.concat(label, "title", F.lit(" — "), "body"))
    run = F.sum(F.length("line")).over(Window.partitionBy("query_id").orderBy("rank"))
    return m.withColumn("chars", run + 40).where(F.col("chars") <= budget).select("query_id", "rank", "kind", "id", "line")


def hybrid(keyword: DataFrame, vector: DataFrame, k: int, w_keyword: float = 0.55, w_vector: float = 0.45) -> DataFrame:
    """score/max·0.55 from keywords plus cosine·0.45 from vectors, per document."""
    top = keyword.groupBy("query_id").agg(F.max("score").alias("_m"))
    a = keyword.join(top, "query_id").select("query_id", "id", F.when(F.col("_m") > 0, F.col("score") / F.col("_m") * w_keyword).otherwise(0.0).alias("score"))
    b = vector.select("query_id", "id", (F.col("score") * w_vector).alias("score"))
    return R.top_k(a.unionByName(b).groupBy("query_id", "id").agg(F.sum("score").alias("score")), k)


def blended(hits: DataFrame, as_of, k: int) -> DataFrame:
    """Dashboard ranking: min(1, bm25/30), recency and access by intent weights, times 1 + boost/10.

    ``hits(query_id, intent, id, type, score, indexed_at, access_count)``; here a
    recommendation query ranks as a general one and boosts nothing.
    """
    i = F.when(F.col("intent") == "recommendation", "general").otherwise(F.col("intent"))
    w = [F.lit(x) for x in R.INTENT_WEIGHTS["general"]]
    for name, ws in R.INTENT_WEIGHTS.items():
        w = [F.when(i == name, v).otherwise(o) for v, o in zip(ws, w)]
    age = (F.unix_micros(as_of) - F.unix_micros("indexed_at")) / 86400e6
    s = (w[0] * F.least(F.lit(1.0), F.col("score") / 30) + w[1] * decay(age, 7) + w[2] * F.log2(F.col("access_count") + 2) / 10)
    boost = L.type_boost(i, "type")
    s = s * F.when(boost > 0, 1 + boost * 0.1).otherwise(1.0)
    return R.top_k(hits.withColumn("score", s), k)


def evaluator_search(tok: DataFrame, clauses: DataFrame, queries: DataFrame, texts: DataFrame, trigram: DataFrame, limit: int, syn=None) -> DataFrame:
    """Keyword candidates, trigram hits ×0.3 where fewer than ``limit`` were found, plus an additive content boost."""
    s = R.top_clauses(tok, clauses, limit * 5)
    main = cut(s.groupBy("query_id", "id").agg(F.max(F.col("score") * F.col("weight")).alias("score")), "candidates")
    enough = main.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= limit).select("query_id")
    fill = trigram.select("query_id", "id", (F.col("score") * 0.3).alias("score")).join(enough, "query_id", "left_anti").join(main, ["query_id", "id"], "left_anti")
    c = cut(main.unionByName(fill), "candidates").join(texts, "id")
    b = R.content_boost(c, queries, "content", 3.0, 1.5, syn)
    return R.top_k(b.withColumn("score", F.col("score") + F.col("boost")), limit).select("query_id", "id", "score", "rank")


def overlap_rerank(cands: DataFrame, queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """score · (1 + share of query keywords the text holds)."""
    c = cands.join(queries.select("query_id", L.search_keywords("text").alias("_kw")), "query_id").join(texts, "id")
    low = F.lower("content")
    share = F.when(F.size("_kw") > 0, F.size(F.filter("_kw", lambda w: F.contains(low, w))) / F.greatest(F.size("_kw"), F.lit(1))).otherwise(0.0)
    return R.top_k(c.withColumn("score", F.col("score") * (1 + share)).drop("rank"), k).select("query_id", "id", "score", "rank")


def related_context(actions: DataFrame, obs: DataFrame, know: DataFrame, know_index, edges: DataFrame, shared: DataFrame, shared_index, as_of,
                    threshold: float = 0.6, per_action: int = 4) -> DataFrame:
    """Scored context lines for a table of actions ``(action_id, query, path)``.

    Legs: the file's last three errors and decisions (.9·recency), patterns and
    decisions that match the query (.8·(.7+.2·recency+.1·access), three most
    used), graph neighbours of the file (.5, five), entities named with the
    file (.4), and other projects' knowledge (.48, two) when fewer than two
    strong lines were found. The indexes hold title and content of ``know`` and of ``shared``.
    """
    age = lambda c: (F.unix_micros(as_of) - F.unix_micros(c)) / 86400e6
    actions = cut(actions.select("action_id", "query", "path"), "actions")
    # what is found by the file: the best rows of a path first, then of an action; a line that can't be shown is not carried
    row = lambda leg, most, o1=None, o2=None, o3=None, o4=None: [F.lit(leg).alias("leg"), F.lit(most).alias("most"), (F.lit(None) if o1 is None else o1).cast("double").alias("o1"), (
        F.lit(None).cast(dict(obs.dtypes)["id"]) if o2 is None else F.col(o2)).alias("o2"), *[(F.lit(None).cast("string") if o is None else F.col(o)).alias(n) for n, o in (("o3", o3), ("o4", o4))]]
    fresh = decay(age("indexed_at"), 7) * 0.9
    bugs = obs.where(F.col("type").isin("error", "decision")).select(
        F.col("file_path").alias("path"), *row("bug-history", 3, -F.unix_micros("indexed_at"), "id"), F.when(fresh >= threshold, F.substring("content", 1, 200)).alias("line"), fresh.alias("score"))
    graph = edges.select(F.col("src").alias("path"), F.col("dst").alias("name"), "type").unionByName(edges.select(F.col("dst").alias("path"), F.col("src").alias("name"), "type")).select(
        "path", *row("graph", 5, None, None, "type", "name"), F.concat("type", F.lit(": "), "name").alias("line"), F.lit(0.5).alias("score"))
    co = obs.where((F.col("importance") >= 0.6) & (F.size("entities") > 0)).select(
        F.col("file_path").alias("path"), *row("entities", 1, -F.col("importance"), "id"), F.concat(F.lit("Related: "), F.array_join(F.slice("entities", 1, 3), ", ")).alias("line"), F.lit(0.4).alias("score"))
    order = [F.asc_nulls_last("o1"), "o2", "o3", "o4"]
    def best(rows, by):
        return rows.withColumn("rk", F.row_number().over(Window.partitionBy(by, "leg").orderBy(*order))).where("rk <= most").drop("rk")
    of_path = best(bugs.unionByName(graph).unionByName(co).where("path IS NOT NULL").repartition("path"), "path")
    of_file = cut(best(actions.where("path is not null").select("action_id", "path").join(of_path, "path"), "action_id").select("action_id", "line", "score", "leg"), "files")
    ask = actions.where("query is not null").select(F.col("query").alias("text")).distinct().select("text", F.col("text").alias("query_id"))
    words = ask.select("query_id", F.filter(F.split(F.trim(F.regexp_replace("text", r"[^\w\s-]", " ")), r"\s+"), lambda w: F.length(w) > 1).alias("ws"))
    form = cut(Q.any_word(words, F.col("ws")).select("query_id", "phrase"), "words")
    phrases = cut(form.select("phrase").distinct(), "phrases")
    def match(frame, index, most, *order):
        """The first ``most`` rows of ``frame`` for each query: they are among the first of some word of it."""
        hits = I.phrase_hits(index, phrases).select("phrase", "id").distinct().join(frame, "id")
        first = hits.withColumn("rk", F.row_number().over(Window.partitionBy("phrase").orderBy(*order))).where(F.col("rk") <= most).select("phrase", "id").distinct()
        found = form.join(cut(first, "first"), "phrase").select("query_id", "id").distinct().join(frame, "id")
        return cut(found.withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rk") <= most), "matches")
    by_query = actions.select("action_id", F.col("query").alias("query_id"))
    entry = lambda d, *more: d.select("id", "category", "title", *more)
    pat = match(entry(know.where(F.col("category").isin("pattern", "decision")), "created_at", "access_count"), know_index, 3, F.desc("access_count"), "id")
    pat = by_query.join(pat, "query_id").select(
        "action_id", F.concat("category", F.lit(": "), "title").alias("line"),
        (0.8 * (0.7 + 0.2 * decay(age("created_at"), 7) + 0.1 * (F.log2(F.col("access_count") + 2) / 10))).alias("score"), F.lit("pattern").alias("leg"))
    strong = of_file.where("leg = 'bug-history'").select("action_id").unionByName(pat.select("action_id"))  # at most six rows per action
    many = strong.groupBy("action_id").agg(F.count("*").alias("n")).where("n >= 2").select("action_id")
    other = match(entry(shared, "project"), shared_index, 2, F.col("id"))
    cross = (by_query.join(other, "query_id").join(many, "action_id", "left_anti")
             .select("action_id", F.concat(F.lit("["), "project", F.lit("] "), "category", F.lit(": "), "title").alias("line"), F.lit(0.48).alias("score"), F.lit("cross-project").alias("leg")))
    every = of_file.unionByName(pat).unionByName(cross).where(F.col("score") >= threshold)
    w = Window.partitionBy("action_id").orderBy(F.round("score", 9).desc(), "leg", "line")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_action)


def event_hits(source, asked: DataFrame) -> DataFrame:
    """(query_id, id): events whose kind or payload holds some word of ``asked(query_id, w)`` as a substring; ``source`` holds both as one text."""
    pairs = cut(R.substring_pairs(source, asked.select(F.col("w").alias("term")).distinct()), "pairs")
    found = source.word_postings(pairs.select("word")).join(pairs, "word").select(F.col("term").alias("w"), "id").distinct()
    return asked.join(found, "w").select("query_id", "id").distinct()


def answer_sources(questions: DataFrame, know: DataFrame, know_index, obs: DataFrame, obs_index, events: DataFrame, event_index, people: DataFrame, as_of, limit: int = 20) -> DataFrame:
    """Question answering retrieval: legs routed by intent, merged by relevance, one row per source.

    Knowledge scores its decayed relevance (top 10, by category for why / how),
    persons 0.6, observations 0.5 (top 10, code for how), events 0.4 (the newest 10 that match).
    The indexes hold title and content, content, and kind and payload.
    """
    q = questions.select("query_id", L.question_intent("text").alias("intent"), F.array_join(L.question_terms("text"), " ").alias("text"))
    q = cut(q.where("text <> ''"), "questions")
    of = lambda *names: q.where(F.col("intent").isin(*names))
    src = lambda d, kind: d.select("query_id", F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "score")
    legs = [src(knowledge_search(know, know_index, of("what", "who", "why", "general"), as_of), "knowledge")]
    legs.append(src(knowledge_search(know, know_index, of("why"), as_of, allowed=know.where("category = 'decision'")), "knowledge"))
    legs.append(src(knowledge_search(know, know_index, of("how"), as_of, allowed=know.where("category = 'pattern'")), "knowledge"))
    def observed(qs, rows=None):
        scored = R.score_clauses(obs_index, Q.all_words(qs, words_ws("text")))
        scored = scored if rows is None else scored.join(rows.select("id"), "id", "left_semi")
        return src(R.top_k(scored, 10).withColumn("score", F.lit(0.5)), "observation")
    legs.append(observed(of("what", "when", "general")))
    legs.append(observed(of("how"), obs.where("type = 'code'")))
    words = of("when", "general").select("query_id", F.explode(words_ws("text")).alias("w")).distinct()
    newest = Window.partitionBy("query_id").orderBy(F.desc("ts"), F.desc("id"))
    ev = event_hits(event_index, words).join(events.select("id", "ts"), "id").withColumn("rk", F.row_number().over(newest)).where("rk <= 10")
    legs.append(src(ev.withColumn("score", F.lit(0.4)), "event"))
    who = of("who", "general").select("query_id", F.explode(words_ws("text")).alias("w")).distinct()
    legs.append(src(who.join(people, F.lower("name") == F.col("w")).select("query_id", F.col("name").alias("id")).distinct().withColumn("score", F.lit(0.6)), "entity"))
    every = legs[0]
    for leg in legs[1:]:
        every = every.unionByName(leg)
    return best_per_source(every, limit)


def best_per_source(rows: DataFrame, limit: int = 20) -> DataFrame:
    """Distinct union of result lists: best relevance per source, then the top ``limit`` per query."""
    best = rows.groupBy("query_id", "kind", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "kind", "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
