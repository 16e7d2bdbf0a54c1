"""Registered queries over the given tables, and the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.functions import vectors as VX
from colloquy.operators import codes, embed, encoder, evaluate, export, filters, search, stats, sync
from colloquy.plans import rendered, stored, tools
from colloquy.plans.views import AS_OF, SQL, Views

WORDS, PHRASES = "The der the", "of_the the_of, THE!"
SCOPE = {"sources": ["claude-code", "codex", "kiro-cli", "cursor"], "time_range": "month"}
SCOPE_SQL = f"source IN ('claude-code', 'codex', 'kiro-cli', 'cursor') AND started_at >= {AS_OF - 30 * X.DAY_MS}"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the views under its name, with the SELECT that follows the views' WITH clause."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[fn.__name__] = SQL + sql
        return fn

    return add


def keyword_sql(text: str, condition: str = "true", fetch: int = 60) -> str:
    """CTEs up to kw(session_id, rank, snippet, wr): the keyword search in SQL."""
    words: dict[tuple, int] = {}
    for w in X.rewrite_query(text):
        if w:
            words[tuple(w)] = words.get(tuple(w), 0) + 1
    parts = []
    for w, times in words.items():
        joins = "".join(f" JOIN post p{i} ON p{i}.message_id = p0.message_id AND p{i}.pos = p0.pos + {i} AND p{i}.term = '{t}'" for i, t in enumerate(w[1:], 1))
        parts.append(f"SELECT '{' '.join(w)}' AS word, {times} AS times, p0.message_id, p0.session_id, count(*) AS f FROM post p0{joins} WHERE p0.term = '{w[0]}' GROUP BY ALL")
    return rf""",
toks AS (SELECT message_id, session_id, list_filter(string_split_regex(lower(strip_accents(content)), '[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda x: x <> '') AS ts FROM messages),
lens AS (SELECT message_id, len(ts) AS dl FROM toks),
post AS (SELECT message_id, session_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM toks),
held AS ({" UNION ALL ".join(parts)}),
idf AS (SELECT word, CASE WHEN raw <= 0 THEN 1e-6 ELSE raw END AS idf FROM (
  SELECT word, ln(((SELECT count(*) FROM lens) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM held GROUP BY word)),
scored AS (SELECT message_id, session_id, round(-sum(idf * times * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * dl / (SELECT avg(dl) FROM lens)))), 9) AS r
  FROM held JOIN idf USING (word) JOIN lens USING (message_id) GROUP BY ALL),
best AS (SELECT scored.session_id, min({{'r': r, 'm': message_id}}) AS b FROM scored JOIN sessions ON sessions.id = scored.session_id WHERE {condition} GROUP BY 1),
kw AS (SELECT t.session_id, b.r AS rank, substr(content, 1, 200) AS snippet, wr FROM (
  SELECT *, row_number() OVER (ORDER BY b.r, session_id) - 1 AS wr FROM best ORDER BY b.r, session_id LIMIT {fetch}) t JOIN messages ON message_id = b.m AND messages.session_id = t.session_id)
"""


def vector_sql(condition: str = "true", k: int = 300) -> str:
    """CTE vec(session_id, distance, vr): the vector search in SQL."""
    return f""",
near AS (SELECT message_id, list_distance(embedding, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS distance FROM vectors ORDER BY distance, message_id LIMIT {k}),
vec AS (SELECT *, row_number() OVER (ORDER BY distance, session_id) - 1 AS vr FROM (
  SELECT messages.session_id, min(distance) AS distance FROM near JOIN messages USING (message_id) JOIN sessions ON id = messages.session_id WHERE {condition} GROUP BY 1))
"""


FUSED = """,
fused AS (SELECT coalesce(kw.session_id, vec.session_id) AS session_id, coalesce(1.0 / (11 + wr), 0) + coalesce(1.0 / (11 + vr), 0) AS score,
  CASE WHEN wr IS NOT NULL AND vr IS NOT NULL THEN 'HYB' WHEN wr IS NOT NULL THEN 'FTS' ELSE 'VEC' END AS match, snippet
  FROM kw FULL OUTER JOIN vec ON kw.session_id = vec.session_id),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, session_id) AS position FROM fused QUALIFY position <= 20),
found AS (SELECT position, session_id, round(score, 9) AS score, match, snippet, source, title, directory, started_at FROM top JOIN sessions ON id = session_id)
"""


def _hybrid(v: Views, **scope) -> DataFrame:
    found = search.hybrid_search(v.sessions, v.messages, v.vectors, WORDS, v.query_vector, as_of_ms=AS_OF, **scope)
    return found.select("position", "session_id", F.round("score", 9).alias("score"), "match", "snippet", "source", "title", "directory", "started_at")


@query(keyword_sql(WORDS) + "SELECT session_id, rank, snippet FROM kw")
def fts_search(v: Views) -> DataFrame:
    return search.fts_search(v.sessions, v.messages, WORDS)


@query(keyword_sql(PHRASES) + "SELECT session_id, rank, snippet FROM kw")
def fts_phrase(v: Views) -> DataFrame:
    return search.fts_search(v.sessions, v.messages, PHRASES)


@query(keyword_sql(WORDS, SCOPE_SQL) + "SELECT session_id, rank, snippet FROM kw")
def fts_filtered(v: Views) -> DataFrame:
    return search.fts_search(v.sessions, v.messages, WORDS, condition=filters.session_filter(**SCOPE, as_of_ms=AS_OF))


@query(vector_sql() + "SELECT session_id, round(distance, 9) AS distance FROM vec")
def knn_search(v: Views) -> DataFrame:
    return search.knn_search(v.sessions, v.messages, v.vectors, v.query_vector).select("session_id", F.round("distance", 9).alias("distance"))


@query(keyword_sql(WORDS) + vector_sql() + FUSED + "SELECT * FROM found")
def hybrid_search(v: Views) -> DataFrame:
    return _hybrid(v)


@query(keyword_sql(WORDS, SCOPE_SQL) + vector_sql(SCOPE_SQL) + FUSED + "SELECT * FROM found")
def hybrid_filtered(v: Views) -> DataFrame:
    return _hybrid(v, **SCOPE)


@query(keyword_sql(WORDS, "directory ILIKE '/PROJ/1%'") + vector_sql("directory ILIKE '/PROJ/1%'") + FUSED + "SELECT * FROM found")
def hybrid_directory(v: Views) -> DataFrame:
    return _hybrid(v, directory="/PROJ/1")


_LABELS = ", ".join(f"('{s}', '{label}')" for s, label in filters.SOURCES)
_AGE = f"({AS_OF} - started_at) // 3600000"


@query(
    keyword_sql(WORDS) + vector_sql() + FUSED + f""", labels(source, label) AS (VALUES {_LABELS})
SELECT position, label, match, CASE WHEN {_AGE} < 1 THEN '<1h' WHEN {_AGE} < 24 THEN {_AGE} || 'h' WHEN {_AGE} // 24 < 30 THEN ({_AGE} // 24) || 'd' ELSE ({_AGE} // 720) || 'mo' END AS age,
  title, substr(snippet, 1, 120) AS snippet, coalesce(directory, '-') AS directory FROM found JOIN labels USING (source)"""
)
def result_listing(v: Views) -> DataFrame:
    return search.result_listing(_hybrid(v), filters.source_table(v.spark), AS_OF)


@query(f"SELECT id, source, title, started_at FROM sessions WHERE {SCOPE_SQL} ORDER BY started_at DESC, id LIMIT 50")
def recent_sessions(v: Views) -> DataFrame:
    return filters.recent_sessions(v.sessions, 50, as_of_ms=AS_OF, **SCOPE).select("id", "source", "title", "started_at")


@query(f"SELECT id, source, started_at FROM (SELECT * FROM sessions ORDER BY started_at DESC, id LIMIT 200) WHERE {SCOPE_SQL}")
def recent_then_filter(v: Views) -> DataFrame:
    return filters.recent_then_filter(v.sessions, SCOPE["sources"], SCOPE["time_range"], AS_OF).select("id", "source", "started_at")


@query(r"""SELECT session_id, seq, role, array_to_string(list_transform(string_split(substr(content, 1, 300), chr(10))[1:6], lambda l: regexp_replace(replace(l, chr(9), '    '), '\p{Cc}', '', 'g')), chr(10)) AS preview
FROM messages WHERE seq < 30""")
def session_preview(v: Views) -> DataFrame:
    return filters.preview(v.messages)


def lines_sql(needle: str) -> str:
    """Messages with a line that holds the needle, in SQL."""
    return rf"SELECT session_id, seq, role FROM messages WHERE len(list_filter(string_split(content, chr(10)), lambda l: contains(lower(regexp_replace(replace(l, chr(9), '    '), '\p{{Cc}}', '', 'g')), '{needle}'))) > 0"


@query(lines_sql("the t"))
def in_session_search(v: Views) -> DataFrame:
    return filters.in_session_search(v.messages, "The T")


STATE = """,
units AS (SELECT session_id, count(*) AS units_total, count(has) AS units_done FROM messages LEFT JOIN (SELECT DISTINCT message_id, 1 AS has FROM vectors WHERE message_id // 100000 % 3 <> 1) USING (message_id)
  WHERE role = 'user' AND length(content) > 2 GROUP BY 1),
state AS (SELECT id AS session_id, coalesce(units_total, 0) AS units_total, coalesce(units_done, 0) AS units_done,
  CASE WHEN coalesce(units_done, 0) >= coalesce(units_total, 0) THEN 'done' WHEN id IN ('s3', 's10') THEN 'failed' WHEN units_done > 0 THEN 'processing' ELSE 'pending' END AS status,
  CASE WHEN id IN ('s3', 's10') THEN 'out of memory' END AS last_error
  FROM sessions LEFT JOIN units ON id = session_id)
"""


def _state(v: Views) -> DataFrame:
    failed = v.sessions.where(F.col("id").isin("s3", "s10")).select(F.col("id").alias("session_id"), F.lit("out of memory").alias("error"), F.lit(1).alias("at"))
    return stats.embedding_state(v.sessions, v.messages, v.vectors.where("message_id div 100000 % 3 <> 1"), failed)  # a third of the sessions has no vectors yet


@query(STATE + "SELECT * FROM state")
def embedding_state(v: Views) -> DataFrame:
    return _state(v)


_COUNTS = "count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending"


@query(STATE + f"SELECT {_COUNTS} FROM state JOIN sessions ON id = session_id WHERE {SCOPE_SQL}")
def embedding_progress(v: Views) -> DataFrame:
    return stats.embedding_progress(v.sessions, _state(v), filters.session_filter(**SCOPE, as_of_ms=AS_OF))


@query(f"SELECT count(DISTINCT id) AS sessions, count(message_id) AS messages FROM sessions LEFT JOIN messages ON id = session_id WHERE {SCOPE_SQL}")
def scope_totals(v: Views) -> DataFrame:
    return stats.scope_totals(v.sessions, v.messages, filters.session_filter(**SCOPE, as_of_ms=AS_OF))


@query(
    STATE + f"""SELECT * FROM (SELECT count(DISTINCT id) AS sessions, count(message_id) AS messages FROM sessions LEFT JOIN messages ON id = session_id WHERE {SCOPE_SQL}),
(SELECT {_COUNTS} FROM state JOIN sessions ON id = session_id WHERE {SCOPE_SQL}),
(SELECT max_by(title, {{'a': coalesce(updated_at, started_at), 'b': id}}) AS processing_title FROM state JOIN sessions ON id = session_id WHERE status = 'processing' AND {SCOPE_SQL})"""
)
def scope_metrics(v: Views) -> DataFrame:
    return stats.scope_metrics(v.sessions, v.messages, _state(v), filters.session_filter(**SCOPE, as_of_ms=AS_OF))


@query(STATE + "SELECT session_id, title, units_total FROM state JOIN sessions ON id = session_id WHERE status = 'pending' ORDER BY coalesce(updated_at, started_at) DESC, session_id LIMIT 10")
def work_list(v: Views) -> DataFrame:
    return stats.work_list(v.sessions, _state(v), 10)


@query(
    STATE + """SELECT state.session_id, units_total, CASE WHEN n <= 10 THEN 'processing' ELSE status END AS status, CASE WHEN n <= 10 THEN NULL ELSE last_error END AS last_error FROM state LEFT JOIN (
  SELECT session_id, row_number() OVER (ORDER BY coalesce(updated_at, started_at) DESC, session_id) AS n FROM state JOIN sessions ON id = session_id WHERE status = 'pending') t USING (session_id)"""
)
def claim(v: Views) -> DataFrame:
    return stats.claim(v.sessions, _state(v), 10)[1].select("session_id", "units_total", "status", "last_error")


@query(STATE + "SELECT count(*) FILTER (status = 'pending') > 0 AS pending_exists FROM state")
def pending_exists(v: Views) -> DataFrame:
    return stats.pending_exists(_state(v))


@query("SELECT message_id, session_id FROM messages WHERE role = 'user' AND length(content) > 2 AND message_id NOT IN (SELECT message_id FROM vectors)")
def pending_messages(v: Views) -> DataFrame:
    return stats.pending_messages(v.messages, v.vectors).select("message_id", "session_id")


@query("SELECT count(*) AS embedded FROM messages WHERE message_id IN (SELECT message_id FROM vectors)")
def embedded_count(v: Views) -> DataFrame:
    return stats.embedded_count(v.messages, v.vectors)


@query("SELECT session_id, count(*) AS n_messages FROM messages GROUP BY 1")
def messages_per_session(v: Views) -> DataFrame:
    return stats.messages_per_session(v.messages)


@query("SELECT session_id, count(*) FILTER (role = 'user' AND length(content) > 2) AS n_embeddable FROM messages GROUP BY 1")
def embeddable_per_session(v: Views) -> DataFrame:
    return stats.embeddable_per_session(v.messages)


@query(
    """SELECT session_id, count(*) FILTER (has IS NULL) AS pending, count(*) AS units FROM messages LEFT JOIN (SELECT DISTINCT message_id, 1 AS has FROM vectors) USING (message_id)
WHERE role = 'user' AND length(content) > 2 GROUP BY 1 ORDER BY pending DESC, units DESC, session_id LIMIT 1"""
)
def largest_pending_session(v: Views) -> DataFrame:
    return stats.largest_pending_session(v.messages, v.vectors)


@query("SELECT floor(avg(length(substr(title || ': ' || content, 1, 500))))::BIGINT AS average_chars FROM messages JOIN sessions ON id = session_id")
def average_text_length(v: Views) -> DataFrame:
    texts = v.messages.join(v.sessions.select(F.col("id").alias("session_id"), "title"), "session_id").select(X.embedding_text("title", "content").alias("text"))
    return stats.average_text_length(texts, "text")


@query("SELECT coalesce(source, 'total') AS source, count(*) AS sessions, sum(message_count)::BIGINT AS messages, min(started_at) AS oldest, max(started_at) AS newest FROM sessions GROUP BY ROLLUP (source)")
def source_summary(v: Views) -> DataFrame:
    return stats.source_summary(v.sessions)


@query(
    STATE + """, agg AS (SELECT coalesce(source, 'total') AS source, count(*) AS sessions, sum(message_count)::BIGINT AS messages,
  strftime(make_timestamp(min(started_at) * 1000), '%Y-%m-%d') || ' -> ' || strftime(make_timestamp(max(started_at) * 1000), '%Y-%m-%d') AS dates,
  count(*) FILTER (status = 'done') AS done, count(*) FILTER (status IN ('pending', 'processing')) AS pending, count(*) FILTER (status = 'failed') AS failed
  FROM sessions JOIN state ON id = session_id GROUP BY ROLLUP (source))
SELECT source, sessions, messages, dates, source <> 'codex' AS enabled, done, pending, failed, done * 100.0::DOUBLE / sessions AS done_pct FROM agg"""
)
def source_report(v: Views) -> DataFrame:
    return stats.source_report(v.sessions, _state(v), filters.enabled_sources(disabled=["codex", "unknown"]))


# Sync: sessions scanned again, some with another count or time, some not stored yet.
def _raw(v: Views) -> DataFrame:
    c = F.regexp_extract("id", r"\d+", 0).cast("bigint")
    m = v.messages.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct("role", "content", "timestamp").alias("m")))), lambda x: x["m"]).alias("messages"))
    raw = v.sessions.join(m, F.col("id") == F.col("session_id")).withColumn("c", c)
    shifted = raw.withColumn("updated_at", F.when(F.col("c") % 5 == 0, F.col("updated_at") + 1000).otherwise(F.col("updated_at"))).withColumn("listing", F.col("c"))
    again = shifted.where(F.col("c") % 7 == 3).withColumn("listing", F.col("c") + 1_000_000).withColumn("updated_at", F.lit(AS_OF).cast("bigint"))
    return shifted.unionByName(again).select("source", "source_id", "directory", "started_at", "updated_at", "entrypoint", "listing", "messages")


def _stored(v: Views) -> DataFrame:
    c = F.regexp_extract("id", r"\d+", 0).cast("bigint")
    return v.sessions.where(c % 4 != 0).withColumn("message_count", F.when(c % 6 == 1, F.col("message_count") + 1).otherwise(F.col("message_count")))


PLAN = f""",
c AS (SELECT *, regexp_extract(id, '\\d+')::BIGINT AS c FROM sessions),
entries AS (SELECT * REPLACE (CASE WHEN c % 7 = 3 THEN {AS_OF} WHEN c % 5 = 0 THEN updated_at + 1000 ELSE updated_at END AS updated_at) FROM c),
stored AS (SELECT source_id, updated_at AS stored_at, message_count + (c % 6 = 1)::INT AS stored_count FROM c WHERE c % 4 <> 0),
first AS (SELECT c.*, stored_at, stored_count, stored_count IS NOT NULL AS known, coalesce(c.updated_at, started_at) < {AS_OF - 35 * X.DAY_MS} AS outside,
  CASE WHEN c.c % 5 = 0 THEN c.updated_at + 1000 ELSE c.updated_at END AS moved FROM c LEFT JOIN stored USING (source_id)),
one AS (SELECT *, CASE WHEN coalesce(moved, started_at) < {AS_OF - 35 * X.DAY_MS} THEN 'filtered' WHEN NOT known THEN 'new'
  WHEN message_count <> stored_count OR (moved IS NOT NULL AND moved IS DISTINCT FROM stored_at) THEN 'updated' ELSE 'unchanged' END AS action FROM first),
two AS (SELECT *, action IN ('new', 'updated') AS written FROM one),
again AS (SELECT * REPLACE (CASE WHEN NOT known AND NOT written THEN 'new'
  WHEN message_count <> CASE WHEN written THEN message_count ELSE stored_count END OR {AS_OF} IS DISTINCT FROM CASE WHEN written THEN moved ELSE stored_at END THEN 'updated' ELSE 'unchanged' END AS action) FROM two WHERE c % 7 = 3),
planned AS (SELECT source_id, message_count, id, action, c % 7 <> 3 OR (SELECT action FROM again a WHERE a.source_id = two.source_id) = 'unchanged' AS last, 1 AS n FROM two
  UNION ALL SELECT source_id, message_count, id, action, true, 2 FROM again),
done AS (SELECT source_id, any_value(id) AS id, any_value(message_count) AS message_count, bool_or(action IN ('new', 'updated')) AS written FROM planned GROUP BY 1)
"""


def _plan(v: Views, force: bool = False) -> DataFrame:
    return sync.plan(_raw(v), _stored(v), AS_OF - 35 * X.DAY_MS, force)


@query(PLAN + "SELECT source_id, action, action IN ('new', 'updated') AND last AS stands FROM planned")
def sync_plan(v: Views) -> DataFrame:
    return _plan(v).select("source_id", "action", "stands")


# A forced run replaces what is unchanged too; a second entry is then compared with the first.
@query(PLAN + """SELECT source_id, CASE WHEN action = 'unchanged' THEN 'reprocessed' ELSE action END AS action FROM planned WHERE n = 1
UNION ALL SELECT source_id, CASE WHEN one.action = 'filtered' THEN (SELECT CASE a.action WHEN 'unchanged' THEN 'reprocessed' ELSE a.action END FROM again a WHERE a.source_id = one.source_id) WHEN moved IS DISTINCT FROM """ + str(AS_OF) + """ THEN 'updated' ELSE 'reprocessed' END FROM one WHERE c % 7 = 3""")
def sync_plan_forced(v: Views) -> DataFrame:
    return _plan(v, True).select("source_id", "action")


@query(PLAN + "SELECT action, count(*) AS sessions, sum(message_count)::BIGINT AS messages FROM planned GROUP BY 1")
def sync_counters(v: Views) -> DataFrame:
    return sync.counters(_plan(v))


@query(
    PLAN + """SELECT c.source_id, CASE WHEN written THEN c.message_count ELSE stored_count END AS message_count, title, written AS fresh, n_messages, digest
FROM done JOIN c USING (source_id) LEFT JOIN stored USING (source_id) JOIN (
  SELECT 'conv-' || conv_id AS source_id, count(*) AS n_messages, md5(string_agg(seq || role || content, chr(10) ORDER BY seq)) AS digest FROM messages GROUP BY 1) USING (source_id)
WHERE written OR stored_count IS NOT NULL"""
)
def sync_merge(v: Views) -> DataFrame:
    merged = _merged(v)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat(F.col("seq").cast("string"), "role", "content").alias("t")))), lambda x: x["t"]), "\n")
    said = merged["messages"].groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n_messages"), F.md5(text.cast("binary")).alias("digest"))
    return merged["sessions"].join(said, "id").select("source_id", "message_count", "title", (F.length("id") > 20).alias("fresh"), "n_messages", "digest")


def _merged(v: Views) -> dict[str, DataFrame]:
    stored = _stored(v)
    held = v.messages.join(stored.select(F.col("id").alias("session_id")), "session_id", "left_semi").withColumn("seq", F.col("seq").cast("int")).select("message_id", "session_id", "role", "content", "timestamp", "seq")
    return sync.merge(_plan(v), stored, held, v.vectors)


@query(PLAN + "SELECT message_id FROM vectors WHERE message_id NOT IN (SELECT message_id FROM messages JOIN done ON done.id = session_id JOIN stored USING (source_id) WHERE written)")
def sync_vectors(v: Views) -> DataFrame:
    """Vectors left after a merge: none of a replaced message."""
    return _merged(v)["vectors"].select("message_id")


@query(PLAN + "SELECT source_id FROM (SELECT source_id, message_count, CASE WHEN n = 2 AND action2 <> 'unchanged' THEN " + str(AS_OF) + " ELSE moved END AS updated_at FROM one LEFT JOIN (SELECT source_id, 2 AS n, action AS action2 FROM again) USING (source_id)) LEFT JOIN stored USING (source_id) WHERE NOT coalesce(updated_at IS NOT DISTINCT FROM stored_at AND message_count = stored_count, false)")
def tabular_changes(v: Views) -> DataFrame:
    listed = sync.last_differing(_raw(v)).select("source_id", "updated_at", F.size("messages").alias("message_count"))
    return sync.tabular_changes(listed, _stored(v)).select("source_id")


@query(
    """SELECT 'sessions' AS name, count(*) AS n FROM sessions WHERE source <> 'codex' UNION ALL
SELECT 'messages', count(*) FROM messages JOIN sessions ON id = session_id WHERE source <> 'codex' UNION ALL
SELECT 'vectors', count(*) FROM vectors WHERE message_id NOT IN (SELECT message_id FROM messages JOIN sessions ON id = session_id WHERE source = 'codex')"""
)
def delete_sessions(v: Views) -> DataFrame:
    left = sync.delete_sessions(v.sessions.where("source = 'codex'").select(F.col("id").alias("session_id")), v.sessions, v.messages, v.vectors)
    one, two, three = (left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("sessions", "messages", "vectors"))
    return one.union(two).union(three)


@query("SELECT message_id, CASE WHEN message_id % 2 = 0 THEN 0.0 ELSE round(list_sum(embedding), 6) END AS total FROM vectors")
def vector_upsert(v: Views) -> DataFrame:
    new = v.vectors.where("message_id % 2 = 0").select("message_id", F.transform("embedding", lambda _: F.lit(0.0).cast("float")).alias("embedding"))
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return embed.upsert_vectors(v.vectors, new).select("message_id", F.round(total, 6).alias("total"))


@query("SELECT count(*) FILTER (coalesce(updated_at, started_at) < 1704153600000) AS filtered FROM sessions")
def outside_window(v: Views) -> DataFrame:
    return filters.outside_window_count(v.sessions, AS_OF - 30 * X.DAY_MS)


@query(
    r"""SELECT id, CASE source WHEN 'claude-code' THEN 'claude --resume ' || source_id WHEN 'opencode' THEN 'opencode --session ' || source_id WHEN 'codex' THEN 'codex resume ' || source_id
  WHEN 'copilot-cli' THEN 'copilot --resume=' || source_id END AS command, strftime(make_timestamp(started_at * 1000), '%m-%d %H:%M') AS time,
  substr(title, 1, 40) AS short_title, right(directory, 30) AS short_directory, 'L-' || regexp_replace(substr(title, 1, 40), '[^\p{L}\p{N}_-]', '_', 'g') || '.txt' AS file FROM sessions"""
)
def session_labels(v: Views) -> DataFrame:
    return v.sessions.select(
        "id", filters.resume_command(F.col("source"), F.col("source_id")).alias("command"), X.message_time("started_at").alias("time"), X.cut("title", 40, "").alias("short_title"), F.right("directory", F.lit(30)).alias("short_directory"),
        X.export_name(F.lit("L"), "title").alias("file"),
    )


_OFFSETS = r"list_transform(list_filter(range(1, length(content) + 1), lambda i: substr(lower(content), i, 2) = 'th'), lambda i: i - 1)"


@query(f"SELECT message_id, CASE WHEN strlen(lower(content)) = strlen(content) THEN array_to_string({_OFFSETS}, ',') ELSE '' END AS offsets FROM (SELECT message_id, content || CASE WHEN message_id % 9 = 0 THEN ' THE İth' ELSE '' END AS content FROM messages)")
def match_offsets(v: Views) -> DataFrame:
    """Every ninth message gets a letter whose lower case is longer, so it has no offsets."""
    rows = v.messages.withColumn("content", F.when(F.col("message_id") % 9 == 0, F.concat("content", F.lit(" THE İth"))).otherwise(F.col("content")))
    return rows.select("message_id", F.array_join(F.transform(X.match_offsets("content", "TH"), lambda x: x.cast("string")), ",").alias("offsets"))


# Evaluation: the first words of every fifth session's title, and a vector for each; one half looks for that session, the other for the next one.
def _entries(v: Views) -> DataFrame:
    c = F.regexp_extract("id", r"\d+", 0).cast("bigint")
    wanted = F.when(c % 10 == 0, c).otherwise(c + 1)
    source = F.element_at(F.array(*[F.lit(s) for s in filters.SOURCE_IDS]), (wanted % len(filters.SOURCE_IDS) + 1).cast("int"))
    expected = F.array(F.struct(source.alias("source"), F.concat(F.lit("conv-"), wanted).alias("source_id")))
    words = F.substring_index("title", " ", 4)
    query = F.when(c % 3 == 0, F.concat(F.regexp_replace(words, r"^(\S+) ", "$1_"), F.lit(" Thé"))).otherwise(words)  # a phrase and an accent in every third
    return v.sessions.where(c % 5 == 0).select(c.alias("query_id"), query.alias("query"), expected.alias("expected"))


EVAL = r""",
toks AS (SELECT message_id, session_id, list_filter(string_split_regex(lower(strip_accents(content)), '[^\p{L}\p{N}\p{Co}]+'), lambda x: x <> '') AS ts FROM messages),
lens AS (SELECT message_id, len(ts) AS dl FROM toks),
post AS (SELECT message_id, session_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM toks),
four AS (SELECT regexp_extract(id, '\d+')::BIGINT AS query_id, array_to_string(string_split(title, ' ')[1:4], ' ') AS w FROM sessions),
q AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN regexp_replace(w, '^(\S+) ', '\1_') || ' Thé' ELSE w END AS query, 'conv-' || (query_id + (query_id % 10 <> 0)::INT) AS source_id FROM four WHERE query_id % 5 = 0),
words AS (SELECT query_id, ws, count(*) AS times FROM (
  SELECT query_id, list_filter(string_split_regex(lower(strip_accents(regexp_replace(unnest(string_split_regex(query, '\s+')), '[^\p{L}\p{N}_]', '', 'g'))), '[^\p{L}\p{N}\p{Co}]+'), lambda x: x <> '') AS ws FROM q) WHERE len(ws) > 0 GROUP BY ALL),
parts AS (SELECT ws, unnest(ws) AS term, generate_subscripts(ws, 1) AS k FROM (SELECT DISTINCT ws FROM words)),
held AS (SELECT ws, message_id, session_id, count(*) AS f FROM (SELECT ws, message_id, session_id, pos - k AS start FROM parts JOIN post USING (term) GROUP BY ALL HAVING count(*) = len(ws)) GROUP BY ALL),
idf AS (SELECT ws, CASE WHEN raw <= 0 THEN 1e-6 ELSE raw END AS idf FROM (SELECT ws, ln(((SELECT count(*) FROM lens) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM held GROUP BY ws)),
scored AS (SELECT query_id, session_id, message_id, round(-sum(idf * times * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * dl / (SELECT avg(dl) FROM lens)))), 9) AS r
  FROM words JOIN held USING (ws) JOIN idf USING (ws) JOIN lens USING (message_id) GROUP BY ALL),
best AS (SELECT query_id, session_id, min(r) AS r FROM scored GROUP BY ALL),
kw AS (SELECT query_id, session_id, row_number() OVER (PARTITION BY query_id ORDER BY r, session_id) - 1 AS wr FROM best QUALIFY wr < 400),
near AS (SELECT query_id, message_id, list_distance(e.embedding::DOUBLE[], v.embedding) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(e.embedding::DOUBLE[], v.embedding), message_id) AS n
  FROM q JOIN embeddings e ON e.vec_id = query_id, vectors v QUALIFY n <= 2000),
vec AS (SELECT query_id, session_id, row_number() OVER (PARTITION BY query_id ORDER BY d, session_id) - 1 AS vr FROM (SELECT query_id, session_id, min(distance) AS d FROM near JOIN messages USING (message_id) GROUP BY ALL)),
ranked AS (SELECT query_id, session_id, CASE WHEN wr IS NOT NULL AND vr IS NOT NULL THEN 'HYB' WHEN wr IS NOT NULL THEN 'FTS' ELSE 'VEC' END AS match,
  row_number() OVER (PARTITION BY query_id ORDER BY coalesce(1.0::DOUBLE / (11 + wr), 0) + coalesce(1.0::DOUBLE / (11 + vr), 0) DESC, session_id) AS rank
  FROM kw FULL OUTER JOIN vec USING (query_id, session_id) QUALIFY rank <= 20),
results AS (SELECT ranked.*, source, source_id, title FROM ranked JOIN sessions ON id = session_id),
details AS (SELECT q.query_id, query, min(rank) AS best_rank, count(rank) AS hits, 1 AS n_expected FROM q LEFT JOIN results ON results.query_id = q.query_id AND results.source_id = q.source_id GROUP BY ALL)
"""


def _results(v: Views) -> tuple[DataFrame, DataFrame]:
    entries, lengths = _entries(v), search.build_lengths(v.messages)
    asked = v.table("embeddings").select(F.col("vec_id").alias("query_id"), "embedding").join(entries.select("query_id"), "query_id", "left_semi")
    near = evaluate.near_sessions(asked, v.vectors, v.messages)
    return entries, evaluate.batch_results(entries, v.sessions, search.build_postings(v.messages), lengths, search.corpus_stats(lengths), near)


@query(EVAL + "SELECT query_id, query, best_rank, hits, n_expected FROM details")
def eval_details(v: Views) -> DataFrame:
    return evaluate.query_details(*_results(v))


@query(
    EVAL + """SELECT count(*) AS total, count(*) FILTER (best_rank <= 5) AS hit_at_5, count(*) FILTER (best_rank <= 10) AS hit_at_10, count(*) FILTER (best_rank <= 5) * 100.0::DOUBLE / count(*) AS hit_at_5_pct,
count(*) FILTER (best_rank <= 10) * 100.0::DOUBLE / count(*) AS hit_at_10_pct, round(coalesce(sum(1.0::DOUBLE / best_rank), 0) / count(*), 9) AS mrr FROM details"""
)
def eval_metrics(v: Views) -> DataFrame:
    return evaluate.metrics(evaluate.query_details(*_results(v))).withColumn("mrr", F.round("mrr", 9))


@query(EVAL + "SELECT query_id, query FROM details WHERE best_rank IS NULL OR best_rank > 5")
def eval_failures(v: Views) -> DataFrame:
    return evaluate.failures(evaluate.query_details(*_results(v))).select("query_id", "query")


@query(EVAL + "SELECT results.query_id, rank, match, source, results.source_id, results.source_id = q.source_id AS is_expected, CASE WHEN length(t) > 70 THEN substr(t, 1, 67) || '...' ELSE t END AS title FROM (SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t FROM results) results JOIN q ON q.query_id = results.query_id WHERE rank <= 10")
def eval_summaries(v: Views) -> DataFrame:
    return evaluate.summaries(*_results(v))


#: Vectors that a query of the approximate search measures.
RERANKED = 40
NEAREST = """SELECT query_id, message_id, round(distance, 6) AS distance FROM (SELECT q.vec_id AS query_id, message_id, list_distance(q.embedding::DOUBLE[], v.embedding) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], v.embedding), message_id) AS n FROM embeddings q, vectors v WHERE q.vec_id % 20 = 0) WHERE n <= 10"""


@query()
def encoder_metrics(v: Views) -> DataFrame:
    """(encoder, total, hit_at_10, mrr): retrieval by vectors alone with hashed terms and with vectors learned from the corpus, for the queries
    of the evaluation; SQL has neither."""
    entries, lengths = _entries(v), search.build_lengths(v.messages)
    none = search.build_postings(v.messages).where(F.lit(False))
    model = encoder.fit(v.messages)
    texts = v.messages.select(F.struct(F.col("message_id")).alias("k"), F.col("content").alias("t"))
    hashed = embed.encode(texts, "k", "t").select("k.message_id", "embedding"), embed.encode(entries.select("query_id", "query"), "query_id", "query", prefix="query: ").select("query_id", "embedding")
    learned = encoder.encode(v.messages, model, "message_id", "content"), encoder.encode(entries, model, "query_id", "query")
    out = None
    for name, (vectors, asked) in (("hashed terms", hashed), ("learned", learned)):
        near = evaluate.near_sessions(asked, vectors, v.messages)
        results = evaluate.batch_results(entries, v.sessions, none, lengths, (1, 1.0), near)
        one = evaluate.metrics(evaluate.query_details(entries, results)).select(F.lit(name).alias("encoder"), "total", "hit_at_10", F.round("mrr", 6).alias("mrr"))
        out = one if out is None else out.unionByName(one)
    return out


@query(NEAREST)
def knn_batch(v: Views) -> DataFrame:
    return search.knn_batch(v.vectors, _asked(v), 10).withColumn("distance", F.round("distance", 6))


def _asked(v: Views) -> DataFrame:
    """The stated query set."""
    return v.table("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("SELECT message_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x * x))), 6) AS before, round(1.0, 6)::DOUBLE AS after FROM vectors")
def normalized_vectors(v: Views) -> DataFrame:
    doubled = v.vectors.select("message_id", F.transform("embedding", lambda x: x * 3).alias("d"), "embedding")
    return doubled.select("message_id", F.round(F.sqrt(VX.dot("embedding", "embedding")), 6).alias("before"), F.round(F.sqrt(VX.dot(VX.normalize("d"), VX.normalize("d"))), 6).alias("after"))


@query("SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS first, round(avg(embedding[64]::DOUBLE), 6) AS last FROM embeddings WHERE vec_id % 2 = 0 GROUP BY label")
def pooled_vectors(v: Views) -> DataFrame:
    pooled = VX.mean_by(v.table("embeddings"), "label", "embedding", F.col("vec_id") % 2 == 0)
    return pooled.select("label", F.round(F.get("m", 0), 6).alias("first"), F.round(F.get("m", 63), 6).alias("last"))


@query(
    """SELECT term, count(*) AS n, sum(f)::BIGINT AS tf FROM (SELECT message_id, term, count(*) AS f FROM (
  SELECT message_id, unnest(list_filter(string_split_regex(lower(strip_accents(content)), '[^\\p{L}\\p{N}\\p{Co}]+'), lambda x: x <> '')) AS term FROM messages) GROUP BY ALL) GROUP BY term"""
)
def index_terms(v: Views) -> DataFrame:
    return search.build_postings(v.messages).groupBy("term").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))


@query(
    r""", bodies AS (SELECT session_id, count(*) AS n, string_agg('## ' || CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || chr(10) || chr(10) || content || chr(10) || chr(10), '' ORDER BY seq) AS body FROM messages GROUP BY 1)
SELECT id AS session_id, md5('Session: ' || title || chr(10) || 'Source: ' || source || chr(10) || CASE WHEN directory IS NULL THEN '' ELSE 'Directory: ' || directory || chr(10) END
  || 'Date: ' || strftime(make_timestamp(started_at * 1000), '%Y-%m-%d %H:%M') || chr(10) || 'Messages: ' || n || chr(10) || chr(10) || '---' || chr(10) || chr(10) || body) AS digest
FROM sessions JOIN bodies ON id = session_id"""
)
def export_transcripts(v: Views) -> DataFrame:
    found = export.transcripts(v.sessions, v.messages, filters.source_table(v.spark))
    return found.select("session_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(r"SELECT source, source_id, strftime(make_timestamp(started_at * 1000), '%Y-%m-%dT%H:%M:%S') AS time, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title FROM sessions")
def session_listing(v: Views) -> DataFrame:
    return export.listing(v.sessions)


@query("SELECT message_id, session_id, NULL::VARCHAR AS error, 384 AS dimension, 1.0::DOUBLE AS norm FROM messages WHERE role = 'user' AND length(content) > 2 AND message_id NOT IN (SELECT message_id FROM vectors)")
def embed_pending(v: Views) -> DataFrame:
    """Vectors of the default encoder for all pending messages: of unit length, whatever they say."""
    done = embed.embed_pending(v.sessions, v.messages, v.vectors)
    return done.select("message_id", "session_id", "error", F.size("embedding").alias("dimension"), F.round(F.sqrt(VX.dot("embedding", "embedding")), 4).alias("norm"))


@query(NEAREST)
def approximate_neighbours(v: Views) -> DataFrame:
    """Nearest vectors by product-quantised codes, RERANKED of them measured; compared with the exact ones."""
    return codes.approximate_neighbours(v.vectors, _asked(v), 10, RERANKED).withColumn("distance", F.round("distance", 6))


@query(f"SELECT count(DISTINCT query_id) AS queries, count(*) AS pairs, count(*) AS found, least(1.0, {RERANKED}::DOUBLE / (SELECT count(*) FROM vectors)) AS share_read FROM ({NEAREST})")
def approximate_found(v: Views) -> DataFrame:
    """How many of the true neighbours the codes find, over the stated query set against all vectors, and what share of the full vectors a query measures."""
    exact, found = search.knn_batch(v.vectors, _asked(v), 10), codes.approximate_neighbours(v.vectors, _asked(v), 10, RERANKED)
    return codes.share_found(exact, found, v.vectors.count(), RERANKED).drop("share_found")


@query(keyword_sql(WORDS) + vector_sql() + FUSED + "SELECT session_id, row_number() OVER (ORDER BY started_at DESC, position) AS place FROM found")
def newest_first(v: Views) -> DataFrame:
    return filters.by_newest(_hybrid(v)).select("session_id", "place")


@query(STATE + keyword_sql(WORDS) + ", vec AS (SELECT NULL::VARCHAR AS session_id, NULL::BIGINT AS vr WHERE false)" + FUSED + "SELECT position, session_id, score, match FROM found")
def keywords_until_embedded(v: Views) -> DataFrame:
    """Nothing is embedded, so no vector is asked for."""
    none = v.vectors.where(F.lit(False))
    state = stats.embedding_state(v.sessions, v.messages, none).where("units_total > 0")
    found = search.search_with(lambda _: v.query_vector, v.sessions, v.messages, none, state, WORDS)
    return found.select("position", "session_id", F.round("score", 9).alias("score"), "match")


@query("SELECT id, source, source_id FROM sessions WHERE id IN (SELECT session_id FROM messages WHERE message_id % 7 = 0)")
def sessions_by_id(v: Views) -> DataFrame:
    return filters.sessions_by_id(v.sessions, v.messages.where("message_id % 7 = 0").select("session_id")).select("id", "source", "source_id")


@query("SELECT source, source_id, updated_at, message_count FROM sessions WHERE source = 'codex'")
def session_meta(v: Views) -> DataFrame:
    return filters.session_meta(v.sessions, "codex")


@query("SELECT message_id, role, md5(content) AS digest, seq FROM messages WHERE session_id = (SELECT max(session_id) FROM messages)")
def messages_of(v: Views) -> DataFrame:
    last = v.messages.agg(F.max("session_id")).first()[0]
    return filters.messages_of(v.messages, last).select("message_id", "role", F.md5(F.col("content").cast("binary")).alias("digest"), "seq")


@query(f"SELECT id FROM sessions WHERE source = 'copilot-cli' AND started_at >= {AS_OF - 30 * X.DAY_MS}")
def resolved_arguments(v: Views) -> DataFrame:
    """A source named by its label, whatever the case, and a range named by days."""
    return v.sessions.where(filters.session_filter(filters.resolve_source("cpl"), filters.resolve_range("30D"), None, AS_OF)).select("id")


@query("SELECT source, count(*) AS n FROM sessions WHERE source NOT IN ('codex', 'cursor') GROUP BY 1")
def enabled_scope(v: Views) -> DataFrame:
    """Sessions of the sources left on, an unknown name among those switched off; all on is no filter."""
    scope = filters.default_scope(filters.enabled_sources(disabled=["cursor", "codex", "nobody", "codex"]))
    assert filters.default_scope(filters.enabled_sources()) is None
    return v.sessions.where(filters.session_filter(scope)).groupBy("source").agg(F.count("*").alias("n"))


_NOISE_SQL = "CASE message_id % 5 WHEN 0 THEN '  <command-message>' WHEN 1 THEN '<local-command-caveat>' WHEN 2 THEN chr(10) || '# New session - ' WHEN 3 THEN 'x# New session - ' ELSE '' END || content"


@query(f"SELECT message_id, regexp_matches({_NOISE_SQL}, '^[\\s\\p{{Z}}]*(<command-message>|<local-command-caveat>|# New session -)') AS noise FROM messages")
def noise(v: Views) -> DataFrame:
    m = F.col("message_id") % 5
    text = F.concat(F.when(m == 0, "  <command-message>").when(m == 1, "<local-command-caveat>").when(m == 2, "\n# New session - ").when(m == 3, "x# New session - ").otherwise(""), "content")
    return v.messages.select("message_id", X.is_noise(text).alias("noise"))


@query(
    f"""SELECT message_id, CASE message_id % 4 WHEN 0 THEN {AS_OF} - (message_id % 30) * {X.DAY_MS} WHEN 1 THEN {AS_OF} - (message_id % 30) * 7 * {X.DAY_MS} WHEN 2 THEN {AS_OF} - (message_id % 30) * 30 * {X.DAY_MS} END AS cutoff FROM messages"""
)
def relative_cutoffs(v: Views) -> DataFrame:
    n = (F.col("message_id") % 30).cast("string")
    text = F.when(F.col("message_id") % 4 == 3, F.concat(n, F.lit("y"))).otherwise(F.concat(F.lit(" "), n, F.element_at(F.array(F.lit("d"), F.lit("w"), F.lit("m")), (F.col("message_id") % 4 % 3 + 1).cast("int")), F.lit(" ")))
    return v.messages.select("message_id", X.relative_cutoff(text, AS_OF).alias("cutoff"))


@query(
    """SELECT job, phase, detail, updated_at FROM (SELECT user_id::VARCHAR AS job, CASE WHEN event_type <> 'click' THEN event_type END AS phase, event_id::VARCHAR AS detail, epoch_us(ts) * 1000 + event_id % 1000 AS updated_at,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) * 1000 + event_id % 1000 DESC) AS n FROM events) WHERE n = 1 AND phase IS NOT NULL"""
)
def job_states(v: Views) -> DataFrame:
    """The last phase of each job from a log; one kind of row clears a job."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    log = v.table("events").select(F.col("user_id").cast("string").alias("job"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("phase"), F.col("event_id").cast("string").alias("detail"), at.alias("updated_at"))
    return sync.job_state(log)


_STORED = {
    "fts_indexed": (lambda v: stored.fts_indexed(v, WORDS), stored.STORED_SQL + keyword_sql(WORDS) + "SELECT source_id, rank FROM kw JOIN sessions ON id = session_id"),
    "fts_indexed_phrase": (lambda v: stored.fts_indexed(v, PHRASES), stored.STORED_SQL + keyword_sql(PHRASES) + "SELECT source_id, rank FROM kw JOIN sessions ON id = session_id"),
    "sync_stored": (stored.sync_stored, stored.SYNC_STORED),
    "sync_stored_rows": (lambda v: stored.sync_stored(v, stored.filled_by_rows), stored.SYNC_STORED),
    "embedding_runs": (stored.embedding_runs, stored.EMBEDDING_RUNS),
    "summaries_kept": (stored.summaries_kept, stored.SUMMARIES_KEPT),
    "scope_kept": (lambda v: stored.scope_kept(v, SCOPE["sources"], filters.time_cutoff(SCOPE["time_range"], AS_OF)), stored.SCOPE_KEPT + SCOPE_SQL),
    "in_session_signed": (lambda v: stored.in_session_signed(v, "Anshtion"), stored.STORED_SQL + " " + lines_sql("anshtion")),
    "index_blocks": (lambda v: stored.index_blocks(v, "the"), None),
}
for _name, (_fn, _sql) in _STORED.items():
    QUERIES[_name] = lambda spark, sf_dir, fn=_fn: fn(Views(spark, sf_dir))
    if _sql:
        ORACLE_SQL[_name] = _sql

for _name, (_fn, _sql) in (rendered.ROUND_TRIPS | tools.TOOLS).items():
    QUERIES[_name] = lambda spark, sf_dir, fn=_fn: fn(Views(spark, sf_dir))
    ORACLE_SQL[_name] = SQL + _sql


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return QUERIES[name](spark, sf_dir)
