"""A keyword index kept up by the sync: immutable segments sorted by term, with stored statistics, and top lists that read few blocks.

A run adds one segment: postings of its new messages in blocks of some hundred, and what they change in the terms' and the corpus's
counts. Postings of replaced sessions stay until segments are merged; tombstones hide them, and their counts are taken back at once, so
statistics are exact without a scan of lengths. Within a term blocks go by the share that the term has of a message, best first; each
carries its largest share and count, which bound what any of its postings can score whatever the average length becomes."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import rewrite_query
from colloquy.operators.search import K1, LEAST_IDF, B, best_sessions, build_lengths, build_postings, score_words, snippets_of, word_frequencies
from colloquy.operators.store import ALL, INDEXED, UNINDEXED, Store, number_of

#: Postings of a block, postings of a term in a segment that one task orders, segments of a size that are merged, their growth, and blocks looked at first for each session wanted.
BLOCK, HOT, FAN, GROWTH, FIRST = 128, 200_000, 4, 4, 8
POST = "struct<message_id:bigint,session_id:string,length:int,tf:bigint,positions:array<int>>"
SEGMENT = f"term string, n bigint, most_tf bigint, share double, posts array<{POST}>"
TERMS, CORPUS = "term string, n bigint", "messages bigint, tokens bigint"


def build_blocks(postings: DataFrame) -> DataFrame:
    """Postings of a segment in blocks. A term of very many postings is ordered in several tasks, each of which makes blocks of its own."""
    counts = postings.groupBy("term").agg(F.ceil(F.count("*") / HOT).alias("tasks"))
    share = F.col("tf") / F.col("length")
    placed = postings.join(counts.hint("merge"), "term").withColumn("task", F.pmod(F.xxhash64("message_id"), F.col("tasks"))).withColumn("share", share)
    order = Window.partitionBy("term", "task").orderBy(F.col("share").desc(), "message_id")
    numbered = placed.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK))
    post = F.struct("message_id", "session_id", "length", "tf", "positions")
    blocks = numbered.groupBy("term", "task", "block").agg(F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.max("share").alias("share"), F.collect_list(post).cast(f"array<{POST}>").alias("posts"))
    return blocks.select("term", "n", "most_tf", "share", "posts")


def sorted_by_term(blocks: DataFrame, tasks: int | None = None) -> DataFrame:
    """Blocks as a segment's files hold them: a scan reads the row groups of a query's terms, and of those the best shares."""
    dealt = blocks.repartitionByRange(tasks, "term", F.col("share").desc()) if tasks else blocks.repartitionByRange("term", F.col("share").desc())
    return dealt.sortWithinPartitions("term", F.col("share").desc())


def counts_of(new: DataFrame, old: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What messages that come and messages that go change: (term, n) and one row of (messages, tokens)."""
    parts = [(new, 1)] + ([(old, -1)] if old is not None else [])
    terms = corpus = None
    for messages, sign in parts:
        t = build_postings(messages).groupBy("term").agg((F.lit(sign) * F.count("*")).alias("n"))
        c = build_lengths(messages).agg((F.lit(sign) * F.count("*")).alias("messages"), (F.lit(sign) * F.coalesce(F.sum("length"), F.lit(0))).alias("tokens"))
        terms, corpus = (t, c) if terms is None else (terms.unionByName(t), corpus.unionByName(c))
    return terms.groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0"), corpus.agg(F.sum("messages").alias("messages"), F.sum("tokens").alias("tokens"))


def segment_of(store: Store, base: dict, new: DataFrame, old: DataFrame | None) -> list[tuple]:
    """A run's segment and counts, as versions that no manifest names yet."""
    terms, corpus = counts_of(new, old)
    return [*store.put(INDEXED, sorted_by_term(build_blocks(build_postings(new))), base), *store.put("terms", terms.sortWithinPartitions("term"), base), *store.put("corpus", corpus.coalesce(1), base)]


def stored_counts(store: Store, terms: list[str], manifest: dict | None = None) -> tuple[int, float, dict[str, int]]:
    """Messages, their average length, and how many hold each of the terms: a few rows a segment, no lengths."""
    manifest = manifest or store.manifest()
    messages, tokens = store.read("corpus", CORPUS, manifest).agg(F.coalesce(F.sum("messages"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    held = store.read("terms", TERMS, manifest).where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("n").alias("n")).collect()
    return messages, tokens / messages if messages else 0.0, {r["term"]: r["n"] for r in held if r["n"] > 0}


def _blocks(store: Store, manifest: dict) -> DataFrame:
    """All segments' blocks, with the number of the version each is of."""
    return store._load(INDEXED, SEGMENT, manifest)


def _postings(store: Store, manifest: dict, blocks: DataFrame) -> DataFrame:
    """Blocks as postings that no tombstone kills, in the columns of build_postings."""
    posts = blocks.select("term", "_version", F.explode("posts").alias("p")).select("term", "_version", "p.*")
    return store.live(posts, "session_id", store.killing(INDEXED, manifest, {ALL}, UNINDEXED), {ALL}, UNINDEXED)


def postings(store: Store, manifest: dict | None = None) -> DataFrame:
    """The whole index as postings; a filter on terms reaches the files."""
    manifest = manifest or store.manifest()
    return _postings(store, manifest, _blocks(store, manifest))


def weight(tf, share_inverse, mean: float):
    """BM25's part of a term that stands tf times in a message that is share_inverse times as long as that."""
    return (K1 + 1) / (1 + K1 * (1 - B) / tf + K1 * B * share_inverse / mean)


def idf_of(messages: int, n: int) -> float:
    raw = math.log((messages - n + 0.5) / (n + 0.5))
    return raw if raw > 0 else LEAST_IDF


def _bound(mean: float) -> Column:
    return weight(F.col("most_tf"), 1 / F.col("share"), mean)


def reach(store: Store, manifest: dict, times: dict[str, int], messages: int, mean: float, counts: dict[str, int], fetch: int, scope: DataFrame | None) -> Column:
    """Which blocks can hold a message of the ``fetch`` best sessions.

    First the best blocks of every term are read and scored: the fetch-th session is reached by as many. A message with a better score has
    each of its postings in a block that, with all other terms at their best, reaches that score; other blocks needn't be read."""
    terms = [t for t in times if t in counts]
    if not terms:
        return F.lit(False)
    idf = {t: times[t] * idf_of(messages, counts[t]) for t in terms}
    heads = _blocks(store, manifest).where(F.col("term").isin(terms)).select("term", "share", _bound(mean).alias("bound"))
    order = Window.partitionBy("term").orderBy(F.col("share").desc())
    first = heads.withColumn("i", F.row_number().over(order)).where(F.col("i") <= max(1, -(-FIRST * fetch // BLOCK)))
    tops = {r["term"]: r for r in heads.groupBy("term").agg(F.max("bound").alias("most")).join(first.groupBy("term").agg(F.min("share").alias("least")), "term").collect()}
    terms = [t for t in terms if t in tops]
    if not terms:
        return F.lit(False)
    some = _postings(store, manifest, _blocks(store, manifest).where(_at_least({t: (tops[t]["least"], 0.0) for t in terms}, mean)))
    if scope is not None:
        some = some.join(scope, "session_id", "left_semi")
    gain = F.lit(0.0)
    for t in terms:
        gain = F.when(F.col("term") == t, F.lit(idf[t])).otherwise(gain)
    scored = some.groupBy("session_id", "message_id").agg(F.sum(gain * weight(F.col("tf"), F.col("length") / F.col("tf"), mean)).alias("score"))
    best = scored.groupBy("session_id").agg(F.max("score").alias("score")).orderBy(F.col("score").desc()).limit(fetch).agg(F.count("*"), F.min("score")).first()
    least = best[1] - 2e-9 if best[0] == fetch else 0.0  # ranks are told apart by nine digits
    most = {t: idf[t] * tops[t]["most"] for t in terms}
    out = {}
    for t in terms:
        need = (least - sum(m for other, m in most.items() if other != t)) / idf[t]
        # weight of a share alone, the most any count gives it, is (K1 + 1) / (1 + K1 B / (share mean))
        share = 0.0 if need <= 0 else math.inf if need >= K1 + 1 else K1 * B / (mean * ((K1 + 1) / need - 1))
        out[t] = (share * (1 - 1e-9), need * (1 - 1e-9))
    return _at_least(out, mean)


def _at_least(least: dict[str, tuple[float, float]], mean: float) -> Column:
    """Blocks of each term from a share on, which reaches the files, and of these those whose bound is high enough."""
    out = F.lit(False)
    for t, (share, bound) in least.items():
        out = out | ((F.col("term") == t) & (F.col("share") >= share) & (_bound(mean) >= bound))
    return out


def search_index(store: Store, sessions: DataFrame, messages: DataFrame, query: str, fetch: int = 60, *, condition: Column | None = None, manifest: dict | None = None, bounded: bool = True) -> DataFrame:
    """fts_search over the stored index: (session_id, rank, snippet), the same rows. Queries with words of several terms read all their postings."""
    manifest = manifest or store.manifest()
    words = Counter(map(tuple, [w for w in rewrite_query(query) if w]))
    terms = sorted({t for w in words for t in w})
    n, mean, counts = stored_counts(store, terms, manifest)
    scope = sessions.where(condition) if condition is not None else sessions
    scope = scope.select(F.col("id").alias("session_id"))
    blocks = _blocks(store, manifest).where(F.col("term").isin(terms))
    single = all(len(w) == 1 for w in words)
    if bounded and single and n and words:
        blocks = _blocks(store, manifest).where(reach(store, manifest, {w[0]: c for w, c in words.items()}, n, mean, counts, fetch, scope if condition is not None else None))
    if not words or not n:
        return sessions.select(F.col("id").alias("session_id"), F.lit(0.0).alias("rank"), F.lit("").alias("snippet")).where(F.lit(False))
    found = word_frequencies(_postings(store, manifest, blocks), [list(w) for w in words])
    # the stored counts, since not all postings are read
    held = {i: counts.get(w[0], 0) for i, w in enumerate(words)} if single else None
    scored = score_words(found, list(words.values()), n, mean, held)
    return snippets_of(best_sessions(scored, scope, fetch), messages)


def blocks_read(store: Store, sessions: DataFrame, query: str, fetch: int = 60, condition: Column | None = None) -> DataFrame:
    """(term, blocks, blocks_read) of a query of single terms: how many blocks the index has of it, and how many its search reads in the end."""
    manifest = store.manifest()
    times = Counter(w[0] for w in rewrite_query(query) if len(w) == 1)
    n, mean, counts = stored_counts(store, sorted(times), manifest)
    scope = sessions.where(condition).select(F.col("id").alias("session_id")) if condition is not None else None
    needed = reach(store, manifest, times, n, mean, counts, fetch, scope) if n else F.lit(False)
    blocks = _blocks(store, manifest).where(F.col("term").isin(sorted(times)))
    return blocks.groupBy("term").agg(F.count("*").alias("blocks"), F.count_if(needed).alias("blocks_read"))


def like_size(held: list) -> list[str]:
    """Of versions (name, bytes) those of a tier that has enough of them to be gathered."""
    tiers: dict[int, list] = {}
    for version, size in held:
        tiers.setdefault(int(math.log(max(size, 1), GROWTH)), []).append(version)
    return [v for tier in tiers.values() if len(tier) >= FAN for v in tier]


def merge_segments(store: Store) -> dict:
    """Gather segments of like size (FAN of a tier of GROWTH times the bytes) into one each, without dead postings; statistics into one row a term.

    A tombstone is kept until every segment is younger."""
    base = store.manifest()
    held = base["tables"].get(INDEXED, {}).get(ALL, [])
    due = like_size(held)
    if not due:
        return base
    some = base | {"tables": base["tables"] | {INDEXED: {ALL: [v for v in held if v[0] in due]}}}
    add = store.put(INDEXED, sorted_by_term(build_blocks(postings(store, some))), base)
    remove = [(INDEXED, ALL, v) for v in due]
    for table, schema, keys in (("terms", TERMS, ["term"]), ("corpus", CORPUS, [])):
        rows = store.read(table, schema, base)
        sums = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])
        add += store.put(table, sums.where("n <> 0").repartitionByRange("term").sortWithinPartitions("term") if keys else sums, base)
        remove += [(table, ALL, v[0]) for v in base["tables"].get(table, {}).get(ALL, [])]
    oldest = min([number_of(v) for v, _ in held if v not in due], default=base["number"] + 1)
    remove += [(UNINDEXED, ALL, v[0]) for v in base["tables"].get(UNINDEXED, {}).get(ALL, []) if number_of(v[0]) <= oldest]
    return store.commit(base, add, remove, still=(UNINDEXED,))
