"""Keyword, vector and hybrid search over sessions and messages."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import age_label, cut, rewrite_query, snippet, tokens
from colloquy.functions.vectors import is_whole, l2
from colloquy.operators.filters import session_filter
from colloquy.operators.stats import is_embedded

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Offset of reciprocal ranks, and messages taken for each session wanted from the vectors.
RRF, PER_SESSION = 10, 5
#: Many-query search: query vectors in a block, vectors in a chunk, pairs measured at once, and queries whose nearest a task holds.
BLOCK, CHUNK, PAIRS, HELD = 512, 4_096, 100_000, 10_000


def build_postings(messages: DataFrame) -> DataFrame:
    """Inverted index: (term, message_id, session_id, length, tf, positions), length being the message's in tokens; sorted by term within files
    so that a scan prunes to a query's terms."""
    said = messages.select("message_id", "session_id", tokens("content").alias("terms"))
    words = said.select("message_id", "session_id", F.size("terms").alias("length"), F.posexplode("terms").alias("position", "term"))
    return words.groupBy("term", "message_id", "session_id", "length").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def build_lengths(messages: DataFrame) -> DataFrame:
    """(message_id, length) in tokens."""
    return messages.select("message_id", F.size(tokens("content")).alias("length"))


def corpus_stats(lengths: DataFrame) -> tuple[int, float]:
    """Messages and their average length over the whole corpus, whatever the filters: two numbers."""
    n, mean = lengths.agg(F.count("*"), F.avg("length")).first()
    return n, float(mean or 0.0)


def write_index(messages: DataFrame, path: str, partitions: int = 64) -> None:
    """Postings and lengths as parquet; postings dealt out and sorted by term."""
    build_postings(messages).repartitionByRange(partitions, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    build_lengths(messages).write.mode("overwrite").parquet(f"{path}/lengths")


def word_frequencies(postings: DataFrame, words: list[list[str]]) -> DataFrame:
    """(word, message_id, session_id, length, f): how often each word, that is a row of one or more adjacent terms, stands in a message.

    The postings are read once for all terms; a message's places of them meet in one row."""
    terms = sorted({t for word in words for t in word})
    held = postings.where(F.col("term").isin(terms)).groupBy("message_id", "session_id", "length").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    counts = []
    for i, word in enumerate(words):
        places = F.coalesce(F.col("at")[word[0]], F.array().cast("array<int>"))
        for j, term in enumerate(word[1:], 1):
            places = F.array_intersect(places, F.transform(F.coalesce(F.col("at")[term], F.array().cast("array<int>")), _back(j)))
        counts.append(F.struct(F.lit(i).alias("word"), F.size(places).alias("f")))
    return held.select("message_id", "session_id", "length", F.explode(F.filter(F.array(*counts), lambda x: x["f"] > 0)).alias("x")).select("x.word", "message_id", "session_id", "length", "x.f")


def _back(j: int):
    return lambda p: p - j


def score_words(found: DataFrame, times: list[int], n: int, mean: float, held: dict[int, int] | None = None) -> DataFrame:
    """(message_id, session_id, rank) of the words' frequencies: BM25, smaller is better. times: how often each word stands in the query;
    held: in how many messages it stands, where that isn't to be counted."""
    if held is None:
        counts = found.groupBy("word").agg(F.count("*").alias("n"))  # one row a word
    else:
        counts = found.sparkSession.createDataFrame(sorted(held.items()), "word int, n bigint")
    idf = counts.select("word", F.log((F.lit(n) - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("raw"))
    idf = idf.select("word", F.when(F.col("raw") <= 0, LEAST_IDF).otherwise(F.col("raw")).alias("idf"))
    repeat = reduce(lambda c, i: c.when(F.col("word") == i, times[i]), range(len(times)), F.when(F.lit(False), 0))
    weight = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    scored = found.join(F.broadcast(idf), "word")
    return scored.groupBy("message_id", "session_id").agg((-F.sum(F.col("idf") * weight * repeat)).alias("rank"))


def score_messages(postings: DataFrame, lengths: DataFrame | None, query: str, stats: tuple[int, float] | None = None) -> DataFrame | None:
    """(message_id, session_id, rank): BM25 of the messages that hold any word of the query; None for a query without words.

    Only the query's postings are read. Repeated words count as often as they stand in the query."""
    times = Counter(tuple(w) for w in rewrite_query(query) if w)
    if not times:
        return None
    n, mean = stats or corpus_stats(lengths)
    return score_words(word_frequencies(postings, [list(w) for w in times]), list(times.values()), n, mean)


def best_sessions(scored: DataFrame, scope: DataFrame, fetch: int) -> DataFrame:
    """(session_id, rank, message_id): the first sessions by their best message."""
    hits = scored.join(scope.hint("merge"), "session_id", "left_semi")
    best = hits.withColumn("r", F.round("rank", 9)).groupBy("session_id").agg(F.min(F.struct("r", "message_id")).alias("best")).select("session_id", F.col("best.r").alias("rank"), F.col("best.message_id").alias("message_id"))
    return best.orderBy("rank", "session_id").limit(fetch)


def snippets_of(top: DataFrame, messages: DataFrame) -> DataFrame:
    """A list's rows with the beginning of their message; at most as many look-ups as the list has rows."""
    return top.join(messages.select("message_id", snippet("content").alias("snippet")), "message_id").select("session_id", "rank", "snippet")


def fts_search(
    sessions: DataFrame, messages: DataFrame, query: str, fetch: int = 60, *, condition: Column | None = None, postings: DataFrame | None = None, lengths: DataFrame | None = None
) -> DataFrame:
    """(session_id, rank, snippet): sessions by their best message, which gives the snippet. Filters come before the limit.

    The index is made from the messages unless one is given; search_index in ``index`` searches one that a store keeps up."""
    scored = score_messages(postings if postings is not None else build_postings(messages), lengths if lengths is not None else build_lengths(messages), query)
    if scored is None:
        return messages.select("session_id", F.lit(0.0).alias("rank"), F.lit("").alias("snippet")).where(F.lit(False))
    scope = (sessions.where(condition) if condition is not None else sessions).select(F.col("id").alias("session_id"))
    return snippets_of(best_sessions(scored, scope, fetch), messages)


def knn_messages(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(message_id, distance) of the k nearest vectors by L2; vectors that are null, incomplete or of another length take no place."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(is_whole("embedding", len(query))).select("message_id", l2("embedding", literal).alias("distance")).orderBy("distance", "message_id").limit(k)


def knn_search(sessions: DataFrame, messages: DataFrame, vectors: DataFrame, query: list[float], fetch: int = 60, *, condition: Column | None = None, prefilter: bool = False) -> DataFrame:
    """(session_id, distance): sessions by their nearest message among the nearest fetch x 5.

    Filters come after that cut, so a narrow filter may leave few sessions; with ``prefilter`` (an addition) they come before."""
    owner = messages.select("message_id", "session_id")
    scope = (sessions.where(condition) if condition is not None else sessions).select(F.col("id").alias("session_id"))
    pool = vectors
    if prefilter:
        pool = vectors.join(owner.join(scope, "session_id", "left_semi").select("message_id"), "message_id", "left_semi")
    near = knn_messages(pool, query, fetch * PER_SESSION)
    return near.join(owner, "message_id").join(scope, "session_id", "left_semi").groupBy("session_id").agg(F.min("distance").alias("distance"))


def smallest(query, ids, distance, k: int, *more):
    """The k nearest of each query, ties by id; more: arrays that go along."""
    import numpy as np

    order = np.lexsort((ids, distance, query))
    at = query[order]
    keep = order[np.arange(len(at)) - np.searchsorted(at, at) < k]
    return query[keep], ids[keep], distance[keep], *(m[keep] for m in more)


def _nearest(wanted, x, ids, k: int, bound=None, *more):
    """(query's row, id, distance) of the k nearest rows of x for each wanted vector, ties by id; products choose, differences measure.
    bound: a distance for each wanted vector beyond which nothing is asked for."""
    import numpy as np

    take = min(k, len(x))
    norms, own = (x * x).sum(1), (wanted * wanted).sum(1)[:, None]
    far = norms[None, :] - 2 * wanted @ x.T
    edge = np.partition(far, take - 1, axis=1)[:, take - 1 : take]
    if bound is not None:
        edge = np.minimum(edge, bound[:, None] ** 2 - own)
    query, at = np.nonzero(far <= edge + 1e-9 * (1 + norms.max() + own))
    distance = np.empty(len(at))
    for i in range(0, len(at), PAIRS):
        some = slice(i, i + PAIRS)
        distance[some] = np.sqrt(((wanted[query[some]] - x[at[some]]) ** 2).sum(1))
    return smallest(query, ids[at], distance, k, *(m[at] for m in more))


def farthest(query, distance, n: int, k: int):
    """The distance of each of n queries' k-th neighbour, endless where it has fewer."""
    import numpy as np

    out = np.zeros(n)
    np.maximum.at(out, query, distance)
    return np.where(np.bincount(query, minlength=n) < k, np.inf, out)


def meet(blocks: DataFrame, chunks: DataFrame, tasks: int) -> DataFrame:
    """Every block of queries beside every chunk, a block's rows being in one of ``tasks`` partitions (see ``dealt``).

    A task has a few blocks and goes through all chunks; chunks are parted only where there are fewer blocks than cores. So what tasks keep
    for their queries grows with the queries, not with queries x chunks."""
    parts = max(1, chunks.sparkSession.sparkContext.defaultParallelism // tasks)
    return chunks.repartition(parts).hint("shuffle_replicate_nl").crossJoin(blocks)


def dealt(queries: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Queries dealt out by their ids to partitions of about ``most``, and how many those are."""
    tasks = max(1, -(-queries.select("query_id").distinct().count() // most))
    return queries.repartition(tasks, "query_id"), tasks


def row_by_row(batches):
    """Rows of batches, one at a time as Python values."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in batch.columns]


def packed(vectors: DataFrame, key: str, most: int, names: tuple[str, str], owner: str | None = None) -> DataFrame:
    """Rows of at most ``most`` vectors: their ids and their numbers as bytes, and their owners (strings) as an array."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                some = batch.slice(i, most)
                ids, x = some.column(0).to_numpy(zero_copy_only=False), some.column(1).flatten().to_numpy(zero_copy_only=False)
                parts = [pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([x.astype(np.float64).tobytes()], pa.binary())]
                parts += [pa.array([some.column(2).to_pylist()], pa.list_(pa.string()))] if owner else []
                yield pa.RecordBatch.from_arrays(parts, names=[*names, "owners"][: len(parts)])

    return vectors.select(key, "embedding", *([owner] if owner else [])).mapInArrow(run, f"{names[0]} binary, {names[1]} binary{', owners array<string>' if owner else ''}")


def comparable(vectors: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of both, the vectors that are whole and as long as the longest query."""
    dimension = queries.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    return vectors.where(is_whole("embedding", dimension)), queries.where(is_whole("embedding", dimension))


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, owner: str | None = None) -> DataFrame:
    """(query_id, message_id, distance): the k nearest vectors of each query, whatever their number, with a column of strings that the vectors bring along.

    Blocks of query vectors meet chunks of vectors in a join, so neither side passes through the driver. Each task keeps the k nearest of
    each of its queries, so what is dealt out by query grows with the queries. Vectors and queries count that are whole and as long as the longest query."""
    import numpy as np
    import pyarrow as pa

    vectors, queries = comparable(vectors, queries)
    names = ["query_id", "message_id", "distance", *([owner] if owner else [])]

    def near(batches):
        held: dict = {}
        n = 0

        def rows():
            for asked, (query, ids, distance, *owners) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(asked, np.int64)[query]), pa.array(ids), pa.array(distance), *[pa.array(o, pa.string()) for o in owners]], names=names)

        for asked, wanted, ids, x, *owners in row_by_row(batches):
            ids, wanted = np.frombuffer(ids, np.int64), np.frombuffer(wanted).reshape(len(asked) // 8, -1)
            bound = farthest(held[asked][0], held[asked][2], len(wanted), k) if asked in held else None
            found = _nearest(wanted, np.frombuffer(x).reshape(len(ids), -1), ids, k, bound, *[np.array(o, object) for o in owners])
            if asked in held:
                query, *rest = (np.concatenate(two) for two in zip(held[asked], found, strict=True))
                found = smallest(query, *rest[:2], k, *rest[2:])
            elif n + len(wanted) > HELD:
                yield from rows()
                held.clear()
                n = 0
            n += 0 if asked in held else len(wanted)
            held[asked] = found
        yield from rows()

    few, tasks = dealt(queries, BLOCK)
    pairs = meet(packed(few, "query_id", BLOCK, ("asked", "wanted")), packed(vectors, "message_id", CHUNK, ("ids", "x"), owner), tasks).select("asked", "wanted", "ids", "x", *(["owners"] if owner else []))
    local = pairs.mapInArrow(near, f"query_id bigint, message_id bigint, distance double{f', `{owner}` string' if owner else ''}")
    order = Window.partitionBy("query_id").orderBy("distance", "message_id")
    return local.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def _ranked(listed: DataFrame, by: str, name: str) -> DataFrame:
    """Ranks from 0 over a list that is already limited (a few hundred rows)."""
    return listed.withColumn(name, F.row_number().over(Window.orderBy(by, "session_id")) - 1)


def fuse(keyword: DataFrame, vector: DataFrame | None) -> DataFrame:
    """(session_id, score, match, snippet): reciprocal ranks summed over both lists; the label tells which lists hold a session."""
    words = _ranked(keyword, "rank", "wr").select("session_id", "snippet", "wr")
    if vector is None:
        vector = keyword.select("session_id", F.col("rank").alias("distance")).where(F.lit(False))
    near = _ranked(vector, "distance", "vr").select("session_id", "vr")
    both = words.join(near, "session_id", "full_outer")
    share = lambda c: F.when(F.col(c).isNotNull(), 1.0 / (RRF + F.col(c) + 1)).otherwise(0.0)
    label = F.when(F.col("wr").isNotNull() & F.col("vr").isNotNull(), "HYB").when(F.col("wr").isNotNull(), "FTS").otherwise("VEC")
    return both.select("session_id", (share("wr") + share("vr")).alias("score"), label.alias("match"), "snippet")


def hybrid_search(
    sessions: DataFrame, messages: DataFrame, vectors: DataFrame | None, query: str, query_vector: list[float] | None = None, limit: int = 20, multiplier: int = 3, *,
    sources: list[str] | None = None, time_range: str = "all", directory: str | None = None, as_of_ms: int = 0, postings: DataFrame | None = None, lengths: DataFrame | None = None,
) -> DataFrame:
    """Sessions by fused score, best first: position, score, match label, snippet, and the session's columns. Without a query vector: keywords alone."""
    condition = session_filter(sources, time_range, directory, as_of_ms)
    fetch = limit * multiplier
    words = fts_search(sessions, messages, query, fetch, condition=condition, postings=postings, lengths=lengths)
    near = knn_search(sessions, messages, vectors, query_vector, fetch, condition=condition) if query_vector is not None and vectors is not None else None
    top = fuse(words, near).orderBy(F.col("score").desc(), "session_id").limit(limit)
    # at most `limit` rows
    placed = top.withColumn("position", F.row_number().over(Window.orderBy(F.col("score").desc(), "session_id")))
    return F.broadcast(placed).join(sessions, F.col("session_id") == F.col("id")).drop("id").orderBy("position")


def search_with(encoder, sessions: DataFrame, messages: DataFrame, vectors: DataFrame, state: DataFrame, query: str, **scope) -> DataFrame:
    """Hybrid search with the query's vector by an encoder; keywords alone, and no encoder called, until a session is done or in work."""
    vector = encoder(query) if is_embedded(state) else None
    return hybrid_search(sessions, messages, vectors, query, vector, **scope)


def result_listing(results: DataFrame, labels: DataFrame, as_of_ms: int) -> DataFrame:
    """Lines of a result list: position, source label, match label, age, title, snippet of 120 characters, directory."""
    return results.join(F.broadcast(labels), "source", "left").select(
        "position", F.coalesce("label", "source").alias("label"), "match", age_label("started_at", as_of_ms).alias("age"), "title", F.substring("snippet", 1, 120).alias("snippet"), F.coalesce("directory", F.lit("-")).alias("directory")
    )


def display_cuts(results: DataFrame) -> DataFrame:
    """Titles of 40 characters and the last 30 of directories."""
    return results.select("session_id", cut("title", 40, "").alias("title"), F.right("directory", F.lit(30)).alias("directory"))
