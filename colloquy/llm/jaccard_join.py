"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word 5-grams; texts with equal sets form one node, so copies are never paired. Nodes that agree on all values of a
MinHash band are candidates. Candidates' MinHash values are compared step by step; a pair is dropped as soon as the posterior
probability (uniform prior) of reaching the threshold falls below the tolerance. The rest are verified exactly.

No row stands for a pair within a group of near copies. In each bucket the node that stands in the most company is the pivot; a
node's home is the pivot, of similarity HOME and more, that most nodes are close to (first through its own buckets, then through the
pivots' homes), and what tells the node from the pivot is kept. Two members of one home have |pivot| - a - b + o grams in common,
where a and b count the pivot's grams each lacks and o the grams that both lack or both add. A light member lacks so little that any
two of them reach the threshold with o = 0: their links are a count. All other pairs of a home have a heavy member: heavy members
meet all members in units of two blocks of bounded size, a unit compares its pairs' MinHash values, verifies the survivors exactly
and gives the number of links of each member, not the pairs. Work within a home grows with heavy members x members, rows with
heavy members x members / BLOCK.

Nodes of different homes meet in their buckets, where these hold few homes, and by their rarest grams where a bucket holds many
(texts that share a passage and little else): a pair that reaches the threshold always shares one of them. They too are compared in
units of two blocks; the pairs that survive are verified exactly. At similarity 0.8 the bands miss three links in a million.

Texts of fewer than five words have one gram of all their words; null, empty and blank texts have none and are equal to each other
and to nothing else. Repeated rows and equal keys stay rows of their own; a null key is a key like any other, but names no group
while the group has another. An empty table gives no rows. Columns of any name pass; a text of any length is one set of grams.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut_lineage, list_array, per_batch, read_table, release, unused
from .license_scan import rolling, word_hashes

SHINGLE, THRESHOLD = 5, (4, 5)  # the similarity as a fraction: 0.8
ROWS, BANDS = 5, 32
#: Least similarity to a pivot at which a node may have its home there.
HOME = (1, 4)
#: Homes a bucket may have for its nodes to meet there; nodes of fuller buckets meet by their rarest grams.
DOORS = 16
#: Members of a block, and grams that tell them from their pivot; a unit holds two blocks.
BLOCK, GRAMS = 256, 100_000
#: Tasks in which the members of one home meet its counts.
SALTS = 8
TOLERANCE, STEP = 1e-6, 32

_r = np.random.default_rng(20240229)
FACTORS = _r.integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
OFFSETS = _r.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)


def grams(data: bytes) -> np.ndarray:
    """Distinct hashes of a text's word 5-grams, sorted."""
    words = data.split()
    return np.unique(rolling(word_hashes(words), min(SHINGLE, len(words)))) if words else np.zeros(0, np.int64)


def minhash(found: np.ndarray) -> np.ndarray:
    """The low 16 bits of the smallest value of each hash function over the grams."""
    out = np.full(len(FACTORS), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(found), 4096):
        some = found[i : i + 4096].view(np.uint64)
        np.minimum(out, ((FACTORS[:, None] * some[None, :] + OFFSETS[:, None]) >> np.uint64(32)).min(1), out=out)
    return out & np.uint64(0xFFFF)


def band_hashes(values: np.ndarray) -> np.ndarray:
    """A hash of each band's values, with the band's number."""
    rows = values.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        out = (out ^ rows[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def least_matches(threshold: tuple[int, int] = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is dropped): posterior of similarity >= threshold under a uniform prior."""
    t = np.linspace(1e-9, 1 - 1e-9, 20_001)
    high = t >= threshold[0] / threshold[1]
    out = []
    for n in range(STEP, ROWS * BANDS + 1, STEP):
        least = 0
        for m in range(n + 1):
            log = m * np.log(t) + (n - m) * np.log1p(-t)
            density = np.exp(log - log.max())
            if density[high].sum() / density.sum() >= tolerance:
                break
            least = m + 1
        out.append((n, least))
    return out


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest, node, size, values, bands) of each row; node names the set of grams, digest the text."""
    kind = dict(docs.dtypes)[key]
    ready = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", digest_of("text"))

    def run(batch: pa.RecordBatch) -> dict:
        every = [grams(t) for t in as_bytes(batch.column(2))]
        values = [minhash(g) for g in every]
        return {
            "key": batch.column(0), "digest": batch.column(1), "node": [hashlib.blake2b(g.tobytes(), digest_size=16).digest() for g in every], "size": [len(g) for g in every],
            "values": [v.astype("<u2").tobytes() for v in values], "bands": list_array(np.concatenate([band_hashes(v) if len(g) else np.zeros(0, np.int64) for v, g in zip(values, every, strict=True)]), [BANDS if len(g) else 0 for g in every], pa.int64()),
        }

    return per_batch(ready, ["key", "digest", "text"], run, f"key {kind}, digest binary, node binary, size int, values binary, bands array<bigint>")


def digest_of(text: str) -> Column:
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def matrix(values: pa.Array) -> np.ndarray:
    """MinHash values of the rows of a binary column."""
    return np.frombuffer(b"".join(values.to_pylist()), "<u2").reshape(len(values), ROWS * BANDS)


def surviving(va: np.ndarray, vb: np.ndarray, x: np.ndarray, y: np.ndarray, table: list[tuple[int, int]], at_once: int = 50_000) -> np.ndarray:
    """Which of the pairs (row x of va, row y of vb) keep a chance: values are compared step by step, dropped pairs no further."""
    kept = []
    for i in range(0, len(x), at_once):
        a, b = x[i : i + at_once], y[i : i + at_once]
        alive, seen, last = np.arange(len(a)), np.zeros(len(a), np.int64), 0
        for n, least in table:
            seen[alive] += (va[a[alive], last:n] == vb[b[alive], last:n]).sum(1)
            alive, last = alive[seen[alive] >= least], n
        kept.append(alive + i)
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def prune(pairs: DataFrame, nodes: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Pairs (a, b) whose MinHash values leave them a chance to reach the threshold."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("values").alias(f"v{c}"))
    table = least_matches(threshold)

    def run(batch: pa.RecordBatch) -> dict:
        every = np.arange(batch.num_rows)
        at = pa.array(surviving(matrix(batch.column(2)), matrix(batch.column(3)), every, every, table), pa.int64())
        return {"a": batch.column(0).take(at), "b": batch.column(1).take(at)}

    return per_batch(pairs.join(side("a"), "a").join(side("b"), "b"), ["a", "b", "va", "vb"], run, "a binary, b binary")


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(node, text) of the wanted nodes, the text of each node's representative row."""
    places = nodes.join(wanted, "node").select("node", F.col("rep.key").alias("key"), F.col("rep.digest").alias("digest"))
    all_texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", digest_of("text"))
    return all_texts.join(places, all_texts["key"].eqNullSafe(places["key"]) & (all_texts["digest"] == places["digest"])).select("node", "text").dropDuplicates(["node"])


def verify(pairs: DataFrame, texts: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Pairs that reach the threshold exactly, with what tells a from b: (a, b, size_a, size_b, lacks, adds); lacks are b's grams that a has not."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("at", "size_a", "size_b", "lacks", "adds")}
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.int64))
        for i, (ta, tb) in enumerate(zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True)):
            if last[0] != tb:
                last = (tb, grams(tb))
            x, y = grams(ta), last[1]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both * sum(threshold) >= threshold[0] * (len(x) + len(y)):
                for k, v in (("at", i), ("size_a", len(x)), ("size_b", len(y)), ("lacks", np.setdiff1d(y, x, assume_unique=True)), ("adds", np.setdiff1d(x, y, assume_unique=True))):
                    out[k].append(v)
        at = pa.array(out.pop("at"), pa.int64())
        return {"a": batch.column(0).take(at), "b": batch.column(1).take(at), **out}

    return per_batch(pairs.join(side("a"), "a").join(side("b"), "b"), ["a", "b", "ta", "tb"], run, "a binary, b binary, size_a int, size_b int, lacks array<bigint>, adds array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b): smallest label of the neighbours and label of the label, until nothing moves.

    A label that a large component shares meets one row only, and Spark splits the partition it lands in."""
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = cut_lineage(labels.join(near, "node").join(jump, "label").select("node", F.col("label").alias("old"), F.least("label", "near", "jump").alias("label")))
        release(labels)
        labels = new
        if new.where(F.col("old") != F.col("label")).isEmpty():
            release(both)
            return labels.select("node", F.col("label").alias("component"))


def homes_of(close: DataFrame) -> DataFrame:
    """(node, home): of the pivots b that a node a is close to, the one that most are; a pivot that outdoes them all is at home with itself."""
    weight = close.groupBy("b").agg(F.count("*").alias("w"))
    best = close.join(weight, "b").groupBy("a").agg(F.max(F.struct("w", "b")).alias("best"))
    own = best.join(weight.select(F.col("b").alias("a"), F.col("w").alias("own")), "a", "full_outer")
    stays = F.coalesce(F.struct(F.col("own").alias("w"), F.col("a").alias("b")) > F.col("best"), F.col("best").isNull())
    return own.select(F.col("a").alias("node"), F.when(stays, F.col("a")).otherwise(F.col("best.b")).alias("home"))


def hashed_block(node: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(node), n).cast("int")


def overlaps(parts: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many values of parts[x] and parts[y] are the same, for each pair."""
    if len(x) <= 4 * len(parts):
        return np.array([len(np.intersect1d(parts[i], parts[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    _, code, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    rename = np.cumsum(times > 1) - 1
    shared = times[code] > 1
    row, col = np.repeat(np.arange(len(parts)), size)[shared], rename[code[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(parts), len(parts)), np.float32)
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        a, b = np.searchsorted(col, [first, first + 4096])
        dense = np.zeros((len(parts), 4096), np.float32)
        dense[row[a:b], col[a:b] - first] = 1
        both += dense @ dense.T
    return both[x, y].astype(np.int64)


def count_in_units(members: DataFrame, threshold: tuple[int, int] = THRESHOLD, block: int = BLOCK, most_grams: int = GRAMS) -> DataFrame:
    """(node, links, peer): links of the members of each home to one another, and nodes that join those the pivot doesn't.

    members: node, home, pivot (its size), size, a, lacks, adds, values. A member may stand in several rows of the result."""
    t, u = threshold[0], sum(threshold)
    light = 2 * (t * F.col("size") + u * F.col("a")) <= u * F.col("pivot")
    weighed = members.withColumn("light", light).withColumn("salt", hashed_block("node", F.lit(SALTS)))
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    grams_of = F.size("lacks") + F.size("adds")
    homes = weighed.groupBy("home").agg(
        F.count_if("light").alias("n_light"), F.count_if(~F.col("light")).alias("n_heavy"), F.sum(F.when(F.col("light"), grams_of).otherwise(0)).alias("g_light"), F.sum(F.when(F.col("light"), 0).otherwise(grams_of)).alias("g_heavy")
    )
    sure = weighed.where("light").join(homes.where("n_light > 1").select("home", "n_light", every_salt), ["home", "salt"]).select("node", (F.col("n_light") - 1).alias("links"), F.lit(None).cast("binary").alias("peer"))

    blocks = lambda n, g: F.ceil(F.greatest(n / block, g / most_grams)).cast("int")
    whole = (F.col("n_light") + F.col("n_heavy") <= block) & (F.col("g_light") + F.col("g_heavy") <= most_grams)
    dealt = homes.where((F.col("n_heavy") > 0) & (F.col("n_light") + F.col("n_heavy") > 1)).select(
        "home", F.when(whole, 1).otherwise(blocks(F.col("n_heavy"), F.col("g_heavy"))).alias("heavy_blocks"), F.when(whole, 0).otherwise(blocks(F.col("n_light"), F.col("g_light"))).alias("light_blocks")
    )
    placed = weighed.join(dealt.select("*", every_salt), ["home", "salt"]).withColumn("b", F.when(F.col("light") & (F.col("light_blocks") > 0), F.col("heavy_blocks") + hashed_block("node", F.col("light_blocks"))).otherwise(hashed_block("node", F.col("heavy_blocks"))))
    # a heavy block meets every block, a light one the heavy ones
    partners = F.when(F.col("b") < F.col("heavy_blocks"), F.col("heavy_blocks") + F.col("light_blocks")).otherwise(F.col("heavy_blocks"))
    spread = placed.withColumn("q", F.explode(F.sequence(F.lit(0), partners - 1)))
    fields = ["node", "b", "size", "a", "lacks", "adds", "values"]
    units = spread.groupBy("home", F.least("b", "q").alias("i"), F.greatest("b", "q").alias("j")).agg(F.first("pivot").alias("pivot"), F.collect_list(F.struct(*fields)).alias("m"))
    table = least_matches(threshold)

    def run(batch: pa.RecordBatch) -> dict:
        pivots, first, second = (batch.column(i).to_numpy() for i in (0, 1, 2))
        lists = batch.column(3)
        offsets = lists.offsets.to_numpy()
        flat = dict(zip(fields, lists.values.flatten(), strict=True))
        nodes, ends = flat["node"], {}
        for side in ("lacks", "adds"):
            ends[side] = (flat[side].offsets.to_numpy(), flat[side].values.to_numpy())
        out_node, out_links, out_peer = [], [], []
        for r in range(batch.num_rows):
            lo, hi = int(offsets[r]), int(offsets[r + 1])
            n, pivot = hi - lo, int(pivots[r])
            size, a, b = (flat[c].slice(lo, n).to_numpy().astype(np.int64) for c in ("size", "a", "b"))
            adds = size - pivot + a
            cost = t * size + u * a
            short = cost[:, None] + cost[None, :] - u * pivot  # how far the intersection is short if o is 0, times u
            wanted = -(-short // u) <= np.minimum(a[:, None], a[None, :]) + np.minimum(adds[:, None], adds[None, :])
            wanted &= (2 * np.maximum(cost[:, None], cost[None, :])) > u * pivot  # two light members are counted already
            if first[r] == second[r]:
                wanted &= np.arange(n)[:, None] < np.arange(n)[None, :]
            else:
                wanted &= (b == first[r])[:, None] & (b == second[r])[None, :]
            x, y = np.nonzero(wanted)
            if not len(x):
                continue
            sure = short[x, y] <= 0
            known = x[sure], y[sure]
            x, y = x[~sure], y[~sure]
            values = matrix(flat["values"].slice(lo, n))
            kept = surviving(values, values, x, y, table)
            x, y = x[kept], y[kept]
            parts = []
            for k in range(lo, hi):  # a gram that is lacked never equals one that is added
                some = [v[o[k] : o[k + 1]] for o, v in (ends["lacks"], ends["adds"])]
                parts.append(np.concatenate(some))
            linked = u * overlaps(parts, x, y) >= short[x, y]
            x, y = (np.concatenate([k, z[linked]]) for k, z in zip(known, (x, y), strict=True))
            if not len(x):
                continue
            links = np.bincount(x, minlength=n) + np.bincount(y, minlength=n)
            tied = u * (pivot - a) >= t * (size + pivot)  # joined through the pivot already
            label = np.arange(n)
            ties = np.flatnonzero(tied)
            while True:
                before = label.copy()
                np.minimum.at(label, x, label[y])
                np.minimum.at(label, y, label[x])
                if len(ties):
                    label[ties] = label[ties].min()
                label = label[label]
                if (label == before).all():
                    break
            leads = ~tied
            leads[ties[:1]] = True
            at = np.flatnonzero((links > 0) | (leads & (label != np.arange(n))))
            out_node.append(nodes.take(pa.array(lo + at)))
            out_links.append(links[at])
            out_peer.append(nodes.take(pa.array(np.where(leads[at] & (label[at] != at), lo + label[at], -1), mask=~(leads[at] & (label[at] != at)))))
        if not out_node:
            return None
        return {"node": pa.concat_arrays(out_node), "links": np.concatenate(out_links), "peer": pa.concat_arrays(out_peer)}

    return sure.unionByName(per_batch(units, ["pivot", "i", "j", "m"], run, "node binary, links bigint, peer binary"))


def rare_grams(housed: DataFrame, texts: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(place, node, home) under the rarest grams of each node that other nodes share.

    A pair at the threshold t has at least t times the grams of either in common, so one of them is among the first (1 - t) of each
    and one more, in any order that is the same for all."""

    def run(batch: pa.RecordBatch) -> dict:
        every = [grams(t) for t in as_bytes(batch.column(2))]
        sizes = [len(g) for g in every]
        return {"node": batch.column(0), "home": batch.column(1), "size": sizes, "grams": list_array(np.concatenate(every), sizes, pa.int64())}

    held = per_batch(housed.join(texts, "node"), ["node", "home", "text"], run, "node binary, home binary, size int, grams array<bigint>")
    held = held.select("node", "home", "size", F.explode("grams").alias("gram"))
    common = held.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    rarest = Window.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "gram")
    short = F.col("size") - F.ceil(F.col("size") * threshold[0] / threshold[1] - 1e-9) + 1
    return held.join(common, "gram", "left").withColumn("at", F.row_number().over(rarest)).where(F.col("df").isNotNull() & (F.col("at") <= short)).select(F.col("gram").alias("place"), "node", "home")


def meet(places: DataFrame, nodes: DataFrame, threshold: tuple[int, int] = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of nodes of different homes that stand at one place and whose MinHash values leave them a chance.

    places: place, node, home; each place once for a node. The nodes of a place meet in units of two blocks of bounded size."""
    here = places.groupBy("place").agg(F.count("*").alias("m"), F.min("home").alias("one"), F.max("home").alias("two")).where(F.col("one") != F.col("two"))
    placed = places.join(here.select("place", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "place").withColumn("b", hashed_block("node", F.col("blocks")))
    spread = placed.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("place", "node", "home", "b", F.least("b", "q").alias("i"), F.greatest("b", "q").alias("j"))
    valued = spread.join(nodes.select("node", "size", "values"), "node")
    fields = ["node", "home", "b", "size", "values"]
    units = valued.groupBy("place", "i", "j").agg(F.collect_list(F.struct(*fields)).alias("m"))
    table, (t, whole) = least_matches(threshold), threshold

    def run(batch: pa.RecordBatch) -> dict:
        first, second = (batch.column(i).to_numpy() for i in (0, 1))
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy()
        flat = dict(zip(fields, lists.values.flatten(), strict=True))
        home = flat["home"].dictionary_encode().indices.to_numpy()
        b, size = (flat[c].to_numpy() for c in ("b", "size"))
        pairs = []
        for r in range(batch.num_rows):
            lo, hi = int(offsets[r]), int(offsets[r + 1])
            x, y = np.triu_indices(hi - lo, 1)
            x, y = x + lo, y + lo
            wanted = home[x] != home[y]
            if first[r] != second[r]:
                wanted &= b[x] != b[y]
            wanted &= np.minimum(size[x], size[y]) * whole >= np.maximum(size[x], size[y]) * t
            pairs.append((x[wanted], y[wanted]))
        x, y = (np.concatenate(z) for z in zip(*pairs, strict=True))
        values = matrix(flat["values"])
        kept = surviving(values, values, x, y, table)
        return {"x": flat["node"].take(pa.array(x[kept])), "y": flat["node"].take(pa.array(y[kept]))}

    found = per_batch(units, ["i", "j", "m"], run, "x binary, y binary")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def link_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, digest, group (smallest key of the rows that links join), set_key (smallest key with equal grams), n_copies, n_links
    (other nodes linked to the row's node)."""
    rows = cut_lineage(sketch(docs, key, text))
    nodes = cut_lineage(rows.groupBy("node").agg(F.min(F.struct("key", "digest")).alias("rep"), F.min("key").alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("values").alias("values"), F.first("bands").alias("bands")))

    # buckets of two nodes and more
    banded = nodes.select("node", F.explode("bands").alias("h"))
    crowds = banded.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    buckets = cut_lineage(banded.join(crowds, "h"))
    company = buckets.groupBy("node").agg(F.sum("m").alias("company"))
    pivots = cut_lineage(buckets.join(company, "node").groupBy("h").agg(F.max(F.struct("company", "node")).alias("p")).select("h", F.col("p.node").alias("pivot")))
    stars = buckets.join(pivots, "h").where(F.col("node") != F.col("pivot")).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    texts = cut_lineage(texts_of(buckets.select("node").distinct(), nodes, docs, key, text))
    near = cut_lineage(verify(prune(stars, nodes, HOME), texts, HOME))
    # a node that meets no great pivot itself may do so through the pivots of its buckets
    first_homes = cut_lineage(homes_of(near)).select(F.col("node").alias("pivot"), F.col("home").alias("b"))
    led = buckets.join(pivots, "h").join(first_homes, "pivot").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct().join(near.select("a", "b"), ["a", "b"], "left_anti")
    far = cut_lineage(verify(prune(led, nodes, HOME), texts, HOME))
    close = near.union(far)
    homes = cut_lineage(homes_of(close))

    away = close.join(homes.where(F.col("node") != F.col("home")).select(F.col("node").alias("a"), F.col("home").alias("b")), ["a", "b"])
    empty = F.array().cast("array<bigint>")
    at_home = homes.where(F.col("node") == F.col("home")).join(nodes.select("node", "size"), "node")
    members = away.select(F.col("a").alias("node"), F.col("b").alias("home"), F.col("size_a").alias("size"), F.col("size_b").alias("pivot"), "lacks", "adds").unionByName(
        at_home.select("node", "home", "size", F.col("size").alias("pivot"), empty.alias("lacks"), empty.alias("adds"))
    )
    members = cut_lineage(members.withColumn("a", F.size("lacks")))
    release(near, far)
    inside = cut_lineage(count_in_units(members.join(nodes.select("node", "values"), "node")))

    # nodes of different homes
    housed = buckets.join(homes, "node", "left").select("h", "node", F.coalesce("home", "node").alias("home"))
    full = housed.select("h", "home").distinct().groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > DOORS).select("h")
    few, many = housed.join(full, "h", "left_anti"), housed.join(full, "h", "left_semi").select("node", "home").distinct()
    places = few.select(F.struct(F.lit(0).alias("k"), F.col("h").alias("v")).alias("place"), "node", "home")
    rare = rare_grams(many, texts).select(F.struct(F.lit(1).alias("k"), F.col("place").alias("v")).alias("place"), "node", "home")
    across = cut_lineage(verify(prune(meet(places.unionByName(rare), nodes), nodes), texts).select("a", "b"))

    counted = inside.select("node", "links").union(across.select(F.col("a").alias("node"), F.lit(1).alias("links"))).union(across.select(F.col("b").alias("node"), F.lit(1).alias("links"))).groupBy("node").agg(F.sum("links").alias("links"))
    # a home's links join through the pivot, but for those that units found beyond it
    t, u = THRESHOLD[0], sum(THRESHOLD)
    at_pivot = members.where((F.col("node") != F.col("home")) & (u * (F.col("pivot") - F.col("a")) >= t * (F.col("size") + F.col("pivot")))).select(F.col("node").alias("a"), F.col("home").alias("b"))
    joined = components(across.union(at_pivot).union(inside.where(F.col("peer").isNotNull()).select(F.col("node").alias("a"), F.col("peer").alias("b"))))
    named = nodes.select("node", "least", "copies").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = named.groupBy("component").agg(F.min("least").alias("group"))
    facts = named.join(groups, "component").join(counted, "node", "left").select("node", "group", F.col("least").alias("set_key"), F.col("copies").alias("n_copies"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"))
    release(buckets, pivots, texts, homes)
    return rows.select("node", "key", "digest").join(facts, "node").select(F.col("key").alias(key), "digest", "group", "set_key", "n_copies", "n_links")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: class, exact class, and number of links."""
    found = link_groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("group").alias("class_id"), "n_links", F.col("set_key").alias("copy_class_id"), "n_copies")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, all its columns: that of the smallest key (of equal keys, the one with the smallest hash of its text)."""
    found = link_groups(docs, key, text)
    digest, first_key, first_digest = (unused(docs, c) for c in ("digest", "first_key", "first_digest"))
    first = found.groupBy("group").agg(F.min(F.struct(F.col(key).alias("k"), F.col("digest").alias("d"))).alias("x")).select(F.col("x.k").alias(first_key), F.col("x.d").alias(first_digest))
    ready = docs.withColumn(digest, digest_of(text))
    kept = ready.join(first, F.col(key).eqNullSafe(F.col(first_key)) & (F.col(digest) == F.col(first_digest)), "left_semi")
    # rows repeated whole: one of them
    return kept.dropDuplicates([key, digest]).drop(digest)
