"""SentencePiece encoding with sampled segmentations, and decoding.

A text is a lattice of vocabulary pieces. A piece weighs -POWER * log(1 + its rank), a character that no piece holds weighs as its
byte pieces; a segmentation's probability is the normalised exponent of its pieces' weights. K distinct segmentations are drawn
without replacement by Gumbel top-k: the lattice is searched best first over partial segmentations, each with the largest perturbed
log-probability below it. The first is an exact sample; every decision along it leaves a sibling subtree (the same decisions before,
another piece here) whose perturbed maximum is a Gumbel value truncated at its parent's; the largest sibling is the next segmentation,
and so on. The value that would come next gives each drawn segmentation its inclusion score.

Pieces never cross from a word into the space before the next word, nor a line end, so the lattice falls apart into short ones, one
for each word; a worker keeps those of the words it has met, up to a bound. Random numbers are a hash of the row's key (64 bits),
round, place and step: a row draws the same whatever rows stand beside it. Along a path the mass of the siblings falls, and a Gumbel
value of 53 random bits is at most 37, so decisions whose siblings cannot be among the K largest any more are passed over exactly.

Null and empty texts have one segmentation, of no pieces, included with certainty; texts with fewer than K segmentations give all they
have. Repeated rows give equal rows; equal texts under other keys draw anew, a null key is a key of its own. Ties between perturbed
values go to the earlier decision. Columns of any name pass; an empty table gives no rows. A text is held whole, with some 60 bytes of
working memory for each of its characters.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, list_array, per_batch, read_table

K, POWER, LONGEST = 3, 1.0, 16
UNIT = re.compile(r" *[^ \n]+| +|\n")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)
#: Pieces of word lattices that a worker keeps before it begins anew; bytes of texts that are sampled together.
KEPT, TOGETHER = 10_000_000, 2 << 20
#: Decisions of a path that are looked at first, and more than the largest Gumbel value of a 53-bit number.
WINDOW, TALLEST = 400, 37.5


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) by seed and counter."""
    u = mix(seed + counter.astype(np.uint64) * GOLDEN) >> np.uint64(11)
    return np.minimum((u.astype(float) + 0.5) * 2.0**-53, 1 - 2.0**-53)


def gumbel(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(uniform(seed, counter)))


def counters(round_: int, kind: int, place) -> np.ndarray:
    """Numbers that differ by round, kind (0: whole lattice, 1: steps, 2: siblings) and place (under 2 ** 48)."""
    return np.asarray(place).astype(np.uint64) + np.uint64((3 * round_ + kind) << 48)


class Strings:
    """The string of each id, one after the other, so that strings of many ids are put together as arrays."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.fromiter(map(len, strings), np.int32, len(strings))
        self.start = np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All ids' strings joined, and where each run of ids (by its end) ends in them."""
        size = self.size[ids]
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        at = np.repeat(self.start[ids] - total[:-1], size)
        at += np.arange(len(at))
        return self.flat[at].tobytes(), total[ends]


class Vocabulary:
    """Pieces by hash of their code points, their weights, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.byte_id = next(i for i in range(len(pieces)) if model.is_byte(i))
        usable = [i for i in range(len(pieces)) if self.bytes[i] and not model.is_byte(i)]
        rank = np.array([min(-model.get_score(i), len(pieces)) for i in usable])
        self.byte_weight = -POWER * float(np.log1p(len(pieces)))
        hashes = np.array([self._hash(self.bytes[i].decode()) for i in usable], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.weights = hashes[order], np.array(usable)[order], -POWER * np.log1p(np.maximum(rank, 0))[order]
        self.text = Strings(self.bytes)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) % (1 << 64)
        return int(mix(np.array([h + len(piece)], np.uint64))[0])

    def find(self, rolled: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces of size code points stand among rolled hashes (flat places), and their places in the vocabulary."""
        h = mix(rolled.ravel() + np.uint64(size))
        at = np.flatnonzero(self.maybe[h >> np.uint64(44)])
        found = np.searchsorted(self.hashes, h[at])
        found[found == len(self.hashes)] = 0
        hit = self.hashes[found] == h[at]
        return at[hit], found[hit]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Index(dict):
    """Numbers for words, in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Lattices:
    """Lattices of the words met so far. Node base[w] + j stands before the word's j-th code point. The edges (pieces) of a node are
    those that end there, the likeliest first; bound is their cumulated share, and one uniform number a step draws an edge."""

    def __init__(self, voc: Vocabulary, most: int = KEPT):
        self.voc, self.most = voc, most
        self.clear()

    def clear(self) -> None:
        self.index, self.nodes, self.edges = Index(), 0, 0
        self.size, self.base = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.begin, self.options = np.zeros(0, np.int32), np.zeros(0, np.int16)
        self.node, self.length, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int8), np.zeros(0, np.int32)
        self.bound, self.log = np.zeros(0, np.float32), np.zeros(0, np.float32)

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's words; lattices of new ones are added."""
        if self.edges > self.most:
            self.clear()
        old = len(self.index)
        out = []
        for t in texts:
            units = UNIT.findall(" " + t) if t else []
            out.append(np.fromiter(map(self.index.__getitem__, units), np.int64, len(units)))
        self._add(list(self.index)[old:] if old else list(self.index))
        return out

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """values at a place of an array that doubles when it is full."""
        have = getattr(self, name)
        if at + len(values) > len(have):
            grown = np.zeros(max(2 * len(have), at + len(values)), have.dtype)
            grown[:at] = have[:at]
            setattr(self, name, grown)
            have = grown
        have[at : at + len(values)] = values

    def _add(self, units: list[str]) -> None:
        size = np.fromiter(map(len, units), np.int64, len(units))
        base = np.zeros(len(units), np.int64)
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        first = np.cumsum(size) - size
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order], prepend=-1))
        known = len(self.index) - len(units)
        for i, a in enumerate(cuts):
            some = order[a : cuts[i + 1] if i + 1 < len(cuts) else len(order)]
            n = int(size[some[0]])
            step = max(1, 1_000_000 // (n + 1) // min(n, LONGEST))
            for j in range(0, len(some), step):
                here = some[j : j + step]
                base[here] = self.nodes + np.arange(len(here)) * (n + 1)
                node, length, ids, share, bound = self._edges(codes[first[here][:, None] + np.arange(n)], self.voc)
                count = np.bincount(node, minlength=len(here) * (n + 1))
                self._put("begin", self.nodes, self.edges + np.cumsum(count) - count)
                self._put("options", self.nodes, count)
                for name, values in (("node", node + self.nodes), ("length", length), ("ids", ids), ("bound", bound), ("log", np.log(share))):
                    self._put(name, self.edges, values)
                self.nodes, self.edges = self.nodes + len(count), self.edges + len(node)
        self._put("size", known, size)
        self._put("base", known, base)

    @staticmethod
    def _edges(chars: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, ...]:
        """(node, length, id, share, bound) of all pieces in units of one size; a character without piece has minus one minus its code point for id."""
        m, n = chars.shape
        width = min(n, LONGEST)
        weight = np.full((n + 1, m, width), -np.inf, np.float32)
        ids = np.zeros((n + 1, m, width), np.int32)
        rolled = np.zeros((n, m), np.uint64)  # hash of the d code points from each place
        wide = chars.T.astype(np.uint64) + np.uint64(1)
        for d in range(1, width + 1):
            rolled = rolled[: n - d + 1] * BASE + wide[d - 1 :]
            at, found = voc.find(rolled, d)
            weight[d:, :, d - 1][at // m, at % m] = voc.weights[found]
            ids[d:, :, d - 1][at // m, at % m] = voc.ids[found]
        alone = weight[1:, :, 0] == -np.inf
        if alone.any():
            c = chars.T[alone].astype(np.int64)
            weight[1:, :, 0][alone] = voc.byte_weight * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
            ids[1:, :, 0][alone] = -1 - c
        alpha = np.zeros((n + 1, m), np.float32)
        share = np.zeros((m, n + 1, width), np.float32)
        for j in range(1, n + 1):
            k = min(j, LONGEST)
            x = weight[j, :, :k] + alpha[j - k : j][::-1].T
            top = x.max(1)
            e = np.exp(x - top[:, None])
            total = e.sum(1)
            alpha[j] = top + np.log(total)
            share[:, j, :k] = e / total[:, None]
        rank = np.argsort(-share, axis=2, kind="stable")
        share = np.take_along_axis(share, rank, 2)
        bound = np.cumsum(share, axis=2)
        flat = np.flatnonzero(share)
        node = flat // width
        bound = bound.ravel()[flat]
        bound[np.diff(node, append=-1) != 0] = 1.0  # the last edge of a node takes what is left
        rank = rank.ravel()[flat]
        return node, rank + 1, ids.transpose(1, 0, 2).ravel()[node * width + rank], share.ravel()[flat], bound


def _walk(lat: Lattices, node: np.ndarray, floor: np.ndarray, seed: np.ndarray, counter: np.ndarray, barred: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node back to its floor: (walker, edge), by walker and step. barred: edges that a walker's first step may not take."""
    walkers, edges = [], []
    alive, step = np.arange(len(node)), 0  # every word has a code point
    while len(alive):
        u = uniform(seed[alive], counter[alive] + np.uint64(step))
        edge = lat.begin[node[alive]]
        on = np.flatnonzero(u >= lat.bound[edge])
        while len(on):
            edge[on] += 1
            on = on[u[on] >= lat.bound[edge[on]]]
        if step == 0:
            for w, gone in barred.items():
                first = int(lat.begin[node[w]])
                free = [e for e in range(first, first + int(lat.options[node[w]])) if e not in gone]
                cum = np.cumsum(np.exp(lat.log[free], dtype=float))
                edge[w] = free[min(int(np.searchsorted(cum, u[w] * cum[-1], "right")), len(free) - 1)]
        walkers.append(alive)
        edges.append(edge)
        node[alive] -= lat.length[edge]
        alive = alive[node[alive] > floor[alive]]
        step += 1
    if not walkers:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # place by walker, then step
    count = np.bincount(np.concatenate(walkers), minlength=len(node))
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int64)
    for s, (w, e) in enumerate(zip(walkers, edges, strict=True)):
        out[start[w] + s] = e
    return np.repeat(np.arange(len(node)), count), out


def _siblings(lat: Lattices, edge: np.ndarray, bounds: np.ndarray, docs: np.ndarray, logp: np.ndarray, left: np.ndarray, seeds: np.ndarray, r: int, k: int, window: int = WINDOW) -> dict[int, list[tuple[float, int]]]:
    """The k largest perturbed values among the siblings of each document's new decisions: document to (value, decision), largest first.

    logp: of what comes before the first decision; left: mass that the first decision's node has left, nan where only the edge is gone."""
    out: dict[int, list[tuple[float, int]]] = {}
    start, n = bounds[docs], bounds[docs + 1] - bounds[docs]
    width = int(min(window, n.max(initial=0)))
    if not width:
        return {int(d): [] for d in docs}
    inside = np.arange(width)[None, :] < n[:, None]
    e = edge[np.where(inside, start[:, None] + np.arange(width), 0)]
    logs = np.where(inside, lat.log[e].astype(float), 0.0)
    total = np.cumsum(logs, axis=1) + logp[docs][:, None]
    with np.errstate(divide="ignore"):
        rest = np.where(lat.options[lat.node[e]] > 1, np.log(np.maximum(1 - np.exp(logs), 1e-12)), -np.inf)
        special = left[docs]
        rest[:, 0] = np.where(np.isnan(special), rest[:, 0], np.where(special > 0, np.log(np.maximum(special, 1e-12)), -np.inf))
    g = np.where(inside, total - logs + rest + gumbel(seeds[docs][:, None], counters(r, 2, np.arange(width))[None, :]), -np.inf)
    best = np.argsort(-g, axis=1, kind="stable")[:, :k]
    value = np.take_along_axis(g, best, 1)
    later = []
    for i, d in enumerate(docs.tolist()):
        if n[i] > width and (best.shape[1] < k or not total[i, -1] + TALLEST < value[i, k - 1]):
            later.append(d)  # decisions beyond the window still have a chance
        else:
            out[d] = [(v, p) for v, p in zip(value[i].tolist(), best[i].tolist(), strict=True) if v > -np.inf]
    if later:
        out |= _siblings(lat, edge, bounds, np.array(later), logp, left, seeds, r, k, 4 * window)
    return out


def sample_batch(texts: list[str], seeds: np.ndarray, lat: Lattices, k: int = K) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For each round: (documents that have a segmentation, ids one after the other in reading order, how many of each, log-probabilities);
    and the perturbed value that would come next for each document (-inf if none would)."""
    words = lat.words(texts)
    count = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(count) - count
    unit = np.concatenate(words) if words else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), count)
    inside = np.arange(len(unit)) - np.repeat(begins, count)
    size = lat.size[unit]
    place = np.cumsum(size) - size
    place -= np.repeat(place[begins[count > 0]], count[count > 0])  # in code points of the text
    floor = lat.base[unit]
    end = floor + size
    paths: list[list[dict]] = [[] for _ in texts]
    # perturbed value of the whole lattice, by document
    value = gumbel(seeds, counters(0, 0, np.zeros(len(texts))))
    # the path and decision from which the next path of a document departs; none where no segmentation is left
    departs: list[tuple[int, int] | None] = [(-1, 0)] * len(texts)
    rounds = []
    for r in range(k):
        node, barred = end.copy(), {}
        start, logp, left = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.full(len(texts), np.nan)
        on = np.array([c is not None for c in departs], bool)
        if not on.any():
            break
        for d, c in enumerate(departs):
            if c is not None and r:
                p = paths[d][c[0]]
                at = int(begins[d] + p["word"][c[1]])
                start[d], logp[d] = p["word"][c[1]], lat.log[p["edge"][: c[1]]].sum(dtype=float)
                node[at] = lat.node[p["edge"][c[1]]]
                barred[at] = [*p["gone"].get(c[1], []), int(p["edge"][c[1]])]
        some = np.flatnonzero(on[doc] & (inside >= start[doc]))
        local = dict(zip(np.searchsorted(some, list(barred)).tolist(), barred.values(), strict=True)) if barred else {}
        w, edge = _walk(lat, node[some], floor[some], seeds[doc[some]], counters(r, 1, place[some]), local)
        w = some[w]
        bounds = np.searchsorted(w, np.append(begins, len(unit)))
        logs = lat.log[edge].astype(float)
        for d, c in enumerate(departs):
            if r and c is not None:
                a = bounds[d]
                gone = [*barred[int(begins[d] + start[d])], int(edge[a])]
                left[d] = max(0.0, 1 - np.exp(lat.log[gone], dtype=float).sum()) if len(gone) < lat.options[lat.node[edge[a]]] else 0.0
        found = _siblings(lat, edge, bounds, np.flatnonzero(on), logp, left, seeds, r, k)
        chosen_w, chosen_e, sizes, sums = [], [], [], []
        for d, c in enumerate(departs):
            if c is None:
                continue
            a, b = bounds[d], bounds[d + 1]
            word, path, gone, before = w[a:b] - begins[d], edge[a:b], {}, 0
            if r:
                p, before = paths[d][c[0]], c[1]
                word, path = np.concatenate([p["word"][:before], word]), np.concatenate([p["edge"][:before], path])
                gone = {before: barred[int(begins[d] + start[d])]}
                p["value"] = [x for x in p["value"] if x[1] != before]  # that subtree is split up now
            values = [(-float(np.logaddexp(-value[d], -g)), x + before) for g, x in found[d]]
            paths[d].append({"word": word, "edge": path, "gone": gone, "value": values})
            chosen_w.append(word + begins[d])
            chosen_e.append(path)
            sizes.append(len(path))
            sums.append(float(logp[d] + logs[a:b].sum()))
            best, where = -np.inf, None
            for i, p in enumerate(paths[d]):
                if p["value"] and p["value"][0][0] > best:
                    best, where = p["value"][0][0], (i, p["value"][0][1])
            departs[d], value[d] = where, best
        ids, n = _reading_order(lat, np.concatenate(chosen_w), np.concatenate(chosen_e), np.array(sizes, np.int64))
        rounds.append((np.flatnonzero(on), ids, n, np.array(sums)))
    return rounds, value


def _reading_order(lat: Lattices, word: np.ndarray, edge: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of many paths in reading order, and how many each has: decisions run from a word's end to its start."""
    if not len(word):
        return np.zeros(0, np.int32), sizes
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    each = np.diff(np.append(starts, len(word)))
    ids = lat.ids[edge[np.repeat(2 * starts + each - 1, each) - np.arange(len(word))]]
    raw = ids < 0
    if raw.any():  # characters without piece become their bytes
        data = [chr(-1 - i).encode() for i in ids[raw].tolist()]
        times = np.ones(len(ids), np.int64)
        times[raw] = [len(x) for x in data]
        total = np.concatenate([[0], np.cumsum(times)])
        ends = np.cumsum(sizes)
        sizes = total[ends] - total[ends - sizes]
        ids = np.repeat(ids, times)
        ids[np.repeat(raw, times)] = np.frombuffer(b"".join(data), np.uint8).astype(np.int32) + lat.voc.byte_id
    return ids, sizes


def inclusion(logp: np.ndarray, kappa: np.ndarray) -> np.ndarray:
    """Probability of a segmentation to have a perturbed value above the next one's; certain where no other is left."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.where(np.isfinite(kappa), -np.expm1(-np.exp(np.minimum(700.0, logp - kappa))), 1.0)


def sample(texts: list[str], seeds: np.ndarray, voc: Vocabulary, k: int = K) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text, up to k of (ids, log-probability, inclusion score), largest perturbed value first."""
    out: list[list] = [[] for _ in texts]
    rounds, kappa = sample_batch(texts, seeds, Lattices(voc), k)
    for docs, ids, n, logp in rounds:
        ends = np.cumsum(n)
        for d, a, b, x, q in zip(docs.tolist(), (ends - n).tolist(), ends.tolist(), logp.tolist(), inclusion(logp, kappa[docs]).tolist(), strict=True):
            out[d].append((ids[a:b], x, q))
    return out


@lru_cache(1)
def lattices(path: str) -> Lattices:
    """The lattices a worker keeps."""
    return Lattices(vocabulary(path))


def decode_ids(ids, voc: Vocabulary) -> str:
    """Text of piece ids: the space that begins every text goes."""
    data = b"".join([voc.bytes[i] for i in ids])
    return data.decode(errors="replace")[1:] if data[:1] == b" " else data.decode(errors="replace")


def seed_of(key: str, seed: int = 0):
    """64 bits by the key; a null key has bits of its own."""
    return F.xxhash64(F.col(key).isNull(), F.col(key), F.lit(seed))


def _samples(df: DataFrame, path: str, key: str, text: str, k: int, seed: int, more, schema: str) -> DataFrame:
    """(key, sample, logp, inclusion, ...) of up to k segmentations of each text; more makes the other columns of a round's ids."""
    kind = dict(df.dtypes)[key]

    def run(batch: pa.RecordBatch) -> dict:
        seeds = mix(batch.column(1).to_numpy().view(np.uint64))
        rounds, kappa = sample_batch([t.decode() for t in as_bytes(batch.column(2))], seeds, lattices(path), k)
        order = np.argsort(np.concatenate([docs for docs, *_ in rounds]), kind="stable")  # the samples of a text one after the other
        take = lambda parts: np.concatenate(parts)[order]
        docs, logp = take([x[0] for x in rounds]), take([x[3] for x in rounds])
        made = [more(ids, n) for _, ids, n, _ in rounds]
        others = [pa.concat_arrays([m[i] for m in made]).take(pa.array(order)) for i in range(len(made[0]))]
        return {"key": batch.column(0).take(pa.array(docs)), "sample": take([np.full(len(x[0]), r) for r, x in enumerate(rounds)]), "logp": logp, "inclusion": inclusion(logp, kappa[docs]), **dict(enumerate(others))}

    return per_batch(df, [key, seed_of(key, seed), text], run, f"`{key}` {kind}, sample int, logp double, inclusion double, {schema}", TOGETHER)


def encode_samples(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", k: int = K, seed: int = 0) -> DataFrame:
    """(key, sample, logp, inclusion, ids): up to k distinct segmentations of each text."""
    return _samples(df, path, key, text, k, seed, lambda ids, n: [list_array(ids, n, pa.int32())], "ids array<int>")


def sample_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", k: int = K, seed: int = 0) -> DataFrame:
    """(key, sample, logp, inclusion, n_pieces, ids_crc32, text_crc32): crc32 of each segmentation's ids (little-endian unsigned 32 bits each) and of the text decoded from them."""

    def more(ids: np.ndarray, n: np.ndarray) -> list[pa.Array]:
        voc, ends = vocabulary(path), np.cumsum(n)
        whole = memoryview(ids.astype("<u4").tobytes())
        spoken, till = voc.text.join(ids, ends)
        cut = lambda a, b: spoken[a + (spoken[a : a + 1] == b" ") : b] if b > a else b""  # noqa: E731  the space that begins every text goes
        return [
            pa.array(n, pa.int32()),
            pa.array([zlib.crc32(whole[4 * (b - size) : 4 * b]) for b, size in zip(ends.tolist(), n.tolist(), strict=True)], pa.int64()),
            pa.array([zlib.crc32(cut(a, b)) for a, b in zip([0, *till[:-1].tolist()], till.tolist(), strict=True)], pa.int64()),
        ]

    return _samples(df, path, key, text, k, seed, more, "n_pieces int, ids_crc32 bigint, text_crc32 bigint")


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """(key, text) of each row's ids, and the kept columns."""
    keep = keep or []
    kinds = dict(df.dtypes)

    def run(batch: pa.RecordBatch) -> dict:
        voc = vocabulary(path)
        return {"key": batch.column(0), "text": [decode_ids(x or [], voc) for x in batch.column(1).to_pylist()], **{str(i): batch.column(2 + i) for i in range(len(keep))}}

    return per_batch(df, [key, ids, *keep], run, ", ".join([f"`{key}` {kinds[key]}, text string", *[f"`{c}` {kinds[c]}" for c in keep]]))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: digests of each sampled segmentation, and of the text decoded from it."""
    found = sample_digests(read_table(spark, sf_dir, "documents"), default_model())
    return found.select("doc_id", "sample", "n_pieces", "ids_crc32", "logp", "inclusion", "text_crc32")
