"""LM scoring by Brown class-based n-grams.

Token counts cover all training texts, and every word of them has a class of its own contexts. A context is a unit: one of the at most
``TOP`` most frequent words, the end of a text, or, for any other neighbour, one of ``ENDINGS`` units by its ending. How often a word
stands beside each unit is gathered over all training texts into one row a word, a table that grows with the corpus. Exchange
clustering then runs in two steps. First units are exchanged one by one, each to the class that raises the likelihood of the class
bigrams most, sweep by sweep (at most units squared numbers, whatever the input's size). Then, ``ROUNDS`` times over the whole table,
every other word is exchanged to the class that its own contexts make likeliest, and the class bigrams, and what classes the words of
each ending have, are counted anew. A text's probability is the product of interpolated class transitions and of word emissions within
the class, from exact word counts with 0.5 added. A word that no training text holds has the class that most words of its ending have.

The words that many texts hold are scored where the text is read, by a broadcast table of at most ``KNOWN`` counts and classes; all
others join the full table, and the transitions they take part in are added up when their classes are there. Texts are told apart by
row, so repeated rows and repeated ids each get their own score.

Null and empty texts are one token, the end. With no training token at all (an empty table, or all rows held out) counts are 0 and
the base's formula holds with N = V = 0; an empty table gives no rows. A null id is never held out. Ties between classes go to the
lower one. Columns of any name pass by; texts of any length are scored whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, cut_lineage, fold, list_array, per_batch, portions, read_table, release

TOP, ENDINGS, CLASSES, SWEEPS, ROUNDS = 512, 255, 48, 6, 2
#: Counts that are broadcast to the workers, at most.
KNOWN = 65_536
UNITS = TOP + ENDINGS + 1
END_UNIT = TOP + ENDINGS
#: The end's name among the tokens: no word is empty.
END = b""
#: Begins the name under which a text's own row goes through the join; no word holds a space.
OWN = b" "
#: Distinct words, and word-context pairs, that a worker keeps before it sends them on.
CACHE, PAIRS = 300_000, 2_500_000
#: What stands for a word without a broadcast class in a transition: this and more.
LATER = 1 << 16


def ending(word: bytes) -> int:
    """Unit of a word that isn't among the most frequent, by its last three bytes."""
    return TOP + zlib.crc32(word[-3:]) % ENDINGS


def tokens(data: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, and the end."""
    return [*data.lower().split(), END]


def count_tokens(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token, c) over all texts; each task sends a token once for each of its batches' totals."""

    def run(batches):
        total: Counter = Counter()

        def rows():
            names = list(total)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(list(total.values()), pa.int64())], names=["token", "c"])

        for batch in batches:
            for data in as_bytes(batch.column(0)):
                total.update(tokens(data))
            if len(total) > CACHE:
                yield rows()
                total.clear()
        if total:
            yield rows()

    return texts.select(text).mapInArrow(run, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


class Index(dict):
    """Numbers for tokens, in the order in which they are first asked for."""

    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self)
        return n


def contexts(texts: DataFrame, units: dict[bytes, int], text: str = "text") -> DataFrame:
    """(token, unit, context, n): for each token its own unit, the units beside it (after it: the unit; before it: UNITS + the unit) and how often, as 32-bit numbers.

    The end stands before each text. A task sends a token once for each of its totals; each token's rows are then added up to one."""

    def run(batches):
        index, unit_of, seen = Index(), [], []
        held = 0

        def rows():
            keys, counts = (np.concatenate(x) for x in zip(*seen, strict=True))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            starts = np.flatnonzero(np.diff(keys, prepend=-1))
            keys, counts = keys[starts], np.add.reduceat(counts[order], starts)
            token = keys // (2 * UNITS)
            names = list(index)
            first = np.flatnonzero(np.diff(token, prepend=-1))
            own = token[first]
            return pa.RecordBatch.from_arrays([pa.array([names[t] for t in own.tolist()], pa.binary()), pa.array(np.array(unit_of, np.int32)[own]), *_packed(first, keys % (2 * UNITS), counts)], names=names_of)

        for batch in batches:
            for some in portions(batch):
                words = [END]
                for data in as_bytes(some.column(0)):
                    words += data.lower().split()
                    words.append(END)
                ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                unit_of += [units[w] if w in units else ending(w) for w in list(index)[len(unit_of) :]] if len(index) > len(unit_of) else []
                unit = np.array(unit_of, np.int64)[ids]
                keys, counts = np.unique(np.concatenate([ids[:-1] * (2 * UNITS) + unit[1:], ids[1:] * (2 * UNITS) + UNITS + unit[:-1]]), return_counts=True)
                seen.append((keys, counts))
                held += len(keys)
                if len(index) > CACHE or held > PAIRS:
                    yield rows()
                    index, unit_of, seen, held = Index(), [], [], 0
        if seen:
            yield rows()

    def add(batches):
        held = None
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns, kinds, strict=True)], names=names_of)
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            token = batch.column(0)
            n = batch.num_rows
            opens = np.ones(n, bool)
            opens[1:] = pc.not_equal(token.slice(1), token.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(opens)
            cut = int(starts[-1])  # the last token may go on in the next batch
            held = batch.slice(cut)
            if cut:
                yield summed(batch.slice(0, cut), starts[:-1])
        if held is not None and held.num_rows:
            yield summed(held, np.zeros(1, np.int64))

    def summed(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        """Rows of one token added up; starts: the first row of each."""
        (keys, size), (n, _) = _flat(batch.column(2)), _flat(batch.column(3))
        token = np.repeat(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows))), size)
        keys = token * (2 * UNITS) + keys
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, n = keys[at], np.add.reduceat(n[order], at)
        at = pa.array(starts)
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *_packed(np.flatnonzero(np.diff(keys // (2 * UNITS), prepend=-1)), keys % (2 * UNITS), n)], names=names_of)

    names_of, kinds = ["token", "unit", "context", "n"], [pa.binary(), pa.int32(), pa.binary(), pa.binary()]
    schema = "token binary, unit int, context binary, n binary"
    return texts.select(text).mapInArrow(run, schema).repartition("token").sortWithinPartitions("token").mapInArrow(add, schema)


def _packed(first: np.ndarray, *numbers: np.ndarray) -> list[pa.Array]:
    """Each row's numbers as bytes, 32 bits each; first: where each row begins."""
    ends = (np.append(first, len(numbers[0])) * 4).astype(np.int64)
    return [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.astype("<u4").tobytes())]).cast(pa.binary()) for x in numbers]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of such bytes, and how many each row has."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return values.view("<u4").astype(np.int64), np.diff(ends) // 4


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of the tokens; the row, context and count of each pair. Columns: token, unit, context, n."""
    (keys, size), (n, _) = _flat(batch.column(2)), _flat(batch.column(3))
    return batch.column(1).to_numpy(), np.repeat(np.arange(batch.num_rows), size), keys, n


def _summed(table: DataFrame, width: int, fill) -> np.ndarray:
    """Numbers that fill(batch, total) adds into an array of that width, over the whole table."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            for some in portions(batch, rows=4096):
                fill(some, total)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            some = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["place", "v"])

    found = table.mapInArrow(run, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).toArrow()  # at most `width` rows
    out = np.zeros(width)
    out[found["place"].to_numpy()] = found["v"].to_numpy()
    return out


def unit_bigrams(table: DataFrame) -> np.ndarray:
    """Matrix of how often one unit follows another, from the contexts after each word."""

    def fill(batch: pa.RecordBatch, total: np.ndarray) -> None:
        unit, row, keys, n = _unpacked(batch)
        after = keys < UNITS
        total += np.bincount(unit[row[after]].astype(np.int64) * UNITS + keys[after], weights=n[after], minlength=UNITS * UNITS)

    return _summed(table, UNITS * UNITS, fill).reshape(UNITS, UNITS)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: units move one by one to the class with the highest sum of N log N over class bigrams, less those of classes.

    The end keeps a class of its own (the last). Units start dealt by frequency; ties go to the lower class."""
    n = len(bigrams)
    weight = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-weight[: n - 1], kind="stable")
    cls = np.full(n, classes - 1)
    cls[order] = np.arange(n - 1) % (classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), cls] = 1
    table = member.T @ bigrams @ member
    to_class, from_class = bigrams @ member, (member.T @ bigrams).T  # per unit: counts into and out of each class
    rows, cols = table.sum(1), table.sum(0)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            old = cls[u]
            out, inn, own = to_class[u].copy(), from_class[u].copy(), bigrams[u, u]
            out[old] -= own
            inn[old] -= own
            r, c = bigrams[u].sum(), bigrams[:, u].sum()
            if r + c == 0:
                continue
            # without u
            table[old] -= out
            table[:, old] -= inn
            table[old, old] -= own
            rows[old] -= r
            cols[old] -= c
            base_r = _xlogx(table)
            with_out, with_in = _xlogx(table + out[None, :]), _xlogx(table + inn[:, None])
            gain = (with_out - base_r).sum(1) + (with_in - base_r).sum(0)
            d = np.arange(classes)
            diag = table[d, d]
            gain -= (with_out[d, d] - base_r[d, d]) + (with_in[d, d] - base_r[d, d])
            gain += _xlogx(diag + out + inn + own) - _xlogx(diag)
            gain -= _xlogx(rows + r) - _xlogx(rows) + _xlogx(cols + c) - _xlogx(cols)
            new = int(np.argmax(gain[: classes - 1]))
            if gain[old] >= gain[new] - 1e-9:
                new = int(old)
            table[new] += out
            table[:, new] += inn
            table[new, new] += own
            rows[new] += r
            cols[new] += c
            if new != old:
                cls[u] = new
                moved += 1
                to_class[:, old] -= bigrams[:, u]
                to_class[:, new] += bigrams[:, u]
                from_class[:, old] -= bigrams[u]
                from_class[:, new] += bigrams[u]
        if not moved:
            break
    return cls


def transitions(table: np.ndarray) -> np.ndarray:
    """log10 of a class after a class, from class bigrams: their share and the class's own (one added), weighed by how often the first was seen (Witten-Bell)."""
    classes = len(table)
    one = (table.sum(0) + 1) / (table.sum() + classes)
    seen, kinds = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
    mixed = (table + np.maximum(kinds, 1) * one[None, :]) / (seen + np.maximum(kinds, 1))
    return np.log10(mixed)


def frequent(counts: DataFrame, most: int, also: str | None = None) -> dict:
    """The tokens of the highest counts, at most ``most`` (all whose count is at or above a step of a logarithmic scale, eight steps a
    doubling), to their count, or to count and one more column.

    Only the scale's histogram and the chosen rows leave the executors, so the driver's share doesn't grow with the number of tasks."""
    step = F.floor(F.log2("c") * 8)
    sizes = {r[0]: r[1] for r in counts.groupBy(step.alias("step")).count().collect()}  # at most 8 x 63 rows
    room, least = most, None
    for s in sorted(sizes, reverse=True):
        room -= sizes[s]
        if room < 0:
            break
        least = s
    if least is None:
        return {}
    rows = counts.where(step >= least).select("token", "c", *([also] if also else [])).toArrow().to_pydict()
    return dict(zip(rows["token"], zip(rows["c"], rows[also], strict=True) if also else rows["c"], strict=True))


class Classes:
    """Where words go: the classes of the units that stand for themselves, what share of an ending's words each class has, and class bigrams."""

    def __init__(self, cls: np.ndarray, table: np.ndarray, share: np.ndarray):
        self.cls, self.table, self.share = cls, table, share
        self.step = transitions(table) * np.log(10)
        self.size = np.log(table.sum(0) + 1)

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ending of each token (the last for those that are units of their own), its class, its count, and how often each class stands before it."""
        unit, row, keys, n = _unpacked(batch)
        place = 2 * row + (keys >= UNITS)
        beside = np.zeros((2 * len(unit), CLASSES))
        for i in range(0, len(place), 100_000):
            p = place[i : i + 100_000]
            starts = np.flatnonzero(np.diff(p, prepend=-1))
            beside[p[starts]] += np.add.reduceat(self.share[keys[i : i + 100_000] % UNITS] * n[i : i + 100_000, None], starts)
        after, before = beside[0::2], beside[1::2]
        count = np.bincount(row[keys >= UNITS], weights=n[keys >= UNITS], minlength=len(unit))
        gain = before @ self.step + after @ self.step.T - count[:, None] * self.size[None, :]
        gain[:, CLASSES - 1] = -np.inf  # the end's own
        own = (unit < TOP) | (unit == END_UNIT)
        return np.where(own, ENDINGS, unit - TOP), np.where(own, self.cls[unit], gain.argmax(1)), count, before


def count_classes(table: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class bigrams; tokens, and words, of each ending and class (the words that are units of their own come last)."""
    c2, width = CLASSES * CLASSES, (ENDINGS + 1) * CLASSES

    def fill(batch: pa.RecordBatch, total: np.ndarray) -> None:
        end, cls, count, before = classes.of(batch)
        np.add.at(total[:c2].reshape(CLASSES, CLASSES).T, cls, before)
        place = end * CLASSES + cls
        total[c2 : c2 + width] += np.bincount(place, weights=count, minlength=width)
        total[c2 + width :] += np.bincount(place, minlength=width)

    out = _summed(table, c2 + 2 * width, fill)
    return out[:c2].reshape(CLASSES, CLASSES), out[c2 : c2 + width].reshape(-1, CLASSES), out[c2 + width :].reshape(-1, CLASSES)


def assigned(table: DataFrame, classes: Classes) -> DataFrame:
    """(token, c, cls) of all training tokens."""

    def run(batch: pa.RecordBatch) -> dict:
        _, cls, count, _ = classes.of(batch)
        return {"token": batch.column(0), "c": count.astype(np.int64), "cls": cls.astype(np.int32)}

    return per_batch(table, ["token", "unit", "context", "n"], run, "token binary, c bigint, cls int")


class Model:
    """What the workers need: counts and classes of the most frequent tokens, classes by ending, class transitions and emission masses."""

    def __init__(self, texts: DataFrame, text: str = "text", top: int = TOP):
        """top: words that are units of their own, at most TOP."""
        counts = cut_lineage(count_tokens(texts, text))
        most = frequent(counts.where(F.octet_length("token") > 0), min(top, TOP))
        units = {w: i for i, w in enumerate(sorted(most, key=lambda w: (-most[w], w)))} | {END: END_UNIT}
        table = cut_lineage(contexts(texts, units, text))
        bigrams = unit_bigrams(table)
        cls = exchange(bigrams)
        share = np.eye(CLASSES)[cls]
        classes = Classes(cls, share.T @ bigrams @ share, share)
        for r in range(ROUNDS):
            pairs, mass, types = count_classes(table, classes)
            if r < ROUNDS - 1:  # the last count is that of the classes that stay
                known = mass[:ENDINGS].sum(1, keepdims=True)
                share = share.copy()
                share[TOP:END_UNIT] = np.where(known > 0, mass[:ENDINGS] / np.maximum(known, 1), share[TOP:END_UNIT])
                classes = Classes(cls, pairs, share)
        self.classes = cut_lineage(assigned(table, classes))
        release(counts, table)
        self.n, self.v = mass.sum(), types.sum()
        # an unseen word goes by the words of its ending, or of all endings
        self.unseen = np.where(types[:ENDINGS].sum(1) > 0, types[:ENDINGS].argmax(1), types[:ENDINGS].sum(0)[: CLASSES - 1].argmax()).astype(np.int32)
        self.step = transitions(pairs)
        self.emit = np.log10(mass.sum(0) + 0.5 * (types.sum(0) + 1))  # what is taken from log10(c + 0.5)
        self.base = float(np.log10(self.n + 0.5 * (self.v + 1)))
        rows = frequent(self.classes, KNOWN, "cls")
        end = self.classes.where(F.octet_length("token") == 0).first()
        rows[END] = (end["c"] if end else 0, CLASSES - 1)
        self.index = {w: i for i, w in enumerate(rows)}
        self.c, self.cls = (np.array([x[i] for x in rows.values()], np.int64) for i in (0, 1))
        self.log = np.log10(self.c + 0.5)


def score_texts(docs: DataFrame, model: Model, key: str = "key", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base, score) of every row: base is the sum of log10(c + 0.5).

    What the broadcast words give is added up where the text is read. A text's other words go out to the table of classes, each once,
    beside a row that holds the text's sums and the transitions those words take part in."""
    kind = dict(docs.dtypes)[key]
    classes, model.classes = model.classes, None
    handed = docs.sparkSession.sparkContext.broadcast(model)
    model.classes = classes
    ready = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        m = handed.value
        get = m.index.get
        n_tokens, base, score, known, pairs, rare, rare_n, sizes = [], [], [], [], [], [], [], []
        for uid, data in zip(batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
            words = tokens(data)
            at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
            here = at >= 0
            code = np.where(here, m.cls[at], 0)
            far = np.flatnonzero(~here)
            local = Index()
            if len(far):
                code[far] = LATER + np.fromiter(map(local.__getitem__, map(words.__getitem__, far.tolist())), np.int64, len(far))
            code = np.concatenate([[CLASSES - 1], code])
            a, b = code[:-1], code[1:]
            sure = (a < LATER) & (b < LATER)
            n_tokens.append(len(words))
            known.append(int((m.c[at[here]] > 0).sum()))
            base.append(float(m.log[at[here]].sum()))
            score.append(base[-1] + float(m.step[a[sure], b[sure]].sum() - m.emit[code[1:][here]].sum()))
            pairs.append(np.stack([a[~sure], b[~sure]]).astype("<i4").tobytes())
            rare += [OWN + uid.to_bytes(8, "big"), *local]
            rare_n += [0, *np.bincount(code[code >= LATER] - LATER, minlength=len(local)).tolist()] if len(far) else [0]
            sizes.append(len(local) + 1)
        return {"key": batch.column(0), "uid": batch.column(1), "n_tokens": n_tokens, "known": known, "base": base, "score": score, "pairs": pairs, "rare": list_array(rare, sizes, pa.binary()), "rare_n": list_array(np.array(rare_n, np.int32), sizes, pa.int32())}

    local = per_batch(ready, ["key", "uid", "text"], run, f"key {kind}, uid bigint, n_tokens bigint, known bigint, base double, score double, pairs binary, rare array<binary>, rare_n array<int>")
    own = F.struct("key", "n_tokens", "known", "base", "score", "pairs")
    spread = local.select("uid", own.alias("own"), F.posexplode(F.arrays_zip("rare", "rare_n")).alias("place", "x")).select("uid", "place", F.when(F.col("place") == 0, F.col("own")).alias("own"), F.col("x.rare").alias("token"), F.col("x.rare_n").alias("n"))
    met = spread.join(classes, "token", "left")
    fallback = F.when(F.col("place") > 0, F.col("token"))
    rows = met.select("uid", "place", "own", "n", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("cls", F.lit(-1)).alias("cls"), F.when(F.col("c").isNull(), fallback).alias("unseen"))

    def finish(batches):
        m = handed.value
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> pa.RecordBatch:
            """Whole texts: a row of sums, then the rows of their other words."""
            place = table["place"].to_numpy()
            first = np.flatnonzero(place == 0)
            sums = table["own"].combine_chunks().take(pa.array(first))
            field = {f.name: sums.field(i) for i, f in enumerate(sums.type)}
            cls, c, n = (table[x].to_numpy().copy() for x in ("cls", "c", "n"))
            for i in np.flatnonzero((cls < 0) & (place > 0)).tolist():
                cls[i] = m.unseen[ending(table["unseen"][i].as_py()) - TOP]
            far = place > 0
            text = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(place))))
            logs = np.where(far, n * np.log10(c + 0.5), 0.0)
            # transitions of all texts at once: a later word's class stands behind its text's first row
            raw = field["pairs"].to_pylist()
            size = np.array([len(x) // 8 for x in raw], np.int64)
            begin = np.concatenate([[0], np.cumsum(2 * size)])
            codes = np.frombuffer(b"".join(raw), "<i4").astype(np.int64)
            owner = np.repeat(np.arange(len(first)), 2 * size)
            later = codes >= LATER
            codes[later] = cls[first[owner[later]] + 1 + codes[later] - LATER]
            inside = np.arange(len(codes)) - np.repeat(begin[:-1], 2 * size)
            left = inside < np.repeat(size, 2 * size)
            step = np.bincount(owner[left], weights=m.step[codes[left], codes[~left]], minlength=len(first))
            emit = np.bincount(text[far], weights=n[far] * m.emit[cls[far]], minlength=len(first))
            more = np.bincount(text, weights=logs, minlength=len(first))
            known = np.bincount(text[far], weights=n[far] * (c[far] > 0), minlength=len(first)).astype(np.int64)
            return pa.RecordBatch.from_arrays([field["key"], field["n_tokens"], pa.array(field["known"].to_numpy() + known), pa.array(field["base"].to_numpy() + more), pa.array(field["score"].to_numpy() + more + step - emit)], names=names)

        names = ["key", "n_tokens", "n_known", "base", "score"]
        for batch in batches:
            starts = np.flatnonzero(batch.column(1).to_numpy() == 0)
            if len(starts) and (held or starts[-1] > 0):
                cut = int(starts[-1])
                whole = [*held, batch.slice(0, cut)]
                held = [batch.slice(cut)]
                if sum(b.num_rows for b in whole):
                    yield done(pa.Table.from_batches(whole))
            else:
                held.append(batch)
        if held:
            yield done(pa.Table.from_batches(held))

    # a text's row of sums comes before its words
    return rows.repartition("uid").sortWithinPartitions("uid", "place").mapInArrow(finish, f"key {kind}, n_tokens bigint, n_known bigint, base double, score double")


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: int = 1) -> DataFrame:
    """All rows of docs, scored by a model of those outside the held-out fold."""
    named = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    training = named.where(F.coalesce(fold("key") != held_out, F.lit(True)))
    model = Model(training)
    total = score_texts(named, model)
    return total.select(
        F.col("key").alias(key), F.coalesce(fold("key") == held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(int(model.n)).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(model.base)).alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a model of those outside fold 1."""
    return score_documents(read_table(spark, sf_dir, "documents"))
