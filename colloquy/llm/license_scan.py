"""License scans by diagonal voting.

Words of every text are hashed; all rolling k-grams of word hashes join the positions of the same k-grams in a fixed set of licence
notices. A match votes for the diagonal (word place in the text minus word place in the notice); votes of one diagonal are
aggregated before they are dealt out, and neighbouring diagonals merge (a word added or lost moves the diagonal by one). A merged span
with half of the votes its notice can give is verified word by word: nearly all words agree, or a long stretch; words that tell
licences apart (FAMILIES, and numbers of short notices) agree each at its place; and no word that tells apart its own family's licences stands in or
beside the span that the notice hasn't. Of spans that overlap, the one with most votes stays (ties: the larger share, then the earlier notice).

Base labels come from exact phrases and always stay; a verified notice adds its own label. Null and empty texts have no words, no
places (null first and last word), empty labels and score 0. Texts shorter than k words can hold base phrases only. Repeated rows
each get their own result, columns of any name pass by, an empty table gives no rows. Very long texts are matched in stretches of
STRETCH words, so no row carries more than one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, list_array, per_batch, read_table

K, SLACK, COVERED, ENOUGH, VOTED = 4, 3, 0.87, 32, 0.5
#: Words of a text that stand in one row, and words beside a span that may contradict it.
STRETCH, FLANK = 512, 3
#: Notices of so many words are short: their numbers must agree.
SHORT = 32
#: The notices' k-grams are broadcast; more than this is refused.
MAX_GRAMS = 100_000

# Phrases of the base labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Public licence notices, (label, text).
NOTICES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ),
    ("bsd", "Licensed under the BSD License"),
    ("bsd", "Released under the BSD License"),
    ("bsd", "Licensed under the BSD 2-Clause License"),
    ("bsd", "Licensed under the BSD 3-Clause License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]

# Further notices of the GNU and other families.
NOTICES += [
    ("apache", "Licensed under the Apache License, Version 1.1"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation"),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0"),
    ("mpl", "subject to the Mozilla Public License Version 1.1"),
    ("epl", "made available under the terms of the Eclipse Public License v2.0"),
    ("epl", "made available under the terms of the Eclipse Public License v1.0"),
    ("cc0", "CC0 1.0 Universal"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
]
for _n in ("2", "3"):
    NOTICES += [
        (f"gpl-{_n}", f"under the GNU GPL v{_n}"), (f"gpl-{_n}", f"under the GNU GPL version {_n}"), (f"gpl-{_n}", f"licensed under GNU GPL v{_n}"), (f"gpl-{_n}", f"licensed under GPLv{_n}"),
        (f"gpl-{_n}-or-later", f"under the terms of the GNU General Public License as published by the Free Software Foundation, either version {_n} of the License, or (at your option) any later version"),
    ]

# Creative Commons kinds (label, initials, name), versions with the name of their unported form, and SPDX identifiers with their labels.
CC_KINDS = [
    ("cc-by", "BY", "Attribution"), ("cc-by-nc", "BY-NC", "Attribution-NonCommercial"), ("cc-by-nc-sa", "BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("cc-by-nc-nd", "BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"), ("cc-by-sa", "BY-SA", "Attribution-ShareAlike"), ("cc-by-nd", "BY-ND", "Attribution-NoDerivatives"),
]
CC_VERSIONS = [("4.0", "International"), ("3.0", "Unported"), ("3.0", "United States"), ("2.5", "Generic"), ("2.0", "Generic"), ("1.0", "Generic")]
SPDX = {
    "MIT": "mit", "Apache-2.0": "apache", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "ISC": "isc", "Zlib": "zlib", "Unlicense": "unlicense", "CC0-1.0": "cc0", "MPL-2.0": "mpl", "EPL-2.0": "epl", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa",
    "GPL-2.0-only": "gpl-2", "GPL-3.0-only": "gpl-3", "GPL-2.0-or-later": "gpl-2-or-later", "GPL-3.0-or-later": "gpl-3-or-later", "LGPL-2.1-or-later": "lgpl", "LGPL-3.0-or-later": "lgpl", "AGPL-3.0-only": "agpl", "AGPL-3.0-or-later": "agpl",
}
for _label, _short, _name in CC_KINDS:
    for _version, _form in CC_VERSIONS:
        NOTICES += [(_label, f"Licensed under CC {_short} {_version}")] if _form != "United States" else []
        NOTICES += [(_label, f"This work is licensed under a Creative Commons {_name} {_version} {_form} License"), (_label, f"{_name} {_version} {_form}")]
NOTICES += [(_label, f"SPDX-License-Identifier: {_name}") for _name, _label in SPDX.items()]

# Words that tell a family's licences apart, by the beginning of its labels.
FAMILIES = {("gpl", "lgpl", "agpl"): "affero lesser".split(), ("cc-",): "nc nd noderivatives noderivs noncommercial sa sharealike".split()}

#: Words are runs of letters a-z, digits and anything beyond ASCII, A-Z lower-cased.
BREAK = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128 else (b + 32 if 65 <= b <= 90 else 32) for b in range(256))
BASE = [(re.compile(rb"(?= " + p.encode() + rb" )"), label, p.split()[0].encode(), p.split()[1].encode()) for p, label in PHRASES.items()]


def words_of(data: bytes) -> list[bytes]:
    return data.translate(BREAK).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes alone."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    place = np.arange(len(joined), dtype=np.uint64) - np.repeat(start, size).astype(np.uint64)
    mixed = (joined + np.uint64(0x9E3779B97F4A7C15)) * (np.uint64(2) * place + np.uint64(0xBF58476D1CE4E5B9))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    total = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), start)
    return total ^ (total >> np.uint64(31))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    if len(hashes) < k:
        return np.zeros(0, np.int64)
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x100000001B3) + hashes[i : len(hashes) - k + 1 + i]
    return (out ^ (out >> np.uint64(33))).view(np.int64)


def base_places(words: list[bytes], data: bytes) -> list[tuple[int, str]]:
    """(word place, label) of each phrase's places."""
    joined, out = None, []
    for pattern, label, first, second in BASE:
        if first in data and second in data:
            joined = joined or b" " + b" ".join(words) + b" "
            out += [(joined.count(b" ", 0, m.start() + 1) - 1, label) for m in pattern.finditer(joined)]
    return out


def notice_facts(label: str, text: str) -> tuple[list[bytes], list[int], list[bytes]]:
    """A notice's words, the places of those that must agree, and the words that must not stand in or beside its span."""
    words = words_of(text.encode())
    apart = [w.encode() for starts, some in FAMILIES.items() if label.startswith(starts) for w in some]
    telling = [i for i, w in enumerate(words) if w in apart or w == b"library" or len(words) <= SHORT and w.isdigit()]
    return words, telling, [w for w in apart if w not in words]


def notice_grams(spark: SparkSession, notices: list[tuple[str, str]], k: int) -> DataFrame:
    """(gram, notice, label, at, size, words, telling, rivals): the notices' k-grams, and one row under gram 0 by which texts without a match pass the join."""
    rows: list[tuple] = [(0, -1, "", 0, 0, [], [], [])]
    signed = lambda some: word_hashes(some).view(np.int64).tolist()
    for n, (label, text) in enumerate(notices):
        words, telling, rivals = notice_facts(label, text)
        rows += [(int(g), n, label, at, len(words), signed(words), telling, signed(rivals)) for at, g in enumerate(rolling(word_hashes(words), k))]
    if len(rows) > MAX_GRAMS:
        raise ValueError(f"{len(rows)} k-grams of notices; at most {MAX_GRAMS} are broadcast")
    return spark.createDataFrame(rows, "gram bigint, notice int, label string, at int, size int, words array<bigint>, telling array<int>, rivals array<bigint>")


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text", notices: list[tuple[str, str]] = NOTICES, k: int = K) -> DataFrame:
    """Per row of df: base places and labels, labels with those of verified notices, the verified spans, and the best coverage as score."""
    kind = dict(df.dtypes)[key]
    reach = max((len(words_of(t.encode())) for _, t in notices), default=0) + FLANK

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t.translate(BREAK) for t in as_bytes(batch.column(2))]
        words = [t.split() for t in texts]
        places = [base_places(w, t) for w, t in zip(words, texts, strict=True)]
        size = [len(w) for w in words]
        every = word_hashes([x for w in words for x in w])
        start = np.cumsum(size) - size
        row, first, base, hashes, grams = [], [], [], [], []
        for i, (a, n) in enumerate(zip(start.tolist(), size, strict=True)):
            found = rolling(every[a : a + n], k)
            for at in range(0, max(1, n), STRETCH):
                row.append(i)
                first.append(at == 0)
                low = max(0, at - reach)
                base.append(at - low)
                hashes.append(every[a + low : a + min(n, at + STRETCH + reach)])
                grams.append(np.append(found[at : at + STRETCH], np.zeros(int(at == 0), np.int64)))
        at = pa.array(row, pa.int64())
        own = lambda values: pa.array([values[i] if f else None for i, f in zip(row, first, strict=True)])
        lists = lambda parts: list_array(np.concatenate(parts).view(np.int64), [len(x) for x in parts], pa.int64())
        return {
            "key": batch.column(0).take(at), "uid": batch.column(1).take(at), "n_words": own(size), "n_base": own([len(p) for p in places]),
            "first_word": own([min(p)[0] if p else None for p in places]), "last_word": own([max(p)[0] if p else None for p in places]),
            "base": pa.array([sorted({label for _, label in places[i]}) if f else None for i, f in zip(row, first, strict=True)], pa.list_(pa.string())),
            "stretch": [STRETCH * c for c in _counted(row)], "before": base, "hashes": lists(hashes), "grams": lists(grams),
        }

    ready = df.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text"))
    own = ["n_words", "n_base", "first_word", "last_word", "base"]
    schema = f"key {kind}, uid bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, stretch bigint, before int, hashes array<bigint>, grams array<bigint>"
    every = per_batch(ready, ["key", "uid", "text"], run, schema).select("uid", F.when(F.col("n_words").isNotNull(), F.struct("key", *own)).alias("own"), "stretch", "before", "hashes", F.posexplode("grams").alias("place", "gram"))
    hits = every.join(F.broadcast(notice_grams(df.sparkSession, notices, k)), "gram")
    hit = F.col("notice") >= 0
    # the first word of the notice in the text, and in the row's hashes
    diagonal = F.when(hit, F.col("stretch") + F.col("place") - F.col("at")).otherwise(0)
    begin = F.col("before") + F.col("place") - F.col("at") - FLANK
    # words along the diagonal and beside it; -1 stands before the text's start
    along = F.when(hit, F.concat(F.slice(F.array_repeat(F.lit(-1).cast("bigint"), reach + FLANK), 1, F.greatest(-begin, F.lit(0))), F.slice("hashes", F.greatest(begin, F.lit(0)) + 1, F.col("size") + 2 * FLANK + F.least(begin, F.lit(0)))))
    of_notice = ["notice", "label", "size", "words", "telling", "rivals"]
    votes = hits.select("uid", F.when(~hit, F.col("own")).alias("own"), *of_notice, diagonal.alias("diagonal"), along.alias("along")).groupBy("uid", *of_notice, "diagonal").agg(
        F.count("*").alias("votes"), F.first("along").alias("along"), F.first("own", ignorenulls=True).alias("own")
    )
    agree = F.zip_with(F.slice("along", FLANK + 1, F.greatest(F.col("size"), F.lit(0))), "words", lambda a, b: F.coalesce(a == b, F.lit(False)))
    places = F.filter(F.transform(agree, lambda ok, i: F.when(ok, i).otherwise(F.lit(-1))), lambda i: i >= 0)
    checked = votes.withColumn("verified", F.when(hit, places)).withColumn("contradicted", hit & F.arrays_overlap("along", "rivals"))
    order = Window.partitionBy("uid", "notice").orderBy("diagonal")
    merged = checked.withColumn("opens", (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK).cast("int")).withColumn("chain", F.sum(F.coalesce("opens", F.lit(0))).over(order))
    spans = merged.groupBy("uid", *of_notice, "chain").agg(
        F.sum("votes").alias("votes"), F.array_distinct(F.flatten(F.collect_list("verified"))).alias("verified"), F.bool_or("contradicted").alias("contradicted"), F.first("own", ignorenulls=True).alias("own"),
        F.min(F.col("diagonal") + F.coalesce(F.array_min("verified"), F.lit(0))).alias("start"), F.max(F.col("diagonal") + F.coalesce(F.array_max("verified"), F.lit(0))).alias("end"),
    )
    n = F.size("verified")
    nearly = (n / F.col("size") >= COVERED) & (F.col("votes") >= VOTED * (F.col("size") - k + 1))
    stretch = (n >= ENOUGH) & (F.col("votes") >= VOTED * (ENOUGH - k + 1))
    found = hit & (nearly | stretch) & ~F.col("contradicted") & (F.size(F.array_except("telling", "verified")) == 0)
    judged = spans.withColumn("found", F.coalesce(found, F.lit(False))).withColumn("share", F.when(F.col("found"), n / F.col("size")).otherwise(0.0))
    # spans that overlap stand in one pile; the best stays, and whatever doesn't touch it
    by_start = Window.partitionBy("uid", "found").orderBy("start", "end", "notice")
    apart = F.col("start") > F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    piled = judged.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("pile", F.sum("apart").over(by_start))
    best = F.max(F.struct("votes", "share", (-F.col("notice")).alias("before"), "start", "end")).over(Window.partitionBy("uid", "found", "pile"))
    kept = piled.withColumn("best", best).withColumn("found", F.col("found") & ((F.col("start") == F.col("best.start")) & (F.col("end") == F.col("best.end")) & (F.col("best.before") == -F.col("notice")) | (F.col("start") > F.col("best.end")) | (F.col("end") < F.col("best.start"))))
    done = kept.groupBy("uid").agg(
        F.first("own", ignorenulls=True).alias("own"), F.collect_set(F.when(F.col("found"), F.col("label"))).alias("more"), F.max(F.when(F.col("found"), F.col("share")).otherwise(0.0)).alias("share"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("found"), F.concat_ws(":", F.lpad(F.col("start").cast("string"), 12, "0"), F.col("end") + 1, "label")))), ",").alias("notice_spans"),
    ).select("own.*", "more", "share", "notice_spans")
    return done.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.greatest("share", F.lit(0.5))).otherwise(F.col("share")).alias("score"), "notice_spans",
    )


def _counted(row: list[int]) -> list[int]:
    """How many equal numbers stand before each, in runs."""
    out: list[int] = []
    for i, r in enumerate(row):
        out.append(out[-1] + 1 if i and row[i - 1] == r else 0)
    return out


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all notices."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))
