import re

import numpy as np

from colloquy.llm import license_scan as ls


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = sorted((i, label) for phrase, label in ls.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({label for _, label in at}))


def scan(docs_of, rows):
    return ls.scan_licenses(docs_of(rows)).collect()


FILL = "éa bcd " * 30


def test_base_equals_brute_force(spark, docs_of, odd):
    rows = odd + [(10, FILL + "Licensed under the Apache License, Version 2.0." + FILL), (11, "MIT-License CC BY cc by CC/BY gnu General public LICENSE"), (12, "apache licenseé mit\x00license apache  license")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in scan(docs_of, rows)), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_notices_are_found_by_their_diagonals(spark, docs_of):
    mit = next(t for label, t in ls.NOTICES if label == "mit" and len(t) > 200)
    words = mit.split()
    edited = words[:10] + ["really"] + words[10:30] + words[32:]
    rows = [(1, FILL + mit + " " + FILL), (2, " ".join(edited)), (3, " ".join(words[:9])), (4, FILL), (5, "Licensed under CC BY-NC 4.0."), (6, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r["doc_id"]: r for r in scan(docs_of, rows)}
    assert [got[i]["labels"] for i in range(1, 7)] == ["mit", "mit", "", "", "cc-by,cc-by-nc", "gpl,gpl-3"]
    assert got[1]["n_base"] == 0 and got[1]["notice_spans"] == f"000000000060:{60 + len(ls.words_of(mit.encode()))}:mit"
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[4]["score"] == 0 and got[1]["score"] == 1


def brute_spans(text):
    """Verified notices of a text by comparing it with every notice along every diagonal: (start, end, label)."""
    words, found = ls.words_of((text or "").encode()), []
    for number, (label, notice) in enumerate(ls.NOTICES):
        own, telling, rivals = ls.notice_facts(label, notice)
        size, chains = len(own), []
        for d in range(-size, len(words)):
            votes = sum(0 <= d + i and words[d + i : d + i + ls.K] == own[i : i + ls.K] for i in range(size - ls.K + 1))
            if votes:
                agree = {i for i in range(size) if 0 <= d + i < len(words) and words[d + i] == own[i]}
                beside = words[max(0, d - ls.FLANK) : d + size + ls.FLANK]
                if not chains or d - chains[-1][-1][0] > ls.SLACK:
                    chains.append([])
                chains[-1].append((d, votes, agree, any(w in rivals for w in beside)))
        for chain in chains:
            votes, verified = sum(c[1] for c in chain), set().union(*(c[2] for c in chain))
            good = len(verified) / size >= ls.COVERED and votes >= ls.VOTED * (size - ls.K + 1) or len(verified) >= ls.ENOUGH and votes >= ls.VOTED * (ls.ENOUGH - ls.K + 1)
            if good and not any(c[3] for c in chain) and set(telling) <= verified:
                found.append((min(d + min(a) for d, _, a, _ in chain), max(d + max(a) for d, _, a, _ in chain), label, (votes, len(verified) / size, -number)))
    piles, kept = [], []
    for span in sorted(found):
        if piles and span[0] <= max(s[1] for s in piles[-1]):
            piles[-1].append(span)
        else:
            piles.append([span])
    for pile in piles:
        best = max(pile, key=lambda s: s[3])
        kept += [s for s in pile if s is best or s[0] > best[1] or s[1] < best[0]]
    return sorted((s, e + 1, label) for s, e, label, _ in kept)


#: Texts and the labels that the method adds to those of base phrases.
TOLD_APART = [
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "cc-by-nc-nd"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
    ("Licensed under CC BY-NC-ND 4.0.", "cc-by,cc-by-nc-nd"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lgpl"),
    ("This work is licensed under the GNU General Public License, version 2.", "gpl,gpl-2"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3"),
    ("It mentions the GNU General Public License, version 2, in passing.", "gpl"),
    ("Copyright 2020 The XYZ Library authors. " + ls.NOTICES[2][1], "mit"),
    ("Copyright Foo SA. " + ls.NOTICES[2][1], "mit"),
    ("The widget library. " + next(t for label, t in ls.NOTICES if label == "bsd"), "bsd"),
    ("Creative Commons Attribution-NonCommercial 3.0 Unported", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 2.5 Generic License.", "cc-by-sa"),
    ("Dedicated to all under CC0 1.0 Universal.", "cc0"),
    ("Licensed under the GNU GPL v3.", "gpl-3"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2-or-later"),
    ("# SPDX-License-Identifier: MIT", "mit"),
    ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation", "lgpl"),
    ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ""),
]


def test_licences_are_told_apart(spark, docs_of):
    rows = [(i, FILL + t + " " + FILL) for i, (t, _) in enumerate(TOLD_APART)] + [(100 + i, t) for i, (t, _) in enumerate(TOLD_APART)]
    got = {r["doc_id"]: r["labels"] for r in scan(docs_of, rows)}
    assert [got[i] for i in range(len(TOLD_APART))] == [w for _, w in TOLD_APART]
    assert [got[100 + i] for i in range(len(TOLD_APART))] == [w for _, w in TOLD_APART]


def test_spans_equal_brute_force(spark, docs_of):
    r, rows = np.random.default_rng(3), []
    for i in range(45):
        text = []
        for n in r.integers(0, len(ls.NOTICES), r.integers(0, 4)):
            words = ls.NOTICES[n][1].split()
            for _ in range(r.integers(0, 4)):
                at = int(r.integers(0, len(words)))
                words[at : at + int(r.integers(0, 2))] = ["other"] * int(r.integers(0, 2))
            text += words + ["filler"] * int(r.integers(0, 3))
        rows.append((i, " ".join(text)))
    rows.append((99, " ".join(["x"] * (ls.STRETCH - 5)) + " " + ls.NOTICES[2][1] + " y" * ls.STRETCH + " " + ls.NOTICES[0][1]))
    got = {r["doc_id"]: [(int(a), int(b), c) for a, b, c in (x.split(":") for x in r["notice_spans"].split(",") if x)] for r in scan(docs_of, rows)}
    for i, text in rows:
        assert got[i] == brute_spans(text), text


def test_hashes_depend_on_the_word_alone():
    a = ls.word_hashes([b"mit", b"license", b"x", b"mit"])
    assert a[0] == a[3] and len(set(a.tolist())) == 3 and a[1] == ls.word_hashes([b"license"])[0]
    assert len(ls.rolling(a, 4)) == 1 and len(ls.rolling(a, 5)) == 0 and ls.rolling(a, 2).dtype == np.int64


def test_repeated_notice_in_one_text(spark, docs_of):
    text = ("Released under the MIT License. " + FILL) * 50
    row = scan(docs_of, [(1, text)])[0]
    assert row["n_base"] == 50 and row["labels"] == "mit" and row["notice_spans"].count("mit") == 50


def test_empty_table(spark, docs_of):
    assert ls.scan_licenses(docs_of([(1, "x")]).limit(0)).count() == 0
