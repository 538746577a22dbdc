"""Operators 2, 6 and 10 against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shoebox.llm import licenses, mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


TEXTS = [None, "", "a", "a b c", "a a a a", "a b c a b c", "x y z a x y z", "# | <a> b\n# | <a> b", "\n\n", "a b c d a b c", " a  b\tc\x0bd ", "漢 字 漢 字 漢 字 é"]


@pytest.mark.parametrize("packed", [4096, 2])
def test_measures(spark, docs, rows, monkeypatch, packed):
    monkeypatch.setattr(quality_rules, "PACKED_WORDS", packed)
    texts = TEXTS + [r[1] for r in rows]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in quality_rules.ledger(df).collect()}
    for k, text in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == measures(text), repr(text)
    assert quality_rules.ledger(docs).count() == len(rows)


def test_policies_and_ablations(docs, no_docs):
    ledger = quality_rules.ledger(docs)
    policy = quality_rules.POLICIES[1]
    assert quality_rules.keep_good(docs).columns == docs.columns
    kept = [r["doc_id"] for r in quality_rules.apply_policy(ledger, policy).where("kept").collect()]
    assert sorted(map(str, kept)) == sorted(str(r["doc_id"]) for r in quality_rules.keep_good(docs).collect())
    by = {r["rule"]: r for r in quality_rules.ablations(ledger, policy).collect()}
    rows = ledger.collect()
    for rule in quality_rules.RULES:
        bit, rest = 1 << rule.bit, quality_rules.mask(policy) & ~(1 << rule.bit)
        assert by[rule.name]["failed"] == sum(bool(r["fail_bits"] & bit) for r in rows)
        assert by[rule.name]["failed_only_here"] == sum(r["fail_bits"] == bit for r in rows)
        assert by[rule.name]["kept_without"] == sum(not r["fail_bits"] & rest for r in rows)
    assert quality_rules.keep_good(no_docs).count() == 0


def test_water_fill():
    assert mixing.water_fill([], []) == []
    assert mixing.water_fill([0, 0], [5, 2]) == [0, 0]
    out = mixing.water_fill([100, 1000, 10, 0], [5, 2, 1, 5])
    assert sum(out) == pytest.approx(1110) and all(o <= 3 * s + 1e-9 for o, s in zip(out, [100, 1000, 10, 0]))
    assert out[0] == 300 and out[2] == 30


def test_mix(spark, docs, no_docs):
    data = [(i, " ".join(["w"] * (1 + i * 37 % 400)), f"s{i % 7}" if i % 11 else None) for i in range(3000)] + [(5000 + i, "w " * 30, "s0") for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = mixing.mixed(df, mixing.plan(df)).select("doc_id", "source", *(F.col(f"__mix_{c}").alias(c) for c in ("size", "source_size", "target", "copies"))).collect()
    taken, goal = Counter(), {}
    for r in out:
        taken[r["source"]] += r["copies"] * r["size"]
        goal[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    for s, g in goal.items():
        assert taken[s] == pytest.approx(g, rel=5e-3)
    again = mixing.mixed(df.repartition(7), mixing.plan(df.repartition(5))).select("doc_id", "__mix_copies").collect()
    assert dict(map(tuple, again)) == {r["doc_id"]: r["copies"] for r in out}
    assert mixing.mix(df).count() == sum(r["copies"] for r in out)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(no_docs).count() == 0


def test_balance_of_two_margins(spark):
    cells = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 30.0), ("b", "x", 20.0), ("b", "y", 5.0), (None, "x", 7.0)], "m string, n string, tokens double")
    goals = {"m": {"a": 30.0, "b": 30.0, None: 12.0}, "n": {"x": 40.0, "y": 32.0}}
    lam = mixing.balance(cells, goals)
    import math

    tilted = [(m, n, t * math.exp(lam["m"][m] + lam["n"][n])) for m, n, t in cells.collect()]
    for k, margin in enumerate(("m", "n")):
        for level, goal in goals[margin].items():
            assert sum(r[2] for r in tilted if r[k] == level) == pytest.approx(goal, rel=1e-6)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_licenses(spark, docs, no_docs, rows):
    texts = {
        1: (MIT, "MIT", 0), 2: ("x\nLicensed under the Apache License, Version 2.0.\ny", "Apache-2.0", 0), 3: ("Released under the MIT License. Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,MIT", 0),
        4: ("My own license applies here.", "", 1), 5: (None, "", 0), 6: ("no word of it", "", 0), 7: (MIT + "\nReleased under the MIT License.", "MIT", 0),
        8: ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "GPL-3.0-or-later", 0),
    }
    df = spark.createDataFrame([(k, t[0]) for k, t in texts.items()], "doc_id int, text string")
    got = {r["doc_id"]: (r["licenses"], r["n_unknown"]) for r in licenses.scan(df).collect()}
    assert got == {k: t[1:] for k, t in texts.items()}
    assert licenses.scan(docs).count() == len(rows) and licenses.scan(no_docs).count() == 0


GPL3 = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
MPL2 = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
APACHE2 = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

{} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def test_wrapped_and_official_notices(spark):
    import textwrap

    mit = "\n\n".join(textwrap.fill(p, 72) for p in MIT.split("\n"))
    bsd = [BSD2.format(*marks) for marks in (("1.", "2."), ("*", "*"), ("(a)", "(b)"), ("1)", "2)"))]
    texts = [("MIT License\n\nCopyright (c) 2020 A. Author\n\n" + mit, "MIT"), (textwrap.indent(mit, " * "), "MIT"), (GPL3, "GPL-3.0-or-later"), (GPL3.replace("3", "2"), "GPL-2.0-or-later"), (MPL2, "MPL-2.0"), (APACHE2, "Apache-2.0"), *[(x, "BSD-2-Clause") for x in bsd], (ISC, "ISC"), ("All rights\n# reserved.", "Proprietary"), ("some heading\nReleased under the MIT License\nand a line", "MIT")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: (r["licenses"], r["n_unknown"]) for r in licenses.scan(df).collect()}
    want = {k: (x, 0) for k, (_, x) in enumerate(texts)}
    want[0] = ("MIT", 1)  # its title
    assert got == want
    own = licenses.scan(spark.createDataFrame([(1, "You may do\nanything. Else.")], "doc_id int, text string"), known={"you may do anything": "ANY"}, rules=(("Any", ("ANY",)),))
    assert own.first()["licenses"] == "Any"


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Targets by source (sorted, null last) in whole steps: who is above the cap is set to it, and the others share the rest anew."""
    from fractions import Fraction

    names, fixed = sorted(sizes, key=lambda s: (s is None, s or "")), {}
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    while True:
        rest = [s for s in names if s not in fixed and sizes[s]]
        left = sum(sizes.values()) - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return {s: float(fixed.get(s, share.get(s, 0))) for s in names}
        fixed |= {s: Fraction(cap * sizes[s]) for s in over}


def test_mix_meets_targets_of_its_own_reckoning(spark):
    """Null ids, repeated ids and repeated rows of all sizes; sources of a few documents and of thousands."""
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    rows = [(i, text(rng.randrange(1, 60)), "big") for i in range(3000)] + [(None, text(20), None) for _ in range(400)] + [(7, text(rng.randrange(5, 40)), "one id") for _ in range(500)]
    rows += [(9, "a b c d e f g h", "equal rows")] * 4000 + [(100 + i, text(50), "few") for i in range(6)] + [(200, text(70), "single"), (201, None, "empty"), (202, " ", "empty")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    out = mixing.mixed(df, mixing.plan(df)).toPandas()
    for s, own in out.groupby(out.source.map(lambda s: s if isinstance(s, str) else "null")):
        key = None if s == "null" else s
        taken, goal = (own.__mix_copies * own.__mix_size).sum(), want[key]
        assert abs(own.__mix_target.iloc[0] - goal) < 1e-6 if own.__mix_size.sum() else True
        slack = {"few": 25, "single": 35, "equal rows": 0.05 * goal}.get(s, 0.002 * goal + 1)
        assert abs(taken - goal) <= slack, (s, taken, goal)
        assert own.__mix_copies.max() <= 3
    assert out.__mix_size.sum() == sum(sizes.values()) and len(out) == len(rows)


def test_margins_that_cannot_be_met(spark):
    cells = spark.createDataFrame([("a", "x", 10.0), ("b", "y", 10.0)], "s string, l string, tokens double")
    with pytest.raises(ValueError):
        mixing.balance(cells, {"s": {"a": 5.0, "b": 15.0}, "l": {"x": 15.0, "y": 5.0}}, max_steps=8)


def test_reruns_agree_however_the_scan_is_split(spark, tmp_path):
    rows = [(i % 7 if i % 2 else i, f"words of text {i % 3} and some" if i % 2 else f"a text of its own {i}", ("s0", "s1", "s2", None)[i % 4 if i % 3 else 0]) for i in range(30_000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).write.parquet(str(tmp_path / "docs"))
    taken = []
    for size in ("128m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        df = spark.read.parquet(str(tmp_path / "docs"))
        taken.append((df.rdd.getNumPartitions(), sorted((r[0], str(r[1]), r[2], r[3]) for r in mixing.mixed(df, mixing.plan(df)).groupBy("doc_id", "source", "text").agg(F.sum(F.col("__mix_copies") * F.col("__mix_size"))).collect())))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert taken[0][0] != taken[1][0] and taken[0][1] == taken[1][1]
    made = mixing.plan(df)
    assert not made.where("edge >= 0").isEmpty()  # some bins are split
    total = mixing.mixed(df, made).groupBy("source").agg((F.sum(F.col("__mix_copies") * F.col("__mix_size")) / F.max("__mix_target")).alias("r")).collect()
    assert all(abs(r["r"] - 1) < 0.003 for r in total)


ENDORSE = """
{} Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from this
   software without specific prior written permission."""
FREE = """This {what} is free software; you can redistribute it and/or
modify it under the terms of the GNU {which} General Public
License as published by the Free Software Foundation; either
version {n} of the License, or (at your option) any later version."""
BOOK = [
    (BSD2.format("1.", "2.") + ENDORSE.format("3.", "Example Widgets International, Inc."), "BSD-3-Clause"),
    (BSD2.format("*", "*") + ENDORSE.format("*", "the University"), "BSD-3-Clause"),
    (BSD2.format("*", "*") + ENDORSE.format("*", "the copyright holder"), "BSD-3-Clause"),
    (BSD2.format("1.", "2.") + ENDORSE.format("3.", "one two three four five six seven eight nine ten eleven twelve thirteen"), "BSD-2-Clause"),  # beyond a slot
    (FREE.format(what="program", which="Affero", n="3"), "AGPL-3.0-or-later"), (FREE.format(what="library", which="Lesser", n="2.1"), "LGPL-2.1-or-later"), (FREE.format(what="library", which="Lesser", n="3"), "LGPL-3.0-or-later"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("// SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: Apache-2.0 OR GPL-2.0-or-later", "Apache-2.0,GPL-2.0-or-later"),
    ("SPDX-License-Identifier: MIT AND BSD-3-Clause\nSPDX-License-Identifier: Zlib", "BSD-3-Clause,MIT,Zlib"), ("SPDX-License-Identifier: Made-Up-1.0", ""),
    ("To the extent possible under law, A. N. Author has waived all copyright and related or neighboring rights to this work.", "CC0-1.0"),
    ("The program and the accompanying materials may be licensed.", ""), ("Free and unencumbered software, released into the world", ""), ("He has no license and no permission to redistribute it.", ""), ("in the public domain", ""),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "EPL-2.0"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "Zlib"),
]


def test_wider_book(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(BOOK)], "doc_id int, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(df).collect()}
    assert {k: ",".join(sorted(filter(None, v.split(",")))) for k, v in got.items()} == {k: x for k, (_, x) in enumerate(BOOK)}


def test_operator_and_sql_hold_the_same_book(spark):
    """Every sentence of the book, alone on a line, with slots filled (the SQL reads sentences in one piece)."""
    import duckdb

    one = [k.replace("{12}", "Some Holder of Nowhere") for k in licenses.BOOK]
    texts = [*one, *[t.replace("\n", " ") for t, _ in BOOK], None, "", "nothing of it", "All rights reserved.\nAll rights reserved."]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id INTEGER, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = duck.execute(licenses.ORACLE)
    names = [c[0] for c in want.description]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).select(*names).collect()
    want = {r[0]: r for r in want.fetchall()}
    assert {r["doc_id"]: tuple(r) for r in rows if r["doc_id"] < len(one)} == {k: v for k, v in want.items() if k < len(one)}
    assert all(r["licenses"] or r["doc_id"] >= len(one) or r["sentence_ids"] for r in rows)
    every = {tuple(r)[names.index("licenses")] for r in rows}
    assert {n for n, _ in licenses.OFFICIAL_RULES if n not in ("GPL-3.0-or-later", "GPL-2.0-or-later")} <= set(",".join(every).split(","))
