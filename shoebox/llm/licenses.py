"""License scans by sentence-rule recognition (operator 2), in DataFrame functions only.

A text is cut into pieces (line breaks, and gaps after . ! ? ; :), from which list marks such as '(a)' are
taken. Pieces are normalised: lower case, runs of other characters than letters and digits (also comment
marks) become one space. A known sentence may have slots (the holder, a project), each a bounded number of words. A run of whole pieces that reads like a known license sentence becomes its identifier, the
longest known one first, so sentences that are wrapped, or cut after 'v.', are found. The identifiers of a text in order
form its sequence (an SPDX line gives one for each license that it names); pieces that speak of a license and are in no known sentence are '?' in it.
Ordered rules (longer texts first, as listed where they are equally long) are then looked for in the sequence as contiguous runs; a rule that
matches takes its identifiers away from the rules after it. Everything happens within the row: no
shuffle, and a text of any length is scanned whole.

Defined cases: null and empty texts have no sentences; null ids are kept; repeated rows are scanned
each by itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Known sentences of licenses in their normal form, and the identifier of each.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT_GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT_NOTICE",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MIT_WARRANTY",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MIT_LIABILITY",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD_GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD_SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD_BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD_ENDORSE",
    "licensed under the apache license version 2 0": "APACHE2_REF",
    "licensed under the apache license version 2 0 the license": "APACHE2_REF",
    "you may not use this file except in compliance with the license": "APACHE_COMPLY",
    "you may obtain a copy of the license at": "APACHE_COPY",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE_BASIS",
    "released under the mit license": "MIT_REF",
    "licensed under the mit license": "MIT_REF",
    "this project is licensed under the mit license": "MIT_REF",
    "this work is licensed under the gnu general public license version 3": "GPL3_REF",
    "licensed under the gnu general public license version 3": "GPL3_REF",
    "licensed under the gnu general public license version 2": "GPL2_REF",
    "this program is free software": "GPL_FREE",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPL_TERMS",
    "either version 3 of the license or at your option any later version": "GPL3_LATER",
    "either version 2 of the license or at your option any later version": "GPL2_LATER",
    "licensed under cc by nc 4 0": "CC_BY_NC_4_REF",
    "licensed under cc by 4 0": "CC_BY_4_REF",
    "licensed under cc by sa 4 0": "CC_BY_SA_4_REF",
    "this work is licensed under a creative commons attribution 4 0 international license": "CC_BY_4_REF",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2_REF",
    "all rights reserved": "ALL_RIGHTS",
}
#: Rules in the order in which they are tried; each is a license and its run of identifiers.
RULES = (
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "MIT_WARRANTY", "MIT_LIABILITY")),
    ("ISC", ("ISC_GRANT",)),
    ("BSD-3-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE")),
    ("BSD-2-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY")),
    ("Apache-2.0", ("APACHE2_REF", "APACHE_COMPLY", "APACHE_COPY", "APACHE_BASIS")),
    ("Apache-2.0", ("APACHE2_REF",)),
    ("GPL-3.0-or-later", ("GPL_FREE", "GPL_TERMS", "GPL3_LATER")),
    ("GPL-2.0-or-later", ("GPL_FREE", "GPL_TERMS", "GPL2_LATER")),
    ("GPL-3.0-only", ("GPL3_REF",)),
    ("GPL-2.0-only", ("GPL2_REF",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC_4_REF",)),
    ("CC-BY-SA-4.0", ("CC_BY_SA_4_REF",)),
    ("CC-BY-4.0", ("CC_BY_4_REF",)),
    ("MPL-2.0", ("MPL2_REF",)),
    ("MIT", ("MIT_REF",)),
    ("Proprietary", ("ALL_RIGHTS",)),
)
#: Further wordings, as official notices have them. {n} stands for one to n words of a holder or project.
OFFICIAL_SENTENCES = {
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3_TERMS",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2_TERMS",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "APACHE_COPY",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "APACHE_COPY",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MPL2_COPY",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MPL2_COPY",
    "neither the name of {12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD_ENDORSE",
    "neither the name of {12} nor the names of {12} contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD_ENDORSE",
    "the name of {12} may not be used to endorse or promote products derived from this software without specific prior written permission": "BSD_ENDORSE",
    "this software is provided by {12} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSD_DISCLAIMER",
    "this library is free software": "LGPL_FREE",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LGPL_TERMS",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "LGPL21_TERMS",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3_TERMS",
    "either version 2 1 of the license or at your option any later version": "LGPL21_LATER",
    "licensed under the gnu lesser general public license version 2 1": "LGPL21_REF",
    "licensed under the gnu lesser general public license version 3": "LGPL3_REF",
    "this work is licensed under the gnu lesser general public license version 3": "LGPL3_REF",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "AGPL_TERMS",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL3_TERMS",
    "licensed under the gnu affero general public license version 3": "AGPL3_REF",
    "this is free and unencumbered software released into the public domain": "UNLICENSE",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZLIB_GRANT",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BSL_GRANT",
    "distributed under the boost software license version 1 0": "BSL_REF",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "EPL2_REF",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0": "EPL2_REF",
    "to the extent possible under law {12} has waived all copyright and related or neighboring rights to {12}": "CC0_WAIVER",
}
OFFICIAL_RULES = (
    ("GPL-3.0-or-later", ("GPL_FREE", "GPL3_TERMS")),
    ("GPL-2.0-or-later", ("GPL_FREE", "GPL2_TERMS")),
    ("LGPL-2.1-or-later", ("LGPL_FREE", "LGPL21_TERMS")),
    ("LGPL-2.1-or-later", ("LGPL_FREE", "LGPL_TERMS", "LGPL21_LATER")),
    ("LGPL-3.0-or-later", ("LGPL_FREE", "LGPL3_TERMS")),
    ("LGPL-3.0-or-later", ("LGPL_FREE", "LGPL_TERMS", "GPL3_LATER")),
    ("LGPL-2.1-only", ("LGPL21_REF",)),
    ("LGPL-3.0-only", ("LGPL3_REF",)),
    ("AGPL-3.0-or-later", ("GPL_FREE", "AGPL3_TERMS")),
    ("AGPL-3.0-or-later", ("GPL_FREE", "AGPL_TERMS", "GPL3_LATER")),
    ("AGPL-3.0-only", ("AGPL3_REF",)),
    ("Unlicense", ("UNLICENSE",)),
    ("Zlib", ("ZLIB_GRANT",)),
    ("BSL-1.0", ("BSL_GRANT",)),
    ("BSL-1.0", ("BSL_REF",)),
    ("EPL-2.0", ("EPL2_REF",)),
    ("CC0-1.0", ("CC0_WAIVER",)),
)
#: Names that a line 'SPDX-License-Identifier: name' may give; each is a sentence, an identifier and a rule.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
_SPDX_HEAD = "spdx license identifier "
SPDX_SENTENCES = {_SPDX_HEAD + re.sub("[^a-z0-9]+", " ", name.lower()): f"SPDX_{name}" for name in SPDX}
SPDX_RULES = tuple((name, (f"SPDX_{name}",)) for name in SPDX)
#: The book: what the operator and the SQL both know.
BOOK, ALL_RULES = SENTENCES | OFFICIAL_SENTENCES | SPDX_SENTENCES, RULES + OFFICIAL_RULES + SPDX_RULES
#: Pieces with one of these speak of a license; every sentence above holds one.
KEYWORDS = "licen|permission|redistribut|warrant|free software|liable|option any|copy of the|rights reserved"


def sentences(text: Column, known: dict[str, str]) -> Column:
    """Normalised sentences of a text: known ones, and other pieces that may speak of a license."""
    text = F.regexp_replace(text, r"(?i)(spdx-license-identifier):[ \t]*", "$1 ")  # one piece with what it names
    cut = F.split(F.regexp_replace(text, r"[.!?;:][ \t-\r]+", "\n"), "[\\n-\\r]")
    unmarked = F.transform(cut, lambda x: F.regexp_replace(F.lower(x), r"^[^a-z0-9]*\(?(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})\)", " "))
    plain = F.array_remove(F.transform(unmarked, lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))), "")
    # The terms of a line that names several licenses are lines of their own.
    terms = lambda x: F.regexp_replace(x, " (?:or|and) (?!later)", f"\n{_SPDX_HEAD}")
    plain = F.transform(plain, lambda x: F.when(x.startswith(_SPDX_HEAD), terms(x)).otherwise(x))
    longest = sorted(known, key=lambda x: (-len(x), x))
    piece = r"(?<=\n)(?:" + "|".join(_slotted("[ \\n]".join(x.split()), "[ \\n]") for x in longest) + r"|[^\n]+)(?=\n)"
    lines = F.concat(F.lit("\n"), F.array_join(plain, "\n"), F.lit("\n"))
    found = F.transform(F.regexp_extract_all(lines, F.lit(piece), F.lit(0)), lambda x: named(F.translate(x, "\n", " "), known))
    return F.filter(found, lambda x: x.rlike(KEYWORDS) | x.isin(*_unmarked(known)))


def _slotted(sentence: str, gap: str) -> str:
    """A pattern of a sentence in which {n} is one to n words."""
    return re.sub(r"\{(\d+)\}", lambda m: "[a-z0-9]+(?:" + gap + "[a-z0-9]+){0," + str(int(m[1]) - 1) + "}?", sentence)


def named(sentence: Column, known: dict[str, str]) -> Column:
    """A sentence with the words of its slots taken out, so that it can be looked up."""
    out = sentence
    for k in known:
        if "{" in k:
            out = F.when(sentence.rlike("^" + _slotted(k, " ") + "$"), k).otherwise(out)
    return out


def _unmarked(known: dict[str, str]) -> list[str]:
    """Known sentences that hold no keyword."""
    return [k for k in known if not re.search(KEYWORDS, k)]


def may_hold(text: Column, known: dict[str, str]) -> Column:
    """Whether a text can hold one of the known sentences or a keyword, wherever its lines are broken."""
    others = {max(k.split(), key=len) for k in _unmarked(known)}
    return F.lower(text).rlike("|".join([KEYWORDS.replace(" ", "[^a-z0-9]+"), *sorted(others)]))


def identified(sents: Column, known: dict[str, str]) -> Column:
    """The identifier of each sentence, or '?' for one that is not known."""
    ids = F.create_map(*[F.lit(x) for x in chain.from_iterable(known.items())])
    return F.transform(sents, lambda x: F.coalesce(F.try_element_at(ids, x), F.lit("?")))


def matched(ids: Column, rules: tuple) -> Column:
    """(sequence left over, licenses found) after the rules took their runs in order."""
    start = F.struct(F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" ")).alias("left"), F.lit("").alias("found"))
    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(run) + " ").alias("run")) for name, run in rules])

    def step(acc: Column, rule: Column) -> Column:
        new = F.when(F.array_contains(F.split(acc["found"], ","), rule["name"]), acc["found"]).when(acc["found"] == "", rule["name"]).otherwise(F.concat(acc["found"], F.lit(","), rule["name"]))
        return F.when(F.contains(acc["left"], rule["run"]), F.struct(F.replace(acc["left"], rule["run"], F.lit(" | ")).alias("left"), new.alias("found"))).otherwise(acc)

    return F.aggregate(listed, start, step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None, rules: tuple = ALL_RULES) -> DataFrame:
    """Per document: n_license_sentences, sentence_ids, licenses (in rule order) and n_unknown (pieces that are in no known one)."""
    known = known or BOOK
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    ids = F.when(may_hold(text, known), identified(sentences(text, known), known)).otherwise(none)
    rows = docs.select(F.col(id_col), ids.alias("ids"))
    found = F.when(F.size("ids") > 0, matched(F.col("ids"), rules)["found"]).otherwise(F.lit(""))
    return rows.select(id_col, F.size("ids").cast("long").alias("n_license_sentences"), F.array_join(F.filter("ids", lambda x: x != "?"), ",").alias("sentence_ids"), found.alias("licenses"), F.size(F.filter("ids", lambda x: x == "?")).cast("long").alias("n_unknown"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in BOOK.items())
    slots = "CASE " + " ".join(f"WHEN regexp_full_match(s, '{_slotted(k, ' ')}') THEN '{k}'" for k in BOOK if "{" in k) + " ELSE s END"
    marked = f"regexp_matches(s, '{KEYWORDS}') OR s IN ({', '.join(repr(k) for k in _unmarked(BOOK))})"
    terms = f"CASE WHEN starts_with(s, '{_SPDX_HEAD}') THEN list_transform(string_split_regex(replace(substr(s, {len(_SPDX_HEAD) + 1}), ' or later', ' orlater'), ' (or|and) '), lambda x: '{_SPDX_HEAD}' || replace(x, ' orlater', ' or later')) ELSE [s] END"
    others = "|".join(sorted({max(k.split(), key=len) for k in _unmarked(BOOK)}))
    left, cols = "' ' || list_aggregate(ids, 'string_agg', '  ') || ' '", ""
    steps = [f"SELECT *, {left} AS l0 FROM a"]
    for k, (_, run) in enumerate(ALL_RULES):
        steps.append(f"SELECT *, replace(l{k}, ' {'  '.join(run)} ', ' | ') AS l{k + 1}, contains(l{k}, ' {'  '.join(run)} ') AS f{k} FROM s{k}")
    names: dict[str, list[int]] = {}
    for k, (name, _) in enumerate(ALL_RULES):
        names.setdefault(name, []).append(k)
    first = "CASE " + " ".join(f"WHEN name = '{n}' THEN {'least(' + ','.join(f'CASE WHEN f{k} THEN {k} ELSE 999 END' for k in ks) + ')'}" for n, ks in names.items()) + " END"
    cols = ", ".join(f"('{n}')" for n in names)
    ctes = ", ".join(f"s{k} AS ({q})" for k, q in enumerate(steps))
    return f"""
WITH known(s, i) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, unnest(ls) AS raw, generate_subscripts(ls, 1) AS n FROM (SELECT rid, string_split_regex(regexp_replace(regexp_replace(t, '(spdx-license-identifier):[ \\t]*', '\\1 ', 'gi'), '[.!?;:][ \\t-\\r]+', chr(10), 'g'), '[\\n-\\r]') AS ls FROM d WHERE regexp_matches(lower(t), '{KEYWORDS}|{others}'))),
o AS (SELECT rid, n, trim(regexp_replace(regexp_replace(lower(raw), '^[^a-z0-9]*[(]?([0-9]{{1,2}}|[a-z]|[ivx]{{2,4}})[)]', ' '), '[^a-z0-9]+', ' ', 'g')) AS s FROM l),
p AS (SELECT rid, n, unnest({terms}) AS s, generate_subscripts({terms}, 1) AS j FROM o),
n AS (SELECT rid, n * 1000 + j AS n, {slots} AS s FROM p),
m AS (SELECT rid, n, coalesce(known.i, '?') AS i FROM n LEFT JOIN known USING (s) WHERE {marked}),
a AS (SELECT rid, list(i ORDER BY n) AS ids FROM m GROUP BY rid),
{ctes},
f AS (SELECT rid, string_agg(name, ',' ORDER BY k) AS licenses FROM (SELECT rid, name, {first} AS k FROM s{len(ALL_RULES)}, (VALUES {cols}) AS v(name)) WHERE k < 999 GROUP BY rid)
SELECT d.doc_id, coalesce(len(a.ids), 0)::BIGINT AS n_license_sentences,
  coalesce(list_aggregate(list_filter(a.ids, lambda x: x <> '?'), 'string_agg', ','), '') AS sentence_ids,
  coalesce(f.licenses, '') AS licenses, coalesce(len(list_filter(a.ids, lambda x: x = '?')), 0)::BIGINT AS n_unknown
FROM d LEFT JOIN a USING (rid) LEFT JOIN f ON f.rid = d.rid"""


ORACLE = _oracle()
