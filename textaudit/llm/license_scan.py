"""Licence recognition by sentence rules.

Text is cut into sentences in two readings (line by line, and with the lines of a paragraph joined), each sentence is
normalised and looked up among known licence sentences; the identifiers found, in order, are matched against ordered
licence rules. A rule walks along the identifiers with a pointer to the one it needs next, and consumes the places it used
each time it is complete, so that a longer rule (tried first) leaves nothing for the shorter ones; identifiers that no rule
consumes are reported. Sentence table and rules are fixed and small, so they are literals of one expression over the row: nothing is
shuffled. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences in normal form (lower case; runs of other characters than letters, digits and . are one space), cut as
#: the readings cut: behind each of . ! ? ; : before white space. Those without any text are known by their SPDX tag alone.
#: The rest of mpl2-form's sentence, "2.0", is too short to be one; no other version of that licence has these words.
SENTENCES = {
    "apache2-ref": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license", "this project is licensed under the apache license version 2.0", "released under the apache license version 2.0"],
    "apache2-comply": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at"],
    "apache2-asis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit-ref": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-asis": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "gpl3-ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "gpl2-ref": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl-free-1": ["this program is free software"],
    "gpl-free-2": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-free-2": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-pub": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl-free": ["this library is free software"],
    "lgpl-pub": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "lgpl3-free-2": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl3-free-2": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "later-2": ["either version 2 of the license or at your option any later version"],
    "later-2.1": ["either version 2.1 of the license or at your option any later version"],
    "later-3": ["either version 3 of the license or at your option any later version"],
    "unlicense-free": ["this is free and unencumbered software released into the public domain"],
    "unlicense-anyone": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "unlicense-ref": [],
    "zlib-asis": ["this software is provided as is without any express or implied warranty"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "zlib-ref": [],
    "boost-dist": ["distributed under the boost software license version 1.0"],
    "boost-ref": [],
    "epl2-terms": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0"],
    "epl2-form": ["this program and the accompanying materials are made available under the terms of the eclipse public license v"],
    "epl2-site": ["2.0 which is available at http www.eclipse.org legal epl 2.0"],
    "epl2-ref": [],
    "gpl-hope-1": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "gpl-hope-2": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl3-later": [],
    "gpl2-later": [],
    "lgpl3-ref": ["licensed under the gnu lesser general public license version 3"],
    "agpl3-ref": ["licensed under the gnu affero general public license version 3"],
    "mpl2-ref": [],
    "mpl2-form": ["this source code form is subject to the terms of the mozilla public license v"],
    "mpl2-obtain": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0"],
    "bsd3-ref": [],
    "bsd2-ref": [],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc-ref": [],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "ccbync4-ref": ["licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "ccby4-ref": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "ccbysa4-ref": ["licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc0-ref": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "licensed under cc0 1.0"],
}
#: SPDX tags are sentences, too: spdx license identifier <name>. GPL-2.0 and GPL-2.0+ are one in normal form, so neither is here.
SPDX = {
    "apache2-ref": ["apache 2.0"], "mit-ref": ["mit"], "bsd3-ref": ["bsd 3 clause"], "bsd2-ref": ["bsd 2 clause"], "isc-ref": ["isc"], "gpl3-later": ["gpl 3.0 or later"], "gpl2-later": ["gpl 2.0 or later"],
    "gpl3-ref": ["gpl 3.0 only"], "gpl2-ref": ["gpl 2.0 only"], "lgpl3-ref": ["lgpl 3.0 only", "lgpl 3.0 or later"], "agpl3-ref": ["agpl 3.0 only", "agpl 3.0 or later"],
    "mpl2-ref": ["mpl 2.0"], "unlicense-ref": ["unlicense"], "zlib-ref": ["zlib"], "boost-ref": ["bsl 1.0"], "epl2-ref": ["epl 2.0"], "ccby4-ref": ["cc by 4.0"], "ccbync4-ref": ["cc by nc 4.0"], "ccbysa4-ref": ["cc by sa 4.0"], "cc0-ref": ["cc0 1.0"],
}
#: Ordered: (licence, identifiers in order, with others between them allowed).
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-ref",)),
    ("Apache-2.0", ("apache2-ref", "apache2-comply", "apache2-copy", "apache2-asis")),
    ("Apache-2.0", ("apache2-ref",)),
    ("GPL-3.0-or-later", ("gpl-free-1", "gpl-free-2", "gpl-hope-1", "gpl-hope-2")),
    ("GPL-3.0-or-later", ("gpl-free-1", "gpl-free-2")),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-2.0-or-later", ("gpl-free-1", "gpl2-free-2", "gpl-hope-1", "gpl-hope-2")),
    ("GPL-2.0-or-later", ("gpl-free-1", "gpl2-free-2")),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-3.0-or-later", ("gpl-free-1", "gpl-pub", "later-3", "gpl-hope-1", "gpl-hope-2")),
    ("GPL-3.0-or-later", ("gpl-free-1", "gpl-pub", "later-3")),
    ("GPL-2.0-or-later", ("gpl-free-1", "gpl-pub", "later-2", "gpl-hope-1", "gpl-hope-2")),
    ("GPL-2.0-or-later", ("gpl-free-1", "gpl-pub", "later-2")),
    ("AGPL-3.0", ("gpl-free-1", "agpl3-free-2", "gpl-hope-1", "gpl-hope-2")),
    ("AGPL-3.0", ("gpl-free-1", "agpl3-free-2")),
    ("LGPL-3.0", ("lgpl-free", "lgpl-pub", "later-3")),
    ("LGPL-2.1", ("lgpl-free", "lgpl-pub", "later-2.1")),
    ("LGPL-3.0", ("lgpl-free", "lgpl3-free-2")),
    ("LGPL-3.0", ("gpl-free-1", "lgpl3-free-2")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-ref",)),
    ("Zlib", ("zlib-asis", "zlib-grant")),
    ("Zlib", ("zlib-ref",)),
    ("BSL-1.0", ("boost-dist",)),
    ("BSL-1.0", ("boost-ref",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("EPL-2.0", ("epl2-form", "epl2-site")),
    ("EPL-2.0", ("epl2-ref",)),
    ("AGPL-3.0", ("agpl3-ref",)),
    ("LGPL-3.0", ("lgpl3-ref",)),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-2.0", ("gpl2-ref",)),
    ("MPL-2.0", ("mpl2-form", "mpl2-obtain")),
    ("MPL-2.0", ("mpl2-form",)),
    ("MPL-2.0", ("mpl2-ref",)),
    ("MIT", ("mit-ref",)),
    ("CC-BY-NC-4.0", ("ccbync4-ref",)),
    ("CC-BY-SA-4.0", ("ccbysa4-ref",)),
    ("CC-BY-4.0", ("ccby4-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
)
#: Every known sentence holds one of these, so texts without any are not cut.
HINTS = r"(?i)licen[sc]e|licensed|copyright|permission|redistribut|public|warrant|without|compliance|software|mozilla|either version|eclipse"
TAG = r"(?i)spdx-license-identifier:[ \t]*"
CUT = "\x01"


def known_sentences() -> dict[str, str]:
    out = {s: k for k, ss in SENTENCES.items() for s in ss}
    return out | {f"spdx license identifier {name}": k for k, names in SPDX.items() for name in names}


def normal(sentence: Column) -> Column:
    s = F.regexp_replace(F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9.]+", " ")
    return F.regexp_replace(F.regexp_replace(s, r"[ .]+$", ""), r"^[ .]+", "")


def by_line(text: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(text, r"\r?\n", CUT), r"([.!?;:])[ \t]+", f"$1{CUT}"), CUT)


def by_paragraph(text: Column) -> Column:
    t = F.regexp_replace(text, r"\n[ \t\r]*\n", CUT)
    return F.split(F.regexp_replace(F.regexp_replace(t, r"[ \t\r\n\f]+", " "), r"([.!?;:]) ", f"$1{CUT}"), CUT)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licenses, sentence_ids, unmatched_ids), for every row with a known sentence; strings joined by commas.

    licenses: distinct, sorted. sentence_ids: as the better reading (more identifiers, by lines on a tie) has them, in
    order. Null and empty texts, texts without known sentences and an empty table give no row. Whole texts are read, however
    long. Rows are texts of their own, whether they share an id, repeat or have none. Other columns are not read. Nothing is shuffled.
    """
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").rlike(HINTS))
    text = F.regexp_replace("_text", TAG, "spdx license identifier ")  # its colon ends no sentence
    d = d.select("_id", F.explode(F.array(F.array(_identifiers(by_line(text)), _identifiers(by_paragraph(text))))).alias("ways"))  # explode: both readings are made once
    d = d.where("size(ways[0]) + size(ways[1]) > 0").select("_id", F.transform("ways", matched).alias("ways"))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform("ways", lambda w: w.found))))
    best = F.when(F.size(F.col("ways")[1].ids) > F.size(F.col("ways")[0].ids), F.col("ways")[1]).otherwise(F.col("ways")[0])
    d = d.select("_id", found.alias("found"), best.alias("best"))
    return d.select(F.col("_id").alias(id_col), F.array_join("found", ",").alias("licenses"), F.array_join("best.ids", ",").alias("sentence_ids"), F.array_join("best.rest", ",").alias("unmatched_ids"))


def _identifiers(parts: Column) -> Column:
    """Of the parts that are known sentences the identifiers, in order."""
    known = F.create_map(*[F.lit(x) for pair in sorted(known_sentences().items()) for x in pair])
    ids = F.transform(F.filter(parts, lambda p: F.length(p) >= 8), lambda p: F.try_element_at(known, normal(p)))
    return F.filter(ids, lambda k: k.isNotNull())


_PLACES = "array<struct<at: int, sid: string>>"


def _walk(rest: Column, need: Column) -> Column:
    """Places of `rest` that hold the identifiers `need` in order, others between them allowed: from left to right, as often as they are complete."""
    start = F.struct(F.lit(0).alias("seen"), F.array().cast("array<int>").alias("open"), F.array().cast("array<int>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        took = F.array_append(s.open, x.at)
        last = F.struct(F.lit(0).alias("seen"), F.array().cast("array<int>").alias("open"), F.concat(s.done, took).alias("done"))
        more = F.struct((s.seen + 1).alias("seen"), took.alias("open"), s.done.alias("done"))
        return F.when(x.sid != F.get(need, s.seen), s).when(s.seen == F.size(need) - 1, last).otherwise(more)

    return F.aggregate(rest, start, step, lambda s: s.done)


def matched(ids: Column) -> Column:
    """struct(ids, found: licences, rest: identifiers left) of an array of identifiers: one fold over the rules."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, need)).alias("need")) for name, need in RULES])
    start = F.struct(F.transform(ids, lambda x, i: F.struct(i.cast("int").alias("at"), x.alias("sid"))).cast(_PLACES).alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, rule: Column) -> Column:
        left = lambda used: F.struct(F.filter(s.rest, lambda x: ~F.array_contains(used, x.at)).cast(_PLACES).alias("rest"), F.array_append(s.found, rule["name"]).alias("found"))
        after = F.get(F.transform(F.array(_walk(s.rest, rule.need)), lambda used: F.when(F.size(used) == 0, s).otherwise(left(used))), F.lit(0))
        # not without all it needs: most rules end here
        return F.when(F.size(F.array_except(rule.need, F.transform(s.rest, lambda x: x.sid))) > 0, s).otherwise(after)

    return F.aggregate(rules, start, step, lambda s: F.struct(ids.alias("ids"), s.found.alias("found"), F.transform(s.rest, lambda x: x.sid).alias("rest")))


def op7_license_scan(spark, sf_dir):
    from .common import table

    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Identifiers as single letters, rules as regular expressions over them."""
    names = sorted({*SENTENCES, *SPDX})
    letter = {k: chr(0x4E00 + i) for i, k in enumerate(names)}
    values = ", ".join(f"('{s}', '{letter[k]}')" for s, k in sorted(known_sentences().items()))
    ctes, prev = [], "s0"
    for i, (name, need) in enumerate(RULES, 1):
        pattern = "(.*?)".join(letter[k] for k in need)
        between = "".join(rf"\{k}" for k in range(1, len(need)))
        ctes.append(f"s{i} as (select _id, way, ids, case when regexp_matches(rest, '{pattern}') then list_append(found, '{name}') else found end as found, regexp_replace(rest, '{pattern}', '{between}', 'g') as rest from {prev})")
        prev = f"s{i}"
    lower = "translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    spelt = "map {" + ", ".join(f"'{letter[k]}': '{k}'" for k in names) + "}"
    joined = lambda x: f"array_to_string(list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: {spelt}[c]), ',')"
    return rf"""
with known(sentence, sid) as (values {values}),
d as (select row_number() over () as _id, doc_id, regexp_replace(text, '{TAG}', 'spdx license identifier ', 'g') as text from documents where regexp_matches(text, '{HINTS}')),
lines as (select _id, 0 as way, string_split(regexp_replace(regexp_replace(text, '\r?\n', chr(1), 'g'), '([.!?;:])[ \t]+', '\1' || chr(1), 'g'), chr(1)) as parts from d
  union all select _id, 1, string_split(regexp_replace(regexp_replace(regexp_replace(text, '\n[ \t\r]*\n', chr(1), 'g'), '[ \t\r\n\f]+', ' ', 'g'), '([.!?;:]) ', '\1' || chr(1), 'g'), chr(1)) from d),
pieces as (select _id, way, unnest(parts) as part, generate_subscripts(parts, 1) as pos from lines),
norm as (select _id, way, pos, regexp_replace(regexp_replace(regexp_replace({lower}, '[^a-z0-9.]+', ' ', 'g'), '[ .]+$', ''), '^[ .]+', '') as sentence from pieces where length(part) >= 8),
s0 as (select _id, way, string_agg(sid, '' order by pos) as ids, string_agg(sid, '' order by pos) as rest, []::varchar[] as found from norm join known using (sentence) group by _id, way),
{", ".join(ctes)},
found as (select _id, list_sort(list_distinct(flatten(list(found)))) as found from {prev} group by _id),
best as (select * from {prev} qualify row_number() over (partition by _id order by length(ids) desc, way) = 1)
select d.doc_id, array_to_string(f.found, ',') as licenses, {joined("b.ids")} as sentence_ids, {joined("b.rest")} as unmatched_ids
from best b join found f using (_id) join d using (_id)
"""


OP7_SQL = _sql()
