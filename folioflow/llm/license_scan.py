"""License scan by sentence rules, in DataFrame functions only.

Texts are cut into sentences (line ends, and full stops, exclamation and question marks or
semicolons before white space), sentences are normalised to lower-case letters and digits, and
those that equal a known license sentence become its identifier; so do consecutive lines that
together equal one, as license texts are wrapped and commented out (not over a sentence mark or
a blank line); their place is the first line's. A document's identifiers in
order are matched against rules, ordered lists of identifiers: a rule holds if its sentences
occur in that order, with anything between them. A rule whose sentences are part of a longer one's
(two clauses of three, the notice in a license's appendix) counts only where it occurs more often
than that one does. The two tables are small, fixed and broadcast
(runs of words by their 64-bit hash); sentences of no license end at the join.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sentences of public license texts and notices, by identifier.
SENTENCES: dict[str, str] = {
    "mit-short": "Released under the MIT License.",
    "mit-short-2": "Licensed under the MIT License.",
    "mit-short-3": "This project is licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-2-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-2-comply": "you may not use this file except in compliance with the License.",
    "apache-2-copy": "You may obtain a copy of the License at",
    "apache-2-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2-short": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl-3-short": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "bsd-use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-4-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "program-free": "This program is free software;",
    "library-free": "This library is free software;",
    "gpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "lgpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "either-2": "either version 2 of the License, or (at your option) any later version.",
    "either-2.1": "either version 2.1 of the License, or (at your option) any later version.",
    "either-3": "either version 3 of the License, or (at your option) any later version.",
    "gpl-2-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl-notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-2-v": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html",
    "boost": "Distributed under the Boost Software License, Version 1.0.",
    "apache-title": "Apache License",
    "apache-version": "Version 2.0, January 2004",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "gpl-2-version": "Version 2, June 1991",
    "lgpl-2.1-version": "Version 2.1, February 1999",
    "gpl-3-version": "Version 3, 29 June 2007",
    "agpl-3-version": "Version 3, 19 November 2007",
    "verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "mpl-title": "Mozilla Public License Version 2.0",
    "mpl-definitions": "1. Definitions",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache-2": "SPDX-License-Identifier: Apache-2.0",
    "spdx-bsd-2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-bsd-3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-mpl-2": "SPDX-License-Identifier: MPL-2.0",
    "spdx-epl-2": "SPDX-License-Identifier: EPL-2.0",
    "spdx-gpl-2": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx-gpl-2-later": "SPDX-License-Identifier: GPL-2.0-or-later",
    "spdx-gpl-3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-gpl-3-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-lgpl-2.1-later": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "spdx-agpl-3-later": "SPDX-License-Identifier: AGPL-3.0-or-later",
}
# Rules, (license, its sentences in order).
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("AGPL-3.0-only", ("agpl-title", "agpl-3-version", "verbatim")),
    ("AGPL-3.0-only", ("agpl-title", "agpl-3-version", "verbatim", "agpl-notice")),
    ("AGPL-3.0-or-later", ("agpl-notice",)),
    ("AGPL-3.0-or-later", ("spdx-agpl-3-later",)),
    ("Apache-2.0", ("apache-2-short",)),
    ("Apache-2.0", ("apache-2-header", "apache-2-comply", "apache-2-warranty")),
    ("Apache-2.0", ("apache-title", "apache-version", "apache-terms")),
    ("Apache-2.0", ("spdx-apache-2",)),
    ("BSD-2-Clause", ("bsd-use", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("spdx-bsd-2",)),
    ("BSD-3-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("spdx-bsd-3",)),
    ("BSL-1.0", ("boost",)),
    ("CC-BY-4.0", ("cc-by-4-short",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-short",)),
    ("CC0-1.0", ("cc0",)),
    ("EPL-2.0", ("epl-2",)),
    ("EPL-2.0", ("epl-2-v",)),
    ("EPL-2.0", ("spdx-epl-2",)),
    ("GPL-2.0-only", ("gpl-2-short",)),
    ("GPL-2.0-only", ("program-free", "gpl-2-redistribute")),
    ("GPL-2.0-only", ("gpl-title", "gpl-2-version", "verbatim")),
    ("GPL-2.0-only", ("gpl-title", "gpl-2-version", "verbatim", "program-free", "gpl-redistribute", "either-2")),
    ("GPL-2.0-only", ("spdx-gpl-2",)),
    ("GPL-2.0-or-later", ("program-free", "gpl-redistribute", "either-2")),
    ("GPL-2.0-or-later", ("spdx-gpl-2-later",)),
    ("GPL-3.0-only", ("gpl-3-short",)),
    ("GPL-3.0-only", ("gpl-title", "gpl-3-version", "verbatim")),
    ("GPL-3.0-only", ("gpl-title", "gpl-3-version", "verbatim", "gpl-notice", "gpl-hope", "gpl-received")),
    ("GPL-3.0-only", ("spdx-gpl-3",)),
    ("GPL-3.0-or-later", ("gpl-notice", "gpl-hope", "gpl-received")),
    ("GPL-3.0-or-later", ("program-free", "gpl-redistribute", "either-3")),
    ("GPL-3.0-or-later", ("spdx-gpl-3-later",)),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("spdx-isc",)),
    ("LGPL-2.1-only", ("lgpl-title", "lgpl-2.1-version", "verbatim")),
    ("LGPL-2.1-only", ("lgpl-title", "lgpl-2.1-version", "verbatim", "library-free", "lgpl-redistribute", "either-2.1")),
    ("LGPL-2.1-or-later", ("library-free", "lgpl-redistribute", "either-2.1")),
    ("LGPL-2.1-or-later", ("spdx-lgpl-2.1-later",)),
    ("LGPL-3.0-only", ("lgpl-3-short",)),
    ("LGPL-3.0-only", ("lgpl-title", "gpl-3-version", "verbatim")),
    ("LGPL-3.0-or-later", ("lgpl-notice",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-short-2",)),
    ("MIT", ("mit-short-3",)),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("MIT", ("spdx-mit",)),
    ("MPL-2.0", ("mpl-2",)),
    ("MPL-2.0", ("mpl-title", "mpl-definitions")),
    ("MPL-2.0", ("spdx-mpl-2",)),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
)
CUT = r"([.!?;])[ \t\r\f]+"


def normalised(text: str) -> list[str]:
    """Sentences of a text, normalised, in Python: for the tables and the tests."""
    cut = re.sub(CUT, r"\1\n", text.lower())
    return [s for s in (x.strip(" ") for x in re.sub(r"[^a-z0-9\n]+", " ", cut).split("\n")) if s]


def known_sentences() -> list[tuple[str, int]]:
    """(sentence, identifier): a table entry that is cut into several keeps the longest as its own."""
    return [(max(normalised(s), key=len), k) for k, s in enumerate(SENTENCES.values())]


def rules() -> list[tuple[str, int, list[int]]]:
    """(license, first identifier, identifiers in order)."""
    place = {name: k for k, name in enumerate(SENTENCES)}
    return [(name, place[ids[0]], [place[x] for x in ids]) for name, ids in RULES]


def covers() -> list[list[int]]:
    """For each rule the longer rules of other licenses that hold all its sentences in the same order."""

    def inside(short: tuple[str, ...], long: tuple[str, ...]) -> bool:
        rest = iter(long)
        return len(short) < len(long) and all(x in rest for x in short)

    return [[k for k, (other, long) in enumerate(RULES) if other != name and inside(ids, long)] for name, ids in RULES]


def fragments() -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(hash of a run of words, its occurrences in known sentences as (identifier, first word, number of
    words of the sentence)). The hash is what F.xxhash64 gives for the run."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for sentence, sid in known_sentences():
        words = sentence.split(" ")
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                code = xxhash.xxh64_intdigest(" ".join(words[a:b]).encode(), 42)
                found.setdefault(code - (1 << 64) if code >> 63 else code, []).append((sid, a, len(words)))
    return list(found.items())


def sentences(text: Column) -> Column:
    """Normalised lines of sentences, in order, without empty ones; one that does not continue
    the line before it (after a sentence mark or a blank line) has a bar in front."""
    cut = F.regexp_replace(F.lower(text), r"[.!?;](?:[ \t\r\f]+|(?=\n))", "\n\n")
    plain = F.regexp_replace(cut, r"[^a-z0-9\n]+", " ")
    barred = F.regexp_replace(plain, r"\n[ \n]*\n", "\n|")
    return F.filter(F.transform(F.split(barred, "\n"), lambda s: F.trim(s)), lambda s: ~s.isin("", "|"))


def times_in_order(sequence: Column, ids: Column) -> Column:
    """How often the identifiers occur in the sequence in that order, with anything between them and one
    occurrence behind the other: one pass that looks for one identifier after the other."""
    n = F.size(ids)
    steps = F.aggregate(sequence, F.lit(0), lambda k, x: F.when(x == F.get(ids, k % n), k + 1).otherwise(k))
    return F.floor(steps / n).cast("int")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document row and license: doc_id, license, first_sentence and last_sentence (places
    among the document's sentences of the first and last known sentence), n_known (known sentences).
    What a longer rule covers is not reported: three-clause BSD is not two-clause BSD as well, unless both stand there.

    Null and empty texts have no sentences; a repeated row reports again; a license that several
    rules name, or one rule finds twice, is reported once; an empty table gives no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(fragments(), "code bigint, at array<struct<sid: int, first: int, n: int>>")
    rule = spark.createDataFrame([(k, *r, c) for k, (r, c) in enumerate(zip(rules(), covers(), strict=True))], "rule int, license string, first int, ids array<int>, covers array<int>")
    # rows are numbered before their sentences are dealt out
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", sentences(F.col("text")).alias("sentences"))
    cut = numbered.select("row", "doc_id", F.posexplode("sentences").alias("place", "line"))
    lines = cut.select("row", "doc_id", "place", F.startswith("line", F.lit("|")).cast("int").alias("head"), F.ltrim("line", F.lit("| ")).alias("sentence")).withColumn("code", F.xxhash64("sentence"))
    # only lines that are a run of words of a known sentence go on; one document's are a group
    held = lines.join(F.broadcast(known), "code").withColumn("n_words", F.size(F.split("sentence", " "))).drop("sentence", "code")
    order = Window.partitionBy("row").orderBy("place")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = held.select("row", "doc_id", "place", "at", "n_words", (F.col("place") - F.row_number().over(order)).alias("run"), F.sum("head").over(upto).alias("block"), (F.sum("n_words").over(upto) - F.col("n_words")).alias("before"))
    # lines in one unbroken run whose words stand at the same distance from a sentence's start make it up
    parts = runs.select("*", F.explode("at").alias("part")).select("row", "doc_id", "place", "run", "block", "n_words", "part.sid", "part.n", (F.col("before") - F.col("part.first")).alias("start"))
    whole = parts.groupBy("row", "doc_id", "run", "block", "sid", "n", "start").agg(F.min("place").alias("place"), F.sum("n_words").alias("words")).where("words = n")
    # a group is one document's known sentences
    known_of = whole.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "sid"))).alias("known"))
    sequence = known_of.select("row", "doc_id", F.transform("known", lambda x: x["sid"]).alias("sids"), F.col("known")[0]["place"].alias("lo"), F.element_at("known", -1)["place"].alias("hi"))
    marked = sequence.select("*", F.explode(F.array_distinct("sids")).alias("first"))
    found = marked.join(F.broadcast(rule), "first").withColumn("n", times_in_order(F.col("sids"), F.col("ids"))).where("n > 0")
    # a document's rules are at most as many as there are
    held_rules = found.groupBy("row", "doc_id").agg(F.collect_list(F.struct("rule", "license", "covers", "n")).alias("rules"), F.min("lo").alias("first_sentence"), F.max("hi").alias("last_sentence"), F.max(F.size("sids")).cast("bigint").alias("n_known"))
    own = "filter(rules, r -> r.n > aggregate(filter(rules, o -> array_contains(r.covers, o.rule)), 0, (n, o) -> n + o.n))"
    licenses = F.array_distinct(F.expr(f"transform({own}, r -> r.license)"))
    return held_rules.select("doc_id", F.explode(licenses).alias("license"), "first_sentence", "last_sentence", "n_known")


def oracle() -> str:
    """The same scan in DuckDB SQL, found another way: the words of every line are counted on, a known
    sentence that begins with a line must end with the line so many words on and read the same, and a
    rule advances from each sentence to the first later one that it names next, and starts again behind its last."""
    quote = lambda x: "'" + str(x).replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {k}, {len(s.split(' '))})" for s, k in known_sentences())
    steps = ", ".join(f"({r}, {quote(name)}, {k}, {sid}, {len(ids)})" for r, (name, _, ids) in enumerate(rules()) for k, sid in enumerate(ids))
    covered = ", ".join(f"({r}, {c})" for r, cs in enumerate(covers()) for c in cs)
    return f"""
with recursive known(sentence, sid, n) as (values {known}),
steps(rule, license, step, sid, n_steps) as (values {steps}),
covered(rule, cover) as (values {covered}),
doc as (select row_number() over () as row_id, doc_id, replace(regexp_replace(regexp_replace(lower(text), '[.!?;](?:[ \t\r\f]+|\n)', chr(10) || chr(10), 'g'), '[^a-z0-9\n]+', ' ', 'g'), chr(10), ' ' || chr(10) || ' ') as t from documents),
raw as (select row_id, doc_id, unnest(ss) as line, unnest(range(len(ss))) as k from (select row_id, doc_id, string_split(t, chr(10)) as ss from doc)),
full_ as (select row_id, doc_id, k, trim(line) as line from raw where trim(line) <> ''),
num as (select *, row_number() over w - 1 as place, case when k - coalesce(lag(k) over w, -9) > 1 then 1 else 0 end as head, len(string_split(line, ' ')) as nw from full_ window w as (partition by row_id order by k)),
cum as (select *, sum(nw) over w as upto, sum(head) over w as block from num window w as (partition by row_id order by place rows unbounded preceding)),
begins as (select c.row_id, c.doc_id, c.place, c.block, c.upto - c.nw as before, sid, n, sentence from cum c join known on starts_with(sentence || ' ', line || ' ')),
ends as (select b.*, e.place as stop from begins b join cum e on e.row_id = b.row_id and e.upto = b.before + b.n and e.block = b.block),
hits as (select e.row_id, e.doc_id, e.place, e.sid from ends e join cum c on c.row_id = e.row_id and c.place between e.place and e.stop group by e.row_id, e.doc_id, e.place, e.sid, e.sentence having string_agg(c.line, ' ' order by c.place) = e.sentence),
span as (select row_id, min(place) as lo, max(place) as hi, count(*) as n_known from hits group by row_id),
walk as (
  select h.row_id, h.doc_id, s.rule, s.step, min(h.place) as place from hits h join steps s on s.sid = h.sid and s.step = 0 group by all
  union all
  select w.row_id, w.doc_id, w.rule, w.step + 1, (select min(h.place) from hits h where h.row_id = w.row_id and h.sid = s.sid and h.place > w.place) as place
  from walk w join steps s on s.rule = w.rule and s.step = (w.step + 1) % s.n_steps where w.place is not null),
held as (select w.row_id, w.doc_id, w.rule, s.license, (max(w.step) + 1) // s.n_steps as n from walk w join steps s on s.rule = w.rule and s.step = 0 where w.place is not null group by w.row_id, w.doc_id, w.rule, s.license, s.n_steps having n > 0)
select distinct on (h.row_id, h.license) h.doc_id, h.license, cast(lo as integer) as first_sentence, cast(hi as integer) as last_sentence, n_known
from held h join span using (row_id) where h.n > (select coalesce(sum(o.n), 0) from held o join covered c on c.cover = o.rule where o.row_id = h.row_id and c.rule = h.rule)
"""
