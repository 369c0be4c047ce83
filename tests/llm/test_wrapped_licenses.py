"""Licenses in their usual wrapped form."""

from __future__ import annotations

import random
import textwrap

import pytest

from folioflow.llm import license_scan

RULES = sorted({(name, ids) for name, ids in license_scan.RULES})
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {(r["doc_id"], r["license"]) for r in license_scan.scan_licenses(docs).collect()}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_standard_texts(spark, end):
    assert scan(spark, [APACHE.replace("\n", end), BSD.replace("\n", end)]) == {(0, "Apache-2.0"), (1, "BSD-2-Clause")}


def test_every_rule_at_every_width(spark):
    texts, names = [], []
    for width in (24, 50, 72, 79):
        for prefix in ("", "# ", " * "):
            for name, ids in RULES:
                texts.append("Some words\n\n" + f"\n{prefix}\n".join(textwrap.fill(license_scan.SENTENCES[x], width, initial_indent=prefix, subsequent_indent=prefix, break_long_words=False) for x in ids) + "\n\nother words")
                names.append(name)
    found = scan(spark, texts)
    assert [k for k, name in enumerate(names) if (k, name) not in found] == []


def test_not_over_gaps_or_marks(spark):
    assert scan(spark, ["This work is licensed\n\nunder the GNU General Public License, version 3.", "Released under.\nthe MIT License.", "Released\nunder x\nthe MIT License.", "Released under\nunder the MIT License."]) == set()


def test_against_sql(spark):
    """Wrapped, commented, shuffled and interrupted sentences, against the SQL that finds them another way."""
    duckdb, pd = pytest.importorskip("duckdb"), pytest.importorskip("pandas")
    rng, texts = random.Random(3), [None, "", "\n\n", "mit"]
    for _ in range(150):
        ids = list(rng.choice(RULES)[1]) + [x for _ in range(rng.randint(0, 3)) for x in rng.choice(RULES)[1]]
        if rng.random() < 0.5:
            rng.shuffle(ids)
        prefix, out = rng.choice(["", "# ", " * ", "// "]), []
        for x in ids:
            lines = textwrap.wrap(license_scan.SENTENCES[x], rng.choice([20, 40, 72, 500]), break_long_words=False)
            if rng.random() < 0.1:
                lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", "other words", lines[0]]))
            out += [prefix + y for y in lines] + rng.choice([[], [""], [prefix.rstrip()], ["Copyright 2020"]])
        texts.append(rng.choice(["\n", "\n", "\r\n"]).join(out))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(tuple(r) for r in license_scan.scan_licenses(docs).collect())
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(list(enumerate(texts)), columns=["doc_id", "text"]))
    want = con.execute(f"select doc_id, license, first_sentence, last_sentence, n_known from ({license_scan.oracle()})").fetchall()
    assert len(got) > 60 and got == sorted(want)


def test_a_notices_file_of_many_sentences(spark):
    s = license_scan.SENTENCES
    body = [s["bsd-use"], *[s["bsd-source"]] * 20_000, s["mit-short"], *[s["bsd-use"]] * 5_000, s["bsd-binary"]]
    assert scan(spark, ["\n".join(body), "\n".join(reversed(body))]) == {(0, "BSD-2-Clause"), (0, "MIT"), (1, "MIT")}


def test_a_covered_rule_goes_unless_it_stands_there_too(spark):
    body = {ids: "\n".join(license_scan.SENTENCES[x] for x in ids) for _, ids in RULES}
    two, three = (body[ids] for name, ids in RULES if name.startswith("BSD") and len(ids) > 1)
    whole = next(body[ids] for name, ids in RULES if name == "GPL-3.0-only" and "gpl-notice" in ids)
    notice = next(body[ids] for name, ids in RULES if name == "GPL-3.0-or-later" and "gpl-notice" in ids)
    texts = [three, two, three + "\n" + three, two + "\n" + three, three + "\n" + two, whole, notice + "\n" + whole, notice]
    bsd, gpl = {"BSD-2-Clause", "BSD-3-Clause"}, {"GPL-3.0-only", "GPL-3.0-or-later"}
    want = [{"BSD-3-Clause"}, {"BSD-2-Clause"}, {"BSD-3-Clause"}, bsd, bsd, {"GPL-3.0-only"}, gpl, {"GPL-3.0-or-later"}]
    assert scan(spark, texts) == {(k, name) for k, names in enumerate(want) for name in names}
