"""Token alignment, conversation repair and exact duplicates against brute force and on edge cases."""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import conversations, exact_dedup, queries, token_alignment

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, n bigint, keep string, hash string, `a.b` int, tags map<string,string>"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", "y", k % 2, {"a": "b"}) for k, (i, t) in enumerate(rows)], DOCS)


# --- exact duplicates ----------------------------------------------------------------------

TEXTS = [None, "", "a", "A", "a ", "b", "é", "é", "long " * 4000, "long " * 3999 + "lonG "]


def expected(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        group = groups[t or ""]
        kept = keep([x for x in group if x is not None], default=None)
        out.append((i, kept, len(group), i == kept, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda t: F.unhex(F.hex(F.length(t) % 3))], ids=["md5", "colliding"])
@pytest.mark.parametrize("keep", [(min, F.min), (max, F.max)], ids=["smallest", "largest"])
def test_exact_duplicates(spark, hashed, keep):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(400)]), rng.choice(TEXTS)) for _ in range(300)] + [(1000 + k, "hot") for k in range(600)]
    table = docs(spark, rows).repartition(7)
    found = exact_dedup.exact_duplicates(table, keep=keep[1], hashed=hashed)
    assert found.columns == ["id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(rows, keep[0])
    stay = exact_dedup.keep_one(table, keep=keep[1], hashed=hashed)
    assert stay.columns == table.columns
    got = stay.collect()
    assert sorted((r.text or "", r.doc_id) for r in got) == sorted({(t or "", k) for (i, t) in rows for k in [expected_keep(rows, t, keep[0])]})
    assert len(got) == len({t or "" for _, t in rows})


def expected_keep(rows, text, keep):
    return keep([i for i, t in rows if (t or "") == (text or "") and i is not None], default=None)


def test_exact_duplicates_without_rows_or_ids(spark):
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0
    assert exact_dedup.keep_one(docs(spark, [])).count() == 0
    rows = [(None, "a"), (None, "a")]
    assert [tuple(r)[:4] for r in exact_dedup.exact_duplicates(docs(spark, rows)).collect()] == [(None, None, 2, True)] * 2
    assert exact_dedup.keep_one(docs(spark, rows)).count() == 1


def test_exact_duplicates_stay_in_the_jvm(spark):
    plan = exact_dedup.exact_duplicates(docs(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- conversations -------------------------------------------------------------------------

CONV = "conv_id bigint, turn bigint, role string, text string, n int, seg int"


def faults(rows):
    """(turn, role, text, fault) in order."""
    rows = sorted([(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, out = set(), []
    for t, r, x in rows:
        bare = x.strip(" \t\n\x0b\x0c\r")
        out.append((t, r, x, 1 if not bare else 2 if (r, x) in seen else 0 if bare[-1] in ".!?" else 3))
        seen.add((r, x))
    return out


def cheapest(rows):
    """All edit strings with at most two insertions in a gap, tried one by one: least (cost, audit) and its lines."""
    best = None

    def go(k, cost, audit, lines, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if k == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(x[0][:1] or "?" for x in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, ["%s:%s" % x for x in lines])
        else:
            _, role, text, fault = rows[k]
            extra = fault == 3
            if fault not in (1, 2):
                go(k + 1, cost + extra, audit + "K", [*lines, (role, text)], 0)
                for other in ("user", "assistant"):
                    go(k + 1, cost + 2 + extra, audit + "R", [*lines, (other, text)], 0)
            go(k + 1, cost + 3, audit + "D", lines, 0)
        if inserted < 2:
            for role in ("user", "assistant"):
                go(k, cost + 2, audit + "I", [*lines, (role, "")], inserted + 1)

    go(0, 0, "", [], 0)
    return best


def repaired(conv, given):
    rows = faults(given)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _, _ in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    cost, audit, lines = cheapest(rows)
    counts = Counter(f for *_, f in rows)
    return (conv, gaps, counts[1], counts[2], counts[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.mark.parametrize(("piece", "limit"), [(256, 8192), (2, 3), (1, 1)])
def test_conversations_against_every_edit(spark, piece, limit):
    rng = random.Random(11)
    given = {}
    for conv in [None, *range(70)]:
        given[conv] = [(rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), rng.choice(["Hi.", "Yes!", "no", "ok \n", "What? ", "", " ", None])) for _ in range(rng.randint(1, 5))]
    rows = [(c, *r, 1, 2) for c, some in given.items() for r in some]
    rng.shuffle(rows)
    found = conversations.repair_conversations(spark.createDataFrame(rows, CONV), piece, limit)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted((repaired(c, some) for c, some in given.items()), key=repr)


def test_long_conversations_in_pieces(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system"]), f"{rng.randint(0, 60)}{rng.choice(['.', '', '!'])}", 1, 2) for c in range(3) for t in range(700)]
    table = spark.createDataFrame(rows, CONV)
    whole, parts = (sorted(map(tuple, conversations.repair_conversations(table, p, n).collect())) for p, n in ((5000, 100_000), (37, 100)))
    assert whole == parts and all(len(r[7]) >= 700 for r in whole)


def test_conversations_without_rows(spark):
    assert conversations.repair_conversations(spark.createDataFrame([], CONV)).count() == 0
    table = spark.createDataFrame([(4, 0, "user", "x", True), (5, 0, "user", "x.", False), (5, 1, "user", "x.", True)], "conv_id bigint, turn bigint, role string, text string, gone boolean")
    got = sorted(map(tuple, conversations.repair_conversations(table).collect()))
    assert got[0] == (4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[1] == (5, 0, 0, 0, 0, 0, 2, "KI", hashlib.sha256(b"user:x.\nassistant:").hexdigest())


def test_damage(spark):
    rows = [(c, t, r, x, 1, 2) for c in [None, *range(60)] for t, r, x in [(None, None, None), (0, "system", "Be. kind!"), (1, "assistant", "A? b")]]
    got = defaultdict(list)
    for r in conversations.damage(spark.createDataFrame(rows, CONV)).collect():
        got[(r.conv_id, r.turn)].append((r.role, r.text, r.gone))
    for c, t, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = {0: "", 1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        assert got[(c, t)] == [("user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)


# --- token alignment -----------------------------------------------------------------------

ODD = [None, "", " ", "word", "Two  words\n\n", "▁", "É日本 🙂 <s> <0x41> <|endoftext|> </s>", "aaaa" * 300, "a\x00b\tc", "x=1;" * 200, "word", "don't can't 1234567"]


def align_plainly(both, text):
    """Groups, links and counts of one text, comparing every token of A with every token of B."""
    encoded = both.encode([text.encode()])[0] if text else None
    if encoded is None:
        return None
    ids, vocabularies, ranges = encoded, (both.a, both.b), []
    for v, side in zip(vocabularies, ids, strict=True):
        at, spans = 0, []
        for i in side:
            spans.append((at, at + len(v.entries[i])))
            at = spans[-1][1]
        ranges.append(spans)
    links = [(ids[0][i], ids[1][j]) for i, (s, e) in enumerate(ranges[0]) for j, (p, q) in enumerate(ranges[1]) if s < q and p < e]
    border = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
    groups, start = [], 0
    for stop in border:
        groups.append("|".join(",".join(str(i) for i, (s, e) in zip(side, spans, strict=True) if start < e <= stop) for side, spans in zip(ids, ranges, strict=True)))
        start = stop
    return ids, groups, links


@pytest.mark.parametrize("sent", [token_alignment.SENT, 0], ids=["sent", "joined"])
def test_alignment_against_all_pairs(spark, sent):
    rng = random.Random(8)
    texts = ODD + ["".join(rng.choice("aeiou tnrs\n.,é日🙂0") for _ in range(rng.randint(1, 200))) for _ in range(40)]
    rows = [(k % 45 or None, t) for k, t in enumerate(texts)]
    both = token_alignment.pair_of(token_alignment._read(token_alignment.BYTE_BPE), token_alignment._read(token_alignment.PIECES))
    plain = [align_plainly(both, t) for t in texts]
    counts = Counter(p for x in plain if x for p in set(x[2]))
    most = defaultdict(int)
    for (a, _), k in counts.items():
        most[a] = max(most[a], k)
    want = []
    for (i, _), x in zip(rows, plain, strict=True):
        if x is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            (a, b), groups, links = x
            want.append((i, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    assert want[5][1] == 0 and want[6][1] > 0  # the marker itself cannot be told from a space
    found = token_alignment.align_documents(docs(spark, rows), sent=sent)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(want, key=repr)
    assert token_alignment.align_documents(docs(spark, []), sent=sent).count() == 0
    assert token_alignment.align_documents(docs(spark, [(1, None)]), sent=sent).first().n_links == 0


def test_token_bytes_are_those_of_the_text():
    both = token_alignment.pair_of(token_alignment._read(token_alignment.BYTE_BPE), token_alignment._read(token_alignment.PIECES))
    text = "".join(map(chr, [*range(1, 0x250), 0x4E00, 0x1F642]))
    assert both.encode([text.encode()])[0] is not None
    assert both.encode([b"\xff broken"])[0] is None
    assert both.a.entries[50256] == b"<|endoftext|>"


def test_rank_encoder_is_the_file_s_encoder():
    from tokenizers import Tokenizer

    file = token_alignment._read(token_alignment.BYTE_BPE)
    both = token_alignment.pair_of(file, token_alignment._read(token_alignment.PIECES))
    plain = Tokenizer.from_buffer(file)
    plain.encode_special_tokens = True
    rng = random.Random(4)
    texts = [" " + (t or "") for t in ODD] + ["".join(chr(rng.choice([rng.randint(1, 127), 32, 10, rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    assert both.first(texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    # a file of another kind goes the general way
    other = json.loads(file)
    other["pre_tokenizer"]["add_prefix_space"] = True
    other = json.dumps(other).encode()
    assert token_alignment.byte_encoder(other, both.a.entries)(["word", " word"]) == both.first([" word", " word"])


def test_interval_index_against_all_pairs():
    rng = np.random.default_rng(2)
    for n in [0, 1, 2, 17, 60]:
        starts = rng.integers(0, 50, n)
        ends = starts + rng.integers(0, 12, n)
        qs = rng.integers(-3, 55, 40)
        qe = qs + rng.integers(0, 9, 40)
        got = token_alignment.IntervalIndex(starts, ends).overlaps(qs, qe)
        want = {(i, j) for i in range(40) for j in range(n) if qs[i] < ends[j] and starts[j] < qe[i] and qs[i] < qe[i] and starts[j] < ends[j]}
        assert len(got[0]) == len(want) and set(zip(got[0].tolist(), got[1].tolist())) == want
    assert token_alignment.unspanned(np.array([2, 5, 9]), np.array([5, 7, 9])).tolist() == [5, 9]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the small tables")
@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_exact_dedup"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(map(repr, got[order].values.tolist())) == sorted(map(repr, want[order].values.tolist()))
