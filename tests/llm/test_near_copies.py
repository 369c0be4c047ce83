"""The near-copy stage against brute-force Jaccard similarity of five-word shingles."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from folioflow.llm import simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], DOCS).repartition(5)


def shingles(text):
    ws = (text or "").encode().lower().split()
    return frozenset(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset()


def near(a, b):
    return a == b or bool(a | b) and 10 * len(a & b) >= 8 * len(a | b)


def brute(rows):
    """Smallest id of each component, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near(sets[i], sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(words) for _ in range(40)]
    texts = [None, "", " \n", "word", "Word", "two words", "two other"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([4, 9, 60, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6, 12])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy[rng.choice([0, 0, 3]) :]).upper() if rng.random() < 0.3 else " ".join(copy))
    for _ in range(30):  # one passage in texts that are no copies
        own = [rng.choice(words) for _ in range(rng.choice([3, 20]))]
        texts.append(" ".join(own + passage))
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("crowd", "sample"), [(64, 64), (3, 2)])
def test_stage_against_brute_force(spark, crowd, sample):
    from folioflow.llm import copies

    rows = corpus(11)
    got = copies.keep_one(docs(spark, rows), crowd=crowd, sample=sample)
    assert got.columns == docs(spark, []).columns
    assert sorted(r.doc_id for r in got.collect()) == brute(rows)


def test_stage_drops_a_text_with_three_edited_words(spark):
    base = [f"a{k}" for k in range(150)]
    copy = list(base)
    for k in (20, 70, 120):
        copy[k] = "edit"
    table = docs(spark, [(1, " ".join(base)), (2, " ".join(copy))])
    a, b = (simhash.fingerprint(" ".join(x).encode()) for x in (base, copy))
    assert (a ^ b).bit_count() > simhash.RADIUS
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, table, "").collect()] == [1]


def test_clashing_and_missing_ids(spark):
    one, other, third = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    kept = simhash.keep_one(docs(spark, [(7, one), (7, other), (7, other), (3, one), (None, third), (None, third), (None, one)]))
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, third), (3, one), (7, other)]
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_parity_never_exceeds_what_two_sets_do_not_share():
    import numpy as np

    from folioflow.llm import copies

    rng = np.random.default_rng(3)
    for n, kept in ((0, 0), (1, 1), (30, 20), (400, 380), (3000, 100)):
        a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        b = np.unique(np.concatenate([a[:kept], rng.integers(0, 1 << 64, n - kept, dtype=np.uint64)]))
        turned = sum(int(x & 0xFFFFFFFFFFFFFFFF).bit_count() for x in (copies.parity_of(np.unique(a)) ^ copies.parity_of(b)).tolist())
        assert len(copies.parity_of(b)) == copies.PARITY and turned <= len(np.setxor1d(a, b)) and (n == kept) == (turned == 0)


def test_stage_takes_fingerprints_through_the_pivot_tables(spark, monkeypatch):
    from folioflow.llm import copies

    rng = random.Random(23)
    base = [f"b{k}" for k in range(900)]
    texts = [" ".join(base), None, ""]
    for _ in range(12):  # one word of 900: few bits turn
        copy = list(base)
        copy[rng.randrange(900)] = "edit"
        texts.append(" ".join(copy))
    texts += [" ".join(rng.choice(base) for _ in range(60)) for _ in range(20)]
    sets = {copies.key_of(s): simhash.majority(s) for s in (copies.shingle_set((t or "").encode()) for t in texts)}
    seen, pivots = [], simhash.pivot_table
    monkeypatch.setattr(simhash, "pivot_table", lambda prints: seen.extend(r.fp % (1 << 64) for r in prints.collect()) or pivots(prints))
    table = docs(spark, list(enumerate(texts)))
    classes = {r.id: r.component for r in copies.near_copies(table).collect()}
    assert sorted(seen) == sorted(set(sets.values()))
    assert len({classes[i] for i in (0, *range(3, 15))}) == 1 and len(set(classes.values())) == 22
    prints = spark.createDataFrame([(k, simhash.signed(f)) for k, f in sets.items()], "key bigint, fp bigint")
    for crowd in (1, 64):
        root = {k: k for k in sets}
        for r in copies.by_fingerprint(prints, crowd).collect():
            assert (sets[r.a] ^ sets[r.b]).bit_count() <= simhash.RADIUS
            a, b = root[r.a], root[r.b]
            root = {k: a if v == b else v for k, v in root.items()}
        for a in sets:
            for b in sets:
                assert root[a] == root[b] or (sets[a] ^ sets[b]).bit_count() > simhash.RADIUS
    assert len(set(root.values())) < len(sets)
