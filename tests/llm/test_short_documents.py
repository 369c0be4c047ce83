"""Benchmark items in documents that have fewer words than the item."""

from __future__ import annotations

import random
from collections import Counter

from folioflow.llm import decontaminate

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_documents_shorter_than_the_item(spark):
    rng = random.Random(5)
    items = [(k, " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(60)}" for _ in range(n))) for k, n in enumerate([1, 3, 5, 6, 12, 30, 50, 50, 51])]
    items.append((99, " ".join(items[6][1].split()[:44])))
    texts = []
    for _, item in items:
        ws = item.split()
        for cut in range(13):
            texts += [" ".join(ws[: len(ws) - cut]), " ".join(ws[cut // 2 : len(ws) - cut // 2]).upper()]
        if len(ws) > 20:
            ws[7] = "changed"
            texts.append(" ".join(ws[1:]))
    index, want = decontaminate.Items(items), {}
    for d, text in enumerate(texts):
        h = decontaminate.word_hashes(decontaminate.words(text.encode()))
        for k, item in enumerate(index.ids):
            n = len(dict(items)[item].split())
            size = min(5, n)
            codes = decontaminate.shingle_hashes(h, size).tolist()
            run = min(n - size + 1, len(codes))
            if codes:
                best = max(decontaminate.similarity(Counter(codes[s : s + run]), index.counts[k], index.weight) for s in range(len(codes) - run + 1))
                if best >= 0.8:
                    want[d, item] = round(best, 9)
    table = spark.createDataFrame([(d, t, "en", "src", len(t)) for d, t in enumerate(texts)], DOCS)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find_leaks(table, benchmark).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == want
    short = [r for r in got if len(texts[r.doc_id].split()) < len(dict(items)[r.item_id].split())]
    assert len(short) > 20 and all(r.word == 0 and r.n_words == len(texts[r.doc_id].split()) for r in short)
    leaks = {d for d, _ in want}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(table, benchmark).collect()) == [d for d in range(len(texts)) if d not in leaks]
