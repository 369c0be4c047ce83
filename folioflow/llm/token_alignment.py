"""Alignment of two tokenizers' tokens over the same text.

Tokens are byte ranges. The ranges of B go into a static interval index: starts in order and, beside them, how far any range up to
there reaches. For a token of A two bisections give the B ranges that it overlaps: the first that reaches beyond its start, and the last
that starts before its end. Byte offsets that no token of either side spans are group borders.

1. One pass of Arrow batches encodes every text with both tokenizers and leaves, per row, the counts, the digest of the groups and
   the linked id pairs, each once with how often it occurs. That table is written once, so texts are encoded once.
2. A pair's count is the number of rows that hold it: an aggregation, combined in the map tasks, so a pair of nearly every row costs
   what any other does. Pairs come from two vocabularies, so their number stops growing long before the corpus does.
3. Counts go back to the rows. Up to `SENT` pairs are sent to all tasks as two sorted arrays, 16 bytes a pair; more are joined by
   pair. Both ways give the same sums.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._runtime import ship_package, written

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECES = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Pairs sent to all tasks at most (32 MB); more are joined by a shuffle.
SENT = 2_000_000
#: Characters encoded and aligned at a time in a task.
SLICE = 1_000_000
SPACE = "▁"
# The word split of byte-level vocabularies, as a file states it and as a pattern.
PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RESULT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


class IntervalIndex:
    """Static index over half-open ranges: which overlap [start, end)? Ranges are kept by start; `reach` is the greatest end up to
    each, so it never falls and can be bisected. Where ranges tile their span, as tokens do, every range found overlaps; in
    general those found are the overlapping ones and some between them that end before."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray) -> None:
        self.order = np.lexsort((ends, starts))
        self.starts, self.ends = starts[self.order], ends[self.order]
        self.reach = np.maximum.accumulate(self.ends) if len(ends) else self.ends

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one behind the last place, in the index's order, of the ranges that may overlap each query."""
        low = np.searchsorted(self.reach, starts, "right")
        return low, np.maximum(low, np.searchsorted(self.starts, ends, "left"))

    def overlaps(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, range) of all overlaps, by query and then by start; empty ranges overlap nothing."""
        low, high = self.spans(starts, ends)
        n = high - low
        query = np.repeat(np.arange(len(starts)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        real = (self.ends[at] > starts[query]) & (self.ends[at] > self.starts[at]) & (ends[query] > starts[query])
        return query[real], self.order[at[real]]


def unspanned(*ends: np.ndarray) -> np.ndarray:
    """Offsets at which tokens of every side end: no token spans them, so groups end there."""
    common = _distinct(np.sort(ends[0]))
    for more in ends[1:]:
        more = np.sort(more)
        if not len(more):
            return more
        at = np.minimum(np.searchsorted(more, common), len(more) - 1)
        common = common[more[at] == common]
    return common


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values of a sorted array."""
    return x[_firsts(x)]


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where a sorted array has a value for the first time."""
    first = np.ones(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    return first


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable bytes as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Bytes, byte lengths and, for the group texts, decimal forms of a tokenizer's ids."""

    def __init__(self, entries: list[bytes]) -> None:
        self.entries = entries
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.forms = np.array([[f"{i}{mark}" for i in range(len(entries))] for mark in ",|;"], object)

    def joined(self, ids: list[int]) -> bytes:
        entries = self.entries
        return b"".join([entries[i] for i in ids])


def byte_encoder(byte_bpe: bytes, entries: list[bytes]) -> Callable[[list[str]], list[list[int]]]:
    """Ids of texts by a byte-level vocabulary file, special tokens being plain text. Where the file is of the plain kind, its ids the
    bytes and then the merges in their order, ids are ranks and the rank encoder gives the same ids in a fourth of the time."""
    import tiktoken
    from tokenizers import Tokenizer

    file = json.loads(byte_bpe)
    model, added = file["model"], {t["id"] for t in file.get("added_tokens", [])}
    merged = [model["vocab"].get(m.replace(" ", "") if isinstance(m, str) else "".join(m)) for m in model.get("merges", [])]
    alphabet = byte_alphabet()
    plain = (
        file.get("normalizer") is None and file.get("pre_tokenizer") == PLAIN_SPLIT and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and sorted(model["vocab"][c] for c in alphabet) == list(range(256)) and merged == list(range(256, 256 + len(merged)))
    )
    if plain:
        ranks = {e: i for i, e in enumerate(entries) if i not in added}
        ranked = tiktoken.Encoding("byte-bpe", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [ranked.encode_ordinary(t) for t in texts]
    whole = Tokenizer.from_buffer(byte_bpe)
    whole.encode_special_tokens = True
    return lambda texts: [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]


class Pair:
    """The two tokenizers and their vocabularies."""

    def __init__(self, byte_bpe: bytes, pieces: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        first, alphabet = Tokenizer.from_buffer(byte_bpe), byte_alphabet()
        names = [first.id_to_token(i) or "" for i in range(first.get_vocab_size())]
        added = {t["id"]: t["content"].encode() for t in json.loads(byte_bpe).get("added_tokens", [])}
        self.a = Vocabulary([added[i] if i in added else bytes(alphabet[c] for c in n) for i, n in enumerate(names)])
        self.first = byte_encoder(byte_bpe, self.a.entries)
        self.second = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        p = self.second
        self.b = Vocabulary([bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace(SPACE, " ").encode() for i in range(p.get_piece_size())])

    def encode(self, texts: list[bytes]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both sides for each text; None where a side's bytes are not those of space and text."""
        plain = [t.decode("utf-8", "replace") for t in texts]
        left = self.first([" " + t for t in plain])
        right = self.second.encode(plain, num_threads=1)
        out = []
        for text, x, y in zip(texts, left, right, strict=True):
            whole = b" " + text
            out.append((x, y) if self.a.joined(x) == whole and self.b.joined(y) == whole else None)
        return out

    def align(self, texts: list[bytes]) -> tuple[list, ...]:
        """The columns of RESULT for texts: None or empty ones have no tokens."""
        encoded = self.encode([t for t in texts if t]) if any(texts) else []
        taken = iter(encoded)
        both = [next(taken) if t else None for t in texts]
        none = np.zeros(0, np.int64)
        ids = [np.concatenate([none, *[np.asarray(e[k], np.int64) for e in both if e]]) for k in (0, 1)]
        n = [np.array([len(e[k]) if e else 0 for e in both], np.int64) for k in (0, 1)]
        # all texts of the slice lie behind one another, so one index serves them; every text ends at a border
        ends = [np.cumsum(v.lengths[i]) for v, i in zip((self.a, self.b), ids, strict=True)]
        starts = [e - v.lengths[i] for e, v, i in zip(ends, (self.a, self.b), ids, strict=True)]
        size = np.array([len(t) + 1 if e else 0 for t, e in zip(texts, both, strict=True)], np.int64)
        stops = np.cumsum(size)
        border = unspanned(*ends)
        query, met = IntervalIndex(starts[1], ends[1]).overlaps(starts[0], ends[0])
        row = np.repeat(np.arange(len(texts)), n[0])[query]
        links = np.bincount(row, minlength=len(texts))
        per = len(self.a.entries) * len(self.b.entries)
        keys = np.sort(row * per + ids[0][query] * len(self.b.entries) + ids[1][met])
        begins = np.flatnonzero(_firsts(keys))
        keys, times = keys[begins], np.diff(begins, append=len(keys))
        cut = np.searchsorted(keys, np.arange(len(texts) + 1) * per)
        pairs = keys % per
        codes = (pairs // len(self.b.entries) << 32) | pairs % len(self.b.entries)
        groups = np.searchsorted(border, stops, "right")
        groups = np.diff(groups, prepend=0)
        digests, at = [], 0
        forms = self._forms(ids, ends, border)
        for x, y in zip(*n, strict=True):
            digests.append(hashlib.sha256("".join(forms[at : at + x + y])[:-1].encode()).hexdigest() if x else "")
            at += x + y
        return n[0], n[1], groups, links, digests, (cut, codes), (cut, times)

    def _forms(self, ids: list[np.ndarray], ends: list[np.ndarray], border: np.ndarray) -> list[str]:
        """Ids in decimal, group by group, A before B, each with the mark behind it."""
        group = [np.searchsorted(border, e) for e in ends]
        count = [np.bincount(g, minlength=len(border)) for g in group]
        out = np.empty(len(ids[0]) + len(ids[1]), object)
        before_b, before_a = np.cumsum(count[1]) - count[1], np.cumsum(count[0])
        for v, i, e, g, shift, mark in zip((self.a, self.b), ids, ends, group, (before_b, before_a), (1, 2), strict=True):
            closes = border[g] == e if len(g) else np.zeros(0, bool)
            out[np.arange(len(i)) + shift[g]] = v.forms[np.where(closes, mark, 0), i]
        return out.tolist()


@lru_cache(maxsize=2)
def pair_of(byte_bpe: bytes, pieces: bytes) -> Pair:
    return Pair(byte_bpe, pieces)


def _slices(batch: pa.Array) -> Iterator[list[bytes]]:
    held, size = [], 0
    for x in batch:
        held.append(x.as_buffer().to_pybytes() if x.is_valid else b"")
        size += len(held[-1])
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _list(cut: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values, kind))


def aligned(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """(id columns of docs without text) and the columns of RESULT for each row of docs (…, text)."""
    first, second = _read(byte_bpe), _read(pieces)

    @arrow_udf(f"struct<{','.join(f.replace(' ', ':', 1) for f in RESULT.split(', '))}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        both = pair_of(first, second)
        for batch in batches:
            parts = []
            for texts in _slices(batch):
                a, b, groups, links, digests, codes, times = both.align(texts)
                arrays = [pa.array(x, pa.int64()) for x in (a, b, groups, links)] + [pa.array(digests, pa.string()), _list(*codes, pa.int64()), _list(*times, pa.int32())]
                parts.append(pa.StructArray.from_arrays(arrays, [f.split()[0] for f in RESULT.split(", ")]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([]))

    return docs.withColumn("_a", run(F.col("text").cast("binary"))).drop("text").select("*", "_a.*").drop("_a")


def _read(path: str) -> bytes:
    """A tokenizer's file; it is small and goes to the tasks with the function."""
    with open(path, "rb") as f:
        return f.read()


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, count, best) over rows with distinct `pairs` each: how many rows hold the pair, and whether that is the highest count
    of its A id."""
    counts = table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")).withColumn("a", F.shiftrightunsigned("pair", 32))
    counts = written(counts, "pairs")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _sent(table: DataFrame, counts: DataFrame) -> DataFrame:
    """(…, n_best, count_sum) by arrays that every task holds."""
    got = counts.orderBy("pair").toArrow()
    keys = table.sparkSession.sparkContext.broadcast((got["pair"].to_numpy(), got["count"].to_numpy(), got["best"].to_numpy().astype(np.int64)))

    @arrow_udf("struct<n_best:bigint,count_sum:bigint>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        pair, count, best = keys.value
        for pairs, times in batches:
            cut = np.concatenate([[0], np.cumsum(np.asarray(pairs.value_lengths().to_numpy(zero_copy_only=False), np.int64))])
            at, k = np.searchsorted(pair, pairs.flatten().to_numpy()), times.flatten().to_numpy().astype(np.int64)
            sums = [np.diff(np.concatenate([[0], np.cumsum(v[at] * k)])[cut]) for v in (best, count)] if len(k) else [np.zeros(len(pairs), np.int64)] * 2
            yield pa.StructArray.from_arrays([pa.array(s, pa.int64()) for s in sums], ["n_best", "count_sum"])

    return table.withColumn("_s", run("pairs", "times")).select("*", "_s.*").drop("_s")


def _joined(table: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join on the pair; a pair of many rows is one row on the other side, so adaptive execution can split it."""
    links = table.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("_row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("k"))
    sums = links.join(counts, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("k")).alias("count_sum"))
    return table.join(sums, "_row", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_best", "count_sum")})


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES, sent: int = SENT) -> DataFrame:
    """One row per row of docs: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    Null and empty texts, and texts that either tokenizer does not give back byte for byte behind a space (U+2581 or broken UTF-8 in
    them, for instance), have zeros and an empty digest column. Rows count as documents of their own, so null and repeated ids are as any
    other; an empty table stays empty; other columns are not read.
    """
    ship_package(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table = written(aligned(read, byte_bpe, pieces).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(table), "counts")
    out = _sent(table, counts) if counts.count() <= sent else _joined(table, counts)
    return out.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
