"""SentencePiece encoding with sampled segmentations, and its lossless inverse.

A text becomes a lattice: spaces turn into the marker, one marker is put in front, and every
vocabulary piece that fits at a place is an edge; a character outside the vocabulary is an edge
of its UTF-8 bytes. No piece holds a marker behind another character, so the lattice falls
apart at every space behind a word, and equal chunks have equal lattices. A chunk of over `LONG` characters
is cut further wherever no piece holds the two characters side by side, which changes no probability. Per batch each
distinct chunk's forward sums are filtered once; then all its occurrences draw their last
piece, the piece before it and so on by the forward probabilities (forward filtering,
backward sampling). Every draw is a hash of the row's key and the draw's place, so a row's
segmentation does not depend on partitions, batches or retries.

A piece's probability is 1 / (rank + 2) to the power `alpha`, rank its place in the merge
order, since the model's scores are ranks and no likelihoods. Large alpha tends to the best
segmentation. Decoding joins pieces and byte runs: it returns the text for every sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._runtime import ship_package

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
#: Characters of the texts that are worked on at once in a task.
SLICE = 1_000_000
#: Characters of a chunk that is not cut further.
LONG = 32
#: Columns of the dense part of the prefix tree.
DENSE = 128
MARK = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message, by wire type 0, 1, 2 and 5."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def pieces_of(model: bytes) -> list[tuple[str, int]]:
    """(piece, type) of a serialised model, in id order. Types: 1 normal, 6 byte."""
    out = []
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            out.append((piece[1].decode("utf-8"), piece.get(3, 1)))
    return out


class Lattice:
    """Piece table of a model, and sampling over batches of texts.

    Inside, the marker is a space, so a marker character in a text is an unknown character.
    """

    def __init__(self, pieces: list[tuple[str, int]], alpha: float = ALPHA) -> None:
        self.names = [p.replace(MARK, " ") for p, _ in pieces]
        self.byte_ids = np.zeros(256, np.int32)
        of_byte = {int(p[3:5], 16): i for i, (p, kind) in enumerate(pieces) if kind == 6}
        normal = [(self.names[i], i) for i, (p, kind) in enumerate(pieces) if kind == 1]
        if len(of_byte) < 256 or any(" " in p.lstrip(" ") for p, _ in normal):
            raise ValueError("the model needs byte pieces, and no marker behind another character")
        self.byte_ids[list(of_byte)] = list(of_byte.values())
        self.byte_of = {i: b for b, i in of_byte.items()}
        self.is_byte, self.name_of = np.zeros(len(pieces), bool), np.array(self.names, object)
        self.is_byte[list(self.byte_of)] = True
        # prefix tree: state 0 is dead, 1 the root; columns of `dense` are the commonest characters
        children: dict[tuple[int, str], int] = {}
        self.piece, weight = [-1, -1], [0.0, 0.0]
        for rank, (p, i) in enumerate(normal):
            at = 1
            for c in p:
                if (nxt := children.get((at, c))) is None:
                    nxt = children[at, c] = len(self.piece)
                    self.piece.append(-1)
                    weight.append(0.0)
                at = nxt
            self.piece[at], weight[at] = i, (rank + 2.0) ** -alpha
        self.piece, self.weight = np.array(self.piece, np.int32), np.array(weight)
        often: dict[str, int] = {}
        for _, c in children:
            often[c] = often.get(c, 0) + 1
        self.letters = {c: k + 1 for k, c in enumerate(sorted(often, key=lambda c: (-often[c], c)))}
        self.code = np.zeros(0x110000, np.int16)
        self.code[[ord(c) for c in self.letters]] = list(self.letters.values())
        self.dense = np.zeros((len(self.piece), DENSE), np.int32)
        rare = {}
        for (at, c), nxt in children.items():
            if (k := self.letters[c]) < DENSE:
                self.dense[at, k] = nxt
            else:
                rare[at << 16 | k] = nxt
        # pairs of characters that stand side by side in some piece
        self.joints = np.unique(np.array([self.letters[a] << 16 | self.letters[b] for p, _ in normal for a, b in zip(p, p[1:], strict=False)] or [-1], np.int64))
        self.rare_keys = np.array(sorted(rare) or [-1], np.int64)
        self.rare_next = np.array([rare[k] for k in sorted(rare)] or [0], np.int32)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Next states; letter 0 is outside the vocabulary."""
        out = self.dense[state, np.minimum(letter, DENSE - 1)]
        far = np.flatnonzero(letter >= DENSE - 1)
        if len(far):
            keys = state[far].astype(np.int64) << 16 | letter[far]
            at = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
            out[far] = np.where(self.rare_keys[at] == keys, self.rare_next[at], np.where(letter[far] == DENSE - 1, out[far], 0))
        return out

    def parts(self, text: str) -> list[str | tuple[str]]:
        """Chunks of a text: those of split(), without their first space, and in tuples what is cut off from
        long ones, which have none."""
        chunks = split(text)
        if max(map(len, chunks)) <= LONG:
            return chunks
        out: list[str | tuple[str]] = []
        for c in chunks:
            if len(c) <= LONG:
                out.append(c)
                continue
            whole = " " + c
            codes = self.code[np.frombuffer(whole.encode("utf-32-le"), np.uint32)].astype(np.int64)
            keys = codes[:-1] << 16 | codes[1:]
            at = np.minimum(np.searchsorted(self.joints, keys), len(self.joints) - 1)
            cuts = [0, *(np.flatnonzero(self.joints[at] != keys) + 1).tolist(), len(whole)]
            out.append(whole[1 : cuts[1]])
            out += [(whole[a:b],) for a, b in zip(cuts[1:], cuts[2:], strict=False)]
        return out

    def filtered(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward filtering of distinct chunks, longest first.

        Returns base: node (j, t), the place behind character j of chunk t, is base[j - 1] + t; and
        for every node its first edge, then for the edges their piece (-1: an unknown character),
        length, and cumulative probability given the node, longer pieces first.
        """
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        n, longest = len(chunks), int(sizes[0])
        flat = self.code[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        begin = np.cumsum(sizes) - sizes
        live = np.searchsorted(-sizes, -np.arange(longest + 1), "right")  # live[j]: chunks of j characters or more
        base = np.cumsum(live[1:]) - live[1:]
        letters = [flat[begin[: live[j + 1]] + j] for j in range(longest)]
        found: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(longest + 1)]
        for i in range(longest):
            at = np.arange(live[i + 1])
            state = self.step(np.ones(len(at), np.int32), letters[i])
            lost = np.flatnonzero(self.piece[state] < 0)
            if len(lost):
                found[i + 1].append((1, lost, np.zeros(len(lost), np.int32)))
            d = 1
            while True:
                whole = np.flatnonzero(self.piece[state] >= 0)
                if len(whole):
                    found[i + d].append((d, at[whole], state[whole]))
                going = np.flatnonzero((state > 0) & (at < (live[i + d + 1] if i + d < longest else 0)))
                if not len(going):
                    break
                at, state = at[going], state[going]
                state = self.step(state, letters[i + d][at])
                alive = np.flatnonzero(state)
                at, state, d = at[alive], state[alive], d + 1
                if not len(at):
                    break
        # forward sums by place; a power of two per place and chunk keeps them in range
        alpha, scale = [np.ones(n)], [np.zeros(n)]
        firsts, pieces, lengths, sums = [], [], [], []
        total_edges = 0
        for j in range(1, longest + 1):
            m = int(live[j])
            edges = sorted(found[j], key=lambda x: -x[0])
            found[j] = []
            top = np.full(m, -np.inf)
            for d, at, _ in edges:
                top[at] = np.maximum(top[at], scale[j - d][at])
            total, count = np.zeros(m), np.zeros(m, np.int64)
            values = []
            for d, at, state in edges:
                v = alpha[j - d][at] * np.where(state > 0, self.weight[state], 1.0) * np.exp2(scale[j - d][at] - top[at])
                total[at] += v
                values.append((count[at], v, total[at]))
                count[at] += 1
            first = np.cumsum(count) - count
            k = int(count.sum())
            piece, length, cumulative = np.empty(k, np.int32), np.empty(k, np.int16), np.empty(k)
            for (d, at, state), (rank, _, run) in zip(edges, values, strict=True):
                where = first[at] + rank
                piece[where] = np.where(state > 0, self.piece[state], -1)
                length[where] = d
                cumulative[where] = run / total[at]
            cumulative[first + count - 1] = 2.0
            firsts.append(first + total_edges)
            pieces.append(piece)
            lengths.append(length)
            sums.append(cumulative)
            total_edges += k
            shift = np.frexp(total)[1].astype(float)
            alpha.append(np.ldexp(total, -shift.astype(np.int32)))
            scale.append(top + shift)
        return base, np.concatenate(firsts), np.concatenate(pieces), np.concatenate(lengths), np.concatenate(sums)

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled piece ids of all texts, one after another, and where each text's ids end.
        keys: an unsigned number per text that seeds its draws. An empty text has no pieces."""
        types: dict[str | tuple[str], int] = {}
        kinds, owners = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                parts = self.parts(text)
                owners[k] = len(parts)
                kinds.append(np.fromiter((types.setdefault(c, len(types)) for c in parts), np.int32, len(parts)))
        if not kinds:
            return np.zeros(0, np.int32), owners
        names = [" " + c if type(c) is str else c[0] for c in types]
        order = np.argsort(-np.fromiter(map(len, names), np.int64, len(names)), kind="stable")
        names = [names[k] for k in order.tolist()]
        renamed = np.empty(len(names), np.int32)
        renamed[order] = np.arange(len(names), dtype=np.int32)
        kind = renamed[np.concatenate(kinds)]
        doc = np.repeat(np.arange(len(texts)), owners)
        base, first, pieces, lengths, sums = self.filtered(names)
        # backward sampling: all chunks together, one piece of each per step
        live = np.arange(len(kind))
        seeds = mix(keys.astype(np.uint64)[doc] + (live - (np.cumsum(owners) - owners)[doc]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        place = np.fromiter(map(len, names), np.int64, len(names))[kind]
        drawn, k = [], 0
        while len(live):
            u = (mix(seeds + np.uint64(k * 0xD1342543DE82EF95 & (1 << 64) - 1)) >> np.uint64(11)) * 2.0**-53
            at = first[base[place - 1] + kind]
            todo = np.flatnonzero(u >= sums[at])
            while len(todo):
                at[todo] += 1
                todo = todo[u[todo] >= sums[at[todo]]]
            place = place - lengths[at]
            drawn.append((live, pieces[at]))
            for x in np.flatnonzero(drawn[-1][1] < 0).tolist():  # an unknown character: its code point, marked
                drawn[-1][1][x] = -2 - ord(names[kind[x]][place[x]])
            rest = np.flatnonzero(place > 0)
            live, seeds, place, kind, k = live[rest], seeds[rest], place[rest], kind[rest], k + 1
        return self._in_order(drawn, owners)

    def encoded(self, keys: pa.Array, texts: pa.Array) -> pa.Array:
        """Lists of sampled ids of a batch of texts, `SLICE` characters at a time."""
        seeds, parts, offsets, end, start, size = keys.to_numpy(zero_copy_only=False).view(np.uint64), [], [np.zeros(1, np.int64)], 0, 0, 0
        rows = texts.to_pylist()
        for k, text in enumerate(rows):
            size += len(text or "")
            if size >= SLICE or k == len(rows) - 1:
                ids, ends = self.encode([x or "" for x in rows[start : k + 1]], seeds[start : k + 1])
                parts.append(ids)
                offsets.append(ends + end)
                end, start, size = end + len(ids), k + 1, 0
        values = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), values, mask=texts.is_null())

    def _in_order(self, drawn: list[tuple[np.ndarray, np.ndarray]], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws, which come last piece first, in text order; unknown characters as bytes."""
        n = np.zeros(int(owners.sum()), np.int64)
        for live, _ in drawn:
            n[live] += 1
        back = np.cumsum(n)
        out = np.empty(int(back[-1]), np.int32)
        text_ends = np.concatenate([[0], back])[np.cumsum(owners)]
        for live, ids in drawn:
            back[live] -= 1
            out[back[live]] = ids
        wide = np.flatnonzero(out < 0)
        if len(wide):
            data = [chr(-2 - x).encode("utf-8") for x in out[wide].tolist()]
            repeat = np.ones(len(out), np.int64)
            repeat[wide] = list(map(len, data))
            ends = np.cumsum(repeat)
            out = np.repeat(out, repeat)
            out[out < 0] = self.byte_ids[np.frombuffer(b"".join(data), np.uint8)]
            text_ends = np.concatenate([[0], ends])[text_ends]
        return out, text_ends

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of a piece sequence: pieces and runs of bytes, without the leading marker."""
        ids = np.asarray(ids, np.int64)
        if not self.is_byte[ids].any():
            return "".join(self.name_of[ids])[1:]
        out, held = [], bytearray()
        for i in ids.tolist():
            if (byte := self.byte_of.get(i)) is not None:
                held.append(byte)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.names[i])
        out.append(held.decode("utf-8", "replace"))
        return "".join(out)[1:]


_CHUNK = re.compile(r" *[^ ]+| +")


def split(text: str) -> list[str]:
    """Chunks of the text with one space in front: spaces and the other characters behind them,
    each chunk without its first space."""
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [m[1:] for m in _CHUNK.findall(" " + text)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def lattice(model: bytes, alpha: float) -> Lattice:
    return Lattice(pieces_of(model), alpha)


def encode_column(model: bytes, key: Column, text: Column, alpha: float = ALPHA) -> Column:
    """Sampled piece ids (null for null text), seeded by the key's text form; rows with equal key
    and text get equal ids. A null key is a key of its own."""

    @arrow_udf("array<int>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        table = lattice(model, alpha)
        for keys, texts in batches:
            yield table.encoded(keys, texts)

    return run(F.xxhash64(key.cast("string")), text)


def round_trip_column(model: bytes, key: Column, text: Column, alpha: float = ALPHA) -> Column:
    """Sampled piece ids as encode_column() gives them, and whether they decode to the text (null for null text), in one pass."""

    @arrow_udf("struct<pieces:array<int>,lossless:boolean>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        table = lattice(model, alpha)
        for keys, texts in batches:
            pieces = table.encoded(keys, texts)
            same = [table.decode(p.values.to_numpy()) == t.as_py() if t.is_valid else None for p, t in zip(pieces, texts, strict=True)]
            yield pa.StructArray.from_arrays([pieces, pa.array(same, pa.bool_())], ["pieces", "lossless"])

    return run(F.xxhash64(key.cast("string")), text)


def decode_column(model: bytes, ids: Column) -> Column:
    """The text of each list of piece ids; null stays null."""

    @arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = lattice(model, ALPHA)
        for batch in batches:
            yield pa.array([table.decode(x.values.to_numpy()) if x.is_valid else None for x in batch], pa.string())

    return run(ids)


def read_model(path: str = MODEL) -> bytes:
    """The serialised model; a tokenizer's file is small and goes to the tasks with the function."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_path: str = MODEL, alpha: float = ALPHA) -> DataFrame:
    """All columns of docs and `pieces`, the sampled ids of text, seeded by doc_id. Null text has
    null pieces, empty text an empty list; repeated rows agree; an empty table stays empty; a
    column named pieces is replaced."""
    ship_package(docs.sparkSession)
    return docs.withColumn("pieces", encode_column(read_model(model_path), F.col("doc_id"), F.col("text"), alpha))


def round_trip_documents(docs: DataFrame, model_path: str = MODEL, alpha: float = ALPHA) -> DataFrame:
    """encode_documents() and `lossless`, whether decoding the pieces returned the text (null for null text)."""
    ship_package(docs.sparkSession)
    both = docs.withColumn("_both", round_trip_column(read_model(model_path), F.col("doc_id"), F.col("text"), alpha))
    return both.withColumns({"pieces": F.col("_both.pieces"), "lossless": F.col("_both.lossless")}).drop("_both")


def decode_documents(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """Inverse: `text` from `pieces`."""
    ship_package(encoded.sparkSession)
    return encoded.withColumn("text", decode_column(read_model(model_path), F.col("pieces")))
