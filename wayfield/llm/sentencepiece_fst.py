"""SentencePiece encoding and decoding with a weighted finite-state transducer.

``compile_model`` reads a public model file and composes its parts into one machine that reads raw text:

- the normaliser (a blank and U+2581 are one symbol, and one stands before the text) is composed with the pieces, whose labels
  are therefore raw characters, so no text is rewritten on the way;
- the pieces are the paths of a trie, which is closed under failure links, so that it reads a text once for all starts;
- byte fallback is an arc for any character that is no piece: it writes the character's bytes (or the unknown piece) at the
  weight of an unknown character.

Composed with a text the machine gives a lattice, whose arcs are pieces and fallbacks.  The encoding is the lattice's shortest
path in the tropical semiring (weights add along a path, the least path wins), by one routine for both kinds of model,
which differ in their arcs' weights alone:

- unigram models weigh a piece with its negative log-probability;
- BPE models weigh pieces with 0 and every *pair* of neighbouring pieces with 0 or infinity: a pair is
  finite if merging by rank, in the order that BPE takes, never joins characters across it.  Just one
  path is then finite, and it is BPE's own result.

A pair's weight asks for the piece before, and every prefix of a text has one least path, so a position keeps the last
piece of its least path.  Where no piece has a blank after another character, a text falls into chunks (blanks
and what follows them) that never share an arc, and chunks seen before are looked up.

How it scales.  One pass over the texts with no shuffle; the machine, bounded by the vocabulary, is compiled
on the driver and broadcast, so executors need no model file; tables of chunks and pairs are bounded.

Nulls and odd cases: null and empty texts have no ids and decode to an empty text; U+2581 in a text
reads as a blank, as the format has it; any other text decodes to itself; very long texts are read in one piece; of paths of equal
weight the one found first stays; equal texts get equal ids, repeated rows are encoded on their own; the column of ids (or of decoded text) is the
only one added, and replaces one of its name (round_trip reads doc_id and text alone); an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, text_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
INFINITY = float("inf")


def merge_by_rank(symbols: list[str], rank: dict[str, int]) -> list[str]:
    """BPE as it is defined: join the neighbours whose union ranks first, the leftmost on ties, until none does."""
    while True:
        best = min(((rank.get(a + b, INFINITY), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))), default=(INFINITY, 0))
        if best[0] == INFINITY:
            return symbols
        i = best[1]
        symbols = symbols[:i] + [symbols[i] + symbols[i + 1]] + symbols[i + 2 :]


def last_merge(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The two symbols that merging makes a piece of; None if it never comes to that piece."""
    symbols = list(piece)
    while len(symbols) > 2:
        r, i = min((rank.get(a + b, INFINITY), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
        if r == INFINITY:
            return None
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return (symbols[0], symbols[1]) if len(symbols) == 2 else None


@dataclass
class Machine:
    """What is broadcast: the trie's labels (raw text, a blank for U+2581) with their pieces, fallback arcs, weights, and the merges for pairs."""

    pieces: list[str]
    labels: dict[str, int]
    weights: dict[int, float]  # empty for BPE
    unknown: float
    merges: dict[str, tuple[str, str]]  # empty for unigram
    rank: dict[str, int]
    byte_ids: list[int]
    unk: int
    prefix: bool
    chunked: bool


def compile_model(path: str = MODEL) -> Machine:
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    spec, kind = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("this normaliser has rules other than the escape of blanks")
    pieces = [p.piece for p in model.pieces]
    usable = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)}
    bytes_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
    unk = next(i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN)
    bpe = model.trainer_spec.model_type == model.trainer_spec.BPE
    rank = {p: r for r, (p, _) in enumerate(sorted(usable.items(), key=lambda x: (-x[1][1], x[1][0])))} if bpe else {}
    merges = {p: m for p in usable if len(p) > 1 and (m := last_merge(p, rank))} if bpe else {}
    return Machine(
        pieces=pieces,
        labels={p.replace(BLANK, " "): i for p, (i, _) in usable.items() if not bpe or len(p) == 1 or p in merges},
        weights={} if bpe else {i: -s for i, s in usable.values()},
        unknown=10.0 - min(s for _, s in usable.values()),
        merges=merges,
        rank=rank,
        byte_ids=[bytes_of[f"<0x{b:02X}>"] for b in range(256)] if bytes_of else [],
        unk=unk,
        prefix=spec.add_dummy_prefix,
        chunked=not any(BLANK in p.lstrip(BLANK) for p in usable),
    )


class _Pairs(dict):
    """The weight of a piece (second) after another (first; None after a fallback or at the start), worked out when first asked for."""

    def __init__(self, weigh: Callable[[int | None, int], float], most: int):
        super().__init__()
        self.weigh, self.most = weigh, most

    def __missing__(self, pair: tuple[int | None, int]) -> float:
        if len(self) >= self.most:
            self.clear()
        w = self[pair] = self.weigh(*pair)
        return w


class Transducer:
    """A machine ready to run, with its tables of what it has seen."""

    def __init__(self, machine: Machine, most: int = 1 << 18):
        self.m, self.most = machine, most
        self.trie = ahocorasick.Automaton()
        for label, i in machine.labels.items():
            self.trie.add_word(label, (len(label), i))
        self.trie.make_automaton()
        self.pairs = _Pairs(self.weight, most)
        self.chunks: dict[str, bytes] = {}
        self.cut = re.compile(" *[^ ]+| +") if machine.chunked else re.compile(".+", re.S)
        plain = {i: p.replace(BLANK, " ").encode() for i, p in enumerate(machine.pieces)}
        for b, i in enumerate(machine.byte_ids):
            plain[i] = bytes([b])
        self.plain = [plain[i] for i in range(len(machine.pieces))]

    def weight(self, before: int | None, piece: int) -> float:
        if self.m.weights:
            return self.m.weights[piece]
        return 0.0 if before is None or self.finite(before, piece) else INFINITY

    def _spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """Symbols at one end of a piece, the smallest first, with the rank at which each is merged on."""
        out, above = [], INFINITY
        while True:
            out.append((piece, above))
            if len(piece) == 1:
                return out[::-1]
            above = self.m.rank[piece]
            piece = self.m.merges[piece][side]

    def finite(self, a: int, b: int) -> bool:
        """Whether no merge joins the end of piece a and the start of piece b while merging by rank makes both."""
        left, right = self._spine(self.m.pieces[a], 1), self._spine(self.m.pieces[b], 0)
        i = j = 0
        while True:
            (x, on_left), (y, on_right) = left[i], right[j]
            across = self.m.rank.get(x + y, INFINITY)
            if across < on_left and across <= on_right:
                return False
            if on_left == on_right == INFINITY:
                return True
            if on_left <= on_right:
                i += 1
            else:
                j += 1

    def _fallback(self, c: str) -> list[int]:
        return [self.m.byte_ids[b] for b in c.encode()] if self.m.byte_ids else [self.m.unk]

    def shortest_path(self, text: str) -> list[int]:
        """Ids of the least path through the lattice of a text that starts with the normaliser's blank."""
        n, pairs = len(text), self.pairs
        last: list[int | None] = [None] * (n + 1)  # the last piece of the least path to a position; None: a fallback, or the start
        length, cost = [0] * (n + 1), [0.0] + [INFINITY] * n
        known = 0  # up to here all arcs have come in
        for end, (size, piece) in self.trie.iter(text):
            end += 1
            start = end - size
            while known < start:  # a position that no piece reached: its character has the fallback arc
                known += 1
                if cost[known] == INFINITY:
                    cost[known], length[known] = cost[known - 1] + self.m.unknown, 1
            if cost[start] >= cost[end]:  # no weight is below 0
                continue
            c = cost[start] + pairs[last[start], piece]
            if c < cost[end]:
                last[end], length[end], cost[end] = piece, size, c
        while known < n:
            known += 1
            if cost[known] == INFINITY:
                cost[known], length[known] = cost[known - 1] + self.m.unknown, 1
        out, at = [], n
        while at:
            out.append([last[at]] if last[at] is not None else self._fallback(text[at - 1]))
            at -= length[at]
        return [i for ids in reversed(out) for i in ids]

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if BLANK in text:  # the other label of the blank's arcs
            text = text.replace(BLANK, " ")
        chunks, known = self.cut.findall(" " + text if self.m.prefix and text else text), self.chunks
        try:
            found = b"".join(map(known.__getitem__, chunks))
        except KeyError:
            parts = []
            for c in chunks:
                ids = known.get(c)
                if ids is None:
                    ids = np.array(self.shortest_path(c), np.int32).tobytes()
                    if len(c) <= 64:
                        if len(known) >= self.most:
                            known.clear()
                        known[c] = ids
                parts.append(ids)
            found = b"".join(parts)
        return np.frombuffer(found, np.int32)

    def decode(self, ids) -> str:
        text = b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.m.prefix and text[:1] == " " else text


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))


def encode(docs: DataFrame, column: str = "ids", model: str | Machine = MODEL, text: str = "text") -> DataFrame:
    """docs with one more column: the ids of each text."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, Machine) else compile_model(model))

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        machine = kept(shared, Transducer)
        return _lists([machine.encode(t.as_py()) for t in texts])

    return docs.withColumn(column, ids(F.col(text)))


def decode(docs: DataFrame, column: str = "decoded", model: str | Machine = MODEL, ids: str = "ids") -> DataFrame:
    """docs with one more column: the text of each row's ids (null: empty)."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, Machine) else compile_model(model))

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        machine = kept(shared, Transducer)
        return pa.array([machine.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid and len(x.values) else "" for x in lists], pa.string())

    return docs.withColumn(column, text(F.col(ids)))


def round_trip(docs: DataFrame, model: str | Machine = MODEL) -> DataFrame:
    """doc_id, n_ids, ids, and decoded_crc32 and lossless of the text decoded from them."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, Machine) else compile_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = kept(shared, Transducer)
        for batch in batches:
            found, crcs, same = [], [], []
            for text in batch.column(1).to_pylist():
                ids = machine.encode(text)
                back = machine.decode(ids)
                found.append(ids)
                crcs.append(zlib.crc32(back.encode()))
                same.append(back == (text or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), _lists(found), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids", "decoded_crc32", "lossless"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_ids long, ids array<int>, decoded_crc32 long, lossless boolean")
