"""Token ids in files: canonical length-limited Huffman codes from global counts, in blocks that are read by themselves.

``write`` encodes texts with a public tokenizer, puts an end id behind each, and writes them in ascending doc_id order.  A folder holds

- ``code``: one row, ``lengths``, with a byte for each id: how many bits its code has (0: it doesn't occur).  Codes are canonical: dealt by length, then by id;
- ``segments``: one row for some whole documents that follow each other: ``part`` (number of the file in order), ``first`` (ids of the part before it),
  ``doc_id`` and ``n_tokens`` (arrays), ``n_ids``, and ``blocks``, an array of binaries;
- ``parts``: ``part`` and ``start``, the ids of all parts before it.

A block is little-endian: number of ids (4 bytes), ids between checkpoints (4), one bit offset for each checkpoint (4 each), then the code bits in
big-endian words of 32 bits, the first bit highest.  It holds `BLOCK` ids at most, so a document of any length is decoded in bounded steps.  Decoding
looks the next `limit` bits up in a table of ids and lengths, at all checkpoints of a block at once; a span of ids reads its own checkpoints alone.

How it scales.  Texts meet the tokenizer once and are staged as ids; counts are summed up in each task, so at most the vocabulary's ids reach the driver, which
makes the lengths by package-merge and broadcasts them.  Documents are ordered by a range shuffle of their ids; copies of a row are told apart by
a running number, so one doc_id may hold any share of the rows.  `start` is never summed up over rows: a part counts its own ids, and the parts' totals (one
number a file) are added up.

How the tokenizer is used.  Byte-level BPE cuts a text into words before it merges, and a blank with no white space behind it always starts a word; a single line
end between words is one.  Texts are cut there, and the library encodes pieces, many as one text, of which a worker remembers a bounded number; the ids of a text
are its pieces' ids in order.  Pieces of Latin letters meet the model without the search for words, if none of its merges crosses their ends.
Any other kind of tokenizer gets whole texts.

Nulls and odd cases: a null or empty text has the end id alone; documents without doc_id come first; of rows with one doc_id the order is by a hash of the text,
equal rows have equal ids in any order; very long texts take several blocks of one row; other columns are not read, so no name can clash; an empty table gives
files without rows.
"""

from __future__ import annotations

import codecs
import contextlib
import ctypes
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import kept, stage, text_batches, values

BLOCK, CHECKPOINT = 1 << 17, 128
WORDS = re.compile(r" (?=\S)")  # a blank that starts a word
MARKS = ".,;:!?#$%&*"  # word by word, what a run of them behind a letter is to the tokenizer
BYTES = "".join(chr(i if 33 <= i <= 126 or 161 <= i <= 172 or 174 <= i else 256 + i - (0 if i < 33 else 94 if i < 161 else 106)) for i in range(256))  # how byte-level BPE writes bytes
BLANK, LINE = BYTES[32], BYTES[10]
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"  # fixed values: what Python takes for white space
WIDE = f" ([{SPACES}]|$)"  # one that doesn't
LINES = f"^[^{SPACES}]+(\n[^{SPACES}]+)+$"  # words with single line ends between them
LETTERS = [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)]  # fixed values too: Latin ones, which each edition of Unicode takes for letters
WORD = "^[ \n][" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in LETTERS) + "]+$"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _listed(texts: pa.StringArray) -> list[str]:
    """By numpy, which is several times as quick as to_pylist."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def _offsets(a: pa.Array) -> np.ndarray:
    """Where the values of an array of strings or binaries begin and end."""
    return np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, 4 * a.offset) if len(a) else np.zeros(1, np.int32)


def _binaries(data, upto: np.ndarray) -> pa.BinaryArray:
    """Pieces of a buffer, from each offset to the next."""
    return pa.Array.from_buffers(pa.binary(), len(upto) - 1, [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(data)])


def _strung(parts: pa.BinaryArray, at: np.ndarray, upto: np.ndarray) -> pa.BinaryArray:
    """The parts `at` in order, those from each of upto to the next as one value: what lies side by side only needs fewer offsets."""
    taken = parts.take(pa.array(at, pa.int64()))
    return _binaries(taken.buffers()[2] or b"", _offsets(taken)[upto])


class Encoder:
    """The ids of texts.

    Pieces of `longest` bytes at most are looked up in a table of the worker, two Arrow arrays, which takes new ones until it holds `most`: those that occur twice
    in a batch, and any up to `few`.  It is emptied when half of a batch's that occur twice are not in it.
    """

    def __init__(self, path: str, most: int = 250_000, few: int = 1 << 15, longest: int = 100):
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already; the library's threads cost CPU and keep memory
        self.lib, self.most, self.few, self.longest = Tokenizer.from_file(path), most, few, longest
        self.kind = id_type(self.lib.get_vocab_size(True))
        p = self.lib.pre_tokenizer
        self.by_words = isinstance(p, pre_tokenizers.ByteLevel) and p.use_regex and not p.add_prefix_space and self.lib.normalizer is None and self.lib.truncation is None and self.lib.padding is None
        added, vocabulary = self.lib.get_added_tokens_decoder().values(), self.lib.get_vocab(True)
        self.by_words = self.by_words and all(not (t.lstrip or t.rstrip or " " in t.content or "\n" in t.content or t.content.startswith(BLANK)) for t in added)
        self.marks = "".join(c for c in MARKS if all(c not in t.content for t in added))
        self.merger, m = Tokenizer(self.lib.model), self.lib.model  # the model alone, for words that no merge joins
        self.merges_words = isinstance(m, models.BPE) and not (m.ignore_merges or m.continuing_subword_prefix or m.end_of_word_suffix or any(all(any(a <= ord(c) <= b for a, b in LETTERS) for c in t.content) for t in added))
        letters = codecs.charmap_decode("".join(chr(c) for a, b in LETTERS for c in range(a, b + 1)).encode(), "strict", BYTES)[0]
        written, join = {BLANK, LINE, *letters}, re.compile(f"^{LINE}.|.[{BLANK}{LINE}]", re.DOTALL)
        self.merges_words = self.merges_words and not any(join.search(t) and not re.search(f"[{BLANK}{LINE}]{{2}}", t) and written.issuperset(t) for t in vocabulary)
        self.blanks, self.lines = np.zeros((2, max(vocabulary.values(), default=-1) + 1), bool)  # whether an id's letters start with a blank; whether it is a line's end
        for letters, i in vocabulary.items():
            self.blanks[i], self.lines[i] = letters.startswith(BLANK), letters == LINE
        self.known, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def _packed(self, texts: list[str], some: int = 4096) -> pa.BinaryArray:
        """`some` texts at a time, as the library keeps about a kilobyte for each."""
        out = [pa.array([], pa.binary())]
        for i in range(0, len(texts), some):
            found = [e.ids for e in self.lib.encode_batch_fast(texts[i : i + some], add_special_tokens=False)]
            upto = np.array([0, *accumulate(map(len, found))])
            data = np.fromiter(chain.from_iterable(found), self.kind, upto[-1])
            out.append(_binaries(data, data.itemsize * upto))
        return pa.concat_arrays(out)

    def _joined(self, lib, pieces: pa.StringArray, opens: np.ndarray, letters: str | None = None, each: int = 256, some: int = 16) -> pa.BinaryArray:
        """The ids of pieces, `each` of which the library gets as one text, which spares its cost of a text for each; ids in `opens` say where each piece begins."""
        at, data, out = _offsets(pieces)[[*range(0, len(pieces), each), len(pieces)]].tolist(), pieces.buffers()[2], [np.zeros(0, self.kind)]
        texts = [codecs.charmap_decode(data[a:b], "strict", letters)[0] if letters else str(data[a:b], "utf-8") for a, b in zip(at, at[1:], strict=False)]
        for i in range(0, len(texts), some):
            out += [np.array(e.ids, self.kind) for e in lib.encode_batch_fast(texts[i : i + some], add_special_tokens=False)]
        ids = np.concatenate(out)
        upto = np.append(np.flatnonzero(opens[ids]), len(ids))
        if len(upto) != len(pieces) + 1:
            raise ValueError("the tokenizer's ids don't tell where pieces begin")
        return _binaries(ids, ids.itemsize * upto)

    def _learn(self, pieces: pa.StringArray) -> pa.BinaryArray:
        """The ids of different pieces, each with the blank or line end before it; behind a line end there is no white space."""
        line = pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False)
        word = pc.match_substring_regex(pieces, WORD).to_numpy(zero_copy_only=False) & self.merges_words
        wide = ~line & pc.or_(pc.greater(pc.count_substring(pieces, " "), 1), pc.equal(pieces, " ")).to_numpy(zero_copy_only=False)
        kinds = [word, line & ~word, wide, ~(word | line | wide)]
        some = [pieces.filter(pa.array(k)) for k in kinds]
        found = [
            self._joined(self.merger, some[0], self.blanks | self.lines, BYTES),
            self._joined(self.lib, some[1], self.lines),
            self._packed(_listed(some[2])),
            self._joined(self.lib, some[3], self.blanks),
        ]
        place = np.empty(len(pieces), np.int64)
        place[np.concatenate([np.flatnonzero(k) for k in kinds])] = np.arange(len(pieces))
        return pa.concat_arrays(found).take(pa.array(place))

    def _found(self, pieces: pa.StringArray, times: np.ndarray) -> pa.BinaryArray:
        """The ids of different pieces by the table."""
        at = pc.index_in(pieces, value_set=self.known)
        gaps = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        place[gaps] = len(self.known) + np.arange(len(gaps))
        new = pieces.take(pa.array(gaps))
        both = pa.concat_arrays([self.ids, self._learn(new)])
        out = both.take(pa.array(place))
        short = pc.binary_length(pieces).to_numpy() <= self.longest
        often = short & (times > 1)
        if len(self.known) >= self.most and 2 * often[gaps].sum() > often.sum():
            self.known, self.ids, both = self.known[:0], self.ids[:0], both[len(self.known) :]
        room = min(max(int(often[gaps].sum()), self.few - len(self.known)), self.most - len(self.known))
        if room > 0:
            keep = np.argsort(-(times * short)[gaps], kind="stable")[:room]
            keep = keep[short[gaps[keep]]]
            self.ids = pa.concat_arrays([self.ids, both.take(pa.array(len(self.known) + keep))])
            self.known = pa.concat_arrays([self.known, new.take(pa.array(keep))])
        return out

    def table(self, pieces: pa.StringArray, times: np.ndarray) -> pa.BinaryArray:
        """The ids of different pieces, each of which follows a blank and occurs so many times.

        A single line end between words is a word of its own, so pieces are cut before it.  So are marks behind a letter, and pieces are looked up without them.
        """
        lined = np.flatnonzero(pc.match_substring(pieces, "\n").to_numpy(zero_copy_only=False))
        lined = lined[pc.match_substring_regex(pieces.take(pa.array(lined)), LINES).to_numpy(zero_copy_only=False)]
        cut = pc.split_pattern(pieces.take(pa.array(lined)), "\n")
        sizes, lines = pc.list_value_length(cut).to_numpy(), cut.flatten()
        first = np.cumsum(sizes) - sizes
        later = np.delete(np.arange(len(lines)), first)
        heads = np.arange(len(pieces))
        heads[lined] = len(pieces) + first
        units = pa.concat_arrays([
            pc.binary_join_element_wise(" ", pa.concat_arrays([pieces, lines]).take(pa.array(heads)), ""),
            pc.binary_join_element_wise("\n", lines.take(pa.array(later)), ""),
        ])
        n = np.ones(len(pieces), np.int64)
        n[lined] = sizes
        upto = np.concatenate([[0], np.cumsum(n)])
        order = np.full(upto[-1], -1)
        order[upto[:-1]] = np.arange(len(pieces))
        order[order < 0] = len(pieces) + np.arange(len(later))
        body = pc.utf8_rtrim(units, self.marks)
        marked = pc.and_(pc.utf8_is_alpha(pc.utf8_slice_codeunits(body, -1)), pc.not_equal(body, units))
        once = pc.if_else(marked, body, units).dictionary_encode()
        at = once.indices.to_numpy()
        found = self._found(once.dictionary, np.bincount(at, np.concatenate([times, np.repeat(times[lined], sizes - 1)]), len(once.dictionary)))
        ends = [u[len(b) :] for u, b in zip(_listed(units.filter(marked)), _listed(body.filter(marked)), strict=True)]
        ends = pa.array(ends, pa.string()).dictionary_encode()
        marked = marked.to_numpy(zero_copy_only=False)
        tail = np.zeros(len(units), np.int64)
        tail[marked] = len(found) + ends.indices.to_numpy()
        more = marked[order]
        at = np.insert(at[order].astype(np.int64), np.flatnonzero(more) + 1, tail[order[more]])
        return _strung(pa.concat_arrays([found, self._packed(_listed(ends.dictionary))]), at, upto + np.concatenate([[0], np.cumsum(more)])[upto])

    def encode(self, texts: pa.StringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) in one array, an end id behind each, and how many each text has.

        The texts' words are numbered, each different one is looked up once, and the lists of ids are put together by Arrow.
        """
        texts = pc.fill_null(texts, "")
        if self.by_words:
            wide = pc.match_substring_regex(texts, WIDE).to_numpy(zero_copy_only=False)
            cut = pc.split_pattern(texts, " ")
            if wide.any():  # these texts alone are cut by Python, and go back to their places
                again = pa.array([WORDS.split(t) for t in _listed(texts.filter(pa.array(wide)))], cut.type)
                place = np.arange(len(texts))
                place[wide] = len(texts) + np.arange(len(again))
                cut = pa.concat_arrays([cut, again]).take(pa.array(place))
            sizes, words = pc.list_value_length(cut).to_numpy(), cut.flatten()
            upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            whole = words.take(pa.array(upto[:-1])).dictionary_encode()
            words = words.dictionary_encode()
            pieces, at = words.dictionary, words.indices.to_numpy().copy()
        else:
            upto, whole = np.arange(len(texts) + 1), texts.dictionary_encode()
            pieces, at = pa.array([], pa.string()), np.zeros(len(texts), np.int32)
        at[upto[:-1]] = len(pieces) + whole.indices.to_numpy()  # what no blank precedes is looked up by itself
        times = np.bincount(at, minlength=len(pieces))[: len(pieces)]
        used = np.flatnonzero(times)  # not what only begins texts
        parts = [self.table(pieces.take(pa.array(used)), times[used]), self._packed(_listed(whole.dictionary)), pa.array([np.array([end], self.kind).tobytes()], pa.binary())]
        number = np.zeros(len(pieces) + len(whole.dictionary), np.int32)
        number[used], number[len(pieces) :] = np.arange(len(used)), len(used) + np.arange(len(whole.dictionary))
        at = np.insert(number[at], upto[1:], len(used) + len(whole.dictionary))
        out = _strung(pa.concat_arrays(parts), at, upto + np.arange(len(upto)))
        ids = np.frombuffer(out.buffers()[2], self.kind)
        return ids, np.diff(_offsets(out)).astype(np.int64) // ids.itemsize


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """One for all tasks that a worker runs."""
    return Encoder(path)


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _returned() -> None:
    """Hands freed memory back to the system, of which the allocators of C and Arrow otherwise keep some hundred MB a worker; Arrow then uses C's."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def _gathered(batches: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes: the more texts at once, the fewer words are looked up."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def tokenised(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """doc_id, h (hash of the text), n_tokens and ids (binary, of the tokenizer's id_type) with the end id behind each."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _returned()
        encoder = worker_encoder(tokenizer)
        for batch in _gathered(batches):
            ids, n = encoder.encode(batch.column(2), end)
            offsets = np.concatenate([[0], np.cumsum(n)]) * ids.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), packed], ["doc_id", "h", "n_tokens", "ids"])
            del batch, ids, n, offsets, packed
            _returned()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h long, n_tokens long, ids binary")


def counts(ids: DataFrame, kind: str, column: str = "ids") -> np.ndarray:
    """How often each id occurs; a task sends its own sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind))
            if len(more) > len(n):
                n, more = more, n
            n[: len(more)] += more
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["id", "n"])

    rows = ids.select(column).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # the vocabulary's ids at most
    out = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def code_lengths(n: np.ndarray, limit: int) -> np.ndarray:
    """Code lengths, `limit` at most, of the least total size, by package-merge; 0 where n is 0.

    Each round pairs the cheapest of the last one's list into packages and puts the single ids among them; what the cheapest 2 * ids - 2 of
    the last list hold of an id is its length.
    """
    used = np.flatnonzero(n)
    order = used[np.argsort(n[used], kind="stable")]
    out = np.zeros(len(n), np.uint8)
    if len(order) < 2:
        out[order] = 1
        return out
    if len(order) > 1 << limit:
        raise ValueError(f"{len(order)} ids don't fit codes of {limit} bits")
    weights, single = n[order], []
    row = weights
    for _ in range(limit):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1) if single else row[:0]
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        row = both[at]
        single.append(at < len(weights))
    take, lengths = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for ones in reversed(single):
        alone = int(ones[:take].sum())
        lengths[:alone] += 1
        take = 2 * (take - alone)
    out[order] = lengths
    return out


@dataclass
class Code:
    """The canonical code of some lengths: codes to write, tables to read."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.bits = max(1, int(self.lengths.max(initial=1)))
        ids = np.flatnonzero(self.lengths)
        ids = ids[np.argsort(self.lengths[ids], kind="stable")]
        width = np.int64(1) << (self.bits - self.lengths[ids].astype(np.int64))  # entries of the table
        first = np.concatenate([[0], np.cumsum(width)])
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[ids] = first[:-1] >> (self.bits - self.lengths[ids].astype(np.int64))
        self.ids = np.zeros(1 << self.bits, np.uint32)
        self.steps = np.ones(1 << self.bits, np.int64)
        self.ids[: first[-1]], self.steps[: first[-1]] = np.repeat(ids, width), np.repeat(self.lengths[ids], width)

    def encode(self, ids: np.ndarray) -> bytes:
        """One block."""
        length = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(length)
        start = ends - length
        words = np.zeros((int(ends[-1]) >> 5) + 2 if len(ids) else 1, np.uint64)
        if len(ids):
            at = start >> 5
            wide = self.codes[ids] << (64 - (start & 31) - length).astype(np.uint64)  # lies in a word and the next
            new = np.flatnonzero(np.diff(at, prepend=-1))
            words[at[new]] |= np.bitwise_or.reduceat(wide >> np.uint64(32), new)
            words[at[new] + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), new)
        return b"".join([np.array([len(ids), CHECKPOINT], "<u4").tobytes(), start[::CHECKPOINT].astype("<u4").tobytes(), words.astype(">u4").tobytes()])

    def decode(self, block: bytes, low: int = 0, high: int | None = None) -> np.ndarray:
        """Ids low to high (all) of a block; only the checkpoints that hold them are read."""
        n, every = (int(x) for x in np.frombuffer(block, "<u4", 2))
        high = n if high is None else min(high, n)
        if high <= low:
            return np.zeros(0, np.uint32)
        points = -(-n // every)
        a, b = low // every, -(-high // every)
        at = np.frombuffer(block, "<u4", points, 8).astype(np.int64)[a:b]
        words = np.frombuffer(block, ">u4", -1, 8 + 4 * points).astype(np.uint64)
        words = np.concatenate([words, np.zeros(every * self.bits // 32 + 2, np.uint64)])  # what follows the last id reads as zeros
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        out, mask, shift = np.empty((every, b - a), np.uint32), np.uint64((1 << self.bits) - 1), 64 - self.bits
        for k in range(every):
            entry = (pairs[at >> 5] >> (shift - (at & 31)).astype(np.uint64) & mask).astype(np.int64)
            out[k] = self.ids[entry]
            at += self.steps[entry]
        return out.T.reshape(-1)[low - a * every : high - a * every]


def _segments(code, kind: str, doc_kind: pa.DataType):
    """Rows (part, doc_id, n_tokens, ids) in order, as segments of some BLOCK ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = kept(code, Code)
        first, part, total, docs, sizes, held = 0, 0, 0, [], [], []

        def segment() -> pa.RecordBatch:
            ids = np.concatenate(held)
            blocks = [c.encode(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
            arrays = [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([docs], pa.list_(doc_kind)), pa.array([sizes], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([blocks], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(arrays, ["part", "first", "doc_id", "n_tokens", "n_ids", "blocks"])

        for batch in batches:
            part = batch.column(0)[0].as_py() if len(batch) else part
            for doc, n, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                docs.append(doc)
                sizes.append(n)
                held.append(np.frombuffer(ids.as_buffer(), kind))
                total += n
                if total >= BLOCK:
                    yield segment()
                    first, total, docs, sizes, held = first + total, 0, [], [], []
        if docs:
            yield segment()
        _returned()

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 0, limit: int = 18) -> None:
    """Writes the ids of docs' texts (doc_id, text) to a new folder of a file system that driver and executors share."""
    from tokenizers import Tokenizer

    spark, tokenizer = docs.sparkSession, tokenizer or tokenizer_path()
    kind = id_type(Tokenizer.from_file(tokenizer).get_vocab_size(True))
    ids = stage(tokenised(docs, tokenizer, end).withColumn("uid", F.monotonically_increasing_id()))
    n = counts(ids, kind)
    lengths = code_lengths(n, max(limit, int(np.count_nonzero(n)).bit_length()))
    code = spark.sparkContext.broadcast(lengths)
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("uid")]
    rows = ids.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "ids")
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part int, first long, doc_id array<{doc_kind}>, n_tokens array<long>, n_ids long, blocks array<binary>"
    rows.mapInArrow(_segments(code, kind, to_arrow_type(docs.schema["doc_id"].dataType)), schema).write.parquet(f"{path}/segments")
    totals = sorted((r.part, r.n) for r in spark.read.schema(schema).parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a number a file
    starts = [(p, at) for (p, _), at in zip(totals, accumulate([0, *(k for _, k in totals)]), strict=False)]
    values(spark, "part int, start bigint", starts).write.parquet(f"{path}/parts")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{path}/code")


def _opened(spark: SparkSession, path: str):
    """The code, and the segments with `start`, the ids of all segments before."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first().lengths), np.uint8)
    parts = spark.read.parquet(f"{path}/parts")
    rows = spark.read.parquet(f"{path}/segments").join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("first"))  # a row a file
    return spark.sparkContext.broadcast(lengths), rows


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (binary, little-endian unsigned 32-bit integers) of each document."""
    code, rows = _opened(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _returned()
        c = kept(code, Code)
        for batch in batches:
            for i in range(len(batch)):
                sizes = batch.column(2)[i].values.to_numpy()
                upto = np.concatenate([[0], np.cumsum(sizes)])
                ids = np.empty(upto[-1], "<u4")
                for k, b in enumerate(batch.column(3)[i].values):
                    ids[k * BLOCK : (k + 1) * BLOCK] = c.decode(b.as_buffer())
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(4 * upto), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, pa.array(batch.column(0)[i].as_py() + upto[:-1], pa.int64()), pa.array(sizes, pa.int64()), packed], ["doc_id", "start", "n_tokens", "ids"])
            _returned()

    kind = rows.schema["doc_id"].dataType.elementType.simpleString()
    return rows.select("start", "doc_id", "n_tokens", "blocks").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def spans(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """start and ids (array) of the pieces, one a segment in order of start, that make up ids start to start + length, whatever documents they are of."""
    code, rows = _opened(spark, path)
    met = rows.where((F.col("start") < start + length) & (F.col("start") + F.col("n_ids") > start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = kept(code, Code)
        for batch in batches:
            for i in range(len(batch)):
                at = batch.column(0)[i].as_py()
                blocks = batch.column(1)[i].values
                found = [c.decode(b.as_buffer(), max(0, start - at - k * BLOCK), min(BLOCK, start + length - at - k * BLOCK)) for k, b in enumerate(blocks)]
                yield pa.RecordBatch.from_arrays([pa.array([max(at, start)], pa.int64()), pa.array([np.concatenate(found).astype(np.int32)], pa.list_(pa.int32()))], ["start", "ids"])

    return met.select("start", "blocks").mapInArrow(run, "start long, ids array<int>")
