"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A text is lower-cased (A-Z) and read as its words with one blank between them and one end mark.  Every
byte is eight binary decisions; each decision has, for every context of up to ``depth`` preceding
bytes, a Krichevsky-Trofimov estimate from counts of all training texts, and the estimates of all
depths are mixed with context-tree weights: Pw = (Pe + product of the children's Pw) / 2, a leaf's Pw
being its Pe.  A decision's probability is the mixture along its context path; a text's score is the
sum of their logarithms, and so its code length.  Every context and decision that the training texts
hold is a node, so the tree grows with the corpus.

How it scales.  The distinct n-grams of all rows are counted in bounded memory in each task, then summed in a
shuffle by their nearest ``split`` bytes of context.  One such key has 2**24 distinct n-grams at most (two
more bytes of context and the byte itself), whatever the corpus, and only distinct ones travel, so no key is hot;
keys are dealt into buckets, twice as many as shuffle partitions, and a task's n-grams of a bucket travel as one packed row.
Within a bucket the levels below ``split`` are a Python function over sorted arrays; the levels above, which are
few rows, are group-bys on the way up and joins on the way down.  Going up, only each node's counts and weighted
probability leave a task; going down, each decision's mixture is linear in that of the level below, so two
numbers a node come back.  Scoring is one pass over the texts: the ``2**hot_grams`` most frequent n-grams at most (2,097,152
of 12 bytes) are broadcast, the others meet their logarithms in a join.  The base score needs the count of each
word: words with at least 2**-17 of all tokens (so 131,072 at most; a word over 64 bytes goes by its digest) are broadcast,
the others meet their counts in a join.

Nulls and odd cases: a null text counts as empty and has the end mark alone; very long texts are read in one piece
each; a null doc_id is in the training part; ties do not occur; repeated rows are scored and counted on their own;
without training texts every decision has probability 1/2; columns other than doc_id and text are not
read, so their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, kept, stage, text_batches

END = b"\n"


def canonical(text: str | None) -> bytes:
    """Words (runs of bytes other than blank and 9 to 13) with one blank between them, and the end mark."""
    return b" ".join((text or "").encode().lower().split()) + END


def _grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the texts with the `depth` bytes before it in a number, the nearest of these on top and the byte itself at the bottom; and where each text starts."""
    body = END * depth + (END * depth).join(texts)  # a text starts after end marks
    data = np.frombuffer(body, np.uint8).astype(np.int64)
    packed = data[depth:].copy()
    for k in range(1, depth + 1):
        packed |= data[depth - k : len(data) - k] << (8 * (depth - k + 1))
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + depth) - sizes - depth
    inside = np.ones(len(packed), bool)
    for k in range(depth):  # the marks between texts
        inside[(starts[1:] - 1 - k)] = False
    return packed[inside], np.cumsum(sizes) - sizes


def _batches(column: pa.Array, most: int = 1 << 19) -> Iterator[list[int]]:
    """Row numbers in runs of at most `most` characters (a longer text alone)."""
    run, size = [], 0
    for i, n in enumerate(pa.compute.binary_length(column).fill_null(0).to_pylist()):
        if run and size + n > most:
            yield run
            run, size = [], 0
        run.append(i)
        size += n
    if run:
        yield run


def _name(word: bytes) -> bytes:
    """A word as it is counted: itself, or the digest of a long one (a blank in front, which no word has)."""
    return word if len(word) <= 64 else b" " + xxhash.xxh3_128_digest(word)


def word_counts(docs: DataFrame, flush: int = 200_000) -> DataFrame:
    """word (as it is counted) and n: summed in bounded memory in a task, then by a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        total = lambda: pa.record_batch({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})
        for batch in batches:
            for text in batch.column(0):
                seen.update(map(_name, (text.as_py() or "").encode().lower().split()))
                if len(seen) >= flush:
                    yield total()
                    seen = Counter()
        yield total()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams, sorted and distinct, with the sums of both counts."""
    g, n, m = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(g)
    g = g[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    return g[first], np.add.reduceat(n[order], first) if len(g) else n, np.add.reduceat(m[order], first) if len(g) else m


def packed(g: np.ndarray, n: np.ndarray, m: np.ndarray) -> bytes:
    """Sorted n-grams with both counts: differences, byte by byte, compressed."""
    columns = [np.diff(g, prepend=0), n.astype(np.int64), m.astype(np.int64)]
    return zstandard.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns), 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(3, 8, -1)
    d, n, m = (np.ascontiguousarray(c.T).view(np.int64).ravel() for c in planes)
    return np.cumsum(d), n, m


def _bucket(near: np.ndarray, buckets: int) -> np.ndarray:
    return (((near.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def gram_counts(docs: DataFrame, depth: int, split: int, buckets: int, flush: int = 3 << 19) -> DataFrame:
    """bucket and n-grams (depth + 1 bytes), packed with n in the rows to learn from (column t) and m in all rows; a gram comes from a task once for each `flush` distinct ones."""

    def out(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = _summed(parts)
        at = _bucket(columns[0] >> (8 * (depth - split + 1)), buckets)
        order = np.argsort(at, kind="stable")
        at, columns = at[order], [c[order] for c in columns]
        edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([int(at[a])], pa.int32()), pa.array([packed(*(c[a:b] for c in columns))], pa.binary())], ["bucket", "grams"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            column, learn = batch.column(0), batch.column(1).to_pylist()
            for run in _batches(column):
                for t in (True, False):
                    texts = [canonical(column[i].as_py()) for i in run if bool(learn[i]) == t]
                    if texts:
                        g, k = np.unique(_grams(texts, depth)[0], return_counts=True)
                        k = k.astype(np.int32)
                        parts.append((g, k * np.int32(t), k))
                        size += len(g)
                if size >= 2 * flush:
                    parts = [_summed(parts)]
                    size = len(parts[0][0])
                    if size >= flush:
                        yield from out(parts)
                        parts, size = [], 0
        if parts:
            yield from out(parts)

    return docs.select("text", "t").mapInArrow(count, "bucket int, grams binary")


def _sums_of_logs(first: float, step: float, n: int = 1 << 16) -> np.ndarray:
    """ln of Gamma at first, first + 1, ..., given at `first`."""
    return first + np.concatenate([[0.0], np.cumsum(np.log(step + np.arange(n - 1)))])


_AT_HALVES, _AT_ONES = _sums_of_logs(0.5 * math.log(math.pi), 0.5), _sums_of_logs(0.0, 1.0)


def _log_gammas(n: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
    """ln Gamma(n + plus): from a table, or by Stirling's series where n is beyond it."""
    out = table[np.minimum(n, len(table) - 1)]
    far = np.flatnonzero(n >= len(table))
    z = n[far] + plus
    out[far] = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z)
    return out


def log_estimates(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with n0 zeros and n1 ones."""
    return _log_gammas(n0, _AT_HALVES, 0.5) + _log_gammas(n1, _AT_HALVES, 0.5) - _log_gammas(n0 + n1, _AT_ONES, 1.0) - math.log(math.pi)


def _log_gamma(x: Column) -> Column:
    """By Stirling's series after moving the argument up by 6."""
    z = x + 6.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, 5.0))
    return series - F.log(reduce(lambda a, b: a * b, [x + float(k) for k in range(6)]))


def log_estimate(n0: Column, n1: Column) -> Column:
    """The same for columns."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


@dataclass
class Nodes:
    """One decision (the i-th bit) in all contexts of one length: number (context, decision), counts, own and weighted log-probability, and the parents' places."""

    ids: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    own: np.ndarray
    weighted: np.ndarray
    up: np.ndarray | None = None


def _collapsed(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams without their furthest byte of context."""
    k, n, _ = _summed([(((g >> 16) << 8) | (g & 255), n, n)])
    return k, n


def _nodes(levels: list[tuple[np.ndarray, np.ndarray]], i: int) -> tuple[list[Nodes], np.ndarray]:
    """The i-th decision of each level, the deepest first, and each deepest gram's place in it."""
    out: list[Nodes] = []
    for g, n in levels:
        of = g >> (8 - i)
        new = np.concatenate([[True], of[1:] != of[:-1]])
        first = np.flatnonzero(new)
        one = np.add.reduceat(n * (g >> (7 - i) & 1), first)
        zero = np.add.reduceat(n, first) - one
        ids = ((of[first] >> i) << 8) | (1 << i) | (of[first] & ((1 << i) - 1))
        own = log_estimates(zero, one)
        if out:
            below = out[-1]
            below.up = np.searchsorted(ids, ((below.ids >> 16) << 8) | (below.ids & 255))
            kids = np.bincount(below.up, weights=below.weighted, minlength=len(ids))
            out.append(Nodes(ids, zero, one, own, np.logaddexp(own, kids) - math.log(2)))
        else:
            place = np.cumsum(new) - 1
            out.append(Nodes(ids, zero, one, own, own))
    return out, place


def _levels(g: np.ndarray, n: np.ndarray, depth: int, split: int) -> list[tuple[np.ndarray, np.ndarray]]:
    levels = [(g, n)]
    for _ in range(depth - split):
        levels.append(_collapsed(*levels[-1]))
    return levels


def _runs_of_keys(keys: np.ndarray, least: int = 1 << 17) -> Iterator[slice]:
    """Sorted keys in runs of whole keys with at least so many rows (but for the last)."""
    at = 0
    while at < len(keys):
        last = min(at + least, len(keys)) - 1
        end = int(np.searchsorted(keys, keys[last], "right"))
        yield slice(at, end)
        at = end


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of each bucket (the first column), which come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            of = batch.column(0).to_numpy()
            if held and held[0].column(0)[0].as_py() != of[0]:
                yield held[0].column(0)[0].as_py(), held
                held = []
            end = int(np.searchsorted(of, of[0], "right"))
            held.append(batch.slice(0, end))
            batch = batch.slice(end)
    if held:
        yield held[0].column(0)[0].as_py(), held


GRAM, NODE = 1, 0
_ROWS = "bucket int, kind int, k long, n long, m long, lw double, grams binary"


def first_pass(counts: DataFrame, depth: int, split: int, flush: int = 3 << 19) -> DataFrame:
    """Rows of kind GRAM: a bucket's n-grams, packed in runs of whole keys; rows of kind NODE, for the level `split`: k (the node), n (zeros), m (ones) and lw."""

    def rows(bucket: int, kind: int, *columns: np.ndarray | bytes) -> pa.RecordBatch:
        size = 1 if kind == GRAM else len(columns[0])
        head = [pa.array(np.full(size, bucket, np.int32)), pa.array(np.full(size, kind, np.int32))]
        none = [pa.nulls(size, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())]
        body = [*none, pa.array([columns[0]], pa.binary())] if kind == GRAM else [*(pa.array(c) for c in columns), pa.nulls(size, pa.binary())]
        return pa.RecordBatch.from_arrays([*head, *body], ["bucket", "kind", "k", "n", "m", "lw", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, part in _buckets(batches):
            parts, size = [], 0
            for blob in (x for batch in part for x in batch.column(1)):
                parts.append(unpacked(blob.as_py()))
                size += len(parts[-1][0])
                if size >= 2 * flush:
                    parts = [_summed(parts)]
                    size = len(parts[0][0])
            whole = _summed(parts)
            for at in _runs_of_keys(whole[0] >> (8 * (depth - split + 1))):
                g, n, m = (c[at] for c in whole)
                yield rows(bucket, GRAM, packed(g, n, m))
                levels = _levels(g, n, depth, split)
                for i in range(8):
                    top = _nodes(levels, i)[0][-1]
                    yield rows(bucket, NODE, top.ids, top.n0, top.n1, top.weighted)

    return counts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _ROWS)


def upper_levels(nodes: DataFrame, split: int) -> DataFrame:
    """bucket, k, a and b of each node of the level `split`: its decision's probability of a 1 is a + b times that of the subtree from there on."""
    levels = [nodes.select("bucket", "k", "n", "m", "lw")]
    own = log_estimate(F.col("n"), F.col("m"))
    parent = F.shiftleft(F.shiftright("k", 16), 8) + F.col("k").bitwiseAND(255)
    for _ in range(split):
        kids = levels[-1].groupBy(parent.alias("k")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("lw").alias("kids")).withColumn("own", own)
        top = F.greatest("own", "kids")
        lw = top + F.log(F.exp(F.col("own") - top) + F.exp(F.col("kids") - top)) - math.log(2)
        levels.append(stage(kids.withColumn("lw", lw).withColumn("w", F.exp(F.col("own") - math.log(2) - F.col("lw")))))
    found = levels.pop().withColumns({"a": F.lit(0.0), "b": F.lit(1.0)})
    while levels:
        one = (F.col("m") + 0.5) / (F.col("n") + F.col("m") + 1.0)
        above = found.select(F.col("k").alias("up"), (F.col("a") + F.col("b") * F.col("w") * one).alias("a"), (F.col("b") * (1.0 - F.col("w"))).alias("b"))
        found = levels.pop().withColumn("up", parent).join(above, "up").drop("up")
    return found.select("bucket", "k", "a", "b")


def second_pass(grams: DataFrame, upper: DataFrame, depth: int, split: int) -> DataFrame:
    """g, m and the logarithm of its last byte's probability."""

    def logs(g: np.ndarray, n: np.ndarray, nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        levels, lp = _levels(g, n, depth, split), np.zeros(len(g))
        for i in range(8):
            path, place = _nodes(levels, i)
            p = (path[0].n1 + 0.5) / (path[0].n0 + path[0].n1 + 1.0)
            to = np.arange(len(p))
            for below, here in zip(path, path[1:], strict=False):
                to = below.up[to]
                w = np.exp(here.own - math.log(2) - here.weighted)
                own = w * (here.n1 + 0.5) / (here.n0 + here.n1 + 1.0)
                p = own[to] + (1.0 - w[to]) * p
            top = np.searchsorted(nodes, path[-1].ids)[to]
            p = np.clip(a[top] + b[top] * p, 1e-7, 1 - 1e-7)[place]
            lp += np.log10(np.where(g >> (7 - i) & 1, p, 1.0 - p))
        return lp

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _buckets(batches):
            rows = pa.Table.from_batches([x.select(["kind", "k", "a", "b"]) for x in part])
            at = rows.column("kind").to_numpy() == NODE
            k, a, b = (rows.column(c).to_numpy()[at] for c in ("k", "a", "b"))
            order = np.argsort(k)
            nodes, a, b = k[order].astype(np.int64), a[order], b[order]
            for blob in (x for batch in part for x in batch.column("grams") if x.is_valid):
                g, n, m = unpacked(blob.as_py())
                yield pa.record_batch({"g": g, "m": m, "lp": logs(g, n, nodes, a, b)})

    none = lambda kind: F.lit(None).cast(kind)
    rows = grams.select("bucket", F.lit(GRAM).alias("kind"), none("long").alias("k"), none("double").alias("a"), none("double").alias("b"), "grams")
    both = rows.unionByName(upper.select("bucket", F.lit(NODE).alias("kind"), "k", "a", "b", none("binary").alias("grams")))
    return both.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "g long, m long, lp double")


def gram_logs(rows: DataFrame, depth: int, split: int = 4) -> DataFrame:
    """g, m and the logarithm of its last byte's probability for each distinct gram of the texts; rows: text and t (whether to learn from it)."""
    split, buckets = min(split, depth), 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stage(first_pass(gram_counts(rows, depth, split, buckets), depth, split))
    return second_pass(found.where(F.col("kind") == GRAM), upper_levels(found.where(F.col("kind") == NODE), split), depth, split)


def least_of_most(counts: DataFrame, column: str, most: int) -> int:
    """The least count such that at most `most` rows have it or more, to a sixteenth of a doubling."""
    step = F.floor(F.log2(column) * 16)
    total, least = 0, 1 << 62
    for r in sorted(counts.where(F.col(column) > 0).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("least")).collect(), key=lambda r: -r.step):  # 1008 rows at most
        total += r.n
        if total > most:
            break
        least = r.least
    return least


class Memo:
    """The logarithms of packed n-grams that are hot; where two share a slot, by bisection."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray, bits: int = 22):
        self.keys, self.logs, self.bits = keys, logs, bits  # keys: sorted
        self.at = np.zeros(1 << bits, np.int32)
        self.at[self._slots(keys)] = np.arange(len(keys))

    def _slots(self, g: np.ndarray) -> np.ndarray:
        return ((g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def logs_of(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """0 for those that aren't hot, and their positions."""
        if not len(self.keys):
            return np.zeros(len(g)), np.arange(len(g))
        at = self.at[self._slots(g)]
        miss = np.flatnonzero(self.keys[at] != g)
        at[miss] = np.minimum(np.searchsorted(self.keys, g[miss]), len(self.keys) - 1)
        cold = miss[self.keys[at[miss]] != g[miss]]
        out = self.logs[at].astype(np.float64)
        out[cold] = 0.0
        return out, cold


def score(docs: DataFrame, train: Column | None = None, depth: int = 6, hot: int = 17, hot_grams: int = 21) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and n_bytes (of the text as read) for every row of docs.

    train: whether the model learns from a row; all rows by default.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select("doc_id", "text", (F.lit(True) if train is None else train).alias("t"))
    learn = rows.where("t")
    words = stage(word_counts(learn))
    ends = learn.count()
    n, v = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    n, v = (n or 0) + ends, v + (ends > 0)
    often = words.where(F.col("n") >= max(2, n * 2.0**-hot)).toArrow()  # at most 2**hot words
    logs = stage(gram_logs(rows, depth))
    least = least_of_most(logs, "m", 1 << hot_grams)
    top = logs.where(F.col("m") >= least).select("g", F.col("lp").cast("float").alias("lp")).toArrow()  # at most 2**hot_grams
    keys, lps = top.column("g").to_numpy(), top.column("lp").to_numpy()
    order = np.argsort(keys)
    model = spark.sparkContext.broadcast((dict(zip(often.column("word").to_pylist(), often.column("n").to_pylist(), strict=True)), keys[order], lps[order]))
    del top, keys, lps, order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, memo = model.value[0], kept(model, lambda m: Memo(m[1], m[2]))
        for batch in batches:
            column = batch.column(2)
            for part in _batches(column):
                texts = [canonical(column[i].as_py()) for i in part]
                packed, starts = _grams(texts, depth)
                each, cold = memo.logs_of(packed)
                scores = np.add.reduceat(each, starts)
                ends_at = np.searchsorted(cold, np.append(starts, len(packed))).astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(ends_at), pa.array(packed[cold]))
                tokens, known, base, rare, times = [], [], [], [], []
                for t in texts:
                    seen = Counter(map(_name, t[:-1].split()))
                    here = [(k, c) for w, k in seen.items() if (c := counts.get(w))]
                    rest = {w: k for w, k in seen.items() if w not in counts}
                    tokens.append(sum(seen.values()) + 1)
                    known.append(sum(k for k, _ in here) + (ends > 0))
                    base.append(sum(k * math.log10(c + 1) for k, c in here) + math.log10(ends + 1))
                    rare.append(list(rest))
                    times.append(list(rest.values()))
                taken = batch.take(pa.array(part))
                yield pa.RecordBatch.from_arrays(
                    [taken.column(0), taken.column(1), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(scores), pa.array([len(t) for t in texts], pa.int64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32())), others],
                    ["uid", "doc_id", "n_tokens", "known", "base", "score", "n_bytes", "rare", "times", "cold"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    scored = stage(numbered.mapInArrow(run, f"uid long, doc_id {kind}, n_tokens long, known long, base double, score double, n_bytes long, rare array<binary>, times array<int>, cold array<bigint>"))
    model.destroy()
    rest = scored.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    more = rest.join(words, "word").groupBy("uid").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("plus"))
    colder = scored.select("uid", F.explode("cold").alias("g")).join(logs.where(F.col("m") < least), "g").groupBy("uid").agg(F.sum("lp").alias("colder"))
    return scored.drop("rare", "times", "cold").join(more, "uid", "left").join(colder, "uid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("plus", F.lit(0.0)) - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("score") + F.coalesce("colder", F.lit(0.0))).alias("score"),
        "n_bytes",
    )


def score_held_out(docs: DataFrame, mod: int = 7, **options) -> DataFrame:
    """As score, learning from the rows outside the held-out part; with held_out and bits_per_byte."""
    out = score(docs, ~held_out("doc_id", mod), **options)
    return out.select("doc_id", held_out("doc_id", mod).alias("held_out"), *out.columns[1:-1], (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"))
