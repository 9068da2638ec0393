"""N-gram Jaccard join with index-level and answer-level skipping (exact set similarity by set relations).

A document's set is its distinct five-word shingles, as 64-bit hashes.  Two sets link when their
intersection is at least ``threshold`` percent of their union.  Only links between different sets are
sought: documents with equal sets are one class, known by a 128-bit digest.

Index.  Every class puts the first part of its set, in one global order, into inverted lists; sets
that link share a shingle there.  The order is by hash, except that shingles which stand in many
first parts come last, so that passages which many documents share don't fill the lists.

Index-level skipping.  Lists are ordered by size of set; a set meets only the block of sizes it can
link with, and skips entries whose position leaves too few shingles for a link.

Answer-level skipping.  Sets of a family are highly similar, so their answers differ little.  Members of long
lists are first compared with one hub of their family alone (the member that stands in most lists);
those that link take over the hub's answer, the component.  What is left to derive are links between
different components.  In large families blocks of sets meet blocks; in each block one set's overlaps with the other block are
counted, and every other set's overlaps are derived from these by the shingles in which it differs from that set; it gives only
as many links as join components, and blocks of the answered part aren't compared with each other.
Elsewhere the remaining candidates of the lists are compared.  No link between components is lost.

How it scales.  Sets never leave a task, and are made again from texts.  The shuffles hold first parts
(a fifth of the shingles) and, for candidates, their texts.  Shingles that come last are
broadcast: those in more than ``common`` first parts, where ``common`` doubles until they are ``bound`` at most.  Lists
with 2**-12 of all entries or more (4096 at most) are dealt over ``salts`` tasks and meet what belongs to them by a broadcast; a long list is
streamed, and in the second round lists of more than ``block`` entries are dealt into pairs of blocks as rows, so no task holds a whole one.
A class of copies, however large, is one row until the end, where its rows meet its answer in the same way.

Nulls and odd cases: null, empty and blank texts have an empty set (n 0) and link with nothing; fewer
than five words make one shingle; very long texts are read whole, one at a time in their part of a batch; a null doc_id takes part and is never a
component's id unless all are null; repeated rows are a class; ties do not occur (a link is met or not); columns other than doc_id and text are not
read by join, and one_of_each names its own columns apart from docs', so no name can clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, hot_join, stage, text_batches
from .components import components

_ODD = np.uint64(0x9E3779B97F4A7C15)


_RANDOM = np.random.Generator(np.random.PCG64(2024))
_LETTER = _RANDOM.integers(0, 2**64, 256, np.uint64, endpoint=False) | np.uint64(1)
_PLACE = _RANDOM.integers(0, 2**64, 1 << 16, np.uint64, endpoint=False) | np.uint64(1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow's batches in parts, so that a task holds the sets of few documents at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Each text's set: sorted distinct hashes.

    A word's hash is the sum of its bytes' random numbers, each times that of its place; a shingle's is a mix of those of its words.
    """
    out: list[np.ndarray] = []
    run, size = [], 0
    for t in texts:
        raw = (t or "").encode()
        if run and size + len(raw) > 1 << 19:
            out += _sets(run, width)
            run, size = [], 0
        run.append(raw)
        size += len(raw) + 1
    return out + (_sets(run, width) if run else [])


def _sets(raws: list[bytes], width: int) -> list[np.ndarray]:
    body = np.frombuffer((b" " + b" ".join(raws) + b" ").translate(_LOWER), np.uint8)
    blank = _SPACE[body]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    sizes = ends - starts
    offsets = np.cumsum(np.array([len(r) + 1 for r in raws], np.int64)) + 1  # where the next text starts
    cut = np.concatenate([[0], np.searchsorted(starts, offsets)])
    if not len(starts):
        return [np.empty(0, np.uint64) for _ in raws]
    inside = body[~blank]
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    turn = place >> 16  # words of over 65,536 bytes take the numbers again, times an odd one
    terms = _LETTER[inside] * _PLACE[place & 0xFFFF]
    if turn.any():
        terms *= (2 * turn + 1).astype(np.uint64)
    ids = _mixed(np.add.reduceat(terms, first) + sizes.astype(np.uint64) * _ODD)
    full = np.full(max(0, len(ids) - width + 1), width, np.uint64)
    for k in range(width):
        full = _mixed(full ^ ids[k : len(full) + k])
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= width:
            h = np.sort(full[a : b - width + 1])
            keep = np.ones(len(h), bool)
            np.not_equal(h[1:], h[:-1], out=keep[1:])
            out.append(h[keep])
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                h = _mixed(h ^ ids[k : k + 1])
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def first_part(n: int, threshold: int) -> int:
    """How many shingles of a set of n must stand in the index: n - ceil(threshold % of n) + 1."""
    return n - -(-n * threshold // 100) + 1


def in_order(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A sorted set with common shingles moved to its end."""
    if not len(common) or not len(s):
        return s
    last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
    return np.concatenate([s[~last], s[last]])


def common_shingles(docs: DataFrame, threshold: int, common: int, bound: int) -> np.ndarray:
    """Those in more than `common` first parts by hash, sorted; `common` doubles until they are `bound` at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def total() -> pa.RecordBatch:
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.record_batch({"g": pa.array(g.view(np.int64)), "n": pa.array(n)})

        parts, size = [], 0
        for batch in _slices(batches):
            for s in shingle_sets(batch.column(0).to_pylist()):
                parts.append(s[: first_part(len(s), threshold)] if len(s) else s)
                size += len(parts[-1])
                if size > 2_000_000:
                    yield total()
                    parts, size = [], 0
        if parts:
            yield total()

    often = stage(docs.select("text").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") > common))
    while often.where(F.col("n") > common).count() > bound:
        common *= 2
    rows = often.where(F.col("n") > common).select("g").toPandas()["g"]  # `bound` numbers at most
    return np.sort(rows.to_numpy(np.int64).view(np.uint64))


def _eligible(n: np.ndarray, pos: np.ndarray, i, j, threshold: int) -> np.ndarray:
    """Whether entries i and j of a list may link: sizes near enough, and enough shingles left from here on."""
    a, b = n[i], n[j]
    need = -(-threshold * (a + b) // (100 + threshold))
    return (np.minimum(a, b) * 100 >= threshold * np.maximum(a, b)) & (np.minimum(a - pos[i], b - pos[j]) >= need)


def other_pairs(node: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, family: np.ndarray, role: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of a list that may link and lie in different components, but for those of one large family (-1: none).

    role: entries of role 1 meet those of role 0; in a list that isn't dealt all have role 2 and meet those before them.
    """
    if len(root) < 2 or (root == root[0]).all():
        return
    start, end = np.searchsorted(n, -(-n * threshold // 100)), np.searchsorted(n, n * 100 // threshold, "right")
    for j in np.flatnonzero(role > 0):
        i = np.arange(start[j], j if role[j] == 2 else end[j])
        i = i[(root[i] != root[j]) & ((family[i] != family[j]) | (family[j] < 0)) & (role[i] != 1)]
        i = i[_eligible(n, pos, i, j, threshold)]
        if len(i):
            yield node[i], np.full(len(i), node[j])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of each list with two entries or more, from rows sorted by their first column."""
    rest: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        if rest and rest[-1][0][-1] == columns[0][0] == columns[0][-1]:
            rest.append(columns)
            continue
        columns = _packed([*rest, columns])
        edges = np.concatenate([[0], np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1])
        for a, b in zip(edges[:-1][np.diff(edges) > 1], edges[1:][np.diff(edges) > 1], strict=True):
            yield [c[a:b] for c in columns]
        rest = [[c[edges[-1] :] for c in columns]]
    if rest and sum(len(r[0]) for r in rest) > 1:
        yield _packed(rest)


def _packed(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _index(nodes: DataFrame, threshold: int, short: int, hot_entries: int = 1024, salts: int = 64) -> DataFrame:
    """The entries of all lists of two or more (pair false; long: of a list with more than `short`), and the pairs of short ones (pair true)."""

    def rows(pair: bool, g: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, long: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), pair)), *(pa.array(x) for x in (g, node, n, pos, long))], ["pair", "g", "node", "n", "pos", "long"])

    def entries_and_pairs(g: np.ndarray, n: np.ndarray, node: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        """From whole lists."""
        edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
        length = np.repeat(np.diff(edges), np.diff(edges))
        g, n, node, pos, length = (x[length > 1] for x in (g, n, node, pos, length))
        yield rows(False, g, node, n, pos, length > short)
        for k in range(1, short):  # entries of short lists that stand k apart
            i = np.flatnonzero((g[:-k] == g[k:]) & (length[k:] <= short))
            i = i[_eligible(n, pos, i, i + k, threshold)]
            a, b = node[i], node[i + k]
            yield rows(True, np.minimum(a, b), np.maximum(a, b), n[i], pos[i], np.zeros(len(i), bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []  # the last list so far, while it may be short
        flowing = None  # the long list that goes on
        for batch in batches:
            g, n, node, pos, hot = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if hot.any():
                yield rows(False, g[hot], node[hot], n[hot], pos[hot], np.ones(hot.sum(), bool))
                g, n, node, pos = (x[~hot] for x in (g, n, node, pos))
            if flowing is not None and len(g):
                k = int(np.searchsorted(g, flowing, "right"))
                yield rows(False, g[:k], node[:k], n[:k], pos[:k], np.ones(k, bool))
                if k < len(g):
                    flowing = None
                g, n, node, pos = (x[k:] for x in (g, n, node, pos))
            if not len(g):
                continue
            columns = _packed([*rest, [g, n, node, pos]])
            end = int(np.searchsorted(columns[0], columns[0][-1]))
            if end:
                yield from entries_and_pairs(*(c[:end] for c in columns))
            rest = [[c[end:] for c in columns]]
            if len(rest[0][0]) > short:
                flowing = rest[0][0][0]
                yield rows(False, rest[0][0], rest[0][2], rest[0][1], rest[0][3], np.ones(len(rest[0][0]), bool))
                rest = []
        if rest:
            yield from entries_and_pairs(*_packed(rest))

    entries = nodes.select("node", "n", F.posexplode("part").alias("pos", "g"))
    total = nodes.agg(F.sum(F.size("part"))).first()[0] or 0
    least = max(total * 2.0**-12, hot_entries)
    hot = stage(entries.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least).select("g", F.lit(True).alias("hot")))  # 4096 at most
    dealt = entries.join(F.broadcast(hot), "g", "left").select("g", "n", "node", "pos", F.coalesce("hot", F.lit(False)).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(salts))).otherwise(0)
    return dealt.repartition("g", salt).sortWithinPartitions("g", "n", "node").mapInArrow(run, "pair boolean, g long, node long, n long, pos int, long boolean")


def _families(entries: DataFrame) -> DataFrame:
    """node and hub: of the hubs of the long lists that hold a node, the most frequent.

    A list's hub is its entry that stands in most long lists for its size, and so has most in common with the others.
    """
    long = entries.where("long")
    share = long.groupBy("node").agg((F.count(F.lit(1)) / F.first("n")).alias("share"))
    hubs = stage(long.join(share, "node").groupBy("g").agg(F.max(F.struct("share", "node")).alias("hub"), F.count(F.lit(1)).alias("w_size")).select("g", F.col("hub.node").alias("hub"), "w_size"))
    total = hubs.agg(F.sum("w_size")).first()[0] or 0
    votes = hot_join(long.select("g", "node"), hubs, ["g"], "w_size", total).groupBy("node", "hub").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("node").agg(F.max(F.struct("votes", "hub")).alias("x")).select("node", F.col("x.hub").alias("hub"))


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of two groups of sets (positions).

    The first left set's are counted; those of the others are derived from them: a shingle that a set has and the first lacks adds
    its right sets' memberships, one that the first has and a set lacks takes them away.  Shingles on which the left sets agree cost nothing.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    is_left, is_right = np.zeros(len(sets), bool), np.zeros(len(sets), bool)
    is_left[left], is_right[right] = True, True
    first = at[owner == left[0]]
    base = np.zeros(at.max() + 1 if len(at) else 0, bool)
    base[first] = True
    known = np.bincount(owner, weights=base[at], minlength=len(sets))[right]
    n_left = np.bincount(at, weights=is_left[owner], minlength=len(base))
    n_right = np.bincount(at, weights=is_right[owner], minlength=len(base))
    differ = (n_left > 0) & (n_left < len(left)) & (n_right > 0)
    rank = np.cumsum(differ) - 1
    keep = differ[at]
    owner, at = owner[keep], rank[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(left), len(right)), np.float32)
    sign = base[differ]
    for start in range(0, int(differ.sum()), columns):
        a, b = np.searchsorted(at, [start, start + columns])
        dense = np.zeros((len(sets), columns), np.float32)
        dense[owner[a:b], at[a:b] - start] = 1
        from_first = dense[left]
        from_first[:, : len(sign[start : start + columns])] -= sign[start : start + columns]
        both += from_first @ dense[right].T
    return both + known[None, :].astype(np.float32)


def _spanning(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links between two groups of sets (positions), as many as join what the links join."""
    sizes = np.array([len(x) for x in sets], np.int64)
    both = overlaps(sets, left, right)
    u, v = np.nonzero(100 * both >= threshold * (sizes[left][:, None] + sizes[right][None, :] - both))
    place = np.arange(len(sets))

    def find(x: int) -> int:
        while place[x] != x:
            place[x] = place[place[x]]
            x = place[x]
        return x

    out = []
    for x, y in zip(left[u].tolist(), right[v].tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            place[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _family_links(families: DataFrame, nodes: DataFrame, roots: DataFrame, docs: DataFrame, threshold: int, most: int = 384, weight: int = 1 << 19) -> DataFrame:
    """Links (u, v) within large families that join different components: every set against every other, in blocks.

    A block has about `most` sets, and `weight` shingles, at most; sets that the first round put into the family's largest
    component stand in blocks of their own, which aren't compared with each other.
    """
    placed = families.join(nodes.select("node", "n"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = placed.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    main = by_root.groupBy("hub").agg(F.max(F.struct("k", "w", "root")).alias("main"), F.sum("k").alias("k"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    blocks = lambda k, w: F.ceil(F.greatest(k / most, w / weight)).cast("int")
    main = main.select("hub", F.col("k").alias("w_size"), F.col("main.root").alias("main"), blocks(F.col("main.k"), F.col("main.w")).alias("a"), blocks(F.col("k") - F.col("main.k"), F.col("w") - F.col("main.w")).alias("b"))
    inside = F.col("root") == F.col("main")
    at = F.pmod(F.xxhash64("node"), F.when(inside, F.col("a")).otherwise(F.col("b"))).cast("int")
    member = hot_join(placed, stage(main), ["hub"], "w_size", families.count()).withColumn("at", F.when(inside, F.col("b") + at).otherwise(at))
    # Blocks 0 to b-1 hold the others, b to a+b-1 the main component; block i meets every block j >= i, if i is below b.
    own = F.when(F.col("at") < F.col("b"), F.sequence(F.col("at"), F.col("a") + F.col("b") - 1)).otherwise(F.array().cast("array<int>"))
    met = F.sequence(F.lit(0), F.least("at", F.col("b") - 1))
    pairs = F.concat(F.transform(own, lambda j: F.struct(F.col("at").alias("i"), j.alias("j"))), F.transform(F.filter(met, lambda i: i != F.col("at")), lambda i: F.struct(i.alias("i"), F.col("at").alias("j"))))
    dealt = member.select("node", "hub", "at", F.explode(pairs).alias("x")).select("node", "hub", "at", "x.i", "x.j")
    texts = _texts(families.select("node"), nodes, docs)

    def run(table: pa.Table) -> pa.Table:
        node, at, i = (table.column(c).to_numpy() for c in ("node", "at", "i"))
        same = table.column("j").to_numpy()[0] == i[0]
        sets = shingle_sets(table.column("text").to_pylist())
        left, right = np.flatnonzero(at == i), np.flatnonzero(at == i if same else at != i)
        links = _spanning(sets, left, right, threshold) if len(left) and len(right) else []
        return pa.table({"u": pa.array([node[x] for x, _ in links], pa.int64()), "v": pa.array([node[y] for _, y in links], pa.int64())})

    return dealt.join(texts, "node").groupBy("hub", "i", "j").applyInArrow(run, "u long, v long").where("u <> v")


def _second_pairs(entries: DataFrame, roots: DataFrame, families: DataFrame, threshold: int, block: int = 4096) -> DataFrame:
    """Candidates of the lists between different components.

    A list of more than `block` entries is dealt: of its groups (large families, else components) the largest holds no candidates within
    itself, so blocks of the other groups' entries (role 1) meet blocks of all entries (role 0).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for _, n, node, pos, root, family, role in _lists(batches):
            for a, b in other_pairs(node, n, pos, root, family, role, threshold):
                parts.append((np.minimum(a, b), np.maximum(a, b)))
                size += len(a)
                if size > 100_000:
                    u, v = np.unique(np.stack(_packed(parts)), axis=1)
                    yield pa.record_batch({"u": u, "v": v})
                    parts, size = [], 0
        if parts:
            u, v = np.unique(np.stack(_packed(parts)), axis=1)
            yield pa.record_batch({"u": u, "v": v})

    placed = entries.join(roots, "node", "left").join(families, "node", "left").select("g", "n", "node", "pos", F.coalesce("root", "node").alias("root"), F.coalesce("hub", F.lit(-1)).alias("family"))
    placed = placed.withColumn("group", F.when(F.col("family") >= 0, -F.col("family") - 1).otherwise(F.col("root")))
    groups = placed.groupBy("g", "group").agg(F.count(F.lit(1)).alias("k"), F.min("root").alias("a"), F.max("root").alias("b"))
    lists = groups.groupBy("g").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("k").alias("w_size"), F.max(F.struct("k", "group")).alias("top")).where("a <> b")
    blocks = lambda k: F.ceil(k / block).cast("int")
    lists = stage(lists.select("g", "w_size", F.col("top.group").alias("top"), blocks(F.col("w_size")).alias("i"), blocks(F.col("w_size") - F.col("top.k")).alias("j")))
    met = hot_join(placed, lists, ["g"], "w_size", lists.agg(F.sum("w_size")).first()[0] or 0)
    spot = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(role).alias("role"))
    h = F.xxhash64("node")
    as_all = F.transform(F.sequence(F.lit(0), F.col("j") - 1), lambda j: spot(F.pmod(h, F.col("i")), j, 0))
    as_other = F.transform(F.sequence(F.lit(0), F.col("i") - 1), lambda i: spot(i, F.pmod(h, F.col("j")), 1))
    none = F.array().cast("array<struct<i:int,j:int,role:int>>")
    dealt = F.when(F.col("i") == 1, F.array(spot(F.lit(0), F.lit(0), 2))).when(F.col("j") == 0, none).otherwise(F.concat(as_all, F.when(F.col("group") != F.col("top"), as_other).otherwise(none)))
    rows = met.select("g", "n", "node", "pos", "root", "family", F.explode(dealt).alias("x"))
    key = F.when((F.col("x.i") == 0) & (F.col("x.j") == 0), F.col("g")).otherwise(F.xxhash64("g", "x.i", "x.j"))
    rows = rows.select(key.alias("key"), "n", "node", "pos", "root", "family", "x.role")
    return rows.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(run, "u long, v long").distinct()


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, few: int = 1_000_000) -> DataFrame:
    """node and text of one document of each wanted class."""
    need = stage(wanted.distinct().join(nodes, "node").select("node", F.col("doc_id").alias("d"), "digest"))
    small = F.broadcast(need) if need.count() <= few else need  # beyond that a shuffle
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).join(small, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("digest")))
    return stage(texts.select("node", "text"))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (u, v) whose sets, made again from the whole texts, link."""
    texts = _texts(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))), nodes, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            us, keep = batch.column(0).to_numpy(), np.zeros(batch.num_rows, bool)
            fresh = np.ones(len(us), bool)  # neighbours with the same u share its set
            fresh[1:] = us[1:] != us[:-1]
            firsts = shingle_sets(batch.column(2).filter(pa.array(fresh)).to_pylist())
            for k, (i, s) in enumerate(zip((np.cumsum(fresh) - 1).tolist(), shingle_sets(batch.column(3).to_pylist()), strict=True)):
                both = len(firsts[i]) + len(s) - len(np.unique(np.concatenate([firsts[i], s])))
                keep[k] = 100 * both >= threshold * (len(firsts[i]) + len(s) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep))

    first = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    both = first.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")
    return both.mapInArrow(run, "u long, v long")


def join(docs: DataFrame, threshold: int = 80, common: int = 32, bound: int = 1 << 21, short: int = 8, large: int = 64, block: int = 4096, hot_entries: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, root (the component's own number; null without words) and digest (of the text) for each row of docs.

    component_id is the smallest doc_id that links lead to.
    """
    spark = docs.sparkSession
    text_batches(spark)
    last = spark.sparkContext.broadcast(common_shingles(docs, threshold, common, bound))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n, high, low, parts = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist()):
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                high.append((digest >> 64) - (1 << 63))
                low.append((digest & ((1 << 64) - 1)) - (1 << 63))
                parts.append(in_order(s, last.value)[: first_part(len(s), threshold)].view(np.int64) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(parts, pa.list_(pa.int64()))],
                ["doc_id", "digest", "n", "high", "low", "part"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stage(docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(sets, f"doc_id {kind}, digest long, n long, high long, low long, part array<long>"))
    last.destroy()
    classes = rows.where("n > 0").groupBy("high", "low").agg(F.count(F.lit(1)).alias("w_size"), F.min(F.struct("doc_id", "digest")).alias("one"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("part").alias("part"))
    nodes = stage(classes.select(F.monotonically_increasing_id().alias("node"), "high", "low", "w_size", "one.*", "least", "n", "part"))
    known, total = nodes.select("node", "doc_id", "digest", "n"), nodes.count()
    index = stage(_index(nodes, threshold, short, hot_entries))
    entries = index.where(~F.col("pair")).drop("pair")
    families = stage(_families(entries).join(nodes.select("node", "n"), "node"), total)
    hubs = families.groupBy("hub").agg(F.count(F.lit(1)).alias("w_size")).join(nodes.select(F.col("node").alias("hub"), F.col("n").alias("m")), "hub")
    families = stage(hot_join(families, stage(hubs.withColumn("members", F.col("w_size")), total), ["hub"], "w_size", families.count()), total)
    near = families.where((F.col("node") != F.col("hub")) & (F.least("n", "m") * 100 >= F.greatest("n", "m") * threshold))
    pairs = index.where("pair").select(F.col("g").alias("u"), F.col("node").alias("v"))
    pairs = stage(pairs.unionByName(near.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v"))).distinct())
    links = stage(verified(pairs, known, docs, threshold))
    roots = stage(components(links), total)
    large = stage(families.where(F.col("members") >= large).select("node", "hub"), total)
    if large.count():
        links = links.unionByName(stage(_family_links(large, known, roots, docs, threshold)))
        roots = stage(components(links), total)
    more = stage(_second_pairs(entries, roots, large, threshold, block).join(pairs, ["u", "v"], "left_anti"))
    if more.count():
        links = links.unionByName(stage(verified(more, known, docs, threshold)))
        roots = stage(components(links), total)
    placed = nodes.select("node", "high", "low", "w_size", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = stage(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), total)
    answers = hot_join(placed, ids, ["root"], "members", total)
    answers = stage(answers.select("high", "low", "w_size", "root", "component_id"), total)
    met = hot_join(rows.select("doc_id", "digest", "n", "high", "low"), answers, ["high", "low"], "w_size", rows.count(), "left")
    return met.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root", "digest")


def one_of_each(docs: DataFrame, few: int = 1_000_000, **options) -> DataFrame:
    """docs without the rows that link, directly or not, with a row of smaller doc_id; rows without words stay.

    Of rows with one doc_id in a component the one with the least digest of its text stays, and one of its repetitions.
    """
    found = stage(join(docs, **options))
    least = found.where(F.col("root").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id")))  # join gives each component its least doc_id
    stay = stage(least.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("one")).select(F.col("one.doc_id").alias("d"), F.col("one.digest").alias("t")))
    n = stay.count()
    small = F.broadcast(stay) if n <= few else stay  # beyond that a shuffle
    d, t, words = (fresh(docs, c) for c in ("w_doc", "w_digest", "w_words"))
    small = small.select(F.col("d").alias(d), F.col("t").alias(t + "_"))
    rows = docs.withColumns({t: F.xxhash64("text"), words: F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))})
    left = rows.where(words).join(small, rows["doc_id"].eqNullSafe(small[d]) & (rows[t] == small[t + "_"]), "left_semi")
    if least.join(stay, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("t")), "left_semi").count() > n:  # rows with the doc_id and the text of one that stays
        left = left.dropDuplicates(["doc_id", t])
    return left.unionByName(rows.where(~F.col(words))).select(*docs.columns)
