"""Sharding by a minimax contiguous partition, in DataFrame operations only.

Rows with equal keys (here: equal texts) form an atomic group; groups stand in the order of their
fingerprints.  The smallest capacity C for which ``shards`` contiguous runs of groups suffice, each
of at most C bytes, is found by a search over C: a capacity is feasible if cutting greedily, as late
as possible, needs no more than ``shards`` runs.

How it scales.  Texts are read once, into a narrow staged table.  Copies are summed before anything
is ordered, and a hot group is spread over ``salts`` sub-rows, so no task holds all of its rows.
Fingerprint order is uniform by construction, so ``16**digits`` equal blocks replace a global sort:
prefix sums are windows within a block, and the driver keeps one sum for each block (at most
``16**digits`` numbers, whatever the input).  One job answers one greedy step for ``ways`` capacities
at once, so the search takes ``log(max group)/log(ways) * shards`` short jobs over the group table.

Nulls and odd cases: a null text counts as an empty one (size 1) and shares its group; very long texts are groups like any other; a null doc_id
is kept; repeated rows each get a slot and are spread like other copies; within a group slots go by salt, then doc_id; an empty table gives no rows;
groups larger than a fair share make capacity equal to the largest group; columns other than doc_id and text are not read, so their names
cannot clash.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, values


class _Prefix:
    """Looks up the largest group end at or below a position, for many positions in one job."""

    def __init__(self, groups: DataFrame, ends: list[tuple[int, int]]):
        self.groups, self.blocks, self.at = groups.select("block", "end_in_block"), [b for b, _ in ends], [0]
        for _, n in ends:
            self.at.append(self.at[-1] + n)
        self.total = self.at[-1]

    def floor(self, positions: set[int]) -> dict[int, int]:
        found, probes = {}, []
        for p in positions:
            if p >= self.total:
                found[p] = self.total
                continue
            k = bisect_right(self.at, p) - 1
            found[p] = self.at[k]
            if p > self.at[k]:
                probes.append((p, self.blocks[k], p - self.at[k]))
        if probes:
            ask = values(self.groups.sparkSession, "p bigint, block int, most bigint", probes)
            hit = self.groups.join(F.broadcast(ask), "block").where("end_in_block <= most")  # at most `ways` probes
            for r in hit.groupBy("p").agg(F.max("end_in_block").alias("e")).collect():
                found[r.p] += r.e
        return found


def _greedy(prefix: _Prefix, capacities: list[int], shards: int) -> list[list[int]]:
    """For each capacity the positions of its cuts; the last is the total if the capacity is feasible."""
    cuts = [[0] for _ in capacities]
    for _ in range(shards):
        want = {c[-1] + cap for c, cap in zip(cuts, capacities, strict=True)}
        found = prefix.floor(want)
        for c, cap in zip(cuts, capacities, strict=True):
            c.append(found[c[-1] + cap])
    return cuts


def _even(prefix: _Prefix, cap: int, shards: int) -> list[int] | None:
    """Cuts within the same capacity that give each shard its share of what is left, if they fit."""
    cuts = [0]
    for left in range(shards, 0, -1):
        rest = prefix.total - cuts[-1]
        want = min(cap, max(-(-rest // left), rest - (left - 1) * cap))
        at = prefix.floor({cuts[-1] + want})[cuts[-1] + want]
        if at == cuts[-1] and rest:
            at = prefix.floor({cuts[-1] + cap})[cuts[-1] + cap]
        cuts.append(at)
    return cuts if cuts[-1] == prefix.total else None


def minimax_cuts(prefix: _Prefix, largest: int, shards: int, ways: int = 512) -> list[int]:
    """Positions 0 = c0 <= c1 <= ... <= c_shards = total whose largest gap is the least possible."""
    low = max(-(-prefix.total // shards), largest)
    high = -(-prefix.total // shards) + largest  # always feasible: a shard that is closed holds over total / shards
    best = None
    while best is None or low < high:
        step = max(1, -(-(high - low) // (ways - 1)))
        tried = sorted({*range(low, high, step), high})
        cuts = _greedy(prefix, tried, shards)
        k = next(i for i, c in enumerate(cuts) if c[-1] == prefix.total)
        best, high = cuts[k], tried[k]
        low = tried[k - 1] + 1 if k else high
    return _even(prefix, high, shards) or best


def shard(docs: DataFrame, shards: int = 16, text: str = "text", salts: int = 64, digits: int = 3) -> DataFrame:
    """doc_id, size, text_crc32, group, shard and slot (gapless from 0 within its shard) for each row."""
    spark = docs.sparkSession
    body: Column = F.coalesce(F.col(text), F.lit(""))
    rows = stage(
        docs.select(
            "doc_id",
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.md5(body).alias("fp"),
            F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("salt"),
        )
    )
    parts = rows.groupBy("fp", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    block = F.conv(F.substring("fp", 1, digits), 16, 10).cast("int")
    in_block = Window.partitionBy("block")
    groups = stage(
        parts.withColumn("block", block)
        .withColumn("end_in_block", F.sum("bytes").over(in_block.orderBy("fp")))  # a range frame: all of a group ends together
        .withColumn("rows_to", F.sum("n").over(in_block.orderBy("fp", "salt").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("group_bytes", F.sum("bytes").over(Window.partitionBy("block", "fp")))
    )
    sums = groups.groupBy("block").agg(F.sum("bytes").alias("b"), F.sum("n").alias("n"), F.max("group_bytes").alias("g")).collect()  # <= 16**digits
    sums.sort(key=lambda r: r.block)
    prefix = _Prefix(groups, [(r.block, r.b) for r in sums])
    cuts = minimax_cuts(prefix, max((r.g for r in sums), default=0), shards) if sums else [0] * (shards + 1)

    starts, rows_before, seen = [], [], 0  # of blocks
    for r, at in zip(sums, prefix.at, strict=False):
        starts.append((r.block, at, seen))
        seen += r.n
    blocks = values(spark, "block int, block_at bigint, block_rows bigint", starts)
    placed = groups.join(F.broadcast(blocks), "block").select(  # <= 16**digits rows
        "fp", "salt", (F.col("block_at") + F.col("end_in_block")).alias("end"), (F.col("block_rows") + F.col("rows_to") - F.col("n")).alias("before"), "n"
    )
    placed = placed.withColumn("shard", sum((F.when(F.col("end") > c, 1).otherwise(0) for c in cuts[1:-1]), F.lit(0)).cast("int"))
    first = {r.shard: r.b for r in placed.groupBy("shard").agg(F.min("before").alias("b")).collect()}
    rows_before = values(spark, "shard int, shard_rows bigint", sorted(first.items()))
    placed = placed.join(F.broadcast(rows_before), "shard").select("fp", "salt", "shard", (F.col("before") - F.col("shard_rows")).alias("base"))
    # A key of this join and window is one salt of one group.
    return (
        rows.join(placed, ["fp", "salt"])
        .withColumn("slot", F.col("base") + F.row_number().over(Window.partitionBy("fp", "salt").orderBy("doc_id")) - 1)
        .select("doc_id", "size", "text_crc32", F.col("fp").alias("text_md5"), "shard", F.col("slot").cast("long").alias("slot"))
    )
