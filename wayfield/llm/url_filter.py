"""URL filters: host and path rules first, then a character language-model ratio.

Two smoothed variable-order Markov models over characters (as UTF-8 bytes), one of accepted and one of rejected
URLs, give each URL the difference of their log-likelihoods per character.  A URL is blocked if that
exceeds a calibrated threshold.

Labels and calibration.  Accepted and rejected URLs are by default those that the rules allow and block, so the
models carry the rules' decisions on to URLs that no rule fits; other labels can be given as columns.  A model that is
calibrated on what it was fitted on would know it by heart, so the labelled URLs are dealt into ``folds`` by host, each fold is scored by
models that have seen none of its hosts, and the threshold comes from these scores.

Counts, models and threshold come from all different labelled URLs; there is no sample.  A byte and up to `order` before it are a gram, packed into one
number.  Grams are counted by class and fold, their ends' counts follow from theirs, and as a context's probability is a weighted sum with the next shorter
one's, those of all grams are found by one join for each length, with all folds' models side by side.  A join of positions and grams (by a broadcast for
the most frequent) scores the texts, in whole multiples of 2^-36, so the order of rows changes nothing.  No join before it has a key with more than 256 rows.
`Markov`, `ratio` and `threshold` state the same for a list of texts; tests hold the tables against them.

Nulls and odd cases: a null URL, or one without ``://``, has an empty host and path and meets no rule; the models judge
the URL's whole text (null: empty), and an empty text is allowed; very long URLs are judged whole; equal URLs get equal
verdicts and count once in the models, repeated rows are judged on their own; of rules of equal length that both fit, the
later one holds; without two rejected and two accepted URLs to calibrate on the models block nothing; columns other than page_id
and url are not read, so their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, stage, values

#: (action, host, path): fixed values of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str = "url") -> Column:
    return F.translate(F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(rules=RULES) -> Column:
    """The longest rule (host and path) that fits columns host and path, as action and text."""
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer one wraps and so overrides
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        found = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


@dataclass
class Markov:
    """Interpolated (Witten-Bell) model of bytes; a context's length varies up to `order` with what was seen.  Texts end with a newline."""

    order: int
    counts: dict = field(default_factory=lambda: defaultdict(Counter))
    known: dict = field(default_factory=dict)

    def fit(self, texts) -> Markov:
        for t in texts:
            t = b"\n" + t + b"\n"
            for i in range(1, len(t)):
                for k in range(min(i, self.order) + 1):
                    self.counts[t[i - k : i]][t[i]] += 1
        self.counts = {c: (n, sum(n.values())) for c, n in self.counts.items()}
        return self

    def p(self, context: bytes, c: int) -> float:
        if (got := self.known.get((context, c))) is not None:
            return got
        p = lower = self.p(context[1:], c) if context else 1 / 256
        if context in self.counts:
            n, total = self.counts[context]
            p = (n.get(c, 0) + len(n) * lower) / (total + len(n))
        if len(self.known) < 1_000_000:
            self.known[(context, c)] = p
        return p

    def log_likelihood(self, text: bytes) -> float:
        t = b"\n" + text + b"\n"
        return sum(math.log(self.p(t[max(0, i - self.order) : i], t[i])) for i in range(1, len(t)))


def ratio(accepted: Markov, rejected: Markov, text: bytes) -> float:
    return (rejected.log_likelihood(text) - accepted.log_likelihood(text)) / (len(text) + 1)


def judged_part(url: str = "url") -> Column:
    """What the models see: the whole URL, lower-cased (A-Z)."""
    return F.translate(F.coalesce(F.col(url), F.lit("")), _UPPER, _LOWER)


def threshold(scores: list[tuple[float, bool]], care: float) -> float:
    """Where the share of rejected URLs below and `care` times the share of accepted URLs above are least, in the middle of its gap."""
    scores, n = sorted(scores), Counter(bad for _, bad in scores)
    cost = best = care
    at = scores[0][0] - 1.0
    for i, (s, bad) in enumerate(scores):
        cost += 1 / n[True] if bad else -care / n[False]
        after = scores[i + 1][0] if i + 1 < len(scores) else s + 1.0
        if cost < best - 1e-12 and after > s:
            best, at = cost, (s + after) / 2
    return at


UNIT = 2.0**36  # parts of a logarithm that scores are counted in


@dataclass
class Filter:
    most: float  # the threshold
    scores: DataFrame  # t, n (rows with it) and score of all different texts; for labelled ones that were calibrated on bad and out, the score without their fold

    @property
    def out_of_fold(self) -> list[tuple[float, bool]]:
        """(score, rejected) of what was calibrated on; to look at, where that is little."""
        return [(r.out, r.bad) for r in self.scores.where("out IS NOT NULL").select("out", "bad").collect()]


def grams(order: int):
    """A column function: the gram of each byte of a text and of the newline behind it, its length in the highest byte."""

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str) -> np.ndarray:
            t = np.frombuffer(b"\n" + text.encode() + b"\n", np.uint8).astype(np.int64)
            out = t[1:].copy()
            for k in range(1, order + 1):
                out[k - 1 :] |= t[: max(0, len(t) - k)] << (8 * k)
            return out | (np.minimum(np.arange(1, len(t)), order) + 1) << 56

        return texts.map(one)

    return run


def _logs(positions: DataFrame, order: int, folds: int) -> DataFrame:
    """gram, n (positions that have it) and d0 to d<folds>: its log-likelihood ratio with all counts, and without those of each fold."""
    kinds = [(bad, k) for bad in (False, True) for k in range(folds)]
    name = lambda bad, k: f"c{int(bad)}_{k}"
    own = positions.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when((F.col("bad") == bad) & (F.col("fold") == k), 1)).alias(name(bad, k)) for bad, k in kinds))
    ends = own.withColumn("m", F.explode(F.sequence(F.lit(1), F.shiftright("gram", 56).cast("int")))).withColumn("end", F.expr("(gram & (shiftleft(1L, 8 * m) - 1)) | shiftleft(CAST(m AS BIGINT), 56)"))
    ends = stage(ends.groupBy("end", "m").agg(F.sum(F.when(F.col("end") == F.col("gram"), F.col("n")).otherwise(0)).alias("n"), *(F.sum(name(*k)).alias(name(*k)) for k in kinds)))
    ends = ends.withColumns({"context": F.expr("shiftright(end & (shiftleft(1L, 56) - 1), 8) | shiftleft(CAST(m - 1 AS BIGINT), 56)"), "tail": F.expr("(end & (shiftleft(1L, 8 * (m - 1)) - 1)) | shiftleft(CAST(m - 1 AS BIGINT), 56)")})
    models = [(bad, without) for bad in (0, 1) for without in range(folds + 1)]  # without: 0 none, else the fold less 1
    counted = {f"n{b}_{w}": sum((F.col(f"c{b}_{k}") for k in range(folds) if k != w - 1), F.lit(0)) for b, w in models}
    ends = ends.withColumns(counted)
    of = ends.groupBy("context").agg(*(f(F.col(f"n{b}_{w}")).alias(f"{t}{b}_{w}") for b, w in models for t, f in (("all", F.sum), ("kinds", lambda c: F.count(F.when(c > 0, 1))))))
    met = ends.join(of, "context")
    share = {}
    for b, w in models:
        n, total, different = (F.col(f"{t}{b}_{w}") for t in ("n", "all", "kinds"))
        share |= {f"a{b}_{w}": F.when(total > 0, n / (total + different)).otherwise(0.0), f"b{b}_{w}": F.when(total > 0, different / (total + different)).otherwise(1.0)}
    met = stage(met.select("end", "m", "n", "tail", *(v.alias(k) for k, v in share.items())))
    found, shorter = [], None
    for m in range(1, order + 2):
        rows = met.where(F.col("m") == m)
        if shorter is not None:
            rows = rows.join(shorter.select(F.col("end").alias("tail"), *(F.col(f"p{b}_{w}").alias(f"q{b}_{w}") for b, w in models)), "tail")
        p = [(F.col(f"a{b}_{w}") + F.col(f"b{b}_{w}") * (F.lit(1 / 256) if shorter is None else F.col(f"q{b}_{w}"))).alias(f"p{b}_{w}") for b, w in models]
        shorter = stage(rows.select("end", "n", *p))
        found.append(shorter)
    ratio = [F.round(F.log(F.col(f"p1_{w}") / F.col(f"p0_{w}")) * UNIT).cast("long").alias(f"d{w}") for w in range(folds + 1)]
    return reduce(DataFrame.unionByName, found).where("n > 0").select(F.col("end").alias("gram"), "n", *ratio)


def calibrated(scores: DataFrame, care: float, accepted: int, rejected: int) -> float:
    """`threshold` of a table (score, bad) of so many rows: ranges of scores are summed up by themselves, and a few numbers a range reach the driver."""
    one = scores.groupBy("score").agg(F.count(F.when(~F.col("bad"), 1)).alias("good"), F.count(F.when(F.col("bad"), 1)).alias("bad"))
    one = stage(one.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    ranges = one.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("score").alias("low")).orderBy("low").collect()  # a row a range
    w = Window.partitionBy("part").orderBy("score")
    upto = one.select("part", "score", F.lead("score").over(w).alias("after"), *(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in ("good", "bad")))
    before, known = [0, 0], []
    for r, after in zip(ranges, [*ranges[1:], None], strict=True):
        known.append((r.part, *before, repr(after.low) if after else "NULL"))
        before = [before[0] + r.good, before[1] + r.bad]
    ranged = upto.join(F.broadcast(values(scores.sparkSession, "part int, good0 bigint, bad0 bigint, low double", known)), "part")
    cost = F.round(care + (F.col("bad") + F.col("bad0")) / F.lit(rejected) - care * (F.col("good") + F.col("good0")) / F.lit(accepted), 12)
    best = ranged.select(cost.alias("cost"), "score", F.coalesce("after", "low", F.col("score") + 1.0).alias("after")).orderBy("cost", "score").first()
    return (best.score + best.after) / 2 if best.cost < care - 1e-12 else ranges[0].low - 1.0


def fit(pages: DataFrame, accepted: Column, rejected: Column, order: int = 5, folds: int = 4, care: float = 4.0) -> Filter | None:
    """The threshold and all texts' scores, from all different labelled texts; None if they are too few to calibrate on."""
    if order > 6:
        raise ValueError("grams hold 7 bytes at most")
    label = F.when(F.col("t") != "", F.when(F.col("r"), True).when(F.col("a"), False))
    rows = pages.select(judged_part().alias("t"), accepted.alias("a"), rejected.alias("r")).select("t", label.alias("bad"))
    fold = F.crc32(F.regexp_extract("t", r"(?s)^.*?://([^/]*)", 1)) % folds
    texts = rows.groupBy("t").agg(F.bool_or("bad").alias("bad"), F.count(F.lit(1)).alias("n")).withColumn("fold", F.when(F.col("bad").isNotNull(), fold).cast("int"))
    texts = stage(texts.withColumn("id", F.monotonically_increasing_id()))
    size = Counter({(r.bad, r.fold): r["count"] for r in texts.where("bad IS NOT NULL").groupBy("bad", "fold").count().collect()})  # 2 * folds numbers
    whole = {b: sum(n for (bad, _), n in size.items() if bad == b) for b in (False, True)}
    sound = [k for k in range(folds) if all(whole[b] > size[b, k] for b in whole)]  # folds without which both classes are left
    scored = {b: sum(size[b, k] for k in sound) for b in whole}
    if min(scored.values()) < 2:
        return None
    positions = texts.select("id", "bad", "fold", F.explode(grams(order)("t")).alias("gram"))
    logs = stage(_logs(positions, order, folds))
    total = logs.agg(F.sum("n")).first()[0]
    met = hot_join(positions.select("id", "fold", "gram"), logs, ["gram"], "n", total)
    without = reduce(lambda out, k: F.when(F.col("fold") == k, F.col(f"d{k + 1}")).otherwise(out), sound, F.lit(None).cast("long"))
    sums = met.groupBy("id").agg(F.sum("d0").alias("d"), F.sum(without).alias("out"))
    long = (F.octet_length("t") + 1) * F.lit(UNIT)
    scores = stage(texts.join(sums, "id").select("t", "n", "bad", (F.col("d") / long).alias("score"), (F.col("out") / long).alias("out")))
    return Filter(calibrated(scores.where("out IS NOT NULL").select(F.col("out").alias("score"), "bad"), care, scored[False], scored[True]), scores)


def judge(pages: DataFrame, rules=RULES, accepted: Column | None = None, rejected: Column | None = None, **options) -> DataFrame:
    """page_id, host, path, rule, verdict and the models' score of every row (null without models)."""
    given = [F.lit(None).cast("boolean") if c is None else c for c in (accepted, rejected)]
    rows = pages.select("page_id", "url", host().alias("host"), path().alias("path"), given[0].alias("accepted"), given[1].alias("rejected")).withColumn("hit", rule(rules))
    allowed, blocked = (F.col("hit.action") == a for a in ("allow", "block"))
    found = fit(rows, allowed if accepted is None else F.col("accepted"), blocked if rejected is None else F.col("rejected"), **options)
    if found:
        total = found.scores.agg(F.sum("n")).first()[0]
        scored = hot_join(rows.withColumn("t", judged_part()), found.scores.select("t", "n", "score"), ["t"], "n", total)
    else:
        scored = rows.withColumn("score", F.lit(None).cast("double"))
    by_model = F.when((F.col("score") > (found.most if found else 0.0)) & (F.col("url") != ""), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", by_model).alias("verdict"), "score")
