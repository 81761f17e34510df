"""Problem 7: mix sources to target weights.

Temperature mixing. The weights of the sources are their natural token shares raised towards the targets,
``w(e) ~ natural^(1-e) * target^e``. The exponent is bisected: at 1 the mix is the target; if a budget asks for more
repetitions than a source may give, the largest exponent that keeps every repetition limit is taken. Without
targets of their own, ``w(e) ~ natural^e`` is bisected to a wanted entropy instead.

Without a budget the shares come first: the mix is the largest at which every source has its share and keeps its
limit, so the exponent is 1. One rare source with a large share can make that mix small; ``least_mix`` (0 unless
given) is the part of all usable tokens that the mix has to keep, and where the shares don't allow it, that size is the budget.

The weights are realised by block permutations: every full pass over a source takes all of it, and the last
pass takes blocks of documents in the order of a seeded hash while the budget lasts; only the one
block that crosses the budget is looked at document by document.

Defined results: source names ignore case, outer white space, and ``-``, ``_`` and space are one; shares are
divided by their sum over the sources that have both tokens and a target; a source without a target gets
nothing, a target without documents is out of reach and reported with a reached share of 0. Null ``max_repeats`` is 1.
Documents without tokens are never taken. Targets are a small table; more than ``MAX_SOURCES`` are an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.tokens import VOCABULARY, token_counts
from quern.session import cut_lineage

BLOCK_DOCS = 10_000
MAX_SOURCES = 100_000


def source_name(column: str = "source") -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(column), F.lit("")))), r"[\s_-]+", "_")


def tempered(natural: dict[str, float], target: dict[str, float], e: float) -> dict[str, float]:
    raw = {s: math.exp((1 - e) * math.log(natural[s]) + e * math.log(target[s])) for s in target}
    total = sum(raw.values())
    return {s: x / total for s, x in raw.items()}


def _bisect(good, low: float = 0.0, high: float = 1.0) -> float:
    """The largest value in [low, high] for which ``good`` holds, or ``low``."""
    if good(high):
        return high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if good(middle) else (low, middle)
    return low


def entropy_exponent(natural: dict[str, float], entropy: float) -> float:
    """The exponent at which natural^e has the wanted entropy (in nats); lower exponents are flatter."""

    def spread(e: float) -> float:
        raw = [x**e for x in natural.values()]
        return -sum(x / sum(raw) * math.log(x / sum(raw)) for x in raw)

    return _bisect(lambda e: spread(e) >= entropy)


def plan(tokens: dict[str, int], targets: dict[str, tuple[float, int]], budget: int | None = None, entropy: float | None = None, least_mix: float = 0.0) -> tuple[dict[str, float], float]:
    """(wanted tokens of each source, exponent)."""
    usable = {s: share for s, (share, _) in targets.items() if share and share > 0 and tokens.get(s, 0) > 0}
    if not usable:
        return {}, 1.0
    limit = {s: tokens[s] * max(1, targets[s][1]) for s in usable}
    every = sum(tokens[s] for s in usable)
    natural = {s: tokens[s] / every for s in usable}
    exponent = 1.0
    if entropy is not None:
        exponent = entropy_exponent(natural, entropy)
        usable = {s: x**exponent for s, x in natural.items()}
    total = sum(usable.values())
    target = {s: x / total for s, x in usable.items()}
    size = min(limit[s] / t for s, t in target.items())
    if budget is None and size >= least_mix * every:
        return {s: size * t for s, t in target.items()}, exponent
    wanted = budget if budget is not None else math.floor(least_mix * every)
    e = _bisect(lambda e: all(wanted * w <= limit[s] for s, w in tempered(natural, target, e).items()))
    return {s: min(limit[s], wanted * w) for s, w in tempered(natural, target, e).items()}, e if entropy is None else exponent


class Mix:
    """The plan over one table of documents; ``selection`` and ``report`` are DataFrames."""

    def __init__(self, documents: DataFrame, targets: DataFrame, budget: int | float | None = None, entropy: float | None = None, vocabulary: str = VOCABULARY, seed: int = 17, least_mix: float = 0.0):
        """``budget`` in tokens, or as a part of all tokens of the usable sources (a float); ``entropy`` as a part of that of equal shares."""
        spark = documents.sparkSession
        counts = token_counts(documents.withColumn("src", source_name()), "src", vocabulary=vocabulary)
        self.counts = cut_lineage(counts.select("doc_id", F.col("src").alias("source"), "tokens"))
        self.targets = targets.select(source_name().alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        wanted = self.targets.limit(MAX_SOURCES + 1).collect()
        if len(wanted) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources with targets")
        sums = self.counts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
        have = {r.source: (r.tokens, r.docs) for r in sums.join(F.broadcast(self.targets.select("source")), "source", "left_semi").collect()}
        limits = {r.source: (r.target_share or 0.0, r.max_repeats or 1) for r in wanted}
        self.sums = sums
        usable = [have[s][0] for s, (share, _) in limits.items() if share > 0 and s in have and have[s][0]]
        budget = math.floor(budget * sum(usable)) if isinstance(budget, float) else budget
        entropy = None if entropy is None else entropy * math.log(max(1, len(usable)))
        self.wanted, self.exponent = plan({s: t for s, (t, _) in have.items()}, limits, budget, entropy, least_mix)
        rows = []
        for s, want in self.wanted.items():
            held, docs = have[s]
            full = min(int(want // held), limits[s][1])
            rest = int(want - full * held) if full < limits[s][1] else 0
            rows.append((s, full, rest, max(256, docs // BLOCK_DOCS)))
        self.passes = spark.createDataFrame(rows, "source string, full int, rest long, blocks int")
        self.seed = seed

    def selection(self) -> DataFrame:
        """(doc_id, repeat, source, tokens): one row each time a document is taken; ``repeat`` starts at 1."""
        seed = F.lit(self.seed)
        docs = self.counts.where("tokens > 0").join(F.broadcast(self.passes), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", seed), F.col("blocks")))
        order = Window.partitionBy("source").orderBy(F.xxhash64("block", seed), "block")
        blocks = docs.groupBy("source", "block").agg(F.sum("tokens").alias("size")).withColumn("upto", F.sum("size").over(order))
        placed = docs.join(blocks, ["source", "block"])
        whole = placed.where("upto <= rest")
        inner = Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", F.lit(self.seed + 1)), "doc_id")
        crossing = placed.where("upto > rest and upto - size < rest").withColumn("run", F.sum("tokens").over(inner)).where("run + upto - size <= rest")
        last = whole.select("doc_id", "source", "tokens", (F.col("full") + 1).alias("repeat")).unionAll(crossing.select("doc_id", "source", "tokens", (F.col("full") + 1).alias("repeat")))
        every = docs.where("full >= 1").select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("repeat"))
        return every.unionAll(last).select("doc_id", "repeat", "source", "tokens")

    def report(self) -> DataFrame:
        """One row a source, wanted and reached side by side."""
        got = self.selection().groupBy("source").agg(F.sum("tokens").alias("taken"), F.count(F.lit(1)).alias("rows"), F.max("repeat").alias("most_repeats"))
        base = self.targets.join(self.sums, "source", "full").join(got, "source", "left")
        everything = Window.partitionBy()
        zero = F.lit(0)
        taken = F.coalesce("taken", zero)
        out = base.select("source", "target_share", "max_repeats", F.coalesce("tokens", zero).alias("tokens"), F.coalesce("docs", zero).alias("docs"), taken.alias("taken_tokens"), F.coalesce("rows", zero).alias("taken_rows"), F.coalesce("most_repeats", zero).alias("most_repeats"), (F.col("target_share").isNotNull() & (F.coalesce("tokens", zero) == 0)).alias("out_of_reach"))
        usable = F.when((F.col("target_share") > 0) & (F.col("tokens") > 0), F.col("target_share"))
        return out.select("*", (usable / F.sum(usable).over(everything)).alias("wanted_share"), F.try_divide(F.col("taken_tokens"), F.sum("taken_tokens").over(everything)).alias("reached_share"), F.lit(self.exponent).alias("exponent"))
