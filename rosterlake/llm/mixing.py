"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its token share to the power ``alpha``, normalised. alpha
is bisected (64 points a round, one aggregation each, so that no table of
sources is collected): first the largest that reaches the target entropy, a
share of the logarithm of the number of sources; then, where a source would be
repeated more than ``max_repeat`` times within the budget, the least that
stays within it. 1 leaves the shares as they are, 0 makes them even.

A source's budget is its weight times the total: whole epochs over all its
documents, then part of one. Documents are dealt to blocks of about
``block_docs``; the last epoch takes the blocks in a keyed order, and within
each the documents in a keyed order, as long as the budget holds. Only totals
of stretches (about the square root of the number of blocks) are summed up along
a source, blocks within their stretch and documents within their block, so a
source with a third of all rows is spread like any other.

Edge cases: null and empty sources are one source; null, empty or blank texts
have no tokens and are drawn with the whole epochs only; a source without
tokens has weight 0; repeated rows are drawn each; an empty table draws nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import row_key, settled
from .host_rules import words

ENTROPY_SHARE = 0.97
MAX_REPEAT = 4.0
BLOCK_DOCS = 1000
ROUNDS = 5
POINTS = 64


def token_shares(rows: DataFrame) -> DataFrame:
    """src, docs, tokens, share. rows: src, n_tokens."""
    sums = rows.groupBy("src").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    total = sums.agg(F.sum("tokens").alias("all_tokens"))
    return sums.join(F.broadcast(total)).withColumn("share", F.col("tokens") / F.col("all_tokens"))  # one row for all


def measured(shares: DataFrame, alphas: list[float], budget_share: float) -> list[tuple[float, float, float]]:
    """(alpha, entropy / most possible, largest number of repeats) for each alpha."""
    grid = F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha")
    p = F.pow("share", "alpha")
    sums = shares.select("share", grid).groupBy("alpha").agg(
        F.sum(p).alias("z"), F.sum(p * F.log("share")).alias("zl"), F.max(F.pow("share", F.col("alpha") - 1)).alias("top"), F.count("*").alias("k"))
    even = F.when(F.col("k") > 1, (F.log("z") - F.col("alpha") * F.col("zl") / F.col("z")) / F.log(F.col("k").cast("double"))).otherwise(1.0)
    return sorted(tuple(r) for r in sums.select("alpha", even, F.col("top") / F.col("z") * budget_share).collect())


def bisected(shares: DataFrame, good, largest: bool, low: float, high: float, budget_share: float) -> float:
    """The largest (or least) alpha in [low, high] that is good; where it is good changes once."""
    for _ in range(ROUNDS):
        step = (high - low) / POINTS
        points = measured(shares, [low + step * i for i in range(POINTS + 1)], budget_share)
        fits = [a for a, *rest in points if good(*rest)]
        if not points or not fits:
            return low if largest else high
        edge = max(fits) if largest else min(fits)
        low, high = (edge, min(high, edge + step)) if largest else (max(low, edge - step), edge)
    return low if largest else high


def temperature(shares: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeat: float = MAX_REPEAT, budget_share: float = 1.0) -> float:
    alpha = bisected(shares, lambda e, _: e >= entropy_share, True, 0.0, 1.0, budget_share)
    return bisected(shares, lambda _, r: r <= max_repeat, False, alpha, 1.0, budget_share)


def weights(shares: DataFrame, alpha: float) -> DataFrame:
    """src, docs, tokens, weight."""
    p = F.pow("share", F.lit(alpha))
    return shares.join(F.broadcast(shares.agg(F.sum(p).alias("z")))).select("src", "docs", "tokens", "all_tokens", (p / F.col("z")).alias("weight"))  # one row for all


def mix(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeat: float = MAX_REPEAT, budget_share: float = 1.0, block_docs: int = BLOCK_DOCS, seed: int = 0) -> DataFrame:
    """A row for each draw: doc_id, source, n_tokens, epoch (from 0), block, weight. budget_share: tokens to draw, as a share of all."""
    rows = settled(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("src"), F.size(words(F.col("text"))).cast("bigint").alias("n_tokens"), row_key().alias("key")))
    shares = settled(token_shares(rows))
    alpha = temperature(shares, entropy_share, max_repeat, budget_share)
    budget = F.round(F.col("weight") * F.col("all_tokens") * budget_share).cast("bigint")
    plan = weights(shares, alpha).withColumn("budget", budget).select(
        "src", F.round("weight", 9).alias("weight"), F.expr("budget div tokens").alias("epochs"), F.expr("budget % tokens").alias("rest"), F.ceil(F.col("docs") / block_docs).alias("blocks"))
    plan = settled(plan)
    dealt = rows.join(plan, "src").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "key"), "blocks"))
    out = [F.col("doc_id"), F.nullif("src", F.lit("")).alias("source"), F.col("n_tokens"), F.col("epoch").cast("bigint").alias("epoch"), F.col("block"), F.col("weight")]
    # whole epochs; a plain number of copies of each row, no shuffle
    full = dealt.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("epochs") - 1)))
    # the last one: blocks in keyed order, summed up by stretches of that order first, so that no task holds all blocks of a source
    blocks = dealt.groupBy("src", "block", "blocks", "epochs").agg(F.sum("n_tokens").alias("size")).withColumn("turn", F.xxhash64(F.lit(seed + 1), "epochs", "src", "block"))
    blocks = settled(blocks.withColumn("stretch", F.floor((F.col("turn") / F.lit(2.0**64) + 0.5) * F.ceil(F.sqrt("blocks")))))
    stretches = blocks.groupBy("src", "stretch").agg(F.sum("size").alias("size"))
    stretches = stretches.select("src", "stretch", F.expr("sum(size) over (partition by src order by stretch rows between unbounded preceding and current row) - size").alias("earlier"))
    within = F.expr("sum(size) over (partition by src, stretch order by turn, block rows between unbounded preceding and current row) - size")
    before = blocks.withColumn("within", within).join(stretches, ["src", "stretch"]).select("src", "block", (F.col("earlier") + F.col("within")).alias("before"))
    part = dealt.where("rest > 0 and n_tokens > 0").join(before, ["src", "block"]).where("before < rest")
    part = part.withColumn("upto", F.expr(f"before + sum(n_tokens) over (partition by src, block order by xxhash64({seed + 2}, epochs, key), doc_id rows between unbounded preceding and current row)"))
    part = part.where("upto <= rest").withColumn("epoch", F.col("epochs"))
    return full.select(*out).union(part.select(*out))
