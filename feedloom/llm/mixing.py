"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent between 0 (all equal) and 1 (as they are) and normalised. The exponent
is bisected to the flattest mix that keeps a target entropy or a limit on repetitions. The weights are realised under a token
budget as permutations: an epoch of a source is all its documents in an order of its own, given by a keyed hash, and cut into
blocks by ranges of that hash; whole epochs are taken until the rest of the budget falls into one, of which the first
documents are taken.

Finding where the last epoch ends needs a running total, and a source may hold a third of all rows. Totals are therefore
taken per block first; only the one block of each source in which the budget ends is ordered by document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import fresh, store

#: Candidate exponents per pass, and passes: 33^5 steps, one small aggregate over the source table each.
FAN, PASSES = 32, 5


@dataclass(frozen=True)
class Mix:
    exponent: float
    total: float
    sources: DataFrame  # source, tokens, weight, epochs


def token_count(text: Column) -> Column:
    """Size of a text in tokens for the budget: one per four UTF-8 bytes, at least one. Null counts as empty."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long"))


def _measures(sources: DataFrame, total: float, exponents: list[float]) -> list[tuple[float, float, float]]:
    """Entropy (share of its maximum) and repetitions (most over fewest epochs) of each exponent, in one aggregate."""
    share = F.col("tokens") / F.lit(total)
    powers = sources.select("tokens", F.explode(F.array(*map(F.lit, exponents))).alias("e")).withColumn("w", F.pow(share, "e"))
    row = powers.groupBy("e").agg(
        F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.count("*").alias("n"), F.max(F.col("w") / share).alias("most"), F.min(F.col("w") / share).alias("fewest")
    )
    out = []
    for r in sorted(row.collect(), key=lambda r: r.e):
        entropy = math.log(r.z) - r.wl / r.z
        out.append((r.e, entropy / math.log(r.n) if r.n > 1 else 1.0, r.most / r.fewest))
    return out


def find_exponent(sources: DataFrame, total: float, entropy: float, repetitions: float) -> float:
    """The largest exponent whose entropy reaches the target, raised if rare sources would repeat more often than allowed.

    Entropy and repetitions both fall as the exponent grows, so both bounds are found by bisection over many candidates at
    once. Shares that reach the target as they are keep the exponent 1; a target above any mix gives 0.
    """

    def bisect(fits) -> float:
        """The largest exponent that fits, if all below fit too."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            steps = [low + (high - low) * i / FAN for i in range(FAN + 1)]
            good = [e for e, h, r in _measures(sources, total, steps) if fits(h, r)]
            if len(good) == len(steps):
                return high
            at = steps.index(max(good)) if good else 0
            low, high = steps[at], steps[at + 1]
        return low

    flat = bisect(lambda h, r: h >= entropy)
    # The smallest exponent within the limit: just above the largest beyond it.
    beyond = bisect(lambda h, r: r > repetitions)
    allowed = 0.0 if beyond == 0.0 else min(1.0, beyond + (FAN ** -PASSES))
    return max(flat, allowed)


def plan(documents: DataFrame, entropy: float = 0.95, repetitions: float = 4.0, budget: float | None = None) -> Mix:
    """Weights and epochs of the sources of (source, tokens). Without a budget it is the smallest that takes every document."""
    sources = store(documents.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    total = float(sources.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return Mix(1.0, 0.0, sources.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("epochs")))
    exponent = find_exponent(sources, total, entropy, repetitions)
    power = F.pow(F.col("tokens") / F.lit(total), F.lit(exponent))
    z, fewest = sources.agg(F.sum(power), F.min(power / F.col("tokens"))).first()
    weighted = sources.withColumn("weight", power / F.lit(z))
    if budget is None:
        epochs = power / F.col("tokens") / F.lit(fewest)
    else:
        epochs = F.col("weight") * F.lit(float(budget)) / F.col("tokens")
    # Rounding must not cut the last document of a whole epoch.
    return Mix(exponent, total, weighted.withColumn("epochs", F.round(epochs, 9)))


def mix_rows(documents: DataFrame, text_column: str = "text", source_column: str = "source", id_column: str = "doc_id", entropy: float = 0.95, repetitions: float = 4.0,
             budget: float | None = None, seed: int = 0, block_tokens: int = 1 << 20) -> DataFrame:
    """The rows of the mix with their columns and three more: mix_epoch, mix_block, mix_tokens (fresh names, if taken).

    A source's rows come once per whole epoch, and in the last epoch until its budget is used up: a document is taken if
    the budget is not used up before it, so a source exceeds its budget by less than one document. A null source is a
    source. Order within an epoch is by a keyed hash of id and text, then by id and the hash of the text; rows that
    repeat both are taken together. Null and empty texts weigh one token. An empty table gives no rows.
    """
    epoch, block, tokens = (fresh(documents.columns, n) for n in ("mix_epoch", "mix_block", "mix_tokens"))
    source, own_id, text = (F.col(f"`{c}`") for c in (source_column, id_column, text_column))
    slim = documents.select(source.alias("source"), token_count(text).alias("tokens"))
    mixed = plan(slim, entropy, repetitions, budget)
    # A block is a range of the hash, as wide for every source as its tokens ask for.
    sources = mixed.sources.withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("long"))).withColumn("whole", F.floor("epochs").cast("int")).select(
        F.col("source").alias("s_source"), "blocks", "whole", ((F.col("epochs") - F.floor("epochs")) * F.col("tokens")).alias("rest"))
    content = F.xxhash64(own_id, text)
    reserved = {n: fresh(documents.columns, n) for n in ("mix_hash", "mix_content", "s_source", "blocks", "whole", "rest")}
    sources = sources.select(*[F.col(n).alias(reserved[n]) for n in ("s_source", "blocks", "whole", "rest")])

    def keyed(round_: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), round_, content), 2)

    def place(blocks: Column, hashed: Column) -> Column:
        return F.floor(hashed / F.lit(float(1 << 62)) * blocks).cast("long")

    whole, rest, blocks = (F.col(reserved[n]) for n in ("whole", "rest", "blocks"))
    joined = documents.join(sources, source.eqNullSafe(F.col(reserved["s_source"])))  # the plan's source table; AQE broadcasts it if small
    last = keyed(whole)
    keys = joined.where(rest > 0).select(
        F.col(reserved["s_source"]).alias("source"), place(blocks, last).alias("block"), last.alias("hash"), own_id.alias("id"), content.alias("content"), token_count(text).alias("tokens"), rest.alias("rest")
    )
    keys = store(keys, "order")
    per_block = keys.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = per_block.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") >= F.col("rest")))
    edge = store(edge.select(F.col("source").alias("e_source"), F.col("block").alias("e_block"), "before"), "edges")
    inner = keys.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("block") == F.col("e_block")))
    inside = Window.partitionBy("source").orderBy("hash", "id", "content")
    through = F.sum("tokens").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.sum("tokens").over(Window.partitionBy("source", "hash", "id", "content"))
    running = inner.withColumn("at", F.col("before") + through - own)
    stop = running.where(F.col("at") < F.col("rest")).groupBy("source").agg(F.max(F.struct("hash", "id", "content")).alias("stop"))
    names = {n: fresh(documents.columns, n) for n in ("mix_stop", "mix_of", "mix_last")}
    # Stored, so that its size is known and a table of few sources is broadcast instead of shuffling the texts.
    stops = store(stop, "stops").select(F.col("source").alias(names["mix_of"]), F.col("stop").alias(names["mix_stop"]))
    ended = joined.join(stops, source.eqNullSafe(F.col(names["mix_of"])), "left")
    is_last = F.struct(last.alias("hash"), own_id.alias("id"), content.alias("content")) <= F.col(names["mix_stop"])
    upto = F.when(F.coalesce(is_last, F.lit(False)), whole).otherwise(whole - 1)
    return (
        ended.withColumn(names["mix_last"], upto).where(F.col(names["mix_last"]) >= 0)
        .withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col(names["mix_last"]))))
        .withColumn(block, place(blocks, keyed(F.col(epoch)))).withColumn(tokens, token_count(text))
        .select(*[F.col(f"`{c}`") for c in documents.columns], epoch, block, tokens)
    )
