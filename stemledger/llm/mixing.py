"""Mixing sources to target weights, with column functions only.

Temperature mixing: a source's weight is its share of tokens to the power of an exponent, normalised. Flatter
mixtures (smaller exponents) repeat small sources more; the exponent is bisected to the flattest
mixture within a repetition limit, or to a target entropy. The weights are then realised with a budget of tokens per
source: whole passes over the source, then blocks of a permutation of its documents up to the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemledger.llm.shared import staged

#: Bisection steps; each job evaluates all exponents that the next STEPS_PER_JOB steps can ask for.
STEPS = 30
STEPS_PER_JOB = 5
BYTES_PER_TOKEN = 4
#: Columns that ``mix`` adds.
COLUMNS = ("_epoch", "_block", "_order", "_tokens")


def estimated_tokens(text: str = "text") -> Column:
    """Tokens of a text at a fixed number of bytes each, one at least; null text counts as empty."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    return F.greatest(F.lit(1), F.floor((size + BYTES_PER_TOKEN - 1) / BYTES_PER_TOKEN)).cast("long")


def permuted(*parts: Column | str) -> Column:
    """A long between 0 and 2^60 from a digest of ``parts``: the order of a permutation, the same everywhere."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def exponent(sizes: DataFrame, ratio: float = 1.0, repetition: float | None = 1.25, entropy: float | None = None) -> float:
    """The exponent in [0, 1] for sources of ``tokens`` each when ``ratio`` times all tokens are drawn.

    With ``repetition``: the smallest (to 2^-30) at which no source is repeated more often. With ``entropy`` (natural logarithm):
    the smallest whose mixture has no more. 1 where no exponent meets the target. Sources may be many: each probe is one small aggregate.
    """
    total = sizes.agg(F.sum("tokens")).first()[0] or 1
    low, high = 0.0, 1.0  # at high the target holds, or it is 1

    for _ in range(STEPS // STEPS_PER_JOB):
        width = (high - low) / 2**STEPS_PER_JOB
        inner = [low + width * i for i in range(1, 2**STEPS_PER_JOB)]
        probed = sizes.withColumn("p", F.col("tokens") / F.lit(float(total))).withColumn(
            "x", F.explode(F.array(*[F.lit(v) for v in inner]))
        )
        power = F.pow("p", "x")
        rows = probed.groupBy("x").agg(
            F.sum(power).alias("z"), F.max(power / F.col("p")).alias("top"), F.sum(power * F.log("p")).alias("l")
        )
        if entropy is None:
            good = rows.select("x", (F.lit(ratio) * F.col("top") / F.col("z") <= F.lit(repetition)).alias("ok"))
        else:
            good = rows.select("x", (F.log("z") - F.col("x") * F.col("l") / F.col("z") <= F.lit(entropy)).alias("ok"))
        met = dict(good.collect())  # as many rows as probes
        for _ in range(STEPS_PER_JOB):
            middle = (low + high) / 2
            low, high = (low, middle) if met.get(middle, False) else (middle, high)
    return high


def mix(
    docs: DataFrame,
    repetition: float | None = 1.25,
    entropy: float | None = None,
    ratio: float = 1.0,
    block_tokens: int = 1_000_000,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` as often as the mixture draws them, with ``_epoch``, ``_block``, ``_order`` and ``_tokens``.

    Reading by (_epoch, _order) is the permuted order: blocks are permuted anew in each pass. A source's last, partial pass takes
    blocks in the order of its permutation, and of the block in which the budget ends the documents before the end. The document in
    which it ends is drawn if at least half of it lies within the budget, so that long documents are not left out as a rule, and
    in any case if its source would have no document otherwise. A source is off its budget by less than one document.
    Documents with one id share a place and a fate.

    A null source counts as the empty name, a null text as empty. Empty tables give no rows. Extra columns stay; columns named
    like the four above are replaced. A source may hold any part of the rows: its documents are spread over its blocks.
    """
    rows = docs.drop(*COLUMNS).withColumn("_source", F.coalesce("source", F.lit(""))).withColumn("_tokens", estimated_tokens())
    narrow = staged(rows.select("doc_id", "_source", "_tokens"), "mixing")
    sizes = staged(narrow.groupBy("_source").agg(F.sum("_tokens").alias("tokens")), "mixing-sources")
    total = sizes.agg(F.sum("tokens")).first()[0] or 1
    x = exponent(sizes, ratio, repetition, entropy)

    power = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(x))
    z = sizes.agg(F.sum(power)).first()[0] or 1.0
    budget = F.floor(power / F.lit(z) * F.lit(ratio * total) + F.lit(0.5)).cast("long")
    plan = sizes.withColumn("budget", budget).select(
        "_source",
        F.expr("budget div tokens").alias("_full"),
        (F.col("budget") - F.expr("budget div tokens") * F.col("tokens")).alias("_rest"),
        F.ceil(F.col("tokens") / block_tokens).cast("long").alias("_blocks"),
    )
    place = permuted(seed, F.col("doc_id").cast("string"))
    blocked = narrow.join(plan, "_source").withColumn("_place", place).withColumn("_block", F.expr("_place % _blocks"))
    by_source = Window.partitionBy("_source").orderBy(permuted(seed, F.col("_source"), F.col("_block").cast("string")), "_block")
    blocks = blocked.groupBy("_source", "_block", "_full", "_rest").agg(F.sum("_tokens").alias("size"))
    blocks = blocks.withColumn("_left", F.col("_rest") - F.sum("size").over(by_source) + F.col("size"))
    blocks = staged(blocks, "mixing-blocks")
    # only the block in which a budget ends is looked into; documents up to a place in it are drawn once more
    ending = blocks.filter("_left > 0 and _left < size").select(
        "_source", "_block", "_left", ((F.col("_full") == 0) & (F.col("_left") == F.col("_rest"))).alias("_only")
    )
    upto = Window.partitionBy("_source", "_block").orderBy("_place")
    half_inside = 2 * (F.col("_left") - F.col("sum") + F.col("own")) >= F.col("own")
    cuts = (
        blocked.select("_source", "_block", "_place", "_tokens")
        .join(ending, ["_source", "_block"])
        .withColumn("sum", F.sum("_tokens").over(upto))
        .withColumn("own", F.sum("_tokens").over(Window.partitionBy("_source", "_block", "_place")))
        .groupBy("_source", "_block")
        .agg(
            F.coalesce(
                F.max(F.when(half_inside, F.col("_place"))), F.min(F.when(F.col("_only"), F.col("_place")))
            ).alias("_cut")
        )
    )
    cut = F.when(F.col("_left") >= F.col("size"), F.lit(2**62)).otherwise(F.coalesce("_cut", F.lit(-1)))
    decided = blocks.join(cuts, ["_source", "_block"], "left").select("_source", "_block", "_full", cut.alias("_cut"))
    decided = staged(decided, "mixing-decided")
    spread = rows.join(plan.select("_source", "_blocks"), "_source").withColumn("_place", place)
    spread = spread.withColumn("_block", F.expr("_place % _blocks")).join(decided, ["_source", "_block"])
    times = F.col("_full") + F.when(F.col("_place") <= F.col("_cut"), 1).otherwise(0)
    drawn = spread.filter(times > 0).withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    order = permuted(seed, F.col("_epoch").cast("string"), F.col("_source"), F.col("_block").cast("string"))
    kept = [c for c in docs.columns if c not in COLUMNS]
    return drawn.withColumn("_order", order).select(*kept, *COLUMNS)
