"""Mixing sources to target weights by temperature.

Source weights are token shares to the power of an exponent between 0 (all sources alike) and 1 (as they
are), normalised. Both bounds are monotone in the exponent, so it is found by section: a hundred points,
then a hundred between the two that enclose it, down to 1e-6. Each section is one aggregation over the
source totals. A source's share of the budget is then realised as whole passes over its documents and a
part of one more. In every pass the blocks of a source are permuted, and the documents in each block.

DataFrame operations only; the driver sees one exponent at a time, never a row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.llm.common import WORD_CHARS, checkpointed

SECTIONS = 100
ROUNDS = 3


def source_totals(docs: DataFrame) -> DataFrame:
    """(source, tokens) of ``docs`` (source, n_tokens, ...) for sources with tokens."""
    return docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")


def _measures(totals: DataFrame, all_tokens: int, budget: int, points: Column) -> DataFrame:
    """For each exponent: entropy of the weights, and the most often that a source is repeated."""
    share = F.col("tokens") / F.lit(float(all_tokens))
    powers = totals.select("tokens", F.explode(points).alias("exponent")).withColumn("w", F.pow(share, F.col("exponent")))
    # with z = sum w: entropy = ln z - sum(w ln w) / z, and a source is repeated (w / z) * budget / tokens times
    sums = powers.groupBy("exponent").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.max(F.col("w") / F.col("tokens")).alias("r"))
    return sums.select("exponent", (F.log("z") - F.col("wl") / F.col("z")).alias("entropy"), (F.col("r") / F.col("z") * F.lit(float(budget))).alias("repeats"))


def exponent(totals: DataFrame, budget: int, entropy_share: float, max_repeats: float) -> float:
    """The largest exponent whose entropy is ``entropy_share`` of the maximum or more, or else the least one, if that is larger, that repeats no source more than ``max_repeats`` times. 1 if there is no token."""
    n, tokens = totals.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if not n:
        return 1.0

    def section(holds: Column, rising: bool) -> float:
        """The last exponent for which ``holds`` if it holds below some bound, the first one if it holds above (rising)."""
        at, scale = (SECTIONS, SECTIONS) if rising else (0, SECTIONS)
        low = 0
        for _ in range(ROUNDS):
            points = F.transform(F.sequence(F.lit(low), F.lit(low + SECTIONS)), lambda i: i / F.lit(float(scale)))  # noqa: B023
            good = _measures(totals, tokens, budget, points).where(holds)
            found = good.agg(F.min("exponent") if rising else F.max("exponent")).first()[0]
            at = (low + SECTIONS if rising else low) if found is None else round(found * scale)
            low = ((at - 1) if rising else at) * SECTIONS
            low, scale = min(max(low, 0), scale * SECTIONS - SECTIONS), scale * SECTIONS
        return at / (scale / SECTIONS)

    by_entropy = section(F.col("entropy") >= F.lit(entropy_share) * F.log(F.lit(float(n))) - 1e-12, rising=False)
    by_repeats = section(F.col("repeats") <= F.lit(max_repeats) + 1e-12, rising=True)
    return max(by_entropy, by_repeats)


def schedule(docs: DataFrame, entropy_share: float = 0.95, max_repeats: float = 4.0, budget_share: float = 1.0, blocks: int = 4096, seed: str = "mix") -> DataFrame:
    """A row for each time that a document is taken: doc_id, source, n_tokens, pass, block, order_key.

    The budget is ``budget_share`` of all tokens (words). A source with budget b and t tokens gets
    floor(b / t) whole passes, and in one more pass the documents whose running total stays within the
    rest. Sorting by (pass, order_key) is the training order: sources interleave block by block.
    Null texts have no tokens; documents without tokens follow their source's whole passes. Sources
    without tokens, and tables without documents, give no rows. Null and empty source are one source.
    Null doc_ids are rows like others; repeated rows are taken each. Extra columns are ignored.

    A source's documents are spread over ``blocks`` blocks, so that a hot source is no hot task: running
    totals are kept per block, over totals of the blocks before.
    """
    n_tokens = F.coalesce(F.regexp_count("text", F.lit(WORD_CHARS)), F.lit(0)).cast("long")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    block = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), name)), 1, 8), 16, 10).cast("long") % blocks
    docs = checkpointed(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), n_tokens.alias("n_tokens"), block.cast("int").alias("block")))
    block_totals = checkpointed(docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")))
    totals = checkpointed(block_totals.groupBy("source").agg(F.sum("block_tokens").alias("tokens")).where("tokens > 0"))
    tokens = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = int(tokens * budget_share)
    alpha = exponent(totals, budget, entropy_share, max_repeats)
    w = F.pow(F.col("tokens") / F.lit(float(max(tokens, 1))), F.lit(alpha))
    z = totals.agg(F.sum(w)).first()[0] or 1.0
    share = F.floor(w / F.lit(z) * F.lit(float(budget)) + 1e-6)
    plan = totals.select("source", "tokens", share.alias("budget")).withColumn("passes", F.floor(F.col("budget") / F.col("tokens")).cast("int")).withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))

    def key(at: Column) -> Column:
        return F.md5(F.concat(F.lit(seed + "|"), "source", F.lit("|"), at.cast("string"), F.lit("|"), F.col("block").cast("string")))

    def doc_key(at: Column) -> Column:
        return F.md5(F.concat(F.lit(seed + "|"), at.cast("string"), F.lit("|"), name))

    before = F.sum("block_tokens").over(Window.partitionBy("source").orderBy(key(F.col("passes")), "block").rowsBetween(Window.unboundedPreceding, -1))
    per_block = block_totals.join(plan, "source").withColumn("before", F.coalesce(before, F.lit(0))).select("source", "block", "passes", "rest", "before")
    running = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy(doc_key(F.col("passes")), "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    placed = docs.join(per_block, ["source", "block"]).withColumn("upto", F.col("before") + running)
    partly = F.when((F.col("upto") <= F.col("rest")) & (F.col("rest") > 0) & (F.col("n_tokens") > 0), 1).otherwise(0)
    times = placed.withColumn("times", F.col("passes") + partly).where("times > 0").select("doc_id", "source", "n_tokens", "block", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("pass"))
    order_key = F.concat(F.substring(key(F.col("pass")), 1, 12), F.substring(doc_key(F.col("pass")), 1, 20))
    return times.select("doc_id", "source", "n_tokens", "pass", "block", order_key.alias("order_key"))
