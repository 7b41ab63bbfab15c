"""Problem 8: a mixture of sources with target shares of all tokens.

Tokens are summed for each source; the largest total that every source can fill within its cap gives
each source a repetition rate (target share x total / own tokens). Each document comes out
floor(rate) times and once more with probability equal to the fraction, decided by a seeded hash of
its id, so the result is the same on every run. A cap is never passed: a rate at the cap has no
fraction. Sources without a target, with no tokens, or with a null name are not part of the mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, stable_hash
from .tokens import VOCABULARY, token_count

SEED = 20
#: Rate rows that are broadcast at most (about 1 MB).
SMALL = 10_000


def uniform(*cols: Column | str, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on ``cols`` and ``seed`` only."""
    return F.pmod(stable_hash(*cols, seed=seed), F.lit(1 << 40)) / F.lit(float(1 << 40))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """(id, source, n_tokens) of every document, written once: both passes of the mixture read it."""
    spark = docs.sparkSession
    return cut(docs.select(
        F.col(id_col), F.col(source_col).alias("source"), token_count(spark, text_col, vocabulary, folder).alias("n_tokens"),
    ))


def rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target source: tokens, target_share, max_repeats, rate.

    ``targets`` is a parameter table with a row for each named source, so it is small by nature.
    Targets with a null or non-positive share or cap are ignored; a target whose source has no tokens
    gets rate 0 and the shares of the others keep their proportions.
    """
    tokens = sizes.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    t = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    # the left side has one row for each named target
    per = t.join(tokens, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    total = per.where("tokens > 0").agg(F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share")).alias("total"))
    return per.crossJoin(F.broadcast(total)).select(  # the right side is one row
        "source", "tokens", "target_share", "max_repeats",
        F.when(F.col("tokens") > 0, F.least(F.col("target_share") * F.col("total") / F.col("tokens"), F.col("max_repeats").cast("double")))
        .otherwise(F.lit(0.0)).alias("rate"),
    )


def mix(sizes: DataFrame, rate_table: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    """(id, source, n_tokens, copy_no): the documents of the mixture, copies numbered from 1.

    The rate table has a row for each target; it is broadcast while it has at most ``SMALL`` rows, so
    a source with a third of all rows stays spread over the tasks that read it, and joined by key
    beyond that (with more targets than that no source is large for its key).
    """
    r = rate_table.select("source", "rate")
    if r.limit(SMALL + 1).count() <= SMALL:
        r = F.broadcast(r)
    n = F.floor("rate") + (uniform(F.col(id_col), F.col("source"), seed=seed) < F.col("rate") - F.floor("rate")).cast("int")
    return (
        sizes.join(r, "source").withColumn("copies", n.cast("int")).where("copies > 0")
        .select(id_col, "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    )


def reached(mixture: DataFrame, rate_table: DataFrame) -> DataFrame:
    """One row for each target: what it gave to the mixture and the share really reached."""
    got = mixture.groupBy("source").agg(
        F.count(F.lit(1)).alias("copies_used"), F.sum("n_tokens").alias("tokens_used"), F.max("copy_no").alias("most_repeats"))
    total = got.agg(F.sum("tokens_used").alias("all_used"))
    out = rate_table.join(got, "source", "left").crossJoin(F.broadcast(total))  # one row
    used = F.coalesce(F.col("tokens_used"), F.lit(0))
    return out.select(
        "source", "target_share", F.round(F.when(F.col("all_used") > 0, used / F.col("all_used")).otherwise(0.0), 6).alias("actual_share"),
        F.col("tokens").alias("source_tokens"), used.alias("tokens_used"),
        F.coalesce("copies_used", F.lit(0)).alias("copies_used"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        "max_repeats", F.round("rate", 6).alias("rate"),
    )
