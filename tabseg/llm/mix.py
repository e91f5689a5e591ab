"""Mixing sources to target weights (problem 8), by Pareto order sampling.

A source's wanted tokens over its own tokens is the mean number of copies of its documents. Every document
first gets the whole part of its copies for certain; the rest is drawn by Pareto order sampling: documents
are ranked by random odds divided by the odds of their inclusion, and taken in that order until the tokens
still wanted are reached. The place in the order where that happens is found by the exact bisection of
`percentiles`, so no source is sorted or gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabseg.llm.percentiles import ranked_values
from tabseg.llm.tokens import token_sizes
from tabseg.session import materialise, uniform


def source_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")


def sized_documents(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, key, tokens of the documents whose source is in targets (a fixed small table), stored."""
    keys = targets.select(source_key(F.col("source")).alias("key")).distinct()
    own = docs.select("doc_id", "text", source_key(F.col("source")).alias("key")).join(F.broadcast(keys), "key")
    return materialise(token_sizes(own, ["doc_id", "key"]))


def allocate(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: own tokens, wanted tokens, mean copies, and whether the source falls short.

    The mixture is as large as all sized documents together. A source without documents has 0 own tokens
    and falls short if its share is above 0. Null shares or repeats count as 0.
    """
    own = sized.groupBy("key").agg(F.sum("tokens").alias("own_tokens"), F.count("*").alias("documents"))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    t = targets.select("source", source_key(F.col("source")).alias("key"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    t = t.join(own, "key", "left").fillna(0, ["own_tokens", "documents"])
    want = F.col("target_share") * F.lit(float(total))
    most = F.col("max_repeats") * F.col("own_tokens")
    copies = F.when(F.col("own_tokens") == 0, 0.0).otherwise(F.least(want, most.cast("double")) / F.col("own_tokens"))
    return t.select("source", "key", "target_share", "max_repeats", "own_tokens", "documents", want.alias("wanted_tokens"), copies.alias("mean_copies"), (most < want).alias("short"))


def draw(sized: DataFrame, allocation: DataFrame, seed: int = 8, weight: Column | None = None) -> DataFrame:
    """doc_id, key, tokens, copies. weight: relative preference of a document within its source (default: equal)."""
    a = F.broadcast(allocation.select("key", "mean_copies", "max_repeats", "own_tokens"))
    d = sized.join(a, "key").withColumn("w", F.lit(1.0) if weight is None else weight)
    if weight is not None:
        mean = d.groupBy("key").agg((F.sum(F.col("w") * F.col("tokens")) / F.sum("tokens")).alias("mean_w"))
        d = d.join(F.broadcast(mean), "key").withColumn("w", F.col("w") / F.col("mean_w"))
    copies = F.least(F.col("mean_copies") * F.col("w"), F.col("max_repeats").cast("double"))
    whole = F.floor(copies + 1e-12)
    d = d.withColumn("whole", whole).withColumn("chance", F.greatest(copies - whole, F.lit(0.0)))
    u = uniform(F.col("doc_id"), f"mix:{seed}")
    d = d.withColumn("order", F.when(F.col("chance") > 0, F.ln(u / (1 - u)) - F.ln(F.col("chance") / (1 - F.col("chance")))))
    d = materialise(d.select("doc_id", "key", "tokens", "whole", "order", "own_tokens", "mean_copies"))
    rest = d.groupBy("key").agg((F.max("mean_copies") * F.max("own_tokens") - F.sum(F.col("whole") * F.col("tokens"))).alias("rest"))
    drawn = d.where(F.col("order").isNotNull() & (F.col("tokens") > 0))
    counts = materialise(drawn.groupBy(F.col("key").alias("grp"), F.col("order").alias("v")).agg(F.sum("tokens").alias("c")))
    targets = rest.where("rest >= 0.5").select(F.col("key").alias("grp"), F.lit(0).alias("name"), F.round("rest").cast("bigint").alias("rank"))
    last = ranked_values(counts, targets).join(counts, ["grp", "v"])
    # the document in which the wanted size falls is taken if that comes nearer to it than leaving it out
    cut = last.select(F.col("grp").alias("key"), F.col("v").alias("upto"), (2 * (F.col("rank") - F.col("below")) >= F.col("c")).alias("with_last"))
    one_more = F.coalesce((F.col("order") < F.col("upto")) | (F.col("with_last") & (F.col("order") == F.col("upto"))), F.lit(False))
    return d.join(F.broadcast(cut), "key", "left").select("doc_id", "key", "tokens", (F.col("whole") + one_more.cast("bigint")).alias("copies"))


def shares(allocation: DataFrame, drawn: DataFrame) -> DataFrame:
    """The report: per target source what was wanted and what the mixture holds."""
    got = drawn.groupBy("key").agg(F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    all_ = drawn.agg(F.sum(F.col("copies") * F.col("tokens")).alias("all_tokens"))
    x = allocation.join(F.broadcast(got), "key", "left").fillna(0, ["mixed_tokens", "most_copies"]).crossJoin(F.broadcast(all_))
    return x.select("source", "target_share", "max_repeats", "documents", "own_tokens", "wanted_tokens", "mixed_tokens", "most_copies", (F.col("mixed_tokens") / F.col("all_tokens")).alias("actual_share"), "short")
