"""Mixing sources to target weights (problem 8).

Method: a time-varying curriculum. Each source has a weight schedule over the training
progress u in [0, 1] whose integral is its target share. The integral times the total
size is the source's cumulative token demand; inverting it at a text's place in the
source's token sequence gives the text's training position, and the texts are
range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.llm.encode import encode
from chainloom.operators.prefix import order_hash, prefix_sum
from chainloom.session import stage


def source_name(source: Column | str) -> Column:
    """Lower case without outer blanks; null stays null."""
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def sized_texts(documents: DataFrame, targets: DataFrame, **tokenizer) -> DataFrame:
    """One row for each distinct text of a listed source: ``doc_id``, ``source``, ``n_tokens``.

    A text that occurs several times, also in several sources, belongs to the listed
    source of its smallest doc_id, so its uses are counted once. Texts without a token
    (null, empty) and of unlisted or null sources are left out.
    """
    listed = targets.select(source_name("source").alias("source")).distinct()
    named = documents.where("text is not null").select("doc_id", source_name("source").alias("source"), "text")
    kept = named.join(F.broadcast(listed) if targets.count() <= 100_000 else listed, "source", "left_semi").withColumn("_text", F.md5("text"))
    sized = encode(kept, keys=("doc_id", "source", "_text"), count_only=True, **tokenizer)
    first = sized.where("n_tokens > 0").groupBy("_text").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("_d"))
    return first.select("_d.*")


def plan_mixture(texts: DataFrame, targets: DataFrame, total_tokens: int | None = None, ramp: float = 0.5) -> list[dict]:
    """Share, demand and schedule of each listed source, on the driver: one row for each row of ``targets``.

    The total is the greatest at which every source that has texts can hold its share
    within its repeats, or ``total_tokens`` if smaller. The share of a source without
    text can't be met and is spread over the others in proportion. ``slope`` tilts the
    schedule w(u) = share + slope (2u - 1): sources that may be repeated more often come
    later; the slopes sum to 0 and no weight falls below 0 while ``ramp`` <= 1.
    """
    have = {r.source: (r.tokens, r.texts) for r in texts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts")).collect()}
    asked = targets.select(source_name("source").alias("source"), "share", "max_repeats").groupBy("source").agg(F.sum("share").alias("share"), F.min("max_repeats").alias("max_repeats"))
    rows = [r.asDict() for r in asked.orderBy("source").collect()]
    for r in rows:
        r["tokens"], r["texts"] = have.get(r["source"], (0, 0))
        r["capacity"] = r["tokens"] * max(0, r["max_repeats"] or 0)
        r["wanted"] = max(0.0, r["share"] or 0.0)
    live = [r for r in rows if r["capacity"] > 0 and r["wanted"] > 0]
    scale = sum(r["wanted"] for r in live)
    total = min((r["capacity"] * scale / r["wanted"] for r in live), default=0.0)
    total = min(total, total_tokens) if total_tokens is not None else total
    mean = sum(r["wanted"] * r["max_repeats"] for r in live) / scale if live else 0.0
    span = max((abs(r["max_repeats"] - mean) for r in live), default=0.0) or 1.0
    for r in rows:
        r["mixed_share"] = r["wanted"] / scale if r in live else 0.0
        r["demand"] = r["mixed_share"] * total
        r["slope"] = ramp * r["mixed_share"] * (r["max_repeats"] - mean) / span if r in live else 0.0
        r["total"] = float(total)
    return rows


def mix(texts: DataFrame, plan: list[dict], seed: int = 0, bits: int = 10) -> DataFrame:
    """The selection: ``doc_id``, ``source``, ``use_no`` (from 1), ``n_tokens``, ``position``; sorted by position.

    Each source's texts form one token sequence, in hash order, repeated up to the cap.
    A use is taken if its middle lies within the source's demand, so a source misses its
    demand by half a text at most. ``position`` is the training progress at which the
    inverted cumulative demand reaches that middle.
    """
    spark = texts.sparkSession
    lines = [(r["source"], int(r["tokens"]), float(r["demand"]), float(r["mixed_share"]), float(r["slope"]), float(r["total"]), int(r["max_repeats"])) for r in plan if r["demand"] > 0]
    rules = spark.createDataFrame(lines, "source string, _tokens long, _demand double, _share double, _slope double, _total double, _repeats int")
    ordered = texts.withColumn("_h", order_hash("source", "doc_id", seed=seed))
    placed = prefix_sum(ordered, ["source"], "_h", ["doc_id"], "n_tokens", "_before", bits)
    # the plan has a row for each target row, so it is as small as the target table on the driver
    ruled = placed.join(F.broadcast(rules) if len(lines) <= 100_000 else rules, "source")
    middle = F.col("_before") + F.col("n_tokens") / 2
    # use k has its middle at (k - 1) tokens + middle, so only the uses that are taken are made
    taken = F.least(F.floor((F.col("_demand") - middle) / F.col("_tokens")) + 1, F.col("_repeats")).cast("int")
    uses = ruled.withColumn("_uses", taken).where("_uses >= 1").withColumn("use_no", F.explode(F.sequence(F.lit(1), F.col("_uses"))))
    taken = uses.withColumn("_at", (F.col("use_no") - 1) * F.col("_tokens") + middle)
    a, b, c = F.col("_slope"), F.col("_share") - F.col("_slope"), F.col("_at") / F.col("_total")
    # w integrates to share u + slope (u^2 - u); this is its inverse, also for a slope of 0
    u = 2 * c / (b + F.sqrt(F.greatest(b * b + 4 * a * c, F.lit(0.0))))
    return taken.select("doc_id", "source", "use_no", "n_tokens", F.least(u, F.lit(1.0)).alias("position")).orderBy("position", "doc_id", "use_no")


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, ramp: float = 0.5, seed: int = 0, **tokenizer) -> tuple[DataFrame, list[dict]]:
    """The selection of :func:`mix` for ``documents`` and its plan; empty tables give an empty selection."""
    texts = stage(sized_texts(documents, targets, **tokenizer), "sized")
    plan = plan_mixture(texts, targets, total_tokens, ramp)
    return mix(texts, plan, seed), plan


def reached_shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of each listed source: ``source``, ``share``, ``n_uses``, ``n_tokens``, ``reached``."""
    got = selection.groupBy("source").agg(F.count("*").alias("n_uses"), F.sum("n_tokens").alias("n_tokens"))
    asked = targets.groupBy(source_name("source").alias("source")).agg(F.sum("share").alias("share"))
    every = got.agg(F.sum("n_tokens").alias("_all"))
    joined = asked.join(got, "source", "left").join(F.broadcast(every))  # one row
    return joined.select(
        "source", "share", F.coalesce("n_uses", F.lit(0)).alias("n_uses"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.coalesce(F.try_divide("n_tokens", "_all"), F.lit(0.0)).alias("reached"),
    )
