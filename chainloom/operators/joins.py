"""Joins and alignment of tables by id (J family)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.operators.aggregate import finite


class ContractError(ValueError):
    """A table breaks the contract it was joined under."""


def text_id(df: DataFrame, key: str = "id") -> DataFrame:
    """The key as a string, so that both sides of a join agree on its type."""
    return df.withColumn(key, F.col(key).cast("string"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and their number ``n``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def join_one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which a key repeated on either side makes the query fail when it runs.

    The check is part of the plan: every side is grouped by key (which the join needs
    anyway), so no extra pass is made. Null keys never match and aren't checked.
    """

    def once(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        known = reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, df)
        one = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest) if rest else F.struct(F.lit(1))).alias("_row"))
        bad = F.raise_error(F.concat(F.lit(f"{side} side repeats key "), F.concat_ws("|", *[F.col(k).cast("string") for k in keys])))
        return one.select(*keys, F.when(F.col("_n") == 1, F.col("_row")).otherwise(bad.cast(one.schema["_row"].dataType)).alias(f"_{side}")), rest

    left, lcols = once(a, "left")
    right, rcols = once(b, "right")
    return left.join(right, keys).select(*keys, *[F.col(f"_left.{c}").alias(c) for c in lcols], *[F.col(f"_right.{c}").alias(c) for c in rcols if c not in lcols])


def join_indicator(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full join with ``_merge``: both, left_only or right_only."""
    full = a.withColumn("_l", F.lit(1)).join(b.withColumn("_r", F.lit(1)), keys, "full")
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return full.withColumn("_merge", side).drop("_l", "_r")


def left_block(spine: DataFrame, block: DataFrame, key: str, block_key: str | None = None, prefix: str = "") -> DataFrame:
    """``spine`` with the block's columns; the block's key may have another name, clashing names get ``prefix``."""
    block_key = block_key or key
    named = block.select(F.col(block_key).alias("_bk"), *[F.col(c).alias(f"{prefix}{c}" if prefix and c in spine.columns else c) for c in block.columns if c != block_key])
    clash = set(named.columns) & set(spine.columns)
    if clash:
        raise ContractError(f"columns clash: {sorted(clash)}")
    return spine.join(named, spine[key] == named["_bk"], "left").drop("_bk")


def full_match(a: DataFrame, b: DataFrame, keys: list[str], compare: dict[str, tuple[str, str]]) -> DataFrame:
    """Full join on coalesced keys with ``<name>_match`` for each compared pair of columns; nulls are equal."""
    full = a.join(b, keys, "full")
    return full.withColumns({f"{n}_match": F.col(x).eqNullSafe(F.col(y)) for n, (x, y) in compare.items()})


def left_fill(a: DataFrame, b: DataFrame, keys: list[str], fill: dict[str, object], flag: str = "found") -> DataFrame:
    """Left join on several columns; columns of ``fill`` get their value where there is no match, ``flag`` tells."""
    joined = a.join(b.withColumn(flag, F.lit(True)), keys, "left")
    return joined.withColumns({**{c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()}, flag: F.coalesce(F.col(flag), F.lit(False))})


def _numeric(df: DataFrame, key: str) -> list[str]:
    return [f.name for f in df.schema if f.name != key and isinstance(f.dataType, T.NumericType)]


def alignment_report(block: DataFrame, ids: DataFrame, key: str = "id", most_null_columns: int | None = None) -> DataFrame:
    """One row with the violations of the alignment contract: ``n_ids``, ``n_rows``, ``problems`` (sorted array, empty if none).

    Problems: empty block, repeated ids, missing ids, no numeric column, columns without
    a finite value (more than ``most_null_columns``, default none allowed), no finite cell.
    """
    cols = _numeric(block, key)
    want = ids.select(F.col(key).alias("_id")).where("_id is not null").distinct()
    # one full pass over both tables by key
    tagged = want.select(F.col("_id"), F.lit(1).alias("_want"), F.lit(0).alias("_have")).unionByName(block.groupBy(F.col(key).alias("_id")).agg(F.lit(0).alias("_want"), F.count("*").alias("_have")))
    keys = tagged.groupBy("_id").agg(F.max("_want").alias("_want"), F.sum("_have").alias("_have"))
    k = keys.agg(F.coalesce(F.sum("_want"), F.lit(0)).alias("n_ids"), F.coalesce(F.sum("_have"), F.lit(0)).alias("n_rows"), F.count_if(F.col("_have") > 1).alias("_rep"), F.count_if((F.col("_want") == 1) & (F.col("_have") == 0)).alias("_miss"))
    inside = block.join(want, block[key] == want["_id"], "left_semi")
    v = inside.agg(F.lit(0).alias("_0"), *[F.count(finite(F.col(c).cast("double"))).alias(f"_c{i}") for i, c in enumerate(cols)])
    counts = [F.col(f"_c{i}") for i in range(len(cols))]
    dead = reduce(lambda a, b: a + b, [(c == 0).cast("int") for c in counts], F.lit(0))
    alive = reduce(lambda a, b: a + b, counts, F.lit(0))
    allowed = 0 if most_null_columns is None else most_null_columns
    tests = [
        (F.col("n_rows") == 0, "empty block"), (F.col("_rep") > 0, "repeated ids"), (F.col("_miss") > 0, "missing ids"),
        (F.lit(not cols), "no numeric column"), (dead > allowed, "columns without a value"), (alive == 0, "no finite value"),
    ]
    one = k.crossJoin(v)  # one row each
    return one.select("n_ids", "n_rows", F.sort_array(F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in tests]), lambda m: m.isNotNull())).alias("problems"))


def align(block: DataFrame, ids: DataFrame, key: str = "id", position: str = "pos", strict: bool = True) -> DataFrame:
    """The block's rows for exactly the requested ids, with their ``position``, infinities as nulls.

    ``strict`` raises :class:`ContractError` on any problem of :func:`alignment_report`;
    otherwise the ids that exist are kept. ``ids`` has ``key`` and ``position``.
    """
    if strict:
        problems = alignment_report(block, ids, key).first().problems
        if problems:
            raise ContractError("; ".join(problems))
    cleaned = block.withColumns({c: finite(F.col(c).cast("double")) for c in _numeric(block, key)})
    return ids.select(key, position).join(cleaned, key, "inner").select(key, position, *[c for c in cleaned.columns if c != key])


def concat_blocks(blocks: dict[str, DataFrame], key: str = "id", on_clash: str = "prefix") -> DataFrame:
    """Column blocks side by side by key (inner).

    ``on_clash``: ``prefix`` names every column ``{block}__{column}``, ``fail`` raises on
    a name found twice, ``first`` keeps its first occurrence.
    """
    frames, taken = [], {key}
    for name, df in blocks.items():
        cols = [c for c in df.columns if c != key]
        if on_clash == "prefix":
            df = df.select(key, *[F.col(c).alias(f"{name}__{c}") for c in cols])
        elif on_clash == "fail" and taken & set(cols):
            raise ContractError(f"block {name} repeats {sorted(taken & set(cols))}")
        elif on_clash == "first":
            df = df.select(key, *[c for c in cols if c not in taken])
        taken |= set(df.columns)
        frames.append(df)
    return reduce(lambda a, b: a.join(b, key), frames)


def token_index(df: DataFrame, owner: str, text: str, pattern: str = r"[;,\s]+", kinds: dict[str, str] | None = None) -> DataFrame:
    """Inverted index of the tokens of ``text``: ``token``, ``kind`` (first of ``kinds`` whose regex it matches whole, else ``other``), ``owners`` (sorted), ``n``."""
    tokens = df.select(F.col(owner).alias("_o"), F.explode(F.filter(F.split(text, pattern), lambda t: t != "")).alias("token"))
    kind = None
    for name, rx in (kinds or {}).items():
        test = F.col("token").rlike(f"^(?:{rx})$")
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    pairs = tokens.withColumn("kind", kind.otherwise("other") if kind is not None else F.lit("other")).distinct()
    return pairs.groupBy("token", "kind").agg(F.sort_array(F.collect_list("_o")).alias("owners"), F.count("*").alias("n"))


def resolve(df: DataFrame, key: str, steps: list[tuple[str, str, DataFrame]], value: str) -> DataFrame:
    """Look a record up by several keys in order: ``key``, ``target``, ``via``, ``status``.

    ``steps``: (name, column of ``df``, index with ``token``, ``target`` and ``value``).
    The first step whose index knows the column decides. ``status``: unique (one target),
    same_value (several targets with one ``value``; the least is taken), ambiguous,
    unresolved.
    """
    out = df
    names = []
    for name, column, index in steps:
        hits = index.where(F.col("token").isNotNull()).groupBy("token").agg(
            F.min("target").alias("_t"), F.count_distinct("target").alias("_n"), F.count_distinct(value).alias("_v")
        ).select(F.col("token").alias(f"_tok_{name}"), F.struct("_t", "_n", "_v", F.lit(name).alias("_via")).alias(f"_hit_{name}"))
        out = out.join(hits, out[column] == hits[f"_tok_{name}"], "left")
        names.append(f"_hit_{name}")
    best = out.select(key, F.coalesce(*names).alias("_b"))
    status = F.when(F.col("_b").isNull(), "unresolved").when(F.col("_b._n") == 1, "unique").when(F.col("_b._v") == 1, "same_value").otherwise("ambiguous")
    return best.select(key, F.when(status.isin("unique", "same_value"), F.col("_b._t")).alias("target"), F.col("_b._via").alias("via"), status.alias("status"))


def group_pairs(df: DataFrame, key: list[str], member: str, value: str) -> DataFrame:
    """All pairs of members (a < b) that share a key, with both values; for a few members a key (models, generators)."""
    a = df.select(*key, F.col(member).alias("a"), F.col(value).alias("value_a"))
    b = df.select(*key, F.col(member).alias("b"), F.col(value).alias("value_b"))
    return a.join(b, key).where("a < b")


def deltas(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], prefix: str = "delta_") -> DataFrame:
    """a - b of each shared column on shared keys."""
    right = b.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in columns])
    return a.select(*keys, *columns).join(right, keys).select(*keys, *[(F.col(c) - F.col(f"_r_{c}")).alias(f"{prefix}{c}") for c in columns])


def slots(text: Column | str, first: int, last: int, align_right: bool = False) -> Column:
    """Letters of a region string on the numbered slots ``first`` .. ``last``: array of (slot, letter).

    Short strings fill from the left, or the right; of one too long the middle is left out
    (the left part keeps the extra letter).
    """
    text = F.col(text) if isinstance(text, str) else text
    room = last - first + 1
    n = F.length(text)
    half = (room + 1) // 2
    cut = F.when(n > room, F.concat(F.substring(text, 1, half), F.right(text, F.lit(room - half)) if room > half else F.lit(""))).otherwise(text)
    start = F.lit(first) + (F.lit(room) - F.length(cut) if align_right else F.lit(0))
    return F.transform(F.filter(F.split(cut, ""), lambda c: c != ""), lambda c, i: F.struct((start + i).cast("int").alias("slot"), c.alias("letter")))
