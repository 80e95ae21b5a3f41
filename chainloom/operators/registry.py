"""Validation, registries, manifests and audits (V family)."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.operators.aggregate import finite
from chainloom.operators.joins import ContractError
from chainloom.operators.prefix import value_ranks


def validate_submission(sub: DataFrame, solution: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Messages about a submission: one row ``ok``, ``messages`` (sorted, empty if fine).

    Missing columns, repeated ids, wrong number of rows, missing and unknown ids, missing
    numbers, infinite numbers. One pass over both tables by id.
    """
    lacking = [c for c in (key, *columns) if c not in sub.columns]
    if lacking:
        row = F.array(*[F.lit(f"missing column: {c}") for c in sorted(lacking)])
        return solution.agg(F.lit(False).alias("ok"), F.first(row).alias("messages")).select("ok", F.coalesce("messages", row).alias("messages"))
    got = sub.select(F.col(key).cast("string").alias("_id"), *[F.col(c).try_cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    per = got.groupBy("_id").agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(f"_v{i}").isNull() | F.isnan(f"_v{i}")).alias(f"_m{i}") for i in range(len(columns))], *[F.count_if(F.abs(F.col(f"_v{i}")) == float("inf")).alias(f"_i{i}") for i in range(len(columns))]
    )
    want = solution.select(F.col(key).cast("string").alias("_id")).groupBy("_id").agg(F.count("*").alias("_w"))
    both = per.join(want, "_id", "full")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = both.agg(
        total("_n").alias("n"), total("_w").alias("w"), F.count_if(F.col("_n") > 1).alias("rep"), F.count_if(F.col("_n").isNull()).alias("miss"), F.count_if(F.col("_w").isNull()).alias("extra"),
        *[total(f"_m{i}").alias(f"m{i}") for i in range(len(columns))], *[total(f"_i{i}").alias(f"i{i}") for i in range(len(columns))],
    )
    tests = [(F.col("rep") > 0, F.concat(F.lit("repeated ids: "), "rep")), (F.col("n") != F.col("w"), F.concat(F.lit("rows: "), "n", F.lit(" for "), "w")), (F.col("miss") > 0, F.concat(F.lit("missing ids: "), "miss")), (F.col("extra") > 0, F.concat(F.lit("unknown ids: "), "extra"))]
    for i, c in enumerate(columns):
        tests += [(F.col(f"m{i}") > 0, F.concat(F.lit(f"missing {c}: "), f"m{i}")), (F.col(f"i{i}") > 0, F.concat(F.lit(f"infinite {c}: "), f"i{i}"))]
    messages = F.sort_array(F.filter(F.array(*[F.when(c, m.cast("string")) for c, m in tests]), lambda m: m.isNotNull()))
    return one.select((F.size(messages) == 0).alias("ok"), messages.alias("messages"))


def run_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Named aggregate checks in one pass: ``name``, ``ok`` (a null result fails)."""
    one = df.agg(*[F.coalesce(c, F.lit(False)).alias(f"_{i}") for i, c in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_{i}").alias("ok")) for i, n in enumerate(checks)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def verdict(checks: DataFrame) -> DataFrame:
    """One row ``n_ok``, ``errors`` (names of failed checks, sorted), ``status`` PASS or FAIL."""
    return checks.agg(F.count_if("ok").alias("n_ok"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("name")))).alias("errors")).withColumn("status", F.when(F.size("errors") == 0, "PASS").otherwise("FAIL"))


def tabular_checks(df: DataFrame, key: str, forbidden: tuple[str, ...], folds: str | None = None, n_folds: int = 5) -> DataFrame:
    """Release checks of a table: no forbidden column names, no infinities, no null or repeated keys, folds in range, no absolute paths."""
    from pyspark.sql import types as T

    names = [f.name for f in df.schema]
    numbers = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    some = lambda cs: reduce(lambda a, b: a | b, cs, F.lit(False))
    checks = {
        "absolute_paths": F.count_if(some([F.coalesce(F.col(c).rlike(r"^(/[A-Za-z]|[A-Za-z]:\\)"), F.lit(False)) for c in texts])) == 0,
        "forbidden_columns": F.lit(not any(t in n.lower() for n in names for t in forbidden)) & (F.count("*") >= 0),
        "infinite_values": F.count_if(some([F.coalesce(F.abs(F.col(c)) == float("inf"), F.lit(False)) for c in numbers])) == 0,
        "null_keys": F.count_if(F.col(key).isNull()) == 0,
        "repeated_keys": F.count(key) == F.countDistinct(key),
    }
    if folds:
        checks["fold_range"] = F.count_if(F.col(folds).isNotNull() & ~F.col(folds).between(0, n_folds - 1)) == 0
    return run_checks(df, checks)


def recipe_hash(blocks: list[str], columns: list[str], length: int = 16) -> str:
    """Hash of a feature recipe: its blocks in order and its columns."""
    return hashlib.sha256(json.dumps({"blocks": blocks, "columns": columns}, sort_keys=True).encode()).hexdigest()[:length]


def freeze_manifest(frames: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """Content hash of every named input (frame, key, columns) before labels are read: ``name``, ``n_rows``, ``content_hash``, ``labels_read`` (false)."""
    from chainloom.functions.text import table_hash

    parts = [table_hash(df, key, cols).select(F.lit(name).alias("name"), "n_rows", "content_hash", F.lit(False).alias("labels_read")) for name, (df, key, cols) in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


class LabelGuard:
    """Hands out a labelled table only after scoring was enabled; the table isn't even planned before."""

    def __init__(self, load) -> None:
        self._load, self._open = load, False

    def enable(self) -> None:
        self._open = True

    def read(self) -> DataFrame:
        if not self._open:
            raise PermissionError("labels are read before scoring is enabled")
        return self._load()


def next_codes(codes: DataFrame, code: str, pattern: str = r"^EXP-([A-Z])(\d{3,})$", form: str = "EXP-%s%03d") -> DataFrame:
    """Per namespace the greatest number, how many codes and the next code: ``namespace``, ``n``, ``last``, ``next_code``. Codes that don't match are left out."""
    found = codes.select(F.regexp_extract(code, pattern, 1).alias("namespace"), F.regexp_extract(code, pattern, 2).try_cast("long").alias("_n")).where("namespace != '' and _n is not null")
    g = found.groupBy("namespace").agg(F.countDistinct("_n").alias("n"), F.max("_n").alias("last"))
    return g.withColumn("next_code", F.format_string(form, "namespace", F.col("last") + 1))


def issue(registry: DataFrame, new: DataFrame, code: str = "code", namespace: str = "namespace", order: str = "id", form: str = "EXP-%s%03d") -> DataFrame:
    """Append-only: the new rows with the codes that follow their namespace's last one, in the order of ``order``."""
    last = next_codes(registry, code).select(F.col("namespace").alias("_ns"), "last")
    ranks = value_ranks(new, [namespace], order).select(F.col(namespace).alias("_n2"), F.col(order).alias("_o"), "before")
    placed = new.join(ranks, (new[namespace] == ranks._n2) & (new[order] == ranks._o)).join(last, F.col(namespace) == F.col("_ns"), "left")
    return placed.select(*new.columns, F.format_string(form, namespace, F.coalesce("last", F.lit(0)) + F.col("before") + 1).alias(code))


def resolve_refs(refs: DataFrame, ref: str, registry: DataFrame, code: str, ident: str, legacy: str | None = None) -> DataFrame:
    """A reference by canonical code, else by id, else by legacy code: ``ref``, ``code`` (null if unknown), ``via``, ``deprecated``."""
    out = refs.select(F.col(ref).alias("ref")).distinct()
    steps = [("code", code), ("id", ident), *([("legacy", legacy)] if legacy else [])]
    for name, column in steps:
        hits = registry.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_r")).agg(F.min(code).alias(f"_{name}"))
        out = out.join(hits, F.col("ref") == F.col("_r"), "left").drop("_r")
    via = None
    for name, _ in steps:
        via = F.when(F.col(f"_{name}").isNotNull(), name) if via is None else via.when(F.col(f"_{name}").isNotNull(), name)
    return out.select("ref", F.coalesce(*[f"_{n}" for n, _ in steps]).alias("code"), via.alias("via"), F.coalesce(via == "legacy", F.lit(False)).alias("deprecated"))


def registry_integrity(registry: DataFrame, code: str, ident: str, enums: dict[str, list[str]], foreign: dict[str, tuple[DataFrame, str]], pattern: str = r"^EXP-([A-Z])(\d{3,})$") -> DataFrame:
    """``check``, ``n_bad``: repeated codes, ids under several codes, malformed codes, gaps in the numbering, values outside their list, keys missing in another table."""
    parts = [
        registry.groupBy(code).count().where("count > 1").agg(F.count("*").alias("n_bad")).select(F.lit("repeated_code").alias("check"), "n_bad"),
        registry.groupBy(ident).agg(F.countDistinct(code).alias("n")).where("n > 1").agg(F.count("*").alias("n_bad")).select(F.lit("id_with_several_codes").alias("check"), "n_bad"),
        registry.agg(F.count_if(~F.coalesce(F.col(code).rlike(pattern), F.lit(False))).alias("n_bad")).select(F.lit("malformed_code").alias("check"), "n_bad"),
        next_codes(registry, code, pattern).agg(F.coalesce(F.sum(F.col("last") - F.col("n")), F.lit(0)).alias("n_bad")).select(F.lit("gaps").alias("check"), "n_bad"),
    ]
    for column, allowed in enums.items():
        parts.append(registry.agg(F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).alias("n_bad")).select(F.lit(f"enum_{column}").alias("check"), "n_bad"))
    for column, (other, key) in foreign.items():
        have = other.select(F.col(key).alias("_k")).distinct()
        parts.append(registry.where(F.col(column).isNotNull()).join(have, F.col(column) == F.col("_k"), "left_anti").agg(F.count("*").alias("n_bad")).select(F.lit(f"missing_{column}").alias("check"), "n_bad"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def normalise_predictions(pred: DataFrame, expected: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Predictions for exactly the expected ids: ``key``, ``prediction``; a repeated id or a missing number fails the query.

    Without ``value`` the only numeric column besides the key is taken.
    """
    from pyspark.sql import types as T

    if value is None:
        numeric = [f.name for f in pred.schema if f.name != key and isinstance(f.dataType, T.NumericType)]
        if len(numeric) != 1:
            raise ContractError(f"can't tell the prediction column among {numeric}")
        value = numeric[0]
    one = pred.groupBy(F.col(key).cast("string").alias(key)).agg(F.count("*").alias("_n"), F.max(finite(F.col(value).cast("double"))).alias("_v"))
    ids = expected.select(F.col(key).cast("string").alias(key)).distinct()
    joined = ids.join(one, key, "left")
    ok = (F.coalesce("_n", F.lit(0)) == 1) & F.col("_v").isNotNull()
    return joined.select(key, F.when(ok, F.col("_v")).otherwise(F.raise_error(F.concat(F.lit("no single prediction for "), F.col(key))).cast("double")).alias("prediction"))


def compose(first: DataFrame, second: DataFrame, ids: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Two prediction tables (``key``, ``prediction``) side by side for the ids; both must be whole."""
    a = normalise_predictions(first, ids, key, "prediction").withColumnRenamed("prediction", names[0])
    return a.join(normalise_predictions(second, ids, key, "prediction").withColumnRenamed("prediction", names[1]), key)


def upsert(manifest: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of equal key; columns a side lacks are null."""
    return manifest.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def reproduction_audit(truth: DataFrame, rebuilt: DataFrame, keys: list[str], columns: list[str], exact: float = 1e-6, equivalent: float = 1e-5) -> DataFrame:
    """Per column ``n``, ``max_gap`` and ``status``: EXACT, EQUIVALENT, MISMATCH, or MISSING where a key or value is on one side only."""
    b = rebuilt.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(1).alias("_b"))
    full = truth.select(*keys, *columns, F.lit(1).alias("_a")).join(b, keys, "full")
    long = full.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), finite(F.col(c).cast("double")).alias("x"), finite(F.col(f"_{c}").cast("double")).alias("y")) for c in columns])).alias("e")).select("e.*")
    lonely = F.count_if(F.col("x").isNull() != F.col("y").isNull())
    gap = F.max(F.abs(F.col("x") - F.col("y")))
    status = F.when(F.col("n_missing") > 0, "MISSING").when(F.coalesce("max_gap", F.lit(0.0)) <= exact, "EXACT").when(F.col("max_gap") <= equivalent, "EQUIVALENT").otherwise("MISMATCH")
    return long.groupBy("column").agg(F.count("*").alias("n"), lonely.alias("n_missing"), gap.alias("max_gap")).withColumn("status", status)


def pick_by_role(df: DataFrame, key: str, order: list[Column], roles: list[tuple[str, Column]], fill_to: int) -> DataFrame:
    """One row for each role: the first in ``order`` that satisfies the role and isn't taken, then the best of the rest as ``FILL`` up to ``fill_to``: ``place``, ``role``, ``key``.

    Only the few best rows of each role reach the driver: with r roles a role's choice is
    among its first r rows.
    """
    taken: list = []
    out = []
    for name, c in roles:
        for r in df.where(F.coalesce(c, F.lit(False))).orderBy(*order).select(key).limit(len(roles)).collect():
            if r[0] not in taken:
                taken.append(r[0])
                out.append((name, r[0]))
                break
    for r in df.orderBy(*order).select(key).limit(fill_to + len(taken)).collect():
        if len(out) >= fill_to:
            break
        if r[0] not in taken:
            taken.append(r[0])
            out.append(("FILL", r[0]))
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame([(i + 1, n, k) for i, (n, k) in enumerate(out)], f"place int, role string, `{key}` {kind}")


def pending(work: DataFrame, done: DataFrame, keys: list[str], config: str) -> DataFrame:
    """Work without a finished row of equal keys and config hash."""
    return work.join(done.select(*keys, config).distinct(), [*keys, config], "left_anti")


def status_counts(df: DataFrame, by: list[str], status: str) -> DataFrame:
    """Rows and share of every status in each mapping class."""
    c = df.groupBy(*by, status).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def round_trip(history: DataFrame, rebuilt: DataFrame, keys: list[str], columns: list[str], exact: float = 1e-10) -> DataFrame:
    """Per column the greatest absolute difference and whether it is exact, over shared keys."""
    b = rebuilt.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    j = history.select(*keys, *columns).join(b, keys)
    one = j.agg(F.count("*").alias("_rows"), *[F.max(F.abs(F.col(c) - F.col(f"_{c}"))).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("max_gap")) for c in columns])
    return one.select("_rows", F.explode(rows).alias("r")).select("r.column", F.col("_rows").alias("n"), "r.max_gap", (F.coalesce(F.col("r.max_gap"), F.lit(0.0)) <= exact).alias("exact"))


def config_diff(a: DataFrame, b: DataFrame, key: str, columns: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """Differing settings of two configs of equal key: ``key``, ``setting``, ``left``, ``right``, ``kind`` (changed, only_left, only_right)."""
    use = [c for c in columns if c not in ignore]

    def long(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("setting"), F.col(c).cast("string").alias(name)) for c in use])
        return df.select(key, F.explode(cells).alias("e")).select(key, "e.*").where(F.col(name).isNotNull())

    full = long(a, "left").join(long(b, "right"), [key, "setting"], "full").where(~F.col("left").eqNullSafe(F.col("right")))
    return full.withColumn("kind", F.when(F.col("left").isNull(), "only_right").when(F.col("right").isNull(), "only_left").otherwise("changed"))
