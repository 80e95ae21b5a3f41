"""References to records that do not exist (problem 6).

Parents and children are brought into one long form tagged by kind, grouped by parent
key and ordered by time; a running count of the parent's lives tells whether it was
there when the child referred to it. Keys with very many children are cut into salted
parts, each of which gets a copy of the key's few parent events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.session import read

REF_FIELDS = ("config_path", "oof_primary_path", "test_prediction_path", "feature_path")


def normal_path(path: Column | str) -> Column:
    """A relative file path in one spelling: trimmed, forward slashes, no ``.``, empty or ``x/..`` steps.

    Null stays null; a blank path gives the empty string. Letter case is kept. A ``..``
    that has nothing to step back from stays.
    """
    path = F.col(path) if isinstance(path, str) else path
    text = F.regexp_replace(F.regexp_replace(path, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"\\", "/")
    steps = F.filter(F.split(text, "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, s: F.when(
            (s == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != ".."),
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return F.array_join(kept, "/")


def newest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row for each key: the one with the greatest ``at``, ties broken by all other columns; null times are oldest."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(at, *[F.col(c) for c in rest if c != at])).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def missing_parents(children: DataFrame, parents: DataFrame, salt_rows: int = 200_000) -> DataFrame:
    """Children whose parent key was not alive at their time.

    ``children``: ``key``, ``at`` and any further columns, which are kept. ``parents``:
    ``key``, ``created_at``, ``deleted_at`` (null while alive), several lives allowed.
    Alive at t means created_at <= t and (deleted_at null or > t).

    Null keys are no references. A null ``at`` finds no parent. Lives without a creation
    time or that end before they begin are ignored; repeated lives do no harm. An empty
    parent table makes every child an orphan. Keys with more than ``salt_rows`` children
    are split into parts of about that size.
    """
    kids = children.where(F.col("key").isNotNull())
    extra = [c for c in kids.columns if c not in ("key", "at")]
    lives = parents.where("key is not null and created_at is not null and (deleted_at is null or deleted_at > created_at)").select("key", "created_at", "deleted_at").distinct()
    parts = (
        kids.groupBy("key").count().where(F.col("count") > salt_rows).select("key", F.ceil(F.col("count") / F.lit(salt_rows)).cast("int").alias("_parts"))
    )
    lives = lives.join(parts, "key", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    payload = F.struct(*extra) if extra else F.struct(F.lit(1).alias("_"))
    asked = kids.join(parts, "key", "left").select(
        "key",
        F.coalesce(F.pmod(F.xxhash64("at", *extra), F.col("_parts")), F.lit(0)).cast("int").alias("_part"),
        "at",
        F.lit(1).alias("_order"),
        F.lit(0).alias("_step"),
        payload.alias("_row"),
    )
    nothing = F.lit(None).cast(asked.schema["_row"].dataType)
    began = lives.select("key", "_part", F.col("created_at").alias("at"), F.lit(0).alias("_order"), F.lit(1).alias("_step"), nothing.alias("_row"))
    ended = lives.where("deleted_at is not null").select(
        "key", "_part", F.col("deleted_at").alias("at"), F.lit(0).alias("_order"), F.lit(-1).alias("_step"), nothing.alias("_row")
    )
    run = Window.partitionBy("key", "_part").orderBy(F.col("at").asc_nulls_first(), "_order").rowsBetween(Window.unboundedPreceding, 0)
    tagged = asked.unionByName(began).unionByName(ended).withColumn("_alive", F.sum("_step").over(run))
    found = tagged.where("_order = 1 and _alive <= 0")
    return found.select("key", "at", *[F.col(f"_row.{c}").alias(c) for c in extra])


def orphan_references(experiments: DataFrame, artifacts: DataFrame, fields: tuple[str, ...] = REF_FIELDS) -> DataFrame:
    """Orphan references of the newest row of each code: ``experiment_code``, ``ref_field``, ``path``, ``registered_at``.

    Null and blank references are no cases. A null code counts as one record. A column
    of ``fields`` that is missing raises an analysis error.
    """
    current = newest(experiments.select("experiment_code", "registered_at", *fields), ["experiment_code"], "registered_at")
    refs = current.select(
        "experiment_code", "registered_at", F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f).alias("path")) for f in fields])).alias("r")
    ).select("experiment_code", F.col("r.ref_field").alias("ref_field"), normal_path("r.path").alias("key"), F.col("registered_at").alias("at"))
    orphans = missing_parents(refs.where("key != ''"), artifacts.select(normal_path("path").alias("key"), "created_at", "deleted_at"))
    return orphans.select("experiment_code", "ref_field", F.col("key").alias("path"), F.col("at").alias("registered_at"))


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per field and month of ``registered_at`` (null month for a null time): ``ref_field``, ``month``, ``n_orphans``."""
    return orphans.groupBy("ref_field", F.date_format("registered_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_orphans"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(read(spark, sf_dir, "experiments"), read(spark, sf_dir, "artifacts")).select("experiment_code", "ref_field")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(orphan_references(read(spark, sf_dir, "experiments"), read(spark, sf_dir, "artifacts")))


QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts}

_PATH = """list_reduce(list_prepend('', list_filter(string_split(replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '\\', '/'), '/'), lambda s: s not in ('', '.'))),
    lambda d, s: case when s = '..' and d <> '' and not (d = '..' or d like '%/..') then coalesce(nullif(regexp_extract(d, '^(.*)/[^/]*$', 1), ''), '') when d = '' then s else d || '/' || s end)"""
_CASES = f"""with cur as (select * from (select *, row_number() over (partition by experiment_code order by registered_at desc nulls last) rn from experiments) where rn = 1),
refs as (select experiment_code, registered_at, 'config_path' ref_field, config_path path from cur union all select experiment_code, registered_at, 'oof_primary_path', oof_primary_path from cur
  union all select experiment_code, registered_at, 'test_prediction_path', test_prediction_path from cur union all select experiment_code, registered_at, 'feature_path', feature_path from cur),
named as (select experiment_code, ref_field, registered_at, {_PATH.format("path")} p from refs where path is not null),
cases as (select * from named n where p <> '' and not exists (select 1 from (select {_PATH.format("path")} p, created_at, deleted_at from artifacts) a where a.p = n.p and a.created_at <= n.registered_at and (a.deleted_at is null or a.deleted_at > n.registered_at)))
"""
ORACLE = {
    "p6_found": _CASES + "select experiment_code, ref_field from cases",
    "p6_counts": _CASES + "select ref_field, strftime(registered_at, '%Y-%m') as month, count(*) as n_orphans from cases group by 1, 2",
}
