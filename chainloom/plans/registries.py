"""Queries of validation, registries and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.operators import registry as V
from chainloom.operators.aggregate import finite
from chainloom.operators.blends import ladder, leaderboard
from chainloom.plans.part import Part, r6
from chainloom.session import read

part = Part()


@part.query("""with s as (select id, prediction p from predictions where kind='test'), g as (select id, count(*) n, count(*) filter (p is null or isnan(p)) m from s group by 1), w as (select id, count(*) w from dev group by 1), b as (select * from g full join w on g.id is not distinct from w.id and g.id is not null),
o as (select sum(n) n, sum(w) w, count(*) filter (n>1) rep, count(*) filter (n is null) miss, count(*) filter (w is null) extra, sum(m) m from b)
select false ok, list_sort(list_filter([case when rep>0 then 'repeated ids: '||rep end, case when n<>w then 'rows: '||n||' for '||w end, case when miss>0 then 'missing ids: '||miss end, case when extra>0 then 'unknown ids: '||extra end, case when m>0 then 'missing prediction: '||m end], lambda x: x is not null)) messages from o""")
def submission_validation(spark, sf):
    sub = read(spark, sf, "predictions").where("kind = 'test'").select("id", "prediction")
    return V.validate_submission(sub, read(spark, sf, "dev"), "id", ["prediction"])


_CHECKS = {
    "all_priced": "count(*) = count(o_totalprice)", "keys_unique": "count(*) = count(distinct o_orderkey)", "no_negative": "count(*) filter (where o_totalprice < 0) = 0", "some_open": "bool_or(o_orderstatus = 'O')", "all_open": "bool_and(o_orderstatus = 'O')",
}


@part.query(" union all ".join(f"select '{n}' as name, {c} ok from orders" for n, c in _CHECKS.items()))
def validation_suite(spark, sf):
    return V.run_checks(read(spark, sf, "orders"), {n: F.expr(c) for n, c in _CHECKS.items()})


@part.query("with c as (" + " union all ".join(f"select '{n}' as name, {c} ok from orders" for n, c in _CHECKS.items()) + ") select count(*) filter (ok) n_ok, list_sort(coalesce(list(name) filter (not ok),[])) errors, case when bool_and(ok) then 'PASS' else 'FAIL' end status from c")
def validation_verdict(spark, sf):
    return V.verdict(V.run_checks(read(spark, sf, "orders"), {n: F.expr(c) for n, c in _CHECKS.items()}))


@part.query("""select unnest(['absolute_paths','fold_range','forbidden_columns','infinite_values','null_keys','repeated_keys']) as name, unnest([count(*) filter (regexp_matches(id,'^(/[A-Za-z]|[A-Za-z]:\\\\)'))=0, count(*) filter (fold is not null and fold not between 0 and 4)=0, true, true, count(*)=count(id), count(id)=count(distinct id)]) ok from folds""")
def release_validation(spark, sf):
    return V.tabular_checks(read(spark, sf, "folds"), "id", ("target", "label"), "fold")


_CODE = "regexp_extract(experiment_code,'^EXP-([A-Z])([0-9]{{3,}})$',{})"


@part.query(f"select {_CODE.format(1)} namespace, count(distinct {_CODE.format(2)}::bigint) n, max({_CODE.format(2)}::bigint) as last, 'EXP-' || {_CODE.format(1)} || lpad((max({_CODE.format(2)}::bigint)+1)::varchar, greatest(3, length((max({_CODE.format(2)}::bigint)+1)::varchar))::int, '0') next_code from experiments where regexp_matches(experiment_code,'^EXP-([A-Z])([0-9]{{3,}})$') group by 1")
def registry_next_code(spark, sf):
    return V.next_codes(read(spark, sf, "experiments"), "experiment_code")


@part.query(f"""with l as (select {_CODE.format(1)} ns, max({_CODE.format(2)}::bigint) last from experiments where regexp_matches(experiment_code,'^EXP-([A-Z])([0-9]{{3,}})$') group by 1), n as (select distinct id, case when ascii(right(id,1)) % 3 = 0 then 'T' when ascii(right(id,1)) % 3 = 1 then 'H' else 'Q' end namespace from dev where id is not null),
r as (select *, row_number() over (partition by namespace order by id) r from n) select id, namespace, 'EXP-' || namespace || lpad((coalesce(last,0)+r)::varchar, greatest(3,length((coalesce(last,0)+r)::varchar))::int, '0') code from r left join l on ns=namespace""")
def registry_issue(spark, sf):
    reg = read(spark, sf, "experiments").select(F.col("experiment_code").alias("code"))
    m = F.ascii(F.right("id", F.lit(1))) % 3
    new = read(spark, sf, "dev").where("id is not null").select("id").distinct().withColumn("namespace", F.when(m == 0, "T").when(m == 1, "H").otherwise("Q"))
    return V.issue(reg, new)


@part.query("""with r as (select distinct x ref from (select experiment_code x from predictions union all select experiment_id from experiments union all select experiment_code from documents union all select 'EXP-NONE')), c as (select experiment_code k, min(experiment_code) v from experiments where experiment_code is not null group by 1), i as (select experiment_id k, min(experiment_code) v from experiments where experiment_id is not null group by 1), l as (select feature_set_id k, min(experiment_code) v from experiments where feature_set_id is not null group by 1)
select ref, coalesce(c.v,i.v,l.v) code, case when c.v is not null then 'code' when i.v is not null then 'id' when l.v is not null then 'legacy' end via, (c.v is null and i.v is null and l.v is not null) deprecated from r left join c on c.k=ref left join i on i.k=ref left join l on l.k=ref""")
def resolve_ref(spark, sf):
    e = read(spark, sf, "experiments")
    refs = read(spark, sf, "predictions").select(F.col("experiment_code").alias("r")).unionByName(e.select(F.col("experiment_id").alias("r"))).unionByName(read(spark, sf, "documents").select(F.col("experiment_code").alias("r"))).unionByName(spark.createDataFrame([("EXP-NONE",)], "r string"))
    return V.resolve_refs(refs, "r", e, "experiment_code", "experiment_id", "feature_set_id")


@part.query(f"""select 'repeated_code' "check", (select count(*) from (select experiment_code from experiments group by 1 having count(*)>1)) n_bad union all select 'id_with_several_codes', (select count(*) from (select experiment_id from experiments group by 1 having count(distinct experiment_code)>1)) union all select 'malformed_code', (select count(*) from experiments where not coalesce(regexp_matches(experiment_code,'^EXP-([A-Z])([0-9]{{3,}})$'),false))
union all select 'gaps', (select coalesce(sum(l-n),0)::bigint from (select max({_CODE.format(2)}::bigint) l, count(distinct {_CODE.format(2)}::bigint) n from experiments where regexp_matches(experiment_code,'^EXP-([A-Z])([0-9]{{3,}})$') group by {_CODE.format(1)})) union all select 'enum_target', (select count(*) from experiments where target is not null and target not in ('HIC','TmApp'))
union all select 'missing_experiment_code', (select count(*) from experiments e where experiment_code is not null and not exists (select 1 from predictions p where p.experiment_code=e.experiment_code))""")
def registry_integrity(spark, sf):
    return V.registry_integrity(read(spark, sf, "experiments"), "experiment_code", "experiment_id", {"target": ["HIC", "TmApp"]}, {"experiment_code": (read(spark, sf, "predictions"), "experiment_code")})


@part.query("select c_custkey::varchar id, c_acctbal prediction from customer")
def normalise_predictions(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return V.normalise_predictions(c, c.select("id"), "id")


@part.query("select c_custkey::varchar id, c_acctbal tm, round(c_acctbal*2,6) hic from customer where c_nationkey < 5")
def compose_submission(spark, sf):
    c = read(spark, sf, "customer")
    ids = c.where("c_nationkey < 5").select(F.col("c_custkey").alias("id"))
    one = lambda v: c.select(F.col("c_custkey").alias("id"), v.alias("prediction"))
    return V.compose(one(F.col("c_acctbal")), one(F.col("c_acctbal") * 2), ids, "id", ("tm", "hic")).withColumn("hic", r6("hic"))


@part.query("select c_custkey, c_name, c_acctbal, null::varchar note from customer where c_custkey % 10 <> 0 union all select c_custkey, c_name, 0.0, 'new' from customer where c_custkey % 10 = 0")
def manifest_upsert(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 10 = 0").withColumns({"c_acctbal": F.lit(0.0), "note": F.lit("new")})
    return V.upsert(c, new, ["c_custkey"])


@part.query("""select target, arg_min(experiment_code, (cv_mean_mae, experiment_code, registered_at)) experiment_code, min(cv_mean_mae) cv_mean_mae from experiments where license_status <> 'RESTRICTED' and isfinite(cv_mean_mae) group by 1""")
def leaderboard_eligible(spark, sf):
    return leaderboard(read(spark, sf, "experiments"), ["target"], "cv_mean_mae", "experiment_code", F.col("license_status") != "RESTRICTED").select("target", "experiment_code", "cv_mean_mae")


@part.query("""with a as (select c_custkey k, c_acctbal x, c_nationkey::double y, c_acctbal z from customer), b as (select c_custkey k, c_acctbal + case when c_custkey=7 then 0.000005 else 0 end x, c_nationkey::double y, c_acctbal*1.01 z from customer)
select 'x' "column", count(*) n, 0::bigint n_missing, round(max(abs(a.x-b.x)),9) max_gap, case when max(abs(a.x-b.x))<=1e-6 then 'EXACT' when max(abs(a.x-b.x))<=1e-5 then 'EQUIVALENT' else 'MISMATCH' end status from a join b using(k) union all select 'y', count(*), 0, round(max(abs(a.y-b.y)),9), case when max(abs(a.y-b.y))<=1e-6 then 'EXACT' else 'MISMATCH' end from a join b using(k) union all select 'z', count(*), 0, round(max(abs(a.z-b.z)),9), case when max(abs(a.z-b.z))<=1e-6 then 'EXACT' when max(abs(a.z-b.z))<=1e-5 then 'EQUIVALENT' else 'MISMATCH' end from a join b using(k)""")
def reproduction_audit(spark, sf):
    c = read(spark, sf, "customer")
    a = c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"), F.col("c_acctbal").alias("z"))
    b = a.withColumns({"x": F.col("x") + F.when(F.col("k") == 7, 0.000005).otherwise(0.0), "z": F.col("z") * 1.01})
    return V.reproduction_audit(a, b, ["k"], ["x", "y", "z"]).withColumn("max_gap", r6("max_gap", 9))


_BEST = "(select experiment_code, min(family) family, min(cv) cv from (select experiment_code, family, case when isfinite(cv_mean_mae) then cv_mean_mae end cv from experiments where experiment_code is not null) group by 1 having min(cv) is not null)"


@part.query(f"""with e as (select *, row_number() over (order by cv, experiment_code) r from {_BEST}), a as (select experiment_code from e order by r limit 1), b as (select experiment_code from e where family='LINEAR' and experiment_code not in (select * from a) order by r limit 1), c as (select experiment_code from e where family='TRANSFORMER' and experiment_code not in (select * from a) order by r limit 1),
t as (select 'BEST' as role, experiment_code, 1 place from a union all select 'LINEAR', experiment_code, 2 from b union all select 'TRANSFORMER', experiment_code, 3 from c), f as (select experiment_code, row_number() over (order by r) q from e where experiment_code not in (select experiment_code from t))
select row_number() over (order by place)::int place, role, experiment_code from (select * from t union all select 'FILL', experiment_code, 10+q from f where q <= 7 - (select count(*) from t))""")
def finalists_by_role(spark, sf):
    e = read(spark, sf, "experiments").where("experiment_code is not null").groupBy("experiment_code").agg(F.min("family").alias("family"), F.min(finite("cv_mean_mae")).alias("cv")).where("cv is not null")
    roles = [("BEST", F.lit(True)), ("LINEAR", F.col("family") == "LINEAR"), ("TRANSFORMER", F.col("family") == "TRANSFORMER")]
    return V.pick_by_role(e, "experiment_code", [F.asc("cv"), F.asc("experiment_code")], roles, 7)


@part.query("""select experiment_code, registered_at, case when cv_mean_mae < 0.6 and cv_shadow_mae < 0.6 then 'STRONG' when cv_mean_mae < 1 then 'WEAK' when cv_mean_mae is null or not isfinite(cv_mean_mae) then 'UNKNOWN' else 'NONE' end verdict from experiments""".replace("cv_mean_mae <", "(case when isfinite(cv_mean_mae) then cv_mean_mae end) <").replace("cv_shadow_mae <", "(case when isfinite(cv_shadow_mae) then cv_shadow_mae end) <"))
def signal_verdict(spark, sf):
    m, s = finite("cv_mean_mae"), finite("cv_shadow_mae")
    return read(spark, sf, "experiments").select("experiment_code", "registered_at", ladder([("STRONG", (m < 0.6) & (s < 0.6)), ("WEAK", m < 1), ("UNKNOWN", m.isNull())], "NONE").alias("verdict"))


@part.query("select distinct experiment_code, target, feature_set_id from experiments e where experiment_code is not null and feature_set_id is not null and not exists (select 1 from predictions p where p.experiment_code=e.experiment_code and p.kind='test')")
def resume_pending(spark, sf):
    e = read(spark, sf, "experiments").where("experiment_code is not null and feature_set_id is not null").select("experiment_code", "target", "feature_set_id").distinct()
    done = read(spark, sf, "predictions").where("kind = 'test'").select("experiment_code").distinct().join(e.select("experiment_code", "feature_set_id"), "experiment_code")
    return V.pending(e, done, ["experiment_code"], "feature_set_id")


@part.query("select target, artifact_status, count(*) n, round(count(*)/sum(count(*)) over (partition by target),9) share from experiments group by 1,2")
def provenance_counts(spark, sf):
    return V.status_counts(read(spark, sf, "experiments"), ["target"], "artifact_status").withColumn("share", r6("share", 9))


@part.query("with a as (select o_custkey, sum(o_totalprice) s, count(*)::double n from orders group by 1) select 'n' \"column\", count(*) n, 0.0::double max_gap, true exact from a union all select 's', count(*), 0.0, true from a")
def round_trip_check(spark, sf):
    o = read(spark, sf, "orders").groupBy("o_custkey")
    a = o.agg(F.round(F.sum("o_totalprice"), 4).alias("s"), F.count("*").cast("double").alias("n"))
    half = read(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    b = half.groupBy("o_custkey").agg(F.round(F.sum("s"), 4).alias("s"), F.sum("n").cast("double").alias("n"))
    return V.round_trip(a, b, ["o_custkey"], ["s", "n"], exact=1e-3).withColumn("max_gap", r6("max_gap", 2))


@part.query("""with o as (select experiment_code k, min(target) target, min(family) family, min(n_features)::varchar nf from experiments where experiment_code is not null group by 1), n as (select experiment_code k, max(target) target, max(family) family, case when max(n_features) % 7 > 0 then max(n_features)::varchar end nf from experiments where experiment_code is not null group by 1),
u as (select o.k, s, case s when 'target' then o.target when 'family' then o.family else o.nf end l, case s when 'target' then n.target when 'family' then n.family else n.nf end r from o join n using (k), (values ('target'),('family'),('n_features')) t(s)) select k, s setting, l as "left", r as "right", case when l is null then 'only_right' when r is null then 'only_left' else 'changed' end kind from u where l is distinct from r""")
def config_diff(spark, sf):
    e = read(spark, sf, "experiments").where("experiment_code is not null").groupBy(F.col("experiment_code").alias("k"))
    a = e.agg(F.min("target").alias("target"), F.min("family").alias("family"), F.min("n_features").alias("n_features"), F.min("registered_at").alias("at"))
    b = e.agg(F.max("target").alias("target"), F.max("family").alias("family"), F.max("n_features").alias("n_features"), F.max("registered_at").alias("at"))
    b = b.withColumn("n_features", F.when(F.col("n_features") % 7 > 0, F.col("n_features")))
    return V.config_diff(a, b, "k", ["target", "family", "n_features", "at"], ignore=("at",))


def _manifest(name, row):
    return f"select '{name}' as name, sum(n)::bigint n_rows, sha256(string_agg(bh, '' order by b)) content_hash, false labels_read from (select left(h,3) b, count(*) n, sha256(string_agg(h, '' order by h)) bh from (select sha256({row}) h from {name}) group by 1)"


@part.query(_manifest("customer", "c_custkey || '|' || format('{:.10f}', c_acctbal) || '|' || c_name") + " union all " + _manifest("supplier", "s_suppkey || '|' || format('{:.10f}', s_acctbal)"))
def freeze_manifest(spark, sf):
    return V.freeze_manifest({"customer": (read(spark, sf, "customer"), "c_custkey", ["c_acctbal", "c_name"]), "supplier": (read(spark, sf, "supplier"), "s_suppkey", ["s_acctbal"])})


@part.query(f"select '{V.recipe_hash(['base', 'extra'], ['a', 'b'])}' recipe, 2::bigint n_columns")
def feature_recipe_hash(spark, sf):
    return spark.createDataFrame([(V.recipe_hash(["base", "extra"], ["a", "b"]), 2)], "recipe string, n_columns long")
