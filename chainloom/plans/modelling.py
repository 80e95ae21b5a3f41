"""Queries of folds, resampling, linear models and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.operators import blends as E
from chainloom.operators import folds as K
from chainloom.operators import linear as M
from chainloom.operators import stats as X
from chainloom.operators.aggregate import finite
from chainloom.plans.part import Part, r6
from chainloom.session import read

part = Part()

# --- folds and samples


@part.query(f"""with g as (select c_nationkey, count(*) n, {K.mix_sql('c_nationkey', '7')} h from customer group by 1), r as (select *, coalesce(sum(n) over (order by h, c_nationkey rows between unbounded preceding and 1 preceding),0) b, sum(n) over () t from g)
select c_nationkey, n size, case when b < t*0.25 then 'Public' when b < t*0.5 then 'Private' else 'Dev' end as role from r""")
def greedy_group_roles(spark, sf):
    return K.assign_groups(read(spark, sf, "customer"), "c_nationkey", {"Public": 0.25, "Private": 0.25}, "Dev", seed=7)


@part.query("""with recursive g as (select n, row_number() over (order by n desc) i from (select count(*) n from customer group by c_nationkey)),
r as (select 0::bigint i, [0,0,0,0,0]::bigint[] loads union all select r.i+1, list_transform(r.loads, lambda v, j: case when j = list_position(r.loads, list_min(r.loads)) then v + g.n else v end) from r join g on g.i = r.i+1)
select unnest(range(5))::int fold, unnest(loads)::bigint n_rows from r where i = (select max(i) from g)""")
def grouped_folds(spark, sf):
    return K.balanced_folds(read(spark, sf, "customer"), "c_nationkey", 5).groupBy("fold").agg(F.sum("size").alias("n_rows"))


@part.query(f"select r::int as repeat, c_nationkey, ((row_number() over (partition by r order by {K.mix_sql('c_nationkey', 'r*1000+17')}, c_nationkey) - 1) % 5)::int fold from (select distinct c_nationkey from customer), range(3) t(r)")
def repeated_group_folds(spark, sf):
    return K.repeated_folds(read(spark, sf, "customer"), "c_nationkey", 5, 3)


@part.query(f"select c_nationkey from (select c_nationkey, row_number() over (order by {K.mix_sql('c_nationkey', '3')}, c_nationkey) r, count(*) over () n from (select distinct c_nationkey from customer)) where r <= greatest(1, round(n*0.2))")
def early_stop_groups(spark, sf):
    return K.early_stop_groups(read(spark, sf, "customer"), "c_nationkey", 0.2, seed=3)


@part.query("select c_nationkey, ((row_number() over (order by m, c_nationkey) - 1) % 5)::int fold from (select c_nationkey, avg(c_acctbal) m from customer group by 1)")
def mean_sorted_folds(spark, sf):
    from chainloom.operators.rank import round_robin

    g = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"))
    return round_robin(g, "m", "c_nationkey", 5).select("c_nationkey", "fold")


@part.query(f"""with u as (select *, row_number() over (partition by c_mktsegment, c_nationkey order by (c_acctbal <= 9900)::int, {K.mix_sql('c_custkey', '5')}, c_custkey) u from customer),
r as (select *, row_number() over (partition by c_mktsegment order by (c_acctbal <= 9900)::int, {K.mix_sql('c_custkey', '5')}, c_custkey) r from u where u = 1) select c_custkey, c_mktsegment from r where r <= 4""")
def stratified_pilot(spark, sf):
    return K.stratified_sample(read(spark, sf, "customer"), ["c_mktsegment"], "c_custkey", 4, "c_nationkey", F.col("c_acctbal") > 9900, seed=5).select("c_custkey", "c_mktsegment")


def _groups(spark, sf):
    rows = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 8000).alias("high")).orderBy("c_nationkey").collect()  # a row a nation
    return [r.n for r in rows], [[r.high] for r in rows]


@part.query()
def split_search(spark, sf):
    sizes, labels = _groups(spark, sf)
    return K.split_search(spark, sizes, labels, sum(sizes) // 2, starts=16, steps=150).select("mask_hash", "start", "energy", "size")


@part.query()
def split_search_annealed(spark, sf):
    sizes, labels = _groups(spark, sf)
    scale = K.energy_scale(spark, sizes, labels, sum(sizes) // 2, samples=50)
    found = K.split_search(spark, sizes, labels, sum(sizes) // 2, starts=16, method="anneal", steps=150)
    return found.select("mask_hash", "start", "size", F.try_divide("energy", F.lit(scale)).alias("relative_energy"))


_W = K.poisson_weight_sql(K.mix_sql("k", "b"))


@part.query(f"""with s as (select l_returnflag, (l_orderkey*8+l_linenumber) k, abs(l_extendedprice - l_quantity*p_retailprice) - abs(l_extendedprice - l_quantity*1400) d from lineitem join part on l_partkey=p_partkey),
w as (select l_returnflag, b, {_W} w, d from s, range(50) t(b)), m as (select l_returnflag, b, sum(d*w)/sum(w) m from w group by 1,2)
select l_returnflag, round(avg(m),4) mean, round(quantile_cont(m,0.025),4) low, round(quantile_cont(m,0.975),4) high, round(avg((m<0)::int),6) p_below from m group by 1""")
def paired_bootstrap(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_retailprice")
    d = read(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).withColumn("k", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    diff = F.abs(F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice")) - F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1400)
    boot = K.bootstrap_means(d, ["l_returnflag"], "k", {"d": diff}, 50)
    r = K.percentile_interval(boot, ["l_returnflag"], "d")
    return r.select("l_returnflag", *[r6(c, 4).alias(c) for c in ("mean", "low", "high")], r6("p_below").alias("p_below"))


@part.query(f"""with w as (select c_mktsegment, b, {_W} w, v from (select c_mktsegment, c_custkey k, c_acctbal v from customer), range(100) t(b)), m as (select c_mktsegment, b, sum(v*w)/sum(w) m from w where w > 0 group by 1,2)
select c_mktsegment, round(avg(m),4) mean, round(quantile_cont(m,0.025),4) low, round(quantile_cont(m,0.975),4) high from m group by 1""")
def hash_bootstrap_ci(spark, sf):
    boot = K.bootstrap_means(read(spark, sf, "customer"), ["c_mktsegment"], "c_custkey", {"v": F.col("c_acctbal")}, 100)
    r = K.percentile_interval(boot, ["c_mktsegment"], "v")
    return r.select("c_mktsegment", *[r6(c, 4).alias(c) for c in ("mean", "low", "high")])


_WC = "({0}*sum_wxy - sum_wx*sum_wy)"


@part.query(f"""with s as (select s_nationkey % 3 g, s_suppkey k, s_acctbal y, s_acctbal + (s_suppkey*37%1000)*5 a, s_acctbal + (s_suppkey*91%1000)*7 c from supplier), w as (select g, b, {_W}::double w, y, a, c from s, range(40) t(b)),
m as (select g, b, sum(w) n, sum(w*y) wy, sum(w*y*y) wyy, sum(w*a) wa, sum(w*a*a) waa, sum(w*a*y) way, sum(w*c) wc, sum(w*c*c) wcc, sum(w*c*y) wcy from w group by 1,2),
r as (select g, b, (n*way-wa*wy)/sqrt((n*waa-wa*wa)*(n*wyy-wy*wy)) ra, (n*wcy-wc*wy)/sqrt((n*wcc-wc*wc)*(n*wyy-wy*wy)) rc from m) select g, round(avg(case when ra>rc then 1 when ra=rc then 0.5 else 0 end),6) p_win from r group by 1""")
def win_probability(spark, sf):
    s = read(spark, sf, "supplier")
    s = s.select((F.col("s_nationkey") % 3).alias("g"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("y"), (F.col("s_acctbal") + (F.col("s_suppkey") * 37 % 1000) * 5).alias("a"), (F.col("s_acctbal") + (F.col("s_suppkey") * 91 % 1000) * 7).alias("c"))
    boot = K.bootstrap_correlations(s, ["g"], "k", "y", ["a", "c"], 40)
    return K.win_probability(boot, ["g"], "a", "c").withColumn("p_win", r6("p_win"))


@part.query(f"""with d as (select user_id, event_id k, value v from events where user_id < 60), f as (select user_id, median(v) m, stddev_pop(v) sd from d group by 1),
o as (select user_id, b, v, row_number() over (partition by user_id, b order by {K.mix_sql('k', 'b')}, k) r from d, range(10) t(b)),
e as (select user_id, b, s, median(v) m, count(*) n from o join (values (5),(20)) z(s) on r <= s group by 1,2,3 having count(*) = s)
select e.user_id, s size, round(any_value(f.m),6) reference, round(avg(abs(e.m-f.m)/f.sd),6) deviation, round(stddev_pop(e.m),6) mc_sd, round(stddev_pop(e.m)/any_value(f.sd),6) noise_ratio from e join f using (user_id) group by 1,2""".replace(" where user_id < 60", ""))
def mc_subset_convergence(spark, sf):
    r = K.subset_convergence(read(spark, sf, "events"), "user_id", "event_id", "value", [5, 20], 10)
    return r.select("user_id", "size", *[r6(c).alias(c) for c in ("reference", "deviation", "mc_sd", "noise_ratio")])


# --- preprocessing and linear models


def _lines(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 5).cast("int").alias("fold"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("x2"), F.col("l_extendedprice").alias("y"))


_L = "(select l_orderkey, l_linenumber, (l_orderkey % 5)::int fold, l_quantity x, l_discount x2, l_extendedprice y from lineitem)"


@part.query("""with m as (select (select median(cv_primary_mae) from experiments where target='HIC' and isfinite(cv_primary_mae)) a, coalesce((select median(public_mae) from experiments where target='HIC' and isfinite(public_mae)),0) b)
select experiment_code, registered_at, round(case when cv_primary_mae is null or not isfinite(cv_primary_mae) then a else cv_primary_mae end,6) cv_primary_mae, round(case when public_mae is null or not isfinite(public_mae) then b else public_mae end,6) public_mae from experiments, m""")
def median_impute_fold(spark, sf):
    e = read(spark, sf, "experiments").select("experiment_code", "registered_at", "target", "cv_primary_mae", "public_mae")
    values = M.fit_medians(e, ["cv_primary_mae", "public_mae"], F.col("target") == "HIC")
    return M.impute(e, values).select("experiment_code", "registered_at", r6("cv_primary_mae").alias("cv_primary_mae"), r6("public_mae").alias("public_mae"))


@part.query("""with m as (select avg(cv_primary_mae) filter (isfinite(cv_primary_mae)) a from experiments where target='HIC') select experiment_code, registered_at, round(case when cv_primary_mae is null or not isfinite(cv_primary_mae) then a else cv_primary_mae end,6) cv_primary_mae from experiments, m""")
def mean_impute(spark, sf):
    e = read(spark, sf, "experiments").select("experiment_code", "registered_at", "target", "cv_primary_mae", F.lit(None).cast("double").alias("empty"))
    values = M.fit_means(e, ["cv_primary_mae", "empty"], F.col("target") == "HIC")
    return M.impute(e, values).select("experiment_code", "registered_at", *[r6(c).alias(c) for c in values])


@part.query("""with c as (select family f, count(*) n from experiments where target='HIC' and family is not null group by 1), top as (select f from c order by n desc, f limit 1)
select experiment_code, registered_at, """ + ", ".join(f"(case when coalesce(family, (select f from top)) = '{v}' then 1 else 0 end)::int \"family_{v}\"" for v in ("ENSEMBLE", "LINEAR", "TRANSFORMER", "XGB")) + " from experiments")
def most_frequent_onehot(spark, sf):
    e = read(spark, sf, "experiments").select("experiment_code", "registered_at", "target", "family")
    wide, _ = M.one_hot_most_frequent(e, "family", F.col("target") == "HIC")
    return wide.drop("target", "family")


@part.query(f"with s as (select avg(x) mx, stddev_pop(x) sx, avg(x2) m2, stddev_pop(x2) s2 from {_L} where fold <> 0) select l_orderkey, l_linenumber, round((x-mx)/sx,6) x, round((x2-m2)/s2,6) x2, l_extendedprice from {_L.replace('l_extendedprice y', 'l_extendedprice')}, s")
def standardise_fold(spark, sf):
    d = _lines(spark, sf)
    out = M.scale(d, M.fit_scaler(d, ["x", "x2"], F.col("fold") != 0))
    return out.select("l_orderkey", "l_linenumber", r6("x").alias("x"), r6("x2").alias("x2"), F.col("y").alias("l_extendedprice"))


@part.query(f"with m as (select t.k, median(y) m from {_L} d, range(5) t(k) where fold <> k group by 1) select fold, round(any_value(m),4) oof, count(*) n, round(avg(abs(y-m)),4) mae from {_L} join m on fold = k group by 1")
def median_baseline_oof(spark, sf):
    r = M.median_oof(_lines(spark, sf), "y", "fold")
    return r.groupBy("fold").agg(r6(F.first("oof"), 4).alias("oof"), F.count("*").alias("n"), r6(F.avg(F.abs(F.col("y") - F.col("oof"))), 4).alias("mae"))


def _fit(where, a):
    """Slope and intercept of a one-column ridge on scaled data, as SQL over table d."""
    return f"(select covar_pop(y,x)/var_pop(x)*count(*)/(count(*)+{a}) w, avg(y) my, avg(x) mx from d where {where})"


_GRID = [0.0, 10.0, 1000.0, 100000.0]
_ALPHAS = "(values " + ",".join(f"({a}::double)" for a in _GRID) + ") g(a)"


@part.query(f"""with d as (select * from {_L}), s as (select fold f, count(*)::double n, sum(x) sx, sum(y) sy, sum(x*x) sxx, sum(x*y) sxy from d group by 1),
t as (select k, sum(n) n, sum(sx)/sum(n) mx, sum(sy)/sum(n) my, sum(sxx)-sum(sx)*sum(sx)/sum(n) cxx, sum(sxy)-sum(sx)*sum(sy)/sum(n) cxy from s, range(5) r(k) where f <> k and f <> (k+1)%5 group by 1),
f as (select k, a, cxy/cxx*n/(n+a) w, mx, my from t, {_ALPHAS}), v as (select k, a, round(avg(abs(y-(my+w*(x-mx)))),9) mae from d join f on fold = (k+1)%5 group by 1,2),
c as (select k, arg_min(a, (mae, -a)) a from v group by 1),
u as (select k, sum(n) n, sum(sx)/sum(n) mx, sum(sy)/sum(n) my, sum(sxx)-sum(sx)*sum(sx)/sum(n) cxx, sum(sxy)-sum(sx)*sum(sy)/sum(n) cxy from s, range(5) r(k) where f <> k group by 1),
w as (select k, a, cxy/cxx*n/(n+a) w, mx, my from u join c using (k))
select fold, any_value(a) alpha, count(*) n, round(any_value(w),4) slope, round(avg(abs(y-(my+w*(x-mx)))),4) mae from d join w on fold = k group by 1""")
def ridge_rotation_oof(spark, sf):
    oof, chosen = M.rotation_oof(_lines(spark, sf), ["x"], "y", "fold", _GRID)
    table = spark.createDataFrame([(c["rotation"], c["alpha"], c["coef"][0]) for c in chosen], "fold int, alpha double, slope double")
    r = oof.groupBy("fold").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("y") - F.col("oof"))), 4).alias("mae"))
    return r.join(table, "fold").select("fold", "alpha", "n", r6("slope", 4).alias("slope"), "mae")


def _two(a):
    """Two-column ridge on scaled columns by Cramer's rule, as SQL."""
    return f"""with m as (select count(*)::double n, avg(x) mx, avg(x2) m2, avg(y) my, stddev_pop(x) s1, stddev_pop(x2) s2, covar_pop(x,x2) c12, covar_pop(x,y) c1, covar_pop(x2,y) c2 from {_L}),
g as (select *, 1+{a}/n d, c12/(s1*s2) r, c1/s1 b1, c2/s2 b2 from m), w as (select *, (b1*d-b2*r)/(d*d-r*r)/s1 w1, (b2*d-b1*r)/(d*d-r*r)/s2 w2 from g)
select {a}::double alpha, round(w1,3) w1, round(w2,2) w2, round(my-w1*mx-w2*m2,2) intercept from w"""


@part.query(" union all ".join(f"({_two(a)})" for a in (1.0, 1000.0)))
def ridge_two_columns(spark, sf):
    m = M.total(M.moments(_lines(spark, sf), ["x", "x2", "y"]))
    rows = [(a, float(f.coef[0]), float(f.coef[1]), f.intercept) for a in (1.0, 1000.0) for f in [M.ridge(m, ["x", "x2"], a)]]
    return spark.createDataFrame(rows, "alpha double, w1 double, w2 double, intercept double").select("alpha", r6("w1", 3).alias("w1"), r6("w2", 2).alias("w2"), r6("intercept", 2).alias("intercept"))


_PENALTIES = [0.0, 1000.0, 10000.0, 1000000.0]


@part.query(f"with m as (select stddev_pop(x) s, covar_pop(x,y)/stddev_pop(x) b, avg(x) mx, avg(y) my from {_L}) select a alpha, round(sign(b)*greatest(abs(b)-a,0)/s,4)+0.0 slope, round(my-sign(b)*greatest(abs(b)-a,0)/s*mx,2) intercept from m, (values " + ",".join(f"({a}::double)" for a in _PENALTIES) + ") g(a)")
def lasso_path(spark, sf):
    m = M.total(M.moments(_lines(spark, sf), ["x", "y"]))
    rows = [(a, float(f.coef[0]), f.intercept) for a in _PENALTIES for f in [M.elastic_net(m, ["x"], a)]]
    return spark.createDataFrame(rows, "alpha double, slope double, intercept double").select("alpha", r6("slope", 4).alias("slope"), r6("intercept", 2).alias("intercept"))


@part.query(f"with m as (select stddev_pop(x) s, covar_pop(x,y)/stddev_pop(x) b from {_L}) select a alpha, l1, round(sign(b)*greatest(abs(b)-a*l1,0)/(1+a*(1-l1))/s,4)+0.0 slope from m, (values (1.0::double),(100.0::double)) g(a), (values (0.2::double),(0.8::double)) h(l1)")
def elastic_net_grid(spark, sf):
    m = M.total(M.moments(_lines(spark, sf), ["x", "y"]))
    rows = [(a, r, float(M.elastic_net(m, ["x"], a, r).coef[0])) for a in (1.0, 100.0) for r in (0.2, 0.8)]
    return spark.createDataFrame(rows, "alpha double, l1 double, slope double").withColumn("slope", r6("slope", 4))


@part.query(f"""with d as (select * from {_L}), s as (select fold f, count(*)::double n, sum(x) sx, sum(y) sy, sum(x*x) sxx, sum(x*y) sxy from d group by 1),
t as (select k, j, sum(n) n, sum(sx)/sum(n) mx, sum(sy)/sum(n) my, sum(sxx)-sum(sx)*sum(sx)/sum(n) cxx, sum(sxy)-sum(sx)*sum(sy)/sum(n) cxy from s, range(5) r(k), range(5) q(j) where j <> k and f <> k and f <> j group by 1,2),
f as (select k, j, a, cxy/cxx*n/(n+a) w, mx, my from t, {_ALPHAS}), v as (select k, a, j, avg(abs(y-(my+w*(x-mx)))) mae from d join f on fold = j group by 1,2,3), i as (select k, a, round(avg(mae),9) mae from v group by 1,2),
c as (select k, arg_min(a, (mae, -a)) a, min(mae) inner_mae from i group by 1),
u as (select k, sum(n) n, sum(sx)/sum(n) mx, sum(sy)/sum(n) my, sum(sxx)-sum(sx)*sum(sx)/sum(n) cxx, sum(sxy)-sum(sx)*sum(sy)/sum(n) cxy from s, range(5) r(k) where f <> k group by 1),
w as (select k, a, inner_mae, cxy/cxx*n/(n+a) w, mx, my from u join c using (k)) select fold, any_value(a) alpha, round(any_value(inner_mae),4) inner_mae, round(avg(abs(y-(my+w*(x-mx)))),4) mae from d join w on fold = k group by 1""")
def nested_ridge(spark, sf):
    from chainloom.operators.nested import nested_oof

    oof, chosen = nested_oof(_lines(spark, sf), ["x"], "y", "fold", _GRID)
    table = spark.createDataFrame([(c["fold"], c["alpha"], c["inner_mae"]) for c in chosen], "fold int, alpha double, inner_mae double")
    r = oof.groupBy("fold").agg(r6(F.avg(F.abs(F.col("y") - F.col("oof"))), 4).alias("mae"))
    return r.join(table, "fold").select("fold", "alpha", r6("inner_mae", 4).alias("inner_mae"), "mae")


@part.query(f"""with d0 as (select * from {_L}), m as (select k, median(y) m from d0, range(5) t(k) where fold <> k group by 1), d as (select l_orderkey, fold, x, d0.y yy, m.m base, d0.y - m.m y from d0 join m on fold = k),
u as (select k, covar_pop(y,x)/var_pop(x)*count(*)/(count(*)+10.0) w, avg(y) my, avg(x) mx from d, range(5) r(k) where fold <> k group by 1) select fold, round(avg(abs(yy-base)),4) base_mae, round(avg(abs(yy-(base+my+w*(x-mx)))),4) mae from d join u on fold = k group by 1""")
def residual_ridge(spark, sf):
    from chainloom.operators.nested import residual_oof

    base = M.median_oof(_lines(spark, sf), "y", "fold").withColumnRenamed("oof", "base")
    r = residual_oof(base, "base", ["x"], "y", "fold", 10.0)
    return r.groupBy("fold").agg(r6(F.avg(F.abs(F.col("y") - F.col("base"))), 4).alias("base_mae"), r6(F.avg(F.abs(F.col("y") - F.col("final"))), 4).alias("mae"))


@part.query(f"with m as (select covar_pop(y,x)/var_pop(x)*count(*)/(count(*)+1.0) w, avg(y) my, avg(x) mx from {_L} where fold <> 0) select l_orderkey, l_linenumber, round(y-(my+w*(x-mx)),4) res_y from {_L}, m")
def physics_residual(spark, sf):
    out, _ = M.residualise(_lines(spark, sf), ["y"], ["x"], F.col("fold") != 0, alpha=1.0)
    return out.select("l_orderkey", "l_linenumber", r6("res_y", 4).alias("res_y"))


@part.query(f"""with d as (select * from {_L}), u as (select k, covar_pop(y,x)/var_pop(x)*count(*)/(count(*)+1.0) w, avg(y) my, avg(x) mx from d, range(5) r(k) where fold <> k group by 1), p as (select y, my+w*(x-mx) p from d join u on fold=k)
select 'y' feature, count(*) n, round(1-avg((p-y)*(p-y))/var_pop(y),6) r2, round(corr(y,p),6) pearson, round(sqrt(avg((p-y)*(p-y)))/stddev_pop(y),6) nrmse from p""")
def predict_features(spark, sf):
    from chainloom.operators.nested import feature_predictability

    r = feature_predictability(_lines(spark, sf), ["x"], ["y"], "fold", 1.0)
    return r.select("feature", "n", r6("r2").alias("r2"), r6("pearson").alias("pearson"), r6("nrmse").alias("nrmse"))


@part.query(f"with m as (select covar_pop(y,x)/var_pop(x)*count(*)/(count(*)+10.0) w, avg(y) my, avg(x) mx from {_L} where fold <> 4) select l_orderkey, l_linenumber, round(my+w*(x-mx),4) prediction from {_L}, m where fold = 4")
def refit_and_predict(spark, sf):
    d = _lines(spark, sf)
    model = M.ridge(M.total(M.moments(d.where("fold != 4"), ["x", "y"])), ["x"], 10.0)
    return d.where("fold = 4").select("l_orderkey", "l_linenumber", r6(model.predict(), 4).alias("prediction"))


def _vectors(spark, sf, width=16):
    e = read(spark, sf, "embeddings")
    return e.select("vec_id", (F.col("vec_id") % 5).cast("int").alias("fold"), F.col("label").cast("double").alias("y"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(width)])


@part.query()
def block_pca(spark, sf):
    from chainloom.operators.nested import block_oof

    out = block_oof(_vectors(spark, sf), {"emb": [f"e{i}" for i in range(16)]}, "y", "fold", 1.0, most=8, forced=True)
    return out.groupBy("fold").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("y") - F.col("oof")))).alias("mae"))


@part.query()
def base_plus_block_ridge(spark, sf):
    from chainloom.operators.nested import block_oof

    cols = [f"e{i}" for i in range(16)]
    out = block_oof(_vectors(spark, sf), {"base": cols[:4], "extra": cols[4:]}, "y", "fold", 10.0, most=3, forced=True, raw=("base",))
    return out.groupBy("fold").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("y") - F.col("oof")))).alias("mae"))


@part.query()
def scaled_pca_scores(spark, sf):
    d = _vectors(spark, sf)
    p = M.pca_block(d, [f"e{i}" for i in range(16)], F.col("fold") != 0, most=4, scaled=True, forced=True)
    return p.transform(d).select("vec_id", *[r6(f"pc{j}", 5).alias(f"pc{j}") for j in range(4)])


@part.query()
def partial_least_squares(spark, sf):
    from chainloom.operators.nested import pls

    d = _vectors(spark, sf)
    cols = [f"e{i}" for i in range(16)]
    model = pls(M.total(M.moments(d.where("fold != 0"), [*cols, "y"])), cols, 3)
    return d.where("fold = 0").select("vec_id", r6(model.predict()).alias("prediction"))


@part.query()
def kernel_ridge(spark, sf):
    from chainloom.operators.nested import kernel_ridge_oof

    return kernel_ridge_oof(_vectors(spark, sf, 8), "vec_id", [f"e{i}" for i in range(8)], "y", "fold", gamma=2.0, alpha=1.0, landmarks=64).select("vec_id", r6("oof").alias("oof"))


@part.query()
def huber_regression(spark, sf):
    from chainloom.operators.nested import huber

    d = _lines(spark, sf)
    model = huber(d.where("fold != 0"), ["x", "x2"], "y")
    return d.where("fold = 0").groupBy("fold").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("y") - model.predict())), 2).alias("mae"))


@part.query()
def boosted_trees(spark, sf):
    from chainloom.operators.nested import boosted_trees as fit

    d = _lines(spark, sf)
    out = fit(d.where("fold != 0"), d.where("fold = 0"), ["x", "x2"], "y", group="l_orderkey", rounds=5)
    return out.agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("y") - F.col("prediction"))), 2).alias("mae"))


@part.query()
def random_search(spark, sf):
    from chainloom.operators.nested import random_penalties

    grid = random_penalties(12, -3, 4, seed=5)
    _, chosen = M.rotation_oof(_lines(spark, sf), ["x", "x2"], "y", "fold", grid)
    return spark.createDataFrame([(c["rotation"], round(c["alpha"], 6), round(c["val_mae"], 4)) for c in chosen], "rotation int, alpha double, val_mae double")


@part.query()
def permutation_importance(spark, sf):
    d = _lines(spark, sf).withColumn("k", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    model = M.ridge(M.total(M.moments(d, ["x", "x2", "y"])), ["x", "x2"], 1.0)
    r = M.permutation_importance(d, model, {"quantity": ["x"], "discount": ["x2"]}, "y", "k", "fold", repeats=3)
    return r.groupBy("fold", "block").agg(F.count("*").alias("n"), r6(F.avg("increase"), 4).alias("mean"), r6(F.stddev_pop("increase"), 4).alias("sd"), r6(F.percentile("increase", F.lit(0.025)), 4).alias("low"), r6(F.percentile("increase", F.lit(0.975)), 4).alias("high"))


@part.query(f"with s as (select avg(x) mx, stddev_pop(x) sx from {_L} where fold <> 0) select l_orderkey, l_linenumber, round((x-mx)/sx,6) x, 0.0::double x2 from {_L}, s")
def mask_ablation(spark, sf):
    d = _lines(spark, sf)
    out = M.mask_ablation(d, M.FoldPreprocessor(["x", "x2"], "mean").fit(d, F.col("fold") != 0), ["x2"])
    return out.select("l_orderkey", "l_linenumber", r6("x").alias("x"), "x2")


# --- ensembles

_P3 = "(select o_orderkey k, (o_orderkey % 5)::int fold, o_totalprice y, o_totalprice*0.9::double+o_custkey a, 150000-o_custkey*10.0::double b, (o_orderkey % 1000)*300.0::double c from orders)"


def _three(spark, sf):
    o = read(spark, sf, "orders")
    a, b, c = F.col("o_totalprice") * 0.9 + F.col("o_custkey"), F.lit(150000) - F.col("o_custkey") * 10.0, (F.col("o_orderkey") % 1000) * 300.0
    return o.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5).cast("int").alias("fold"), F.col("o_totalprice").alias("y"), a.alias("a"), b.alias("b"), c.alias("c"))


def _long3(spark, sf):
    return _three(spark, sf).unpivot(["k", "y"], ["a", "b", "c"], "model", "p")


@part.query("select id, round(avg(v),6) blend from (select id, kind, avg(prediction) v from predictions where isfinite(prediction) and kind in ('oof_primary','oof_shadow') and id is not null group by 1,2) group by 1 having count(*) = 2")
def equal_mean_blend(spark, sf):
    p = read(spark, sf, "predictions").withColumn("prediction", finite("prediction")).where("prediction is not null and id is not null and kind in ('oof_primary', 'oof_shadow')").groupBy("id", "kind").agg(F.avg("prediction").alias("v"))
    full = p.join(p.groupBy("id").count().where("count = 2").select("id"), "id", "left_semi")
    return E.blend(full, ["id"], "kind", "v", ["oof_primary", "oof_shadow"]).withColumn("blend", r6("blend"))


@part.query(f"select k, round(list_sort([a,b,c])[2],6) blend from {_P3}")
def median_blend(spark, sf):
    return E.blend(_long3(spark, sf), ["k"], "model", "p", ["a", "b", "c"], "median").withColumn("blend", r6("blend"))


def _avg_rank(c):
    return f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1)/2.0"


@part.query(f"select k, 3::bigint n, round(({_avg_rank('a')} + {_avg_rank('b')} + {_avg_rank('c')})/3,6) rank_mean from {_P3}")
def rank_mean_blend(spark, sf):
    return E.rank_mean(_long3(spark, sf), ["k"], "model", "p").withColumn("rank_mean", r6("rank_mean"))


_SUBSETS = [s for s in ("a", "b", "c", "a|b", "a|c", "b|c", "a|b|c")]


@part.query(" union all ".join(f"select '{s}' as subset, round(avg(abs(y-({'+'.join(s.split('|'))})/{len(s.split('|'))}.0)),4) mae from {_P3}" for s in _SUBSETS))
def model_subset_blend(spark, sf):
    from chainloom.operators.sets import explode_subsets

    d = explode_subsets(_three(spark, sf), ["a", "b", "c"])
    member = lambda m: F.when(F.array_contains("subset", m), F.col(m)).otherwise(0.0)
    mean = (member("a") + member("b") + member("c")) / F.size("subset")
    return d.groupBy(F.array_join("subset", "|").alias("subset")).agg(r6(F.avg(F.abs(F.col("y") - mean)), 4).alias("mae"))


@part.query(f"""with g as (select i/10.0::double a1, j/10.0::double b1, (10-i-j)/10.0::double c1 from range(11) t(i), range(11) u(j) where i+j<=10), m as (select [a1,b1,c1] weights, round(avg(abs(y-(a1*a+b1*b+c1*c))),9) mae from {_P3}, g group by 1) select list_transform(weights, lambda x: round(x,6)) weights, round(mae,4) mae from m order by m.mae, m.weights limit 1""")
def convex_blend_weights(spark, sf):
    r = E.convex_weights(_three(spark, sf), ["a", "b", "c"], "y", steps=10)
    return r.select(F.transform("weights", lambda w: F.round(w, 6)).alias("weights"), r6("mae", 4).alias("mae"))


@part.query(f"select fold, round(avg(abs(y-(a+b+c)/3)),4) mean_mae, round(avg(abs(y-list_sort([a,b,c])[2])),4) median_mae from {_P3} group by 1")
def simple_stackers(spark, sf):
    d = _three(spark, sf)
    d = E.stacked_oof(d, ["a", "b", "c"], "y", "fold", "mean", 5).withColumnRenamed("stack", "s1")
    d = E.stacked_oof(d, ["a", "b", "c"], "y", "fold", "median", 5)
    return d.groupBy("fold").agg(r6(F.avg(F.abs(F.col("y") - F.col("s1"))), 4).alias("mean_mae"), r6(F.avg(F.abs(F.col("y") - F.col("stack"))), 4).alias("median_mae"))


@part.query()
def fitted_stackers(spark, sf):
    d = _three(spark, sf)
    d = E.stacked_oof(d, ["a", "b", "c"], "y", "fold", "nnls", 5).withColumnRenamed("stack", "s1")
    d = E.stacked_oof(d, ["a", "b", "c"], "y", "fold", "ridge", 5, alpha=10.0)
    return d.groupBy("fold").agg(r6(F.avg(F.abs(F.col("y") - F.col("s1"))), 3).alias("nnls_mae"), r6(F.avg(F.abs(F.col("y") - F.col("stack"))), 3).alias("ridge_mae"))


@part.query()
def ridge_meta_alpha(spark, sf):
    d = _three(spark, sf).withColumn("f3", (F.col("k") % 3).cast("int"))
    best, maes = E.meta_alpha(d, ["a", "b", "c"], "y", "f3", [0.1, 10.0, 1000.0])
    return spark.createDataFrame([(a, round(m, 3), a == best) for a, m in maes.items()], "alpha double, mae double, chosen boolean")


@part.query("select experiment_code, id, count(*) n, round(avg(prediction),6) mean, round(median(prediction),6) median, round(stddev_pop(prediction),6) sd from predictions where isfinite(prediction) and kind='oof_primary' group by 1,2")
def fold_mean_median(spark, sf):
    p = read(spark, sf, "predictions").withColumn("prediction", finite("prediction")).where("prediction is not null and kind = 'oof_primary'")
    return E.fold_summary(p, ["experiment_code", "id"], "prediction").select("experiment_code", "id", "n", *[r6(c).alias(c) for c in ("mean", "median", "sd")])


@part.query(f"select seed, round(avg(abs(y-p)),4) mae, round((select stddev_pop(m) from (select avg(abs(y-p)) m from (unpivot {_P3} on a,b,c into name s value p) group by s)),4) dispersion from (unpivot {_P3} on a,b,c into name seed value p) group by 1")
def seed_dispersion(spark, sf):
    from pyspark.sql import Window

    m = _long3(spark, sf).groupBy(F.col("model").alias("seed")).agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    return m.select("seed", r6("mae", 4).alias("mae"), r6(F.stddev_pop("mae").over(Window.partitionBy()), 4).alias("dispersion"))


@part.query(f"select count(*) n, round(avg(abs(y-b)),4) mae, round(avg(abs(y-b)) filter (k%2=0),4) public_mae, round(avg(abs(y-b)) filter (k%2=1),4) private_mae from {_P3}")
def public_private_score(spark, sf):
    d = _three(spark, sf)
    solution = d.select("k", "y", (F.col("k") % 2 == 0).alias("is_public"), (F.col("k") % 2 == 1).alias("is_private"))
    r = E.solution_score(d.select("k", F.col("b").alias("p")), solution, "k", "p", "y", "is_public", "is_private")
    return r.select("n", *[r6(c, 4).alias(c) for c in ("mae", "public_mae", "private_mae")])


_EXP = "(select experiment_code, any_value(family) family, any_value(target) target, min(cv_primary_mae) p, min(cv_shadow_mae) s, min(public_mae) u, min(private_mae) v from (select experiment_code, min(family) over w family, min(target) over w target, case when isfinite(cv_primary_mae) then cv_primary_mae end cv_primary_mae, case when isfinite(cv_shadow_mae) then cv_shadow_mae end cv_shadow_mae, case when isfinite(public_mae) then public_mae end public_mae, case when isfinite(private_mae) then private_mae end private_mae from experiments window w as (partition by experiment_code)) where target is not null group by 1)"


def _exp(spark, sf):
    e = read(spark, sf, "experiments").groupBy("experiment_code").agg(
        F.min("family").alias("family"), F.min("target").alias("target"), F.min(finite("cv_primary_mae")).alias("p"), F.min(finite("cv_shadow_mae")).alias("s"), F.min(finite("public_mae")).alias("u"), F.min(finite("private_mae")).alias("v")
    )
    return e.where("target is not null")


@part.query(f"select experiment_code, round((p+s)/2,9) cv_mean, round(case when p is not null and s is not null then greatest(p,s) end,9) cv_worst, round(abs(p-s),9) cv_gap, round(abs(u-v),9) board_gap from {_EXP}")
def cv_scores_leaderboard(spark, sf):
    r = _exp(spark, sf).select("experiment_code", *E.derived_scores("p", "s", "u", "v"))
    return r.select("experiment_code", *[r6(c, 9).alias(c) for c in ("cv_mean", "cv_worst", "cv_gap", "board_gap")])


def _transfer(a, b):
    base = f"(select target, {a} x, {b} y from {_EXP} where {a} is not null and {b} is not null)"
    rk = lambda c: f"rank() over (partition by target order by {c}) + (count(*) over (partition by target, {c}) - 1)/2.0"
    return f"""select target, '{a}' a, '{b}' b, n, spearman, tau from (select target, count(*) n, round(corr(rx,ry),6) spearman from (select target, {rk('x')} rx, {rk('y')} ry from {base}) group by 1)
 join (select d.target, round(sum(sign(d.x-e.x)*sign(d.y-e.y))/sqrt(sum((d.x<>e.x)::int)::double*sum((d.y<>e.y)::int)),6) tau from {base} d join {base} e on d.target=e.target group by 1) using (target)"""


@part.query(" union all ".join(f"({_transfer(a, b)})" for a, b in (("p", "u"), ("p", "v"), ("u", "v"))))
def rank_transfer(spark, sf):
    return E.rank_transfer(_exp(spark, sf), ["target"], ["p", "u", "v"]).withColumns({"spearman": r6("spearman"), "tau": r6("tau")})


@part.query("""with c as (select o_orderpriority, c_nationkey, o_orderstatus, avg(o_totalprice) s1, min(o_totalprice) s2 from orders join customer on o_custkey=c_custkey group by 1,2,3) select x.o_orderpriority, x.c_nationkey, round(x.s1-y.s1,4) delta_s1, round(x.s2-y.s2,4) delta_s2, (x.s1<y.s1 and x.s2<y.s2) both_improve from c x join c y on x.o_orderpriority=y.o_orderpriority and x.c_nationkey=y.c_nationkey and x.o_orderstatus='O' and y.o_orderstatus='F'""")
def paired_contrasts(spark, sf):
    c = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderpriority", "c_nationkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("s1"), F.min("o_totalprice").alias("s2"))
    r = E.paired_contrasts(c, ["o_orderpriority", "c_nationkey"], "o_orderstatus", "O", "F", ["s1", "s2"])
    return r.withColumns({"delta_s1": r6("delta_s1", 4), "delta_s2": r6("delta_s2", 4)})


def _regret(src, by):
    rk = lambda c: f"rank() over (partition by {by} order by {c}) + (count(*) over (partition by {by}, {c}) - 1)/2.0"
    return f"""select {by}, count(*) n, arg_min(experiment_code, (p, experiment_code)) winner, round(arg_min(v, (p, experiment_code)) - min(v),6) regret, round(case when stddev_pop(rp)>=1e-12 and stddev_pop(rv)>=1e-12 then covar_pop(rp,rv)/(stddev_pop(rp)*stddev_pop(rv)) end,6) spearman,
 (coalesce(case when stddev_pop(rp)>=1e-12 and stddev_pop(rv)>=1e-12 then covar_pop(rp,rv)/(stddev_pop(rp)*stddev_pop(rv)) end < -0.2,false) or arg_min(v, (p, experiment_code)) - min(v) > 1.5) catastrophic from (select *, {rk('p')} rp, {rk('v')} rv from {src} where p is not null and v is not null) group by {by}"""


@part.query(_regret(_EXP, "target"))
def winner_regret(spark, sf):
    return E.winner_regret(_exp(spark, sf), ["target"], "experiment_code", "p", "v").withColumns({"regret": r6("regret"), "spearman": r6("spearman")})


@part.query("select * from (" + _regret(f"(select e.*, f.left_out from {_EXP} e join (select distinct target, family left_out from {_EXP} where family is not null) f on e.target=f.target where e.family is null or e.family <> f.left_out)", "target, left_out") + ") where n >= 3")
def leave_one_family_out(spark, sf):
    return E.leave_one_family_out(_exp(spark, sf), ["target"], "experiment_code", "family", "p", "v").withColumns({"regret": r6("regret"), "spearman": r6("spearman")})


@part.query()
def selection_policy_stress(spark, sf):
    r = E.policy_stress(_exp(spark, sf), ["target"], "experiment_code", "p", "u", "v", trajectories=50, catalogue=20)
    return r.select("target", "policy", "n", *[r6(c).alias(c) for c in ("mean_regret", "median_regret", "p90_regret", "zero_fraction")])


@part.query(f"""with d as (select family, target, avg(p)-avg(s) t, avg(u)-avg(p) a, avg(v)-avg(u) b from {_EXP} where family is not null group by 1,2),
g as (select *, case when t>0 then '+' when t<0 then '-' when t is not null then '0' else '?' end || case when a>0 then '+' when a<0 then '-' when a is not null then '0' else '?' end || case when b>0 then '+' when b<0 then '-' when b is not null then '0' else '?' end pattern from d)
select family, target, pattern, case when pattern = '---' then 'CONSISTENT_GAIN' when pattern = '+++' then 'CONSISTENT_LOSS' when contains(pattern,'?') then 'INCOMPLETE' else 'MIXED' end class from g""")
def evidence_ladder(spark, sf):
    d = _exp(spark, sf).where("family is not null").groupBy("family", "target").agg((F.avg("p") - F.avg("s")).alias("t"), (F.avg("u") - F.avg("p")).alias("a"), (F.avg("v") - F.avg("u")).alias("b"))
    d = d.withColumn("pattern", E.sign_pattern(["t", "a", "b"]))
    return d.select("family", "target", "pattern", E.ladder([("CONSISTENT_GAIN", F.col("pattern") == "---"), ("CONSISTENT_LOSS", F.col("pattern") == "+++"), ("INCOMPLETE", F.contains("pattern", F.lit("?")))], "MIXED").alias("class"))


@part.query()
def nested_group_cv(spark, sf):
    """Nested CV whose folds hold whole suppliers, balanced by size."""
    from chainloom.operators.nested import nested_oof

    groups = K.balanced_folds(read(spark, sf, "lineitem"), "l_suppkey", 5).select("l_suppkey", "fold")
    d = read(spark, sf, "lineitem").join(groups, "l_suppkey").select("l_suppkey", "fold", F.col("l_quantity").alias("x"), F.col("l_tax").alias("x2"), F.col("l_extendedprice").alias("y"))
    oof, chosen = nested_oof(d, ["x", "x2"], "y", "fold", _GRID)
    table = spark.createDataFrame([(c["fold"], c["alpha"]) for c in chosen], "fold int, alpha double")
    r = oof.groupBy("fold").agg(F.countDistinct("l_suppkey").alias("n_groups"), r6(F.avg(F.abs(F.col("y") - F.col("oof"))), 2).alias("mae"))
    return r.join(table, "fold").select("fold", "n_groups", "alpha", "mae")
