"""Queries of error measures, correlations and distribution distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.operators import stats as X
from chainloom.operators.aggregate import finite
from chainloom.plans.part import Part, r6
from chainloom.session import read

part = Part()


def _scored(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    d = read(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return d.select("l_orderkey", "l_linenumber", "l_returnflag", "p_brand", "l_suppkey", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("p"))


_SCORED = "(select l_orderkey, l_linenumber, l_returnflag, p_brand, l_suppkey, l_extendedprice y, l_quantity*p_retailprice p from lineitem join part on l_partkey=p_partkey)"


@part.query(f"select p_brand, round(avg(abs(y-p)),4) mae from {_SCORED} group by 1")
def mae_by_brand(spark, sf):
    return _scored(spark, sf).groupBy("p_brand").agg(r6(X.mae("y", "p"), 4).alias("mae"))


@part.query(f"""select p_brand, count(*) n, round(avg(abs(p-y)),4) mae, round(sqrt(avg((p-y)*(p-y))),4) rmse, round(avg(p-y),4) bias, round(1-avg((p-y)*(p-y))/var_pop(y),6) r2, round(corr(y,p),6) pearson, round(regr_slope(y,p),6) slope, round(regr_intercept(y,p),4) intercept,
 round(2*covar_samp(y,p)/(var_samp(y)+var_samp(p)+(avg(y)-avg(p))*(avg(y)-avg(p))),6) ccc from {_SCORED} group by 1""")
def regression_report(spark, sf):
    r = _scored(spark, sf).groupBy("p_brand").agg(*X.regression_metrics("y", "p"))
    four = ("mae", "rmse", "bias", "intercept")
    return r.select("p_brand", "n", *[r6(c, 4 if c in four else 6).alias(c) for c in r.columns[2:]])


def _rank(c, by):
    return f"rank() over (partition by {by} order by {c}) + (count(*) over (partition by {by}, {c}) - 1)/2.0"


@part.query(f"select c_nationkey, count(*) n, round(corr(ra,rb),6) spearman from (select c_nationkey, {_rank('c_acctbal', 'c_nationkey')} ra, {_rank('b', 'c_nationkey')} rb from (select c_nationkey, c_acctbal, c_custkey % 37 b from customer)) group by 1")
def spearman_by_group(spark, sf):
    c = read(spark, sf, "customer").withColumn("b", F.col("c_custkey") % 37)
    return X.spearman(c, ["c_nationkey"], "c_acctbal", "b").withColumn("spearman", r6("spearman"))


@part.query("""with d as (select s_nationkey, s_acctbal a, s_suppkey % 5 b from supplier), p as (select x.s_nationkey, sum(sign(x.a-y.a)*sign(x.b-y.b)) s, sum((x.a<>y.a)::int) ta, sum((x.b<>y.b)::int) tb from d x join d y on x.s_nationkey=y.s_nationkey group by 1)
select s_nationkey, (select count(*) from d where d.s_nationkey=p.s_nationkey) n, case when ta*tb>0 then round(s/sqrt(ta::double*tb),6) end tau from p""")
def kendall_by_group(spark, sf):
    s = read(spark, sf, "supplier").withColumn("b", F.col("s_suppkey") % 5)
    return X.kendall(s, ["s_nationkey"], "s_acctbal", "b").withColumn("tau", r6("tau"))


@part.query("""with d as (select o_orderstatus, o_totalprice s, o_orderpriority='1-URGENT' p from orders), r as (select *, rank() over (partition by o_orderstatus order by s)+(count(*) over (partition by o_orderstatus, s)-1)/2.0 rk from d),
v as (select o_orderstatus, s, count(*) filter (p) np, count(*) n from d group by 1,2), c as (select *, sum(np) over w cp, sum(n) over w cn from v window w as (partition by o_orderstatus order by s desc)),
ap as (select o_orderstatus, round(sum(np*cp/cn)/sum(np),6) average_precision from c group by 1)
select o_orderstatus, count(*) filter (p) n_pos, count(*) filter (not p) n_neg, round((sum(rk) filter (p) - count(*) filter (p)*(count(*) filter (p)+1)/2.0)/(count(*) filter (p)*count(*) filter (not p)),6) auc, any_value(average_precision) average_precision from r join ap using (o_orderstatus) group by 1""")
def tail_report_auc(spark, sf):
    r = X.auc(read(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", F.col("o_orderpriority") == "1-URGENT")
    return r.select("o_orderstatus", "n_pos", "n_neg", r6("auc").alias("auc"), r6("average_precision").alias("average_precision"))


@part.query("with r as (select *, row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) rn, o_orderpriority='1-URGENT' p from orders) select o_orderstatus, count(*) filter (p) n_pos, round(count(*) filter (p and rn <= 13)/count(*) filter (p),9) recall from r group by 1")
def recall_at_k(spark, sf):
    return X.recall_at(read(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", "o_orderkey", F.col("o_orderpriority") == "1-URGENT", 13).withColumn("recall", r6("recall", 9))


_FEATURES = ["cv_primary_mae", "cv_shadow_mae", "n_features", "public_mae"]


def _one(c):
    pair = f"select private_mae y, {c}::double x from experiments where private_mae is not null and isfinite(private_mae) and {c} is not null and isfinite({c}::double)"
    r = lambda v: f"rank() over (order by {v}) + (count(*) over (partition by {v}) - 1)/2.0"
    return f"select '{c}' feature, count(*) n, round(corr(x,y),6) pearson, round(corr(rx,ry),6) spearman from (select x, y, {r('x')} rx, {r('y')} ry from ({pair}))"


@part.query(" union all ".join(_one(c) for c in _FEATURES))
def correlation_table(spark, sf):
    t = X.correlation_table(read(spark, sf, "experiments"), "private_mae", _FEATURES)
    return t.select("feature", "n", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


_PRED = "(select kind, id, max(prediction) v from predictions where prediction is not null and not isnan(prediction) and id is not null group by 1,2)"


@part.query(f"select a.kind a, b.kind b, count(*) n, round(corr(a.v,b.v),6) pearson from {_PRED} a join {_PRED} b on a.id=b.id and a.kind<b.kind group by 1,2")
def prediction_correlations(spark, sf):
    p = read(spark, sf, "predictions").withColumn("v", finite("prediction")).where("v is not null and id is not null").groupBy("kind", "id").agg(F.max("v").alias("v"))
    return X.correlation_matrix(p, ["id"], "kind", "v").withColumn("pearson", r6("pearson"))


_LCOLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@part.query(" union all ".join(f"select '{a}' a, '{b}' b, round(corr({a},{b}),6) pearson from lineitem" for i, a in enumerate(_LCOLS) for b in _LCOLS[i + 1 :]))
def column_correlations(spark, sf):
    return X.moments_correlation(read(spark, sf, "lineitem"), _LCOLS).withColumn("pearson", r6("pearson"))


@part.query("with r as (select abs(corr(l_quantity,l_extendedprice)) >= 0.5 near from lineitem) select 'l_discount' feature, 'l_discount' seed union all select 'l_extendedprice', case when near then 'l_quantity' else 'l_extendedprice' end from r union all select 'l_quantity', 'l_quantity' union all select 'l_tax', 'l_tax'")
def redundancy_clusters(spark, sf):
    rows = X.moments_correlation(read(spark, sf, "lineitem"), _LCOLS).collect()  # a row a pair of columns
    seeds = X.redundancy_clusters([tuple(r) for r in rows], _LCOLS, threshold=0.5)
    return spark.createDataFrame(sorted(seeds.items()), "feature string, seed string")


_CDF = """with d as (select o_orderpriority, o_totalprice v, o_orderstatus='O' a from orders), v as (select o_orderpriority, v, count(*) filter (a) na, count(*) filter (not a) nb from d group by 1,2),
c as (select *, sum(na) over w / sum(na) over (partition by o_orderpriority) fa, sum(nb) over w / sum(nb) over (partition by o_orderpriority) fb, lead(v) over w nx from v window w as (partition by o_orderpriority order by v))
select o_orderpriority, sum(na)::bigint n_a, sum(nb)::bigint n_b, round(sum(abs(fa-fb)*(nx-v)),4) wasserstein, round(max(abs(fa-fb)),6) ks from c group by 1"""


@part.query(_CDF)
def wasserstein_exact(spark, sf):
    r = X.cdf_distances(read(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", F.col("o_orderstatus") == "O")
    return r.select("o_orderpriority", "n_a", "n_b", r6("wasserstein", 4).alias("wasserstein"), r6("ks").alias("ks"))


@part.query(_CDF.replace("o_orderpriority", "o_orderstatus").replace("o_orderstatus='O'", "o_custkey % 2 = 0").replace("round(sum(abs(fa-fb)*(nx-v)),4) wasserstein, ", ""))
def ks_statistic(spark, sf):
    r = X.cdf_distances(read(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", F.col("o_custkey") % 2 == 0)
    return r.select("o_orderstatus", "n_a", "n_b", r6("ks").alias("ks"))


_GRID = "[" + ",".join(f"{i / 49!r}" for i in range(50)) + "]"


@part.query(f"with q as (select o_orderpriority, o_orderstatus='O' a, quantile_cont(o_totalprice, {_GRID}) q from orders group by 1,2) select x.o_orderpriority, round(list_avg(list_transform(list_zip(x.q,y.q), lambda p: abs(p[1]-p[2]))),4) distance from q x join q y on x.o_orderpriority=y.o_orderpriority and x.a and not y.a")
def wasserstein_grid(spark, sf):
    return X.quantile_distance(read(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", F.col("o_orderstatus") == "O").withColumn("distance", r6("distance", 4))


_BAL = """with c as (select o_orderpriority k, count(*) filter (o_orderstatus='O') a, count(*) filter (o_orderstatus='F') b from orders group by 1), s as (select a, b, a/sum(a) over () p, b/sum(b) over () q from c), m as (select *, greatest(p,1e-12) pc, greatest(q,1e-12) qc from s)
select round(sum(pc*ln(pc/((pc+qc)/2))/2+qc*ln(qc/((pc+qc)/2))/2),9) js, round(sum(abs(p-q))/2,9) tv, round(sum(abs(p-q)),9) l1, sum(abs(a-b))::bigint bin_l1 from m"""


@part.query(_BAL)
def js_tv_l1_balance(spark, sf):
    b = X.category_balance(read(spark, sf, "orders"), "o_orderpriority", F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F")
    return b.select(*[r6(c, 9).alias(c) for c in ("js", "tv", "l1")], "bin_l1")


@part.query("""with d as (select *, (o_totalprice > 100000)::int + 2*(o_orderpriority < '3')::int + 4 * (o_custkey % 4) joint from orders), c as (select joint, count(*) filter (o_orderstatus='O') a, count(*) filter (o_orderstatus='F') b from d group by 1) select sum(abs(a-b))::bigint bin_l1 from c""")
def joint_bin_imbalance(spark, sf):
    joint = (F.col("o_totalprice") > 100000).cast("int") + 2 * (F.col("o_orderpriority") < "3").cast("int") + 4 * (F.col("o_custkey") % 4)
    return X.category_balance(read(spark, sf, "orders").withColumn("joint", joint), "joint", F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F").select("bin_l1")


@part.query("select o_orderpriority, round(abs(avg(o_totalprice) filter (o_orderstatus='O') - avg(o_totalprice) filter (o_orderstatus='F'))/(sqrt((var_pop(o_totalprice) filter (o_orderstatus='O') + var_pop(o_totalprice) filter (o_orderstatus='F'))/2)+1e-12),6) smd from orders group by 1")
def abs_smd(spark, sf):
    c = X.standardised_difference("o_totalprice", F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F")
    return read(spark, sf, "orders").groupBy("o_orderpriority").agg(r6(c).alias("smd"))


@part.query("with q as (select o_orderstatus s, quantile_cont(o_totalprice,[0.1,0.25,0.5,0.75,0.9]) q from orders where o_orderstatus in ('O','F') group by 1) select round(list_avg(list_transform(list_zip(x.q,y.q), lambda p: abs(p[1]-p[2])))/(select stddev_pop(o_totalprice) from orders),6) imbalance from q x join q y on x.s='O' and y.s='F'")
def quantile_imbalance(spark, sf):
    return X.quantile_imbalance(read(spark, sf, "orders"), "o_totalprice", F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F").withColumn("imbalance", r6("imbalance"))


@part.query("""with d as (select s_nationkey % 5 g, s_acctbal x, s_suppkey::double % 97 y, s_suppkey % 2 = 0 a from supplier), m as (select p.g, avg(sqrt((p.x-q.x)**2+(p.y-q.y)**2)) filter (p.a and not q.a) ab, avg(sqrt((p.x-q.x)**2+(p.y-q.y)**2)) filter (p.a and q.a) aa, avg(sqrt((p.x-q.x)**2+(p.y-q.y)**2)) filter (not p.a and not q.a) bb from d p join d q on p.g=q.g group by 1)
select g, (select count(*) filter (a) from d where d.g=m.g) n_a, (select count(*) filter (not a) from d where d.g=m.g) n_b, round(2*ab-aa-bb,4) energy from m""")
def energy_distance(spark, sf):
    s = read(spark, sf, "supplier").select((F.col("s_nationkey") % 5).alias("g"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey").cast("double") % 97).alias("y"), "s_suppkey")
    return X.energy_distance(s, ["g"], "x", "y", F.col("s_suppkey") % 2 == 0).withColumn("energy", r6("energy", 4))


def _pair_sql(f):
    pr = f"(select c_nationkey k, c_mktsegment m, avg({f}) v from customer group by 1,2)"
    p = f"(select '{f}' feature, x.m a, y.m b, x.k k, x.v va, y.v vb, abs(x.v-y.v) gap from {pr} x join {pr} y on x.k=y.k and x.m<y.m)"
    by = "a, b"
    return f"""select feature, a, b, count(*) n, round(corr(va,vb),6) pearson, round(corr(ra,rb),6) spearman, round(quantile_cont(gap,0.5),4) median_gap, round(quantile_cont(gap,0.95),4) p95_gap,
 round(count(*) filter (ta<=5 and tb<=5)/count(*) filter (ta<=5 or tb<=5),6) top_jaccard, round(count(*) filter (ba<=5 and bb<=5)/count(*) filter (ba<=5 or bb<=5),6) bottom_jaccard, case when corr(ra,rb)>=0.8 then 'ROBUST' when corr(ra,rb)>=0.5 then 'MODERATE' else 'FRAGILE' end verdict
 from (select *, {_rank('va', by)} ra, {_rank('vb', by)} rb, row_number() over (partition by {by} order by va desc, k) ta, row_number() over (partition by {by} order by vb desc, k) tb, row_number() over (partition by {by} order by va, k) ba, row_number() over (partition by {by} order by vb, k) bb from {p}) group by 1,2,3"""


@part.query(_pair_sql("c_acctbal") + " union all " + _pair_sql("c_custkey"))
def robustness_pairs(spark, sf):
    d = read(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("c_acctbal"), F.avg("c_custkey").alias("c_custkey"))
    r = X.robustness(d, ["c_nationkey"], "c_mktsegment", ["c_acctbal", "c_custkey"], "c_nationkey", k=5)
    return r.select("feature", "a", "b", "n", *[r6(c, 4 if "gap" in c else 6).alias(c) for c in ("pearson", "spearman", "median_gap", "p95_gap", "top_jaccard", "bottom_jaccard")], "verdict")


@part.query()
def pca_principal_angles(spark, sf):
    """Stability of the first two principal axes of the embeddings between two halves of the rows."""
    import numpy as np

    from chainloom.operators.linear import covariance

    e = read(spark, sf, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(8)])
    axes = []
    for side in (0, 1):
        _, cov, _ = covariance(e.where(F.col("vec_id") % 2 == side), [f"e{i}" for i in range(8)])
        axes.append(np.linalg.eigh(cov)[1][:, ::-1][:, :2])
    cos2 = X.principal_angles(*axes)
    return spark.createDataFrame([(i, round(float(c), 6)) for i, c in enumerate(cos2)], "axis int, cos2 double")


_ROLE = "(select o_custkey, o_totalprice v, o_orderpriority c, case when o_custkey % 10 < 6 or o_orderkey % 97 = 0 then 'train' when o_custkey % 10 < 8 then 'val' else 'test' end role from orders)"


def _term(r):
    return f"""(select list_avg(list_transform(list_zip(x.q,y.q), lambda p: abs(p[1]-p[2]))) / (select stddev_pop(v) from d) from (select quantile_cont(v,[0.1,0.25,0.5,0.75,0.9]) q from d where role='train') x, (select quantile_cont(v,[0.1,0.25,0.5,0.75,0.9]) q from d where role='{r}') y) {r}_imbalance,
 (select sum(abs(a/ta-b/tb))/2 from (select count(*) filter (role='train') a, count(*) filter (role='{r}') b from d group by c), (select count(*) filter (role='train') ta, count(*) filter (role='{r}') tb from d)) {r}_tv,
 (select abs(avg(v) filter (role='train')-avg(v) filter (role='{r}'))/(sqrt((var_pop(v) filter (role='train')+var_pop(v) filter (role='{r}'))/2)+1e-12) from d) {r}_smd"""


@part.query(f"with d as (select * from {_ROLE}), t as (select (select count(*) from (select o_custkey from d group by 1 having count(distinct role)>1)) leaks, {_term('val')}, {_term('test')}) select leaks, " + ", ".join(f"round({r}_{k},6) {r}_{k}" for r in ("val", "test") for k in ("imbalance", "tv", "smd")) + ", round(100*leaks + " + " + ".join(f"{w}*{r}_{k}" for r in ("val", "test") for k, w in (("imbalance", 2.0), ("tv", 1.0), ("smd", 0.5))) + ",4) score from t")
def split_score(spark, sf):
    k = F.col("o_custkey") % 10
    role = F.when((k < 6) | (F.col("o_orderkey") % 97 == 0), "train").when(k < 8, "val").otherwise("test")
    d = read(spark, sf, "orders").select("o_custkey", F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("c"), role.alias("role"))
    r = X.split_score(d, "role", "train", ["val", "test"], "v", "c", "o_custkey", {"imbalance": 2.0, "tv": 1.0, "smd": 0.5})
    return r.select("leaks", *[r6(f"{x}_{t}").alias(f"{x}_{t}") for x in ("val", "test") for t in ("imbalance", "tv", "smd")], r6("score", 4).alias("score"))
