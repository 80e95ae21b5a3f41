"""Queries of the aggregation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.operators import aggregate as A
from chainloom.plans.part import Part, r6
from chainloom.session import read

part = Part()
COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = " union all ".join(f"select '{c}' feature, {c} v from lineitem" for c in COLUMNS)


def rounded(df, digits=6, skip=()):
    """All double columns rounded."""
    return df.select(*[r6(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


@part.query(f"select feature, count(v) n, count(*) - count(v) missing, 0.0::double missing_fraction, round(avg(v),4) mean, round(stddev_samp(v),4) sd, round(quantile_cont(v,0.5),4) median, min(v) min, max(v) max from ({_LONG}) group by 1")
def target_summary(spark, sf):
    return rounded(A.numeric_summary(read(spark, sf, "lineitem"), COLUMNS), 4)


@part.query("select kind, round(quantile_cont(prediction,0.01),6) q01, round(quantile_cont(prediction,0.05),6) q05, round(quantile_cont(prediction,0.5),6) q50, round(quantile_cont(prediction,0.95),6) q95, round(quantile_cont(prediction,0.99),6) q99 from predictions where prediction is not null and not isnan(prediction) group by 1")
def quantile_set(spark, sf):
    from chainloom.operators.prefix import quantiles

    p = read(spark, sf, "predictions").withColumn("prediction", A.finite("prediction"))
    q = quantiles(p, ["kind"], "prediction", [0.01, 0.05, 0.5, 0.95, 0.99])
    return q.select("kind", *[r6(F.col("q")[i]).alias(n) for i, n in enumerate(("q01", "q05", "q50", "q95", "q99"))])


@part.query("""with q as (select l_returnflag, quantile_cont(l_extendedprice,0.25) q1, quantile_cont(l_extendedprice,0.75) q3 from lineitem group by 1)
select l_returnflag, count(*) n, round(any_value(q1),4) q1, round(any_value(q3),4) q3, count(*) filter (l_extendedprice < q1-1.5*(q3-q1) or l_extendedprice > q3+1.5*(q3-q1)) n_out from lineitem join q using (l_returnflag) group by 1""")
def iqr_outliers(spark, sf):
    return rounded(A.iqr_outliers(read(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice"), 4)


@part.query(f"select feature, 1.0::double finite_fraction, round(stddev_pop(v),4) sd, min(v) min, round(quantile_cont(v,0.05),4) q05, round(quantile_cont(v,0.5),4) median, round(quantile_cont(v,0.95),4) q95, max(v) max, stddev_pop(v) < 1e-12 as constant from ({_LONG}) group by 1")
def feature_qc_profile(spark, sf):
    return rounded(A.qc_profile(read(spark, sf, "lineitem"), COLUMNS), 4)


@part.query("select o_orderpriority, o_orderstatus, count(*) n, round(avg(o_totalprice),4) mean, round(median(o_totalprice),4) median, min(o_totalprice) min, max(o_totalprice) max, round(stddev_samp(o_totalprice),4) sd from orders group by 1,2")
def group_statistics(spark, sf):
    d = A.describe(read(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice")
    return rounded(d.select("o_orderpriority", "o_orderstatus", "n", "mean", F.col("q50").alias("median"), "min", "max", "sd"), 4)


@part.query("""select scheme, count(fold) n, round(avg(fold),6) mean, round(stddev_samp(fold),6) sd, min(fold)::double min, quantile_cont(fold,0.25) q25, quantile_cont(fold,0.5) q50, quantile_cont(fold,0.75) q75, max(fold)::double max from folds group by 1""")
def describe_by_scheme(spark, sf):
    return rounded(A.describe(read(spark, sf, "folds").withColumn("fold", F.col("fold").cast("double")), ["scheme"], "fold"))


@part.query("select count(*) n_rows, count(distinct id) n_groups, (select count(*) from (select id from dev group by 1 having count(*)>1)) n_repeated, (select max(c) from (select count(*) c from dev group by id)) largest from dev")
def group_sizes(spark, sf):
    return A.group_sizes(read(spark, sf, "dev"), ["id"])


@part.query("select id, count(*) n_rows, count(distinct fold) n_labels from folds group by 1 having count(distinct fold) > 1")
def group_conflicts(spark, sf):
    return A.conflicts(read(spark, sf, "folds"), ["id"], "fold")


@part.query("select source, count(*) n, round(count(*) / sum(count(*)) over (), 9) fraction from dev group by 1")
def value_counts_norm(spark, sf):
    return A.value_counts(read(spark, sf, "dev"), "source", dropna=False).withColumn("fraction", r6("fraction", 9))


@part.query("select source, count(*) n, round(count(*) / sum(count(*)) over (), 9) fraction from dev where source is not null group by 1")
def value_counts_dropna(spark, sf):
    return A.value_counts(read(spark, sf, "dev"), "source").withColumn("fraction", r6("fraction", 9))


@part.query("select family, count(*) n_rows, round(avg(cv_primary_mae),6) mean_primary, round(min(cv_shadow_mae),6) best_shadow, count(distinct feature_set_id) n_sets from experiments group by 1")
def named_aggregation(spark, sf):
    e = read(spark, sf, "experiments")
    return e.groupBy("family").agg(
        F.count("*").alias("n_rows"), r6(F.avg(A.finite("cv_primary_mae"))).alias("mean_primary"), r6(F.min(A.finite("cv_shadow_mae"))).alias("best_shadow"), F.countDistinct("feature_set_id").alias("n_sets")
    )


@part.query("select l_orderkey, bool_or(l_returnflag='R') any_returned, bool_and(l_returnflag='R') all_returned, bool_or(l_discount > 0.05) any_cheap, bool_and(l_discount > 0.05) all_cheap from lineitem group by 1")
def group_any_all(spark, sf):
    return A.flags(read(spark, sf, "lineitem"), ["l_orderkey"], {"returned": F.col("l_returnflag") == "R", "cheap": F.col("l_discount") > 0.05})


@part.query("select l_returnflag, count(v) n_inner, round(median(v),6) as value from (select l_returnflag, l_suppkey, l_linenumber, min(l_extendedprice) v from lineitem group by 1,2,3) group by 1")
def two_level_agg(spark, sf):
    return rounded(A.two_level(read(spark, sf, "lineitem"), ["l_returnflag", "l_suppkey", "l_linenumber"], ["l_returnflag"], "l_extendedprice"))


@part.query("select l_suppkey, round(sum(l_quantity*l_discount)/sum(l_quantity),9) wmean from lineitem group by 1")
def area_weighted_mean(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(r6(A.weighted_mean("l_quantity", "l_discount"), 9).alias("wmean"))


_MASKS = {"ALL": "true", "OPEN": "o_orderstatus = 'O'", "HIGH": "o_orderpriority in ('1-URGENT','2-HIGH')", "OPENHIGH": "o_orderstatus = 'O' and o_orderpriority in ('1-URGENT','2-HIGH')"}


@part.query("select o_custkey, " + ", ".join(f"count(*) filter ({c}) {m}_count, coalesce(round(sum(o_totalprice) filter ({c}),4),0) {m}_sum, coalesce(round(avg(o_totalprice) filter ({c}),4),0) {m}_mean, coalesce(max(o_totalprice) filter ({c}),0) {m}_max" for m, c in _MASKS.items()) + " from orders group by 1")
def masked_statistics_block(spark, sf):
    return rounded(A.masked_block(read(spark, sf, "orders"), ["o_custkey"], F.col("o_totalprice"), {m: F.expr(c) for m, c in _MASKS.items()}, on_empty=0.0), 4)


@part.query("select l_suppkey, count(*) n_rows, round(sum(l_extendedprice),2) total, round(avg(l_extendedprice),4) mean, round(median(l_extendedprice),4) median, max(l_extendedprice) max, round(count(*) filter (l_discount > 0.05) / count(*),9) cheap_fraction, round(coalesce(sum(l_extendedprice) filter (l_returnflag='R'),0),2) returned_sum, round(sum(l_discount*l_quantity)/nullif(sum(l_discount),0),6) weighted_quantity from lineitem group by 1")
def exposure_block(spark, sf):
    price = A.finite("l_extendedprice")
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n_rows"), r6(F.sum(price), 2).alias("total"), r6(F.avg(price), 4).alias("mean"), r6(A.STATS["median"](price), 4).alias("median"), F.max(price).alias("max"),
        r6(F.count_if(F.col("l_discount") > 0.05) / F.count("*"), 9).alias("cheap_fraction"), r6(F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", price)), F.lit(0.0)), 2).alias("returned_sum"),
        r6(A.weighted_mean("l_discount", "l_quantity")).alias("weighted_quantity"),
    )


@part.query("""select l_suppkey, count(*) n, round(avg(abs(d)),6) mean_abs, round(sqrt(avg(d*d)),6) rms, round(max(abs(d)),6) max_abs, round(avg(d),6) mean_signed, round(count(*) filter (abs(d) >= 0.02)/count(*),9) over_2, round(count(*) filter (abs(d) >= 0.05)/count(*),9) over_5,
 coalesce(round(avg(abs(d)) filter (l_linestatus='F'),6),0) mean_abs_f from (select *, l_discount - l_tax d from lineitem) group by 1""")
def shift_statistics(spark, sf):
    d = A.finite(F.col("l_discount") - F.col("l_tax"))
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(d).alias("n"), r6(F.avg(F.abs(d))).alias("mean_abs"), r6(A.STATS["rms"](d)).alias("rms"), r6(F.max(F.abs(d))).alias("max_abs"), r6(F.avg(d)).alias("mean_signed"),
        r6(F.count_if(F.abs(d) >= 0.02) / F.count("*"), 9).alias("over_2"), r6(F.count_if(F.abs(d) >= 0.05) / F.count("*"), 9).alias("over_5"),
        r6(F.coalesce(F.avg(F.when(F.col("l_linestatus") == "F", F.abs(d))), F.lit(0.0))).alias("mean_abs_f"),
    )


_SHARE = """select s_nationkey, count(*) n, max(v) max, round(avg(v),4) mean, round(sum(v),4) sum, round(stddev_pop(v),4) sd, round(list_avg(list_sort(list(v),'DESC')[1:5]),4) top_mean, round(avg(greatest(v,0)),4) positive_mean,
 case when sum(greatest(v,0))=0 then 0 else round(list_sum(list_transform(list_sort(list(v),'DESC')[1:5], lambda x: greatest(x,0)))/sum(greatest(v,0)),6) end top_share from (select s_nationkey, s_acctbal v from supplier) group by 1"""


@part.query(_SHARE)
def topk_mean_stats(spark, sf):
    return A.top_stats(read(spark, sf, "supplier"), ["s_nationkey"], "s_acctbal").select(
        "s_nationkey", "n", "max", *[r6(c, 4).alias(c) for c in ("mean", "sum", "sd", "top_mean", "positive_mean")], r6("top_share").alias("top_share")
    )


@part.query("select o_custkey, max(o_totalprice) as MAX, round(avg(o_totalprice),4) as MEAN, round(sum(o_totalprice),4) as SUM, round(quantile_cont(o_totalprice,0.9),4) as Q90, round(quantile_cont(o_totalprice,0.95),4) as Q95, round(list_avg(list_sort(list(o_totalprice),'DESC')[1:3]),4) as TOP3_MEAN, round(list_avg(list_sort(list(o_totalprice),'DESC')[1:5]),4) as TOP5_MEAN from orders group by 1")
def spatial_aggregate_set(spark, sf):
    o = read(spark, sf, "orders")
    v = A.finite("o_totalprice")
    base = o.groupBy("o_custkey").agg(F.max(v).alias("MAX"), r6(F.avg(v), 4).alias("MEAN"), r6(F.sum(v), 4).alias("SUM"), r6(A.STATS["q90"](v), 4).alias("Q90"), r6(A.STATS["q95"](v), 4).alias("Q95"))
    top = A.top_values(o, ["o_custkey"], "o_totalprice", 5)
    mean = lambda n: r6(F.try_divide(F.aggregate(F.slice("top", 1, n), F.lit(0.0), lambda a, x: a + x), F.size(F.slice("top", 1, n))), 4)
    return base.join(top, "o_custkey", "left").select(*base.columns, mean(3).alias("TOP3_MEAN"), mean(5).alias("TOP5_MEAN"))


@part.query("select o_orderstatus, round(stddev_pop(o_totalprice),4) sd_pop, round(stddev_samp(o_totalprice),4) sd_samp from orders group by 1")
def population_sd(spark, sf):
    return read(spark, sf, "orders").groupBy("o_orderstatus").agg(r6(A.STATS["sd_pop"](F.col("o_totalprice")), 4).alias("sd_pop"), r6(A.STATS["sd"](F.col("o_totalprice")), 4).alias("sd_samp"))


@part.query("""with v as (select p_brand, unnest(range(1, length(p_name)+1)) pos, p_name from part where length(p_name) > 0),
c as (select p_brand, pos, p_name[pos] ch, count(*) n from v group by 1,2,3),
b as (select p_brand, pos, arg_min(ch, (-n, ascii(ch))) ch from c group by 1,2)
select p_brand, string_agg(ch, '' order by pos) consensus, (select count(*) from part p where p.p_brand = b.p_brand and length(p_name) > 0) n_texts from b group by p_brand""")
def consensus_per_position(spark, sf):
    return A.consensus(read(spark, sf, "part"), ["p_brand"], "p_name")


@part.query("""select count(*) n_rows, count(distinct experiment_code) n_keys, count(*) - count(distinct experiment_code) n_repeated_rows, sum(m1+m2+m3)::bigint missing_cells, ((sum(m1)>0)::int + (sum(m2)>0)::int + (sum(m3)>0)::int) columns_with_missing, coalesce(bool_or(isinf(cv_primary_mae) or isinf(public_mae)),false) has_infinite
from (select *, (cv_primary_mae is null or isnan(cv_primary_mae))::int m1, (public_mae is null or isnan(public_mae))::int m2, (n_features is null)::int m3 from experiments)""")
def coverage_report(spark, sf):
    return A.coverage(read(spark, sf, "experiments"), "experiment_code", ["cv_primary_mae", "public_mae", "n_features"])


@part.query("with s as (select count(*) c from documents where source is not null group by source) select count(*) n_groups, max(c) largest, median(c)::double median_size, round(avg(c),6) mean_size, round(count(*) filter (c=1)/count(*),6) singleton_fraction from s")
def cluster_stats(spark, sf):
    return rounded(A.cluster_stats(read(spark, sf, "documents"), "source"))


@part.query("select o_orderpriority, o_orderstatus, r_name, grouping_id(o_orderpriority,o_orderstatus,r_name)::bigint as \"level\", count(o_totalprice) n, round(avg(o_totalprice),4) mean from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey group by cube(o_orderpriority,o_orderstatus,r_name)")
def hand_margins_cube(spark, sf):
    o, c, n, g = (read(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey)
    return A.cube_means(joined, ["o_orderpriority", "o_orderstatus", "r_name"], "o_totalprice").withColumn("mean", r6("mean", 4))


@part.query("select l_suppkey, count(*) filter (a and b) n_both, count(*) filter (a or b) n_either, count(*) filter (a <> b) n_xor, count(*) filter (not a and not b) n_neither from (select l_suppkey, l_returnflag='R' a, l_discount>0.05 b from lineitem) group by 1")
def boolean_xor_counts(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(*A.boolean_overlap(F.col("l_returnflag") == "R", F.col("l_discount") > 0.05))


@part.query("""with c as (select user_id, event_type, count(*) n from events group by 1,2), t as (select user_id, sum(n) s from c group by 1)
select user_id, any_value(s)::bigint n, count(*) n_labels, round(-sum(n/s*ln(n/s)),6)+0.0 entropy from c join t using (user_id) group by 1""")
def entropy_by_group(spark, sf):
    return A.shannon_entropy(read(spark, sf, "events"), ["user_id"], "event_type").withColumn("entropy", F.abs(r6("entropy")))


@part.query("select l_suppkey, round(avg(-q*ln(q)-(1-q)*ln(1-q)),6) entropy from (select l_suppkey, greatest(least(l_discount*10,1-1e-6),1e-6) q from lineitem) group by 1")
def bernoulli_entropy(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(r6(A.bernoulli_entropy(F.col("l_discount") * 10)).alias("entropy"))
