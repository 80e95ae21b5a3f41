"""Queries of ranks, top-k, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.operators import rank as R
from chainloom.operators import reshape as S
from chainloom.operators import sets as U
from chainloom.plans.part import Part, r6
from chainloom.session import read

part = Part()


@part.query("select c_custkey, rank() over (partition by c_mktsegment order by c_acctbal) + (count(*) over (partition by c_mktsegment, c_acctbal) - 1)/2.0 average, rank() over (partition by c_mktsegment order by c_acctbal) least, dense_rank() over (partition by c_mktsegment order by c_acctbal) dense from customer")
def rank_methods(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    r = R.average_rank(c, ["c_mktsegment"], "c_acctbal", "average")
    r = R.min_rank(r, ["c_mktsegment"], "c_acctbal", "least")
    return R.dense_rank(r, ["c_mktsegment"], "c_acctbal", "dense").select("c_custkey", "average", "least", "dense")


@part.query("select scheme, id, assigned_at, fold, case when fold is null then 1 + count(fold) over (partition by scheme) else rank() over (partition by scheme order by fold nulls last) end as rank from folds")
def min_rank_nulls_last(spark, sf):
    return R.min_rank(read(spark, sf, "folds").select("scheme", "id", "assigned_at", "fold"), ["scheme"], "fold")


@part.query("select s_suppkey, dense_rank() over (order by s_nationkey) as rank from supplier")
def dense_rank_scores(spark, sf):
    return R.dense_rank(read(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), [], "s_nationkey").select("s_suppkey", "rank")


@part.query("select s_suppkey, round((rank() over (order by s_acctbal) + (count(*) over (partition by s_acctbal) - 1)/2.0 - 0.5)/count(*) over (), 9) u from supplier")
def rank_uniform(spark, sf):
    return R.rank_to_uniform(read(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), [], "s_acctbal").select("s_suppkey", r6("u", 9).alias("u"))


@part.query()
def rank_gaussian(spark, sf):
    return R.rank_to_gaussian(read(spark, sf, "customer").select("c_custkey", "c_acctbal"), [], "c_acctbal").select("c_custkey", r6("z").alias("z"))


@part.query("select o_orderkey, least(4, floor((row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) - 1) * 5 / count(*) over (partition by o_orderpriority)))::int bin from orders")
def rank_bins(spark, sf):
    return R.rank_bins(read(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey", 5).select("o_orderkey", "bin")


@part.query("with e as (select o_orderstatus, quantile_cont(o_totalprice,[0.2,0.4,0.6,0.8]) q from orders group by 1) select o_orderkey, ((o_totalprice>q[1])::int+(o_totalprice>q[2])::int+(o_totalprice>q[3])::int+(o_totalprice>q[4])::int) bin from orders join e using (o_orderstatus)")
def quantile_bins(spark, sf):
    return R.quantile_bins(read(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", 5).select("o_orderkey", "bin")


@part.query("""with d as (select l_orderkey, l_linenumber, l_extendedprice y, l_quantity*p_retailprice p from lineitem join part on l_partkey=p_partkey), q as (select quantile_cont(y,[0.2,0.4,0.6,0.8]) q from d)
select ((y>q[1])::int+(y>q[2])::int+(y>q[3])::int+(y>q[4])::int) bin, count(*) n, round(avg(abs(p-y)),4) mae, round(avg(p-y),4) bias from d, q group by 1""")
def quintile_error(spark, sf):
    part_ = read(spark, sf, "part").select("p_partkey", "p_retailprice")
    d = read(spark, sf, "lineitem").join(part_, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("p"))
    e = F.col("p") - F.col("y")
    return R.quantile_bins(d, [], "y", 5).groupBy("bin").agg(F.count("*").alias("n"), r6(F.avg(F.abs(e)), 4).alias("mae"), r6(F.avg(e), 4).alias("bias"))


@part.query("select * exclude (rn) from (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn from orders) where rn = 1")
def best_row_per_group(spark, sf):
    return R.best_rows(read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@part.query("select user_id, arg_max(event_id, (ts, event_id)) event_id, max(ts) ts from events group by 1")
def keep_last(spark, sf):
    return R.last_rows(read(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id")


@part.query("select user_id, arg_min(event_id, (ts, event_id)) event_id, min(ts) ts from events group by 1")
def keep_first(spark, sf):
    return R.first_rows(read(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id")


@part.query("select o_orderpriority, o_orderstatus, count(*) n, round(count(*)/sum(count(*)) over (partition by o_orderpriority),9) fraction from orders group by 1,2")
def fraction_of_total(spark, sf):
    counts = read(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return R.fraction_of_total(counts, ["o_orderpriority"]).withColumn("fraction", r6("fraction", 9))


@part.query("select c_custkey, k::int rotation, case (((c_custkey % 5) - k) % 5 + 5) % 5 when 0 then 'TEST' when 1 then 'VAL' else 'TRAIN' end part from customer, range(5) r(k)")
def fold_rotation(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 5).cast("int").alias("fold"))
    return R.rotation(c).select("c_custkey", "rotation", "part")


@part.query("select c_custkey, ((row_number() over (order by c_acctbal, c_custkey) - 1) % 5)::int fold from customer")
def round_robin_folds(spark, sf):
    return R.round_robin(read(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 5).select("c_custkey", "fold")


@part.query("""with t as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) step from orders),
c as (select *, arg_min(o_totalprice % 1000, (o_totalprice, step)) over (partition by o_custkey order by step) chosen from t)
select o_custkey, o_orderkey, step, round(chosen,6) chosen, round(min(chosen) over (partition by o_custkey order by step),6) best_so_far from c""")
def policy_prefix_choice(spark, sf):
    from pyspark.sql import Window

    o = read(spark, sf, "orders")
    t = o.select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("step"), (F.col("o_totalprice") % 1000).alias("held_out"))
    r = R.prefix_choice(t, ["o_custkey"], "step", "o_totalprice", "held_out")
    return r.select("o_custkey", "o_orderkey", "step", r6("chosen").alias("chosen"), r6("best_so_far").alias("best_so_far"))


@part.query("select event_id, lag(value) over w previous, lead(value) over w following, round(value - lag(value) over w, 6) change, round(avg(value) over (w rows between 2 preceding and current row), 6) rolling_mean, round(sum(value) over (w rows unbounded preceding), 4) running_sum from events window w as (partition by user_id order by ts, event_id)")
def lag_and_rolling(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    r = R.rolling(R.lagged(e, ["user_id"], ["ts", "event_id"], "value"), ["user_id"], ["ts", "event_id"], "value", 3)
    return r.select("event_id", "previous", "following", r6("change").alias("change"), r6("rolling_mean").alias("rolling_mean"), r6("running_sum", 4).alias("running_sum"))


@part.query("select row_number() over (order by c_mktsegment, c_acctbal desc, c_custkey) place, c_custkey from customer order by c_mktsegment, c_acctbal desc, c_custkey limit 100")
def multi_key_sort(spark, sf):
    from pyspark.sql import Window

    order = [F.asc("c_mktsegment"), F.desc("c_acctbal"), F.asc("c_custkey")]
    top = R.top_n(read(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), order, 100)
    return top.select(F.row_number().over(Window.partitionBy().orderBy(*order)).alias("place"), "c_custkey")


@part.query("select c_custkey, c_acctbal from customer order by abs(c_acctbal - 4500) desc, c_custkey limit 25")
def sort_by_absolute(spark, sf):
    return R.top_n(read(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.desc(F.abs(F.col("c_acctbal") - 4500)), F.asc("c_custkey")], 25)


@part.query("select target, arg_min(experiment_code, (cv_mean_mae, experiment_code, registered_at)) experiment_code, min(cv_mean_mae) cv_mean_mae from experiments where cv_mean_mae is not null and not isnan(cv_mean_mae) and target is not null group by 1")
def argmin_row(spark, sf):
    e = read(spark, sf, "experiments").where("cv_mean_mae is not null and not isnan(cv_mean_mae) and target is not null")
    return R.best_rows(e, ["target"], [F.asc("cv_mean_mae"), F.asc("experiment_code"), F.asc("registered_at")]).select("target", "experiment_code", "cv_mean_mae")


@part.query("select * from (select 'largest' side, o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20) union all select * from (select 'smallest', o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 20)")
def top_and_bottom(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    big = R.top_n(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], 20).select(F.lit("largest").alias("side"), "*")
    return U.union_all(big, R.top_n(o, [F.asc("o_totalprice"), F.asc("o_orderkey")], 20).select(F.lit("smallest").alias("side"), "*"))


@part.query("select event_id, value from events order by event_id limit 50")
def head_preview(spark, sf):
    return R.top_n(read(spark, sf, "events").select("event_id", "value"), [F.asc("event_id")], 50)


_E = "(select experiment_code, feature_set_id, min(cv_primary_mae) s from experiments where cv_primary_mae is not null and not isnan(cv_primary_mae) and feature_set_id is not null group by 1,2)"


@part.query(f"with r as (select *, (row_number() over (partition by feature_set_id order by s, experiment_code) > 1)::int again from {_E}) select row_number() over (order by again, s, experiment_code) place, experiment_code, feature_set_id, s from r order by again, s, experiment_code limit 3")
def diverse_top3(spark, sf):
    e = read(spark, sf, "experiments").where("cv_primary_mae is not null and not isnan(cv_primary_mae) and feature_set_id is not null").groupBy("experiment_code", "feature_set_id").agg(F.min("cv_primary_mae").alias("s"))
    return R.diverse_top(e, "feature_set_id", [F.asc("s"), F.asc("experiment_code")], 3).select("place", "experiment_code", "feature_set_id", "s")


@part.query("with g as (select p_brand, p_size alpha, round(avg(abs(p_retailprice-1400))/50,0) s from part group by 1,2) select p_brand, arg_min(alpha, (s, -alpha)) larger, arg_min(alpha, (s, alpha)) smaller, min(s) s from g group by 1")
def alpha_select(spark, sf):
    g = read(spark, sf, "part").groupBy("p_brand", F.col("p_size").alias("alpha")).agg(r6(F.avg(F.abs(F.col("p_retailprice") - 1400)) / 50, 0).alias("s"))
    up = R.argmin_grid(g, ["p_brand"], "s", "alpha").select("p_brand", F.col("alpha").alias("larger"), "s")
    return up.join(R.argmin_grid(g, ["p_brand"], "s", "alpha", larger=False).select("p_brand", F.col("alpha").alias("smaller")), "p_brand")


@part.query("select o_orderstatus, arg_min(o_orderkey, ((o_totalprice < 1000)::int, o_orderpriority, -o_totalprice, o_orderkey)) o_orderkey from orders group by 1")
def lexicographic_best(spark, sf):
    order = [F.asc(F.col("o_totalprice") < 1000), F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")]
    return R.best_rows(read(spark, sf, "orders"), ["o_orderstatus"], order).select("o_orderstatus", "o_orderkey")


# --- sets


@part.query("select 'customer' kind, c_custkey k, c_acctbal balance, c_mktsegment segment from customer union all select 'supplier', s_suppkey, s_acctbal, null from supplier")
def union_all_frames(spark, sf):
    c = read(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return U.union_all(c, read(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance")))


@part.query("select k, arg_min(name, (f, name)) as name from (select s_suppkey k, s_name as name, 0 f from supplier union all select c_custkey, c_name, 1 from customer) group by 1")
def union_distinct_on_id(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return U.union_first(["k"], s, read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")))


def _ids(spark, sf):
    return read(spark, sf, "dev").select("id").where("id is not null"), read(spark, sf, "predictions").select("id").where("id is not null")


@part.query("select id from dev where id is not null intersect select id from predictions where id is not null")
def intersect_ids(spark, sf):
    return U.intersect(*_ids(spark, sf))


@part.query("select id from dev where id is not null except select id from predictions where id is not null")
def except_ids(spark, sf):
    return U.difference(*_ids(spark, sf))


@part.query("select id, 'left' side from (select id from dev where id is not null except select id from predictions where id is not null) union all select id, 'right' from (select id from predictions where id is not null except select id from dev where id is not null)")
def symmetric_diff(spark, sf):
    return U.symmetric_difference(*_ids(spark, sf))


@part.query("""with a as (select distinct id from dev where id is not null), b as (select distinct id from predictions where id is not null), c as (select count(*) n from a semi join b using (id)), n as (select (select count(*) from a) n_left, (select count(*) from b) n_right, (select n from c) n_common)
select n_left, n_right, n_common, n_left+n_right-2*n_common hamming, round(n_common/(n_left+n_right-n_common),9) jaccard, (n_left=n_common and n_right=n_common) "equal", n_common=0 "disjoint" from n""")
def set_relation(spark, sf):
    return U.relation(*_ids(spark, sf)).withColumn("jaccard", r6("jaccard", 9))


@part.query("select id, count(distinct fold) n_parts, list_sort(list(distinct fold)) parts from folds where id is not null and fold is not null group by 1 having count(distinct fold) > 1")
def split_leaks(spark, sf):
    return U.straddling(read(spark, sf, "folds").where("fold is not null"), ["id"], "fold")


@part.query("""with a as (select c_nationkey k, list_distinct(list(c_mktsegment)) s from customer where c_acctbal > 5000 group by 1), b as (select c_nationkey k, list_distinct(list(c_mktsegment)) s from customer where c_acctbal <= 5000 group by 1)
select k, round(len(list_intersect(a.s,b.s))/len(list_distinct(list_concat(a.s,b.s))),6) jaccard from a join b using (k)""")
def jaccard_topk(spark, sf):
    c = read(spark, sf, "customer")
    side = lambda cond, n: c.where(cond).groupBy(F.col("c_nationkey").alias("k")).agg(F.collect_set("c_mktsegment").alias(n))
    return side("c_acctbal > 5000", "a").join(side("c_acctbal <= 5000", "b"), "k").select("k", r6(U.jaccard("a", "b")).alias("jaccard"))


# --- reshaping

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUS = ["F", "O", "P"]


@part.query("select c_nationkey, " + ", ".join(f"round(avg(o_totalprice) filter (o_orderstatus='{s}'),4) mean_{s}" for s in STATUS) + " from orders join customer on o_custkey=c_custkey group by 1")
def pivot_mean(spark, sf):
    d = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return S.pivot(d, ["c_nationkey"], "o_orderstatus", STATUS, r6(F.avg("o_totalprice"), 4), "mean_")


@part.query("select o_custkey, " + ", ".join(f"count(*) filter (o_orderstatus='{s}') n_{s}" for s in STATUS) + " from orders group by 1")
def crosstab_counts(spark, sf):
    return S.crosstab(read(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", STATUS, "n_")


@part.query("select user_id, " + ", ".join(f"count(*) filter (event_type='{e}') \"{e}\"" for e in ("click", "error", "purchase", "signup", "view")) + ", count(*) n, round(count(*) filter (event_type='error')/count(*),9) rate from events group by 1")
def unstack_rate(spark, sf):
    return S.rate(read(spark, sf, "events"), ["user_id"], "event_type", ["click", "error", "purchase", "signup", "view"], "error").withColumn("rate", r6("rate", 9))


@part.query("select c_custkey, feature, value from (unpivot (select c_custkey, c_acctbal, c_nationkey::double c_nationkey from customer) on c_acctbal, c_nationkey into name feature value value)")
def melt_long(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    return S.melt(c, ["c_custkey"], ["c_acctbal", "c_nationkey"])


_SOURCES = ["north_bcell", "mesa_display", "fen_memory"]


@part.query("select distinct id, " + ", ".join(f"coalesce(source='{s}',false)::int source_{s}" for s in _SOURCES) + ", (source is null)::int source_nan from dev")
def onehot_frozen(spark, sf):
    d = S.one_hot(read(spark, sf, "dev"), "source", _SOURCES)
    return d.select("id", *[f"source_{s}" for s in _SOURCES], "source_nan").distinct()


@part.query("select p_partkey, list_filter(list_transform(range(1,length(p_name)+1), lambda i: case when p_name[i] between 'a' and 'z' then (i-1)*26 + ascii(p_name[i]) - 97 end), lambda x: x is not null) as places from part")
def positional_onehot(spark, sf):
    return read(spark, sf, "part").select("p_partkey", S.positional_one_hot("p_name", "abcdefghijklmnopqrstuvwxyz").alias("places"))


_BAND = "case when {0} < 50000 then 'LOW' when {0} <= 150000 then 'MEDIUM' else 'HIGH' end"


@part.query(f"""with d as (select {_BAND.format('o_totalprice')} truth, {_BAND.format('(s)')} guess from orders join (select l_orderkey, sum(l_extendedprice) s from lineitem group by 1) on o_orderkey=l_orderkey), l as (select unnest(['LOW','MEDIUM','HIGH']) x), c as (select truth, guess, count(*) n from d group by 1,2)
select a.x truth, b.x guess, coalesce(n,0) n, case when sum(coalesce(n,0)) over (partition by a.x) > 0 then round(coalesce(n,0)/sum(coalesce(n,0)) over (partition by a.x),9) else 0 end fraction from l a cross join l b left join c on truth=a.x and guess=b.x""")
def band_confusion(spark, sf):
    from chainloom.operators.select import band

    s = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    d = read(spark, sf, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"))
    cuts = dict(low=50000, high=150000)
    return S.confusion(d.select(band("o_totalprice", **cuts).alias("truth"), band("s", **cuts).alias("guess")), "truth", "guess", ["LOW", "MEDIUM", "HIGH"]).withColumn("fraction", r6("fraction", 9))


@part.query("select vec_id, " + ", ".join(f"round(embedding[{i + 1}]::double,6) e_{i}" for i in range(8)) + " from embeddings")
def array_columns(spark, sf):
    e = S.array_columns(read(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 8, "e_")
    return e.select("vec_id", *[r6(F.col(f"e_{i}").cast("double")).alias(f"e_{i}") for i in range(8)])


@part.query("select vec_id, len(embedding)::int n, round(list_avg(list_transform(embedding, lambda x: x::double)),6) mean, round(list_max(embedding)::double,6) max from embeddings")
def array_explode_stats(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", F.explode("embedding").alias("x"))
    return e.groupBy("vec_id").agg(F.count("*").cast("int").alias("n"), r6(F.avg(F.col("x").cast("double"))).alias("mean"), r6(F.max("x").cast("double")).alias("max"))


@part.query("select o_custkey, " + ", ".join(f"coalesce(round({f}(o_totalprice) filter (o_orderstatus='{s}'),2),0) price_{s}_{t}_{f2}" for s in STATUS for t in ("ALL",) for f, f2 in (("sum", "sum"), ("max", "max"))) + " from orders group by 1")
def named_feature_row(spark, sf):
    from chainloom.operators.aggregate import masked_block

    names = S.feature_names("price", STATUS, ["ALL"], ["sum", "max"])
    wide = masked_block(read(spark, sf, "orders"), ["o_custkey"], F.col("o_totalprice"), {f"price_{s}_ALL": F.col("o_orderstatus") == s for s in STATUS}, ("sum", "max"), 0.0)
    return wide.select("o_custkey", *[r6(n, 2).alias(n) for n in names])


@part.query("select event_id, user_id, json_extract_string(props,'$.k')::int props_k, event_type info_kind, value info_size_value from events")
def struct_flatten(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", F.from_json("props", "k int").alias("props"), F.struct(F.col("event_type").alias("kind"), F.struct("value").alias("size")).alias("info"))
    return S.flatten(e)
