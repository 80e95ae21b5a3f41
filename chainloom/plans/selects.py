"""Queries of projections, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.operators import joins as J
from chainloom.operators import select as P
from chainloom.plans.part import Part, r6
from chainloom.session import read

part = Part()


@part.query("select id as antibody_id, heavy as vh, light as vl, TmApp as tm from dev")
def project_rename(spark, sf):
    return P.project(read(spark, sf, "dev"), {"id": "antibody_id", "heavy": "vh", "light": "vl", "TmApp": "tm"})


@part.query("select experiment_code, registered_at, cv_primary_mae, cv_shadow_mae, cv_mean_mae from experiments")
def select_by_prefix(spark, sf):
    return P.select_numeric(read(spark, sf, "experiments"), ["experiment_code", "registered_at"], ("cv_",), ("mae",))


@part.query("select experiment_code, registered_at, cv_primary_mae, cv_shadow_mae, cv_mean_mae, n_features from experiments")
def drop_forbidden_columns(spark, sf):
    return P.drop_forbidden(read(spark, sf, "experiments"), ["experiment_code", "registered_at"], ("public", "private", "target"))


@part.query("select experiment_code, kind, id, written_at, case when isfinite(prediction) then prediction end prediction from predictions")
def infinities_to_null(spark, sf):
    return P.without_infinities(read(spark, sf, "predictions").select("experiment_code", "kind", "id", "written_at", "prediction"))


@part.query("select o_orderkey from orders where o_orderstatus = 'O' and o_orderpriority in ('1-URGENT','2-HIGH') and not (o_totalprice < 1000)")
def boolean_filter(spark, sf):
    o = read(spark, sf, "orders")
    return o.where((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~(F.col("o_totalprice") < 1000)).select("o_orderkey")


@part.query("select experiment_code, experiment_id, registered_at from experiments where artifact_status = 'FULL' and n_features > 10")
def string_filter(spark, sf):
    return read(spark, sf, "experiments").filter("artifact_status = 'FULL' and n_features > 10").select("experiment_code", "experiment_id", "registered_at")


@part.query("select id, TmApp, HIC from dev where TmApp is not null and HIC is not null and not isnan(TmApp) and not isnan(HIC)")
def dropna_subset(spark, sf):
    return P.complete_rows(read(spark, sf, "dev"), ["TmApp", "HIC"]).select("id", "TmApp", "HIC")


@part.query("select case when HIC < 10.5 then 'LOW' when HIC <= 11.5 then 'MEDIUM' when HIC > 11.5 then 'HIGH' end band, count(*) n, round(count(*)/sum(count(*)) over (),9) fraction from dev where HIC is not null group by 1")
def band_counts(spark, sf):
    from chainloom.operators.aggregate import value_counts

    d = read(spark, sf, "dev").where("HIC is not null").select(P.band("HIC", 10.5, 11.5).alias("band"))
    return value_counts(d, "band", dropna=False).withColumn("fraction", r6("fraction", 9))


_FLAGS = "case p_size % 6 when 0 then ' TRUE ' when 1 then '1' when 2 then 'no' when 3 then '0' when 4 then null else 'True' end"


@part.query(f"select p_partkey, coalesce(lower(trim({_FLAGS})) in ('true','1'), false) flag from part")
def parse_flags(spark, sf):
    return read(spark, sf, "part").select("p_partkey", P.parse_flag(F.expr(_FLAGS)).alias("flag"))


@part.query("select p_partkey, try_cast(case when p_size % 3 = 0 then p_name else ' ' || p_retailprice || ' ' end as double) price from part")
def parse_numbers(spark, sf):
    return read(spark, sf, "part").select("p_partkey", P.parse_number(F.expr("case when p_size % 3 = 0 then p_name else concat(' ', p_retailprice, ' ') end")).alias("price"))


@part.query("""select experiment_code, registered_at, coalesce(pv, sv, mv) as value, case when pv is not null then 'private' when sv is not null then 'public' when mv is not null then 'cv' end origin
from (select *, case when isfinite(private_mae) then private_mae end pv, case when isfinite(public_mae) then public_mae end sv, case when isfinite(cv_mean_mae) then cv_mean_mae end mv from experiments)""")
def coalesce_by_priority(spark, sf):
    from chainloom.operators.aggregate import finite

    c = {"private": finite("private_mae"), "public": finite("public_mae"), "cv": finite("cv_mean_mae")}
    return read(spark, sf, "experiments").select("experiment_code", "registered_at", *P.first_known(c))


@part.query("select l_orderkey, l_linenumber, l_partkey, case when l_returnflag = 'A' then l_extendedprice end price from lineitem")
def mask_holdout_labels(spark, sf):
    d = read(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice"))
    return P.mask_labels(d, ["price"], F.col("l_returnflag") == "A").select("l_orderkey", "l_linenumber", "l_partkey", "price")


@part.query("select l_suppkey, case when sum(l_tax) > 0 then round(sum(case when l_returnflag='R' then l_tax else 0 end)/sum(l_tax),9) else 0 end ratio from lineitem group by 1")
def safe_ratio(spark, sf):
    g = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_tax")).otherwise(0.0)).alias("x"), F.sum("l_tax").alias("t"))
    return g.select("l_suppkey", r6(P.safe_ratio("x", "t"), 9).alias("ratio"))


@part.query("with k as (select source from documents where lang = 'en' and source is not null group by 1 having count(*) >= 30) select doc_id, case when source in (select source from k) then source else '__OTHER__' end source from documents")
def fold_rare_categories(spark, sf):
    return P.fold_rare(read(spark, sf, "documents").select("doc_id", "source", "lang"), "source", F.col("lang") == "en", 30).select("doc_id", "source")


# --- joins


@part.query("select p.experiment_code, p.id, p.written_at, d.n from predictions p join (select id::varchar id, count(*) n from dev group by 1) d using (id)")
def inner_join_on_id(spark, sf):
    d = J.text_id(read(spark, sf, "dev")).groupBy("id").agg(F.count("*").alias("n"))
    return J.text_id(read(spark, sf, "predictions").select("experiment_code", "id", "written_at")).join(d, "id")


@part.query("select o_orderkey, o_totalprice, n_lines, total from orders join (select l_orderkey, count(*) n_lines, round(sum(l_extendedprice),2) total from lineitem group by 1) on o_orderkey = l_orderkey")
def one_to_one_join(spark, sf):
    lines = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), r6(F.sum("l_extendedprice"), 2).alias("total"))
    return J.join_one_to_one(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), lines, ["o_orderkey"])


@part.query("select coalesce(a.k, b.k) k, case when a.k is null then 'right_only' when b.k is null then 'left_only' else 'both' end \"_merge\" from (select c_custkey k from customer where c_acctbal > 0) a full join (select distinct o_custkey k from orders where o_orderstatus='P') b on a.k=b.k")
def join_indicator(spark, sf):
    a = read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    b = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).distinct()
    return J.join_indicator(a, b, ["k"])


@part.query("select s_suppkey, s_name, n_name, n_regionkey from supplier left join nation on s_nationkey = n_nationkey and n_regionkey < 3")
def left_join_block(spark, sf):
    s = read(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey"))
    return J.left_block(s, read(spark, sf, "nation").where("n_regionkey < 3"), "n_nationkey").select("s_suppkey", "s_name", "n_name", "n_regionkey")


@part.query("select s.s_suppkey, s.s_name as name, n.n_name as nation_name from (select * from supplier) s left join nation n on s_nationkey = n_nationkey")
def left_join_named_keys(spark, sf):
    s = read(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name"), "s_nationkey")
    n = read(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    return J.left_block(s, n, "s_nationkey", "n_nationkey", "nation_").select("s_suppkey", "name", "nation_name")


@part.query("""with a as (select c_custkey k, c_mktsegment x from customer where c_custkey % 3 <> 0), b as (select c_custkey k, case when c_custkey % 7 = 0 then 'NONE' else c_mktsegment end y from customer where c_custkey % 5 <> 0)
select coalesce(a.k,b.k) k, x, y, x is not distinct from y segment_match from a full join b on a.k=b.k""")
def full_outer_match(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    a = c.where("k % 3 != 0").select("k", F.col("c_mktsegment").alias("x"))
    b = c.where("k % 5 != 0").select("k", F.when(F.col("k") % 7 == 0, "NONE").otherwise(F.col("c_mktsegment")).alias("y"))
    return J.full_match(a, b, ["k"], {"segment": ("x", "y")})


@part.query("select a.scheme, a.id, a.n, b.n nf from (select scheme, id, count(*) n from folds group by 1,2) a join (select scheme, id, count(fold) n from folds group by 1,2) b on a.scheme=b.scheme and a.id=b.id")
def multi_column_join(spark, sf):
    f = read(spark, sf, "folds")
    a = f.groupBy("scheme", "id").agg(F.count("*").alias("n"))
    return a.join(f.groupBy("scheme", "id").agg(F.count("fold").alias("nf")), ["scheme", "id"])


@part.query("select o_orderkey, o_custkey, coalesce(q, 0.0) q, q is not null found from orders left join (select l_orderkey, 'O' s, round(sum(l_quantity),2) q from lineitem where l_discount > 0.08 group by 1) on o_orderkey=l_orderkey and o_orderstatus=s")
def left_fill_flag(spark, sf):
    q = read(spark, sf, "lineitem").where("l_discount > 0.08").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(r6(F.sum("l_quantity"), 2).alias("q")).withColumn("o_orderstatus", F.lit("O"))
    return J.left_fill(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), q, ["o_orderkey", "o_orderstatus"], {"q": 0.0}).select("o_orderkey", "o_custkey", "q", "found")


@part.query("""with w as (select distinct id from dev where id is not null), h as (select id, count(*) n from stage2_embeddings_ids group by 1)
select (select count(*) from w) n_ids, (select sum(n) from h)::bigint n_rows, list_sort(list_filter([case when (select max(n) from h) > 1 then 'repeated ids' end, case when exists (select 1 from w anti join h using (id)) then 'missing ids' end], lambda x: x is not null)) problems""".replace("stage2_embeddings_ids", "(select ids id from stage2_embeddings)"))
def id_contract_report(spark, sf):
    block = read(spark, sf, "stage2_embeddings").select(F.col("ids").alias("id"), F.size("ablang2__HL_paired").alias("width"), F.get("ablang2__HL_paired", F.lit(0)).alias("first"))
    return J.alignment_report(block, read(spark, sf, "dev").select("id"))


@part.query("select s_suppkey id, row_number() over (order by s_suppkey) - 1 pos, s_acctbal, s_nationkey::double s_nationkey from supplier")
def strict_alignment(spark, sf):
    ids = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("pos"))
    block = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal", "s_nationkey")
    return J.align(block, ids)


@part.query("select c_custkey id, c_custkey pos, c_acctbal from customer where c_custkey % 4 = 0 and c_acctbal > 0")
def alignment_intersection(spark, sf):
    c = read(spark, sf, "customer")
    ids = c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("pos"))
    return J.align(c.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), "c_acctbal"), ids, strict=False)


@part.query("select o_custkey id, count(*) a__n, round(max(o_totalprice),2) a__top, count(*) filter (o_orderstatus='O') b__n, round(min(o_totalprice),2) b__low from orders group by 1")
def block_concat_prefix(spark, sf):
    g = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"))
    a = g.agg(F.count("*").alias("n"), r6(F.max("o_totalprice"), 2).alias("top"))
    return J.concat_blocks({"a": a, "b": g.agg(F.count_if(F.col("o_orderstatus") == "O").alias("n"), r6(F.min("o_totalprice"), 2).alias("low"))})


@part.query("select o_custkey id, count(*) n, round(min(o_totalprice),2) low from orders group by 1")
def block_concat_strict(spark, sf):
    g = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"))
    return J.concat_blocks({"a": g.agg(F.count("*").alias("n")), "b": g.agg(r6(F.min("o_totalprice"), 2).alias("low"))}, on_clash="fail")


@part.query("select o_custkey id, count(*) n, round(max(o_totalprice),2) top from orders group by 1")
def block_concat_first(spark, sf):
    g = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"))
    return J.concat_blocks({"a": g.agg(F.count("*").alias("n")), "b": g.agg((-F.count("*")).alias("n"), r6(F.max("o_totalprice"), 2).alias("top"))}, on_clash="first")


@part.query("select a.c_nationkey, round(a.m - b.m, 4) delta_m, a.n - b.n delta_n from (select c_nationkey, avg(c_acctbal) m, count(*) n from customer where c_mktsegment='BUILDING' group by 1) a join (select c_nationkey, avg(c_acctbal) m, count(*) n from customer where c_mktsegment='MACHINERY' group by 1) b using (c_nationkey)")
def block_concat_delta(spark, sf):
    one = lambda s: read(spark, sf, "customer").where(F.col("c_mktsegment") == s).groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"), F.count("*").alias("n"))
    return J.deltas(one("BUILDING"), one("MACHINERY"), ["c_nationkey"], ["m", "n"]).withColumn("delta_m", r6("delta_m", 4))


@part.query("""with t as (select distinct doc_id, unnest(string_split_regex(experiment_code, '[-;,\\s]+')) token from documents where experiment_code is not null) select token, case when regexp_full_match(token,'[A-Z][0-9]+') then 'code' when regexp_full_match(token,'[A-Z]+') then 'word' else 'other' end kind, list_sort(list(doc_id)) owners, count(*) n from t where token <> '' group by 1,2""")
def inverted_key_index(spark, sf):
    return J.token_index(read(spark, sf, "documents"), "doc_id", "experiment_code", r"[-;,\s]+", {"code": "[A-Z][0-9]+", "word": "[A-Z]+"})


@part.query("""with q as (select s_suppkey k, s_name by_name, s_nationkey::varchar by_nation from supplier),
i1 as (select c_name token, min(c_custkey) t, count(distinct c_custkey) n, count(distinct c_mktsegment) v from (select replace(c_name,'Customer','Supplier') c_name, c_custkey, c_mktsegment from customer where c_custkey % 3 = 0) group by 1),
i2 as (select c_nationkey::varchar token, min(c_custkey) t, count(distinct c_custkey) n, count(distinct c_mktsegment) v from customer where c_nationkey < 12 and c_acctbal > 9000 group by 1),
b as (select k, case when i1.token is not null then {'t':i1.t,'n':i1.n,'v':i1.v,'via':'name'} when i2.token is not null then {'t':i2.t,'n':i2.n,'v':i2.v,'via':'nation'} end b from q left join i1 on by_name=i1.token left join i2 on by_nation=i2.token)
select k, case when b.n=1 or b.v=1 then b.t end target, b.via via, case when b is null then 'unresolved' when b.n=1 then 'unique' when b.v=1 then 'same_value' else 'ambiguous' end status from b""")
def priority_cascade_resolve(spark, sf):
    c = read(spark, sf, "customer")
    q = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("by_name"), F.col("s_nationkey").cast("string").alias("by_nation"))
    i1 = c.where("c_custkey % 3 = 0").select(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("token"), F.col("c_custkey").alias("target"), F.col("c_mktsegment").alias("value"))
    i2 = c.where("c_nationkey < 12 and c_acctbal > 9000").select(F.col("c_nationkey").cast("string").alias("token"), F.col("c_custkey").alias("target"), F.col("c_mktsegment").alias("value"))
    return J.resolve(q, "k", [("name", "by_name", i1), ("nation", "by_nation", i2)], "value")


@part.query("select count(*) n, count(distinct experiment_code) n_codes from predictions where id in (select id from dev)")
def semi_join_members(spark, sf):
    d = read(spark, sf, "dev").select("id").distinct()
    return read(spark, sf, "predictions").join(d, "id", "left_semi").agg(F.count("*").alias("n"), F.countDistinct("experiment_code").alias("n_codes"))


@part.query("select c_custkey from customer anti join orders on c_custkey = o_custkey")
def anti_join_missing(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@part.query("select a.o_custkey, a.o_orderstatus a, b.o_orderstatus b, round(a.m - b.m, 4) gap from (select o_custkey, o_orderstatus, avg(o_totalprice) m from orders group by 1,2) a join (select o_custkey, o_orderstatus, avg(o_totalprice) m from orders group by 1,2) b on a.o_custkey=b.o_custkey and a.o_orderstatus<b.o_orderstatus")
def group_pair_gaps(spark, sf):
    g = read(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("m"))
    return J.group_pairs(g, ["o_custkey"], "o_orderstatus", "m").select("o_custkey", "a", "b", r6(F.col("value_a") - F.col("value_b"), 4).alias("gap"))


@part.query("""with s as (select p_partkey, case when length(p_name) > 8 then p_name[1:4] || right(p_name, 4) else p_name end t from part)
select p_partkey, slot::int slot, t[slot - 105 + length(t) - 8 + 1] letter from (select p_partkey, t, unnest(range(113 - length(t), 113)) slot from s)""")
def slot_map_right(spark, sf):
    s = read(spark, sf, "part").select("p_partkey", F.explode(J.slots("p_name", 105, 112, align_right=True)).alias("s"))
    return s.select("p_partkey", "s.slot", "s.letter")
