"""Queries of spatial, graph, pooling and similarity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.functions import numbers as N
from chainloom.operators import aggregate as A
from chainloom.operators import spatial as G
from chainloom.operators import stats as X
from chainloom.operators.components import connected_components
from chainloom.plans.part import Part, r6
from chainloom.session import read

part = Part()

_P = "(select vec_id, label, round(embedding[1]::double,4) x, round(embedding[2]::double,4) y, round(embedding[3]::double,4) z, round(embedding[4]::double,4) w, abs(round(embedding[5]::double,4)) s from embeddings)"
_D = "sqrt((p.x-q.x)**2+(p.y-q.y)**2+(p.z-q.z)**2)"
_NEAR = f"{_P} p join {_P} q on p.label=q.label"
R = 0.15


def _points(spark, sf):
    at = lambda i, n: F.round(F.get("embedding", F.lit(i)).cast("double"), 4).alias(n)
    e = read(spark, sf, "embeddings").select("vec_id", "label", at(0, "x"), at(1, "y"), at(2, "z"), at(3, "w"), at(4, "s"))
    return e.withColumn("s", F.abs("s"))


@part.query(f"select p.label, p.vec_id key_a, q.vec_id key_b, round({_D},6) d from {_NEAR} where p.vec_id < q.vec_id and p.label < 3")
def pairwise_distances(spark, sf):
    return G.all_distances(_points(spark, sf).where("label < 3"), ["label"], "vec_id").withColumn("d", r6("d"))


@part.query(f"select p.label, p.vec_id // 5 key_a, q.vec_id // 5 key_b, round(min({_D}),6) d from {_NEAR} where p.vec_id // 5 < q.vec_id // 5 group by 1,2,3")
def closest_atom_distance(spark, sf):
    atoms = _points(spark, sf).withColumn("res", F.floor(F.col("vec_id") / 5))
    return G.closest_atoms(atoms, ["label"], "res").withColumn("d", r6("d"))


@part.query(f"select p.label, p.vec_id, round(sum(q.w),6)+0.0 total, count(*) n from {_NEAR} where {_D} <= {R} group by 1,2")
def range_join_neighbour_sum(spark, sf):
    return G.neighbour_sums(_points(spark, sf), ["label"], "vec_id", F.col("w"), R).withColumn("total", r6("total"))


@part.query(f"select p.label, p.vec_id, coalesce(round(sum(q.w*exp(-{_D})) filter ({_D} <= {R} and q.vec_id % 2 = 0),6),0)+0.0 field from {_NEAR} group by 1,2")
def exp_field(spark, sf):
    p = _points(spark, sf)
    return G.exponential_field(p, p.where("vec_id % 2 = 0"), ["label"], "vec_id", "w", R).withColumn("field", r6("field"))


@part.query(f"select p.label, count(*) n_pairs, round(sum(p.w*q.w/({_D}*{_D})),6)+0.0 total from {_NEAR} where p.vec_id<q.vec_id and p.s>=0.05 and q.s>=0.05 and {_D} > 0 and {_D} < {R} group by 1")
def psh_pair_sum(spark, sf):
    return G.pair_sum(_points(spark, sf), ["label"], "vec_id", "w", F.col("s") >= 0.05, R).withColumn("total", r6("total"))


@part.query(f"""with t as (select p.label, p.vec_id, sum(q.w*q.s) t from {_NEAR} where {_D} <= {R} group by 1,2) select label, count(*) n, round(max(t),6) max, round(avg(t),6) mean, round(avg(greatest(t,0)),6) positive_mean, round(list_avg(list_sort(list(t),'DESC')[1:3]),6) top_mean from t group by 1""")
def static_sap_family(spark, sf):
    s = G.neighbour_sums(_points(spark, sf), ["label"], "vec_id", F.col("w") * F.col("s"), R)
    r = A.top_stats(s, ["label"], "total", 3)
    return r.select("label", "n", r6("max").alias("max"), r6("mean").alias("mean"), r6("positive_mean").alias("positive_mean"), r6("top_mean").alias("top_mean"))


@part.query(f"select label, round(sum(greatest(w,0)*s),6) positive_sum, round(max(greatest(w,0)*s),6) positive_max, round(avg(w*s),6)+0.0 direct_mean, round(sum(w*s),6)+0.0 direct_sum from {_P} group by 1")
def surface_hydropathy(spark, sf):
    pos = F.greatest(F.col("w"), F.lit(0.0)) * F.col("s")
    return _points(spark, sf).groupBy("label").agg(r6(F.sum(pos)).alias("positive_sum"), r6(F.max(pos)).alias("positive_max"), r6(F.avg(F.col("w") * F.col("s"))).alias("direct_mean"), r6(F.sum(F.col("w") * F.col("s"))).alias("direct_sum"))


_SCOPES = {"ALL": "true", "EVEN": "vec_id % 2 = 0", "EXPOSED": "s >= 0.1"}


@part.query(f"""with t as (select p.label, p.vec_id, any_value(p.s) s, sum(q.w) filter ({_D}<=0.1) "w_R0.1", sum(q.w) filter ({_D}<=0.2) "w_R0.2", sum(q.s) filter ({_D}<=0.1) "s_R0.1", sum(q.s) filter ({_D}<=0.2) "s_R0.2" from {_NEAR} where {_D} <= 0.2 group by 1,2),
u as (select label, vec_id, s, spec, v from (unpivot t on "w_R0.1","w_R0.2","s_R0.1","s_R0.2" into name spec value v)), m as (""" + " union all ".join(f"select label, '{n}' as scope, spec, v from u where {c}" for n, c in _SCOPES.items()) + """),
g as (select label, spec, scope, round(avg(v),9)+0.0 mean, round(max(v),9)+0.0 max from m group by 1,2,3) select label, spec, scope, stat, value from (unpivot g on mean, max into name stat value value)""")
def feature_atlas(spark, sf):
    r = G.atlas(_points(spark, sf), ["label"], "vec_id", {"w": F.col("w"), "s": F.col("s")}, [0.1, 0.2], {n: F.expr(c) for n, c in _SCOPES.items()}, {"mean": A.STATS["mean"], "max": A.STATS["max"]})
    return r.withColumn("value", r6("value", 9))


@part.query(" union all ".join(f"select '{n}' as scope, count(*) n, round(avg(w),6)+0.0 mean from {_P} where {c}" for n, c in _SCOPES.items()))
def scope_masks(spark, sf):
    return G.scopes(_points(spark, sf), {n: F.expr(c) for n, c in _SCOPES.items()}).groupBy("scope").agg(F.count("*").alias("n"), r6(F.avg("w")).alias("mean"))


# --- graphs

_EDGES = f"(select p.label, p.vec_id a, q.vec_id b from {_NEAR} where p.vec_id < q.vec_id and {_D} <= 0.1)"


@part.query(f"""with recursive e as (select a, b from {_EDGES} union select b, a from {_EDGES}), r as (select a node, a reach from e union select r.node, e.b from r join e on e.a = r.reach) select node, min(reach) component from r group by 1""")
def connected_components_points(spark, sf):
    return connected_components(G.edges_within(_points(spark, sf), ["label"], "vec_id", 0.1))


@part.query(f"""with recursive e as (select a, b from {_EDGES} union select b, a from {_EDGES}), r as (select vec_id node, vec_id reach from {_P} union select r.node, e.b from r join e on e.a = r.reach), c as (select node, min(reach) patch from r group by 1), s as (select p.label, c.patch, count(*) n, sum(s) area from c join {_P} p on p.vec_id=c.node group by 1,2)
select label, count(*) n_patches, max(n) largest_n, round(max(area),6) largest_area, round(sum(area),6) total_area from s group by 1""")
def surface_patches(spark, sf):
    found = G.patches(_points(spark, sf), ["label"], "vec_id", F.lit(True), 0.1, F.col("s"))
    return G.patch_summary(found, ["label"]).withColumns({"largest_area": r6("largest_area"), "total_area": r6("total_area")})


@part.query(f"""with recursive m as (select * from {_P} where s >= 0.05), e0 as (select p.vec_id a, q.vec_id b from m p join m q on p.label=q.label where p.vec_id<>q.vec_id and {_D} <= 0.15), r as (select vec_id node, vec_id reach from m union select r.node, e0.b from r join e0 on e0.a = r.reach), c as (select node, min(reach) patch from r group by 1)
select label, patch, count(*) n, round(sum(s),6) area from c join m on vec_id=node group by 1,2""")
def masked_point_components(spark, sf):
    return G.patches(_points(spark, sf), ["label"], "vec_id", F.col("s") >= 0.05, 0.15, F.col("s")).withColumn("area", r6("area"))


@part.query(f"""with e as (select * from {_EDGES}), b as (select label, a, b from e union all select label, b, a from e), d as (select label, a v, count(*) deg from b group by 1,2), t as (select x.label, x.a v, count(*)/2 tri from b x join b y on x.a=y.a and x.b<>y.b join b z on z.a=x.b and z.b=y.b group by 1,2),
n as (select p.label, p.vec_id, coalesce(deg,0) deg, coalesce(tri,0) tri from {_P} p left join d on d.v=p.vec_id left join t on t.v=p.vec_id)
select label, count(*) n, (sum(deg)/2)::bigint edges, round(sum(deg)/(count(*)*(count(*)-1)),9) density, round(avg(deg),6) mean_degree, max(deg) max_degree, round(avg(case when deg>1 then 2.0*tri/(deg*(deg-1)) else 0 end),6) clustering from n group by 1""")
def graph_stats(spark, sf):
    p = _points(spark, sf)
    g = G.graph_stats(p, G.edges_within(p, ["label"], "vec_id", 0.1), ["label"], "vec_id")
    return g.withColumns({"density": r6("density", 9), "mean_degree": r6("mean_degree"), "clustering": r6("clustering")})


@part.query(f"select label, vec_id, count(*)-1 as degree from (select p.label, p.vec_id from {_NEAR} where {_D} <= 0.2) group by 1,2")
def contact_degree(spark, sf):
    return G.neighbour_sums(_points(spark, sf), ["label"], "vec_id", F.lit(1.0), 0.2).select("label", "vec_id", (F.col("n") - 1).alias("degree"))


@part.query(f"select p.label, count(*) n_contacts, count(distinct p.vec_id) n_a, count(distinct q.vec_id) n_b, count(*) filter ({_D} < 0.05) n_clashes from {_NEAR} where p.vec_id % 2 = 0 and q.vec_id % 2 = 1 and {_D} <= 0.15 group by 1")
def cross_group_contacts(spark, sf):
    p = _points(spark, sf).withColumn("side", F.when(F.col("vec_id") % 2 == 0, "H").otherwise("L"))
    return G.interface(p, ["label"], "vec_id", "side", "H", "L", 0.15, 0.05)


@part.query(f"""with t as (select *, case vec_id % 3 when 0 then 'pos' when 1 then 'neg' else 'aro' end k from {_P}) select p.label, count(*) filter ((p.k||q.k) in ('posneg','negpos') and {_D}<=0.15) salt_bridges, count(*) filter ((p.k||q.k)='aroaro' and {_D}<=0.2) stacking, count(*) filter ((p.k||q.k) in ('posaro','aropos') and {_D}<=0.1) cation_pi from t p join t q on p.label=q.label and p.vec_id<q.vec_id where {_D} <= 0.2 group by 1""")
def typed_interactions(spark, sf):
    p = _points(spark, sf).withColumn("kind", F.when(F.col("vec_id") % 3 == 0, "pos").when(F.col("vec_id") % 3 == 1, "neg").otherwise("aro"))
    return G.typed_contacts(p, ["label"], "vec_id", "kind", [("salt_bridges", "pos", "neg", 0.15), ("stacking", "aro", "aro", 0.2), ("cation_pi", "pos", "aro", 0.1)])


@part.query(f"""with q as (select label, quantile_cont(s,0.15) c from {_P} group by 1), b as (select p.* from {_P} p join q using (label) where s <= c), m as (select distinct p.vec_id from b p join {_P} q on p.label=q.label and p.vec_id<>q.vec_id and q.vec_id%4=0 where {_D} <= 0.15)
select label, count(*) n_buried, count(*) filter (vec_id%3=0 and vec_id not in (select vec_id from m)) n_unsatisfied from b group by 1""")
def buried_unsatisfied(spark, sf):
    return G.buried_unsatisfied(_points(spark, sf), ["label"], "vec_id", "s", F.col("vec_id") % 3 == 0, F.col("vec_id") % 4 == 0, 0.15)


@part.query(f"select label, round(max(t),6) density from (select p.label, p.vec_id, sum(q.s) t from {_NEAR} where {_D}<=0.15 group by 1,2) group by 1")
def max_local_density(spark, sf):
    return G.max_density(_points(spark, sf), ["label"], "vec_id", F.col("s"), 0.15).withColumn("density", r6("density"))


@part.query(f"""with k as (select label, vec_id % 4 kind, count(*) n, count(*) filter (s>=0.05) exposed, round(sum(s) filter (s>=0.05),6) area from {_P} group by 1,2), t as (select label, sum(s) total from {_P} group by 1), d as (select label, max(t) m from (select p.label, p.vec_id, sum(q.s) t from {_NEAR} where {_D}<=0.15 group by 1,2) group by 1)
select label, kind, n, exposed, coalesce(area,0) area, round(coalesce(area,0)/total,6) area_fraction, round(m,6) max_density from k join t using (label) join d using (label)""")
def aromatic_topology(spark, sf):
    p = _points(spark, sf)
    k = p.groupBy("label", (F.col("vec_id") % 4).alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("s") >= 0.05).alias("exposed"), F.coalesce(F.sum(F.when(F.col("s") >= 0.05, F.col("s"))), F.lit(0.0)).alias("area"))
    t = p.groupBy("label").agg(F.sum("s").alias("total"))
    d = G.max_density(p, ["label"], "vec_id", F.col("s"), 0.15)
    return k.join(t, "label").join(d, "label").select("label", "kind", "n", "exposed", r6("area").alias("area"), r6(F.try_divide("area", "total")).alias("area_fraction"), r6("density").alias("max_density"))


@part.query(f"select count(*) n_pairs, round(quantile_cont({_D},0.5),6) median from {_NEAR} where p.vec_id<q.vec_id and p.label%2=0")
def median_pair_distance(spark, sf):
    return G.median_pair_distance(_points(spark, sf), ["label"], "vec_id", F.col("label") % 2 == 0).withColumn("median", r6("median"))


@part.query(f"""with a as (select *, vec_id//4 r, case vec_id%4 when 0 then 'CA' when 1 then 'CB' when 2 then 'N' else 'CG' end atom from {_P} where vec_id%8 <> 5), s as (select label, r, count(*) filter (atom in ('CB','CG')) n_atoms, avg(x) filter (atom in ('CB','CG')) sx, any_value(x) filter (atom='CA') cx, avg(y) filter (atom in ('CB','CG')) sy, any_value(y) filter (atom='CA') cy, avg(z) filter (atom in ('CB','CG')) sz, any_value(z) filter (atom='CA') cz from a group by 1,2)
select label, r residue, round(coalesce(sx,cx),6)+0.0 x, round(coalesce(sy,cy),6)+0.0 y, round(coalesce(sz,cz),6)+0.0 z, case when n_atoms>0 then 'SIDE_CHAIN' when cx is not null then 'CA' else 'INVALID' end origin, n_atoms from s""")
def side_chain_centroids(spark, sf):
    k = F.col("vec_id") % 4
    a = _points(spark, sf).where("vec_id % 8 != 5").withColumns({"residue": F.floor(F.col("vec_id") / 4), "atom": F.when(k == 0, "CA").when(k == 1, "CB").when(k == 2, "N").otherwise("CG")})
    c = G.side_chain_centres(a, ["label"], "residue", "atom", F.lit(True))
    return c.select("label", "residue", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"), "origin", "n_atoms")


@part.query(f"select p.label, p.vec_id key_a, q.vec_id key_b, [round(exp(-(({_D}-0.1)**2)/(2*0.05*0.05)),6), round(exp(-(({_D}-0.2)**2)/(2*0.05*0.05)),6)] kernels from {_NEAR} where p.vec_id < q.vec_id and {_D} <= 0.2")
def rbf_kernels(spark, sf):
    p = _points(spark, sf)
    d = G.range_pairs(p, p, ["label"], "vec_id", 0.2).where("key_a < key_b")
    return d.select("label", "key_a", "key_b", F.transform(G.rbf("d", [0.1, 0.2], 0.05), lambda v: F.round(v, 6)).alias("kernels"))


# --- surfaces


@part.query()
def surface_point_sampling(spark, sf):
    atoms = _points(spark, sf).withColumns({"sasa": F.col("s") * 100, "radius": F.lit(0.05)})
    pts = G.surface_points(atoms, ["label"], "vec_id", "sasa", "radius")
    return pts.groupBy("label").agg(F.count("*").alias("n_points"), r6(F.avg("x"), 4).alias("mx"), r6(F.avg("y"), 4).alias("my"), r6(F.avg("z"), 4).alias("mz"))


@part.query(f"""with q as (select label, quantile_cont(w,0.75) a, quantile_cont(w,0.9) b, quantile_cont(w,0.95) c from {_P} group by 1) select label, round(sum(w*s)/sum(s),6)+0.0 wmean, round(any_value(a),6) q75, round(any_value(b),6) q90, round(any_value(c),6) q95, round(avg(w) filter (w>=b),6) top_mean, round(sum(case when w>0 then s else 0 end)/sum(s),6) positive_area, round(sum(case when w>0.1 then s else 0 end)/sum(s),6) high_area from {_P} join q using (label) group by 1""")
def surface_summaries(spark, sf):
    r = G.surface_summary(_points(spark, sf), ["label"], "w", "s", 0.1)
    return r.select("label", *[r6(c).alias(c) for c in r.columns[1:]])


@part.query(f"select label, count(*) n, round(corr(w,x),6) pearson, round(sum(case when w>0 and x>0 then s else 0 end)/sum(s),6) both_positive, round(sum(case when w>0 and x<0 then s else 0 end)/sum(s),6) opposed from {_P} group by 1")
def co_patch_summary(spark, sf):
    r = G.co_fields(_points(spark, sf), ["label"], "w", "x", "s")
    return r.select("label", "n", *[r6(c).alias(c) for c in ("pearson", "both_positive", "opposed")])


@part.query(f"with g as (select label, floor((x+1)/0.25)::bigint i, floor((y+1)/0.25)::bigint j, floor((z+1)/0.25)::bigint k, max(w) as value from {_P} where vec_id%2=0 group by 1,2,3,4) select p.vec_id, g.value from {_P} p join g on p.label=g.label and floor((x+1)/0.25)=i and floor((y+1)/0.25)=j and floor((z+1)/0.25)=k")
def grid_sampling(spark, sf):
    p = _points(spark, sf)
    cell = lambda c, n: F.floor((F.col(c) + 1) / 0.25).cast("long").alias(n)
    grid = p.where("vec_id % 2 = 0").groupBy("label", cell("x", "i"), cell("y", "j"), cell("z", "k")).agg(F.max("w").alias("value"))
    return G.sample_grid(p, grid, ["label"], (-1.0, -1.0, -1.0), (0.25, 0.25, 0.25)).select("vec_id", "value")


# --- ensembles of structures


def _frames(spark, sf):
    return _points(spark, sf).select((F.col("label") % 2).alias("g"), "label", "vec_id", "x", "y", "z")


@part.query()
def superposed_rmsd(spark, sf):
    r = G.superposed_rmsd(_frames(spark, sf), ["g"], "label", "vec_id")
    return r.withColumn("rmsd", r6("rmsd"))


@part.query()
def generator_disagreement(spark, sf):
    r = G.disagreement(G.superposed_rmsd(_frames(spark, sf), ["g"], "label", "vec_id"), ["g"])
    return r.select("g", "n_pairs", *[r6(c).alias(c) for c in ("median", "max", "sd")])


_FR = f"(select label % 2 g, label // 2 f, vec_id % 20 i, avg(x) x, avg(y) y, avg(z) z from {_P} group by 1,2,3)"


@part.query(f"""with n as (select g, count(distinct f) n from {_FR} group by 1), o as (select p.g, p.i a, q.i b, count(*) c from {_FR} p join {_FR} q on p.g=q.g and p.f=q.f where q.i-p.i>=3 and {_D} <= 0.1 group by 1,2,3), r as (select g, c/n p from o join n using (g))
select g, count(*) n_pairs, round(avg((p>=0.9)::int),6) persistent, round(avg((p>0.1 and p<0.9)::int),6) labile, round(avg(-greatest(least(p,1-1e-6),1e-6)*ln(greatest(least(p,1-1e-6),1e-6))-(1-greatest(least(p,1-1e-6),1e-6))*ln(1-greatest(least(p,1-1e-6),1e-6))),6) entropy from r group by 1""")
def contact_occupancy(spark, sf):
    f = _ensemble(spark, sf)
    r = G.contact_occupancy(f, ["g"], "f", "i", 0.1)
    return r.select("g", "n_pairs", *[r6(c).alias(c) for c in ("persistent", "labile", "entropy")])


def _ensemble(spark, sf):
    p = _points(spark, sf)
    return p.groupBy((F.col("label") % 2).alias("g"), F.floor(F.col("label") / 2).alias("f"), (F.col("vec_id") % 20).alias("i")).agg(*[F.avg(c).alias(c) for c in "xyz"])


@part.query(f"select g, i, round(sqrt(var_pop(x)+var_pop(y)+var_pop(z)),6) rmsf from {_FR} group by 1,2")
def residue_fluctuation(spark, sf):
    return G.fluctuation(_ensemble(spark, sf), ["g"], "i").withColumn("rmsf", r6("rmsf"))


# --- vectors and texts


@part.query("""with v as (select label, vec_id, abs(round(embedding[5]::double,4)) w, embedding e from embeddings), c as (select label, i, sum(w*e[i+1])/sum(w) m, sum(w) sw from v, range(64) t(i) group by 1,2) select label, round(any_value(sw),6) weight, list(round(m,6)+0.0 order by i) pooled from c group by 1""")
def region_weighted_pooling(spark, sf):
    e = read(spark, sf, "embeddings")
    w = F.abs(F.round(F.get("embedding", F.lit(4)).cast("double"), 4))
    r = G.pooled(e, ["label"], "embedding", w, width=64)
    return r.select("label", r6("weight").alias("weight"), F.transform("pooled", lambda x: F.round(x, 6) + F.lit(0.0)).alias("pooled"))


@part.query("""with v as (select vec_id, label, embedding::double[] e from embeddings), p as (select a.vec_id, b.vec_id other, round(list_cosine_similarity(a.e,b.e),9) c from v a join v b on a.label=b.label and a.vec_id<>b.vec_id), r as (select *, row_number() over (partition by vec_id order by c desc, other) r from p) select vec_id, other, round(c,6) cosine from r where r <= 3""")
def cosine_pairs_topk(spark, sf):
    from pyspark.sql import Window

    norm = F.sqrt(N.dot("embedding", "embedding"))  # once a vector, so that a pair costs one product
    e = read(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), norm.alias("n")).where("n > 0")
    b = e.select("label", F.col("vec_id").alias("other"), F.col("embedding").alias("e2"), F.col("n").alias("n2"))
    p = e.join(b, "label").where("vec_id != other").select("vec_id", "other", F.round(N.dot("embedding", "e2") / (F.col("n") * F.col("n2")), 9).alias("c"))
    w = Window.partitionBy("vec_id").orderBy(F.desc("c"), "other")
    return p.withColumn("r", F.row_number().over(w)).where("r <= 3").select("vec_id", "other", r6("c").alias("cosine"))


@part.query("""with v as (select vec_id, label, embedding[1:8]::double[] a, embedding[9:16]::double[] b from embeddings where label = 0), d as (select x.vec_id i, y.vec_id j, round(sqrt(list_sum(list_transform(list_zip(x.a,y.a), lambda p: (p[1]-p[2])**2))),9) da, round(sqrt(list_sum(list_transform(list_zip(x.b,y.b), lambda p: (p[1]-p[2])**2))),9) db from v x join v y on x.vec_id<y.vec_id),
r as (select rank() over (order by da) + (count(*) over (partition by da)-1)/2.0 ra, rank() over (order by db) + (count(*) over (partition by db)-1)/2.0 rb from d) select count(*) n, round(corr(ra,rb),6) spearman from r""")
def geometry_agreement(spark, sf):
    e = read(spark, sf, "embeddings").where("label = 0")
    both = e.select("vec_id", F.lit("a").alias("m"), F.slice("embedding", 1, 8).alias("v")).unionByName(e.select("vec_id", F.lit("b").alias("m"), F.slice("embedding", 9, 8).alias("v")))
    d = G.upper_distances(both, "vec_id", "v", "m").groupBy("key_a", "key_b").agg(F.round(F.max(F.when(F.col("m") == "a", F.col("d"))), 9).alias("da"), F.round(F.max(F.when(F.col("m") == "b", F.col("d"))), 9).alias("db"))
    return X.spearman(d, [], "da", "db").withColumn("spearman", r6("spearman"))


_IDENT = "list_sum(list_transform(range(1, least(length(a.t),length(b.t))+1), lambda i: (a.t[i]=b.t[i])::int))/greatest(length(a.t),length(b.t))"
_NAMES = "(select n_nationkey k, n_name t from nation union all select 1000+s_suppkey, s_name from supplier)"


@part.query(f"select a.k a, b.k b, round({_IDENT},6) as identity from {_NAMES} a join {_NAMES} b on a.k < b.k where {_IDENT} >= 0.9")
def similarity_self_join(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("t"))
    n = n.unionByName(read(spark, sf, "supplier").select((F.col("s_suppkey") + 1000).alias("k"), F.col("s_name").alias("t")))
    return G.similar_texts(n, "k", "t", 0.9).withColumn("identity", r6("identity"))


@part.query("""with recursive e0 as (select a.id a, b.id b from (select distinct upper(regexp_replace(heavy,'[^A-Za-z]','','g')) h, id from dev where length(heavy) > 0) a join (select distinct upper(regexp_replace(heavy,'[^A-Za-z]','','g')) h, id from dev where length(heavy) > 0) b on a.h=b.h and a.id<>b.id and a.h<>''), r as (select a node, a reach from e0 union select r.node, e0.b from r join e0 on e0.a=r.reach), c as (select node, min(reach) component from r group by 1) select component, count(*) size from c group by 1""")
def shared_sequence_groups(spark, sf):
    d = read(spark, sf, "dev").where("length(heavy) > 0 and id is not null").select("id", F.upper(F.regexp_replace("heavy", "[^A-Za-z]", "")).alias("h")).where("h != ''").distinct()
    least = d.groupBy("h").agg(F.min("id").alias("m"))
    comps = connected_components(d.join(least, "h").select(F.col("id").alias("a"), F.col("m").alias("b")))
    return comps.groupBy("component").agg(F.count("*").alias("size"))


_BRUTE = "list_sum(list_transform(range(1, least(length(q.t),length(r.t))+1), lambda i: (q.t[i]=r.t[i])::int))/greatest(length(q.t),length(r.t))"


@part.query(f"""with q as (select p_partkey k, p_name t from part where p_partkey % 20 = 0), r as (select min(s_suppkey) k, replace(s_name,'Supplier','small ring') t from supplier group by 2 union all select min(p_partkey), p_name from part where p_partkey % 20 <> 0 group by 2), s as (select q.k query, r.k n, coalesce({_BRUTE},0) s from q, r)
select query, arg_max(n, (s, -n)) nearest, round(max(s),6) as identity from s group by 1""")
def nearest_neighbour(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("t"))
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.replace("s_name", F.lit("Supplier"), F.lit("small ring")).alias("t"))
    return G.nearest_reference(p.where("k % 20 = 0"), p.where("k % 20 != 0").unionByName(s), "k", "t").withColumn("identity", r6("identity"))
