"""Queries of sources, sinks, streams and extension points.

The test tables are Parquet only, so a format's query writes the table in that format to
the shared folder, whole, and reads it back.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from chainloom.functions import extend as Z
from chainloom.plans.part import Part, r6
from chainloom.session import read, shared_dir
from chainloom.sources import files as S
from chainloom.sources import sinks as W
from chainloom.streaming import events as T

part = Part()


def _folder(spark, name):
    return f"{shared_dir(spark)}/chainloom/{spark.sparkContext.applicationId}/files-{name}-{uuid.uuid4().hex[:8]}"


@part.query("select o_orderkey::varchar id, o_totalprice price, o_orderpriority priority from orders")
def csv_round_trip(spark, sf):
    path = _folder(spark, "csv")
    W.write_csv(read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority")), path, ["id"])
    return S.read_csv(spark, path, "id string, price double, priority string")


@part.query("select c_custkey, c_name, c_acctbal from customer")
def tsv_round_trip(spark, sf):
    path = _folder(spark, "tsv") + ".tsv"
    W.write_csv(read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path, ["c_custkey"], sep="\t", one_file=True)
    return S.read_table(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@part.query("select count(*) n, round(sum(p_retailprice),2) total from part")
def parquet_scan(spark, sf):
    return S.read_table(spark, f"{sf}/part.parquet").agg(F.count("*").alias("n"), r6(F.sum("p_retailprice"), 2).alias("total"))


@part.query("select 'parquet' kind, count(*) n, round(sum(s_acctbal),2) total from supplier union all select 'csv', count(*), round(sum(s_acctbal),2) from supplier")
def suffix_dispatch(spark, sf):
    path = _folder(spark, "dispatch")
    s = read(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    s.write.parquet(f"{path}.parquet")
    W.write_csv(s, f"{path}.csv", ["s_suppkey"])
    one = lambda k: S.read_table(spark, f"{path}.{k}", "s_suppkey bigint, s_acctbal double").agg(F.lit(k).alias("kind"), F.count("*").alias("n"), r6(F.sum("s_acctbal"), 2).alias("total")).select("kind", "n", "total")
    return one("parquet").unionByName(one("csv"))


@part.query("select event_id, json_extract_string(props,'$.k')::int k, event_type from events")
def nested_json_source(spark, sf):
    path = _folder(spark, "json")
    e = read(spark, sf, "events").select(F.to_json(F.struct("event_id", F.struct(F.from_json("props", "k int").alias("props"), F.col("event_type").alias("kind")).alias("info"))).alias("value"), (F.col("event_id") % 40).alias("b"))
    # each file is one JSON array
    e.groupBy("b").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value")).select("value").repartition(8).write.option("lineSep", "\n\n").text(path)
    whole = spark.read.text(path).select(F.explode(F.from_json("value", "array<struct<event_id: bigint, info: struct<props: struct<k: int>, kind: string>>>")).alias("e"))
    from chainloom.operators.reshape import flatten

    return flatten(whole.select("e.*")).select("event_id", F.col("info_props_k").alias("k"), F.col("info_kind").alias("event_type"))


@part.query("select 'NB-' || s_suppkey as name, round(s_acctbal,1) as value from supplier")
def notebook_source(spark, sf):
    path = _folder(spark, "notebook")
    s = read(spark, sf, "supplier").select(F.format_string('{"outputs": [{"text": ["NB-%d  ", "%.1f\\\\n"]}, {"data": {"text/plain": ["done"]}}]}', "s_suppkey", "s_acctbal").alias("c"), (F.col("s_suppkey") % 4).alias("b"))
    books = s.groupBy("b").agg(F.concat(F.lit('{"cells": ['), F.array_join(F.collect_list("c"), ","), F.lit("]}")).alias("value")).select("value")
    books.repartition(4).write.text(path)
    # a file of several notebooks, one a line
    cells = spark.read.text(path).select(F.from_json("value", S.NOTEBOOK).alias("n")).select(F.explode("n.cells").alias("c")).select(F.explode("c.outputs").alias("o"))
    text = cells.select(S.output_text("o").alias("t"))
    from chainloom.functions.text import find_pairs

    return text.select(F.explode(find_pairs("t", r"(NB-\d+)\s+(-?[\d.]+)")).alias("p")).select(F.col("p.a").alias("name"), F.col("p.b").cast("double").alias("value"))


_AA = "ACDEFGHIKLMNPQRSTVWY"
_CLEAN = f"regexp_replace(upper(coalesce({{0}},'')), '[^{_AA}]', '', 'g')"
_DEV = f"(select distinct replace(id,' ','_') id, {_CLEAN.format('heavy')} h, {_CLEAN.format('light')} l from dev where id is not null)"


@part.query(f"select id || '_H' as name, h as sequence from {_DEV} where h <> '' union all select id || '_L', l from {_DEV} where l <> ''")
def fasta_round_trip(spark, sf):
    from chainloom.functions.text import clean_sequence

    path = _folder(spark, "fasta")
    d = read(spark, sf, "dev").where("id is not null").select(F.replace("id", F.lit(" "), F.lit("_")).alias("id"), clean_sequence("heavy").alias("h"), clean_sequence("light").alias("l")).distinct()
    W.write_fasta(d, path, "id", {"h": "H", "l": "L"})
    return S.read_fasta(spark, path)


@part.query("select vec_id::int seq, round(embedding[1]::double*100,3) x, round(embedding[2]::double*100,3) y, round(embedding[3]::double*100,3) z from embeddings where vec_id < 9000")
def pdb_source(spark, sf):
    path = _folder(spark, "pdb")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 100
    form = "ATOM  %5d  %-3s GLY %s%4d    %8.3f%8.3f%8.3f  1.00%6.2f"
    e = read(spark, sf, "embeddings").where("vec_id < 9000")
    line = lambda serial, atom: F.format_string(form, serial, F.lit(atom), F.lit("A"), F.col("vec_id"), F.round(at(0), 3), F.round(at(1), 3), F.round(at(2), 3), F.lit(9.5))
    rows = e.select(F.explode(F.array(line(F.col("vec_id") * 2, "CA"), line(F.col("vec_id") * 2 + 1, "CB"), line(F.col("vec_id") * 2 + 1, "CA"))).alias("value"))
    rows.write.text(path)
    ca = S.first_ca(S.read_pdb(spark, path).withColumn("path", F.lit("model")))
    return ca.select("seq", r6("x", 3).alias("x"), r6("y", 3).alias("y"), r6("z", 3).alias("z"))


@part.query("select label::varchar grid, (label%2+2)*12::bigint n, round(sum(v),4) total, 1.5::double step from (select label, unnest([round(embedding[1]::double,4)]) v, row_number() over (partition by label order by vec_id) r from embeddings) where r <= (label%2+2)*12 group by 1,2")
def dx_grid_source(spark, sf):
    from pyspark.sql import Window

    path = _folder(spark, "dx")
    e = read(spark, sf, "embeddings").select("label", "vec_id", F.format_string("%.4f", F.round(F.get("embedding", F.lit(0)).cast("double"), 4)).alias("v"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("r")).where("r <= (label % 2 + 2) * 12")
    body = e.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda s: s["v"]), "\n").alias("v"))
    head = F.format_string("object 1 class gridpositions counts %d 3 4\norigin 0 0 %d\ndelta 1.5 0 0\ndelta 0 1.5 0\ndelta 0 0 1.5\n", F.col("label") % 2 + 2, F.col("label"))
    body.select(F.concat(head, "v").alias("value"), "label").write.partitionBy("label").option("lineSep", "\n").text(path)
    g = S.read_dx(spark, f"{path}/*/*.txt")
    return g.select(F.format_string("%.0f", F.col("origin")[2]).alias("grid"), F.size("values").cast("long").alias("n"), r6(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.col("step")[0].alias("step"))


@part.query("select 'ASP' residue, s_suppkey::int seq, 'A' chain, round(s_acctbal/1000,2) pka, 3.8::double model_pka, round(round(s_acctbal/1000,2)-3.8,2) delta from supplier")
def pka_report_source(spark, sf):
    path = _folder(spark, "pka")
    s = read(spark, sf, "supplier").select(F.format_string("   ASP %3d A %8.2f %10.2f", "s_suppkey", F.round(F.col("s_acctbal") / 1000, 2), F.lit(3.8)).alias("l"), (F.col("s_suppkey") % 3).alias("b"))
    rep = s.groupBy("b").agg(F.concat(F.lit("junk ASP 1 A 1.0 1.0\nSUMMARY OF THIS PREDICTION\n"), F.array_join(F.collect_list("l"), "\n"), F.lit("\n-------\nASP 9 Z 1.0 1.0\n")).alias("value"))
    rep.write.partitionBy("b").text(path)
    return S.read_pka(spark, f"{path}/*/*.txt").select("residue", "seq", "chain", "pka", "model_pka", r6("delta", 2).alias("delta"))


@part.query("select label as row, len(list(vec_id))::bigint n, round(sum(embedding[1]::double),5) total from embeddings group by 1")
def npy_source(spark, sf):
    """Every label's first numbers as one row of a padded array, written in NumPy's format in two pieces and read back."""
    import os

    import numpy as np

    path = _folder(spark, "npy")
    e = read(spark, sf, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("v"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        import io

        labels = sorted(frame["label"].unique())
        rows = [frame.loc[frame["label"] == k, "v"].to_numpy() for k in labels]
        a = np.full((len(rows), max(map(len, rows))), np.nan)
        for i, r in enumerate(rows):
            a[i, : len(r)] = r
        out = io.BytesIO()
        np.save(out, a)
        body = out.getvalue()
        os.makedirs(path, exist_ok=True)  # the shared folder, which every executor sees
        for i, piece in enumerate((body[: len(body) // 2], body[len(body) // 2 :])):
            with open(f"{path}/labels.npy.part{i}", "wb") as f:
                f.write(piece)
        return pd.DataFrame({"n": [len(rows)]})

    if path.startswith("file:"):
        path = path[5:]
    e.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(build, "n int").count()
    a = S.read_npy(spark, f"{path}/labels.npy.part*")
    known = F.filter("values", lambda x: x.isNotNull() & ~F.isnan(x))
    return a.select(F.col("row").cast("int").alias("row"), F.size(known).cast("long").alias("n"), r6(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@part.query("select 'split' || case when share > 0.5 then '.major' else '.minor' end || '.' || split_name setting, round(share,3)::varchar as value from split_target")
def config_source(spark, sf):
    rows = read(spark, sf, "split_target").collect()  # the wanted splits, a few
    config: dict = {"split": {"major": {}, "minor": {}}}
    for r in rows:
        config["split"]["major" if r.share > 0.5 else "minor"][r.split_name] = round(r.share, 3)
    return S.config_table(spark, config)


@part.query("select 'q' || s_suppkey query, 't' || s_nationkey target, round(s_acctbal/10000,3) as identity, 100::int aln_length, '119M' cigar from supplier")
def search_hits_source(spark, sf):
    path = _folder(spark, "hits")
    s = read(spark, sf, "supplier").select(F.format_string("q%d\tt%d\t%.3f\t100\t2\t0\t1\t119\t1\t119\t3.853E-41\t148\t119M", "s_suppkey", "s_nationkey", F.round(F.col("s_acctbal") / 10000, 3)).alias("value"))
    s.write.text(path)
    return S.read_hits(spark, path).select("query", "target", "identity", "aln_length", "cigar")


@part.query()
def workbook_sheets(spark, sf):
    """Nations in two sheets of a small workbook, read by a sheet pattern, footnotes dropped."""
    import io
    import os
    import zipfile

    rows = read(spark, sf, "nation").orderBy("n_nationkey").collect()  # a fixed table of a few rows
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda c, i, v: f'<c r="{c}{i}" t="inlineStr"><is><t>{v}</t></is></c>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="ma_a" r:id="r0"/><sheet name="ma_b" r:id="r1"/><sheet name="legend" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(3)) + "</Relationships>")
        for i in range(3):
            body = [f'<row>{cell("A", 1, "id")}{cell("B", 1, "name")}</row>'] + [f'<row>{cell("A", j + 2, f"ADI-{r.n_nationkey}")}{cell("B", j + 2, r.n_name)}</row>' for j, r in enumerate(rows) if r.n_nationkey % 2 == i] + [f'<row>{cell("A", 99, "footnote")}</row>']
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{''.join(body)}</sheetData></worksheet>")
    path = _folder(spark, "book").removeprefix("file:")
    os.makedirs(path)
    with open(f"{path}/book.xlsx", "wb") as f:
        f.write(out.getvalue())
    return S.read_sheets(spark, f"{path}/book.xlsx", "ma_%", ["id", "name"], F.col("id").startswith("ADI-"))


part.ORACLE["workbook_sheets"] = "select case n_nationkey % 2 when 0 then 'ma_a' else 'ma_b' end sheet, 'ADI-' || n_nationkey id, n_name as name from nation"


@part.query("select count(*) n_rows, count(distinct c_custkey) n_ids, 2::bigint dim from customer")
def parquet_sink_report(spark, sf):
    report = W.write_parquet(read(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_name"), _folder(spark, "sink"), "c_custkey")
    return spark.createDataFrame([(report["n_rows"], report["n_ids"], report["dim"])], "n_rows long, n_ids long, dim long")


@part.query()
def json_sidecar_sink(spark, sf):
    import os

    path = _folder(spark, "side").removeprefix("file:")
    os.makedirs(path)
    one = read(spark, sf, "orders").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last")).first().asDict()
    digest = W.write_json(f"{path}/summary.json", one)
    with open(f"{path}/summary.json.sha256", encoding="ascii") as f:
        same = f.read() == digest
    return spark.createDataFrame([(S.read_config(f"{path}/summary.json")["n"], same)], "n long, same boolean")


part.ORACLE["json_sidecar_sink"] = "select count(*) n, true same from orders"


@part.query("select '| r_regionkey | r_name |' line, 0::bigint i union all select '|---|---|', 1 union all select '| ' || r_regionkey || ' | ' || r_name || ' |', r_regionkey+2 from region")
def markdown_sink(spark, sf):
    text = W.markdown(read(spark, sf, "region").orderBy("r_regionkey"))
    return spark.createDataFrame([(line, i) for i, line in enumerate(text.split("\n"))], "line string, i long")


@part.query("select 'region.csv' as name, true packed union all select 'skip.tmp', false")
def release_pack(spark, sf):
    import os

    path = _folder(spark, "pack").removeprefix("file:")
    os.makedirs(path)
    for name in ("region.csv", "skip.tmp"):
        with open(f"{path}/{name}", "w", encoding="ascii") as f:
            f.write("".join(f"{r.r_regionkey},{r.r_name}\n" for r in read(spark, sf, "region").orderBy("r_regionkey").collect()))
    found = W.pack(path, f"{path}.zip", lambda rel: rel.endswith(".csv"))
    return spark.createDataFrame([(n, n in found) for n in ("region.csv", "skip.tmp")], "name string, packed boolean")


# --- streams


@part.query("select time_bucket(interval '1 hour', ts) \"start\", event_type, count(*) n, round(sum(value),4) total, round(avg(value),6) mean from events group by 1,2")
def stream_tumbling(spark, sf):
    w = T.windowed(read(spark, sf, "events"), "ts", ["event_type"], "1 hour", "value", late=None)
    return w.select("start", "event_type", "n", r6("total", 4).alias("total"), r6("mean").alias("mean"))


@part.query("select time_bucket(interval '15 minutes', ts) - to_minutes(15*k) \"start\", count(*) n, round(sum(value),4) total, round(avg(value),6) mean from events, range(4) t(k) group by 1")
def stream_sliding(spark, sf):
    w = T.windowed(read(spark, sf, "events"), "ts", [], "1 hour", "value", slide="15 minutes", late=None)
    return w.select("start", "n", r6("total", 4).alias("total"), r6("mean").alias("mean"))


@part.query("""with g as (select user_id, ts, sum((ts - p >= interval '30 minutes' or p is null)::int) over (partition by user_id order by ts, event_id) s from (select *, lag(ts) over (partition by user_id order by ts, event_id) p from events)) select min(ts) "start", max(ts) + interval '30 minutes' "end", user_id, count(*) n from g group by user_id, s""")
def stream_sessions(spark, sf):
    return T.sessions(read(spark, sf, "events"), "ts", ["user_id"], "30 minutes", late=None)


@part.query("select count(distinct (user_id, event_type)) n from events")
def stream_dedup(spark, sf):
    return T.once(read(spark, sf, "events"), "ts", ["user_id", "event_type"]).agg(F.count("*").alias("n"))


@part.query("select user_id::varchar as key, count(*) n, round(sum(value),4) total from events group by 1")
def stream_running_totals(spark, sf):
    """A real stream over the table's files, with state in each key, drained to the shared folder; the last update of each key."""
    e = read(spark, sf, "events")
    stream = T.read_stream(spark, f"{sf}/events.parquet*", e.schema)
    from chainloom.operators.rank import best_rows

    out = _folder(spark, "totals")
    q = T.running_totals(stream, "user_id", "ts", "value").writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{out}/rows")).trigger(availableNow=True).start()
    q.awaitTermination()
    return best_rows(spark.read.parquet(f"{out}/rows"), ["key"], [F.desc("batch"), F.desc("n")]).select("key", "n", r6("total", 4).alias("total"))


@part.query("select time_bucket(interval '1 hour', ts) \"start\", event_type, count(*) n, round(avg(abs(value - (user_id % 10)*5)),6) mae from events group by 1,2")
def stream_incremental_scores(spark, sf):
    e = read(spark, sf, "events")
    solution = e.select("event_id", ((F.col("user_id") % 10) * 5).cast("double").alias("truth"))
    return T.incremental_scores(e.select("event_id", "ts", "event_type", "value"), solution, "event_id", "value", "truth", ["event_type"]).withColumn("mae", r6("mae"))


# --- extension points


@part.query("select s_suppkey, length(s_name) n, round(s_acctbal*2,4) twice, null::varchar error from supplier")
def row_extractor(spark, sf):
    def feature(name, balance):
        return {"n": len(name), "twice": balance * 2}

    r = Z.extract(read(spark, sf, "supplier"), feature, ["s_name", "s_acctbal"], "n long, twice double", ["s_suppkey"])
    return r.withColumn("twice", r6("twice", 4))


@part.query("select o_orderkey, case o_orderstatus when 'O' then 'open' when 'F' then 'done' else 'other' end state from orders")
def map_apply(spark, sf):
    return Z.map_values(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"O": "open", "F": "done"}, "state", "other").select("o_orderkey", "state")


@part.query("select s_suppkey, list_sort(list_filter([case when s_acctbal < 0 then 'debt' end, case when s_nationkey < 5 then 'near' end], lambda x: x is not null)) hits from supplier where s_acctbal < 0 or s_nationkey < 5")
def predicate_hits(spark, sf):
    return Z.where_any(read(spark, sf, "supplier"), {"near": F.col("s_nationkey") < 5, "debt": F.col("s_acctbal") < 0}).select("s_suppkey", "hits")


@part.query("select s_nationkey, count(*) n, round(max(s_acctbal)-min(s_acctbal),4) spread from supplier group by 1")
def group_apply(spark, sf):
    def spread(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s_nationkey": [f["s_nationkey"].iloc[0]], "n": [len(f)], "spread": [f["s_acctbal"].max() - f["s_acctbal"].min()]})

    return Z.apply_groups(read(spark, sf, "supplier"), ["s_nationkey"], spread, "s_nationkey int, n long, spread double").withColumn("spread", r6("spread", 4))


@part.query("select p_partkey, (i-1)::int place, p_name[i:i+2] gram from (select p_partkey, p_name, unnest(range(1, length(p_name)-1)) i from part)")
def table_function(spark, sf):
    Z.register_functions(spark)
    read(spark, sf, "part").createOrReplaceTempView("_parts")
    return spark.sql("select p_partkey, g.place, g.gram from _parts, lateral grams(p_name, 3) g")


@part.query("select p_brand, round(max(p_retailprice)-min(p_retailprice),4) as range from part group by 1")
def registered_statistic(spark, sf):
    if "range" not in Z.STATS:
        Z.register_stat("range", lambda c: F.max(c) - F.min(c))
    return read(spark, sf, "part").groupBy("p_brand").agg(r6(Z.STATS["range"](F.col("p_retailprice")), 4).alias("range"))


@part.query("select s_suppkey id, s_acctbal a__s_acctbal, s_nationkey b__s_nationkey from supplier")
def feature_store(spark, sf):
    store = Z.FeatureStore(spark)
    store.register("a", lambda: read(spark, sf, "supplier").withColumnRenamed("s_suppkey", "id"), lambda c: c.startswith("s_acct"))
    store.register("b", lambda: read(spark, sf, "supplier").withColumnRenamed("s_suppkey", "id").drop("s_name"), lambda c: "nation" in c)
    return store.matrix(["a", "b"])


@part.query("select s_suppkey, round((s_acctbal-(select avg(s_acctbal) from supplier where s_nationkey<20))/(select stddev_pop(s_acctbal) from supplier where s_nationkey<20),6) s_acctbal from supplier")
def fold_preprocessor(spark, sf):
    from chainloom.operators.linear import FoldPreprocessor

    s = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return FoldPreprocessor(["s_acctbal"]).fit(s, F.col("s_nationkey") < 20).transform(s).select("s_suppkey", r6("s_acctbal").alias("s_acctbal"))
