"""Readers of the file formats scientific tables come in (S family).

Text formats are parsed by Spark's own readers and expressions; a reader of a whole
binary file gets one file at a time on an executor, never on the driver.
"""

from __future__ import annotations

import io
import json
import os
import time
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited text by an explicit schema; cells that don't parse are null, embedded newlines in quotes are kept."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, multiLine=True, mode="PERMISSIVE", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The same table whatever its suffix: .parquet, .csv, .tsv, .json (lines)."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".parquet":
        df = spark.read.parquet(path)
        return df if schema is None else df.select(*[F.col(f.name).cast(f.dataType) for f in _schema(spark, schema)])
    if kind in (".csv", ".tsv"):
        if schema is None:
            raise ValueError("a delimited file needs a schema")
        return read_csv(spark, path, schema, sep="," if kind == ".csv" else "\t")
    if kind in (".json", ".jsonl"):
        return spark.read.json(path, schema=schema) if schema else spark.read.json(path)
    raise ValueError(f"unknown suffix {kind!r}")


def _schema(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


#: Columns of a search-hit table (tab-separated, without header).
HITS = "query string, target string, identity double, aln_length int, mismatch int, gap_open int, q_start int, q_end int, t_start int, t_end int, e_value double, bits double, cigar string"


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, HITS, sep="\t", header=False)


def read_json_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array: a row for each entry; fields an entry lacks are null."""
    return spark.read.json(path, schema=schema, multiLine=True)


_LINES = T.ArrayType(T.StringType())
#: The parts of a notebook that hold output.
NOTEBOOK = T.StructType([T.StructField("cells", T.ArrayType(T.StructType([T.StructField("outputs", T.ArrayType(T.StructType([T.StructField("text", _LINES), T.StructField("data", T.StructType([T.StructField("text/plain", _LINES)]))])))])))])


def read_notebook(spark: SparkSession, path: str) -> DataFrame:
    """Texts of a notebook's outputs: ``path``, ``cell``, ``output``, ``text`` (stream text, then plain data)."""
    books = spark.read.json(path, schema=NOTEBOOK, multiLine=True).select(F.input_file_name().alias("path"), F.posexplode("cells").alias("cell", "c"))
    outs = books.select("path", "cell", F.posexplode("c.outputs").alias("output", "o"))
    return outs.select("path", "cell", "output", output_text("o").alias("text"))


def output_text(output: str) -> Column:
    """Stream text and plain data of a notebook output (a struct column of :data:`NOTEBOOK`)."""
    empty = F.array().cast("array<string>")
    return F.array_join(F.concat(F.coalesce(F.col(f"{output}.text"), empty), F.coalesce(F.col(f"{output}.data").getField("text/plain"), empty)), "")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``name`` (first word of the header) and ``sequence`` (lines joined, white space out), in file order within ``path``."""
    records = spark.read.text(path, lineSep=">").where(F.length(F.trim("value")) > 0)
    lines = F.split("value", r"\r?\n")
    name = F.regexp_extract(lines[0], r"^(\S*)", 1)
    body = F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s", "")
    return records.select(name.alias("name"), body.alias("sequence"))


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """ATOM lines by their fixed columns: ``path``, ``atom``, ``residue``, ``chain``, ``seq``, ``insertion``, x, y, z, ``b_factor``."""
    v = F.col("value")
    cut = lambda a, b, kind: F.trim(F.substring(v, a, b - a + 1)).try_cast(kind)
    return spark.read.text(path).where(v.startswith("ATOM  ")).select(
        F.input_file_name().alias("path"), cut(7, 11, "int").alias("serial"), F.trim(F.substring(v, 13, 4)).alias("atom"), F.trim(F.substring(v, 18, 3)).alias("residue"), F.substring(v, 22, 1).alias("chain"), cut(23, 26, "int").alias("seq"),
        F.trim(F.substring(v, 27, 1)).alias("insertion"), cut(31, 38, "double").alias("x"), cut(39, 46, "double").alias("y"), cut(47, 54, "double").alias("z"), cut(61, 66, "double").alias("b_factor"),
    )


def first_ca(atoms: DataFrame) -> DataFrame:
    """The first CA atom of each (path, chain, seq)."""
    from chainloom.operators.rank import first_rows

    return first_rows(atoms.where(F.col("atom") == "CA"), ["path", "chain", "seq"], "serial", "insertion")


def read_whole(spark: SparkSession, path: str, parse: Callable[[bytes], pd.DataFrame], schema: str) -> DataFrame:
    """Binary files parsed one at a time on the executors: ``path`` and the columns of ``schema``."""
    names = [f.name for f in _schema(spark, schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"]):
                rows = parse(bytes(content))
                rows.insert(0, "path", p)
                yield rows[["path", *names]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {schema}")


def parse_dx(content: bytes) -> pd.DataFrame:
    """An OpenDX grid: counts, origin, steps and values in Fortran order (first index fastest)."""
    counts, origin, delta, values = None, None, [], []
    for line in content.decode("ascii", "replace").splitlines():
        words = line.split()
        if not words or words[0].startswith("#"):
            continue
        if words[:2] == ["object", "1"] and "counts" in words:
            counts = [int(w) for w in words[-3:]]
        elif words[0] == "origin":
            origin = [float(w) for w in words[1:4]]
        elif words[0] == "delta":
            delta.append([float(w) for w in words[1:4]])
        elif words[0] in ("object", "attribute", "component"):
            continue
        else:
            values += [float(w) for w in words]
    if counts is None or origin is None or len(delta) != 3 or len(values) < counts[0] * counts[1] * counts[2]:
        raise ValueError("not a whole grid file")
    grid = np.array(values[: counts[0] * counts[1] * counts[2]]).reshape(counts)  # z runs fastest in the file
    return pd.DataFrame([{"counts": counts, "origin": origin, "step": [delta[i][i] for i in range(3)], "values": grid.ravel(order="F").tolist()}])


DX = "counts array<int>, origin array<double>, step array<double>, values array<double>"


def read_dx(spark: SparkSession, path: str) -> DataFrame:
    return read_whole(spark, path, parse_dx, DX)


def read_pka(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the summary part of pKa reports: ``path``, ``residue``, ``seq``, ``chain``, ``pka``, ``model_pka``, ``delta``.

    The part runs from the line SUMMARY to the next rule of dashes.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split_part(F.regexp_extract("value", r"(?s)SUMMARY[^\n]*\n(.*)", 1), F.lit("\n---"), F.lit(1)).alias("part"))
    rows = text.select("path", F.explode(F.split("part", r"\r?\n")).alias("l")).select("path", F.regexp_extract("l", r"^\s*([A-Z+-]{2,3})\s+(\d+)\s+(\w)\s+(-?[\d.]+)\s+(-?[\d.]+)", 0).alias("_hit"), "l").where("_hit != ''")
    at = lambda i: F.regexp_extract("l", r"^\s*([A-Z+-]{2,3})\s+(\d+)\s+(\w)\s+(-?[\d.]+)\s+(-?[\d.]+)", i)
    return rows.select("path", at(1).alias("residue"), at(2).cast("int").alias("seq"), at(3).alias("chain"), at(4).cast("double").alias("pka"), at(5).cast("double").alias("model_pka")).withColumn("delta", F.col("pka") - F.col("model_pka"))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """NumPy arrays of up to three axes, one row for each entry of the first axis: ``stem``, ``row``, ``shape``, ``values`` (flat).

    A file split into ``.part0``, ``.part1``, ... is put together by name; only such pieces of one array meet in a task.
    """
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.part\d+$", "")
    part = F.coalesce(F.regexp_extract("path", r"\.part(\d+)$", 1).try_cast("int"), F.lit(0))
    files = spark.read.format("binaryFile").load(path).select(stem.alias("stem"), part.alias("part"), "content")

    def parse(frame: pd.DataFrame) -> pd.DataFrame:
        body = b"".join(bytes(c) for c in frame.sort_values("part")["content"])
        a = np.load(io.BytesIO(body), allow_pickle=False)
        return pd.DataFrame({"stem": frame["stem"].iloc[0], "row": np.arange(len(a), dtype=np.int64), "shape": [list(a.shape[1:])] * len(a), "values": [x.ravel().astype(np.float64).tolist() for x in a]})

    return files.groupBy("stem").applyInPandas(parse, "stem string, row long, shape array<int>, values array<double>")


_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column_number(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def parse_xlsx(content: bytes) -> pd.DataFrame:
    """All sheets of a workbook as rows of text cells: ``sheet``, ``row`` (from 0), ``cells`` (null where empty)."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_X}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_X}si")]
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in book.iter(f"{_X}sheet"):
        target = links[s.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")]
        tree = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        for i, row in enumerate(tree.iter(f"{_X}row")):
            cells: list = []
            for c in row.iter(f"{_X}c"):
                at = _column_number(c.get("r", "A1")) if c.get("r") else len(cells)
                v = c.find(f"{_X}v")
                text = "".join(t.text or "" for t in c.iter(f"{_X}t")) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                cells += [None] * (at + 1 - len(cells))
                cells[at] = text
            out.append({"sheet": s.get("name"), "row": i, "cells": cells})
    return pd.DataFrame(out, columns=["sheet", "row", "cells"])


XLSX = "sheet string, row int, cells array<string>"


def read_sheets(spark: SparkSession, path: str, sheet: str, columns: list[str], keep: Column | None = None) -> DataFrame:
    """Sheets whose name matches the SQL pattern ``sheet``, with the ``sheet`` name: text columns by place, the first row is the header.

    ``keep`` filters rows by the named columns, for example ``F.col("id").startswith("ADI-")`` against footnotes.
    """
    rows = read_whole(spark, path, parse_xlsx, XLSX).where(F.col("sheet").like(sheet) & (F.col("row") > 0))
    named = rows.select("sheet", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    return named.where(keep) if keep is not None else named


def read_config(path: str) -> dict:
    """A JSON or YAML config on the driver; YAML needs its optional package."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml  # optional

            return yaml.safe_load(f)
        return json.load(f)


def config_table(spark: SparkSession, config: dict, name: str = "setting") -> DataFrame:
    """A config as rows ``setting`` (dotted path) and ``value`` (JSON text)."""
    rows: list[tuple[str, str]] = []

    def walk(value, path: str) -> None:
        if isinstance(value, dict) and value:
            for k in sorted(value):
                walk(value[k], f"{path}.{k}" if path else str(k))
        else:
            rows.append((path, json.dumps(value, sort_keys=True, ensure_ascii=False)))

    walk(config, "")
    return spark.createDataFrame(rows, f"{name} string, value string")


def fetch(url: str, cache: str, tries: int = 5, opener: Callable[[str], bytes] | None = None, sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """A document from the cache folder, else from the network: ``tries`` attempts with pauses of 2^k seconds; None for a 404."""
    import hashlib

    path = os.path.join(cache, hashlib.sha256(url.encode()).hexdigest())
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    get = opener or (lambda u: urllib.request.urlopen(u, timeout=30).read())
    for k in range(tries):
        try:
            body = get(url)
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if k == tries - 1:
                raise
        except OSError:
            if k == tries - 1:
                raise
        else:
            os.makedirs(cache, exist_ok=True)
            with open(f"{path}.tmp", "wb") as f:
                f.write(body)
            os.replace(f"{path}.tmp", path)
            return body
        sleep(2.0**k)
    return None
