"""Writers (S family): deterministic tables, metadata, side files, archives."""

from __future__ import annotations

import hashlib
import json
import os
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions.text import table_hash


def write_csv(df: DataFrame, path: str, key: list[str], sep: str = ",", one_file: bool = False) -> None:
    """Rows in the order of ``key`` with a header; sorted over all files, or in a single one for small releases.

    Spark's commit protocol makes the write all or nothing.
    """
    ordered = df.orderBy(*key)
    (ordered.coalesce(1) if one_file else ordered).write.mode("overwrite").csv(path, header=True, sep=sep, lineSep="\n", escape='"')


def write_parquet(df: DataFrame, path: str, key: str) -> dict:
    """Write and describe: n_rows, n_ids, dim, columns and a content hash that doesn't depend on the files."""
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    columns = [c for c in back.columns if c != key]
    one = table_hash(back, key, columns).first()
    return {"n_rows": one.n_rows, "n_ids": back.select(key).distinct().count(), "dim": len(columns), "columns": back.columns, "content_hash": one.content_hash}


def write_json(path: str, value: object) -> str:
    """JSON with sorted keys and, beside it, the SHA-256 of its bytes; returns the hash. For results of one row on the driver."""
    body = json.dumps(value, sort_keys=True, indent=1, ensure_ascii=False, default=str).encode()
    digest = hashlib.sha256(body).hexdigest()
    for name, content in ((path, body), (f"{path}.sha256", digest.encode())):
        with open(f"{name}.tmp", "wb") as f:
            f.write(content)
        os.replace(f"{name}.tmp", name)
    return digest


def fasta_records(df: DataFrame, key: str, chains: dict[str, str]) -> DataFrame:
    """One text row for each record and chain: ``>key_suffix`` and the sequence; chains are column -> suffix, empty ones are left out."""
    entries = F.array(*[F.struct(F.lit(suffix).alias("s"), F.col(c).alias("q")) for c, suffix in chains.items()])
    rows = df.select(F.col(key).cast("string").alias("_k"), F.explode(entries).alias("e")).where(F.length("e.q") > 0)
    return rows.select(F.concat(F.lit(">"), "_k", F.lit("_"), "e.s", F.lit("\n"), "e.q").alias("value"))


def write_fasta(df: DataFrame, path: str, key: str, chains: dict[str, str]) -> None:
    fasta_records(df, key, chains).write.mode("overwrite").text(path)


def markdown(df: DataFrame, most: int = 50) -> str:
    """The first ``most`` rows as a Markdown table; a report format, so it has a limit."""
    rows = df.limit(most).collect()
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]])


def pack(folder: str, archive: str, keep: Callable[[str], bool]) -> dict[str, str]:
    """Files under ``folder`` whose relative path satisfies ``keep`` into a zip, in sorted order with a fixed time; path -> SHA-256."""
    found: dict[str, str] = {}
    with zipfile.ZipFile(f"{archive}.tmp", "w", zipfile.ZIP_DEFLATED) as z:
        for base, dirs, names in os.walk(folder):
            dirs.sort()
            for n in sorted(names):
                full = os.path.join(base, n)
                rel = os.path.relpath(full, folder)
                if keep(rel):
                    with open(full, "rb") as f:
                        body = f.read()
                    z.writestr(zipfile.ZipInfo(rel, (1980, 1, 1, 0, 0, 0)), body)
                    found[rel] = hashlib.sha256(body).hexdigest()
    os.replace(f"{archive}.tmp", archive)
    return found
