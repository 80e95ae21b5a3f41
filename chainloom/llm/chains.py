"""Antibody records as texts: residues, classes of exact copies, and the exact check of edits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def residues(chain: Column | str) -> Column:
    """The letters of a chain in upper case; a null chain has none."""
    return F.regexp_replace(F.upper(F.coalesce(chain, F.lit(""))), r"[^\p{L}]", "")


def antibody(record_id: Column | str) -> Column:
    """Letter code and number of an id, without case, filler, leading zeros and repeat mark; null if it lacks either."""
    code = F.upper(F.regexp_extract(record_id, r"(\p{L}+)", 1))
    number = F.regexp_extract(record_id, r"(\d+)", 1)
    return F.when((code != "") & (number != ""), F.concat_ws("|", code, F.regexp_replace(number, r"^0+(?=\d)", "")))


def records(dev: DataFrame) -> DataFrame:
    """``id``, the record's residues as ``x`` <= ``y`` whichever chain they stand in, and their 64-bit class ``k``.

    Null ids and records without any residue are left out. Repeated rows stay repeated.
    """
    chains = dev.where("id is not null").select("id", residues("heavy").alias("_h"), residues("light").alias("_l"))
    ends = chains.where("_h != '' or _l != ''").select("id", F.least("_h", "_l").alias("x"), F.greatest("_h", "_l").alias("y"))
    return ends.select("id", "x", "y", F.xxhash64("x", "y").alias("k"))


def texts(recs: DataFrame) -> DataFrame:
    """One row for each class of exact copies: ``k``, ``x``, ``y``.

    Copies are combined before the shuffle. That no two different texts share ``k`` is
    checked with a second hash; should it ever happen, the query fails instead of merging them.
    """
    second = F.xxhash64(F.lit(1), "y", "x")
    classes = recs.groupBy("k").agg(F.min(F.struct("x", "y")).alias("_t"), F.min(second).alias("_lo"), F.max(second).alias("_hi"))
    # a filter, not a new column: the rows stay partitioned by k for the joins to come
    checked = F.when(F.col("_lo") == F.col("_hi"), F.lit(True)).otherwise(F.raise_error(F.lit("two texts share a 64-bit hash")).cast("boolean"))
    return classes.where(checked).select("k", "_t.x", "_t.y")


def edits(a: str, b: str, most: int) -> int:
    """Least number of single-letter insertions, deletions and replacements between two texts, ``most`` + 1 if it is more.

    Bit-parallel: a column of the table is one long integer, so a letter of ``b`` costs
    a few operations whatever the length of ``a``. Common ends are cut off first.
    """
    if a == b:
        return 0
    i, n = 0, min(len(a), len(b))
    while i + 16 <= n and a[i : i + 16] == b[i : i + 16]:
        i += 16
    while i < n and a[i] == b[i]:
        i += 1
    a, b, n = a[i:], b[i:], n - i
    i = 0
    while i + 16 <= n and a[len(a) - i - 16 : len(a) - i] == b[len(b) - i - 16 : len(b) - i]:
        i += 16
    while i < n and a[len(a) - 1 - i] == b[len(b) - 1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    if not b:
        return len(a)
    block = len(a) // (most + 1)  # of most + 1 blocks one is left whole, moved by at most ``most`` places
    if block >= 3 and not any(a[i : i + block] in b[max(0, i - most) : i + block + most] for i in range(0, block * (most + 1), block)):
        return most + 1
    at: dict[str, int] = {}
    for place, letter in enumerate(a):
        at[letter] = at.get(letter, 0) | (1 << place)
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, left = full, 0, len(a), len(b)
    for letter in b:
        eq = at.get(letter, 0)
        d = (((eq & up) + up) ^ up) | eq | down
        rise = down | (full & ~(d | up))
        fall = up & d
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        left -= 1
        if score - left > most:  # each further letter lowers it by one at most
            return most + 1
        rise = ((rise << 1) | 1) & full
        fall = (fall << 1) & full
        up = fall | (full & ~(d | rise))
        down = rise & d
    return score if score <= most else most + 1


def best_edits(xa: str, ya: str, xb: str, yb: str, threshold: float) -> tuple[int, int] | None:
    """Least edits between two records over exchanged chains, and the longer length; None if the similarity is below ``threshold``."""
    n = max(len(xa) + len(ya), len(xb) + len(yb))
    most = int((1 - threshold) * n + 1e-9)
    best = most + 1
    for a in (xa + ya, ya + xa):
        for b in (xb + yb, yb + xb):
            best = min(best, edits(a, b, best - 1))
            if best == 0:
                return 0, n
    return (best, n) if best <= most and 1 - best / n >= threshold else None


def _checked(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ka, kb, d, ns = [], [], [], []
            for a, b, *four in zip(*(batch.column(c).to_pylist() for c in ("ka", "kb", "xa", "ya", "xb", "yb"))):
                found = best_edits(*four, threshold)
                if found:
                    ka.append(a)
                    kb.append(b)
                    d.append(found[0])
                    ns.append(found[1])
            yield pa.RecordBatch.from_arrays([pa.array(ka, pa.int64()), pa.array(kb, pa.int64()), pa.array(d, pa.int32()), pa.array(ns, pa.int32())], names=["ka", "kb", "d", "n"])

    return run


_WORDS = 4


def parities(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, of each of 256 classes of adjacent letter pairs whether their number is odd, as four words.

    ``data``: the texts one after the other, each prolonged by its first letter. An edit
    changes at most four pairs of the ring, so rings ``d`` edits apart differ in at most 4 d bits.
    """
    n, bits = len(offsets) - 1, 64 * _WORDS
    pair = data[:-1].astype(np.int64) * 257 + data[1:]
    row = np.repeat(np.arange(n), np.diff(offsets))[: len(pair)]
    inside = np.arange(len(pair)) + 1 < offsets[1:][row]
    odd = np.bincount(row[inside] * bits + (pair[inside] * 40503 >> 4) % bits, minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1).view(np.int64)


def _parity_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), 2000):
            batch = whole.slice(at, 2000)
            ring = batch.column("ring").cast(pa.large_binary())
            offsets = np.frombuffer(ring.buffers()[1], np.int64, count=ring.offset + len(ring) + 1)[ring.offset :]
            data = np.frombuffer(ring.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            p = parities(data, offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("n"), batch.column("wide"), *(pa.array(p[:, j]) for j in range(_WORDS))], names=["k", "n", "wide", *(f"p{j}" for j in range(_WORDS))])


def may_reach(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``ka``, ``kb``, each once, whose parities (:func:`parities`) don't differ in more bits than the allowed edits can change.

    Only the parities are sent to the pairs, not the texts. A letter beyond ASCII is
    several bytes, all of which an edit may change; pairs with such letters all stay.
    """
    whole = F.concat("x", "y")
    words = [f"p{j}" for j in range(_WORDS)]
    rings = classes.select("k", F.length(whole).alias("n"), (F.octet_length(whole) > F.length(whole)).alias("wide"), F.concat(whole, F.substring(whole, 1, 1)).alias("ring"))
    marks = rings.mapInArrow(_parity_rows, "k long, n int, wide boolean, " + ", ".join(f"{w} long" for w in words))
    a, b = (marks.toDF(*[c + side if c == "k" else f"{c}_{side}" for c in marks.columns]) for side in "ab")
    most = f"floor({1 - threshold:.12g}D * greatest(n_a, n_b) + 1e-9D)"
    differ = " + ".join(f"bit_count({w}_a ^ {w}_b)" for w in words)
    # hashing by ka alone also puts equal pairs together, so that they are made distinct and joined in one exchange
    once = pairs.select("ka", "kb").repartition("ka").distinct()
    return once.join(a, "ka").join(b, "kb").where(f"wide_a or wide_b or {differ} <= 4 * {most}").select("ka", "kb")


def checked(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The class pairs ``ka`` < ``kb`` that pass the exact check, with ``d`` edits and the longer length ``n``."""
    a = classes.select(F.col("k").alias("ka"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = classes.select(F.col("k").alias("kb"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    both = pairs.join(a, "ka").join(b, "kb").select("ka", "kb", "xa", "ya", "xb", "yb")
    return both.mapInArrow(_checked(threshold), "ka long, kb long, d int, n int")


def verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Candidate class pairs ``ka`` < ``kb``, perhaps repeated, that pass the exact check, as :func:`checked`."""
    return checked(may_reach(pairs, classes, threshold), classes, threshold)


def expand(links: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of ids (``id_a`` < ``id_b``) of linked classes and of copies within a class; ``members``: ``id``, ``k``, rows may repeat."""
    # hashing by k alone also puts equal rows together, and all joins below are by k: one exchange
    members = members.select("k", "id").repartition("k").distinct()
    a = members.select(F.col("k").alias("ka"), F.col("id").alias("_a"))
    b = members.select(F.col("k").alias("kb"), F.col("id").alias("_b"))
    across = links.select("ka", "kb").join(a, "ka").join(b, "kb").where("_a != _b")
    many = members.groupBy("k").count().where("count > 1").select("k")
    within = members.join(many, "k", "left_semi")
    copies = within.select("k", F.col("id").alias("_a")).join(within.select("k", F.col("id").alias("_b")), "k").where("_a < _b")
    return across.select(F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b")).unionByName(copies.select(F.col("_a").alias("id_a"), F.col("_b").alias("id_b")))
