"""Near-duplicate records with small edits (problem 5).

Method: a MinHash LSH forest. Each text has several trees; its label in a tree is a
sequence of minima of hashed shingles. Texts whose labels share a prefix are candidates
and are checked exactly. The prefix is the longest at which the forest finds a pair of
the greatest distance allowed with the target recall, whatever else the table holds.

A text is the ring heavy + light, so its shingles are the same whichever chain comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.chains import expand, records, texts, verified
from chainloom.operators.components import connected_components
from chainloom.session import stage

SHINGLE = 5
TREES = 28
DEPTH = 6
_BINS = 32
_ROUNDS = -(-TREES * DEPTH // _BINS)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(v: np.ndarray, seed: int) -> np.ndarray:
    v = (v + np.uint64(seed * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(32)
    return v


def signatures(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """16-bit minima, one row a text: one-permutation hashing with 32 bins in each of several rounds.

    ``data`` holds the texts, each prolonged by its first ``width - 1`` bytes.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    v = np.zeros(max(0, len(data) - width + 1), np.uint64)
    for j in range(width):
        v |= data[j : len(data) - width + 1 + j].astype(np.uint64) << np.uint64(8 * j)
    row = np.repeat(np.arange(n), lengths)[: len(v)]
    place = np.arange(len(v)) - offsets[:-1][row]
    inside = place <= lengths[row] - width
    v, row = v[inside], row[inside]
    out = np.empty((n, _ROUNDS * _BINS), np.uint16)
    for r in range(_ROUNDS):
        h = _mix(v, r)
        low = np.full(n * _BINS, _FULL)
        np.minimum.at(low, row * _BINS + (h >> np.uint64(59)).astype(np.int64), h & np.uint64((1 << 59) - 1))
        low = low.reshape(n, _BINS)
        empty = low == _FULL
        first = low.copy()
        step = 0
        while step < _BINS and empty.any():  # an empty bin takes the next full one's minimum, marked by the distance
            step += 1
            other = np.roll(first, -step, axis=1)
            fill = empty & (other != _FULL)
            low[fill] = _mix(other[fill], 100 + step)
            empty &= ~fill
        out[:, r * _BINS : (r + 1) * _BINS] = (low & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _tree_rows(depth: int):
    bits = min(12, 48 // depth)  # of each minimum, so that the tree and its label fit a long
    order = np.arange(TREES * DEPTH).reshape(DEPTH, TREES).T  # a tree's levels come from different rounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                ring = batch.column("ring").cast(pa.large_binary())
                offsets = np.frombuffer(ring.buffers()[1], np.int64, count=ring.offset + len(ring) + 1)[ring.offset :]
                data = np.frombuffer(ring.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                sig = signatures(data, offsets - offsets[0])
                key = np.empty((len(batch), TREES), np.int64)
                for t in range(TREES):
                    label = np.zeros(len(batch), np.int64)
                    for level in order[t][:depth]:
                        label = (label << bits) | (sig[:, level] & ((1 << bits) - 1))
                    key[:, t] = (t << 48) | label
                k = batch.column("k").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(k, TREES))], names=["node", "k"])

    return run


def forest_pairs(classes: DataFrame, depth: int) -> DataFrame:
    """Pairs ``ka`` < ``kb`` of classes that share a trie node at ``depth`` in a tree; a pair may repeat."""
    whole = F.concat("x", "y")
    rings = classes.select("k", F.concat(whole, F.substring(F.repeat(whole, SHINGLE - 1), 1, SHINGLE - 1)).alias("ring"))
    nodes = rings.mapInArrow(_tree_rows(depth), "node long, k long")
    a = nodes.select("node", F.col("k").alias("ka"))
    b = nodes.select("node", F.col("k").alias("kb"))
    return a.join(b, "node").where("ka < kb").select("ka", "kb")


def least_chance(threshold: float, depth: int) -> float:
    """Least probability that the forest finds a pair at or above ``threshold``: that of pairs just at it, no shingle changed twice."""
    away = SHINGLE * (1 - threshold)
    return 1 - (1 - max((1 - away) / (1 + away), 0.02) ** depth) ** TREES


def depth_for(threshold: float, target_recall: float, start_depth: int) -> int:
    """The greatest depth up to ``start_depth`` at which every pair at or above ``threshold`` is found with ``target_recall``, or 1."""
    return next((d for d in range(min(start_depth, DEPTH), 1, -1) if least_chance(threshold, d) >= target_recall), 1)


def near_links(classes: DataFrame, threshold: float = 0.94, target_recall: float = 0.99, start_depth: int = 4) -> DataFrame:
    """Links between classes of different texts: ``ka``, ``kb``, ``d``, ``n``; staged.

    ``target_recall`` holds for each pair, not only for their mean.
    """
    depth = depth_for(threshold, target_recall, start_depth)
    return stage(verified(forest_pairs(classes, depth), classes, threshold), f"links{depth}")


def near_duplicates(dev: DataFrame, threshold: float = 0.94, **how) -> tuple[DataFrame, DataFrame]:
    """Links between classes of exact copies (:func:`near_links`) and the members: ``id``, ``k``, rows may repeat.

    Chains count without what is no letter, null chains as empty; records without any
    residue are no cases. Repeated rows of an id count once. Empty tables give empty results.
    """
    recs = records(dev)
    return near_links(texts(recs), threshold, **how), recs.select("id", "k")


def near_pairs(dev: DataFrame, threshold: float = 0.94, **how) -> DataFrame:
    """All pairs of ids at or above ``threshold``: ``id_a`` < ``id_b``."""
    links, members = near_duplicates(dev, threshold, **how)
    return expand(links, members)


def near_groups(dev: DataFrame, threshold: float = 0.94, **how) -> DataFrame:
    """One row for each id with residues: ``id``, ``class_id``, ``group_id`` (connected classes), ``n_links`` of its class."""
    links, members = near_duplicates(dev, threshold, **how)
    comps = connected_components(links, "ka", "kb")
    degree = links.select(F.explode(F.array("ka", "kb")).alias("k")).groupBy("k").agg(F.count("*").alias("n_links"))
    return (
        members.distinct().join(comps, members.k == comps.node, "left")
        .join(degree, "k", "left")
        .select("id", F.col("k").alias("class_id"), F.coalesce("component", "k").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
