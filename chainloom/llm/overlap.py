"""Same or near-same records across splits (problem 4).

Method: an equi-join in place of a suffix array. Each text is the ring heavy + light. Of
its suffixes some are kept, chosen by their letters alone, so that two texts that share a
span keep the same ones in it. Texts with a kept suffix of equal first letters are a
pair, whatever their splits, and each pair is checked exactly. No suffix order is built,
no longest common prefixes are compared and no coverage is merged: with the exact check
after it, they would change no result. A span that many texts share gives all their pairs.

A pair at a similarity of 0.94 or more has d <= 0.06 n edits, n being the letters of the
longer text. They part the ring into at most d arcs, which the other ring has too and
whose letters number n - d at least. So one arc has (n - d) / d >= 15.7 letters, that is
16, wherever the edits lie. Every window of 16 letters keeps a suffix by its letters
alone (about one in five is kept in all); up to 36 letters all suffixes are kept. Thus
no pair is missed.

The suffixes are paired in :data:`PASSES` passes, by a hash of their letters: each pass
leaves only candidates behind, so that its shuffle files go before the next begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.llm.chains import checked, expand, may_reach, records, residues, texts
from chainloom.llm.neardup import _mix
from chainloom.operators.orphans import newest
from chainloom.session import stage

#: name: (least and greatest length of text, window in suffixes, letters of the suffix compared, letters hashed to choose one)
TIERS = {0: (1, 36, 1, 8, 8), 1: (33, 1 << 31, 7, 10, 3)}
LONGEST = 16
PASSES = 2


def _code(letters: np.ndarray, length: int) -> np.ndarray:
    """Order-preserving number of the ``length`` letters (at most 13) from each place."""
    out = np.zeros(len(letters), np.int64)
    for j in range(length):
        out *= 27
        out[: len(letters) - j] += letters[j:]
    return out


def suffixes(data: np.ndarray, offsets: np.ndarray, tiers: dict = TIERS) -> tuple[np.ndarray, np.ndarray]:
    """Row and first-letters code (with the tier) of each kept suffix.

    ``data``: the texts one after the other, each prolonged by its first 15 letters.
    A window keeps the suffix at x mod w, x being the place of its least hashed few
    letters: this thins more than keeping the least suffix (about a quarter of them).
    """
    lengths = np.diff(offsets) - (LONGEST - 1)
    letters = np.where((data >= 65) & (data <= 90), data - 64, 0).astype(np.int64)
    row_of = np.repeat(np.arange(len(lengths)), np.diff(offsets))
    place = np.arange(len(data)) - offsets[:-1][row_of]
    parts = []
    for tier, (least, most, window, compared, hashed) in tiers.items():
        fits = (lengths >= least) & (lengths <= most)
        if not fits.any():
            continue
        inside = np.flatnonzero(fits[row_of] & (place < lengths[row_of]))
        # the place within the window rides in the low bits, so that a minimum also tells where it is
        h = _mix(_code(letters, hashed).astype(np.uint64), 7) & ~np.uint64(31)
        best = h.copy()
        for j in range(1, window + compared - hashed):
            np.minimum(best[:-j], h[j:] | np.uint64(j), out=best[:-j])
        at = (best & np.uint64(31)).astype(np.int64)
        starts = inside + at[inside] % window
        row = row_of[inside]
        starts = np.unique(np.where(starts - offsets[:-1][row] >= lengths[row], starts - lengths[row], starts))
        head = np.zeros(len(starts), np.int64)
        for j in range(compared):
            head = head * 27 + letters[starts + j]
        parts.append((row_of[starts], (tier << 58) | head))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _suffix_rows(number: int, passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                ring = batch.column("ring").cast(pa.large_binary())
                offsets = np.frombuffer(ring.buffers()[1], np.int64, count=ring.offset + len(ring) + 1)[ring.offset :]
                data = np.frombuffer(ring.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                row, head = suffixes(data, offsets - offsets[0])
                now = _mix(head.astype(np.uint64), 23) % np.uint64(passes) == number
                yield pa.RecordBatch.from_arrays([pa.array(head[now]), pa.array(batch.column("k").to_numpy(zero_copy_only=False)[row[now]])], names=["head", "k"])

    return run


def span_pairs(classes: DataFrame, number: int = 0, passes: int = 1) -> DataFrame:
    """Pairs ``ka`` < ``kb`` of classes with equal kept suffixes, of those that pass ``number`` takes; a pair may repeat."""
    whole = F.concat("x", "y")
    rings = classes.select("k", F.concat(whole, F.substring(F.repeat(whole, LONGEST - 1), 1, LONGEST - 1)).alias("ring"))
    kept = rings.mapInArrow(_suffix_rows(number, passes), "head long, k long")
    a = kept.select("head", F.col("k").alias("ka"))
    b = kept.select("head", F.col("k").alias("kb"))
    return a.join(b, "head").where("ka < kb").select("ka", "kb")


def known_folds(folds: DataFrame) -> DataFrame:
    """``scheme``, ``id``, ``fold``: the newest row of each scheme and id where it has a fold; outer blanks of ids don't count."""
    named = folds.where("scheme is not null and id is not null").select("scheme", F.regexp_replace("id", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("id"), "fold", "assigned_at")
    return newest(named, ["scheme", "id"], "assigned_at").where("fold is not null").select("scheme", "id", "fold")


def cross_split(dev: DataFrame, folds: DataFrame, threshold: float = 0.94) -> DataFrame:
    """Pairs of ids in different folds with the same or nearly the same residues: ``scheme``, ``id_a``, ``id_b``, ``fold_a``, ``fold_b``.

    Each fold in turn is the evaluation split. Ids of ``folds`` that dev lacks, null
    folds and records without residues give no pair. Repeated rows count once. Empty
    tables give an empty result.
    """
    recs = records(dev)
    classes = stage(texts(recs), "classes")
    parts = [stage(may_reach(span_pairs(classes, i, PASSES), classes, threshold), "candidates") for i in range(PASSES)]
    links = stage(checked(reduce(lambda a, b: a.unionByName(b), parts).repartition("ka").distinct(), classes, threshold), "links")
    pairs = stage(expand(links, recs.select("id", "k")), "pairs")
    split = known_folds(folds)
    a = split.select("scheme", F.col("id").alias("id_a"), F.col("fold").alias("fold_a"))
    b = split.select("scheme", F.col("id").alias("id_b"), F.col("fold").alias("fold_b"))
    return pairs.join(a, "id_a").join(b, ["scheme", "id_b"]).where("fold_a != fold_b").select("scheme", "id_a", "id_b", "fold_a", "fold_b")


def overlap_counts(found: DataFrame, dev: DataFrame) -> DataFrame:
    """Per ``scheme``, evaluation ``fold`` and ``source`` of the record in it: ``n_pairs`` and ``n_records`` that have a copy in training."""
    sides = found.select("scheme", F.explode(F.array(F.struct(F.col("fold_a").alias("fold"), F.col("id_a").alias("id")), F.struct(F.col("fold_b").alias("fold"), F.col("id_b").alias("id")))).alias("s")).select("scheme", "s.fold", "s.id")
    source = dev.where("id is not null").groupBy("id").agg(F.min("source").alias("source"))
    return sides.join(source, "id").groupBy("scheme", "fold", "source").agg(F.count("*").alias("n_pairs"), F.countDistinct("id").alias("n_records"))


SPAN = 24


def _all_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    half = SPAN // 2
    for whole in batches:
        for at in range(0, len(whole), 1000):
            batch = whole.slice(at, 1000)
            text = batch.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64, count=text.offset + len(text) + 1)[text.offset :]
            data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            letters = np.where((data >= 65) & (data <= 90), data - 64, 0).astype(np.int64)
            row = np.repeat(np.arange(len(text)), np.diff(offsets))
            place = np.arange(len(data)) - offsets[:-1][row]
            starts = np.flatnonzero(place <= np.diff(offsets)[row] - SPAN)
            code = _code(letters, half)
            ids = batch.column("id").take(pa.array(row[starts]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(place[starts].astype(np.int32)), pa.array(code[starts]), pa.array(code[starts + half])], names=["id", "place", "head", "tail"])


def span_coverage(dev: DataFrame, folds: DataFrame) -> DataFrame:
    """How much of each record is found in training records: ``scheme``, ``id``, ``fold``, ``letters``, ``covered``.

    All suffixes of the chains are grouped by their first 24 letters: in a suffix order
    partitioned by them, such a group is a run of neighbours with so long a common prefix.
    Where a run holds records of different folds, each of its suffixes covers 24 letters
    of its record; overlapping ones are merged. Each fold in turn is the evaluation split.
    Records without a fold or with both chains shorter than 24 letters are left out, as
    are letters beyond A to Z. Counts are combined before they are shuffled, so a run that
    a third of all records share is two numbers a task.
    """
    chains = dev.where("id is not null").select("id", F.explode(F.array(F.struct(F.lit(0).alias("c"), residues("heavy").alias("t")), F.struct(F.lit(1).alias("c"), residues("light").alias("t")))).alias("s"))
    one = chains.groupBy("id", F.col("s.c").alias("c")).agg(F.min("s.t").alias("text")).where(F.length("text") >= SPAN)
    split = known_folds(folds)
    texts_ = stage(one.join(split.select("id").distinct(), "id", "left_semi").withColumn("key", F.concat_ws("\x01", "c", "id")), "texts")
    kind = "id string, place int, head long, tail long"
    suffixes_ = texts_.select(F.col("key").alias("id"), "text").mapInArrow(_all_suffixes, kind)
    keyed = split.select("scheme", "id", "fold", F.explode(F.array(F.lit("0"), F.lit("1"))).alias("c")).select("scheme", F.concat_ws("\x01", "c", "id").alias("id"), "fold")
    placed = suffixes_.join(keyed, "id")
    runs = placed.groupBy("scheme", "head", "tail").agg(F.min("fold").alias("_lo"), F.max("fold").alias("_hi")).where("_lo != _hi")
    # heads are above -1, so this is the head, but shuffled anew: the join can split a run that many records share
    runs = runs.select("scheme", F.greatest("head", F.lit(-1)).alias("head"), "tail")
    hits = placed.join(runs, ["scheme", "head", "tail"], "left_semi").select("scheme", "id", "place").distinct()
    # a span's new letters are those the span before it, if any, doesn't cover
    before = Window.partitionBy("scheme", "id").orderBy("place")
    gain = F.least(F.lit(SPAN), F.coalesce(F.col("place") - F.lag("place").over(before), F.lit(SPAN)))
    covered = hits.withColumn("_gain", gain).groupBy("scheme", "id").agg(F.sum("_gain").alias("covered"))
    every = texts_.select(F.col("key").alias("id"), F.col("id").alias("_id"), F.length("text").alias("letters")).join(keyed, "id")
    joined = every.join(covered, ["scheme", "id"], "left")
    return joined.groupBy("scheme", F.col("_id").alias("id")).agg(F.max("fold").alias("fold"), F.sum("letters").alias("letters"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"))


def coverage_report(covered: DataFrame, dev: DataFrame) -> DataFrame:
    """Per ``scheme``, evaluation ``fold`` and ``source``: ``n_records``, ``n_touched`` (any span in training), ``n_half`` (half or more covered) and the ``share`` of letters covered."""
    source = dev.where("id is not null").groupBy("id").agg(F.min("source").alias("source"))
    c = covered.join(source, "id")
    return c.groupBy("scheme", "fold", "source").agg(
        F.count("*").alias("n_records"), F.count_if(F.col("covered") > 0).alias("n_touched"), F.count_if(F.col("covered") * 2 >= F.col("letters")).alias("n_half"), F.try_divide(F.sum("covered"), F.sum("letters")).alias("share")
    )
