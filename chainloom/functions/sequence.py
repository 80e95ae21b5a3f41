"""Protein sequence descriptors (D family)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chainloom.functions.numbers import property_sum
from chainloom.functions.text import AMINO_ACIDS, hamming_fraction

# fixed values: Kyte and Doolittle hydropathy (published 1982)
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
# fixed values: average residue masses in dalton
MASSES = {
    "A": 71.0788, "R": 156.1875, "N": 114.1038, "D": 115.0886, "C": 103.1388, "Q": 128.1307, "E": 129.1155, "G": 57.0519, "H": 137.1411, "I": 113.1594,
    "L": 113.1594, "K": 128.1741, "M": 131.1926, "F": 147.1766, "P": 97.1167, "S": 87.0782, "T": 101.1051, "W": 186.2132, "Y": 163.1760, "V": 99.1326,
}
WATER = 18.01524
# fixed values: charges at pH 7 with histidine as a tenth
CHARGES = {"K": 1.0, "R": 1.0, "H": 0.1, "D": -1.0, "E": -1.0}
# fixed values: side chain and terminal pK
PK_POSITIVE = {"n_term": 9.0, "K": 10.5, "R": 12.5, "H": 6.0}
PK_NEGATIVE = {"c_term": 3.1, "D": 3.65, "E": 4.25, "C": 8.3, "Y": 10.1}
# fixed values: largest accessible surface of a residue in square angstrom (Tien 2013, theoretical)
MAX_SURFACE = {
    "A": 129, "R": 274, "N": 195, "D": 193, "C": 167, "Q": 225, "E": 223, "G": 104, "H": 224, "I": 197,
    "L": 201, "K": 236, "M": 224, "F": 240, "P": 159, "S": 155, "T": 172, "W": 285, "Y": 263, "V": 174,
}
# fixed values: residue classes
CLASSES = {"aromatic": "FWY", "polar": "STNQ", "hydrophobic": "AVILMFWC", "positive": "KRH", "negative": "DE"}
# fixed values: regions of the IMGT numbering, first and last number
REGIONS = (("FR1", 1, 26), ("CDR1", 27, 38), ("FR2", 39, 55), ("CDR2", 56, 65), ("FR3", 66, 104), ("CDR3", 105, 117), ("FR4", 118, 128))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_of(seq: Column | str, letters: str) -> Column:
    """Number of letters of a set; null for a null sequence."""
    return F.length(F.regexp_replace(_c(seq), f"[^{letters}]", ""))


def composition(seq: Column | str, prefix: str = "", alphabet: str = AMINO_ACIDS) -> list[Column]:
    """``prefix`` + letter: count over the length (at least 1) for every letter."""
    return [(count_of(seq, a) / F.greatest(F.length(_c(seq)), F.lit(1))).alias(f"{prefix}{a}") for a in alphabet]


def isoelectric_points(seqs: pd.Series) -> pd.Series:
    """pH at which the net charge is 0, by bisection; missing for empty texts. Equal letter counts are solved once."""
    s = seqs.fillna("")
    counts = {a: s.str.count(a).to_numpy(np.float64) for a in "KRHDECY"}
    full = s.str.len().to_numpy() > 0
    low, high = np.zeros(len(s)), np.full(len(s), 14.0)
    for _ in range(60):
        ph = (low + high) / 2
        charge = sum((counts.get(k, 1.0)) / (1 + 10 ** (ph - pk)) for k, pk in PK_POSITIVE.items())
        charge = charge - sum((counts.get(k, 1.0)) / (1 + 10 ** (pk - ph)) for k, pk in PK_NEGATIVE.items())
        low, high = np.where(charge > 0, ph, low), np.where(charge > 0, high, ph)
    return pd.Series(np.where(full, (low + high) / 2, np.nan))


@F.pandas_udf(DoubleType())
def isoelectric_point(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield isoelectric_points(s)


def parameters(seq: Column | str, prefix: str = "") -> list[Column]:
    """Length, mass, hydropathy mean, charge at pH 7 and class fractions; null for empty sequences, but the length.

    All are sums over letters and stay on the JVM.
    """
    s = _c(seq)
    n = F.length(s)
    full = n > 0
    outs = {
        "length": n,
        "mass": F.when(full, property_sum(s, MASSES) + WATER),
        "gravy": F.when(full, property_sum(s, HYDROPATHY) / n),
        "charge": F.when(full, property_sum(s, CHARGES)),
        **{k: F.when(full, count_of(s, v) / n) for k, v in CLASSES.items()},
    }
    return [c.alias(f"{prefix}{k}") for k, c in outs.items()]


def pair_index(seq: Column | str, weights: dict[str, float], factor: float = 10.0) -> Column:
    """``factor`` / length times the sum of a per-letter-pair table (a parameter) over all adjacent pairs; pairs it lacks count 0, null for empty sequences.

    With a published table of dipeptide weights this is the instability index.
    """
    s = _c(seq)
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, 2))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.coalesce(F.try_element_at(table, p), F.lit(0.0)))
    return F.when(F.length(s) > 0, F.lit(factor) * total / F.length(s))


def region_of(number: Column | str) -> Column:
    """Region name of an IMGT number, UNKNOWN outside 1 .. 128 or for a null."""
    x = _c(number)
    out = None
    for name, a, b in REGIONS:
        test = (x >= a) & (x <= b)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("UNKNOWN")


def position_label(number: Column | str, insertion: Column | str) -> Column:
    """Number and insertion code as one label; null for a null number."""
    return F.concat(_c(number).cast("string"), F.trim(F.coalesce(_c(insertion), F.lit(""))))


def regions_from_numbered(df: DataFrame, keys: list[str], number: str, insertion: str, letter: str) -> DataFrame:
    """Region strings of numbered residues, insertions in order, gaps left out: ``keys``, FR1 .. FR4, empty where there is none."""
    rows = df.where(F.col(letter).isNotNull() & (F.col(letter) != "-")).withColumn("_r", region_of(number))
    cells = [
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_r") == name, F.struct(F.col(number).alias("n"), F.coalesce(insertion, F.lit("")).alias("i"), F.col(letter).alias("a"))))), lambda s: s["a"]), "").alias(name)
        for name, _, _ in REGIONS
    ]
    return rows.groupBy(*keys).agg(*cells)


def annotate(df: DataFrame, keys: list[str], seq: str, numbering: DataFrame) -> DataFrame:
    """Residue rows of each sequence with its numbering and a status for the whole chain.

    ``numbering``: ``keys``, ``seq_index`` (from 0), ``aa``, ``number``, ``insertion``.
    Gives ``keys``, ``seq_index``, ``aa``, ``label``, ``region``, ``status``: OK,
    PARTIAL_UNKNOWN (a residue without number), SEQ_MISMATCH, LENGTH_MISMATCH.

    A chain's numbering is gathered into one row before it is shuffled and joined.
    """
    entry = F.struct("seq_index", "aa", "number", "insertion")
    gathered = numbering.groupBy(*keys).agg(F.collect_list(entry).alias("_numbering"))
    return annotate_rows(df.join(gathered, keys, "left"), keys, seq, "_numbering")


def annotate_rows(df: DataFrame, keys: list[str], seq: str, numbering: Column | str) -> DataFrame:
    """As :func:`annotate`, the numbering standing in the sequence's own row: an array of (seq_index, aa, number, insertion) or null. Of entries for one residue the least counts. Nothing is shuffled."""
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    known = _c(numbering)
    # evaluated once a row: a column named within a lambda might be put in its place, once a letter
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    entries = F.sort_array(F.filter(known, lambda e: e["seq_index"].isNotNull()))
    least = lambda all_: F.filter(all_, lambda e, i: (i == 0) | (F.get(all_, i - 1)["seq_index"] != e["seq_index"]))
    placed = once(entries, lambda all_: F.struct(least(all_).alias("all"), F.transform(least(all_), lambda e: e["seq_index"].cast("int")).alias("at")))
    residue = lambda both: F.transform(both["l"], lambda aa, i: F.struct(i.alias("seq_index"), aa.alias("aa"), F.get(both["p"]["all"], F.array_position(both["p"]["at"], i).cast("int") - 1).alias("e")))
    rows = df.select(*keys, F.coalesce(F.size(known), F.lit(0)).alias("_m"), once(F.struct(letters.alias("l"), placed.alias("p")), residue).alias("_rows"))
    bad = F.exists("_rows", lambda r: r["e"]["aa"] != r["aa"])
    unnumbered = F.exists("_rows", lambda r: r["e"]["number"].isNull())
    status = F.when(F.greatest("_m", F.lit(0)) != F.size("_rows"), "LENGTH_MISMATCH").when(bad, "SEQ_MISMATCH").when(unnumbered, "PARTIAL_UNKNOWN").otherwise("OK")
    # a select of its own: beside the explode the status would be found anew for each residue
    each = rows.select(*keys, "_rows", status.alias("status")).select(*keys, "status", F.explode("_rows").alias("_r"))
    return each.select(*keys, "_r.seq_index", "_r.aa", position_label("_r.e.number", "_r.e.insertion").alias("label"), region_of("_r.e.number").alias("region"), "status")


def family_distance(df: DataFrame, key: str, family: str, seq: str, naive: Column) -> DataFrame:
    """Distance of each sequence to its family's consensus: ``key``, ``family``, ``reference`` (naive or all), ``distance``.

    The consensus is that of the naive members, of all where a family has none. Null
    families and empty sequences are left out.
    """
    from chainloom.operators.aggregate import consensus

    known = df.where(F.col(family).isNotNull() & (F.length(seq) > 0))
    some = consensus(known.where(naive), [family], seq).select(family, F.col("consensus").alias("_naive"))
    every = consensus(known, [family], seq).select(family, F.col("consensus").alias("_all"))
    joined = known.join(every, family).join(some, family, "left")
    return joined.select(key, family, F.when(F.col("_naive").isNotNull(), "naive").otherwise("all").alias("reference"), hamming_fraction(seq, F.coalesce("_naive", "_all")).alias("distance"))


def mutation_fraction(a: DataFrame, b: DataFrame, keys: list[str], position: str, letter: str, last: int = 104) -> DataFrame:
    """Share of different letters over the positions 1 .. ``last`` both tables have: ``keys``, ``covered``, ``mutated``."""
    both = a.where(F.col(position).between(1, last)).join(b.withColumnRenamed(letter, "_other"), [*keys, position])
    return both.groupBy(*keys).agg(F.count("*").alias("covered"), F.avg((F.col(letter) != F.col("_other")).cast("double")).alias("mutated"))


def mutation_share(a: Column | str, b: Column | str, last: int = 104) -> list[Column]:
    """``covered`` and ``mutated`` as in :func:`mutation_fraction`, for two texts whose positions are their places; null where either is empty."""
    x, y = _c(a), _c(b)
    n = F.when((F.length(x) > 0) & (F.length(y) > 0), F.least(F.length(x), F.length(y), F.lit(last)))
    letters = [F.split(t.substr(F.lit(1), n), "") for t in (x, y)]
    same = F.aggregate(F.zip_with(*letters, lambda p, q: ((p == q) & (p != "")).cast("int")), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    return [n.cast("long").alias("covered"), ((n - same) / n).alias("mutated")]


def map_chains(chains: DataFrame, records: DataFrame, model: str, chain: str, seq: str, key: str, heavy: str, light: str) -> DataFrame:
    """Which chain of a model is heavy and which light, by equal sequence: ``model``, ``key``, ``heavy_chain``, ``light_chain``, ``error``.

    The least chain name counts where several are equal; ``error`` names what is missing.
    """
    want = records.select(key, F.explode(F.array(F.struct(F.lit("H").alias("kind"), F.col(heavy).alias("s")), F.struct(F.lit("L").alias("kind"), F.col(light).alias("s")))).alias("w")).select(key, "w.kind", F.col("w.s").alias(seq)).where(F.col(seq) != "")
    hits = chains.join(want, seq)
    out = hits.groupBy(model, key).agg(F.min(F.when(F.col("kind") == "H", F.col(chain))).alias("heavy_chain"), F.min(F.when(F.col("kind") == "L", F.col(chain))).alias("light_chain"))
    return out.withColumn("error", F.when(F.col("heavy_chain").isNull(), "no heavy chain").when(F.col("light_chain").isNull(), "no light chain"))


def relative_surface(surface: Column | str, letter: Column | str, clipped: bool = False) -> Column:
    """Surface over the residue's largest; clipped to 0 .. 1 if asked. Null for letters without a maximum."""
    from chainloom.functions.numbers import clip, lookup

    ratio = F.try_divide(_c(surface), lookup(letter, MAX_SURFACE))
    return clip(ratio, 0.0, 1.0) if clipped else ratio


def exposure_flags(rasa: Column | str) -> list[Column]:
    """``exposed`` (>= 0.20), ``strong`` (>= 0.50), ``buried`` (< 0.20); all false for null and NaN."""
    known = _c(rasa).isNotNull() & ~F.isnan(_c(rasa))
    return [(known & (_c(rasa) >= 0.20)).alias("exposed"), (known & (_c(rasa) >= 0.50)).alias("strong"), (known & (_c(rasa) < 0.20)).alias("buried")]


def fuse(variable: Column | str, constant: str, most: int = 12) -> list[Column]:
    """A domain and the constant one after it, an accidental overlap of up to ``most`` letters written once: ``fused``, ``overlap``."""
    v = _c(variable)
    n = F.lit(0)
    for k in range(1, min(most, len(constant)) + 1):  # the longest wins
        n = F.when(F.right(v, F.lit(k)) == constant[:k], F.lit(k)).otherwise(n)
    n = F.when(v.isNull() | (v == ""), F.lit(None).cast("int")).otherwise(n)
    return [F.concat(v, F.substring(F.lit(constant), n + 1, F.lit(len(constant)))).alias("fused"), n.alias("overlap")]


def expected_bridges(df: DataFrame, keys: list[str], rules: list[tuple[str, str, str, int, int]], domain: str = "domain", locus: str = "locus") -> DataFrame:
    """Expected bonds by a rule table (domain, locus or ``*``, name, first, second): ``keys``, ``bond``, ``first``, ``second``."""
    table = df.sparkSession.createDataFrame(rules, "_d string, _l string, bond string, first int, second int")
    hit = (df[domain] == table._d) & ((table._l == "*") | (df[locus] == table._l))
    return df.join(F.broadcast(table), hit).select(*keys, "bond", "first", "second")  # the rules are a literal list


def domain_slices(lengths: dict[str, Column]) -> Column:
    """Half-open index ranges of domains one after the other: array of (domain, start, stop)."""
    start = F.lit(0)
    out = []
    for name, n in lengths.items():
        out.append(F.struct(F.lit(name).alias("domain"), start.cast("int").alias("start"), (start + n).cast("int").alias("stop")))
        start = start + n
    return F.array(*out)
