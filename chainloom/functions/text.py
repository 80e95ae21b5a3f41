"""Text, regex, hash and JSON expressions (F family). All are JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_sequence(seq: Column | str, alphabet: str = AMINO_ACIDS) -> Column:
    """Upper case, only letters of ``alphabet``; null becomes the empty string."""
    return F.regexp_replace(F.upper(F.coalesce(_c(seq), F.lit(""))), f"[^{alphabet}]", "")


def contains_any(text: Column | str, words: list[str]) -> Column:
    """Whether any of the words occurs, whatever the letter case; null is false."""
    alternatives = "|".join("\\Q" + w + "\\E" for w in words)
    return F.coalesce(_c(text).rlike(f"(?i)(?:{alternatives})"), F.lit(False))


def full_match(text: Column | str, pattern: str) -> Column:
    """Whether the whole text matches; null is false."""
    return F.coalesce(_c(text).rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def capture(text: Column | str, pattern: str, replace: dict[str, str] | None = None, group: int = 0) -> Column:
    """The first match after literal replacements, null if there is none."""
    out = _c(text)
    for a, b in (replace or {}).items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.nullif(F.regexp_extract(out, pattern, group), F.lit(""))


def find_pairs(text: Column | str, pattern: str) -> Column:
    """All matches of a pattern with two groups: array of structs ``a``, ``b``."""
    t = _c(text)
    return F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), 1).alias("a"), F.regexp_extract_all(t, F.lit(pattern), 2).alias("b"))


def tokens(text: Column | str, pattern: str = r"[;,|\s]+") -> Column:
    """Non-empty parts between the separators; an empty array for null."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), pattern), lambda t: t != "")


def joined(values: Column | str, sep: str = ";") -> Column:
    """Aggregate: the distinct values, sorted, in one string. For groups of bounded size."""
    return F.array_join(F.sort_array(F.collect_set(_c(values))), sep)


def first_rule(text: Column | str, rules: list[tuple[str, str]]) -> Column:
    """The name of the first rule (name, regex) that matches; null if none does or for a null text."""
    out = None
    for name, rx in rules:
        test = _c(text).rlike(rx)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def sha256(*parts: Column | str, sep: str = "|", length: int = 64) -> Column:
    """The first ``length`` hex digits of the SHA-256 of the parts joined by ``sep``; null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws(sep, *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def id_list_hash(ids: Column | str) -> Column:
    """Aggregate: SHA-256 of a group's ids, sorted and joined by newlines. For groups of bounded size; see :func:`table_hash`."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(_c(ids).cast("string"))), "\n"), 256)


def ordered_id_hash(ids: Column | str, position: Column | str) -> Column:
    """Aggregate: as :func:`id_list_hash`, in the order of ``position``, then id."""
    pairs = F.sort_array(F.collect_list(F.struct(_c(position).alias("p"), _c(ids).cast("string").alias("i"))))
    return F.sha2(F.array_join(F.transform(pairs, lambda s: s["i"]), "\n"), 256)


def row_hash(df: DataFrame, key: str, columns: list[str], digits: int = 10) -> Column:
    """SHA-256 of a row's key and columns in a canonical spelling, independent of how the table is stored.

    Floating numbers are rounded to ``digits`` decimals; null, NaN and infinities are spelled ``null``, ``nan``, ``inf``, ``-inf``.
    """
    kinds = dict(df.dtypes)
    inf = F.lit(float("inf"))

    def spell(name: str) -> Column:
        c = F.col(name)
        if kinds[name] in ("double", "float"):
            number = F.format_string(f"%.{digits}f", F.round(c.cast("double"), digits) + F.lit(0.0))
            c = F.when(F.isnan(c), "nan").when(c == inf, "inf").when(c == -inf, "-inf").otherwise(number)
        return F.coalesce(c.cast("string"), F.lit("null"))

    return F.sha2(F.concat_ws("|", spell(key), *[spell(c) for c in columns]), 256)


def table_hash(df: DataFrame, key: str, columns: list[str], digits: int = 10) -> DataFrame:
    """One row ``n_rows``, ``content_hash`` of a table of any size, independent of row order and container.

    Rows are hashed, the hashes sorted and hashed within 4096 buckets by their first
    digits, then the bucket hashes, so no task holds more than a bucket.
    """
    rows = df.select(row_hash(df, key, columns, digits).alias("h")).withColumn("b", F.substring("h", 1, 3))
    buckets = rows.groupBy("b").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("bh"))
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "bh"))), lambda s: s["bh"]), ""), 256).alias("content_hash"))


def spec_json(columns: list[str]) -> Column:
    """JSON object of the columns, keys in sorted order, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def spec_hash(columns: list[str], length: int = 16) -> Column:
    """The first digits of the SHA-256 of :func:`spec_json`."""
    return F.substring(F.sha2(spec_json(columns), 256), 1, length)


def seed_of(text: Column | str, modulus: int = 2**31) -> Column:
    """A stable integer below ``modulus`` from a text: its SHA-256's first 15 hex digits."""
    return F.pmod(F.conv(F.substring(F.sha2(_c(text).cast("string"), 256), 1, 15), 16, 10).cast("long"), F.lit(modulus))


def json_field(text: Column | str, path: str, kind: str = "string") -> Column:
    """A field of a JSON text by path, null if the text is no JSON, lacks it or it isn't of that type."""
    return F.get_json_object(_c(text), path).try_cast(kind)


def positional_identity(a: Column | str, b: Column | str) -> Column:
    """Equal letters at equal places over the longer length; 0 if either is empty, null for a null."""
    x, y = _c(a), _c(b)
    same = F.aggregate(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: (p.eqNullSafe(q) & (p != "")).cast("int")), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    return F.when((F.length(x) > 0) & (F.length(y) > 0), same / F.greatest(F.length(x), F.length(y))).when(x.isNotNull() & y.isNotNull(), F.lit(0.0))


def hamming_fraction(a: Column | str, b: Column | str) -> Column:
    """(different letters over the shorter length + length difference) / longer length; null if either is empty."""
    x, y = _c(a), _c(b)
    return F.when((F.length(x) > 0) & (F.length(y) > 0), 1 - positional_identity(x, y))


def token_identity(a: Column | str, b: Column | str) -> Column:
    """Share of equal letters; 0 if the lengths differ or both are empty."""
    x, y = _c(a), _c(b)
    return F.when((F.length(x) == F.length(y)) & (F.length(x) > 0), positional_identity(x, y)).when(x.isNotNull() & y.isNotNull(), F.lit(0.0))


def match_status(expected: Column | str, observed: Column | str) -> Column:
    """MISSING, EXACT, SUBSTRING, LENGTH_DELTA (at most 2 letters longer or shorter and equal so far), NEAR (that, with at most 3 differences), MISMATCH."""
    x, y = _c(expected), _c(observed)
    gap = F.abs(F.length(x) - F.length(y))
    shorter = F.least(F.length(x), F.length(y))
    wrong = shorter - F.round(positional_identity(x, y) * F.greatest(F.length(x), F.length(y))).cast("int")
    return (
        F.when(x.isNull() | y.isNull() | (x == "") | (y == ""), "MISSING").when(x == y, "EXACT").when(F.contains(x, y) | F.contains(y, x), "SUBSTRING")
        .when((gap <= 2) & (wrong == 0), "LENGTH_DELTA").when((gap <= 2) & (wrong <= 3), "NEAR").otherwise("MISMATCH")
    )


def char_ngrams(text: Column | str, n: int) -> Column:
    """All overlapping ``n``-grams in order; empty for shorter texts."""
    t = _c(text)
    last = F.length(t) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(t, i, n))).otherwise(F.array().cast("array<string>"))


def tfidf(df: DataFrame, key: str, text: str, n: int, train: Column, max_features: int) -> DataFrame:
    """Character n-gram TF-IDF: ``key``, ``gram``, ``value`` (non-zero entries, L2-normed a row).

    Vocabulary: the ``max_features`` grams most frequent in the ``train`` rows, ties by
    gram. idf = ln((1 + N) / (1 + df)) + 1 over the train rows. Counts are combined before
    they are shuffled; ``max_features`` is a feature of the method and bounds the vocabulary.
    """
    grams = df.select(key, train.alias("_train"), F.explode(char_ngrams(text, n)).alias("gram"))
    tf = grams.groupBy(key, "_train", "gram").agg(F.count("*").alias("tf"))
    known = tf.where("_train").groupBy("gram").agg(F.sum("tf").alias("_all"), F.count("*").alias("_df"))
    vocabulary = known.orderBy(F.desc("_all"), F.asc("gram")).limit(max_features)
    n_train = df.agg(F.count_if(train).alias("_n"))
    idf = vocabulary.crossJoin(n_train).select("gram", (F.ln((1 + F.col("_n")) / (1 + F.col("_df"))) + 1).alias("idf"))  # one row
    weighted = tf.join(idf, "gram").select(key, "gram", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "gram", (F.col("w") / norm).alias("value"))


def residue_spans(length: Column | str, gram: int = 3) -> Column:
    """For each residue r (from 0) of a sequence the tokens that cover it: token t covers padded places t .. t + gram - 1, residue r is at place r + 1."""
    n = _c(length)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.filter(F.sequence(F.greatest(r + 1 - (gram - 1), F.lit(0)), r + 1), lambda t: t <= n + 2 - gram))
