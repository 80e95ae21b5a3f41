"""Long and wide forms (RS family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pivot(df: DataFrame, rows: list[str], column: str, values: list, measure: Column, prefix: str = "") -> DataFrame:
    """One column ``prefix`` + value for each of the given ``values``; no extra pass to find them. Missing cells are null."""
    wide = df.groupBy(*rows).pivot(column, values).agg(measure)
    return wide.select(*rows, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def crosstab(df: DataFrame, rows: list[str], column: str, values: list, prefix: str = "") -> DataFrame:
    """Counts of rows by ``rows`` and the given ``values``, 0 where there are none."""
    return pivot(df, rows, column, values, F.count(F.lit(1)), prefix).na.fill(0)


def rate(df: DataFrame, rows: list[str], column: str, values: list, hit) -> DataFrame:
    """:func:`crosstab` with ``n`` and the ``rate`` of the value ``hit``."""
    wide = crosstab(df, rows, column, values)
    n = sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))
    return wide.withColumn("n", n).withColumn("rate", F.try_divide(F.col(f"`{hit}`"), F.col("n")))


def melt(df: DataFrame, keys: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Long form; every column one row, nulls kept."""
    return df.unpivot(keys, columns, name, value)


def one_hot(df: DataFrame, column: str, categories: list, null_column: bool = True, prefix: str | None = None) -> DataFrame:
    """0/1 columns for a frozen list of ``categories``; a value not listed has all zeros, null its own column if ``null_column``."""
    p = prefix if prefix is not None else f"{column}_"
    outs = {f"{p}{v}": F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int") for v in categories}
    if null_column:
        outs[f"{p}nan"] = F.col(column).isNull().cast("int")
    return df.withColumns(outs)


def positional_one_hot(text: Column | str, alphabet: str) -> Column:
    """Sparse one-hot of a text: the sorted array of (position - 1) * |alphabet| + letter index; letters outside have no entry."""
    text = F.col(text) if isinstance(text, str) else text
    place = F.create_map(*[F.lit(x) for i, a in enumerate(alphabet) for x in (a, i)])
    at = F.transform(F.filter(F.split(text, ""), lambda ch: ch != ""), lambda ch, i: i * len(alphabet) + F.try_element_at(place, ch))
    return F.filter(at, lambda x: x.isNotNull())


def confusion(df: DataFrame, truth: str, guess: str, labels: list) -> DataFrame:
    """Long confusion table with its zero cells: ``truth``, ``guess``, ``n``, ``fraction`` of the truth's rows (0 if it has none)."""
    spark = df.sparkSession
    kind = df.schema[truth].dataType.simpleString()
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], f"{truth} {kind}, {guess} {kind}")
    counts = df.groupBy(truth, guess).agg(F.count("*").alias("n"))
    full = grid.join(counts, [truth, guess], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(truth))
    return full.withColumn("fraction", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def array_columns(df: DataFrame, array: str, size: int, prefix: str) -> DataFrame:
    """Columns ``prefix``0 .. of the array's first ``size`` entries in place of it; null where it is shorter."""
    return df.select(*[c for c in df.columns if c != array], *[F.get(array, F.lit(i)).alias(f"{prefix}{i}") for i in range(size)])


def feature_names(prefix: str, regions: list[str], tags: list[str], stats: list[str]) -> list[str]:
    """``{prefix}_{region}_{tag}_{stat}`` for all combinations, in that nesting."""
    return [f"{prefix}_{r}_{t}_{s}" for r in regions for t in tags for s in stats]


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct columns, at any depth, as plain columns named by their path; a name that is taken is an error."""
    outs: list[tuple[str, Column]] = []

    def walk(field: T.StructField, path: str, name: str) -> None:
        if isinstance(field.dataType, T.StructType):
            for sub in field.dataType:
                walk(sub, f"{path}.`{sub.name}`", f"{name}{sep}{sub.name}")
        else:
            outs.append((name, F.col(path)))

    for field in df.schema:
        walk(field, f"`{field.name}`", field.name)
    names = [n for n, _ in outs]
    if len(set(names)) < len(names):
        raise ValueError(f"column names clash: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return df.select(*[c.alias(n) for n, c in outs])

