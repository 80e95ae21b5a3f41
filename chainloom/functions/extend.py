"""Extension points: per-file extractors, group functions, generators, statistics and feature stores (Z family)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.operators.aggregate import STATS, register_stat  # noqa: F401  (the registry of statistics is part of this surface)


def extract(df: DataFrame, function: Callable[..., dict], arguments: list[str], schema: str, keys: list[str]) -> DataFrame:
    """A pure function from a row's ``arguments`` to a dict, as columns of ``schema``: ``keys`` and its values.

    Runs in Arrow batches; a row for which the function raises has nulls and the text of the error in ``error``.
    """
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for values in zip(*[f[a] for a in arguments]):
                try:
                    got = function(*values)
                    rows.append([got.get(n) for n in names] + [None])
                except Exception as e:  # an extractor's failure belongs to its row
                    rows.append([None] * len(names) + [f"{type(e).__name__}: {e}"])
            out = pd.DataFrame(rows, columns=[*names, "error"], index=f.index, dtype=object)
            yield pd.concat([f[keys], out], axis=1)

    return df.select(*dict.fromkeys([*keys, *arguments])).mapInPandas(run, f"{kinds}, {schema}, error string")


def map_values(df: DataFrame, column: str, table: dict, out: str, default=None) -> DataFrame:
    """A Python dict as a column expression: no Python runs a row."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return df.withColumn(out, F.coalesce(F.try_element_at(pairs, F.col(column)), F.lit(default)))


def apply_groups(df: DataFrame, by: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function from one group's frame to a frame. A group must fit a task: for groups bounded by their meaning, such as molecules."""
    return df.groupBy(*by).applyInPandas(function, schema)


def where_any(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Rows that satisfy any predicate, with the sorted names of those as ``hits``; predicates are column expressions, not row functions."""
    hits = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in sorted(predicates.items())]), lambda x: x.isNotNull())
    return df.withColumn("hits", hits).where(F.size("hits") > 0)


@F.udtf(returnType="place int, gram string")
class Grams:
    """Table function: the overlapping grams of a text with their places."""

    def eval(self, text: str, n: int):
        for i in range(len(text or "") - n + 1):
            yield i, text[i : i + n]


def register_functions(spark: SparkSession) -> None:
    """Make the table function known to SQL as ``grams(text, n)``."""
    spark.udtf.register("grams", Grams)


@dataclass
class FeatureStore:
    """Named feature blocks, loaded lazily and once; ``rules`` choose a block's columns."""

    spark: SparkSession
    loaders: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    rules: dict[str, Callable[[str], bool]] = field(default_factory=dict)
    _frames: dict[str, DataFrame] = field(default_factory=dict)

    def register(self, name: str, load: Callable[[], DataFrame], rule: Callable[[str], bool] | None = None) -> None:
        if name in self.loaders:
            raise ValueError(f"block {name} exists")
        self.loaders[name] = load
        if rule:
            self.rules[name] = rule

    def block(self, name: str, key: str = "id") -> DataFrame:
        if name not in self._frames:
            df = self.loaders[name]()
            rule = self.rules.get(name)
            self._frames[name] = df if rule is None else df.select(key, *[c for c in df.columns if c != key and rule(c)])
        return self._frames[name]

    def matrix(self, names: list[str], key: str = "id") -> DataFrame:
        from chainloom.operators.joins import concat_blocks

        return concat_blocks({n: self.block(n, key) for n in names}, key)
