"""Row operators as a fluent chain over a DataFrame: each call adds to the logical plan and nothing runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIP, FAIL = "skip", "fail"


def _policy(policy: str) -> str:
    if policy not in (SKIP, FAIL):
        raise ValueError(f"policy is {policy!r}, not skip or fail")
    return policy


def fail_when(df: DataFrame, error: Column) -> DataFrame:
    """Stops the query with the first non-null error. It is a filter, which the optimizer can't prune."""
    return df.filter(F.when(error.isNotNull(), F.raise_error(error).cast("boolean")).otherwise(F.lit(True)))


class Pipeline:
    """A chain of operators. Rows keep their other columns (envelope included) unless `map` selects anew."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    @classmethod
    def from_df(cls, df: DataFrame) -> Pipeline:
        return cls(df)

    def map(self, *columns: Column | str) -> Pipeline:
        """1 to 1: exactly these columns."""
        return Pipeline(self.df.select(*columns))

    def with_columns(self, **columns: Column) -> Pipeline:
        """1 to 1: adds or replaces columns."""
        return Pipeline(self.df.withColumns(columns))

    def filter(self, condition: Column) -> Pipeline:
        """Keeps rows for which the condition is true; null counts as false."""
        return Pipeline(self.df.filter(F.coalesce(condition, F.lit(False))))

    def inspect(self, name: str, *aggregates: Column) -> Pipeline:
        """Observes aggregates of the passing rows without changing them."""
        return Pipeline(self.df.observe(name, *aggregates))

    def try_map(self, error: Column, policy: str = FAIL, **columns: Column) -> Pipeline:
        """1 to 1 or none: rows whose error is not null are dropped (skip) or stop the query (fail)."""
        kept = self.df.filter(error.isNull()) if _policy(policy) == SKIP else fail_when(self.df, error)
        return Pipeline(kept.withColumns(columns))

    def flat_map(self, items: Column, alias: str = "item", keep: list[str] | None = None) -> Pipeline:
        """1 to 0..N: a row for each item of an array column (structs become columns); null and empty arrays give none.
        Children have the parent's columns, so a router over the envelope keeps them together."""
        base = self.df if keep is None else None
        own = list(base.columns) if base is not None else keep
        out = self.df.withColumn(alias, F.explode(items))
        kind = out.schema[alias].dataType.typeName()
        return Pipeline(out.select(*own, f"{alias}.*" if kind == "struct" else alias))

    def dedup(self, *keys: str) -> Pipeline:
        """One row for each key, over all partitions."""
        return Pipeline(self.df.dropDuplicates(list(keys)))

    def transform(self, step: Callable[[DataFrame], DataFrame]) -> Pipeline:
        """A custom operator."""
        return Pipeline(step(self.df))

    def split(self, unmatched: str = FAIL) -> Split:
        return Split(self.df, _policy(unmatched))

    def route(self, shard: Column) -> Pipeline:
        return self.with_columns(shard=shard)


@dataclass
class Branch:
    name: str
    times: Column  # how often a row goes to this branch
    columns: list[Column | str]


@dataclass
class Split:
    """Sends each row to any number of named branches, each with its own columns."""

    df: DataFrame
    unmatched: str = FAIL
    branches: list[Branch] = field(default_factory=list)

    def add(self, name: str, when: Column, *columns: Column | str, times: Column | None = None) -> Split:
        """A branch for rows that meet `when`, with these columns (all of them by default); `times` (an integer column)
        repeats its rows."""
        if name in ("", "sink") or any(b.name == name for b in self.branches):
            raise ValueError(f"branch name {name!r} is reserved or taken")
        n = F.when(F.coalesce(when, F.lit(False)), times if times is not None else F.lit(1)).otherwise(F.lit(0))
        self.branches.append(Branch(name, n, list(columns) or list(self.df.columns)))
        return self

    def tagged(self) -> DataFrame:
        """All rows with a `branch` column, once for each emission; one pass over the input."""
        names = F.flatten(F.array(*[F.array_repeat(F.lit(b.name), b.times.cast("int")) for b in self.branches]))
        df = self.df.withColumn("_branches", names)
        if self.unmatched == FAIL:
            df = fail_when(df, F.when(F.size("_branches") == 0, F.lit("a row matches no branch")))
        return df.withColumn("branch", F.explode("_branches")).drop("_branches")

    def unrouted(self) -> DataFrame:
        """The rows that no branch takes."""
        return self.df.filter(sum((b.times for b in self.branches), F.lit(0)) == 0)

    def outputs(self) -> dict[str, DataFrame]:
        """A DataFrame for each branch; persist tagged() first if several are written."""
        all_ = self.tagged()
        return {b.name: all_.filter(F.col("branch") == b.name).select(*b.columns) for b in self.branches}

    def write(self, writers: dict[str, Callable[[DataFrame], None]]) -> None:
        """Writes all branches from one persisted pass; an error in any writer leaves the whole batch uncommitted."""
        missing = {b.name for b in self.branches} - writers.keys()
        if missing:
            raise ValueError(f"no writer for {sorted(missing)}")
        held = self.tagged().persist()
        try:
            for b in self.branches:
                writers[b.name](held.filter(F.col("branch") == b.name).select(*b.columns))
        finally:
            held.unpersist()
