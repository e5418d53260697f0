"""Percentiles of very large numeric columns per group, with a stated error, in states that can be combined.

A state is a hierarchy of compactors: level h holds values of weight 2^h. A full level is sorted, and every second value (from a random start) moves up
one level; the rest is dropped. One compaction at level h shifts any rank by at most 2^h, up or down with equal chance, so with m_h
compactions the rank error of any query is sub-Gaussian with variance S = sum(m_h * 4^h). Every state carries its own S; merging adds them. By Hoeffding's
bound a rank is off by more than sqrt(2 * S * ln(2 / delta)) with probability below delta: this is the error stated with every answer.

States are ordinary rows (keys, n, lo, hi, spread, levels), so those of separate days can be kept in a table and merged at any time. Coins of different states,
merges and levels are independent, as the bound needs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.session import materialize

STATE = "n bigint, lo double, hi double, spread double, levels array<array<double>>"


class Compactors:
    """One state. ``k`` values at most stay in the top level; lower levels hold two thirds of the one above, at least ``k / 8``."""

    __slots__ = ("k", "n", "lo", "hi", "spread", "levels", "rng")

    def __init__(self, k: int, seed: int):
        self.k, self.n, self.lo, self.hi, self.spread = k, 0, math.inf, -math.inf, 0.0
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.rng = np.random.default_rng(seed)

    def _room(self, h: int) -> int:
        return max(self.k // 8, 2, math.ceil(self.k * (2 / 3) ** (len(self.levels) - 1 - h)))

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.n += len(values)
            self.lo, self.hi = min(self.lo, float(values.min())), max(self.hi, float(values.max()))
            self.levels[0] = np.concatenate([self.levels[0], values])
            self._compress()

    def merge(self, n: int, lo: float, hi: float, spread: float, levels: Sequence[Sequence[float]]) -> None:
        self.n, self.lo, self.hi, self.spread = self.n + int(n), min(self.lo, lo), max(self.hi, hi), self.spread + spread
        for h, items in enumerate(levels):
            if h == len(self.levels):
                self.levels.append(np.empty(0))
            self.levels[h] = np.concatenate([self.levels[h], np.asarray(items, dtype=float)])
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            items = self.levels[h]
            if len(items) > self._room(h):
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                items = np.sort(items)
                # of an odd number the last one stays, so that the weight of the state is exact
                even = len(items) & ~1
                self.levels[h] = items[even:]
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], items[int(self.rng.integers(2)) : even : 2]])
                self.spread += 4.0**h
            h += 1

    def row(self) -> tuple:
        return self.n, self.lo, self.hi, self.spread, [x.tolist() for x in self.levels]


def _seed(seed: int, *parts: object) -> int:
    return zlib.crc32(repr((seed, *parts)).encode())


def sketch(df: DataFrame, keys: Sequence[Column], names: Sequence[str], value: Column, k: int = 1024, seed: int = 7, held: int = 2_000_000) -> DataFrame:
    """Partial states (``names`` + state columns + ``part``) of the finite values per group; any number of rows per group may come back.

    Runs where the rows are, without a shuffle. A task holds at most ``held`` values: beyond that it emits its states and starts afresh,
    so millions of groups cost rows, not memory. Nulls, NaN and infinities of ``value`` are left out; null keys are a group of their own.
    """
    picked = df.select(*[c.alias(n) for c, n in zip(keys, names)], value.cast("double").alias("__value"))
    finite = picked.filter(F.col("__value").isNotNull() & ~F.isnan("__value") & (F.abs("__value") < float("inf"))).withColumn("__part", F.spark_partition_id())
    schema = T.StructType([*picked.schema.fields[:-1], *T._parse_datatype_string(STATE).fields, T.StructField("part", T.IntegerType())])
    n_keys = len(names)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, Compactors] = {}
        part, room, waiting, rows, begun = 0, 0, [], 0, 0

        def fold() -> None:
            nonlocal room, waiting, rows, begun
            block = pd.concat(waiting, ignore_index=True)
            waiting, rows = [], 0
            for key, values in block.groupby(list(names), dropna=False, sort=False)["__value"] if n_keys else [((), block["__value"])]:
                key = tuple(None if pd.isna(x) else x for x in (key if isinstance(key, tuple) else (key,)))
                state = states.get(key)
                if state is None:
                    # a running number, so that a state begun after an emission throws new coins
                    begun += 1
                    state = states[key] = Compactors(k, _seed(seed, "sketch", part, begun, key))
                before = sum(map(len, state.levels))
                state.add(values.to_numpy())
                room += sum(map(len, state.levels)) - before

        def emit() -> pd.DataFrame:
            nonlocal room
            out = pd.DataFrame([(*key, *s.row(), part) for key, s in states.items()], columns=[f.name for f in schema.fields])
            states.clear()
            room = 0
            return out

        for batch in batches:
            if len(batch):
                part = int(batch["__part"].iloc[0])
                waiting.append(batch)
                rows += len(batch)
                if rows >= 200_000:
                    fold()
                    if room > held:
                        yield emit()
        if waiting:
            fold()
        if states:
            yield emit()

    return finite.mapInPandas(partial, schema)


def merge(states: DataFrame, names: Sequence[str], k: int = 1024, seed: int = 7, fan_in: int = 64) -> DataFrame:
    """One state per group from any number of states (days, partitions, runs), merged level by level in a tree.

    Every state draws a branch from a hash of all it holds; about ``fan_in`` states of a group share one, are merged there one after the other, and go on to a branch of the level
    above. The depth follows from the largest number of states of a group, so no group is ever gathered whole. Every merge throws coins of its own."""
    fields = {f.name: f for f in states.schema.fields}
    # all columns that tell states apart, the day or partition they come from among them
    branch = F.xxhash64(F.lit(seed), *[F.col(c) for c in states.columns])
    # states are few and small; written once, they are not made again for the levels above
    states = materialize(states.select(*names, "n", "lo", "hi", "spread", "levels", branch.alias("branch")), "percentile-states")
    width = math.ceil((states.groupBy(*names).count().agg(F.max("count")).first()[0] or 1) / fan_in)
    schema = T.StructType([*[fields[n] for n in names], *T._parse_datatype_string(STATE).fields, T.StructField("branch", T.LongType())])
    columns = [f.name for f in schema.fields]

    def together(depth: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # rows come ordered by group, so one state is open at a time
            at, state, done = None, None, []
            for pdf in batches:
                heads = list(zip(*[pdf[n] for n in (*names, "branch")]))
                for head, *row in zip(heads, pdf["n"], pdf["lo"], pdf["hi"], pdf["spread"], pdf["levels"]):
                    head = tuple(None if pd.isna(x) else x for x in head)
                    if head != at:
                        if state is not None:
                            done.append((*at[:-1], *state.row(), at[-1]))
                        at, state = head, Compactors(k, _seed(seed, "merge", depth, *names, *map(str, head)))
                    state.merge(*row)
                if len(done) >= 500:
                    yield pd.DataFrame(done, columns=columns)
                    done = []
            if state is not None:
                done.append((*at[:-1], *state.row(), at[-1]))
            if done:
                yield pd.DataFrame(done, columns=columns)

        return run

    step, depth = states.withColumn("branch", F.pmod("branch", F.lit(width))), 0
    while True:
        order = [*names, "branch", F.desc("n"), "lo", "hi", "spread"]
        step = step.repartition(*names, "branch").sortWithinPartitions(*order).mapInPandas(together(depth), schema)
        if width == 1:
            return step.drop("branch")
        width, depth = math.ceil(width / fan_in), depth + 1
        step = step.withColumn("branch", F.pmod("branch", F.lit(width)))


def percentiles(states: DataFrame, names: Sequence[str], at: Sequence[float], delta: float = 0.01) -> DataFrame:
    """Per group of merged states one row per entry of ``at``: ``n_values, min_value, max_value, q, value, rank_error``.

    ``rank_error`` is a share of n: with probability 1 - ``delta`` the rank of the value is within it (and within one position) of the asked rank."""
    fields = {f.name: f for f in states.schema.fields}
    told = "n_values bigint, min_value double, max_value double, q double, value double, rank_error double"
    schema = T.StructType([*[fields[n] for n in names], *T._parse_datatype_string(told).fields])

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, n, lo, hi, spread, levels in zip(zip(*[pdf[c] for c in names]) if names else [()] * len(pdf), pdf["n"], pdf["lo"], pdf["hi"], pdf["spread"], pdf["levels"]):
                items = np.concatenate([np.asarray(x, dtype=float) for x in levels])
                weights = np.concatenate([np.full(len(x), 2**h, dtype=np.int64) for h, x in enumerate(levels)])
                order = np.argsort(items, kind="stable")
                items, upto = items[order], np.cumsum(weights[order])
                error = math.sqrt(2 * spread * math.log(2 / delta)) / n
                for q in at:
                    place = min(len(items) - 1, int(np.searchsorted(upto, max(1, math.ceil(q * n)))))
                    rows.append((*key, n, lo, hi, q, float(items[place]), error))
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return states.select(*names, "n", "lo", "hi", "spread", "levels").mapInPandas(answer, schema)
