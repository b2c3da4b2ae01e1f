"""The estimators of ``operators.recurrence`` over streams: one state per series, kept by Spark between batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.operators.positions import with_positions
from tracklane.operators.recurrence import Kernel
from tracklane.session import cut


def _advance(key: tuple, pdfs: Iterator[pd.DataFrame], state: Any, kernel: Kernel, order: list[str], columns: list[str], names: list[str]) -> Iterator[pd.DataFrame]:
    step = kernel(state=pickle.loads(state.get[0])) if state.exists else kernel()
    t = pd.concat(list(pdfs)).sort_values(order, kind="stable")  # what arrived of one series in one batch, which the caller bounds
    rows = [step(r) for r in t.itertuples(index=False)]
    state.update((pickle.dumps(step.state),))
    yield pd.concat([t.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)[columns]


def stream_sequential(df: DataFrame, keys: list[str], order: list[str], kernel: Kernel, results: str) -> DataFrame:
    """``sequential`` for a stream whose batches come in order of time; inside a batch rows are sorted.

    What one batch brings of a series is sorted in memory, so batches must be bounded
    (files per trigger, rows per trigger; ``time_slices`` for a stored table). Late rows
    that belong before an earlier batch must have been held back or dropped upstream: a
    filter cannot take a step back.
    """
    names = [x.split()[0] for x in results.split(",")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + results
    fn = partial(_advance, kernel=kernel, order=order, columns=[*df.columns, *names], names=names)
    return df.groupBy(*keys).applyInPandasWithState(_named(fn), schema, "state binary", "append", "NoTimeout")


def time_slices(df: DataFrame, keys: list[str], order: list[str], bucket: Column, rows: int = 100_000) -> Iterator[DataFrame]:
    """A stored table in stretches of the order, each with at most ``rows`` rows of any series: what to feed a stream one after the other."""
    placed = cut(with_positions(df, keys, order, bucket).withColumn("_slice", F.floor(F.col("pos") / rows)))
    last = placed.agg(F.max("_slice")).first()[0]
    for k in range(0 if last is None else last + 1):
        yield placed.filter(F.col("_slice") == k).drop("pos", "_slice")


def _named(fn: partial):
    """Spark looks at the signature, so the rest is bound in a plain function."""

    def advance(key, pdfs, state):
        yield from fn(key, pdfs, state)

    return advance
