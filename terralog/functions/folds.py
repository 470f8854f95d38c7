"""User-defined operators and folds.

An operator is a plain function ``(df, **spec) -> df`` under a name. A fold is ``init, apply, view``
over the ordered log of one key; it is the way to run sequential logic no window can express.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPERATORS: dict[str, Callable[..., DataFrame]] = {}


def operator(name: str):
    """Register a DataFrame operator."""
    def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        OPERATORS[name] = fn
        return fn
    return wrap


def run(name: str, df: DataFrame, view: str | None = None, **spec: Any) -> DataFrame:
    """Run a registered operator; ``view`` makes the result readable from SQL."""
    out = OPERATORS[name](df, **spec)
    if view:
        out.createOrReplaceTempView(view)
    return out


def numeric(fn: Callable[[pd.Series], pd.Series]) -> Callable[..., Column]:
    """A vectorised numeric function as a column function."""
    from pyspark.sql import types as T

    def series(v: pd.Series) -> pd.Series:
        return fn(v).astype("float64")
    series.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return F.pandas_udf(series, T.DoubleType())


@dataclass(frozen=True)
class Fold:
    key: str
    order: str
    init: Callable[[], dict]
    apply: Callable[[dict, Any], dict]
    view: Callable[[dict], dict]
    schema: str                         # of the view, without the key
    state_version: int = 1


def run_fold(events: DataFrame, fold: Fold) -> DataFrame:
    """One view row per key.

    Keys are hashed to partitions and sorted there; a partition streams through Arrow batches and
    only the state of the current key is held, so the length of a log does not bound memory.
    A fold is sequential by nature; logs that must be split go through ``plans.running``.
    """
    key, order, init, step, view = fold.key, fold.order, fold.init, fold.apply, fold.view
    ordered = events.repartition(F.col(key)).sortWithinPartitions(key, order)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for frame in frames:
            done = []
            for row in frame.itertuples(index=False):
                k = getattr(row, key)
                if state is None or k != current:
                    if state is not None:
                        done.append({key: current, **view(state)})
                    current, state = k, init()
                state = step(state, row)
            if done:
                yield pd.DataFrame(done)
        if state is not None:
            yield pd.DataFrame([{key: current, **view(state)}])
    kind = dict(events.dtypes)[key]
    return ordered.mapInPandas(batches, f"{key} {kind}, {fold.schema}")


def register_fold(spark: SparkSession, name: str, fold: Fold, key_type: str = "bigint") -> None:
    """Make a fold a table-valued function: ``SELECT * FROM name(TABLE(events) PARTITION BY key ORDER BY order)``, one view row per key.

    Spark partitions and sorts; the function sees one key's rows after another and holds its state only.
    """
    columns = [c.split()[0] for c in fold.schema.split(", ")]
    key, init, step, view = fold.key, fold.init, fold.apply, fold.view

    class Folded:
        def __init__(self):
            self.key, self.state = None, None

        def eval(self, row: Row):
            if self.state is None:
                self.key, self.state = row[key], init()
            self.state = step(self.state, row)

        def terminate(self):
            if self.state is not None:
                told = view(self.state)
                yield (self.key, *(told[c] for c in columns))
    spark.udtf.register(name, F.udtf(Folded, returnType=f"{key} {key_type}, {fold.schema}"))


def fold_stream(stream: DataFrame, fold: Fold) -> DataFrame:
    """Streaming twin: the state of each key survives between batches; emits the newest view.

    Rows of a key are in order within a trigger; a row that arrives in a later trigger than its successors is folded when it comes.
    """
    key, order, init, step, view = fold.key, fold.order, fold.init, fold.apply, fold.view

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = json.loads(state.get[0]) if state.exists else init()
        # a key's rows of one trigger come in several frames: order holds across them, so they are put together first
        for row in pd.concat(list(frames)).sort_values(order).itertuples(index=False):
            value = step(value, row)
        state.update((json.dumps(value),))
        yield pd.DataFrame([{key: k[0], **view(value)}])
    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, {fold.schema}", "state string", "update", GroupStateTimeout.NoTimeout)
