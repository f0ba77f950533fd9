"""State machines over streams: the step functions of the batch folds, with their state kept by Spark between batches."""

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from lodestream.shipping import ship_package


def fold_stream(events: DataFrame, key: str, order: str, step: Callable, schema: str) -> DataFrame:
    """(key, order, results of ``step``) of a stream. Rows of a micro-batch are taken in order within their key; rows
    must not arrive in a later batch than rows that follow them."""
    ship_package(events.sparkSession)
    names = [x.split()[0] for x in schema.split(",")]
    types = dict(events.dtypes)

    def run(_, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = pickle.loads(held.get[0]) if held.exists else None  # written below, by this code
        out = []
        for row in pd.concat(list(batches)).sort_values(order, kind="stable").itertuples(index=False):
            state, result = step(state, row)
            out.append((getattr(row, key), getattr(row, order), *result))
        held.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=[key, order, *names])

    return events.groupBy(key).applyInPandasWithState(run, f"{key} {types[key]}, {order} {types[order]}, {schema}", "state binary", "append", GroupStateTimeout.NoTimeout)
