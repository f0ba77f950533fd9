"""Ordered state machines. A fold runs over each key's rows in order and gives a row per command.

Rows are dealt by key and sorted within their partition; the fold reads the sorted stream and holds nothing but one
key's state, however long its history. Machines are step functions (state, row) -> (state, result)."""

from collections import namedtuple
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestream.shipping import ship_package


def ordered_fold(df: DataFrame, key: str, order: str, step: Callable, schema: str) -> DataFrame:
    """(key, order, results of ``step``) of all rows. ``schema``: names and types of the results."""
    kept, columns = [key, order], df.columns
    at = columns.index(key)
    types = dict(df.dtypes)
    result_type = T._parse_datatype_string(", ".join([f"{c} {types[c]}" for c in kept] + [schema]))
    arrow = to_arrow_schema(result_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of = namedtuple("row_of", columns)
        held, state = object(), None
        for batch in batches:
            results = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if values[at] != held:
                    held, state = values[at], None
                state, result = step(state, row_of._make(values))
                results.append(result)
            own = list(zip(*results, strict=True)) or [()] * (len(arrow) - 2)
            arrays = [batch.column(columns.index(c)) for c in kept] + [pa.array(x, f.type) for x, f in zip(own, list(arrow)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    ship_package(df.sparkSession)
    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, result_type)


def lock_step(state, row):
    """acquire (click), release (view), status (others): ok and the holder after the command (-1: free)."""
    holder = -1 if state is None else state
    if row.op == "click":
        ok = holder in (-1, row.owner)
        holder = row.owner if ok else holder
    elif row.op == "view":
        ok = holder == row.owner
        holder = -1 if ok else holder
    else:
        ok = holder != -1
    return holder, (ok, holder)


def cas_step(state, row):
    """set (click), delete (view), compare-and-swap from the command's owner to its value (purchase), get (others).
    The state is the value, or None for a missing key, which compares equal to an owner divisible by three."""
    value, op = state, row.op
    ok = True
    if op == "click":
        value = row.owner
    elif op == "view":
        ok, value = value is not None, None
    elif op == "purchase":
        ok = value == (None if row.owner % 3 == 0 else row.owner)
        value = row.value if ok else value
    else:
        ok = value is not None
    return value, (ok, -1 if value is None else int(value))


def election_step(state, row):
    """campaign (click), resign (view), heartbeat (purchase), get (others): ok, leader (-1: none), term."""
    leader, term = state or (-1, 0)
    if row.op == "click":
        ok = leader == -1
        leader, term = (row.owner, term + 1) if ok else (leader, term)
    elif row.op == "view":
        ok = leader == row.owner
        leader = -1 if ok else leader
    else:
        ok = leader == row.owner if row.op == "purchase" else leader != -1
    return (leader, term), (ok, leader, term)


CLOSED, OPEN, HALF = 0, 1, 2


def breaker_step(state, row, threshold: int = 2, recovery: int = 3600, trials: int = 2):
    """A circuit breaker over outcomes (an error is a failure): whether the call is let through, and the state after."""
    mode, failures, opened, successes = state or (CLOSED, 0, 0, 0)
    if mode == OPEN and row.t - opened >= recovery:
        mode, successes = HALF, 0
    allowed = mode != OPEN
    if allowed:
        if row.op == "error":
            failures += 1
            if mode == HALF or failures >= threshold:
                mode, opened = OPEN, row.t
        elif mode == HALF:
            successes += 1
            if successes >= trials:
                mode, failures = CLOSED, 0
        else:
            failures = 0
    return (mode, failures, opened, successes), (allowed, mode)


def limiter_step(state, row, most: int = 3, window: int = 7200):
    """A sliding-window limiter: a request passes if fewer than ``most`` passed within the window; only those count."""
    passed = [t for t in state or [] if t > row.t - window]
    allowed = len(passed) < most
    return (passed + [row.t] if allowed else passed), (allowed, len(passed))


def ewma_step(state, row, weight: float = 0.1):
    """Smoothed round trip and its deviation (from the old estimate), and the timeout they give."""
    if state is None:
        estimate, deviation = float(row.value), row.value / 2
    else:
        estimate, deviation = state
        deviation = (1 - weight) * deviation + weight * abs(row.value - estimate)
        estimate = (1 - weight) * estimate + weight * row.value
    return (estimate, deviation), (estimate, deviation, estimate + 4 * deviation)


def memtable_step(state, row, size: int = 5):
    """A memtable of ``size`` keys: the run that a write goes to; a new key that no longer fits starts the next run."""
    keys, run = state or (frozenset(), 0)
    if row.owner not in keys and len(keys) == size:
        keys, run = frozenset(), run + 1
    return (keys | {row.owner}, run), (run,)
