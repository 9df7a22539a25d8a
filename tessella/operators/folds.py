"""Ordered folds over the rows of a key, one pass and bounded memory.

What happens to a row can depend on what happened to the rows before it, which
no window expresses.  Rows are dealt by key and sorted within a task; a worker
reads them batch by batch and keeps nothing but the state of the current key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Step = Callable[..., tuple]


def placed(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...], name: str = "_place") -> DataFrame:
    """rows with ``name``, their place in their key from 1, each key whole in a task and in order.

    Where rows lie by their key, or by a part of it, they are not shuffled
    again.  They are in order only as long as the place is read.  Without an
    order the rows of a key come as they are.
    """
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order or (F.lit(0),))))


def ordered_fold(rows: DataFrame, *, key: tuple[str, ...], order: tuple[str, ...], reads: tuple[str, ...], fresh: Callable[[], Step], adds: str, parts: int | None = None) -> DataFrame:
    """rows with the columns ``adds`` (DDL) that a step function gives for each row.

    ``fresh`` makes the step of a new key; a step takes the values of ``reads``
    and returns those of ``adds``.  ``parts`` tasks are used if it is given, else
    as many as the rows' bytes ask for.
    """
    names = [x.split()[0] for x in adds.split(", ")]
    place = {c: rows.columns.index(c) for c in (*key, *reads)}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step = object(), None
        for batch in batches:
            keys = zip(*(batch.column(place[c]).to_pylist() for c in key), strict=True)
            values = zip(*(batch.column(place[c]).to_pylist() for c in reads), strict=True)
            out = []
            for k, v in zip(keys, values, strict=True):
                if k != at:
                    at, step = k, fresh()
                out.append(step(*v))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            made = pa.RecordBatch.from_arrays([pa.array(c, types[n]) for c, n in zip(columns, names, strict=True)], names=names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.columns], names=[*batch.schema.names, *names])

    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    types = {x.split()[0]: kinds[x.split()[1]] for x in adds.split(", ")}
    return rows.repartition(*([parts] if parts else []), *key).sortWithinPartitions(*key, *order).mapInArrow(run, f"{schema}, {adds}")


def whole_keys(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows sorted by key as tables that hold each key whole, with where each key starts and stops; many keys at a time."""
    held, last = [], None

    def table() -> tuple[pa.Table, list[tuple[int, int]]]:
        whole = pa.Table.from_batches(held)
        keys = list(zip(*(whole.column(c).to_pylist() for c in key), strict=True))
        starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
        return whole, list(zip(starts, [*starts[1:], len(keys)], strict=True))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
        start = len(keys) - 1
        while start and keys[start - 1] == keys[-1]:
            start -= 1
        if start or keys[-1] != last:
            held += [batch.slice(0, start)] if start else []
            if held:
                yield table()
            held, last = [batch.slice(start)], keys[-1]
        else:
            held.append(batch)
    if held:
        yield table()


def whole_places(batches: Iterator[pa.RecordBatch], least: int = 20_000, name: str = "_place") -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of ``placed`` as tables of at least so many that hold each key whole, with whether a row is the first of its key."""
    held, size = [], 0

    def table() -> tuple[pa.Table, np.ndarray]:
        whole = pa.Table.from_batches(held)
        return whole, whole.column(name).to_numpy() == 1

    for batch in batches:
        starts = np.flatnonzero(batch.column(batch.schema.get_field_index(name)).to_numpy() == 1) if size + batch.num_rows > least else ()
        if len(starts) and size + starts[-1]:
            held.append(batch.slice(0, starts[-1]))
            yield table()
            held, size = [batch.slice(starts[-1])], batch.num_rows - int(starts[-1])
        elif batch.num_rows:
            held.append(batch)
            size += batch.num_rows
    if held:
        yield table()
