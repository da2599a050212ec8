"""Dealing packed arrays to buckets: numpy arrays travel as binary columns between Arrow stages.

One row stands for one bucket of one chunk, so tens of thousands of hashes move as a few binary values.
A task has several buckets; Spark sorts its rows by bucket (and spills where they are many), so that the
task holds one bucket at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tremor.llm.common import partitions

#: Bytes of text whose hashes are dealt out together.
DEAL_BYTES = 4 << 20
BUCKETS_PER_TASK = 4
#: Bytes of results of small buckets that leave a task together.
SEND_BYTES = 4 << 20


def buckets(spark: SparkSession) -> int:
    return BUCKETS_PER_TASK * partitions(spark)


def batch_of(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def steps(values: np.ndarray) -> bytes:
    """Differences of a nearly sorted array: they compress well on the way."""
    return np.diff(values, prepend=values.dtype.type(0)).astype(values.dtype).tobytes()


def pack_by(bucket: np.ndarray, n_buckets: int, columns: dict[str, np.ndarray], stepped: tuple[str, ...] = ()) -> pa.RecordBatch:
    """One row per bucket that has values: its number and each column's values in their given order."""
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=bucket.dtype))
    some = np.flatnonzero(np.diff(cut))
    out: dict[str, tuple[list, pa.DataType]] = {"bucket": (some.tolist(), pa.int64())}
    for name, values in columns.items():
        values = values[order]
        parts = [values[cut[x] : cut[x + 1]] for x in some]
        out[name] = ([steps(p) if name in stepped else p.tobytes() for p in parts], pa.binary())
    return batch_of(out)


def by_bucket(df: DataFrame, column: str, arrays: dict[str, str], work: Callable[..., Iterator[pa.RecordBatch]], schema: str, sums: tuple[str, ...] = (), finish: Callable | None = None) -> DataFrame:
    """Deal ``df`` by ``column`` and call ``work(bucket, {name: array})`` on each whole bucket.

    ``arrays`` names the binary columns and their numpy types; chunks of a bucket are joined.
    Columns named in ``sums`` hold the differences of their values (see ``steps``).
    With ``finish``, ``work`` returns a tuple of arrays instead; those of neighbouring buckets are joined
    and given to ``finish`` together, so that few rows go out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, done = None, {name: [] for name in arrays}, []

        def close() -> Iterator[pa.RecordBatch]:
            whole = {name: np.concatenate([np.frombuffer(x, kind) if name not in sums else np.cumsum(np.frombuffer(x, kind), dtype=kind) for x in parts[name]]) for name, kind in arrays.items()}
            for held in parts.values():
                held.clear()
            out = work(at, whole)
            if not finish:
                yield from out
                return
            done.append(out)
            if sum(x.nbytes for d in done for x in d) >= SEND_BYTES:
                yield finish(*map(np.concatenate, zip(*done)))
                done.clear()

        for batch in batches:
            columns = {name: batch.column(name) for name in arrays}
            for i, b in enumerate(batch.column(column).to_pylist()):
                if b != at and at is not None:
                    yield from close()
                at = b
                for name, values in columns.items():
                    parts[name].append(values[i].as_py() or b"")
        if at is not None:
            yield from close()
        if done:
            yield finish(*map(np.concatenate, zip(*done)))

    return df.select(column, *arrays).repartition(partitions(df.sparkSession), column).sortWithinPartitions(column).mapInArrow(run, schema)
