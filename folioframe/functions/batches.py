"""Passes over documents in small pieces: what a worker holds depends on a piece of text or one document, not on the batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHUNK_BYTES = 1 << 20
#: Batches beyond this have the memory of those before them given back.
RELEASE_BYTES = 4 << 20
#: Documents of a piece, whose results are kept together, are at most so long, or one.
DOCUMENT_BYTES = 1 << 18
#: Text of which the results are large, beyond this, have memory given back.
SPENT_BYTES = 4 << 20
SPREAD = 4

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None


def release() -> None:
    """Give back to the system what Arrow and the C library keep of memory that is free again; workers live from one stage to
    the next, and beside a JVM each."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut at rows so that each piece holds about limit bytes of text, or a single row."""
    # what the stage before has left in this worker
    release()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, min(at + 32768, int(np.searchsorted(size, base + limit, "right"))))
            yield batch.slice(at, to - at)
            if at == 0 and batch.nbytes > RELEASE_BYTES:
                # by now the caller has let go of the batch before
                release()
            at = to
        del batch, col, size
    release()


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is read in fewer parts than there are: a few files of short rows hold hours of work. What comes
    from a shuffle has been laid out by Spark, and a stream by its source."""
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution()
    if plan.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(SPREAD * cores) if plan.toRdd().getNumPartitions() < cores else df


def per_row(docs: DataFrame, content: str, added: str, start: Callable[[], Callable[[str | None], tuple]]) -> DataFrame:
    """docs without content, with added columns (DDL), which the function that start makes, once a worker, gives for a text."""
    kept = [f for f in docs.schema.fields if f.name != content]
    names = [f.name for f in kept]
    schema = StructType(kept + StructType.fromDDL(added).fields)
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, spent = start(), 0
        for piece in pieces(batches, content, DOCUMENT_BYTES):
            texts = piece.column(piece.schema.get_field_index(content))
            rows = [one(x.as_py()) for x in texts]
            spent += texts.nbytes
            made = [pa.array([r[i] for r in rows], kinds.field(len(names) + i).type) for i in range(len(kinds) - len(names))]
            del rows
            yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index(n)) for n in names] + made, names=kinds.names)
            del made
            if spent > SPENT_BYTES:
                spent = 0
                release()

    return spread(docs).mapInArrow(run, schema)


def per_document(docs: DataFrame, content: str, added: str, start: Callable[[], Callable[[str], tuple]], failed: tuple) -> DataFrame:
    """The same with parse_error: a null text counts as empty, one that raises gets failed and its error."""

    def safe():
        one = start()

        def row(x: str | None) -> tuple:
            try:
                return (*one(x or ""), None)
            except Exception as e:  # noqa: BLE001
                return (*failed, f"{type(e).__name__}: {e}")

        return row

    return per_row(docs, content, f"{added}, parse_error string", safe)


def each(df: DataFrame, text: str, **made: tuple[Callable[[str], object], str]) -> DataFrame:
    """df without text, with functions of it, each with the type of its column; null stays null."""
    functions = [f for f, _ in made.values()]
    start = lambda: lambda x: tuple(None if x is None else f(x) for f in functions)
    return per_row(df, text, ", ".join(f"`{name}` {kind}" for name, (_, kind) in made.items()), start)
