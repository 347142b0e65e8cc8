"""Groups of a sorted, keyed stream of Arrow batches; many small groups cost no call to Spark each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def _cuts(table: pa.Table, keys: list[str]) -> list[int]:
    """Row numbers at which a key differs from that of the row before."""
    n = table.num_rows
    if n < 2:
        return []
    changed = None
    for k in keys:
        col = table.column(k).combine_chunks()
        one = pc.not_equal(col.slice(1), col.slice(0, n - 1))
        changed = one if changed is None else pc.or_(changed, one)
    return [int(i) + 1 for i in pc.indices_nonzero(changed).to_pylist()]


def groups(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    held: pa.Table | None = None
    for part in parts:
        if not part.num_rows:
            continue
        held = pa.Table.from_batches([part]) if held is None else pa.concat_tables([held, pa.Table.from_batches([part])])
        at = 0
        for cut in _cuts(held, keys):
            yield held.slice(at, cut - at)
            at = cut
        held = held.slice(at)
    if held is not None and held.num_rows:
        yield held


#: Bytes of an Arrow batch handed to Python, where the session keeps Spark's own default. A batch is held several
#: times over (vectors that double as they grow, the stream, strings of up to four bytes a character).
BATCH_BYTES, SPARK_BYTES = 8 << 20, 64 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over rows with whole texts or sets: the session's batches become BATCH_BYTES unless it named a size."""
    conf = df.sparkSession.conf
    if conf.get(_BYTES).rstrip("b") == str(SPARK_BYTES):
        conf.set(_BYTES, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``fn`` to the rows of each key (non-null columns ``keys``). The caller bounds the groups."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(parts, keys):
            yield from fn(table)

    return map_batches(df.repartition(*keys).sortWithinPartitions(*keys), run, schema)
