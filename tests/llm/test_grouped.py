"""Batches handed to Python are bounded by bytes, and cutting them changes no result."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import grouped
from loomgraph.llm.shared import numbered


@pytest.fixture
def size_of_batches(spark):
    before = spark.conf.get(grouped._BYTES)
    yield lambda value: spark.conf.set(grouped._BYTES, value)
    spark.conf.set(grouped._BYTES, before)


def test_default_size_is_lowered_and_a_named_one_stays(spark, size_of_batches):
    def largest(parts):
        yield pa.RecordBatch.from_arrays([pa.array([max((p.nbytes for p in parts), default=0)])], ["size"])

    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 8000).alias("text"))
    size_of_batches(f"{grouped.SPARK_BYTES}b")
    assert 1 << 20 < grouped.map_batches(rows, largest, "size long").first()[0] < grouped.BATCH_BYTES + (1 << 16)
    size_of_batches("1048576")
    assert grouped.map_batches(rows, largest, "size long").first()[0] < (1 << 20) + (1 << 16)


def test_groups_span_batches(spark, size_of_batches):
    size_of_batches("4096")
    rows = spark.range(2000).select((F.col("id") % 7).alias("k"), F.repeat(F.lit("y"), 50).alias("text"))

    def count(table):
        yield pa.RecordBatch.from_arrays([table.column("k").slice(0, 1).combine_chunks(), pa.array([table.num_rows])], ["k", "n"])

    got = {r.k: r.n for r in grouped.map_groups(rows, ["k"], count, "k long, n long").collect()}
    assert got == {k: len(range(k, 2000, 7)) for k in range(7)}


def test_numbers_of_rows_stay_and_differ(spark, tmp_path):
    path = "file://" + str(tmp_path / "rows")
    spark.range(1000).selectExpr("id % 7 as row_0", "id").repartition(5).write.parquet(path)
    read = spark.read.parquet(path)
    for frame in (read, read.where("id >= 0"), spark.range(1000).selectExpr("id % 7 as row_0", "id")):
        rows, name = numbered(frame)
        assert name == "row_1" and rows.columns == ["row_0", "id", "row_1"]
        once = {r.id: r.row_1 for r in rows.collect()}
        again = {r.id: r.row_1 for r in rows.repartition(3).collect()}
        assert once == again and len(once) == len(set(once.values())) == 1000
    assert "_metadata" not in read.columns
