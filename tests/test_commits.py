"""Idempotent commits of streams: restarts, repeats in later batches, tables that others wrote, refused bindings."""

import pytest
from pyspark.errors import StreamingQueryException

from reconlake.streaming import views

SCHEMA = "k long, b string, note string"


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "in").mkdir()
    return str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "state")


def arrive(spark, folder, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, table, state, files=1):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)
    query = views.stream_commit(stream, table, state, "k", "b")
    query.awaitTermination()
    return sorted(map(tuple, views.committed(spark, table).collect())), [p["batchId"] for p in query.recentProgress if p["numInputRows"]]


def test_repeats_and_restarts(spark, folders):
    folder, table, state = folders
    arrive(spark, folder, (1, "x", "a"), (2, "y", "a"), (1, "x", "a"))
    arrive(spark, folder, (2, "y", "later"), (3, "z", "b"))
    got, _ = run(spark, folder, *folders[1:])
    assert got == [(1, "x", "a"), (2, "y", "a"), (3, "z", "b")]
    arrive(spark, folder, (1, "x", "again"), (4, "w", "c"))
    got, batches = run(spark, folder, table, state)  # the same state goes on
    assert got == [(1, "x", "a"), (2, "y", "a"), (3, "z", "b"), (4, "w", "c")] and batches
    got, _ = run(spark, folder, table, state + "-new")  # a new state meets every record again, and the table
    assert [r[0] for r in got] == [1, 2, 3, 4]


def test_other_bindings_stop_the_stream(spark, folders):
    folder, table, state = folders
    views.commit_batch(spark.createDataFrame([(7, "old", "n")], SCHEMA), table, "k", "b")
    arrive(spark, folder, (1, "x", "a"), (7, "old", "again"))
    assert [r[:2] for r in run(spark, folder, table, state)[0]] == [(1, "x"), (7, "old")]
    arrive(spark, folder, (1, "other", "a"), (5, "v", "a"))
    for _ in range(2):  # a retry meets the same records and is refused again
        with pytest.raises(StreamingQueryException):
            run(spark, folder, table, state)
    assert [r[:2] for r in sorted(map(tuple, views.committed(spark, table).collect()))] == [(1, "x"), (7, "old")]


def test_binding_of_a_table_row_is_kept(spark, folders):
    folder, table, state = folders
    views.commit_batch(spark.createDataFrame([(7, "old", "n")], SCHEMA), table, "k", "b")
    arrive(spark, folder, (7, "new", "n"))
    with pytest.raises(StreamingQueryException):
        run(spark, folder, table, state)
    assert [tuple(r) for r in views.committed(spark, table).collect()] == [(7, "old", "n")]
