"""The report channel: stream and batch agree, and a repeated epoch leaves no row twice."""

import pytest

from textlots.operators import reports
from textlots.plans import inputs
from textlots.streaming import epochs
from textlots.streaming import reports as stream


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_stream_equals_batch(spark, small, tmp_path):
    source = inputs.report_source(spark, small)
    query = stream.start_triage(source, str(tmp_path / "t"), str(tmp_path / "c"), available_now=True)
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == rows(reports.submit(inputs.reports(spark, small)))


def test_table_of_several_files_is_streamed_whole(spark, small, tmp_path):
    folder = tmp_path / "tables"
    spark.read.parquet(f"{small}/conversations.parquet").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    source = inputs.report_source(spark, str(folder))
    tables = {name: str(tmp_path / name) for name in stream.ROUTES}
    stream.start_routes(source, tables, str(tmp_path / "c1"), available_now=True).awaitTermination()
    stream.start_triage(source, str(tmp_path / "t"), str(tmp_path / "c2"), available_now=True).awaitTermination()
    batch = reports.submit(inputs.reports(spark, small))
    assert rows(epochs.read_epochs(spark, tables["tracker"])) == rows(reports.tracker_rows(batch))
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == rows(batch)


def test_routes_hold_each_report_once_even_after_a_restart(spark, small, tmp_path):
    tables = {name: str(tmp_path / name) for name in stream.ROUTES}
    for checkpoint in ("c1", "c2"):
        # A lost checkpoint makes the second run write epoch 0 again.
        source = inputs.report_source(spark, small)
        stream.start_routes(source, tables, str(tmp_path / checkpoint), available_now=True).awaitTermination()
    batch = reports.submit(inputs.reports(spark, small))
    tracked = epochs.read_epochs(spark, tables["tracker"])
    assert rows(tracked) == rows(reports.tracker_rows(batch))
    alerts = epochs.read_epochs(spark, tables["alerts"])
    assert alerts.count() == batch.where("severidad = 'critica'").count()
    refused = epochs.read_epochs(spark, tables["rejected"])
    assert refused.count() == inputs.reports(spark, small).count() - batch.count() > 0
    assert epochs.read_epochs(spark, tables["outbox"]).count() == batch.where("email like '%@%'").count()


def numbers(df):
    return sorted(r.id for r in df.collect())


def test_epochs_replace_themselves_and_are_compacted(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(ValueError, match="no epoch"):
        epochs.read_epochs(spark, path)
    for epoch in range(3):
        epochs.write_epoch(spark.range(10 * epoch, 10 * epoch + 3), path, epoch)
    assert numbers(epochs.read_epochs(spark, path)) == [0, 1, 2, 10, 11, 12, 20, 21, 22]
    held = epochs.read_epochs(spark, path)
    # Epoch 2 is run again with more rows; a run that failed before its commit is not seen.
    epochs.write_epoch(spark.range(20, 25), path, 2)
    spark.range(900, 910).write.parquet(f"{path}/parts/lost")
    now = [0, 1, 2, 10, 11, 12, 20, 21, 22, 23, 24]
    assert numbers(epochs.read_epochs(spark, path)) == now and len(numbers(held)) == 9
    epochs.compact(spark, path)
    assert numbers(epochs.read_epochs(spark, path)) == now
    assert len(epochs._newest(epochs._log(spark, path))[1]) == 1
    # Closed epochs are there already; later ones go on, and are compacted with the rest.
    epochs.write_epoch(spark.range(20, 25), path, 2)
    epochs.write_epoch(spark.range(30, 31), path, 3)
    epochs.write_epoch(spark.range(0), path, 4)
    assert numbers(epochs.read_epochs(spark, path)) == [*now, 30]
    epochs.compact(spark, path)
    epochs.compact(spark, path)
    assert numbers(epochs.read_epochs(spark, path)) == [*now, 30]
    assert epochs.read_epochs(spark, path).inputFiles() != [] and epochs._newest(epochs._log(spark, path))[0] == 4


def counted(spark, path):
    return sorted(map(tuple, epochs.epoch_counts(spark, path).collect()))


def test_epochs_count_their_rows(spark, tmp_path):
    path = str(tmp_path / "table")
    epochs.write_epoch(spark.range(7), path, 0)
    epochs.write_epoch(spark.range(0), path, 1)
    # Known to be empty only after a shuffle.
    epochs.write_epoch(spark.range(9).where("id > 20").groupBy("id").count().select("id"), path, 2)
    epochs.write_epoch(spark.range(5), path, 0)
    assert counted(spark, path) == [(0, 5), (1, 0), (2, 0)]
    epochs.compact(spark, path)
    epochs.write_epoch(spark.range(90), path, 1)  # closed: already there
    epochs.write_epoch(spark.range(3), path, 3)
    assert counted(spark, path) == [(0, 5), (1, 0), (2, 0), (3, 3)]


def test_listener_receives_the_rows_of_each_stage(spark, small, tmp_path):
    import time

    from textlots.streaming.metrics import EpochCounts

    listener = EpochCounts(keep=2)
    spark.streams.addListener(listener)
    try:
        source = inputs.report_source(spark, small)
        stream.start_triage(source, str(tmp_path / "t"), str(tmp_path / "c"), available_now=True).awaitTermination()
        until = time.time() + 30
        while not listener.counts and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    batch = reports.submit(inputs.reports(spark, small))
    kept = batch.count()
    (found,) = listener.counts.values()
    assert found["reports_read"]["n_rows"] == inputs.reports(spark, small).count() > kept
    assert found["reports_kept"] == {"n_rows": kept, "n_critical": batch.where("severidad = 'critica'").count()}
