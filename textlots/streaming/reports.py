"""The report channel as a stream: validate, triage and route each report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textlots.operators.reports import alert_text, compose_reply, rejected_reports, submit, tracker_rows
from textlots.streaming.epochs import write_epoch

ROUTES = ("alerts", "tracker", "outbox", "rejected")


def report_stream(reports: DataFrame, source: str = "web") -> DataFrame:
    """Good reports with their triage. Stateless, so it serves streams and batches alike."""
    return submit(reports, source)


def route(triaged: DataFrame, name: str, brand: str) -> DataFrame:
    """Rows of one target table: critical alerts, all tracker rows, or replies to send."""
    if name == "alerts":
        critical = alert_text(triaged.where(F.col("severidad") == "critica"), brand)
        return critical.select("report_id", "timestamp", "mail_subject", "alert_text")
    if name == "tracker":
        return tracker_rows(triaged)
    replies = compose_reply(triaged, brand).where(F.col("tiene_email"))
    return replies.select("report_id", "email_usuario", "asunto_auto", "cuerpo_texto", "auto_reply_estado")


def start_routes(
    reports: DataFrame,
    tables: Mapping[str, str],
    checkpoint: str,
    brand: str = "Soporte",
    source: str = "web",
    available_now: bool = False,
    interval: str = "5 minutes",
) -> StreamingQuery:
    """Start the routing job. ``tables`` maps alerts, tracker, outbox and rejected to folders.

    Each table is read with ``epochs.read_epochs``: a micro-batch that is run again after a
    failure takes the place of its first run in one step. Refused reports go to ``rejected``
    with their reason. Every trigger leaves a file per table; ``epochs.compact`` puts them
    together, while the job runs.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            good = report_stream(batch, source)
            for name in ROUTES:
                rows = rejected_reports(batch) if name == "rejected" else route(good, name, brand)
                write_epoch(rows, tables[name], epoch)
        finally:
            batch.unpersist()

    writer = reports.writeStream.foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def start_triage(
    reports: DataFrame, path: str, checkpoint: str, source: str = "web", available_now: bool = False
) -> StreamingQuery:
    """Append triaged reports to a Parquet table. ``metrics.EpochCounts`` receives the rows at each stage."""
    read = reports.observe("reports_read", F.count("*").alias("n_rows"))
    kept = report_stream(read, source).observe(
        "reports_kept", F.count("*").alias("n_rows"), F.count_if(F.col("severidad") == "critica").alias("n_critical")
    )
    writer = kept.writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint).option("path", path)
    trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    return writer.trigger(**trigger).start()
