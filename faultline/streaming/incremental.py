"""Work orders that keep arriving: the same phases per micro-batch, one shared ledger."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from faultline.operators.dictionary import long_entries
from faultline.plans.full import Run, branches, finish, run_codes, run_labels, with_codes
from faultline.sources.scratch import folder_names
from faultline.sources.tables import map_columns


def label_stream(
    run: Run, arriving: DataFrame, taxonomy: DataFrame, dictionary: DataFrame, available_now: bool = True
) -> StreamingQuery:
    """Labels each micro-batch with a given dictionary into `<folder>/labelled/batch=<n>`.

    The taxonomy is ordered and a branch's text built once for all batches, and kept for later streams of the same folder.
    A batch is logged beside the stream's own progress once its folder is written: one that is handed over again after
    that does nothing, and one that failed before overwrites its folder and finds its answers in the ledger, so nothing
    is asked or written twice. A batch without rows writes a folder without rows.
    """

    long = run.table("dictionary_long", long_entries(dictionary))
    tree = branches(run, taxonomy)
    progress = f"{run.folder}/stream"

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log = f"{progress}/labelled/{number}"
        if "_SUCCESS" in folder_names(spark, log):
            return
        part = replace(run, name=f"{run.name}-{number}", batches=[], asked=[])
        rows, coded = run_codes(part, map_columns(batch, run.config.columns), tree)
        labelled = run_labels(part, with_codes(part, rows, coded), long)
        finish(rows, coded, labelled, run.config).write.mode("overwrite").parquet(
            f"{run.folder}/labelled/batch={number}")
        spark.range(1).write.mode("overwrite").parquet(log)

    writer = arriving.writeStream.foreachBatch(handle).option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
