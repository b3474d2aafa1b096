"""Classification of reads as they arrive.

A read's k-mers and hits belong to that read alone, so each micro-batch is classified by
the batch plan against the static index and no state is kept between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators.classify import classify
from tessera.operators.index import Index
from tessera.plans.shared import scratch


def classify_stream(reads: DataFrame, index: Index, out: str, checkpoint: str, exponent: int = 12, trials: int = 100, **trigger):
    """Starts a query that appends ``(flag, read_id, taxid, file, batch)`` as Parquet to ``out``.

    A batch that is run again after a failure replaces its own part of the output, and the
    tables of a batch are deleted at its end.
    """

    def each(batch: DataFrame, number: int) -> None:
        with scratch():
            classify(batch, index, exponent, trials).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
