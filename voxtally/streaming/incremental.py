"""The analysis over files that keep arriving.

The analysis of a row depends on that row and on static look-up tables, so the
batch plan runs unchanged on a streaming DataFrame and needs no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from voxtally.plans.analyze import analyze


def append_results(conversations: DataFrame, path: str, checkpoint: str, profile, **options) -> StreamingQuery:
    """Analyse everything that has arrived since the last run and append it to ``path``.

    ``conversations`` comes from ``spark.readStream``; ``options`` go to ``analyze``.
    """
    return (
        analyze(conversations, profile, **options)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
