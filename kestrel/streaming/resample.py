"""Watermarked, incremental version of ``operators.resample.resample_agg``.

Bins are tumbling event-time windows; a bin is emitted once the watermark has
passed its end (append mode), so late rows up to ``lateness`` are still
counted. Differences from the batch operator: bins without any row never
appear (a stream has no first/last row to span), and the median is Spark's
streaming-capable exact ``percentile`` kept in the state store per bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resample import freq_interval

_AGG = {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp,
        "median": lambda c: F.percentile(c, 0.5)}


def resample_agg_stream(stream: DataFrame, time_col: str, freq: str, cols, funcs=("mean", "max"),
                        group_col: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Streaming (group, bin start, {col}_{func}...) aggregate with a watermark."""
    keys = [group_col] if group_col else []
    # watermarks need an instant (TIMESTAMP); zone-less times are read as UTC
    in_type = stream.schema[time_col].dataType
    et = F.to_utc_timestamp(F.col(time_col).cast("timestamp"), F.current_timezone()) \
        if in_type.typeName() == "timestamp_ntz" else F.col(time_col)
    s = stream.withColumn("_et", et).withWatermark("_et", lateness)
    w = F.window(F.col("_et"), freq_interval(freq))
    agg = s.groupBy(*keys, w.alias("_w")).agg(*[_AGG[f](F.col(c).cast("double")).alias(f"{c}_{f}")
                                                for c in cols for f in funcs])
    start = F.col("_w.start")
    if in_type.typeName() == "timestamp_ntz":
        start = F.from_utc_timestamp(start, F.current_timezone()).cast("timestamp_ntz")
    return agg.select(*keys, start.alias(time_col), *[f"{c}_{f}" for c in cols for f in funcs])


def run_once(agg: DataFrame, path: str, checkpoint: str):
    """Process everything available (trigger availableNow), appending parquet
    files under ``path``; the checkpoint makes the job restartable."""
    q = (agg.writeStream.outputMode("append").format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
