"""Structured streams: curve logs, dedup, mixture state, event windows. The event-time windows are an extension of ours."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CURVE = "run string, stage string, step bigint, loss double, elapsed_seconds double, learning_rate double, loss_tokens bigint, validation_loss double, sources map<string,struct<draws:bigint,tokens:bigint,loss:double>>"


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    """A run's points, oldest first, from append-only JSON lines."""
    return spark.read.schema(CURVE).json(path).orderBy("run", "stage", "step")


def curve_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(CURVE).json(path)


def append_curve(points: DataFrame, path: str) -> None:
    points.write.mode("append").json(path)


def source_losses(points: DataFrame) -> DataFrame:
    """Per run and source: draws, tokens and the token-weighted mean loss."""
    rows = points.select("run", F.explode("sources").alias("source", "s"))
    return rows.groupBy("run", "source").agg(F.sum("s.draws").alias("draws"), F.sum("s.tokens").alias("tokens"), F.try_divide(F.sum(F.col("s.loss") * F.col("s.tokens")), F.sum("s.tokens")).alias("loss"))


def dedup_stream(rows: DataFrame, digest: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each digest within the watermark; the state of older digests is dropped."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([digest])


def windowed_counts(events: DataFrame, time: str, size: str, *, slide: str | None = None, delay: str = "10 minutes", group: list[str] | None = None) -> DataFrame:
    """Tumbling or sliding counts; late rows beyond the delay don't count."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, delay).groupBy(window, *(group or [])).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, time: str, gap: str, group: list[str], delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap), *group).agg(F.count(F.lit(1)).alias("n"))


def running_budget(rows: DataFrame, source: str, amount: str, budget: int) -> DataFrame:
    """(source, taken, rows): what each source has used of its budget; the row that crosses it is taken and later ones aren't."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, rows = state.get if state.exists else (0, 0)
        for batch in batches:
            for n in batch[amount]:
                if used < budget:
                    used, rows = used + int(n), rows + 1
        state.update((used, rows))
        yield pd.DataFrame({source: [key[0]], "taken": [used], "rows": [rows]})

    return rows.groupBy(source).applyInPandasWithState(step, f"{source} string, taken bigint, rows bigint", "used bigint, rows bigint", "update", GroupStateTimeout.NoTimeout)


def to_end(counts: DataFrame, folder: str) -> str:
    """Runs a complete-mode aggregation over what its source has now, with its checkpoint and its result in the shared folder; the path of the result. A run that is broken off goes on from the checkpoint."""
    path = f"{folder}/result"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    return path
