"""Resumable runs (S12, E14): only open examples are processed, results are appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.evaluate import is_rate_limit
from threadloom.session import cut_lineage
from threadloom.sources.writers import completed_ids


def pending(inputs: DataFrame, done: DataFrame | None, key: str = "example_id") -> DataFrame:
    """Inputs without a finished result."""
    if done is None:
        return inputs
    return inputs.join(done.select(key), key, "left_anti")


def storable(results: DataFrame) -> DataFrame:
    """Rate-limited rows are tried again later; other errors are results."""
    return results.where(~is_rate_limit("api_error"))


def append_results(
    inputs: DataFrame,
    process: Callable[[DataFrame], DataFrame],
    path: str,
    key: str = "example_id",
) -> DataFrame:
    """Process what is open, append what may be stored, and return the keys of the rest.

    What is stored already is left out first, so a rerun adds no row twice, whether
    an earlier append was finished, cut short, or not seen by the caller. Results are
    written down once before they are split, so no input is processed twice in a run.
    """
    done = completed_ids(inputs.sparkSession, path, key)
    results = cut_lineage(process(pending(inputs, done, key)))
    storable(results).write.mode("append").parquet(path)
    return results.where(is_rate_limit("api_error")).select(key)


def follow(
    inputs: DataFrame,
    process: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    key: str = "example_id",
    waiting: str | None = None,
) -> StreamingQuery:
    """S12/E14 for inputs that keep arriving in a folder.

    Each micro-batch runs the same resume step, so a replayed batch adds no row
    twice. The stream hands every input out once; inputs whose results may not be
    stored are kept in the folder ``waiting`` (by default beside ``path``) and tried
    again when the next run starts. Ends once the present input is used up; start it
    again to go on.
    """
    waiting = waiting or f"{path.rstrip('/')}_waiting"
    spark = inputs.sparkSession

    def step(batch: DataFrame, _batch_id: int) -> None:
        rows = batch.dropDuplicates([key])
        limited = cut_lineage(append_results(rows, process, path, key))
        rows.join(limited, key, "left_semi").write.mode("append").parquet(waiting)

    if completed_ids(spark, waiting, key) is not None:
        again = spark.read.schema(inputs.schema).parquet(waiting)
        append_results(again.dropDuplicates([key]), process, path, key)
    return (
        inputs.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def with_run_config(results: DataFrame, **config: str) -> DataFrame:
    """Run settings as columns of every result, so mixed runs can be told apart."""
    return results.withColumns({f"run_{k}": F.lit(v) for k, v in config.items()})


def config_mismatch(results: DataFrame, **config: str) -> DataFrame:
    """Stored results whose settings differ from the given ones, by setting."""
    marks = [
        F.when(F.col(f"run_{k}") != v, F.struct(F.lit(k).alias("setting"), F.col(f"run_{k}").alias("found")))
        for k, v in config.items()
    ]
    wrong = results.select(F.inline(F.filter(F.array(*marks), lambda m: m.isNotNull())))
    return wrong.groupBy("setting", "found").agg(F.count("*").alias("n"))
