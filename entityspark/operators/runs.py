"""Runs that go on where an earlier one stopped, and whether their output is appended or rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityspark.operators import ledger


def fingerprint(*settings: Column) -> Column:
    """A hash of the settings that change results; a null setting differs from an empty one."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"s{i}") for i, c in enumerate(settings)]), {"ignoreNullFields": "false"}), 256)


def latest_runs(run_log: DataFrame) -> DataFrame:
    """The newest record ``(run_id, fingerprint, output_path)`` of each run in an append-only log with ``version``."""
    return ledger.latest_status(run_log.select("run_id", "fingerprint", "output_path", "version"), "run_id").drop("version")


def resume_run(current: DataFrame, run_log: DataFrame) -> DataFrame:
    """``current`` (run_id, fingerprint, output_path, mode, output_exists) with ``action`` and ``output``.

    ``action`` is fresh without an earlier record or in mode ``fresh``, resume if the settings
    are the same, and for changed settings fresh in mode ``auto`` and error in mode ``resume``.
    ``output`` is append only for a resumed run with the same path whose output exists, else
    rewrite (null for an error). No output path counts as a path of its own.
    """
    saved = latest_runs(run_log).select("run_id", F.col("fingerprint").alias("__saved"), F.col("output_path").alias("__path"))
    known = current.join(saved, "run_id", "left")
    action = (
        F.when(F.col("__saved").isNull() | (F.col("mode") == "fresh"), "fresh").when(F.col("__saved") == F.col("fingerprint"), "resume")
        .when(F.col("mode") == "resume", "error").otherwise("fresh")
    )
    decided = known.withColumn("action", action)
    append = (F.col("action") == "resume") & F.col("__path").eqNullSafe(F.col("output_path")) & (F.col("output_exists") | F.col("output_path").isNull())
    return decided.withColumn("output", F.when(F.col("action") == "error", F.lit(None).cast("string")).when(append, "append").otherwise("rewrite")).drop("__saved", "__path")


def check_runs(decided: DataFrame) -> DataFrame:
    """The runs, or an error if the settings of one to be resumed have changed."""
    if not decided.where("action = 'error'").isEmpty():
        raise ValueError("settings have changed since the last run; start afresh")
    return decided


def remaining_rows(rows: DataFrame, processed: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows (with ``run_id``) still to do: all of a fresh run, those without a result of a resumed one, none of an error."""
    action = decided.select("run_id", F.col("action").alias("__action"))
    done = processed.select("row_id", F.lit(True).alias("__done")).distinct()
    left = rows.join(action, "run_id").where("__action <> 'error'").join(done, "row_id", "left")
    return left.where("__action = 'fresh' OR __done IS NULL").drop("__action", "__done")
