"""The state tables' joins, counts and versions: what is processed, complete, merged, emitted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unprocessed_rows(rows: DataFrame, processed: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows without a result; with ``limit`` the first ones in order, otherwise all in no order."""
    found = rows.join(processed.select("row_id"), "row_id", "left_anti")
    return found.orderBy("global_row_index").limit(limit) if limit else found


def sync_counts(rows: DataFrame, processed: DataFrame) -> DataFrame:
    """Per key: rows, processed rows and status, derived instead of stored."""
    counts = rows.where(F.col("uuid").isNotNull()).join(processed.select("row_id", F.lit(1).alias("hit")).distinct(), "row_id", "left").groupBy("uuid").agg(F.count("*").alias("record_count"), F.count("hit").alias("processed_count"))
    status = F.when((F.col("record_count") == F.col("processed_count")) & (F.col("record_count") > 0), "completed").when(F.col("processed_count") > 0, "processing").otherwise("pending")
    return counts.withColumn("status", status)


def ready_for_merge(counts: DataFrame, emitted: DataFrame) -> DataFrame:
    return counts.where("record_count = processed_count and record_count > 0").join(emitted.select("uuid"), "uuid", "left_anti")


def reconcile_orphans(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Keys of results without a row of that key, with the number of results they adopt."""
    return results.join(rows.select("uuid").distinct(), "uuid", "left_anti").groupBy("uuid").agg(F.count("*").alias("processed_count"))


def insert_ignore(existing: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The new rows that a unique key admits: the first of each key that does not exist yet."""
    first = new.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__rn = 1").drop("__rn")
    return first.join(existing.select(*key).distinct(), key, "left_anti")


def insert_counts(existing: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """``(inserted, ignored)`` of ``insert_ignore``, one row."""
    added = insert_ignore(existing, new, key, order).select(F.lit(1).alias("added"))
    both = added.unionByName(new.select(F.lit(0).alias("added")))
    inserted = F.count_if(F.col("added") == 1)
    return both.agg(inserted.alias("inserted"), (F.count_if(F.col("added") == 0) - inserted).alias("ignored"))


def attach_results(rows: DataFrame, results: DataFrame, batch: str = "batch_id") -> tuple[DataFrame, DataFrame]:
    """(rows with their results, refused batches): by ``row_id``; a batch with another number of results than rows is refused whole.

    Of the refused, ``(batch, n_rows, n_results)``.
    """
    counts = [x.groupBy(batch).agg(F.count("*").alias(n)) for x, n in ((rows, "n_rows"), (results, "n_results"))]
    both = counts[0].join(counts[1], batch, "full").select(batch, *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_rows", "n_results")])
    refused = both.where("n_rows <> n_results")
    return rows.join(results, [batch, "row_id"]).join(refused.select(batch), batch, "left_anti"), refused


def upsert_latest(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return base.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def unwritten_outputs(entities: DataFrame, emitted: DataFrame) -> DataFrame:
    return entities.join(emitted.select("uuid", "version"), ["uuid", "version"], "left_anti")


def invalidate_outputs(emitted: DataFrame, uuids: DataFrame | None = None) -> DataFrame:
    """The emission records that stay: none, or those of keys that are not in ``uuids``."""
    return emitted.where("false") if uuids is None else emitted.join(uuids.select("uuid").distinct(), "uuid", "left_anti")


def latest_status(manifest: DataFrame, key: str = "file_id", version: str = "version") -> DataFrame:
    """The newest record of each file in an append-only manifest."""
    rest = [c for c in manifest.columns if c != key]
    return manifest.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, "r.*")


def cascade_delete(rows: DataFrame, processed: DataFrame, entities: DataFrame, file_ids: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, results and entities without the given files: affected keys lose their entity."""
    gone = rows.where(F.col("file_id").isin(file_ids))
    kept = rows.where(~F.col("file_id").isin(file_ids))
    return kept, processed.join(gone.select("row_id"), "row_id", "left_anti"), entities.join(gone.select("uuid").distinct(), "uuid", "left_anti")


def ingest_plan(incoming: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """``(file_path, file_hash, action)``: skip, ingest, replace_failed, reingest or reject.

    Equal content that was ingested is skipped, equal content that failed is replaced. Edited
    content of a known path is ingested again only with ``force``, whether it had failed or not.
    """
    by_hash = manifest.groupBy("file_hash").agg(F.max((F.col("status") == "completed").cast("int")).alias("done"), F.count("*").alias("n_hash"))
    by_path = manifest.groupBy("file_path").agg(F.max_by("status", "file_id").alias("path_status"))
    action = (
        F.when(F.col("done") == 1, "skip").when(F.col("n_hash") > 0, "replace_failed").when(F.col("path_status").isNull(), "ingest")
        .otherwise("reingest" if force else "reject")
    )
    return incoming.join(by_hash, "file_hash", "left").join(by_path, "file_path", "left").select("file_path", "file_hash", action.alias("action"))


#: Orders of one range of a file's row index: no window holds more.
RANGE_ROWS = 1 << 20


def file_row_index(rows: DataFrame, file_id: str = "file_id", order: str = "pos") -> DataFrame:
    """Adds ``file_row_index``, from 0 in each file. ``order`` is a number without ties; ranges of it are numbered apart and added up, so a large file is many tasks."""
    ranged = rows.withColumn("__range", F.floor(F.col(order) / RANGE_ROWS))
    before = Window.partitionBy(file_id).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy(file_id, "__range").agg(F.count("*").alias("__c")).select(file_id, "__range", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(file_id, "__range").orderBy(order)) - 1
    return ranged.withColumn("__place", place).join(bases, [file_id, "__range"]).withColumn("file_row_index", F.col("__before") + F.col("__place")).drop("__range", "__place", "__before")


def global_row_index(rows: DataFrame, file_id: str = "file_id", order: str = "pos") -> DataFrame:
    """Continuous index over files by id: per-file offsets, so no window holds all rows."""
    counts = rows.groupBy(file_id).agg(F.count("*").alias("__n"))
    offsets = counts.select(file_id, F.coalesce(F.sum("__n").over(Window.orderBy(file_id).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return file_row_index(rows, file_id, order).join(F.broadcast(offsets), file_id).withColumn("global_row_index", F.col("__base") + F.col("file_row_index")).drop("__base")


def dedup_rows(rows: DataFrame, file_id: str, cells: list[str], order: str) -> DataFrame:
    """The first of the rows of a file that are equal in all cells; other files keep theirs."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(file_id, *cells).orderBy(order))).where("__rn = 1").drop("__rn")


def fixed_batches(rows: DataFrame, size: int, index: str = "global_row_index") -> DataFrame:
    return rows.withColumn("batch_id", F.floor(F.col(index) / size))


def _tagged(tables: dict[str, DataFrame]) -> DataFrame:
    """``(name, status)`` of every row of several tables; status is null where a table has none."""
    parts = [df.select(F.lit(name).alias("name"), (F.col("status") if "status" in df.columns else F.lit(None)).cast("string").alias("status")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def progress(files: DataFrame, rows: DataFrame, results: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of eight counts, by one aggregate over all four tables; ``files`` and ``keys`` have a status."""
    name, status = F.col("name"), F.col("status")
    return _tagged({"files": files, "rows": rows, "results": results, "keys": keys}).agg(
        F.count_if(name == "files").alias("total_files"), F.count_if((name == "files") & (status == "completed")).alias("completed_files"), F.count_if((name == "files") & (status == "failed")).alias("failed_files"),
        F.count_if(name == "rows").alias("total_rows"), F.count_if(name == "results").alias("processed_rows"),
        F.count_if(name == "keys").alias("total_keys"), F.count_if((name == "keys") & (status == "completed")).alias("completed_keys"), F.count_if((name == "keys") & status.isin("pending", "processing")).alias("pending_keys"),
    )


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """``(name, n)``: the number of rows of each table, empty ones too; one aggregate."""
    names = list(tables)
    counts = _tagged(tables).agg(*[F.count_if(F.col("name") == n).alias(n) for n in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")
