"""Ingest of CSV files: rows with identity, without repeats, and the manifest that commits them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entityspark.functions import text as fx
from entityspark.operators import ledger
from entityspark.operators.components import ensure_checkpoint_dir
from entityspark.sources import files
from entityspark.sources.files import csv_scan, split_malformed


@dataclass(frozen=True)
class Ingested:
    """``rows``: kept rows with file_path, file_row_index, uuid and is_random; ``rejected``: malformed rows as text; ``manifest``: one record per file."""

    rows: DataFrame
    rejected: DataFrame
    manifest: DataFrame


def ingest(spark: SparkSession, paths: str | list[str], columns: list[str], key_column: str | None = None) -> Ingested:
    """Reads files, drops blank rows, sets malformed ones aside, identifies rows and drops a file's repeats.

    A repeat equals an earlier row of its file in all cells and in identity; it keeps its index.
    Rows without a value get an identity of their own and so are never repeats. A file with
    malformed rows is ``failed`` in the manifest, which is to be written last. No rows: no records.
    """
    return _ingested(csv_scan(spark, paths, columns), columns, key_column)


def _ingested(scanned: DataFrame, columns: list[str], key_column: str | None) -> Ingested:
    cells = list(dict.fromkeys(columns))
    good, bad = split_malformed(scanned, cells)
    indexed = ledger.file_row_index(good, "file_path", "pos").drop("pos")
    first = F.try_element_at(fx.id_values(cells, key_column), F.lit(1))
    own = F.concat_ws(":", F.lit("row"), "file_path", "file_row_index")
    known = indexed.withColumn("is_random", first.isNull()).withColumn("uuid", fx.uuid_v5(F.coalesce(first, own)))
    kept = ledger.dedup_rows(known, "file_path", [*cells, "uuid"], "file_row_index")
    read = good.groupBy("file_path").agg(F.count("*").alias("n_read"))
    counts = kept.groupBy("file_path").agg(F.count("*").alias("n_rows"), F.countDistinct("uuid").alias("n_keys"), F.count_if("is_random").alias("n_random"))
    wrong = bad.groupBy("file_path").agg(F.count("*").alias("n_rejected"))
    manifest = read.join(counts, "file_path").join(wrong, "file_path", "left").select(
        "file_path", "n_rows", (F.col("n_read") - F.col("n_rows")).alias("n_duplicates"), "n_keys", "n_random", F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"),
        F.when(F.col("n_rejected") > 0, "failed").otherwise("completed").alias("status"),
    )
    return Ingested(kept, bad, manifest)


MANIFEST = "file_path string, file_hash string, ingest_id string, version long, n_rows long, n_duplicates long, n_keys long, n_random long, n_rejected long, status string"


def live_files(manifest: DataFrame) -> DataFrame:
    """The records of an append-only manifest that no later one of the same path or content replaces."""
    newest = lambda key: F.max("version").over(Window.partitionBy(key))
    ranked = manifest.withColumn("__path", newest("file_path")).withColumn("__hash", newest("file_hash"))
    return ranked.where("version = __path AND version = __hash").drop("__path", "__hash")


class Conflict(RuntimeError):
    """Others committed first, again and again."""


def _path(spark: SparkSession, name: str):  # noqa: ANN202
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _delete(spark: SparkSession, name: str) -> None:
    path = _path(spark, name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def committed(spark: SparkSession, state: str) -> tuple[int, DataFrame]:
    """The last version committed, 0 if there is none, and the records of all versions up to it."""
    commits = files.stored(spark, f"{state}/commits", "version long, ingest_id string")
    last = commits.agg(F.max("version")).first()[0] or 0
    return last, files.stored(spark, f"{state}/manifest/*", MANIFEST).join(commits.where(F.col("version") <= last), ["version", "ingest_id"], "left_semi")


def commit(spark: SparkSession, state: str, version: int, ingest_id: str) -> bool:
    """Makes ``ingest_id`` the commit of ``version`` unless there is one: a finished file is moved to a name that only one can have."""
    mine, name = f"{state}/staged-{ingest_id}", f"{state}/commits/{version:012d}.parquet"
    spark.createDataFrame([(version, ingest_id)], "version long, ingest_id string").coalesce(1).write.parquet(mine)
    conf, fs = spark._jsc.hadoopConfiguration(), _path(spark, state).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(_path(spark, f"{state}/commits"))
    part = next(x.getPath() for x in fs.listStatus(_path(spark, mine)) if x.getPath().getName().startswith("part-"))
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(part), fs.makeQualified(_path(spark, name)), options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
            raise
        return False
    finally:
        _delete(spark, mine)
    return True


def _discard(spark: SparkSession, state: str, ingest_id: str) -> None:
    for table in ("rows", "rejected"):
        _delete(spark, f"{state}/{table}/ingest_id={ingest_id}")


def ingest_new(spark: SparkSession, paths: str | list[str], columns: list[str], state: str, key_column: str | None = None, force: bool = False, attempts: int = 5) -> DataFrame:
    """Ingests the files that are new against the folder ``state``; returns ``(file_path, file_hash, action)`` of all.

    The plan is ``ledger.ingest_plan`` against the live records; of files with equal content in
    one call the first path counts, the others are skipped. Files are read once, into a table of
    this call. Rows, malformed rows and manifest records are written under a new ``ingest_id``
    and count once a commit names it, so what a broken run left behind is never read, and rows
    of replaced files vanish at once (``vacuum`` deletes them). If another call has committed
    the version first, what this one wrote is discarded and the plan made anew, ``attempts``
    times at most; then it is a ``Conflict``. A file without rows is completed with none.

    The paths of the files to read reach the driver, which lists them anyway.
    """
    ensure_checkpoint_dir(spark)
    for _ in range(attempts):
        version, known = committed(spark, state)
        found = spark.read.format("binaryFile").load(paths).select("path", F.col("_metadata.file_path").alias("file_path")).join(files.file_content_hash(spark, paths), "file_path")
        planned = ledger.ingest_plan(found, live_files(known).withColumnRenamed("version", "file_id"), force)
        first = F.row_number().over(Window.partitionBy("file_hash").orderBy("file_path")) == 1
        plan = planned.withColumn("action", F.when(first, F.col("action")).otherwise("skip")).join(found.select("path", "file_path"), "file_path").checkpoint()
        todo = plan.where(F.col("action").isin("ingest", "replace_failed", "reingest"))
        names = [r["path"] for r in todo.select("path").collect()]
        if not names or _write(spark, names, columns, state, key_column, todo, version + 1):
            return plan.select("file_path", "file_hash", "action")
    raise Conflict(f"{attempts} times another call committed first")


def _write(spark: SparkSession, names: list[str], columns: list[str], state: str, key_column: str | None, todo: DataFrame, version: int) -> bool:
    ingest_id = uuid.uuid4().hex
    scan = f"{state}/scans/{ingest_id}"
    csv_scan(spark, names, columns).write.parquet(scan)
    done = _ingested(spark.read.parquet(scan), columns, key_column)
    done.rows.write.parquet(f"{state}/rows/ingest_id={ingest_id}")  # a folder of its own: calls at once share none
    done.rejected.write.parquet(f"{state}/rejected/ingest_id={ingest_id}")
    counts = ("n_rows", "n_duplicates", "n_keys", "n_random", "n_rejected")
    records = todo.join(done.manifest, "file_path", "left").select(
        "file_path", "file_hash", F.lit(ingest_id).alias("ingest_id"), F.lit(version).cast("long").alias("version"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("status", F.lit("completed")).alias("status"),
    )
    records.coalesce(1).write.parquet(f"{state}/manifest/{ingest_id}")
    _delete(spark, scan)
    if commit(spark, state, version, ingest_id):
        return True
    _discard(spark, state, ingest_id)
    return False


def manifest(spark: SparkSession, state: str) -> DataFrame:
    """The live record of every file."""
    return live_files(committed(spark, state)[1])


def current_rows(spark: SparkSession, state: str) -> DataFrame:
    """The rows of all completed live files, with ``version``, the number of the ingest that read them. There must be one."""
    live = manifest(spark, state).where("status = 'completed'")
    return _of_ingests(spark, state, "rows", [r["ingest_id"] for r in live.select("ingest_id").distinct().collect()]).join(live.select("file_path", "ingest_id", "version"), ["file_path", "ingest_id"])


def _of_ingests(spark: SparkSession, state: str, table: str, ingests: list[str]) -> DataFrame:
    """The rows that some ingests wrote; no other folder is read. There is one ingest at least."""
    return spark.read.option("basePath", f"{state}/{table}").parquet(*[f"{state}/{table}/ingest_id={i}" for i in ingests])


def vacuum(spark: SparkSession, state: str) -> int:
    """Deletes rows that no live file has any more; returns how many ingests' folders went.

    Ingests of which some files are still live are rewritten without the others under a new
    commit first. For a time when nobody reads or ingests: readers of an older plan lose their
    files, and a call that commits meanwhile makes this one a ``Conflict``.
    """
    version, known = committed(spark, state)
    live = live_files(known)
    of_ingest = known.groupBy("ingest_id").agg(F.count("*").alias("n")).join(live.groupBy("ingest_id").agg(F.count("*").alias("n_live")), "ingest_id", "left")
    fs = _path(spark, state).getFileSystem(spark._jsc.hadoopConfiguration())
    dead = of_ingest.where("coalesce(n_live, 0) < n").collect()  # one for each ingest
    stale = [(r["ingest_id"], r["n_live"]) for r in dead if fs.exists(_path(spark, f"{state}/rows/ingest_id={r['ingest_id']}"))]
    mixed = [i for i, n_live in stale if n_live]
    if mixed:
        fresh = uuid.uuid4().hex
        moved = live.where(F.col("ingest_id").isin(mixed))
        for table in ("rows", "rejected"):
            kept = _of_ingests(spark, state, table, mixed).join(moved.select("file_path", "ingest_id"), ["file_path", "ingest_id"], "left_semi")
            kept.drop("ingest_id").write.parquet(f"{state}/{table}/ingest_id={fresh}")
        records = moved.withColumns({"ingest_id": F.lit(fresh), "version": F.lit(version + 1).cast("long")}).select(*[c.split()[0] for c in MANIFEST.split(", ")])
        records.coalesce(1).write.parquet(f"{state}/manifest/{fresh}")
        if not commit(spark, state, version + 1, fresh):
            _discard(spark, state, fresh)
            raise Conflict("another call committed meanwhile")
    for ingest_id, _ in stale:
        _discard(spark, state, ingest_id)
    return len(stale)


def ingestion_summary(manifest: DataFrame) -> DataFrame:
    """``(file_path, n_rows, status)`` of every file, and a last record with the totals under the path ``total``."""
    total = manifest.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.count("*").alias("n")).select(F.lit("total").alias("file_path"), "n_rows", F.concat(F.col("n").cast("string"), F.lit(" files")).alias("status"))
    return manifest.select("file_path", "n_rows", "status").unionByName(total)
