"""Completion of keys over a stream of results, in keyed state.

A micro-batch reads and writes the state of the keys that it touches, nothing else: what came
earlier is in the state store, never read again as rows. Scalars are a streaming aggregation
inside the JVM. Lists, whose items are united in order, need a state of their own per key, which
holds the different items only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from entityspark.operators.merge import first_nonempty

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _merged(stream: DataFrame, scalars: list[str]) -> DataFrame:
    """All records so far of every key that a batch touches, as one."""
    values = [first_nonempty(F.col(c), F.col("ord")).alias(c) for c in scalars]
    return stream.groupBy("uuid").agg(F.count("*").alias("n_records"), F.max("record_count").alias("record_count"), *values)


#: Keys are handled by buckets of their hash, each a call: a call for each key costs more than its rows. The keys of a batch and bucket are held at once.
BUCKETS = 4096


class Merging(StatefulProcessor):
    """One bucket's persons. The state of each: counts, the first value of each scalar, the first place of each list item."""

    def __init__(self, scalars: list[str], lists: list[str]) -> None:
        self.scalars, self.lists = scalars, lists

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getMapState("persons", "uuid string", "state string")

    def _load(self, key: str, is_known: bool) -> list:
        stored = self.states.getValue((key,)) if is_known else None
        if stored is None:
            return [0, None, [None] * len(self.scalars), [None] * len(self.scalars), {}]
        n, expected, orders, texts, items = json.loads(stored[0])
        return [n, expected, orders, texts, {(k, x): (o, p) for k, x, o, p in items}]

    def _merge(self, state: list, count: float | None, order: int, values: tuple) -> None:
        _, expected, orders, texts, found = state
        state[0] += 1
        if count is not None and count == count and (expected is None or count > expected):
            state[1] = int(count)
        for i, text in enumerate(values[: len(orders)]):
            if text is not None and text == text and text != "" and (orders[i] is None or order < orders[i]):
                orders[i], texts[i] = int(order), text
        for k, items in enumerate(values[len(orders) :]):
            for place, item in enumerate(items if items is not None and not isinstance(items, float) else ()):
                if item is not None and ((at := found.get((k, item))) is None or (order, place) < at):
                    found[k, item] = int(order), place

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        is_known, states = self.states.exists(), {}
        for part in rows:
            columns = [part[c].tolist() for c in ("uuid", "record_count", "ord", *self.scalars, *self.lists)]
            for one, count, order, *values in zip(*columns):
                if one not in states:
                    states[one] = self._load(one, is_known)
                self._merge(states[one], count, order, values)
        for one, (*known, found) in states.items():
            self.states.updateValue((one,), (json.dumps([*known, [[k, x, o, p] for (k, x), (o, p) in found.items()]]),))
        out = {"uuid": list(states), "n_records": [x[0] for x in states.values()], "record_count": pd.array([x[1] for x in states.values()], "Int64")}
        for i, c in enumerate(self.scalars):
            out[c] = pd.Series([x[3][i] for x in states.values()], dtype=object)
        for k, c in enumerate(self.lists):
            out[c] = pd.Series([[x for _, x in sorted((at, x) for (j, x), at in state[4].items() if j == k)] for state in states.values()], dtype=object)
        yield pd.DataFrame(out)


def _united(stream: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
    out = T.StructType([T.StructField("uuid", T.StringType()), T.StructField("n_records", T.LongType()), T.StructField("record_count", T.LongType())])
    for c in scalars:
        out = out.add(c, "string")
    for c in lists:
        out = out.add(c, T.ArrayType(T.StringType()))
    dealt = stream.withColumn("__bucket", F.pmod(F.xxhash64("uuid"), F.lit(BUCKETS)))
    return dealt.groupBy("__bucket").transformWithStateInPandas(Merging(list(scalars), list(lists)), outputStructType=out, outputMode="Update", timeMode="None")


def is_complete() -> Column:
    """Results are expected, and all are there."""
    return F.coalesce((F.col("record_count") > 0) & (F.col("n_records") >= F.col("record_count")), F.lit(False))


def run_available(spark: SparkSession, source: str, schema: str, entities_path: str, checkpoint: str, scalars: list[str], lists: list[str] = (), max_files: int | None = None) -> StreamingQuery:
    """Consumes what is in ``source`` and writes a new version of each key that it touches; returns the finished query.

    ``schema`` has uuid, record_count (rows expected for the key) and ord besides the merged
    columns, which are text, or lists of text; ``max_files`` bounds a micro-batch. Results
    without a key are left out. A version is ``complete`` once all expected results are there; a
    key with late rows, or for which more are expected, is open again until they are. A repeated
    batch overwrites its own folder, and a restart goes on from the checkpoint with the state as
    it was. The state is kept in RocksDB, so it may exceed memory; it is dealt over as many
    partitions as spark.sql.shuffle.partitions was at the first start.
    """
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(source).where("uuid IS NOT NULL")
    merged = _united(stream, list(scalars), list(lists)) if lists else _merged(stream, list(scalars))

    def step(batch: DataFrame, number: int) -> None:
        versions = batch.select("uuid", "n_records", "record_count", *scalars, *lists, is_complete().alias("complete"), F.lit(number).alias("version"))
        versions.write.mode("overwrite").parquet(f"{entities_path}/entities/batch={number}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = merged.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    query.awaitTermination()
    return query


def _newest(versions: DataFrame) -> DataFrame:
    newest = versions.groupBy("uuid").agg(F.max("version").alias("version"))
    return versions.join(newest, ["uuid", "version"], "left_semi")


def _versions(spark: SparkSession, entities_path: str) -> DataFrame:
    return spark.read.parquet(f"{entities_path}/entities").drop("batch")


def latest(spark: SparkSession, entities_path: str) -> DataFrame:
    """The latest complete version of every entity that the stream has written."""
    return _newest(_versions(spark, entities_path).where("complete"))


def progress(spark: SparkSession, entities_path: str) -> DataFrame:
    """One row: results and keys seen, keys complete at some time, complete versions written."""
    of_key = _versions(spark, entities_path).groupBy("uuid").agg(F.max("n_records").alias("n"), F.count_if("complete").alias("c"))
    return of_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_results"), F.count("*").alias("n_keys"), F.count_if(F.col("c") > 0).alias("n_completed"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_versions"))


def restore(spark: SparkSession, entities_path: str, emitted: DataFrame) -> DataFrame:
    """After a restart: what is to be emitted. Latest complete versions that have not been, and orphans.

    An orphan is a key with results that nobody announced (record_count null or 0): it is
    adopted, as if the results it has were all that it expects. ``emitted`` has uuid and version.
    """
    orphans = _newest(_versions(spark, entities_path)).where("coalesce(record_count, 0) = 0")
    due = latest(spark, entities_path).unionByName(orphans.withColumn("complete", F.lit(True)).withColumn("record_count", F.col("n_records")))
    return due.join(emitted.select("uuid", "version"), ["uuid", "version"], "left_anti")


def finalize(spark: SparkSession, entities_path: str, emitted: DataFrame) -> DataFrame:
    """At the end: every key whose newest version is complete and that has not been emitted at all."""
    return _newest(_versions(spark, entities_path)).where("complete").join(emitted.select("uuid").distinct(), "uuid", "left_anti")
