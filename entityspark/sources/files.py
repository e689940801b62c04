"""CSV in, JSON Lines out, and what is known about the files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityspark.functions.text import is_blank
from entityspark.operators import rules


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The header's names as written."""
    line = spark.read.option("header", False).option("escape", '"').csv(path, schema=None).limit(1)
    row = line.first()
    return [] if row is None else ["" if v is None else v for v in row]


#: Larger files are read by several tasks each.
SPLIT_BYTES = 1 << 28


def _sized(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, length)`` of every file; no content is read."""
    return spark.read.format("binaryFile").load(paths).select("path", "length")


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file_path, block, at, line)``: all lines of files, ends cut at line feeds; block is the offset of the part that one task read, at rises within it."""
    raw = spark.read.option("lineSep", "\n").text(paths)
    return raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def _records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file_path, pos, record)``: the records of CSV files, whose cells may hold line breaks, by several tasks a file.

    A line begins a record if the quotes before it are even in number. Each part of a file counts
    its quotes; sums over the parts tell how every part begins, and where the record that it
    continues began. Only records of several lines are put together from them.
    """
    quotes = lambda c: F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))
    lines = _lines(spark, paths).withColumn("quotes", quotes(F.col("line")))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = lines.groupBy("file_path", "block").agg(F.sum("quotes").alias("n")).select("file_path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    so_far = Window.partitionBy("file_path", "block").orderBy("at")
    begun = lines.join(parts, ["file_path", "block"]).withColumn("open", F.col("earlier") + F.coalesce(F.sum("quotes").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    begun = begun.withColumn("begins", F.col("open") % 2 == 0).withColumn("place", F.col("block") + F.row_number().over(so_far) - 1)  # no more lines than bytes, so places rise over a file
    own = begun.withColumn("own", F.last(F.when(F.col("begins"), F.col("place")), ignorenulls=True).over(so_far)).withColumn("next_begins", F.lead("begins").over(so_far))
    last = own.groupBy("file_path", "block").agg(F.max("own").alias("own")).select("file_path", "block", F.last("own", ignorenulls=True).over(before).alias("carried"))
    ends = own.groupBy("file_path", "block").agg(F.min_by("begins", "at").alias("first")).select("file_path", "block", F.lead("first").over(Window.partitionBy("file_path").orderBy("block")).alias("then"))
    placed = own.join(last, ["file_path", "block"]).join(ends, ["file_path", "block"])
    whole = F.coalesce(F.col("next_begins"), F.col("then"), F.lit(True))
    alone = placed.where(F.col("begins") & whole).select("file_path", F.col("place").alias("pos"), F.col("line").alias("record"))
    several = placed.where(~(F.col("begins") & whole)).groupBy("file_path", F.coalesce("own", "carried").alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("record"))
    returns = lines.where("block = 0").groupBy("file_path").agg(F.min_by(F.col("line").endswith("\r"), "at").alias("returns"))  # as the header ends
    plain = F.when(F.col("returns"), F.replace(F.regexp_replace("record", "\r$", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("record"))
    every = alone.unionByName(several).join(returns, "file_path").select("file_path", "pos", plain.alias("record"))
    return every.where("pos > 0 AND record <> ''")  # without the header and empty lines


def _schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))] + [T.StructField("_corrupt", T.StringType())])


def csv_scan(spark: SparkSession, paths: str | list[str], columns: list[str], strict: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Header CSV files as text columns, with ``file_path``, ``pos`` (rising over a file) and ``_corrupt``.

    Of columns that repeat a name the last one counts. An empty cell is empty text. ``strict``
    fails at a malformed row, else such rows carry their text in ``_corrupt``. Empty files give no
    rows. Files of more than ``split_bytes`` are read by several tasks each, also where cells hold
    line breaks; their lines end with a line feed, or with a carriage return and a line
    feed if the header does, and the header is their first line. The names of the files reach the driver if there is such a one.
    """
    mode = {"escape": '"', "mode": "FAILFAST" if strict else "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    last = {name: f"c{i}" for i, name in enumerate(columns)}
    cells = [F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in last.items()]
    rest = ["_corrupt", "file_path", "pos"]
    whole, split = paths, []
    if (_sized(spark, paths).agg(F.max("length")).first()[0] or 0) > split_bytes:
        found = _sized(spark, paths).select("path", (F.col("length") > split_bytes).alias("large")).collect()
        whole, split = [r["path"] for r in found if not r["large"]], [r["path"] for r in found if r["large"]]
    out = []
    if whole:
        raw = spark.read.schema(_schema(columns)).option("header", True).option("enforceSchema", True).option("multiLine", True).options(**mode).csv(whole)
        out.append(raw.withColumns({"file_path": F.col("_metadata.file_path"), "pos": F.monotonically_increasing_id()}).select(*cells, *rest))
    if split:
        parsed = _records(spark, split).select("file_path", "pos", F.from_csv("record", _schema(columns).simpleString(), mode).alias("r"))
        out.append(parsed.select("file_path", "pos", "r.*").select(*cells, *rest))
    return reduce(DataFrame.unionByName, out)


def not_blank(columns: list[str]) -> Column:
    return F.exists(F.array(*[F.col(c) for c in columns]), lambda c: ~is_blank(c))


def split_malformed(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined); blank rows of full width are in neither."""
    parsed = F.length(columns[0]) >= 0  # always so; Spark refuses scans of the corrupt text alone
    return rows.where(F.col("_corrupt").isNull() & not_blank(columns)).drop("_corrupt"), rows.where(F.col("_corrupt").isNotNull() & parsed)


def _streamed_hash(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SHA-256 of large files, whose lines pass through one task each in order; a line is the most that is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, left = None, None, 0
        for batch in batches:
            out, column = [], batch.column(0).to_pylist()
            starts = [i for i in range(len(column)) if i == 0 or column[i] != column[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(column)]):
                if column[start] != now:
                    now, digest, left = column[start], hashlib.sha256(), batch.column(1)[start].as_py()
                part = b"\n".join(batch.column(2).slice(start, end - start).to_pylist())
                digest.update(part)
                left -= len(part)
                if left > 0:  # a line feed follows, but for the last line where the file does not end with it
                    digest.update(b"\n")
                    left -= 1
                if left == 0:
                    out.append((now, digest.hexdigest()))
                    left = -1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], names=["file_path", "file_hash"])

    raw = spark.read.option("lineSep", "\n").text(paths)
    lines = raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    dealt = lines.repartition("file_path").sortWithinPartitions("file_path", "block", "at")
    return dealt.select("file_path", "size", "line").mapInArrow(run, "file_path string, file_hash string")


def file_content_hash(spark: SparkSession, paths: str | list[str], stream_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(file_path, file_hash)``: SHA-256 of the bytes.

    Files of more than ``stream_bytes`` are hashed line by line, so they may have any size and
    need no more memory than their longest line; the names of files reach the driver then. Spark
    lists no empty files, so these have no row.
    """
    whole, streamed = paths, []
    if (_sized(spark, paths).agg(F.max("length")).first()[0] or 0) > stream_bytes:
        found = _sized(spark, paths).select("path", (F.col("length") > stream_bytes).alias("large")).collect()
        whole, streamed = [r["path"] for r in found if not r["large"]], [r["path"] for r in found if r["large"]]
    out = []
    if whole:
        out.append(spark.read.format("binaryFile").load(whole).select(F.col("_metadata.file_path").alias("file_path"), F.sha2("content", 256).alias("file_hash")))
    if streamed:
        out.append(_streamed_hash(spark, streamed))
    return reduce(DataFrame.unionByName, out)


def taxonomy_scan(spark: SparkSession, path: str) -> DataFrame:
    """``(notation, value)`` of a JSON array of entries; a missing file has none."""
    schema = "notation string, value string"
    try:
        return spark.read.option("multiLine", True).schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def json_file(spark: SparkSession, path: str) -> dict:
    """A small JSON file, as configurations, schemas and taxonomies are."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def load_rules(spark: SparkSession, rules_path: str, schema_path: str, taxonomy_folder: str | None = None, include: list[str] = (), exclude: list[str] = (), custom: dict | None = None) -> tuple[rules.RuleSet, dict]:
    """(rules, schema) from their files. Taxonomies that either names are ``<name>.json`` in a folder; one that is missing is empty."""
    config, schema = json_file(spark, rules_path), json_file(spark, schema_path)

    def named(spec: object) -> set[str]:
        if isinstance(spec, list):
            return set().union(*map(named, spec)) if spec else set()
        if not isinstance(spec, dict):
            return set()
        own = {spec[k] for k in ("taxonomy", "enumFromTaxonomy") if isinstance(spec.get(k), str)}
        return own.union(*map(named, spec.values()))

    found = {}
    for name in sorted(named(config) | named(schema)) if taxonomy_folder else ():
        found[name] = {r["notation"]: r["value"] for r in taxonomy_scan(spark, f"{taxonomy_folder}/{name}.json").collect()}  # a list of terms, small
    return rules.rules_of(config, schema, found, include, exclude, custom), rules.with_taxonomies(schema, found)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table; one that is not there yet has no rows."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def not_blank_count(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(file_path, n)``: rows with a cell that is not blank, malformed ones too."""
    return rows.where(F.col("_corrupt").isNotNull() | not_blank(columns)).groupBy("file_path").agg(F.count("*").alias("n"))


def multi_file_union(frames: list[DataFrame]) -> DataFrame:
    """Files with different headers as one row set; columns that a file lacks are empty text."""
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    text = dict(out.dtypes)
    return out.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if text[c] == "string" and c != "_corrupt" else F.col(c) for c in names])


def jsonld_sink(entities: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines of the column ``jsonld``; ``append`` adds files without rewriting any."""
    entities.select("jsonld").write.mode(mode).text(path)
