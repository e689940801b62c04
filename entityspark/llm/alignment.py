"""Alignment of two tokenizers over a corpus, each distinct text once.

Documents are shuffled by their full text, so that copies are one row with their number. Each
distinct text is tokenised and aligned once; how many documents hold a pair of ids linked is
counted with that number as weight. The measures of a text, which depend on corpus-wide counts,
are joined to its documents. Frequent pairs are sent to the tasks, a bounded number of them; the
others, which no longer are hot keys, are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from entityspark.llm.packing import SPLIT, _byte_of_char
from entityspark.llm.textio import keep, quoted, steps, texts

#: Pairs sent to the tasks, at most (17 bytes each).
HEAD_PAIRS = 1 << 19
#: Bytes of text that one step aligns.
STEP = 1 << 20
#: Texts of more than one in so many documents are dealt over several keys when measures return to documents.
HOT_SHARE = 1000

SPACE = "▁"


@lru_cache(maxsize=2)
def byte_tokenizer(path: str) -> tuple[tiktoken.Encoding, Tokenizer, list[bytes]]:
    """A byte-level BPE file in the faster library, in its own, and every id's bytes. Strings of added tokens are plain text to both."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {x["content"] for x in spec["added_tokens"]}
    byte = _byte_of_char()
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    table = [b""] * own.get_vocab_size()
    for token, i in ranks.items():
        table[i] = token
    return tiktoken.Encoding("aligned", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), own, table


@lru_cache(maxsize=2)
def piece_tokenizer(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """A sentencepiece file and every id's bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = range(model.get_piece_size())
    return model, [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE, " ").encode() for i in pieces]


@lru_cache(maxsize=2)
def _lengths(path: str, kind: str) -> np.ndarray:
    table = byte_tokenizer(path)[2] if kind == "byte" else piece_tokenizer(path)[1]
    return np.array([len(x) for x in table], np.int64)


@lru_cache(maxsize=1)
def _written(size: int) -> np.ndarray:
    """Every id followed by a comma, a bar or a semicolon, at 3 * id + (0, 1 or 2)."""
    return np.array([f"{i}{mark}" for i in range(size) for mark in ",|;"], object)


def ids_of(text: str, path: str) -> np.ndarray:
    """The first tokenizer's ids of a text."""
    fast, own, _ = byte_tokenizer(path)
    try:
        return fast.encode_to_numpy(text, disallowed_special=())
    except BaseException as e:  # the fast library's matcher gives up on some very long runs
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
    return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)


class Aligned:
    """The alignment of several texts; arrays of one entry a text, and the distinct linked pairs of each in turn."""

    def __init__(self, found: list[bytes], byte_path: str, piece_path: str) -> None:
        table_a, (model, table_b) = byte_tokenizer(byte_path)[2], piece_tokenizer(piece_path)
        self.size_b = len(table_b)
        a_parts, b_parts, whole = [], [], np.zeros(len(found), bool)
        for i, text in enumerate(found):
            given, spaced = text.decode("utf-8", "replace"), b" " + text
            if not given:
                continue
            b = model.encode(given)
            if b"".join([table_b[x] for x in b]) != spaced:
                continue
            a = ids_of(" " + given, byte_path)
            if b"".join([table_a[x] for x in a.tolist()]) != spaced:
                continue
            whole[i] = True
            a_parts.append(a)
            b_parts.append(b)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(len(found), np.int64) for _ in range(4))
        self.digests = [""] * len(found)
        self.pair_text, self.pairs, self.links = (np.empty(0, np.int64) for _ in range(3))
        if not a_parts:
            return
        rows = np.flatnonzero(whole)
        self.n_a[rows], self.n_b[rows] = [len(x) for x in a_parts], [len(x) for x in b_parts]
        a = np.concatenate(a_parts).astype(np.int64)
        b = np.fromiter((x for part in b_parts for x in part), np.int64, int(self.n_b.sum()))
        a_end, b_end = np.cumsum(_lengths(byte_path, "byte")[a]), np.cumsum(_lengths(piece_path, "piece")[b])
        mark = np.zeros(int(a_end[-1]) + 1, np.uint8)
        mark[a_end] = 1
        mark[b_end] += 2
        ends = np.flatnonzero(mark)
        of = mark[ends]
        is_a, is_b, common = (of & 1).astype(np.int64), (of >> 1).astype(np.int64), of == 3
        at_a, at_b = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b  # the tokens that end here or next
        text_of = np.repeat(rows, self.n_a[rows])[at_a]
        self.n_groups += np.bincount(text_of[common], minlength=len(found))
        self.n_links += np.bincount(text_of, minlength=len(found))
        self._write(a, b, common, is_a > 0, is_b > 0, rows, max(len(table_a), self.size_b))
        span = len(table_a) * self.size_b
        linked = np.sort(text_of * span + a[at_a] * self.size_b + b[at_b])
        first = np.flatnonzero(np.concatenate(([True], linked[1:] != linked[:-1])))
        self.links = np.diff(np.append(first, len(linked)))
        self.pair_text, self.pairs = np.divmod(linked[first], span)

    def _write(self, a: np.ndarray, b: np.ndarray, common: np.ndarray, is_a: np.ndarray, is_b: np.ndarray, rows: np.ndarray, size: int) -> None:
        """The digests: all groups in order, each its first tokenizer's ids, then its second's."""
        group = np.cumsum(common) - common
        group_a, group_b, last_a, last_b = group[is_a], group[is_b], common[is_a], common[is_b]
        n = int(group[-1]) + 1
        total_a, total_b = np.cumsum(np.bincount(group_a, minlength=n)), np.cumsum(np.bincount(group_b, minlength=n))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate(([0], total_b))[group_a]] = 3 * a + last_a
        order[np.arange(len(b)) + total_a[group_b]] = 3 * b + 2 * last_b
        written = _written(size)[order].tolist()
        stop = np.cumsum(self.n_a[rows] + self.n_b[rows]).tolist()
        for row, start, end in zip(rows.tolist(), [0, *stop], stop):
            self.digests[row] = hashlib.sha256("".join(written[start:end])[:-1].encode()).hexdigest()


MEASURED = "digest binary, copies long, text_no long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<int>"


def _measured(docs: DataFrame, text_col: str, byte_path: str, piece_path: str) -> DataFrame:
    """Every distinct text aligned, with its number of documents and its linked pairs."""
    distinct = docs.select(F.col(quoted(text_col)).alias("t")).where(F.length("t") > 0).groupBy("t").agg(F.count("*").alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in steps(batches, "t", STEP):
            found = Aligned(texts(batch, "t"), byte_path, piece_path)
            offsets = np.searchsorted(found.pair_text, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (found.pairs, found.links.astype(np.int32))]
            longs = [pa.array(x) for x in (number + np.arange(batch.num_rows), found.n_a, found.n_b, found.n_groups, found.n_links)]
            number += batch.num_rows
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("digest", "copies")]
            yield pa.RecordBatch.from_arrays([*columns, *longs, pa.array(found.digests, pa.string()), *lists], names=[c.split()[0] for c in MEASURED.split(", ")])

    return distinct.select("t", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), "copies").mapInArrow(run, MEASURED)


def pair_counts(measured: DataFrame, size_b: int) -> DataFrame:
    """``(pair, docs, best)``: in how many documents a pair is linked, and whether that is the most of its first id."""
    counts = keep(measured.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("docs")))
    first = F.floor(F.col("pair") / size_b).alias("a")
    most = counts.groupBy(first).agg(F.max("docs").alias("most"))  # one row for each id of a vocabulary at most
    return counts.withColumn("a", first).join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _head(counts: DataFrame) -> int:
    """The least number of documents of pairs sent to the tasks: a power of two, so that they are HEAD_PAIRS at most."""
    by_size = counts.groupBy(F.floor(F.log2("docs")).alias("k")).count().collect()  # one row for each power of two
    total = 0
    for r in sorted(by_size, key=lambda r: -r["k"]):
        total += r["count"]
        if total > HEAD_PAIRS:
            return 2 ** (r["k"] + 1)
    return 1


def _summed(measured: DataFrame, counts: DataFrame) -> DataFrame:
    """``(text_no, n_best, count_sum)`` of every text with tokens."""
    least = _head(counts)
    head = counts.where(F.col("docs") >= least).toArrow().sort_by("pair")
    pairs, docs, best = (head.column(c).to_numpy() for c in ("pair", "docs", "best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, links = batch.column(1), batch.column(2)
            own, times = given.flatten().to_numpy(zero_copy_only=False), links.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(given.offsets)))
            at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
            known = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row[known], times[known] * best[at[known]])
            np.add.at(sums[1], row[known], times[known] * docs[at[known]])
            rest = np.searchsorted(row[~known], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x)) for x in (own[~known], times[~known])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[0]), pa.array(sums[1]), *lists], names=["text_no", "n_best", "count_sum", "pairs", "links"])

    with_head = measured.where(F.col("n_a") > 0).select("text_no", "pairs", "links").mapInArrow(run, "text_no long, n_best long, count_sum long, pairs array<long>, links array<long>")
    if least == 1:
        return with_head.select("text_no", "n_best", "count_sum")
    with_head = keep(with_head)
    rare = with_head.select("text_no", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("text_no", "x.pairs", "x.links").join(counts.where(F.col("docs") < least), F.col("pairs") == F.col("pair"))
    of_rare = rare.select("text_no", (F.col("links") * F.col("best").cast("long")).alias("n_best"), (F.col("links") * F.col("docs")).alias("count_sum"))
    return with_head.select("text_no", "n_best", "count_sum").unionByName(of_rare).groupBy("text_no").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row of ``docs``.

    Of space + text by a byte-level BPE file (A) and of text by a sentencepiece file (B): tokens,
    groups between byte offsets where tokens of both end, and links, the pairs of tokens whose
    bytes overlap. A pair of ids counts the documents that hold it linked; ``count_sum`` adds the
    counts of a document's links, ``n_best`` are those with the highest count of their A id.
    ``groups_sha256`` is of ``a1,a2|b1;a3|b2,b3``. Texts that are null or empty, or that a
    tokenizer does not give back, have zeros and an empty ``groups_sha256``. Every row is a
    document, also where ids are null or repeat. No documents: no rows. Texts are told apart by
    themselves until they are aligned, by SHA-256 when measures return to their documents. Other
    columns are not read.
    """
    measured = keep(_measured(docs, text_col, byte_path, piece_path))
    size_b = len(piece_tokenizer(piece_path)[1])
    summed = _summed(measured, keep(pair_counts(measured, size_b)))
    of_text = keep(measured.drop("pairs", "links").join(summed, "text_no", "left"))

    n_docs = of_text.agg(F.sum("copies")).first()[0] or 0
    hot = of_text.where(F.col("copies") * HOT_SHARE > n_docs).select("digest", F.ceil(F.col("copies") * HOT_SHARE / F.lit(max(n_docs, 1))).alias("keys"))  # HOT_SHARE rows at most
    dealt = of_text.join(F.broadcast(hot), "digest", "left").withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("keys", F.lit(1)) - 1)))

    text = F.col(quoted(text_col))
    own = docs.select(F.col(quoted(id_col)).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), (F.coalesce(F.length(text), F.lit(0)) > 0).alias("there"))
    keyed = own.where("there").withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(hot), "digest", "left").withColumn("key", F.col("row") % F.coalesce("keys", F.lit(1)))
    found = keyed.select("id", "digest", "key").join(dealt, ["digest", "key"]).select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in MEASURES], "groups_sha256")
    none = own.where("not there").select("id", *[F.lit(0).cast("long").alias(c) for c in MEASURES], F.lit("").alias("groups_sha256"))
    return found.unionByName(none).withColumnRenamed("id", id_col)
