"""Exact deduplication: compressed radix tries over whole texts, whose terminals hold the smallest id.

Texts are dealt by length and content hash; what is equal is decided by tries over the full byte
strings. Every task first inserts its own documents into a trie, so that copies within a task
are one string before anything is shuffled; what the shuffle brings together is one row for each
task and distinct text. There the strings arrive sorted by length and hash. Once these two
change, the subtree under them is complete: it is emitted and freed, so a task holds the strings
of one length and hash, and what does not fit in memory is spilled by Spark's sort.

A document finds its owner by the number of its task's string, not by a hash: a group with a
third of all documents returns to them over as many keys as tasks had it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityspark.llm.textio import keep, quoted, steps, texts

#: A task's trie is emitted and begun anew once it holds so many bytes or has taken so many documents.
HOLD_BYTES, HOLD_ROWS = 1 << 23, 1 << 17


class RadixTrie:
    """A compressed radix trie over byte strings; a terminal is the number of its string, in order of insertion."""

    def __init__(self) -> None:
        self.size = 0
        self._label: list[bytes] = [b""]
        self._children: list[dict[int, int] | None] = [None]
        self._terminal: list[int] = [-1]

    def _node(self, label: bytes, children: dict[int, int] | None, terminal: int) -> int:
        self._label.append(label)
        self._children.append(children)
        self._terminal.append(terminal)
        return len(self._label) - 1

    def _split(self, node: int, at: int) -> None:
        """Cuts a node's label: what follows ``at`` becomes its only child."""
        label = self._label[node]
        below = self._node(label[at:], self._children[node], self._terminal[node])
        self._label[node], self._children[node], self._terminal[node] = label[:at], {label[at]: below}, -1

    def _end(self, node: int) -> int:
        """Makes a node terminal unless it is; returns its number."""
        if self._terminal[node] < 0:
            self._terminal[node] = self.size
            self.size += 1
        return self._terminal[node]

    def insert(self, string: bytes) -> int:
        """The number of ``string``, a new one if it was not there."""
        node = at = 0
        while True:
            label = self._label[node]
            if not string.startswith(label, at):
                self._split(node, common_prefix(label, string[at : at + len(label)]))
                label = self._label[node]
            at += len(label)
            if at == len(string):
                return self._end(node)
            children = self._children[node]
            if children is None:
                children = self._children[node] = {}
            child = children.get(string[at])
            if child is None:
                children[string[at]] = child = self._node(string[at:], None, -1)
                return self._end(child)
            node = child


def common_prefix(a: bytes, b: bytes) -> int:
    """How many bytes two strings have in common at their start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def normalised(text: bytes) -> bytes:
    """Every run of the bytes 9 to 13 and 32 as one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return b" " * text[:1].isspace() + b" ".join(words) + b" " * text[-1:].isspace()


class Group:
    """What is known of one string in a task: the smallest id, where its row stands, and the number of rows."""

    def __init__(self, text: bytes, number: int) -> None:
        self.text, self.number, self.least, self.place, self.rows = text, number, None, None, 0

    def add(self, doc_id: object, place: int) -> None:
        self.rows += 1
        if self.place is None or (doc_id is not None and (self.least is None or doc_id < self.least)):
            self.least, self.place = doc_id, place


def _strings(docs: DataFrame, id_col: str, text_col: str, own: list[str]) -> DataFrame:
    """A row ``(id, own, string, place)`` for each document, and one with ``rows``, ``id``, ``text``, ``n_bytes`` and ``hash`` for each string of a task."""
    carried = F.struct(*map(quoted, own)) if own else F.struct(F.lit(0).alias("none"))
    given = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("t"), carried.alias("own"))
    kinds_of = {"id": given.schema["id"].dataType, "own": given.schema["own"].dataType, "string": T.LongType(), "place": T.LongType(), "rows": T.LongType(), "text": T.BinaryType(), "n_bytes": T.LongType(), "hash": T.LongType()}
    schema = T.StructType([T.StructField(n, k, True) for n, k in kinds_of.items()])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, place, numbers = TaskContext.get().partitionId() << 40, 0, 0
        trie, groups, held, taken = RadixTrie(), [], 0, 0

        def complete(kind: pa.DataType, own_kind: pa.DataType) -> pa.RecordBatch:
            hashes = [xxhash.xxh64_intdigest(g.text) - (1 << 63) for g in groups]
            long = lambda values: pa.array(values, pa.int64())
            columns = [pa.array([g.least for g in groups], kind), pa.nulls(len(groups), own_kind), long([base + g.number for g in groups]), long([g.place for g in groups])]
            columns += [long([g.rows for g in groups]), pa.array([g.text for g in groups], pa.binary()), long([len(g.text) for g in groups]), long(hashes)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        kinds = None
        for batch in steps(batches, "t"):
            kinds = batch.column(0).type, batch.column(2).type
            string, places = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch, "t")):
                whole = normalised(text)
                at = trie.insert(whole)
                if at == len(groups):
                    groups.append(Group(whole, numbers))
                    numbers += 1
                    held += len(whole)
                groups[at].add(doc_id, place)
                string.append(base + groups[at].number)
                places.append(place)
                place += 1
            taken += batch.num_rows
            absent = [pa.nulls(batch.num_rows, kind) for kind in (pa.int64(), pa.binary(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(string, pa.int64()), pa.array(places, pa.int64()), *absent], names=names)
            if held > HOLD_BYTES or taken > HOLD_ROWS:
                yield complete(*kinds)
                trie, groups, held, taken = RadixTrie(), [], 0, 0
        if groups:
            yield complete(*kinds)

    return given.mapInArrow(run, schema)


def _owners(strings: DataFrame) -> DataFrame:
    """``(string, keep_id, owner, place, group_size, text_sha256)`` of every string of a task: the group of its text."""
    kind = strings.schema["id"].dataType.simpleString()
    names = ["string", "keep_id", "owner", "place", "group_size", "text_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie, members, best = None, RadixTrie(), [], []  # of the present length and hash
        out = []

        def subtree() -> None:
            for string, at in members:
                out.append((string, *best[at]))

        for batch in steps(batches, "text"):
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("n_bytes", "hash", "string", "id", "place", "rows", "text")]
            id_kind = columns[3].type
            for n_bytes, hashed, string, doc_id, place, rows, text in zip(*(c.to_pylist() for c in columns)):
                if (n_bytes, hashed) != now:
                    subtree()
                    now, trie, members, best = (n_bytes, hashed), RadixTrie(), [], []
                at = trie.insert(text)
                if at == len(best):
                    best.append((doc_id, string, place, rows, hashlib.sha256(text).hexdigest()))
                else:
                    least, owner, where, total, digest = best[at]
                    if doc_id is not None and (least is None or (doc_id, string) < (least, owner)) or (doc_id is None and least is None and string < owner):
                        least, owner, where = doc_id, string, place
                    best[at] = least, owner, where, total + rows, digest
                members.append((string, at))
            if out:
                yield _batch(out, id_kind, names)
                out = []
        subtree()
        if out:
            yield _batch(out, id_kind, names)

    dealt = strings.where(F.col("rows").isNotNull()).select("n_bytes", "hash", "string", "id", "place", "rows", "text").repartition("n_bytes", "hash").sortWithinPartitions("n_bytes", "hash")
    return dealt.mapInArrow(run, f"string long, keep_id {kind}, owner long, place long, group_size long, text_sha256 string")


def _batch(rows: list[tuple], id_kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), id_kind, pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _judged(docs: DataFrame, id_col: str, text_col: str, own: list[str]) -> DataFrame:
    strings = keep(_strings(docs, id_col, text_col, own))
    owners = _owners(strings).withColumnRenamed("place", "owner_place")
    found = strings.where(F.col("rows").isNull()).select("id", "own", "string", "place").join(owners, "string")
    return found.withColumn("kept", (F.col("string") == F.col("owner")) & (F.col("place") == F.col("owner_place")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, keep_id, group_size, kept, text_sha256)`` of every row of ``docs``.

    Texts are equal if they are once every run of white space (bytes 9 to 13 and 32) is one
    space; null counts as empty. Of equal texts the row with the smallest id is kept, exactly one
    also where rows repeat an id. A null id comes after all others: it is kept, and ``keep_id``
    null, only in a group without any other. ``text_sha256`` is of the normalised text. Ids need
    an ordered type. No documents: no rows. Other columns are not read.
    """
    return _judged(docs, id_col, text_col, []).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns in their order, whatever their names. Ties as in ``exact_duplicates``."""
    kept = _judged(docs, id_col, text_col, docs.columns).where("kept")
    return kept.select(*[F.col("own").getField(c).alias(c) for c in docs.columns])
