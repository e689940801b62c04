"""SimHash near-duplicates through pivot distance tables.

A fingerprint's pivot table row holds its Hamming distances to reference fingerprints. For any
pivot p, |d(x, p) - d(y, p)| <= d(x, y): two fingerprints within ``max_bits`` differ by at most
``max_bits`` in every coordinate. Two kinds of references are used.

* Zero and its 64 one-bit neighbours, in blocks. d(x, 0) - d(x, e_i) tells bit i of x, so a
  block's coordinates are equal exactly if its bits are: they are read off the fingerprint
  instead of being stored. Of ``max_bits + k`` blocks, pairs within ``max_bits`` agree in k at
  least: these coordinates are the key of an equi-join, which finds every pair without comparing
  all. k grows with the number of fingerprints, so that keys stay selective.
* Sixteen scattered references. A candidate whose largest coordinate difference to its partner
  exceeds ``max_bits`` is discarded by them; survivors are verified by the distance itself.

Equal fingerprints are one row of the search, so groups of copies of any size cost one row. Of
each key's fingerprints, all are compared with the smallest first; only those that these links
leave apart are paired, so a dense group costs links in proportion to its size, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityspark.llm.textio import cut, quoted, steps, texts
from entityspark.operators.components import connected_components

#: Scattered references: the XXH64 of the numbers 0 to 15 as text, seed 7; eight distances fit in a long.
PIVOTS = [xxhash.xxh64_intdigest(str(i), 7) for i in range(16)]


def majority(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes: a bit is 1 if over half of them have it; zero of none."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def simhash(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles (repeats included).

    A-Z are lower-cased, words end at the bytes 9 to 13 and 32. Fewer words than a shingle
    has: the whole sequence is the shingle; no words: zero.
    """
    found = text.lower().split()
    if not found:
        return 0
    joined, n = b" ".join(found), len(found)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, found), np.int64, n) + 1
    ends = np.cumsum(lengths)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip((ends - lengths)[: n - words + 1].tolist(), (ends[words - 1 :] - 1).tolist())], dtype="<u8")
    return majority(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(id, fp)`` per row; fp is the SimHash as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "t"):
            prints = np.array([simhash(t, words) for t in texts(batch, "t")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def _bits(n: int) -> Column:
    """An unsigned 64-bit number as a long literal."""
    return F.lit(n - (1 << 64) if n >= 1 << 63 else n).cast("long")


def _blocks(count: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of ``count`` blocks over 64 bits."""
    cuts = [round(64 * i / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def pivot_table(prints: DataFrame, fp_col: str = "fp", pivots: list[int] | None = None) -> DataFrame:
    """Adds ``d0, d1, ...``: the distances to the scattered references, eight bytes to a long."""
    columns = {}
    pivots = PIVOTS if pivots is None else pivots
    for k in range(0, len(pivots), 8):
        distances = [F.shiftleft(F.bit_count(F.col(fp_col).bitwiseXOR(_bits(p))).cast("long"), 8 * i) for i, p in enumerate(pivots[k : k + 8])]
        columns[f"d{k // 8}"] = reduce(Column.bitwiseOR, distances)
    return prints.withColumns(columns)


def _coordinates(column: Column) -> list[Column]:
    return [F.shiftrightunsigned(column, 8 * i).bitwiseAND(F.lit(255).cast("long")) for i in range(8)]


def block_count(prints: int, max_bits: int = 4) -> int:
    """The number of blocks for which keys and expected chance candidates are fewest together."""

    def cost(blocks: int) -> float:
        agree = blocks - max_bits
        return comb(blocks, agree) * (prints + prints**2 / 2.0 ** (64 * agree // blocks + 1))

    return min(range(max_bits + 2, max_bits + 5), key=cost)


def _keyed(table: DataFrame, blocks: list[tuple[int, int]], agree: int) -> DataFrame:
    """``table`` with ``key`` and ``chosen``, once for each choice of ``agree`` blocks: their bits, and which they are."""
    keys = []
    for chosen in combinations(range(len(blocks)), agree):
        key = F.lit(0).cast("long")
        for s, n in (blocks[i] for i in chosen):
            key = F.shiftleft(key, n).bitwiseOR(F.shiftrightunsigned("fp", s).bitwiseAND(_bits((1 << n) - 1)))
        keys.append(F.struct(key.alias("key"), F.lit(sum(1 << i for i in chosen)).alias("chosen")))
    return table.withColumn("k", F.explode(F.array(*keys))).select(*table.columns, "k.key", "k.chosen")


def _near(max_bits: int) -> Column:
    """Of rows a and b: whether no pivot coordinate differs by more than ``max_bits``, and the distance neither."""
    apart = F.greatest(*[F.abs(x - y) for d in ("d0", "d1") for x, y in zip(_coordinates(F.col(f"a.{d}")), _coordinates(F.col(f"b.{d}")))])
    return (apart <= max_bits) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)


def links(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints within ``max_bits`` that connect all such pairs.

    Two fingerprints within ``max_bits`` are linked, or joined by links of others.
    """
    table = cut(pivot_table(prints.select("fp").distinct()))
    count = block_count(table.count(), max_bits)
    blocks, agree = _blocks(count), count - max_bits
    keyed = _keyed(table, blocks, agree)
    leads = keyed.groupBy("key", "chosen").agg(F.min("fp").alias("fp"), F.count("*").alias("n")).where("n > 1").select("key", "chosen", "fp")
    leads = pivot_table(leads)
    stars = keyed.alias("a").join(leads.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.chosen") == F.col("b.chosen")) & (F.col("a.fp") > F.col("b.fp")) & _near(max_bits))
    first = cut(stars.select(F.col("b.fp").alias("a"), F.col("a.fp").alias("b")).distinct())
    parts = connected_components(first, "a", "b").withColumnRenamed("id", "fp")
    placed = _keyed(table.join(parts, "fp", "left").withColumn("part", F.coalesce("component", "fp")).drop("component"), blocks, agree)
    a, b = placed.alias("a"), placed.alias("b")
    rest = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.chosen") == F.col("b.chosen")) & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.part") != F.col("b.part")) & _near(max_bits))
    return first.unionByName(rest.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4, large: int = 1024) -> DataFrame:
    """``(id_col, fp, component_id)`` per row of ``docs``.

    component_id is the smallest id that links reach, the row's own included. Equal rows and
    ids stay as they are, each with its row. Rows without an id keep a null id and take part;
    a component of such rows alone has a null component_id. Null and empty texts have
    fingerprint zero and link like any other. An empty table gives no rows. Other columns of
    ``docs`` are not read, so their names cannot clash. Fingerprints with ``large`` rows, and one
    in 100,000 of all, are sent to their rows; the others are joined.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words))
    groups = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    roots = connected_components(links(groups, max_bits), "a", "b").withColumnRenamed("id", "fp")
    linked = groups.join(roots, "fp")
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = linked.select("fp", "component").join(smallest, "component").select("fp", F.col("component_id").alias("linked_id"))
    named = cut(groups.join(of_print, "fp", "left").select("fp", "n", F.coalesce("linked_id", "least").alias("component_id")))
    often = F.col("n") >= max(large, -(-prints.count() // 100_000))  # at most 100,000 fingerprints
    hot = named.where(often).select("fp", F.struct("component_id").alias("found"))
    sent = prints.join(F.broadcast(hot), "fp", "left")
    rest = sent.where("found is null").drop("found").join(named.where(~often).select("fp", "component_id"), "fp")
    both = sent.where("found is not null").select("id", "fp", "found.component_id").unionByName(rest.select("id", "fp", "component_id"))
    return both.select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one document of each near-duplicate component: the one with the smallest id.

    Rows without an id are kept, as nothing tells them apart; rows that repeat the kept id all stay.
    An empty table gives no rows. All columns stay, in their order.
    """
    found = near_duplicates(docs, id_col, text_col, words, max_bits)
    drop = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col)).distinct()
    return docs.join(drop, id_col, "left_anti").select(*map(quoted, docs.columns))
