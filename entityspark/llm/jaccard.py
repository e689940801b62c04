"""Near-duplicates by SimHash, and every pair of the Jaccard similarity of word shingles that it misses.

SimHash comes first: the 64-bit fingerprints of the sets of shingles are linked within MAX_BITS
through pivot distance tables (``simhash.links``), and each link is verified by the similarity of
the whole sets. Fingerprints of similarity 0.8 differ in about ten bits, so this finds the nearest
copies alone. An exact search completes it, between sets that these links leave apart.

Prefix filtering: let all shingles have one order. Sets of similarity t at least share one of
their first n - ceil(t n) + 1 shingles, so an equi-join of these prefixes misses no pair. The
order puts shingles that are common in a sample of the documents last; it decides how many
candidates there are, not which pairs are found. Bit i of a set's sketch is the parity of its
shingles whose hash is i modulo the number of bits, so two sketches differ in at most as many
bits as the sets do in shingles: candidates that differ in more than the similarity allows are
discarded. A sketch has at least a bit a shingle, else long sets could not differ in enough of
them; halves of a sketch, one laid on the other, are the sketch of half as many bits, so all
sizes compare. The others are verified by the similarity of the whole sets.

Equal sets are one row of the search. Of each prefix shingle's sets, all are compared with a
leading one first (the smallest by one of LEADERS hashes, chosen by the shingle, so that a group
that shares many shingles has several); what these links connect need not be compared again, so a
large group of near copies costs comparisons in proportion to its size. Only sets that are still
apart are paired. A pair with many common shingles is made at the first of them: an entry has the
EARLIER shingles before it, and a pair whose entries have one of these in common is made there.

Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityspark.llm import simhash
from entityspark.llm.textio import keep, quoted, scratch, steps, texts
from entityspark.operators.components import connected_components

#: Similarity from which two sets are near-duplicates, as a fraction.
LEAST = (4, 5)
#: One document in so many is looked at for common shingles; those of two at least, at most COMMON of them, are ordered last.
SAMPLED, COMMON = 8, 1 << 19
#: Longs of the shortest sketch, and of the folded one that is compared first; both powers of two.
SKETCH, FOLDED = 16, 8
#: Bits in which linked SimHashes differ at most, as in op1.
MAX_BITS = 4
#: Hashes by which leading sets are chosen, and shingles that an entry has of those before it.
LEADERS, EARLIER = 4, 4
#: Candidates that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The sorted hashes of a text's distinct word shingles.

    A-Z are lower-cased, words end at the bytes 9 to 13 and 32. Fewer words than a shingle
    has: the whole sequence is the shingle; no words: none.
    """
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    of_word = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    k = min(words, len(found))
    total = np.full(len(found) - k + 1, k, np.uint64)
    for i in range(k):
        total = _mixed(total ^ of_word[i : len(found) - k + 1 + i]) + np.uint64(i)
    return np.unique(total)


def _prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """The first shingles of a set, of which any set of similarity ``least`` has one among its own first."""
    n = len(hashes)
    if not n:
        return hashes
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    often = np.where(common[at] == hashes, counts[at], 0) if len(common) else np.zeros(n, np.int64)
    return hashes[np.lexsort((hashes, often))[: n + (-n * least[0] // least[1]) + 1]]


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """The parities of the numbers of shingles by the last bits of their hashes, a bit a shingle or more."""
    bits = 64 * SKETCH
    while bits < len(hashes):
        bits *= 2
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)))


def _sets(docs: DataFrame, words: int, common: tuple[np.ndarray, np.ndarray] | None = None, least: tuple[int, int] = LEAST) -> DataFrame:
    """``(id, key, n, fp, sketch, hashes)`` of ``(id, t)``: the set's hash, size, SimHash and sketch, and all of its shingles or, given the common ones, its prefix in order."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "t"):
            found = [shingles(t, words) for t in texts(batch, "t")]
            keys = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in found], np.uint64).view(np.int64)
            sizes = np.array([len(x) for x in found], np.int64)
            prints = np.array([simhash.majority(x) for x in found], np.uint64).view(np.int64)
            sketches = _lists([_sketch(x) for x in found])
            if shared.value is not None:
                found = [_prefix(x, *shared.value, least) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(sizes), pa.array(prints), sketches, _lists(found)], names=["id", "key", "n", "fp", "sketch", "hashes"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "t").mapInArrow(run, f"id {kind}, key long, n long, fp long, sketch array<bigint>, hashes array<bigint>")


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the shingles that a sample of the texts has most often, at most COMMON of them."""
    some = docs.where(F.pmod(F.xxhash64("t"), F.lit(SAMPLED)) == 0)
    counts = keep(_sets(some, words).select(F.explode("hashes").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("c")).where("c >= 2"))
    least, total = 2, 0
    for r in sorted(counts.groupBy("c").agg(F.count("*").alias("n")).collect(), reverse=True):  # a row for each different count
        total += r["n"]
        if total > COMMON:
            least = r["c"] + 1
            break
    rows = counts.where(F.col("c") >= least).toArrow()
    hashes = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows.column("c").to_numpy()[order]


def _may(apart: Column, of_a: Column, of_b: Column, least: tuple[int, int]) -> Column:
    """Whether sets of these sizes, ``apart`` in that many shingles at least, can have the similarity."""
    near = apart * sum(least) <= (of_a + of_b) * (least[1] - least[0])
    return (of_a * least[1] >= of_b * least[0]) & (of_b * least[1] >= of_a * least[0]) & near


def _folded(sketch: Column, longs: Column) -> Column:
    """A sketch as one of ``longs`` longs, of which its length is a multiple."""
    laid = lambda sofar, i: F.zip_with(sofar, F.slice(sketch, i * longs + 1, longs), Column.bitwiseXOR)
    return F.aggregate(F.sequence(F.lit(0), (F.size(sketch) / longs).cast("int") - 1), F.array_repeat(F.lit(0).cast("long"), longs), laid)


def _differing(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ, the longer one folded."""
    longs = F.least(F.size(a), F.size(b))
    a, b = (F.when(F.size(x) == longs, x).otherwise(_folded(x, longs)) for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _verified(pairs: DataFrame, found: DataFrame, texts_of: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """The pairs ``(a, b)`` of keys whose sets have the similarity."""
    for end in ("a", "b"):
        pairs = pairs.join(found.select(F.col("key").alias(end), F.col("n").alias(f"n{end}"), F.col("sketch").alias(f"s{end}")), end)
    pairs = keep(pairs.where(_may(_differing(F.col("sa"), F.col("sb")), F.col("na"), F.col("nb"), least)).select("a", "b"))
    ends = keep(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    wanted = keep(found.join(ends, "key").where(F.col("id").isNotNull()).select("id").distinct())
    few = ends.count() <= BROADCAST_ROWS
    wanted, pairs = (F.broadcast(x) if x.count() <= BROADCAST_ROWS else x for x in (wanted, pairs))
    without = texts_of.where(F.col("id").isNull())  # nothing else tells these rows apart
    rows = texts_of.join(wanted, "id", "left_semi").unionByName(without)
    whole = _sets(rows, words).join(F.broadcast(ends) if few else ends, "key", "left_semi").groupBy("key").agg(F.first("hashes").alias("hashes"))
    both = whole.select(F.col("key").alias("a"), F.col("hashes").alias("x")).join(pairs, "a").join(whole.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared * least[1] >= (F.size("x") + F.size("y") - shared) * least[0]).select("a", "b")


@scratch
def _documents(given: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """``(id, key, least, n, fp, sketch, q, hashes)`` of every row of ``(id, t)``.

    n, the SimHash, the sketch, the folded one (q) and the prefix are those of the first row of each set, null
    in the others; least is the smallest id of the set there. Stored once, what leads to it is not.
    """
    prints = keep(_sets(given, words, _common(given, words), least).withColumn("row", F.monotonically_increasing_id()))
    groups = keep(prints.groupBy("key").agg(F.min("id").alias("least"), F.min("row").alias("row")).select("row", "least", F.lit(True).alias("first")))
    of_first = [F.when(F.col("first"), c).alias(name) for name, c in (("n", F.col("n")), ("fp", F.col("fp")), ("sketch", F.col("sketch")), ("q", _folded(F.col("sketch"), F.lit(FOLDED))), ("hashes", F.col("hashes")))]
    return prints.join(groups, "row", "left").select("id", "key", "least", *of_first)


def _print_links(found: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of keys that connect the sets whose SimHashes do, through op1's pivot tables."""
    first = keep(found.groupBy("fp").agg(F.min("key").alias("key")))
    links = simhash.links(first.select("fp"), MAX_BITS)
    for end in ("a", "b"):
        links = links.join(first.select(F.col("fp").alias(end), F.col("key").alias(f"key_{end}")), end)
    equal = found.select("fp", F.col("key").alias("key_b")).join(first.select("fp", F.col("key").alias("key_a")), "fp").where("key_a < key_b")
    both = links.select("key_a", "key_b").unionByName(equal.select("key_a", "key_b"))
    return both.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()


def _placed(entries: DataFrame, links: DataFrame) -> DataFrame:
    """``entries`` with ``part``: the smallest key that the links reach from their own."""
    parts = connected_components(links, "a", "b").withColumnRenamed("id", "key")
    return entries.join(parts, "key", "left").withColumn("part", F.coalesce("component", "key")).drop("component")


def _pair() -> tuple[Column, Column]:
    return F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")


def _columns() -> list[Column]:
    return [F.col("q")[i].alias(f"q{i}") for i in range(FOLDED)]


def _candidates(least: tuple[int, int]) -> Column:
    """Of entries a and b: whether they share their shingle, are apart, and may have the similarity."""
    bits = reduce(Column.__add__, [F.bit_count(F.col(f"a.q{i}").bitwiseXOR(F.col(f"b.q{i}"))) for i in range(FOLDED)])
    return (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.part") != F.col("b.part")) & _may(bits, F.col("a.n"), F.col("b.n"), least)


def _apart_pairs(placed: DataFrame, found: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Candidates ``(a, b)`` of different parts, each at the first shingle that both have, or a few more."""
    open_at = placed.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("shingle")
    before = F.slice("hashes", F.greatest(F.col("at") - EARLIER, F.lit(0)) + 1, F.least("at", F.lit(EARLIER)))
    sized = found.select("key", "n", "hashes", *_columns())
    apart = placed.join(open_at, "shingle", "left_semi").join(sized, "key").withColumn("before", before).drop("hashes", "at")
    once = ~F.arrays_overlap("a.before", "b.before") & (F.col("a.key") < F.col("b.key"))
    return apart.alias("a").join(apart.alias("b"), _candidates(least) & once).select(*_pair())


@scratch
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: tuple[int, int] = LEAST) -> DataFrame:
    """``(id_col, key, component_id)`` per row of ``docs``.

    component_id is the smallest id that pairs of similarity ``least`` reach, the row's own
    included. Equal rows and ids stay as they are. Rows without an id keep a null id and take
    part; a component of such rows alone has a null component_id. Null, empty and blank texts
    have no shingles and equal each other alone. An empty table gives no rows. Other columns of
    ``docs`` are not read.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    prints = _documents(given, words, least)
    found = prints.where("n IS NOT NULL").select("key", "n", "fp", "sketch", F.col("least").alias("id"), "q", "hashes")
    groups = found.select("key", F.col("id").alias("least"))
    near = keep(_verified(keep(_print_links(found)), found, given, words, least))

    # a set stays if the next smaller or larger one of its shingle has a size that the similarity allows
    by_size = Window.partitionBy("shingle").orderBy("n")
    below, above = F.lag("n").over(by_size), F.lead("n").over(by_size)
    entries = found.select("key", "n", F.posexplode("hashes").alias("at", "shingle")).withColumns({"below": below, "above": above})
    kept = entries.where((F.col("below") * least[1] >= F.col("n") * least[0]) | (F.col("n") * least[1] >= F.col("above") * least[0]))
    shared = keep(_placed(kept.select("shingle", "key", "at"), near))
    sized = found.select("key", "n", *_columns())
    by_hash = F.min_by(F.struct("key", "part"), F.xxhash64("key", F.pmod("shingle", F.lit(LEADERS))))
    lead = shared.groupBy("shingle").agg(by_hash.alias("first")).select("shingle", "first.*").join(sized, "key")
    stars = shared.join(sized, "key").alias("a").join(lead.alias("b"), _candidates(least)).select(*_pair())
    first = keep(_verified(keep(stars.distinct()), found, given, words, least)).unionByName(near)

    placed = keep(_placed(shared.drop("part"), first))
    second = _verified(keep(_apart_pairs(placed, found, least).distinct()), found, given, words, least)

    roots = connected_components(first.unionByName(second), "a", "b").withColumnRenamed("id", "key")
    linked = groups.join(roots, "key")
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    of_key = linked.select("key", "component").join(smallest, "component").select("key", F.col("component_id").alias("linked_id"))
    named = groups.join(of_key, "key", "left").select("key", F.coalesce("linked_id", "least").alias("component_id"))
    return prints.select("id", "key").join(named, "key").select(F.col("id").alias(id_col), "key", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: tuple[int, int] = LEAST) -> DataFrame:
    """``docs`` with one document of each near-duplicate component: the one with the smallest id.

    Rows without an id are kept, as nothing tells them apart; rows that repeat the kept id all stay.
    An empty table gives no rows. All columns stay, in their order.
    """
    found = near_duplicates(docs, id_col, text_col, words, least)
    drop = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col)).distinct()
    return docs.join(drop, id_col, "left_anti").select(*map(quoted, docs.columns))
