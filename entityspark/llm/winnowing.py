"""Benchmark decontamination by winnowing, with DataFrame functions alone.

Of every ``window`` consecutive words the smallest hash of their k-grams is kept. Equal windows
keep equal hashes, so every shared span of ``window`` words shares a fingerprint: a join of the
two sides' fingerprints misses none. Its hits are extended in the words themselves, so chance
matches and hash collisions do not count. Items shorter than a window are one window; they are
looked up by all word sequences of their length, the k-gram being the whole item. The search runs
over chunks of words and per distinct text; no words are shuffled unless a table outgrows its bound.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityspark.llm.textio import keep, quoted

#: What separates words: ASCII other than digits and letters (A-Z are lower-cased first).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest fingerprint table that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Words of a text that one row of the search stands for.
CHUNK_WORDS = 4096


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none. Pure ASCII takes the faster function."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), BETWEEN), lambda w: w != "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hashes(hashes: Column, k: int) -> Column:
    """The hashes of all sequences of k words, by position, from the words' hashes; none if there are fewer words."""
    return _positions(hashes, k, lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)]))


def window_minima(grams: Column, k: int, window: int) -> Column:
    """The smallest of the k-gram hashes of every ``window`` words, repeats dropped."""
    w = window - k + 1
    return F.array_distinct(_positions(grams, w, lambda i: F.least(*[F.get(grams, i + j) for j in range(w)]) if w > 1 else F.get(grams, i)))


def _positions(items: Column, size: int, of: Callable[[Column], Column], kind: str = "bigint") -> Column:
    """``of`` every position from which ``size`` items are there, from 0 on."""
    return F.when(F.size(items) >= size, F.transform(F.sequence(F.lit(0), F.size(items) - size), of)).otherwise(F.array().cast(f"array<{kind}>"))


def _chunks(texts: DataFrame, window: int, size: int = CHUNK_WORDS) -> DataFrame:
    """``(k1, k2, base, w)``: the words in chunks that begin every ``size`` words and hold all windows that begin in them.

    Every array of a later step belongs to one chunk, so a very long text needs no more memory.
    """
    words = texts.select("k1", "k2", words_of(F.col("t")).alias("words")).where(F.size("words") > 0)
    taken = lambda c: F.transform(F.sequence(c, F.least(c + (size + window - 2), F.size("words") - 1)), lambda i: F.get("words", i))  # noqa: E731  slice() would copy all words for every chunk
    parts = F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(size)), lambda c: F.struct(c.alias("base"), F.when(F.size("words") <= size, F.col("words")).otherwise(taken(c)).alias("w")))
    return words.select("k1", "k2", F.explode(parts).alias("c")).select("k1", "k2", "c.base", "c.w")


def _small(df: DataFrame, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if it has ``limit`` rows at most."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _keyed(text: Column) -> list[Column]:
    """A text's key: two 64-bit hashes; what is hit depends on the text alone."""
    given = F.coalesce(text, F.lit(""))
    return [F.xxhash64(given).alias("k1"), F.xxhash64(F.lit(1), given).alias("k2")]


def _starts(m: int) -> Column:
    """(position, words) of all sequences of m words of a chunk; slice() would copy the chunk for each."""
    return _positions(F.col("w"), m, lambda i: F.struct(i.alias("at"), F.array(*[F.get("w", i + j) for j in range(m)]).alias("span")), "struct<at:int,span:array<string>>")


def hits_of_texts(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(k1, k2, n_hit, names)`` of every distinct text with a hit: hit words, and the items in order."""
    texts = docs.select(*_keyed(F.col(text_col)), F.col(text_col).alias("t"))
    bench = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0).distinct()
    spans = bench.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1))), lambda i: F.slice("words", i, window))).alias("span")).distinct()

    of_item = bench.select(F.size("words").alias("m"), word_hashes(F.col("words")).alias("h"))
    long = of_item.where(F.col("m") >= window).select("m", gram_hashes(F.col("h"), k).alias("g")).select("m", F.explode(window_minima(F.col("g"), k, window)).alias("print"))
    lengths = sorted(r[0] for r in of_item.where(F.col("m") < window).select("m").distinct().collect())  # at most window - 1
    short = [of_item.where(F.col("m") == m).select("m", F.explode(gram_hashes(F.col("h"), m)).alias("print")) for m in lengths]
    prints = reduce(DataFrame.unionByName, short, long).select("print").distinct()

    chunks = _chunks(texts, window)
    hashed = chunks.select("k1", "k2", word_hashes(F.col("w")).alias("h")).select("k1", "k2", "h", gram_hashes(F.col("h"), k).alias("g"))
    own = F.concat(window_minima(F.col("g"), k, window), *[F.array_distinct(gram_hashes(F.col("h"), m)) for m in lengths])
    suspects = keep(hashed.select("k1", "k2", F.explode(own).alias("print")).join(_small(prints, broadcast_rows), "print", "left_semi").select("k1", "k2").distinct())

    near = _chunks(texts.join(_small(suspects, broadcast_rows), ["k1", "k2"], "left_semi"), window)
    starts = F.concat(*[_starts(m) for m in sorted({window, *lengths})])
    begun = near.select("k1", "k2", "base", F.explode(starts).alias("x")).where(F.col("x.at") < CHUNK_WORDS).select("k1", "k2", (F.col("base") + F.col("x.at")).alias("at"), "x.span")
    hits = keep(begun.join(_small(spans, broadcast_rows), "span").select("k1", "k2", "at", F.size("span").alias("m"), "item").distinct())
    places = hits.select("k1", "k2", "at", "m").distinct().select("k1", "k2", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("m") - 1)).alias("place")).distinct()
    of_items = hits.select("k1", "k2", "item").distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("names"))
    return keep(places.groupBy("k1", "k2").agg(F.count("*").alias("n_hit")).join(of_items, ["k1", "k2"]))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(id_col, n_words, n_hit, n_items, items_sha256, contaminated)`` per row of ``docs``.

    A word is hit if it lies in an occurrence of a window of an item: ``window`` consecutive
    words, or all of a shorter item. Items without words or id are ignored; items that repeat an
    id count as one. Null and empty texts have no words. Every row gets what its own text has,
    whether its id is null, repeated or neither: results are found per distinct text, told apart
    by two 64-bit hashes. No items: nothing is hit. Other columns are not read.
    """
    hits = hits_of_texts(docs, items, text_col, item_id, item_text, window, k, broadcast_rows)
    own = docs.select(F.col(id_col).alias("id"), *_keyed(F.col(text_col)), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    return own.join(_small(hits, broadcast_rows), ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, **options: object) -> DataFrame:
    """``docs`` without contaminated documents, all columns in their order.

    Each row is judged by its own text, whatever its id. No items, or no documents: nothing goes.
    """
    hits = hits_of_texts(docs, items, text_col, broadcast_rows=broadcast_rows, **options).select("k1", "k2")
    own = docs.select(F.struct(*map(quoted, docs.columns)).alias("own"), *_keyed(F.col(quoted(text_col))))
    return own.join(_small(hits, broadcast_rows), ["k1", "k2"], "left_anti").select("own.*")
