"""Fingerprints bit by bit, and components against all pairs, dense groups and common fingerprints among them."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from entityspark.llm import simhash


def test_fingerprint_bit_by_bit(spark):
    pick = random.Random(6)
    texts = [" ".join(pick.choice(["Aa", "bé", "c\x0bD", "e", "ß"]) for _ in range(n)) for n in [*range(9), 40, 3000]] + [None, "", " \t\n", "one\x1cword", "a b c"]
    got = {r["id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for i, t in enumerate(texts):
        words, word = [], ""
        for c in (t or "").translate(str.maketrans(upper, upper.lower())) + " ":
            if c in " \t\n\x0b\x0c\r":
                words, word = words + [word] * bool(word), ""
            else:
                word += c
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert got[i] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)), t


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_components_equal_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(simhash, "block_count", lambda n, bits: blocks)
    pick = random.Random(blocks)
    centres = [pick.getrandbits(64) for _ in range(12)]
    flip = lambda x, n: x ^ sum(1 << b for b in pick.sample(range(64), n))
    prints = {flip(pick.choice(centres), pick.randrange(6)) for _ in range(400)} | {pick.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1, 15, 1 << 63}
    prints |= {x ^ (1 << b) for x in centres[:1] for b in range(64)}
    parent = {x: x for x in prints}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in prints:
        for y in prints:
            if x < y and (x ^ y).bit_count() <= 4:
                parent[root(x)] = root(y)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    found = simhash.links(spark.createDataFrame([(signed(x),) for x in prints], "fp long")).collect()
    joined = {x: x for x in prints}

    def top(x):
        while joined[x] != x:
            joined[x] = joined[joined[x]]
            x = joined[x]
        return x

    for r in found:
        a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
        assert (a ^ b).bit_count() <= 4
        joined[top(a)] = top(b)
    groups = lambda f: {frozenset(y for y in prints if f(y) == f(x)) for x in prints}
    assert groups(root) == groups(top)


def test_common_fingerprints_and_growing_keys(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("the same text of many rows here")).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("text"), (5000 - F.col("id")).alias("doc_id"))
    rows = simhash.near_duplicates(docs, large=100).collect()
    assert len(rows) == 3000
    assert {r["component_id"] for r in rows if r["doc_id"] % 3 == 5000 % 3} == {min(r["doc_id"] for r in rows if r["doc_id"] % 3 == 5000 % 3)}
    assert [simhash.block_count(n) for n in (10**4, 10**6, 10**7, 10**9)] == [6, 6, 7, 8]
