"""Exact deduplication against brute force, and its trie by itself."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from entityspark.llm import exact
from entityspark.llm.textio import keep

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def test_trie_numbers_distinct_strings():
    r = random.Random(5)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(12))) for _ in range(2000)] + [b"", b"\x00", b"\x00\x00", b"\xff" * 5000, b"\xff" * 5000 + b"a", b"\xff" * 4999]
    trie, numbers = exact.RadixTrie(), {}
    for s in strings:
        assert trie.insert(s) == numbers.setdefault(s, len(numbers))
    assert trie.size == len(numbers)


def brute(rows):
    """(id, keep_id, size, sha256) of every row, sorted; and how many rows are kept."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(SPACES.sub(" ", text or ""), []).append(doc_id)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    out = []
    for doc_id, text in rows:
        t = SPACES.sub(" ", text or "")
        out.append((doc_id, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


def check(spark, rows, monkeypatch=None, kind="long"):
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    got = exact.exact_duplicates(docs).collect()
    want, kept = brute(rows)
    assert sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "text_sha256")) for r in got), key=str) == want
    assert sum(r["kept"] for r in got) == kept
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def made():
    r = random.Random(2)
    base = ["a b c", "a  b\tc", " a b c", "a b c ", "a b c", "A b c", "", " ", "\n\t", "é ü", "x" * 50_000, "x" * 50_000 + "y", "x" * 49_999 + "y", "a b\x0bc", "a b\x1cc", "a b\x85c"]
    rows = [(r.randrange(400), r.choice(base)) for _ in range(300)] + [(7, "tie"), (7, "tie"), (None, "tie"), (None, "lost"), (None, "lost"), (3, None), (1, None)]
    r.shuffle(rows)
    return rows


def test_brute_force(spark):
    check(spark, made())


def test_tries_begun_anew(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOLD_ROWS", 2)
    check(spark, made())


def test_texts_of_one_hash(spark):
    """Every text is given the same hash: the tries alone tell them apart."""
    docs = spark.createDataFrame([(i, f"{i % 10} and {i % 7}") for i in range(200)], "doc_id long, text string").repartition(4)
    strings = keep(exact._strings(docs, "doc_id", "text", []))
    got = exact._owners(strings.withColumn("hash", F.lit(0).cast("long"))).groupBy("keep_id", "group_size").count().collect()
    want = {}
    for i in range(200):
        want.setdefault((i % 10, i % 7), []).append(i)
    assert sorted((r["keep_id"], r["group_size"]) for r in got) == sorted((min(ids), len(ids)) for ids in want.values())


@pytest.mark.parametrize("kind", ["string", "int"])
def test_other_ids(spark, kind):
    rows = [("b", "t"), ("a", "t "), ("a", "t"), (None, "t")] if kind == "string" else [(2, "t"), (1, "t"), (-4, "t")]
    check(spark, rows, kind=kind)


def test_edges(spark):
    docs = spark.createDataFrame([(2, "x  y", 5), (1, "x y", 6), (3, "z", None), (3, "z", None)], "doc_id long, text string, `a.b` int").withColumn("rows", F.lit("clash")).withColumn("string", F.lit(None).cast("string")).withColumn("keep_id", F.lit(1))
    assert exact.exact_duplicates(docs.limit(0)).count() == 0
    kept = exact.keep_first(docs)
    assert kept.dtypes == docs.dtypes
    assert sorted((r["doc_id"], r["text"], r["a.b"], r["rows"]) for r in kept.collect()) == [(1, "x y", 6, "clash"), (3, "z", None, "clash")]
    assert exact.keep_first(docs.limit(0)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()])
