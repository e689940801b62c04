"""The pipeline's near-duplicates against brute force over all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from entityspark.llm import jaccard

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "tu") for b in ("ban", "dir", "fel", "gom", "hus", "jat", "vek", "zin")]


def made():
    """Texts with copies of one to six words changed, a large group of near copies, a line that many share, short and empty ones."""
    r = random.Random(3)
    text = lambda n: [r.choice(WORDS) for _ in range(n)]
    out, line, base = [], text(30), text(200)
    for _ in range(60):
        own = text(r.randint(40, 160)) + (line if r.random() < 0.5 else [])
        out.append(own)
        for _ in range(r.randint(0, 3)):
            copy = list(own)
            for _ in range(r.randint(1, 6)):
                copy[r.randrange(len(copy))] = r.choice(WORDS)
            out.append(copy)
    for _ in range(80):
        copy = list(base)
        for _ in range(r.randint(1, 6)):
            copy[r.randrange(len(copy))] = r.choice(WORDS)
        out.append(copy)
    for n in (1020, 1100, 2040, 2100, 4200):  # sketches of one, two, four and eight times the shortest length
        own = text(n)
        out += [own, own + text(30), own[: n * 5 // 6] + line, text(40) + own[: n // 2] + text(n // 2)]
        changed = list(own)
        for at in range(7, n, 50):
            changed[at] = r.choice(WORDS)
        out.append(changed)
    out += [out[0], out[0], ["one"], ["one"], ["one", "two"], [], []]
    r.shuffle(out)
    return [" ".join(x) for x in out]


def brute(found):
    """Smallest position that each reaches over pairs of five-word Jaccard of 0.8 or more."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := t.lower().split()) else frozenset() for t in found]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(sets))]


@pytest.mark.parametrize("sampled", [16, 1])
def test_every_pair(spark, monkeypatch, sampled):
    monkeypatch.setattr(jaccard, "SAMPLED", sampled)
    found = made()
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    want = brute(found)
    assert [got[i] for i in range(len(found))] == want
    assert len(set(want)) < len(want) - 60
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()} == set(want)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    want = brute([r["text"] or "" for r in rows])
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()} == {rows[i]["doc_id"] for i in want}


@pytest.mark.parametrize("shingles", [0, 5, 1000, 1025, 3000, 9000])
def test_sketches_of_different_lengths(spark, shingles):
    r = np.random.default_rng(shingles)
    a, b = (r.integers(0, 1 << 63, n, np.uint64) for n in (shingles, shingles * 5 // 4))
    b[: shingles * 3 // 4] = a[: shingles * 3 // 4]
    bits = 64 * min(len(jaccard._sketch(a)), len(jaccard._sketch(b)))
    odd = lambda x: np.bincount((x % np.uint64(bits)).astype(int), minlength=bits) % 2
    rows = [([int(x) for x in jaccard._sketch(a).view("<i8")], [int(x) for x in jaccard._sketch(b).view("<i8")])]
    got = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").select(jaccard._differing(F.col("a"), F.col("b"))).first()[0]
    assert got == int((odd(a) != odd(b)).sum())
    assert got <= len(a) + len(b) - 2 * (shingles * 3 // 4)


def test_simhash_links_come_first(spark, monkeypatch):
    """Without the exact search the components are those of SimHashes within four bits, verified."""
    placed = jaccard._placed
    monkeypatch.setattr(jaccard, "_placed", lambda entries, links: placed(entries, links).where(F.lit(False)))
    r = random.Random(4)
    found = []
    for _ in range(50):
        own = [r.choice(WORDS) for _ in range(r.randint(100, 200))]
        found.append(" ".join(own))
        for _ in range(3):
            copy = list(own)
            copy[r.randrange(len(copy))] = "changed"
            found.append(" ".join(copy))
    sets = [jaccard.shingles(t.encode()) for t in found]
    prints = [sum(1 << b for b in range(64) if 2 * int((x >> np.uint64(b) & np.uint64(1)).sum()) > len(x)) for x in sets]
    of = [set(x.tolist()) for x in sets]
    root = list(range(len(found)))
    links = 0
    for i in range(len(found)):
        for j in range(i):
            if of[i] == of[j] or (prints[i] ^ prints[j]).bit_count() <= 4 and 5 * len(of[i] & of[j]) >= 4 * len(of[i] | of[j]):
                links += of[i] != of[j]
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
            else:
                assert (prints[i] ^ prints[j]).bit_count() > 4  # no link that verification takes back
    assert links > 60 and root != brute(found)
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(found))] == root


def test_pairs_of_a_group_are_made_once(spark, monkeypatch):
    """Sets that are no near copies but share most of their first shingles."""
    r = random.Random(5)
    base, texts = [r.choice(WORDS) + str(i) for i in range(300)], []
    for _ in range(60):
        copy = list(base)
        for at in r.sample(range(300), 4):
            copy[at] = f"{r.choice(WORDS)}{r.random()}"
        texts.append(" ".join(copy))
    made_rows, pairs = [], jaccard._apart_pairs

    def counted(*given):
        found = pairs(*given)
        made_rows.append((found.count(), found.distinct().count()))
        return found

    monkeypatch.setattr(jaccard, "_apart_pairs", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in jaccard.near_duplicates(docs).collect()}
    assert [got[i] for i in range(60)] == brute(texts)
    rows, different = made_rows[0]
    assert different > 100 and rows <= 3 * different
