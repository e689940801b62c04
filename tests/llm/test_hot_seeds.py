"""Substring removal where one string has very many different surroundings."""

import hashlib
import random
import resource

import numpy as np
import pytest

from entityspark.llm import substrings


def brute(rows, least=50):
    first: dict[bytes, int] = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - least + 1):
            first[raw[k : k + least]] = min(first.get(raw[k : k + least], i), i)
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - least + 1):
            if first[raw[k : k + least]] < i:
                gone[k : k + least] = True
        out[i] = (int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1)), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1, 5, substrings.HOT])
def test_hot_seeds_equal_brute_force(spark, hot):
    pick = random.Random(3)
    word = lambda n: "".join(pick.choice("abcdefgé ") for _ in range(n))
    common, shorter = word(140), word(49)
    rows = []
    for i in range(240):
        a, b = sorted((pick.randrange(60), pick.randrange(80, 140)))
        middle = [common[a:b], shorter, common, ""][i % 4]
        rows.append((i, word(pick.randrange(60)) + middle + word(pick.randrange(60))))
    rows += [(300, rows[7][1]), (301, ""), (302, None), (303, common * 3)]
    pick.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(docs, hot=hot).collect()}
    assert got == brute(rows)


def test_one_seed_in_many_surroundings(spark):
    """200,000 surroundings of one seed; every worker's peak stays below 600 MB (150 MB of them are libraries)."""
    seed = "The same twenty-six bytes."

    def use(_):
        yield resource.getrusage(resource.RUSAGE_SELF).ru_maxrss

    left, right = "substr(sha2(cast(id as string), 256), 1, 29)", "substr(sha2(cast(id % 100000 as string), 256), 1, 30)"
    docs = spark.range(200_000, numPartitions=8).selectExpr("id as doc_id", f"concat({left}, if(id < 100000, 'y', 'z'), '{seed}', {right}) as text")
    n, removed = substrings.remove_repeats(docs).selectExpr("count(*)", "sum(n_removed)").first()
    assert (n, removed) == (200_000, 100_000 * 56)  # the seed and the 30 bytes after it, in the later half
    assert max(spark.sparkContext.parallelize(range(4), 4).mapPartitions(use).collect()) < 600_000
