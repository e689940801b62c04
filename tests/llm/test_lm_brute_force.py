"""Language-model scores against a sequential model with dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from entityspark.llm import lm


def sequential(training: list[str], order: int = 4):
    """Prediction by partial matching with exclusion and escape method C, byte after byte."""
    table: dict[bytes, Counter] = defaultdict(Counter)
    for t in training:
        raw = b"\0" * order + t.encode()
        for i in range(order, len(raw)):
            for k in range(order + 1):
                table[raw[i - k : i]][raw[i]] += 1

    def score(text: str) -> float:
        raw, total = b"\0" * order + text.encode(), 0.0
        for i in range(order, len(raw)):
            excluded: set[int] = set()
            for k in range(order, -1, -1):
                seen = {s: n for s, n in table.get(raw[i - k : i], {}).items() if s not in excluded}
                if not seen:
                    continue
                whole = sum(seen.values()) + len(seen)
                if raw[i] in seen:
                    total += math.log10(seen[raw[i]] / whole)
                    break
                total += math.log10(len(seen) / whole)
                excluded |= set(seen)
            else:
                total -= math.log10(256 - len(excluded))
        return total

    return score


def unigrams(training: list[str]):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*t.translate(lower).encode().split(), b""]
    counts = Counter(w for t in training for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return lambda t: (len(tokens(t)), sum(w in counts for w in tokens(t)), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)))


@pytest.mark.parametrize("shares", [(2.0**-22, 1 / 200_000, 1_000_000), (0.002, 0.01, 0), (2.0, 2.0, 0)])  # all frequent, some, none
def test_scores_equal_a_sequential_model(spark, shares):
    pick = random.Random(2)
    word = lambda: "".join(pick.choice("aabcdeé ") for _ in range(pick.randrange(1, 7)))
    rows = [(i, " ".join(word() for _ in range(pick.randrange(40)))) for i in range(50)] + [(60, None), (61, ""), (62, "Zebra QUAGGA \x00\x01"), (62, "zebra"), (None, "abc")]
    docs = spark.createDataFrame([(i, t, "u", 1) for i, t in rows], "doc_id long, text string, score string, row int")
    learned = [t or "" for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    training = docs.where("doc_id is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 10) <> 0")
    got = sorted(map(tuple, lm.score(docs, training, head_grams=shares[0], head_words=shares[1], broadcast_rows=shares[2]).collect()), key=lambda r: (str(r[0]), r[1], r[5]))
    ppm, base = sequential(learned), unigrams(learned)
    want = sorted([(i, *base(t or ""), ppm(t or "")) for i, t in rows], key=lambda r: (str(r[0]), r[1], r[5]))
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], abs=1e-9)
