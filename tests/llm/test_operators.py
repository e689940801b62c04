"""The ten operators against brute force on small tables with nulls, empty, repeated and long texts."""

import bisect
import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from entityspark.llm import disclosure, language, lm, packing, quality, secrets, simhash, substrings, telephony, winnowing

WORDS = "alpha beta gamma delta omega sigma kappa theta lambda zeta epsilon iota".split()
LONG = " ".join(WORDS[i * i % 12] + str(i % 7) for i in range(900))
TEXTS = [(1, LONG), (2, LONG), (3, LONG.replace("gamma4", "gamma5", 1)), (4, None), (5, ""), (6, "x"), (6, "x"), (7, "Ünïcode " * 30), (None, LONG), (8, "prefix " + LONG[200:420] + " suffix")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "a/b", "z", "z") for i, t in TEXTS], "doc_id long, text string, lang string, source string, id string, t string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_simhash(docs, empty):
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    prints = [(i, simhash.simhash((t or "").encode())) for i, t in TEXTS]
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                parent[root(a)] = root(b)
    for a, (i, fp) in enumerate(prints):
        same = [prints[b][0] for b in range(len(prints)) if root(b) == root(a) and prints[b][0] is not None]
        assert got[(i, fp - (1 << 64) if fp >= 1 << 63 else fp)] == min(same, default=None)
    assert simhash.near_duplicates(empty).count() == 0


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    for _, t in TEXTS:
        assert packing.token_ids(t or "", path).tolist() == own.encode(t or "", add_special_tokens=False).ids
    rows = packing.pack_documents(docs, path, window=64).collect()
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    room: list[int] = []  # plain best fit
    for n in sorted((r["length"] for r in rows), reverse=True):
        k = bisect.bisect_left(room, n)
        left = (room.pop(k) if k < len(room) else 64) - n
        if left:
            bisect.insort(room, left)
    used: dict[int, int] = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert sorted(64 - n for n in used.values() if n < 64) == room
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm", None])
def test_telephony(docs, codec):
    assert telephony.MULAW[0] == -32124 and telephony.MULAW[255] == 0 and telephony.ALAW[0x55] == -8 and telephony.ALAW[0xD5] == 8
    rows = telephony.decode(telephony.store(docs, codec=codec)).collect()
    assert len(rows) == len(TEXTS)
    digests = {hashlib.sha256((t or "").encode().ljust(max(1, -(-len((t or "").encode()) // 192)) * 192)).hexdigest() for _, t in TEXTS}
    assert {r["payload_sha256"] for r in rows} == digests and all(len(r["pcm"]) > 0 for r in rows)


def test_substrings(docs, empty):
    got = {(r["doc_id"], r["n_bytes"]): (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(docs).collect()}
    first: dict[bytes, int] = {}
    for i, t in TEXTS:
        raw = (t or "").encode()
        for k in range(len(raw) - 49 if i is not None else 0):
            first[raw[k : k + 50]] = min(first.get(raw[k : k + 50], i), i)
    for i, t in TEXTS:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49 if i is not None else 0):
            if first[raw[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        assert got[(i, len(raw))] == (gone.sum(), np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1), hashlib.sha256(kept).hexdigest())
    assert substrings.remove_repeats(empty).count() == 0


def test_winnowing(spark, docs, empty):
    items = spark.createDataFrame([(1, " ".join(LONG.split()[30:45])), (2, "x"), (3, None), (4, "not there at all")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in winnowing.decontaminate(docs, items).collect()}
    assert rows[1]["n_hit"] >= 15 and rows[1]["n_items"] == 1 and rows[6]["n_hit"] == 1 and not rows[4]["contaminated"] and not rows[7]["contaminated"]
    assert rows[None]["contaminated"] and rows[None]["n_hit"] == rows[1]["n_hit"] and winnowing.decontaminate(empty, items).count() == 0
    assert {r["contaminated"] for r in winnowing.decontaminate(docs, items.where("false")).collect()} == {False}


def test_language_and_quality(spark, docs, empty):
    train = spark.createDataFrame([("der und die ist nicht " * 20, "de"), ("the and of is not " * 20, "en"), (None, "en"), ("z", None)], "text string, lang string")
    model = language.train(train)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(spark.createDataFrame([(1, "und nicht die"), (2, "the of and"), (3, "12 !"), (4, None), (5, "x\u00b2"), (6, "\u00b2\u00bd \u2167 \u0663 _"), (7, "")], "doc_id long, text string"), model).collect()}
    assert got.pop(5) in ("de", "en")
    assert got == {1: "de", 2: "en", 3: "und", 4: "und", 6: "und", 7: "und"}
    assert {r["lang_pred"] for r in language.predict(docs, language.train(docs.where("false"))).collect()} == {"und"}
    labelled = spark.createDataFrame([(f"a calm sentence number {i}. ", 1.0) for i in range(60)] + [(f"BUY!! NOW!! {i}!! ", 0.0) for i in range(60)], "text string, label double")
    machine = quality.train(labelled)
    scores = [r["score"] for r in quality.score(spark.createDataFrame([(1, "another calm sentence. "), (2, "BUY!! IT!! NOW!!")], "doc_id long, text string"), machine).orderBy("doc_id").collect()]
    assert scores[0] > 0.5 > scores[1]
    assert quality.score(docs, machine).count() == len(TEXTS) and quality.score(empty, machine).count() == 0


def test_partial_matching(docs, empty):
    spark = docs.sparkSession
    for trained in (docs, empty):
        trie = lm.train_bytes(trained)
        asked = [(h, int.from_bytes((b"\0" * 4 + h)[-4:] + bytes([s]), "big")) for h in (b"", b"alph", b"qqqq", b"a0 b") for s in range(256)]
        found = {r["gram"]: r["log_p"] for r in trie.code_lengths(spark.createDataFrame([(c,) for c in {c for _, c in asked}], "gram long")).collect()}
        for h in (b"", b"alph", b"qqqq", b"a0 b"):
            assert abs(sum(np.exp(found[c]) for x, c in asked if x == h) - 1) < 1e-9  # a distribution, so exclusion and escapes add up
    rows = lm.score(docs, docs).collect()
    assert len(rows) == len(TEXTS) and all(r["n_known"] == r["n_tokens"] for r in rows)
    assert {r["train_tokens"] for r in lm.score(docs, empty).collect()} == {0} and lm.score(empty, docs).count() == 0


def test_disclosure_and_secrets(spark):
    rows = [(i, f"{w} met Quentin near 10.1.2.{3} today {w}") for i, w in enumerate(["one", "two", "three"])] + [(9, None), (10, "a@b.c.d, +1 (803) 555-5351 and 4111 1111 1111 1111")] + [(20 + i, "nothing met near today") for i in range(30)]
    docs = spark.createDataFrame([(i, t, "p") for i, t in rows], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in disclosure.digests(disclosure.spans_of(docs)).collect()}
    assert (got[10]["n_email"], got[10]["n_card"], got[10]["n_phone"]) == (1, 1, 1) and got[9]["spans"] == ""
    assert f"term:{rows[0][1].index('Quentin')}:" in got[0]["spans"]
    assert "Quentin" not in disclosure.sanitise(docs, removal=2.0).where("doc_id = 0").first()["text"]
    texts = [(i, f"key password=ab{i:02d}cd34ef56ab{i:02d} end", "x") for i in range(40)] + [(100 + i, f"see somewordsthatarejustverylong{'abc'[i % 3]}ones now", "y") for i in range(40)] + [(200, None, None)]
    found = spark.createDataFrame(texts, "doc_id long, text string, source string")
    model = secrets.scanner(found, found)
    flags = {r["doc_id"]: r["secret"] for r in secrets.scan(found, model).collect()}
    assert flags[3] and not flags[101] and 200 not in flags
    assert "[SECRET]" in secrets.redact(found, model).where(F.col("doc_id") == 3).first()["text"]


def test_winnowing_equals_sql(spark):
    from entityspark.llm import queries

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL["op10_winnowing"])
    got = queries.QUERIES["op10_winnowing"](spark, folder).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
