"""Texts with an added token's string get the ids of the tokenizer file."""

import public_tokenizers
from tokenizers import Tokenizer

from entityspark.llm import packing

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\u00e9 ", "<|endoftext|", "<|ENDOFTEXT|>", "a b"]


def test_added_tokens(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    want = [own.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert [packing.token_ids(t, path).tolist() for t in TEXTS] == want
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["doc_tokens"] for r in packing.pack_documents(docs, path).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [len(x) + 1 for x in want]


def test_fallback(monkeypatch):
    """So do texts that the fast library gives up on."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    _, own, added = packing._encoder(path)

    class Failing:
        def encode_to_numpy(self, *a, **b):
            raise ValueError

    monkeypatch.setattr(packing, "_encoder", lambda path: (Failing(), own, added))
    assert packing.token_ids("a <|endoftext|> b", path).tolist() == [64, 220, 50256, 275]
