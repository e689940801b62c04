"""Secrets of any length are candidates as a whole and leave nothing behind."""

import random
import string

import pytest
from pyspark.sql import functions as F

from entityspark.llm import secrets
from entityspark.llm.textio import fold

R = random.Random(5)
BASE64 = string.ascii_letters + string.digits + "+/"
made = lambda n, of=BASE64: "".join(R.choices(of, k=n))
TOKEN, RUN, BODY = made(400, string.ascii_letters + string.digits), made(1000), made(1610)
BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
LINES = "\n".join(BODY[i : i + 64] for i in range(0, len(BODY), 64))
FOUND = {
    "token": (f"we set token = {TOKEN} there", TOKEN),
    "run": (f"we saw {RUN} there", RUN),
    "pem": (f"we use {BEGIN}\n{LINES}\n{END} there", f"{BEGIN}\n{LINES}\n{END}"),
    "headers": (f"we use {BEGIN}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A\n\n{LINES}\n{END} there", f"{BEGIN}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A\n\n{LINES}\n{END}"),
    "cut": (f"we use {BEGIN}\n{LINES}\nthere it ends", f"{BEGIN}\n{LINES}"),
    "one line": (f"we use {BEGIN} {BODY} there", f"{BEGIN} {BODY}"),
    "escaped": (f'we use "{BEGIN}\\n{BODY}\\n{END}\\n" there', f"{BEGIN}\\n{BODY}\\n{END}"),
    "mention": (f"a line {BEGIN} comes first\nand then more words", BEGIN),
}


@pytest.mark.parametrize("name", FOUND)
def test_whole_candidates(name):
    text, value = FOUND[name]
    assert [text[a:b] for a, b, _ in secrets.candidates(text)] == [value]


def test_redacted(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = spark.createDataFrame([(name, text, "web") for name, (text, _) in FOUND.items()], "doc_id string, text string, source string")
    model = secrets.scanner(given, given.where(fold("doc_id", 3) != 1).select("doc_id", "text", "source"))
    print(sorted((r["doc_id"], r["score"]) for r in secrets.scan(docs, model).collect()))
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs, model).collect()}
    assert got == {name: text.replace(value, "[SECRET]") for name, (text, value) in FOUND.items()}
