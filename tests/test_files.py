"""Large CSV files by several tasks, and hashes of files in pieces, against reading them whole."""

import hashlib
import random

import pytest

from entityspark.sources import files

HEADER = ["a", "b", "a"]


def made(r, n, end):
    """Cells with quotes, line breaks and commas; short rows, empty and blank lines."""
    cell = lambda: r.choice(["x", "", 'say ""hi""', "two\nlines", "a,b", "tail\r\nfeed", "é", "\n\n", '""', " sp "])
    rows = []
    for _ in range(n):
        k = r.random()
        rows.append("" if k < 0.05 else "only,two" if k < 0.1 else " " if k < 0.13 else ",".join(f'"{c}"' if r.random() < 0.6 or any(x in c for x in '",\n\r') else c for c in (cell() for _ in range(3))))
    return end.join(["a,b,a", *rows]) + (end if r.random() < 0.5 else "")


@pytest.fixture
def small_parts(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_files_give_the_same_rows(spark, small_parts, tmp_path, end):
    r = random.Random(4)
    for i, n in enumerate((900, 40, 0)):
        (tmp_path / f"{i}.csv").write_bytes(made(r, n, end).encode())
    (tmp_path / "long.csv").write_bytes(('a,b,a\n1,"' + "line\n" * 3000 + '",2\n3,4,5\n').encode())  # one record over many parts
    (tmp_path / "empty.csv").write_bytes(b"")
    rows = lambda df: [tuple(x) for x in df.orderBy("file_path", "pos").select("file_path", "b", "a", "_corrupt").collect()]
    whole, split = files.csv_scan(spark, str(tmp_path), HEADER), files.csv_scan(spark, str(tmp_path), HEADER, split_bytes=0)
    assert rows(split) == rows(whole) and len(rows(whole)) > 800
    assert files._lines(spark, [str(tmp_path / "0.csv")]).rdd.getNumPartitions() > 4
    mixed = files.csv_scan(spark, str(tmp_path), HEADER, split_bytes=1000)
    assert rows(mixed) == rows(whole)


def test_strict_mode_fails_at_a_malformed_row(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,a\n1,2\n")
    for bound in (0, 1 << 20):
        with pytest.raises(Exception, match="(?i)malformed"):
            files.csv_scan(spark, str(tmp_path), HEADER, strict=True, split_bytes=bound).collect()


def test_hashes_in_pieces(spark, small_parts, tmp_path):
    r = random.Random(1)
    contents = [b"x", b"\n", b"\n\n", b"a\nb", b"a\nb\n", b"\r\n\r\n", bytes(r.randrange(256) for _ in range(30_000)), b"ab\n" * 9000 + b"\xff\xfe", b"one line " * 4000]
    for i, data in enumerate(contents):
        (tmp_path / f"{i}.bin").write_bytes(data)
    (tmp_path / "empty.bin").write_bytes(b"")  # Spark lists no empty files
    want = {f"{i}.bin": hashlib.sha256(data).hexdigest() for i, data in enumerate(contents)}
    for bound in (0, 100, 1 << 30):
        got = {x["file_path"].rsplit("/", 1)[-1]: x["file_hash"] for x in files.file_content_hash(spark, str(tmp_path), bound).collect()}
        assert got == want
