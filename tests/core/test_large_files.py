"""Files that no task may hold as a whole."""

import gzip
import hashlib
import random

from gridloom.sources import rows


def test_large_files_are_hashed_as_they_are(spark, tmp_path, monkeypatch):
    """Any bytes, in many splits: blank lines, returns, byte order marks, with and without an end; no large file is held."""
    rng = random.Random(3)
    noise = rng.randbytes(700_000)
    data = {"a.bin": noise, "b.bin": noise + b"\n", "c c%20.bin": b"\xef\xbb\xbf" + noise, "d.bin": b"\xef\xbb\xbf" + noise + b"\n\n", "e.bin": b"\r\n\n" * 90_000, "f.bin": b"\n" * 70_000, "g.bin": b"\0" * 80_000 + b"\xff", "small.bin": b"ab\n"}
    (tmp_path / "sub").mkdir()
    for k, (name, x) in enumerate(data.items()):
        (tmp_path / ("sub" if k % 2 else "") / name).write_bytes(x)
    (tmp_path / "other.txt").write_bytes(noise)
    monkeypatch.setattr(rows, "WHOLE_BYTES", 60_000, raising=False)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 60_000)  # what is larger cannot be read as a whole
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    try:
        got = rows.binary_documents(spark, str(tmp_path), "*.bin").collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.path.rsplit("/", 1)[1]: (r["size"], r.content_hash) for r in got} == {n: (len(x), hashlib.sha256(x).hexdigest()) for n, x in data.items()}
    assert len(got) == len(data) and all(r.path.startswith("file:/") and r.modified for r in got)


def test_compressed_files_are_hashed_as_they_are(spark, tmp_path, monkeypatch):
    (tmp_path / "x.gz").write_bytes(x := gzip.compress(b"abc\n" * 1000))
    monkeypatch.setattr(rows, "WHOLE_BYTES", 10, raising=False)
    assert [r.content_hash for r in rows.binary_documents(spark, str(tmp_path), "*.gz", since="1971-01-01").collect()] == [hashlib.sha256(x).hexdigest()]
    assert rows.binary_documents(spark, str(tmp_path), "*", since="2999-01-01").count() == 0
