"""Large payloads are hashed line by line, with the digest of the file. Spark lists no empty file, at any size."""

import hashlib

import pytest

from editlens.sources import payloads

CONTENTS = {
    "b": b"\n", "c": b"x", "d": b"x\r\ny\n", "e": b"\n\nx\n\n", "f": b"\xef\xbb\xbfab\n\xff\x00\xfe", "g": b"\xef\xbb\xbf\n", "h": bytes(range(256)) * 300,
    "sub/i +%.x": b"no end", "sub/j.gz": b"not packed\n",
}


@pytest.mark.parametrize("limit", [0, 4, 1 << 20])
def test_digests_at_any_limit(spark, tmp_path, monkeypatch, limit):
    (tmp_path / "sub").mkdir()
    for name, content in CONTENTS.items():
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(payloads, "WHOLE_BYTES", limit)
    got = {r.path: (r.size_bytes, r.sha256) for r in payloads.read_payloads(spark, str(tmp_path)).collect()}
    assert got == {n.split("/")[-1]: (len(c), hashlib.sha256(c).hexdigest()) for n, c in CONTENTS.items()}


def test_no_value_holds_a_large_file(spark, tmp_path, monkeypatch):
    """Spark refuses values above a length; larger files are hashed all the same."""
    setting = "spark.sql.sources.binaryFile.maxLength"
    (tmp_path / "big").write_bytes(b"some line\n" * 500)
    (tmp_path / "small").write_bytes(b"some line\n")
    monkeypatch.setattr(payloads, "WHOLE_BYTES", 1000, raising=False)
    spark.conf.set(setting, "2000")
    try:
        assert payloads.read_payloads(spark, str(tmp_path)).count() == 2
        assert {r.size_bytes for r in payloads.read_payloads(spark, str(tmp_path)).select("size_bytes", "sha256").collect()} == {10, 5000}
    finally:
        spark.conf.unset(setting)
