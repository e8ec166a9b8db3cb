"""Headers of recordings: any order of chunks, pad bytes, extensible formats, broken files."""

from __future__ import annotations

import struct

from editlens.operators import quality

FORMAT = struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16)
LONGER = struct.pack("<HHIIHHHHI", 0xFFFE, 2, 8000, 32000, 4, 16, 22, 16, 3) + struct.pack("<H", 3) + bytes(14)


def chunk(name, body, size=None):
    return name + struct.pack("<I", len(body) if size is None else size) + body + b"\0" * (len(body) % 2)


def wav(*chunks, magic=b"RIFF"):
    body = b"WAVE" + b"".join(chunks)
    return magic + struct.pack("<I", len(body)) + body


def test_wav_profile(spark):
    data, fmt = chunk(b"data", bytes(8)), chunk(b"fmt ", FORMAT)
    files = {
        "plain": wav(fmt, data),
        "odd": wav(chunk(b"LIST", b"abc"), fmt, chunk(b"data", bytes(7))),
        "unpadded": wav(fmt, chunk(b"data", bytes(7)))[:-1],
        "data first": wav(chunk(b"data", bytes(9)), fmt),
        "extensible": wav(chunk(b"fmt ", LONGER), data),
        "two data": wav(fmt, data, chunk(b"data", bytes(4))),
        "no data": wav(fmt),
        "empty data": wav(fmt, chunk(b"data", b"")),
        "no format": wav(data),
        "short format": wav(chunk(b"fmt ", FORMAT[:14]), data),
        "short extensible": wav(chunk(b"fmt ", LONGER[:18]), data),
        "truncated": wav(fmt, chunk(b"data", bytes(8), 9)),
        "half a header": wav(fmt, data) + b"LIS",
        "big end": wav(fmt, data, magic=b"RIFX"),
        "header only": b"RIFF",
        "empty": b"",
        "null": None,
    }
    rows = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "path string, content binary")
    got = {r.path: r for r in quality.wav_profile(rows).collect()}
    sizes = {"plain": 8, "odd": 7, "unpadded": 7, "data first": 9, "extensible": 8, "two data": 8}
    assert {k: r.data_bytes for k, r in got.items() if r.valid} == sizes
    assert all(got[k].duration == n / 32000 and got[k].channels == 2 and got[k].sample_rate == 8000 for k, n in sizes.items())
    assert got["extensible"].encoding == 3 and got["plain"].encoding == 1
    assert all(r.duration is None for r in got.values() if not r.valid)
    assert quality.wav_profile(rows.limit(0)).count() == 0
