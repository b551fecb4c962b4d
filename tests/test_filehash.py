"""MD4 against the RFC's own vectors, and chunked hashes by hand."""

import hashlib
import zlib

from stillwater.functions.md4 import md4
from stillwater.operators import filehash


def test_md4_vectors():
    # The test suite of RFC 1320.
    known = {
        b"": "31d6cfe0d16ae931b73c59d7e0c089c0", b"a": "bde52cb31de33e46245e05fbdbd6fb24", b"abc": "a448017aaf21d8525fc10ae87aa6729d", b"message digest": "d9130a8164549fe818874806e1c7014b",
        b"abcdefghijklmnopqrstuvwxyz": "d79e1c308aa5bbcdeea8ed63df412da9", b"1234567890" * 8: "e33b4ddc9c38f2199c3e7b164fcc0536",
    }
    assert [d.hex() for d in md4(list(known))] == list(known.values())
    assert [d.hex() for d in md4(list(known)[::-1])] == list(known.values())[::-1]
    assert md4([]) == []


def test_chunks(spark):
    one = lambda b: md4([b])[0]
    rows = [(1, b""), (2, b"abc"), (3, bytes(range(100))), (4, b"x" * 200), (5, b"y" * 250), (6, None), (7, bytes(100))]
    got = {r.id: r for r in filehash.checksums(spark.createDataFrame(rows, "id long, content binary"), 100).collect()}
    for i, b in rows:
        if b is None:
            assert i not in got
            continue
        parts = [one(b[k : k + 100]) for k in range(0, max(1, len(b)), 100)]
        want = [parts[0] if len(parts) == 1 else one(b"".join(parts))] + ([one(b"".join(parts) + one(b""))] if b and len(b) % 100 == 0 else [])
        assert got[i].ed2k == [d.hex().upper() for d in want]
        assert (got[i].sha256, got[i].crc32, got[i].md5) == (hashlib.sha256(b).hexdigest().upper(), f"{zlib.crc32(b):08X}", hashlib.md5(b).hexdigest().upper())
