"""MD4 (RFC 1320) of many byte strings at once; neither Spark nor Python's usual build has it."""

from __future__ import annotations

import numpy as np

U = np.uint32
#: Fixed values of the RFC: the first state, each round's constant, shifts and order of words.
STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
ROUNDS = (
    (0, (3, 7, 11, 19), tuple(range(16))),
    (0x5A827999, (3, 5, 9, 13), tuple(4 * (i % 4) + i // 4 for i in range(16))),
    (0x6ED9EBA1, (3, 9, 11, 15), (0, 8, 4, 12, 2, 10, 6, 14, 1, 9, 5, 13, 3, 11, 7, 15)),
)


def mix(k: int, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return ((x & y) | (~x & z)) if k == 0 else ((x & y) | (x & z) | (y & z)) if k == 1 else x ^ y ^ z


def padded(data: bytes) -> bytes:
    return data + b"\x80" + b"\0" * ((55 - len(data)) % 64) + (8 * len(data)).to_bytes(8, "little")


def md4(texts: list[bytes]) -> list[bytes]:
    """The digest of each; all go through their blocks together, the longest first."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    words = [np.frombuffer(padded(texts[i]), "<u4").reshape(-1, 16) for i in order]
    sizes = np.array([len(w) for w in words])
    state = [np.full(len(texts), s, U) for s in STATE]
    for block in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes, -block, side="left"))  # those with a block left are in front
        x = np.stack([w[block] for w in words[:n]], 1).astype(U)
        a, b, c, d = (s[:n].copy() for s in state)
        for k, (add, shifts, at) in enumerate(ROUNDS):
            for i in range(16):
                t = a + mix(k, b, c, d) + x[at[i]] + U(add)
                s = U(shifts[i % 4])
                a, b, c, d = d, (t << s) | (t >> (U(32) - s)), b, c
        for s, v in zip(state, (a, b, c, d), strict=True):
            s[:n] += v
    out = [b""] * len(texts)
    for place, i in enumerate(order):
        out[i] = b"".join(int(s[place]).to_bytes(4, "little") for s in state)
    return out
