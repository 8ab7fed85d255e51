"""Key exchange envelopes: RSA-OAEP with SHA-256 of a guarded symmetric key (driver-side, a few bytes each)."""

from __future__ import annotations

import hashlib
import os

#: Fixed value: what a sound envelope starts with.
GUARD = b"KEY_UPDATE#"


def _mask(seed: bytes, size: int) -> bytes:
    out = b"".join(hashlib.sha256(seed + i.to_bytes(4, "big")).digest() for i in range(-(-size // 32)))
    return out[:size]


def _xor(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b))


def seal(key: bytes, n: int, e: int, seed: bytes | None = None) -> bytes:
    """RSA-OAEP-SHA256 of GUARD and key under the public key (n, e)."""
    size, text = (n.bit_length() + 7) // 8, GUARD + key
    if len(text) > size - 66:
        raise ValueError("key too long for the modulus")
    block = hashlib.sha256(b"").digest() + bytes(size - len(text) - 66) + b"\1" + text
    seed = seed or os.urandom(32)
    block = _xor(block, _mask(seed, len(block)))
    seed = _xor(seed, _mask(block, 32))
    return pow(int.from_bytes(b"\0" + seed + block, "big"), e, n).to_bytes(size, "big")


def unseal(envelope: bytes, private: list[tuple[int, int]]) -> bytes | None:
    """The key by the first private key (n, d) that gives a guarded text."""
    for n, d in private:
        size = (n.bit_length() + 7) // 8
        if len(envelope) != size:
            continue
        plain = pow(int.from_bytes(envelope, "big"), d, n).to_bytes(size, "big")
        seed = _xor(plain[1:33], _mask(plain[33:], 32))
        block = _xor(plain[33:], _mask(seed, size - 33))
        head, _, text = block[32:].partition(b"\1")
        if plain[0] == 0 and block[:32] == hashlib.sha256(b"").digest() and not any(head) and text.startswith(GUARD):
            return text[len(GUARD) :]
    return None
