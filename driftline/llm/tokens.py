"""Byte-level BPE ids of whole texts, with the vocabulary's end-of-text id behind each document."""

from __future__ import annotations

import json

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, "Encoder"] = {}


def _bytes_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary file means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _check(path: str, spec: dict) -> None:
    """Raises ValueError unless the file is a plain byte-level BPE: other settings would give other ids, and nothing would tell."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain_split = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    plain_model = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain_tokens = not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    if spec.get("normalizer") or not (plain_split and plain_model and plain_tokens):
        raise ValueError(f"{path} is no plain byte-level vocabulary: its ids would differ from the rank encoder's")


class Encoder:
    """Same ids as Tokenizer.from_file(path).encode(text, add_special_tokens=False), through the faster rank encoder.

    Texts on which the rank encoder panics go to the tokenizer itself. A file whose texts aren't split and encoded in this way is refused.
    """

    def __init__(self, path: str):
        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(path, spec)
        byte = _bytes_of()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        try:
            return np.array(self.encoding.encode(text, allowed_special="all"), np.uint32)
        except BaseException as e:  # a panic of the native encoder is no Exception, and its class can't be imported
            if type(e).__name__ != "PanicException":
                raise
            if self.slow is None:
                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only longer documents are cut; the first piece takes the rest."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first)] + [(s, size) for s in range(first, n, size)]
