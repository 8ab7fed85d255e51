"""Exact merge-order (BPE) encoding by backtracking, for sentencepiece BPE models.

The merges of a piece model yield a token sequence exactly when every two
neighbours are compatible: merging the characters of the two joined gives the
two back. encode_word() walks the text, taking the longest piece at each place
(all matches of one Aho-Corasick pass), checks the new neighbour pair by
re-merging, and on failure goes to the next shorter piece or steps back; a
bitfield marks the positions that have failed.

No piece goes on after a character with a space mark, so spaces split a text
into parts that merge on their own, and so does the place between a letter and a
sign where no piece has the two; a character without a piece becomes byte pieces. Parts recur, so their ids are cached in the worker,
in two bounded generations: what the old one still answers moves to the new.

Null and empty texts have no tokens; repeated rows are repeated; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops
from .common import plain

#: Parts in a generation of a worker's cache.
CACHE = 600_000

_MARK = "▁"
_SIGN = r"[!-/:-@\[-`{-~]"


def _splitter(pieces) -> re.Pattern:
    """Parts of a marked text: space marks with the run of other characters behind them, letters before a sign, and line breaks.

    Letters that some piece has before a sign don't count as letters, so no piece crosses a part's end.
    """
    letter = re.compile(f"([^\\W\\d_]){_SIGN}")
    joined = "".join(sorted({m[1] for p in pieces for m in letter.finditer(p)}))
    return re.compile(f"{_MARK}*[^\\W\\d_{joined}]++(?={_SIGN})|{_MARK}*[^{_MARK}\n]+|{_MARK}+|\n")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = b[i]
        i += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, i


def _fields(b: bytes):
    """(number, value) of a protobuf message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, i = _varint(b, i)
            value, i = b[i : i + size], i + size
        yield key >> 3, value


class Model:
    """A BPE piece model with identity normalisation, dummy prefix and byte fallback."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces, self.score, self.ids, self.byte = [], [], {}, {}
        trainer, normal = {}, {}
        for number, value in _fields(raw):
            if number == 1:
                d = dict(_fields(value))
                piece, kind = d[1].decode(), d.get(3, 1)
                if kind == 6:
                    self.byte[int(piece[1:-1], 16)] = len(self.pieces)
                elif kind == 1:
                    self.ids[piece] = len(self.pieces)
                elif kind not in (2, 3):
                    raise ValueError("only normal, byte, control and unknown pieces")
                self.pieces.append(piece)
                self.score.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if trainer.get(3) != 2 or normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or len(self.byte) != 256:
            raise ValueError("only BPE models with identity normalisation, dummy prefix, kept spaces and byte fallback")
        if any(_MARK in p.lstrip(_MARK) for p in self.ids):
            raise ValueError("a piece goes on after a space mark inside it")
        self.split = _splitter(self.ids)
        self.names = [str(i) for i in range(len(self.pieces))]
        self.known = frozenset(p for p in self.ids if len(p) == 1)
        self.automaton = ahocorasick.Automaton()
        self.pairs: dict[int, bool] = {}
        for piece, i in self.ids.items():
            if self.merge(piece) == [i]:  # others never come out of merging
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        #: Part to number of ids, the ids joined by commas, and the decoded text (None: the part itself, marks as spaces).
        self.cache: dict[str, tuple[int, str, str | None]] = {}
        self.older: dict[str, tuple[int, str, str | None]] = {}

    def merge(self, text: str) -> list[int]:
        """The merges themselves: the best-scored neighbouring pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids.get(p, -1) for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' characters gives the two back; remembered."""
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        ok = self.pairs[left * len(self.pieces) + right] = self.merge(self.pieces[left] + self.pieces[right]) == [left, right]
        return ok

    def encode_word(self, text: str) -> list[int]:
        """Ids of a part all of whose characters are pieces."""
        n, width, pairs = len(text), len(self.pieces), self.pairs
        found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            found[end - match[0] + 1].append(match)  # by end, so from short to long
        ids: list[int] = []
        rest: list[int] = []  # untried matches at each token's start
        failed, at, k, last = 0, 0, len(found[0]) - 1, -1
        while at < n:
            here = found[at]
            while k >= 0:
                size, i = here[k]
                if not failed >> at + size & 1:
                    if last < 0:
                        break
                    ok = pairs.get(last * width + i)
                    if ok or ok is None and self.fits(last, i):
                        break
                k -= 1
            if k >= 0:
                ids.append(i)
                rest.append(k - 1)
                at += size
                last = i
                k = len(found[at]) - 1 if at < n else -1
            else:
                if not ids:
                    raise ValueError(f"no merge order gives {text!r}")
                failed |= 1 << at
                at -= len(self.pieces[ids.pop()])
                k = rest.pop()
                last = ids[-1] if ids else -1
        return ids

    def _part(self, part: str) -> tuple[int, str, str | None]:
        if self.known.issuperset(part):
            ids = self.encode_word(part)
        else:
            ids, run = [], ""
            for ch in part:
                if ch in self.known:
                    run += ch
                    continue
                if run:
                    ids += self.encode_word(run)
                    run = ""
                ids += [self.byte[b] for b in ch.encode()]
            if run:
                ids += self.encode_word(run)
        decoded, names = self.text(ids), self.names
        return len(ids), ",".join([names[i] for i in ids]), None if decoded == part.replace(_MARK, " ") else decoded

    def text(self, ids: list[int]) -> str:
        """Pieces joined, marks as spaces, runs of byte pieces as UTF-8; without the dummy prefix's removal."""
        out, run = [], bytearray()
        for i in ids:
            piece = self.pieces[i]
            if len(piece) == 6 and self.byte.get(int(piece[3:5], 16) if piece.startswith("<0x") else -1) == i:
                run.append(int(piece[3:5], 16))
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(piece)
        out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(_MARK, " ")

    def parts(self, text: str) -> tuple[list[str], list[tuple[int, str, str | None]]]:
        """The text's parts in order, and what the cache holds of each."""
        if not text:
            return [], []
        cache, older, out = self.cache, self.older, []
        every = self.split.findall(_MARK + text.replace(" ", _MARK))
        for part in every:
            got = cache.get(part)
            if got is None:
                got = older.get(part) or self._part(part)
                if len(part) <= 64:
                    if len(cache) >= CACHE:
                        self.older, self.cache = older, cache = cache, {}
                    cache[part] = got
            out.append(got)
        return every, out

    def encode_and_decode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the text that they decode to, without the dummy prefix."""
        every, got = self.parts(text)
        decoded = "".join([part if g[2] is None else g[2] for part, g in zip(every, got)]).replace(_MARK, " ")
        return sum([g[0] for g in got]), ",".join([g[1] for g in got]), decoded[1:]

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.parts(text)[1] for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        out = self.text(ids)
        return out[1:] if ids and self.pieces[ids[0]].startswith(_MARK) else out


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every whole text; ids=False leaves the ids out."""

    def run(batches):
        m = model(path)
        for batch in textops.slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                n, joined, decoded = m.encode_and_decode(text or "")
                rows.append((n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), [int(i) for i in joined.split(",") if i] if ids else None))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols[: 4 if ids else 3]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 5 if ids else 4])

    return plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
