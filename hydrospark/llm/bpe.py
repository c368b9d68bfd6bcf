"""Byte-level BPE by prefix dynamic programming over the ranks of a public tokenizer.

For every prefix of a piece of text there is exactly one token that ends the encoding of that
prefix. It is found from shorter prefixes: a token t that ends the prefix is right if t may follow the last token of the
prefix before it, that is if the merges would never have joined or split across their border. Keeping
that last token for each prefix makes the encoding of any prefix a walk back, lets text be appended
without work on what is there, and limits the work of an edit to the pieces near it.

The table belongs to the package of tokenizer files; only its path is a parameter here.
"""

from __future__ import annotations

import base64
import gc
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces and chunks that a worker remembers before it starts afresh.
HELD = 200_000
#: Pairs of tokens whose standing together a worker remembers.
PAIRS = 400_000


def _lines(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def tokens_at(path: str) -> dict[int, bytes]:
    """Bytes of every id: all that decoding needs."""
    return {rank: token for token, rank in _lines(path).items()}


class Ranks:
    """Tokens by rank, the pair that each was merged from, and whether two tokens may stand together."""

    def __init__(self, tokens: dict[bytes, int]):
        self.rank = tokens
        self.token = {r: t for t, r in tokens.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self._fits: dict[int, bool] = {}
        for token, r in sorted(tokens.items(), key=lambda x: x[1]):
            self.split[r] = self._parts(token, r)
        self.sizes = {r: len(t) for r, t in self.token.items()}
        self.endings: dict = {}  # reversed tokens as a tree; the rank of a token that a node spells is at -1
        for token, r in tokens.items():
            node = self.endings
            for b in reversed(token):
                node = node.setdefault(b, {})
            node[-1] = r

    @classmethod
    def read(cls, path: str) -> Ranks:
        return cls(_lines(path))

    def _parts(self, token: bytes, rank: int) -> tuple[int, int]:
        for i in range(len(token) - 1, 0, -1):
            left, right = self.rank.get(token[:i], rank), self.rank.get(token[i:], rank)
            if left < rank and right < rank and self._stand(left, right):
                self.merged[left, right] = rank
                return left, right
        return rank, rank

    def _stand(self, left: int, right: int) -> bool:
        """Undo merges at the border, latest first; a join that would have come before them breaks it.

        Equal ranks are merged from the left, so a join across the border must be earlier than the
        left token's last merge, but may be as late as the right token's.
        """
        before = 1 << 62
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            go_left = left > right
            for _ in range(2):
                if go_left:
                    parts = self.split[left]
                    if parts[0] != left:
                        before, left = left, parts[1]
                        break
                else:
                    parts = self.split[right]
                    if parts[0] != right:
                        before, right = right + 1, parts[0]
                        break
                go_left = not go_left
            else:
                return True

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of every prefix, by length less one; `known` holds those of a shorter piece."""
        last = known if known is not None else []
        endings, fits = self.endings, self._fits
        for i in range(len(last), len(piece)):
            node, j = endings, i
            while True:
                node = node[piece[j]]
                right = node.get(-1)
                if right is not None:
                    if not j:
                        break
                    pair = last[j - 1] << 32 | right
                    good = fits.get(pair)
                    if good is None:
                        if len(fits) >= PAIRS:
                            fits.clear()
                        good = fits[pair] = self._stand(last[j - 1], right)
                    if good:
                        break
                j -= 1
            last.append(right)
        return last

    def walk_back(self, last: list[int], length: int | None = None) -> list[int]:
        """Token ids of the prefix of `length` bytes."""
        at, out = len(last) if length is None else length, []
        while at > 0:
            out.append(last[at - 1])
            at -= self.sizes[last[at - 1]]
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        return [whole] if whole is not None else self.walk_back(self.last_tokens(piece))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@cache
def ranks_at(path: str) -> Ranks:
    ranks = Ranks.read(path)
    gc.freeze()  # the table stays; the collector need not walk it again and again
    return ranks


class Encoded:
    """A text with the last token of each prefix of its pieces, for appends and edits.

    A match of the pattern depends on at most two characters beyond its end; pieces that end
    earlier than that before a change stay, and once a piece starts where an old one did behind the
    change, all later ones are taken over.
    """

    REACH = 3

    def __init__(self, ranks: Ranks, pattern: str, text: str = ""):
        self.ranks, self._pattern, self.text = ranks, regex.compile(pattern), ""
        self.starts: list[int] = []
        self.pieces: list[tuple[bytes, list[int]]] = []
        self.encoded_bytes = 0  # work done, for tests
        self.append(text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, begin: int, end: int, put: str) -> None:
        text, moved = self.text[:begin] + put + self.text[end:], len(put) - (end - begin)
        stay = 0
        ends = [*self.starts[1:], len(self.text)]
        while stay < len(self.starts) and ends[stay] + self.REACH <= begin:
            stay += 1
        old = {s + moved: i for i, s in enumerate(self.starts) if s >= end}
        starts, pieces = self.starts[:stay], self.pieces[:stay]
        at = ends[stay - 1] if stay else 0
        for m in self._pattern.finditer(text, at):
            if m.start() >= begin + len(put) and m.start() in old:
                i = old[m.start()]
                starts += [s + moved for s in self.starts[i:]]
                pieces += self.pieces[i:]
                break
            piece = m.group().encode()
            was = self.pieces[len(pieces)] if len(pieces) < len(self.pieces) and len(pieces) == stay else None
            known = list(was[1]) if was and piece.startswith(was[0]) else []
            self.encoded_bytes += len(piece) - len(known)
            starts.append(m.start())
            pieces.append((piece, self.ranks.last_tokens(piece, known)))
        self.text, self.starts, self.pieces = text, starts, pieces

    def ids(self) -> list[int]:
        return [i for _, last in self.pieces for i in self.ranks.walk_back(last)]


class _Recent(dict):
    """What was asked for lately: two generations of at most `held` entries, so that frequent keys outlive rare ones."""

    def __init__(self, held: int, make):
        self._held, self._make, self._older = held, make, {}

    def __missing__(self, key: str) -> bytes:
        value = self._older.get(key)
        if value is None:
            value = self._make(key)
        if len(key) <= 64:
            if len(self) >= self._held:
                self._older = dict(self)
                self.clear()
            self[key] = value
        return value


def _packer(ranks: Ranks, pattern: str, whole: bool):
    """Packed ids of a text. `whole`: a run of letters with at most a space before it is one piece by the pattern."""
    split = regex.compile(pattern).findall

    def of_piece(piece: str) -> bytes:
        ids = ranks.encode_piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    pieces = _Recent(HELD // 4, of_piece)

    def of(text: str) -> bytes:
        if whole and (text[1:] if text[0] == " " else text).isalpha():
            return of_piece(text)
        return b"".join(map(pieces.__getitem__, split(text)))

    return of


#: The pattern of the tables never lets a space stand inside a piece or at its end before other
#: text, so text may be cut before each single space and around white space, and chunks remembered.
_CUT = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+")
#: Characters that Python's re takes for white space and Unicode does not.
_ODD = re.compile("[\x1c-\x1f]")


def _encode(path: str, pattern: str, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _packer(ranks_at(path), pattern, cut)
        chunk = _Recent(HELD, pack).__getitem__
        for batch in _sliced(batches):
            ids = []
            for text in batch.column(1).to_pylist():
                if not text:
                    ids.append(b"")
                elif not cut or _ODD.search(text):
                    ids.append(pack(text))
                else:
                    ids.append(b"".join(map(chunk, _CUT.findall(text))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@cache
def _bytes_at(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens behind each other by id, where each starts, and their lengths."""
    tokens = tokens_at(path)
    table = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    sizes = np.fromiter(map(len, table), np.int64, len(table))
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(sizes) - sizes, sizes


#: Ids that are decoded at a time, so that a long row needs little memory.
_IDS = 1 << 20


def _decoded(path: str, ids: np.ndarray) -> bytes:
    """The bytes of the ids: every id's bytes gathered from the table at once."""
    table, starts, sizes = _bytes_at(path)
    out = []
    for at in range(0, len(ids), _IDS):
        part = ids[at:at + _IDS]
        n = sizes[part]
        end = np.cumsum(n)
        out.append(table[np.repeat(starts[part] - end + n, n) + np.arange(end[-1])].tobytes())
    return b"".join(out)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _bytes_at(path)[2]
        for batch in _sliced(batches):
            rows = batch.column(1).to_pylist()
            ids = np.frombuffer(b"".join(rows), "<u4")
            every = _decoded(path, ids)
            ends = np.concatenate(([0], np.cumsum(sizes[ids])))[np.cumsum([0, *(len(r) // 4 for r in rows)])].tolist()
            out = [every[a:b] for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return run


def default_table() -> tuple[str, str]:
    """Path and pattern of the installed 50k table."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of every whole text as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. No special tokens. Each row is encoded by itself, so repeated
    rows and null ids pass through; further columns are not read. Texts are cut into remembered chunks for the
    pattern of the installed tables alone; by any other pattern each text is split as a whole.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _encode(path, pattern, pattern == default_table()[1]), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids of each row stand for."""
    return encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(
        _decode(path), "doc_id long, ids binary, decoded binary")
