"""Byte-level BPE of whole texts: pieces are merged in length-bucketed, padded numpy matrices.

A text is cut into pieces by a pattern, and each distinct piece of a slice that the worker does not know yet is a row of the
matrix of its length bucket. In every round each row merges its leftmost pair of minimum rank, as looked up in an
open-addressing table of pairs; the gap is closed by compaction, and rows without a mergeable pair leave. Pieces that are
tokens as a whole are taken as such. Rounds over a piece of n bytes cost about n * n, so pieces beyond WIDEST bytes (runs
of one class of characters without a break) are merged in the same order with a heap, in n * log(n).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_slices

#: Widths of the matrices; cells of one matrix at most.
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256)
WIDEST, CELLS = WIDTHS[-1], 1 << 18
#: Distinct pieces, and bytes in them, beyond which a worker forgets what it has merged.
KNOWN_PIECES, KNOWN_BYTES = 100_000, 4 << 20
#: Ids that are decoded at a time.
SLICE_IDS = 1 << 18
#: Characters of a text that are cut into pieces at a time; pieces that wait until those that are new among them are merged.
CHUNK, PENDING = 1 << 18, 1 << 18
_NONE = np.int32(2**31 - 1)
_EMPTY = np.uint64(2**64 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Pairs:
    """An open-addressing hash table from pairs of token ids to the id of the token they merge to."""

    def __init__(self, left: np.ndarray, right: np.ndarray, token: np.ndarray):
        bits = max(4, (4 * len(token)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._keys, self._tokens = np.full(1 << bits, _EMPTY), np.full(1 << bits, _NONE, np.int32)
        key = self._key(left, right)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            at = slot[todo]
            free = self._keys[at] == _EMPTY
            self._keys[at[free]] = key[todo[free]]
            held = self._keys[at] == key[todo]
            self._tokens[at[held]] = token[todo[held]]
            todo = todo[~held]
            slot[todo] = (slot[todo] + 1) & self._mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint32).astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _MULTIPLIER) >> self._shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens of pairs, _NONE for what is no pair (such as holds the filler -1)."""
        key = self._key(left.ravel(), right.ravel())
        slot = self._slot(key)
        found = self._keys[slot]
        out = np.where(found == key, self._tokens[slot], _NONE)
        todo = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self._mask
            found = self._keys[slot[todo]]
            same = found == key[todo]
            out[todo[same]] = self._tokens[slot[todo[same]]]
            todo = todo[~same & (found != _EMPTY)]
        return out.reshape(left.shape)


class _Known(dict):
    """Numbers pieces in the order in which they are first asked for; `new` holds those that are not merged yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


def library_classes() -> dict[str, str]:
    """The letters (L) and numbers (N) of the tiktoken library as bodies of character classes, and where this interpreter's regex module has others (odd): their versions of Unicode differ."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    single = {bytes([b]): b for b in range(256)}
    found, odd = {}, set()
    for name in "LN":
        encoding = tiktoken.Encoding(name, pat_str=rf"\p{{{name}}}", mergeable_ranks=single, special_tokens={})
        theirs, ours = set(encoding.decode(encoding.encode_ordinary(every))), set(regex.findall(rf"\p{{{name}}}", every))
        found[name], odd = _ranges(theirs), odd | (theirs ^ ours)
    return found | {"odd": _ranges(odd)}


def _ranges(characters: set[str]) -> str:
    codes = np.array(sorted(map(ord, characters)), np.int64)
    if not len(codes):
        return ""
    cut = np.flatnonzero(np.diff(codes) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[np.append(0, cut + 1)], codes[np.append(cut, len(codes) - 1)], strict=True))


class Cutter:
    """Cuts texts into pieces as the tiktoken library does by `pattern`, all of whose characters must lie in some piece."""

    #: No alternative of a pattern that matches a fixed string is longer, and none looks further ahead.
    AHEAD = 4

    def __init__(self, pattern: str, classes: dict[str, str]):
        self._plain = regex.compile(pattern)
        self._odd = regex.compile(f"[{classes['odd']}]") if classes["odd"] else None
        theirs = pattern.replace(r"\p{L}", "\0").replace(r"\p{N}", "\1")
        inside = regex.sub(r"(\[\^?)([^\]]*)\]", lambda m: m[1] + m[2].replace("\0", classes["L"]).replace("\1", classes["N"]) + "]", theirs)
        self._exact = regex.compile(inside.replace("\0", f"[{classes['L']}]").replace("\1", f"[{classes['N']}]"))

    def __call__(self, text: str) -> Iterator[list[str]]:
        """The pieces in order, in lists of those of about CHUNK characters."""
        find = (self._exact if self._odd is not None and not text.isascii() and self._odd.search(text) else self._plain).findall
        at, size = 0, CHUNK
        while at + size < len(text):
            pieces = find(text, at, at + size)
            end = size
            while pieces and end > size - self.AHEAD:  # what ends here could go on or be cut otherwise
                end -= len(pieces.pop())
            if pieces:
                yield pieces
                at, size = at + end, CHUNK
            else:
                size *= 2
        if pieces := find(text, at):
            yield pieces


def read_ranks(ranks: bytes) -> dict[bytes, int]:
    """Of a file's lines, base64 of a token's bytes and its rank, which is its id."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}


class Vocabulary:
    """The bytes of tokens, by their ids."""

    def __init__(self, ranks: bytes):
        by_id = sorted(read_ranks(ranks).items(), key=lambda x: x[1])
        size = np.full(by_id[-1][1] + 1, -1)
        size[[r for _, r in by_id]] = [len(t) for t, _ in by_id]
        self._size, self._at = size, np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
        self._data = np.frombuffer(b"".join(t for t, _ in by_id), np.uint8)

    def decode(self, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of lists of ids, one after the other, and where each list's begin (with the total at the end)."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self._size) and (self._size[ids] >= 0).all()):
            raise ValueError("an id is no token")
        size = self._size[ids]
        end = np.concatenate([[0], np.cumsum(size)])
        return self._data[np.repeat(self._at[ids] - end[:-1], size) + np.arange(end[-1])], end[start]


class BytePairEncoder:
    """Encodes texts by a file of ranks."""

    def __init__(self, ranks: bytes, pattern: str, classes: dict[str, str]):
        self._ranks = read_ranks(ranks)
        self._bytes = np.array([self._ranks[bytes([b])] for b in range(256)], np.int32)
        get = self._ranks.get
        made = [(a, b, r) for token, r in self._ranks.items() for i in range(1, len(token)) if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None]
        left, right, token = np.array(made, np.int64).reshape(-1, 3).T
        self.pairs = Pairs(left, right, token.astype(np.int32))
        self._cut = Cutter(pattern, classes)
        self._forget()

    def _forget(self) -> None:
        self._known, self._held = _Known(), 0
        self._ids, self._at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and where each piece's begin (with the total at the end)."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.concatenate([[0], np.cumsum(size)])
        out = self._bytes[np.frombuffer(b"".join(pieces), np.uint8)]  # room for each piece's bytes, of which its ids take the first
        whole = np.fromiter((self._ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
        count = np.where(whole >= 0, 1, size)
        out[start[:-1][whole >= 0]] = whole[whole >= 0]
        below = 1
        for width in WIDTHS:
            rows = np.flatnonzero((whole < 0) & (size > below) & (size <= width))
            below = width
            for first in range(0, len(rows), max(1, CELLS // width)):
                self._rounds(rows[first : first + max(1, CELLS // width)], width, start, size, out, count)
        for i in np.flatnonzero((whole < 0) & (size > WIDEST)):
            ids = self._by_heap(pieces[i])
            out[start[i] : start[i] + len(ids)] = ids
            count[i] = len(ids)
        at = np.concatenate([[0], np.cumsum(count)])
        return out[np.repeat(start[:-1] - at[:-1], count) + np.arange(at[-1])], at

    def _rounds(self, rows: np.ndarray, width: int, start: np.ndarray, size: np.ndarray, out: np.ndarray, count: np.ndarray) -> None:
        cols, left = np.arange(width), size[rows]
        inside = cols < left[:, None]
        tokens = np.where(inside, out[np.minimum(start[rows][:, None] + cols, len(out) - 1)], np.int32(-1))
        ranks = self.pairs(tokens[:, :-1], tokens[:, 1:])
        while len(rows):
            each = np.arange(len(rows))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)  # the leftmost of the least
            best = ranks[each, at] if ranks.shape[1] else np.full(len(rows), _NONE)
            done = best == _NONE
            if done.any():
                ended = rows[done]
                inside = np.arange(tokens.shape[1]) < left[done][:, None]
                n = left[done]
                out[np.repeat(start[ended] - np.cumsum(n) + n, n) + np.arange(n.sum())] = tokens[done][inside]
                count[ended] = n
                keep = ~done
                rows, tokens, ranks, left, at, best = rows[keep], tokens[keep], ranks[keep], left[keep], at[keep], best[keep]
                each = np.arange(len(rows))
                if not len(rows):
                    return
            tokens[each, at] = best
            stay = np.ones(tokens.shape, bool)
            stay[each, at + 1] = False
            tokens = tokens[stay].reshape(len(rows), -1)
            stay = np.ones(ranks.shape, bool)
            stay[each, at] = False
            ranks = ranks[stay].reshape(len(rows), -1)
            left = left - 1
            for i in (at - 1, at):  # the pairs that the new token is in
                own = np.flatnonzero((i >= 0) & (i < ranks.shape[1]))
                ranks[own, i[own]] = self.pairs(tokens[own, i[own]], tokens[own, i[own] + 1])

    def _by_heap(self, piece: bytes) -> np.ndarray:
        """One long piece: tokens are spans of its bytes, and spans that are merged or gone are passed over when they come up."""
        n, ranks = len(piece), self._ranks
        after, before = list(range(1, n + 2)), list(range(-1, n))  # of the token that begins at a byte; after[i] is also its end
        alive = [True] * n

        def pair(i: int):
            j = after[i]
            if j < n and (r := ranks.get(piece[i : after[j]])) is not None:
                heapq.heappush(heap, (r, i, j, after[j]))

        heap: list[tuple[int, int, int, int]] = []
        for i in range(n - 1):
            pair(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not alive[i] or after[i] != j or j >= n or not alive[j] or after[j] != k:
                continue
            alive[j], after[i] = False, k
            if k < n:
                before[k] = i
                pair(i)
            if before[i] >= 0:
                pair(before[i])
        return np.array([ranks[piece[i : after[i]]] for i in range(n) if alive[i]], np.int32)

    def _settle(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces by their numbers, and how many each has. Merges the pieces that are new, and forgets all if they have become too many."""
        if self._known.new:
            pieces = [p.encode() for p in self._known.new]
            ids, at = self.merge(pieces)
            self._ids, self._at = np.concatenate([self._ids, ids]), np.concatenate([self._at, self._at[-1] + at[1:]])
            self._held += sum(map(len, pieces))
            self._known.new.clear()
        every = np.concatenate(codes)
        size = np.diff(self._at)[every]
        end = np.cumsum(size)
        found = self._ids[np.repeat(self._at[every] - end + size, size) + np.arange(end[-1])]
        if len(self._known) > KNOWN_PIECES or self._held > KNOWN_BYTES:
            self._forget()
        return found, size

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and where each text's begin (with the total at the end). A null text counts as empty."""
        out, count, codes, owner, held = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), [], [], 0
        for i, text in enumerate(texts):
            for pieces in self._cut(text or ""):
                codes.append(np.fromiter(map(self._known.__getitem__, pieces), np.int64, len(pieces)))
                owner.append(np.full(len(pieces), i))
                held += len(pieces)
                if held > PENDING:
                    ids, size = self._settle(codes)
                    out.append(ids)
                    count += np.bincount(np.concatenate(owner), size, len(texts)).astype(np.int64)
                    codes, owner, held = [], [], 0
        if codes:
            ids, size = self._settle(codes)
            out.append(ids)
            count += np.bincount(np.concatenate(owner), size, len(texts)).astype(np.int64)
        return np.concatenate(out), np.concatenate([[0], np.cumsum(count)])


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row, by the ranks in `ranks_path`, without special tokens; each match of `pattern` is encoded apart.

    A null or empty text has no ids. Rows that repeat an id, or have none, are encoded each for itself; other columns, whatever
    their names, take no part. Texts are encoded whole. The file of ranks is read on the driver and sent to the executors (some
    MB: a vocabulary does not grow with the data).
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast((f.read(), pattern, library_classes()))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BytePairEncoder(*shared.value)
        for batch in batches:
            for row, n in row_slices(batch.column(1)):
                ids, start = encoder.encode(batch.column(1).slice(row, n).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return _text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """`encoded` (with ids array<int>) and `decoded` binary, the bytes of its ids. Null ids are decoded to no bytes; an id that the file of ranks lacks is an error."""
    with open(ranks_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    base = encoded.drop("decoded")
    schema = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            size = np.diff(lists.offsets.to_numpy())
            start = np.concatenate([[0], np.cumsum(np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, size))])
            flat = lists.flatten().to_numpy()
            first = 0
            while first < len(lists):  # about SLICE_IDS at a time
                end = max(first + 1, int(np.searchsorted(start, start[first] + SLICE_IDS, "right")) - 1)
                data, at = vocabulary.decode(flat[start[first] : start[end]], start[first : end + 1] - start[first])
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - first, [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, text], [*batch.schema.names, "decoded"])
                first = end

    return base.mapInArrow(run, f"{schema}, decoded binary")
