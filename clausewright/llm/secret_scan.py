"""Secrets in whole texts: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Both models give the probability of each character after the one before it. A run of key characters is a secret where the
log-likelihood of the random strings' model exceeds that of the ordinary ones' by a margin; both are trained from samples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import share_of_hashes

#: Fixed patterns, in the order in which kinds are listed: kind, pattern, group that is measured, its least length.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs are whole, so shorter ones need no match
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(128, len(_CHARS), np.int64)
_CODE[[ord(c) for c in _CHARS]] = np.arange(len(_CHARS))
_N = len(_CHARS) + 1  # the last: any other, and the start
SAMPLE_TEXTS, SAMPLE_WORDS, SAMPLE_CHARS = 2_000, 50_000, 64
LEAST_RUN, MARGIN = 12, 12.0


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    return np.concatenate([[_N - 1], _CODE[np.minimum(raw, 127)]])


def train(samples: Iterable[str], smoothing: float = 0.5) -> np.ndarray:
    """Log-probabilities of a character after another. Without samples all characters are equally likely."""
    counts = np.full((_N, _N), smoothing)
    for text in samples:
        c = _codes(text)
        np.add.at(counts, (c[:-1], c[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def random_strings(n: int = 20_000, seed: int = 11) -> list[str]:
    """Samples of the class of random strings: keys in base 64, base 62, base 32 and hexadecimal of 20 to 64 characters."""
    rng = np.random.default_rng(seed)
    alphabets = [_CHARS[:62] + "+/", _CHARS[:62] + "-_", _CHARS[:62], _CHARS[:26] + "234567", "0123456789abcdef", _CHARS[26:62]]
    return ["".join(rng.choice(list(alphabets[i % len(alphabets)]), int(rng.integers(20, 65)))) for i in range(n)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order; whole matches, in code points."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


class RandomStrings:
    """The two models, compared: scan() gives the runs that are likelier random by `margin` nats, of other runs the stretches that are."""

    def __init__(self, random: Iterable[str], ordinary: Iterable[str], margin: float = MARGIN, least: int = LEAST_RUN):
        self.ratio, self.margin, self.least = train(random) - train(ordinary), margin, least
        self.runs = re.compile(f"[A-Za-z0-9+/_=-]{{{least},}}")

    def score(self, text: str) -> float:
        c = _codes(text)
        return float(self.ratio[c[:-1], c[1:]].sum())

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        found = []
        for m in self.runs.finditer(text):
            c = _codes(m[0])
            found += [(m.start() + s, 3, m.start() + e) for s, e in self._stretches(self.ratio[c[:-1], c[1:]])]
        return found

    def _stretches(self, ratio: np.ndarray) -> list[tuple[int, int]]:
        """The whole run, if its sum exceeds the margin; else the stretch of the greatest sum, if that does and has `least` characters, and so on to both sides of it."""
        if ratio.sum() > self.margin:
            return [(0, len(ratio))]
        out, parts = [], [(0, len(ratio))]
        while parts:
            s, e = parts.pop()
            if e - s >= self.least and ratio[s:e].clip(0).sum() > self.margin:
                upto = np.concatenate([[0.0], np.cumsum(ratio[s:e])])
                last = int(np.argmax(upto - np.minimum.accumulate(upto)))
                first = int(np.argmin(upto[: last + 1]))
                if upto[last] - upto[first] > self.margin:
                    if last - first >= self.least:
                        out.append((s + first, s + last))
                    parts += [(s, s + first), (s + last, e)]
        return sorted(out)


def ordinary_words(docs: DataFrame, texts: int = SAMPLE_TEXTS, words: int = SAMPLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Samples of the class of ordinary identifiers: distinct runs of 4 characters or more outside the fixed patterns, from about `texts` texts (all, if fewer; else those of the smallest hashes of id and text), `words` at most, of each its first SAMPLE_CHARS characters."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).filter("length(text) > 0")
    total = rows.count()
    if total > texts:
        rows = rows.filter(share_of_hashes("id", "text", share=texts / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[str] = set()
            for text in batch.column(0).to_pylist():
                at = 0
                for s, _, e in [*base_spans(text), (len(text), 0, len(text))]:
                    found.update(w[:SAMPLE_CHARS] for w in _RUN.findall(text[at:s]) if len(w) >= 4)
                    at = max(at, e)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])

    distinct = rows.select("text").mapInArrow(run, "word string").distinct()
    return [r.word for r in distinct.orderBy(F.xxhash64("word"), "word").limit(words).collect()]


def find_secrets(docs: DataFrame, model: RandomStrings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end by start and kind, comma-joined; the models' kind is `random`).

    Runs of at least `model.least` key characters, or the random stretches in them, outside base spans, are spans. Null and empty texts
    have no span. Null and repeated ids stay as they are; other columns take no part. Texts are scanned whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more, at = [], 0
                for s, _, e in [*base, (len(text), 0, len(text))]:  # what lies between base spans
                    more += [(first + at, kind, last + at) for first, kind, last in model.scan(text[at:s])]
                    at = max(at, e)
                for k in range(3):
                    out[k].append(sum(b[1] == k for b in base))
                out[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out[4].append(joined(sorted(base + more)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
