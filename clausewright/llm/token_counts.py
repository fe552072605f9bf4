"""Token counts of whole texts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton lists all pieces of the vocabulary that end at each character, longest first; the best score and
the piece count of its path are all that is carried. A candidate replaces the best so far only if it scores strictly more,
so among equal paths the one whose last piece is longest wins, as in the tokenizers library. Words that Metaspace splits
apart are counted apart, and counts of short words are kept for the life of the Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: What an unknown character scores below the least piece (fixed by the tokenizers library).
UNKNOWN_BELOW = 10.0
#: Longer words are not kept; a cache of more words is emptied.
KEEP_CHARS, KEEP_WORDS = 48, 500_000
_counters: dict[str, CountOnlyViterbi] = {}


class CountOnlyViterbi:
    """count(text): len(Tokenizer(Unigram(pieces, unk_id, byte_fallback=True)).encode(text).ids) with a Metaspace pre-tokenizer.

    `pieces`: (piece, score) pairs in id order. An unknown run counts its UTF-8 bytes where all of those are pieces, else one.
    """

    def __init__(self, pieces: list[tuple[str, float]], unk_id: int = 0):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        best: dict[str, float] = dict(pieces)  # of a piece that repeats, the last counts
        for piece, score in best.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_BELOW
        self.words: dict[str, int] = {}
        # Characters of no piece cut a word into parts that may be counted apart; only where sums of scores are exact.
        exact = all(float(s).is_integer() and abs(s) < 1 << 30 for s in best.values())
        chars = sorted({c for p in best for c in p})
        self.foreign = re.compile(f"([^{re.escape(''.join(chars))}]+)") if exact and self.bytes else None

    def _best_path(self, word: str) -> int:
        """Pieces on the best path through the word."""
        n = len(word)
        score = [0.0] * (n + 1)
        count = [0] * (n + 1)
        loose = [False] * (n + 1)  # whether the path ends in an unknown character
        unknown, at = self.unknown, 0

        def close(end: int, top: float | None, pieces: int, single: bool) -> None:
            """Takes the unknown character as the last candidate for what ends at `end`."""
            if not single:
                own = score[end - 1] + unknown
                if top is None or own > top:
                    width = len(word[end - 1].encode()) if self.bytes else 0 if loose[end - 1] else 1
                    score[end], count[end], loose[end] = own, count[end - 1] + width, True
                    return
            score[end], count[end] = top, pieces

        top, pieces, single = None, 0, False
        for last, (size, own) in self.automaton.iter(word):
            while at < last:
                at += 1
                close(at, top, pieces, single)
                top, pieces, single = None, 0, False
            start = last + 1 - size
            path = score[start] + own
            if size == 1:
                single = True
            if top is None or path > top:
                top, pieces = path, count[start] + 1
        while at < n:
            at += 1
            close(at, top, pieces, single)
            top, pieces, single = None, 0, False
        return count[n]

    def _word(self, word: str) -> int:
        if self.foreign is None:
            return self._best_path(word)
        total = 0
        for i, part in enumerate(self.foreign.split(word)):
            if i % 2:
                total += len(part.encode())
            elif part:
                known = self.words.get(part)
                if known is None:
                    known = self._best_path(part)
                    if len(part) <= KEEP_CHARS:
                        self.words[part] = known
                total += known
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        parts = (marked if marked.startswith(MARK) else MARK + marked).split(MARK)
        words, total = self.words, 0
        if len(words) > KEEP_WORDS:
            words.clear()
        for i in range(1, len(parts)):
            word = MARK + parts[i]
            known = words.get(word)
            if known is None:
                known = self._word(word)
                if len(word) <= KEEP_CHARS:
                    words[word] = known
            total += known
        return total


def sentencepiece_pieces(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file and the scores it gives them, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def _counter(path: str) -> CountOnlyViterbi:
    if path not in _counters:
        _counters[path] = CountOnlyViterbi(sentencepiece_pieces(path))
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: doc_id, n_tokens of its whole text. Null and empty texts have 0; null and repeated ids and ties stay as they are; other columns take no part. The vocabulary file is opened on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            counts = [counter.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
