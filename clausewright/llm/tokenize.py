"""Token ids of whole texts by the tokenizers library, with a cache of words where the tokenizer works word by word."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words that the cache of a worker holds at most.
CACHE_WORDS = 100_000
BETWEEN = "~"
#: Fixed: the pattern of pre-tokens for which _CUTS holds.
_PRE_TOKENS = str({"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"})
_SIGN = r"!-/:-@\[-`{-~"
_CUTS = ((rf"([a-z])([{_SIGN}])", r"\1 \2"), ("([0-9])", r" \1 "), (r"([!-&(-/:-@\[-`{-~])([a-z])", r"\1 \2"))
#: Marks of special tokens, and what utf8_split_whitespace() alone takes for white space.
_ODD = r"[\x1c-\x1f]|<\|"
#: The byte alphabet: bytes that are no visible character of Latin-1 stand for the characters from U+0100 on. Here, but for ASCII.
_BYTES = {b: 0x100 + 33 + i for i, b in enumerate([*range(0x7F, 0xA1), 0xAD])}


def drops_white_space(config: dict) -> bool:
    """Whether the tokenizer turns each run of white space into one space and cuts it away, so that words are encoded apart."""
    norm = config.get("normalizer") or {}
    parts = norm.get("normalizers", [norm])
    pre = config.get("pre_tokenizer") or {}
    split = (pre.get("pretokenizers") or [pre])[0]
    squeezed = any(p.get("type") == "Replace" and p.get("pattern") == {"Regex": "\\s+"} and p.get("content") == " " for p in parts)
    plain = all(p.get("type") in ("NFC", "Replace", "Lowercase") for p in parts)
    return squeezed and plain and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True and "\\s" in str(split.get("pattern"))


class TokenEncoder:
    """encode(texts): the ids of all texts of an Arrow column, one after the other, and the number of ids of each.

    The same ids as Tokenizer.encode(text, add_special_tokens=False) of each whole text. `words` bounds the cache, by words and,
    at 16 characters each, by characters: when it holds more, the words that come up least often are forgotten.
    """

    def __init__(self, path: str, words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        suffix = config["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(self.size, bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.between = vocab.get(BETWEEN + (suffix or ""))  # stands between words that are encoded together
        self.by_word = drops_white_space(config) and bool(self.ends.any()) and self.between is not None
        self.lower = any(p.get("type") == "Lowercase" for p in (config.get("normalizer") or {}).get("normalizers", []))
        self.cuts = self.lower and _PRE_TOKENS in str(config["pre_tokenizer"])
        if self.by_word:  # of Latin letters that neither compose nor change in number, the model takes the lower-case bytes as they are
            self.model = Tokenizer.from_str(json.dumps(config | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.words = words
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.count, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.pool, self.entries, self.used, self.chars = np.zeros(1 << 16, np.uint32), 0, 0, 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        n, first = len(words), self.entries
        while first + n > len(self.start):
            self.start, self.count, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.hits))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.count[first : first + n] = sizes
        self.start[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.hits[first : first + n] = 0
        self.pool[self.used : self.used + len(flat)] = flat
        self.used, self.entries, self.chars = self.used + len(flat), first + n, self.chars + sum(map(len, words))
        self.index.update(zip(words, range(first, first + n), strict=True))

    def _gather(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.count[where]
        total = np.cumsum(size)
        return self.pool[np.repeat(self.start[where] - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)], total

    def _forget(self) -> None:
        """Keeps half of the bound at most: the words of the most hits, and none of over 64 characters or met once."""
        names = [(w, i) for w, i in self.index.items() if len(w) <= 64]
        hits = self.hits[[i for _, i in names]]
        least = max(2, int(np.partition(hits, -self.words // 2)[-self.words // 2]) + 1) if len(hits) > self.words // 2 else 2
        keep = [(w, i) for (w, i), h in zip(names, hits.tolist(), strict=True) if h >= least]
        where = np.array([i for _, i in keep], np.int64)
        flat, _ = self._gather(where)
        sizes, hits = self.count[where], self.hits[where]
        self._empty()
        self._add([w for w, _ in keep], flat, sizes)
        self.hits[: len(keep)] = hits // 2

    def _learn(self, words: list[str]) -> None:
        # One pre-token each, which ends where a token carries the end-of-word mark.
        plain = [w for w in words if w.isalpha() and (w.isascii() or max(w) < "\u0250" and "\u0130" not in w)] if self.lower else []
        plain.sort(key=str.isascii)
        for i in range(0, len(plain), 2000):
            part = plain[i : i + 2000]
            text = " ".join(part).lower()
            text = text if text.isascii() else text.encode().decode("latin-1").translate(_BYTES)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                self._add(part, ids, np.diff(ends, prepend=0))
            else:
                self._learn_whole(part)
        known = set(plain)
        others = [w for w in words if w not in known and BETWEEN not in w]
        for i in range(0, len(others), 500):
            part = others[i : i + 500]
            ids = np.array(self._whole([f" {BETWEEN} ".join(part)])[0], np.int64)
            cut = np.flatnonzero(ids == self.between)
            if len(cut) == len(part) - 1:
                self._add(part, np.delete(ids, cut), np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
            else:
                self._learn_whole(part)
        self._learn_whole([w for w in words if BETWEEN in w])

    def _learn_whole(self, words: list[str]) -> None:
        if words:
            own = self._whole(words)
            self._add(words, np.array([i for ids in own for i in ids], np.uint32), np.array([len(ids) for ids in own], np.int64))

    def _prepared(self, texts: pa.Array) -> pa.Array:
        """Texts of the same ids with fewer different words: ASCII letters in lower case, and cuts where the pattern of pre-tokens always cuts.

        It cuts between an ASCII letter and the ASCII digit or sign behind it, around each digit, and behind a sign, but for the
        apostrophe, which may belong to the letters behind it. Texts with combining marks, which could meet those characters, stay.
        """
        if not self.cuts:
            return texts
        out = pc.ascii_lower(texts)
        for pattern, to in _CUTS:
            out = pc.replace_substring_regex(out, pattern, to)
        return pc.if_else(pc.match_substring_regex(texts, r"\p{M}"), texts, out)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("")
        if not self.by_word:
            ids = self._whole(texts.to_pylist())
            sizes = np.array([len(x) for x in ids], np.int64)
            return np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), sizes
        if len(self.index) > self.words or self.chars > 16 * self.words:
            self._forget()
        odd = pc.match_substring_regex(texts, _ODD)
        lists = pc.utf8_split_whitespace(pc.if_else(odd, "", self._prepared(texts)))
        counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if "" in (index := self.index) or "" in names:  # what white space at an end leaves
            self.index.setdefault("", self.entries)
            if self.index[""] == self.entries:
                self._add([""], np.zeros(0, np.uint32), np.zeros(1, np.int64))
        missing = [w for w in names if w not in index]
        if missing:
            self._learn(missing)
        at = np.array([index[w] for w in names], np.int64)
        self.hits[at] += np.bincount(code, minlength=len(names))
        flat, total = self._gather(at[code])
        ends = np.concatenate([[0], total])[np.cumsum(counts)]
        sizes = np.diff(np.concatenate([[0], ends]))
        where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(where):
            pieces = np.split(flat, ends[:-1])
            for i, ids in zip(where.tolist(), self._whole(texts.take(pa.array(where)).to_pylist()), strict=True):
                pieces[i] = np.array(ids, np.uint32)
                sizes[i] = len(ids)
            flat = np.concatenate(pieces)
        return flat, sizes
