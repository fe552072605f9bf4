"""What a text cites: the standards it names and the clauses, sentence by sentence. Plain functions; each is tried on one text."""

from __future__ import annotations

import re
import unicodedata

from . import rules as R


def _compiled(pattern: str) -> re.Pattern:
    """A pattern of `rules` as this interpreter writes it: white space is that of Unicode there."""
    space = f"[{R.WHITE_SPACE}]"
    return re.compile(pattern.replace(r"(?U:\s)", space).replace(r"(?U:\d)", r"\d").replace("(?U)", "").replace(r"\s", space))


STANDARD, LABELLED, BARE, APPENDIX, YEAR, QUANTITY, SENTENCE_END = map(_compiled, (R.STANDARD, R.LABELLED, R.BARE, R.LETTERED, R.YEAR, R.QUANTITY, R.SENTENCE_END))
_DOTTED, _SPACES = re.compile(r"\d+(?:\.\d+)+"), re.compile(f"[{R.WHITE_SPACE}]+")
_PLAIN = str.maketrans(R.DASHES, R.PLAIN_DASHES)


def _spelled(found: str) -> str:
    clean = _SPACES.sub(" ", found).strip(R.WHITE_SPACE)
    m = STANDARD.search(clean)
    if m is None or m[1] == "T":
        return clean
    return m[1] + ("/T" if m[2] else "") + " " + m[3] + ("-" + m[4] if m[4] else "")


def standards(text: str) -> list[str]:
    """The distinct standards that a text names, normalized and sorted. Lower-case prefixes are not names."""
    return sorted({_spelled(m[0]) for m in STANDARD.finditer(text.translate(_PLAIN))})


def _key(number: str) -> str:
    m = _DOTTED.match(number)
    return m[0] if m else number


def _ends_word(text: str, at: int) -> bool:
    """Whether no letter, mark, digit or connector stands at `at`."""
    c = text[at : at + 1]
    return not c or not (unicodedata.category(c)[0] in "LM" or unicodedata.category(c) in ("Nd", "Nl", "Pc") or c in "\u200c\u200d" or "\u24b6" <= c <= "\u24e9")


def article_numbers(text: str) -> list[str]:
    """The distinct clause keys that a text cites, sorted: labelled ones, bare ones of two levels or more (after standards, years and quantities are cut), and lettered appendices."""
    t = text.replace("．", ".")
    keys = {_key(m[1]) for m in LABELLED.finditer(t)}
    cut = QUANTITY.sub(" ", YEAR.sub(" ", STANDARD.sub(" ", t)))
    keys.update(k for m in BARE.finditer(cut) if "." in (k := _key(m[1])))
    keys.update("附录" + m[1].upper() for m in APPENDIX.finditer(t) if _ends_word(t, m.end()))
    return sorted(keys)


def sentences(text: str) -> list[str]:
    return [s for s in (p.strip(R.WHITE_SPACE) for p in SENTENCE_END.split(text)) if s]


class Reader:
    """Sentences read by article_numbers() and standards(), of which short ones that come again are read once: at most `most` of them are kept."""

    def __init__(self, most: int = 20_000, longest: int = 300):
        self.most, self.longest, self.known = most, longest, {}

    def read(self, sentence: str) -> tuple[list[str], list[str]]:
        found = self.known.get(sentence)
        if found is None:
            keys = article_numbers(sentence)
            found = keys, standards(sentence) if keys else []
            if len(sentence) <= self.longest:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[sentence] = found
        return found
