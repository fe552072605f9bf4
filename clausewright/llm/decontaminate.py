"""Benchmark decontamination: a BM25 inverted index of test items with block maxima, queried by every training passage.

Items lie in the index by length, in blocks of BLOCK. A passage is the query and its distinct words the terms; an item's
score is divided by what the item scores on itself, so that 1 means that all of its words occur. For a batch of passages at a
time: the sum of the terms' greatest impacts (the pivot test) drops passages for which no item can reach the threshold, the
sums of block maxima drop blocks, and only items of the blocks left are scored. No passage is sampled and no list is cut, so
all items at or above the threshold are retrieved. Retrieved items are then verified on word n-grams of question and answer.

Items of few words, and those in scripts written without spaces, whose words are not cut, are looked up apart: as a whole, in
units that are words or, in such scripts, single characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, scratch, small, stage, text_slices
from .shingles import NOT_ALNUM, word_hashes

BLOCK, SHARD_ITEMS, INDEX_BYTES = 16, 1024, 64 << 20
K1, B = 1.2, 0.75
NGRAM, LEAD = 5, 8
_CUT = re.compile(r"(?:\n\s*(?:A|Answer)\s*[:.]|[.?!]\s)(?=\s*\S)")
_BLANK = re.compile(r"\s\s++")
_CUT_ALSO = r"[\p{Z}\p{P}\p{Cc}\p{Cf}]"
#: Scripts written without spaces; each of their characters is a unit, and so is each symbol.
_SCRIPTS = r"\p{Han}\p{Hiragana}\p{Katakana}\x{3000}-\x{30FF}\x{FF66}-\x{FF9F}\p{Bopomofo}\p{Yi}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}\p{Javanese}\p{Balinese}\p{Tai_Le}\p{Tai_Tham}\p{New_Tai_Lue}"
_SINGLE = "[" + _SCRIPTS + r"\p{S}]"
_MASK = np.uint64(0xD6E8FEB86659FD93)


def _spaced(texts: pa.Array) -> pa.Array:
    """Lower-case texts in which NOT_ALNUM cuts the units apart."""
    return pc.replace_substring_regex(pc.replace_substring_regex(pc.utf8_lower(texts), _CUT_ALSO, " "), f"({_SINGLE})", r" \1 ")


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]), NOT_ALNUM)[0]


def question_answer(text: str) -> tuple[str, str]:
    """An item's question and answer: at a line "Answer:", else before the last sentence, else in the middle of the words. Of white space, only whether it has a line end counts."""
    text = _BLANK.sub(lambda m: m[0][0] + ("\n" if "\n" in m[0][1:] else ""), text)
    cuts = list(_CUT.finditer(text.strip()))
    if cuts:
        at = next((m for m in cuts if "\n" in m[0] and ":" in m[0]), cuts[-1]).end()
        question, answer = text.strip()[:at], text.strip()[at:]
        if len(_words(question)) and len(_words(answer)):
            return question, answer
    words = text.split()
    return " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        out = out * _MASK + words[i : i + len(out)]
    return mix64(out)


class Shard:
    """The index of up to SHARD_ITEMS items (item_id, text, number of words, terms, how often each comes, items that have it): postings by block, block maxima by term.

    `items` and `mean` are the number and mean length of all items of the benchmark.
    """

    def __init__(self, rows: list[tuple], items: int, mean: float):
        self.ids = [r[0] for r in rows]
        self.span = max(64, *(r[2] for r in rows))
        self.parts = [[(min(NGRAM, len(p)), np.unique(_runs(p, min(NGRAM, len(p))))) for p in map(_words, question_answer(r[1]))] for r in rows]
        count = np.array([len(r[3]) for r in rows])
        term = np.concatenate([np.asarray(r[3], np.int64) for r in rows]).view(np.uint64)
        tf, df = (np.concatenate([np.asarray(r[i], float) for r in rows]) for i in (4, 5))
        item = np.repeat(np.arange(len(rows)), count)
        long = K1 * (1 - B + B * np.array([r[2] for r in rows], float)[item] / mean)
        impact = np.log(1 + (items - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + long)
        impact /= np.bincount(item, impact)[item]
        self.terms, at = np.unique(term, return_inverse=True)
        self.block_max = np.zeros((len(self.terms), -(-len(rows) // BLOCK)), np.float32)
        np.maximum.at(self.block_max, (at, item // BLOCK), impact)
        self.term_max = self.block_max.max(axis=1)
        self.postings = []
        for b in range(self.block_max.shape[1]):
            own = item // BLOCK == b
            have, row = np.unique(at[own], return_inverse=True)
            held = np.zeros((len(have), BLOCK), np.float32)
            held[row, item[own] % BLOCK] = impact[own]
            self.postings.append((have.astype(np.int32), held))
        self.hit = np.zeros(1 << 16, bool)
        self.hit[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def bytes(self) -> int:
        return sum(x.nbytes for x in (self.terms, self.block_max, self.term_max, self.hit)) + sum(t.nbytes + h.nbytes for t, h in self.postings) + sum(g.nbytes + 200 for parts in self.parts for _, g in parts)

    def search(self, words: np.ndarray, start: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """(document, first word of the passage in it, item, score) of all passages: 2 * span words, every span words."""
        maybe = np.flatnonzero(self.hit[(words & np.uint64(0xFFFF)).astype(np.int64)])
        term = np.searchsorted(self.terms, words[maybe])
        known = self.terms[np.minimum(term, len(self.terms) - 1)] == words[maybe]
        place, term = maybe[known], term[known]
        doc = np.searchsorted(start, place, "right") - 1
        stretches = -(-np.diff(start) // self.span)
        first = np.cumsum(stretches) - stretches
        stretch = (place - start[doc]) // self.span
        width = np.int64(len(self.terms))
        later = stretch > 0
        key = np.unique(np.concatenate([(first[doc] + stretch) * width + term, (first[doc] + stretch - 1)[later] * width + term[later]]))
        passage, term = key // width, key % width
        cut = np.flatnonzero(np.diff(passage, prepend=-1))
        if not len(cut):
            return
        slack = np.float32(threshold - 1e-4)  # sums of float32
        size = np.diff(np.append(cut, len(key)))
        able = np.add.reduceat(self.term_max[term], cut) >= slack
        keep = np.repeat(able, size)
        passage, term = passage[keep], term[keep]
        if not len(term):
            return
        size = size[able]
        cut = np.cumsum(size) - size
        bound = np.add.reduceat(self.block_max[term], cut, axis=0) >= slack
        for b in np.flatnonzero(bound.any(axis=0)).tolist():
            own = bound[:, b]
            rows, sizes = term[np.repeat(own, size)], size[own]
            have, held = self.postings[b]
            at = np.minimum(np.searchsorted(have, rows), len(have) - 1)
            among = have[at] == rows  # each of these passages has a term of the block
            of = np.repeat(np.arange(len(sizes)), sizes)[among]
            score = np.add.reduceat(held[at[among]].astype(np.float64), np.searchsorted(of, np.arange(len(sizes))), axis=0)
            which = passage[cut[own]]
            for p, j in zip(*np.nonzero(score >= threshold - 1e-6), strict=True):
                item = b * BLOCK + int(j)
                if item < len(self.ids):
                    d = int(np.searchsorted(first, which[p], "right") - 1)
                    yield d, int((which[p] - first[d]) * self.span), item, float(score[p, j])

    def overlap(self, item: int, passage: np.ndarray, grams: dict[int, np.ndarray]) -> tuple[float, float]:
        """The shares of the question's and of the answer's n-grams that the passage has."""
        shares = []
        for n, own in self.parts[item]:
            if n not in grams:
                grams[n] = _runs(passage, n) if n else np.zeros(0, np.uint64)
            shares.append(float(np.isin(own, grams[n]).mean()) if len(own) else 0.0)
        return shares[0], shares[1]


class Runs:
    """Items (key, item id, text) that are looked up as a whole: by the hash of their first LEAD units, then by all units."""

    def __init__(self, items: list[tuple[tuple, int | None, str]]):
        self.items: list[tuple[tuple, int | None, np.ndarray]] = []
        by: dict[int, dict[int, list[int]]] = {}
        for key, item_id, text in items:
            raw = np.frombuffer(_spaced(pa.array([text]))[0].as_py().encode(), np.uint8)
            units = word_hashes(raw, np.array([0, len(raw)]), NOT_ALNUM)[0]
            if len(units):
                lead = min(len(units), LEAD)
                by.setdefault(lead, {}).setdefault(int(_runs(units[:lead], lead)[0]), []).append(len(self.items))
                self.items.append((key, item_id, units))
        self.by = {lead: (np.array(sorted(own), np.uint64), [own[h] for h in sorted(own)]) for lead, own in by.items()}

    def bytes(self) -> int:
        return sum(u.nbytes + 400 for *_, u in self.items)

    def search(self, units: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, first unit, item) of each item's first place in each document that holds it."""
        for lead, (hashes, owners) in self.by.items():
            found = _runs(units, lead)
            which = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            place = np.flatnonzero(hashes[which] == found)
            doc = np.searchsorted(start, place, "right") - 1
            inside = place + lead <= start[doc + 1]
            place, doc, which = place[inside], doc[inside], which[place[inside]]
            if lead < LEAD:  # hashes are of whole items
                once = np.unique(doc * len(hashes) + which, return_index=True)[1]
                place, doc, which = place[once], doc[once], which[once]
            seen = set()
            for p, d, w in zip(place.tolist(), doc.tolist(), which.tolist(), strict=True):
                for item in owners[w]:
                    own = self.items[item][2]
                    if (d, item) not in seen and p + len(own) <= start[d + 1] and np.array_equal(units[p : p + len(own)], own):
                        seen.add((d, item))
                        yield d, int(p - start[d]), item


def _searcher(shared, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, runs = shared.value
        for batch in batches:
            ids = batch.column(0)
            found: list[tuple] = []
            whole = set()
            for row, data, at in text_slices(_spaced(batch.column(1))) if runs.items else ():
                for d, first, item in runs.search(*word_hashes(data, at, NOT_ALNUM)):
                    whole.add((row + d, runs.items[item][0]))
                    found.append((ids[row + d].as_py(), runs.items[item][1], first, 1.0, 1.0, 1.0))
            for row, data, at in text_slices(pc.utf8_lower(batch.column(1))):
                words, start = word_hashes(data, at, NOT_ALNUM)
                for k, shard in enumerate(shards):
                    best: dict[tuple[int, int], tuple] = {}
                    grams: dict[tuple[int, int], dict[int, np.ndarray]] = {}
                    for d, first, item, score in shard.search(words, start, threshold):
                        passage = words[start[d] + first : min(start[d + 1], start[d] + first + 2 * shard.span)]
                        q, a = shard.overlap(item, passage, grams.setdefault((d, first), {}))
                        if q >= overlap and a >= overlap:
                            best[d, item] = max(best.get((d, item), (-1.0, 0)), (q + a, -first, score, q, a))
                    found += [(ids[row + d].as_py(), shard.ids[item], -first, score, q, a) for (d, item), (_, first, score, q, a) in best.items() if (row + d, (k, item)) not in whole]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True) if found else [()] * 6, [pa.int64()] * 3 + [pa.float64()] * 3, strict=True)], ["doc_id", "item_id", "first_word", "score", "question_overlap", "answer_overlap"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.5, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and benchmark item that it contains: doc_id, item_id, first_word (of the passage that matches best), score, question_overlap, answer_overlap.

    A passage is `2 * span` words at every `span` words of the whole text, where span is 64 or the longest item of its index
    shard (SHARD_ITEMS items of like length); words are lower-case runs of letters and digits. Retrieved: score of at least `threshold`. Verified: at least the
    share `overlap` of the n-grams (5 words) of the item's question, and of its answer, occur in the passage. Items of fewer
    than `min_words` words and those in scripts without spaces (see _SCRIPTS) are found where all of their units stand in one
    run, whatever cuts them; first_word is then the first unit, score and overlaps are 1. Such an item of one common word is
    found in every document with that word. Items without a unit tell nothing; rows that repeat an item_id are items of their own.
    Null and empty texts contain nothing; null ids are returned as null. Other columns of `docs` and `items` take no part.
    How many items have a word, and their number and mean length, are counted over all items. The index is built on the driver,
    item by item in order of length, and broadcast in passes of about INDEX_BYTES, each of which reads `docs` once.
    """
    found, _ = _contaminated(docs, items, threshold, overlap, min_words, id_col, text_col)
    return found


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for text in batch.column(1).to_pylist():
            words = _words(text)
            term, count = np.unique(words, return_counts=True)
            rows.append((len(words), term.view(np.int64), count))
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["n", "words", "terms", "counts"])


def _indexes(items: DataFrame, min_words: int, folder: str) -> Iterator[tuple[list[Shard], Runs]]:
    """The items' index, pass by pass."""
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("length(text) > 0")
    wanted = stage(wanted.withColumn("n", F.monotonically_increasing_id()), f"{folder}/items")
    counted = stage(wanted.select("n", "text").mapInArrow(_terms_of, "n long, words long, terms array<long>, counts array<long>"), f"{folder}/terms")
    indexed = counted.filter(F.col("words") >= min_words)
    total, mean = indexed.agg(F.count(F.lit(1)), F.avg("words")).first()
    single = indexed.select("n", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("n", F.col("t.terms").alias("term"), F.col("t.counts").alias("tf"))
    df = small(stage(single.groupBy("term").agg(F.count(F.lit(1)).alias("df")), f"{folder}/df"))
    listed = single.join(df, "term").groupBy("n").agg(F.collect_list(F.struct("term", "tf", "df")).alias("t"))
    listed = listed.select("n", "t.term", "t.tf", "t.df")
    ordered = wanted.join(counted.select("n", "words"), "n").join(listed, "n", "left").orderBy("words", "item_id", "text", "n")
    shards: list[Shard] = []
    held: list[tuple] = []
    runs: list[tuple] = []
    size = 0

    def closed() -> tuple[list[Shard], Runs]:
        nonlocal shards, runs, size
        out = shards, Runs(runs)
        shards, runs, size = [], [], 0
        return out

    for r in stage(ordered, f"{folder}/ordered").orderBy("words", "item_id", "text", "n").toLocalIterator(prefetchPartitions=False):
        if r.words < min_words:
            runs.append(((-1, r.n), r.item_id, r.text))
            size += 400 + 8 * len(r.text)
        else:
            if pc.match_substring_regex(pa.array([r.text]), f"[{_SCRIPTS}]")[0].as_py():
                runs.append(((len(shards), len(held)), r.item_id, r.text))
                size += 400 + 8 * len(r.text)
            held.append((r.item_id, r.text, r.words, r.term, r.tf, r.df))
        if len(held) == SHARD_ITEMS or held and size + 300 * sum(len(h[3]) for h in held) >= INDEX_BYTES:
            shards.append(Shard(held, total, mean))
            size, held = size + shards[-1].bytes(), []
        if not held and size >= INDEX_BYTES:
            yield closed()
    if held:
        shards.append(Shard(held, total, mean))
    yield closed()


def _contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.5, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list]:
    """What contaminated() returns, and the broadcast indexes that it holds."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, first_word long, score double, question_overlap double, answer_overlap double"
    folder = scratch(spark)
    done: list[DataFrame] = []
    now: tuple | None = None

    def end() -> None:  # a pass is done, and its index gone, before the next begins
        done.append(stage(now[0], f"{folder}/pass{len(done)}"))
        now[1].destroy()

    for index in _indexes(items, min_words, folder):
        if now is not None:
            end()
        shared = spark.sparkContext.broadcast(index)
        now = source.mapInArrow(_searcher(shared, threshold, overlap), schema), shared
    if not done:
        return now[0], [now[1]]
    end()
    return reduce(DataFrame.unionByName, done), []


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """`docs` without the documents that contain an item (see contaminated()); all columns and all other rows stay, those with a null id too."""
    id_col = how.get("id_col", "doc_id")
    found, indexes = _contaminated(docs, items, **how)
    leaks = small(stage(found.select(F.col("doc_id").alias("_leak")).distinct(), f"{scratch(docs.sparkSession)}/leaks"))
    for index in indexes:
        index.unpersist()
    return docs.join(leaks, docs[id_col] == leaks["_leak"], "left_anti")
