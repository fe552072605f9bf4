"""Citation algebra as column expressions: standards, clause numbers, sentences, runs shared by question and text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import cited
from . import rules as R
from .runs import greedy_longest


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(text, F.lit(R.WHITE_SPACE))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def plain_dashes(text: Column) -> Column:
    return F.translate(text, R.DASHES, R.PLAIN_DASHES)


def normalize_standard(text: Column, known: Column | None = None) -> Column:
    """One spelling for a standard's number, like `GB 50352-2019`; null becomes ''. Text that holds none is only cleaned.

    `known`: an array of normalized standards, of which the first with the same number completes a missing year.
    """
    clean = strip(F.regexp_replace(F.upper(plain_dashes(F.coalesce(text, F.lit("")))), r"(?U)\s+", " "))

    def spelled(t: Column, prefix: Column) -> Column:
        slash, number, year = (F.regexp_extract(t, R.STANDARD, g) for g in (2, 3, 4))
        head = F.concat(prefix, F.when(slash != "", "/T").otherwise(""), F.lit(" "), number)
        full = F.when(year != "", F.concat(head, F.lit("-"), year))
        if known is not None:
            full = F.coalesce(full, F.get(F.filter(known, lambda k: F.startswith(k, F.concat(head, F.lit("-")))), 0))
        return F.when(prefix.isin("", "T"), t).otherwise(F.coalesce(full, head))

    given = F.coalesce(text, F.lit(""))  # most lack nothing, or the space
    return F.when(given.rlike(R.NORMAL_STANDARD), text).when(given.rlike(R.CLOSE_STANDARD), F.regexp_replace(given, R.CLOSE_STANDARD, "$1 $2")).otherwise(_let(clean, lambda t: _let(F.regexp_extract(t, R.STANDARD, 1), lambda prefix: spelled(t, prefix))))


def article_key(number: Column) -> Column:
    """The key of a clause number without its wrapping: `第 3.1.6 条` is 3.1.6, `4.3.5-表` is 4.3.5, `附表 b` is 附录B; digits are never changed."""
    two = r"(?U)^(\d+)\s*[-—]\s*(\d+)$"

    def unwrapped(t: Column) -> Column:
        return strip(F.regexp_replace(F.regexp_replace(t, "^(第|表|附表|条文号)", ""), "(条|款|项)$", ""))

    def plain(bare: Column) -> Column:
        letter = F.regexp_extract(bare, r"(?U)^([A-Za-z])\s*+-?\s*+\d+$", 1)
        dotted = F.regexp_extract(bare, r"(?U)^(\d+(?:\.\d+)+)", 1)
        pair = F.when(bare.rlike(two), F.concat_ws(".", F.regexp_extract(bare, two, 1), F.regexp_extract(bare, two, 2))).otherwise(bare)
        return F.coalesce(F.when(letter != "", F.concat(F.lit("附录"), F.upper(letter))), F.nullif(dotted, F.lit("")), pair)

    def key(t: Column) -> Column:
        appendix = F.regexp_extract(t, r"(?U)^(?:附\s*[表录]|附录)\s*([A-Za-z]|[一二三四五六七八九十]+)", 1)
        return F.when(appendix != "", F.concat(F.lit("附录"), F.upper(appendix))).otherwise(_let(unwrapped(t), plain))

    whole = _let(F.regexp_replace(strip(F.coalesce(number, F.lit(""))), "[．。]", "."), key)
    return F.when(F.coalesce(number, F.lit("")).rlike(R.NORMAL_NUMBER), number).otherwise(whole)  # as most are


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: x != "")


def bare_numbers(text: Column) -> Column:
    """Numbers of two levels or more as they stand in a text, in order, without what follows a hyphen."""
    return _all(F.coalesce(text, F.lit("")), R.BARE, 1)


@F.arrow_udf(ArrayType(StringType()))
def article_numbers(text: pa.Array) -> pa.Array:
    """The distinct clause keys that a text cites, sorted (see cited.article_numbers)."""
    return pa.array([cited.article_numbers(t or "") for t in text.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(ArrayType(StringType()))
def standards(text: pa.Array) -> pa.Array:
    """The distinct standards that a text names, normalized and sorted (see cited.standards)."""
    return pa.array([cited.standards(t or "") for t in text.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(ArrayType(StructType([StructField("sentence", IntegerType()), StructField("key", StringType()), StructField("named", ArrayType(StringType()))])))
def citations(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """For each clause in each sentence of a text, in order: the sentence's place, the clause's key, the standards that the sentence names."""
    reader = cited.Reader()
    for batch in texts:
        ends, places, keys, named = [0], [], [], []
        for text in batch.to_pylist():
            for i, sentence in enumerate(cited.sentences(text or "")):
                own, standards_named = reader.read(sentence)
                for key in own:
                    places.append(i)
                    keys.append(key)
                    named.append(standards_named)
            ends.append(len(keys))
        rows = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(keys, pa.string()), pa.array(named, pa.list_(pa.string()))], ["sentence", "key", "named"])
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def sentences(text: Column) -> Column:
    """The pieces between sentence ends that are not blank, in order."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), R.SENTENCE_END), strip), lambda s: s != "")


def hit_keys(number: Column) -> Column:
    """The keys that a retrieved clause answers to: its own, and for a table that of its clause."""
    every = F.filter(F.array_distinct(F.array(article_key(number), article_key(F.get(F.split(number, "-"), 0)))), lambda k: k != "")
    return F.when(F.coalesce(number, F.lit("")).rlike(R.NORMAL_NUMBER), F.array(number)).otherwise(every)


def base_number(number: Column) -> Column:
    """A clause number without the mark of a table."""
    return F.regexp_replace(number, "-表$", "")


def question_segments(question: Column) -> Column:
    """What is left of a question in runs, without standards, question words and function characters."""
    t = F.regexp_replace(F.coalesce(question, F.lit("")), R.STANDARD, " ")
    for word in R.QUESTION_WORDS:
        t = F.replace(t, F.lit(word), F.lit(" "))
    return F.filter(F.split(t, rf"[^\u4e00-\u9fffA-Za-z0-9]+|[{R.QUESTION_CHARS}]"), lambda s: s != "")


@F.pandas_udf(IntegerType())
def _longest(segments: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([greedy_longest(list(s), () if t is None else t) for s, t in zip(segments, texts, strict=True)], dtype="int32")


def longest_run(question: Column, texts: Column) -> Column:
    """The longest run of two or more ideographs of the question that stands in one of the texts, scanned greedily from the left: the longest run at a place is taken and the scan goes on behind it. Time goes with the lengths of question and texts; a null text has no run."""
    ideographs = F.transform(question_segments(question), lambda s: F.regexp_replace(s, r"[^\u4e00-\u9fff]", ""))
    some = F.filter(ideographs, lambda s: F.length(s) > 1)
    return F.when((F.size(some) > 0) & (F.size(texts) > 0), _longest(some, texts)).otherwise(0)


def shortened(text: Column, most: int = 400, mark: str = "……") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def mask(secret: Column) -> Column:
    """A secret for display: of more than 10 characters the first 3, the last 4 and the length, else the first 2 and stars; a mark for none."""
    size, (between, opened, closed) = F.length(secret), R.MASKED
    short = F.concat(F.left(secret, F.lit(2)), F.repeat(F.lit("*"), F.greatest(size - 2, F.lit(0))))
    long = F.concat(F.left(secret, F.lit(3)), F.lit(between), F.right(secret, F.lit(4)), F.lit(opened), size.cast("string"), F.lit(closed))
    return F.when(F.coalesce(secret, F.lit("")) == "", R.UNSET).when(size <= 10, short).otherwise(long)
