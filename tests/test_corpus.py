"""Clauses against a scan of one line after the other, with small segments and blocks."""

import random
import re

import pytest

from clausewright.operators import corpus
from clausewright.sources.chunks import read_marked_text


def scanned(lines):
    """(article_no, text, page_start, page_end) of one file's lines."""
    page, content = None, []
    for text in lines:
        text = text.strip()
        mark = re.fullmatch(r"<!--\s*page\s+(\d+)\s*-->", text)
        if mark:
            page = int(mark[1])
        elif text:
            content.append((page, text))
    out, opened, clause = [], False, None
    for i, (page, text) in enumerate(content):
        if re.fullmatch(r"\d{1,3}", text) and (i + 1 == len(content) or content[i + 1][0] != page):
            continue
        if opened and re.match(r"^(附\s*[:：]?\s*)?条\s*文\s*说\s*明$", text):
            break
        number = re.match(r"^(\d{1,2}\.\d{1,3}\.\d{1,3})(?![.\d])", text)
        if number:
            opened, clause = True, [number[1], [], []]
            out.append(clause)
        elif re.match(r"^\d{1,2}(\.\d{1,3})?\s+\D", text):
            clause = None
        if clause is not None:
            clause[1].append(text)
            clause[2].append(page)
    pages = lambda ps: [p for p in ps if p is not None] or [None]
    return [(n, "\n".join(ts), min(pages(ps), key=lambda p: p or 0), max(pages(ps), key=lambda p: p or 0)) for n, ts, ps in out]


def made(rng):
    page, out = 0, []
    for _ in range(rng.randint(0, 60)):
        kind = rng.random()
        if kind < 0.15:
            page += rng.randint(0, 2)
            out.append(f"<!-- page {page} -->")
        elif kind < 0.3:
            out.append(f"{rng.randint(1, 20)}.{rng.randint(1, 9)}.{rng.randint(1, 30)} 条")
        elif kind < 0.4:
            out.append(rng.choice(["6.1 一般规定", "7 附则", " ", ""]))
        elif kind < 0.6:
            out.append(str(rng.randint(1, 400)))
        elif kind < 0.63:
            out.append(rng.choice(["条文说明", "附：条 文 说 明", "条文说明见后"]))
        else:
            out.append(rng.choice(["正文", "  缩进 ", "1.2.3.4 不是", "3.1.6", "见 3.1.6 条"]))
    return out


@pytest.mark.parametrize("segment", [1, 3, 16, corpus.SEGMENT])
def test_segments_give_what_one_scan_gives(spark, segment):
    rng = random.Random(11)
    files = {f"f{i}": made(rng) for i in range(60)} | {"none": [], "blank": ["", " "]}
    rows = [(f, i, t) for f, lines in files.items() for i, t in enumerate(lines)] + [("null", 0, None), ("null", 1, "1.1.1 a"), ("null", 2, None), (None, 0, "1.1.1 a"), (None, 1, "b")]
    found = {}
    for r in corpus.split_clauses(spark.createDataFrame(rows, "file string, line int, text string"), segment).collect():
        found.setdefault(r.file, []).append((r.article_no, r.text, r.page_start, r.page_end))
    assert found.pop("null") == [("1.1.1", "1.1.1 a", None, None)]
    assert found.pop(None) == [("1.1.1", "1.1.1 a\nb", None, None)]
    key = lambda c: tuple(str(x) for x in c)
    assert {f: sorted(c, key=key) for f, c in found.items()} == {f: sorted(c, key=key) for f, lines in files.items() if (c := scanned(lines))}


def test_no_window_over_a_whole_file(spark):
    lines = spark.createDataFrame([("f", i, "1.1.1 a") for i in range(9)], "file string, line int, text string")
    plan = corpus.split_clauses(lines, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert set(re.findall(r"\], \[of#\d+\], \[(\w+)#", plan)) == {"segment"}  # over a file: rows of segments, no lines


def test_lines_of_a_file_in_many_blocks(spark, tmp_path):
    (tmp_path / "a.md").write_text("".join(f"line {i}\r\n" for i in range(3000)), newline="")
    (tmp_path / "b.md").write_text("x\n\ny")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = read_marked_text(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 1
        rows = {}
        for r in found.collect():
            rows.setdefault(r.file.rsplit("/", 1)[1], {})[r.line] = r.text
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == {"a.md": {i: f"line {i}" for i in range(3000)}, "b.md": {0: "x", 1: "", 2: "y"}}
