"""op1 against brute force: a line goes if a run around it, ten words or more, stands in an earlier document."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomsift.llm import linedup

UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")


def count(line):
    """Words of a line: white-space runs, and each code point of an unspaced script by itself."""
    n, inside = 0, False
    for c in line:
        if c in " \t\n\r\x0b\x0c":
            inside = False
        elif UNSPACED.match(c):
            n, inside = n + 1, False
        else:
            n, inside = n + (not inside), True
    return n


def brute(rows):
    """(doc_id, text) -> texts, by trying every run of lines of every document in every earlier one."""
    kept = {i: [x.strip(" \t\r\x0b\x0c") for x in t.split("\n") if count(x)] for i, t in rows}
    out = {}
    for i, t in rows:
        mine, gone = kept[i], set()
        for j in kept:
            if j >= i:
                continue
            for s in range(len(mine)):
                for a in range(len(kept[j])):
                    n = 0
                    while s + n < len(mine) and a + n < len(kept[j]) and mine[s + n] == kept[j][a + n]:
                        n += 1
                    if sum(map(count, mine[s : s + n])) >= 10:
                        gone |= set(range(s, s + n))
        lines, unit = [], -1
        for x in t.split("\n"):
            unit += count(x) > 0
            if unit not in gone:
                lines.append(x)
        out[i] = "\n".join(lines)
    return out


def passage(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


def deduped(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: r.text for r in linedup.dedup_lines(docs).collect()}


def test_lines_that_cross(spark):
    a, b = passage("a"), passage("b")
    head = passage("head", 9)
    rows = [(1, f"{a}\n{b}"), (2, f"{b}\n{a}"), (3, f"{b}\n{a}"), (10, f"{head}\nother end"), (11, f"{head}\nshort\n{passage('c', 8)}"), (12, f"{head}\nshort\n{passage('c', 8)}")]
    got = deduped(spark, rows)
    assert got[2] == got[3] == got[12] == "" and got[11] == rows[4][1]
    assert got == brute(rows)


def test_only_what_one_earlier_document_holds_together(spark):
    x, y = passage("x", 6), passage("y", 6)
    rest = "\n".join(passage(f"r{i}", 12) for i in range(30))
    rows = [(1, f"{x}\n{passage('p')}"), (2, f"{passage('q')}\n{y}"), (3, f"{x}\n{y}"), (4, f"{y}\n{rest}\n{x}"), (5, f"{passage('o')}\n{x}\n{y}\nend")]
    got = deduped(spark, rows)
    assert got[3] == rows[2][1] and got[4] == rows[3][1] and got[5] == f"{passage('o')}\nend"
    assert got == brute(rows)


def test_repeated_short_and_unspaced_lines(spark):
    a, b, c = passage("a"), passage("b"), passage("c")
    song = "\n".join(f"la {i} di" for i in range(20))
    chinese = "今天天气很好我们去公园"
    rows = [(1, f"{a}\n{b}\n{a}\n{c}"), (2, f"{a}\n{b}\n{a}\n{c}"), (3, f"{a}\n{a}\n{a}"), (4, f"one\n{song}\ntwo"), (5, f"Title\n\n{song}\n\n\nend"), (6, f"x\n{chinese}\ny"), (7, f"{chinese}\nz"), (8, "Haanth.\nshort"), (9, "Haanth.\nshort")]
    got = deduped(spark, rows)
    assert got[2] == got[3] == "" and got[5] == "Title\n\nend" and got[7] == "z" and got[9] == rows[8][1]
    assert got == brute(rows)


@pytest.mark.parametrize("rare", [0, 2, 16])
def test_random_shuffles(spark, rare, monkeypatch):
    monkeypatch.setattr(linedup, "RARE", rare)
    r = random.Random(3 + rare)
    lines = [passage(f"w{k}x", k % 13 + 1) for k in range(30)]
    rows = []
    for i in range(60):
        kind = r.sample(lines, r.randint(2, 12)) if i % 3 else [r.choice(lines[:9]) for _ in range(r.randint(2, 14))]
        text = "\n".join("  " * r.randint(0, 1) + x + r.choice(["", "", "\n", "\nshort", "\r"]) for x in kind)
        if i % 10 == 9:
            old = rows[r.randrange(i)][1].split("\n")
            at = r.randrange(len(old))
            text = "\n".join(old[at:] + old[:at])
        rows.append((i, text))
    assert deduped(spark, rows) == brute(rows)


def test_blocks_advance_in_both_documents(spark):
    a, b, c, d = (passage(x) for x in "abcd")
    rows = [(1, "\n".join([a, b, c, d])), (2, "\n".join([b, c, a, "own line here", d]))]
    got = linedup.common_blocks(spark.createDataFrame(rows, "doc_id long, text string")).select("earlier", "at", "lines", "earlier_at", "moved").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 2, 1, False), (1, 2, 1, 0, True), (1, 4, 1, 3, False)]


def test_patience_alignment():
    one = {k: [i] for i, k in enumerate("abcd")}
    assert linedup.align({"a": [5], "b": [6], "c": [1], "d": [7]}, {"a": [0], "b": [1], "c": [2], "d": [3]}) == ([(5, 0), (6, 1), (7, 3)], [(1, 2)])
    assert linedup.align(one, one) == ([(i, i) for i in range(4)], [])
    mine, theirs = {"x": [0], "r": [1, 3, 5], "y": [4]}, {"x": [0], "r": [1, 3], "y": [2]}
    aligned, crossing = linedup.align(mine, theirs)
    assert aligned == [(0, 0), (1, 1), (4, 2), (5, 3)] and [b for b, _ in crossing] == [3]


def test_runs_cover_every_block():
    r = random.Random(5)
    for _ in range(300):
        words = [r.randint(1, 12) for _ in range(r.randint(1, 9))]
        runs = linedup.runs_of(words)
        assert all(sum(words[s : s + n]) >= 10 for s, n in runs)
        for s in range(len(words)):
            for e in range(s + 1, len(words) + 1):
                if sum(words[s:e]) >= 10:
                    assert {i for a, n in runs if s <= a and a + n <= e for i in range(a, a + n)} == set(range(s, e))


def test_odd_rows(spark):
    p = passage("p")
    rows = [(None, p, 1, "n"), (1, None, 2, None), (2, "", 3, ""), (3, p, 4, "x"), (3, p, 5, "x"), (3, f"{p}\nmore", 6, "x"), (4, f"own\n{p}", 7, "x"), (5, " \n\n", 8, "x"), (6, f"{p}\n" * 20000, 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, run string").withColumn("loomsift_cut", F.lit(1))
    got = {r.n: r for r in linedup.dedup_lines(docs).collect()}
    assert {k: r.text for k, r in got.items()} == {1: p, 2: None, 3: "", 4: p, 5: p, 6: rows[5][1], 7: "own", 8: " \n\n", 9: ""}
    assert got[9].n_cut == 20000 and got[7].n_cut == 1 and got[4].n_cut == 0 and got[7].run == "x" and got[2].chars_after == 0
    kept = linedup.drop_repeated_lines(docs.drop("loomsift_cut"))
    assert kept.columns == ["doc_id", "text", "n", "run"] and sorted(r.n for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
    none = docs.limit(0)
    assert linedup.drop_repeated_lines(docs).columns == kept.columns
    assert linedup.dedup_lines(none).count() == 0 and linedup.drop_repeated_lines(none).count() == 0


def test_batches_with_and_without_cuts_in_one_task(spark):
    p = passage("q")
    docs = spark.createDataFrame([(i, f"own {i}\n{p}" if i < 2000 else f"own {i}") for i in range(8000)], "doc_id long, text string")
    got = linedup.dedup_lines(docs).collect()
    assert len(got) == 8000 and all(r.text == (f"own {r.doc_id}\n{p}" if r.doc_id == 0 else f"own {r.doc_id}") and r.n_cut == (0 < r.doc_id < 2000) for r in got)
