from __future__ import annotations

import random
from collections import namedtuple

import pytest

Q = pytest.importorskip("siftwork.llm.quality")

PROSE = "The scanner reads the first few rows of the file. It checks what the reader expects, and then it stores the result."
LIST = "- the size of the file\n- stack 47\n- the missing values\n- a list of patterns"
TABLE = "| a | b | c |\n|---|---|---|\n| 1 | two | 3.5 |\n| 4 | five | 6.5 |"
CASES = [
    (PROSE, "prose"), (PROSE.lower().replace(".", ""), "prose"), ("# Title\n\n" + PROSE + "\n\n- a point\n", "prose"), ("<p>" + PROSE + "</p>", "prose"),
    (PROSE.replace(" ", "\n"), "prose"), ("扫描器检查字段的顺序。日志收集器保存所有的数字列。", "prose"), ("the reader keeps all of the rows in the file\nthe scanner checks every line of it\nit stores a list", "prose"),
    (LIST, "list"), ("The parts\n\n(a) stack 1;\n(b) the order of the fields;\n(c) column 96;", "list"), ("frame_window = 417\narchive_glyph = on\nshard = off", "list"),
    ("/a/b/c_1.md\n/d/e/f_2.txt\n/g/h/i.csv", "list"), ("1. Tensor 89\n2. The missing values\n3. Handle 18", "list"),
    (TABLE, "table"), ("a,b,c\n1,x,2.5\n3,y,4.5", "table"), ("a\tb\n1\t2\n3\t4", "table"), ("name     size   kind\nqueue    12     a\nstream   7      b", "table"), ("+---+---+\n| a | b |\n+---+---+", "table"),
    ("00000000  63 b3 33 23 8f e8 e6 62\n00000010  f4 cb db f0 d6 27 73 3c", "junk"), ("ha" * 200, "junk"), ("." * 200, "junk"), ("~=++@ +-##~ @$_~ %&*_ ~ #$~_#", "junk"),
    ("2AkDs0fvATmZmXu9Cw4g7FumMi3fjXokdJlAUY8pSti6qoUW1E3GnWHv0y0wQJOOSi3fCU", "junk"), ("slk vc jkjedsa;sls krdz fwwdlcfzfxcl vxrr sj xdjzeceasdfq", "junk"), ("queue prefix record filter branch bundle queue batch branch sector", "junk"),
    ("i k d r l s k r o k f r e d o a a y", "junk"), ("»\nNext\n<<52\n[top]  24\nPage85\n©", "junk"), ("offset " * 30, "junk"),
    (None, None), ("", None), (" \n\t\n ", None),
]


@pytest.mark.parametrize("text,want", CASES)
def test_verdicts(text, want):
    assert Q.verdict(Q.finished(Q.chunk_state(text or "")).counts) == want


def _whole(text):
    s = Q.finished(Q.chunk_state(text))
    return s.counts, s.hashed()


def _cut_anywhere(text, cuts):
    states = [Q.chunk_state(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
    while len(states) > 1:  # any tree gives the same
        k = random.randrange(len(states) - 1)
        packed = [Q._unpacked(Row(*Q._packed(1, "k", 0, s))) for s in states[k : k + 2]]  # as they come from other tasks
        states[k : k + 2] = [Q.merge(*packed)]
    done = Q.finished(states[0])
    return done.counts, done.hashed()


Row = namedtuple("Row", "doc_id text_key part head tail first last broken counts vocabulary")


def test_chunks_merge_to_the_whole():
    random.seed(6)
    texts = [t for t, _ in CASES if t]
    for _ in range(300):
        text = random.choice(["\n\n", "\n \n", "\r\n\r\n", "\n", "\r\n", " "]).join(random.choice(texts) for _ in range(random.randint(1, 6)))
        cuts = sorted(random.randrange(len(text) + 1) for _ in range(random.randint(1, 7)))
        assert _cut_anywhere(text, cuts) == _whole(text)


def test_paragraphs_lines_and_words_longer_than_chunks():
    """One paragraph of 9,000 lines, a line of a megabyte and a word of 1.2 million letters, in chunks of any size."""
    random.seed(7)
    for text in ("\n".join(f"The line {k} holds the words of the file." for k in range(9_000)), "the word of the file " * 50_000, "a" * 1_200_000, "\n".join(["- an entry"] * 70_000)):
        for size in (100_000, 262_144, 524_288):
            assert _cut_anywhere(text, list(range(size, len(text), size))) == _whole(text)
    done = Q.finished(Q.chunk_state("\n".join(f"The line {k} holds the words of the file." for k in range(9_000)))).counts
    assert done["lines"] == done["sentences"] == done["sentence"] == 9_000


def test_documents_of_any_length(spark):
    long = "\n\n".join([PROSE] * 400)
    rows = [(1, PROSE, "x"), (1, PROSE, "x"), (2, LIST, "x"), (3, TABLE, "x"), (4, "ha" * 200, "x"), (5, None, "x"), (6, "", "x"), (7, long, "x"), (8, "\n".join([LIST] * 300), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    assert {tuple(r) for r in Q.found(df).collect()} == {(2, "list"), (3, "table"), (4, "junk"), (8, "list")}
    one = {r.doc_id: r for r in Q.document_stats(df).collect()}
    cut = Q.document_stats(df, 1000).collect()
    assert one == {r.doc_id: r for r in cut} and len(cut) == 8
    two = spark.createDataFrame([(1, long, "x"), (1, long + "!", "x"), (1, long, "x"), (1, None, "x")], "doc_id long, text string, kind string")
    assert len(Q.document_stats(two, 1000).collect()) == 3 and len(Q.document_stats(two).collect()) == 3
    assert one[7].word_count == 400 * one[1].word_count and one[5].word_count == 0 and one[5].period_percent is None and one[1].period_percent == 100.0


def test_empty_table(spark):
    assert Q.found(spark.createDataFrame([], "doc_id long, text string")).collect() == []
