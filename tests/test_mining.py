from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftwork.config import configured
from siftwork.functions import text as X
from siftwork.operators import mining as M


def _one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).collect()[0][0]


@pytest.mark.parametrize(
    "text,want",
    [
        ("One two. Three four! Five?", ["One two.", "Three four!", "Five?"]), ("Version 3.14 is out. Yes.", ["Version 3.14 is out.", "Yes."]), ("Wait... What now?", ["Wait... What now?"]),
        ("Mr. A. Smith came. he left.", ["Mr.", "A. Smith came. he left."]), ("a (see b.) c", ["a (see b.) c"]), ("  \n--\n", []), ("Line one\nline two.", ["Line one line two."]),
    ],
)
def test_sentences(spark, text, want):
    assert _one(spark, text, X.sentences) == want


def test_lines_and_endings(spark):
    assert _one(spark, "a\r\nb\n\nc\n", X.lines) == ["a", "b", "", "c"] and _one(spark, "", X.lines) == [] and _one(spark, "a\rb", X.lines) == ["a\rb"]
    assert [_one(spark, t, X.line_ending) for t in ("a\nb", "a\r\nb", "a\rb", "a\r\nb\nc", "a")] == ["lf", "crlf", "cr", "mixed", None]


def test_placeholders_are_not_cut(spark):
    got = spark.createDataFrame([(i,) for i in (0, 9, 10, 99, 100, 1000)], "i int").select(X.placeholder("WORD", F.col("i"))).collect()
    assert [r[0] for r in got] == ["[WORD_00]", "[WORD_09]", "[WORD_10]", "[WORD_99]", "[WORD_100]", "[WORD_1000]"]


def test_greedy_pattern(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"], ["b c", "a b c", "c d"]), ([], ["a b"]), (["a"], [])], "t array<string>, f array<string>")
    assert [r[0] for r in df.select(X.greedy_pattern(F.col("t"), F.col("f"))).collect()] == ["a b c [WORD_03] [WORD_04]", "", "[WORD_00]"]


LOG = ["2025 INFO start x", "2025 INFO stop y", "2025 WARN stop z", "2025 INFO go", None, ""]


def test_log_templates(spark):
    df = spark.createDataFrame([(1, k, s, "p") for k, s in enumerate(LOG)] + [(2, 0, "only one line", "p")], "file long, no long, line string, pattern string")
    got = {(r.key, r.pattern): r.template_count for r in M.log_templates(df, "file", "line", "no").collect()}
    assert got == {(1, "2025 [POS_01] [POS_02] [POS_03]"): 3, (1, "2025 [POS_01] [POS_02]"): 1, (1, ""): 1, (2, "only one line"): 1}
    ex = {(r.pattern, r.placeholder, r.example_no): r.example for r in M.log_examples(df, "file", "line", "no").collect()}
    assert ex["2025 [POS_01] [POS_02] [POS_03]", "POS_01", 2] == "WARN" and ex["2025 [POS_01] [POS_02]", "POS_02", 1] == "go"


def test_json_templates(spark):
    rows = [(1, 1, '{"a": 1, "b": "x"}'), (1, 2, '{"a": 1, "b": "y"}'), (1, 3, '{"a": 1, "b": [1, 2], "c": {"d": 1}}'), (1, 4, "broken {"), (1, 5, None)]
    df = spark.createDataFrame(rows, "k int, n int, j string")
    got = {r.pattern: r.template_count for r in M.json_templates(df, "k", "j", "n").collect()}
    assert got == {'{"a": 1, "b": [VALUE]}': 2, '{"a": 1, "b": [VALUE], "c": [VALUE]}': 1}
    assert {r.value for r in M.json_pairs(df, "k", "j", "n").where("jkey in ('b', 'c')").collect()} == {'"x"', '"y"', "[num:2]", "{1 keys}"}


def test_json_examples_and_books(spark):
    import io
    import zipfile

    from siftwork.operators import documents as D

    df = spark.createDataFrame([(1, k, f'{{"a": 1, "b": "x{k // 2}"}}') for k in range(4)], "k int, n int, j string")
    got = [(r.placeholder, r.example_no, r.example) for r in M.json_examples(df, "k", "j", "n").orderBy("placeholder", "example_no").collect()]
    assert got == [("a_VALUE", 1, "1"), ("b_VALUE", 1, "x0"), ("b_VALUE", 2, "x1")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfile full-path="c.opf"/></container>')
        z.writestr("c.opf", '<package><manifest><item id="a" href="a.html"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("a.html", "<html><body><p>The old dog ran home. The old dog ran home.</p></body></html>")
    books = spark.createDataFrame([(1, bytearray(out.getvalue())), (2, bytearray(b"no book"))], "k int, c binary")
    assert [(r.key, r.template_count) for r in D.epub_templates(books, "k", "c").collect()] == [(1, 2)]


def test_json_templates_of_whole_texts(spark):
    from siftwork.sources.stores import json_records

    bodies = ['{\n "a": 1\n}', '[\n {"a": 1},\n {"a": 1}\n]', '[["h"], [1], [1, 2]]', "[1, 2]\n[1, 2]", "7", '{"a": 1e5}\n{"a": 1e5}']
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    got = {(r.key, r.pattern, r.template_count) for r in M.json_templates(json_records(df, "k", "body"), "key", "record", "line_no").collect()}
    assert {x for x in got if x[0] < 5} == {(0, '{"a": 1}', 1), (1, '{"a": 1}', 2), (2, '["h": 1]', 1), (2, '["h": 1, "col_01": 2]', 1), (3, '["pos_00": 1, "pos_01": 2]', 2)}
    assert [(x[0], x[2]) for x in got if x[0] == 5] == [(5, 2)]


def test_text_templates_and_fallback(spark):
    df = spark.createDataFrame([(1, "The red cat sat here. The red cat sat here. Dogs run."), (2, "One two three. Four five six. Seven eight."), (3, None), (4, "")], "d int, t string")
    got = {(r.key, r.pattern): (r.template_count, r.fallback) for r in M.text_templates(df, "d", "t").collect()}
    assert got == {(1, "The red cat sat here."): (2, False), (2, "[WORD_00] [WORD_01] [WORD_02]"): (2, True)} or (2, True) in got.values()


def test_footprint_and_lines(spark):
    df = spark.createDataFrame([(1, 'Yes, he said "go". Is it so? No.'), (2, ""), (3, None)], "d int, t string")
    f = {r.key: r for r in M.footprint(df, "d", "t").collect()}
    assert f[1].period_percent == 50.0 and f[1].question_percent == 50.0 and f[1].dialogue_percent == 50.0 and f[1].vocabulary_richness == 1.0 and f[2].avg_sentence_length == 0.0 and 3 not in f
    n = M.line_stats(spark.createDataFrame([(1, "é\n\n  \nab\n")], "d int, t string"), "d", "t").collect()[0]
    assert (n.line_count, n.max_line_length, n.blank_line_count, n.line_ending) == (4, 2, 2, "lf")


def test_pivots_and_svo(spark):
    s = spark.createDataFrame([(1, k, x.split()) for k, x in enumerate(["cats eat fish now", "dogs eat meat", "cows eat grass too", "sit"])], "d int, n int, tok array<string>")
    assert [(r.pos, r.word, r.n, r.variation) for r in M.pivots(s, "d", "tok").collect()] == [(1, "eat", 3, 3)]
    r = M.svo(s, "d", "n", "tok").collect()[0]
    assert (r.svo_structure_percent, r.avg_subject_length, r.avg_object_length) == (75.0, 1.0, pytest.approx(5 / 3))


def test_compression(spark):
    t = spark.createDataFrame([(1, "a b c"), (1, "d")], "key int, pattern string")
    o = spark.createDataFrame([(1, 108), (2, 10), (3, 0)], "key int, original_tokens int")
    got = {r.key: (r.compressed_tokens, r.reduction_percent) for r in M.compression(t, o).collect()}
    assert got == {1: (54, 50.0), 2: (50, 0.0), 3: (50, 0.0)}


def test_compression_counts_examples_and_footprint(spark):
    from siftwork.operators import results as R

    text = "The old dog ran home. The old dog ran home. The old dog ran home."
    df = spark.createDataFrame([(1, text), (2, "Cats eat fish. Dogs drink milk. - run off."), (3, "--")], "d int, t string")
    t = M.text_templates(df, "d", "t")
    assert {(r.key, r.pattern, str(r.examples)) for r in t.where("key = 1").collect()} == {(1, "The old dog ran [WORD_04]", "{'WORD_00': ['home.']}")}
    got = {r.key: (r.original_tokens, r.compressed_tokens, r.reduction_percent) for r in R.mined(df, "d", "t", F.lit("Text")).collect()}
    assert got[1] == (16, 50 + 30 + 5 + 1, 0.0) and got[3] == (0, 0, 0.0)
    words = spark.createDataFrame([(1, " ".join(f"Xa{c} yb{c} - zeta{c}." for c in "abcdefg"))], "d int, t string")
    r = M.text_templates(words, "d", "t", configured(min_ngram_size=9, max_ngram_size=9)).collect()
    assert [(x.template_count, sorted(map(len, x.examples.values())), x.fallback) for x in r] == [(7, [5, 5, 5], True)] or [x.fallback for x in r] == [False]
    e = spark.createDataFrame([(1, "A", str(k)) for k in range(7)] + [(1, "B", "x"), (1, "C", None)], "key int, placeholder string, example string")
    assert [r.examples for r in M.example_counts(e, ["key"]).collect()] == [6]
    s = M.sentence_table(spark.createDataFrame([(1, "Cats eat fish now. Dogs eat meat today. Cows eat grass too.")], "d int, t string"), "d", "t")
    assert [(r.key, r.common_pivots) for r in M.common_pivots(s, "key", "sent_no", "tokens").collect()] == [(1, ["eat"])]


def test_examples(spark):
    rows = [(1, 0, ["a", "b", "c", "d"], "[WORD_00] b c [WORD_03]"), (1, 1, ["x", "b", "c", "d"], "[WORD_00] b c [WORD_03]"), (1, 2, ["a", "b", "c", "e"], "[WORD_00] b c [WORD_03]"), (2, 0, ["p", "q"], "p q")]
    df = spark.createDataFrame(rows, "key int, sent_no int, tokens array<string>, pattern string")
    got = {(r.placeholder, r.example_no): r.example for r in M.ngram_examples(df).collect()}
    assert got == {("WORD_00", 1): "a", ("WORD_00", 2): "x", ("WORD_01", 1): "d", ("WORD_01", 2): "e"}
    got = {(r.placeholder, r.example_no): r.example for r in M.position_examples(df.where("key = 2")).collect()}
    assert got == {("WORD_00", 1): "p", ("WORD_01", 1): "q"}


def test_empty(spark):
    lines = spark.createDataFrame([], "file long, no long, line string")
    assert M.log_templates(lines, "file", "line", "no").collect() == [] and M.text_templates(spark.createDataFrame([], "d int, t string"), "d", "t").collect() == []
