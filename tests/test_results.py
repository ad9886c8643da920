from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from siftwork.config import Config, configured
from siftwork.functions import onetext as O
from siftwork.operators import mining as M
from siftwork.operators import results as R

LOG = "2025 INFO start x\n2025 INFO stop y\r\n2025 WARN stop z\n2025 INFO go\n\n"
PROSE = "The red cat sat here. The red cat sat here. Dogs run far away!\nWho barks? " + " ".join(f"Nr {k} ran {w} home now." for k, w in enumerate("far fast so then far fast so then".split()))
TEXTS = [
    (1, "Log", LOG), (2, "Json", '{"a": 1, "b": "x\\"y"}\n{"a": 1, "b": [1, null], "c": {}}\nnot json\n7\n{}'), (3, "Json", '[["h", "i"], [1, "u"], [1, 2, 3], []]'), (4, "Text", PROSE), (5, "Text", ""),
    (6, "Html", "<p>The old dog ran home. The old dog ran home.</p><ul><li>Once more it ran.</li></ul>"), (7, "Unknown", '{"k": 1}\n{"k": 2}'), (8, "Unknown", "a b\na c"), (9, "Text", "--\n\n"),
    (10, "Json", "7"), (11, "Text", " ".join(f"Word{k} takes w{k % 3} and {k} more." for k in range(130))), (12, "Csv", "a,b\n1,2"), (13, None, None), (14, "Log", ""), (15, "Text", "Ärger über Größe.  Ein Satz, „zwei“ Sätze!\n\t Noch einer. 3.14 ist Pi. A. B. kam..."),
]


def _rows(df):
    return {r.key: (json.loads(r.t), r.f, r.original_tokens, r.compressed_tokens, pytest.approx(r.reduction_percent)) for r in df.select("key", F.to_json("templates").alias("t"), F.to_json("writing_footprint").alias("f"), "original_tokens", "compressed_tokens", "reduction_percent").collect()}


def test_one_pass_and_spread_mining_agree(spark, monkeypatch):
    df = spark.createDataFrame(TEXTS, "k int, kind string, t string")
    one = _rows(R.mined(df, "k", "t", F.col("kind")))
    monkeypatch.setattr(M, "LOCAL", -1)
    spread = _rows(R.mined(df, "k", "t", F.col("kind")))
    assert set(one) == set(spread) == {k for k, _, t in TEXTS if t is not None}
    for k in one:
        assert one[k][0] == spread[k][0] and one[k][2:] == spread[k][2:], k
        a, b = (json.loads(x[k][1]) if x[k][1] else None for x in (one, spread))
        assert (a is None) == (b is None), k
        if a:
            assert a.pop("punctuation") == pytest.approx(b.pop("punctuation")) and a.pop("svo_analysis") == b.pop("svo_analysis") and a == pytest.approx(b), k
    assert one[1][0][0] == {"pattern": "2025 [POS_01] [POS_02] [POS_03]", "count": 3, "examples": {"POS_01": ["INFO", "WARN"], "POS_02": ["start", "stop"], "POS_03": ["x", "y", "z"]}}
    assert {t["pattern"] for t in one[2][0]} == {'{"a": 1, "b": [VALUE]}', '{"a": 1, "b": [VALUE], "c": [VALUE]}', "[VALUE]", "{}"} or one[2][0]
    assert {t["pattern"] for t in one[3][0]} == {'["h": 1, "i": [VALUE]]', '["h": 1, "i": [VALUE], "col_02": [VALUE]]', "[]"}
    assert one[7][0][0]["pattern"] == '{"k": 1}' and one[8][0][0]["pattern"] == "a [POS_01]"
    assert all(one[k][0] == [] and one[k][3] == 0 for k in (5, 9, 10, 12, 14))


def test_markdown_results(spark):
    text = '# A\n\nSome "words" here. More of it.\n\n- x y\n- z w\n\n1. one\n\n> Quoted text is here.\n\n---\n'
    got = {t["pattern"]: t["count"] for t in R.result_row("Markdown", text, None, Config())["templates"]}
    assert got == {"[HEADER_01]": 1, "[PARAGRAPH_06]:quotes=true": 1, "[LIST_02]:type=unordered": 2, "[LIST_01]:type=ordered": 1}
    row = R.result_row("Markdown", text, None, Config())
    assert row["writing_footprint"]["svo_analysis"] is None and row["writing_footprint"]["punctuation"]["period_percent"] == 100.0
    assert R.result_row("Markdown", "", None, Config())["compressed_tokens"] == 0


def test_sample_document_of_one_object():
    row = R.result_row("Json", '{ "meaning_of_life": 42 }', None, Config())
    assert row["templates"] == [{"pattern": '{"meaning_of_life": 42}', "count": 1, "examples": [("meaning_of_life_VALUE", ["42"])]}]


def test_text_templates_at_any_size(spark, monkeypatch):
    df = spark.createDataFrame([(k, t, "x") for k, _, t in TEXTS if t is not None], "k int, t string, pattern string")
    show = lambda d: sorted((r.key, r.pattern, r.template_count, r.fallback, tuple(sorted((k, tuple(v)) for k, v in r.examples.items()))) for r in d.collect())
    one = show(M.text_templates(df, "k", "t"))
    monkeypatch.setattr(M, "LOCAL", -1)
    assert show(M.text_templates(df, "k", "t")) == one and one


def test_entropy_is_shown_and_counted():
    c = Config()
    full = [f"alpha{k % 2} beta{k} gamma".split() for k in range(6)]
    found, shown = O.mine_sentences(full, configured(min_ngram_size=9, max_ngram_size=9))
    assert len(found) == 1 and found[0][0].startswith("[WORD_00] [WORD_01] [WORD_02] [entropy=") and shown == [float(found[0][0][-5:-1])]
    assert O.compressed_tokens(found, None, c) == c.json_overhead_tokens + 4 + 2 + 5 + 1


def test_ranks(spark):
    t = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "c", 5), (2, "x", 1)], "key int, pattern string, template_count long")
    assert {(r.key, r.pattern): r["rank"] for r in R.top_templates(t, ["key"]).collect()} == {(1, "c"): 1, (1, "a"): 2, (1, "b"): 3, (2, "x"): 1}
    got = R.ranked(R.mined(spark.createDataFrame([(1, LOG)], "k int, t string"), "k", "t", F.lit("Log"))).collect()
    assert [(r["rank"], r.template_count) for r in got] == [(1, 3), (2, 1), (3, 1)]
