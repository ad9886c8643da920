from __future__ import annotations

import random

import pytest

pieces = pytest.importorskip("siftwork.llm.pieces")


def _text(kind, n):
    random.seed(n)
    if kind == "prose":
        return "\n\n".join(". ".join("wörd " * random.randint(1, 12) for _ in range(random.randint(1, 9))) + "." for _ in range(n))
    if kind == "blob":
        return "".join(random.choice("abcéж漢🙂,;") for _ in range(n * 40))
    if kind == "mixed":
        return _text("prose", n) + "\r\n" + _text("blob", n) + " 。" + _text("prose", n // 2 + 1)
    return "\r\n" * n + " " * n


@pytest.mark.parametrize("kind", ["prose", "blob", "mixed", "blank"])
@pytest.mark.parametrize("n", [1, 3, 17, 60])
@pytest.mark.parametrize("limit,overlap", [(300, 30), (64, 8), (1000, 0), (5000, 200)])
def test_pieces_cover_fit_and_overlap(kind, n, limit, overlap):
    text = _text(kind, n)
    at = pieces.byte_offsets(text)
    assert at[-1] == len(text.encode())
    got = pieces.split(text, limit, overlap)
    assert got[0][:2] == (0, 0) and got[-1][2] == len(text)
    for k, (a, s, e, forced) in enumerate(got):
        assert a <= s < e or (not text and e == 0)
        assert at[e] - at[a] <= max(limit, 0) or len(got) == 1 and at[-1] <= limit
        if k:
            assert s == got[k - 1][2] and at[s] - at[a] <= overlap
        if forced:
            assert pieces.stretches_over(text, at, limit)
    assert (len(got) > 1) == bool(at[-1] > limit)


def test_larger_atoms_give_the_pieces_of_all_boundaries():
    random.seed(8)
    marks = [" ", " ", " ", ", ", "; ", ". ", "! ", "\n", "\r\n", "\n\n", "。", ") ", "\t"]
    for _ in range(400):
        text = "".join("".join(random.choice("abé漢z") for _ in range(random.choice([1, 3, 7, 7, 40]))) + random.choice(marks) for _ in range(random.randint(1, 120)))
        limit = random.choice([40, 64, 100, 300, 1000])
        overlap = random.choice([0, limit // 8, limit // 3])
        at = pieces.byte_offsets(text)
        few, every = pieces.atoms(text, at, limit, overlap), pieces.atoms(text, at, limit, overlap, True)
        assert len(few[0]) <= len(every[0])
        assert pieces.merged(*few, at, len(text), limit, overlap) == pieces.merged(*every, at, len(text), limit, overlap), (text, limit, overlap)


def test_paragraphs_are_kept_whole_where_they_fit():
    text = "\n\n".join("word " * 20 + "end." for _ in range(6))
    got = pieces.split(text, 230, 0)
    assert all(text[s - 2 : s] == "\n\n" for _, s, _, _ in got[1:])


def test_weakest_boundaries_go_first():
    text = "aaa bbb. ccc ddd.\n\neee fff. ggg hhh."
    assert [text[a:e] for a, _, e, _ in pieces.split(text, 24, 0)] == ["aaa bbb. ccc ddd.\n\n", "eee fff. ggg hhh."]


def test_unusable_parameters():
    with pytest.raises(ValueError):
        pieces.split("x" * 100, 3, 0)
    with pytest.raises(ValueError):
        pieces.split("x" * 100, 50, 40)


def test_issues_nulls_and_repeats(spark):
    rows = [(1, "A", "x" * 30, 5), (1, "A", "x" * 30, 5), (2, "A", "word " * 9, None), (3, "A", None, 9), (4, "A", "", 9), (5, "none", "x" * 99, 9), (6, None, "x" * 99, 9), (None, "A", "x" * 99, 9), (7, "A", "é" * 10, 1), (8, "A", "é" * 11, 1), (9, "A", "ab 。" * 5, 1)]
    b = spark.createDataFrame(rows, "item_id long, file_type string, body string, byte_count long")
    lim = spark.createDataFrame([("A", 20, 4), ("A", 20, 4), (None, 1, 1)], "file_type string, large_file_threshold_bytes long, overlap_bytes long")
    got = sorted(tuple(r) for r in pieces.found(b, lim).collect())
    assert got == [(1, "oversized"), (1, "unbreakable"), (2, "oversized"), (8, "oversized"), (8, "unbreakable"), (9, "oversized")]
    texts = {(r.item_id, r.piece_no): r.piece for r in pieces.pieces(b, lim).collect()}
    assert texts[3, 1] == "" and texts[5, 1] == "x" * 99 and max(len(t.encode()) for (i, _), t in texts.items() if i in (1, 2, 7, 8, 9)) <= 20


def test_empty_table(spark):
    b = spark.createDataFrame([], "item_id long, file_type string, body string")
    lim = spark.createDataFrame([], "file_type string, large_file_threshold_bytes long, overlap_bytes long")
    assert pieces.found(b, lim).collect() == []
