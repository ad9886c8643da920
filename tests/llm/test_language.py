from __future__ import annotations

import numpy as np
import pytest

G = pytest.importorskip("siftwork.llm.language")

SENTENCES = {
    "en": ["The scanner reads the first few rows of the file.", "Every worker stores what the reader expects.", "It keeps a list of the missing values."],
    "de": ["Der Scanner liest die ersten Zeilen der Datei.", "Jeder Prozess behält die eigenen Einstellungen.", "Das Werkzeug zählt die fehlenden Werte."],
    "fr": ["Le lecteur garde les premières lignes du fichier.", "Chaque processus conserve ses propres réglages.", "Cet outil compare toutes les colonnes."],
    "es": ["El lector guarda las primeras filas del archivo.", "Cada proceso revisa su propia configuración.", "La herramienta compara todas las columnas."],
    "ru": ["Сканер читает первые строки файла.", "Каждый процесс хранит скрытые папки.", "Новый инструмент сравнивает пустые значения."],
    "zh": ["扫描器读取前面的几行。", "每个进程保存隐藏的文件夹。", "日志收集器检查字段的顺序。"],
}


def test_codewords_differ_in_half_their_bits():
    for n in (2, 5, 9, 15):
        c = G.codewords(n)
        assert all((c[a] != c[b]).sum() * 2 >= c.shape[1] for a in range(n) for b in range(a))


@pytest.mark.parametrize("label,code", [("en-US", "en"), ("GER", "de"), ("English", "en"), ("zho", "zh"), ("xx", None), ("", None), (None, None), ("und", None), ("pt_BR", "pt")])
def test_labels(label, code):
    assert G.label_code(label) == code


@pytest.fixture(scope="module")
def documents(spark):
    rows = []
    for code, ss in SENTENCES.items():
        for k in range(30):
            wrong = {"en": "de"}.get(code, "en") if k == 0 else code
            rows.append((len(rows), " ".join(ss[(k + j) % 3] for j in range(4)), wrong))
    n = len(rows)
    rows += [
        (n, " ".join(SENTENCES["en"]) + "\n\n" + " ".join(SENTENCES["de"]), "en"), (n + 1, " ".join(SENTENCES["fr"]), None), (n + 2, " ".join(SENTENCES["es"]), "spa"),
        (n + 3, "- a b\n- c d", "xx"), (n + 4, None, None), (n + 5, "", "en"), (n + 6, " ".join(SENTENCES["zh"]), "??"), (n + 1, " ".join(SENTENCES["fr"]), None),
    ]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, seg_no string"), n


def test_found(documents):
    df, n = documents
    got = {tuple(r) for r in G.found(df).collect()}
    wrong = {(30 * k, 1, code) for k, code in enumerate(SENTENCES)}
    assert got == wrong | {(n, 1, "en"), (n, 2, "de"), (n + 1, 1, "fr"), (n + 6, 1, "zh")}


def test_training_does_not_depend_on_partitions(documents):
    df, _ = documents
    assert np.array_equal(G.train(df).weights, G.train(df.repartition(7)).weights)


def test_held_out_accuracy(spark, sf):
    """Sentences of the given documents that their own label and common words agree on: at least 99 % right."""
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = G.train(docs.where("doc_id % 2 = 0"))
    right = total = 0
    for r in docs.where("doc_id % 2 = 1 and text is not null").collect():
        code = G.label_code(r.lang)
        kind, ss = G.sentences(r.text)
        own = [c for c in map(G._clean, ss) if len(c) >= 20 and code and G.agrees(c, code)] if kind == "prose" else []
        if own:
            guess = model.losses(model.bits(own)).argmin(axis=1)
            right += int((guess == G.CODES.index(code)).sum())
            total += len(own)
    print(right, total)
    assert total > 500 and right >= 0.99 * total


def test_empty_table(spark):
    assert G.found(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
