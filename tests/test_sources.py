from __future__ import annotations

import io
import json
import os
import pickle
import sqlite3
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from siftwork.config import Config, configured
from siftwork.operators import documents as D
from siftwork.operators import paths as P
from siftwork.sources import files, sinks
from siftwork.sources.documents import markdown_blocks
from siftwork.sources.media import jpeg_frame
from siftwork.streaming import files as streams


def told(kind, data, path=""):
    text, failure = files.summarise(kind, data, path)
    assert failure is None, failure
    return json.loads(text)


def _zip(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return b.getvalue()


def test_archives():
    z = told("Zip", _zip(**{"a.csv": "1", "b.csv": "22", "__MACOSX/x": "", ".hidden": "", "d/c.log": "3"}))
    assert z["file_count"] == 3 and z["entry_type_counts"] == {"CSV": 2, "Log": 1} and z["total_size"] == 4
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w") as t:
        i = tarfile.TarInfo("x" * 120)
        i.size = 3
        t.addfile(i, io.BytesIO(b"abc"))
    assert told("Archive", b.getvalue())["entries"] == [{"name": "x" * 120, "size": 3}]
    assert told("Archive", b"\x1f\x8b" + b"0" * 8 + b"\x07\0\0\0")["uncompressed_size"] == 7


def test_settings():
    assert told("Toml", b"[a]\nx = 1\ny = [true]\n[b]\nz = 'q'")["key_count"] == 5
    y = told("Yaml", b"a: 1\nb: [x, y]\n")
    assert (y["key_count"], y["sequence_count"], y["scalar_count"]) == (2, 1, 5)
    i = told("Ini", b"; c\n[s]\na = 1\nb = x\n  more\n")
    assert (i["section_count"], i["key_count"], i["comment_count"], i["schema"]["s"]["a"]) == (1, 2, 1, "integer")
    x = told("Xml", b"<r xmlns:q='u'><a k='1'/><a j='x'><b/></a></r>")
    assert (x["element_count"], x["attribute_count"], x["max_depth"], x["has_namespaces"]) == (4, 2, 3, True) and set(x["schema"]["r"]["children"]["a"]["attributes"]) == {"k", "j"}


def test_sqlite(tmp_path):
    f = tmp_path / "t.db"
    db = sqlite3.connect(f)
    db.executescript("create table c(id integer primary key, name text not null); create table o(id integer primary key, c_id int not null references c(id), total real); create unique index u on c(name); insert into c values (1,'a'),(2,'b');")
    db.close()
    s = told("Sqlite", f.read_bytes())
    assert (s["table_count"], s["total_rows"]) == (2, 2) and s["tables"][0]["indexes"][0]["unique"] and s["tables"][1]["columns"][1]["references"] == "c.id"


def test_arrays_and_models():
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    b = io.BytesIO()
    np.savez(b, a=np.zeros((2, 3, 4)), b=np.arange(3))
    assert [e["shape"] for e in told("Npz", b.getvalue())["npy_entries"]] == [[2, 3, 4], [3]]
    assert told("Mtx", b"%%MatrixMarket matrix coordinate real symmetric\n% c\n3 3 2\n1 1 5\n2 1 1\n")["num_stored_values"] == 2
    head = json.dumps({"w": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}}).encode()
    assert told("Safetensors", struct.pack("<Q", len(head)) + head + b"0" * 8)["dtype_counts"] == {"F32": 1}
    g = b"GGUF" + struct.pack("<IQQ", 3, 1, 1) + struct.pack("<Q", 1) + b"k" + struct.pack("<II", 4, 7) + struct.pack("<Q", 1) + b"t" + struct.pack("<IQIQ", 1, 5, 0, 0)
    assert told("Gguf", g)["kv"] == {"k": 7}
    assert "os.getcwd" in str(told("Pickle", pickle.dumps([os.getcwd, {"a": 1}]))).replace("posix.", "os.")
    t = pa.table({"a": [1, 2], "b": ["x", None]})
    b = io.BytesIO()
    pq.write_table(t, b, row_group_size=1)
    assert told("Parquet", b.getvalue())["num_row_groups"] == 2
    b = io.BytesIO()
    with pa.ipc.new_stream(b, t.schema) as w:
        w.write_table(t)
    assert told("ArrowIpc", b.getvalue()) | {} == told("ArrowIpc", b.getvalue()) and told("ArrowIpc", b.getvalue())["row_count"] == 2


def test_columns_of_files(tmp_path):
    import numpy as np
    import pyarrow as pa
    import pyarrow.orc as orc
    import pyarrow.parquet as pq

    body = "id,name,age,active,price,day\n1,John,30,true,10.5,2025-01-01\n2,Ann,20,false,20,2025-01-05\n3,,41,true,15.75,2025-01-10\n"
    c = told("Csv", body.encode(), "x.csv")
    assert (c["row_count"], c["column_count"], c["delimiter"], c["has_header"], c["stats_rows_sampled"]) == (3, 6, ",", True, 3)
    assert [x["type"] for x in c["columns"]] == ["number", "string", "number", "boolean", "number", "date"]
    cols = {x["name"]: x for x in c["columns"]}
    assert cols["price"]["numeric_stats"]["median"] == 15.75 and cols["day"]["date_stats"]["span_days"] == 9 and cols["name"]["null_percentage"] == pytest.approx(100 / 3) and cols["name"]["unique_count"] == 2
    assert cols["active"]["boolean_stats"]["true_percentage"] == pytest.approx(200 / 3)
    assert told("Csv", b"a\tb\n1\t2", "x.tsv")["delimiter"] == "\\t" and told("Csv", b"", "x.csv")["row_count"] == 0 and told("Csv", b"\xff\xfe", "x.csv") == {"encoding": "Non-UTF-8"}
    assert told("Csv", b'a,b\n"x ""y""",z\n', "x.csv")["escape_character"] == '"'
    t = pa.table({"a": [1, 2, 5], "b": ["x", None, "y"], "at": pa.array([0, 1, 2], pa.timestamp("us"))})
    files_ = {"Parquet": io.BytesIO(), "Orc": io.BytesIO(), "ArrowIpc": io.BytesIO()}
    pq.write_table(t, files_["Parquet"])
    orc.write_table(t, files_["Orc"])
    with pa.ipc.new_file(files_["ArrowIpc"], t.schema) as w:
        w.write_table(t)
    for kind, b in files_.items():
        s = told(kind, b.getvalue())
        assert s["row_count"] == 3 and s["columns"][0]["numeric_stats"]["max"] == 5 and s["columns"][1]["unique_count"] == 2 and s["columns"][2]["type"] in ("date", "string"), kind
    b = io.BytesIO()
    np.save(b, np.arange(12, dtype="f8").reshape(4, 3))
    n = told("Npy", b.getvalue())
    assert [x["numeric_stats"]["mean"] for x in n["columns"]] == [4.5, 5.5, 6.5] and n["stats_rows_sampled"] == 4
    b = io.BytesIO()
    np.save(b, np.asfortranarray(np.arange(12, dtype="i4").reshape(4, 3)))
    assert [x["numeric_stats"]["max"] for x in told("Npy", b.getvalue())["columns"]] == [9, 10, 11]
    b = io.BytesIO()
    np.savez(b, cube=np.arange(250.0).reshape(5, 5, 10), other=np.array([1.0, np.nan]))
    z = {e["name"]: e for e in told("Npz", b.getvalue())["npy_entries"]}
    assert z["cube.npy"]["tensor3d"]["along_axis"] == 0 and len(z["cube.npy"]["tensor3d"]["planes"]) == 5 and z["cube.npy"]["tensor3d"]["planes"][0]["mean"] == 24.5 and z["other.npy"]["columns"][0]["null_percentage"] == 50
    m = told("Mtx", b"%%MatrixMarket matrix coordinate real symmetric\n3 3 2\n1 1 5\n2 1 -1\n")
    assert [(x["numeric_stats"]["min"], x["numeric_stats"]["max"], x["numeric_stats"]["mean"]) for x in m["columns"]] == [(-1, 5, pytest.approx(4 / 3)), (-1, 0, pytest.approx(-1 / 3)), (0, 0, 0)]
    assert told("Mtx", b"%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n")["columns"][1]["numeric_stats"]["mean"] == 3.5


def test_sample_size():
    from siftwork.sources.columns import sample_size

    assert sample_size(50_000, None, 4, 10_000) == 10_000 and sample_size(10_000_000, None, 4, 10_000) == 9_600 and sample_size(5 << 20, 80_000, 4, 10_000) == 80_000
    assert sample_size(50_000, None, 8_000, 10_000) == 5_000 and sample_size(1 << 40, 10, 4, 10_000) == 8_600 and sample_size(10, 3, 4, 1) == 3


def test_avro_and_classic_netcdf():
    def zig(n):
        n = (n << 1) ^ (n >> 63)
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    text = lambda s: zig(len(s)) + s.encode()
    schema = json.dumps({"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}, {"name": "e", "type": {"type": "enum", "name": "e", "symbols": ["x", "y"]}}]})
    rows = zig(7) + zig(1) + text("hi") + zig(1) + zig(-3) + zig(0) + zig(0)
    data = b"Obj\x01" + zig(1) + text("avro.schema") + text(schema) + zig(0) + b"S" * 16 + zig(2) + zig(len(rows)) + rows + b"S" * 16
    a = told("Avro", data)
    assert a["row_count"] == 2 and a["columns"][0]["numeric_stats"]["min"] == -3 and a["columns"][1]["null_percentage"] == 50 and a["columns"][2]["unique_count"] == 2
    pad = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    nc = b"CDF\x01" + struct.pack(">I", 0) + struct.pack(">II", 10, 1) + pad("x") + struct.pack(">I", 3) + struct.pack(">II", 12, 1) + pad("title") + struct.pack(">II", 2, 2) + b"hi\0\0"
    nc += struct.pack(">II", 11, 1) + pad("v") + struct.pack(">II", 1, 0) + struct.pack(">II", 12, 1) + pad("scale") + struct.pack(">IId", 6, 1, 2.5) + struct.pack(">III", 5, 12, 200)
    n = told("NetCdf", nc)
    assert n["dimensions_sample"] == [{"name": "x", "size": 3}] and n["global_attributes"] == {"title": "hi"} and n["variables"] == [{"name": "v", "type": "float", "dimensions": ["x"], "shape": [3], "attributes": {"scale": "2.5"}}]


def test_matlab_values():
    import numpy as np

    def element(kind, body):
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    def array(cls, shape, name, *parts):
        return element(14, element(6, struct.pack("<II", cls, 0)) + element(5, struct.pack(f"<{len(shape)}i", *shape)) + element(1, name.encode()) + b"".join(parts))

    inner = array(6, (1, 2), "", element(9, struct.pack("<dd", 1.0, float("nan"))))
    body = array(6, (1, 1), "one", element(9, struct.pack("<d", 4.5))) + array(6, (2, 2, 3), "cube", element(9, np.arange(12.0).tobytes())) + array(4, (1, 3), "s", element(4, "aba".encode("utf-16-le")))
    body += array(2, (1, 1), "st", element(5, struct.pack("<i", 4)), element(1, b"fld\0"), inner)
    m = told("Mat", b" " * 124 + b"\x00\x01IM" + body)
    by = {e["name"]: e for e in m["entries"]}
    assert m["variable_count"] == 4 and by["one"]["value"] == 4.5 and by["s"]["unique_chars"] == 2 and by["st"]["fields"] == ["fld"] and by["st"]["members"] == [{"depth": 1, "key": "fld", "class": "double"}]
    assert by["cube"]["tensor3d"]["along_axis"] == 0 and by["cube"]["tensor3d"]["planes"][1]["mean"] == 6.0


def test_images():
    sof = b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 64, 128, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    assert jpeg_frame(b"\xff\xd8\xff" + sof + b"\xff\xd9")["chroma_subsampling"] == "4:2:0"
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">IIBBBBB", 40, 30, 8, 6, 0, 0, 0)
    assert told("Image", png)["aspect_ratio"] == "4:3"
    assert told("Image", b'<svg viewBox="0 0 128 64"/>')["width"] == 128 and "width" not in told("Image", b'<svg width="100%"/>')


def test_documents():
    h = told("Html", b"<html lang='en'><head><title>T</title><style>x</style></head><body><p>a <b>b</b></p><ul><li>c</li></ul></body></html>")
    assert (h["title"], h["lang"], h["p_count"], h["word_count"]) == ("T", "en", 1, 4)
    p = told("Pdf", b"%PDF-1.7\n1 0 obj<</Type /Page>>\n<</Title (A \\(b\\)) /CreationDate (D:2024)>>")
    assert (p["pdf_version"], p["page_count"], p["title"]) == ("1.7", 1, "A (b)")
    assert told("Json", b'{"a": [1, {"b": 2}]}')["max_depth"] == 4 and told("Json", b"[]")["root_array_length"] == 0
    assert told("Code", b"#!/usr/bin/env python3\n\tx\n", "script")["script_type"] == "Python"
    assert told("Code", b"fn main() {}\n", "main.rs")["script_type"] == "Rust"
    assert [(b[0], b[1], b[3]) for b in markdown_blocks("# A\n\np\nq\n\n- x\n  1. y\n> q\n---\n```py\nc\n```\n```")] == [("header", 1, False), ("paragraph", 0, False), ("item", 0, False), ("item", 1, True), ("quote", 0, False), ("rule", 0, False), ("code", 0, False), ("paragraph", 0, False)]


def test_broken_files_keep_their_row():
    for kind in files.READERS:
        text, failure = files.summarise(kind, b"\x00\x01broken")
        assert json.loads(text) and (failure is None or json.loads(text) == {"stream_size": 8})


def test_paths(spark):
    rows = [("/a/.DS_Store", True), ("Desktop.ini", True), ("~$x.docx", True), ("a.swp", True), ("/b/.env", True), ("b/c.log", False), ("a.tmp.csv", False)]
    got = spark.createDataFrame(rows, "p string, w boolean").select("p", P.is_ignored(F.col("p")).alias("g"), "w").collect()
    assert all(r.g == r.w for r in got)
    kinds = [("x.TAR.GZ", "Archive"), ("a.lock", "Toml"), ("b.psv", "Csv"), ("c.cdf", "NetCdf"), ("noext", "Unknown"), ("d.rs", "Unknown"), ("a.dsf", "Audio"), (".bashrc", "Unknown")]
    assert all(r[0] == r[1] for r in spark.createDataFrame(kinds, "p string, k string").select(P.file_type(F.col("p")), "k").collect())
    assert spark.createDataFrame([("a {b} (c).txt",)], "p string").select(P.sanitised(F.col("p"))).collect()[0][0] == "a_b__c_.txt"
    with pytest.raises(ValueError):
        configured(nope=1)
    with pytest.raises(ValueError):
        Config(static_threshold=2.0)


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.toml").write_text("x = 1\n")
    (d / "b.zip").write_bytes(b"not a zip")
    (d / ".hidden").write_text("x")
    (d / "c.txt").write_text("one\ntwo")
    return d


def test_files_come_with_templates(spark, tmp_path):
    d = tmp_path / "t"
    (d / "sub").mkdir(parents=True)
    (d / "a.log").write_text("2025 INFO up x\n2025 WARN up y\n")
    (d / "b.json").write_text('{"a": 1}\n{"a": 2}\n')
    (d / "sub" / "c.txt").write_text("The old dog ran home. The old dog ran home.")
    (d / "d.md").write_text("# T\n\n- x\n")
    (d / "e").write_text('{"k": 1}\n')
    (d / "f").write_text("one two\none three\n")
    (d / "g.pkl").write_bytes(pickle.dumps({"a": 1}))
    (d / "h.pkl").write_text("module x\nname = 1\n")
    (d / "i.html").write_text("<p>The old dog ran home. The old dog ran home.</p>")
    (d / "j.csv").write_text("a,b\n1,2\n")
    (d / "k.bin").write_bytes(b"\xff\xfe\x00")
    (d / "l.log").write_text("\n")
    rows = {os.path.basename(r.path): r for r in files.read(spark, str(d)).collect()}
    show = {n: [(t.pattern, t["count"]) for t in r.templates] for n, r in rows.items()}
    assert show["a.log"] == [("2025 [POS_01] up [POS_03]", 2)] and show["b.json"] == [('{"a": 1}', 1), ('{"a": 2}', 1)] and show["c.txt"][0][1] == 2 and show["d.md"] == [("[HEADER_01]", 1), ("[LIST_01]:type=unordered", 1)]
    assert show["e"] == [('{"k": 1}', 1)] and show["f"] == [("one [POS_01]", 2)] and show["i.html"] == show["c.txt"] and show["j.csv"] == show["k.bin"] == [] and show["l.log"] == [("", 1)]
    assert (rows["g.pkl"].file_type, rows["h.pkl"].file_type) == ("Pickle", "Code") and rows["k.bin"].is_binary and rows["k.bin"].token_count == 0
    assert json.loads(rows["a.log"].metadata)["has_timestamps"] is False and json.loads(rows["j.csv"].metadata)["row_count"] == 1
    assert rows["c.txt"].writing_footprint.punctuation.period_percent == 100.0 and rows["c.txt"].compressed_tokens > 0 and rows["k.bin"].compressed_tokens == 0
    assert rows["a.log"].templates[0].examples == {"POS_01": ["INFO", "WARN"], "POS_03": ["x", "y"]}
    some = {os.path.basename(r.path) for r in files.read(spark, [str(d / "a.log"), d / "sub"]).collect()}
    assert some == {"a.log", "c.txt"}
    got = [(os.path.basename(r.key), r["rank"], r.pattern, r.template_count) for r in files.large_logs(spark, str(d / "a.log")).collect()]
    assert got == [("a.log", 1, "2025 [POS_01] up [POS_03]", 2)]
    t = {r.file_type: (r.files, r.failures) for r in files.totals(files.read(spark, str(d))).collect()}
    assert t["Log"] == (2, 0) and t[None] == (12, 0)
    record = {os.path.basename(r.path): json.loads(r.record) for r in sinks.records(files.read(spark, str(d)), "templates").collect()}["a.log"]
    assert set(record) == {"path", "file_type", "templates", "metadata"}


def test_scan_sinks_and_failures(spark, folder, tmp_path):
    got = files.read(spark, str(folder))
    rows = {os.path.basename(r.path): r for r in got.collect()}
    assert set(rows) == {"a.toml", "b.zip", "c.txt"} and rows["c.txt"].line_count == 2 and json.loads(rows["a.toml"].metadata)["key_count"] == 1
    assert [os.path.basename(r.path) for r in files.failures(got).collect()] == ["b.zip"]
    sinks.write_records(got, str(tmp_path / "out"))
    assert "failure" not in json.loads((tmp_path / "out" / "a.toml.siftwork.out").read_text())
    with pytest.raises(ValueError):
        sinks.checked(got.limit(0), files.failures(got))


def test_stream_gives_what_the_batch_gives(spark, folder, tmp_path):
    seen = []
    streams.drain(streams.scan_stream(spark, str(folder), 2), lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(map(str, seen)) == sorted(map(str, files.read(spark, str(folder)).collect()))


def test_windowed_counts(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as e union all select timestamp'2024-01-01 00:20:00', 'a' union all select timestamp'2024-01-01 01:20:00', 'b'").write.parquet(str(tmp_path / "e"))
    s = streams.windowed_counts(spark.readStream.schema("ts timestamp, e string").parquet(str(tmp_path / "e")), "ts", "e")
    q = s.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.label, r.n) for r in spark.table("w").collect()) == [("a", 2), ("b", 1)]


def test_markdown_and_html_tables(spark):
    df = spark.createDataFrame([(1, "# A\n\n- x\n- y", "Markdown"), (2, None, "Markdown"), (3, "<p>Hi <b>you</b></p>", "Html")], "k int, b string, t string")
    assert {(r.pattern, r.template_count) for r in D.markdown_templates(df.where("t = 'Markdown'"), "k", "b").collect()} == {("[HEADER_01]", 1), ("[LIST_01]:type=unordered", 2)}
    assert [r.text for r in D.html_texts(df.where("k = 3"), "k", "b").collect()] == ["Hi you"]
    assert D.summaries(df, "k", "t", "b").count() == 2


def test_array_stores(spark):
    from siftwork.sources import stores

    v2 = json.dumps({"shape": [4, 6], "chunks": [2, 3], "dtype": "<f8"}).encode()
    v3 = json.dumps({"node_type": "array", "shape": [5], "data_type": "int32", "chunk_grid": {"configuration": {"chunk_shape": [5]}}}).encode()
    rows = [("/d/s.zarr/a/.zarray", v2, 30), ("/d/s.zarr/a/0.0", b"x", 12), ("/d/t.zarr/zarr.json", v3, 9), ("/d/t.zarr/g/zarr.json", b'{"node_type": "group"}', 5), ("/d/x.txt", b"", 7)]
    df = spark.createDataFrame([(p, c, n) for p, c, n in rows], "path string, content binary, length long")
    assert {r.root: r.byte_count for r in stores.store_sizes(df).collect()} == {"/d/s.zarr": 42, "/d/t.zarr": 14}
    assert {(r.root, r.array, tuple(r.shape), r.dtype, tuple(r.chunks)) for r in stores.store_arrays(df).collect()} == {("/d/s.zarr", "a", (4, 6), "<f8", (2, 3)), ("/d/t.zarr", "", (5,), "int32", (5,))}


def test_database_columns_are_profiled(spark, tmp_path):
    from siftwork.operators import tabular
    from siftwork.sources import stores

    f = tmp_path / "p.db"
    db = sqlite3.connect(f)
    db.executescript("create table t(id integer, name text, ok int); insert into t values (5,'a',1),(7,null,0),(9,'b',1);")
    db.close()
    cells = stores.sqlite_cells(spark, str(f), ["t"])
    counts = cells.groupBy("tbl", "col_idx", "col_name", "value").agg(F.count(F.lit(1)).alias("n"))
    kinds = {r.col_name: r.type for r in tabular.inferred_types(counts, ["tbl", "col_name"]).collect()}
    assert kinds == {"id": "number", "name": "string", "ok": "boolean"}
    keys = spark.createDataFrame([("t", "id", "u.id")], "tbl string, name string, references string")
    got = stores.foreign_keys(spark.createDataFrame([("t", "id"), ("t", "name")], "tbl string, name string"), keys).collect()
    assert {r.name: r.is_foreign_key for r in got} == {"id": True, "name": False}


def test_records_and_reading_order(spark):
    from siftwork.sources import stores

    docs = spark.createDataFrame([(1, '[["a","b"],[1,2]]'), (2, '{"a":1}\n{"a":2}'), (3, "[]"), (4, None)], "k int, t string")
    got = {(r.key, r.line_no): (r.record, r.headers) for r in stores.json_records(docs, "k", "t").collect()}
    assert got == {(1, 0): ("[1, 2]", ["a", "b"]), (2, 0): ('{"a": 1}', None), (2, 1): ('{"a": 2}', None)}
    spine = spark.createDataFrame([("k", 0, "b"), ("k", 1, "gone"), ("k", 2, "a")], "book string, pos int, idref string")
    manifest = spark.createDataFrame([("k", "a", "a.html"), ("k", "b", "b.html")], "book string, id string, href string")
    assert [r.href for r in stores.spine_order(spine, manifest).collect()] == ["b.html", "a.html"]
