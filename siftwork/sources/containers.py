"""Summaries of archives, office documents, books and databases from their bytes, with the standard library only."""

from __future__ import annotations

import io
import os
import re
import sqlite3
import tarfile
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter

from siftwork.config import Config
from siftwork.functions.typecheck import BOOLEANS
from siftwork.operators.paths import LABELS, TYPE_OF
from siftwork.sources.columns import boolean_stats, date_stats, instant, numeric_stats

MOST_MEMBER = 52_428_800


def member(z: zipfile.ZipFile, name: str, most: int = MOST_MEMBER) -> bytes:
    """A member's bytes; one that claims or turns out to be larger than the bound is an error (0: no bound)."""
    if most and z.getinfo(name).file_size > most:
        raise ValueError(f"{name} is larger than {most} bytes")
    with z.open(name) as f:
        data = f.read(most + 1 if most else -1)
    if most and len(data) > most:
        raise ValueError(f"{name} is larger than {most} bytes")
    return data


def ignored(path: str, config: Config = Config()) -> bool:
    """`paths.is_ignored` for one path."""
    name = re.split(r"[/\\]", path)[-1]
    if not name:
        return False
    if config.ignore_hidden_files and name.startswith("."):
        return True
    return any(name.endswith(p[1:]) if p.startswith("*") else name.startswith(p[:-1]) if p.endswith("*") else name.lower() == p.lower() for p in config.ignore_patterns if p)


def _kind(name: str) -> str:
    low = name.lower()
    kind = "Archive" if low.endswith((".tar.gz", ".tar.bz2", ".tar.xz", ".tgz")) else TYPE_OF.get(low.rsplit(".", 1)[-1] if "." in low else "", "Unknown")
    return LABELS[kind]


def zip_summary(data: bytes, path: str = "", config: Config = Config()) -> dict:
    """Members with sizes and types; folders, ignored names and resource forks are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir() and not i.filename.startswith("__MACOSX/") and not ignored(i.filename, config)]
    entries = [{"name": i.filename, "size": i.file_size, "compressed_size": i.compress_size, "type": _kind(i.filename)} for i in infos]
    return {
        "file_count": len(entries),
        "total_size": sum(e["size"] for e in entries),
        "total_compressed_size": sum(e["compressed_size"] for e in entries),
        "entry_type_counts": dict(sorted(Counter(e["type"] for e in entries).items())),
        "entries": entries,
    }


def tar_summary(data: bytes) -> dict:
    """Members of a plain tar; of a compressed one only the format and, for gzip, the size it records."""
    for magic, name in ((b"\x1f\x8b", "gz"), (b"BZh", "bz2"), (b"\xfd7zXZ", "xz")):
        if data.startswith(magic):
            out = {"format": f"tar.{name}", "compressed_size": len(data), "note": "members of a compressed archive aren't listed"}
            if name == "gz" and len(data) >= 4:
                out["uncompressed_size"] = int.from_bytes(data[-4:], "little")
            return out
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
        entries = [{"name": m.name, "size": m.size} for m in t if m.isfile()]
    return {"format": "tar", "file_count": len(entries), "uncompressed_size": sum(e["size"] for e in entries), "entries": entries}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _core(z: zipfile.ZipFile) -> dict:
    if "docProps/core.xml" not in z.namelist():
        return {}
    wanted = {"title": "title", "creator": "author", "subject": "subject", "created": "created", "modified": "modified", "lastModifiedBy": "last_modified_by", "revision": "revision"}
    root = ET.fromstring(member(z, "docProps/core.xml"))
    return {wanted[_local(e.tag)]: e.text for e in root.iter() if _local(e.tag) in wanted and e.text}


def docx_summary(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(member(z, "word/document.xml"))
        out = _core(z)
    paragraphs = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in root.iter() if _local(p.tag) == "p"]
    text = "\n".join(paragraphs)
    return out | {
        "word_count": len(text.split()),
        "character_count": sum(map(len, paragraphs)),
        "character_count_no_spaces": sum(len("".join(p.split())) for p in paragraphs),
        "paragraph_count": sum(1 for p in paragraphs if p.strip()),
    }


def content_path(of: str, href: str) -> str:
    """Where a reference in a part of a package leads: beside the part, or from the root where it begins with /."""
    base = of.rsplit("/", 1)[0] + "/" if "/" in of else ""
    return os.path.normpath(href[1:] if href.startswith("/") else base + href).replace(os.sep, "/")


def xlsx_summary(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        out = _core(z)
        book = ET.fromstring(member(z, "xl/workbook.xml"))
        sheets = [(s.get("name"), next((v for k, v in s.attrib.items() if _local(k) == "id"), None)) for s in book.iter() if _local(s.tag) == "sheet"]
        names = [n for n, _ in sheets]
        rels = "xl/_rels/workbook.xml.rels"
        targets = {e.get("Id"): e.get("Target", "") for e in ET.fromstring(member(z, rels)).iter() if _local(e.tag) == "Relationship"} if rels in z.namelist() else {}
        stats = {}
        for k, (name, ref) in enumerate(sheets):
            part = content_path("xl/workbook.xml", targets.get(ref) or f"worksheets/sheet{k + 1}.xml")
            if part not in z.namelist():
                continue
            rows, columns = 0, 0
            for e in ET.fromstring(member(z, part)).iter():
                if _local(e.tag) == "c" and (m := re.fullmatch(r"([A-Z]+)(\d+)", e.get("r", ""))):
                    column = 0
                    for letter in m[1]:
                        column = column * 26 + ord(letter) - 64
                    rows, columns = max(rows, int(m[2])), max(columns, column)
            stats[name] = {"rows": rows, "columns": columns}
    return out | {"sheet_count": len(names), "sheet_stats": stats}


def pptx_summary(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        show = ET.fromstring(member(z, "ppt/presentation.xml"))
        return _core(z) | {"slide_count": sum(1 for e in show.iter() if _local(e.tag) == "sldId")}


def epub_parts(data: bytes) -> tuple[dict, list[bytes]]:
    """Metadata of a book, and its chapters in the order of the spine; ids that the manifest lacks are skipped."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        box = ET.fromstring(member(z, "META-INF/container.xml"))
        path = next(e.get("full-path") for e in box.iter() if _local(e.tag) == "rootfile")
        root = ET.fromstring(member(z, path))
        first = lambda tag: next((e.text for e in root.iter() if _local(e.tag) == tag and e.text), None)
        manifest = {e.get("id"): e.get("href") for e in root.iter() if _local(e.tag) == "item"}
        spine = [e.get("idref") for e in root.iter() if _local(e.tag) == "itemref"]
        chapters = []
        if "META-INF/encryption.xml" not in z.namelist():
            there = set(z.namelist())
            chapters = [member(z, p) for p in (content_path(path, manifest[i]) for i in spine if i in manifest) if p in there]
    return {"title": first("title"), "author": first("creator"), "language": first("language"), "identifier": first("identifier"), "chapter_count": len(spine)}, chapters


def affinity(declared: str | None) -> str:
    """Storage class that a declared column type means."""
    t = (declared or "").upper()
    if "INT" in t:
        return "INTEGER"
    if any(x in t for x in ("CHAR", "CLOB", "TEXT")):
        return "TEXT"
    if not t or "BLOB" in t:
        return "BLOB"
    return "REAL" if any(x in t for x in ("REAL", "FLOA", "DOUB")) else "NUMERIC"


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def column_by_type(db: sqlite3.Connection, table: str, column: str, kind: str) -> dict:
    """Null share, distincts and figures of a column: numbers, or booleans where an INTEGER column has nothing else; lengths of
    texts, and dates where more than half of the cells are some; sizes of blobs. Counting is left to the database."""
    t, c = quoted(table), quoted(column)
    shown = f"cast({c} as text)"
    null = f"({c} is null or lower({shown}) in ('', 'null', 'nil'))"
    rows, nulls, distinct = db.execute(f"select count(*), coalesce(sum({null}), 0), count(distinct case when not {null} then {shown} end) from {t}").fetchone()
    out: dict = {"null_percentage": 100.0 * nulls / rows if rows else None, "unique_count": distinct}
    if not rows:
        return out
    if kind in ("INTEGER", "REAL", "NUMERIC"):
        marks = ", ".join(f"'{b}'" for b in BOOLEANS)
        held, other = db.execute(f"select count(*), coalesce(sum(lower({shown}) not in ({marks})), 0) from {t} where {c} is not null and {shown} <> ''").fetchone()
        if kind == "INTEGER" and held and not other:
            groups = db.execute(f"select {shown}, count(*) from {t} where not {null} group by 1").fetchall()
            true = sum(n for v, n in groups if boolean_stats([v])["true_percentage"])
            out["boolean_stats"] = {"true_percentage": 100.0 * true / sum(n for _, n in groups)} if groups else None
        else:
            out["numeric_stats"] = numeric_stats([float(v) for (v,) in db.execute(f"select {c} from {t} where typeof({c}) in ('integer', 'real')")])
    elif kind == "TEXT":
        lo, hi, mean = db.execute(f"select min(length(cast({c} as blob))), max(length(cast({c} as blob))), avg(length(cast({c} as blob))) from {t} where not {null}").fetchone()
        out["text_stats"] = {"min_length": lo, "max_length": hi, "avg_length": mean} if lo is not None else None
        counted = db.execute(f"select {shown}, count(*) from {t} where not {null} group by 1")
        seconds, dated = [], 0
        for v, n in counted:
            at = instant(v)
            if at is not None:
                seconds.append(at)
                dated += n
        if dated * 2 > rows:
            out["date_stats"] = date_stats(seconds)
    elif kind == "BLOB":
        lo, hi, mean = db.execute(f"select min(length({c})), max(length({c})), avg(length({c})) from {t} where {c} is not null").fetchone()
        out["blob_stats"] = {"min_size": lo, "max_size": hi, "avg_size": mean} if lo is not None else None
    return {k: v for k, v in out.items() if v is not None}


def sqlite_summary(data: bytes) -> dict:
    """Tables with rows, columns, keys, indexes, and the statistics of each column by its declared type."""
    db = sqlite3.connect(":memory:")
    # a file in write-ahead mode says so in two bytes of its header; without its log it is read as a plain one
    db.deserialize(data[:18] + b"\x01\x01" + data[20:] if data[18:20] == b"\x02\x02" else data)
    try:
        one = lambda sql: db.execute(sql).fetchone()[0]
        tables = []
        for (name,) in db.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name").fetchall():
            foreign = {r[3]: f"{r[2]}.{r[4]}" for r in db.execute(f"pragma foreign_key_list({quoted(name)})")}
            columns = [
                {"name": c[1], "type": affinity(c[2]), "not_null": bool(c[3]), "is_primary_key": c[5] > 0, "is_foreign_key": c[1] in foreign, "references": foreign.get(c[1])}
                for c in db.execute(f"pragma table_info({quoted(name)})").fetchall()
            ]
            keys = [c[1] for c in sorted(db.execute(f"pragma table_info({quoted(name)})").fetchall(), key=lambda c: c[5]) if c[5] > 0]
            indexes = [
                {"name": i[1], "unique": bool(i[2]), "columns": [c[2] for c in db.execute(f"pragma index_info({quoted(i[1])})")]}
                for i in db.execute(f"pragma index_list({quoted(name)})").fetchall()
            ]
            for c in columns:
                c |= column_by_type(db, name, c["name"], c["type"])
            tables.append({"name": name, "row_count": one(f"select count(*) from {quoted(name)}"), "columns": columns, "primary_key": keys, "indexes": indexes})
        return {
            "page_size": one("pragma page_size"),
            "encoding": one("pragma encoding"),
            "sqlite_version": sqlite3.sqlite_version,
            "table_count": len(tables),
            "total_rows": sum(t["row_count"] for t in tables),
            "tables": tables,
        }
    finally:
        db.close()
