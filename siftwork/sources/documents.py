"""Summaries of HTML, Markdown, JSON, PDF and source code."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

from siftwork.functions.onetext import lines, parsed, tokens
from siftwork.sources.columns import date_seconds

_COUNTED = "link style script h1 h2 h3 h4 h5 h6 img table form p ul ol iframe article nav section header footer main".split()
_CONTENT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "blockquote", "figcaption"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags: Counter = Counter()
        self.meta: dict = {}
        self.open: list[str] = []
        self.title: list[str] = []
        self.plain: list[str] = []
        self.parts: list[list[str]] = []  # text of each content element, in order of opening
        self.held: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.tags[tag] += 1
        a = dict(attrs)
        if tag == "html" and a.get("lang"):
            self.meta["lang"] = a["lang"]
        if tag == "meta":
            name = (a.get("name") or "").lower()
            if a.get("charset"):
                self.meta["charset"] = a["charset"]
            if name == "description":
                self.meta["meta_description"] = a.get("content")
            if name == "viewport":
                self.meta["has_viewport"] = True
        if tag not in _VOID:
            self.open.append(tag)
            if tag in _CONTENT:
                self.parts.append([])
                self.held.append(len(self.parts) - 1)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open:
                t = self.open.pop()
                if t in _CONTENT and self.held:
                    self.held.pop()
                if t == tag:
                    break

    def handle_data(self, data):
        if "title" in self.open:
            self.title.append(data)
        if "script" in self.open or "style" in self.open:
            return
        if data.strip():
            self.plain.append(data.strip())
            for k in self.held:  # text inside nested content elements belongs to each of them
                self.parts[k].append(data.strip())


def html_page(text: str) -> _Page:
    page = _Page()
    page.feed(text)
    page.close()
    return page


def html_summary(data: bytes) -> dict:
    p = html_page(data.decode("utf-8", "replace"))
    plain = " ".join(p.plain)
    out = {"title": "".join(p.title).strip() or None, "has_viewport": False} | p.meta
    out |= {f"{t}_count": p.tags[t] for t in _COUNTED}
    return out | {"heading_count": sum(p.tags[f"h{k}"] for k in range(1, 7)), "plain_text_len": len(plain), "word_count": len(plain.split())}


def html_text(text: str | None) -> str:
    """Text of the content elements, nested ones once for each ancestor."""
    return " ".join(" ".join(x) for x in html_page(text).parts if x) if text else ""


_HEAD, _RULE, _FENCE = re.compile(r"(#{1,6})\s+(.*)"), re.compile(r"(?:-{3,}|\*{3,}|_{3,})$"), re.compile(r"(```|~~~)(\S*)")
_ITEM, _NUMBERED = re.compile(r"\s*[-*+]\s+(.*)"), re.compile(r"\s*\d+[.)]\s+(.*)")


def markdown_blocks(text: str | None) -> list[tuple[str, int, str, bool, str | None]]:
    """kind, level, text, ordered and language of the blocks: header, rule, code, quote, list item, paragraph."""
    ls = (text or "").replace("\r\n", "\n").split("\n")
    out: list[tuple[str, int, str, bool, str | None]] = []
    k = 0
    while k < len(ls):
        s = ls[k].strip()
        if not s:
            k += 1
            continue
        if m := _HEAD.match(s):
            out.append(("header", len(m[1]), m[2].strip(), False, None))
        elif _RULE.match(s):
            out.append(("rule", 0, "", False, None))
        elif (m := _FENCE.match(s)) and (end := next((j for j in range(k + 1, len(ls)) if ls[j].strip().startswith(m[1])), None)) is not None:
            out.append(("code", 0, "\n".join(ls[k + 1 : end]), False, m[2] or None))
            k = end
        elif s.startswith(">"):
            part = []
            while k < len(ls) and ls[k].strip().startswith(">"):
                part.append(ls[k].strip().lstrip(">").strip())
                k += 1
            out.append(("quote", 0, " ".join(part), False, None))
            continue
        elif m := _ITEM.match(ls[k]) or _NUMBERED.match(ls[k]):
            out.append(("item", (len(ls[k]) - len(ls[k].lstrip())) // 2, m[1].strip(), bool(_NUMBERED.match(ls[k])), None))
        else:
            part = [s]
            while k + 1 < len(ls) and (n := ls[k + 1].strip()) and not (_HEAD.match(n) or _RULE.match(n) or n.startswith((">", "```", "~~~")) or _ITEM.match(ls[k + 1]) or _NUMBERED.match(ls[k + 1])):
                part.append(n)
                k += 1
            out.append(("paragraph", 0, " ".join(part), False, None))
        k += 1
    return out


def json_depth(v) -> int:
    """Depth of a value; scalars have 1."""
    deepest, todo = 1, [(v, 1)]
    while todo:
        x, d = todo.pop()
        deepest = max(deepest, d)
        todo += [(y, d + 1) for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]
    return deepest


def line_figures(text: str) -> dict:
    """Bytes, lines, kind of line ends, longest line in bytes and blank lines of a text."""
    ls = lines(text)
    crlf = text.count("\r\n")
    lf, cr = text.count("\n") - crlf, text.count("\r") - crlf
    kinds = [k for k, n in (("crlf", crlf), ("lf", lf), ("cr", cr)) if n]
    return {
        "byte_count": len(text.encode("utf-8", "surrogatepass")),
        "line_count": len(ls),
        "line_ending": kinds[0] if len(kinds) == 1 else "mixed" if kinds else None,
        "max_line_length": max((len(x.encode("utf-8", "surrogatepass")) for x in ls), default=None),
        "blank_line_count": sum(1 for x in ls if not x.strip()) or None,
    }


def log_summary(data: bytes) -> dict:
    """Figures of the lines, and whether one of the first fifty holds a time."""
    text = data.decode()
    return line_figures(text) | {"has_timestamps": any(map(holds_time, lines(text)[:50]))}


_UNIX = re.compile(r"[1-3]\d{9}|4000000000|[1-3]\d{12}|4000000000000")


def holds_time(line: str) -> bool:
    """Whether a line holds a Unix time, or one to six words from one of its first six that are a date or time."""
    if _UNIX.search(line):
        return True
    words = tokens(line)
    runs = (" ".join(words[i : i + n]) for i in range(min(6, len(words))) for n in range(1, min(6, len(words) - i) + 1))
    return any(date_seconds(w) is not None for w in runs if re.search(r"\d[/:-]\d|\d{6}", w))


def json_summary(data: bytes) -> dict:
    """Figures of the lines; kind, size and depth of the root, or the depth of the first line of one value a line; whether it is
    laid out over indented lines."""
    text = data.decode()
    out = line_figures(text) | {"pretty_printed": "\n  " in text or "\n\t" in text}
    try:
        doc = parsed(text)
    except (ValueError, RecursionError):
        try:
            return out | {"max_depth": json_depth(parsed((lines(text) or [""])[0]))}
        except (ValueError, RecursionError):
            return out
    if isinstance(doc, list):
        return out | {"root_type": "array", "root_array_length": len(doc), "max_depth": json_depth(doc)}
    if isinstance(doc, dict):
        return out | {"root_type": "object", "root_object_key_count": len(doc), "max_depth": json_depth(doc)}
    return out | {"max_depth": 1}


def pdf_summary(data: bytes) -> dict:
    """Version, pages, encryption and the Info texts that stand in the file uncompressed."""
    if data[:5] != b"%PDF-":
        raise ValueError("not a PDF file")
    info = {}
    for key, name in ((b"Title", "title"), (b"Author", "author"), (b"Subject", "subject"), (b"Creator", "creator"), (b"Producer", "producer"), (b"CreationDate", "creation_date"), (b"ModDate", "modification_date")):
        if m := re.search(rb"/" + key + rb"\s*\(((?:[^()\\]|\\.)*)\)", data, re.S):
            raw = re.sub(rb"\\([()\\])", rb"\1", m[1])
            info[name] = raw.decode("utf-16") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("latin1")
    return info | {"pdf_version": data[5:8].decode("latin1"), "page_count": len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", data)), "is_encrypted": b"/Encrypt" in data}


# Languages of extensions, file names and interpreters.
_LANGUAGE = {"rs": "Rust", "py": "Python", "js": "JavaScript", "ts": "TypeScript", "go": "Go", "c": "C", "h": "C", "cpp": "C++", "java": "Java", "rb": "Ruby", "sh": "Shell", "sql": "SQL"}
_NAMES = {"makefile": "Makefile", "dockerfile": "Dockerfile", "rakefile": "Ruby"}
_RUN = {"python": "Python", "node": "JavaScript", "bash": "Shell", "sh": "Shell", "ruby": "Ruby", "perl": "Perl"}


def code_summary(data: bytes, path: str = "") -> dict:
    """Language by interpreter line, then extension, then name; byte-order mark, line ends, longest line, indentation."""
    bom = next((n for b, n in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")) if data.startswith(b)), None)
    text = data.decode("utf-8", "replace").lstrip("﻿")
    name = path.rsplit("/", 1)[-1].lower()
    language = None
    if m := re.match(r"#!\s*\S*?(?:/env\s+)?([a-z]+)[\d.]*\s*(?:\n|$|\s)", text):
        language = _RUN.get(m[1])
    language = language or _LANGUAGE.get(name.rsplit(".", 1)[-1]) or _NAMES.get(name)
    crlf = text.count("\r\n")
    lf, cr = text.count("\n") - crlf, text.count("\r") - crlf
    kinds = [k for k, n in (("lf", lf), ("crlf", crlf), ("cr", cr)) if n]
    ls = text.splitlines()
    lead = Counter("tabs" if x[0] == "\t" else "spaces" for x in ls if x[:1] in ("\t", " ") and x.strip())
    return {
        "script_type": language,
        "bom": bom,
        "line_ending": kinds[0] if len(kinds) == 1 else "mixed" if kinds else None,
        "trailing_newline": text.endswith(("\n", "\r")),
        "max_line_length": max((len(x.encode()) for x in ls), default=0),
        "blank_line_count": sum(1 for x in ls if not x.strip()),
        "indentation": "mixed" if len(lead) > 1 else next(iter(lead), None),
    }
