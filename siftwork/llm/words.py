"""Words of a text, however it is written."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np

_BREAK = re.compile(r"(?<=\w)[-­‐‑⁃]+[ \t\r]*\n[ \t]*(?:(?://|[>#*|;%]+)[ \t]*)*(?=\w)")
_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u|wbr)\b[^<>]*>", re.I)
_TAG = re.compile(r"<(?:/?[a-zA-Z][^<>]*|!--.*?--)>", re.S)
_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]*(?:\s\"[^\"]*\")?\)")
_WORD = re.compile(r"[^\W_]+")
_MARKS = {ord(c): None for c in "*`~"}


class _Invisible(dict):
    """Drops format characters, combining marks that only decorate, and variation selectors."""

    def __missing__(self, c: int):
        kind = unicodedata.category(chr(c))
        out = None if kind in ("Cf", "Mn", "Me") and not 0x0900 <= c < 0x1000 or kind == "Cc" and chr(c) not in "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85" else c
        self[c] = out
        return out


_invisible = _Invisible()


def words(text: str | None) -> list[str]:
    """The words of a text in order, free of case, punctuation, mark-up, spacing, line breaks with or without hyphenation,
    invisible characters and compatibility forms. Null and empty texts have none."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.replace("­\n", "-\n").replace("­\r\n", "-\n"))
    if "\n" in text:
        text = _BREAK.sub("", text.replace("\r\n", "\n"))
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_invisible))
    return _WORD.findall(text.translate(_MARKS).casefold())


class Hashes(dict):
    """64-bit hash of each word, kept for the words seen last."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = Hashes()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A second, independent-looking hash of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(ws: list[str]) -> np.ndarray:
    return np.fromiter((_hashes[w] for w in ws), dtype=np.uint64, count=len(ws))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; empty for shorter texts."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * _MIX + h[k : k + n]
    return mixed(out)
