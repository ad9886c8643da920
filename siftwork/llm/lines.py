"""What the lines of a text are: sentences, entries, rows of cells, rulings or noise."""

from __future__ import annotations

import re

# Common words of each language.
COMMON = {
    "en": "the of and to in a is that it for on with as are this was be by an at from which or but not what when so",
    "de": "der die das und in den von zu mit dem ist nicht ein eine des auf für im sich als auch wie jede mehr alle",
    "fr": "le la les de des du et un une dans pour que qui est sur pas plus par au avec ce chaque sa ses toutes",
    "es": "el la los las de del y un una en que es por con para no se su más lo como cada todas",
    "pt": "o a os as de do da dos das e um uma em que é por com para não se no na mais cada todas",
    "it": "il lo la i gli le di del della e un una in che è per con non si da al più ogni tutte",
    "nl": "de het een van en in is op dat te met voor niet zijn aan er om als bij elke meer dan alle",
    "ru": "и в не на что с по как из у за от для это к о так же но все более перед",
    "zh": "的 一 是 不 了 在 有 我 这 中 大 来 上 个 到 说 们 为 和 地 所 以 也 时 与 每 其",
}
COMMON_WORDS = frozenset(w for code, ws in COMMON.items() if code != "zh" for w in ws.split())
#: Bit set of the languages that each word is common in, in the order of COMMON.
LANGUAGES_OF: dict[str, int] = {}
for _bit, _words in enumerate(COMMON.values()):
    for _w in _words.split():
        LANGUAGES_OF[_w] = LANGUAGES_OF.get(_w, 0) | 1 << _bit
NAVIGATION = frozenset("page next prev previous top home back menu seite weiter suivant siguiente copyright".split())

CJK = r"㐀-䶿一-鿿豈-﫿぀-ヿ"
_TAGS = re.compile(r"</?[a-zA-Z][^<>]*>")
_MARK = re.compile(r"^\s*(?:(?:[-*+•‣◦·–—]|\[[ xX✓]?\]|\(?(?:\d{1,4}|[a-zA-Z]|[ivxIVX]{1,5})[.)])\s+)+")
_HEADING = re.compile(r"^\s*#{1,6}\s")
_QUOTE = re.compile(r"^(?:\s*>)+\s?")
_RULING = re.compile(r"^[\s|+\-=:_─-╿~*]+$")
_HEX = re.compile(r"^\s*(?:0x)?[0-9a-fA-F]{4,16}:?\s+(?:[0-9a-fA-F]{2,8}(?:\s+|$)){2,}")
_SETTING = re.compile(r"^\s*[\w.\-]+\s*[=:]\s*\S+(?:\s\S+){0,3}$")
_PATH = re.compile(r"^\s*(?:[a-zA-Z]:)?[\w.\-~]*(?:[/\\][\w.\-]+){2,}/?$")
_BLOB = re.compile(r"^[A-Za-z0-9+/=_\-]{24,}$")
_SCRAP = re.compile(r"^(?=.*[+=/\d])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]{8,}={0,2}$|^[A-Za-z0-9+/]{2,}==?$")
_WORD = re.compile(rf"[{CJK}]|[^\W_]+(?:[_'’\-][^\W_]+)*")
_STOP = re.compile(r"""[^\W_]["'”’»)\]%]*[.!?]["'”’»)\]]*(?=\s|$)|[。！？]""")
_GAP = re.compile(r"\S(?: {2,}|\t)(?=\S)")
_CELL = re.compile(r"[,;](?=\S)")
_TIGHT = re.compile(r"[^\s,;](?:[,;](?:\"[^\"]*\"|[^\s,;\"]*(?: [^\s,;\"]+)*))+")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"(?<![^\s,;\"])\d[\d.:\-]*(?![^\s,;\"])")
_VOWEL = re.compile(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýœаеёиоуыэюя]")
#: Five consonants in a row, in Latin letters.
_MASH = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}")
_ODD = re.compile(r"[¡-©«-´¶-¸»-¿×÷�†-‧€‚„ÂÃÐÑâ]")



def ends_sentence(s: str) -> bool:
    """Whether a stripped line ends in a mark behind a word, or in an ideographic one, closing quotes, brackets and emphasis aside."""
    t = s.rstrip("\"'”’»)]*_")
    if t and t[-1] in ".!?…":
        u = t[:-1].rstrip("\"'”’»)]%")
        return bool(u) and (u[-1].isalnum() or u[-1] == "_")
    t = t.rstrip("\"'”’»」)]*_")
    return bool(t) and t[-1] in "。！？"


SENTENCE, ENTRY, ROW, RULING, NOISE, HEADING, OTHER = "sentence entry row ruling noise heading other".split()


def line_words(raw: str) -> list[str]:
    """The words of a line in lower case; every character of an ideographic script is one."""
    if "İ" in raw:  # its lower case is two characters, of which one is no letter
        return [w.lower() for w in _WORD.findall(raw)]
    return _WORD.findall(raw.lower())


def line_kind(raw: str, known: list[str] | None = None) -> str:
    """Kind of one line that isn't blank, looked at on its own. known: its words, where the caller has them."""
    s = _QUOTE.sub("", raw) if ">" in raw[:4] else raw
    tagged = "<" in s
    s = _TAGS.sub("", s).strip() if tagged else s.strip()
    if not s:
        return OTHER
    # what a line begins with tells which layouts it can't have
    first, mark, heading = s[0], None, False
    if first.isalpha():
        if first in "abcdefABCDEF" and _HEX.match(s):
            return NOISE
        start = s[1:6]
        if "." in start or ")" in start:
            mark = _MARK.match(s)
    else:
        if _RULING.match(s):
            return RULING if len(s) >= 3 and ("-" in s or "=" in s or "─" in s or "━" in s or "═" in s) and " - " not in s and _ruled(s) else NOISE
        if _HEX.match(s):
            return NOISE
        heading, mark = first == "#" and bool(_HEADING.match(s)), _MARK.match(s)
    body = s[mark.end() :] if mark else s.lstrip("# ") if heading else s
    ws = line_words(body) if known is None or mark or tagged else known
    sizes = sum(map(len, ws))
    letters = sizes if not _DIGIT.search(body) else sum([len(w) for w in ws if not w.isdigit()])
    if "|" in s and s.count("|") >= 2 and ws or "│" in s or "┃" in s:
        return ROW
    if letters == 0:
        return ROW if len(_NUMBER.findall(s)) >= 2 and _cells(raw.strip("\r\n")) >= 2 else ENTRY if mark and ws else NOISE
    if not mark and len(ws) <= 3 and all([w.isdigit() or w.rstrip("0123456789") in NAVIGATION for w in ws]):
        return NOISE
    if "/" in s and _path(s) or ("=" in body or ":" in body) and _SETTING.match(body) and not ends_sentence(body):
        return HEADING if heading else ENTRY
    n, width = len(body.split()), len(body) - body.count(" ")
    cells = _cells(s)
    if n == 1 and (_SCRAP.match(body) or _BLOB.match(body) and not body.islower() or len(set(body)) <= 4 < len(body) / 3 or len(body) > 60 and not _cjk(body)):
        return NOISE
    if not body.isascii() and len(_ODD.findall(body)) * 5 > width:
        return NOISE
    if letters * 3 < width and cells < 2:
        return ENTRY if mark else NOISE
    cjk = _cjk(body)
    known_words = sum(map(COMMON_WORDS.__contains__, ws))
    if not cjk and n >= 4:
        if len(ws) >= 6 and (sizes <= 1.4 * len(ws) or len(set(ws)) * 4 <= len(ws)):
            return NOISE
        if cells < 3 and known_words * 8 < len(ws):  # else it is made of words
            words = [w for w in ws if not w.isdigit() and "_" not in w]
            bare = sum([1 for w in words if len(w) > 2 and not _VOWEL.search(w) or _MASH.search(w)])
            if words and bare * 3 >= len(words):
                return NOISE
    if cells >= 2 and not (n >= 8 and ends_sentence(body)):
        return ROW
    common = cjk >= 4 or known_words > 0
    if heading:
        return HEADING
    if common and not mark and (n >= 8 or cjk >= 14):
        return SENTENCE
    if (len(ws) >= 4 or len(ws) == 3 and common) and _STOP.search(body):
        return SENTENCE
    if not common and len(ws) >= 8 and not mark:
        return NOISE
    return ENTRY


def _ruled(s: str) -> bool:
    """Whether a line of ruling characters is made of runs, as a ruling is."""
    return sum(len(m) for m in re.findall(r"([-=─-╿])\1+", s.replace("+", "")) for m in [m * 2]) * 1 >= 1 and len(set(s) - set(" |+:-=─━═│┃┼├┤┌┐└┘┬┴╪╬")) == 0


def _path(s: str) -> bool:
    if "/" not in s or len(s) > 200 or not _PATH.match(s):
        return False
    return bool(re.search(r"\.\w{1,5}$", s)) or s.islower() or len(s) < 40 and not any(map(str.isdigit, s))


def _cjk(s: str) -> int:
    return 0 if s.isascii() else len(re.findall(rf"[{CJK}]", s))


def _cells(s: str) -> int:
    """Cells of a line, by gaps, tabs or tight separators: 1 where it has none."""
    gaps = len(_GAP.findall(s.strip())) if "  " in s or "\t" in s else 0
    if "," not in s and ";" not in s:
        return 1 + gaps
    tight = len(_CELL.findall(s))
    loose = s.count(", ") + s.count("; ")
    return 1 + max(gaps, tight if tight > loose and "://" not in s else 0)


def paragraphs(lines: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for x in lines:
        if x.strip():
            out[-1].append(x)
        elif out[-1]:
            out.append([])
    return [p for p in out if p]


def _stops(x: str) -> int:
    return len(_STOP.findall((_QUOTE.sub("", x) if ">" in x else x).strip()))


def _ends(x: str) -> bool:
    return ends_sentence((_TAGS.sub("", x) if "<" in x else x).strip())


class Paragraph:
    """What its lines say together: counts that add up over the lines, so that parts of a paragraph merge (`joined`) to what
    one pass over it gives. Lines that were added here are kept until their kinds are known, as few paragraphs need more."""

    __slots__ = ("size", "kinds", "long_entries", "stops", "words", "barred", "marked", "mark_first", "last_ends", "raw")

    def __init__(self) -> None:
        self.size = self.long_entries = self.stops = self.words = 0
        self.kinds: dict[str, int] = {}
        self.barred = self.marked = self.mark_first = self.last_ends = False
        self.raw: list[tuple[str, str, int]] = []  # lines whose further counts aren't taken yet

    def add(self, raw: str, kind: str, words: int) -> None:
        self.raw.append((raw, kind, words))

    def counted(self) -> Paragraph:
        """Itself, with all counts taken."""
        for x, k, words in self.raw:
            mark = _MARK.match(x) is not None
            if self.size == 0:
                self.mark_first = mark
            else:
                self.marked |= mark
            self.size += 1
            self.kinds[k] = self.kinds.get(k, 0) + 1
            self.long_entries += k == ENTRY and len(x.split()) >= 5
            self.stops += _stops(x)
            self.words += words
            self.barred |= "|" in x or "│" in x
        if self.raw:
            self.last_ends = _ends(self.raw[-1][0])
        self.raw = []
        return self

    def joined(self, other: Paragraph) -> Paragraph:
        """This part followed by the other."""
        a, b = self.counted(), other.counted()
        if a.size == 0 or b.size == 0:
            return b if a.size == 0 else a
        out = Paragraph()
        out.kinds = {k: a.kinds.get(k, 0) + b.kinds.get(k, 0) for k in {**a.kinds, **b.kinds}}
        out.size, out.long_entries, out.stops, out.words = a.size + b.size, a.long_entries + b.long_entries, a.stops + b.stops, a.words + b.words
        out.barred, out.marked, out.mark_first, out.last_ends = a.barred or b.barred, a.marked or b.marked or b.mark_first, a.mark_first, b.last_ends
        return out

    def packed(self) -> list[int]:
        p = self.counted()
        return [p.size, p.long_entries, p.stops, p.words, int(p.barred), int(p.marked), int(p.mark_first), int(p.last_ends), *[p.kinds.get(k, 0) for k in KINDS]]

    @staticmethod
    def unpacked(v: list[int]) -> Paragraph:
        p = Paragraph()
        p.size, p.long_entries, p.stops, p.words = map(int, v[:4])
        p.barred, p.marked, p.mark_first, p.last_ends = map(bool, v[4:8])
        p.kinds = {k: int(n) for k, n in zip(KINDS, v[8:]) if n}
        return p

    def verdict(self) -> str:
        """How the lines are taken: "alone" as they are, "text" all as sentences but headings, "long" entries of five words or
        more as sentences. Lines of wrapped prose may be as short as entries: where a paragraph ends as a sentence does and has
        no marks, rows or rulings that say otherwise, all of its lines belong to sentences."""
        if self.size == 0 and self.raw:  # all of it is here: only what decides is looked at
            kinds = [k for _, k, _ in self.raw]
            if len(kinds) == 1 or not (ENTRY in kinds or ROW in kinds or NOISE in kinds):
                return "alone"
            if RULING in kinds or kinds.count(NOISE) * 2 >= len(kinds) or any("|" in x or "│" in x for x, _, _ in self.raw) or any(_MARK.match(x) for x, _, _ in self.raw[1:]):
                return "alone"
        p = self.counted()
        k = p.kinds
        if p.size <= 1 or not (ENTRY in k or ROW in k or NOISE in k):
            return "alone"
        if RULING in k or k.get(NOISE, 0) * 2 >= p.size or p.barred or p.marked:
            return "alone"
        if p.stops and p.words >= 5 and (p.words <= 80 * p.stops and p.last_ends or p.stops >= 2 and p.words <= 40 * p.stops):
            return "text"
        return "long" if SENTENCE in k else "alone"  # prose without punctuation, a sentence a line: shorter ones are sentences too

    def totals(self) -> dict[str, int]:
        """Lines of each kind."""
        how = self.verdict()
        if how == "alone" and self.raw:
            out: dict[str, int] = {}
            for _, k, _ in self.raw:
                out[k] = out.get(k, 0) + 1
            return out
        k = dict(self.kinds)
        if how == "text":
            head = k.get(HEADING, 0)
            return {SENTENCE: self.size - head, HEADING: head}
        if how == "long":
            k[SENTENCE] = k.get(SENTENCE, 0) + self.long_entries
            k[ENTRY] = k.get(ENTRY, 0) - self.long_entries
        return k


KINDS = (SENTENCE, ENTRY, ROW, RULING, NOISE, HEADING, OTHER)


def paragraph_kinds(p: list[str]) -> list[str]:
    """Kinds of the lines of one paragraph."""
    words = [line_words(x) for x in p]
    kinds = [line_kind(x, ws) for x, ws in zip(p, words)]
    whole = Paragraph()
    for x, k, ws in zip(p, kinds, words):
        whole.add(x, k, len(ws))
    how = whole.verdict()
    if how == "text":
        return [k if k == HEADING else SENTENCE for k in kinds]
    if how == "long":
        return [SENTENCE if k == ENTRY and len(x.split()) >= 5 else k for k, x in zip(kinds, p)]
    return kinds
