"""Statistics of each text, and whether it is prose, a list, a table or junk.

A text is cut into chunks anywhere. Each chunk gives partial counts and, as its boundary state, the open lines at both ends and
the counts of the open paragraphs there (`lines.Paragraph`, whose counts add up). States are merged in order, in a tree: two
halves of a line become one line, parts of a paragraph one paragraph, and what is closed is counted. So a text of any length
gives exactly what one pass over it does, wherever it is cut; only lines are ever carried as text. Ratios and the verdict are
derived from the merged counts.

Defined cases: a null, empty or blank text has zero counts, null ratios and no verdict; a line must fit a task, a paragraph
needn't; repeats of a row count once; two texts under one id are two documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siftwork.llm import lines as L

#: Characters of a chunk, and states merged by one task. No string has more than CHUNK * FAN ** LEVELS characters.
CHUNK, FAN, LEVELS = 262_144, 64, 3

COUNTS = ("lines", "sentence", "entry", "row", "ruling", "noise", "heading", "other", "ended_lines", "words", "word_chars", "symbols", "chars", "sentences", "periods", "marks", *(f"common_{c}" for c in L.COMMON))
_LINE_ENDS = frozenset(".!?…。！？:;")
_SYMBOL = re.compile(r"[^\w\s]|_")
#: Letters, digits and white space of ASCII: what is no symbol.
_PLAIN = bytes(b for b in range(128) if chr(b).isalnum() or chr(b).isspace())
_SENTENCE = re.compile(r"[.!?](?=[\"'”’»)\]]*(?:\s|$))|[。！？]")


class _Hashes(dict):
    """63-bit hash of each word, kept for the words seen last."""

    def __missing__(self, w: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1
        return h


_hashes = _Hashes()


@dataclass
class Open:
    """A paragraph that isn't closed: its lines, whether it has words, and whether its last line ends as a sentence does."""

    lines: L.Paragraph = field(default_factory=L.Paragraph)
    size: int = 0
    worded: bool = False
    ended: bool = False

    def then(self, other: Open) -> Open:
        if self.size == 0 or other.size == 0:
            return other if self.size == 0 else self
        return Open(self.lines.joined(other.lines), self.size + other.size, self.worded or other.worded, other.ended)


@dataclass
class State:
    """Lines of a stretch of text. head is the text before its first line break, None where it has none; tail that behind the
    last one. first and last are the open paragraphs next to them; where no blank line lies between, first holds all lines."""

    head: str | None = None
    tail: str = ""
    first: Open = field(default_factory=Open)
    last: Open = field(default_factory=Open)
    broken: bool = False
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTS, 0))
    vocabulary: set[int] = field(default_factory=set)

    def line(self, x: str) -> None:
        """One more whole line."""
        if x.endswith("\r"):
            x = x[:-1]
        if not x or x.isspace():
            if self.broken:
                self._close(self.last)
            self.broken, self.last = True, Open()
            return
        p, c = self.last if self.broken else self.first, self.counts
        ws = L.line_words(x)
        p.lines.add(x, L.line_kind(x, ws), len(ws))
        p.size += 1
        p.worded |= bool(ws)
        p.ended = x.rstrip().rstrip("\"'”’»)]")[-1:] in _LINE_ENDS
        c["lines"] += 1
        c["ended_lines"] += p.ended
        c["words"] += len(ws)
        c["word_chars"] += sum(map(len, ws))
        c["symbols"] += len(x.encode().translate(None, _PLAIN)) if x.isascii() else len(_SYMBOL.findall(x))
        c["chars"] += len("".join(x.split()))
        ends = _SENTENCE.findall(x)
        c["sentences"] += len(ends)
        c["marks"] += len(ends)
        c["periods"] += ends.count(".") + ends.count("。")
        self.hits += filter(None, map(L.LANGUAGES_OF.get, ws))
        self.words.update(ws)

    hits: list[int] = field(default_factory=list)
    words: set[str] = field(default_factory=set)

    def _close(self, p: Open) -> None:
        """A paragraph ends: its lines have their kinds, and words behind its last mark are a sentence of their own."""
        if p.size:
            for k, n in p.lines.totals().items():
                self.counts[k] += n
            self.counts["sentences"] += p.worded and not p.ended

    def settled(self) -> State:
        """Itself, with the common words added up by language."""
        for m, n in Counter(self.hits).items():
            for bit, code in enumerate(L.COMMON):
                if m >> bit & 1:
                    self.counts[f"common_{code}"] += n
        self.hits = []
        return self

    def hashed(self) -> set[int]:
        """The vocabulary as hashes: what states carry from task to task."""
        self.vocabulary.update(map(_hashes.__getitem__, self.words))
        self.words = set()
        return self.vocabulary

    def different(self) -> int:
        """Different words of the text."""
        return len(self.hashed()) if self.vocabulary else len(self.words)


def chunk_state(text: str) -> State:
    """State of one chunk."""
    s = State()
    parts = text.split("\n")
    if len(parts) == 1:
        s.tail = text
        return s
    s.head, s.tail = parts[0], parts[-1]
    for x in parts[1:-1]:
        s.line(x)
    return s.settled()


def merge(a: State, b: State) -> State:
    """State of the text of a followed by that of b."""
    if b.head is None:
        a.tail += b.tail
        return a
    if a.head is None:
        b.head = a.tail + b.head
        return b
    a.line(a.tail + b.head)  # the line that the cut went through
    a.settled()
    for k, v in b.counts.items():
        a.counts[k] += v
    a.vocabulary |= b.vocabulary
    a.words |= b.words
    a.tail = b.tail
    if not a.broken:
        a.first = a.first.then(b.first)
    else:
        a.last = a.last.then(b.first)
    if b.broken:
        if a.broken:
            a._close(a.last)
        a.broken, a.last = True, b.last
    return a


def finished(s: State) -> State:
    """The state of a whole text: what is open at its ends is closed."""
    if s.head is not None:
        whole = State(vocabulary=s.vocabulary, words=s.words)
        whole.line(s.head)
        s = merge_middle(whole, s)
    s.line(s.tail)
    s.settled()
    s._close(s.first)
    if s.broken:
        s._close(s.last)
    s.head, s.tail, s.first, s.last, s.broken = None, "", Open(), Open(), False
    return s


def merge_middle(a: State, b: State) -> State:
    """The lines of a followed by those of b, where a has no open lines; what is before and behind them is b's."""
    a.head, a.tail, b.head, tail = "", "", "", b.tail
    a.settled()
    first = a.first.then(b.first) if not a.broken else a.first
    for k, v in b.counts.items():
        a.counts[k] += v
    if a.broken:
        a.last = a.last.then(b.first)
        if b.broken:
            a._close(a.last)
            a.last = b.last
    else:
        a.first = first
        a.broken, a.last = b.broken, b.last
    a.tail = tail
    return a


def verdict(c: dict[str, int]) -> str | None:
    """prose, list, table or junk; None without any line."""
    n = c["lines"]
    if n == 0:
        return None
    if c["sentence"] == 0 and (c["noise"] * 2 >= n and c["noise"] or c["noise"] and not c["entry"] + c["row"]):
        return "junk"
    if (c["row"] + c["ruling"]) * 2 > n and c["row"]:
        return "table"
    if c["entry"] * 2 > n:
        return "list"
    if c["sentence"] == 0 and c["noise"] > c["entry"] + c["row"]:
        return "junk"
    return "prose"


STATS = "word_count bigint, mean_word_length double, symbol_share double, ended_line_share double, common_share double, vocabulary_richness double, avg_sentence_length double, period_percent double, line_count bigint, kind string"


def derived(s: State) -> tuple:
    """Figures of a finished state, in the order of STATS. common_share is that of the language with most common words;
    period_percent is the share of sentence marks that are periods."""
    c = s.counts
    div = lambda a, b: a / b if b else None
    common = max(c[f"common_{code}"] for code in L.COMMON)
    return (
        c["words"], div(c["word_chars"], c["words"]), div(c["symbols"], c["chars"]), div(c["ended_lines"], c["lines"]), div(common, c["words"]),
        div(s.different(), c["words"]), div(c["words"], c["sentences"]), div(100.0 * c["periods"], c["marks"]), c["lines"], verdict(c),
    )


_STATE = "doc_id bigint, text_key string, part bigint, head string, tail string, first array<bigint>, last array<bigint>, broken boolean, counts array<bigint>, vocabulary array<bigint>"


def _open_packed(p: Open) -> list[int]:
    return [p.size, int(p.worded), int(p.ended), *p.lines.packed()]


def _open_unpacked(v) -> Open:
    v = [int(x) for x in v]
    return Open(L.Paragraph.unpacked(v[3:]), v[0], bool(v[1]), bool(v[2]))


def _packed(doc, key, part, s: State) -> tuple:
    return doc, key, part, s.head, s.tail, _open_packed(s.first), _open_packed(s.last), s.broken, [s.counts[k] for k in COUNTS], sorted(s.hashed())


def _unpacked(r) -> State:
    return State(r.head, r.tail or "", _open_unpacked(r.first), _open_unpacked(r.last), bool(r.broken), dict(zip(COUNTS, map(int, r.counts))), set(np.asarray(r.vocabulary, dtype="int64").tolist()))


def _frame(rows: list[tuple], columns: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])


def _pieces(chunk: int):
    """Cuts texts into numbered chunks, in one pass over each."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, key, text in zip(b["doc_id"].tolist(), b["text_key"].tolist(), b["text"].tolist()):
                for at in range(0, len(text), chunk * FAN):
                    some = [(d, key, k // chunk, text[k : k + chunk]) for k in range(at, min(len(text), at + chunk * FAN), chunk)]
                    yield _frame(some, "doc_id bigint, text_key string, part bigint, text string")

    return cut


def document_stats(documents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id with its figures and verdict; one row per doc_id and text.

    Texts of one chunk are read where they are, without a shuffle. Longer ones are cut, their chunks dealt out, and the states
    merged level by level, FAN at a time.
    """
    own = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = f"doc_id bigint, {STATS}"

    schema = to_arrow_schema(StructType.fromDDL(out))

    def whole(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = [(d, *derived(finished(chunk_state(t)))) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    small = own.where(F.length("text") <= chunk).mapInArrow(whole, out)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _frame([_packed(d, key, p, chunk_state(t)) for d, key, p, t in zip(b["doc_id"].tolist(), b["text_key"].tolist(), b["part"].tolist(), b["text"].tolist())], _STATE)

    def joined(key, rows: pd.DataFrame) -> pd.DataFrame:
        state = None
        for r in rows.sort_values("part").drop_duplicates("part").itertuples():  # a repeated row gives its chunks twice
            state = _unpacked(r) if state is None else merge(state, _unpacked(r))
        return _frame([_packed(key[0], key[1], key[2], state)], _STATE)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _frame([(r.doc_id, *derived(finished(_unpacked(r)))) for r in b.itertuples()], out)

    key = F.concat_ws("-", F.hex(F.xxhash64("text")), F.octet_length("text").cast("string"))
    large = own.where(F.length("text") > chunk).select("doc_id", key.alias("text_key"), "text")
    states = large.mapInPandas(_pieces(chunk), "doc_id bigint, text_key string, part bigint, text string").repartition("doc_id", "text_key", "part").mapInPandas(partial, _STATE)
    for _ in range(LEVELS):
        states = states.groupBy("doc_id", "text_key", F.floor(F.col("part") / FAN).cast("bigint").alias("group")).applyInPandas(joined, _STATE)
    return small.unionByName(states.mapInPandas(told, out)).dropDuplicates()


def found(documents: DataFrame) -> DataFrame:
    """doc_id, kind of the documents that aren't prose."""
    return document_stats(documents).where("kind <> 'prose'").select("doc_id", "kind").dropDuplicates()
