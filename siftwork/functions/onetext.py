"""Mining of one text in one pass: logs by position, JSON by key, prose by frequent n-grams, Markdown by block.

What a template needs is local to its source. A text that a task holds anyway is mined where it is, without any shuffle; the
relational forms of the same rules, for sources spread over many rows, are in `siftwork.operators.mining`. Both give the same
templates (tested).

A template is (pattern, count, examples), examples a dict of lists. Results are sorted by count, most first, then pattern.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache

from siftwork.config import Config

#: White space of any script, as in the Unicode property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
Template = tuple[str, int, dict[str, list[str]]]


@lru_cache(1)
def _patterns():
    import regex

    end = (
        r"(?<=[.!?])(?<![0-9][.!?])(?<!(?:\A|\P{Alphabetic})\p{Alphabetic}[.!?])(?<!\.\.)(?!(?<=\.)\.)"
        r"(?!\))(?!\p{Lowercase})(?:(?=[ \n\t]\p{White_Space}*(?:\p{Uppercase}|\Z))|(?![ \n\t]))"
    )
    return {
        "end": regex.compile(end),
        "token": regex.compile(r"\P{White_Space}+"),
        "alnum": regex.compile(r"[\p{Alphabetic}\p{N}]"),
        "other": regex.compile(r"[^\p{Alphabetic}\p{N}]+"),
        "edges": regex.compile(r"^[^\p{Alphabetic}\p{N}]+|[^\p{Alphabetic}\p{N}]+$"),
        "blank": regex.compile(r"^\p{White_Space}+|\p{White_Space}+$"),
    }


def tokens(s: str) -> list[str]:
    """Words between white space of any script."""
    return s.split() if s.isascii() and not any(c in s for c in "\x1c\x1d\x1e\x1f") else _patterns()["token"].findall(s)


def lines(text: str) -> list[str]:
    """Lines, split at LF with one CR before it taken off; a final LF opens no line."""
    out = text.split("\n")
    if not out[-1]:
        out.pop()
    last = len(out) - 1 if text and not text.endswith("\n") else len(out)
    return [x[:-1] if k < last and x.endswith("\r") else x for k, x in enumerate(out)]


def sentences(text: str) -> list[str]:
    """Sentences of a text, trimmed."""
    p = _patterns()
    joined = " ".join(x for x in (y.strip(WHITE) for y in lines(text)) if p["alnum"].search(x))
    out, a = [], 0
    for m in p["end"].finditer(joined):
        if m.start() > 0:
            out.append(joined[a : m.start()])
            a = m.start()
    out.append(joined[a:])
    return [s for s in (p["blank"].sub("", x) for x in out) if s]


def is_full(sentence: str, words: list[str], c: Config) -> bool:
    long = len(sentence.encode("utf-8", "surrogatepass")) >= c.min_sentence_length or len(words) >= c.min_sentence_words_alt
    return len(words) >= c.min_sentence_words and long and _patterns()["alnum"].search(sentence) is not None


def placeholder(kind: str, i: int) -> str:
    return f"{kind}_{i:02d}"


def ordered(found: list[Template]) -> list[Template]:
    """Most frequent first, then by pattern."""
    return sorted(found, key=lambda t: (-t[1], t[0]))


def mine_log(ls: list[str], c: Config) -> list[Template]:
    """Templates by position: a token that is alone at a place which enough lines reach stays, other places are open."""
    rows = [tokens(x) for x in ls]
    places: dict[int, Counter] = {}
    for row in rows:
        for k, t in enumerate(row):
            places.setdefault(k, Counter())[t] += 1
    least = int(len(rows) * c.static_threshold)
    static = {k: next(iter(n)) for k, n in places.items() if len(n) == 1 and n.total() >= least}
    groups: dict[str, list[list[str]]] = {}
    sizes: Counter = Counter()
    for row in rows:
        pattern = " ".join(static.get(k) or f"[{placeholder('POS', k)}]" for k in range(len(row)))
        sizes[pattern] += 1
        kept = groups.setdefault(pattern, [])
        if len(kept) < c.max_sample_lines:
            kept.append(row)
    out = []
    for pattern, some in groups.items():
        examples = {}
        for k in range(len(some[0])):
            if k not in static:
                examples[placeholder("POS", k)] = list(dict.fromkeys(row[k] for row in some))[: c.max_examples_per_placeholder]
        out.append((pattern, sizes[pattern], examples))
    return ordered(out)


def _no_constant(x):
    raise ValueError(x)


def parsed(text: str):
    """A JSON value; an error for anything else, NaN and infinities too."""
    return json.loads(text, parse_constant=_no_constant)


def json_values(doc: str) -> tuple[list, list[str] | None]:
    """The records of a JSON text, and its header names where its first row has names only: the items of an array, one
    object, or one value a line where the whole doesn't parse. Lines that don't parse are left out; a text that is one scalar
    has no records."""
    try:
        v = parsed(doc)
    except (ValueError, RecursionError):
        out = []
        for x in lines(doc):
            try:
                out.append(parsed(x))
            except (ValueError, RecursionError):
                continue
        return out, None
    if isinstance(v, dict):
        return [v], None
    if not isinstance(v, list):
        return [], None
    if v and isinstance(v[0], list) and all(isinstance(x, str) for x in v[0]):
        return v[1:], v[0]
    return v, None


def fields(record, header: list[str] | None) -> list[tuple[str, object]] | None:
    """Names and values of a record: an object's by name, an array's by place or header; None for a scalar."""
    if isinstance(record, dict):
        return sorted(record.items())
    if isinstance(record, list):
        name = lambda k: placeholder("pos", k) if header is None else header[k] if k < len(header) else placeholder("col", k)
        return [(name(k), x) for k, x in enumerate(record)]
    return None


def _scalar(v) -> str:
    return "null" if v is None else ("true" if v else "false") if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else json.dumps(v)


def value_key(v) -> str:
    """The text by which a value's frequency is counted."""
    if isinstance(v, list):
        kinds = {str: "str", bool: "bool", int: "num", float: "num", list: "arr", dict: "obj", type(None): "null"}
        return f"[{kinds[type(v[0])]}:{len(v)}]" if v else "[]"
    return value_text(v)


def value_text(v) -> str:
    """The text by which a value is shown."""
    if isinstance(v, list):
        return f"[{len(v)} items]" if v else "[]"
    if isinstance(v, dict):
        return f"{{{len(v)} keys}}" if v else "{}"
    return _scalar(v)


def mine_json(records: list, header: list[str] | None, c: Config) -> list[Template]:
    """Templates by key: values that most records share stay, others are open. Examples are given of all keys."""
    named = [fields(r, header) for r in records]
    seen = Counter((k, value_key(v)) for f in named if f for k, v in f)
    least = int(len(records) * c.static_threshold)
    groups: dict[str, list[int]] = {}
    for at, (r, f) in enumerate(zip(records, named)):
        if f is None:
            pattern = "[VALUE]"
        else:
            body = ", ".join(f'"{k}": {value_text(v) if seen[k, value_key(v)] >= least else "[VALUE]"}' for k, v in f)
            pattern = f"{{{body}}}" if isinstance(r, dict) else f"[{body}]"
        groups.setdefault(pattern, []).append(at)
    out = []
    for pattern, places in groups.items():
        examples: dict[str, dict[str, None]] = {}
        for at in places[: c.max_sample_lines]:
            for k, v in named[at] if named[at] is not None else [("", records[at])]:
                kept = examples.setdefault(f"{k}_VALUE" if named[at] is not None else "VALUE", {})
                if len(kept) < c.max_examples_per_placeholder:
                    kept[v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)] = None
        out.append((pattern, len(places), {k: list(v) for k, v in examples.items()}))
    return ordered(out)


def greedy(words: list[str], frequent, low: int, high: int) -> list[tuple[str, bool]]:
    """Parts of a sentence from the left, longest frequent n-gram first: (text, whether it is one), else one word."""
    out, k, n = [], 0, len(words)
    while k < n:
        for size in range(min(high, n - k), low - 1, -1):
            gram = " ".join(words[k : k + size])
            if frequent is None or gram in frequent:
                out.append((gram, True))
                k += size
                break
        else:
            out.append((words[k], False))
            k += 1
    return out


def mine_sentences(full: list[list[str]], c: Config) -> tuple[list[tuple[str, int, dict[str, list[str]], bool]], list[float]]:
    """Templates of full sentences given as words, with whether they are by length only, and the entropies shown.

    Frequent n-grams stay, other words are open; where no such pattern repeats, sentences are grouped by their length.
    """
    n = len(full)
    if n == 0:
        return [], []
    low, high = c.min_ngram_size, c.max_ngram_size
    floor = int(n * c.text_threshold)
    frequent = None  # below a hundred sentences every n-gram reaches the threshold
    if floor > 0:
        counts: Counter = Counter()
        for w in full:
            for size in range(low, min(high, len(w)) + 1):
                counts.update(" ".join(w[k : k + size]) for k in range(len(w) - size + 1))
        frequent = {g for g, m in counts.items() if m >= floor}
    groups: dict[str, list[int]] = {}
    parts = [greedy(w, frequent, low, high) for w in full]
    for at, p in enumerate(parts):
        shown, place = [], 0
        for text, hit in p:
            shown.append(text if hit else f"[{placeholder('WORD', place)}]")
            place += text.count(" ") + 1 if hit else 1
        groups.setdefault(" ".join(shown), []).append(at)
    least, longest = max(floor, 2), 2 * (sum(map(len, full)) // n)
    kept = {p: a for p, a in groups.items() if len(a) >= least and p.count(" ") + 1 <= longest}
    fallback = not kept
    if fallback:
        by_length: dict[str, list[int]] = {}
        for at, w in enumerate(full):
            by_length.setdefault(" ".join(f"[{placeholder('WORD', k)}]" for k in range(len(w))), []).append(at)
        kept = {p: a for p, a in by_length.items() if len(a) >= least and p.count(" ") + 1 <= longest}
    most = max(c.max_examples_per_placeholder // 2, c.min_examples_per_placeholder)
    out, entropies = [], []
    alnum = _patterns()["alnum"]
    for pattern, places in kept.items():
        examples: dict[str, dict[str, None]] = {}
        open_ = all(x.startswith("[") and x.endswith("]") for x in pattern.split(" "))
        for at in places[: min(most, c.max_examples_for_entropy)]:
            if open_:
                words = [(k, w) for k, w in enumerate(full[at]) if alnum.search(w)]
            else:
                words = list(enumerate(w for w, hit in parts[at] if not hit))
            for k, w in words:
                examples.setdefault(placeholder("WORD", k), {})[w] = None
        got = {k: list(v)[:most] for k, v in sorted(examples.items())}
        if len(places) >= c.min_entropy_sample_size and got:
            each = [0.0 if len(v) <= 1 else min(min(len(v), c.max_examples_for_entropy) / c.entropy_small_sample_threshold, 1.0) for v in got.values()]
            entropy = sum(each) / len(each)
            if c.min_entropy_display < entropy < c.max_entropy_display:
                pattern = f"{pattern} [entropy={entropy:.2f}]"
                entropies.append(float(f"{entropy:.2f}"))
        out.append((pattern, len(places), got, fallback))
    return sorted(out, key=lambda t: (-t[1], t[0])), entropies


def normal(token: str) -> str:
    """Letters and digits only, in lower case."""
    return (token if token.isalnum() and token.isascii() else _patterns()["other"].sub("", token)).lower()


def structure(rows: list[list[str]], c: Config) -> dict:
    """Share of sentences that have a pivot, mean words before and after the first one, and the most frequent pivots."""
    words = [[normal(t) for t in row] for row in rows]
    count: Counter = Counter()
    after: dict[tuple[int, str], set[str]] = {}
    for row in words:
        for k, w in enumerate(row):
            if w:
                count[k, w] += 1
                if k + 1 < len(row) and row[k + 1]:
                    after.setdefault((k, w), set()).add(row[k + 1])
    least = int(max(len(rows) * c.text_threshold, 2.0))
    pivots = {p for p, m in count.items() if m >= least and c.min_pivot_variation <= len(after.get(p, ())) <= c.max_pivot_variation}
    held: Counter = Counter()
    before, behind = [], []
    for row in words:
        at = next((k for k, w in enumerate(row) if (k, w) in pivots), None)
        if at is not None:
            held[row[at]] += 1
            if at > 0:
                before.append(at)
            if len(row) - at - 1 > 0:
                behind.append(len(row) - at - 1)
    mean = lambda v: sum(v) / len(v) if v else 0.0
    return {
        "svo_structure_percent": 100.0 * held.total() / len(rows) if rows else 0.0,
        "avg_subject_length": mean(before),
        "avg_object_length": mean(behind),
        "common_pivots": [w for w, _ in sorted(held.items(), key=lambda x: (-x[1], x[0]))[: c.max_common_pivots]],
    }


def footprint(text: str, kept: list[str], templates: int, entropies: list[float], svo: dict | None) -> dict:
    """Writing footprint of a text whose sentences are given."""
    p = _patterns()
    words = [w for w in (t if t.isalnum() and t.isascii() else p["edges"].sub("", t) for t in tokens(text)) if w]
    n = len(kept)
    share = lambda hits: 100.0 * sum(hits) / n if n else 0.0
    ends = [s.rstrip()[-1:] for s in kept]
    return {
        "vocabulary_richness": len(set(words)) / len(words) if words else 0.0,
        "avg_sentence_length": sum(len(tokens(s)) for s in kept) / n if n else 0.0,
        "punctuation": {
            "period_percent": share(e == "." for e in ends),
            "question_percent": share(e == "?" for e in ends),
            "exclamation_percent": share(e == "!" for e in ends),
            "dialogue_percent": share('"' in s or "'" in s for s in kept),
            "avg_commas_per_sentence": sum(s.count(",") for s in kept) / n if n else 0.0,
        },
        "template_diversity": templates,
        "avg_entropy": sum(entropies) / len(entropies) if entropies else 0.0,
        "svo_analysis": svo,
    }


def mine_text(text: str, c: Config) -> tuple[list[tuple[str, int, dict[str, list[str]], bool]], dict | None]:
    """Templates of a text's sentences and its footprint; none of either without a full sentence."""
    ss = sentences(text)
    rows = [tokens(s) for s in ss]
    full = [k for k, s in enumerate(ss) if is_full(s, rows[k], c)]
    if not full:
        return [], None
    found, entropies = mine_sentences([rows[k] for k in full], c)
    return found, footprint(text, [ss[k] for k in full], len(found), entropies, structure(rows, c))


def block_pattern(kind: str, level: int, text: str, ordered_: bool) -> tuple[str, str, str] | None:
    """Pattern, name of the example and example of a Markdown block; None for the kinds that aren't grouped."""
    if kind == "header":
        return f"[{placeholder('HEADER', level)}]", "header_text", text
    if kind == "item":
        return f"[{placeholder('LIST', len(tokens(text)))}]:type={'ordered' if ordered_ else 'unordered'}", "list_text", text
    if kind == "paragraph":
        quotes = "true" if '"' in text or "'" in text else "false"
        return f"[{placeholder('PARAGRAPH', len(tokens(text)))}]:quotes={quotes}", "paragraph_text", text
    return None


def mine_blocks(text: str, blocks: list[tuple], c: Config) -> tuple[list[Template], dict | None]:
    """Templates of Markdown blocks, and the footprint of the sentences in paragraphs and quotes."""
    if not blocks:
        return [], None
    groups: dict[str, list[tuple[str, str]]] = {}
    ss: list[str] = []
    for kind, level, body, ordered_, _ in blocks:
        if kind in ("paragraph", "quote"):
            ss += sentences(body)
        if got := block_pattern(kind, level, body, ordered_):
            groups.setdefault(got[0], []).append(got[1:])
    out = []
    for pattern, items in groups.items():
        cut = c.markdown_preview_length if items[0][0] == "paragraph_text" else None
        kept = list(dict.fromkeys(x[:cut] for _, x in items[: c.max_sample_lines]))
        out.append((pattern, len(items), {items[0][0]: kept[: c.max_examples_per_placeholder]}))
    return ordered(out), footprint(text, ss, len(out), [], None)


def compressed_tokens(found: list, foot: dict | None, c: Config) -> int:
    """Words of the patterns, examples (five a placeholder at most), footprint and overhead."""
    out = c.json_overhead_tokens + sum(len(tokens(t[0])) + sum(min(len(v), c.max_examples_per_placeholder, 5) for v in t[2].values()) for t in found)
    if foot is not None:
        out += c.footprint_base_overhead_tokens
        if foot["svo_analysis"] is not None:
            out += c.footprint_svo_metrics_tokens + min(len(foot["svo_analysis"]["common_pivots"]), c.max_common_pivots)
    return out


def first_line_is_json(text: str) -> bool:
    try:
        parsed((lines(text) or [""])[0])
    except (ValueError, RecursionError):
        return False
    return True


def mined(kind: str, text: str | None, blocks: list[tuple] | None, c: Config) -> dict:
    """Templates, footprint and compression of a text by the type of its source; text is None for what can't be mined.

    An Unknown source whose first line is JSON is mined as JSON, any other as a log. Sources without anything to mine have no
    templates and no compressed tokens.
    """
    found: list = []
    foot = None
    if text is not None and kind == "Unknown":
        kind = "Json" if first_line_is_json(text) else "Log"
    if text is None:
        pass
    elif kind == "Log":
        found = mine_log(lines(text), c)
    elif kind == "Json":
        found = mine_json(*json_values(text), c)
    elif kind == "Markdown":
        found, foot = mine_blocks(text, blocks or [], c)
    elif kind in ("Text", "Html", "Epub"):
        found, foot = mine_text(text, c)
    original = len(text.encode("utf-8", "surrogatepass")) // 4 if text is not None else 0
    packed = compressed_tokens(found, foot, c) if found or foot is not None else 0
    return {"templates": found, "writing_footprint": foot, "original_tokens": original, "compressed_tokens": packed}
