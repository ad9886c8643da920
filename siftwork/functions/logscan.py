"""A deterministic automaton for the headers of log lines.

The time layouts below are compiled into one transition table over characters (`automaton`): from the first character of
a line it either reaches an accepting state, which names the layout and where the stamp ends, or it stops. From there a
grammar of delimiter states, one per family of layouts, assigns level, component and message. Structured lines (JSON
objects, key=value) are read by a machine with the states key, value, quoted and escape.

Nothing here looks back at earlier lines: whether a line starts an entry depends on the line alone, so lines can be
parsed in any order and on any executor. Attaching continuation lines is `siftwork.operators.loglines`.
"""

from __future__ import annotations

import string
from functools import lru_cache

# Spellings of levels.
LEVELS = {
    "TRACE": "TRACE", "TRC": "TRACE", "VERBOSE": "TRACE", "T": "TRACE", "V": "TRACE", "DEBUG": "DEBUG", "DBG": "DEBUG", "D": "DEBUG",
    "INFO": "INFO", "INF": "INFO", "NOTICE": "INFO", "INFORMATION": "INFO", "I": "INFO", "WARN": "WARN", "WARNING": "WARN", "WRN": "WARN",
    "W": "WARN", "ERROR": "ERROR", "ERR": "ERROR", "SEVERE": "ERROR", "E": "ERROR", "FATAL": "FATAL", "CRITICAL": "FATAL", "CRIT": "FATAL",
    "EMERG": "FATAL", "ALERT": "FATAL", "PANIC": "FATAL", "F": "FATAL", "C": "FATAL",
}
# Names of the fields of structured lines.
KEYS = {
    "time": ("time", "timestamp", "@timestamp", "ts", "t", "date", "datetime", "asctime"),
    "level": ("level", "lvl", "severity", "log.level", "loglevel", "levelname"),
    "component": ("component", "logger", "mod", "module", "target", "name", "source"),
    "message": ("message", "msg", "event", "text"),
}
FIELD = {k: f for f, ks in KEYS.items() for k in ks}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}

# Layouts of stamps: # digit, ~ one or more digits, @ letter; everything else stands for itself.
_FRAC = ("", ".~", ",~")
_ZONE = ("", "Z", "z", "+##:##", "-##:##", "+####", "-####", " +####", " -####", " Z", " UTC")


def _layouts():
    for sep in "T ":
        for f in _FRAC:
            for z in _ZONE:
                yield "date", f"####-##-##{sep}##:##:##{f}{z}"
    for f in _FRAC:
        yield "slash", f"####/##/## ##:##:##{f}"
    for z in ("", " +####", " -####"):
        yield "web", f"##/@@@/####:##:##:##{z}"
    for d in (" #", "##", "#"):
        yield "syslog", f"@@@ {d} ##:##:##"
    yield "glog", "@#### ##:##:##.~"
    yield "epoch", "#" * 10
    yield "epoch", "#" * 10 + ".~"
    yield "epoch", "#" * 13
    yield "epoch", "#" * 16


@lru_cache(1)
def automaton() -> tuple[list[dict[str, int]], dict[int, str]]:
    """Transition table (a dict of characters per state, state 0 first) and accepting states with their layout.

    Layouts share prefixes, so the table is a trie whose ~ states loop; digits and letters are expanded to single
    characters, which makes it deterministic. A layout whose letter class would meet a literal of another one keeps both
    targets merged by the order of insertion: literals are added to the class's target state first.
    """
    table: list[dict[str, int]] = [{}]
    accept: dict[int, str] = {}
    memo: dict[tuple[int, str], int] = {}
    classes = {"#": string.digits, "~": string.digits, "@": string.ascii_letters}
    for name, layout in _layouts():
        at = 0
        for c in layout:
            key = (at, c)
            if key not in memo:
                table.append({})
                memo[key] = new = len(table) - 1
                for x in classes.get(c, c):
                    table[at].setdefault(x, new)
                if c == "~":
                    for x in string.digits:
                        table[new][x] = new
            at = memo[key]
        accept.setdefault(at, name)
    return table, accept


def _days(y: int, m: int, d: int) -> int | None:
    """Days since 1970-01-01, or None where there is no such date."""
    if not (1 <= m <= 12 and 1 <= y <= 9999 and d >= 1):
        return None
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    if d > (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]:
        return None
    z = y - (m <= 2)
    era, yoe = z // 400, z % 400
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + (153 * ((m + 9) % 12) + 2) // 5 + d - 1 - 719468


_day_memo: dict[str, int | None] = {}


def _day(text: str, y: int, m: int, d: int) -> int | None:
    v = _day_memo.get(text, -1)
    if v == -1:
        if len(_day_memo) > 50_000:
            _day_memo.clear()
        v = _day_memo[text] = _days(y, m, d)
    return v


def _clock(s: str, p: int) -> int | None:
    h, m, x = int(s[p : p + 2]), int(s[p + 3 : p + 5]), int(s[p + 6 : p + 8])
    return ((h * 60 + m) * 60 + x) * 1_000_000 if h < 24 and m < 60 and x < 60 else None


def _tail(s: str, p: int, end: int) -> int:
    """Microseconds of the fraction and the zone in s[p:end], to be added to the wall clock."""
    us = 0
    if p < end and s[p] in ".,":
        q = p + 1
        while q < end and s[q].isdigit():
            q += 1
        us = int(s[p + 1 : min(q, p + 7)].ljust(6, "0"))
        p = q
    z = s[p:end].strip()
    if z and z[0] in "+-":
        n = z[1:].replace(":", "")
        off = (int(n[:2]) * 60 + int(n[2:4])) * 60_000_000
        us += -off if z[0] == "+" else off
    return us


def stamp(s: str, start: int) -> tuple[str, int, int | None, int | None] | None:
    """Layout, end, microseconds since 1970 UTC, and month * 100 + day where the year is missing (the microseconds are
    then those of the day), of the longest stamp at s[start:]; None where there is none or it is impossible."""
    table, accept = automaton()
    at, p, n, last, name = 0, start, len(s), -1, ""
    while p < n:
        nxt = table[at].get(s[p])
        if nxt is None:
            break
        at = nxt
        p += 1
        if at in accept:
            last, name = p, accept[at]
    if last < 0 or (last < n and s[last].isdigit()):
        return None
    if name in ("date", "slash"):
        day, clock = _day(s[start : start + 10], int(s[start : start + 4]), int(s[start + 5 : start + 7]), int(s[start + 8 : start + 10])), _clock(s, start + 11)
        return None if day is None or clock is None else (name, last, day * 86_400_000_000 + clock + _tail(s, start + 19, last), None)
    if name == "web":
        m = MONTHS.get(s[start + 3 : start + 6].lower())
        day, clock = _day(s[start : start + 11], int(s[start + 7 : start + 11]), m or 0, int(s[start : start + 2])), _clock(s, start + 12)
        return None if day is None or clock is None else (name, last, day * 86_400_000_000 + clock + _tail(s, start + 20, last), None)
    if name == "syslog":
        m, d, clock = MONTHS.get(s[start : start + 3].lower()), int(s[start + 4 : last - 9]), _clock(s, last - 8)
        return None if m is None or clock is None or _days(2000, m, d) is None else (name, last, clock, m * 100 + d)
    if name == "glog":
        m, d, clock = int(s[start + 1 : start + 3]), int(s[start + 3 : start + 5]), _clock(s, start + 6)
        return None if clock is None or _days(2000, m, d) is None or s[start] not in "TDIWEFVC" else (name, last, clock + _tail(s, start + 14, last), m * 100 + d)
    digits = s[start:last].partition(".")
    whole = len(digits[0])
    us = int(digits[0]) * (1_000_000 if whole == 10 else 1000 if whole == 13 else 1) + (int(digits[2][:6].ljust(6, "0")) if digits[2] else 0)
    return name, last, us, None


def _plain(s: str) -> str:
    """s without terminal colour sequences."""
    while (p := s.find("\x1b[")) >= 0:
        q = p + 2
        while q < len(s) and not s[q].isalpha():
            q += 1
        s = s[:p] + s[q + 1 :]
    return s


def level_of(word: str) -> str | None:
    return LEVELS.get(_plain(word).strip().upper())


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _quoted(s: str, p: int) -> tuple[str, int] | None:
    """Text of the quoted string whose opening quote is at p, and the place after its closing quote."""
    out, q = [], p + 1
    while True:
        close, esc = s.find('"', q), s.find("\\", q)
        if close < 0:
            return None
        if esc < 0 or close < esc:
            out.append(s[q:close])
            return "".join(out), close + 1
        out.append(s[q:esc])
        c = s[esc + 1 : esc + 2]
        if c == "u":
            try:
                unit = int(s[esc + 2 : esc + 6], 16)
            except ValueError:
                return None
            q = esc + 6
            if 0xD800 <= unit < 0xDC00 and s[q : q + 2] == "\\u":
                try:
                    low = int(s[q + 2 : q + 6], 16)
                except ValueError:
                    return None
                if 0xDC00 <= low < 0xE000:
                    unit, q = 0x10000 + ((unit - 0xD800) << 10) + (low - 0xDC00), q + 6
            out.append(chr(unit) if not 0xD800 <= unit < 0xE000 else "\ufffd")
        else:
            out.append(_ESCAPES.get(c, c))
            q = esc + 2


def json_fields(s: str) -> dict[str, str] | None:
    """Fields of a one-line JSON object as text; nested values are skipped over. None where it isn't one."""
    p, n, out = 1, len(s), {}
    while True:
        while p < n and s[p] in " \t,":
            p += 1
        if p >= n:
            return None
        if s[p] == "}":
            return out
        if s[p] != '"' or (key := _quoted(s, p)) is None:
            return None
        p = key[1]
        while p < n and s[p] in " \t:":
            p += 1
        if p >= n:
            return None
        if s[p] == '"':
            value = _quoted(s, p)
            if value is None:
                return None
            out.setdefault(key[0], value[0])
            p = value[1]
        else:
            q, depth = p, 0
            while q < n and (depth or s[q] not in ",}"):
                if s[q] == '"':
                    inner = _quoted(s, q)
                    if inner is None:
                        return None
                    q = inner[1]
                    continue
                depth += (s[q] in "{[") - (s[q] in "}]")
                q += 1
            out.setdefault(key[0], s[p:q].strip())
            p = q


def pair_fields(s: str) -> dict[str, str] | None:
    """Fields of a line of key=value pairs, values quoted or bare. None where a token has no =."""
    p, n, out = 0, len(s), {}
    while p < n:
        if s[p] == " ":
            p += 1
            continue
        e = s.find("=", p)
        if e < 0 or " " in s[p:e]:
            return out or None
        if s[e + 1 : e + 2] == '"':
            value = _quoted(s, e + 1)
            if value is None:
                return None
            out.setdefault(s[p:e], value[0])
            p = value[1]
        else:
            q = s.find(" ", e + 1)
            q = n if q < 0 else q
            out.setdefault(s[p:e], s[e + 1 : q])
            p = q
    return out or None


Header = tuple[int | None, int | None, str, str, str]


def _structured(fields: dict[str, str] | None) -> Header | None:
    if not fields:
        return None
    got: dict[str, str] = {}
    for k, v in fields.items():
        f = FIELD.get(k) or FIELD.get(k.lower())
        if f and f not in got:
            got[f] = v
    if "time" not in got or (t := stamp(got["time"].strip(), 0)) is None or t[1] != len(got["time"].strip()):
        return None
    return t[2], t[3], level_of(got.get("level", "")) or "", _plain(got.get("component", "")).strip(), got.get("message", "").strip()


def _split2(s: str, p: int, delimiter: str) -> tuple[str, int] | None:
    q = s.find(delimiter, p)
    return None if q < 0 else (s[p:q], q + len(delimiter))


def _word(s: str, p: int) -> tuple[str, int]:
    """The next word after blanks, and the place after it."""
    n = len(s)
    while p < n and s[p] == " ":
        p += 1
    q = p
    while q < n and s[q] not in " \t":
        q += 1
    return s[p:q], q


def header(s: str) -> Header | None:
    """Microseconds, month-day, level, component and message of a line that starts an entry; None for any other line."""
    if not s:
        return None
    c = s[0]
    if c == "{":
        return _structured(json_fields(s)) if '"' in s else None
    if c == "[":
        t = stamp(s, 1)
        if t is None:
            return None
        name, p, us, md = t
        if s[p : p + 1] == "]":  # [stamp] [component] [LEVEL] message, the fields in either order
            level = component = None
            p += 1
            while s[p : p + 2] == " [" and (level is None or component is None) and (f := _split2(_plain(s[p:]), 2, "]")) is not None:
                s, p = _plain(s[p:]), f[1]
                if level is None and (x := level_of(f[0])) is not None:
                    level = x
                elif component is None:
                    component = f[0].strip()
                else:
                    break
            if level is None and component is None:
                return None
            return us, md, level or "", component or "", s[p:].strip()
        if s[p : p + 1] == " ":  # [stamp LEVEL component] message
            f = _split2(s, p, "]")
            if f is None:
                return None
            words = _plain(f[0]).split()
            level = level_of(words[0]) if words else None
            rest = words[1:] if level is not None else words
            if len(rest) > 1 or not words:
                return None
            return us, md, level or "", rest[0] if rest else "", s[f[1] :].strip()
        return None
    t = stamp(s, 0)
    if t is None:
        return _structured(pair_fields(s)) if "=" in s[:16] and c.isalpha() or c == "@" else None
    name, p, us, md = t
    if s[p : p + 3] == " | ":  # stamp | LEVEL | component | message
        a = _split2(s, p + 3, " | ")
        b = a and _split2(s, a[1], " | ")
        if not b:
            return None
        level = level_of(a[0])
        if level is None and (x := level_of(b[0])) is not None:
            return us, md, x, _plain(a[0]).strip(), s[b[1] :].strip()
        return (us, md, level or "", _plain(b[0]).strip(), s[b[1] :].strip()) if level is not None else None
    if s[p : p + 1] == "\t":  # stamp, component and message between tabs; a level may stand in front of the component
        a = _split2(s, p + 1, "\t")
        if a is None:
            return None
        b = _split2(s, a[1], "\t")
        level = level_of(a[0])
        if level is not None and b is not None:
            return us, md, level, _plain(b[0]).strip(), s[b[1] :].strip()
        return us, md, "", _plain(a[0]).strip(), s[a[1] :].strip()
    if name == "glog":  # I0728 03:34:25.421150  48493 component:281] message
        pid, p = _word(s, p)
        f = _split2(s, p, "]")
        if not pid.isdigit() or f is None:
            return None
        where = f[0].strip()
        base, _, line = where.rpartition(":")
        return us, md, LEVELS[s[0]], base if line.isdigit() and base else where, s[f[1] :].strip()
    if name == "syslog":  # stamp host component[pid]: LEVEL: message
        host, p = _word(s, p)
        tag, p = _word(s, p)
        if not tag.endswith(":"):
            return None
        component = tag[:-1]
        if component.endswith("]") and (q := component.rfind("[")) > 0:
            component = component[:q]
        word, q = _word(s, p)
        level = level_of(word[:-1]) if word.endswith(":") else None
        return us, md, level or "", component, s[q if level is not None else p :].strip()
    if name == "epoch":  # stamp L/component: message
        word, p = _word(s, p)
        mark, slash, component = word.partition("/")
        if not slash or not component.endswith(":") or (level := level_of(mark)) is None:
            return None
        return us, md, level, component[:-1], s[p:].strip()
    if s[p : p + 1] == " ":  # stamp LEVEL component - message
        word, q = _word(s, p)
        level = level_of(word)
        component, r = _word(s, q) if level is not None else (word, q)
        if s[r : r + 3] == " - ":
            return us, md, level or "", _plain(component), s[r + 3 :].strip()
    return None
