"""Items over a size limit into pieces under it, cut at natural boundaries, with an overlap.

Agglomerative merging: a body starts as atomic segments, every pair of neighbours waits in a heap by the strength of the
boundary between them, and the weakest boundaries are merged first while the joint size plus the overlap fits the limit.
Boundaries are, from strong to weak: paragraph, line, sentence, clause, word; inside a stretch without any of them that
alone exceeds the limit, characters (a forced cut). Sizes are UTF-8 bytes, and no character is ever cut apart.

Atoms are the largest segments that fit a piece beside its overlap. That gives the pieces that merging from all boundaries
gives (tested): boundaries inside such a segment are weaker than those around it, so they come first, and every union of its
parts fits. So the heap of a body stays proportional to its number of pieces.

Defined cases: a null or empty body, and one at most as large as its limit, is one piece; so is a body whose file type has
no limit. Recorded byte counts aren't used. Repeats of an item's row count once. A limit under 4 bytes, or an overlap that
leaves less than half of the limit, is an error of the parameters and reported as such.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, FORCED = 5, 4, 3, 2, 1, 0
_ENDS = {
    PARAGRAPH: re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*"),
    LINE: re.compile(r"\r\n|\r|\n"),
    SENTENCE: re.compile(r"[.!?…][\"'”’»)\]]*[ \t]+|。[\"'”’»」)\]]*"),
    CLAUSE: re.compile(r"[,;:)\]}>][ \t]+"),
    WORD: re.compile(r"[ \t]+"),
}
#: What may be cut at: these characters end a stretch that can't be broken.
_BREAKABLE = re.compile(r"[ \t\r\n。]")


def byte_offsets(text: str) -> np.ndarray:
    """UTF-8 bytes before each character, and the size of the text at the end."""
    if text.isascii():
        return np.arange(len(text) + 1, dtype=np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
    return np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(size)])


def atoms(text: str, at: np.ndarray, limit: int, overlap: int, all_boundaries: bool = False) -> tuple[list[int], list[int]]:
    """Starts of the atomic segments, and the strength of the boundary in front of each. all_boundaries: down to words
    everywhere, also where a larger segment fits."""
    room = limit - overlap
    found: list[tuple[int, int]] = []
    todo = [(0, len(text), PARAGRAPH, PARAGRAPH)]  # begin, end, boundary in front, next level
    while todo:
        a, b, front, level = todo.pop()
        size = at[b] - at[a]
        if size <= room and not all_boundaries or level == FORCED and size <= limit:
            found.append((a, front))
            continue
        if level == FORCED:
            found.extend(_forced(text, at, a, b, front, room))
            continue
        cuts = [m.end() for m in _ENDS[level].finditer(text, a, b) if a < m.end() < b]
        edges = [a, *cuts, b]
        for k in range(len(edges) - 2, -1, -1):
            todo.append((edges[k], edges[k + 1], front if k == 0 else level, level - 1))
    found.sort()
    return [x for x, _ in found], [s for _, s in found]


def _forced(text: str, at: np.ndarray, a: int, b: int, front: int, room: int) -> list[tuple[int, int]]:
    """Cuts inside a stretch without a boundary: as far apart as fits, behind a mark or digit group where one is near."""
    out = [(a, front)]
    while at[b] - at[a] > room:
        cut = max(int(np.searchsorted(at, at[a] + room, side="right")) - 1, a + 1)
        near = next((k for k in range(cut, max(a, cut - 48), -1) if not text[k - 1].isalnum()), cut)
        out.append((near, FORCED))
        a = near
    return out


def merged(starts: list[int], strengths: list[int], at: np.ndarray, end: int, limit: int, overlap: int) -> list[int]:
    """Starts of the pieces: atoms merged over their weakest boundaries while the joint size plus the overlap fits."""
    n = len(starts)
    left, right = [k - 1 for k in range(n)], [k + 1 for k in range(n)]
    stop = [*starts[1:], end]  # end of the segment that starts at atom k
    alive = [True] * n
    size = lambda k: int(at[stop[k]] - at[starts[k]])
    heap = [(strengths[k], size(k - 1) + size(k), k, stop[k]) for k in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, joint, k, upto = heapq.heappop(heap)
        if not alive[k] or stop[k] != upto:
            continue
        j = left[k]
        now = size(j) + size(k)
        if now != joint:  # the left one has grown since: back with its present size
            heapq.heappush(heap, (strengths[k], now, k, upto))
            continue
        if now + (overlap if j > 0 else 0) > limit:
            continue
        alive[k] = False
        stop[j], right[j] = stop[k], right[k]
        if right[k] < n:
            r = right[k]
            left[r] = j
            heapq.heappush(heap, (strengths[r], size(j) + size(r), r, stop[r]))
        if j > 0:
            heapq.heappush(heap, (strengths[j], size(left[j]) + size(j), j, stop[j]))
    return [starts[k] for k in range(n) if alive[k]]


def _overlapped(text: str, at: np.ndarray, start: int, before: int, end: int, limit: int, overlap: int) -> int:
    """Where a piece begins when it takes about ``overlap`` bytes from the one before, whose own part begins at before."""
    take = min(overlap, limit - int(at[end] - at[start]))
    if take <= 0:
        return start
    low = max(before, int(np.searchsorted(at, at[start] - take, side="left")))
    if low <= before or _BREAKABLE.match(text[low - 1]):
        return low
    m = _BREAKABLE.search(text, low, start)
    near = m.end() if m else low
    return near if at[start] - at[near] >= take // 2 else low


def split(text: str | None, limit: int | None, overlap: int) -> list[tuple[int, int, int, bool]]:
    """Pieces of a text as (begin, own part's begin, end, forced) in characters; forced: the cut in front is inside a
    stretch without boundary."""
    text = text or ""
    at = byte_offsets(text)
    if limit is None or at[-1] <= limit:
        return [(0, 0, len(text), False)]
    if limit < 4 or overlap < 0 or 2 * overlap > limit:
        raise ValueError(f"a limit of {limit} bytes doesn't allow an overlap of {overlap}")
    starts, strengths = atoms(text, at, limit, overlap)
    forced = {s for s, x in zip(starts, strengths) if x == FORCED}
    own = merged(starts, strengths, at, len(text), limit, overlap)
    out = []
    for k, s in enumerate(own):
        end = own[k + 1] if k + 1 < len(own) else len(text)
        out.append((s if k == 0 else _overlapped(text, at, s, own[k - 1], end, limit, overlap), s, end, s in forced))
    return out


def stretches_over(text: str, at: np.ndarray, limit: int) -> bool:
    """Whether a stretch of more bytes than the limit has nothing to be cut at."""
    last = 0
    for m in _BREAKABLE.finditer(text):
        if at[m.start()] - at[last] > limit:
            return True
        last = m.end()
    return bool(at[-1] - at[last] > limit)


PIECES = "item_id bigint, piece_no int, byte_begin bigint, own_begin bigint, byte_end bigint, forced boolean, unbreakable boolean, piece string"


def pieces(bodies: DataFrame, limits: DataFrame, keep_text: bool = True) -> DataFrame:
    """Pieces of each item, numbered from 1: their place in bytes, where their own part begins behind the overlap, whether
    the cut in front was forced, whether the item holds a stretch over the limit, and their text.

    limits: file_type, large_file_threshold_bytes, overlap_bytes. It has a row a file type, so the join is a broadcast
    where the planner finds it small enough, and a shuffle of the items where it doesn't.
    """
    own = bodies.where("item_id is not null").select("item_id", "file_type", F.coalesce("body", F.lit("")).alias("body"))
    of = limits.groupBy("file_type").agg(F.min("large_file_threshold_bytes").alias("most"), F.max("overlap_bytes").alias("overlap"))
    rows = own.join(of, "file_type", "left").select("item_id", "body", F.coalesce("most", F.lit(-1)).alias("most"), F.coalesce("overlap", F.lit(0)).alias("overlap"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        for b in batches:
            out = []
            for item, body, most, overlap in zip(b["item_id"].tolist(), b["body"].tolist(), b["most"].tolist(), b["overlap"].tolist()):
                at = byte_offsets(body)
                hard = most >= 0 and at[-1] > most and stretches_over(body, at, most)
                for k, (a, s, e, f) in enumerate(split(body, most if most >= 0 else None, overlap)):
                    out.append((item, k + 1, int(at[a]), int(at[s]), int(at[e]), f, bool(hard), body[a:e] if keep_text else None))
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(cut, PIECES)


def found(bodies: DataFrame, limits: DataFrame) -> DataFrame:
    """item_id, issue: oversized where an item came out as more than one piece, unbreakable where a cut inside a stretch
    without boundary was forced by the limit."""
    p = pieces(bodies, limits, keep_text=False)
    issues = F.array(F.when(F.col("piece_no") == 2, F.lit("oversized")), F.when((F.col("piece_no") == 2) & F.col("unbreakable"), F.lit("unbreakable")))
    return p.where("piece_no = 2").select("item_id", F.explode(issues).alias("issue")).where("issue is not null").dropDuplicates()
