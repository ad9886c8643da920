"""Encoding of texts by a byte-level BPE vocabulary, as a token automaton.

Construction. The automaton starts with one state in which every byte loops. Each merge (a, b) -> ab, in order of rank,
puts in its gadget: the state behind a is copied without its arc b, the arcs a lead to the copy, and every state that had
the path a b gets the arc ab to where b led. All arcs of a token end in the same state, so the automaton needs at most one
state a merge and its table holds, for each token, the state it leads to, and for each state its parent, the arc taken
away and when it was made. Whether a state has an arc follows from the gadgets alone (`Automaton.has_arc`).

The paths of the finished automaton are exactly the token sequences that merging in order of rank produces, so a word, and
each of its prefixes, has one path that spells it. Encoding reads a word byte by byte through a table of transitions: a
configuration holds the places of all tokens that may be under way (a state of the automaton and a node of the vocabulary's
prefix tree); with the next byte it leads to another one, and exactly one token ends there. A transition is worked out when it
is first met and looked up from then on, one step a byte; the arc labels of the path, read back from the end, are the ids.

Words are cut by the pattern of the vocabulary first; a word's path is kept, up to a bound, for its next occurrence.

Defined cases: empty and null texts give an empty list; texts are encoded as they stand, special tokens' strings are
ordinary text; lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: The public pre-splitting pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids, and transitions, that a worker keeps.
KEPT_WORDS, KEPT_STEPS = 200_000, 2_000_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Automaton:
    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = vocabulary
        size = max(vocabulary.values()) + 1
        root = 0
        self.target = [root] * size  # token -> state behind it
        self.made = [-1] * size  # token -> rank of its merge, -1 for bytes
        self.left = [-1] * size
        self.parent, self.cut, self.born = [-1], [-1], [-1]  # by state
        self._arcs: dict[tuple[int, int], bool] = {}
        self._bytes = {i for b, i in vocabulary.items() if len(b) == 1}
        self.size_of = [0] * size
        for b, i in vocabulary.items():
            self.size_of[i] = len(b)
        for rank, (a, b) in enumerate(merges):
            x, y, xy = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if not (self._reaches(x) and self._reaches(y) and self.has_arc(self.target[x], y)):
                continue  # earlier merges leave no such pair
            self.parent.append(self.target[x])
            self.cut.append(y)
            self.born.append(rank)
            if self.made[xy] < 0 and len(a + b) > 1:
                self.made[xy], self.left[xy] = rank, x
            self.target[xy] = self.target[y]  # before the next line: in a run of a's, a third one may follow aa
            self.target[x] = len(self.parent) - 1
        # the prefix tree: node << 8 | byte -> node, and the token that ends at a node
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for word, i in vocabulary.items():
            if not self._reaches(i):
                continue
            node = 0
            for c in word:
                nxt = self.child.get(node << 8 | c)
                if nxt is None:
                    nxt = self.child[node << 8 | c] = len(self.ends)
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = i
        self._restart()

    def _restart(self) -> None:
        self.configurations: list[tuple[tuple[int, int], ...]] = [((0, 0),)]
        self.numbers: dict[tuple[tuple[int, int], ...], int] = {((0, 0),): 0}
        self.steps: dict[int, tuple[int, int]] = {}  # configuration << 8 | byte -> configuration, token that ends there

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the finished automaton has this arc."""
        key = (state, token)
        known = self._arcs.get(key)
        if known is not None:
            return known
        s, t = state, token
        while True:
            if s == 0:
                out = True
                break
            if self.made[t] >= self.born[s]:  # the arc came with a later gadget, where the state had the arc of its left part
                t = self.left[t]
            elif t == self.cut[s]:
                out = False
                break
            else:
                s = self.parent[s]
        if len(self._arcs) > 2_000_000:
            self._arcs.clear()
        self._arcs[key] = out
        return out

    def _step(self, at: int, c: int) -> tuple[int, int]:
        """The transition of a configuration by a byte, worked out and kept."""
        child, ends = self.child, self.ends
        alive, token = [], -1
        for state, node in self.configurations[at]:
            nxt = child.get(node << 8 | c)
            if nxt is None:
                continue
            alive.append((state, nxt))
            t = ends[nxt]
            if token < 0 <= t and self.has_arc(state, t):
                token = t
        if token < 0:
            raise ValueError(f"no token for byte {c}")
        alive.append((self.target[token], 0))
        key = tuple(alive)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.configurations)
            self.configurations.append(key)
        out = self.steps[at << 8 | c] = number, token
        return out

    def encode(self, word: bytes) -> list[int]:
        """Ids of the one path that spells the word."""
        if len(self.steps) > KEPT_STEPS:
            self._restart()
        steps, size_of, at, last = self.steps, self.size_of, 0, []
        for c in word:
            step = steps.get(at << 8 | c) or self._step(at, c)
            at = step[0]
            last.append(step[1])
        out, k = [], len(last)
        while k > 0:
            t = last[k - 1]
            out.append(t)
            k -= size_of[t]
        return out[::-1]

    def _reaches(self, token: int) -> bool:
        return self.made[token] >= 0 or token in self._bytes


def read_vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Ids of the byte strings, and the merges in order, of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = _byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocabulary = {raw(k): v for k, v in model["vocab"].items() if all(c in letters for c in k) and not k.startswith("<|")}
    return vocabulary, [(raw(a), raw(b)) for a, b in merges]


@lru_cache(2)
def load(path: str) -> Automaton:
    return Automaton(*read_vocabulary(path))


class Encoder:
    """Texts to ids; one per worker and vocabulary."""

    def __init__(self, path: str):
        import regex

        self.automaton = load(path)
        self.split = regex.compile(PATTERN).findall
        self.words: dict[str, list[int]] = {}

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        words, out = self.words, []
        for w in self.split(text):
            ids = words.get(w)
            if ids is None:
                ids = self.automaton.encode(w.encode("utf-8", "surrogatepass"))
                if len(words) >= KEPT_WORDS:
                    words.clear()
                if len(w) <= 64:
                    words[w] = ids
            out.extend(ids)
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """key and ids (array<int>) of each row. A map over the rows: nothing is shuffled. The vocabulary is read from
    ``tokenizers`` where the query is made, and handed to the executors as a file."""
    vocabulary = shipped(df, tokenizers, name)
    ddl = f"`{key}` {dict(df.dtypes)[key]}, ids array<int>"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(SparkFiles.get(vocabulary))
        for b in batches:
            ids = pa.array([enc(t) for t in b.column(1).to_pylist()], type=schema.field(1).type)
            yield pa.RecordBatch.from_arrays([b.column(0), ids], schema=schema)

    return df.select(key, text).mapInArrow(run, ddl)


def shipped(df: DataFrame, tokenizers: str, name: str) -> str:
    """Name under which all executors find a vocabulary file."""
    df.sparkSession.sparkContext.addFile(os.path.join(tokenizers, f"{name}.json"))
    return f"{name}.json"


def decode(df: DataFrame, key: str, ids: str = "ids", tokenizers: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """key and text of each list of ids: the byte labels of the arcs, joined. Null ids give null, unknown ids an error."""
    vocabulary = shipped(df, tokenizers, name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label = {i: b for b, i in load(SparkFiles.get(vocabulary)).ids.items()}
        for b in batches:
            texts = [None if v is None else b"".join(label[i] for i in v).decode("utf-8", "replace") for v in b[ids].tolist()]
            yield pd.DataFrame({key: b[key], "text": pd.Series(texts, dtype="object")})

    kind = dict(df.dtypes)[key]
    return df.select(key, ids).mapInPandas(run, f"`{key}` {kind}, text string")


def document_ids(documents: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc_id and ids of each document. Repeats of a row are folded before anything is encoded; that shuffle also deals the
    texts out evenly. Two texts under one id are two documents."""
    own = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    return encode(own, "doc_id", "text", tokenizers)
