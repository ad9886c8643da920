"""Language of each document and of each stretch of sentences, by error-correcting output codes.

Each language has a codeword, a row of a Hadamard matrix, so that any two differ in at least half of the bits. For every
bit a binary logistic classifier over hashed character n-grams predicts which side a sentence is on. Decoding weighs the
loss of each bit: the language whose codeword costs least wins, and a small lead over the second flags ambiguity.

The classifiers are trained on a bounded sample of labelled rows (`SAMPLE` documents a language, chosen by a hash of their
id). Labels are partly wrong and documents partly mixed, so a sentence is learned from only if no other language has more
common words in it than the one its label names (`agrees`). Classification reads every sentence of every document.

Defined cases: null, empty and blank texts, lists, tables and junk have no segment; nor have sentences of fewer than
`LEAST` letters once identifiers and numbers are taken out, or scraps of fewer than five words without an end, which
belong to the stretch around them; a label is compared
by the language it names, whatever code or name it uses; repeats of a row count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftwork.functions.logscan import header
from siftwork.llm import lines as L
from siftwork.llm.quality import verdict

#: Labelled documents a language that are sampled for training, their longest text, and sentences taken of each.
SAMPLE, SAMPLE_CHARS, SAMPLE_SENTENCES = 160, 20_000, 5
#: Buckets of hashed n-grams, their lengths, and passes over the sample.
BUCKETS, GRAMS, EPOCHS = 1 << 15, (1, 2, 3, 4), 2
#: Letters that a sentence needs to be judged on its own, and to be judged in full; loss that a change of language costs.
LEAST, FULL, SWITCH = 8, 30, 4.0

# Codes and names of the languages.
LANGUAGES = {
    "en": "en eng english anglais englisch",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands",
    "ru": "ru rus russian русский",
    "zh": "zh zho chi chinese 中文 汉语 cmn",
}
NAMES = {n: code for code, names in LANGUAGES.items() for n in names.split()}
CODES = tuple(LANGUAGES)
# Seed text of the language that is written without blanks.
_SEEDS = {**L.COMMON, "zh": "的一是不了在有我们他这中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过后作里"}


def label_code(label: str | None) -> str | None:
    """The language that a label names, None where it names none."""
    if not label:
        return None
    s = label.strip().lower()
    return NAMES.get(s) or NAMES.get(re.split(r"[-_]", s)[0])


def codewords(n: int) -> np.ndarray:
    """n rows of signs, any two of which differ in half of their bits or more."""
    size = 1 << max(2, n.bit_length())
    h = np.ones((1, 1), dtype=np.float32)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[1 : n + 1, 1:]


_STOP = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+(?=[\"'“‘«(\[¿¡]*\S)|(?<=[。！？])[\"'”’»」)\]]*")
_ODD = re.compile(r"[_\d/\\@=<>{}|]")
_LETTERS = re.compile(r"[^\W\d_]+")
_CJK = re.compile(f"[{L.CJK}]")
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_IDENTIFIER = re.compile(r"[A-Za-z0-9]+(?:_[A-Za-z0-9]+)+|[A-Za-z]*\d[A-Za-z0-9.,:%]*")


def sentences(text: str | None) -> tuple[str | None, list[str]]:
    """Verdict on the text, and its sentences in reading order; headings, entries, rows, noise and log lines are left out."""
    if not text or text.isspace():
        return None, []
    counts = dict.fromkeys(("lines", "sentence", "entry", "row", "ruling", "noise", "heading", "other"), 0)
    out: list[str] = []
    for p in L.paragraphs(text.replace("\r\n", "\n").split("\n")):
        kinds = L.paragraph_kinds(p)
        counts["lines"] += len(p)
        for k in kinds:
            counts[k] += 1
        run: list[str] = []
        for x, k in [*zip(p, kinds), ("", "")]:
            if k == L.SENTENCE and not (x[:1].isdigit() or x[:1] in "[{") or k == L.SENTENCE and header(x.strip()) is None:
                run.append(_TAG.sub(" ", L._QUOTE.sub("", x)).strip())
            elif run:
                joined = " ".join(run)
                parts = _STOP.split(joined) if L._STOP.search(joined) else run
                if len(parts) * 40 < len(run):
                    parts = run
                out.extend(s for s in parts if s and not s.isspace())
                run = []
    return verdict(counts), out


def _clean(sentence: str) -> str:
    """Lower-case letters of the sentence, with one space for anything else; identifiers and numbers are taken out."""
    if _ODD.search(sentence):
        if sentence.isascii() or not _CJK.search(sentence):
            sentence = " ".join([w for w in sentence.split() if not _ODD.search(w)])
        else:
            sentence = _IDENTIFIER.sub(" ", sentence)
    return " ".join(_LETTERS.findall(sentence.lower()))


def features(parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-grams: their buckets, those of one cleaned sentence after the other, and where each sentence's
    begin. A sentence has n-grams of every length: it is taken with blanks around it, and filled up with more of them."""
    width = max(GRAMS)
    codes = np.frombuffer("".join([f" {p} ".ljust(width) for p in parts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([max(width, len(p) + 2) for p in parts], dtype=np.int64)
    ends = np.cumsum(sizes)
    out = []
    h = np.zeros(len(codes), dtype=np.uint32)
    for n in GRAMS:
        m = len(codes) - n + 1
        h = h[:m] * np.uint32(0x01000193) + codes[n - 1 : n - 1 + m] + np.uint32(n)
        z = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        z = (z >> np.uint32(16)) & np.uint32(BUCKETS - 1)
        # those that run over the end of a sentence are left out
        inside = np.ones(m, dtype=bool)
        for k in range(1, n):
            over = ends[:-1] - k
            inside[over] = False
        starts = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(sizes - n + 1)[:-1]])
        out.append((z[inside].astype(np.intp), starts))
    return out


class Model:
    """Weights of the bit classifiers, and the codewords of the languages."""

    def __init__(self, languages: tuple[str, ...] = CODES):
        self.languages = languages
        self.code = codewords(len(languages))
        self.weights = np.zeros((BUCKETS, self.code.shape[1]), dtype=np.float32)

    def bits(self, parts: list[str]) -> np.ndarray:
        """Margins of the bits of each cleaned sentence."""
        total, count = np.zeros((len(parts), self.code.shape[1]), dtype=np.float32), np.zeros(len(parts), dtype=np.float32)
        for idx, start in features(parts):
            total += np.add.reduceat(self.weights.take(idx, axis=0), start, axis=0)
            count += np.diff(np.append(start, len(idx)))
        return total / np.sqrt(count)[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss of each language's codeword, weighted by how sure each bit is: the logistic loss of its margin.

        The loss of a bit on the wrong side is that of the right one and the margin more, so losses are a sum over the bits
        and a product with the bits that a codeword has on the other side.
        """
        base = np.logaddexp(0, -margins).sum(axis=1)
        return base[:, None] + margins @ ((1 - self.code) / 2).T

    def fit(self, parts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> None:
        """Logistic regression of every bit by adaptive gradient steps, in an order that only depends on the sample."""
        w = np.zeros_like(self.weights)
        scale = np.full(BUCKETS, 1e-2, dtype=np.float32)
        ready = [np.unique(np.concatenate([i for i, _ in features([p])])) for p in parts]
        rng = np.random.default_rng(7)
        # each language weighs the same, however many sentences the sample has of it
        share = np.bincount(labels, minlength=len(self.languages)).astype(np.float32)
        weight = np.minimum(4.0, share.sum() / np.maximum(share, 1) / max(1, (share > 0).sum()))
        for _ in range(epochs):
            for k in rng.permutation(len(parts)):
                i = ready[k]
                x = np.float32(1 / np.sqrt(len(i)))
                y = self.code[labels[k]]
                m = w[i].sum(axis=0) * x
                g = y / (1 + np.exp(np.clip(y * m, -30, 30))) * x * weight[labels[k]]
                scale[i] += float((g * g).mean())
                w[i] += 0.5 * g[None, :] / np.sqrt(scale[i])[:, None]
        self.weights = w


def train(documents: DataFrame) -> Model:
    """Model fitted to a bounded sample of the labelled rows: at most SAMPLE documents a language come to the driver."""
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    code = F.try_element_at(names, F.regexp_extract(F.lower(F.trim("lang")), r"^([^-_]*)", 1))
    labelled = documents.where("text is not null and doc_id is not null").where(F.length("text").between(40, SAMPLE_CHARS)).select("doc_id", code.alias("code"), "text").where("code is not null")
    order = W.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = labelled.select("doc_id", "code", "text", F.row_number().over(order).alias("k")).where(F.col("k") <= SAMPLE).select("doc_id", "code", "text").collect()
    model = Model()
    parts, labels = [], []
    for r in sorted(rows, key=lambda r: (r.code, r.doc_id)):
        kind, ss = sentences(r.text)
        if kind != "prose":
            continue
        clean = [c for c in map(_clean, ss) if len(c) >= LEAST and agrees(c, r.code)]
        for c in clean[:: max(1, len(clean) // SAMPLE_SENTENCES)][:SAMPLE_SENTENCES]:
            parts.append(c)
            labels.append(CODES.index(r.code))
    for c, seed in _SEEDS.items():
        for k in range(4):
            parts.append(" ".join(seed.split()[k::4]) if " " in seed else seed[k::2])
            labels.append(CODES.index(c))
    model.fit(parts, np.array(labels))
    return model


_COMMON = {c: frozenset(ws.split()) for c, ws in L.COMMON.items()}


def agrees(clean: str, code: str) -> bool:
    """Whether a cleaned sentence may be in the language: by its script, and as no other has more common words in it."""
    letters = clean.replace(" ", "")
    chinese = sum(1 for c in letters if ord(c) > 0x2E80)
    if code == "zh" or chinese * 3 > len(letters):
        return code == "zh" and chinese * 3 > len(letters)
    if (code == "ru") != (sum(1 for c in letters if "\u0400" <= c < "\u0530") * 2 > len(letters)):
        return False
    ws = clean.split()
    score = {c: sum(w in common for w in ws) for c, common in _COMMON.items()}
    return code == "ru" or score[code] > 0 and score[code] == max(score.values()) and sum(v == score[code] for v in score.values()) == 1


def judged(ss: list[str]) -> list[tuple[int, str, int]]:
    """Number, cleaned text and weight of the sentences that are judged on their own. Scraps and those without letters aren't;
    ideographs weigh four letters."""
    out = []
    for k, s in enumerate(ss):
        clean = _clean(s)
        chinese = 0 if clean.isascii() else len(_CJK.findall(clean))
        if (len(clean) >= LEAST or chinese >= 4) and (chinese >= 6 or len(s.split()) >= 5 or L.ends_sentence(s.strip())):
            out.append((k, clean, len(clean) + 3 * chinese))
    return out


def stretches(model: Model, numbers: list[int], loss: np.ndarray) -> list[tuple[str, float, bool, int, int]]:
    """Language, confidence, ambiguity, first and last sentence of each stretch of judged sentences, given their losses.

    The path through the sentences that costs least, where each costs the loss of its language and each change SWITCH.
    """
    n, m = loss.shape
    best = loss.argmin(axis=1)
    if (best == best[0]).all():  # no other path can cost less
        path = [int(best[0])] * n
    else:
        cost, back = loss[0].copy(), np.zeros((n, m), dtype=np.int64)
        every = np.arange(m)
        for k in range(1, n):
            low = int(cost.argmin())
            stay = cost <= cost[low] + SWITCH
            back[k] = np.where(stay, every, low)
            cost = np.where(stay, cost, cost[low] + SWITCH) + loss[k]
        path = [int(cost.argmin())]
        for k in range(n - 1, 0, -1):
            path.append(int(back[k][path[-1]]))
        path.reverse()
    out = []
    a = 0
    for k in range(1, n + 1):
        if k == n or path[k] != path[a]:
            total = loss[a:k].mean(axis=0)
            first, second = np.partition(total, 1)[:2]
            confidence = float(np.exp(first - total[path[a]]) / np.exp(first - total).sum())
            out.append((model.languages[path[a]], confidence, bool(second - first < SWITCH), numbers[a], numbers[k - 1]))
            a = k
    return out


#: Letters of the sentences that are classified at a time.
AT_ONCE = 65_536


def classified(model: Model, documents: list[list[tuple[int, str, int]]]) -> Iterator[list[tuple[str, float, bool, int, int]]]:
    """The stretches of each document, given its judged sentences; the sentences of many documents are classified together.
    Those of fewer than FULL letters weigh less in proportion."""
    at = 0
    while at < len(documents):
        upto, size = at, 0
        while upto < len(documents) and (size < AT_ONCE or upto == at):
            size += sum([len(c) for _, c, _ in documents[upto]])
            upto += 1
        every = [x for d in documents[at:upto] for x in d]
        loss = None
        if every:
            loss = model.losses(model.bits([c for _, c, _ in every]))
            loss *= np.minimum(1.0, np.array([w for _, _, w in every], dtype=np.float32) / FULL)[:, None]
        k = 0
        for d in documents[at:upto]:
            yield stretches(model, [x[0] for x in d], loss[k : k + len(d)]) if d else []
            k += len(d)
        at = upto


SEGMENTS = "doc_id bigint, label string, seg_no int, lang string, confidence double, ambiguous boolean, first_sentence int, last_sentence int, segments int"


def segments(documents: DataFrame, model: Model) -> DataFrame:
    """The stretches of each document with sentences; label is the language that its own label names, or null."""
    known = documents.sparkSession.sparkContext.broadcast((model.weights, model.languages))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(known.value[1])
        m.weights = known.value[0]
        for b in batches:
            kept, sentences_of = [], []
            for d, label, text in zip(b["doc_id"].tolist(), b["lang"].tolist(), b["text"].tolist()):
                kind, ss = sentences(text)
                if kind == "prose" and ss:
                    kept.append((d, label_code(label)))
                    sentences_of.append(judged(ss))
            out = [(*row, k + 1, *s, len(got)) for row, got in zip(kept, classified(m, sentences_of)) for k, s in enumerate(got)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    return documents.where("doc_id is not null and text is not null").select("doc_id", "lang", "text").mapInPandas(run, SEGMENTS)


def found(documents: DataFrame) -> DataFrame:
    """doc_id, seg_no, lang of the segments of documents that are mixed or whose label is missing or wrong."""
    s = segments(documents, train(documents))
    case = (F.col("segments") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return s.where(case).select("doc_id", "seg_no", "lang").dropDuplicates()
