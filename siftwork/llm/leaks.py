"""Passages of held-out test items inside a corpus.

A leak is a run of at least `RUN` words of an item. Search: size-partitioned MinHash containment. The queries are the
passages, the windows of RUN words of every item, as sets of five-word shingles; the domains are the windows of the
documents. Domains are partitioned by size: texts are cut into windows of RUN words, so there is one partition, whose
upper bound equals the size of every query. At that bound, containment of a passage in a domain means a Jaccard
similarity of 1, so one band of one row suffices and its recall is 1: a shared passage has the same least shingle hash
on both sides. Partitions of larger domains would need more bands and lose short leaks in long documents.

Signatures of the items are kept in a bitmap of bounded size, the only thing sent to all executors. Windows whose
signature isn't in it are dropped where they are read; what is left is joined with the items' passages on the passage
itself, word by word, so the result is exact whatever the bitmap lets through.

Defined cases: null and empty texts and items of fewer than RUN words have no passage; a repeat of a document row counts
once, an equal text under another doc_id is a case of its own; the same passage in two items gives a row for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.words import shingle_hashes, word_hashes, words

RUN, SHINGLE = 12, 5
#: Bits of the bitmap per signature of the items, and its largest size in bits: 8 MB.
BITS_EACH, MOST_BITS = 64, 1 << 26
#: Parts into which the passages found in many documents are spread.
SALT = 16


def signatures(h: np.ndarray, run: int = RUN, shingle: int = SHINGLE) -> np.ndarray:
    """MinHash of each window of ``run`` words: the least hash of the shingles inside it."""
    s = shingle_hashes(h, shingle)
    width = run - shingle + 1
    if len(s) < width:
        return np.empty(0, dtype=np.uint64)
    out, done = s, 1
    while done < width:  # minima over 2, 4, 8, ... shingles
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def passages(items: DataFrame, run: int, shingle: int) -> DataFrame:
    """item_id, sig, passage of each window of each item."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["item_id"].tolist(), b["text"].tolist()):
                ws = words(t)
                for k, sig in enumerate(signatures(word_hashes(ws), run, shingle).astype("int64").tolist()):
                    rows.append((i, sig, " ".join(ws[k : k + run])))
            yield pd.DataFrame(rows, columns=["item_id", "sig", "passage"])

    return items.select("item_id", "text").mapInPandas(cut, "item_id bigint, sig bigint, passage string").dropDuplicates(["item_id", "passage"])


def bitmap(own: DataFrame) -> np.ndarray:
    """Bitmap of the signatures, of a power of two of bits up to MOST_BITS. What comes to the driver is one number per 64
    bits at most, however many passages there are."""
    count = own.select("sig").distinct().count()
    bits = 1 << max(12, min(MOST_BITS.bit_length() - 1, (BITS_EACH * max(1, count) - 1).bit_length()))
    slot = F.col("sig").bitwiseAND(bits - 1)
    cells = own.select(F.shiftright(slot, 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(63).cast("int")).alias("bit"))
    out = np.zeros(bits >> 6, dtype=np.int64)
    for r in cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r.cell] = r.bits
    return out.view(np.uint64)


def candidates(documents: DataFrame, bits: np.ndarray, run: int, shingle: int) -> DataFrame:
    """doc_id and passage of each window whose signature an item has."""
    known = documents.sparkSession.sparkContext.broadcast(bits)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = known.value
        mask = np.uint64(len(table) * 64 - 1)
        for b in batches:
            docs, found = [], []
            for d, t in zip(b["doc_id"].tolist(), b["text"].tolist()):
                ws = words(t)
                if len(ws) < run:
                    continue
                slot = signatures(word_hashes(ws), run, shingle) & mask
                hit = (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
                got = {" ".join(ws[k : k + run]) for k in np.flatnonzero(hit).tolist()}
                docs += [d] * len(got)
                found += got
            yield pd.DataFrame({"doc_id": pd.Series(docs, dtype="int64"), "passage": pd.Series(found, dtype="object")})

    return documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(search, "doc_id bigint, passage string")


def found(documents: DataFrame, items: DataFrame, run: int = RUN, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, item_id of each document with a passage of an item.

    A passage that many documents hold is spread over SALT parts on both sides; there are few rows on the items' side.
    """
    own = passages(items, run, shingle)
    spread = own.select("item_id", "passage", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    hits = candidates(documents, bitmap(own), run, shingle).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    return hits.join(spread, ["passage", "salt"]).select("doc_id", "item_id").dropDuplicates()
