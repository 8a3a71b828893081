"""Operator 8: document fingerprints by consistent weighted sampling.

A document is its words weighted by their counts.  For each of K samples and
each word, gamma variates r, c and a uniform b are drawn from a hash of (word,
sample); the word with the smallest ln c - r (t - b + 1) wins, t being ln(weight)
quantised in steps of r from b.  Two documents win with the same (word, t) with a
probability equal to their generalised Jaccard similarity.  The fingerprint
holds 16 bits for each sample.

Scale: a sample's value depends on (word, count) alone, so each batch computes it
once for each distinct pair and takes minima over documents; no vocabulary is
kept.  Neighbours by doc_id come from a range partition of the ids; only the
first text of each partition crosses its border.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _spark as S
from ._text import Words, mix64, seeds

SAMPLES = 128
#: Ids for each range that its bounds are found from, at most 4 million in all (20,000 partitions).
CUT_FROM = 200
_CHUNK = 2 << 20
_LOW = -(1 << 63)


def _uniform(h: np.ndarray, shift: int, bits: int = 23) -> np.ndarray:
    """In (0, 1), from some bits of h."""
    return (((h >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-bits)


def _values(word: np.ndarray, log_weight: np.ndarray, salt: int) -> np.ndarray:
    """One sample's value for each (word, weight): its order in the top 32 bits, what was sampled in the rest."""
    h = mix64(word ^ np.uint64(salt))
    g = mix64(h + np.uint64(0x9E3779B97F4A7C15))
    r = -np.log(_uniform(h, 0) * _uniform(h, 23))
    c = -np.log(_uniform(g, 0) * _uniform(g, 23))
    b = _uniform(h, 46, 18)
    t = np.floor(log_weight / r + b)
    bits = (np.log(c) - r * (t - b + np.float32(1))).view(np.uint32)
    order = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
    what = mix64(g + t.astype(np.int64).view(np.uint64)) & np.uint64(0xFFFFFFFF)
    return (order << np.uint64(32)) | what


def signatures(texts: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """uint16 (text, sample); all zero for a text without words."""
    w = Words(texts)
    out = np.zeros((len(w.count), samples), np.uint16)
    if not len(w):
        return out
    vocabulary, word = np.unique(w.hashes(), return_inverse=True)
    pair, n = np.unique(w.doc * len(vocabulary) + word, return_counts=True)
    doc, word = np.divmod(pair, len(vocabulary))
    most = int(n.max()) + 1
    kinds, kind = np.unique(word * most + n, return_inverse=True)
    hashes, log_weight = vocabulary[kinds // most], np.log(kinds % most).astype(np.float32)
    kind = kind.astype(np.int32)
    full, first = np.unique(doc, return_index=True)
    for s, salt in enumerate(seeds(samples, 31).tolist()):
        least = np.minimum.reduceat(_values(hashes, log_weight, salt)[kind], first)
        out[full, s] = (least & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], samples: int) -> pa.RecordBatch:
    """One row for each text but the last, which is only the next of its predecessor."""
    edited = [_edited(a, b) for a, b in zip(texts, texts[1:])]
    made = signatures(pa.array([*texts, *edited], pa.string()), samples)
    both, changed = made[: len(texts)], made[len(texts) :]
    big = both.astype(">u2")
    big_changed = changed.astype(">u2")
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([x.tobytes().hex() for x in big[:-1]], pa.string()), pa.array([x.tobytes().hex() for x in big_changed], pa.string()),
            pa.array(likeness(both[:-1], changed)), pa.array(likeness(both[:-1], both[1:])),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _along(samples: int):
    """Rows sorted by part and id; the last of each part is the border row, the first of the next part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, part = 0, None
        for batch in batches:
            for p, i, t in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text"))):
                if p != part:
                    if len(texts) > 1:
                        yield _rows(ids, texts, samples)
                    ids, texts, size, part = [], [], 0, p
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= _CHUNK and len(texts) > 1:
                    yield _rows(ids, texts, samples)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if len(texts) > 1:
            yield _rows(ids, texts, samples)

    return run


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs (doc_id, text).

    Edited: the last quarter of the code points replaced by as many first ones
    of the next document (all of them if it has fewer), ascending doc_id; after
    the last comes the first.  near_edited and near_next: the share of samples
    that agree.  Equal texts have equal fingerprints.

    Null reads as the empty text.  Texts without words have the all-zero
    fingerprint and are alike.  Null ids come first; rows with one doc_id are
    ordered by their texts.  A single row follows itself.  An empty table gives
    an empty result; other columns are not read.
    """
    S.small_batches(docs)
    n = S.partitions(S.slices(docs))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).withColumn("at", F.coalesce("doc_id", F.lit(_LOW)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("at", F.coalesce("doc_id", F.lit(_LOW)))
    # bounds of even ranges, as a range partitioner finds them: from about CUT_FROM ids for each
    seen = np.sort(ids.select("at").sample(min(1.0, CUT_FROM * n / max(1, ids.count())), seed=1).toArrow()["at"].to_numpy())
    cuts = seen[np.arange(1, n) * len(seen) // n] if len(seen) else []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def part_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, at.to_numpy(), "right").astype(np.int32))

    # one row for each part: where the next one begins; after the last part comes the first
    firsts = ids.withColumn("part", part_of("at")).groupBy("part").agg(F.min("at").alias("first"))
    order = W.orderBy("part")
    follow = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("follow"))
    borders = texts.join(F.broadcast(follow), F.col("at") == F.col("follow")).groupBy("part").agg(F.min("text").alias("text"))
    rows = texts.withColumn("part", part_of("at")).select("part", F.lit(0).alias("border"), "at", "doc_id", "text")
    rows = rows.unionByName(borders.select("part", F.lit(1).alias("border"), F.lit(_LOW).alias("at"), F.lit(None).cast("long").alias("doc_id"), "text"))
    return rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "border", "at", "text").select("part", "doc_id", "text").mapInArrow(S.tidy(_along(samples)), _OUT)
