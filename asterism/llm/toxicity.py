"""Operator 10: toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are all whole words and word beginnings (four to seven letters) that
labelled examples show to be far likelier in toxic texts, and how many words of a text have such terms, counted in doublings.  Term frequency is
damped, inverse document frequency is counted over all documents.  The labelled
examples' vectors form an inverted index in blocks, each with the largest weight
of each term (block-max): a query visits blocks by their upper bound and stops
where the bound falls below its k-th best cosine, so neighbours are exact.
Every example votes, weighted by closeness, and votes are shrunk towards the rate among examples that,
like most documents, have none of the terms.

The cosine covers marker terms only, not all words: the README has the figures of the whole
vocabulary, which misses two to three times as many toxic texts and takes about twenty times as long.

Scale: the model (terms, example vectors) comes from at most ``MAX_EXAMPLES``
labelled ids, one text for each, and so has a fixed bound; everything else is one pass over the
texts without a shuffle, and a second one over the few terms found.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark as S
from .neardup import shingles
from ._text import Words

MAX_EXAMPLES = 16_000
FOLDS = 5
NEIGHBOURS, BLOCK, PRIOR_WEIGHT, EVIDENCE = 15, 32, 0.25, 3
#: A text with n words that hold terms has one further term, for 1, 2 to 3, 4 to 7 such words, and so on, and its weight.
DOUBLINGS, WORDS_WEIGHT = 40, 2.0
LEAST_DOCS, LEAST_LIFT, LEAST_Z = 4, 4.0, 4.0
BEGINNINGS = (4, 5, 6, 7)
_CHUNK = 2 << 20
#: ASCII control characters, punctuation and digits become spaces.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def plain(text: str | None) -> str:
    """Lower-cased words between single separators, with a space at both ends."""
    return f" {(text or '').lower().encode().translate(_PLAIN).decode()} "


def terms_of(text: str | None) -> set[str]:
    out: set[str] = set()
    for word in set(plain(text).split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in BEGINNINGS if len(word) >= n)
    return out


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a row is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Model:
    """Terms with their weights, and a block-max inverted index of the distinct example vectors."""

    def __init__(self, terms: list[str], idf: np.ndarray, examples: list[tuple[int, int, dict[int, int]]], block: int = BLOCK):
        self.terms, self.idf = terms, idf
        none = [y for _, y, v in examples if not v]
        self.prior = (sum(none) + 0.5) / (len(none) + 2)
        groups: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for doc, y, v in examples:
            if v:
                groups[tuple(sorted(v.items()))].append((doc, y))
        keys = sorted(groups)
        self.count = np.array([len(groups[k]) for k in keys], float)
        self.toxic = np.array([sum(y for _, y in groups[k]) for k in keys], float)
        self.docs = [sorted(d for d, _ in groups[k])[0] for k in keys]
        self.block = block
        blocks = -(-len(keys) // block)
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for e, k in enumerate(keys):
            for t, w in zip([t for t, _ in k], self.unit(dict(k))[1].tolist()):
                postings[t].append((e, w))
        self.lists = {t: (np.array([e for e, _ in p]), np.array([w for _, w in p])) for t, p in postings.items()}
        self.top = {}
        self.cut = {}
        for t, (e, w) in self.lists.items():
            top = np.zeros(blocks)
            np.maximum.at(top, e // block, w)
            self.top[t] = top
            self.cut[t] = np.searchsorted(e // block, np.arange(blocks + 1))
        self.blocks = blocks

    def unit(self, v: dict[int, int]) -> tuple[list[int], np.ndarray]:
        t = sorted(v)
        w = np.array([(1 + log(v[i])) * self.idf[i] for i in t])
        return t, w / np.linalg.norm(w)

    def nearest(self, v: dict[int, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k distinct example vectors of largest cosine (ties: the first), and these cosines; only those above 0."""
        terms, q = self.unit(v)
        known = [(t, x) for t, x in zip(terms, q.tolist()) if t in self.lists]
        best = np.zeros(0)
        ids = np.zeros(0, np.int64)
        if not known or not self.blocks:
            return ids, best
        bound = sum(x * self.top[t] for t, x in known)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best) == k and bound[b] < best[-1] - 1e-12):
                break
            score = np.zeros(min(self.block, len(self.count) - b * self.block))
            for t, x in known:
                lo, hi = self.cut[t][b], self.cut[t][b + 1]
                e, w = self.lists[t]
                score[e[lo:hi] - b * self.block] += x * w[lo:hi]
            found = np.flatnonzero(score > 0)
            best, ids = np.concatenate([best, score[found]]), np.concatenate([ids, found + b * self.block])
            order = np.lexsort((ids, -np.round(best, 12)))[:k]
            best, ids = best[order], ids[order]
        return ids, best

    def score(self, v: dict[int, int], k: int = NEIGHBOURS) -> tuple[float, list[int]]:
        """(score, example doc_ids)."""
        if not v:
            return self.prior, []
        ids, cosine = self.nearest(v, k)
        vote = cosine**2 * self.count[ids]
        share = self.toxic[ids] / self.count[ids]
        return float(((vote * share).sum() + PRIOR_WEIGHT * self.prior) / (vote.sum() + PRIOR_WEIGHT)), [self.docs[i] for i in ids[:EVIDENCE].tolist()]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A value that near copies share more often than not: the smallest hash of their 5-word shingles."""
    for table in S.gathered(batches, _CHUNK):
        g, bounds = shingles(Words(table["text"]), 5)
        least = [int(g[a:b].min()) >> 1 if b > a else None for a, b in zip(bounds, bounds[1:])]
        yield pa.Table.from_arrays([table["doc_id"], table["toxic"], table["text"], pa.array(least, pa.int64())], ["doc_id", "toxic", "text", "sketch"]).combine_chunks().to_batches()[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: list[Counter] = [Counter(), Counter()]

    def out() -> pa.RecordBatch:
        terms = list(seen[0].keys() | seen[1].keys())
        made = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], ["term", "toxic", "clean"])
        seen[0].clear(), seen[1].clear()
        return made

    for batch in batches:
        for y, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            seen[y].update(terms_of(text))
        if len(seen[0]) + len(seen[1]) > 400_000:
            yield out()
    yield out()


def _automaton(terms: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        a.add_word(t, (i, len(t)))
    if terms:
        a.make_automaton()
    return a


def _find(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _automaton(terms)
        for batch in batches:
            ids, counts, empty = [], [], []
            for text in batch.column("text").to_pylist():
                got: Counter = Counter()
                if terms and text:
                    words = set()
                    for end, (i, size) in find.iter(plain(text)):
                        got[i] += 1
                        words.add(end - size)
                    if words:
                        got[len(terms) + len(words).bit_length() - 1] = 1
                ids.append(sorted(got))
                counts.append([got[i] for i in ids[-1]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "terms", "counts"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> tuple[Model, DataFrame]:
    """The model, and (doc_id, terms, counts) of all documents as a written table."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    sample = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the sample has at most max_examples ids; of an id's rows each task sends one text, the one of least hash
    labelled = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    examples, _ = S.written(labelled.select("doc_id", "toxic", "t.text").mapInArrow(S.tidy(_sketch), "doc_id long, toxic int, text string, sketch long"), "examples")
    single = examples.groupBy("sketch", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    apart = examples.join(F.broadcast(single), "doc_id", "left_semi")
    n = {r.toxic: r.n for r in apart.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0) + 1.0, n.get(0, 0) + 1.0
    p, q = (F.col("toxic") + 0.5) / n1, (F.col("clean") + 0.5) / n0
    z = (p - q) / F.sqrt(p * (1 - p) / n1 + q * (1 - q) / n0)
    stats = apart.mapInArrow(S.tidy(_count), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    chosen = stats.where(F.col("toxic") >= LEAST_DOCS).withColumn("z", z).where((F.col("z") >= LEAST_Z / 2) & (p >= LEAST_LIFT * q))
    # few documents speak for a term only if they are almost all toxic
    chosen = chosen.where((F.col("z") >= LEAST_Z) | (F.col("toxic") >= 20 * F.col("clean") + 6))
    terms = sorted(r.term for r in chosen.select("term").collect())
    found, _ = S.written(texts.mapInArrow(S.tidy(_find(terms)), "doc_id long, terms array<int>, counts array<int>"), "terms")
    df = {r.term: r.n for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    total = found.count()
    idf = np.array([log((1 + total) / (1 + df.get(i, 0))) + 1 for i in range(len(terms) + DOUBLINGS)])
    idf[len(terms) :] *= WORDS_WEIGHT
    toxic = {r.doc_id: r.toxic for r in examples.select("doc_id", "toxic").collect()}
    vectors = examples.select("doc_id", "text").mapInArrow(S.tidy(_find(terms)), "doc_id long, terms array<int>, counts array<int>").collect()
    return Model(terms, idf, sorted((r.doc_id, toxic[r.doc_id], dict(zip(r.terms, r.counts))) for r in vectors)), found


def score_toxicity(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for each row of docs (doc_id, text); labels (doc_id, toxic 0 or 1).

    evidence: up to three labelled documents nearest to it.  Learned from are
    labelled rows that are not held out, at most ``max_examples`` of them, taken by a hash of
    doc_id; a doc_id with several labels counts as toxic if one says so; null
    labels and ids are ignored.  Null and empty texts, and texts without any of
    the terms, get the rate of toxic ones among such examples, 0.25 if there are
    none.  Repeated rows get equal scores.  A null doc_id is scored and is not
    held out.  An empty table gives an empty result; other columns are not read.
    """
    S.small_batches(docs)
    model, found = fit(docs, labels, max_examples)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, {}
        for batch in batches:
            scores = []
            for t, c in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                key = (*t, *c)
                if key not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[key] = model.score(dict(zip(t, c)))
                scores.append(known[key])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in scores], pa.float64()), pa.array([e for _, e in scores], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    out = found.mapInArrow(S.tidy(run), "doc_id long, score double, evidence array<long>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """The rows of docs that score below 0.5, with all their columns; texts are scored where they stand, without a shuffle.

    Scores are those of score_toxicity(): null and empty texts score the rate among examples without terms and so
    stay where most of these are clean, a null doc_id changes nothing, repeated rows stay or go
    together, and an empty table stays empty.  Columns of any name pass through.
    """
    S.small_batches(docs)
    model, _ = fit(docs, labels, max_examples)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    find = _find(model.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (got,) = find(iter([batch]))
            keep = [sent.value.score(dict(zip(t, c)))[0] < 0.5 for t, c in zip(got.column("terms").to_pylist(), got.column("counts").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(S.tidy(run), docs.schema)
