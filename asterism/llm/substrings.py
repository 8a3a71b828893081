"""Operator 6: removal of passages that other documents have already (seed and extend).

Anchors are winnowed: of the ``window - anchor + 1`` anchor-long word runs in a
window the one with the smallest hash is its anchor, so equal windows have
equal anchors wherever they stand.  Documents meet on their anchors; from each
shared anchor the match is extended to both sides, window by window, as far as
the windows around it agree, and neighbouring matches are merged into maximal
repeats.  A window counts as a repeat in a document if it also starts in a
document with a smaller id.

Scale: a task first settles what it can alone.  Of equal windows in its rows
only those of the smallest document are sent on, so a passage in a third of all
documents sends one row for each task, not one for each document.  What is sent
is one entry for each run of windows with one anchor, as packed arrays, dealt
by anchor into cells of bounded size.  A phrase that many different passages share makes a hot anchor:
a task that has more than ``HOT`` windows of it deals these over all cells and
tells the anchor's own cell.  Such windows, and all of a cell that is larger than
expected, are dealt a second time by their own hash and compared there, in
pieces of bounded size; equal windows meet all the same.  Ranges
come back dealt by document and meet the texts there.  A
window is compared by its anchor's 64-bit hash and 48 bits of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark as S
from ._text import Words, grams, hash_of_long, mix64, pack, sliding_min, unpack

WINDOW, ANCHOR = 13, 4
#: Windows of one anchor in a task's chunk from which it counts as hot.
HOT = 64
#: Packed bytes that are expanded at once.
PIECE = 40 << 20
_CHUNK = 4 << 20
_LOW48 = np.uint64((1 << 48) - 1)
#: Kinds of rows: marked ranges, names of hot anchors, windows of hot anchors, and other windows.
MARK, NAMES, HEAVY, LIGHT = range(4)
_BLOBS = "cell int, kind int, m binary, doc binary, start binary, span binary, hash binary"
_SCHEMA = pa.schema([("cell", pa.int32()), ("kind", pa.int32()), *[(x, pa.binary()) for x in ("m", "doc", "start", "span", "hash")]])


def _row(cell: int, kind: int, m: bytes = b"", doc: bytes = b"", start: bytes = b"", span: bytes = b"", hash: bytes = b"") -> dict:
    return {"cell": int(cell), "kind": kind, "m": m, "doc": doc, "start": start, "span": span, "hash": hash}


def _groups(cell: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, int]]]:
    """An order by cell, and the bounds of each cell in it."""
    order = np.argsort(cell, kind="stable")
    c = cell[order]
    cuts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]])).tolist() if len(c) else []
    return order, zip(cuts, cuts[1:])


def _ranges(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (doc, position) marks as (doc, first, count)."""
    if not len(doc):
        return doc, pos, pos
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)) + 1
    at = np.concatenate([[0], cut])
    return doc[at], pos[at], np.diff(np.concatenate([at, [len(doc)]]))


def _marks(doc: np.ndarray, pos: np.ndarray, n: int) -> Iterator[dict]:
    """Repeated windows (document, position) as rows dealt by document, as home_of() deals texts."""
    order = np.lexsort((pos, doc))
    d, first, count = _ranges(doc[order], pos[order])
    home = hash_of_long(d) % n
    order, groups = _groups(home)
    for a, b in groups:
        o = order[a:b]
        yield _row(home[o[0]], MARK, doc=pack(np.diff(d[o], prepend=0)), start=pack(first[o].astype(np.int32)), span=pack(count[o].astype(np.int32)))


def home_of(doc_id: str, n: int) -> F.Column:
    """The cell of a document; a text without an id goes by itself."""
    return F.pmod(F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id)).otherwise(F.xxhash64("text")), F.lit(n)).cast("int")


def _low(wh: np.ndarray) -> bytes:
    return wh.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _entries(kind: int, cell: np.ndarray, m: np.ndarray, wh: np.ndarray, doc: np.ndarray, pos: np.ndarray, first: np.ndarray, span: np.ndarray) -> Iterator[dict]:
    """Runs of windows, each from first on and of one anchor, as rows of their cells."""
    order, groups = _groups(cell)
    for a, b in groups:
        o = order[a:b]
        o = o[np.argsort(doc[first[o]], kind="stable")]
        r, s = first[o], span[o]
        every = np.repeat(r - np.cumsum(s) + s, s) + np.arange(s.sum())
        yield _row(cell[o[0]], kind, m[r].tobytes(), pack(np.diff(doc[r], prepend=0)), pack(pos[r].astype(np.int32)), pack(s.astype(np.int32)), _low(wh[every]))


def _windows(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, own hash, document and position of each window in rows that _entries() made."""
    span = np.concatenate([unpack(r["span"], np.int32) for r in rows]).astype(np.int64)
    m = np.repeat(np.concatenate([np.frombuffer(r["m"], np.uint64) for r in rows]), span)
    doc = np.repeat(np.concatenate([np.cumsum(unpack(r["doc"], np.int64)) for r in rows]), span)
    start = np.concatenate([unpack(r["start"], np.int32) for r in rows]).astype(np.int64)
    wide = np.zeros((len(m), 8), np.uint8)
    wide[:, :6] = np.frombuffer(b"".join(r["hash"] for r in rows), np.uint8).reshape(-1, 6)
    pos = np.repeat(start - np.cumsum(span) + span, span) + np.arange(len(m))
    return m, wide.reshape(-1).view(np.uint64), doc, pos


def _key(m: np.ndarray, wh: np.ndarray) -> np.ndarray:
    return mix64(m + wh * np.uint64(0x9E3779B97F4A7C15))


def _batch(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


def _first_of_equal(m: np.ndarray, wh: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window the smallest document that has an equal one here."""
    key = _key(m, wh)
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    mo, wo = m[order], wh[order]
    if (same & ((mo[1:] != mo[:-1]) | (wo[1:] != wo[:-1]))).any():  # two windows with one key
        order = np.lexsort((wh, m))
        mo, wo = m[order], wh[order]
        same = (mo[1:] == mo[:-1]) & (wo[1:] == wo[:-1])
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(doc[order], starts)
    out = np.empty(len(doc), dtype=doc.dtype)
    out[order] = np.repeat(least, np.diff(np.concatenate([starts, [len(doc)]])))
    return out


def _seeds(window: int, anchor: int, n: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in S.gathered(batches, _CHUNK):
            table = table.filter(table["doc_id"].is_valid())
            if not table.num_rows:
                continue
            w = Words(table["text"])
            if len(w) < window:
                continue
            h = w.hashes()
            whole, ok = w.grams(h, window)
            m = sliding_min(grams(h, anchor), window - anchor + 1)
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            m, wh, local = m[at], whole[at] & _LOW48, w.doc[at]
            doc = table["doc_id"].to_numpy()[local]
            pos = at - w.first[local]
            mine = _first_of_equal(m, wh, doc) == doc
            rows = list(_marks(doc[~mine], pos[~mine], n))
            m, wh, doc, pos, local = m[mine], wh[mine], doc[mine], pos[mine], local[mine]
            cut = (m[1:] != m[:-1]) | (local[1:] != local[:-1]) | (pos[1:] != pos[:-1] + 1)
            first = np.flatnonzero(np.concatenate([[True], cut]))
            span = np.diff(np.concatenate([first, [len(m)]]))
            anchors, which = np.unique(m[first], return_inverse=True)
            hot = anchors[np.bincount(which, span) > most]
            heavy = np.isin(m[first], hot)
            own = (m[first] % np.uint64(n)).astype(np.int64)
            spread = (mix64(m[first] ^ hash_of_long(doc[first]).view(np.uint64)) % np.uint64(n)).astype(np.int64)
            for kind, chosen, cell in ((LIGHT, ~heavy, own), (HEAVY, heavy, spread)):
                rows += _entries(kind, cell[chosen], m, wh, doc, pos, first[chosen], span[chosen])
            order, groups = _groups((hot % np.uint64(n)).astype(np.int64))
            rows += [_row(hot[order[a]] % np.uint64(n), NAMES, hot[order[a:b]].tobytes()) for a, b in groups]
            yield from _batch(rows)

    return run


def _extend(n: int, piece: int):
    """Cells by anchor in; marks, and windows to deal by their own hash, out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hot = None, np.zeros(0, np.uint64)
        for (cell, kind), table, whole in S.runs(batches, ("cell", "kind"), piece):
            if kind == MARK:
                yield from table.to_batches()
                continue
            rows = table.to_pylist()
            if cell != at:
                at, hot = cell, np.zeros(0, np.uint64)
            if kind == NAMES:
                hot = np.union1d(hot, np.concatenate([np.frombuffer(r["m"], np.uint64) for r in rows]))
                continue
            m, wh, doc, pos = _windows(rows)
            late = _first_of_equal(m, wh, doc) != doc
            out = list(_marks(doc[late], pos[late], n))
            send = np.flatnonzero(~late & (np.isin(m, hot) if kind == LIGHT and whole else True))
            again = (_key(m[send], wh[send]) % np.uint64(n)).astype(np.int64)
            yield from _batch(out + list(_entries(LIGHT, again, m, wh, doc, pos, send, np.ones(len(send), np.int64))))

    return run


def _settle(n: int):
    """Cells by window hash in; only marks out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table, whole in S.runs(batches, ("cell", "kind"), 1 << 62):
            if key[1] == MARK:
                yield from table.to_batches()
                continue
            m, wh, doc, pos = _windows(table.to_pylist())
            late = _first_of_equal(m, wh, doc) != doc
            yield from _batch(list(_marks(doc[late], pos[late], n)))

    return run


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<long>"
_OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("spans", pa.list_(pa.int64()))])


def _apply(window: int):
    """Each cell's ranges, then its texts; one row for each text out."""

    def rest(ids: list, texts: list, d: np.ndarray, a: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        out: dict[str, list] = {x: [] for x in _OUT_SCHEMA.names}
        for i, text in zip(ids, texts):
            words = (text or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            if i is not None:
                lo, hi = np.searchsorted(d, i), np.searchsorted(d, i, "right")
                np.add.at(gone, np.minimum(a[lo:hi], len(words)), 1)
                np.add.at(gone, np.minimum(a[lo:hi] + c[lo:hi] + window - 1, len(words)), -1)
            stay = np.cumsum(gone[:-1]) == 0
            kept = b" ".join(words) if stay.all() else b" ".join([words[j] for j in np.flatnonzero(stay)])
            edges = np.flatnonzero(np.diff(np.concatenate([[True], stay, [True]])))
            for x, v in zip(out, (i, len(words), int(len(words) - stay.sum()), hashlib.sha256(kept).hexdigest(), kept.decode(), [int(x) for x in edges])):
                out[x].append(v)
        return pa.RecordBatch.from_pydict(out, _OUT_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, []
        d = a = c = np.zeros(0, np.int64)
        for (cell, kind), table, _ in S.runs(batches, ("cell", "kind"), _CHUNK):
            if cell != at:
                at, found = cell, []
                d = a = c = np.zeros(0, np.int64)
            if kind == MARK:
                found += [(np.cumsum(unpack(r["doc"], np.int64)), unpack(r["start"], np.int32).astype(np.int64), unpack(r["span"], np.int32).astype(np.int64)) for r in table.to_pylist()]
                continue
            if found:
                d, a, c = (np.concatenate([f[i] for f in found]) for i in range(3))
                order = np.argsort(d, kind="stable")
                d, a, c, found = d[order], a[order], c[order], []
            yield rest(table["doc_id"].to_pylist(), table["text"].to_pylist(), d, a, c)

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, spans) for each row of docs (doc_id, text).

    A word goes if a window of ``window`` words that covers it also starts in a
    document with a smaller doc_id; windows are those of the input.  kept: the
    remaining words joined by one space.  spans: word positions at which
    removed runs begin and end, in turn.

    Null and empty texts have no words and an empty rest.  A null doc_id is
    neither smaller nor larger: its text stays whole and takes nothing from
    others.  Rows with one doc_id count as one document; a range found in one of
    them applies to them all.  An empty table gives an empty result; other
    columns are not read.
    """
    if not 1 <= anchor <= window:
        raise ValueError("anchor must be between 1 and window")
    S.small_batches(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = S.slices(docs, 8)
    seeds = S.by_cells(texts.mapInArrow(S.tidy(_seeds(window, anchor, n, HOT)), _BLOBS), n, "kind")
    again = S.by_cells(seeds.mapInArrow(S.tidy(_extend(n, PIECE)), _BLOBS), n, "kind")
    marks = again.mapInArrow(S.tidy(_settle(n)), _BLOBS).select("cell", "kind", "doc", "start", "span", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    nothing = F.lit(None).cast("binary")
    own = texts.select(home_of("doc_id", n).alias("cell"), F.lit(MARK + 1).alias("kind"), nothing.alias("doc"), nothing.alias("start"), nothing.alias("span"), "doc_id", "text")
    return S.by_cells(marks.unionByName(own), n, "kind").mapInArrow(S.tidy(_apply(window)), _OUT)
