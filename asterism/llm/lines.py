"""Operator 2: removal of repeated multi-line chunks at content-defined boundaries.

A text is its lines.  A rolling hash over the last two non-blank lines' hashes decides
where a chunk ends, so boundaries depend on nearby lines alone and come back in
step after an insertion.  A chunk with two or more non-blank lines that stands,
byte for byte, at an earlier place (smaller doc_id, or earlier in the same
document) is removed.

One chunking leaves the edges of a repeated passage, and short passages that no chunk
fits.  With several chunkings the same lines are cut again by rolling hashes of other
seeds, and a chunk of any of them goes that is a chunk, of any of them, of a smaller doc_id.

Scale: a task first compares the chunks it has itself, byte for byte; of equal ones only
the first is sent on, as a 64-bit hash and its place.  Rows meet by hash.  Only chunks
whose hash several documents have are sent with their bytes, from later documents
no more of them than cover the lines in question, and compared as a sorted stream, never as a group
in memory.  Texts are dealt by doc_id once, for both joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _spark as S

LEAST_LINES, MOST_LINES, DIVISOR = 2, 16, 2
#: Further chunkings cut after two or more lines but for one time in so many, and after a single line one time in so
#: many: short chunks fit into short passages, and single lines, which never go, bring chunks in step with a passage.
REST_DIVISOR = 4
_CHUNK = 4 << 20
_MASK = (1 << 64) - 1
#: What becomes of a chunk: its hash is the first of its kind, an earlier document has its hash, or an equal one stands earlier.
_FIRST, _LATER, _GONE = 0, 1, 2


def _line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little")


def _rolled(filled: list[bytes]) -> np.ndarray:
    """The rolling hash over two lines, after each line."""
    h = np.array([_line_hash(x) for x in filled], np.uint64)
    before = np.zeros_like(h)
    before[1:] = h[:-1]
    return before * np.uint64(0x9E3779B97F4A7C15) + h


def _cuts(rolled: np.ndarray, chunking: int) -> list[tuple[int, int]]:
    """Ranges of non-blank lines, by their number; chunking is the seed."""
    x = rolled + np.uint64(chunking * 0xD6E8FEB86659FD93 & _MASK)
    mixed = ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
    ends = (mixed % np.uint64(REST_DIVISOR) != 0 if chunking else mixed % np.uint64(DIVISOR) == 0).tolist()
    out, start = [], 0
    for i in range(1, len(ends)):
        if i - start >= MOST_LINES or (ends[i - 1] if i - start >= LEAST_LINES else chunking and not ends[i - 1]):
            out.append((start, i))
            start = i
    return [*out, (start, len(ends))]


def chunks(text: bytes, chunking: int = 0) -> list[tuple[int, int]]:
    """Line ranges of a text's chunks; blank lines don't count and go with the line before them, in further chunkings only between lines of a chunk."""
    lines = text.split(b"\n")
    filled = [i for i, x in enumerate(lines) if x.strip()]
    return _ranges(_cuts(_rolled([lines[i] for i in filled]), chunking), filled, len(lines), chunking)


def _ranges(cuts: list[tuple[int, int]], filled: list[int], total: int, chunking: int) -> list[tuple[int, int]]:
    if chunking:
        return [(filled[a], filled[b - 1] + 1) for a, b in cuts if b > a]
    ends = [filled[b] if b < len(filled) else total for _, b in cuts]
    return list(zip([0, *ends], ends))


def _units(raw: bytes, chunkings: int) -> tuple[list[int], dict[tuple[int, int], bool]]:
    """Where each line begins, and the line ranges of chunks with two or more non-blank lines: whether they are of the first chunking."""
    lines = raw.split(b"\n")
    filled, begins, at = [], [], 0
    for i, x in enumerate(lines):
        begins.append(at)
        at += len(x) + 1
        if x.strip():
            filled.append(i)
    begins.append(at)
    out: dict[tuple[int, int], bool] = {}
    if len(filled) >= LEAST_LINES:
        rolled = _rolled([lines[i] for i in filled])
        for chunking in range(chunkings):
            cuts = _cuts(rolled, chunking)
            for (a, b), spot in zip(cuts, _ranges(cuts, filled, len(lines), chunking)):
                if b - a >= LEAST_LINES:
                    out.setdefault(spot, chunking == 0)
    return begins, out


def _pack(a: int, b: int, first: bool) -> int:
    """A line range as one number, in the order of places; the lowest bit: of the first chunking."""
    return a << 32 | (b - a) << 1 | first


def _unpack(unit: int) -> tuple[int, int, int]:
    a = unit >> 32
    return a, a + ((unit & 0xFFFFFFFF) >> 1), unit & 1


def _emit(chunkings: int):
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("unit", pa.int64()), ("state", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in S.gathered(batches, _CHUNK):
            seen: dict[bytes, tuple[int, list[int]]] = {}
            gone: list[tuple[int, int]] = []
            for doc, text in zip(table["doc_id"].to_pylist(), table["text"].to_pylist()):
                if doc is None or not text:
                    continue
                raw = text.encode()
                begins, units = _units(raw, chunkings)
                own: dict[bytes, int] = {}
                for (a, b), first in sorted(units.items()):
                    unit, body = _pack(a, b, first), raw[begins[a] : begins[b] - 1]
                    if first and own.setdefault(body, unit) != unit:
                        gone.append((doc, unit))
                        continue
                    held = seen.get(body)
                    if held is None or doc < held[0]:
                        if held:
                            gone.extend((held[0], u) for u in held[1])
                        seen[body] = (doc, [unit])
                    elif doc > held[0]:
                        gone.append((doc, unit))
                    elif unit not in held[1]:
                        held[1].append(unit)
            gone.sort()
            rows = [(int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True), doc, u, _FIRST) for body, (doc, units) in seen.items() for u in units]
            rows += [(_line_hash(b"%d %d" % x) - (1 << 63), *x, _GONE) for x in gone]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and place: of the keys of several documents the first row, and those of all other documents as later ones."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("unit", pa.int64()), ("state", pa.int32())])
    held, sent = None, False
    for batch in batches:
        key, doc, unit, state = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("key", "doc_id", "unit", "state"))
        out = [np.stack([key, doc, unit, state.astype(np.int64)])[:, state == _GONE]]
        k, d, u = (x[state != _GONE] for x in (key, doc, unit))
        if len(k):
            if held is not None:
                k, d, u = (np.concatenate([[x], y]) for x, y in zip(held, (k, d, u)))
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            later = d > d[head]
            heads = np.unique(head[later])
            out.append(np.stack([k[later], d[later], u[later], np.full(later.sum(), _LATER)]))
            fresh = heads[1:] if held is not None and sent and len(heads) and heads[0] == 0 else heads
            out.append(np.stack([k[fresh], d[fresh], u[fresh], np.full(len(fresh), _FIRST)]))
            last = head[-1]
            sent = bool(len(heads) and heads[-1] == last) or (held is not None and sent and last == 0)
            held = (k[last], d[last], u[last])
        got = np.concatenate(out, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1]), pa.array(got[2]), pa.array(got[3].astype(np.int32))], schema=schema)


def _bodies(found: str):
    """The bytes of chunks that later ones are compared with, and of as many later ones of a document as cover all their lines."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("unit", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, units in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column(found).to_pylist()):
                if doc is None or not units or not text:
                    continue
                lines, covered = text.encode().split(b"\n"), set()
                # what goes already, then the first chunking, then the longest
                for x in sorted(units, key=lambda x: (-x["state"], not x["unit"] & 1, -(x["unit"] & 0xFFFFFFFF), x["unit"])):
                    a, b, _ = _unpack(x["unit"])
                    if x["state"] != _FIRST:
                        if covered.issuperset(range(a, b)):
                            continue
                        covered.update(range(a, b))
                    rows.append((x["key"], int(doc), x["unit"], None if x["state"] == _GONE else b"\n".join(lines[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and place: those whose bytes an earlier document's row of their key has."""
    key, held = None, {}
    for batch in batches:
        doc, unit = [], []
        for k, d, u, body in zip(*(batch.column(x).to_pylist() for x in ("key", "doc_id", "unit", "body"))):
            if body is not None:
                if k != key:
                    key, held = k, {}
                if held.setdefault(body, d) == d:
                    continue
            doc.append(d)
            unit.append(u)
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(unit, pa.int64())], ["doc_id", "unit"])


def _without(text: str | None, gone: list[int] | None) -> tuple[str | None, int, int]:
    """The rest of a text, its lines, and its removed lines."""
    if text is None:
        return None, 0, 0
    lines = text.encode().split(b"\n")
    if not gone:
        return text, len(lines), 0
    drop = {i for unit in gone for a, b, _ in [_unpack(unit)] for i in range(a, b)}
    kept = [line for i, line in enumerate(lines) if i not in drop]
    return b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, chunkings: int = 1) -> DataFrame:
    """docs (doc_id, text, ...) with repeated chunks taken out of text, and n_lines and n_lines_removed added.

    The first of equal chunks by (doc_id, place) stays.  A chunk with fewer than
    two non-blank lines stays always.  An empty text is one line; a null text
    stays null with 0 lines.  Rows with a null doc_id stay as they are and take
    nothing from others.  doc_id is taken as a key: rows that repeat one are one
    place, so equal ones stay both.  Other columns pass through; columns named
    n_lines or n_lines_removed are replaced.  An empty table stays empty.

    chunkings: how many there are.  Within a document only chunks of the first one are compared;
    chunks of further ones end at their last non-blank line, so blank lines around them stay.
    """
    S.small_batches(docs)
    n = S.partitions(S.slices(docs))
    own = docs.drop("n_lines", "n_lines_removed")
    names = own.columns
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spots = texts.mapInArrow(S.tidy(_emit(chunkings)), "key long, doc_id long, unit long, state int")
    shared = spots.repartition(n, "key").sortWithinPartitions("key", "doc_id", "unit").mapInArrow(S.tidy(_repeated), "key long, doc_id long, unit long, state int")

    place, doc, chunk = (S.fresh(x, names) for x in ("__place", "__doc", "__gone"))
    # rows without an id are dealt by their text and meet nothing; both joins read this one exchange
    dealt = own.withColumn(place, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))).repartition(n, place)

    def with_list(rows: DataFrame, item: F.Column) -> DataFrame:
        lists = rows.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list(item).alias(chunk))
        return dealt.join(lists.hint("merge"), F.col(place) == F.col(doc), "left").drop(doc)

    bodies = with_list(shared, F.struct("key", "unit", "state")).mapInArrow(S.tidy(_bodies(chunk)), "key long, doc_id long, unit long, body binary")
    gone = bodies.repartition(n, "key").sortWithinPartitions("key", "doc_id", "unit").mapInArrow(S.tidy(_compare), "doc_id long, unit long")
    schema = T.StructType([*own.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_lines_removed", T.LongType())])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_without(t, g if i is not None else None) for i, t, g in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column(chunk).to_pylist())]
            cols = [pa.array([m[0] for m in made], pa.string()) if x == "text" else batch.column(x) for x in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], [*names, "n_lines", "n_lines_removed"])

    return with_list(gone, F.col("unit")).mapInArrow(S.tidy(rest), schema)
