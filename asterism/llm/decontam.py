"""Operator 5: benchmark passages in documents, also with other numbers, names or units (template canonicalisation).

Words are trimmed of punctuation and case-folded; numbers, names (capitalised
words inside a sentence) and units (after a number) become typed placeholders.
Capitals say nothing about names in headings and texts in capitals, so texts are
also read with names as literal words, and with all words literal (``VIEWS``).
All windows of eight such tokens with at least four literal words are hashed and
joined with the windows of the benchmark's items, view by view.  Matches of one document and
item on one alignment are then checked for slot consistency: each value of the
item must stand for one value in the document, that of most of its slots, and
windows that cover a slot with another one don't count.  Different values may
become equal.  A pair is reported if consistent windows cover at least
half of the item's in one of the views.  In capitals a changed name costs the windows that cover it.

An item of fewer than eight words is one window of its own: with at least four words it is found wherever
they stand one after the other, with fewer only where they are a document's whole text.

Scale: the benchmark's size is measured.  Up to ``BLOCK_BYTES`` of text its index goes to the
executors and one pass over the documents, without a shuffle, does the rest.  A larger benchmark is joined: each item is posted
under its rarest windows, so many that a covered item shares one of them; one pass over the documents
keeps those with a posted window (a bitmap of fixed size lets most others go), their windows meet the posted
ones in one hash join, and only the pairs so found are compared.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _spark as S
from ._text import Words, grams, mix64, seeds, string_buffers

WINDOW, LITERALS, COVERAGE = 8, 4, 0.5
BLOCK_BYTES = 8 << 20
#: Rows to drop, of 16 bytes each, that are sent around at most; more are joined by merge.
GONE_ROWS = 1 << 20
#: The bitmap of posted windows has two to the power of this many bits.
BITMAP = 26
_CHUNK = 2 << 20
_PLACEHOLDER = seeds(3, 21)
_LITERAL, _NUMBER, _NAME, _UNIT = 0, 1, 2, 3
#: The kinds that are placeholders: templates, templates whatever the capitals, and words as they stand.
VIEWS = ((_NUMBER, _NAME, _UNIT), (_NUMBER, _UNIT), ())
# The units that may follow a number.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "t", "gram", "grams", "kilogram", "kilograms", "tonne", "tonnes", "oz", "lb", "lbs", "pound", "pounds",
    "ml", "l", "litre", "litres", "liter", "liters", "gallon", "gallons",
    "ms", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "percent", "degree", "degrees", "dollar", "dollars", "euro", "euros", "cent", "cents", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "w", "kw", "v", "j", "kj", "n", "pa",
)


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_TRIM, _STOP, _DIGIT, _UPPER, _BREAK = _flags(".,;:!?()[]{}\"'"), _flags(".!?:"), _flags("0123456789"), _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags("\n\r")
_SIGN = _flags("$+-#")


def _lower(text: str) -> str:
    """text in lower case but for characters that would take another number of bytes."""
    return "".join(x if len((x := c.lower()).encode()) == len(c.encode()) else c for c in text)


def _folded(texts: pa.Array) -> np.ndarray:
    """The bytes of texts in lower case, each at the place of the original."""
    lower = pc.utf8_lower(texts)
    if not pc.all(pc.equal(pc.binary_length(lower), pc.binary_length(texts)), min_count=0).as_py():
        lower = pa.array([None if t is None else _lower(t) for t in texts.to_pylist()], texts.type)
    return string_buffers(lower)[0]


class Tokens:
    """Tokens of a batch of texts: their kind, and the hash of the word in lower case."""

    def __init__(self, texts: pa.Array):
        w = Words(texts)
        self.doc, self.first, self.count = w.doc, w.first, w.count
        raw, last = w.raw, np.zeros(0, np.uint8)
        if len(w):
            last = raw[w.end - 1]
            broken = np.zeros(len(raw) + 1, np.int64)
            np.cumsum(_BREAK[raw], out=broken[1:])
            opens = np.ones(len(w), bool)
            opens[1:] = _STOP[last[:-1]] | (w.doc[1:] != w.doc[:-1]) | (broken[w.start[1:]] > broken[w.end[:-1]])
            for _ in range(4):
                w.end -= (w.end - w.start > 1) & _TRIM[raw[w.end - 1]]
                w.start += (w.end - w.start > 1) & _TRIM[raw[w.start]]
            if raw.max() > 127:
                w.raw = _folded(texts)
        self.word = w.hashes(fold=True)
        self.kind = np.zeros(len(w), np.int8)
        if len(w):
            head = raw[w.start]
            second = raw[np.minimum(w.start + 1, w.end - 1)]
            number = _DIGIT[head] | (_SIGN[head] & _DIGIT[second])
            unit = np.zeros(len(w), bool)
            unit[1:] = np.isin(self.word[1:], _units()) & number[:-1] & (w.doc[1:] == w.doc[:-1])
            self.kind[_UPPER[head] & ~opens] = _NAME
            self.kind[unit] = _UNIT
            self.kind[number] = _NUMBER

    def windows(self, n: int, literals: int, view: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the windows that count where the kinds of view are placeholders."""
        if len(self.word) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        slot = _among(self.kind, view)
        h = grams(np.where(slot, _PLACEHOLDER[np.maximum(self.kind, 1) - 1], self.word), n)
        plain = np.concatenate([[0], np.cumsum(~slot)])
        ok = (self.doc[: len(h)] == self.doc[n - 1 :]) & (plain[n:] - plain[:-n] >= literals)
        at = np.flatnonzero(ok)
        return at, h[at]


def _among(kind: np.ndarray, view: tuple[int, ...]) -> np.ndarray:
    """Which kinds the view has as placeholders."""
    held = np.zeros(4, bool)
    held[list(view)] = True
    return held[kind]


_unit_hashes: np.ndarray | None = None


def _units() -> np.ndarray:
    global _unit_hashes
    if _unit_hashes is None:
        _unit_hashes = np.sort(Words(pa.array(UNITS)).hashes(fold=True))
    return _unit_hashes


def _conflicts(ours: list[int], theirs: list[int]) -> list[int]:
    """The slots that hold another value than most of those with the item's same value; in a tie the item's own value counts, or none."""
    votes: dict[int, Counter] = defaultdict(Counter)
    for x, y in zip(ours, theirs):
        votes[x][y] += 1
    value = {}
    for x, counts in votes.items():
        (y, n), *others = counts.most_common(2)
        value[x] = y if not others or others[0][1] < n else x if counts[x] == n else None
    return [k for k, (x, y) in enumerate(zip(ours, theirs)) if y != value[x]]


def _kinds(window: int, literals: int) -> list[tuple[tuple[int, ...], int, int, bool]]:
    """View, words of a window, literals it needs, and whether it must be a whole text: the views, then items of fewer words."""
    return [(v, window, literals, False) for v in VIEWS] + [((), k, 0, k < literals) for k in range(1, window)]


def _windows(t: Tokens, kind: tuple, of_items: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a kind's windows; of_items: only those that items are posted under."""
    view, k, literals, whole = kind
    at, h = t.windows(k, literals, view)
    if whole or (of_items and (literals, view) == (0, ())):
        alone = t.count[t.doc[at]] == k
        at, h = at[alone], h[alone]
    return at, h


class View:
    """The windows of a block of items in one view, sorted by hash."""

    def __init__(self, kind: tuple, t: Tokens):
        self.kind, (view, self.window, *_) = kind, kind
        at, h = _windows(t, kind, True)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.offset = h[order], t.doc[at][order], (at - t.first[t.doc[at]])[order]
        self.total = np.bincount(t.doc[at], minlength=len(t.count))
        self.first, self.slot, self.word = t.first, _among(t.kind, view), t.word
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(h >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, t: Tokens) -> dict[tuple[int, int], list]:
        """Consistent windows, first word, and whether all slots are equal, by (text, item)."""
        at, h = _windows(t, self.kind)
        near = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
        at, h = at[near], h[near]
        lo, hi = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return {}
        n = (hi - lo)[hit]
        where = np.repeat(lo[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = np.repeat(at[hit], n)
        item, offset, doc = self.item[where], self.offset[where], t.doc[at]
        order = np.lexsort((offset, at - offset, item, doc))
        at, item, offset, doc = at[order], item[order], offset[order], doc[order]
        pairs: dict[tuple[int, int], list] = defaultdict(lambda: [set(), None, True])
        cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(at - offset) != 0), [True]])).tolist()
        for a, b in zip(cuts, cuts[1:]):
            d, i, shift = int(doc[a]), int(item[a]), int(at[a] - offset[a])
            slots = np.unique((offset[a:b, None] + np.arange(self.window)).ravel())
            slots = slots[self.slot[self.first[i] + slots]]
            ours, theirs = self.word[self.first[i] + slots].tolist(), t.word[shift + slots].tolist()
            held = offset[a:b]
            if len(set(zip(ours, theirs))) != len(set(ours)):
                wrong = slots[_conflicts(ours, theirs)]
                held = held[np.searchsorted(wrong, held + self.window) == np.searchsorted(wrong, held)]
                if not len(held):
                    continue
            p = pairs[d, i]
            p[0].update(held.tolist())
            p[1] = shift - int(t.first[d]) if p[1] is None else min(p[1], shift - int(t.first[d]))
            p[2] &= ours == theirs
        return pairs


class Index:
    """One block of items in all views."""

    def __init__(self, ids: list, texts: list[str], window: int, literals: int, coverage: float):
        self.ids, self.coverage = ids, coverage
        t = Tokens(pa.array(texts, pa.string()))
        self.views = [x for x in (View(kind, t) for kind in _kinds(window, literals)) if len(x.hash)]

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int, int, bool]]:
        """(text, item, consistent windows, the item's windows, first word, all slots equal) for each pair that is covered enough, in the view that covers it most."""
        t = Tokens(texts)
        best: dict[tuple[int, int], tuple[int, int, int, bool]] = {}
        for view in self.views:
            for (d, i), (windows, first, same) in view.matches(t).items():
                n, total = len(windows), int(view.total[i])
                if n < self.coverage * total:
                    continue
                old = best.get((d, i))
                if old is None or n * old[1] > old[0] * total:
                    best[d, i] = n, total, max(0, first), same and (old is None or old[3])
                else:
                    best[d, i] = *old[:3], old[3] and same
        return [(d, i, *x) for (d, i), x in sorted(best.items())]


def _small(benchmark: DataFrame, window: int, literals: int, coverage: float) -> Index | None:
    """The whole benchmark's index, if its texts take no more than BLOCK_BYTES."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BLOCK_BYTES:
        return None
    rows = items.collect()
    return Index([r.item_id for r in rows], [r.text for r in rows], window, literals, coverage)


def _salted(h: np.ndarray, kind: int) -> np.ndarray:
    return mix64(h + seeds(64, 22)[kind]).view(np.int64)


def _post(window: int, literals: int):
    """Items in; the hashes of their windows, with how many the item has of that kind, out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in S.gathered(batches, _CHUNK):
            t, items = Tokens(table["text"]), table["item"].to_numpy()
            for k, kind in enumerate(_kinds(window, literals)):
                at, h = _windows(t, kind, True)
                total = np.bincount(t.doc[at], minlength=len(t.count))
                yield pa.RecordBatch.from_arrays([pa.array(_salted(h, k)), pa.array(items[t.doc[at]]), pa.array(np.full(len(at), k, np.int32)), pa.array(total[t.doc[at]])], ["key", "item", "kind", "total"])

    return run


def _hits(window: int, literals: int, kinds: list[int], bitmap):
    """Documents in; those with a window that the bitmap has, and the hashes of such windows, out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        every = _kinds(window, literals)
        for table in S.gathered(batches, _CHUNK):
            t = Tokens(table["text"])
            keys, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in kinds:
                at, h = _windows(t, every[k])
                key = _salted(h, k)
                spot = key.view(np.uint64) >> np.uint64(64 - BITMAP)
                near = (bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) > 0
                keys.append(key[near])
                docs.append(t.doc[at[near]])
            keys, docs = np.concatenate(keys), np.concatenate(docs)
            order = np.argsort(docs, kind="stable")
            found, first = np.unique(docs[order], return_index=True)
            if len(found):
                lists = [np.unique(x) for x in np.split(keys[order], first[1:])]
                some = table.take(pa.array(found))
                yield from some.append_column("keys", pa.array(lists, pa.list_(pa.int64()))).combine_chunks().to_batches()

    return run


def _found(benchmark: DataFrame, *more: str) -> tuple[str, pa.Schema]:
    """The columns of what is found, for Spark and for Arrow."""
    kind = benchmark.schema["item_id"].dataType
    numbers = ("matched_windows", "item_windows", "first_word")
    ddl = f"doc_id long, item_id {kind.simpleString()}, " + ", ".join(f"{x} long" for x in numbers) + ", exact boolean" + "".join(f", {x} long" for x in more)
    return ddl, pa.schema([("doc_id", pa.int64()), ("item_id", to_arrow_type(kind)), *[(x, pa.int64()) for x in numbers], ("exact", pa.bool_()), *[(x, pa.int64()) for x in more]])


def _verify(window: int, literals: int, coverage: float, schema: pa.Schema):
    """Pairs (row, item, and both texts) in; those that are covered out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in S.gathered(batches, _CHUNK):
            columns = {c: table[c].to_pylist() for c in ("row", "item", "doc_id", "item_id", "text", "item_text")}
            texts, items = dict(zip(columns["row"], columns["text"])), dict(zip(columns["item"], columns["item_text"]))
            index = Index(list(items), list(items.values()), window, literals, coverage)
            rows, names = list(texts), list(items)
            found = {(rows[d], names[i]): x for d, i, *x in index.matches(pa.array(texts.values(), pa.string()))}
            out = [{"doc_id": d, "item_id": i, "matched_windows": x[0], "item_windows": x[1], "first_word": x[2], "exact": x[3], "row": r} for r, item, d, i in zip(*(columns[c] for c in ("row", "item", "doc_id", "item_id"))) if (x := found.get((r, item)))]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _joined(texts: DataFrame, benchmark: DataFrame, window: int, literals: int, coverage: float) -> DataFrame:
    """What find_contamination() gives, for a benchmark of any size, by one join on window hashes."""
    spark = texts.sparkSession
    items, _ = S.written(benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text")).where("text is not null"), "items")
    windows, _ = S.written(items.select("item", "text").mapInArrow(S.tidy(_post(window, literals)), "key long, item long, kind int, total long"), "windows")
    held = windows.groupBy("key").agg(F.count("*").alias("held"))
    # an item with n windows of which m must match shares one of any n - m + 1: its rarest
    rank = F.row_number().over(W.partitionBy("item", "kind").orderBy("held", "key"))
    needed = F.greatest(F.lit(1), F.col("total") - F.ceil(F.col("total") * coverage) + 1)
    posted, _ = S.written(windows.join(held, "key").withColumn("rank", rank).where(F.col("rank") <= needed).select("key", "item", "kind").distinct(), "posted")
    spot = F.shiftrightunsigned("key", 64 - BITMAP)
    words = posted.groupBy(F.shiftright(spot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - BITMAP}) & 63 as int))")).alias("set")).toArrow()
    bits = np.zeros(1 << (BITMAP - 6), np.uint64)
    bits[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    kinds = sorted(r.kind for r in posted.select("kind").distinct().collect())
    rows = texts.mapInArrow(S.tidy(_hits(window, literals, kinds, spark.sparkContext.broadcast(bits))), "doc_id long, text string, keys array<bigint>")
    rows, _ = S.written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "keys"), "rows")
    pairs = rows.select("row", F.explode("keys").alias("key")).join(posted, "key").select("row", "item").distinct()
    both = pairs.join(items.withColumnRenamed("text", "item_text"), "item").join(rows.drop("keys"), "row")
    ddl, schema = _found(benchmark, "row")
    return both.mapInArrow(S.tidy(_verify(window, literals, coverage, schema)), ddl).join(rows.select("row", *_same(rows)), "row").drop("row")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, matched_windows, item_windows, first_word, exact): documents that contain an item.

    docs (doc_id, text), benchmark (item_id, text).  exact: all slots of
    matched windows hold the item's own values.  Windows are those of the view that covers most of the item.
    Items of fewer than ``window`` words have one window, all of their words as they stand; with
    fewer than ``literals`` words it must be a document's whole text.  Null and empty texts on either side,
    and texts without a word, are never reported.  Repeated
    rows are reported as often as they occur; a null id stays null.  An empty
    table on either side gives an empty result; other columns are not read.
    """
    S.small_batches(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = _small(benchmark, window, literals, coverage)
    if index is None:
        return _joined(texts, benchmark, window, literals, coverage).drop("same1", "same2")
    sent = docs.sparkSession.sparkContext.broadcast(index)
    ddl, schema = _found(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for table in S.gathered(batches, _CHUNK):
            found = index.matches(table["text"])
            ids = table["doc_id"].to_pylist() if found else []
            rows = [{"doc_id": ids[d], "item_id": index.ids[i], "matched_windows": n, "item_windows": total, "first_word": first, "exact": same} for d, i, n, total, first, same in found]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return texts.mapInArrow(S.tidy(run), ddl)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs in which find_contamination() finds nothing, with all their columns; no shuffle of docs unless the benchmark is large and more rows go than can be sent around.

    Null and empty texts stay, null ids change nothing, and repeated rows stay or
    go together.  An empty table stays empty; an empty benchmark changes nothing.  Columns of any name pass through.
    """
    S.small_batches(docs)
    index = _small(benchmark, window, literals, coverage)
    if index is None:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        gone, _ = S.written(_joined(texts, benchmark, window, literals, coverage).select("same1", "same2").distinct(), "gone")
        few = gone.count() <= GONE_ROWS
        # the keys of docs stand beside its columns in a struct, so no name can clash
        rows = docs.select(F.struct("*").alias("r"), *_same(docs))
        return rows.join(F.broadcast(gone) if few else gone.hint("merge"), ["same1", "same2"], "left_anti").select("r.*")
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in S.gathered(batches, _CHUNK):
            clean = np.ones(table.num_rows, bool)
            clean[[d for d, *_ in sent.value.matches(table["text"])]] = False
            yield from table.filter(pa.array(clean)).to_batches()

    return docs.mapInArrow(S.tidy(run), docs.schema)


def _same(docs: DataFrame) -> list[F.Column]:
    """128 bits that rows with equal doc_id and text share."""
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    return [F.xxhash64(F.lit(k), doc_id.isNull(), text.isNull(), doc_id, text).alias(f"same{k}") for k in (1, 2)]
