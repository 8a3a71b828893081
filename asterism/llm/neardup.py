"""Operator 9: near-duplicate groups by a signature-coordinate inverted join.

Each document's set of word shingles gets a MinHash signature.  Documents are
posted under their (coordinate, value) pairs; pairs that one document holds are
dropped, and of the rest each document keeps only a prefix in order of rarity:
two documents that agree in at least ``t`` of the posted coordinates share one
of the first ``s - t + 1``.  Within a list collisions are counted over the whole
signature, documents whose set sizes rule a link out are skipped, and of the
pairs above the match threshold a spanning forest is kept.  Its components hold
every link (but for a chance below 2e-6 for each pair at the threshold itself), so
their members' full shingle sets are fetched once and compared exactly.

Scale: documents with equal sets are one class from the start, so copies cost
one row each and no pairs; copies of classes that hold more than a ten-thousandth of all
documents learn their component where they stand.  Long lists and large components are dealt in blocks of
bounded size and linked in two rounds: first within blocks, members of components in
two blocks each, so that what is linked grows together; then
across blocks, where only members that are still apart are compared, and blocks of one
linked part never with each other.  A group of near copies of which nearly all are linked thus costs work in
proportion to its size; only parts that are not linked meet each other's members one by one.
Only forests leave a task, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark as S
from ._text import Words, mix64, seeds

COORDINATES, POSTED, MISS = 64, 24, 1e-6
LIST_BLOCK, SET_BLOCK, SET_TOTAL = 1024, 512, 400_000
#: The weight of a full block.
UNIT = 1_000_000
#: Classes of equal sets are hot from this share of all documents on: there can be no more of them than so many.
HOT_CLASSES, HOT_COPIES = 10_000, 1000
_CHUNK = 1 << 20
_ODD = seeds(4 * COORDINATES, 11).astype(np.uint32) | np.uint32(1)


def least_matches(k: int, similarity: float, miss: float = MISS) -> int:
    """The largest t for which fewer than t of k coordinates agree with a chance of at most miss."""
    total = 0.0
    for t in range(k + 1):
        total += comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if total > miss:
            return max(1, t)
    return k


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in the order of the texts, and bounds of each text's; a shorter text is one shingle."""
    h = w.hashes(fold=True)
    g, ok = w.grams(h, k)
    g, doc = g[ok], w.doc[: len(ok)][ok]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        mult = seeds(k, 12)
        own = np.array([np.bitwise_xor.reduce(mix64(h[w.first[i] : w.first[i + 1]] * mult[: w.count[i]])) for i in short], np.uint64)
        g, doc = np.concatenate([g, mix64(own + w.count[short].astype(np.uint64))]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    return g, np.searchsorted(doc, np.arange(len(w.count) + 1))


def signatures_of(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bounds) - 1, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        x = (g ^ (g >> np.uint64(32))).astype(np.uint32)
        for c in range(COORDINATES):
            y = x * _ODD[2 * c]
            y ^= y >> np.uint32(16)
            y *= _ODD[2 * c + 1]
            out[full, c] = np.minimum.reduceat(y, bounds[full])
    return out


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in S.gathered(batches, _CHUNK):
            g, bounds = shingles(Words(table["text"]), k)
            sig = signatures_of(g, bounds)
            sets = [np.unique(g[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks() if table["doc_id"].num_chunks != 1 else table["doc_id"].chunk(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())],
                ["doc_id", "n", "digest", "sig"],
            )

    return run


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = seeds(POSTED, 13)
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)[:, :POSTED]
        keys = mix64(sig.astype(np.uint64) * salt + salt)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("rep").to_numpy(), POSTED))], ["key", "rep"])


class _Forest:
    """Labels of n nodes under pairs that come in arrays; keeps the pairs that joined something."""

    def __init__(self, n: int, parts: np.ndarray | None = None):
        """parts: nodes of one part count as joined."""
        self.label = np.arange(n)
        if parts is not None:
            _, first, part = np.unique(parts, return_index=True, return_inverse=True)
            self.label = first[part]
        self.a: list[int] = []
        self.b: list[int] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        x, y = self.label[i], self.label[j]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while (p := root.get(v, v)) != v:
                root[v] = root.get(p, p)
                v = p
            return v

        for t, p, q in zip(apart.tolist(), x[apart].tolist(), y[apart].tolist()):
            p, q = find(p), find(q)
            if p != q:
                root[max(p, q)] = min(p, q)
                self.a.append(int(i[t]))
                self.b.append(int(j[t]))
        new = np.arange(len(self.label))
        for v in list(root):
            new[v] = find(v)
        self.label = new[self.label]


def _edges(reps: np.ndarray, forest: _Forest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(reps[np.array(forest.a, dtype=np.int64)], pa.int64()), pa.array(reps[np.array(forest.b, dtype=np.int64)], pa.int64())], ["a", "b"])


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole groups with at least so many rows, and each row's group number."""
    held: list[pa.RecordBatch] = []
    n = 0

    def numbered(t: pa.Table) -> np.ndarray:
        cut = np.zeros(t.num_rows, bool)
        for k in keys:
            x = t[k].to_numpy()
            cut[1:] |= x[1:] != x[:-1]
        return np.cumsum(cut)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            g = numbered(t)
            last = int(np.searchsorted(g, g[-1]))
            if last:
                yield t.slice(0, last), g[:last]
            held = t.slice(last).to_batches()
            n = t.num_rows - last if last else 0
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, numbered(t)


def _collide(least: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in _whole_groups(batches, ["key", "lo", "hi"], 8192):
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, COORDINATES)
            size = t["n"].to_numpy()
            reps, first, node = np.unique(t["rep"].to_numpy(), return_index=True, return_inverse=True)
            forest = _Forest(len(reps), t["label"].to_numpy()[first])
            live = np.arange(len(group))
            off = 1
            while True:
                live = live[live + off < len(group)]
                live = live[group[live] == group[live + off]]
                if not len(live):
                    break
                i = live[forest.label[node[live]] != forest.label[node[live + off]]]
                i = i[np.minimum(size[i], size[i + off]) * 100 >= percent * np.maximum(size[i], size[i + off])]
                if len(i):
                    i = i[(sig[i] == sig[i + off]).sum(axis=1) >= least]
                    forest.add(node[i], node[i + off])
                off += 1
            yield _edges(reps, forest)

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()
        for table in S.gathered(batches, _CHUNK):
            g, bounds = shingles(Words(table["text"]), k)
            sets = [np.unique(g[a:b]).tobytes() for a, b in zip(bounds, bounds[1:])]
            fresh = []  # rows come by doc_id: what repeats one in full is left out
            for i, x in zip(table["doc_id"].to_pylist(), sets):
                if i != last:
                    last, seen = i, set()
                fresh.append((x := hashlib.blake2b(x, digest_size=16).digest()) not in seen)
                seen.add(x)
            if not all(fresh):
                table, sets = table.filter(pa.array(fresh)), [x for x, f in zip(sets, fresh) if f]
            yield from pa.Table.from_arrays([table["doc_id"], table["component"], table["blocks"], pa.array(sets, pa.binary())], ["rep", "component", "blocks", "shingles"]).to_batches()

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets without repeats."""
    m = len(sets)
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    count = np.diff(np.concatenate([first, [len(value)]]))
    out = np.zeros(m * m, np.int64)
    rare = (count >= 2) & (count <= 32)
    at, left = first[rare], count[rare] - 1
    for off in range(1, 33):
        at, left = at[left >= 1], left[left >= 1]
        if not len(at):
            break
        # every start within a run that has a partner off places on
        starts = np.repeat(at, left) + (np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left))
        out += np.bincount(owner[starts] * m + owner[starts + off], minlength=m * m)
        left = left - 1
    out = out.reshape(m, m)
    out = out + out.T
    often = np.flatnonzero(count > 32)
    for c in range(0, len(often), 2048):
        part = often[c : c + 2048]
        x = np.zeros((m, len(part)), np.float32)
        spread = np.repeat(first[part] - np.cumsum(count[part]) + count[part], count[part]) + np.arange(count[part].sum())
        x[owner[spread], np.repeat(np.arange(len(part)), count[part])] = 1
        out += np.rint(x @ x.T).astype(np.int64)
    return out


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in _whole_groups(batches, ["near", "lo", "hi"], 64):
            reps_all, labels = t["rep"].to_numpy(), t["label"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])).tolist()
            raw = t["shingles"].to_pylist()
            for a, b in zip(cuts, cuts[1:]):
                if b - a < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in raw[a:b]]
                n = np.array([len(s) for s in sets])
                both = intersections(sets)
                i, j = np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1))
                forest = _Forest(b - a, labels[a:b])
                forest.add(i, j)
                yield _edges(reps_all[a:b], forest)

    return run


def _within(rows: DataFrame, n: int, group: str, deals: int) -> DataFrame:
    """rows (group, rep, label, blocks, ...) dealt to one of each group's blocks by a hash of rep; where there are several blocks, so many times."""
    salt = F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.lit(deals - 1))).otherwise(F.array(F.lit(0))))
    own = F.col("salt") * F.col("blocks") + F.pmod(F.xxhash64("salt", "rep", group), F.col("blocks"))
    return rows.withColumn("salt", salt).withColumn("lo", own).withColumn("hi", F.col("lo")).drop("blocks", "salt").repartition(n, group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")


def _across(rows: DataFrame, n: int, group: str) -> DataFrame:
    """rows (group, rep, label, weight, ...) dealt to those pairs (lo, hi) of blocks in which members with different labels meet.

    weight: a member's share of a block, in millionths.  A block has one label, or several small ones (a pool).  Two
    blocks of one label are no pair; all pairs of members with different labels are in some pair of blocks.
    Groups of one label are left out.
    """
    counts = rows.groupBy(group, "label").agg(F.sum("weight").alias("c"))
    few = F.col("c") < UNIT // 2
    several = counts.groupBy(group).agg(F.count("*").alias("labels"), F.max_by("label", F.struct("c", "label")).alias("top"), F.sum(F.when(few, F.col("c"))).alias("small")).where("labels > 1")
    several = several.select(group, "top", F.ceil(F.coalesce("small", F.lit(0)) / UNIT).alias("pools"))
    named = counts.join(several, group).select(group, "label", few.alias("few"), F.when(few, F.col("pools")).otherwise(F.ceil(F.col("c") / UNIT)).alias("of"), (F.col("label") == F.col("top")).alias("top"))

    def numbers(count: str):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1)).alias("k")

    single = named.where("not few").select(group, F.col("label").alias("of_label"), "top", numbers("of"))
    pools = several.where("pools > 0").select(group, F.lit(None).cast("bigint").alias("of_label"), F.lit(False).alias("top"), numbers("pools"))
    blocks = single.union(pools).withColumn("block", _block("of_label", F.col("k")))
    a = blocks.where("not top").select(group, F.col("block").alias("a"), F.col("of_label").alias("al"))
    b = blocks.select(group, F.col("block").alias("b"), F.col("of_label").alias("bl"), "top")
    pairs = a.join(b, group).where("(top or a < b or (a = b and al is null)) and (al is null or bl is null or al != bl)")
    pairs = pairs.select(group, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    sides = pairs.select(group, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"), "lo", "hi")
    number = F.pmod(F.when(F.col("few"), F.xxhash64("label")).otherwise(F.xxhash64(F.lit(3), "rep")), F.col("of"))
    mine = rows.join(named.drop("top"), [group, "label"]).withColumn("block", _block(F.when(~F.col("few"), F.col("label")), number)).drop("few", "of")
    return mine.join(sides, [group, "block"]).drop("block").repartition(n, group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")


def _block(label, number: F.Column) -> F.Column:
    """A block's name; one without a label is a pool."""
    label = F.col(label) if isinstance(label, str) else label
    return F.xxhash64(label.isNull(), label, number)


def _labelled(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """rows with the part that links have put each rep in so far as its label."""
    if links is None:
        return rows.withColumn("label", F.col("rep"))
    return rows.join(links.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")


def _stars(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("a"), F.col("component").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    A document's set: its distinct shingles of ``words`` words (A-Z lower-cased);
    with fewer words the whole sequence is one.  Documents are linked if
    100 * |intersection| >= percent * |union|; component_id is the smallest
    doc_id that links lead to, and the document with that id is kept.

    Null, empty and blank texts have empty sets and are linked with nothing.  A
    null doc_id is in no component (component_id null) and is kept.  doc_id is
    taken as a key: rows that repeat one are one node, and all of them are kept
    with it.  An empty table gives an empty result; other columns are not read.
    """
    S.small_batches(docs)
    n = S.partitions(S.slices(docs))
    posted, matched = least_matches(POSTED, percent / 100), least_matches(COORDINATES, percent / 100)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, _ = S.written(texts.mapInArrow(S.tidy(_signatures(words)), "doc_id long, n long, digest binary, sig binary"), "signatures")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes, _ = S.written(classes, "classes")

    posts = classes.select("rep", "sig").mapInArrow(S.tidy(_post), "key long, rep long")
    shared = posts.groupBy("key").agg(F.count("*").alias("held")).where("held >= 2")
    tokens = posts.join(shared, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("held", "key"))).alias("t")).where(F.size("t") >= posted)
    prefix = tokens.select("rep", F.explode(F.slice("t", F.lit(1), F.size("t") - (posted - 1))).alias("p"))
    prefix, _ = S.written(prefix.select("p.key", "rep", F.ceil(F.col("p.held") / LIST_BLOCK).alias("blocks")), "prefix")
    sigs = classes.select("rep", "n", "sig")
    collide = S.tidy(_collide(matched, percent))
    near = _within(_labelled(prefix.join(sigs, "rep"), None), n, "key", 1).mapInArrow(collide, "a long, b long")
    long = prefix.where("blocks > 1").select("key", "rep")
    if not long.isEmpty():
        parts = S.components(near, 2)
        weighed = _labelled(long.join(sigs, "rep"), parts).withColumn("weight", F.lit(UNIT // LIST_BLOCK))
        near = _stars(parts).union(_across(weighed, n, "key").mapInArrow(collide, "a long, b long"))

    groups = S.components(near)
    sizes, _ = S.written(groups.join(classes.select(F.col("rep").alias("node"), "n"), "node"), "groups")
    blocks = sizes.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / SET_BLOCK), F.ceil(F.sum("n") / SET_TOTAL)).alias("blocks"))
    members = sizes.join(blocks, "component").select(F.col("node").alias("doc_id"), "component", "blocks")
    # always by merge: the number of members grows with the documents
    sets, _ = S.written(texts.join(members.hint("merge"), "doc_id").mapInArrow(S.tidy(_sets(words)), "rep long, component long, blocks long, shingles binary"), "sets")
    sets = sets.withColumnRenamed("component", "near")
    confirm = S.tidy(_confirm(percent))
    links = _within(_labelled(sets, None), n, "near", 2).mapInArrow(confirm, "a long, b long")
    large = sets.where("blocks > 1").drop("blocks")
    if not large.isEmpty():
        parts = S.components(links, 2)
        weight = F.greatest(F.lit(UNIT // SET_BLOCK), F.octet_length("shingles") * (UNIT // 8) / SET_TOTAL).cast("bigint")
        links = _stars(parts).union(_across(_labelled(large, parts).withColumn("weight", weight), n, "near").mapInArrow(confirm, "a long, b long"))

    linked = S.components(links)
    # a class that has copies or links, with its component; all other documents are their own
    named = classes.join(linked, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).where("copies > 1 or component != rep")
    named, _ = S.written(named.select("digest", "component", "copies"), "named")
    # classes with this share of all documents are at most HOT_CLASSES, so they are sent to all; their copies don't meet in one task
    least = max(HOT_COPIES, (classes.agg(F.sum("copies")).first()[0] or 0) // HOT_CLASSES)
    hot = named.where(F.col("copies") >= least).select("digest", F.col("component").alias("hot"))
    cold = named.where(F.col("copies") < least).select(F.col("digest").alias("key"), "component")
    own = rows.where("n > 0 and doc_id is not null").select("doc_id", "n", "digest").join(F.broadcast(hot), "digest", "left")
    own = own.withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.col("doc_id").cast("string").cast("binary")))
    own = own.join(cold.hint("merge"), "key", "left").select("doc_id", "n", F.coalesce("hot", "component", "doc_id").alias("component"))
    # empty sets and rows without an id meet nothing
    out = own.union(rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
