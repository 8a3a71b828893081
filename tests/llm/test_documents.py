"""Operators on documents against plain versions, with odd rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from asterism.llm import _spark as S
from asterism.llm._text import Words, hash_of_long, pack, sliding_min, unpack
from asterism.llm.decontam import drop_contaminated, find_contamination
from asterism.llm.fingerprints import fingerprints, signatures
from asterism.llm.lines import chunks, dedup_lines
from asterism.llm.neardup import intersections, least_matches, near_duplicates
from asterism.llm.substrings import dedup_substrings

from . import brute


def key(x):
    return repr(x)


# --- shared parts ---


def test_words_are_those_of_split():
    texts = ["a b", "", None, "  lead\tand\x0btrail \n", "é x y", "A\x0cB", "z"]
    w = Words(pa.array(texts))
    raw = w.raw.tobytes()
    got = [[raw[w.start[j] : w.end[j]] for j in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [(t or "").encode().split() for t in texts]
    h = Words(pa.array(["Ab aB ab é", "ab"])).hashes(fold=True)
    assert h[0] == h[1] == h[2] == h[4] != h[3]
    assert len(set(Words(pa.array(["Ab aB ab"])).hashes().tolist())) == 3


def test_sliding_min_and_packing():
    x = np.random.default_rng(1).integers(0, 1000, 50).astype(np.uint64)
    for w in (1, 2, 3, 7, 10, 50):
        assert sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(51 - w)]
    assert len(sliding_min(x, 60)) == 0
    assert unpack(pack(x), np.uint64).tolist() == x.tolist()


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, int(x)) for x in range(101, 160)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (150, 2))] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in S.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert S.components(spark.createDataFrame([], "a long, b long")).isEmpty()
    partly = S.components(spark.createDataFrame(edges, "a long, b long"), 1).collect()
    assert len({r.node for r in partly}) == len(partly) == len(got) and all(find(r.node) == find(r.component) for r in partly)


def _near_copies(n, most, words=60, seed=3):
    rng = np.random.default_rng(seed)
    hub = [f"w{x}" for x in rng.integers(0, 5000, words)]
    rows = []
    for i in range(n):
        w = list(hub)
        for _ in range(rng.integers(0, most + 1)):
            w[rng.integers(words)] = f"w{rng.integers(5000)}"
        rows.append((i, " ".join(w)))
    return rows


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Several blocks of members, of which some are linked with none or few others."""
    from asterism.llm import neardup

    monkeypatch.setattr(neardup, "LIST_BLOCK", 60)
    monkeypatch.setattr(neardup, "SET_BLOCK", 40)
    rows = _near_copies(500, 3)
    rows += [(1000 + i, t) for i, t in _near_copies(80, 1, 30, 9)] + [(2000, rows[7][1]), (2001, ""), (2002, None)]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4).collect()}
    assert got == brute.near(rows, 4) and len({r[2] for r in got}) > 20


def test_across_pairs_all_labels_and_no_label_with_itself(spark):
    from asterism.llm import neardup

    rng = np.random.default_rng(4)
    labels = [0] * 400 + [1] * 150 + [2] * 8 + list(range(10, 60))
    rows = [(7, i, int(x), neardup.UNIT // 50) for i, x in enumerate(labels)] + [(8, 1000 + i, 5, neardup.UNIT // 50) for i in range(120)]
    rng.shuffle(rows)
    dealt = neardup._across(spark.createDataFrame([tuple(map(int, r)) for r in rows], "key long, rep long, label long, weight long"), 4, "key").collect()
    held = {}
    for r in dealt:
        held.setdefault((r.key, r.lo, r.hi), []).append(r.rep)
    assert {k[0] for k in held} == {7} and all(len(v) == len(set(v)) <= 150 for v in held.values())
    met = {(a, b) for v in held.values() for a in v for b in v if a < b}
    assert {(a, b) for a in range(len(labels)) for b in range(a + 1, len(labels)) if labels[a] != labels[b]} <= met
    assert not any({labels[x] for x in v} == {0} for v in held.values())


def test_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(70)]
    both = intersections(sets)
    for i in range(70):
        for j in range(i):
            assert both[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_least_matches():
    t = least_matches(24, 0.8)
    miss = sum(math.comb(24, i) * 0.8**i * 0.2 ** (24 - i) for i in range(t))
    assert miss <= 1e-6 < miss + math.comb(24, t) * 0.8**t * 0.2 ** (24 - t)


# --- 6 ---


def test_substrings(docs, corpus):
    got = dedup_substrings(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(brute.substrings(corpus), key=key)
    for r in got:
        assert len(r.kept.split()) == r.n_words - r.n_removed and sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed


@pytest.mark.parametrize("window, anchor", [(5, 2), (3, 3), (20, 1)])
def test_substrings_other_lengths(docs, corpus, window, anchor):
    got = dedup_substrings(docs, window, anchor).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(brute.substrings(corpus, window), key=key)


def test_hash_of_long_is_sparks(spark):
    ids = [0, 1, -1, 7, 2**62, -(2**63), 2**63 - 1, 123456789]
    rows = spark.createDataFrame([(i,) for i in ids], "i long").select("i", F.xxhash64("i").alias("h")).collect()
    assert hash_of_long(np.array([r.i for r in rows])).tolist() == [r.h for r in rows]


def _phrase(n, phrase, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        w = [f"w{x}" for x in rng.integers(0, 10**6, 40)]
        rows.append((i * 51, " ".join([*w[:20], *phrase.split(), *w[20:]])))
    return rows


def test_substrings_deal_a_hot_phrase_evenly(spark):
    """One phrase in every document, ids in steps of the number of cells: no cell has twice the mean, before nor after the second dealing."""
    from asterism.llm import substrings as M

    cells = 51
    rows = _phrase(6000, "for more information see")
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    S.small_batches(texts)
    seeds = texts.mapInArrow(M._seeds(13, 4, cells, M.HOT), M._BLOBS)
    again = S.by_cells(seeds, cells, "kind").mapInArrow(M._extend(cells, M.PIECE), M._BLOBS)
    for dealt in (seeds, again):
        windows = dealt.where(f"kind in ({M.HEAVY}, {M.LIGHT})").groupBy("cell").agg((F.sum(F.octet_length("hash")) / 6).alias("n")).collect()
        total = sum(r.n for r in windows)
        assert max(r.n for r in windows) < 2 * total / cells
    assert total > 30_000  # the phrase's windows, dealt again
    assert sum(1 for r in dedup_substrings(texts).collect() if r.n_removed) == 0
    homes = texts.select(M.home_of("doc_id", cells).alias("cell")).groupBy("cell").count().collect()
    assert max(r["count"] for r in homes) < 2 * len(rows) / cells


@pytest.mark.parametrize("hot, piece", [(0, 16 << 20), (3, 1), (10**9, 1), (10**9, 2000)])
def test_substrings_hot_anchors_and_large_cells(spark, docs, corpus, monkeypatch, hot, piece):
    """Every anchor hot, every cell too large, and both: the same result."""
    from asterism.llm import substrings as M

    monkeypatch.setattr(M, "HOT", hot)
    monkeypatch.setattr(M, "PIECE", piece)
    got = dedup_substrings(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(brute.substrings(corpus), key=key)
    rows = _phrase(300, "for more information see the one and only page on the site that has it", 6)
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(brute.substrings(rows))


def test_cells_of_any_number(spark):
    """More cells than partitions: every partition gets a run of cells, sorted; sizes of sources add up."""
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("int").alias("cell"))
    from unittest import mock

    with mock.patch.object(S, "MOST_PARTITIONS", 8):
        parts = S.by_cells(df, 5000).rdd.mapPartitions(lambda rows: [[r.cell for r in rows]]).collect()
    assert [x for p in parts for x in p] == list(range(5000)) and {len(p) for p in parts} == {625}
    one = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert S.stored_bytes(one.join(one.select("doc_id"), "doc_id")) == 2 * S.stored_bytes(one) > 0
    assert S.stored_bytes(spark.createDataFrame([("x" * 1000,)] * 50, "t string").repartition(2)) == 25_000
    batches = pa.table({"k": [1, 1, 1, 2, 2, 3], "v": list("abcdef")}).to_batches(max_chunksize=2)
    assert [(k, t["v"].to_pylist(), whole) for k, t, whole in S.runs(iter(batches), ("k",), 1 << 20)] == [((1,), ["a", "b", "c"], True), ((2,), ["d", "e"], True), ((3,), ["f"], True)]
    small = [(k, t.num_rows, whole) for k, t, whole in S.runs(iter(batches), ("k",), 1)]
    assert sum(n for _, n, _ in small) == 6 and [x for x in small if x[2]] == [((3,), 1, True)]


# --- 9 ---


@pytest.mark.parametrize("words, percent", [(4, 80), (5, 80), (2, 60)])
def test_near_duplicates(docs, corpus, words, percent):
    rows = near_duplicates(docs, words, percent).collect()
    assert {tuple(r) for r in rows if r.doc_id is not None} == brute.near(corpus, words, percent)
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)] * 2


def test_near_duplicates_in_blocks(docs, corpus, monkeypatch):
    """Hot lists and groups are dealt in blocks; no link between blocks is lost."""
    from asterism.llm import neardup

    monkeypatch.setattr(neardup, "LIST_BLOCK", 4)
    monkeypatch.setattr(neardup, "SET_BLOCK", 5)
    assert {tuple(r) for r in near_duplicates(docs, 4).collect() if r.doc_id is not None} == brute.near(corpus, 4)


def test_near_duplicates_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df, 4).collect())) == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 1, 3, True)]


@pytest.mark.parametrize("classes, copies", [(10_000, 1), (10_000, 3), (3, 1)])
def test_hot_classes(docs, corpus, monkeypatch, classes, copies):
    """Copies of hot classes, which don't meet in one task, get the component that others get."""
    from asterism.llm import neardup

    monkeypatch.setattr(neardup, "HOT_CLASSES", classes)
    monkeypatch.setattr(neardup, "HOT_COPIES", copies)
    spark = docs.sparkSession
    text = next(t for i, t in corpus if i == 200)
    many = [(2000 + i, text if i % 3 else text + " end") for i in range(90)] + [(3000 + i, None if i % 2 else "  ") for i in range(20)]
    got = near_duplicates(docs.select("doc_id", "text").union(spark.createDataFrame(many, "doc_id long, text string"))).collect()
    assert {tuple(r) for r in got if r.doc_id is not None} == brute.near([*corpus, *many], 5)
    assert len(got) == len(corpus) + len(many) and all(r.kept and r.component_id is None for r in got if r.doc_id is None)


# --- 2 ---


def test_lines(docs, corpus):
    got = {r.doc_id: r for r in dedup_lines(docs).where("doc_id is not null").collect()}
    expected = brute.lines([r for r in corpus if r[0] is not None])
    for i, t in corpus:
        if i is not None:
            assert got[i].text == (None if t is None else expected[i])
            assert got[i].n_lines == (0 if t is None else t.count("\n") + 1)
    assert dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_lines_removed"]
    assert sum(r.n_lines_removed for r in got.values()) > 50


@pytest.mark.parametrize("chunkings", [1, 2, 12])
def test_lines_of_several_chunkings(spark, docs, corpus, chunkings):
    rng = random.Random(chunkings)
    said = [f"line {i} " + "word " * rng.randint(0, 9) for i in range(40)]
    short = [(1000 + i, "\n".join(rng.choice([*said, "", "  "]) for _ in range(rng.randint(1, 60)))) for i in range(120)]
    rows = [r for r in corpus if r[0] is not None] + short
    df = docs.select("doc_id", "text").union(spark.createDataFrame(short, "doc_id long, text string")).repartition(7)
    expected = brute.lines_of_many(rows, chunkings)
    got = {r.doc_id: r for r in dedup_lines(df, chunkings).where("doc_id is not null").collect()}
    text = dict(rows)
    assert {i: r.text for i, r in got.items()} == {i: None if t is None else expected[i] for i, t in rows}
    assert all(r.n_lines_removed == r.n_lines - (0 if text[i] is None else len((r.text or "").split("\n")) if r.n_lines_removed < r.n_lines else 0) for i, r in got.items())
    if chunkings == 1:
        assert expected == brute.lines(rows)


def test_short_passages_of_lines(spark):
    """A passage of four lines goes from nearly all documents that repeat it, whole."""
    rng = random.Random(5)
    own = lambda n: [f"{rng.random()} of its own" for _ in range(n)]
    passage = [f"line {i} of the passage " + "word " * 12 for i in range(4)]
    rows = [(i, "\n".join(own(rng.randint(1, 9)) + passage + own(rng.randint(1, 9)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in dedup_lines(df, 12).collect()}
    left = [sum(x in got[i] for x in passage) for i, _ in rows]
    assert left[0] == 4 and sum(n == 0 for n in left) > 190
    assert all(x in got[i] for i, t in rows for x in t.split("\n") if x not in passage)


def test_rows_of_one_hash(spark):
    """Only equal bytes go where chunks share a hash, over batches of any size."""
    from asterism.llm.lines import _compare, _repeated

    rows = sorted([(1, 5, 0, 0), (1, 7, 0, 0), (1, 7, 8, 0), (1, 9, 0, 0), (2, 3, 0, 0), (3, 1, 0, 0), (3, 1, 4, 0), (4, 1, 2, 0), (4, 2, 2, 0), (4, 3, 0, 2)])
    for size in (1, 2, 3, 20):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("key", "doc_id", "unit", "state"), r)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
        got = sorted(tuple(r.values()) for b in _repeated(iter(batches)) for r in b.to_pylist())
        assert got == [(1, 5, 0, 0), (1, 7, 0, 1), (1, 7, 8, 1), (1, 9, 0, 1), (4, 1, 2, 0), (4, 2, 2, 1), (4, 3, 0, 2)]
    made = pa.RecordBatch.from_pylist([{"key": 1, "doc_id": d, "unit": 0, "body": b} for d, b in ((1, b"x"), (2, b"y"), (3, b"x"), (4, b"y"))])
    assert [r["doc_id"] for b in _compare(iter([made])) for r in b.to_pylist()] == [3, 4]


def test_chunks_are_a_partition_and_shift(corpus):
    for _, t in corpus:
        ranges = chunks((t or "").encode())
        assert ranges[0][0] == 0 and ranges[-1][1] == (t or "").count("\n") + 1 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
        assert all(b - a >= 2 for a, b in ranges[:-1])
    text = next(t for i, t in corpus if i == 408)
    bodies = lambda t: {tuple(t.split("\n")[a:b]) for a, b in chunks(t.encode())}
    before, after = bodies(text), bodies("one new line\n" + text)
    assert len(before & after) >= 0.9 * len(before)


def test_lines_clashing_names(spark):
    t = "\n".join(f"line {i}" for i in range(8))
    df = spark.createDataFrame([(1, t, 5, "a", 2), (2, t, 6, "b", 3)], "doc_id int, text string, __doc int, __GONE string, n_lines int")
    got = sorted(dedup_lines(df).collect())
    assert [(r["__doc"], r["__GONE"], r.n_lines) for r in got] == [(5, "a", 8), (6, "b", 8)] and got[1].n_lines_removed >= 6
    for text in (t, "a\n\n b\nc", "", "\n\n", "x\n" * 40):
        assert chunks(text.encode()) == brute.cut(text.encode())


def test_lines_planted(spark):
    shared = "\n".join(f"line number {i} of a passage that repeats" for i in range(12))
    rows = [(i, f"own text {i * 7}\nmore of {i}\n{shared}\nand an end {i}") for i in range(6)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_lines_removed == 0 and all(got[i].n_lines_removed >= 6 for i in range(1, 6))
    assert all(f"own text {i * 7}" in got[i].text and f"and an end {i}" in got[i].text for i in got)


def test_blank_lines_do_not_count(spark, corpus):
    filled = lambda t: [[x for x in t.split("\n")[a:b] if x.strip()] for a, b in chunks(t.encode())]
    for _, t in corpus:
        if t and t.strip():
            assert filled(t) == filled(t.replace("\n", "\n\n")) == filled(t.replace("\n", "\n \n\n"))
    passage = "\n".join(f"paragraph {i} of a passage" for i in range(12))
    plain = [(i, f"own {i}\n{passage}\nend {i}") for i in range(4)]
    rows = plain + [(100 + i, t.replace("\n", "\n\n")) for i, t in plain]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(4):
        assert [x for x in got[100 + i].split("\n") if x] == got[i].split("\n")
    assert len(got[2].split("\n")) <= 8 and len(got[3].split("\n")) <= 8


def test_lines_repeated_rows_and_null_ids(spark):
    t = "\n".join(f"line {i} with words" for i in range(20))
    rows = [(5, t), (5, t), (None, t), (9, t)]
    got = sorted(((r.doc_id, r.n_lines_removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=key)
    assert [x for x in got if x[0] == 5] == [(5, 0), (5, 0)] and (None, 0) in got and dict(x for x in got if x[0] == 9)[9] >= 18


# --- 5 ---

ITEM = "The train leaves Berlin at 7 with 120 passengers and then it travels 300 km before the driver stops at 9 for 15 minutes while Anna waits near the station"


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def found(spark, texts, *benchmark):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r.doc_id, r.item_id, r.exact) for r in find_contamination(df, items(spark, *benchmark)).collect())


def test_decontamination_templates(spark):
    around = "Some words come first and say nothing at all. {} After that there is more text of no interest."
    other = ITEM.replace("7", "8").replace("120", "45").replace("300 km", "77 miles").replace("Berlin", "Madrid").replace("Anna", "Piotr")
    assert found(spark, [around.format(ITEM), around.format(other), around.format("Nothing."), ITEM.lower(), ""], ITEM) == [(0, 0, True), (1, 0, False), (3, 0, True)]  # in lower case names are other words, but most windows have none
    assert found(spark, [around.format(ITEM)] * 3, ITEM, "Other item that is long enough to have windows of words in it") == [(0, 0, True), (1, 0, True), (2, 0, True)]


def test_decontamination_slots(spark):
    item = "if x costs 5 coins and y costs 5 coins then both of them together cost 10 coins in the end of it"
    same = item.replace("5", "8").replace("10", "16")
    mixed = item.replace("costs 5 coins and y costs 5", "costs 8 coins and y costs 9").replace("10", "16")
    assert found(spark, [same, mixed, item], item) == [(0, 0, False), (2, 0, True)]


def test_decontamination_odd_rows(spark, docs, empty):
    bench = items(spark, None, "", "too short", ITEM)
    assert find_contamination(docs, bench).isEmpty()
    assert find_contamination(empty, bench).isEmpty()
    assert find_contamination(docs, bench.limit(0)).isEmpty()
    assert drop_contaminated(docs, bench).count() == docs.count()


def test_decontamination_in_blocks(spark, monkeypatch):
    from asterism.llm import decontam

    monkeypatch.setattr(decontam, "BLOCK_BYTES", 10)
    second = " ".join(f"word{i}x" for i in range(30))
    assert found(spark, [ITEM, second, ITEM + " " + second], ITEM, second) == [(0, 0, True), (1, 1, True), (2, 0, True), (2, 1, True)]
    df = spark.createDataFrame([(0, ITEM), (1, "clean text"), (2, second)], "doc_id long, text string")
    assert [r.doc_id for r in drop_contaminated(df, items(spark, ITEM, second)).collect()] == [1]


def _exam(seed):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("mor", "tal", "ven", "sir", "pod") for b in ("a", "en", "us", "il")]
    other = ["Anna", "Tom", "Berlin", "3", "5", "7", "120", "km", "kg", "hours", "$9", "-4"]

    def text(n):
        pick = [str(rng.choice(other if rng.random() < 0.3 else words)) for _ in range(n)]
        return "".join(w + str(rng.choice([" ", " ", " ", ", ", ". ", ".\n", " ("])) for w in pick).strip()

    def change(t):
        w = t.split(" ")
        for _ in range(rng.integers(0, 4)):
            k = rng.integers(len(w))
            w[k] = str(rng.choice(other if w[k][:1].isupper() or w[k][:1].isdigit() else words))
        return " ".join(w)

    items = [(i, text(int(rng.choice([1, 3, 4, 6, 8, 9, 12, 20, 40])))) for i in range(40)]
    docs = []
    for i in range(90):
        parts = [text(int(rng.integers(0, 30)))]
        for _ in range(rng.integers(0, 3)):
            x = items[rng.integers(len(items))][1]
            parts += [[x, change(x), x.upper(), change(x).lower(), " ".join(x.split(" ")[: 1 + len(x.split(" ")) * 2 // 3])][rng.integers(5)], text(int(rng.integers(0, 20)))]
        docs.append((i, " ".join(parts) if i % 9 else items[i % 40][1]))
    return docs, items


@pytest.mark.parametrize("seed, block, coverage", [(1, 8 << 20, 0.5), (1, 10, 0.5), (2, 10, 0.75), (3, 8 << 20, 0.3)])
def test_decontamination_against_all_windows_and_alignments(spark, monkeypatch, seed, block, coverage):
    from asterism.llm import decontam

    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    rows, bench = _exam(seed)
    expected = brute.contamination(rows, bench, decontam.UNITS, coverage=coverage)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, item_id long, same1 string").repartition(3)
    got = find_contamination(docs, spark.createDataFrame(bench, "item_id long, text string"), coverage=coverage)
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 30
    left = drop_contaminated(docs, spark.createDataFrame(bench, "item_id long, text string"), coverage=coverage)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {x[0] for x in expected}


def test_decontamination_join_and_odd_rows(spark, monkeypatch):
    """The joined benchmark: repeated rows on both sides, null ids, and more rows to drop than are sent around."""
    from asterism.llm import decontam

    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1)
    monkeypatch.setattr(decontam, "GONE_ROWS", 0)
    rows = [(1, ITEM), (1, ITEM), (None, ITEM), (2, "clean"), (None, None), (None, "clean"), (3, ""), (4, "Too short?")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(None, ITEM), (5, ITEM), (5, "too short"), (6, None), (7, "")], "item_id int, text string")
    got = sorted(((r.doc_id, r.item_id) for r in find_contamination(df, bench).collect()), key=key)
    assert got == sorted([(1, None), (1, 5)] * 2 + [(None, None), (None, 5), (4, 5)], key=key)
    assert sorted(map(tuple, drop_contaminated(df, bench).collect()), key=key) == sorted([(2, "clean"), (None, None), (None, "clean"), (3, "")], key=key)
    assert drop_contaminated(df.limit(0), bench).isEmpty() and find_contamination(df.limit(0), bench).isEmpty()


def test_decontamination_conflicting_slots(spark):
    words = [f"w{i}x" for i in range(60)]
    words[5] = words[25] = words[45] = "Tom"
    words[12], words[32], words[52] = "3", "5", "5"
    item = " ".join(words)
    put = lambda **new: " ".join(new.get(f"at{i}", w) for i, w in enumerate(words))
    texts = [put(at45="Tim"), put(at52="6"), put(at12="4", at32="4", at52="4"), put(at32="4", at52="7"), put(at5="Ann", at25="Eve", at45="Sue", at12="8", at32="9", at52="10")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.matched_windows, r.item_windows, r.exact) for r in find_contamination(df, items(spark, item)).collect()}
    # a conflict costs the eight windows that cover its slot; the last slots are covered by eight windows, too; the last text has no consistent half
    assert got == {0: (45, 53, False), 1: (45, 53, False), 2: (53, 53, False), 3: (37, 53, False)}


def test_decontamination_in_capitals(spark):
    item = "Der Zug fährt um 7 Uhr ab und Anna trägt 12 schwere Koffer über die lange Brücke zu Peter nach Köln weil dort niemand wartet"
    other = item.replace("12", "15")
    assert found(spark, [item.upper(), item.title(), other.upper(), "Vorher. " + item], item) == [(0, 0, True), (1, 0, True), (2, 0, False), (3, 0, True)]
    assert found(spark, [item, item.lower()], item.upper()) == [(0, 0, True), (1, 0, True)]
    df = spark.createDataFrame([(0, f"SO IT IS.\n{ITEM.upper()}"), (1, "NOTHING OF IT")], "doc_id long, text string")
    assert [r.doc_id for r in drop_contaminated(df, items(spark, ITEM)).collect()] == [1]


# --- 8 ---


def test_fingerprints(docs, corpus):
    rows = sorted(((i, t or "") for i, t in corpus), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = fingerprints(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows)
    errors, equal = [], {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        assert any((r.n_chars, r.edited_sha256) == (len(t), brute.sha(edited)) for r in by[i])
        if i is not None:
            (r,) = by[i]
            assert equal.setdefault(t, r.fingerprint) == r.fingerprint and 0 <= r.near_next <= 1
            if t.split() and edited.split():
                errors.append(r.near_edited - brute.weighted_jaccard(t, edited))
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.06
    assert len(set(equal.values())) >= len({t for t in equal if t.split()})


def test_collision_rate_is_weighted_jaccard():
    a, b = "x x x y z", "x y y w"
    s = signatures(pa.array([a, b]), 4000)
    assert abs((s[0] == s[1]).mean() - brute.weighted_jaccard(a, b)) < 0.03
    assert not signatures(pa.array(["", " "])).any()


def test_fingerprints_few_rows(spark):
    one = fingerprints(spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == brute.sha("abcdefab")
    blank = fingerprints(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert {(r.n_chars, r.near_edited, r.near_next, set(r.fingerprint) == {"0"}) for r in blank} == {(0, 1.0, 1.0, True)}


# --- all ---


def test_empty_tables(empty):
    assert dedup_substrings(empty).isEmpty() and near_duplicates(empty).isEmpty() and dedup_lines(empty).isEmpty() and fingerprints(empty).isEmpty()


def test_same_result_at_other_partitionings(docs):
    for op, cols in ((dedup_substrings, ["doc_id", "kept_sha256"]), (dedup_lines, ["doc_id", "text"]), (fingerprints, ["doc_id", "fingerprint", "edited_sha256"])):
        a = op(docs.coalesce(1)).where(F.col("doc_id").isNotNull()).select(cols)
        b = op(docs.repartition(9)).where(F.col("doc_id").isNotNull()).select(cols)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_repeated_rows(spark):
    """Rows that are equal in everything get equal results and count as one document."""
    text = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (3, "other words here")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in dedup_substrings(df).collect()) == [(1, 0), (1, 0), (2, 40), (3, 0)]
    first, second = [r for r in fingerprints(df).collect() if r.doc_id == 1]
    assert first.fingerprint == second.fingerprint and {first.near_next, second.near_next} == {1.0}
    item = spark.createDataFrame([(7, text), (7, text)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in find_contamination(df, item).collect()) == [(1, 7)] * 4 + [(2, 7)] * 2
    assert [r.doc_id for r in drop_contaminated(df, item).collect()] == [3]
