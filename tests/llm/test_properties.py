"""Properties of the parts that need no session."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from asterism.llm._text import Words, pack, sliding_min, unpack
from asterism.llm.chat import END, START, _branch, _Pack, escape, escape_role, unescape, unescape_role
from asterism.llm.decontam import Index
from asterism.llm.lines import chunks
from asterism.llm.neardup import _Forest, shingles
from asterism.llm.pieces import MODEL, Codec

from . import brute

texts = st.text(alphabet=st.one_of(st.sampled_from(" \t\n<|\\▁abC.7é"), st.characters(exclude_categories=["Cs"])), max_size=60)
settings.register_profile("few", max_examples=60, deadline=None)
settings.load_profile("few")
CODEC = Codec(open(MODEL, "rb").read())


@given(st.lists(st.one_of(st.none(), texts), max_size=8))
def test_words(rows):
    w = Words(pa.array(rows, pa.string()))
    raw = w.raw.tobytes()
    assert [[raw[w.start[j] : w.end[j]] for j in range(a, b)] for a, b in zip(w.first, w.first[1:])] == [(t or "").encode().split() for t in rows]
    h = w.hashes(fold=True).tolist()
    words = [x for t in rows for x in (t or "").encode().lower().split()]
    assert [h.index(x) for x in h] == [words.index(x) for x in words]


@given(st.lists(texts, max_size=6), st.integers(1, 5))
def test_shingles(rows, k):
    g, bounds = shingles(Words(pa.array(rows, pa.string())), k)
    assert [len(set(g[a:b].tolist())) for a, b in zip(bounds, bounds[1:])] == [len(brute.shingle_set(t, k)) for t in rows]


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.integers(1, 12))
def test_sliding_min(x, w):
    x = np.array(x, np.uint64)
    assert sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]
    assert unpack(pack(x), np.uint64).tolist() == x.tolist()


@given(texts)
def test_escapes(x):
    assert unescape(escape(x)) == x and "<|" not in escape(x)
    assert unescape_role(escape_role(x)) == x and "\n" not in escape_role(x)


@given(st.lists(st.lists(st.tuples(texts, texts), min_size=1, max_size=4), min_size=1, max_size=6))
def test_packs_give_turns_back(conversations):
    pack = _Pack()
    for i, turns in enumerate(conversations):
        pack.add(i, turns)
    row = pack.row()
    for turns, leaf in zip(conversations, row["leaves"]):
        got = _branch(row, leaf["node"])
        assert [(t["role"], t["text"]) for t in got[-1]] == turns
        assert got[4] == sum(len(f"{START}{escape_role(r)}\n{escape(t)}{END}\n") for r, t in turns)


@given(st.binary(max_size=80))
def test_chunks_cover(raw):
    ranges = chunks(raw)
    assert [i for a, b in ranges for i in range(a, b)] == list(range(raw.count(b"\n") + 1))


@given(st.lists(texts, min_size=1, max_size=5))
def test_tokens(rows):
    ids, back, parity = CODEC.encode(rows)
    assert [x.tolist() for x in ids] == CODEC.peer.encode(rows) and all(parity)
    assert all(a == b for a, b in zip(rows, back) if "▁" not in a)
    assert back == CODEC.decode(ids)


@given(st.integers(2, 30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 29)), max_size=40))
def test_forest(n, pairs):
    pairs = [(a % n, b % n) for a, b in pairs]
    forest = _Forest(n)
    forest.add(np.array([a for a, _ in pairs], dtype=np.int64), np.array([b for _, b in pairs], dtype=np.int64))
    again = _Forest(n)
    again.add(np.array(forest.a, dtype=np.int64), np.array(forest.b, dtype=np.int64))
    same = lambda f: {tuple(np.flatnonzero(f.label == x)) for x in f.label}
    assert same(forest) == same(again) and len(forest.a) == n - len(set(forest.label.tolist()))
    assert all(forest.label[a] == forest.label[b] for a, b in pairs)


@given(st.lists(st.sampled_from("alpha beta gamma delta eps zeta eta theta iota kappa".split()), min_size=12, max_size=40), texts, texts)
def test_items_are_found_in_any_surroundings(words, before, after):
    item = " ".join(f"{w}{i}" for i, w in enumerate(words))
    found = Index([1], [item], 8, 4, 0.5).matches(pa.array([f"{before}. {item} {after}"], pa.string()))
    assert [(d, i) for d, i, *_ in found] == [(0, 0)]
