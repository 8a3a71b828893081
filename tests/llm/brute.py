"""Plain versions of the operators, on lists of (doc_id, text)."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def substrings(rows, window=13):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near(rows, k=4, percent=80):
    sets = {i: shingle_set(t, k) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    for i, s in sets.items():
        both = Counter(j for x in s for j in held[x] if j < i)
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}


def cut(text, shortest=2, longest=16, divisor=2):
    """Line ranges of chunks: a chunk ends after its n-th filled line, n from shortest on, if the hash of its last two filled lines says so, or at longest."""

    def h(line):
        return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little")

    every = text.split(b"\n")
    filled = [i for i, x in enumerate(every) if x.strip()]
    ends, n = [], 0
    for k, i in enumerate(filled[:-1]):
        n += 1
        two = ((h(every[filled[k - 1]]) if k else 0) * 0x9E3779B97F4A7C15 + h(every[i])) % 2**64
        spread = ((two ^ two >> 29) * 0xBF58476D1CE4E5B9) % 2**64 >> 40
        if n >= longest or (n >= shortest and spread % divisor == 0):
            ends.append(filled[k + 1])
            n = 0
    return list(zip([0, *ends], [*ends, len(every)]))


def lines(rows, least=2):
    spots = {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        own = t.encode().split(b"\n")
        for c, (a, b) in enumerate(cut(t.encode())):
            if sum(1 for x in own[a:b] if x.strip()) >= least:
                spots.setdefault(b"\n".join(own[a:b]), (i, c))
    out = {}
    for i, t in rows:
        own = (t or "").encode().split(b"\n")
        kept = []
        for c, (a, b) in enumerate(cut((t or "").encode())):
            body = b"\n".join(own[a:b])
            if i is None or spots.get(body, (i, c)) == (i, c):
                kept += own[a:b]
        out[i] = b"\n".join(kept).decode()
    return out


def cut_again(filled, seed):
    """Runs of the filled lines in a further chunking: a run of two or more ends but for one time in four, at 16 always, a run of one in the fourth time."""

    def h(line):
        return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little")

    out, run = [], []
    for k, line in enumerate(filled):
        run.append(k)
        two = ((h(filled[k - 1]) if k else 0) * 0x9E3779B97F4A7C15 + h(line) + seed * 0xD6E8FEB86659FD93) % 2**64
        spread = ((two ^ two >> 29) * 0xBF58476D1CE4E5B9) % 2**64 >> 40
        if len(run) == 16 or (len(run) > 1) == (spread % 4 > 0):
            out.append(run)
            run = []
    return [*out, run]


def lines_of_many(rows, chunkings):
    """As lines(), with further chunkings whose chunks count where a smaller doc_id has an equal chunk of any chunking."""
    first, spans, within = {}, {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        own = t.encode().split(b"\n")
        filled = [k for k, x in enumerate(own) if x.strip()]
        here = [(a, b) for a, b in cut(t.encode()) if sum(1 for x in own[a:b] if x.strip()) >= 2]
        seen = set()
        for a, b in here:
            body = b"\n".join(own[a:b])
            if body in seen:
                within.setdefault(i, []).append((a, b))
            seen.add(body)
        for seed in range(1, chunkings):
            here += [(filled[r[0]], filled[r[-1]] + 1) for r in cut_again([own[k] for k in filled], seed) if len(r) >= 2]
        spans[i] = here
        for a, b in here:
            first.setdefault(b"\n".join(own[a:b]), i)
    out = {}
    for i, t in rows:
        own = (t or "").encode().split(b"\n")
        gone = set()
        for a, b in spans.get(i, []):
            if first[b"\n".join(own[a:b])] < i or (a, b) in within.get(i, []):
                gone.update(range(a, b))
        out[i] = b"\n".join(x for k, x in enumerate(own) if k not in gone).decode()
    return out


def weighted_jaccard(a, b):
    x, y = Counter(a.encode().split()), Counter(b.encode().split())
    keys = x.keys() | y.keys()
    return sum(min(x[k], y[k]) for k in keys) / max(1, sum(max(x[k], y[k]) for k in keys))


def _marks(text):
    words = re.sub(r"[\x00-\x7f]", lambda m: m[0] if m[0].isalpha() else " ", (text or "").lower()).split(" ")
    return [w for w in words if w]


def _terms(word):
    return {("whole", word), *((n, word[:n]) for n in (4, 5, 6, 7) if len(word) >= n)}


def toxicity(docs, labels):
    """Scores of all (doc_id, text), by dense cosines with every example; no two examples may share a shingle."""
    texts = dict(docs)
    learned = {i: y for i, y in labels if i in texts and zlib.crc32(str(i).encode()) % 5}
    n1, n0 = sum(learned.values()) + 1, len(learned) - sum(learned.values()) + 1
    seen = {0: Counter(), 1: Counter()}
    for i, y in learned.items():
        seen[y].update({t for w in _marks(texts[i]) for t in _terms(w)})
    chosen = set()
    for t, a in seen[1].items():
        p, q = (a + 0.5) / n1, (seen[0][t] + 0.5) / n0
        z = (p - q) / math.sqrt(p * (1 - p) / n1 + q * (1 - q) / n0)
        if a >= 4 and z >= 2 and p >= 4 * q and (z >= 4 or a >= 20 * seen[0][t] + 6):
            chosen.add(t)

    def counts(text):
        found = [_terms(w) & chosen for w in _marks(text)]
        out = Counter(t for f in found for t in f)
        if n := sum(1 for f in found if f):
            out["doublings", int(math.log2(n))] = 1
        return out

    vectors = {i: counts(t) for i, t in texts.items()}
    df = Counter(t for i, _ in docs for t in vectors[i])

    def unit(v):
        w = {t: (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) * (2 if t[0] == "doublings" else 1) for t, n in v.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    none = [y for i, y in learned.items() if not vectors[i]]
    prior = (sum(none) + 0.5) / (len(none) + 2)
    # of equally near vectors the first counts: by their terms in the order of the texts that stand for them
    place = {t: k for k, t in enumerate(sorted(chosen, key=lambda t: f" {t[1]} " if t[0] == "whole" else f" {t[1]}"))}
    groups = defaultdict(list)
    for i, y in learned.items():
        if vectors[i]:
            groups[tuple(sorted((place.get(t, len(place) + int(t[1]) if t[0] == "doublings" else 0), n, t) for t, n in vectors[i].items()))].append(y)
    groups = [(unit({t: n for _, n, t in k}), groups[k]) for k in sorted(groups)]
    out = {}
    for i, t in docs:
        if not vectors[i]:
            out[i] = prior
            continue
        q = unit(vectors[i])
        close = sorted(((sum(x * q.get(t, 0) for t, x in e.items()), ys) for e, ys in groups), key=lambda c: -round(c[0], 12))
        close = [c for c in close[:15] if c[0] > 0]
        total = sum(c * c * len(ys) for c, ys in close) + 0.25
        out[i] = (sum(c * c * sum(ys) for c, ys in close) + 0.25 * prior) / total
    return out


def _tokens(text, units):
    """(kind, word) of each word: "" for literals, else number, name or unit."""
    out, opens, before, at = [], True, "", 0
    raw = (text or "").encode()
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
        if out:
            opens = before[-1] in ".!?:" or b"\n" in raw[at : m.start()] or b"\r" in raw[at : m.start()]
        before, at = m[0].decode(), m.end()
        w = before
        for _ in range(4):
            if len(w) > 1 and w[-1] in ".,;:!?()[]{}\"'":
                w = w[:-1]
            if len(w) > 1 and w[0] in ".,;:!?()[]{}\"'":
                w = w[1:]
        kind = "name" if w[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" and not opens else ""
        if out and out[-1][0] == "number" and w.lower() in units:
            kind = "unit"
        if w[0] in "0123456789" or (w[0] in "$+-#" and w[1:2] in "0 1 2 3 4 5 6 7 8 9".split()):
            kind = "number"
        out.append((kind, w.lower()))
    return out


def contamination(docs, items, units, window=8, literals=4, coverage=0.5):
    """(doc_id, item_id, matched, windows, first word, exact) over all windows and alignments."""
    out = []
    read = [(i, _tokens(t, units)) for i, t in docs]
    for item_id, text in items:
        item = _tokens(text, units)
        if not item:
            continue
        for doc_id, doc in read:
            if len(item) < window:
                words, n = [w for _, w in item], len(item)
                spots = [s for s in range(len(doc) - n + 1) if [w for _, w in doc[s : s + n]] == words]
                if spots and (n >= literals or len(doc) == n):
                    out.append((doc_id, item_id, 1, 1, spots[0], True))
                continue
            best = None
            for view in ({"number", "name", "unit"}, {"number", "unit"}, set()):

                def keys(tokens):
                    masked = [(k,) if k in view else w for k, w in tokens]
                    cut = {s: tuple(masked[s : s + window]) for s in range(len(tokens) - window + 1)}
                    return {s: x for s, x in cut.items() if sum(isinstance(w, str) for w in x) >= literals}

                ours, theirs = keys(item), keys(doc)
                held, first, same = set(), None, True
                for shift in range(-len(item), len(doc)):
                    match = [o for o, x in ours.items() if theirs.get(o + shift) == x]
                    slots = sorted({p for o in match for p in range(o, o + window) if item[p][0] in view})
                    wrong = set()
                    for value in {item[p][1] for p in slots}:
                        mine = [p for p in slots if item[p][1] == value]
                        votes = Counter(doc[p + shift][1] for p in mine)
                        most = max(votes.values())
                        tops = [y for y, n in votes.items() if n == most]
                        chosen = tops[0] if len(tops) == 1 else value if value in tops else None
                        wrong |= {p for p in mine if doc[p + shift][1] != chosen}
                    good = [o for o in match if not wrong & set(range(o, o + window))]
                    if good:
                        held |= set(good)
                        first = shift if first is None else min(first, shift)
                        same &= all(item[p][1] == doc[p + shift][1] for p in slots)
                if held and len(held) >= coverage * len(ours):
                    if best is None or len(held) * best[1] > best[0] * len(ours):
                        best = (len(held), len(ours), max(0, first), same and (best is None or best[3]))
                    else:
                        best = (*best[:3], best[3] and same)
            if best:
                out.append((doc_id, item_id, *best))
    return sorted(out)
