"""Operator 4: URL filters by Bloom filter cascades, with DataFrame functions only.

A cascade's first level is a Bloom filter of the listed keys; its second holds
those unlisted keys of the corpus's whole key universe that pass the first; its
third the listed keys that pass the second, and so on until none is wrong.  Over
that universe membership is exact, and looking a key up needs no join: a level's
bits are a constant in the expression.

Keys are host suffixes (a listed host) and host suffixes followed by path
beginnings (a rule).  One cascade tells rules from other keys, a second tells
what is blocked.

Scale: the first level's error rate is set from the number of listed keys and
the universe's size, so that the second level has about as many keys as the
first; all levels together stay within a fixed multiple of the list.  A list of more
than ``MAX_KEYS`` keys is dealt by hash to several cascades, each over its part of the universe.  The universe is streamed, never stored: one pass for its
size, one for the first level's errors.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark as S

ALLOW, BLOCK = "allow", "block"
# The rules of the query, (verdict, host and path).
RULES = ((ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/"))
# Hosts that the query blocks, with their subdomains, where no rule fits.
HOSTS = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
MAX_KEYS = 1_000_000
HASHES = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column, labels: Sequence[int]) -> Column:
    """The suffixes of a host with so many labels; only those it has."""
    parts = F.split(host, r"\.")
    return F.filter(F.array(*[F.when(F.size(parts) >= n, F.concat_ws(".", F.slice(parts, F.size(parts) - (n - 1), F.lit(n)))) for n in sorted(set(labels))]), lambda x: x.isNotNull())


def prefixes(path: Column, lengths: Sequence[int]) -> Column:
    return F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths))]), lambda x: x.isNotNull())


def _spots(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * HASHES + i), key), F.lit(bits)) for i in range(HASHES)]


class Cascade:
    """Levels of (bits, words); contains() is exact for the keys of the universe it was built over."""

    def __init__(self, levels: list[tuple[int, list[int]]]):
        self.levels = levels

    def _passes(self, key: Column, level: int) -> Column:
        bits, words = self.levels[level]
        table = F.from_json(F.lit(json.dumps(words)), "array<bigint>")
        out = F.lit(True)
        for spot in _spots(key, level, bits):
            word = F.element_at(table, (F.shiftright(spot, 6) + 1).cast("int"))
            out = out & (F.getbit(word, spot.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            out = F.when(self._passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def _level(keys: DataFrame, level: int, bits: int) -> tuple[int, list[int]]:
    """A Bloom filter of (key); its words, at most bits / 64, come to the driver."""
    spots = keys.select(F.explode(F.array(*_spots(F.col("key"), level, bits))).alias("spot"))
    rows = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("set")).collect()
    words = [0] * ceil(bits / 64)
    for r in rows:
        words[r.word] = r.set
    return bits, words


class Cascades:
    """Cascades of the parts that keys are dealt to by hash."""

    def __init__(self, parts: list[Cascade]):
        self.parts = parts

    def contains(self, key: Column) -> Column:
        if len(self.parts) == 1:
            return self.parts[0].contains(key)
        out = F.lit(False)
        for i, part in enumerate(self.parts):
            out = F.when(_part(key, len(self.parts)) == i, part.contains(key)).otherwise(out)
        return out


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts))


def build_cascade(universe: DataFrame, listed: Sequence[str]) -> Cascades:
    """Cascades of the listed keys over a universe (key).

    Keys may repeat on both sides, and null ones in the universe are in no list.  An empty list contains
    nothing; over an empty universe there is nothing to be wrong about.
    """
    names = sorted(set(listed))
    parts = max(1, ceil(len(names) / MAX_KEYS))
    if parts == 1:
        return Cascades([_cascade(universe, names)])
    held: list[list[str]] = [[] for _ in range(parts)]
    for r in universe.sparkSession.createDataFrame([(k,) for k in names], "key string").select("key", _part(F.col("key"), parts).alias("part")).collect():
        held[r.part].append(r.key)
    return Cascades([_cascade(universe.where(_part(F.col("key"), parts) == i), x) for i, x in enumerate(held)])


def _cascade(universe: DataFrame, names: list[str]) -> Cascade:
    if not names:
        return Cascade([])
    keys = universe.sparkSession.createDataFrame([(k,) for k in names], "key string")
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, len(names) / max(1, size))
    levels = [_level(keys, 0, max(64, ceil(HASHES * len(names) / -log(1 - rate ** (1 / HASHES)))))]
    # errors of the first level: unlisted keys that pass it
    passed = universe.where(Cascade(levels)._passes(F.col("key"), 0)).distinct().join(keys, "key", "left_anti")
    sides = [keys, S.written(passed, "passed")[0]]  # sides[i]: what level i holds
    while n := sides[-1].count():
        at = len(levels)
        levels.append(_level(sides[at], at, max(64, ceil(HASHES * n / -log(1 - 0.5 ** (1 / HASHES))))))
        # every level hashes anew and halves what is left, so the last is soon empty
        sides.append(sides[at - 1].where(Cascade(levels)._passes(F.col("key"), at)))
    return Cascade(levels)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, hosts: Sequence[str] = HOSTS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url).

    A rule (verdict, host/path) fits its host and all subdomains if the url's
    path starts with its path; the longest rule wins (of equally long ones that with
    the longer host).  Where none fits, hosts that are listed, and their
    subdomains, are blocked and all others allowed.

    A null url and one without ``://`` have an empty host and path, fit no rule and
    are allowed.  Repeated rows are judged each; a null page_id stays null.  An
    empty table gives an empty result; other columns are not read.
    """
    url = F.col("url")
    split = [(v, *r.partition("/")) for v, r in rules]
    blocked = [r for v, r in rules if v == BLOCK] + list(hosts)
    found = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    host_keys = suffixes(F.col("host"), [h.count(".") + 1 for h in hosts] or [1])
    heads, starts = suffixes(F.col("host"), [h.count(".") + 1 for _, h, _, _ in split] or [1]), prefixes(F.col("path"), [1 + len(p) for *_, p in split] or [1])
    rule_keys = F.flatten(F.transform(heads, lambda h: F.transform(starts, lambda p: F.concat(h, p))))
    keyed = found.select("page_id", "host", "path", host_keys.alias("host_keys"), rule_keys.alias("rule_keys"))
    universe = keyed.select(F.explode(F.concat("host_keys", "rule_keys")).alias("key"))
    is_rule, is_blocked = build_cascade(universe, [r for _, r in rules]), build_cascade(universe, blocked)
    fits = F.array_sort(
        F.filter("rule_keys", is_rule.contains),
        lambda a, b: F.coalesce(F.nullif(F.length(b) - F.length(a), F.lit(0)), F.instr(b, "/") - F.instr(a, "/")),
    )
    judged = keyed.withColumn("rule", F.get(fits, F.lit(0)))
    verdict = F.when(F.when(F.col("rule").isNotNull(), is_blocked.contains(F.col("rule"))).otherwise(F.exists("host_keys", is_blocked.contains)), BLOCK).otherwise(ALLOW)
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
