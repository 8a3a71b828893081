"""Operator 1: SentencePiece encoding and decoding on the Tokenizers library.

The model file is parsed here (protobuf wire format, no generated code) and
rebuilt as a Tokenizers pipeline: normaliser (prefix space, collapsed spaces,
the metaspace marker), then a unigram model from the scores or, for BPE models,
merges ranked by score, with byte fallback, and the decoder that undoes it all.

Where no piece of the vocabulary reaches over a word's start, a text's tokens are
its words' tokens.  A batch then encodes and decodes each distinct word once, in
multithreaded calls, and puts texts together from those.  Models with pieces across
words are encoded and decoded text by text.  Ids and decoded texts are always the
rebuilt pipeline's; everything is encoded by the SentencePiece library as well, and ``parity`` tells of
each text whether the two agree.

Scale: one narrow pass, no shuffle; the model file (read on the driver, bounded
by ``MAX_MODEL_BYTES``) is broadcast.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark as S

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL_BYTES = 64 << 20
THREADS = 2
#: Words that a worker keeps, besides those of one batch.
KNOWN_WORDS = 150_000
MARK = "▁"
_CHUNK = 1 << 20
# Piece types and model types of the model file's format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: int for varints, bytes for the rest."""
    at, n = 0, len(raw)

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind}")
            size = varint()
        if at + size > n:
            raise ValueError("the model file ends early")
        yield tag >> 3, raw[at : at + size]
        at += size


@dataclass
class Spec:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def parse(raw: bytes) -> Spec:
    out = Spec()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif n == 3:
                    kind = v
            out.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    out.model_type = v
                elif n == 35:
                    out.byte_fallback = bool(v)
                elif n == 40:
                    out.unk_id = v
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    out.charsmap = v
                elif n == 3:
                    out.add_dummy_prefix = bool(v)
                elif n == 4:
                    out.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    out.escape_whitespaces = bool(v)
    if out.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models")
    return out


def merges(spec: Spec) -> list[tuple[str, str]]:
    """BPE merges, best first: all ways to join two pieces into a third, by its score."""
    rank = {p: -s for p, s, kind in spec.pieces if kind in (NORMAL, USER_DEFINED)}
    ids = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
    found = [(r, ids[p[:i]], ids[p[i:]], p[:i], p[i:]) for p, r in rank.items() for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank]
    return [(a, b) for *_, a, b in sorted(found)]


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, raw: bytes):
        import sentencepiece
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        self.spec = spec = parse(raw)
        self.peer = sentencepiece.SentencePieceProcessor(model_proto=raw)
        vocabulary = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        steps = []
        if spec.charsmap:
            steps.append(normalizers.Precompiled(spec.charsmap))
        if spec.remove_extra_whitespaces:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if spec.add_dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if spec.escape_whitespaces:
            steps.append(normalizers.Replace(" ", MARK))
        if spec.model_type == BPE:
            model = models.BPE(vocab=vocabulary, merges=merges(spec), unk_token=spec.pieces[spec.unk_id][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
        else:
            model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=spec.unk_id, byte_fallback=spec.byte_fallback)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.normalizer = normalizers.Sequence(steps)
        undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        if spec.add_dummy_prefix:
            undo.append(decoders.Strip(" ", 1, 0))
        self.tokenizer.decoder = decoders.Sequence(undo)
        marked = [p for p, _, kind in spec.pieces if kind in (NORMAL, USER_DEFINED)]
        #: No piece has a marker after something else, and the normaliser is the identity but for the marker: words are apart.
        self.by_word = spec.escape_whitespaces and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and not spec.charsmap and not any(MARK in p.lstrip(MARK) for p in marked) and not any(kind == USER_DEFINED for *_, kind in spec.pieces)
        if self.by_word:
            self.tokenizer.normalizer = None  # words come with their spaces, already marked
        #: Ids of each word; what words decode to that do not give themselves again; the words on which the libraries differ.
        self.known: dict[str, bytes] = {}
        self.changed: dict[str, str] = {}
        self.differ: set[str] = set()

    def _learn(self, words: list[str]) -> None:
        """Adds words (each with its leading markers) to the known ones."""
        ours = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        # the peer puts the first marker itself, but not before nothing
        theirs = self.peer.encode([w[1:].replace(MARK, " ") for w in words], num_threads=THREADS)
        for w, a, b in zip(words, ours, theirs):
            self.known[w] = array("i", a).tobytes()
            if a != b and w != MARK:
                self.differ.add(w)
        # all words are decoded as one text; only if that differs, one by one
        if self.tokenizer.decode([i for x in ours for i in x], skip_special_tokens=False) != "".join(words).replace(MARK, " ")[1:]:
            for w, text in zip(words, self.tokenizer.decode_batch(ours, skip_special_tokens=False)):
                if f" {text}" != w.replace(MARK, " "):  # the decoder takes a first space as the text's
                    self.changed[w] = f" {text}"

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str], list[bool]]:
        """Of each text the ids, what they decode to, and whether the SentencePiece library gives these ids; the empty text has none."""
        if not self.by_word:
            ours = [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            theirs = self.peer.encode(texts, num_threads=THREADS)
            return [np.array(a, np.int32) for a in ours], self.tokenizer.decode_batch(ours, skip_special_tokens=False), [a == b for a, b in zip(ours, theirs)]
        split = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
            self.changed.clear()
            self.differ.clear()
        if new := {w for words in split for w in words} - self.known.keys():
            self._learn(list(new))
        known, changed = self.known, self.changed
        ids = [np.frombuffer(b"".join([known[w] for w in words]), np.int32) for words in split]
        if changed:
            back = ["".join([changed.get(w) or w.replace(MARK, " ") for w in words])[1:] for words in split]
        else:
            back = [t.replace(MARK, " ") for t in texts]
        return ids, back, [self.differ.isdisjoint(words) for words in split] if self.differ else [True] * len(texts)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


#: Leading markers with what follows up to the next marker.
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
_codecs: dict[str, Codec] = {}


def codec(raw: bytes) -> Codec:
    """One codec for each model in a process."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _codecs:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        _codecs[key] = Codec(raw)
    return _codecs[key]


def _schema(ids: bool) -> str:
    return "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean, parity boolean" + ", ids array<int>" * ids


def encode_documents(docs: DataFrame, model: str = MODEL, ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, round_trip, parity[, ids]) for each row of docs (doc_id, text).

    ids: the whole text's tokens; ids_sha256: of their little-endian int32
    bytes.  round_trip: decoding gives the text again (not where the text holds
    the metaspace marker itself, which the model reads as a space).  parity:
    the SentencePiece library gives the same ids for this text; where it does
    not, the ids are the rebuilt tokenizer's all the same.

    Null and empty texts have no tokens and come back as empty.  Repeated rows
    get equal results; null ids stay null.  An empty table gives an empty
    result; other columns are not read.
    """
    S.small_batches(docs)
    if os.path.getsize(model) > MAX_MODEL_BYTES:
        raise ValueError("the model file is too large to broadcast")
    with open(model, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value)
        for table in S.gathered(batches, _CHUNK):
            own = [t or "" for t in table["text"].to_pylist()]
            made, back, parity = c.encode(own)
            cols = [
                table["doc_id"].combine_chunks(), pa.array([len(x) for x in made], pa.int64()), pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in made], pa.string()),
                pa.array([a == b for a, b in zip(own, back)], pa.bool_()), pa.array(parity, pa.bool_()),
            ]
            if ids:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *made]))))
            names = ["doc_id", "n_tokens", "ids_sha256", "round_trip", "parity", "ids"][: len(cols)]
            yield from pa.Table.from_arrays(cols, names).to_batches()

    return texts.mapInArrow(S.tidy(run), _schema(ids))


def decode_ids(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null and empty ids decode to the empty text.

    Rows may repeat and are decoded each; a null doc_id stays null.  Ids beyond
    the vocabulary decode to nothing.  An empty table gives an empty result; other columns are not read.
    """
    S.small_batches(encoded)
    with open(model, "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value)
        for batch in batches:
            texts = c.decode([np.array(x or [], np.int32) for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(S.tidy(run), "doc_id long, text string")
