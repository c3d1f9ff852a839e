"""SentencePiece encoding and decoding on the tokenizers library.

The model file (a protobuf) is read field by field; from it come the pieces with
their scores and kinds, the normaliser's settings and the model type. The
tokenizer is rebuilt from them: a unigram model takes the scores as they are; in
a byte-pair model a merge's rank is the score order of the piece it makes. Spaces
become the metaspace marker, a text gets one in front, unknown characters fall
back to byte pieces.

Encoding a batch: no piece goes on behind a marker-led run of characters
(checked on load), so a text's pieces are those of its marker-led segments.
The distinct segments of a block of texts are encoded once, multithreaded, and their
ids are put together by array indexing. Parity: every distinct segment is also
encoded by the sentencepiece library, and a text's ``parity`` says whether all
its segments agree. A model whose pieces do cross segments, or with a
normaliser other than identity or nmt/nfkc given by the file's own character
map, is encoded text by text.

Edge cases: null and empty texts have no ids and decode to the empty text; every
text of an identity model without a literal marker decodes to itself; very long texts are cut at
segments only; repeated rows are encoded alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textblocks import blocks, bounded_batches, settled, without

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_BLOCK = 1 << 20
#: Segments (of at most so many characters) that a worker's codec remembers with their ids and parity.
CACHED_SEGMENTS, CACHED_LENGTH = 1 << 16, 32
# fixed values of the file format: model types and piece kinds
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: numbers as int, all else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        v = shift = 0
        while True:
            b = raw[at]
            at += 1
            v |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return v

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


class Model:
    """The parts of a SentencePiece model file."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.pieces: list[tuple[str, float, int]] = []
        self.type, self.byte_fallback, self.unk = UNIGRAM, False, 0
        self.dummy_prefix, self.trim, self.escape, self.charsmap, self.suffix = True, True, True, b"", False
        for number, v in _fields(raw):
            if number == 1:  # a piece: text, score, kind
                f = dict(_fields(v))
                self.pieces.append((f.get(1, b"").decode(), float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]), f.get(3, NORMAL)))
            elif number == 2:  # the trainer's settings
                f = dict(_fields(v))
                self.type, self.byte_fallback, self.suffix = f.get(3, UNIGRAM), bool(f.get(35, 0)), bool(f.get(24, 0))
            elif number == 3:  # the normaliser's settings
                f = dict(_fields(v))
                self.charsmap = f.get(2, b"")
                self.dummy_prefix, self.trim, self.escape = (bool(f.get(i, 1)) for i in (3, 4, 5))
        self.unk = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        plain = [p for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED)]
        self.by_segment = not self.charsmap and not self.trim and self.escape and not self.suffix and not any(MARK in p.lstrip(MARK) for p in plain)
        self.user_defined = any(kind == USER_DEFINED for _, _, kind in self.pieces)

    def tokenizer(self):
        """The same model in the tokenizers library."""
        from tokenizers import Tokenizer, decoders, models, normalizers

        if self.type == UNIGRAM:
            t = Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], self.unk, self.byte_fallback))
        elif self.type == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            usable = {p for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED)}
            merges = []
            for i, (p, s, kind) in enumerate(self.pieces):
                if kind == NORMAL:
                    merges += [(-s, i, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
            t = Tokenizer(models.BPE(vocab, [m[2:] for m in sorted(merges)], unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback))
        else:
            raise ValueError(f"model type {self.type} is not supported")
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim:
            steps += [normalizers.Strip(), normalizers.Replace(_regex(" {2,}"), " ")]
        if self.dummy_prefix and not self.by_segment:
            steps.append(normalizers.Prepend(MARK))
        if self.escape and not self.by_segment:
            steps.append(normalizers.Replace(" ", MARK))
        if steps:
            t.normalizer = normalizers.Sequence(steps)
        strip = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        return t


def _regex(pattern: str):
    from tokenizers import Regex

    return Regex(pattern)


_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Codec:
    """Encodes and decodes lists of texts."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = Model(raw)
        self.tok = self.model.tokenizer()
        self.other = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.byte = [kind == BYTE for _, _, kind in self.model.pieces]
        self.known: dict[str, tuple[tuple[int, ...], bool]] = {}
        self.alone = [self.other.piece_to_id(MARK)]  # the library looks through all pieces for it

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        s = (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        if not self.model.by_segment:
            return [s]
        if MARK * 2 not in s and s.startswith(MARK):
            return [MARK + x for x in s.split(MARK)[1:]]
        return _SEGMENT.findall(s)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, row offsets, and each text's parity."""
        if not self.model.by_segment:
            ids = [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]
            same = np.array([a == b for a, b in zip(ids, self.other.encode(texts), strict=True)], bool)
            flat = np.array([i for x in ids for i in x], np.int32)
            return flat, np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64), same
        place: dict[str, int] = {}
        rows = [np.fromiter((place.setdefault(s, len(place)) for s in self.segments(t)), np.int64) for t in texts]
        known = self.known
        new = [s for s in place if s not in known]
        here = dict(zip(new, self._encode_segments(new), strict=True))
        for s, x in here.items():
            if len(known) >= CACHED_SEGMENTS:
                break
            if len(s) <= CACHED_LENGTH:
                known[s] = x
        both = [here[s] if s in here else known[s] for s in place]
        ids, same = [x for x, _ in both], np.array([x for _, x in both], bool)
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        of = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        n = size[of]
        ends = np.cumsum(n)
        out = flat[np.repeat(start[of] - (ends - n), n) + np.arange(int(n.sum()))] if len(of) else np.zeros(0, np.int32)
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        offs = np.concatenate([[0], ends])[at]
        wrong = np.concatenate([[0], np.cumsum(~same[of])])[at] if len(of) else np.zeros(len(texts) + 1)
        return out, offs.astype(np.int64), np.diff(wrong) == 0

    def _encode_segments(self, segments: list[str]) -> list[tuple[tuple[int, ...], bool]]:
        """Ids of distinct segments, and whether the other library has the same."""
        ids = [tuple(e.ids) for e in self.tok.encode_batch(segments, add_special_tokens=False)]
        # the library puts a marker in front of each, so each goes in without its first one
        prefix = self.model.dummy_prefix
        bare = [s[1:].replace(MARK, " ") if prefix and s.startswith(MARK) else s.replace(MARK, " ") for s in segments]
        theirs = self.other.encode(bare, num_threads=1)
        return [(a, list(a) == (b if s or not prefix else self.alone)) for a, b, s in zip(ids, theirs, bare, strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)

    def decode_flat(self, flat: np.ndarray, offs: np.ndarray) -> list[str]:
        """The decoder's steps on whole arrays: pieces to bytes, markers to spaces, one leading space off."""
        table, size, start = self._bytes()
        n = size[flat]
        ends = np.cumsum(n)
        raw = table[np.repeat(start[flat] - (ends - n), n) + np.arange(int(n.sum()))].tobytes() if len(flat) else b""
        cut = np.concatenate([[0], ends])[offs].tolist()
        strip = self.model.dummy_prefix
        out = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            s = raw[a:b].decode("utf-8", "replace")
            out.append(s[1:] if strip and s.startswith(" ") else s)
        return out

    @lru_cache(maxsize=1)  # noqa: B019  one codec lives as long as its worker
    def _bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        size = np.array([len(p) for p in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), size, np.concatenate([[0], np.cumsum(size)])[:-1]


@lru_cache(maxsize=2)
def _codec(raw: bytes) -> Codec:
    return Codec(raw)


def read_model(docs: DataFrame, path: str) -> bytes:
    """The model file, read by the driver (a file of a few hundred kB)."""
    if "://" in path:
        return bytes(docs.sparkSession.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """``docs`` with n_tokens, ids, parity and round_trip (the ids decode to the text) added."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_model(docs, model))
    docs = without(docs, "n_tokens", "ids", "parity", "round_trip")
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            for i, j in blocks(sizes, _BLOCK):
                ids, offs, parity = codec.encode(texts[i:j])
                back = codec.decode_flat(ids, offs)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(i, j - i) for c in names), pa.array(np.diff(offs)),
                        pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids, pa.int32())),
                        pa.array(parity), pa.array([a == b for a, b in zip(back, texts[i:j], strict=True)]),
                    ],
                    names=[*names, "n_tokens", "ids", "parity", "round_trip"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(settled(scan), f"{fields}, n_tokens long, ids array<int>, parity boolean, round_trip boolean")


def decode(rows: DataFrame, model: str = DEFAULT_MODEL, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded`` added: the text of each row's ids (null ids: empty)."""
    bounded_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(read_model(rows, model))
    rows = without(rows, "decoded")
    names = rows.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            texts = codec.decode([x or [] for x in batch.column(ids).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(settled(scan), f"{fields}, decoded string")
