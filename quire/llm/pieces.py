"""SentencePiece encoding that keeps the source bytes of every piece, and decoding.

Normalisation walks the model's compiled character map (a double-array trie and a pool of replacements) by longest
prefix and records, for each normalised byte, the source byte it came from. Pieces are cut in the normalised text, so
each projects to a span of source bytes.

No piece of the usual models has a word mark after another character, so no merge crosses the start of a word. Where
the vocabulary confirms this, each distinct word is segmented once per task and its pieces are reused.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import fresh, slices, text_of

MARK = "▁"
_MARK_BYTES = MARK.encode()


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[tag & 7]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class CharacterMap:
    """A compiled character map: longest-prefix replacement rules over UTF-8 bytes.

    Layout: the size of the trie in bytes, the trie's 32-bit units, then the replacements, each ended by a zero byte.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest rule that matches at a position."""
        if not self.units:
            return None
        found, node = None, self._child(0, self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node = self._child(node, unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])]

    @staticmethod
    def _child(node: int, unit: int) -> int:
        return node ^ (unit >> 10) << ((unit & 0x200) >> 6)


@dataclass
class Settings:
    """What of a model file concerns normalisation and spans."""

    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    suffix: bool = False
    pieces: list[str] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)

    @classmethod
    def read(cls, model: bytes) -> Settings:
        out = cls()
        for number, value in proto_fields(model):
            if number == 1:
                own = dict(proto_fields(value))
                out.pieces.append(own.get(1, b"").decode())
                out.kinds.append(own.get(3, 1))
            elif number == 2:
                out.suffix = bool(dict(proto_fields(value)).get(24, 0))
            elif number == 3:
                own = dict(proto_fields(value))
                out.charsmap = own.get(2, b"")
                out.dummy_prefix, out.remove_extra, out.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
        return out


def normalise(text: str, settings: Settings, rules: CharacterMap) -> tuple[bytes, np.ndarray]:
    """Normalised bytes, and for each of them (and the end) the source byte offset that it starts from."""
    data = text.encode()
    if not rules.units and not settings.remove_extra and not settings.suffix:
        if not data:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)
        width = np.where(raw == 32, 3 if settings.escape else 1, 1)
        lead = (3 if settings.escape else 1) if settings.dummy_prefix else 0
        source = np.concatenate((np.zeros(lead, np.int64), np.repeat(np.arange(len(raw)), width), [len(raw)]))
        mark = _MARK_BYTES if settings.escape else b" "
        return mark * settings.dummy_prefix + data.replace(b" ", mark), source
    mark, out, source, at = (_MARK_BYTES if settings.escape else b" "), bytearray(), [], 0
    steps = []
    while at < len(data):
        rule = rules.longest(data, at)
        if rule is None:
            size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            rule = size, data[at : at + size]
        steps.append((at, rule[1]))
        at += rule[0]
    end = len(data)
    if settings.remove_extra:
        while steps and not steps[0][1].strip(b" "):
            steps.pop(0)
        while steps and not steps[-1][1].strip(b" "):
            end = steps.pop()[0]
    if steps and settings.dummy_prefix and not settings.suffix:
        out += mark
        source += [steps[0][0]] * len(mark)
    spaced = settings.remove_extra
    for begin, piece in steps:
        if settings.remove_extra and spaced:
            piece = piece.lstrip(b" ")
        for c in piece:
            put = mark if c == 32 else bytes((c,))
            out += put
            source += [begin] * len(put)
        if piece:
            spaced = settings.remove_extra and piece.endswith(b" ")
    if settings.remove_extra:
        while out.endswith(mark) and len(out) > len(mark):
            del out[-len(mark) :]
            end = source[-len(mark)]
            del source[-len(mark) :]
    if steps and settings.dummy_prefix and settings.suffix:
        out += mark
        source += [end] * len(mark)
    return bytes(out), np.array([*source, end], np.int64)


class Codec:
    """Encoder and decoder of one model, with a bounded cache of word segmentations."""

    def __init__(self, model: bytes, cache_words: int = 200_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.settings = Settings.read(model)
        self.rules = CharacterMap(self.settings.charsmap)
        s = self.settings
        self.by_word = (
            s.dummy_prefix and s.escape and not s.remove_extra and not s.suffix and not self.rules.units
            and MARK in s.pieces and 6 in s.kinds and 4 not in s.kinds and not any(MARK in p.lstrip(MARK) for p in s.pieces)
        )
        self.sizes = np.array([1 if k == 6 else len(p.encode()) for p, k in zip(s.pieces, s.kinds, strict=True)], np.int64)
        self.cache_words = cache_words
        self.words: dict[str, tuple[tuple[int, ...], str]] = {}
        self.cut = re.compile(f"{MARK}+[^{MARK}]*")

    def batch(self, texts: list[str]) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray]]:
        """For each text: ids, the ids as decimals joined by commas, and begin and end of each piece in source bytes."""
        if not self.by_word:
            for text in texts:
                ids = self.sp.encode(text)
                _, source = normalise(text, self.settings, self.rules)
                known = self.sp.encode(text, out_type=str)
                sizes = [1 if self.settings.kinds[i] == 6 else len(p.encode()) for i, p in zip(ids, known, strict=True)]
                yield ids, ",".join(map(str, ids)), *self._spans(np.array(sizes, np.int64), source)
            return
        cut = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list(set().union(*cut).difference(self.words)) if cut else []
        if len(self.words) + len(new) > self.cache_words:
            self.words.clear()
            new = list(set().union(*cut))
        words = self.words
        # the library puts a mark before its input again; a mark alone would come to nothing there
        for w, ids in zip(new, self.sp.encode([w[1:].replace(MARK, " ") for w in new], num_threads=1) if new else [], strict=True):
            words[w] = (tuple(ids), ",".join(map(str, ids)))
        if MARK in words:
            alone = self.settings.pieces.index(MARK)
            words[MARK] = ((alone,), str(alone))
        for text, parts in zip(texts, cut, strict=True):
            got = [words[p] for p in parts]
            ids = [i for own, _ in got for i in own]
            _, source = normalise(text, self.settings, self.rules)
            yield ids, ",".join([s for _, s in got]), *self._spans(self.sizes[np.fromiter(ids, np.int64, len(ids))], source)

    @staticmethod
    def _spans(sizes: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(sizes)
        if len(ends) and ends[-1] != len(source) - 1:
            raise ValueError("the pieces do not cover the normalised text")
        return source[ends - sizes], source[ends]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("begin", T.ArrayType(T.IntegerType())), T.StructField("end", T.ArrayType(T.IntegerType()))])
DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("spans_sha256", T.StringType())])


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _runs(texts: pa.Array) -> Iterator[list[str]]:
    for part in slices(texts, 2 << 20):
        yield part.to_pylist()


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct ``encoded`` (another name if taken): ids, and begin and end bytes of each piece.

    The model is read once on the driver and its bytes go with the function. Null texts count as empty: no ids.
    """
    from .telephony import to_arrow

    model = _read(model_path)

    @arrow_udf(ENCODED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec, kind = Codec(model), to_arrow(ENCODED)
        for texts in batches:
            yield pa.array([{"ids": ids, "begin": a, "end": b} for part in _runs(texts) for ids, _, a, b in codec.batch(part)], kind)

    (name,) = fresh(docs, "encoded")
    return docs.withColumn(name, run(text_of(text)))


def decode(docs: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``decoded`` (another name if taken), the text of an array of ids; null for null."""
    model = _read(model_path)

    @arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(model)
        for column in batches:
            yield pa.array([None if x is None else codec.decode(x) for x in column.to_pylist()], pa.string())

    (name,) = fresh(docs, "decoded")
    return docs.withColumn(name, run(F.col(ids)))


def digests(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct ``encoded`` (another name if taken) of digests of :func:`encode` and its decoding.

    ``spans_sha256`` is over the begins, then the ends, as little-endian 64-bit integers. Texts stay whole; null counts as
    empty; equal texts give equal digests.
    """
    from .telephony import to_arrow

    model = _read(model_path)

    @arrow_udf(DIGEST)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec, kind = Codec(model), to_arrow(DIGEST)
        hexed = lambda x: hashlib.sha256(x).hexdigest()
        for texts in batches:
            yield pa.array([
                {"n_tokens": len(ids), "ids_sha256": hexed(said.encode()), "decoded_sha256": hexed(codec.decode(ids).encode()), "spans_sha256": hexed(a.tobytes() + b.tobytes())}
                for part in _runs(texts) for ids, said, a, b in codec.batch(part)
            ], kind)

    (name,) = fresh(docs, "encoded")
    return docs.withColumn(name, run(text_of(text)))
