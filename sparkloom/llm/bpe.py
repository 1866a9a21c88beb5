"""Byte-level BPE through a sentencepiece model that is serialised from the vocabulary.

A byte-level vocabulary gives ranks of byte strings.  Each byte becomes one
character (U+0100 + byte), each entry one piece scored by its negative rank, and
the normaliser is the identity; then sentencepiece's best-score-first merging is
the rank-first merging of byte-level BPE, and its ids are the ranks.  Texts are
cut into pre-tokens by the vocabulary's pattern and each is encoded by itself.

Row-local in Python: a scan, one Arrow stage, no shuffle.  A worker keeps the
ids of a bounded number of stretches; long texts are worked through in chunks,
so memory is bounded by one text and its ids.
"""

from __future__ import annotations

import base64
import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.batches import small_batches
from sparkloom.llm.common import table
from sparkloom.llm.stretches import CLOSING, TOGETHER, Stretches, gathered_ranges, regrouped

#: The pattern whose pre-tokens begin at single spaces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Put before such spaces for Arrow to split at; texts that hold it are cut in Python.
MARK = "\x1e"
_SPACE = re.compile(r"(?<=[^ \t\n\v\f\r]) (?=[^ \t\n\v\f\r])")
#: Fixed values of sentencepiece's model file: field numbers and enum values of its public schema.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, BPE = 1, 2, 2
#: The character of byte 0.
BASE = 0x100


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _int(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARS)


_TO_CHARS = {b: BASE + b for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: a base64 byte string and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def serialised(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model; the id of a piece is its rank, and unknown (never used: all bytes are pieces) comes last."""
    order = sorted(ranks, key=ranks.get)
    if [ranks[x] for x in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without gaps")
    if missing := {bytes([b]) for b in range(256)} - ranks.keys():
        raise ValueError(f"{len(missing)} bytes are no entries of the vocabulary")
    pieces = [_bytes(PIECES, _bytes(1, mapped(x).encode()) + b"\x15" + struct.pack("<f", -k) + _int(3, NORMAL)) for k, x in enumerate(order)]
    unknown = _bytes(PIECES, _bytes(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _int(3, UNKNOWN))
    trainer = _int(3, BPE) + _int(4, len(order) + 1) + _int(40, len(order))
    normalizer = _bytes(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0)
    return b"".join(pieces) + unknown + _bytes(TRAINER, trainer) + _bytes(NORMALIZER, normalizer)


class Codec:
    """Encodes and decodes whole texts.

    With PATTERN, a single space between two other characters that aren't white
    space begins a pre-token, and so does closing punctuation after a letter or
    digit; texts are cut there and each distinct stretch is encoded once.  With
    another pattern a stretch is a text.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=serialised(ranks))
        self.pattern = regex.compile(pattern)
        self.cuttable = pattern == PATTERN
        own = sorted(ranks, key=ranks.get)
        self.bytes_of = np.frombuffer(b"".join(own), np.uint8)
        self.sizes = np.fromiter(map(len, own), np.int64, len(own))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.stretches = Stretches(self._learn)

    def _learn(self, stretches: list[str]) -> list[bytes]:
        """Each pre-token of each stretch is encoded by itself."""
        cut = [self.pattern.findall(x) for x in stretches]
        ids = iter(self.pieces.encode([mapped(t.encode()) for x in cut for t in x], num_threads=1))
        return [np.array([i for _ in x for i in next(ids)], "<u4").tobytes() for x in cut]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.ids_of(pa.array([text], pa.string()))[0].tobytes()

    def ids_of(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; together they are a few MB, or one long text, which is worked through in chunks."""
        if not self.cuttable:
            return [np.frombuffer(self._learn([t])[0], "<u4") for t in texts.to_pylist()]
        if len(texts) == 1 and len(text := texts[0].as_py()) > TOGETHER:
            return [np.concatenate([x for c in _chunks(text) for x in self._ids(pa.array([c], pa.string()))])]
        return self._ids(texts)

    def _ids(self, texts: pa.Array) -> list[np.ndarray]:
        if pc.any(pc.match_substring(texts, MARK)).as_py():
            return self.stretches.ids(pa.array([_SPACE.sub(MARK + " ", t).split(MARK) if MARK not in t else [t] for t in texts.to_pylist()], pa.list_(pa.string())))
        marked = pc.replace_substring_regex(texts, CLOSING, rf"\1{MARK}\2\3")
        return self.stretches.ids(pc.split_pattern(pc.replace_substring_regex(marked, r"([^ \t\n\v\f\r]) ([^ \t\n\v\f\r])", rf"\1{MARK} \2"), MARK))

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        at = np.frombuffer(ids, "<u4")
        return gathered_ranges(self.bytes_of, self.starts[at], self.sizes[at]).tobytes()


def _chunks(text: str) -> Iterator[str]:
    """Chunks of about TOGETHER characters that end before such a space; a longer stretch without one is one chunk."""
    at = 0
    while len(text) - at > TOGETHER and (m := _SPACE.search(text, at + TOGETHER)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One a worker and vocabulary."""
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", decoded: bool = False) -> DataFrame:
    """keep's columns and ids (binary: little-endian unsigned 32-bit); with decoded also the bytes that the ids decode to.

    Null text counts as empty: no ids.  Repeated rows are encoded alike; an empty
    table gives an empty result; columns that aren't in keep are dropped.
    """
    small_batches(docs.sparkSession)
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    out = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "_text"] + ["ids binary"] + ["decoded binary"] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in regrouped(batches, len(keep)):
            found = c.ids_of(b.column(len(keep)))
            columns = [pa.array([x.tobytes() for x in found], pa.binary())]
            if decoded:
                columns.append(pa.array([c.decode(x) for x in found], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *columns], names=[*keep, "ids"] + ["decoded"] * decoded)

    return d.mapInArrow(run, ", ".join(out))


def decode(tokens: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """keep's columns and decoded, the bytes of ids; null ids decode to nothing."""
    d = tokens.select(*keep, F.coalesce(F.col(ids), F.lit(b"")).alias("_ids"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "_ids"] + ["decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array([c.decode(x.as_py()) for x in b.column(len(keep))], pa.binary())], names=[*keep, "decoded"])

    return d.mapInArrow(run, schema)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    e = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return e.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
