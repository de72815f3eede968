"""Byte-level BPE encoding and decoding with a sentencepiece model serialised straight from a rank file.

Every vocabulary entry becomes a piece whose bytes are written as the characters of the usual byte map, scored by its
negative rank, with identity normalisation: sentencepiece then joins the pair of lowest rank first, as the rank file
asks. Pre-tokens are encoded one by one; an entry that equals a whole pre-token is taken as it is. Decoding maps the
ids back to their bytes.

Defined cases: a null or empty text has no ids and decodes to no bytes; texts of any length are encoded whole; equal
rows give equal rows; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows of a result batch, and pre-tokens whose ids a task remembers before it starts afresh.
ROWS, REMEMBERED = 500, 200_000


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file, read on the driver: its entries in rank order, from 0 without gaps."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    vocabulary = sorted(ranks, key=ranks.get)
    if [ranks[v] for v in vocabulary] != list(range(len(vocabulary))):
        raise ValueError("ranks have gaps")
    return vocabulary


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: the unknown piece, then one normal piece per entry (its id is rank + 1)."""
    letters = byte_characters()
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for rank, entry in enumerate(vocabulary):
        piece = "".join([letters[b] for b in entry]).encode()
        out.append(_field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(vocabulary) + 1) + _field(40, 0) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Encoder:
    """Encodes pre-tokens; remembers the ids of those it has seen."""

    def __init__(self, vocabulary: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.vocabulary, self.whole = vocabulary, {entry: rank for rank, entry in enumerate(vocabulary)}
        self.split = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.letters = byte_characters()
        self.seen: dict[str, list[int]] = {}

    def ids(self, token: str) -> list[int]:
        raw = token.encode()
        rank = self.whole.get(raw)
        found = [rank] if rank is not None else [i - 1 for i in self.pieces.encode("".join([self.letters[b] for b in raw]))]
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[token] = found
        return found

    def encode(self, text: str) -> list[int]:
        seen, out = self.seen, []
        for token in self.split(text):
            out += seen.get(token) or self.ids(token)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (with text) and two columns: ids, and decoded, the bytes that those ids stand for.

    path names a rank file the driver can read; vocabulary and model, of fixed size, travel with the tasks.
    """
    vocabulary = read_ranks(path)
    model = docs.sparkSession.sparkContext.broadcast((vocabulary, serialise_model(vocabulary)))
    plain = docs.drop("ids", "decoded")
    schema = T.StructType([*plain.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*model.value, pattern)
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                ids = [encoder.encode(t or "") for t in part.column("text").to_pylist()]
                columns = [pa.array(ids, pa.list_(pa.int32())), pa.array(map(encoder.decode, ids), pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "ids", "decoded"])

    return plain.mapInArrow(run, schema)
