"""p6 - a corpus encoded by a public byte-level BPE vocabulary.

The vocabulary's ranks are serialised as a sentencepiece BPE model: each token's bytes
are written in the printable byte alphabet, its score is the negative rank, and the
normaliser is the identity, so the pieces' merges run in the order of the ranks.
Pre-tokens are encoded one by one (merges never cross them); decoding maps ids back to
bytes. The vocabulary file stays where it is; its path is a parameter.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("GRANARY_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's publisher splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_WORDS = 400_000  # pre-tokens remembered by a worker; more only costs time


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable, else one above U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by rank; ranks must run from 0 without gaps."""
    with open(path, "rb") as lines:
        ranked = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError(f"{path}: ranks have gaps")
    return [ranked[i] for i in range(len(ranked))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    """A protobuf field: a varint, or anything written with its length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the tokens' ranks."""
    alphabet = byte_alphabet()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind))

    body = b"".join(piece("".join(alphabet[b] for b in token), -float(rank), 1) for rank, token in enumerate(tokens))
    unknown = piece("<unk>", 0.0, 2)
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(24, 0) + _field(40, len(tokens))
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))  # no <s>, </s>, <pad>
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + unknown + _field(2, trainer) + _field(3, identity)


class ByteBpe:
    """Encoder and decoder of one vocabulary, with a memory of pre-tokens."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def _learn(self, words: list[str]) -> None:
        spelled = [word.encode().decode("latin-1").translate(self.alphabet) for word in words]
        self.known.update(zip(words, self.model.encode(spelled, num_threads=1)))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, the offsets of each text in them)."""
        parts = [self.split(text) if text else [] for text in texts]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        new = {word for words in parts for word in words if word not in self.known}
        if new:
            self._learn(list(new))
        known, flat, offsets = self.known, [], [0]
        for words in parts:
            for word in words:
                flat += known[word]
            offsets.append(len(flat))
        return np.array(flat, np.int32), np.array(offsets, np.int64)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def _tokenizer(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_corpus(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN
) -> DataFrame:
    """(id, ids): the token ids of every row's whole text, without special tokens.

    An empty and a null text give an empty list. Strings that look like special tokens
    are ordinary text; nothing is trimmed or normalised. Repeated rows and null ids are
    kept, other columns are ignored. Rows are encoded where they lie, without a shuffle.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(vocabulary, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, offsets = bpe.encode_batch(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id", "ids"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, "id bigint, ids array<int>")


def decode_corpus(df: DataFrame, id_col: str = "id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text): the inverse of ``encode_corpus``; a null list gives a null text.

    Null ids inside a list are skipped; an id outside the vocabulary fails the job.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(vocabulary, PATTERN)
        for batch in batches:
            texts = [
                None if ids is None else bpe.decode([i for i in ids if i is not None])
                for ids in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(decode, "id bigint, text string")
