"""Encoding a corpus with a public byte-level BPE vocabulary.

The vocabulary is serialised as a sentencepiece BPE model: each token's bytes are mapped to printable
characters, its score is its negative rank, and normalisation is the identity. Texts are cut into pre-tokens,
each of which the model merges on its own; decoding is the inverse mapping.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Default place of the vocabulary files; a parameter of every function that reads one.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the public pattern that cuts texts into pre-tokens, white space by its Unicode property.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_UNK = "<unk>"


def byte_characters() -> dict[int, str]:
    """A printable character for each byte: itself where printable in Latin-1, else one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank of a ``.tiktoken`` file."""
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"{path}: ranks are not 0, 1, 2, ...")
    return [token for _, token in ranked]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | str) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model file whose piece ids are the ranks; the unknown piece comes after the last."""
    chars = byte_characters()
    pieces = [_field(1, _field(1, "".join(chars[b] for b in t)) + _varint(2 << 3 | 5) + struct.pack("<f", -float(i))) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, _UNK) + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2)))
    n = len(tokens)
    minus_one = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, minus_one) + _field(42, minus_one) + _field(43, minus_one) + _field(45, _UNK)
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encodes texts to ids and back; keeps the ids of recent pre-tokens."""

    def __init__(self, model: bytes, remembered: int = 200_000) -> None:
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(PRETOKEN).findall
        self.table = str.maketrans({chr(b): c for b, c in byte_characters().items()})
        self.known: dict[str, list[int]] = {}
        self.remembered = remembered

    def _learn(self, words: list[str]) -> None:
        mapped = [w.encode("utf-8", "replace").decode("latin-1").translate(self.table) for w in words]
        self.known.update(zip(words, self.model.encode(mapped, num_threads=1)))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty or null text has none."""
        if not text:
            return []
        words = self.cut(text)
        new = list({w for w in words if w not in self.known})
        if new:
            if len(self.known) > self.remembered:
                self.known = {}
                new = list(set(words))
            self._learn(new)
        known = self.known
        return [i for w in words for i in known[w]]

    def decode(self, ids: list[int]) -> str:
        back = {c: b for b, c in byte_characters().items()}
        return bytes(back[c] for i in ids for c in self.model.id_to_piece(int(i))).decode("utf-8", "replace")


def encode_documents(documents: DataFrame, vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row: the ids of its text, without special tokens.

    Texts that look like special tokens are plain text; empty and null texts give an empty list. One row per
    input row, repeated and null keys included. The model (about a megabyte) is built once on the driver and
    sent with the task; a whole text is encoded however long it is.
    """
    model = serialise_model(read_ranks(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(model)
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.iloc[i : i + 500]
                yield pd.DataFrame({key: part[key], "ids": [encoder.encode(t) for t in part[text]]})

    schema = f"{key} {dict(documents.dtypes)[key]}, ids array<int>"
    return spread(documents.select(key, F.col(text))).mapInPandas(run, schema)
