"""Byte-level BPE through a sentencepiece model that is written straight from a vocabulary of ranks.

Every byte gets a printable character, each token becomes the piece of its bytes' characters with the score
-rank, and the model does no normalisation.  sentencepiece merges the pair of the highest score first, which is the pair of
the lowest rank, so a pre-token gets the ids that the ranks prescribe.  A pre-token that is itself a token is that
token, as rank encoders have it.  Decoding maps ids back to bytes.  Nothing is trained.

The model file is a protocol buffer of a few field types, written here by hand.

Defined results: a null text is empty: no ids, and the digests are those of no bytes; every input row gets its row; an empty table gives
an empty result; further columns are ignored by ``encode`` and not needed.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_cache import vocabulary_path

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens whose ids a worker remembers, and the longest that it does.
REMEMBER = 300_000
REMEMBER_CHARS = 64
#: Rows that are coded at a time.
SLICE = 256
#: Field numbers and values of the sentencepiece model format (fixed values).
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _SCORE, _TYPE = 1, 2, 3
_UNKNOWN = 2
_MODEL_TYPE, _BPE, _VOCAB_SIZE, _UNK_ID, _BOS_ID, _EOS_ID, _PAD_ID = 3, 2, 4, 40, 41, 42, 43
_NAME, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES = 1, 3, 4, 5


def byte_characters() -> dict[int, str]:
    """A printable character for each byte: itself if printable Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _int(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _float(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", x)


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model.  Piece i is the token of rank i; the unknown piece comes last and is never produced."""
    chars = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without gaps and hold all single bytes")
    out = [_bytes(_PIECES, _bytes(_PIECE, "".join(chars[b] for b in token).encode()) + _float(_SCORE, -rank)) for token, rank in by_rank]
    out.append(_bytes(_PIECES, _bytes(_PIECE, b"<unk>") + _float(_SCORE, 0.0) + _int(_TYPE, _UNKNOWN)))
    n = len(by_rank)
    out.append(_bytes(_TRAINER, _int(_MODEL_TYPE, _BPE) + _int(_VOCAB_SIZE, n + 1) + _int(_UNK_ID, n) + b"".join(_int(f, -1) for f in (_BOS_ID, _EOS_ID, _PAD_ID))))
    out.append(_bytes(_NORMALIZER, _bytes(_NAME, b"identity") + b"".join(_int(f, 0) for f in (_DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES))))
    return b"".join(out)


class Codec:
    """Encodes and decodes with one vocabulary; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(ranks_path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.find = regex.compile(pattern).findall
        self.chars = byte_characters()
        self.tokens = np.empty(len(self.ranks), object)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each of the pieces, all new."""
        out, ask = {}, []
        for p in pieces:
            rank = self.ranks.get(p.encode())
            if rank is None:
                ask.append(p)
            else:
                out[p] = struct.pack("<I", rank)
        mapped = [p.encode().decode("latin-1").translate(self.chars) for p in ask]
        for p, ids in zip(ask, self.model.encode(mapped, num_threads=1) if ask else [], strict=True):
            out[p] = np.asarray(ids, "<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        pieces = self.find(text)
        known = self.known
        new = self._learn([p for p in set(pieces) if p not in known])
        if len(known) + len(new) > REMEMBER:
            new |= {p: known[p] for p in set(pieces) if p in known}
            known.clear()
            ids = b"".join([new[p] for p in pieces])
        elif any(len(p) > REMEMBER_CHARS for p in new):
            ids = b"".join([known[p] if p in known else new[p] for p in pieces])
        else:
            known.update(new)
            return b"".join([known[p] for p in pieces])
        if len(new) <= REMEMBER:
            known.update((p, i) for p, i in new.items() if len(p) <= REMEMBER_CHARS)
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.tokens[np.frombuffer(ids, "<u4")].tolist())


def _coder(ranks: str, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        codec = None
        for b in batches:
            codec = codec or Codec(vocabulary_path(ranks), public_tokenizers.PATTERN)
            # In slices, so that a worker holds the ids of few texts at a time.
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                counts, ids_hash, back_hash, all_ids = [], [], [], []
                for t in part.column("t"):
                    ids = codec.encode(t.as_py())
                    counts.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    back_hash.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                columns = [part.column("id"), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(back_hash, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(all_ids), "<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return code


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ranks: str = RANKS, with_ids: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, digests of the ids and of the decoded bytes, and the ids themselves if asked for.

    One pass without a shuffle; a worker holds one batch of texts and a bounded memory of pre-tokens.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    out = d.mapInArrow(_coder(ranks, with_ids), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)
