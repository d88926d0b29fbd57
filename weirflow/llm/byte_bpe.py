"""Byte-level BPE encoding and decoding with the tokenizers library.

A rank file becomes a tokenizer whose alphabet writes each byte as one printable
character. Merges come from the ranks: every way to cut a token in two known
tokens is a merge, in the order of the token's rank, since the lowest rank is
merged first whichever its halves are; a stretch that is itself a token is taken
whole. Decoding writes each id's token in the alphabet and reads its characters back
through the reversed byte table; as ids may end in the middle of a character, bytes
are only read as text once all are together.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunked_bpe import LED, ChunkedEncoder, Tokenizer
from .common import text_rows


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where printable, else the next free from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    plain = set(shown)
    return [chr(b) if b in plain else chr(next(hidden)) for b in range(256)]


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizers file for a rank file and the pattern that cuts texts before merging."""
    of = byte_characters()
    written = {t: "".join(map(of.__getitem__, t)) for t in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        for i in range(1, len(token)):
            a, b = token[:i], token[i:]
            if a in ranks and b in ranks and ranks[a] < ranks[token] and ranks[b] < ranks[token]:
                merges.append([written[a], written[b]])
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        ]},
        "post_processor": None,
        "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {written[t]: r for t, r in ranks.items()}, "merges": merges},
    })


class ByteCodec:
    """Encoder and decoder of one rank file."""

    def __init__(self, spec: str):
        self.encoder = ChunkedEncoder(Tokenizer.from_str(spec), LED)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = self.encoder.tokenizer.get_vocab()
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for written, i in vocabulary.items():
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, written))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array of unsigned 32-bit integers, and where each text's begin in it."""
        return self.encoder.encode_batch(texts)

    def encode_with_offsets(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """(ids, first characters, ends) of a text's tokens; a token of part of a character has that character's span. Stretches go in one after another, so memory is theirs."""
        ids, first, ends, at = [], [], [], 0
        for stretch in self.encoder.stretch.findall(text):
            got = self.encoder.tokenizer.encode(stretch, add_special_tokens=False)
            ids += got.ids
            first += [at + a for a, _ in got.offsets]
            ends += [at + b for _, b in got.offsets]
            at += len(stretch)
        return ids, first, ends

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that make no character become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


_codecs: dict[tuple[str, str], ByteCodec] = {}


def codec(path: str, pattern: str, spec: str | None = None) -> ByteCodec:
    """The worker's codec of a rank file, built once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteCodec(spec or tokenizer_json(read_ranks(path), pattern))
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, and where each token begins and ends (``starts``, ``ends``, in code points) of each whole text.

    Null is empty and has no ids. Repeated rows are encoded each; other columns are
    ignored. An empty table gives an empty result.
    """
    rows = text_rows(docs, id_col, text_col)
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern, spec.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                got = [c.encode_with_offsets(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[k] for g in got], pa.list_(pa.int32())) for k in range(3))], names=["doc_id", "ids", "starts", "ends"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            texts = [c.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: each whole text encoded, and its ids decoded.

    The ids are hashed as little-endian unsigned 32-bit integers. A null text is
    empty: no tokens, hashes of nothing.
    """
    rows = text_rows(docs, id_col, text_col)
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern, spec.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                got, cuts = c.encode(batch.column(1).to_pylist())
                parts = [got[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                n = np.diff(cuts)
                ids = [sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts]
                decoded = [sha256(c.decode_bytes(p)).hexdigest() for p in parts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
