"""Byte-level BPE over Arrow batches: exact ids of a rank file, offsets, and decoding to bytes.

The ranks become a model of the tokenizers library: every byte has a printable character (the
usual byte-to-character table), a token's merges are all ways to cut it into two tokens, and
their order is the rank of the result, which is the order in which ranks merge.  A text is cut
before white-space runs, which no match of the pattern crosses, so a repeated unit is encoded
once and its ids are kept.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer, models, pre_tokenizers

from .arrow_text import slices, sums_by, text_buffer, units_of
from .bpe_words import IdStore, flat_ids
from .scratch import ensure_columns, read_table

#: White space beyond ASCII; texts that hold any are cut by the pattern alone.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]")
JOINED = 512
SLICE = 4 << 20


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(0x100 + extra)
            extra += 1
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}


class ByteBpe:
    """Encoder and decoder for a file of ranks; ``pattern`` cuts a text before merging."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        characters = byte_characters()
        self.table = str.maketrans({chr(b): c for b, c in enumerate(characters)})
        show = lambda t: t.decode("latin-1").translate(self.table)
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(token)):
                if token[:i] in ranks and token[i:] in ranks:
                    merges.append((show(token[:i]), show(token[i:])))
        model = models.BPE({show(t): r for t, r in ranks.items()}, merges, ignore_merges=True)
        self.bpe = Tokenizer(model)
        self.bpe.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.pattern = regex.compile(pattern)
        self.store = IdStore(600_000)
        self.token_at = np.zeros(max(ranks.values()) + 2, np.int64)
        by_id = sorted(ranks.items(), key=lambda x: x[1])
        for token, r in by_id:
            self.token_at[r + 1] = len(token)
        self.token_at = np.cumsum(self.token_at)
        self.token_bytes = np.frombuffer(b"".join(t for t, _ in by_id), np.uint8)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row, and each piece's number of ids."""
        shown = [x.encode().decode("latin-1").translate(self.table) for x in pieces]
        joined = [" ".join(shown[i : i + JOINED]) for i in range(0, len(shown), JOINED)]
        ids = flat_ids(self.bpe.encode_batch_fast(joined, add_special_tokens=False))
        ends = np.cumsum(np.fromiter(map(len, shown), np.int64, len(shown)))
        upto = np.searchsorted(np.cumsum(self.lengths(ids)), ends, side="right")
        return ids, np.diff(upto, prepend=0)

    def encode_new(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        cut = [self.pattern.findall(u.decode()) for u in units]
        places: dict[str, int] = {}
        codes = np.fromiter((places.setdefault(p, len(places)) for x in cut for p in x), np.int64)
        per_unit = np.fromiter(map(len, cut), np.int64, len(cut))
        ids, counts = self.encode_pieces(list(places))
        at = np.concatenate([[0], np.cumsum(counts)])
        lengths = counts[codes]
        end = np.cumsum(lengths)
        total = int(end[-1]) if len(end) else 0
        flat = ids[np.repeat(at[codes] - end + lengths, lengths) + np.arange(total)]
        return sums_by(np.concatenate([[0], np.cumsum(per_unit)]), lengths), flat

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a batch in a row, and each text's number of ids."""
        whole = np.zeros(len(offsets) - 1, dtype=bool)
        raw = data.tobytes()
        for m in WIDE_SPACE.finditer(raw):
            whole[np.searchsorted(offsets, m.start(), side="right") - 1] = True
        units = units_of(data, offsets, whole)
        codes, distinct = units.encoded()
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        ids, counts = self.store.spread(self.store.rows(distinct, self.encode_new)[codes])
        return ids, sums_by(units.docs, counts)

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of each id."""
        return self.token_at[ids + 1] - self.token_at[ids]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for; a character may be split between ids."""
        lengths = self.lengths(ids)
        end = np.cumsum(lengths)
        total = int(end[-1]) if len(end) else 0
        return self.token_bytes[np.repeat(self.token_at[ids] - end + lengths, lengths) + np.arange(total)]

    def decode_text(self, ids: np.ndarray) -> str:
        """Decoded text; bytes that are no whole character become U+FFFD."""
        return self.decode(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")


def encode_batches(path: str, pattern: str, output: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe = ByteBpe(path, pattern)
        for batch in slices(batches, "text", SLICE):
            data, offsets = text_buffer(batch.column(1))
            ids, counts = bpe.encode(data, offsets)
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64())}
            at = np.concatenate([[0], np.cumsum(counts)])
            if output == "digests":
                little = ids.astype("<u4")
                decoded = bpe.decode(ids)
                ends = np.concatenate([[0], np.cumsum(bpe.lengths(ids))])[at]
                hashed = lambda x, cuts: [hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                columns["ids_sha256"] = pa.array(hashed(little, at), pa.string())
                columns["decoded_sha256"] = pa.array(hashed(decoded, ends), pa.string())
            elif output == "ids":
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                before = np.concatenate([[0], np.cumsum(bpe.lengths(ids))])
                begin = before[:-1] - np.repeat(before[at[:-1]], counts)
                columns["ids"] = lists
                columns["starts"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(begin.astype(np.int64)))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def decode_batches(path: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path, pattern)
        for batch in batches:
            lists = batch.column(1)
            texts = [None if x is None else bpe.decode_text(x) for x in lists.to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return run


def defaults(path: str | None, pattern: str | None, name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path(name), pattern or public_tokenizers.PATTERN


SCHEMAS = {
    "ids": "doc_id long, n_tokens long, ids array<int>, starts array<long>",
    "digests": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    "counts": "doc_id long, n_tokens long",
}


def encode(docs: DataFrame, output: str = "ids", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes whole texts: ids with the byte at which each starts, or their digests or number.

    A row for each input row, repeated ones too; a null text counts as empty and has no ids; a
    null doc_id stays null; further columns are ignored.
    """
    path, cut = defaults(ranks_path, pattern)
    return ensure_columns(docs, doc_id="long", text="string").mapInArrow(encode_batches(path, cut, output), SCHEMAS[output])


def decode(encoded: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Texts of rows with doc_id and ids; null ids give a null text."""
    path, cut = defaults(ranks_path, pattern)
    return encoded.select("doc_id", "ids").mapInArrow(decode_batches(path, cut), "doc_id long, text string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every row of ``documents``; null counts as
    empty, repeated rows are encoded each, and an empty table gives no rows."""
    return encode(read_table(spark, sf_dir, "documents"), "digests")
