"""Token ids of distinct words, so that a word is encoded once for each batch of new words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer, pre_tokenizers

from .arrow_text import LOWER, Words, sums_by

JOINED = 256
#: Fixed value: the pattern of ``word_bpe_49k.json``.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class IdStore:
    """Ids of words seen so far by this worker; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 800_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def rows(self, words: pa.Array, encode) -> np.ndarray:
        """Row of each word; encode(list of new words) returns their lengths and their ids in a row."""
        if len(self.known) + len(words) > self.most:
            self.clear()
        asked = words.to_pylist()
        new = [w for w in asked if w not in self.known]
        if new:
            lengths, flat = encode(new)
            base = len(self.known)
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
            self.flat = np.concatenate([self.flat, flat])
        return np.fromiter(map(self.known.__getitem__, asked), np.int64, len(asked))

    def spread(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a row of words, and each word's number of ids."""
        begin, lengths = self.at[rows], self.at[rows + 1] - self.at[rows]
        end = np.cumsum(lengths)
        total = int(end[-1]) if len(end) else 0
        return self.flat[np.repeat(begin - end + lengths, lengths) + np.arange(total)], lengths


def flat_ids(encodings) -> np.ndarray:
    ids = [e.ids for e in encodings]
    return np.fromiter((i for x in ids for i in x), np.int32, sum(map(len, ids)))


class WordEndBpe:
    """A lower-casing BPE whose tokens mark the ends of words, as in ``word_bpe_49k.json``.

    White space never survives in it, so words are encoded one by one.  Plain ASCII words are
    cut here at changes between letters, digits and the rest, as its pattern cuts them; other
    words, and those with an apostrophe, pass its normalizer and pattern, or the whole pipeline.
    Words that hold an added token, as ``<|endoftext|>``, always pass the whole, which gives them
    the token's id as the library does by default.
    """

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        self.parts = Tokenizer.from_file(path)
        self.parts.encode_special_tokens = True
        self.added = regex.compile("|".join(regex.escape(t.content) for t in self.full.get_added_tokens_decoder().values()) or r"(?!)")
        self.parts.normalizer = None
        self.parts.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.full.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        kind = np.full(256, 3, np.uint8)
        kind[48:58] = 2
        kind[65:91] = kind[97:123] = 1
        kind[0x80:] = kind[ord("'")] = kind[0:0x20] = kind[0x7F] = 4
        self.kind = kind
        self.store = IdStore()

    def encode_words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and each word's number of ids."""
        codes, distinct = words.encoded()
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return self.store.spread(self.store.rows(distinct, self.encode_new)[codes])

    def encode_new(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        array = pa.array(new, pa.large_binary())
        offsets = np.frombuffer(array.buffers()[1], np.int64)[: len(new) + 1]
        data = LOWER[np.frombuffer(array.buffers()[2], np.uint8)]
        kind = self.kind[data]
        plain = sums_by(offsets, kind == 4) == 0
        plain &= ~np.fromiter((b"<|" in w for w in new), bool, len(new))
        odd = np.flatnonzero(~plain)
        lengths = np.zeros(len(new), np.int64)
        cut = np.ones(len(data), dtype=bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        cut[offsets[:-1]] = True
        inside = np.repeat(plain, np.diff(offsets))
        starts = np.flatnonzero(cut & inside)
        pieces = sums_by(offsets, cut & inside)
        piece_lengths = np.diff(np.append(np.flatnonzero(cut), len(data)))[inside[cut]]
        at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(piece_lengths, out=at[1:])
        parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[inside])))
        coded = parts.dictionary_encode()
        part_ids, part_lengths = self.encode_parts(coded.dictionary.to_pylist())
        part_at = np.concatenate([[0], np.cumsum(part_lengths)])
        codes = coded.indices.to_numpy()
        counts = part_lengths[codes]
        end = np.cumsum(counts)
        total = int(end[-1]) if len(end) else 0
        plain_flat = part_ids[np.repeat(part_at[codes] - end + counts, counts) + np.arange(total)]
        bounds = np.concatenate([[0], np.cumsum(pieces[plain])])
        lengths[plain] = sums_by(bounds, counts)
        odd_lengths, odd_flat = self.encode_odd([new[i].decode("utf-8", "replace") for i in odd])
        lengths[odd] = odd_lengths
        flat = np.zeros(int(lengths.sum()), np.int32)
        from_plain = np.repeat(plain, lengths)
        flat[from_plain] = plain_flat
        flat[~from_plain] = odd_flat
        return lengths, flat

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = [" ".join(parts[i : i + JOINED]) for i in range(0, len(parts), JOINED)]
        ids = flat_ids(self.parts.encode_batch_fast(joined, add_special_tokens=False))
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(parts):
            raise ValueError("a part of a word gave no end of word")
        return ids, np.diff(np.concatenate([[0], ends]))

    def encode_odd(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        """Words with Latin letters are cut by the pattern after the tokenizer's own normalizer."""
        normal = self.full.normalizer.normalize_str(" ".join(words)).split(" ")
        if len(normal) != len(words):
            return self.encode_whole(words)
        rest = {i: w for i, w in enumerate(words) if max(w) >= "\u0250" or max(normal[i], default="") >= "\u0250" or self.added.search(w)}
        cut = [[w] if w.isalpha() else [] if i in rest else PATTERN.findall(w) for i, w in enumerate(normal)]
        for i in rest:
            cut[i] = []
        parts = list(dict.fromkeys(p for x in cut for p in x))
        ids, part_lengths = self.encode_parts(parts)
        ends = np.cumsum(part_lengths).tolist()
        flat = ids.tolist()
        of = {p: flat[e - n : e] for p, e, n in zip(parts, ends, part_lengths.tolist(), strict=True)}
        out = [of[x[0]] if len(x) == 1 else [i for p in x for i in of[p]] for x in cut]
        if rest:
            lengths, own = self.encode_whole(list(rest.values()))
            at = np.concatenate([[0], np.cumsum(lengths)]).tolist()
            for k, i in enumerate(rest):
                out[i] = own[at[k] : at[k + 1]].tolist()
        lengths = [len(x) for x in out]
        return lengths, np.fromiter((i for x in out for i in x), np.int32, sum(lengths))

    def encode_whole(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        ids = [e.ids for e in self.full.encode_batch_fast(words, add_special_tokens=False)]
        return [len(x) for x in ids], np.fromiter((i for x in ids for i in x), np.int32, sum(map(len, ids)))
