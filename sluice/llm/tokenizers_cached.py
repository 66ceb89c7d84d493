"""Token ids by the tokenizers library, unit by unit through a bounded cache.

The tokenizer lower-cases, drops white space and splits at it, and splits what is left into runs of
letters, single digits and runs of other characters; merges stay inside these. So a text may be
cut at white space and, where only plain letters and punctuation meet, between a letter run and
its neighbours, without changing its ids. Each distinct unit is encoded by the library once and
looked up afterwards by a 64-bit hash. The construction checks that the tokenizer has this form.
Parts with anything that could look past such a cut (apostrophes, which start contractions;
characters other than ASCII and Latin letters, which may compose) stay whole between spaces.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from sluice.llm import text as tx

# classes of bytes
WHITE, LETTER, DIGIT, SYMBOL, WHOLE = 0, 1, 2, 3, 4
_CLASS = np.full(256, WHOLE, np.uint8)
_CLASS[0x21:0x7F] = SYMBOL
_CLASS[tx.WHITE] = WHITE
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = LETTER
_CLASS[0x30:0x3A] = DIGIT
_CLASS[0x27] = WHOLE
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"  # fixed value: the form that is relied on


def _classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte; Latin letters of two bytes (U+00C0 to U+017F) count as letters, but for the
    two signs among them and the dotted capital I, which lower-cases to two characters."""
    out = _CLASS[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5)) if len(data) else np.zeros(0, np.int64)
    a, b = data[lead], data[lead + 1]
    lead = lead[~((a == 0xC3) & ((b == 0x97) | (b == 0xB7) | (b < 0x80))) & ~((a == 0xC4) & (b == 0xB0))]
    out[lead] = out[lead + 1] = LETTER
    return out


class UnitEncoder:
    """Encodes Arrow arrays of texts; keeps at most ``keep`` units."""

    _made: dict[str, UnitEncoder] = {}

    def __init__(self, path: str, keep: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps, split = spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": "\\s+"}:
            raise ValueError("unknown normalisation: units might not be independent")
        if split[0] != {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True} or \
                [s["type"] for s in split] != ["Split", "ByteLevel"] or split[1]["add_prefix_space"] or split[1]["use_regex"]:
            raise ValueError("unknown splitting: units might not be independent")
        if any(not t["content"].startswith("<|") or " " in t["content"] or t["lstrip"] or t["rstrip"]
               for t in spec["added_tokens"]):
            raise ValueError("unknown added tokens: units might not be independent")
        self.tokenizer = Tokenizer.from_file(path)
        self.keep = keep
        self._clear()

    @classmethod
    def of(cls, path: str) -> UnitEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _clear(self) -> None:
        self.number: dict[int, int] = {}
        self.lengths, self.starts = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(len(a), n - len(a)), a.dtype)])

    def _units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the units of lower-cased texts."""
        kind = _classes(data)
        start, end = tx.spans(kind != WHITE, at)
        # a whole part: any byte of it is WHOLE, or it may hold an added token
        odd = kind == WHOLE
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        upto = np.concatenate([[0], np.cumsum(odd)])
        whole = upto[end] > upto[start]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[start[~whole]] += 1
        inside[end[~whole]] -= 1
        fine = np.cumsum(inside[:-1]) > 0
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = fine[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        begins[start] = True
        first = np.flatnonzero(begins)
        # a unit ends where the next one of its part starts, or with the part
        part = np.searchsorted(start, first, "right") - 1
        return first, np.minimum(np.append(first[1:], len(data)), end[part])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text and the end); nulls read as empty."""
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        ids, sizes = [], []
        for _, _, data, at in tx.chunks(batch, limit=1 << 62):
            # capitals that would turn into an added token's string stay
            raw = data.tobytes()
            low = data if b"<|" in raw else tx.UPPER[data]
            first, last = self._units(low, at)
            keys, place, inverse = np.unique(tx.span_hash(tx.prefix_hash(low), first, last), return_index=True,
                                             return_inverse=True)
            number = self._numbers(keys.tolist(), low, first[place], last[place])[inverse]
            lengths = self.lengths[number]
            ids.append(self.ids[tx.ragged(self.starts[number], lengths)])
            upto = np.concatenate([[0], np.cumsum(lengths)])
            sizes.append(np.diff(upto[np.searchsorted(first, at)]))
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        return ids, np.concatenate([[0], *[s for s in sizes]]).cumsum()

    def _numbers(self, keys: list[int], data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        if len(self.number) + len(keys) > self.keep:
            self._clear()
        get = self.number.get
        found = np.array([get(k, -1) for k in keys], np.int64)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            raw = data.tobytes()
            parts = [raw[a:b].decode() for a, b in zip(first[missing].tolist(), last[missing].tolist(), strict=True)]
            n = len(self.number)
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
            lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
            flat = np.fromiter((i for e in encoded for i in e), np.uint32, int(lengths.sum()))
            self.ids = self._grown(self.ids, self.used + len(flat))
            self.lengths, self.starts = self._grown(self.lengths, n + len(parts)), self._grown(self.starts, n + len(parts))
            self.ids[self.used:self.used + len(flat)] = flat
            self.lengths[n:n + len(parts)] = lengths
            self.starts[n:n + len(parts)] = self.used + np.cumsum(lengths) - lengths
            self.used += len(flat)
            numbers = np.arange(n, n + len(parts))
            self.number.update(zip([keys[m] for m in missing.tolist()], numbers.tolist(), strict=True))
            found[missing] = numbers
        return found
