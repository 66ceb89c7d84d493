"""Token counts of whole texts with overlap resynchronisation for huge documents.

A text up to ``chunk`` characters is encoded by the library at once. A longer one is encoded in
overlapping chunks with offsets, so a task's memory stays bounded by the chunk. The encodings of
two neighbouring chunks are spliced where a boundary is proven stable: both of them have a
token boundary there, and no piece of the vocabulary holds the two characters around it side by
side, so no merge can ever cross it and the tokens on either side do not depend on the other. If
the overlap has no such place, it is widened (doubled) until one is found; at worst the overlap
reaches the end of the text, which then is encoded in one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sluice.llm import text as tx

SPACE = "▁"  # how the library writes a space
REWRITTEN = (" ﬁ  ½ ", "Ａ é é \t\n x  ", "  two  ", "ǅ Ⅷ ²   ​ ok")  # what a normalising model changes
COUNTED = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}


class Counter:
    """Counts with one sentencepiece BPE model."""

    _made: dict[str, Counter] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        # the normalised form of a text must be the text with a space put before it
        if any(self.model.normalize(t) != SPACE + t.replace(" ", SPACE) for t in REWRITTEN):
            raise ValueError("the model rewrites texts: offsets of chunks would not hold")
        self.sizes = np.zeros(self.model.vocab_size(), np.int64)  # UTF-8 bytes that a token stands for
        self.inside = set()
        for i in range(self.model.vocab_size()):
            self.sizes[i] = 1 if self.model.is_byte(i) else len(self.model.id_to_piece(i).replace(SPACE, " ").encode())
            if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i)):
                piece = self.model.id_to_piece(i)
                self.inside.update(zip(piece, piece[1:], strict=False))

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def stable(self, text: str, p: int) -> bool:
        """No piece can cover both characters around ``p``."""
        a, b = text[p - 1], text[p]
        return ((SPACE if a == " " else a), (SPACE if b == " " else b)) not in self.inside

    def bounds(self, text: str) -> np.ndarray:
        """Token start offsets of an encoded chunk, in characters."""
        data = np.frombuffer(text.encode(), np.uint8)
        if SPACE not in text:  # then sizes of tokens add up to offsets; the first holds the added prefix
            sizes = self.sizes[self.model.encode(text, return_type="numpy")]
            ends = np.cumsum(sizes) - 1
            if len(ends) and ends[-1] == len(data):
                at = np.maximum(ends - sizes, 0)
                return at if len(data) == len(text) else np.cumsum((data & 0xC0) != 0x80)[at] - 1
        at = self.model.encode(text, return_type="offset_mapping")["offsets"]
        return np.fromiter((begin for begin, _ in at), np.int64, len(at))

    def count_long(self, text: str, chunk: int, overlap: int) -> int:
        """Tokens of ``text`` from chunks of ``chunk`` characters and an overlap of ``overlap``."""
        total, begin, known = 0, 0, 0  # tokens from `known` on are still to be counted
        end = min(len(text), chunk)
        left = self.bounds(text[begin:end]) + begin
        while end < len(text):
            wide = overlap
            while True:
                start = max(known, end - wide)
                # a chunk must hold more than the overlap; it grows with it
                stop = min(len(text), end + max(chunk, wide))
                right = self.bounds(text[start:stop]) + start
                # the first token of a chunk shows the added prefix, the last may go on beyond it
                common = np.intersect1d(left[left > start], right[right > start])
                splice = next((p for p in common[::-1].tolist() if known < p < end and self.stable(text, p)), None)
                if splice is not None:
                    break
                if start <= known:  # the overlap covers all that is open: widen to the right
                    end = stop
                    left = self.bounds(text[begin:end]) + begin
                    if end == len(text):
                        return total + int((left >= known).sum())
                wide *= 2
            total += int(((left >= known) & (left < splice)).sum())
            begin, known, end, left = start, splice, stop, right
        return total + int((left >= known).sum())

    def counts(self, texts: list[str], chunk: int, overlap: int) -> list[int]:
        short = [t for t in texts if len(t) <= chunk]
        done = iter([len(ids) for ids in self.model.encode(short, num_threads=1, return_type="numpy")] if short else [])
        return [next(done) if len(t) <= chunk else self.count_long(t, chunk, overlap) for t in texts]


def with_token_counts(df: DataFrame, model: str, text: str = "text", limit: int = 4096, chunk: int = 1 << 14,
                      overlap: int = 256) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of
    each whole text, without begin and end. Null and empty texts have no tokens; repeated rows
    are counted alike; input columns of the output names are replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in df.columns if c not in COUNTED]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, t) for c, t in COUNTED.items()])
    arrow = to_arrow_schema(schema)

    def run(batches):
        counter = Counter.of(model)
        for batch in batches:
            for lo, hi, _, at in tx.chunks(batch, text):
                part = batch.slice(lo, hi - lo)
                n = counter.counts([t or "" for t in tx.column(part, text).to_pylist()], chunk, overlap)
                yield pa.RecordBatch.from_arrays(
                    [*[tx.column(part, c) for c in kept], pa.array(np.diff(at)), pa.array(n, pa.int64()),
                     pa.array([x > limit for x in n])], schema=arrow)
    return df.mapInArrow(run, schema)
