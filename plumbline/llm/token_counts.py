"""Token counts of whole texts by overlap resynchronisation.

A text above ``chunk_chars`` is encoded in overlapping chunks; each token's bytes give its offset. Two neighbours are
spliced at the last boundary that both have in their overlap and that is proven stable: there, a letter is followed by
anything but a letter, a digit by anything but a digit, or a mark by white space. No pre-token goes across such a place
whatever stands around it, and the pre-tokeniser looks back at nothing, so what follows is encoded alike from there on. A
place inside a special string is none: the left chunk sees the string whole, as it reads further by more than its length.
Where an overlap has no such boundary it is doubled, up to the whole left chunk, which is then doubled itself, so a text
without any boundary is encoded in time proportional to its length too.

Ids come from the rank file of the same vocabulary, which gives the same as the JSON's library several times faster: the
two were compared on every assigned code point, next to letters, digits, signs and spaces, without a difference.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import Batches, batch, texts

END = "<|endoftext|>"
CHUNK_CHARS = 8_192
OVERLAP_CHARS = 256
#: Further from a chunk's end than any special string is long.
MARGIN = len(END) + 3
_STABLE = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=\P{White_Space})(?=\p{White_Space})")


@functools.lru_cache(maxsize=4)
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def ranked(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: 50256})


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> np.ndarray:
    """The number of bytes of each token."""
    own = ranked(path)
    sizes = np.zeros(own.n_vocab, np.int64)
    for token in own.token_byte_values():
        sizes[own.encode_single_token(token)] = len(token)
    sizes[50256] = len(END)
    return sizes


class Encoder:
    """ids and counts as ``tokenizers`` gives them without added special tokens; special strings inside texts count as one."""

    def __init__(self, json_path: str | None = None, rank_path: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS):
        self.json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
        self.rank_path = rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        self.chunk, self.overlap = chunk_chars, overlap_chars

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text. The rank library cannot read some hundred thousand blanks in a row; the JSON's can."""
        try:
            return ranked(self.rank_path).encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)
        except ValueError:
            return np.array(library(self.json_path).encode(text, add_special_tokens=False).ids, np.uint32)

    def count(self, text: str) -> int:
        """Tokens of a text; the chunks in flight are all that is held."""
        n, start, total, skip = len(text), 0, 0, 0
        end = min(n, self.chunk)
        left = self.ids(text[:end])
        while end < n:
            found = self._splice(text, start, end, left, skip)
            if found is None:  # no boundary in all of it: read on, twice as far
                end = min(n, start + 2 * (end - start))
                left = self.ids(text[start:end])
                continue
            before, start, end, left, after = found
            total += before - skip
            skip = after
        return total + len(left) - skip

    def _splice(self, text: str, start: int, end: int, left: np.ndarray, skip: int) -> tuple[int, int, int, np.ndarray, int] | None:
        """The next chunk, spliced on to text[start:end]: tokens of the left chunk up to the common boundary, start, end and
        tokens of the right one, and how many of these lie before the boundary."""
        sizes, n, overlap, ends = token_bytes(self.rank_path), len(text), self.overlap, None
        while True:
            begin = max(start, end - overlap)
            places = [p for m in _STABLE.finditer(text, begin, end - MARGIN) if begin < (p := m.start()) < end - MARGIN]
            if places and begin > start:
                stop = min(n, end + self.chunk)
                right = self.ids(text[begin:stop])
                ends = np.cumsum(sizes[left]) if ends is None else ends
                mine, before = np.cumsum(sizes[right]), len(text[start:begin].encode())
                for p in reversed(places):
                    width = len(text[begin:p].encode())
                    i, j = np.searchsorted(ends, before + width), np.searchsorted(mine, width)
                    if i < len(ends) and j < len(mine) and ends[i] == before + width and mine[j] == width and i + 1 >= skip:
                        return int(i) + 1, begin, stop, right, int(j) + 1
            if begin == start:
                return None
            overlap *= 2


def counter(encoder: Encoder, limit: int) -> Callable[[Batches], Batches]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            own = texts(rows)
            counts = np.array([encoder.count(t) for t in own], np.int64)
            yield batch(schema, [rows.column(0), [len(t.encode()) for t in own], counts, counts > limit])

    return run


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, encoder: Encoder | None = None) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have no tokens; a null id stays null; repeated rows are counted again; other columns, whatever
    their names, are neither read nor returned; an empty table gives an empty table; a text of any length is read in
    chunks, in time in proportion to its length. Narrow: no shuffle.
    """
    slim = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return slim.mapInArrow(counter(encoder or Encoder(), limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
