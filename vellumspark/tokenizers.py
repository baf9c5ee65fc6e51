"""Token counters: words (built-in, additive, the default) and byte-pair ranks from a file (Arrow UDF)."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumspark.functions import text as T

#: Splits text ahead of byte-pair merges: contractions, letters, digits, signs, blanks.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


#: Texts that are taken out of Arrow at a time, and their bytes there.
TAKEN, TAKEN_BYTES = 256, 1 << 20


def by_parts(texts: pa.Array, of: Callable[[str | None], object], kind: pa.DataType) -> Iterator[pa.Array]:
    """of each text, some texts at a time: as Python objects a whole batch and what is made of it take many times their bytes."""
    step = max(1, min(TAKEN, TAKEN_BYTES * len(texts) // max(1, texts.nbytes)))
    for low in range(0, len(texts), step):
        yield pa.array([of(t) for t in texts.slice(low, step).to_pylist()], kind)


class WordCodec:
    """Words with the blanks before them; the count is that of the words alone."""

    _PIECE = re.compile(r"\W*\w+|\W+\Z")
    _WORD = re.compile(r"\w+")

    def count(self, text: str) -> int:
        return len(self._WORD.findall(text))

    def seam(self, text: str, start: int) -> int:
        """No place is known: the text is counted anew."""
        return start

    def split(self, text: str) -> list[str]:
        """Pieces that add up to the text, one a word; what follows the last word is part of it."""
        found = self._PIECE.findall(text)
        if len(found) > 1 and not self._WORD.search(found[-1]):
            found[-2:] = ["".join(found[-2:])]
        return found

    def join(self, pieces: list[str]) -> str:
        return "".join(pieces)


class BpeCodec:
    """Byte-pair tokens of a rank file; strings of special tokens are ordinary text."""

    #: A blank between a sign that isn't one and a letter, digit or sign: PATTERN begins a piece there, whatever is around.
    _SEAM = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        self._seams = pattern == PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str) -> int:
        return len(self._coder.encode_ordinary(text))

    def seam(self, text: str, start: int) -> int:
        """The last place from start on that no token reaches over, whatever is added to the text; start where none is known."""
        if not self._seams:
            return start
        at = text.rfind(" ", start + 1, len(text) - 1)
        while at > start and not self._SEAM.match(text, at):
            at = text.rfind(" ", start + 1, at)
        return max(at, start)

    def split(self, text: str) -> list[int]:
        return self._coder.encode_ordinary(text)

    def join(self, pieces: list[int]) -> str:
        return self._coder.decode(pieces)


@lru_cache(4)
def _bpe(path: str, pattern: str) -> BpeCodec:
    return BpeCodec(path, pattern)


@dataclass(frozen=True)
class Tokenizer:
    """kind "words", or "bpe" with the path of a rank file that every worker can read."""

    kind: str = "words"
    path: str = ""
    pattern: str = PATTERN

    def codec(self) -> WordCodec | BpeCodec:
        """Built once in each Python worker."""
        return WordCodec() if self.kind == "words" else _bpe(self.path, self.pattern)

    def count(self, text: Column) -> Column:
        if self.kind == "words":
            return T.word_count(text)
        codec: Callable[[], BpeCodec] = self.codec

        @F.arrow_udf("int")
        def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = codec()
            for texts in batches:
                yield from by_parts(texts, lambda t: 0 if t is None else own.count(t), pa.int32())

        return counted(text)
