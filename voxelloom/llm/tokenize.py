"""Exact token ids and counts of the public tokenizer files, one dictionary look-up a pre-token.

Both vocabularies cut a text into pre-tokens and merge bytes inside each alone, so a text's ids are its
pre-tokens' ids end to end. `Encoder` cuts Latin-1 texts with a pattern in Python, asks the tokenizers library's
model for each distinct pre-token once, and keeps the answers in a bounded table; other texts it gives to the library.

`Counter` holds the whole-token shortcut: `whole_tokens` proves, once, which vocabulary strings the
library encodes alone as exactly one token; pre-tokens among these count one, and only the rest are merged. Character
classes differ between regular-expression libraries outside Latin-1, so the library's own pre-tokenizer cuts such texts;
they take the same shortcut. Texts with a special token's string go to the library whole, which splits them there.

Texts of more than PIECE characters are worked on in pieces, cut where both patterns cut whatever comes before or
after: between a letter and a space before a letter, and before a line feed between two visible characters. A text
without any such place is one piece.

A null text counts as an empty one; empty tables give no rows; only doc_id and text are read, so other columns' names
don't matter; repeated rows are each counted.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm._text import id_and_text, tidy

#: Entries of a worker's table before the older half goes; about 200 bytes each.
MEMO_ENTRIES = 300_000
PIECE = 1 << 20
_SAFE_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])|(?<=[!-~])(?=\n[!-~])")

# The two files' pre-token patterns, with \s, \p{L} and \p{N} written out for Latin-1.
_S = r"\t\n\x0b\x0c\r \x85\xa0"
_L = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = r"0-9\xb2\xb3\xb9\xbc-\xbe"
PATTERNS = {
    "byte_bpe_50k.json": rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+",
    "word_bpe_49k.json": rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+",
}
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
# Fixed rule of byte-level vocabularies: visible Latin-1 characters stand for their own byte, the others for U+0100 on.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = {b: chr(b if b in _VISIBLE else 0x100 + sum(x not in _VISIBLE for x in range(b))) for b in range(256)}
_LETTER_BYTES = {ord(x): chr(b) for b, x in BYTE_LETTERS.items()}


@cache
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Memo(dict):
    """Pre-token to what `make` gives for it: fixed answers, and a table in two halves of which the older is dropped."""

    def __init__(self, make: Callable[[str], object], fixed: dict | None = None, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.fixed, self.older, self.half = make, fixed or {}, {}, entries // 2

    def __missing__(self, word: str):
        value = self.fixed.get(word)
        if value is None:
            value = self.older.get(word)
            if value is None:
                value = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value


def pieces(text: str) -> list[str]:
    """The text in pieces of about PIECE characters whose ids end to end are the text's."""
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = _SAFE_CUT.search(text, at + PIECE)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]] if at else [text]


def _plain(text: str) -> bool:
    """Whether the Latin-1 pattern cuts it as the library does."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text or not any(x in text for x in SPECIAL)


def _letters(word: str) -> str:
    """The word's bytes as the vocabulary spells them."""
    return word.encode().decode("latin-1").translate(BYTE_LETTERS)


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, entries: int = MEMO_ENTRIES):
        name = os.path.basename(path)
        self.library, self.lower = _library(path), name.startswith("word_")
        self.cut = re.compile(PATTERNS[name]).findall
        merge = self.library.model.tokenize
        self.memo = _Memo(lambda word: array("I", [x.id for x in merge(_letters(word))]).tobytes(), entries=entries)

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self._encode, pieces(text or "")))

    def _encode(self, text: str) -> bytes:
        if not _plain(text):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.memo.__getitem__, self.cut(text.lower() if self.lower else text)))


class Counter:
    """Texts to token counts; `whole` are the pre-tokens that are proven to be one token."""

    def __init__(self, path: str, whole: list[str]):
        self.library, self.lower = _library(path), os.path.basename(path).startswith("word_")
        self.cut = re.compile(PATTERNS[os.path.basename(path)]).findall
        merge = self.library.model.tokenize
        self.memo = _Memo(lambda word: len(merge(_letters(word))), dict.fromkeys(whole, 1))
        self.spelled = _Memo(lambda word: len(merge(word)), {_letters(x): 1 for x in whole})

    def count(self, text: str | None) -> int:
        return sum(map(self._count, pieces(text or "")))

    def _count(self, text: str) -> int:
        if _plain(text):
            return sum(map(self.memo.__getitem__, self.cut(text.lower() if self.lower else text)))
        if "<|" in text and any(x in text for x in SPECIAL):
            return len(self.library.encode(text, add_special_tokens=False))
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return sum(self.spelled[word] for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text))


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings of byte-level vocabularies that are one pre-token and that the library encodes alone as one token.

    Merging can miss a vocabulary string whose pieces join otherwise first, so each is tried, none assumed. Strings that
    aren't whole characters can't be a pre-token.
    """
    library = _library(path)
    if library.model.end_of_word_suffix:
        return []
    found = []
    for name in library.get_vocab():
        try:
            text = name.translate(_LETTER_BYTES).encode("latin-1").decode()
        except UnicodeError:
            continue
        if text and text not in SPECIAL and [x for x, _ in library.pre_tokenizer.pre_tokenize_str(text)] == [name]:
            found.append(text)
    encoded = library.encode_batch(found, add_special_tokens=False)
    return [x for x, e in zip(found, encoded, strict=True) if len(e) == 1]


_made: dict = {}


def _once(key: tuple, make: Callable[[], object]):
    """One per Python worker, kept from task to task with its table."""
    if key not in _made:
        _made[key] = make()
    return _made[key]


def encoder(path: str, entries: int = MEMO_ENTRIES) -> Encoder:
    return _once(("encode", path, entries), lambda: Encoder(path, entries))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than `limit`); one row per row.

    The proven strings are at most the vocabulary, so the broadcast has a fixed bound.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _once(("count", path), lambda: Counter(path, whole.value))
        for batch in batches:
            n = pa.array([of.count(x.as_py()) for x in batch["text"]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], n], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = id_and_text(docs, size).mapInArrow(tidy(task), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
