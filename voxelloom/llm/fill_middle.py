"""Fill-in-the-middle: texts cut in three at two boundaries and written with the middle last.

Where a text may be cut is a set of byte offsets, kept as sorted 32-bit integers usually are when some stretches are dense and
others sparse: offsets are split by their high 16 bits into containers, each stored in the smallest of three forms
(a sorted array, a bitmap of 65,536 bits, or runs), with the cumulative cardinality of the containers before it. The k-th
boundary is then found by a binary search over the cumulative cardinalities and a select within one container: by place
in an array, by ranks of 64-bit words in a bitmap, by cumulative run lengths in runs. ASCII stretches are one run,
other scripts arrays or bitmaps.

The cuts depend on a hash of the id only: h1 to h4 are the first four 8-digit groups of the sha256 of `<seed>:<id>`.
With n units there are n + 1 boundaries; the prefix ends at the smaller of h1 % (n + 1) and h2 % (n + 1), the middle at the
larger. A text is left plain if it is empty, contains a sentinel, or is not drawn (h3); h4 draws suffix-first order. Since
no other text contains a sentinel, and no sentinel can overlap the start or end of another, `restored` rebuilds it exactly.

Null texts count as empty, a null id is hashed as an empty string. One row per row: repeated rows give repeated rows, an empty
table none. Only doc_id and text are read, so other columns' names don't matter. A text is one unit of work, with about nine
bytes of working memory a byte; nothing is shuffled, so a lost task is simply run again.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.llm._text import NOT_SPACE, id_and_text, tidy

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Offsets that share their high 16 bits are one container; an array of more than ARRAY_LIMIT would be larger than a bitmap.
CONTAINER, ARRAY_LIMIT = 1 << 16, 4096
ARRAY, BITMAP, RUN = "array", "bitmap", "run"


class Container:
    """Up to 65,536 sorted 16-bit values in the smallest form."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        first = np.flatnonzero(np.diff(values, prepend=-2) != 1)
        if 2 * len(first) < min(self.n, ARRAY_LIMIT):
            self.kind, self.starts = RUN, values[first].astype(np.uint16)
            self.before = first.astype(np.int32)
        elif self.n <= ARRAY_LIMIT:
            self.kind, self.values = ARRAY, values.astype(np.uint16)
        else:
            bits = np.zeros(CONTAINER, np.uint8)
            bits[values] = 1
            self.kind, self.words = BITMAP, np.packbits(bits, bitorder="little").view("<u8")
            self.before = np.cumsum(np.bitwise_count(self.words)) - np.bitwise_count(self.words)

    def select(self, k: int) -> int:
        """The k-th value, from 0."""
        if self.kind == ARRAY:
            return int(self.values[k])
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        rest = k - int(self.before[at])
        if self.kind == RUN:
            return int(self.starts[at]) + rest
        word = int(self.words[at])
        for _ in range(rest):
            word &= word - 1
        return 64 * at + (word & -word).bit_length() - 1


class BoundarySet:
    """Sorted byte offsets with select."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        cuts = [0, *(np.flatnonzero(np.diff(high)) + 1).tolist(), len(offsets)] if len(offsets) else []
        self.keys = [int(high[a]) for a in cuts[:-1]]
        self.containers = [Container(offsets[a:b] & (CONTAINER - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.before = cuts[:-1]
        self.n = len(offsets)

    def select(self, k: int) -> int:
        if not 0 <= k < self.n:
            raise IndexError(k)
        at = bisect_right(self.before, k) - 1
        return (self.keys[at] << 16) + self.containers[at].select(k - self.before[at])


def char_boundaries(data: np.ndarray) -> np.ndarray:
    """The first byte of every code point, and the end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def word_boundaries(data: np.ndarray) -> np.ndarray:
    """The start, the first byte of every white-space separated word behind it, and the end; just the start if empty."""
    inside = NOT_SPACE[data]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    return np.concatenate([[0], starts, [len(data)] if len(data) else []]).astype(np.int64)


BOUNDARIES: dict[str, Callable[[np.ndarray], np.ndarray]] = {"char": char_boundaries, "word": word_boundaries}


def _cut(boundaries: Callable[[np.ndarray], np.ndarray]):
    """Number of units, the cuts in units, and the three pieces; pieces are null where the text stays plain."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, h1, h2, plain in zip(batch["text"], *(batch[c].to_pylist() for c in ("h1", "h2", "plain")), strict=True):
                raw = memoryview(text.as_buffer())
                data = np.frombuffer(raw, np.uint8)
                if plain:
                    out.append((len(boundaries(data)) - 1, None, None, None, None, None))
                    continue
                allowed = BoundarySet(boundaries(data))
                low, high = sorted((h1 % allowed.n, h2 % allowed.n))
                a, b = allowed.select(low), allowed.select(high)
                out.append((allowed.n - 1, low, high - low, str(raw[:a], "utf-8"), str(raw[a:b], "utf-8"), str(raw[b:], "utf-8")))
            kinds = [pa.int64()] * 3 + [pa.string()] * 3
            cuts = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], batch["form"], *cuts], ["doc_id", "text", "form", "n", "prefix_units", "middle_units", "prefix", "middle", "suffix"])

    return tidy(task)


def rearrange(docs: DataFrame, unit: str = "char", seed: int = 1, percent: int = 90, suffix_first_percent: int = 20) -> DataFrame:
    """doc_id, text, n (units), form (plain, psm or spm), prefix_units, middle_units (null if plain) and the output of every row."""
    rows = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))
    marked = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(sentinel))
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= percent), "plain").when(h4 % 100 < suffix_first_percent, "spm").otherwise("psm")
    drawn = rows.select("doc_id", "text", h1.alias("h1"), h2.alias("h2"), form.alias("form")).withColumn("plain", F.col("form") == "plain")
    cut = drawn.mapInArrow(_cut(BOUNDARIES[unit]), "doc_id long, text string, form string, n long, prefix_units long, middle_units long, prefix string, middle string, suffix string")
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return cut.select("doc_id", "text", "n", "form", "prefix_units", "middle_units", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone."""
    first, second = (F.when(form == "psm", F.lit(s)).otherwise(F.lit(t)) for s, t in ((PREFIX, SUFFIX), (SUFFIX, PREFIX)))
    middle_at, second_at = F.position(F.lit(MIDDLE), output), F.position(second, output)
    width = F.length(first)
    one = F.substring(output, width + 1, second_at - width - 1)
    two = F.substring(output, second_at + F.length(second), middle_at - second_at - F.length(second))
    middle = F.substring(output, middle_at + len(MIDDLE), F.length(output))
    whole = F.when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return F.when(form == "plain", output).otherwise(whole)


def digest(rows: DataFrame) -> DataFrame:
    """Hashes of each output and of the text that `restored` makes of it."""
    own = [F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars")]
    hashes = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return rows.select("doc_id", "n", "form", *own, *hashes)
