"""Fill-in-the-middle transformation, its cuts found through memoized content-defined chunks.

A text is cut into chunks where a rolling hash of the last 16 characters says so, so equal passages
give equal chunks wherever they stand. Of each chunk a boundary summary is kept: whether it begins
with white space, whether it ends inside a word, and where words end within it. A chunk seen before
takes the summary from the cache, after its content was compared. Counts of word ends add up over the
chunks, one more for each word that ends exactly between two of them; a cut after k units is found by
a search in these sums, then in the one chunk that holds it. No text is split into its units.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movewell.llm.common import texts_of

#: The marks before prefix, suffix and middle, and the forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

SPACE = np.zeros(1 << 16, bool)
SPACE[[32, *range(9, 14)]] = True
WINDOW = 16


@dataclass(frozen=True)
class Settings:
    """seed: of the draws. transformed: percentage of texts that are. suffix_first: percentage of these that
    start with the suffix. least, most: characters of a chunk (the last may be shorter). spread: one place in
    2 ** spread is a cut of the content. remembered: characters of chunk content kept by a task's cache."""

    seed: int = 42
    transformed: int = 50
    suffix_first: int = 80
    least: int = 128
    most: int = 2048
    spread: int = 8
    remembered: int = 1 << 22


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    """A fixed random number for each of 65 536 residues of a character's code."""
    return np.random.default_rng(16).integers(0, 1 << 32, 1 << 16, np.uint32)


def rolling(codes: np.ndarray) -> np.ndarray:
    """The hash of the last 16 characters at every place: sums of shifted numbers, doubled in width four times."""
    made = _gear()[codes & 0xFFFF]
    for width in (1, 2, 4, 8):
        wider = made.copy()
        wider[width:] += made[:-width] << np.uint32(2 * width)
        made = wider
    return made


def chunk_ends(codes: np.ndarray, settings: Settings) -> list[int]:
    """Ends of the chunks: places the content chooses, none closer than ``least`` nor farther than ``most``."""
    chosen = np.flatnonzero(rolling(codes) >> np.uint32(32 - settings.spread) == 0) + 1 if len(codes) > settings.least else []
    ends, begin = [], 0
    for place in chosen:
        if place - begin < settings.least:
            continue
        while place - begin > settings.most:
            begin += settings.most
            ends.append(begin)
        if place - begin >= settings.least:
            begin = int(place)
            ends.append(begin)
    while len(codes) - begin > settings.most:
        begin += settings.most
        ends.append(begin)
    return ends if begin == len(codes) and ends else [*ends, len(codes)]


class Summaries:
    """Boundary summaries by content: (begins with white space, ends inside a word, ends of words within)."""

    def __init__(self, remembered: int):
        self.remembered, self.held, self.hits = remembered, 0, 0
        self._known: dict[int, tuple[bytes, tuple]] = {}

    def of(self, chunk: np.ndarray) -> tuple[bool, bool, np.ndarray]:
        content = chunk.tobytes()
        key = hash(content)
        found = self._known.get(key)
        if found and found[0] == content:  # equal hashes are not taken for equal chunks
            self.hits += 1
            return found[1]
        gap = SPACE[np.minimum(chunk, 0xFFFF)]
        made = bool(gap[0]), not gap[-1], np.flatnonzero(gap[1:] & ~gap[:-1]).astype(np.int32) + 1
        if len(chunk) <= self.remembered:
            if self.held + len(chunk) > self.remembered:
                self._known.clear()
                self.held = 0
            self._known[key] = content, made
            self.held += len(chunk)
        return made


class Units:
    """The units of one text, as sums over its chunks."""

    def __init__(self, codes: np.ndarray, settings: Settings, summaries: Summaries):
        self.size = len(codes)
        ends = chunk_ends(codes, settings) if self.size else []
        self.starts = [0, *ends[:-1]]
        parts = [summaries.of(codes[a:b]) for a, b in zip(self.starts, ends)]
        self.within = [p[2] for p in parts]
        begins = [p[0] for p in parts[1:]] + [True]  # the end of the text ends its last word
        self.between = [p[1] and gap for p, gap in zip(parts, begins)]
        self.ends = ends
        self.sums = np.cumsum([len(w) + b for w, b in zip(self.within, self.between)]) if parts else np.zeros(0, int)
        self.words = int(self.sums[-1]) if parts else 0
        self.count = self.words + (1 if parts and not parts[-1][1] else 0)

    def place(self, units: int) -> int:
        """The number of characters before the end of so many units."""
        if units <= 0:
            return 0
        if units > self.words:
            return self.size
        chunk = int(np.searchsorted(self.sums, units))
        before = int(self.sums[chunk - 1]) if chunk else 0
        within = self.within[chunk]
        return self.starts[chunk] + int(within[units - before - 1]) if units - before <= len(within) else self.ends[chunk]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits from seed and id; null for a null id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    return [F.conv(F.substring(digest, 8 * n + 1, 8), 16, 10).cast("long") for n in range(4)]


def transform(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of every input row, one row for each.

    A null text is an empty one, an empty text is plain. A null doc_id draws nothing and its text stays
    plain. Rows of one doc_id draw the same numbers, each for its own text. Other columns change nothing.
    There is no shuffle; a task holds one Arrow batch and a bounded cache, which it can lose and make anew.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries = Summaries(settings.remembered)
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in range(2, 6)])
            made = [_made(text.as_py() or "", drawn, settings, summaries) for text, drawn in zip(batch.column(1), rows)]
            columns = zip(*made) if made else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([batch.column(0), *[pa.array(list(c), kind) for c, kind in zip(columns, kinds)]],
                                  names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = texts_of(docs).select("doc_id", "text", *[h.alias(f"h{n}") for n, h in enumerate(draws(F.col("doc_id"), settings.seed))])
    return rows.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _made(text: str, drawn: tuple, settings: Settings, summaries: Summaries) -> tuple:
    units = Units(codes_of(text), settings, summaries)
    if drawn[0] is None or not text or drawn[2] % 100 >= settings.transformed or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return units.count, PLAIN, None, None, text
    low, high = sorted(units.place(h % (units.count + 1)) for h in drawn[:2])
    before, middle, after = text[:low], text[low:high], text[high:]
    if drawn[3] % 100 < settings.suffix_first:
        return units.count, SPM, low, high - low, SUFFIX + after + PREFIX + before + MIDDLE + middle
    return units.count, PSM, low, high - low, PREFIX + before + SUFFIX + after + MIDDLE + middle


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from output and form alone: each mark occurs once in a transformed text."""
    def between(first: str, last: str) -> Column:
        return F.substring_index(F.substring_index(output, last, 1), first, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    return (F.when(form == PSM, F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
            .when(form == SPM, F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))).otherwise(output))
