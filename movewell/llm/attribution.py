"""Token counts of sections: whole documents are encoded once, and their tokens dealt to sections.

Token boundaries are mapped to characters of the text, sections are character intervals, and the
two sorted lists are joined by position. A token that crosses a boundary goes, by an explicit rule,
to the section of its first character (``first``), of its last (``last``), or to the one that holds
most of its characters, the earlier one on ties (``most``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from movewell.llm.bpe import Encoder, Vocabulary, vocabulary
from movewell.llm.common import pieces, texts_of

RULES = ("first", "last", "most")
COLUMNS = ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"]


def character_widths(known: Vocabulary) -> np.ndarray:
    """By id, what a token adds in characters: twice those that begin in it, plus one where its first byte
    continues a character of the token before."""
    codes = np.zeros(max(known.bytes_of) + 1, np.int64)
    for i, raw in known.bytes_of.items():
        codes[i] = 2 * sum((b & 0xC0) != 0x80 for b in raw) + ((raw[0] & 0xC0) == 0x80 if raw else 0)
    return codes


def token_spans(ids: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of every token of a whole text; a character cut in two is in both tokens."""
    codes = widths[ids]
    begun = np.cumsum(codes >> 1)
    return begun - (codes >> 1) - (codes & 1), begun


def line_ends(text: str) -> np.ndarray:
    """Ends of the sections: lines, each with its line feed. An empty text is one empty section."""
    lengths = np.array([len(line) + 1 for line in text.split("\n")])
    lengths[-1] -= 1
    ends = np.cumsum(lengths)
    return ends[:-1] if len(ends) > 1 and lengths[-1] == 0 else ends


def allocate(starts: np.ndarray, stops: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens dealt to each section, and how many of them cross a boundary."""
    first = np.searchsorted(ends, starts, "right")
    last = np.searchsorted(ends, np.maximum(stops - 1, starts), "right")
    crossing = last > first
    owner = last.copy() if rule == "last" else first.copy()
    if rule == "most":
        for token in np.flatnonzero(crossing):
            sections = np.arange(first[token], last[token] + 1)
            opened = np.concatenate([[0], ends])[sections]
            owner[token] = sections[np.argmax(np.minimum(ends[sections], stops[token]) - np.maximum(opened, starts[token]))]
    return np.bincount(owner, minlength=len(ends)), np.bincount(owner[crossing], minlength=len(ends))


def section_tokens(docs: DataFrame, path: str, rule: str = "first") -> DataFrame:
    """doc_id, section (from 0), char_start, char_end, n_tokens, n_crossing: a row for each line of each text.

    The counts of a document add up to its tokens. A null or empty text is one empty section without
    tokens. Null ids, repeated rows and further columns change nothing. There is no shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def attribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        encoder, widths = Encoder(known), character_widths(known)
        for batch in pieces(batches):
            parts: list[tuple[np.ndarray, ...]] = []
            texts = [text or "" for text in batch.column(1).to_pylist()]
            encoder.prepare(texts)
            for value in texts:
                ends = line_ends(value)
                tokens, crossing = allocate(*token_spans(encoder.encode(value), widths), ends, rule)
                parts.append((np.arange(len(ends)), np.concatenate([[0], ends[:-1]]), ends, tokens, crossing))
            rows = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            columns = [pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) if parts else pa.array([], pa.int64())
                       for k in range(5)]
            yield pa.record_batch([batch.column(0).cast(pa.int64()).take(pa.array(rows, pa.int64())), *columns], names=COLUMNS)

    return texts_of(docs).mapInArrow(attribute, ", ".join(f"{name} long" for name in COLUMNS))
