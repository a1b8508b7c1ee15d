"""Substring dedup: remove every word that lies in a window of words found anywhere else.

Count-min prefilter over anchors. In each window of ``width`` words the ``gram``-word runs with the
smallest hash are its anchors. An anchor is a function of the window's words alone, so equal windows have equal
anchors, and the anchor of a window occurs at least as often as the window: the count of an anchor is an
upper bound of the counts of its windows, as a count-min cell is of its keys, and no repeated window can be estimated
unique. Only anchors (about one word in thirteen) are counted, so the sketch is a twelfth of one over windows.

1. Each task adds its anchors to count-min sketches (``depth`` rows, 2**``cell_bits`` cells), held
   sparsely as (row, cell, count); the sketches merge by adding cells. A cell is an upper bound for each
   of its anchors. A cell that holds 1 also names that one occurrence, so those go back to their
   documents as *settled*: the minimum over the rows is 1 and the window is unique.
2. A second pass forms the 128-bit hashes of all windows whose anchor isn't settled, and groups them
   exactly. Again only the groups of one go back. Everything else that was a candidate repeats.

Rows are told apart by 96 bits of hashes of id and text, so null and repeated ids spread over all tasks.

Both counts are plain sums with map-side combining, so a passage in a third of all documents is one row
for each task, and no join multiplies rows. Sketches are never collected; the width is free as cells are
sparse. A document's lists are bounded by its own length.

Defined results: a null or empty text has no words; fewer than ``width`` words are kept whole; a row
that appears twice loses all its windows in both places; null doc_id stays null; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm._frames import pieces
from keyloom.llm._words import BASES, TOP, U64, Words, grams, mix, slide

#: Odd multipliers, one for each row of the sketch.
ROW_FACTORS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


class Windows:
    """Of some texts: the anchors' hashes, and for each window (by its first word) the smallest gram in it."""

    def __init__(self, texts: list[bytes], width: int, gram: int):
        self.words = w = Words(texts)
        self.span = width - gram + 1
        hashes, left = w.hashes(), w.left()
        self.starts = np.flatnonzero(left >= width)
        self.hashes = hashes
        g = np.full(w.n, TOP, U64)
        g[: max(0, w.n - gram + 1)] = mix(grams(hashes, gram)) | U64(1)
        g[left < gram] = TOP
        self.gram = g
        low = slide(g, self.span, np.minimum) if w.n else g
        self.low = np.zeros(w.n, U64)
        self.low[self.starts] = low[self.starts]

    def anchors(self) -> np.ndarray:
        """Words at which an anchor starts: the gram is smallest in some window."""
        over = np.concatenate([np.zeros(self.span - 1, U64), self.low])
        best = slide(over, self.span, np.maximum)[: self.words.n]
        return np.flatnonzero((best == self.gram) & (best > 0))

    def open_starts(self, settled: np.ndarray) -> np.ndarray:
        """First words of the windows whose anchor isn't one of the settled words."""
        g = np.full(self.words.n, TOP, U64)
        g[settled] = self.gram[settled]
        done = slide(g, self.span, np.minimum) if self.words.n else g
        return self.starts[done[self.starts] != self.low[self.starts]]

    def keys(self, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = (grams(self.hashes, width, base) for base in BASES)
        return mix(a[starts]).view(np.int64), mix(b[starts] ^ U64(BASES[0])).view(np.int64)


def _flat(lists: list, first: np.ndarray) -> np.ndarray:
    """Per-document positions as positions among all words of a piece."""
    parts = [np.asarray(x, np.int64) + f for x, f in zip(lists, first, strict=False) if x is not None and len(x)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _where(w: Words, at: np.ndarray, keys: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document key of each word, and its text's tag with its place in the document in one number."""
    doc = np.searchsorted(w.first, at, "right") - 1
    return keys[doc], (tags[doc] << 32) | (at - w.first[doc])


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened = zstandard.ZstdDecompressor()
    for batch in batches:
        k = batch.schema.get_field_index("packed")
        packed, low, texts, total = batch.column(k).to_pylist(), 0, [], 0
        for high, p in enumerate(packed, 1):
            texts.append(opened.decompress(p))
            total += len(texts[-1])
            if total >= 1 << 22 or high == len(packed):
                yield batch.slice(low, high - low).append_column("text", pa.array(texts, pa.binary()))
                low, texts, total = high, [], 0


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def windows_removed(docs: DataFrame, width: int = 35, gram: int = 10, depth: int = 2, cell_bits: int = 40) -> DataFrame:
    """doc_id, n_words, n_removed, kept (binary: the words left, joined by one space)."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    source = docs.select(F.xxhash64(doc_id, text).alias("key"), F.hash(doc_id, text).alias("tag"), text.alias("text"), doc_id.alias("doc_id"))

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            win = Windows(texts, width, gram)
            at = win.anchors()
            key, place = _where(win.words, at, *(_column(batch, c).to_numpy().astype(np.int64) for c in ("key", "tag")))
            for row in range(depth):
                cell = mix(win.gram[at] * U64(ROW_FACTORS[row])) >> U64(64 - cell_bits)
                cells, one, n = np.unique(cell, return_index=True, return_counts=True)
                cells = (cells.astype(np.int64) << 2) | row
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cells, n.astype(np.int64), key[one], place[one])], ["cell", "n", "key", "place"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays([*(_column(batch, c) for c in ("doc_id", "key", "tag")), pa.array([squeeze.compress(t) for t in texts], pa.binary())], ["doc_id", "key", "tag", "packed"])

    def lone(counted: DataFrame, name: str, *by: str) -> DataFrame:
        """Of groups of one: the document, and the list of its places."""
        ones = counted.groupBy(*by).agg(F.sum("n").alias("n"), F.min("key").alias("key"), F.min("place").alias("place")).where("n = 1")
        place = F.col("place").bitwiseAND(0xFFFFFFFF).cast("int")
        return ones.groupBy("key", F.shiftright("place", 32).cast("int").alias("tag")).agg(F.collect_list(place).alias(name))

    def group(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(_unpacked(batches)):
            win = Windows(texts, width, gram)
            at = win.open_starts(_flat(_column(batch, "settled").to_pylist(), win.words.first))
            key, place = _where(win.words, at, *(_column(batch, c).to_numpy().astype(np.int64) for c in ("key", "tag")))
            a, b = win.keys(at, width)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, np.ones(len(at), np.int64), key, place)], ["a", "b", "n", "key", "place"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(_unpacked(batches)):
            win = Windows(texts, width, gram)
            w = win.words
            at = np.setdiff1d(win.open_starts(_flat(_column(batch, "settled").to_pylist(), w.first)), _flat(_column(batch, "single").to_pylist(), w.first))
            cover = np.zeros(w.n + 1, np.int64)
            cover[at] += 1
            cover[at + width] -= 1
            gone = np.cumsum(cover)[:-1] > 0
            n, removed, kept = [], [], []
            for d in range(len(texts)):
                mine = gone[w.first[d] : w.first[d + 1]]
                n.append(len(mine))
                removed.append(int(mine.sum()))
                kept.append(b" ".join(x for x, g in zip(w.of(d), mine.tolist(), strict=True) if not g) if removed[-1] else b" ".join(w.of(d)))
            yield pa.RecordBatch.from_arrays([_column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    settled = lone(source.mapInArrow(sketch, "cell long, n long, key long, place long"), "settled", "cell")
    packed = source.mapInArrow(pack, "doc_id long, key long, tag int, packed binary").join(settled, ["key", "tag"], "left")
    single = lone(packed.mapInArrow(group, "a long, b long, n long, key long, place long"), "single", "a", "b")
    return packed.join(single, ["key", "tag"], "left").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")
