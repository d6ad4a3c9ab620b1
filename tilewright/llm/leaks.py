"""Passages of held-out test items inside a corpus.

Windows of test items and of documents get SimHash fingerprints of their word shingles. Fingerprints are cut into
blocks; every window that agrees with an item's window in one block up to a few bits is a candidate, so that no
fingerprint within the radius can be missed. Candidates are verified by the exact similarity of their weighted shingles.

There are two kinds of windows. Item-sized ones (as many words as the item has, so one kind for each length) find whole
items that were altered: their radius takes in windows of similarity 0.8, whose fingerprints differ in 10 of 64 bits on
average. Windows of 12 words find passages; at 8 shingles a single changed one costs some 9 bits and more than 0.2 of the
similarity, so that in practice they find what is word for word the item's.

Only windows that can be similar at all get a fingerprint: of their distinct shingles, (1 - least) / least times as many
as occur in any item at most may be unknown to all items. This bound is exact, as no shingle weighs more than one that
no item has.

The test items are the query set: they are indexed on the driver in blocks of bounded size, and the whole corpus
streams past eight blocks at a time in one Arrow pass without a shuffle, in which its words are hashed once; mirrors and
large hosts cause no imbalance. Equal
windows of items are one class: classes are compared and verified, and a class is expanded to its items last, in steps
of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.words import shingle_hashes, word_hashes

BLOCKS, BLOCK_BITS = 4, 16
#: Bits in which a window may differ from an item-sized one, and from one of a passage.
ITEM_RADIUS, PASSAGE_RADIUS = 15, 3
#: Characters of test items in an index, and indexes that a pass over the corpus searches; more items take more passes.
ITEM_BLOCK_CHARS, PASS_BLOCKS = 2_000_000, 8
#: Words, bytes of windows, and pairs of windows or items handled at a time; only memory depends on them.
STEP, WINDOW_BYTES, PAIRS = 1 << 18, 1 << 25, 1 << 20
_FILTER_BITS = 22


def majority(rows: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes: bit b is set if it is in more than half of them."""
    k, m = rows.shape
    out = np.zeros(k, np.uint64)
    step = max(1, WINDOW_BYTES // max(1, m * 64))
    for at in range(0, k, step):
        part = np.ascontiguousarray(rows[at : at + step])
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), m, 8), axis=2, bitorder="little")
        counts = bits.sum(axis=1, dtype=np.uint16 if m < 1 << 16 else np.uint32)
        out[at : at + step] = np.packbits(counts > m // 2, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0] .. lo[0]+n[0]-1, lo[1] .. and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


class MultiIndex:
    """Fingerprints to be searched by distance. Two that differ in ``radius`` bits differ in radius // BLOCKS bits at
    most in one of the blocks, so each is entered under all values of a block that are so near."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        masks = [sum(1 << b for b in chosen) for k in range(radius // BLOCKS + 1) for chosen in combinations(range(BLOCK_BITS), k)]
        self.tables = []
        for b in range(BLOCKS):
            values = (self._block(prints, b)[:, None] ^ np.array(masks, np.uint32)).ravel()
            order = np.argsort(values, kind="stable")
            self.tables.append((values[order], (order // len(masks)).astype(np.int32)))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(BLOCK_BITS * b) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (position in prints, position in the index) within the radius, in order."""
        left, right, at = [], [], 0
        spans = []
        for b, (values, _) in enumerate(self.tables):
            own = self._block(prints, b)
            lo = np.searchsorted(values, own, "left")
            spans.append((lo, np.searchsorted(values, own, "right") - lo))
        ends = np.cumsum(sum(n for _, n in spans))
        while at < len(prints):  # as many prints at a time as have PAIRS candidates
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            for (_, who), (lo, n) in zip(self.tables, spans):
                i, j = np.repeat(np.arange(at, to), n[at:to]), who[ranges(lo[at:to], n[at:to])]
                ok = np.bitwise_count(prints[i] ^ self.prints[j]) <= self.radius
                left.append(i[ok])
                right.append(j[ok])
            at = to
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = np.concatenate(left), np.concatenate(right).astype(np.int64)
        both = np.unique(i * max(1, len(self.prints)) + j)
        return both // max(1, len(self.prints)), both % max(1, len(self.prints))


@dataclass
class Windows:
    """The windows of one size in a block of items: their classes, and of each the items and places that have it."""

    words: int
    size: int
    radius: int
    whole: bool
    rows: np.ndarray
    member_class: np.ndarray
    member_item: np.ndarray
    member_place: np.ndarray

    @staticmethod
    def of(words: int, size: int, whole: bool, rows: list[np.ndarray], items: list[int]) -> Windows:
        place = np.concatenate([np.arange(len(r)) for r in rows])
        item = np.repeat(np.array(items, np.int64), [len(r) for r in rows])
        classes, own = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        own = own.ravel()
        order = np.lexsort((place, item, own))
        return Windows(words, size, ITEM_RADIUS if whole else PASSAGE_RADIUS, whole, classes, own[order].astype(np.int64), item[order], place[order])


@dataclass
class ItemIndex:
    """Windows of a block of items, the weights of the shingles that occur in them, and what other shingles weigh."""

    ids: np.ndarray
    kinds: list[Windows]
    known: dict[int, tuple[np.ndarray, np.ndarray]]
    unknown: float
    least: float

    @staticmethod
    def build(ids: list, texts: list[str | None], window: int, size: int, least: float) -> ItemIndex:
        """Item-sized windows of items of any length (shingles of fewer words where the item has fewer), and those of
        ``window`` words of items that are longer."""
        words, counts = word_hashes(texts)
        kinds: dict[tuple[int, bool], tuple[list, list]] = {}
        seen: dict[int, list[np.ndarray]] = {}
        at = 0
        for i, n in enumerate(counts):
            own = words[at : at + n]
            at += n
            if not n:
                continue
            s = min(size, int(n))
            shingles = shingle_hashes(own, s)
            seen.setdefault(s, []).append(np.unique(shingles))
            for width, whole in ((int(n), True), (window, False)):
                if whole or n > window:
                    rows, who = kinds.setdefault((width, whole), ([], []))
                    rows.append(np.lib.stride_tricks.sliding_window_view(shingles, width - s + 1))
                    who.append(i)
        known = {}
        for s, parts in seen.items():
            hashes, df = np.unique(np.concatenate(parts), return_counts=True)
            # A shingle that many items share says less about one of them.
            known[s] = hashes, 1 + np.log((1 + len(ids)) / (1 + df))
        return ItemIndex(np.array(ids, dtype=np.int64), [Windows.of(w, min(size, w), whole, *x) for (w, whole), x in sorted(kinds.items())], known, float(1 + np.log(1 + len(ids))), least)

    def opened(self) -> Searcher:
        return Searcher(self)


@dataclass
class Segments:
    """Stretches of texts in which a window can hold a shingle of an item: their words one after another."""

    words: np.ndarray
    place: np.ndarray  # of each word in all words
    end: np.ndarray  # of each word: where its segment ends


class Searcher:
    """An index with its lookup tables, made where it is used."""

    def __init__(self, index: ItemIndex):
        self.index = index
        self.tables: dict[int, MultiIndex] = {}
        self.filters = {}
        for s, (hashes, _) in index.known.items():
            filled = np.zeros(1 << _FILTER_BITS, bool)
            filled[self._slot(hashes)] = True
            self.filters[s] = filled

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def _place(self, shingles: np.ndarray, size: int) -> np.ndarray:
        """Of each shingle its number among the known ones, or -1."""
        out = np.full(len(shingles), -1, np.int64)
        maybe = np.flatnonzero(self.filters[size][self._slot(shingles)])
        hashes = self.index.known[size][0]
        at = np.minimum(np.searchsorted(hashes, shingles[maybe]), len(hashes) - 1)
        same = hashes[at] == shingles[maybe]
        out[maybe[same]] = at[same]
        return out

    def _table(self, n: int) -> MultiIndex:
        """Of the windows' n-th kind, made when it is asked for."""
        if n not in self.tables:
            kind = self.index.kinds[n]
            self.tables[n] = MultiIndex(majority(kind.rows), kind.radius)
        return self.tables[n]

    def _segments(self, words: np.ndarray, ends: np.ndarray, size: int, most: int) -> Segments:
        hits = []
        for at in range(0, len(words) - size + 1, STEP):
            hits.append(np.flatnonzero(self._place(shingle_hashes(words[at : at + STEP + size - 1], size), size) >= 0) + at)
        hit = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        owner = np.searchsorted(ends, hit, "right")
        hit, owner = hit[hit + size <= ends[owner]], owner[hit + size <= ends[owner]]  # a shingle mustn't run into the next text
        if not len(hit):
            none = np.zeros(0, np.int64)
            return Segments(words[:0], none, none)
        start = np.where(owner > 0, ends[np.maximum(owner - 1, 0)], 0)
        low, high = np.maximum(hit + size - most, start), np.minimum(hit + most, ends[owner])
        first = np.append(True, (low[1:] > high[:-1]) | (owner[1:] != owner[:-1]))  # high doesn't fall inside a text
        begins = np.flatnonzero(first)
        low, high = low[begins], high[np.append(begins[1:], len(hit)) - 1]
        place = ranges(low, high - low)
        return Segments(words[place], place, np.repeat(np.cumsum(high - low), high - low))

    def _similarity(self, mine: np.ndarray, theirs: np.ndarray, size: int) -> np.ndarray:
        """Weighted Jaccard of the shingle sets, row by row."""
        weights, out = self.index.known[size][1], np.zeros(len(mine))
        of = lambda s: np.where((at := self._place(s, size)) >= 0, weights[at], self.index.unknown)
        for i, (a, b) in enumerate(zip(mine, theirs)):
            a, b = np.unique(a), np.unique(b)
            shared = of(np.intersect1d(a, b, assume_unique=True)).sum()
            out[i] = shared / (of(a).sum() + of(b).sum() - shared)
        return out

    def _matches(self, n_kind: int, seg: Segments, shingles: np.ndarray, known: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, ...]:
        """Place in all words, class, whether equal, and similarity, of the windows that are similar to a class."""
        kind = self.index.kinds[n_kind]
        m, least = kind.words - kind.size + 1, self.index.least
        n = len(seg.words) - kind.words + 1
        none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, float))
        if n <= 0:
            return none
        n_known, n_fresh = known[m : m + n] - known[:n], fresh[m : m + n] - fresh[:n]
        at = np.flatnonzero((n_known > 0) & (n_fresh * least <= n_known * (1 - least) + 1e-9) & (np.arange(n) + kind.words <= seg.end[:n]))
        if not len(at):
            return none
        rows = np.lib.stride_tricks.sliding_window_view(shingles, m)
        found = []
        step = max(1, WINDOW_BYTES // (8 * m))
        for i in range(0, len(at), step):
            own = rows[at[i : i + step]]
            left, right = self._table(n_kind).near(majority(own))
            equal = np.array([], bool)
            for j in range(0, len(left), step):
                equal = np.append(equal, (own[left[j : j + step]] == kind.rows[right[j : j + step]]).all(axis=1))
            score = np.ones(len(left))
            other = np.flatnonzero(~equal)
            for j in range(0, len(other), step):
                o = other[j : j + step]
                score[o] = self._similarity(own[left[o]], kind.rows[right[o]], kind.size)
            good = score >= least
            found.append((seg.place[at[i + left[good]]], right[good], equal[good], score[good]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _steps(self, owner: np.ndarray, found: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, int, int, int]]:
        """Texts from, to and items from, to, so that a step expands to some PAIRS members: whole texts where they fit, else
        a text's items in parts."""
        sizes = np.zeros(len(owner) + 1, np.int64)
        for kind, (text, cls, *_) in zip(self.index.kinds, found):
            per_class = np.bincount(kind.member_class, minlength=len(kind.rows))
            np.add.at(sizes, text, per_class[cls])
        n_items, at = len(self.index.ids), 0
        while at < len(owner):
            to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:-1]), PAIRS, "right")) + at)
            parts = -(-int(sizes[at:to].sum()) // PAIRS) if to == at + 1 else 1
            for p in range(max(1, parts)):
                yield at, to, n_items * p // max(1, parts), n_items * (p + 1) // max(1, parts)
            at = to

    def search(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
        """Columns text, item, matching windows, words of the longest exact passage, best similarity of any window and of
        an item-sized one (0 if there is none), in steps of bounded size."""
        words, counts = word_hashes(texts)
        yield from self.search_words(words, np.cumsum(counts))

    def search_words(self, words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """The same for texts whose words are hashed already; ``ends`` says where each text's words end."""
        found: dict[int, tuple[np.ndarray, ...]] = {}
        for size in self.index.known:
            own = [n for n, k in enumerate(self.index.kinds) if k.size == size]
            most = max(self.index.kinds[n].words for n in own)
            seg = self._segments(words, ends, size, most)
            shingles = shingle_hashes(seg.words, size)
            hit = self._place(shingles, size) >= 0
            # an unknown shingle counts where it wasn't seen shortly before, so that repeated ones don't count twice in a window
            order = np.argsort(shingles, kind="stable")
            again = np.zeros(len(shingles), bool)
            again[order[1:]] = (shingles[order[1:]] == shingles[order[:-1]]) & (order[1:] - order[:-1] < most)
            known = np.append(0, np.cumsum(hit))
            fresh = np.append(0, np.cumsum(~hit & ~again))
            for n in own:
                place, cls, equal, score = self._matches(n, seg, shingles, known, fresh)
                found[n] = np.searchsorted(ends, place, "right"), cls, equal, score, place
        by_kind = [found[n] for n in range(len(self.index.kinds))]
        texts_hit = np.unique(np.concatenate([f[0] for f in by_kind]))
        local = [(np.searchsorted(texts_hit, f[0]), *f[1:]) for f in by_kind]
        for t0, t1, i0, i1 in self._steps(texts_hit, local):
            cols = self._expanded(local, t0, t1, i0, i1)
            if len(cols[0]):
                yield (texts_hit[cols[0]], self.index.ids[cols[1]], *cols[2:])

    def _expanded(self, found: list[tuple[np.ndarray, ...]], t0: int, t1: int, i0: int, i1: int) -> tuple[np.ndarray, ...]:
        n_items, parts = len(self.index.ids), []
        for kind, (text, cls, equal, score, place) in zip(self.index.kinds, found):
            mine = np.flatnonzero((text >= t0) & (text < t1))
            key = kind.member_class * n_items + kind.member_item
            lo, hi = np.searchsorted(key, cls[mine] * n_items + i0), np.searchsorted(key, cls[mine] * n_items + i1)
            mine, who = np.repeat(mine, hi - lo), ranges(lo, hi - lo)
            parts.append((text[mine], kind.member_item[who], place[mine], place[mine] - kind.member_place[who], equal[mine], score[mine], np.full(len(mine), kind.words), np.full(len(mine), kind.whole)))
        text, item, place, diagonal, equal, score, size, whole = (np.concatenate(x) for x in zip(*parts))
        if not len(text):
            return tuple(np.zeros(0, np.int64) for _ in range(6))
        order = np.lexsort((place, diagonal, whole, item, text))
        text, item, place, diagonal, equal, score, size, whole = (x[order] for x in (text, item, place, diagonal, equal, score, size, whole))
        # Equal windows on one diagonal, one after another, make a longer passage.
        goes_on = np.zeros(len(text), bool)
        goes_on[1:] = (text[1:] == text[:-1]) & (item[1:] == item[:-1]) & ~whole[1:] & ~whole[:-1] & (diagonal[1:] == diagonal[:-1]) & (place[1:] == place[:-1] + 1) & equal[1:] & equal[:-1]
        since = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(text))))
        length = np.where(equal, np.arange(len(text)) - since + size, 0)
        pair = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])))
        most = np.maximum.reduceat
        return text[pair], item[pair], np.diff(np.append(pair, len(text))), most(length, pair), most(score, pair), most(np.where(whole, score, 0.0), pair)


SCHEMA = "doc_id long, item_id long, n_windows int, longest_words int, similarity double, whole_similarity double"


def passes(items: DataFrame, item_id: str, text: str, window: int, shingle: int, least: float) -> Iterator[list[ItemIndex]]:
    """Indexes of the items, as many at a time as one pass over the corpus searches."""
    own: list[ItemIndex] = []
    for ids, texts in item_blocks(items, item_id, text):
        index = ItemIndex.build(ids, texts, window, shingle, least)
        own += [index] if index.kinds else []
        if len(own) == PASS_BLOCKS:
            yield own
            own = []
    if own:
        yield own


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items in blocks of bounded size, fetched one partition at a time."""
    ids, texts, size = [], [], 0
    for row in items.select(item_id, text).where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).orderBy(item_id, text).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
        if size >= ITEM_BLOCK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 12, shingle: int = 5, least: float = 0.8, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows, longest_words, similarity, whole_similarity: documents with a window like one of an item.

    An item is compared whole, with all windows of as many words, and, if it has more than ``window`` words, by its
    windows of ``window`` words. A pair is reported if some windows' fingerprints are within the radius of their kind and
    their weighted shingle similarity is ``least`` or more; equal windows always are. Items of fewer words than
    ``shingle`` are one shingle, so that they are found word for word only. A text shorter than an item has no window of its
size; its passages of ``window`` words are found all the same. n_windows counts matching windows of both
    kinds; longest_words is the length of the longest passage that is word for word the item's, 0 if there is only a
    similar one; similarity is the best of any window, whole_similarity of an item-sized one (0 if none matches). Null and
    empty texts, null items and an empty table on either side give no rows; repeated documents give repeated rows; very
    long texts are compared whole.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], SCHEMA)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for indexes in passes(items, item_id, text, window, shingle, least):

        def scan(batches: Iterator[pa.RecordBatch], indexes: list[ItemIndex] = indexes) -> Iterator[pa.RecordBatch]:
            searchers = [index.opened() for index in indexes]
            for batch in batches:
                keys = batch.column(0)
                words, counts = word_hashes(batch.column(1).to_pylist())
                ends = np.cumsum(counts)
                for searcher in searchers:
                    for at, *cols in searcher.search_words(words, ends):
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds[1:]))], names=names)

        out = out.unionAll(docs.select(F.col(doc_id).cast("long"), text).where(F.col(text).isNotNull()).mapInArrow(scan, SCHEMA))
    return out
