"""Benchmark decontamination by suffix arrays over the training text.

Each task turns its documents, ``array_words`` words at a time, into a suffix array: all word
positions, sorted by the words that follow (to the depth of the longest test item: no comparison goes
further). Every suffix of every test item is binary-searched in each array, which yields the longest
verbatim match at each place. A document is affected by an item if they share ``min_words`` words in a
row, or the whole item where that is shorter.

Words are compared without case and punctuation, by 64-bit hashes.

Defined results
* Null or empty texts and items: match nothing. An item of fewer than ``least_item`` words affects the documents
  that consist of it alone: within a longer text it would hit ordinary prose.
* ``matches`` tells every place in a document where an item's words stand, with the longest match there, but
  for those within a longer match of the same item; ties go to the earliest place in the item.
* Repeated items or rows: equal matches are told once.
* A null doc_id is reported as null, and its row is removed like any other.
* Empty tables: no matches. Extra columns: ignored by ``matches``, passed through by ``drop_affected``.
* Very long texts: searched whole. One beyond ``array_words`` takes several arrays, which overlap by the longest item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, slices, trim
from .textops import words

ARRAY_WORDS = 500_000
MIN_WORDS = 13
LEAST_ITEM = 6
#: Words of test items searched in one pass over the documents; more items take more passes.
PASS_WORDS = 4_000_000
#: Places looked at together.
PLACES = 2_000_000


def word_codes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense codes from 1 of each hash, and the hash of each code. Sorts value and place packed in one machine word."""
    n = len(hashes)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    place = np.arange(n, dtype=np.uint64)
    packed = np.sort((hashes >> bits << bits) | place)
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    full = hashes[order]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = full[1:] != full[:-1]
    top = packed >> bits
    if (new[1:] & (top[1:] == top[:-1])).any():  # two hashes share all kept bits: sort them in full
        order = np.argsort(hashes, kind="stable")
        full = hashes[order]
        new[1:] = full[1:] != full[:-1]
    codes = np.empty(n, np.int32)
    codes[order] = np.cumsum(new, dtype=np.int32)
    return codes, full[new]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``codes`` sorted by their suffixes to ``depth`` codes at least, by prefix doubling."""
    n = len(codes)
    bits = max(1, (n - 1).bit_length())
    if 2 * max(bits, int(codes.max()).bit_length()) + bits > 64:
        return _suffix_array_large(codes, depth)
    wide = np.uint64(max(bits, int(codes.max()).bit_length()))
    low = (np.uint64(1) << np.uint64(bits)) - np.uint64(1)
    rank = np.zeros(n + depth + 1, np.int32)
    rank[:n] = codes
    todo, h = np.arange(n, dtype=np.int32), 1
    sa = np.empty(n, np.int32)
    slot = np.arange(n, dtype=np.int32)  # where in sa the sorted todo go
    while len(todo):
        a, b = rank[todo].astype(np.uint64), rank[todo + h].astype(np.uint64)
        packed = np.sort((((a << wide) | b) << np.uint64(bits)) | todo.astype(np.uint64))
        order, pair = (packed & low).astype(np.int32), packed >> np.uint64(bits)
        sa[slot] = order
        new = np.empty(len(order), bool)
        new[0] = True
        new[1:] = pair[1:] != pair[:-1]
        head = np.maximum.accumulate(np.where(new, slot, 0))
        rank[order] = head + 1
        h *= 2
        if h >= depth:
            break
        last = np.empty(len(order), bool)
        last[-1] = True
        last[:-1] = new[1:]
        tied = ~(new & last)
        todo, slot = order[tied], slot[tied]
    return sa


def _suffix_array_large(codes: np.ndarray, depth: int) -> np.ndarray:
    """The same where three numbers don't fit in a machine word (a document of many million words)."""
    n, h = len(codes), 1
    rank = np.zeros(n + depth + 1, np.int64)
    rank[:n] = codes
    while True:
        second = rank[h : n + h] if h < depth + 1 else np.zeros(n, np.int64)
        sa = np.lexsort((second, rank[:n]))
        a, b = rank[sa], second[sa]
        head = np.concatenate([[1], ((a[1:] != a[:-1]) | (b[1:] != b[:-1])).astype(np.int64)]).cumsum()
        rank[sa] = head
        h *= 2
        if h >= depth or head[-1] == n:
            return sa


class TestItems:
    """Suffixes of the test items."""

    __test__ = False

    def __init__(self, ids: list[int], texts: list[str | None], min_words: int, least_item: int):
        w = words(pa.array(texts, pa.large_string()))
        size = np.diff(w.first)
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        self.hashes, self.item, self.first = w.hashes, w.doc, w.first
        self.depth = int(size.max()) if len(size) else 0
        need = np.minimum(min_words, size)
        self.alone = size < least_item
        room = self.first[1:][self.item] - np.arange(len(self.hashes))
        self.need = need[self.item]
        self.starts = np.flatnonzero(room >= self.need)  # suffixes that are long enough to matter
        self.room = room


def _narrow(codes: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within each [lo, hi) of the suffix array, the part whose code at ``depth`` is ``want``; by two binary searches."""
    n = len(codes)
    bounds = []
    for right in (False, True):
        a, b = lo.copy(), hi.copy()
        while (live := a < b).any():
            mid = (a + b) >> 1
            at = sa[np.minimum(mid, n - 1)] + depth
            code = np.where(at < n, codes[np.minimum(at, n - 1)], 0)
            less = (code <= want) if right else (code < want)
            a, b = np.where(live & less, mid + 1, a), np.where(live & ~less, mid, b)
        bounds.append(a)
    return bounds[0], bounds[1]


Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _none() -> Found:
    return tuple(np.zeros(0, np.int64) for _ in range(5))


def search(hashes: np.ndarray, first: np.ndarray, items: TestItems) -> Found:
    """(document index, item index, matched words, word in document, word in item) of the longest match at every place.

    ``first``: where each document's words begin; the last is the number of words.
    """
    if not len(hashes) or not len(items.starts):
        return _none()
    codes, known = word_codes(hashes)
    # an end mark, code 0, after each document; a suffix that reaches it is at its end
    n_docs = len(first) - 1
    text = np.zeros(len(codes) + n_docs, np.int32)
    text[np.arange(len(codes), dtype=np.int32) + np.repeat(np.arange(n_docs, dtype=np.int32), np.diff(first))] = codes
    del codes
    at = np.minimum(np.searchsorted(known, items.hashes), len(known) - 1)
    wanted = np.where(known[at] == items.hashes, at + 1, -1)
    sa = suffix_array(text, items.depth)
    live = items.starts[wanted[items.starts] > 0]
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(text))
    found = []
    depth = 0
    while len(live):
        lo, hi = _narrow(text, sa, lo, hi, depth, wanted[live + depth])
        depth += 1
        go = hi > lo
        live, lo, hi = live[go], lo[go], hi[go]
        done = items.need[live] == depth
        if done.any():
            found.append((live[done], lo[done], hi[done]))
            live, lo, hi = live[~done], lo[~done], hi[~done]
        go = wanted[live + depth] > 0
        live, lo, hi = live[go], lo[go], hi[go]
    if not found:
        return _none()
    start, lo, hi = (np.concatenate(x) for x in zip(*found))
    turn = np.cumsum(hi - lo) // PLACES
    out = []
    for i in np.unique(turn):
        on = turn == i
        out.append(_longest(*_places(text, sa, first, wanted, items, start[on], lo[on], hi[on])))
    return _outermost(*_longest(*(np.concatenate(x) for x in zip(*out))))


def _places(text: np.ndarray, sa: np.ndarray, first: np.ndarray, wanted: np.ndarray, items: TestItems, start: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Found:
    """Where the suffixes of items that begin at ``start`` stand, each match as long as it goes."""
    count = hi - lo
    start = np.repeat(start, count)
    place = sa[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())].astype(np.int64)
    # a match that goes on to the left is reported from where it begins
    inner = (start > items.first[:-1][items.item[start]]) & (place > 0)
    inner[inner] = text[place[inner] - 1] == wanted[start[inner] - 1]
    start, place = start[~inner], place[~inner]
    size = items.need[start].copy()
    going = np.arange(len(start))
    while len(going):
        going = going[size[going] < items.room[start[going]]]
        a, b = place[going] + size[going], start[going] + size[going]
        going = going[(a < len(text)) & (text[np.minimum(a, len(text) - 1)] == wanted[b])]
        size[going] += 1
    n_docs = len(first) - 1
    ends = first[1:] + np.arange(n_docs)  # places of the end marks
    d = np.searchsorted(ends, place, side="right")
    in_doc = place - d - first[d]
    it = items.item[start]
    on = ~items.alone[it] | (in_doc == 0) & (np.diff(first)[d] == size)
    return tuple(x[on] for x in (d, it, size, in_doc, start - items.first[it]))


def _longest(d: np.ndarray, it: np.ndarray, size: np.ndarray, in_doc: np.ndarray, in_item: np.ndarray) -> Found:
    """Of each document, item and place, in order, the longest match."""
    order = np.lexsort((in_item, -size, in_doc, it, d))
    d, it, size, in_doc, in_item = (x[order] for x in (d, it, size, in_doc, in_item))
    top = np.ones(len(d), bool)
    top[1:] = (d[1:] != d[:-1]) | (it[1:] != it[:-1]) | (in_doc[1:] != in_doc[:-1])
    return tuple(x[top] for x in (d, it, size, in_doc, in_item))


def _outermost(d: np.ndarray, it: np.ndarray, size: np.ndarray, in_doc: np.ndarray, in_item: np.ndarray) -> Found:
    """Without those that lie within an earlier one of the same document and item."""
    if not len(d):
        return d, it, size, in_doc, in_item
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (it[1:] != it[:-1])
    end = in_doc + size
    reach = np.cumsum(new) * (int(end.max()) + 1) + end
    on = np.ones(len(d), bool)
    on[1:] = new[1:] | (reach[1:] > np.maximum.accumulate(reach)[:-1])
    return tuple(x[on] for x in (d, it, size, in_doc, in_item))


def search_long(hashes: np.ndarray, first: np.ndarray, items: TestItems, most: int) -> Found:
    """The same; a document of more than ``most`` words is searched in pieces, which overlap by the longest item."""
    if len(first) != 2 or len(hashes) <= most + items.depth:
        return search(hashes, first, items)
    out = []
    for at in range(0, len(hashes), most):
        part = hashes[at : at + most + items.depth]
        d, it, size, in_doc, in_item = search(part, np.array([0, len(part)]), items)
        on = ~items.alone[it]
        out.append(tuple(x[on] for x in (d, it, size, in_doc + at, in_item)))
    return _outermost(*_longest(*(np.concatenate(x) for x in zip(*out))))


def _runs(batches: Iterator[pa.RecordBatch], at: int, most: int, places: bool) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray | None]]:
    """Rows of about ``most`` words at a time (or one row of more), with their words' hashes, where each row's begin, and their bytes."""
    parts, hashes, first, where, n = [], [], [], [], 0

    def joined():
        return parts, np.concatenate(hashes), np.concatenate([*first, [n]]), np.concatenate(where) if places else None

    for batch in batches:
        for part in slices(batch, batch.schema.names[at]):
            w = words(part.column(at))
            if parts and n + len(w.hashes) > most:
                yield joined()
                parts, hashes, first, where, n = [], [], [], [], 0
            parts.append(part)
            hashes.append(w.hashes)
            first.append(w.first[:-1] + n)
            if places:
                where.append(w.at)
            n += len(w.hashes)
    if parts:
        yield joined()


def load_items(benchmark: DataFrame, min_words: int = MIN_WORDS, least_item: int = LEAST_ITEM) -> list[TestItems]:
    """The test items, in groups of at most PASS_WORDS words, streamed to the driver; each group is searched in its own pass."""
    groups, ids, texts, n = [], [], [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        n += len(row[1] or "") // 4
        if n >= PASS_WORDS:
            groups.append(TestItems(ids, texts, min_words, least_item))
            ids, texts, n = [], [], 0
    if ids or not groups:
        groups.append(TestItems(ids, texts, min_words, least_item))
    return groups


SCHEMA = "doc_id bigint, item_id bigint, matched_words int, doc_word bigint, doc_byte bigint, item_word int"


def matches(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, least_item: int = LEAST_ITEM, array_words: int = ARRAY_WORDS) -> DataFrame:
    """The longest verbatim match at every place where an item affects a document, with its place in both."""
    bound_batches(docs.sparkSession)
    out = None
    for items in load_items(benchmark, min_words, least_item):

        def run(batches, items=items):
            for parts, hashes, first, where in _runs(batches, 1, array_words, True):
                d, it, size, in_doc, in_item = search_long(hashes, first, items, array_words)
                if len(d):
                    ids = pa.chunked_array([p.column(0) for p in parts]).take(pa.array(d)).combine_chunks()
                    byte = where[first[d] + in_doc].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(items.ids[it]), pa.array(size.astype(np.int32)), pa.array(in_doc), pa.array(byte), pa.array(in_item.astype(np.int32))], ["doc_id", "item_id", "matched_words", "doc_word", "doc_byte", "item_word"])
            trim()

        one = docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def drop_affected(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, least_item: int = LEAST_ITEM, array_words: int = ARRAY_WORDS) -> DataFrame:
    """The rows that no test item affects, all columns as they were."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")
    schema = docs.schema
    for items in load_items(benchmark, min_words, least_item):

        def run(batches, items=items):
            for parts, hashes, first, _ in _runs(batches, at, array_words, False):
                hit = np.unique(search_long(hashes, first, items, array_words)[0])
                base = 0
                for part in parts:
                    own = hit[(hit >= base) & (hit < base + part.num_rows)] - base
                    base += part.num_rows
                    if not len(own):
                        yield part
                        continue
                    keep = np.ones(part.num_rows, bool)
                    keep[own] = False
                    yield part.filter(pa.array(keep))
            trim()

        docs = docs.mapInArrow(run, schema)
    return docs
