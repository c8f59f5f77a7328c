"""Evaluation texts that leaked into a corpus: a prefix-filtered set join.

Items are sets of word shingles.  A first pass over the documents counts in how
many of them each shingle stands.  An item's ``n`` shingles are ordered by that rarity,
and a document is a candidate only if it shares ``l`` of the item's first
``n - t + l``, which every document with ``t`` shared shingles must (``l`` is half
of ``t``, so the most frequent shingles bring no candidates).  These, and ``t`` of
all the item's shingles, must lie within one item-sized window (positional and
length bound); what remains is verified word by word, in
the item's order, in one place or two close to each other.  Only what leaked is
written.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.words import words

#: An item leaked if this share of its words is held: half is asked for, of which one word in ten may be changed.
SHARE = 0.45
#: Shared shingles that a leak must have at least, as a share of the item's.
OVERLAP = 0.2
#: Two places are close to each other if no more words than the item's and ``REACH`` lie between them; words that
#: agree in order count where no more than ``GAP`` lie between two runs.
REACH, GAP = 60, 12
#: Items are taken in blocks of about so many words; below it three words fit one number exactly.
WORDS_PER_BLOCK = 2_000_000


def shingle_size(n_words: int) -> int:
    """Words in a shingle of an item: short items need short ones, down to single words."""
    return 3 if n_words >= 12 else 2 if n_words >= 6 else 1


class ItemIndex:
    """Vocabulary and shingles of one block of items, shipped to the tasks."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, texts = [], []
        for item_id, text in items:
            found = words(text or "")
            if found:
                self.ids.append(item_id)
                texts.append(found)
        self.vocabulary: dict[str, int] = {}
        self.items = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in t], dtype=np.int64) for t in texts]
        self.base = np.uint64(len(self.vocabulary) + 1)
        self.size = np.array([shingle_size(len(x)) for x in self.items], dtype=np.int64)
        # Shingles are numbered size after size, within a size in the order of their codes.
        self.codes: dict[int, np.ndarray] = {}
        self.first: dict[int, int] = {}
        self.n_shingles = 0
        of_item: list[np.ndarray] = [np.empty(0, np.int64)] * len(self.items)
        for s in sorted(set(self.size.tolist())):
            own = np.flatnonzero(self.size == s)
            coded = [self._codes(self.items[k], np.arange(len(self.items[k]) - s + 1), s) for k in own]
            self.codes[s], self.first[s] = np.unique(np.concatenate(coded)), self.n_shingles
            for k, c in zip(own, coded):
                of_item[k] = np.searchsorted(self.codes[s], c) + self.n_shingles
            self.n_shingles += len(self.codes[s])
        self.of_item = of_item
        self.need = np.array([max(1, int(OVERLAP * len(np.unique(x)))) for x in of_item], dtype=np.int64)
        self.least = -(-self.need // 2)
        self.width = np.array([2 * (len(x) + REACH) for x in self.items], dtype=np.int64)
        # Shingle -> (item, position in it), as offsets into flat arrays.
        flat = np.concatenate(of_item) if of_item else np.empty(0, np.int64)
        item = np.repeat(np.arange(len(of_item)), [len(x) for x in of_item])
        at = np.concatenate([np.arange(len(x)) for x in of_item]) if of_item else flat
        order = np.argsort(flat, kind="stable")
        self.item, self.at = item[order], at[order]
        self.begin = np.searchsorted(flat[order], np.arange(self.n_shingles + 1))

    def _codes(self, x: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        code = np.zeros(len(at), dtype=np.uint64)
        for k in range(size):
            code = code * self.base + x[at + k].astype(np.uint64)
        return code

    def order(self, frequency: np.ndarray) -> None:
        """Fix the rarity order and with it the prefixes."""
        self.in_prefix = np.zeros(len(self.item), dtype=bool)
        for k, s in enumerate(self.of_item):
            distinct = np.unique(s)
            ranked = distinct[np.argsort(frequency[distinct], kind="stable")]
            for x in ranked[: len(ranked) - self.need[k] + self.least[k]].tolist():
                lo, hi = self.begin[x], self.begin[x + 1]
                self.in_prefix[lo:hi] |= self.item[lo:hi] == k
        self.prefix = np.zeros(self.n_shingles, dtype=bool)
        self.prefix[np.repeat(np.arange(self.n_shingles), np.diff(self.begin))[self.in_prefix]] = True

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the texts one after another, 0 for words of no item and after each text; and where texts begin."""
        get = self.vocabulary.get
        found = [words(t) for t in texts]
        begin = np.concatenate([[0], np.cumsum([len(f) + 1 for f in found])]).astype(np.int64)
        x = np.fromiter(chain.from_iterable(chain(map(get, f, repeat(0)), (0,)) for f in found), np.int64, begin[-1])
        return x, begin

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``x`` at which a shingle of an item begins, and which."""
        known = x > 0
        at, what = [], []
        for size, codes in self.codes.items():
            here = known[: len(x) - size + 1].copy()
            for k in range(1, size):
                here &= known[k : len(x) - size + 1 + k]
            here = np.flatnonzero(here)
            own = self._codes(x, here, size)
            place = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            same = codes[place] == own
            at.append(here[same])
            what.append(place[same] + self.first[size])
        return (np.concatenate(at), np.concatenate(what)) if at else (np.empty(0, np.int64), np.empty(0, np.int64))

    def spread(self, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hit all entries of its shingle in ``item`` and ``at``: (hit, entry)."""
        n = self.begin[what + 1] - self.begin[what]
        hit = np.repeat(np.arange(len(what)), n)
        return hit, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.begin[what][hit]


def _frequency(index: ItemIndex, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many documents each shingle stands."""
    total = np.zeros(index.n_shingles, dtype=np.int64)
    for pdf in batches:
        x, begin = index.read(pdf["text"].tolist())
        at, what = index.hits(x)
        pairs = np.unique((np.searchsorted(begin, at, "right") - 1) * index.n_shingles + what)
        total += np.bincount(pairs % index.n_shingles, minlength=index.n_shingles)
    some = np.flatnonzero(total)
    yield pd.DataFrame({"shingle": some, "n": total[some]})


def _lcs(a: list[int], b: list[int]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y and x else max(row[j], row[j - 1])
    return row[-1]


def held_words(item: np.ndarray, doc: np.ndarray, anchors: list[tuple[int, int]], size: int) -> int:
    """Most words of ``item`` that ``doc`` holds in the item's order within two close places.

    ``anchors`` are (position in doc, position in item) of equal shingles.  They
    join to runs; chains of runs that rise in both texts, without a jump of more
    than the item's length plus ``REACH`` words, count their words and those that
    agree in order within gaps of at most ``GAP`` words.
    """
    runs: dict[int, list[list[int]]] = {}
    for d, q in sorted(anchors):
        line = runs.setdefault(d - q, [])
        if line and d <= line[-1][1]:
            line[-1][1] = d + size
        else:
            line.append([d, d + size])
    blocks = sorted((d0, d1, d0 - shift, d1 - shift) for shift, line in runs.items() for d0, d1 in line)
    blocks = [(d0, min(d1, len(doc)), q0, min(q1, len(item))) for d0, d1, q0, q1 in blocks]
    far = len(item) + REACH
    best: list[tuple[int, int]] = []
    top = 0
    for n, (d0, d1, q0, q1) in enumerate(blocks):
        own = q1 - q0
        score, start = own, d0
        for m in range(n - 1, -1, -1):
            e0, e1, p0, p1 = blocks[m]
            if d0 - e0 > far + len(item):
                break  # a run is no longer than the item, so all earlier ones are too far
            if p0 >= q0 or p1 >= q1 or e1 >= d1 or d0 - e1 > far:
                continue
            total, began = best[m]
            if d1 - began > 2 * far:
                continue
            more = own - max(0, p1 - q0, e1 - d0)
            dg, qg = d0 - e1, q0 - p1
            if 0 < dg <= GAP and 0 < qg <= GAP:
                more += _lcs(item[p1:q0].tolist(), doc[e1:d0].tolist())
            if total + more > score:
                score, start = total + more, began
        # Words before the first run and behind the last that agree one by one are left out: they are few.
        best.append((score, start))
        top = max(top, score)
    return top


def most_within(place: np.ndarray, what: np.ndarray, width: int) -> int:
    """Most different values of ``what`` in a window of ``width`` places (ascending)."""
    ends = np.searchsorted(place, place + width, "right")
    if (ends - np.arange(len(place))).max() == len(place):
        return len(np.unique(what))
    counts: dict[int, int] = {}
    values, most, hi = what.tolist(), 0, 0
    for lo, end in enumerate(ends.tolist()):
        for x in values[hi:end]:
            counts[x] = counts.get(x, 0) + 1
        hi = end
        most = max(most, len(counts))
        x = values[lo]
        if counts[x] == 1:
            del counts[x]
        else:
            counts[x] -= 1
    return most


def candidates(index: ItemIndex, x: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(document, item, anchors) that pass the prefix filter and the bounds on shared shingles and their positions."""
    at, what = index.hits(x)
    order = np.argsort(at, kind="stable")
    at, what = at[order], what[order]
    doc = np.searchsorted(begin, at, "right") - 1
    n = len(index.items)
    # Enough shingles of the prefix within one window.
    first = np.flatnonzero(index.prefix[what])
    hit, entry = index.spread(what[first])
    keep = index.in_prefix[entry]
    hit = first[hit[keep]]
    pair, place = doc[hit] * n + index.item[entry[keep]], at[hit]
    order = np.argsort(pair, kind="stable")
    pair, place = pair[order], place[order]
    item = pair % n
    last = np.arange(len(pair)) + index.least[item] - 1
    inside = np.flatnonzero(last < len(pair))
    last = last[inside]
    inside = inside[(pair[last] == pair[inside]) & (place[last] - place[inside] <= index.width[item[inside]])]
    # Enough different shingles of all within one window.
    for d, k in zip(*divmod(np.unique(pair[inside]), n)):
        lo, hi = np.searchsorted(at, (begin[d], begin[d + 1]))
        hit, entry = index.spread(what[lo:hi])
        own = index.item[entry] == k
        place, within = at[lo:hi][hit[own]], index.at[entry[own]]
        if most_within(place, index.of_item[k][within], int(index.width[k])) >= index.need[k]:
            yield int(d), int(k), list(zip((place - begin[d]).tolist(), within.tolist()))


def _leaks(index: ItemIndex, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids = pdf["doc_id"].to_numpy()
        x, begin = index.read(pdf["text"].tolist())
        out = [
            (ids[d], index.ids[k])
            for d, k, anchors in candidates(index, x, begin)
            if held_words(index.items[k], x[begin[d] : begin[d + 1] - 1], anchors, int(index.size[k])) >= SHARE * len(index.items[k])
        ]
        yield pd.DataFrame(out, columns=["doc_id", "item_id"])


def leaked_items(documents: DataFrame, items: DataFrame, words_per_block: int = WORDS_PER_BLOCK) -> DataFrame:
    """(doc_id, item_id): documents that hold at least about half of an item's words in its order.

    ``documents``: doc_id, text; ``items``: item_id, text; other columns are
    ignored.  Null or blank texts hold nothing and texts without words are never
    found.  An item of fewer than twelve words has shingles of two words, below six
    of one.  A doc_id or item_id given several times counts if any of its texts
    match, once.  Whole texts are read, twice: to count shingles and to find the
    items.  Items are the stated query set: they are taken in blocks of about
    ``words_per_block`` words, each block's index goes to the tasks and all
    documents are held against it.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    items = items.select(F.col("item_id"), "text").where("item_id is not null and text is not null")
    kind = dict(items.dtypes)["item_id"]
    # No text has more words than half its characters, rounded up.
    blocks = max(1, -(-int(items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0) // words_per_block))
    found = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        index = ItemIndex([(r["item_id"], r["text"]) for r in own])
        counted = docs.select("text").mapInPandas(lambda it, index=index: _frequency(index, it), "shingle int, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        frequency = np.zeros(index.n_shingles, dtype=np.int64)
        for r in counted.collect():  # at most the block's own shingles
            frequency[r["shingle"]] = r["n"]
        index.order(frequency)
        part = docs.mapInPandas(lambda it, index=index: _leaks(index, it), f"doc_id long, item_id {kind}")
        found = part if found is None else found.unionAll(part)
    return found.distinct()
