"""Test passages that stand in training texts: n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.llm.plaintext import words
from mixloom.session import bounded_rows

GRAM = 4


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """Smith-Waterman over words (match 2, mismatch and gap -1): best score, matched (item, doc) places.

    One row of the matrix at a time; gaps along the row by a running maximum.
    """
    n, m = len(item), len(doc)
    h = np.zeros((n + 1, m + 1), dtype=np.int32)
    slope = np.arange(m + 1, dtype=np.int32)
    for i in range(n):
        row = np.maximum(h[i, :-1] + np.where(doc == item[i], 2, -1), h[i, 1:] - 1)
        full = np.concatenate(([0], np.maximum(row, 0)))
        h[i + 1] = np.maximum.accumulate(full + slope) - slope
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, pairs = int(h[i, j]), []
    while i > 0 and j > 0 and h[i, j] > 0:
        same = doc[j - 1] == item[i - 1]
        if h[i, j] == h[i - 1, j - 1] + (2 if same else -1):
            if same:
                pairs.append((int(i - 1), int(j - 1)))
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return score, pairs[::-1]


def align_many(jobs: list[tuple[np.ndarray, np.ndarray]], least: int, cells: int = 4_000_000) -> list[tuple[int, list[tuple[int, int]]]]:
    """``align`` of each (item, doc), many at a time; the matched places only of scores of at least ``least``.

    Shorter ones are filled up with words that match nothing: cells there stay below the best score."""
    out: list = [None] * len(jobs)
    order = sorted(range(len(jobs)), key=lambda x: (len(jobs[x][1]), len(jobs[x][0])))
    while order:
        own, n, m = [], 0, 0
        while order and (not own or (len(own) + 1) * (max(n, len(jobs[order[-1]][0])) + 1) * (m + 1) <= cells):
            own.append(order.pop())
            n, m = max(n, len(jobs[own[-1]][0])), max(m, len(jobs[own[-1]][1]))
        kind = np.int16 if 3 * (n + m) < 32_000 and max(int(jobs[x][0].max(initial=0)) for x in own) < 32_000 else np.int32
        item, doc = np.full((len(own), n), -3, dtype=kind), np.full((len(own), m), -4, dtype=kind)
        for b, x in enumerate(own):
            item[b, : len(jobs[x][0])], doc[b, : len(jobs[x][1])] = jobs[x]
            doc[b, : len(jobs[x][1])][jobs[x][1] > np.iinfo(kind).max] = -1
        # h[i, b, j] holds the score plus j: a gap along the row then costs nothing
        slope = np.arange(m + 1, dtype=kind)
        h = np.empty((n + 1, len(own), m + 1), dtype=kind)
        h[0], h[:, :, 0] = slope, 0
        gain, down = np.empty((len(own), m), dtype=kind), np.empty((len(own), m), dtype=kind)
        for i in range(n):
            row = h[i + 1, :, 1:]
            np.multiply(doc == item[:, i, None], kind(3), out=gain)
            np.add(h[i, :, :-1], gain, out=row)
            np.subtract(h[i, :, 1:], kind(1), out=down)
            np.maximum(row, down, out=row)
            np.maximum(row, slope[1:], out=row)
            np.maximum.accumulate(row, axis=1, out=row)
        h -= slope
        tops = h.max(axis=2)
        at, value = tops.argmax(axis=0), h.item
        for b, x in enumerate(own):
            i = int(at[b])
            j, score, pairs = int(h[i, b].argmax()), int(tops[i, b]), []
            if score >= least:
                left, right, here = jobs[x][0].tolist(), jobs[x][1].tolist(), score
                while i > 0 and j > 0 and here > 0:
                    same, before = right[j - 1] == left[i - 1], value(i - 1, b, j - 1)
                    if here == before + (2 if same else -1):
                        if same:
                            pairs.append((i - 1, j - 1))
                        i, j, here = i - 1, j - 1, before
                    elif here == value(i - 1, b, j) - 1:
                        i, here = i - 1, here + 1
                    else:
                        j, here = j - 1, value(i, b, j - 1)
            out[x] = (score, pairs[::-1])
    return out


def pieces_of(pairs: list[tuple[int, int]], max_break: int, least: int) -> list[tuple[int, int, int, int]]:
    """Stretches (item first, item last, doc first, doc last) of an alignment without a break of
    more than ``max_break`` unmatched words, of at least ``least`` item words, mostly matched."""
    out, run = [], []
    for p in [*pairs, None]:
        if run and (p is None or p[0] - run[-1][0] > max_break + 1 or p[1] - run[-1][1] > max_break + 1):
            span = run[-1][0] - run[0][0] + 1
            if span >= least and len(run) >= 0.65 * span and len(run) >= 0.6 * (run[-1][1] - run[0][1] + 1):
                out.append((run[0][0], run[-1][0], run[0][1], run[-1][1]))
            run = []
        if p is not None:
            run.append(p)
    return out


def best_chain(pieces: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The pieces, in item and document order at once, that cover the most item words."""
    pieces = sorted(pieces, key=lambda p: p[3])
    best: list[tuple[int, list]] = []
    for k, (a, b, c, d) in enumerate(pieces):
        top, chain = b - a + 1, [pieces[k]]
        for q, (_, b2, _, d2) in enumerate(pieces[:k]):
            if b2 < a and d2 < c and best[q][0] + b - a + 1 > top:
                top, chain = best[q][0] + b - a + 1, [*best[q][1], pieces[k]]
        best.append((top, chain))
    return max(best, key=lambda x: x[0])[1] if best else []


def mended(line: list[str], known: set[str]) -> list[str]:
    """Joins neighbours that are the halves of a known word, unless both are known themselves."""
    out: list[str] = []
    for w in line:
        if out and out[-1] + w in known and not (out[-1] in known and w in known):
            out[-1] += w
        else:
            out.append(w)
    return out


def _hashed(*codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = codes[0].astype(np.uint64)
        for c in codes[1:]:
            x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (c.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return x


class Seeds:
    """Places (item number, place, width) of seeds by hashed key. A shared hash gives a candidate more, never one less."""

    BITS = 20

    def __init__(self, parts: list[tuple[np.ndarray, int, np.ndarray, int]]):
        keys = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)])
        order = np.argsort(keys, kind="stable")
        self.item, self.at, self.width = (np.concatenate([np.broadcast_to(np.int64(x) if np.isscalar(x) else x, len(p[0])) for p in parts for x in (p[i],)] or [np.zeros(0, np.int64)])[order] for i in (1, 2, 3))
        keys = keys[order]
        self.keys, self.first, self.n = np.unique(keys, return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << self.BITS, dtype=bool)
        self.maybe[self.keys >> np.uint64(64 - self.BITS)] = True

    def hits(self, keys: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, item, item place, width) for each seed that has the key of a place."""
        some = self.maybe[keys >> np.uint64(64 - self.BITS)]
        keys, where = keys[some], where[some]
        if not len(keys) or not len(self.keys):
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = self.keys[k] == keys
        k, where = k[same], where[same]
        n = self.n[k]
        e = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(where, n), self.item[e], self.at[e], self.width[e]


class Items:
    """The test items: words, seeds, and vocabulary. Items of equal words have one number.

    Seeds are the word 4-grams, and pairs of rare words with at most ``max_break`` words between
    them: words that at most ``rare`` of the items hold, or five."""

    def __init__(self, items: list[tuple[int, str]], max_break: int = 3, rare: float = 0.1):
        same: dict[tuple, list[int]] = defaultdict(list)
        for i, t in items:
            same[tuple(words(t))].append(i)
        self.ids = list(same.values())
        self.lines = [list(line) for line in same]
        self.number: dict[str, int] = {}
        for line in self.lines:
            for w in line:
                self.number.setdefault(w, len(self.number))
        self.heads = {w[:i] for w in self.number for i in range(1, len(w))}
        self.tails = {w[i:] for w in self.number for i in range(1, len(w))}
        self.coded = [np.array([self.number[w] for w in line], dtype=np.int32) for line in self.lines]
        self.max_break = max_break
        held = np.zeros(len(self.number), np.int64)
        for code in self.coded:
            held[np.unique(code)] += 1
        is_rare = held <= max(5, rare * len(self.lines))
        whole, parts = [], []
        for k, code in enumerate(self.coded):
            if len(code) >= GRAM:
                at = np.arange(len(code) - GRAM + 1)
                whole.append((_hashed(*(code[at + i] for i in range(GRAM))), k, at, GRAM))
            for d in range(1, max_break + 2):
                at = np.flatnonzero(is_rare[code[:-d]] & is_rare[code[d:]]) if len(code) > d else np.zeros(0, np.int64)
                parts.append((_hashed(code[at], code[at + d]), k, at, d + 1))
        self.rare = np.append(is_rare, False)  # no word is number -1
        self.grams, self.pairs = Seeds(whole), Seeds(parts)

    def codes(self, lines: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the lines' words, -1 for words of no item, broken words mended."""
        sizes = [len(x) for x in lines]
        flat, names = pd.factorize(np.fromiter(chain.from_iterable(lines), dtype=object, count=sum(sizes)))
        number = np.fromiter((self.number.get(w, -1) for w in names), dtype=np.int32, count=len(names))
        ends = np.cumsum(sizes)
        if len(flat) < 2:
            return [np.zeros(0, np.int32) if not n else number[flat] for n in sizes]
        code = number[flat]
        head = np.fromiter((w in self.heads for w in names), dtype=bool, count=len(names))[flat]
        tail = np.fromiter((w in self.tails for w in names), dtype=bool, count=len(names))[flat]
        halves = head[:-1] & tail[1:] & ((code[:-1] < 0) | (code[1:] < 0))
        out = [code[e - n : e] for e, n in zip(ends, sizes)]
        for d in np.unique(np.searchsorted(ends, np.flatnonzero(halves), side="right")):
            line = mended(lines[d], self.number.keys())
            if len(line) < len(lines[d]):
                out[d] = np.array([self.number.get(w, -1) for w in line], dtype=np.int32)
        return out


def _near(place: np.ndarray, at: np.ndarray, width: int, drift: int, least: int) -> np.ndarray:
    """Which of some hits, sorted by place, have ``least`` - 1 others within ``width`` words and ``drift`` of shift."""
    shift = place - at
    near = np.ones(len(place), dtype=int)
    for step in range(1, len(place)):
        close = (place[step:] - place[:-step] <= width)
        if not close.any():
            break
        close &= np.abs(shift[step:] - shift[:-step]) <= drift
        near[step:] += close
        near[:-step] += close
    return near >= least


def candidates(items: Items, lines: list[list[str]], block: int, share: float = 1 / 8, cluster: int = 4) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(line, item number, place, words there) of the stretches of the lines to align with items.

    A line and an item meet if 4-grams of the item that the line holds cover ``share`` of the
    item, or its rare pairs do, of those that stand in clusters (``cluster`` within as many
    words as a shortest piece may take, about as far apart as in the item)."""
    coded = items.codes(lines)
    sizes = np.array([len(x) for x in items.lines])
    gap = items.max_break + 2
    offsets = np.cumsum([0, *(len(c) + gap for c in coded)])
    code = np.full(offsets[-1], -1, dtype=np.int64)
    for c, o in zip(coded, offsets):
        code[o : o + len(c)] = c
    known, rare = code >= 0, items.rare[code]
    found = []
    for width, table in [(GRAM, items.grams), *((d + 1, items.pairs) for d in range(1, items.max_break + 2))]:
        if len(code) < width:
            continue
        ends = (0, width - 1) if table is items.pairs else range(width)
        parts = [slice(i, len(code) - width + 1 + i) for i in ends]
        at = np.flatnonzero(np.logical_and.reduce([(rare if table is items.pairs else known)[p] for p in parts]))
        place, item, i, w = table.hits(_hashed(*(code[p][at] for p in parts)), at)
        found.append((place, item, i, w, np.full(len(place), table is items.pairs), np.full(len(place), width)))
    if not found:
        return
    place, item, i, w, paired, here = (np.concatenate(x) for x in zip(*found))
    line = np.searchsorted(offsets, place, side="right") - 1
    order = np.lexsort((place, item, line))
    place, item, i, w, paired, here, line = (x[order] for x in (place, item, i, w, paired, here, line))
    if not len(place):
        return
    begins = np.concatenate(([0], np.flatnonzero((np.diff(line) != 0) | (np.diff(item) != 0)) + 1))
    needed = np.maximum(GRAM, share * sizes[item[begins]])
    # what the hits can cover at most, be it by 4-grams or by pairs in clusters
    by_grams = np.add.reduceat(np.where(paired, 0, GRAM), begins)
    n_pairs = np.add.reduceat(paired.astype(np.int64), begins)
    by_pairs = np.where(n_pairs >= cluster, 2 * n_pairs, 0)
    ends = np.append(begins[1:], len(place))
    for g in np.flatnonzero((by_grams >= needed) | (by_grams + by_pairs >= needed)).tolist():
        lo, hi, least = int(begins[g]), int(ends[g]), float(needed[g])
        k, d = int(item[lo]), int(line[lo])
        n = len(items.lines[k])
        grams = ~paired[lo:hi]
        covered = np.zeros(n, dtype=bool)
        for x in i[lo:hi][grams].tolist():
            covered[x : x + GRAM] = True
        used = grams
        if covered.sum() < least:
            p = np.flatnonzero(~grams)
            if 2 * len(p) < least:
                continue
            p = p[_near(place[lo:hi][p], i[lo:hi][p], 14, 8, cluster)]
            covered[np.concatenate((i[lo:hi][p], i[lo:hi][p] + w[lo:hi][p] - 1))] = True
            if covered.sum() < least:
                continue
            used = np.concatenate((np.flatnonzero(grams), p))
        own = coded[d]
        # stretches of the document around the hits, cut where hits are far apart
        stretches: list[list[int]] = []
        for at in np.unique(place[lo:hi][used] - offsets[d]).tolist():
            a, z = max(0, at - n - 8), min(len(own), at + n + 8)
            if stretches and a <= stretches[-1][1]:
                stretches[-1][1] = z
            else:
                stretches.append([a, z])
        for a, z in stretches:
            for begin in range(a, z, block):
                yield d, k, begin, own[begin : min(z, begin + block + 2 * n)].copy()


def leaked_in(items: Items, lines: list[list[str]], *, min_share: float, min_piece: int, max_break: int = 3, block: int = 4096) -> list[tuple[int, int, float, int]]:
    """(line, item number, share of its words, pieces) of the items that the lines leak."""
    jobs = list(candidates(items, lines, block))
    pieces: dict[tuple[int, int], set] = defaultdict(set)
    while jobs:
        again = []
        for job, (score, pairs) in zip(jobs, align_many([(items.coded[k], doc) for _, k, _, doc in jobs], min_piece + 2)):
            if score >= min_piece + 2:
                at, k, begin, doc = job
                pieces[at, k].update((a, b, c + begin, d + begin) for a, b, c, d in pieces_of(pairs, max_break, min_piece))
                doc[pairs[0][1] : pairs[-1][1] + 1] = -2
                again.append(job)
        jobs = again
    out = []
    for (at, k), own in pieces.items():
        chain = best_chain(sorted(own))
        share = sum(b - a + 1 for a, b, _, _ in chain) / len(items.lines[k])
        if share >= min_share:
            out.append((at, k, share, len(chain)))
    return out


def leaked(items: Items, line: list[str], **rules) -> list[tuple[int, float, int]]:
    """(item number, share of its words, pieces) of the items that ``line`` leaks."""
    return [found[1:] for found in leaked_in(items, [line], **rules)]


def eval_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    min_share: float = 1 / 3,
    min_piece: int = 8,
    max_items: int = 20_000,
) -> DataFrame:
    """(doc_id, item_id, share, n_pieces): documents in which at least ``min_share`` of an item's
    words stand in the item's order, in pieces of at least ``min_piece`` words.

    Every document is scanned for the items' seeds: word 4-grams, common ones too, and pairs of
    words that at most a tenth of the items (or five) hold, with up to three words between
    (``Items``); what is reported of a document does not depend on the others. Where either kind covers at
    least an eighth of an item (``candidates``), Smith-Waterman alignment over words finds the
    pieces, in which up to a good third of the words may be changed, dropped or added singly
    (``pieces_of``). Items of equal words are aligned once and reported each.

    The items, at most ``max_items`` (more is an error), are held by every task; documents are
    never shuffled.

    Null texts and texts of fewer than four words leak nothing and hold nothing. Of repeated
    item rows one counts; equal texts under several ids are reported for each. Every document
    row is scanned, repeated ones are reported once. Other columns are never read.
    """
    spark = docs.sparkSession
    rows = bounded_rows(items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct(), max_items, "test items")
    known = Items(sorted((r.item_id, r.text) for r in rows))
    everywhere = spark.sparkContext.broadcast(known)

    def find(batches: Iterator) -> Iterator:
        own = everywhere.value
        for pdf in batches:
            pdf = pdf[pdf["text"].astype(bool)]
            for at in range(0, len(pdf), 500):
                docs_here, texts = pdf["doc_id"].iloc[at : at + 500].tolist(), pdf["text"].iloc[at : at + 500]
                found = leaked_in(own, [words(t) for t in texts], min_share=min_share, min_piece=min_piece)
                out = [(docs_here[d], i, share, n) for d, k, share, n in found for i in own.ids[k]]
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "item_id", "share", "n_pieces"])

    found = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(find, "doc_id bigint, item_id bigint, share double, n_pieces int")
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "n_pieces")).alias("best")).select("doc_id", "item_id", "best.share", "best.n_pieces")
