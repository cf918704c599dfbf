"""Pages of repeated keywords, link lists and product tags, told by pointwise mutual information."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixloom.llm.plaintext import FOLD

SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([-_*.+~·])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_])")
#: The sign of a tag and the names of its attributes; what the attributes say stays.
MARKUP = re.compile(r"</?[a-z][a-z0-9]*|[a-z-]+=(?=[\"'])")
#: Addresses (by scheme, by www, or dotted names), hashtags, words, figures and what code is written with.
TOKEN = re.compile(
    r"(?:[a-z][a-z0-9+.-]*://|www\.)[^\s<>\")\]|]+|[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?:/[^\s<>\")\]|]*)?(?![\w(])"
    r"|#[^\W\d_][\w-]*|[^\W\d_]+|\d+(?:[.,]\d+)*|[={}\\]"
)
WORD, FIGURE, SIGN = 0, 1, 2
TOTAL = np.int64(0)


@dataclass(frozen=True)
class Rules:
    """Thresholds of ``page_scores``. Rates are per word of the corpus, so they mean the same at any size.

    ``rate``: pairs below this rate say little (added to the observed and the expected rate).
    ``cap``: the most that one pair can add. ``reach``: a pair counts only if its words are
    frequent enough that their PMI could come to this. ``window``: neighbours on each side.
    ``coherent``: the mean PMI under which a place reads as salad. ``strong``: the PMI, and
    ``mutual`` the share of the commoner word's occurrences, from which a pair is a
    collocation; ``frequent``: or a pair of at least ``weak`` PMI that is this share of the
    page's; ``repeats`` times at least. ``repeated`` and ``linked``: what a repeated collocation, and a link or hashtag,
    add in place of their PMI. ``figures``: places with more figures than this are records.
    ``min_pairs`` and ``told``: the least pairs that must say something for a verdict, and their
    least share of a window's pairs.
    """

    rate: float = 2e-5
    cap: float = 2.0
    reach: float = 1.0
    window: int = 10
    coherent: float = 0.4
    strong: float = 5.0
    mutual: float = 0.05
    weak: float = 3.0
    frequent: float = 0.1
    repeats: int = 2
    repeated: float = -1.0
    linked: float = -1.0
    figures: float = 0.3
    min_pairs: int = 4
    told: float = 0.5
    min_share: float = 0.5


def page_tokens(text: str) -> list[str]:
    """Lower-case tokens of a page; words written letter by letter (b-e-l-t) are put together."""
    text = (text if text.isascii() else text.translate(FOLD)).lower()
    if "<" in text or "=" in text:
        text = MARKUP.sub(" ", text)
    if SPACED.search(text):
        text = SPACED.sub(lambda m: m[0].replace(m[1], ""), text)
    return TOKEN.findall(text)


def _mixed(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b << np.uint64(31)) | (b >> np.uint64(33)))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))).view(np.int64)


class Pages:
    """The tokens of some pages as arrays: number of the word, page, kind, length in characters.

    All links are one word, and so are all hashtags and all figures."""

    def __init__(self, texts: Iterable[str]):
        # no token spans white space, so each distinct stretch without it is taken apart once
        lists = [t.split() if t else [] for t in texts]
        self.n_pages = len(lists)
        stretch, distinct = pd.factorize(np.fromiter(chain.from_iterable(lists), dtype=object, count=sum(map(len, lists))))
        tokens = [page_tokens(x) for x in distinct]
        inside, names = pd.factorize(np.fromiter(chain.from_iterable(tokens), dtype=object, count=sum(map(len, tokens))))
        n = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        n_here = n[stretch] if len(stretch) else n
        begins = np.cumsum(n) - n
        at = np.arange(n_here.sum()) + np.repeat((begins[stretch] if len(stretch) else begins) - (np.cumsum(n_here) - n_here), n_here)
        raw = inside[at]
        self.page = np.repeat(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), n_here)
        kind = np.fromiter((FIGURE if w in "={}\\" or w[0].isdigit() and "://" not in w and not w[-1].isalpha() else SIGN if w[0] == "#" or "." in w or "://" in w else WORD for w in names), dtype=np.int8, count=len(names))
        classed = [w if k == WORD else "#" if k == FIGURE else "<tag>" if w[0] == "#" else "<link>" for w, k in zip(names, kind)]
        to, self.names = pd.factorize(np.array(classed, dtype=object))
        self.code = to[raw] if len(raw) else np.zeros(0, np.int64)
        self.kind = kind[raw] if len(raw) else np.zeros(0, np.int8)
        # a token and the blank after it
        self.chars = np.fromiter((len(w) + 1 for w in names), dtype=np.int64, count=len(names))[raw] if len(raw) else np.zeros(0, np.int64)
        self.hashes = pd.util.hash_array(np.asarray(self.names, dtype=object), categorize=False) if len(self.names) else np.zeros(0, np.uint64)
        self.joined = self.page[1:] == self.page[:-1]
        self.pair, pairs = pd.factorize(self.code[:-1].astype(np.int64) * max(1, len(self.names)) + self.code[1:])
        left, right = np.divmod(np.asarray(pairs, np.int64), max(1, len(self.names)))
        self.word_keys = _mixed(self.hashes, np.uint64(1))
        self.pair_keys = _mixed(self.hashes[left], self.hashes[right])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, counts) of all words and pairs, and of all words together under ``TOTAL``."""
        words = np.bincount(self.code, minlength=len(self.names))
        pairs = np.bincount(self.pair[self.joined], minlength=len(self.pair_keys))
        keys = np.concatenate(([TOTAL], self.word_keys, self.pair_keys))
        n = np.concatenate(([len(self.code)], words, pairs))
        return keys[n > 0], n[n > 0]


class Counts:
    """Counts by key, looked up by halving."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        order = np.argsort(keys, kind="stable")
        keys, n = np.asarray(keys, np.int64)[order], np.asarray(n, np.int64)[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.n = keys[first], np.add.reduceat(n, first) if len(keys) else n

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.n[at], 0)

    def over(self, other: Counts) -> Counts:
        """These counts, and those of ``other`` for keys that are not here."""
        new = self.of(other.keys) == 0
        return Counts(np.concatenate((self.keys, other.keys[new])), np.concatenate((self.n, other.n[new])))


def _in_page(items: np.ndarray, page: np.ndarray) -> np.ndarray:
    """How often each item occurs in its own page."""
    if not len(items):
        return np.zeros(0, np.int64)
    code, _ = pd.factorize(page.astype(np.int64) * (int(items.max()) + 1) + items)
    return np.bincount(code)[code]


def score(pages: Pages, corpus: Counts, rules: Rules = Rules()) -> pd.DataFrame:
    """(spam_share, mean_pmi, repeated) of each page; see ``page_scores``."""
    size = np.bincount(pages.page, minlength=pages.n_pages)
    out = pd.DataFrame({"spam_share": np.zeros(pages.n_pages), "mean_pmi": np.full(pages.n_pages, np.nan), "repeated": np.zeros(pages.n_pages)})
    if len(pages.code) < 2:
        return out
    total = max(1, int(corpus.of(np.array([TOTAL]))[0]))
    words = corpus.of(pages.word_keys)[pages.code].astype(float)
    rest = words - _in_page(pages.code, pages.page)
    pairs = corpus.of(pages.pair_keys)[pages.pair]
    # the last word of a page and the first of the next are no pair
    own = _in_page(np.where(pages.joined, pages.pair, len(pages.pair_keys)), pages.page[:-1]) * pages.joined
    # PMI in the rest of the corpus, of pairs whose words are frequent enough there to tell
    little = rules.rate * total
    common = np.minimum(rest[:-1], rest[1:])
    by_chance = rest[:-1] * rest[1:] / total
    with np.errstate(divide="ignore", invalid="ignore"):
        pmi = np.minimum(np.log((pairs - own + little) / (by_chance + little)), rules.cap)
        reached = np.log((common + little) / (by_chance + little))
    a, b = pages.kind[:-1], pages.kind[1:]
    word, figure = (a == WORD) & (b == WORD), (a == FIGURE) | (b == FIGURE)
    known = word & (common >= 3) & (reached >= rules.reach)
    # collocations that the page repeats, the page itself counted
    with np.errstate(divide="ignore", invalid="ignore"):
        strength = np.log(pairs * float(total) / (words[:-1] * words[1:]))
        mutual = pairs / np.maximum(words[:-1], words[1:])
    strong = (strength >= rules.strong) & (mutual >= rules.mutual)
    often = (strength >= rules.weak) & (own >= 3) & (own >= rules.frequent * size[pages.page[:-1]])
    repeated = pages.joined & (own >= rules.repeats) & (strong | often) & (word | (figure & (a != b)))
    value = np.where(repeated, rules.repeated, np.where(figure, np.nan, np.where(word, np.where(known, pmi, np.nan), rules.linked)))
    value[~pages.joined] = np.nan
    said = np.isfinite(value)
    sums, n = np.concatenate(([0.0], np.cumsum(np.where(said, value, 0.0)))), np.concatenate(([0], np.cumsum(said)))
    figures = np.concatenate(([0], np.cumsum(pages.kind == FIGURE)))
    first = np.concatenate(([0], np.cumsum(size)[:-1]))[pages.page]
    i = np.arange(len(pages.page))
    lo, hi = np.maximum(i - rules.window, first), np.minimum(i + rules.window, first + size[pages.page] - 1)
    seen = n[hi] - n[lo]
    mean = (sums[hi] - sums[lo]) / np.maximum(seen, 1)
    words_here = np.concatenate(([0], np.cumsum(pages.joined & ~figure)))
    told_enough = seen >= np.maximum(rules.min_pairs, rules.told * (words_here[hi] - words_here[lo]))
    records = (figures[hi + 1] - figures[lo]) > rules.figures * (hi + 1 - lo)
    spam = told_enough & (mean < rules.coherent) & ~records
    out["spam_share"] = np.bincount(pages.page, spam * pages.chars, minlength=pages.n_pages) / np.maximum(1, np.bincount(pages.page, pages.chars, minlength=pages.n_pages))
    told = pages.joined & known
    n_told = np.bincount(pages.page[:-1], told, minlength=pages.n_pages)
    out["mean_pmi"] = np.where(n_told > 0, np.bincount(pages.page[:-1], np.where(told, pmi, 0.0), minlength=pages.n_pages) / np.maximum(n_told, 1), np.nan)
    out["repeated"] = np.bincount(pages.page[:-1], repeated, minlength=pages.n_pages) / np.maximum(1, np.bincount(pages.page[:-1], pages.joined, minlength=pages.n_pages))
    return out


def _count_chunk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    keys, n = Pages(pdf["text"]).counts()
    return pd.DataFrame({"key": keys, "chunk": np.int64(key[0]), "n": n})


def page_scores(docs: DataFrame, *, rules: Rules = Rules(), chunk_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, spam_share, mean_pmi, repeated) of every page.

    A page is read as a row of words; all links count as one word, all hashtags as another.
    For each pair of neighbours the corpus gives the pointwise mutual information,
    log p(ab) / (p(a) p(b)), the page itself left out. At each place the mean PMI of the pairs
    around it is taken (``window``). In running text words that go together keep it high; in
    lists of keywords, tags and links neighbours have nothing to do with each other, and it is
    near zero: salad. A collocation (high PMI) that a page repeats counts ``repeated`` instead
    of its PMI each time it stands there, so excessive repetition pulls the mean down as salad
    does. ``spam_share`` is the share of the page's characters at places whose mean is below
    ``coherent``; ``mean_pmi`` is that of the whole page, ``repeated`` the share of repeated
    collocations among its pairs. Pairs of words that the rest of the corpus hardly holds say nothing (a
    language that no other page is in is no salad), nor do pairs with figures unless they are
    repeated; places with many figures are records.

    Counts are exact over all pages. Rows are dealt into chunks of about ``chunk_chars``
    characters by a hash; each chunk's words and pairs become one row per distinct one, under
    a 64-bit hash (two of 10^9 pairs share one with a chance of 3 %). Rows meet per key,
    at most one per chunk, and the totals go back to the chunks that hold the key elsewhere too,
    where pages are scored. So nothing is broadcast or read by the driver, and no key, document
    or source makes a group larger than a chunk or than the number of chunks.

    Null and blank texts, and texts of one word, score zero (``mean_pmi`` null). Rows with null
    ``doc_id`` are counted in the corpus and not reported. Of repeated rows the highest score
    is reported. Other columns are never read; empty tables give no rows.
    """
    docs = docs.select("doc_id", "text")
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    chunks = max(1, -(-chars // chunk_chars))
    tasks = max(chunks, docs.sparkSession.sparkContext.defaultParallelism)
    placed = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks))).repartition(min(tasks, 100_000), "chunk")
    counts = placed.groupBy("chunk").applyInPandas(_count_chunk, "key bigint, chunk bigint, n bigint")
    shared = counts.withColumn("total", F.sum("n").over(Window.partitionBy("key"))).where("total > n").select("chunk", "key", "total")
    shared = shared.repartition(min(tasks, 100_000), "chunk")

    columns = ["doc_id", "spam_share", "mean_pmi", "repeated"]

    def judge(pdf: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=columns)
        pages = Pages(pdf["text"])
        corpus = Counts(*pages.counts())
        if len(totals):  # an empty side comes without its columns
            corpus = Counts(totals["key"].to_numpy(np.int64), totals["total"].to_numpy(np.int64)).over(corpus)
        return pd.concat([pdf[["doc_id"]], score(pages, corpus, rules).set_index(pdf.index)], axis=1)[pdf["doc_id"].notna()][columns]

    scored = placed.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(judge, "doc_id bigint, spam_share double, mean_pmi double, repeated double")
    best = scored.groupBy("doc_id").agg(F.max(F.struct("spam_share", "mean_pmi", "repeated")).alias("best"))
    return best.select("doc_id", "best.spam_share", F.nanvl("best.mean_pmi", F.lit(None)).alias("mean_pmi"), "best.repeated")


def spam_pages(docs: DataFrame, *, rules: Rules = Rules(), chunk_chars: int = 2_000_000) -> DataFrame:
    """The rows of ``page_scores`` with a ``spam_share`` above ``min_share``: pages that are mostly
    repeated keywords, or lists of links, tags or products."""
    return page_scores(docs, rules=rules, chunk_chars=chunk_chars).where(F.col("spam_share") > rules.min_share)
