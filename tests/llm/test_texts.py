"""Leaks of test items, and spam pages."""

import random

import numpy as np
import pytest

from mixloom.llm.leaks import Items, align, align_many, best_chain, eval_leaks, leaked, leaked_in, pieces_of
from mixloom.llm.plaintext import words
from mixloom.llm import spam
from mixloom.llm.spam import Counts, Pages, Rules, page_scores, page_tokens, score, spam_pages

DOCS = "doc_id bigint, text string, item_id string, share string"
ITEMS = "item_id bigint, text string, suite string, doc_id string"


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n))


def test_plain_words():
    assert words("<b>Bold</b>&amp;<i>Plain</i> wоrd ﬁne ｗｉｄｅ co​de so\xadft") == ["bold", "plain", "word", "fine", "wide", "code", "soft"]
    assert words("hyphen-\n> ated line\nbreak") == ["hyphenated", "line", "break"]
    assert words("") == [] and words("…\n—") == []


def brute_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_alignment_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.integers(0, 6, rng.integers(1, 25)), rng.integers(0, 6, rng.integers(1, 30))
        score, pairs = align(a, b)
        assert score == brute_score(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_pieces_and_chains():
    assert pieces_of([(i, i + 5) for i in range(8)], 3, 8) == [(0, 7, 5, 12)]
    assert pieces_of([(i, i) for i in range(7)], 3, 8) == []
    assert best_chain([(0, 9, 50, 59), (10, 19, 0, 9), (10, 25, 70, 85)]) == [(0, 9, 50, 59), (10, 25, 70, 85)]
    assert best_chain([]) == []


ITEM = prose(1, 60)
LINE = ITEM.split()


def variants():
    rng = random.Random(7)
    edited = list(LINE)
    for i in range(5, 60, 9):
        edited[i] = "changed"
    del edited[20]
    edited.insert(40, "added")
    out = {
        1: prose(50) + " " + ITEM + " " + prose(51),
        2: " ".join(edited),
        3: prose(52) + "\n> " + " ".join(LINE[:14]).upper() + "\n" + prose(53) + "\n**" + " ".join(LINE[30:44]) + "**",
        4: ITEM.replace("a", "а").replace("o", "о"),  # Cyrillic
        5: "​".join(ITEM),
        6: " ".join(w[:2] + "-\n" + w[2:] if i % 4 == 0 and len(w) > 4 else w for i, w in enumerate(LINE)),
        7: "<p>" + " ".join(f"<b>{w}</b>" for w in LINE) + "</p>",
        20: " ".join(LINE[:12]) + " " + prose(54),  # a fifth
        21: " ".join(rng.sample(LINE, 60)),
        22: " ".join(LINE[30:44]) + " " + prose(55) + " " + " ".join(LINE[:6]),
        23: prose(56),
        24: None,
        25: "",
        26: "one two",
    }
    return out


def test_leaks(spark):
    texts = variants()
    rows = [(k, v, "c", "c") for k, v in texts.items()] + [(1, texts[1], "c", "c"), (None, ITEM, "c", "c")]
    items = [(100, ITEM, "s", "c"), (100, ITEM, "s", "c"), (101, prose(2, 50), "s", "c"), (102, None, "s", "c"), (None, ITEM, "s", "c"), (103, "", "s", "c"), (104, ITEM, "s", "c")]
    got = {(r.doc_id, r.item_id) for r in eval_leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(d, i) for d in range(1, 8) for i in (100, 104)}


def test_leaks_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, ITEM, "c", "c")], DOCS), spark.createDataFrame([(1, ITEM, "s", "c")], ITEMS)
    assert eval_leaks(docs.where("doc_id > 5"), items).count() == 0
    assert eval_leaks(docs, items.where("item_id > 5")).count() == 0


def test_an_item_copied_everywhere_is_still_found(spark):
    docs = spark.createDataFrame([(i, prose(i + 300, 20) + " " + ITEM, "c", "c") for i in range(60)], DOCS)
    items = spark.createDataFrame([(1, ITEM, "s", "c"), (2, prose(9), "s", "c")], ITEMS)
    assert eval_leaks(docs, items).count() == 60


def test_twins_and_shared_passages_copied_everywhere_are_still_found(spark):
    shared = prose(11, 40)
    docs = spark.createDataFrame([(i, prose(i + 300, 20) + " " + ITEM + " " + shared, "c", "c") for i in range(60)], DOCS)
    items = spark.createDataFrame([(1, ITEM, "s", "c"), (2, ITEM, "s", "c"), (3, shared + " " + prose(12, 30), "s", "c"), (4, prose(13, 30) + " " + shared, "s", "c")], ITEMS)
    got = {(r.doc_id, r.item_id) for r in eval_leaks(docs, items).collect()}
    assert got == {(d, i) for d in range(60) for i in (1, 2, 3, 4)}


def test_alignments_at_once_are_those_one_by_one():
    rng = np.random.default_rng(1)
    jobs = [(rng.integers(0, 6, rng.integers(1, 25)), rng.integers(0, 6, rng.integers(1, 30))) for _ in range(60)]
    assert align_many(jobs, 0, cells=5000) == [align(a, b) for a, b in jobs]


def test_long_text_with_a_late_leak():
    known = Items([(1, ITEM)])
    line = words(prose(3, 30_000) + " " + ITEM + " " + prose(4, 500))
    assert [(k, n) for k, _, n in leaked(known, line, min_share=1 / 3, min_piece=8)] == [(0, 1)]


@pytest.mark.parametrize("every", [4, 3])
def test_edits_leave_no_item_unfound(every):
    rng = random.Random(3)
    lines = [prose(600 + k, rng.randint(40, 150)).split() for k in range(40)]
    known = Items([(k, " ".join(line)) for k, line in enumerate(lines)])
    for line in lines:
        for i in range(every - 1, len(line), every):
            line[i] = prose(rng.randint(1000, 9999), 1)
    got = {(a, k) for a, k, _, _ in leaked_in(known, lines, min_share=1 / 3, min_piece=8)}
    assert got == {(k, k) for k in range(40)}


def test_a_leak_with_every_third_word_broken_is_found():
    known = Items([(1, ITEM)])
    line = words(" ".join(w[:3] + "\n" + w[3:] if i % 3 == 0 and len(w) > 3 else w for i, w in enumerate(LINE)))
    fours = lambda x: set(zip(*(x[i:] for i in range(4))))
    assert fours(LINE).isdisjoint(fours(line))
    assert [(k, share) for k, share, _ in leaked(known, line, min_share=1 / 3, min_piece=8)] == [(0, 1.0)]


RECIPE = """\
Pancakes for four
Ingredients: 250 g flour, 2 eggs, 400 ml milk, a pinch of salt, butter for the pan.
Whisk the flour and the salt in a large bowl.
Make a well in the middle and crack the eggs into it.
Pour in half of the milk and stir until the batter is smooth.
Add the rest of the milk and let the batter rest for 20 minutes.
Heat a little butter in a frying pan over medium heat.
Pour in a ladle of batter and tilt the pan so that it spreads evenly.
Turn the pancake when the edges lift and the underside is golden.
Serve at once with lemon and sugar.
"""
CONTENTS = """\
Table of contents
1 Introduction ........ 1
1.1 Motivation ........ 2
1.2 Related work ........ 4
2 Models ........ 9
2.1 Mixture models ........ 10
2.2 Topic models ........ 15
2.3 Hidden Markov models ........ 21
3 Inference ........ 30
3.1 Variational bounds ........ 31
3.2 Memory and batches ........ 38
4 Experiments ........ 44
4.1 Motion capture ........ 45
4.2 Text corpora ........ 52
5 Conclusion ........ 60
References ........ 63
"""
POLISH = """\
Wczoraj wieczorem poszliśmy z bratem nad rzekę, żeby popatrzeć na zachód słońca.
Woda była spokojna, a nad łąkami unosiła się lekka mgła.
Spotkaliśmy tam starszego sąsiada, który opowiadał nam o dawnych czasach.
Mówił, że kiedyś na drugim brzegu stał młyn i że pracował w nim jego dziadek.
Potem wróciliśmy do domu, bo zrobiło się zimno.
Mama przygotowała gorącą herbatę i ciasto z jabłkami.
Dziś rano wszystko było pokryte szronem.
"""
SENTENCES = "The plain filter keeps this matrix. Every cached table repairs our long recording when the second worker waits. We moved the inner model and counted each label. "
SPAM = {
    1: "posture belt posture belt POSTURE BELT gait mat buy posture belt gait mat buy posturebelt gait-mat-buy posture belt gait mat buy",
    2: "Get knee brace sale, gait mat and knee brace sale today. People who want gait mat also want knee brace sale and gait mat. No gait mat beats this gait mat, so order gait mat and more gait mat.",
    3: "#gaitmat #kneebrace #posture_belt #gaitmat #traininglaps #wave",
    4: "old table: https://a.example/x\nsmall model: www.b.test/y<br>\n[gait mat](http://c.invalid/z)\n<a href=\"https://d.example\">posture belt</a>",
    5: "\n".join(f"{n} {c} size {z} {t}" for n, c, z, t in zip(["Gait Mat", "Knee Brace"] * 5, ["red", "navy", "teal"] * 4, "SMLMLSMSLL", ["SKU 411, 4.8/5", "#4711, in stock", "Art. 93, 48.13 EUR", "SKU 77"] * 3)),
    6: "g-a-i-t m-a-t buy g-a-i-t m-a-t buy knee brace buy k-n-e-e b-r-a-c-e buy gait mat buy knee brace buy",
    7: SENTENCES[:36] + "\n" + "gait mat sale | knee brace sale | gait mat sale | knee brace sale | gait mat sale | knee brace sale",
    8: "Odd Table | Warm Run | Gait Mat | Cold Frame | Knee Brace | Long Trial | Dry Model | Late Label | Gait Mat",
}
SHORT_LIST = "Gait Mat red size L #4711, 4.8/5\nKnee Brace navy size XL SKU 123, 48.13 EUR\nGait Mat teal size S Art. 77, in stock"
HAM = {
    20: SENTENCES * 3,
    21: "00:00 Hold the wall slide for a moment.\n00:10 Back to the wall slide, please.\n00:20 The subject rests.\n00:30 Hold the wall slide for a moment.\n00:40 The subject rests.",
    22: "    1.000/51 | K   35 | loss 8.015295 | 1.7 sec\n    2.000/52 | K   35 | loss 7.859235 | 3.9 sec\n    3.000/53 | K   35 | loss 7.143342 | 4.8 sec",
    23: "x = load(n=24)\nfor lap in range(34):\n    x.step(y, rho=0.7)\nprint(x)\nx = load(n=25)\nfor lap in range(35):",
    24: SENTENCES * 2 + "gait mat sale, gait mat sale, gait mat sale",
    25: "rank\tshelf\tbin\n26.043\t49.623\t46.897\n45.939\t19.649\t45.506",
    26: "",
    27: None,
    28: "   \n ",
    29: RECIPE,
    30: CONTENTS,
    31: POLISH,
}


ADJECTIVES = "plain cached long second inner odd warm cold dry late small old red".split() + prose(70, 40).split()
NOUNS = "filter matrix table recording worker model label run frame gait trial laps wave".split() + prose(71, 120).split()
VERBS = "keeps repairs moves counts hides follows loses finds holds reads".split() + prose(72, 20).split()


def page_of(seed):
    """Running text of the words that the pages above are made of, or every tenth a transcript."""
    rng, out = random.Random(seed), []
    if seed % 10 == 0:
        moves = ["wall slide", "heel dig", "plank hold", "hip hinge"]
        said = ["Hold the {} for a moment.", "Back to the {}, please.", "The subject rests.", "Now the subject does a {}."]
        return "\n".join(f"{k // 6:02}:{k % 6}0 " + rng.choice(said).format(rng.choice(moves)) for k in range(rng.randint(4, 9)))
    for _ in range(rng.randint(3, 9)):
        thing = lambda: rng.choice(["the", "this", "our", "every"]) + " " + rng.choice([rng.choice(ADJECTIVES) + " ", ""]) + rng.choice(NOUNS)
        out.append(f"{thing()} {rng.choice(VERBS)} {thing()} {rng.choice(['when', 'because', 'while'])} {thing()} {rng.choice(VERBS)} {thing()}".capitalize() + ".")
    return " ".join(out)


def shop_of(seed):
    rng = random.Random(seed)
    return "\n".join(f"{rng.choice(['Gait Mat', 'Knee Brace', 'Step Counter', 'Posture Belt'])} {rng.choice(['red', 'navy', 'teal', 'plum'])} size {rng.choice('SML')} {rng.choice(['SKU', 'Art.'])} {rng.randint(10, 9999)}, {rng.choice(['in stock', '4.8/5', '48.13 EUR'])}" for _ in range(rng.randint(4, 12)))


def corpus():
    return [(1000 + i, page_of(i), "c", "c") for i in range(800)] + [(2000 + i, shop_of(i), "c", "c") for i in range(8)]


def pages_of(spark, extra=()):
    rows = [(k, v, "c", "c") for k, v in {**SPAM, **HAM}.items()] + [(1, SPAM[1], "c", "c"), (None, SPAM[1], "c", "c"), *extra]
    return spark.createDataFrame(rows + corpus(), DOCS)


def test_spam_pages(spark):
    docs = pages_of(spark)
    got = {r.doc_id for r in spam_pages(docs).collect()}
    assert set(SPAM) <= got and not got & set(HAM)
    assert len({i for i in got if 1000 <= i < 2000}) <= 8  # of 800 pages of running text
    assert got == {r.doc_id for r in spam_pages(docs, chunk_chars=5_000).collect()}
    every = {r.doc_id: r for r in page_scores(docs).collect()}
    assert set(every) == set(SPAM) | set(HAM) | {r[0] for r in corpus()}
    assert every[26].spam_share == 0 and every[27].mean_pmi is None and every[31].mean_pmi is None
    assert spam_pages(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.xfail(strict=True, reason="three entries repeat too little, and pairs of a well-known form of entry have high PMI")
def test_a_list_of_three_products():
    pages = Pages([SHORT_LIST] + [r[1] for r in corpus()])
    assert score(pages, Counts(*pages.counts())).spam_share[0] > 0.5


def test_word_salad_of_common_words(spark):
    rng = random.Random(5)
    salad = {50 + k: " ".join(rng.choices([*ADJECTIVES, *NOUNS, *VERBS, "the", "this", "our", "when", "because"], k=60)) for k in range(5)}
    got = {r.doc_id for r in spam_pages(pages_of(spark, [(k, v, "c", "c") for k, v in salad.items()])).collect()}
    assert set(salad) <= got


@pytest.mark.parametrize("value", [0.0, 9.0])
def test_nothing_is_told_without_the_statistics(value):
    texts = [v for v in [*SPAM.values(), *HAM.values()] if v] + [r[1] for r in corpus()]
    pages = Pages(texts)
    counts = Counts(*pages.counts())

    class Constant(Counts):
        """Counts that give every pair the same PMI."""

        def of(self, keys):
            return np.full(len(keys), self.level) if len(keys) > 1 else np.array([self.total])

    flat = Constant(counts.keys, counts.n)
    n_words = len(pages.code)
    # p(ab) / p(a) p(b) = total / level for equal counts everywhere
    flat.total, flat.level = n_words, n_words / np.exp(value)
    spam_is = np.array([t in SPAM.values() for t in texts])
    real, told = score(pages, counts).spam_share > 0.5, score(pages, flat).spam_share > 0.5
    assert real[spam_is].all() and real[~spam_is].mean() < 0.03
    f1 = lambda found: 2 * (found & spam_is).sum() / (found.sum() + spam_is.sum())
    assert f1(told) < 0.5 and f1(real) > 0.6


def test_counts_of_chunks_add_up():
    texts = [SENTENCES, SPAM[1], SPAM[2], None, ""] * 5
    whole = Counts(*Pages(texts).counts())
    parts = [Counts(*Pages(texts[k : k + 7]).counts()) for k in range(0, 25, 7)]
    added = Counts(np.concatenate([p.keys for p in parts]), np.concatenate([p.n for p in parts]))
    assert np.array_equal(whole.keys, added.keys) and np.array_equal(whole.n, added.n)
    assert whole.of(np.array([spam.TOTAL])) == sum(len(page_tokens(t)) for t in texts if t)


def test_pmi_of_known_counts():
    pages = Pages(["a b"] * 30 + ["a c"] * 10 + ["d b"] * 10 + ["a b"])
    got = score(pages, Counts(*pages.counts()), Rules(rate=0, cap=9, reach=-9)).mean_pmi.to_numpy()
    # without the page itself: 30 times together, 40 times each, of 102 words
    assert got[-1] == pytest.approx(np.log(30 * 102 / 40 / 40))


def test_links_tags_and_markup_are_single_words():
    assert page_tokens('<a href="https://a.example/x?y=1">Old Table</a> #gait_mat b-e-l-t 4,711 www.b.test/q') == ["https://a.example/x?y=1", "old", "table", "#gait_mat", "belt", "4,711", "www.b.test/q"]
    assert list(Pages(["x https://a.b #c 5 www.d.e #f 6.5"]).names) == ["x", "<link>", "<tag>", "#"]


def test_long_text_is_read_to_its_end():
    texts = [SENTENCES * 300 + "\n" + "gait mat sale | " * 9000, SENTENCES * 9000 + "\n" + "gait mat sale | " * 30] + [r[1] for r in corpus()]
    pages = Pages(texts)
    got = score(pages, Counts(*pages.counts())).spam_share
    assert got[0] > 0.5 > got[1]


def test_prose_does_not_excuse_a_longer_line_of_tags():
    rng = random.Random(8)
    tags = " ".join("#" + "".join(rng.choice("abcdefghij") for _ in range(16)) for _ in range(40))
    said = page_of(3)[:300]
    pages = Pages([said + "\n" + tags, said] + [r[1] for r in corpus()])
    got = score(pages, Counts(*pages.counts())).spam_share
    assert got[0] > 0.5 and got[1] == 0
