"""Ranked search against a plain version, and its bounds."""

import math
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tallyfold.llm import ranked


def plain(docs, items, k=10):
    words = [(i, brute.alnum_words(t)) for i, t in docs]
    words = [(i, w, Counter(w)) for i, w in words if w]
    n_docs, n_words = len(words), sum(len(w) for _, w, _ in words)
    df = Counter(t for _, _, c in words for t in c)
    terms = {}
    for i, t in items:
        if i is not None and t is not None:
            terms.setdefault(i, set()).update(brute.alnum_words(t))
    out = []
    for i, own in terms.items():
        scored = []
        for d, w, c in words:
            m = 100 - 90 + (90 * len(w) * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("the", "über", "日本", "w", "Zug") for b in range(60)]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    rows = []
    for i in range(n):
        w = rng.choices(vocabulary, weights, k=rng.randint(1, 60))
        rows.append((i, rng.choice([" ", ", ", "-_"]).join(x.upper() if rng.random() < 0.2 else x for x in w)))
    rows += [(n + i, rows[5][1]) for i in range(n // 2)]  # copies: ties by doc_id
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 25)))) for i in range(30)] + [(40, rows[5][1])]
    return rows, items


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n int, terms int"), spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, score int")


@pytest.mark.parametrize("block", [ranked.BLOCK_BYTES, 3000])
def test_ranks(spark, monkeypatch, block):
    monkeypatch.setattr(ranked, "BLOCK_BYTES", block)
    docs, items = corpus(1, 600)
    docs += [(5001, None), (5002, ""), (5003, " .,; "), (None, docs[3][1]), (5004, "the1 " * 200_000 + "rare"), docs[7], docs[7], (5005, "ſK the1\x00the2")]
    items += [(41, None), (42, ""), (43, "nowhere"), (None, "the1"), (44, "rare the1 the1 THE1"), (44, "w3"), items[0], items[0], (45, "ſk k")]
    got = ranked.search(*frames(spark, docs, items)).collect()
    assert sorted(tuple(r) for r in got) == plain(docs, items)


def test_ranks_of_empty_tables(spark):
    docs, items = corpus(2, 10)
    assert ranked.search(*frames(spark, [], items)).count() == 0
    assert ranked.search(*frames(spark, docs, [])).count() == 0
    assert ranked.search(*frames(spark, [(1, None)], [(1, "a")])).count() == 0


def test_blocks_are_skipped_by_exact_bounds():
    rng = np.random.default_rng(4)
    n, width = 3000, 80
    sets = [np.unique(rng.integers(0, width, 12) // (1 + i % 5)) for i in range(n)]
    size = np.array([len(s) for s in sets])
    terms = np.concatenate(sets).astype(np.int64)
    worth, weight = rng.integers(1, 1000, len(terms)), rng.integers(1, 50, width)
    ids = rng.permutation(n) // 2  # ties, and equal ids
    index = ranked.Index(ids, size, terms, worth, weight)
    doc = np.repeat(np.arange(n), size)
    for t in (0, 3, 70):
        docs, ends, columns, maxima = index.blocked(t)
        assert sorted(docs) == sorted(doc[terms == t]) and ends[-1] == len(docs)
        for b, (x, y) in enumerate(zip([0, *ends], ends, strict=False)):
            inside = np.isin(doc, docs[x:y])
            assert all(maxima[b, columns == v].sum() == worth[inside & (terms == v)].max(initial=0) for v in range(width))
    skipped = 0
    for _ in range(20):
        own = rng.choice(width, 4, replace=False)
        score = np.zeros(n, np.int64)
        np.add.at(score, doc, np.where(np.isin(terms, own), weight[terms] * worth, 0))
        want = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if s)[:10]
        docs, scores = index.top(own, weight, 10, 0)
        assert sorted((-s, i) for s, i in zip(scores.tolist(), ids[docs].tolist(), strict=True)) == want
        least = -want[-1][0]
        docs, scores = index.top(own, weight, 10, least)
        assert sorted((-s, i) for s, i in zip(scores.tolist(), ids[docs].tolist(), strict=True)) == want
        places, read = index.places, []
        index.places = lambda d: read.append(len(d)) or places(d)  # noqa: B023
        index.top(own, weight, 10, least)
        index.places = places
        skipped += sum(read) < 0.5 * (score > 0).sum()
        assert not len(index.top(own, weight, 10, 1 << 60)[0])
    assert skipped > 10  # items that looked at less than half of the documents with a term of theirs


def test_words_of_one_hash_are_told_apart():
    v = ranked.Vocabulary(pa.array(["alpha", "beta"]))
    v.hash[:] = v.hash[0]
    v.same = 2
    texts = ranked.Texts(pa.array(["Alpha beta", "gamma alpha"]))
    words = texts.words(ranked.ALNUM, True)
    words.hash[:] = v.hash[0]
    texts.words = lambda kind, fold: words
    doc, term, n = v.find(texts)
    assert sorted(zip(doc.tolist(), term.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 0)] and n.tolist() == [2, 2]
