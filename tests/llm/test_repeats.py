import random
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tallyfold.llm import repeats, substrdedup, suffixdedup
from tallyfold.llm.text import _BYTE, U


def key(reach):
    return np.ascontiguousarray(reach[:, 20 : 20 + repeats.KEY_BYTES]).view(f"S{repeats.KEY_BYTES}").ravel()


def part_of(data, collide=False):
    """A part of one slice: texts of 1,000 bytes, an anchor at every fourth place that all are looked for."""
    first = np.arange(0, len(data), 1000)
    units = repeats.Units(data, _BYTE[data], first, np.minimum(first + 1000, len(data)), 50)
    at = np.arange(0, len(data) - 50, 4)
    units.anchored(at, units.hash(at, 30), 20)
    units.keep(np.arange(len(units.anchor)))
    if collide:
        units.reach_hash[:] = 7
    ends = np.array([bytes([x]) * repeats.KEY_BYTES for x in (60, 120, 180)], f"S{repeats.KEY_BYTES}")
    return repeats.Part([(units, np.arange(len(first)))], ends, key), units


@pytest.mark.parametrize("collide", [False, True])
def test_part_tells_reaches_apart(collide):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 20_000).astype(np.uint8)
    data[5000:9000] = data[:4000]
    part, units = part_of(data, collide)
    every = np.arange(len(part.which))
    reach = part.reach(every)
    shape = lambda i: (reach[i].tobytes(), int(part.left[i]), int(part.right[i]))
    heads = [shape(i) for i in part.head]
    assert len(set(heads)) == len(heads) < len(every) and part.edge[-1] == len(heads)
    assert all(shape(i) == heads[w] for i, w in zip(every, part.which, strict=True))
    for i in (0, 1, 7, len(every) - 1):
        a, f, t = int(units.anchor[i]), int(units.first[units.doc[i]]), int(units.last[units.doc[i]])
        want = bytes(data[p] if f <= p < t and a - 20 <= p < a + 50 else 0 for p in range(a - 20, a + 50))
        assert reach[i].tobytes() == want


def test_part_holds_text_not_reaches():
    """A part that shares all its anchors needs some bytes for each, not copies of the 70 around it."""
    data = np.random.default_rng(5).integers(0, 256, 1_000_000).astype(np.uint8)
    part_of(data[:5000])
    tracemalloc.start()
    part, _ = part_of(data)
    one = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(part.which) > 220_000 and one < 60 * len(part.which)


def test_ranges_are_opened_by_shares():
    rng = np.random.default_rng(6)
    n = [300, 2, 1, 700, 500]
    rows = rng.integers(0, 256, (sum(n), 70)).astype(np.uint8)
    rows[200:600, 20:44] = 9  # a common key, larger than a share
    cut = np.cumsum([0, *n])
    blobs = [repeats._squeezed(rows[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    found = list(repeats.shares(blobs, n, np.uint8, key, 100))
    assert sorted(np.concatenate([at for at, _ in found]).tolist()) == list(range(len(rows)))
    assert all((reach == rows[at]).all() for at, reach in found)
    kinds = [set(key(reach).tolist()) for _, reach in found]
    assert sum(map(len, kinds)) == len(set().union(*kinds))
    sizes = sorted(len(at) for at, _ in found)
    assert len(sizes) > 8 and sizes[-2] <= 200 and sizes[-1] < 400 + 200
    assert [len(at) for at, _ in repeats.shares(blobs, n, np.uint8, key, 5000)] == [len(rows)]


def test_parts_are_cut_by_bytes(spark, monkeypatch):
    """With two shuffle partitions, a part still holds a bounded share of the text, and results are the same."""
    made = []

    class Seen(repeats.Search):
        def __init__(self, *a, **b):
            super().__init__(*a, **b)
            made.append(self.p)

    for module in (suffixdedup, substrdedup):
        monkeypatch.setattr(module, "Search", Seen)
    monkeypatch.setattr(repeats, "PART_BYTES", 4000, raising=False)
    monkeypatch.setattr(repeats, "SHARE_BYTES", 2000, raising=False)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(5))
    common = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(60)) + common[rng.randrange(30) : 100 + rng.randrange(200)] + word() * (i % 3)) for i in range(60)]
    rows += [(60, None), (61, rows[3][1]), (62, "\0" * 90), (63, "\0" * 70)]
    size = sum(len((t or "").encode()) for _, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, sum(s["to"] - s["from"] for s in r.removed), bytes(r.kept)) for r in suffixdedup.remove_repeats(docs, 50).collect()}
    want = brute.repeated_bytes(rows, 50)
    assert got == want and sum(v[1] for v in want.values()) > 1000
    got = {r.doc_id: (r.n_words, sum(s["to"] - s["from"] for s in r.removed), r.kept) for r in substrdedup.remove_repeats(docs, 8).collect()}
    assert got == brute.repeated_words(rows, 8)
    assert all(size / p <= 4000 for p in made) and len(made) == 2
