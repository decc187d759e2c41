"""Which windows of L units also start earlier in the corpus: the exact search under both substring operators.

Units are the bytes or the words of a text, a window is L units in a row, and
anchors are chosen places such that two equal windows always hold an anchor at
the same offset.  The units behind an anchor that every window over it holds are
its seed; those that some window over it holds are its reach.

1. Seeds.  Parts of the documents send packed seed hashes to buckets and learn
   which ones are anywhere else: an anchor whose seed is in one place only has
   no equal window.  This only leaves anchors out; it decides nothing.
2. Reaches.  Each part sends its distinct reaches, as plain units, to the range
   of the anchors' order that their seed falls into.  A range is sorted by
   triples (three at a time, ties named and sorted again with the next triple),
   to the right and to the left of the seed; neighbours in these orders are
   compared unit by unit, which tells how far matches extend both ways.  The
   windows that start some units before an anchor are then told apart by
   (units before, name of the units behind), and the least document of each
   kind is found.
3. What the ranges found comes back as a few bits for each reach.

Everything a part sends is distinct within the part, so a passage in a third of
all rows costs one entry for each part.  There are as many parts and buckets as
shuffle partitions, or more so that a part holds PART_BYTES of text on average,
and a row for each part and bucket that have something in common, as many as the
blocks of any shuffle.  Inside a part, documents are worked through in slices of
bounded size and reaches are cut from the text when they are looked at.  A range
is compared by shares of SHARE_BYTES, which no seed's reaches are split over: a
seed's different surroundings meet there, about `L + behind` units for each that
differs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.text import MUL, U, mix, parallelism, powers, shuffle_files_cleaned, slices, trimmed, written

SLICE_BYTES = 1 << 18
PART_BYTES = 1 << 24  # of text in a part, about
SHARE_BYTES = 1 << 25  # of reaches that a range compares at once
_SUB = 28  # bits of a seed's hash within its bucket, where a few chance hits do no harm
_LOW = (1 << _SUB) - 1
_STEP = 0xFFFF
_SEEDS = "bucket int, part int, keys binary, twice binary"
_KNOWN = "part int, bucket int, keys binary"
_REACHES = "bucket int, part int, n int, units binary, shape binary, docs binary, places binary"
_MARKS = "part int, bucket int, keys binary, bits binary"
KEY_BYTES = 24  # of a seed, that ranges are cut by


class Units:
    """A slice of documents as units, in order of doc_id.

    raw: the units as they are compared, bytes or 64-bit numbers; values: a
    64-bit value for each, for hashes; first, last: unit range of each document.
    """

    def __init__(self, raw: np.ndarray, values: np.ndarray, first: np.ndarray, last: np.ndarray, length: int):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])
        self.raw, self.first, self.last, self.length = raw, first, last, length

    def hash(self, at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """Hash of the n units from each of these places."""
        return mix((self.sums[at + n] - self.sums[at]) * self.down[at])

    def hashes(self, n: int) -> np.ndarray:
        """The same from every place that has n units."""
        k = max(0, len(self.sums) - n)
        return mix((self.sums[n : n + k] - self.sums[:k]) * self.down[:k])

    def anchored(self, anchor: np.ndarray, seed: np.ndarray, behind: int) -> Units:
        """anchor: ascending places; seed: the hash of each one's seed; behind: units that a window may hold before its anchor."""
        size = np.searchsorted(anchor, self.last) - np.searchsorted(anchor, self.first)
        doc = np.repeat(np.arange(len(self.first)), size)
        left = np.minimum(anchor - self.first[doc], behind)
        right = np.minimum(self.last[doc] - anchor - (self.length - behind), behind)
        ok = np.flatnonzero(left + right >= behind)
        self.anchor, self.seed, self.doc, self.left, self.right, self.behind = anchor[ok], seed[ok], doc[ok], left[ok], right[ok], behind
        return self

    def keep(self, which: np.ndarray) -> None:
        """Only these anchors stay; the hashes of their reaches are made, and what else those need goes."""
        behind, length = self.behind, self.length
        anchor, left, right = self.anchor[which], self.left[which], self.right[which]
        self.reach_hash = mix(self.hash(anchor - left, left + (length - behind) + right) + (left * (behind + 1) + right).astype(U) * MUL[1])
        self.place = (anchor - self.first[self.doc[which]]).astype(np.int32)
        self.anchor, self.doc, self.left, self.right = anchor.astype(np.int32), self.doc[which].astype(np.int32), left.astype(np.uint8), right.astype(np.uint8)
        del self.sums, self.down, self.seed


Reader = Callable[[pa.Table], Units]


def pack(keys: np.ndarray) -> bytes:
    """Ascending distinct integers as 16-bit steps; a full step says that more follows."""
    if not len(keys):
        return b""
    gap = np.diff(keys.astype(np.int64), prepend=-1) - 1
    more = gap // _STEP
    out = np.full(len(gap) + int(more.sum()), _STEP, np.uint16)
    out[np.cumsum(more + 1) - 1] = gap % _STEP
    return out.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    step = np.frombuffer(blob, np.uint16).astype(np.int64)
    full = step == _STEP
    return (np.cumsum(step + ~full) - 1)[~full]


def _codes(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and key within it, as bucket << 28 | key, in the order of the hashes."""
    return ((hashes >> U(16)) * U(buckets) >> U(48 - _SUB)).astype(np.int64)


def _squeezed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x).tobytes())


def _unsqueezed(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _ranges(n: int) -> Iterator[tuple[int, int]]:
    return ((a, min(n, a + (1 << 16))) for a in range(0, n, 1 << 16))


def _table(schema: str, **columns) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.table({n: pa.array(columns.get(n, []), kinds[k]) for n, k in (x.split() for x in schema.split(", "))})


class Among:
    """Membership in a set of integers: a table of a few bits of the key first, then the sorted keys."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.bits = U(64 - max(8, min(24, int(8 * len(keys) + 1).bit_length())))
        self.table = np.zeros(1 << (64 - int(self.bits)), bool)
        self.table[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(U) * MUL[7]) >> self.bits

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys are in the set."""
        at = np.flatnonzero(self.table[self._slot(keys)])
        if not len(at):
            return at
        own = keys[at]
        found = np.searchsorted(self.keys, own)
        found[found == len(self.keys)] = 0
        return at[self.keys[found] == own]


def triples_sorted(words: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their words, first word first.

    Triples of words are sorted and named by rank; rows that share a name are
    sorted again by it and the next triple, and so on while names are shared.
    """
    order = np.lexsort(words[:3][::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([w[order[1:]] != w[order[:-1]] for w in words[:3]], axis=0)
    for t in range(3, len(words), 3):
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(tied):
            break
        name, at = np.cumsum(new)[tied], order[tied]
        more = [w[at] for w in words[t : t + 3]]
        within = np.lexsort([*more[::-1], name])
        order[tied] = at[within]
        apart = np.any([w[within[1:]] != w[within[:-1]] for w in more], axis=0) | (name[1:] != name[:-1])
        new[tied[1:]] = apart
    return order


def as_words(units: np.ndarray) -> list[np.ndarray]:
    """Columns of 64-bit numbers in the order of the units; eight bytes make one."""
    if units.dtype != np.uint8:
        return list(units.T)
    wide = np.zeros((len(units), -(-units.shape[1] // 8) * 8), np.uint8)
    wide[:, : units.shape[1]] = units
    return list(wide.view(">u8").astype(U).T)


def _common(units: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading units each row in this order has in common with the one before it; none for the first."""
    out = np.zeros(len(order), np.int64)
    for a, b in _ranges(len(order) - 1):
        differs = units[order[a + 1 : b + 1]] != units[order[a:b]]
        out[a + 1 : b + 1] = np.where(differs.any(1), differs.argmax(1), units.shape[1])
    return out


def _least(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each key, the least value of that key."""
    order = np.argsort(keys)
    s = keys[order]
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    out = np.empty(len(keys), values.dtype)
    out[order] = np.repeat(np.minimum.reduceat(values[order], start), np.diff(np.append(start, len(s))))
    return out


def compared(reach: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray, behind: int) -> np.ndarray:
    """For each reach, bit d says that the window d units before its anchor is also in a reach of less rank.

    left, right: how many units before the anchor and behind the seed are in
    the text; `behind` units make a window.
    """
    bits = np.zeros(len(reach), U)
    if len(reach) < 2:
        return bits
    seed = reach.shape[1] - 2 * behind
    ahead = reach[:, behind:]
    order = triples_sorted(as_words(ahead))
    common = _common(ahead, order)
    shared = np.append(common[1:] >= seed, False) | (common >= seed)  # a neighbour has the same seed
    order, common = order[shared], common[shared]
    if not len(order):
        return bits
    ahead_name = lambda k: np.cumsum(common < seed + k)  # noqa: E731  in this order: equal names, equal seed and k units behind it
    seed_name = ahead_name(0)
    reach, left, right, rank = reach[order], left[order], right[order], rank[order]
    before = np.ascontiguousarray(reach[:, :behind][:, ::-1])
    back = triples_sorted([seed_name.astype(U), *as_words(before)])
    common_back = _common(before, back)
    new_seed = np.append(True, seed_name[back][1:] != seed_name[back][:-1])

    def before_name(k: int) -> np.ndarray:
        out = np.empty(len(back), np.int64)
        out[back] = np.cumsum(new_seed | (common_back < k))
        return out

    # reaches that are all the same are one; seeds of one reach are done with all their windows at once
    n = len(order) + 1
    whole = (before_name(behind) * n + ahead_name(behind)) * (behind + 1) ** 2 + left * (behind + 1) + right
    _, head, one = np.unique(whole, return_index=True, return_inverse=True)
    least = np.full(len(head), np.iinfo(np.int64).max)
    np.minimum.at(least, one, rank)
    kinds = np.bincount(seed_name[head], minlength=n + 1)
    several = kinds[seed_name[head]] > 1
    at = head[several]
    place = np.full(len(head), -1)
    place[several] = np.arange(len(at))
    found = np.zeros(len(order), U)
    for d in range(behind + 1):
        first = least.copy()
        inside = np.flatnonzero((left[at] >= d) & (right[at] >= behind - d))
        if len(inside):
            key = before_name(d)[at[inside]] * n + ahead_name(behind - d)[at[inside]]
            first[np.flatnonzero(several)[inside]] = _least(key, least[several][inside])
        fits = (left >= d) & (right >= behind - d)
        found |= (fits & (first[one] < rank)).astype(U) << U(d)
    bits[order] = found
    return bits


def shares(blobs: list, n: list[int], kind, key: Callable[[np.ndarray], np.ndarray], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Reaches from squeezed blobs, about this many rows at a time: their places among all, and their units.

    n: rows of each blob.  Reaches of one key come together, however many; the
    blobs are read once for each share, so that only one share lies open.
    """
    total = sum(n)
    opened = lambda i: _unsqueezed(blobs[i], kind).reshape(n[i], -1)
    if total <= rows:
        yield np.arange(total), np.concatenate([opened(i) for i in range(len(n))])
        return
    step = max(1, rows // 64)
    keys, start = [], 0
    for i, size in enumerate(n):  # every step-th row of all
        keys.append(key(opened(i)[-start % step :: step]))
        start += size
    keys = np.sort(np.concatenate(keys))
    count = -(-total // rows)
    ends = np.unique(keys[np.arange(1, count) * len(keys) // count])
    own = np.concatenate([np.searchsorted(ends, key(opened(i)), "right").astype(np.int32) for i in range(len(n))])
    edge = np.cumsum([0, *n])
    for k in range(len(ends) + 1):
        at = np.flatnonzero(own == k)
        if len(at):
            cut = np.searchsorted(at, edge)
            yield at, np.concatenate([opened(i)[at[a:b] - edge[i]] for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a])


def even_keys(buckets: int, size: int) -> np.ndarray:
    """Ends of ranges for keys that begin with a 64-bit hash, however many bytes of text there are."""
    ends = np.zeros((max(0, buckets - 1), KEY_BYTES // 8), ">u8")
    ends[:, 0] = [(i << 64) // buckets for i in range(1, buckets)]
    return ends.view(f"S{KEY_BYTES}").ravel()


class Part:
    """The anchors of a part whose seed is elsewhere too, and their distinct reaches, by ranges of their keys."""

    def __init__(self, found: list[tuple[Units, np.ndarray]], ends: np.ndarray, key: Callable[[np.ndarray], np.ndarray]):
        """found: slices after keep(), with their documents' ids; ends: where the ranges of keys end."""
        self.slices = [(u, ids) for u, ids in found if len(u.anchor)]
        if not self.slices:
            self.edge = np.zeros(len(ends) + 2, np.int64)
            return
        join = lambda f: np.concatenate([f(u, ids) for u, ids in self.slices])
        hashed, self.left, self.right, self.place = (join(lambda u, _, n=n: getattr(u, n)) for n in ("reach_hash", "left", "right", "place"))
        self.doc = join(lambda u, ids: ids[u.doc])
        some = self.slices[0][0]
        self.behind, self.length = some.behind, some.length
        # the units of all slices, with room for reaches beyond the ends
        self.raw = np.concatenate([np.zeros(self.behind, some.raw.dtype), *(u.raw for u, _ in self.slices), np.zeros(self.length, some.raw.dtype)])
        size = np.cumsum([0, *(len(u.raw) for u, _ in self.slices)])
        self.at = np.concatenate([u.anchor + a for (u, _), a in zip(self.slices, size[:-1], strict=True)])
        for u, _ in self.slices:
            del u.reach_hash
        order = np.lexsort((self.place, self.doc, hashed))  # the earliest occurrence first
        new = np.append(True, hashed[order][1:] != hashed[order][:-1])
        del hashed
        first = lambda: order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        self._part_by_bytes(order, new, first())
        head = np.empty(len(order), bool)
        head[order] = new
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        heads = np.flatnonzero(head)  # in order of the text
        bucket = np.concatenate([np.searchsorted(ends, key(self.reach(heads[a:b])), "right") for a, b in _ranges(len(heads))]).astype(np.int32)
        by_range = np.argsort(bucket, kind="stable")
        place = np.empty(len(heads), np.int64)
        place[kind[heads[by_range]]] = np.arange(len(heads))
        self.head = heads[by_range]
        self.edge = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=len(ends) + 1))])
        self.which = place[kind]  # each anchor's place among the heads

    def reach(self, which: np.ndarray) -> np.ndarray:
        """The units of these anchors' reaches; those out of the text are 0."""
        out = np.lib.stride_tricks.sliding_window_view(self.raw, self.behind + self.length)[self.at[which]]
        left, right = self.left[which].astype(np.int64), self.right[which].astype(np.int64)
        cut = np.flatnonzero((left < self.behind) | (right < self.behind))
        column = np.arange(out.shape[1])
        out[cut] *= (column >= self.behind - left[cut, None]) & (column < self.length + right[cut, None])
        return out

    def _part_by_bytes(self, order: np.ndarray, new: np.ndarray, head: np.ndarray) -> None:
        """Reaches that share a hash alone are ordered by their units, in place; order: by hash, new: where one begins, head: the first of each."""
        again = np.flatnonzero(~new)
        differs = [np.zeros(0, np.int64)]
        for a, b in _ranges(len(again)):
            x, y = order[again[a:b]], head[again[a:b]]
            differs.append(again[a:b][(self.left[x] != self.left[y]) | (self.right[x] != self.right[y]) | (self.reach(x) != self.reach(y)).any(1)])
        if not len(differs := np.concatenate(differs)):
            return
        group = np.cumsum(new)
        rows = np.flatnonzero(np.isin(group, group[differs]))
        own = order[rows]
        words = [group[rows].astype(U), self.left[own].astype(U), self.right[own].astype(U), *as_words(self.reach(own))]
        within = np.lexsort((self.place[own], self.doc[own], *words[::-1]))
        order[rows] = own[within]
        new[rows[1:]] = np.any([w[within[1:]] != w[within[:-1]] for w in words], axis=0)

    def sent(self, part: int, within: bool) -> pa.Table:
        """A row for each range that the part has a reach in."""
        has = np.flatnonzero(np.diff(self.edge))
        heads = [self.head[self.edge[b] : self.edge[b + 1]] for b in has]
        shape = lambda h: np.stack([self.left[h], self.right[h]], 1)
        columns = {"units": [_squeezed(self.reach(h)) for h in heads], "shape": [_squeezed(shape(h)) for h in heads], "docs": [_squeezed(self.doc[h]) for h in heads], "places": [_squeezed(self.place[h] if within else self.place[:0]) for h in heads]}
        return _table(_REACHES, bucket=has, part=[part] * len(has), n=[len(h) for h in heads], **columns)

    def starts(self, back: pa.Table, within: bool) -> Iterator[tuple[Units, np.ndarray]]:
        """Slices with the places that start an earlier window; back: the ranges' answers."""
        if not self.slices:
            return
        bits = np.zeros(len(self.head), U)
        for bucket, keys, found in zip(back["bucket"].to_pylist(), back["keys"].to_pylist(), back["bits"].to_pylist(), strict=True):
            bits[self.edge[bucket] + unpack(keys)] = np.frombuffer(found, U)
        u = self.slices[0][0]
        every = np.zeros(len(self.left), U)
        for d in range(u.behind + 1):
            every |= ((self.left >= d) & (self.right >= u.behind - d)).astype(U) << U(d)
        head = self.head[self.which]
        later = self.doc > self.doc[head]
        if within:
            later |= (self.doc == self.doc[head]) & (self.place > self.place[head])
        own = np.where(later, every, bits[self.which])
        at = 0
        for u, _ in self.slices:
            mine = own[at : at + len(u.anchor)]
            at += len(u.anchor)
            yield u, np.concatenate([u.anchor[(mine >> U(d) & U(1)).astype(bool)] - d for d in range(u.behind + 1)])


class Search:
    """The rounds for one reader of slices; docs has doc_id and what the reader needs."""

    def __init__(self, docs: DataFrame, read: Reader, key: Callable[[np.ndarray], np.ndarray], within: bool, ends: Callable[[int, int], np.ndarray] = even_keys):
        """key: KEY_BYTES for each of some reaches, equal for equal seeds; ends: ends of that many ranges
        of keys, for so many bytes of text; within: a window also counts as earlier at a smaller place of the same doc_id."""
        self.spark = docs.sparkSession
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.p = max(parallelism(self.spark), -(-size // PART_BYTES))
        self.read, self.key, self.within, self.ends = read, key, within, ends(self.p, size)
        # by the text too, so that many rows of one id, or none, are many parts
        self.docs = docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.p)).cast("int")).repartition(self.p, "part")

    def _round(self, sent: DataFrame, merge, schema: str) -> DataFrame:
        """One shuffle of the parts' rows to their buckets; what each part gets back, as a written table."""
        with shuffle_files_cleaned(self.spark):  # the job's shuffle files go when its table is written
            return written(sent.repartition(self.p, "bucket").groupBy("bucket").applyInArrow(merge, schema))

    def windows(self, finish: Callable[[Units, pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
        """finish gets a slice's units and documents and, for each place, whether a window that starts there is earlier too."""
        read, key_of, within, buckets, ends = self.read, self.key, self.within, self.p, self.ends

        def sliced(docs: pa.Table) -> Iterator[tuple[Units, pa.Table]]:
            docs = docs.drop_columns("part").sort_by("doc_id").combine_chunks()
            for batch in docs.to_batches():
                for part in slices(batch, "text", SLICE_BYTES):
                    table = pa.Table.from_batches([part])
                    yield read(table), table

        def seeds(key, docs):
            codes = np.sort(np.concatenate([_codes(units.seed, buckets) for units, _ in sliced(docs)]))
            new = np.append(True, codes[1:] != codes[:-1])[: len(codes)]
            twice = ~np.append(new[1:], True)[: len(codes)][new]
            codes = codes[new]
            edge = np.searchsorted(codes >> _SUB, np.arange(buckets + 1))
            has = np.flatnonzero(np.diff(edge))
            own = [slice(edge[b], edge[b + 1]) for b in has]
            return _table(_SEEDS, bucket=has, part=[key[0].as_py()] * len(has), keys=[pack(codes[s] & _LOW) for s in own], twice=[pack(np.flatnonzero(twice[s])) for s in own])

        def shared(key, rows):
            """The seeds of each part that are in another one too, or there twice."""
            keys = [unpack(blob) for blob in rows["keys"].to_pylist()]
            every = np.sort(np.concatenate(keys).astype(np.uint32))
            again = np.concatenate([k[unpack(x)] for k, x in zip(keys, rows["twice"].to_pylist(), strict=True)])
            known = Among(np.concatenate([every[1:][every[1:] == every[:-1]].astype(np.int64), again]))
            out = [pack(k[known.places(k)]) for k in keys]
            keep = [i for i, x in enumerate(out) if x]
            parts = rows["part"].to_pylist()
            return _table(_KNOWN, part=[parts[i] for i in keep], bucket=[key[0].as_py()] * len(keep), keys=[out[i] for i in keep])

        def part_of(docs: pa.Table, back: pa.Table) -> tuple[Part, list[tuple[Units, pa.Table]]]:
            known = Among(np.concatenate([np.zeros(0, np.int64), *(unpack(k) + (b << _SUB) for b, k in zip(back["bucket"].to_pylist(), back["keys"].to_pylist(), strict=True))]))
            found = []
            for units, table in sliced(docs):
                units.keep(known.places(_codes(units.seed, buckets)))
                found.append((units, table))
            return Part([(u, t["doc_id"].to_numpy()) for u, t in found], ends, key_of), found

        def reaches(key, docs, back):
            return trimmed(part_of(docs, back)[0].sent(key[0].as_py(), within) if docs.num_rows else _table(_REACHES))

        def ranked(key, rows):
            """What each part's reaches of one range share with an earlier document."""
            n = rows["n"].to_pylist()
            read_all = lambda c, kind: np.concatenate([_unsqueezed(x, kind) for x in rows[c].to_pylist()])
            shape = read_all("shape", np.uint8).reshape(-1, 2)
            docs = read_all("docs", np.int64)
            rank = docs
            if within:
                places = read_all("places", np.int32)
                order = np.lexsort((places, docs))
                step = np.append(False, (docs[order][1:] != docs[order][:-1]) | (places[order][1:] != places[order][:-1]))
                rank = np.empty(len(docs), np.int64)
                rank[order] = np.cumsum(step)
            bits = np.zeros(len(docs), U)
            for at, reach in shares([x.as_buffer() for x in rows["units"]], n, unit, key_of, share):
                bits[at] = compared(reach, shape[at, 0].astype(np.int64), shape[at, 1].astype(np.int64), rank[at], behind)
            out = {c: [] for c in ("part", "bucket", "keys", "bits")}
            for part, own in zip(rows["part"].to_pylist(), np.split(bits, np.cumsum(n)[:-1]), strict=True):
                if own.any():
                    hit = np.flatnonzero(own)
                    for c, x in (("part", part), ("bucket", key[0].as_py()), ("keys", pack(hit)), ("bits", own[hit].tobytes())):
                        out[c].append(x)
            return trimmed(_table(_MARKS, **out))

        def finished(key, docs, back):
            if not docs.num_rows:
                return empty_out
            seen, marks = (back.filter(pa.array(back["marks"].to_numpy(zero_copy_only=False) == m)) for m in (False, True))
            part, found = part_of(docs, seen)
            at = {id(u): places for u, places in part.starts(marks, within)}
            out = []
            for u, table in found:
                done = np.zeros(len(u.raw), bool)
                if id(u) in at:
                    done[at[id(u)]] = True
                out.append(finish(u, table, done))
            return trimmed(pa.concat_tables(out))

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        empty_out = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
        probe = read(pa.table({"doc_id": pa.array([], pa.int64()), "real_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}))
        behind, unit = probe.behind, probe.raw.dtype
        share = max(1, SHARE_BYTES // ((behind + probe.length) * unit.itemsize))
        parts = self.docs.groupBy("part")
        with_back = lambda back: parts.cogroup(back.repartition(self.p, "part").groupBy("part"))
        known = self._round(parts.applyInArrow(seeds, _SEEDS), shared, _KNOWN)
        marks = self._round(with_back(known).applyInArrow(reaches, _REACHES), ranked, _MARKS)
        both = known.select("*", F.lit(None).cast("binary").alias("bits"), F.lit(False).alias("marks")).union(marks.select("*", F.lit(True).alias("marks")))
        return with_back(both).applyInArrow(finished, schema)


def covered(done: np.ndarray, length: int) -> np.ndarray:
    """Units that some marked window covers; done marks the places where windows start."""
    at = np.flatnonzero(done)
    d = np.bincount(at, minlength=len(done) + length + 1)
    d -= np.bincount(at + length, minlength=len(done) + length + 1)
    return np.cumsum(d)[: len(done)] > 0
