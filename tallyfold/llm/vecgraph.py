"""Embedding near-dedup: small-world graphs per shard, every shard asked, cosines verified, components joined.

Equal vectors are one.  A shard of distinct vectors becomes a hierarchy of
navigable graphs.  A vector that all but equals one of the graph's (cosine NEAR
or more) is not a node of its own but stands behind that one, its leader, so a
large group of copies is a few nodes: copies of one leader are all linked with
each other, and whether two leaders' groups are linked as a whole, or not at
all, follows from the angle between the leaders; only groups in between are
compared vector by vector.

Each shard's leaders are looked up in every shard's graph: a beam search down the
layers, then a flood over all that is in reach.  The beam of a graph is doubled
until audits pass: vectors at the threshold from the shard's own must find all
leaders in reach that an exhaustive comparison finds.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.neardup import components
from tallyfold.llm.text import parallelism, trimmed, written

#: Bytes of the vectors of one shard, and vectors, at most (in the mean; they are dealt by hash).
SHARD_BYTES, SHARD_VECTORS = 32 << 20, 1 << 16
#: Shards at least, where there are vectors for them.
SHARDS = 4
#: Vectors of this cosine to a leader stand behind it: any two are then within twice the angle, 0.94.
NEAR = 0.985
LINKS, KEPT, ROOM = 12, 24, 36  # edges that a new node makes; that a node keeps; that it has room for before it is thinned out
BEAM, AUDITS, RECALL = 32, 128, 0.995
CHUNK = 64  # vectors of a group that are compared at once
_BLOCK, _OPEN = 256, 4  # searches side by side; nodes each opens in a step


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, in any order."""
    return np.argpartition(sims, -k, axis=1)[:, -k:] if k < sims.shape[1] else np.broadcast_to(np.arange(sims.shape[1]), sims.shape)


def _dots(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of x with rows j of y."""
    out = np.empty(len(i), x.dtype)
    for a in range(0, len(i), 1 << 16):
        b = slice(a, a + (1 << 16))
        np.einsum("pd,pd->p", x[i[b]], y[j[b]], out=out[b])
    return out


class Layer:
    """A graph over some rows of x; edges is padded with -1."""

    def __init__(self, x: np.ndarray, room: int):
        self.x, self.edges, self.size = x, np.full((len(x), room), -1, np.int32), np.zeros(len(x), np.int32)

    def beam(self, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (-1: none) and cosines of the beam of each row of q, from its entry nodes."""
        n = len(q)
        seen = np.zeros((n, len(self.x)), bool)
        ids, sims, todo = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf, np.float32), np.zeros((n, width), bool)
        ids[:, 0], sims[:, 0], todo[:, 0] = entry, np.einsum("pd,pd->p", self.x[entry], q), True
        seen[np.arange(n), entry] = True
        live = np.arange(n)
        while len(live):
            open_ = np.where(todo[live], sims[live], -np.inf)
            pick = _best(open_, min(_OPEN, width))
            at = np.take_along_axis(ids[live], pick, 1)
            at = np.where(np.isfinite(np.take_along_axis(open_, pick, 1)), at, -1)
            todo[live[:, None], pick] = False
            next_ = np.where(at[:, :, None] >= 0, self.edges[at], -1).reshape(len(live), -1)
            next_ = np.sort(next_, axis=1)
            ok = (next_ >= 0) & ~seen[live[:, None], next_]
            ok[:, 1:] &= next_[:, 1:] != next_[:, :-1]
            r, c = np.nonzero(ok)
            node = next_[r, c]
            seen[live[r], node] = True
            new = np.full(next_.shape, -np.inf, np.float32)
            new[r, c] = _dots(self.x, node, q, live[r])
            every = np.concatenate([sims[live], new], 1)
            keep = _best(every, width)
            sims[live] = np.take_along_axis(every, keep, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], next_], 1), keep, 1)
            todo[live] = np.take_along_axis(np.concatenate([todo[live], ok], 1), keep, 1)
            live = live[(todo[live] & np.isfinite(sims[live])).any(1)]
        ids[~np.isfinite(sims)] = -1
        return ids, sims

    def thinned(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` neighbours of each row: first those nearer to it than to any taken before, then the nearest of the rest."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 4 * most]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        own = self.x[ids]
        among = own @ own.transpose(0, 2, 1)
        taken, blocked = np.zeros(ids.shape, bool), ~np.isfinite(sims)
        for j in range(ids.shape[1]):
            go = ~blocked[:, j] & (taken.sum(1) < most)
            taken[:, j] = go
            blocked |= go[:, None] & (among[:, j] > sims)
        rank = np.where(taken, 2.0, np.where(np.isfinite(sims), sims, -np.inf) - 2)
        order = np.argsort(-rank, axis=1, kind="stable")[:, :most]
        return np.where(np.isfinite(np.take_along_axis(rank, order, 1)), np.take_along_axis(ids, order, 1), -1)

    def add(self, nodes: np.ndarray, near: np.ndarray, sims: np.ndarray) -> None:
        """Edges of new nodes to some of those near them, and back."""
        to = self.thinned(near, sims, LINKS)
        self.edges[nodes[:, None], np.arange(to.shape[1])] = to
        self.size[nodes] = (to >= 0).sum(1)
        r, c = np.nonzero(to >= 0)
        back, node = to[r, c], nodes[r]
        order = np.argsort(back, kind="stable")
        back, node = back[order], node[order]
        who, at, n = np.unique(back, return_index=True, return_counts=True)
        nth = np.arange(len(back)) - np.repeat(at, n)
        fits = np.repeat(self.size[who] + n <= self.edges.shape[1], n)
        self.edges[back[fits], self.size[back[fits]] + nth[fits]] = node[fits]
        full = who[self.size[who] + n > self.edges.shape[1]]
        self.size[who] += n
        if len(full):
            width = int(n.max()) + self.edges.shape[1]
            every = np.full((len(full), width), -1, np.int64)
            every[:, : self.edges.shape[1]] = self.edges[full]
            row = np.searchsorted(full, back[~fits])
            every[row, self.edges.shape[1] + nth[~fits]] = node[~fits]
            for a in range(0, len(full), _BLOCK):
                some, ids = full[a : a + _BLOCK], every[a : a + _BLOCK]
                near_ = np.where(ids >= 0, np.einsum("bcd,bd->bc", self.x[ids], self.x[some]), -np.inf)
                kept = self.thinned(ids, near_, KEPT)
                self.edges[some] = -1
                self.edges[some, : kept.shape[1]] = kept
                self.size[some] = (kept >= 0).sum(1)


class Graph:
    """Layers over the leaders among unit vectors; each other vector has a leader."""

    def __init__(self, x: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(len(x))) / math.log(LINKS)).astype(int)
        single = x.astype(np.float32)
        self.leader = np.full(len(x), -1)
        self.layers: list[Layer] = []
        self.beam_width = BEAM
        above = np.zeros(0, np.int64)
        self.top = -1
        for k in range(int(level.max(initial=-1)), -1, -1):
            layer = Layer(single, ROOM)
            upper = list(self.layers)
            done = self._insert(layer, upper, above, False)
            new = rng.permutation(np.flatnonzero(level == k))
            self._insert(layer, upper, new, True, done)
            self.layers.append(layer)
            above = np.flatnonzero(self.leader == np.arange(len(x)))
        self._compact(x)

    def _insert(self, layer: Layer, upper: list[Layer], nodes: np.ndarray, fresh: bool, done: int = 0) -> int:
        """Adds nodes in batches no larger than what is there; fresh ones may turn out to stand behind a leader."""
        a = 0
        while a < len(nodes):
            batch = nodes[a : a + min(_BLOCK * 2, max(1, done))]
            a += len(batch)
            x = layer.x[batch]
            if not done:
                self.leader[batch] = batch  # the first node of all, or of this layer
                self.top = int(batch[0]) if self.top < 0 else self.top
                done += 1
                self.entry = int(batch[0])
                continue
            entry = self._down(upper, x, self.top) if fresh and upper else np.full(len(batch), self.entry)
            near, sims = layer.beam(x, entry, 48)
            among = x @ x.T
            np.fill_diagonal(among, -np.inf)
            lead = np.ones(len(batch), bool)
            if fresh:
                best = sims.argmax(1)
                close = sims[np.arange(len(batch)), best] >= NEAR
                self.leader[batch[close]] = near[np.arange(len(batch)), best][close]
                lead &= ~close
                alike = among >= NEAR
                for i in np.flatnonzero(alike.any(1)):
                    if lead[i]:
                        behind = alike[i] & lead & (np.arange(len(batch)) > i)
                        self.leader[batch[behind]] = batch[i]
                        lead &= ~behind
                self.leader[batch[lead]] = batch[lead]
            if not lead.any():
                continue
            k = min(2 * LINKS, int(lead.sum()))
            inner = among[np.ix_(lead, lead)]
            pick = _best(inner, k)
            ids = np.concatenate([near[lead], batch[lead][pick]], 1)
            layer.add(batch[lead], ids, np.concatenate([sims[lead], np.take_along_axis(inner, pick, 1)], 1))
            done += int(lead.sum())
        return done

    def _down(self, layers: list[Layer], q: np.ndarray, top: int) -> np.ndarray:
        at = np.full(len(q), top)
        for layer in layers:
            ids, sims = layer.beam(q, at, 4)
            at = ids[np.arange(len(q)), sims.argmax(1)]
        return at

    def _compact(self, x: np.ndarray) -> None:
        """Keeps leaders alone, numbered anew; audits the beam."""
        self.leaders = np.flatnonzero(self.leader == np.arange(len(x)))
        number = np.full(len(x) + 1, -1, np.int64)
        number[self.leaders] = np.arange(len(self.leaders))
        self.group = number[self.leader]
        self.x = x[self.leaders]
        single = self.x.astype(np.float32)
        for layer in self.layers:
            layer.edges, layer.x = number[layer.edges[self.leaders]].astype(np.int32), single
        self.top = int(number[self.top])
        cos = np.einsum("pd,pd->p", x, self.x[self.group])
        self.radius = np.zeros(len(self.leaders))
        np.maximum.at(self.radius, self.group, np.where(self.leader == np.arange(len(x)), 0, np.arccos(np.clip(cos, -1, 1)) + 1e-7))

    def reach(self, q: np.ndarray, least: np.ndarray):
        """For blocks of rows of q: row, leader and cosine of what is found with the row's least cosine or more."""
        single = q.astype(np.float32)
        bottom = self.layers[-1]
        for a in range(0, len(q), _BLOCK):
            some = single[a : a + _BLOCK]
            low = least[a : a + _BLOCK] - 1e-6
            ids, sims = bottom.beam(some, self._down(self.layers[:-1], some, self.top), self.beam_width)
            seen = np.zeros((len(some), len(self.x)), bool)
            r, c = np.nonzero((ids >= 0) & (sims >= low[:, None]))
            row, node = r, ids[r, c]
            seen[row, node] = True
            while len(row):  # one step of the flood: neighbours in reach that weren't yet
                key = np.unique((row[:, None] * len(self.x) + np.where(bottom.edges[node] >= 0, bottom.edges[node], node[:, None])).ravel())
                row, node = key // len(self.x), key % len(self.x)
                new = ~seen[row, node]
                row, node = row[new], node[new]
                ok = _dots(bottom.x, node, some, row) >= low[row]
                row, node = row[ok], node[ok]
                seen[row, node] = True
            row, node = np.nonzero(seen)
            cos = _dots(q, a + row, self.x, node)
            yield a + row, node, cos

    def audit(self, cosine: float, seed: int = 2) -> float:
        """Widens the beam until vectors at this cosine from some leaders find what an exhaustive comparison finds; the share found."""
        rng = np.random.default_rng(seed)
        some = self.x[rng.permutation(len(self.x))[:AUDITS]]
        aside = rng.standard_normal(some.shape)
        aside -= (aside * some).sum(1, keepdims=True) * some
        norm = np.linalg.norm(aside, axis=1, keepdims=True)
        q = (cosine + 1e-9) * some + math.sqrt(1 - cosine**2) * aside / np.where(norm > 0, norm, 1)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        there = int((q @ self.x.T >= cosine).sum())
        while True:
            found = sum(int((cos >= cosine).sum()) for _, _, cos in self.reach(q, np.full(len(q), cosine)))
            if found >= RECALL * there or self.beam_width >= len(self.x):
                return found / there if there else 1.0
            self.beam_width *= 2


class Joined:
    """Labels of nodes that pairs hang together; keeps the pairs that a spanning forest needs."""

    def __init__(self, n: int):
        self.label, self.pairs = np.arange(n), []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return
        _, at = np.unique(np.minimum(x[apart], y[apart]) * len(self.label) + np.maximum(x[apart], y[apart]), return_index=True)
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.get(v, v) != v:
                root[v] = v = root.get(root[v], root[v])
            return v

        for i in apart[at].tolist():
            u, v = sorted((find(int(x[i])), find(int(y[i]))))
            if u != v:
                root[v] = u
                self.pairs.append((int(a[i]), int(b[i])))
        to = np.arange(len(self.label))
        for v in root:
            to[v] = find(v)
        self.label = to[self.label]


def graphs(nodes: DataFrame, cosine: float) -> DataFrame:
    """Rows of each shard: its graph (leader null), and chunks of each leader's vectors.  nodes: node, w, v, dim, shard."""

    def build(key, table):
        table = table.sort_by("node")
        ids, w = table["node"].to_numpy(), table["w"].to_numpy()
        x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
        big = np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
        x = x / big
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        g = Graph(x)
        recall = g.audit(cosine)
        weight = np.bincount(g.group, w, len(g.leaders)).astype(np.int64)
        blob = {"ids": ids[g.leaders], "x": g.x, "radius": g.radius, "weight": weight, "beam": g.beam_width, "recall": recall, "top": g.top, "layers": [_packed(x.edges) for x in g.layers]}
        out = [(None, [], [], pickle.dumps(blob, 5))]
        order = np.argsort(g.group, kind="stable")
        cut = np.searchsorted(g.group[order], np.arange(len(g.leaders) + 1))
        for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            for c in range(a, b, CHUNK):
                own = order[c : min(b, c + CHUNK)]
                out.append((int(ids[g.leaders[i]]), ids[own].tolist(), w[own].tolist(), x[own].tobytes()))
        dim, shard = (k.as_py() for k in key)
        lead, own, weights, blobs = zip(*out, strict=True)
        n = len(out)
        return trimmed(pa.table({"dim": pa.array([dim] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "leader": pa.array(lead, pa.int64()), "nodes": pa.array(own, pa.list_(pa.int64())), "weights": pa.array(weights, pa.list_(pa.int64())), "blob": pa.array(blobs, pa.binary())}))

    return nodes.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, leader long, nodes array<long>, weights array<long>, blob binary")


def _packed(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes with edges, and these."""
    at = np.flatnonzero((edges >= 0).any(1))
    return at.astype(np.int32), edges[at]


def _loaded(blob: bytes) -> Graph:
    got = pickle.loads(blob)
    g = Graph.__new__(Graph)
    g.ids, g.x, g.radius, g.weight, g.beam_width, g.top, g.layers = got["ids"], got["x"], got["radius"], got["weight"], got["beam"], got["top"], []
    single = g.x.astype(np.float32)
    for at, edges in got["layers"]:
        layer = Layer.__new__(Layer)
        layer.x, layer.edges = single, np.full((len(g.x), edges.shape[1]), -1, np.int32)
        layer.edges[at] = edges
        g.layers.append(layer)
    return g


def asked(built: DataFrame, cosine: float) -> DataFrame:
    """What each pair of shards finds: n (links of each vector behind leader a), or a pair a, b of leaders: linked (sure), or not sure (null n, linked false)."""
    p = parallelism(built.sparkSession)
    limit = math.acos(cosine)
    shards = built.where("leader is null").select("dim", "shard", "blob")
    ids = shards.select("dim", F.col("shard").alias("other"))  # eight bytes a shard of SHARD_VECTORS or SHARD_BYTES
    sides = shards.join(F.broadcast(ids), "dim").select("dim", F.least("shard", "other").alias("lo"), F.greatest("shard", "other").alias("hi"), "shard", "blob")

    def ask(key, table):
        got = [_loaded(b) for b in table["blob"].to_pylist()]
        n_of, pairs, unsure = [], [], []
        for q in got:
            for g in got:
                if len(got) == 2 and q is g:
                    continue
                reach = np.minimum(math.pi, limit + q.radius + g.radius.max(initial=0))
                count, offset = np.zeros(len(q.ids), np.int64), 0 if q is g else len(q.ids)
                joined = Joined(offset + len(g.ids))
                for row, node, cos in g.reach(q.x, np.cos(reach)):
                    apart = q.ids[row] != g.ids[node]
                    row, node, cos = row[apart], node[apart], cos[apart]
                    spread = q.radius[row] + g.radius[node]
                    angle = np.arccos(np.clip(cos, -1, 1))
                    one = spread == 0
                    sure = np.where(one, cos >= cosine, angle + spread <= limit - 1e-7)
                    none = np.where(one, cos < cosine, angle - spread > limit + 1e-7)
                    np.add.at(count, row[sure], g.weight[node[sure]])
                    joined.join(row[sure], node[sure] + offset)
                    maybe = ~sure & ~none
                    unsure.append(np.stack([q.ids[row[maybe]], g.ids[node[maybe]]], 1))
                at = np.flatnonzero(count)
                n_of.append(np.stack([q.ids[at], count[at]], 1))
                few = np.array(joined.pairs, np.int64).reshape(-1, 2)
                pairs.append(np.stack([q.ids[few[:, 0]], g.ids[few[:, 1] - offset]], 1))
        n_of, pairs, unsure = (np.concatenate(x) if x else np.zeros((0, 2), np.int64) for x in (n_of, pairs, unsure))
        none = lambda k: pa.nulls(k, pa.int64())
        out = [
            pa.table({"a": n_of[:, 0], "b": none(len(n_of)), "n": n_of[:, 1], "linked": pa.array([False] * len(n_of))}),
            pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "n": none(len(pairs)), "linked": pa.array([True] * len(pairs))}),
            pa.table({"a": unsure[:, 0], "b": unsure[:, 1], "n": none(len(unsure)), "linked": pa.array([False] * len(unsure), pa.bool_())}),
        ]
        return trimmed(pa.concat_tables([t.cast(pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("linked", pa.bool_())])) for t in out]))

    return sides.repartition(p, "dim", "lo", "hi").groupBy("dim", "lo", "hi").applyInArrow(ask, "a long, b long, n long, linked boolean")


def compared(unsure: DataFrame, built: DataFrame, cosine: float) -> DataFrame:
    """node, n of the vectors of leaders a that are linked with some behind b, and the pair a, b, for pairs of leaders that need it."""
    p = parallelism(unsure.sparkSession)
    chunks = built.where("leader is not null")
    left = unsure.join(chunks.select(F.col("leader").alias("a"), "nodes", F.col("blob").alias("x")), "a")
    both = left.join(chunks.select(F.col("leader").alias("b"), "weights", F.col("blob").alias("y")), "b").select("a", "b", "nodes", "x", "weights", "y")

    def verify(batches):
        for batch in batches:
            out = [(), (), (), ()]
            rows = []
            for a, b, nodes, x, weights, y in zip(*(batch[c].to_pylist() for c in ("a", "b", "nodes", "x", "weights", "y")), strict=True):
                left, right = np.frombuffer(x).reshape(len(nodes), -1), np.frombuffer(y).reshape(len(weights), -1)
                n = (left @ right.T >= cosine) @ np.array(weights)
                rows += [(node, a, b, int(k)) for node, k in zip(nodes, n, strict=True) if k]
            out = list(zip(*rows, strict=True)) or out
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["node", "a", "b", "n"])

    return both.repartition(p).mapInArrow(verify, "node long, a long, b long, n long")


def link(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept, for each row of vectors (vec_id, embedding).

    Two vectors of equal length are linked if their cosine, in double precision,
    is `cosine` or more.  n_links: the other vec_ids linked directly;
    component_id: the least vec_id reachable over links; kept: vec_id is
    component_id.  Vectors that are null, empty or zero or have null or
    non-finite components are linked with nothing and kept; so are rows of null
    vec_id, whose component_id is null.  Rows that repeat a vec_id with the same
    vector are one; with other vectors, each is a vector of its own.  Other
    columns aren't looked at.  An empty table gives none.
    """
    spark = vectors.sparkSession
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    x = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))  # one zero
    good = F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", fine) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(good, x).alias("v"))
    nodes = rows.where("v is not null").groupBy("v").agg(F.countDistinct("vec_id").alias("w"), F.min("vec_id").alias("least"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "w", "least", "v", F.size("v").alias("dim")))
    of_dim = F.broadcast(nodes.groupBy("dim").agg(F.count("*").alias("of_dim")))  # d lengths take d**2 / 2 components at least, so these are few
    most = F.least(F.lit(SHARD_VECTORS), F.greatest(F.lit(256), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    shards = F.greatest(F.ceil(F.col("of_dim") / most), F.least(F.lit(SHARDS), F.ceil(F.col("of_dim") / 256)))
    dealt = nodes.join(of_dim, "dim").select("node", "w", "v", "dim", F.pmod(F.xxhash64("node"), shards).cast("int").alias("shard"))
    built = written(graphs(dealt, cosine))
    found = written(asked(built, cosine))
    close = written(compared(found.where("n is null and not linked").select("a", "b"), built, cosine))
    edges = found.where("linked").select("a", "b").union(close.select("a", "b").distinct())
    comps = components(edges).withColumnRenamed("node", "leader")
    groups = built.where("leader is not null").select("leader", F.explode("nodes").alias("node"))
    whole = groups.join(nodes.select("node", "w", "least"), "node")
    of_group = whole.groupBy("leader").agg(F.sum("w").alias("all"), F.min("least").alias("first"))
    of_group = of_group.join(found.where("n is not null").groupBy(F.col("a").alias("leader")).agg(F.sum("n").alias("far")), "leader", "left")
    of_group = of_group.join(comps, "leader", "left").withColumn("comp", F.coalesce("comp", "leader"))
    of_group = written(of_group.select("leader", "comp", "first", (F.col("all") - 1 + F.coalesce("far", F.lit(0))).alias("n")))
    first = of_group.groupBy("comp").agg(F.min("first").alias("component_id"))
    of_group = of_group.join(first, "comp").select("leader", "n", "component_id")
    own = groups.join(of_group, "leader").join(close.groupBy("node").agg(F.sum("n").alias("more")), "node", "left")
    own = own.select("node", (F.col("n") + F.coalesce("more", F.lit(0))).cast("long").alias("n"), "component_id")
    keyed = nodes.select("node", F.col("v").alias("key")).join(own, "node").select("key", "n", "component_id")
    out = rows.join(keyed, rows["v"] == keyed["key"], "left")
    component = F.when(F.col("v").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
