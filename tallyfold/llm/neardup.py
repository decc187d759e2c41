"""MinHash near-dedup: banded candidates, filtered by odd sketches, confirmed on whole shingle sets.

A document's MinHash samples are folded into a parity bitmap (an odd sketch):
each sample flips one bit, so the ones of the XOR of two sketches count the
samples that differ, precisely where most agree.  Documents that share a band
are compared by sketch inside blocks of a bounded number of documents; texts of
the remaining candidates are read again and their sets compared in full.

Copies are one node from the start.  Candidates come in two passes: first the
edges of a spanning forest of the most similar sketches in each block, whose
confirmed links give components; then, where such a forest still holds several
components, the sketches of all documents of different ones against each other,
and those that are near on whole sets, so that no link that could join two is
left unchecked.  Sets are sets of 64-bit hashes of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.text import MUL, PLAIN, Texts, U, combine, mix, parallelism, slices, trimmed, written

ROWS = 4  # samples of a band
MISSED = 1e-7  # chance that a link at the threshold shares no band
SKETCH_BITS = 512
SLACK_SIGMA = 6.5  # a sketch rejects only what is further from the threshold
BLOCK = 512  # documents that are compared at once
PURE = 128  # documents of a component that get blocks of their own
HUB = 256  # pairs of one document that are compared in one group
_FILTER_BITS = 1 << 25


def band_count(percent: int) -> int:
    return math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** ROWS))


def most_flips(percent: int) -> int:
    """Ones in the XOR of two sketches beyond which the similarity is below percent all but surely."""
    k, t = ROWS * band_count(percent), percent / 100
    differ = min(k, k * (1 - t) + SLACK_SIGMA * math.sqrt(k * t * (1 - t)))
    return math.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differ))) + 8


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's shingles; of fewer words, one of them all; of none, nothing."""
    w = Texts(texts).words(PLAIN, fold=True)
    n = max(0, len(w.hash) - words + 1)
    h = combine(*(w.hash[j : j + n] for j in range(words)))
    out = []
    for a, b in zip(w.first.tolist(), w.last.tolist(), strict=True):
        if b - a >= words:
            s = np.sort(h[a : b - words + 1])  # np.unique hashes, which takes longer
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            out.append(mix(np.array([sum(int(x) * int(m) for x, m in zip(w.hash[a:b], MUL[20:], strict=False)) % 2**64], U)))
        else:
            out.append(np.zeros(0, U))
    return out




def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, d1, d2 (a 128-bit digest of the set), bands, sketch; bands and sketch are empty without shingles."""
    bands = band_count(percent)
    k = bands * ROWS
    rng = np.random.default_rng(11)
    mul = (rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1)).tolist()
    add = rng.integers(0, 2**32, k, dtype=np.uint32).tolist()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                sets = shingle_sets(part["text"], words)
                size = np.array([len(s) for s in sets])
                full = np.flatnonzero(size)
                u = np.concatenate(sets)
                at = np.cumsum(size[full]) - size[full]
                low = (u >> U(32)).astype(np.uint32)
                least = np.empty((len(full), k), np.uint32)
                d = np.zeros((2, len(size)), np.int64)
                if len(full):
                    for j, (m, a) in enumerate(zip(mul, add, strict=True)):
                        x = low * np.uint32(m) + np.uint32(a)
                        x ^= x >> np.uint32(15)
                        x *= np.uint32(0x2C1B3C6D)
                        x ^= x >> np.uint32(13)
                        least[:, j] = np.minimum.reduceat(x, at)
                    d[0, full] = np.add.reduceat(u, at).view(np.int64)
                    d[1, full] = np.bitwise_xor.reduceat(mix(u * MUL[9]), at).view(np.int64)
                wide = least.astype(U)
                keys = np.empty((len(full), bands), U)
                for b in range(bands):
                    keys[:, b] = combine(*(wide[:, b * ROWS + r] for r in range(ROWS)), np.full(len(full), b, U))
                bit = (mix((wide + U(1)) * MUL[3] + np.arange(k, dtype=U) * MUL[5]) % U(SKETCH_BITS)).astype(np.int64)
                ones = np.bincount((np.arange(len(full))[:, None] * SKETCH_BITS + bit).ravel(), minlength=len(full) * SKETCH_BITS) & 1
                packed = np.packbits(ones.astype(np.uint8).reshape(len(full), SKETCH_BITS), axis=1)
                sketch = [b""] * len(size)
                for i, j in enumerate(full.tolist()):
                    sketch[j] = packed[i].tobytes()
                ends = np.zeros(len(size) + 1, np.int32)
                ends[1:] = np.cumsum(np.where(size > 0, bands, 0))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel().view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(size, pa.int64()), pa.array(d[0]), pa.array(d[1]), lists, pa.array(sketch, pa.binary())], ["doc_id", "n", "d1", "d2", "bands", "sketch"])
            trimmed()

    return docs.select("doc_id", "text").mapInArrow(signed, "doc_id long, n long, d1 long, d2 long, bands array<long>, sketch binary")


def _flips(sketches: np.ndarray, row: int) -> np.ndarray:
    return np.bitwise_count(sketches ^ sketches[row]).sum(1, dtype=np.int64)


def _forest(sketches: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the most similar sketches, none over `most` flips (Prim's order)."""
    n = len(sketches)
    far = np.iinfo(np.int64).max
    near, via, out = np.full(n, far), np.zeros(n, np.int64), np.ones(n, bool)
    edges, row = [], 0
    for _ in range(n - 1):
        out[row] = False
        flips = _flips(sketches, row)
        closer = out & (flips < near)
        near[closer], via[closer] = flips[closer], row
        row = int(np.argmin(np.where(out, near, far)))
        if not out[row]:
            row = int(np.flatnonzero(out)[0])
        if near[row] <= most:
            edges.append((int(via[row]), row))
    return edges


def candidates(members: DataFrame, most: int) -> DataFrame:
    """Pairs a < b of members (key, m, rep, sketch) of one band, at most `most` flips apart: a spanning forest in each block."""
    p = parallelism(members.sparkSession)
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = members.withColumn("nb", blocks).withColumn("b", F.pmod(F.xxhash64("rep"), "nb").cast("int"))
    rows = rows.withColumn("o", F.explode(F.expr("if(nb = 1, array(0), filter(sequence(0, nb - 1), x -> x <> b))")))
    rows = rows.withColumn("lo", F.least("b", "o")).withColumn("hi", F.greatest("b", "o"))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(16 * p)).cast("int")).select("g", "key", "lo", "hi", "rep", "sketch")

    def pairs(key, table):
        table = table.sort_by([("key", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("rep", "ascending")])
        rep = table["rep"].to_numpy()
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), U).reshape(-1, SKETCH_BITS // 64)
        same = np.ones(len(rep), bool)
        same[0] = False
        for c in ("key", "lo", "hi"):
            x = table[c].to_numpy()
            same[1:] &= x[1:] == x[:-1]
        start = np.flatnonzero(~same)
        end = np.append(start[1:], len(rep))
        two = start[end - start == 2]
        ok = np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(1, dtype=np.int64) <= most
        found = [np.stack([two[ok], two[ok] + 1], 1)]
        for a, b in zip(start.tolist(), end.tolist(), strict=True):
            if b - a < 3:
                continue
            if edges := _forest(sketch[a:b], most):
                found.append(np.array(edges) + a)
        at = np.concatenate(found)
        a, b = rep[at[:, 0]], rep[at[:, 1]]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        both = both[both[:, 0] < both[:, 1]]
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})

    return rows.repartition(p, "g").groupBy("g").applyInArrow(pairs, "a long, b long").distinct()


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and text of these documents, and of a few others: a filter of fixed size keeps most out of the shuffle."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(_FILTER_BITS))
    words_of = ids.select((place / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(doc_id), {_FILTER_BITS}), 64) as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    bitmap = np.zeros(_FILTER_BITS // 64, np.int64)
    for r in words_of.toLocalIterator():  # 4 MB at most
        bitmap[r["w"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["place"].to_numpy()
            hit = (shared.value[at // 64].view(U) >> (at % 64).astype(U) & U(1)).astype(bool)
            yield batch.filter(pa.array(hit)).select(["doc_id", "text"])

    return docs.where("doc_id is not null").select("doc_id", "text", place.alias("place")).mapInArrow(wanted, "doc_id long, text string")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose whole shingle sets meet the threshold; pairs is a written table, read a few times."""
    p = parallelism(docs.sparkSession)
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs)
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).alias("salts"))  # a hub's text goes to as many groups as its pairs fill
    salted = written(pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")))
    members = salted.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "text")
    hubs = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rows = hubs.union(members).withColumn("g", F.pmod(F.xxhash64("a", "salt"), F.lit(16 * p)).cast("int")).select("g", "a", "salt", "b", "text")

    def compare(key, table):
        table = table.sort_by([("a", "ascending"), ("salt", "ascending")])
        found, hub, at = [], [], None
        for batch in table.combine_chunks().to_batches():
            for part in slices(batch, "text", 2 << 20):
                sets = shingle_sets(part["text"], words)
                for a, salt, b, s in zip(part["a"].to_pylist(), part["salt"].to_pylist(), part["b"].to_pylist(), sets, strict=True):
                    if at != (a, salt):
                        hub, waiting, at = [], [], (a, salt)
                    if b is None:
                        hub.append(s)
                        todo = [(x, s) for x in waiting]
                    else:
                        waiting.append((b, s))
                        todo = [((b, s), h) for h in hub]
                    for (other, x), h in todo:
                        meet = len(np.intersect1d(x, h, assume_unique=True))
                        if meet and 100 * meet >= percent * (len(x) + len(h) - meet):
                            found.append((a, other))
        return trimmed(pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())}))

    return rows.repartition(p, "g").groupBy("g").applyInArrow(compare, "a long, b long")


def across(tried: DataFrame, comps: DataFrame, sketches: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b as components) between the components of each family, a family being what the tried pairs hang together.

    Families of one component are done.  In the others, components of many
    documents fill blocks of their own and the rest share blocks; each pair of
    blocks that isn't of one component is compared by sketches (rep, sketch), and
    the documents that are near one of another component are compared in full,
    as products of their incidence matrices.  A task gives one row for each pair
    of components that it joins, not for each pair of documents.
    """
    spark = docs.sparkSession
    p, most = parallelism(spark), most_flips(percent)
    families = components(tried).withColumnRenamed("node", "rep").withColumnRenamed("comp", "family")
    members = families.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = members.groupBy("family").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("family")
    members = written(members.join(mixed, "family", "left_semi"))
    sizes = members.groupBy("family", "comp").agg(F.count("*").alias("s"))
    small = F.when(F.col("s") < PURE, F.col("s"))
    rest = written(sizes.groupBy("family").agg(F.coalesce(F.sum(small), F.lit(0)).alias("rest")))
    big = F.col("s") >= PURE
    of = F.when(big, F.pmod(F.xxhash64("rep"), F.ceil(F.col("s") / BLOCK))).otherwise(F.pmod(F.xxhash64("comp"), F.ceil(F.col("rest") / BLOCK)))
    blocked = members.join(written(sizes), ["family", "comp"]).join(rest, "family").select("rep", "comp", "family", F.when(big, F.col("comp")).alias("pure"), of.alias("no"))
    blocked = blocked.withColumn("block", F.xxhash64("family", F.coalesce("pure", F.lit(-1)), F.col("pure").isNull(), "no"))
    blocked = written(blocked.join(sketches, "rep"))
    blocks = written(blocked.select("family", "pure", "block").distinct())
    x, y = blocks.alias("x"), blocks.alias("y")
    met = x.join(y, F.col("x.family") == F.col("y.family")).where("x.block <= y.block and not (x.pure <=> y.pure and x.pure is not null)")
    met = met.select(F.col("x.block").alias("lo"), F.col("y.block").alias("hi"))
    sides = written(met.select("lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block")))
    rows = sides.join(blocked.select("block", "rep", "comp", "sketch"), "block").select("lo", "hi", "rep", "comp", "sketch")

    def in_pairs(table: pa.Table) -> Iterator[pa.Table]:
        table = table.sort_by([("lo", "ascending"), ("hi", "ascending")]).combine_chunks()
        lo, hi = (table[c].to_numpy() for c in ("lo", "hi"))
        edge = np.flatnonzero(np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))) if len(lo) else []
        for a, b in zip(edge, [*edge[1:], len(lo)], strict=True):
            yield table.slice(a, b - a)

    def near(key, table):
        """Documents of each pair of blocks that are near one of another component, by sketch."""
        out = []
        for own in in_pairs(table):
            sketch = np.frombuffer(b"".join(own["sketch"].to_pylist()), U).reshape(-1, SKETCH_BITS // 64)
            comp = own["comp"].to_numpy()
            hit = np.zeros(len(comp), bool)
            for i in range(len(comp)):
                hit[i] = ((_flips(sketch, i) <= most) & (comp != comp[i])).any()
            out.append(own.filter(pa.array(hit)).select(["lo", "hi", "rep", "comp"]))
        return trimmed(pa.concat_tables(out))

    grouped = rows.withColumn("g", F.pmod(F.xxhash64("lo", "hi"), F.lit(64 * p)).cast("int"))
    close = written(grouped.repartition(p, "g").groupBy("g").applyInArrow(near, "lo long, hi long, rep long, comp long"))
    texts = texts_of(close.select(F.col("rep").alias("doc_id")), docs).withColumnRenamed("doc_id", "rep")
    full = close.join(texts, "rep").withColumn("g", F.pmod(F.xxhash64("lo", "hi"), F.lit(64 * p)).cast("int")).select("g", "lo", "hi", "comp", "text")

    def compare(key, table):
        found = [np.zeros((0, 2), np.int64)]
        for own in in_pairs(table):
            sets = [s for batch in own.to_batches() for part in slices(batch, "text", 2 << 20) for s in shingle_sets(part["text"], words)]
            size = np.array([len(s) for s in sets])
            ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
            row = np.repeat(np.arange(len(sets)), size)
            meet = np.zeros((len(sets), len(sets)))
            order = np.argsort(ids, kind="stable")
            ids, row = ids[order], row[order]
            for start in range(0, int(ids[-1]) + 1 if len(ids) else 0, 4096):
                u, v = np.searchsorted(ids, [start, start + 4096])
                part = np.zeros((len(sets), 4096), np.float32)
                part[row[u:v], ids[u:v] - start] = 1
                meet += part @ part.T
            c = own["comp"].to_numpy()
            linked = (meet > 0) & (100 * meet >= percent * (size[:, None] + size[None, :] - meet)) & (c[:, None] < c[None, :])
            i, j = np.nonzero(linked)
            found.append(np.unique(np.stack([c[i], c[j]], 1), axis=0))
        both = np.unique(np.concatenate(found), axis=0)
        return trimmed(pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())}))

    return full.repartition(p, "g").groupBy("g").applyInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (least node reachable) of the edges a, b, by contraction.

    In each round every label takes the label that comes first among its
    neighbours and itself, or that one's choice, and edges between labels that
    are still apart stay, once each.  The order is that of the ids in the first
    two rounds, which end what hangs on one document, and in every other one from
    then on; between, it is another hash each time, so that long chains are
    halved.  What a round leaves is a written table.  A label of many nodes is
    one join key; only its rows of two numbers meet there, and adaptive
    execution splits them.
    """
    links = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ups: list[DataFrame] = []
    for turn in count():
        if links.isEmpty():
            break
        rank = lambda c: F.xxhash64(F.lit(turn), F.col(c)) if turn and turn % 2 == 0 else F.col(c)  # noqa: B023, E731
        near = links.select("a", "b").union(links.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min(F.struct(rank("b").alias("r"), "b")).alias("n"))
        up = near.select("node", F.when(F.col("n.r") < rank("node"), F.col("n.b")).otherwise(F.col("node")).alias("y"))
        up = written(up.join(up.select(F.col("node").alias("y"), F.col("y").alias("to")), "y").select("node", "to"))
        ups.append(up)
        for end in ("a", "b"):
            links = links.join(up.withColumnRenamed("node", end), end).withColumn(end, F.col("to")).drop("to")
        links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not ups:
        return links.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    labels = ups[0].select("node", F.col("to").alias("comp"))
    for up in ups[1:]:  # each is about half of the one before, or less
        labels = labels.join(up.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    labels = written(labels)
    least = labels.groupBy("comp").agg(F.min("node").alias("least"))
    return written(labels.join(least, "comp").select("node", F.col("least").alias("comp")))


def link(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for each row of docs (doc_id, text).

    Words are runs of anything but blank, tab, line feed, vertical tab, form
    feed and carriage return, after lower-casing A-Z.  Two documents are linked
    if their sets of `words`-word shingles have 100 * intersection >= percent *
    union.  component_id: the least doc_id reachable over links, itself
    included.  kept: doc_id is component_id.  A text of fewer words is one
    shingle; null, empty and blank texts are linked with nothing and kept.  Rows
    of null doc_id are linked with nothing, have null component_id and are kept.
    Rows that repeat a doc_id are one node.  Other columns are not looked at.
    """
    docs = docs.select("doc_id", "text")
    most = most_flips(percent)
    sig = written(signatures(docs, words, percent))
    nodes = sig.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    nodes = written(nodes)
    own = sig.join(nodes.withColumnRenamed("rep", "doc_id"), ["d1", "d2", "n", "doc_id"], "left_semi").dropDuplicates(["doc_id", "d1", "d2"])
    bands = own.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = bands.join(shared, "key").join(own.select(F.col("doc_id").alias("rep"), "sketch"), "rep")
    members = written(members.select("key", "m", "rep", "sketch"))
    tried = written(candidates(members, most))
    links = written(confirmed(tried, docs, words, percent))
    comps = components(links)
    more = written(across(tried, comps, own.select(F.col("doc_id").alias("rep"), "sketch"), docs, words, percent))
    final = components(links.union(more)) if more.limit(1).count() else comps
    reps = nodes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("comp", "rep").alias("component"))
    out = sig.drop("bands", "sketch").join(reps, ["d1", "d2", "n"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
