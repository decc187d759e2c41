"""Ranked lexical search: posting lists in blocks of like documents, skipped by exact bounds.

One pass over the texts leaves what the items' terms do in each document; all
else reads that.  A task's documents are an index of their own.  Each of its
posting lists is clustered by the similarity of the documents (random signs of
their weighted terms), and a block keeps the coordinatewise maximum of its
documents.  An item reads its lists by falling weight, and of each list the
blocks by falling bound; a block is left out only if its bound, the item's
weights times the block's maxima, is below the score of the k-th document so
far, and the rest of the lists only if their best places together are.  A first
look at one document in SAMPLE gives every task scores to begin with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.text import _FOLDED, ALNUM, Texts, discard, slices, trimmed, written

#: Bytes of the items' terms that are looked for at once; more are looked for in further passes.
BLOCK_BYTES = 16 << 20
#: Postings of one index.
SHARD_POSTINGS = 1 << 20
#: Documents of a block, more or less, and blocks of a list at most.
BLOCK, BLOCKS = 32, 64
#: Bytes of the maxima that an index holds; then it starts afresh.
_HELD = 128 << 20
SAMPLE = 64
_SIGNS = 16
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_TERM), F.lit(0))


class Vocabulary:
    """Numbers of terms; words are found by hash and compared by bytes."""

    def __init__(self, terms: pa.Array):
        texts = Texts(terms)
        words = texts.words(ALNUM, fold=True)
        self.order = np.argsort(words.hash, kind="stable")
        self.hash = words.hash[self.order]
        self.data, self.start, self.size = texts.data, texts.start, texts.end - texts.start
        self.same = max(1, int(np.unique(self.hash, return_counts=True)[1].max(initial=1)))

    def __len__(self) -> int:
        return len(self.order)

    def find(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text and term of each word that is one, and the words of each text."""
        words = texts.words(ALNUM, fold=True)
        lo = np.searchsorted(self.hash, words.hash)
        found = []
        for k in range(self.same if len(self) else 0):
            at = np.minimum(lo + k, len(self) - 1)
            word = np.flatnonzero(self.hash[at] == words.hash)
            term = self.order[at[word]]
            right = words.end[word] - words.start[word] == self.size[term]
            word, term = word[right], term[right]
            size = self.size[term]
            if len(word):
                begin = np.cumsum(size) - size
                step = np.arange(int(size.sum())) - np.repeat(begin, size)
                differ = _FOLDED[texts.data[np.repeat(words.start[word], size) + step]] != self.data[np.repeat(self.start[term], size) + step]
                right = ~np.logical_or.reduceat(differ, begin)
                found.append(np.stack([word[right], term[right]]))
        word, term = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        return np.searchsorted(words.first, word, "right") - 1, term, words.last - words.first


def forward(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n, terms (ascending numbers), tf of each document with a word; vocabulary: a broadcast one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                doc, term, n = v.find(Texts(part["text"]))
                key, tf = np.unique(doc * max(1, len(v)) + term, return_counts=True)
                ends = np.searchsorted(key, np.arange(len(n) + 1) * max(1, len(v))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % max(1, len(v)), tf)]
                out = pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n), *lists], ["doc_id", "n", "terms", "tf"])
                yield out.filter(pa.array(n > 0))
            trimmed()

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id long, n long, terms array<int>, tf array<int>")


def statistics(rows: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, their words, and in how many documents each term is; a few numbers a term come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            total[0] += len(batch)
            total[1] += batch["n"].to_numpy().sum()
            total[2:] += np.bincount(batch["terms"].flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "n"])

    got = rows.select("n", "terms").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size + 2, np.int64)
    for r in got:
        out[r["place"]] = r["n"]
    return int(out[0]), int(out[1]), out[2:]


class Index:
    """Posting lists of some documents, clustered when they are first read."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, terms: np.ndarray, worth: np.ndarray, weight: np.ndarray):
        self.ids, self.size, self.terms, self.worth = ids, size, terms, worth
        self.first = np.cumsum(size) - size
        doc = np.repeat(np.arange(len(ids)), size)
        order = np.argsort(terms, kind="stable")
        self.posted = doc[order].astype(np.int32)
        self.list = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(weight)))])
        self.best = np.zeros(len(weight), np.int64)
        np.maximum.at(self.best, terms, worth)
        signs = np.random.default_rng(8).choice(np.array([-1, 1], np.float32), (len(weight), _SIGNS))
        self.sketch = np.zeros((len(ids), _SIGNS), np.float32)
        for a in range(0, len(terms), 1 << 16):
            b = slice(a, a + (1 << 16))
            np.add.at(self.sketch, doc[b], signs[terms[b]] * (weight[terms[b]] * worth[b]).astype(np.float32)[:, None])
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.held = 0

    def places(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The postings of these documents, and where each document's begin."""
        n = self.size[docs]
        begin = np.cumsum(n) - n
        return np.repeat(self.first[docs] - begin, n) + np.arange(int(n.sum())), begin

    def blocked(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents of a term by block, the ends of the blocks, the terms that they hold, and each block's maxima of these."""
        if term not in self.blocks:
            docs = self.posted[self.list[term] : self.list[term + 1]]
            k = max(1, min(BLOCKS, math.ceil(len(docs) / BLOCK)))
            label = np.zeros(len(docs), np.int64)
            if k > 1:
                middle = self.sketch[docs[np.linspace(0, len(docs) - 1, k).astype(int)]].T
                middle = middle / np.maximum(np.linalg.norm(middle, axis=0), 1e-9)
                for a in range(0, len(docs), 1 << 14):
                    label[a : a + (1 << 14)] = (self.sketch[docs[a : a + (1 << 14)]] @ middle).argmax(1)
            order = np.argsort(label, kind="stable")
            docs, label = docs[order], label[order]
            held = np.zeros(len(self.list) - 1, bool)
            for a in range(0, len(docs), 1 << 12):
                held[self.terms[self.places(docs[a : a + (1 << 12)])[0]]] = True
            columns = np.flatnonzero(held)
            number = np.cumsum(held) - 1
            maxima = np.zeros(k * len(columns), np.int32)
            for a in range(0, len(docs), 1 << 12):
                some = docs[a : a + (1 << 12)]
                at, _ = self.places(some)
                np.maximum.at(maxima, np.repeat(label[a : a + (1 << 12)] * len(columns), self.size[some]) + number[self.terms[at]], self.worth[at])
            maxima = maxima.reshape(k, -1)
            if self.held > _HELD:
                self.blocks.clear()
                self.held = 0
            self.held += maxima.nbytes + docs.nbytes
            self.blocks[term] = docs, np.searchsorted(label, np.arange(k), "right"), columns, maxima
        return self.blocks[term]

    def top(self, terms: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the best k for an item of these terms; those below `least` may be missing."""
        terms = terms[(weight[terms] > 0) & (self.best[terms] > 0)]
        most = weight[terms] * self.best[terms]
        order = np.argsort(-most, kind="stable")
        terms, most = terms[order], most[order]
        rest = np.cumsum(most[::-1])[::-1]
        own = np.zeros(len(weight), np.int64)
        own[terms] = weight[terms]
        seen = np.zeros(len(self.ids), bool)
        docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), max(1, least)
        for term, bound in zip(terms.tolist(), rest.tolist(), strict=True):
            if bound < least:
                break
            listed, ends, columns, maxima = self.blocked(term)
            there = terms[np.isin(terms, columns)]
            bounds = maxima[:, np.searchsorted(columns, there)].astype(np.int64) @ weight[there]
            order, at, step = np.argsort(-bounds, kind="stable"), 0, 1
            while at < len(order) and bounds[order[at]] >= least:  # more blocks at once each time
                next_ = order[at : at + step]
                next_ = next_[bounds[next_] >= least]
                at, step = at + step, 2 * step
                some = np.concatenate([listed[ends[b - 1] if b else 0 : ends[b]] for b in next_.tolist()])
                some = some[~seen[some]]
                if not len(some):
                    continue
                seen[some] = True
                found = []
                for a in range(0, len(some), 1 << 12):
                    post, begin = self.places(some[a : a + (1 << 12)])
                    found.append(np.add.reduceat(own[self.terms[post]] * self.worth[post], begin))
                docs, scores = np.concatenate([docs, some]), np.concatenate([scores, *found])
                keep = np.lexsort((self.ids[docs], -scores))[:k]
                docs, scores = docs[keep], scores[keep]
                if len(docs) == k:
                    least = max(least, int(scores[-1]))
        return docs, scores


def best(rows: DataFrame, shared, k: int, kind: str) -> DataFrame:
    """item, item_id, doc_id, score: each task's best k for each item; shared: broadcast item_ids, terms of items, weights, N, L, least scores."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists, weight, n_docs, n_words, least = shared.value

        def answered(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            n = table["n"].to_numpy()
            m = 10 + (90 * n * n_docs) // n_words
            size = np.diff(table["terms"].chunk(0).offsets.to_numpy())
            terms, tf = (table[c].chunk(0).flatten().to_numpy() for c in ("terms", "tf"))
            worth = np.empty(len(tf), np.int32)  # at most 10**6
            heavy = np.repeat(8 * m, size)
            for a in range(0, len(tf), 1 << 16):
                some = tf[a : a + (1 << 16)].astype(np.int64)
                worth[a : a + (1 << 16)] = (1_000_000_000 * some) // (1000 * some + heavy[a : a + (1 << 16)])
            index = Index(table["doc_id"].to_numpy(), size, terms, worth, weight)
            found = [(i, *index.top(t, weight, k, int(least[i]))) for i, t in enumerate(lists)]
            item = np.repeat([i for i, _, _ in found], [len(d) for _, d, _ in found]).astype(np.int64)
            docs = np.concatenate([d for _, d, _ in found])
            return pa.RecordBatch.from_arrays([pa.array(item), ids.take(pa.array(item)), pa.array(index.ids[docs]), pa.array(np.concatenate([s for _, _, s in found]))], ["item", "item_id", "doc_id", "score"])

        held, size = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                size += len(batch["terms"].flatten())
            if size >= SHARD_POSTINGS:
                yield answered(held)
                held, size = [], 0
                trimmed()
        if held:
            yield answered(held)
        trimmed()

    found = rows.where("doc_id is not null").mapInArrow(find, f"item long, item_id {kind}, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of docs (doc_id, text) for each of items (item_id, text).

    A term is a run of letters and digits: [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+,
    A-Z lower-cased.  With N documents with a term, L terms in all, n in the
    document, m = 100 - 90 + 90 * n * N div L, tf occurrences of a term that df
    documents hold and w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), the
    score is the sum of w * (10**9 * tf div (1000 * tf + 8 * m)) over the item's
    terms, once each.  Only scores above 0 count; equal ones go by doc_id.

    Null and empty texts have no terms.  Rows of one item_id are one item, those
    of null are left out; items that find nothing give no row.  Documents of
    null doc_id count for N, L and df and aren't returned; repeated rows are
    documents of their own.  Other columns aren't looked at.  Without documents
    or items the result is empty.  The items are taken in blocks whose terms
    have about BLOCK_BYTES, so their number isn't bounded; each block is a pass.
    """
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    wanted = written(items.where("item_id is not null and text is not null").select("item_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).distinct())
    total = wanted.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    out = None
    for b in range(math.ceil(total / BLOCK_BYTES)):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(math.ceil(total / BLOCK_BYTES))) == b).orderBy("item_id").toArrow()  # about BLOCK_BYTES
        term = rows["term"].combine_chunks().dictionary_encode()
        ids = rows["item_id"].combine_chunks().dictionary_encode()
        if not len(rows):
            continue
        vocabulary = spark.sparkContext.broadcast(Vocabulary(term.dictionary))
        table = written(forward(docs, vocabulary))
        n_docs, n_words, df = statistics(table, len(term.dictionary))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        at = ids.indices.to_numpy()
        lists = [x.astype(np.int64) for x in np.split(term.indices.to_numpy(), np.flatnonzero(np.diff(at)) + 1)]
        least = np.zeros(len(lists), np.int64)
        known = (ids.dictionary, lists, weight, n_docs, n_words)
        some = table.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SAMPLE)) == 0)
        for r in best(some, spark.sparkContext.broadcast((*known, least)), k, kind).where(F.col("rank") == k).select("item", "score").collect():  # a number for each item of the block
            least[r["item"]] = r["score"]
        found = written(best(table, spark.sparkContext.broadcast((*known, least)), k, kind).select("item_id", "rank", "doc_id", "score"))
        discard(table)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out
