"""Language ID by Bayesian evidence fusion.

A text's likelihood under each language comes from its byte trigrams.  Added in
logarithms: the chance that a page of that language declares what it declares,
and the language's share on the host, smoothed towards that of the address
suffix, which is smoothed towards that of the whole table.  Shares and chances
are sums of the text-only posteriors by grouped aggregation over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.text import _FOLDED, Texts, parallelism, slices, trimmed, written

GRAMS = 1 << 16
#: Labelled rows that the trigram model is fitted on: those of least text hash.
TRAIN_ROWS = 4_000
#: Rows' worth of the parent's share that a host's or suffix's own counts are smoothed with.
STRENGTH = 20.0
#: Least posterior of a language for a text to be kept.
MIN_POSTERIOR = 0.5
_OVERLAP = 3.0  # each byte is in three trigrams
_FOLD = _FOLDED.astype(np.uint32)
_SLICE = 1 << 18  # bytes of text whose trigrams are looked up at once


def _grams(texts: Texts) -> np.ndarray:
    b = _FOLD[texts.data]
    n = max(0, len(b) - 2)
    return (b[:n] * np.uint32(0x9E37) + b[1 : n + 1] * np.uint32(0x85EB) * np.uint32(3) + b[2 : n + 2] * np.uint32(0xC2B3)) & np.uint32(GRAMS - 1)


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # trigram, language
    bytes_logp: np.ndarray  # byte, whatever the language


def train(labelled: DataFrame, text: str = "text", label: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Trigram model from at most `rows` labelled rows (and ties of the last text hash), chosen by text hash."""
    h = F.xxhash64(text)
    known = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("text"), F.lower(label).alias("label"), h.alias("h"))
    limit = known.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    sample = known.where(F.col("h") <= F.lit(limit if limit is not None else 0))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part["text"])
                grams = _grams(texts)
                for lang, a, b in zip(part["label"].to_pylist(), texts.start.tolist(), texts.end.tolist(), strict=True):
                    sums.setdefault(lang, np.zeros(GRAMS + 256, np.int64))
                    sums[lang][:GRAMS] += np.bincount(grams[a : max(a, b - 2)], minlength=GRAMS)
                    sums[lang][GRAMS:] += np.bincount(_FOLD[texts.data[a:b]], minlength=256)
        trimmed()
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["label", "gram", "n"])

    counts = sample.select("text", "label").mapInArrow(counted, "label string, gram int, n long")
    names = sorted(r["label"] for r in counts.select("label").distinct().collect())
    place = {lang: i for i, lang in enumerate(names)}
    table, alone = np.full((GRAMS, len(names)), 0.5, np.float32), np.full(256, 0.5)
    for r in counts.groupBy("label", "gram").agg(F.sum("n").alias("n")).toLocalIterator():  # up to GRAMS + 256 rows for each language
        if r["gram"] < GRAMS:
            table[r["gram"], place[r["label"]]] += r["n"]
        else:
            alone[r["gram"] - GRAMS] += r["n"]
    for i in range(len(names)):
        table[:, i] = np.log(table[:, i] / table[:, i].sum(dtype=np.float64))
    return Model(names, table, np.log(alone / alone.sum()))


def likelihoods(model: Model, text: Column, spark) -> Column:
    """A struct of some (the text has a letter), ll (log-likelihoods by language, zero without letters), fits (by language).

    A language fits if the trigrams of letters and spaces are at least as likely
    in it as by chance: as three bytes drawn alone, or as any trigram.  Only the
    text goes through Python, and only these numbers come back.
    """
    shared = spark.sparkContext.broadcast(model)  # GRAMS floats for each language
    letters = np.zeros(256, np.int8)
    letters[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    prose = letters.astype(bool)
    prose[[9, 10, 13, 32]] = True

    def scored(part: pa.RecordBatch) -> pa.Array:
        logp, single = shared.value.logp, shared.value.bytes_logp
        texts = Texts(part["text"])
        grams = _grams(texts)
        n = len(grams)
        seen = np.concatenate([[0], np.cumsum(letters[texts.data], dtype=np.int64)])
        some = seen[texts.end] > seen[texts.start]
        first, last = np.minimum(texts.start, n), np.minimum(np.maximum(texts.start, texts.end - 2), n)
        chance, told = single[_FOLD[texts.data]], prose[texts.data]
        chance = np.maximum(chance[:n] + chance[1 : n + 1] + chance[2 : n + 2], -np.log(GRAMS))
        told = told[:n] & told[1 : n + 1] & told[2 : n + 2]
        ll, fits = np.zeros((len(texts), logp.shape[1])), np.zeros((len(texts), logp.shape[1]), bool)
        sums = np.zeros(n + 1)
        for j in range(logp.shape[1]):
            own = logp[grams, j]
            np.cumsum(own, out=sums[1:], dtype=np.float64)
            ll[:, j] = np.where(some, (sums[last] - sums[first]) / _OVERLAP, 0)
            np.cumsum(np.where(told, own - chance, 0), out=sums[1:])
            fits[:, j] = sums[last] - sums[first] >= -1e-6
        ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * logp.shape[1])
        return pa.StructArray.from_arrays([pa.array(some), pa.ListArray.from_arrays(ends, pa.array(ll.ravel())), pa.ListArray.from_arrays(ends, pa.array(fits.ravel()))], ["some", "ll", "fits"])

    def of_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("some", pa.bool_()), ("ll", pa.list_(pa.float64())), ("fits", pa.list_(pa.bool_()))])
        for batch in batches:
            parts = [scored(x) for x in slices(pa.RecordBatch.from_arrays([batch], ["text"]), "text", _SLICE)]
            yield pa.concat_arrays([x.cast(kind) for x in parts]) if parts else pa.array([], kind)
            trimmed()

    of_batches.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(of_batches, "some boolean, ll array<double>, fits array<boolean>")(text)


def posterior(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def suffix_of(url: Column) -> Column:
    """Last label of the address's host, or null."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*?\.([A-Za-z]+)(?::\d*)?(?:[/?#]|$)", 1)), F.lit(""))


def markup_language(html: Column) -> Column:
    """Primary subtag of the declared language of an HTML document, or null."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)), F.lit(""))


def host_of(url: Column) -> Column:
    """The address's host without port, or null."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def page_text(html: Column) -> Column:
    """What a page shows: without scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")


def _total(shares: Column) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)


def _smoothed(own: Column, parent: Column) -> Column:
    return F.zip_with(own, parent, lambda a, b: (a + STRENGTH * b) / (_total(own) + STRENGTH))


def host_priors(by: DataFrame, world: list[float]) -> DataFrame:
    """_host, _suffix, n (rows), _prior: shares of the host, smoothed towards its suffix's, and those towards the whole table's.

    by: _host, _suffix, n, s0, s1, ... (the sums of the text-only posteriors).
    """
    names = [f"s{i}" for i in range(len(world))]
    sums = [F.sum(c).alias(c) for c in names]
    vector = F.array(*names)
    hosts = by.groupBy("_host", "_suffix").agg(F.sum("n").alias("n"), *sums)
    suffixes = hosts.groupBy(F.col("_suffix").alias("_of")).agg(*sums)
    suffixes = suffixes.select("_of", F.when(F.col("_of").isNull(), F.lit(world).cast("array<double>")).otherwise(_smoothed(vector, F.lit(world).cast("array<double>"))).alias("_parent"))
    both = hosts.join(suffixes, F.col("_suffix").eqNullSafe(F.col("_of")))
    return both.select("_host", "_suffix", "n", F.when(F.col("_host").isNull(), F.col("_parent")).otherwise(_smoothed(vector, F.col("_parent"))).alias("_prior"))


def identify(docs: DataFrame, model: Model, text: str = "text", declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, out: str = "language") -> DataFrame:
    """Adds to docs a struct column `out`: lang, posterior, kept.

    declared, suffix, host: columns of evidence; a null value, or one that no
    language is known by, says nothing.  kept: the text has a letter, the
    best language's posterior is MIN_POSTERIOR at least, and that language fits
    the text better than chance does (see likelihoods()).  Null, empty and
    letterless texts get the language that the other evidence favours, and are
    not kept.  Ties go to the language that is first by name.  Repeated rows
    each count and get the same result.  An empty table gives none.  docs keeps
    its columns and rows, whatever their names; one named `out` is replaced.
    Without languages in the model nothing is kept.

    Texts are scored twice, for the shares and for the result, rather than
    written between.  Hosts of many rows are joined by a broadcast of at most
    4 rows for each shuffle partition, others by a shuffle that Spark may also
    turn into a broadcast.
    """
    docs = docs.drop(out)
    spark = docs.sparkSession
    n = len(model.languages)
    if not n:
        return docs.withColumn(out, F.struct(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("kept")))
    names = docs.columns
    none = F.lit(None).cast("string")
    known = F.lower(declared) if declared is not None else none
    said = F.when(known.isNull(), -1).otherwise(F.coalesce(F.nullif(F.array_position(F.lit(model.languages), known), F.lit(0)), F.lit(n + 1)) - 1).cast("int")
    packed = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    rows = docs.select(packed.alias("_row"), F.col(f"`{text}`").alias("_text"), said.alias("_said"), (suffix if suffix is not None else none).alias("_suffix"), (host if host is not None else none).alias("_host"))
    found = likelihoods(model, F.col("_text"), spark)
    p = posterior(F.col("_f.ll"))
    shares = [F.coalesce(F.sum(F.when(F.col("_f.some"), p[i])), F.lit(0.0)).alias(f"s{i}") for i in range(n)]
    by = rows.select("_said", "_suffix", "_host", found.alias("_f")).groupBy("_said", "_suffix", "_host").agg(F.count("*").alias("n"), *shares)
    by = written(by)  # a row for each host, suffix and declared language
    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    told = {r["_said"]: [r[f"s{i}"] for i in range(n)] for r in by.groupBy("_said").agg(*sums).collect()}  # languages + 2 rows
    total = np.sum(list(told.values()), axis=0) if told else np.zeros(n)
    world = ((total + 1) / (total + 1).sum()).tolist()
    chance = np.array([told.get(d, [0.0] * n) for d in range(n + 1)]) + 0.5
    chance = np.log(chance / chance.sum(0)).tolist()  # declared d, given language
    priors = written(host_priors(by, world).withColumn("_key", F.to_json(F.struct("_host", "_suffix"))))
    p_ = 4 * parallelism(spark)
    size = priors.agg(F.sum("n")).first()[0] or 0
    hot = priors.where(F.col("n") > size / p_).select("_key", F.col("_prior").alias("_hot"))  # fewer than p_ rows
    cold = priors.where(F.col("n") <= size / p_).select("_key", F.col("_prior").alias("_cold"))
    keyed = rows.withColumn("_key", F.to_json(F.struct("_host", "_suffix"))).join(F.broadcast(hot), "_key", "left")
    spread = F.concat(F.lit("-"), F.pmod(F.xxhash64("_text"), F.lit(64 * p_)).cast("string"))
    keyed = keyed.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("_key")).otherwise(spread)).join(cold, "_key", "left")
    fused = keyed.select("_row", "_said", F.coalesce("_hot", "_cold").alias("_prior"), found.alias("_f"))
    evidence = F.when(F.col("_said") < 0, F.lit([0.0] * n).cast("array<double>")).otherwise(F.element_at(F.lit(chance).cast("array<array<double>>"), F.col("_said") + 1))
    logs = F.zip_with(F.zip_with("_f.ll", evidence, lambda a, b: a + b), F.col("_prior"), lambda a, b: a + F.log(b))
    fused = fused.select("_row", "_f", posterior(logs).alias("_p"))
    best = F.array_max("_p")
    at = F.array_position("_p", best).cast("int")
    kept = F.col("_f.some") & (best >= MIN_POSTERIOR) & F.element_at("_f.fits", at)
    result = F.struct(F.element_at(F.lit(model.languages), at).alias("lang"), best.alias("posterior"), kept.alias("kept"))
    return fused.select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)), result.alias(out))
