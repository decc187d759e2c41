"""Edge cases of the operators and the pipeline, and op7 against a plain version."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline
from tallyfold.llm import bpe, decontam, fingerprint, langid, linededup, queries, sharding, substrdedup, suffixdedup
from tallyfold.llm.text import unused

WORDS = ["the", "of", "and", "été", "mañana", "größe", "x1", "to", "in", "a"]


def fused(rows, model, strength, least):
    """Language ID in plain Python: rows are (text, declared, suffix, host)."""
    n = len(model.languages)
    lls, some, fits = [], [], []
    for text, *_ in rows:
        b = (text or "").encode()
        b = bytes(x + 32 if 65 <= x <= 90 else x for x in b)
        gram = [((b[i] * 0x9E37 + b[i + 1] * 0x85EB * 3 + b[i + 2] * 0xC2B3) % 2**32) & (langid.GRAMS - 1) for i in range(len(b) - 2)]
        prose = [97 <= x <= 122 or x >= 128 or x in (9, 10, 13, 32) for x in b]
        some.append(any(97 <= x <= 122 or x >= 128 for x in b))
        lls.append([sum(float(model.logp[g, j]) for g in gram) / 3 if some[-1] else 0.0 for j in range(n)])
        chance = [max(sum(model.bytes_logp[x] for x in b[i : i + 3]), -np.log(langid.GRAMS)) for i in range(len(gram))]
        fits.append([sum(float(model.logp[g, j]) - chance[i] for i, g in enumerate(gram) if all(prose[i : i + 3])) >= -1e-6 for j in range(n)])
    soft = lambda x: np.exp(np.array(x) - max(x)) / np.exp(np.array(x) - max(x)).sum()
    share = [soft(x) if s else np.zeros(n) for x, s in zip(lls, some)]
    total = np.sum(share, axis=0)
    world = (total + 1) / (total + 1).sum()
    said = [-1 if d is None else (model.languages.index(d.lower()) if d.lower() in model.languages else n) for _, d, _, _ in rows]
    declared = np.array([np.sum([s for s, x in zip(share, said) if x == d] or [np.zeros(n)], axis=0) for d in range(n + 1)]) + 0.5
    declared = np.log(declared / declared.sum(0))
    smooth = lambda own, parent: (own + strength * parent) / (own.sum() + strength)
    of = lambda keep: np.sum([s for s, r in zip(share, rows) if keep(r)] or [np.zeros(n)], axis=0)
    out = []
    for ll, s, f, d, (_, _, suffix, host) in zip(lls, some, fits, said, rows):
        parent = world if suffix is None else smooth(of(lambda r: r[2] == suffix), world)
        prior = parent if host is None else smooth(of(lambda r: r[3] == host and r[2] == suffix), parent)
        p = soft(np.array(ll) + (declared[d] if d >= 0 else 0) + np.log(prior))
        best = int(np.argmax(p))
        out.append((model.languages[best], float(p[best]), bool(s and p[best] >= least and f[best])))
    return out


def test_language_id_is_that_of_a_plain_version(spark):
    rng = random.Random(3)
    vocabulary = {"en": "the of and that with which was".split(), "de": "der die und nicht mit sich auch".split(), "fr": "le les des que pour dans est".split()}
    say = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    known = spark.createDataFrame([(say(x, 30), x) for x in list(vocabulary) * 8], "text string, lang string")
    model = langid.train(known)
    rows = [(say(x, rng.randint(1, 12)), rng.choice([x, None, "en", "xx"]), rng.choice([x, None, "org"]), rng.choice(["h1", "h2", None, "\u0002", f"h{x}"])) for x in list(vocabulary) * 12]
    rows += [(None, "de", "de", "h1"), ("", None, None, None), ("12 34", None, None, "hde"), rows[0], rows[0]]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, declared string, suffix string, host string").withColumn("_row", F.lit(1)).withColumn("_f", F.lit(2)).withColumn("c0", F.lit(3))
    got = {r.i: r for r in langid.identify(frame.repartition(3), model, declared=F.col("declared"), suffix=F.col("suffix"), host=F.col("host")).collect()}
    for i, (lang, posterior, kept) in enumerate(fused(rows, model, langid.STRENGTH, langid.MIN_POSTERIOR)):
        x = got[i].language
        assert (x.lang, x.kept) == (lang, kept) and abs(x.posterior - posterior) < 1e-6, (i, rows[i], x, lang, posterior)
        assert (got[i]["_row"], got[i]["_f"], got[i]["c0"]) == (1, 2, 3)
    # ties go to the first by name: nothing speaks for any
    even = langid.Model(["b", "c"], np.zeros((langid.GRAMS, 2), np.float32), np.zeros(256))
    assert langid.identify(spark.createDataFrame([("ab",)], "text string"), even).first().language.lang == "b"


def test_pages_and_documents_in_one_query(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = {"en": "the of and that with which was".split(), "de": "der die und nicht mit sich auch".split()}
    say = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    docs = [(i, say(lang, 40), lang, f"src{i % 3}", 0) for i, lang in enumerate(["en", "de"] * 20)] + [(99, None, None, None, None)]
    pages = [(i, f"https://www.site{i % 4}.{'de' if i % 2 else 'com'}/x", f'<html lang="{"de" if i % 2 else "en"}"><script>the of and</script><p>{say("de" if i % 2 else "en", 6)}</p></html>') for i in range(20)] + [(50, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op7_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) + len(pages)
    assert all(r.kept and r.lang == ["en", "de"][r.doc_id % 2] for r in got if r.doc_id is not None and r.doc_id != 99)
    assert all(r.kept and r.lang == ["en", "de"][r.page_id % 2] for r in got if r.page_id is not None and r.page_id != 50)
    assert not any(r.kept for r in got if 99 == r.doc_id or 50 == r.page_id)


def test_lines_beside_clashing_names(spark):
    rows = [(1, "a line that is the same\nother"), (2, "a line that is the same\nmore"), (2, "a line that is the same\nmore"), (3, None), (None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(i).alias(n) for i, n in enumerate(("_line_doc", "_line_keep", "_LINE_KEPT", "h1", "no"))))
    got = linededup.remove_lines(frame).collect()
    assert sorted((str(r.doc_id), str(r.lines.kept), r["_line_doc"], r["_line_keep"], r["_LINE_KEPT"], r["h1"], r["no"]) for r in got) == [("1", "a line that is the same\nother", 0, 1, 2, 3, 4), ("2", "more", 0, 1, 2, 3, 4), ("2", "more", 0, 1, 2, 3, 4), ("3", "None", 0, 1, 2, 3, 4), ("None", "x", 0, 1, 2, 3, 4)]
    assert unused(["A", "a_"], "a", "b") == ["a__", "b"]


def test_a_hot_passage_and_a_very_long_text(spark):
    rng = random.Random(5)
    passage = " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(30))
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(120_000))
    rows = [(i, f"{rng.random()} {passage} {rng.random()}") for i in range(60)] + [(100, long), (101, long[200_000:400_000] + " end"), (102, f"{passage}\n{passage}"), (103, None), (104, ""), (None, passage), (7, passage)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("part"), F.lit(2).alias("real_id"), F.lit(3).alias("bucket"))
    ids = [(-1 if i is None else i, t) for i, t in rows]
    want = {}
    first = {}
    for i, t in sorted(ids, key=lambda r: r[0]):
        b = (t or "").encode()
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    for i, t in ids:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        want.setdefault(i, []).append(bytes(x for x, g in zip(b, gone) if not g))
    got = {}
    for r in suffixdedup.remove_repeats(frame, 50).collect():
        got.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(bytes(r.kept))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    seen = {}
    for i, t in ids:
        w = brute.plain_words(t)
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            seen[k] = min(seen.get(k, (i, j)), (i, j))
    want = {}
    for i, t in ids:
        w = brute.plain_words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            if seen[tuple(w[j : j + 20])] < (i, j):
                gone[j : j + 20] = [True] * 20
        want.setdefault(i, []).append(" ".join(x for x, g in zip(w, gone) if not g))
    got = {}
    for r in substrdedup.remove_repeats(frame, 20).collect():
        got.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(r.kept)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_fingerprints_and_shards_of_odd_rows(spark):
    long = "Ａ b\t" * 50_000
    rows = [(1, long), (1, "A b " * 50_000), (2, None), (2, ""), (None, "x"), (3, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(9).alias(c) for c in ("fp", "canon", "cell", "at", "next", "group", "run", "size", "shard")))
    one = fingerprint.with_edits(frame).collect()
    assert len(one) == len(rows) and len({r.fingerprint for r in one if r.doc_id == 1}) == 1 and len({r.fingerprint for r in one if r.doc_id == 2}) == 1
    assert {r.fingerprint for r in one if r.doc_id is None} == {r.fingerprint for r in one if r.doc_id == 3}
    got = sharding.assign(frame, 4).collect()
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 16 for _, t in rows) and all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(4))


def test_one_text_of_many_chunks(spark):
    text = "étude 12 日本 it's  \n\n" * 12_000
    frame = spark.createDataFrame([(1, text), (2, "x" * 100_000)], "doc_id long, text string")
    enc = bpe.encoding(corpus_pipeline.VOCABULARY, queries.public_tokenizers.PATTERN)
    for r in bpe.encode(frame, corpus_pipeline.VOCABULARY, queries.public_tokenizers.PATTERN, decoded="bytes").collect():
        t = text if r.doc_id == 1 else "x" * 100_000
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(t) and bytes(r.bytes).decode() == t


def test_marks_beside_odd_columns(spark):
    frame = spark.createDataFrame([(1, "one two three", 5), (1, "one two three", 5), (2, None, None)], "doc_id long, text string, spans int")
    got = decontam.mark(frame, spark.createDataFrame([(1, "two three"), (None, "one"), (3, None)], "item_id long, text string"), 2).collect()
    assert sorted((r.doc_id, r.spans, str(r.hit.clean)) for r in got if r.text) == [(1, 5, "one ")] * 2 and next(r.hit.n_words for r in got if not r.text) == 0


@pytest.mark.parametrize("odd", [False, True])
def test_pipeline_of_odd_tables(spark, tmp_path, odd):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    text = "the one and the other of which that was for this " * 4
    rows = [(1, text, "en", "s", 0), (1, text, "en", "s", 0), (2, text, "en", None, None), (3, None, None, None, None), (4, "", "en", "s", 0), (None, text + " more", "en", "s", 0), (5, "der die das und nicht mit auch für sich ein " * 5, "de", "s", 0)] if odd else []
    docs = spark.createDataFrame(rows, columns).withColumn("lines", F.lit(1)).withColumn("hit", F.lit(2)).withColumn("language", F.lit(3))
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "tokens":
            assert after.columns == docs.columns
        docs = after
    got = sorted(str(r.doc_id) for r in docs.collect())
    assert got == (["1", "1", "2", "5", "None"] if odd else []) and all(r.round_trip for r in docs.collect())
