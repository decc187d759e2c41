import random
import re
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tallyfold.llm import bpe, decontam, fingerprint, langid, linededup, neardup, repeats, secretscan, sharding, substrdedup, suffixdedup

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = "the of and to in is that for was on aß été 日本 näh Zug la que los una mit 12 x9".split()


def texts(seed=3, n=40):
    """Documents with shared passages, near and exact copies, odd spacing, and nothing at all."""
    rng = random.Random(seed)
    word = lambda: rng.choice(WORDS) + rng.choice(["", "", "a", "en", "ion"])
    passage = [word() for _ in range(30)]
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(1, 90))]
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage[rng.randint(0, 5) :]
        if i % 7 == 6:
            w = out[-1][1].split(" ")
        if i % 9 == 8:
            w = list(out[-2][1].split(" "))
            w[len(w) // 2] = "other"
        out.append((i, " ".join(w) if i % 5 else " \t".join(w[:20]) + "\n" + " ".join(w[20:])))
    return [*out, (n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "loop " * 60), (n + 4, "loop " * 60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1.5) for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, chunk string, part double").cache()  # names that operators use inside


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_packed_keys_come_back():
    rng = np.random.default_rng(1)
    for keys in (np.zeros(0, np.int64), np.arange(5), np.unique(rng.integers(0, 1 << 24, 1000)), np.array([0, 65534, 65535, 65536, 200000, (1 << 24) - 1])):
        assert (repeats.unpack(repeats.pack(keys)) == keys).all()


def test_repeated_words(spark, docs, empty):
    want = brute.repeated_words(texts(), 8)
    got = {r.doc_id: (r.n_words, sum(s["to"] - s["from"] for s in r.removed), r.kept) for r in substrdedup.remove_repeats(docs, 8).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 100
    assert substrdedup.remove_repeats(empty, 8).count() == 0
    twice = spark.createDataFrame([(None, "a b c d e f g h i"), (1, "a b c d e f g h i"), (1, "a b c d e f g h i")], "doc_id long, text string")
    assert sorted(((r.doc_id, len(r.removed)) for r in substrdedup.remove_repeats(twice, 8).collect()), key=str) == [(1, 1), (1, 1), (None, 0)]


def test_repeated_bytes(docs, empty):
    want = brute.repeated_bytes(texts(), 50)
    got = {r.doc_id: (r.n_bytes, sum(s["to"] - s["from"] for s in r.removed), bytes(r.kept)) for r in suffixdedup.remove_repeats(docs, 50).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 100
    assert suffixdedup.remove_repeats(empty).count() == 0
    assert {(a - b) % suffixdedup.PERIOD for a in suffixdedup.COVER for b in suffixdedup.COVER} == set(range(suffixdedup.PERIOD))


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_marked_phrases(spark, docs, empty, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    long = texts()[3][1]
    items = [(1, long), (2, "THE of"), (3, None), (4, "..."), (10, " ".join(texts()[9][1].split()[:8])), (2, "the of"), (None, long)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    windows = brute.phrases([x for x in items if x[0] is not None], 4)
    got = {r.doc_id: r.hit for r in decontam.mark(docs.withColumn("hit", F.lit(1)), frame, 4).collect()}
    for i, t in texts():
        n, hit, found = brute.marked(t, windows)
        assert (got[i].n_words, sum(s["to"] - s["from"] for s in got[i].spans), got[i]["items"]) == (n, hit, found)
        if not hit:
            assert got[i].clean == t
        else:
            spans = [(s["from"], s["to"]) for s in got[i].spans]
            words = brute.alnum_words(t)
            assert brute.alnum_words(got[i].clean.replace("\n", " ")) != words and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert decontam.mark(empty, frame).count() == 0 and decontam.mark(docs, frame.where("false")).where("size(hit.spans) > 0").count() == 0


def test_index_of_repetitive_text():
    rng = np.random.default_rng(5)
    for t in (np.ones(300, np.int64), np.tile([2, 3], 100), rng.integers(1, 4, 500), np.array([1])):
        index = decontam.FMIndex(t, 5)
        full = np.append(t, 0)
        assert [tuple(full[i:]) for i in decontam.suffix_array(full)] == sorted(tuple(full[i:]) for i in range(len(full)))
        for m in (m for m in (1, 2, 5) if m <= len(t)):
            p = np.array([t[:m], np.full(m, 3)])
            lo, hi = index.search(p)
            for row, a, b in zip(p, lo, hi, strict=True):
                want = [i for i in range(len(t) - m + 1) if len(row) == m and (t[i : i + m] == row).all()]
                assert sorted(index.locate(np.arange(a, b))) == want


def test_tokens(spark, docs, empty):
    rows = [*texts(), (100, "x" * 3000), (101, " \n\t'll 's don't" * 200), (102, "été 12 日本 🎉 " * 200), (102, "été 12 日本 🎉 " * 200), (103, " " * 1500 + "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    enc = bpe.encoding(PATH, PATTERN)
    got = bpe.decode(bpe.encode(frame, PATH, PATTERN, chunk=200, overlap=40), PATH, PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.text or "") and bytes(r.bytes).decode() == (r.text or "")
    assert bpe.encode(empty, PATH, PATTERN).count() == 0
    both = bpe.encode(frame.withColumn("_piece", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("bytes", F.lit(3)).withColumn("_ids", F.lit(4)), PATH, PATTERN, chunk=200, overlap=40, decoded="bytes").collect()
    assert {(r.doc_id, bytes(r.ids)) for r in both} == {(r.doc_id, bytes(r.ids)) for r in got} and all(bytes(r.bytes).decode() == (r.text or "") and (r._piece, r._key, r._ids) == (1, 2, 4) for r in both)


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (2, 60)])
def test_near_duplicates(spark, docs, empty, words, percent):
    want = brute.near_components(texts(), words, percent)
    rows = neardup.link(docs, words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert len({c for _, c in want.values()}) < len(want)
    odd = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "A B C D E F")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in neardup.link(odd, 3, 85).collect()) == [("5", 5, True), ("5", 5, True), ("7", 5, False), ("None", None, True)]
    assert neardup.link(empty).count() == 0


def test_a_family_of_many_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "PURE", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(999)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.link(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute.near_components(rows, 3, 85)


def test_lines(spark, empty):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(60)).strip(" ") for _ in range(6)]
    rows = []
    for i in range(40):
        line = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(line))
            what = rng.choice("ids")
            if what == "i":
                line.insert(at, rng.choice("xyß"))
            elif what == "d":
                del line[at]
            else:
                line[at] = rng.choice("xyß")
        rows.append((i, "".join(line) + "\n short\n" + "a line that is the same\n" * (i % 3)))
    rows += [(100, None), (101, ""), (102, "\n\n")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lines string")
    want = brute.deduped_lines(rows, 2, linededup.MIN_CHARS, linededup.FUZZY_CHARS)
    got = {r.doc_id: r.lines for r in linededup.remove_lines(frame).collect()}
    assert {i: x.kept for i, x in got.items()} == want
    assert linededup.remove_lines(empty).count() == 0
    alone = spark.createDataFrame([(None, "a line of null id here"), (None, "a line of null id here"), (3, "a line of null id here")], "doc_id long, text string")
    assert all(r.lines.n_removed == 0 for r in linededup.remove_lines(alone).collect())


@pytest.mark.parametrize("edits", [1, 2])
def test_short_lines(spark, edits):
    rng = random.Random(12)
    line = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 39])))
    menu = ["Read more", "Read more »", "Home | About", "Home | About us", "12 May 2024", "13 May 2024", "Share", "", " ", "ok"]
    rows = [(i, "\n".join([line() for _ in range(3)] + rng.sample(menu, 3))) for i in range(40)]
    got = {r.doc_id: r.lines.kept for r in linededup.remove_lines(spark.createDataFrame(rows, "doc_id long, text string"), edits).collect()}
    assert got == brute.deduped_lines(rows, edits, 1, edits + 1)


def test_edit_distance_in_bits(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(200):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))
        rows.append((a, b))
    frame = spark.createDataFrame(rows, "a string, b string")
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    for k in (0, 1, 2, 3):
        for r in frame.select("a", "b", linededup.within_edits(chars("a"), chars("b"), k).alias("ok")).collect():
            assert r.ok == brute.edits_within(r.a, r.b, k), (r, k)


@pytest.mark.parametrize("shards", [1, 7, 40, 100])
def test_shards(spark, docs, empty, shards):
    rows = dict(texts())
    got = sharding.assign(docs, shards).collect()
    groups, load, slots, where = defaultdict(int), Counter(), defaultdict(list), defaultdict(set)
    for i, t in rows.items():
        groups[brute.sha(t or "")[:32]] += len((t or "").encode()) + 16
    for r in got:
        t = rows[r.doc_id] or ""
        assert r["size"] == len(t.encode()) + 16 and r.text_crc32 == zlib.crc32(t.encode()) and 0 <= r.shard < shards
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[t].add(r.shard)
    assert max(load.values()) == brute.smallest_capacity([groups[k] for k in sorted(groups)], shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    assert sharding.assign(empty, shards).count() == 0


@pytest.mark.parametrize(("copies", "alike"), [((900,), 0), ((300, 120), 0), ((), 60)])
def test_shards_beside_large_groups_are_near_equal(spark, copies, alike):
    rows = [f"text {i}" for i in range(alike)] if alike else [f"{i:04d}" for i in range(1800)] + [f"hot{k}" for k, n in enumerate(copies) for _ in range(n)]
    load, where = Counter(), {}
    for r in sharding.assign(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), 40).collect():
        load[r.shard] += r["size"]
        where[rows[r.doc_id]] = r.shard
    groups = Counter()
    for t in rows:
        groups[brute.sha(t)[:32]] += len(t) + 16
    assert len(load) == 40 and max(load.values()) == brute.smallest_capacity([groups[k] for k in sorted(groups)], 40)
    hot = {where[f"hot{k}"] for k in range(len(copies))}
    others = [n for k, n in load.items() if k not in hot]
    assert max(others) <= 2.1 * min(others) and max(others) <= (2.1 if alike else 1.1) * sum(others) / len(others)


def canonical(t):
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", nfkc(nfkc(t).casefold())).strip()


def test_fingerprints(spark, docs, empty):
    rows = [*texts(), (200, "Ｆｕｌｌ  ＷＩＤＴＨ é"), (201, "full width é\n"), (202, "Straße"), (203, "STRASSE")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.with_edits(frame).collect()}
    ids, texts_ = sorted(dict(rows), reverse=True), dict(rows)
    by = defaultdict(set)
    for k, i in enumerate(ids):
        t, nxt = texts_[i] or "", texts_[ids[(k + 1) % len(ids)]] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(edited))
        assert (r.near_edited, r.near_next) == (float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(nxt)))
        by[canonical(t)].add(r.fingerprint)
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)
    assert {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(frame).collect()} == {i: r.fingerprint for i, r in got.items()}
    assert fingerprint.with_edits(empty).count() == 0 and fingerprint.fingerprints(empty).count() == 0
    pairs = spark.createDataFrame([("h", "x"), ("h", "y"), ("g", "z"), ("g", "z")], "fp string, canon string")
    assert [r.fp for r in fingerprint.collisions(pairs).collect()] == ["h"]


def test_language_of_held_out_texts(spark):
    rng = random.Random(6)
    vocabulary = {"en": "the of and that with which was for from this have".split(), "de": "der die und nicht mit sich auch für über dass".split(), "fr": "le les des que pour dans est une avec être".split()}
    say = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, say(lang, 60), lang, f"http://{lang if i % 4 else 'en'}.example.{'org' if i % 2 else lang}/", f"host{lang}") for i, lang in enumerate(list(vocabulary) * 30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string, _text string")
    model = langid.train(frame.where("doc_id < 60"))
    held = frame.where("doc_id >= 60").withColumn("text", F.substring("text", 1, 40))
    got = langid.identify(held, model, declared=F.lit(None).cast("string"), suffix=langid.suffix_of(F.col("url")), host=F.col("_text")).collect()
    assert sum(r.language.lang == r.lang for r in got) / len(got) >= 0.95 and all(r.language.kept for r in got)
    # a letterless text follows the other evidence, but isn't kept
    odd = spark.createDataFrame([(1, "12 34", "de", "hostde"), (2, None, None, None), (3, "", "xx", "hostfr"), (4, say("fr", 40), "fr", "hostfr"), (5, say("de", 40), "de", "hostde")], "doc_id long, text string, lang string, h string")
    got = {r.doc_id: r.language for r in langid.identify(odd, model, declared=F.col("lang"), host=F.col("h")).collect()}
    assert got[1].lang == "de" and not got[1].kept and not got[2].kept and not got[3].kept and got[4].lang == "fr" and got[4].kept
    assert langid.identify(frame.where("false"), model).count() == 0
    assert not langid.identify(odd, langid.train(odd.where("false")), declared=F.col("lang")).where("language.kept").count()


def test_texts_of_no_known_language(spark):
    rng = random.Random(7)
    syllables = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(12)] for k in range(70)}
    say = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    lacks = "l69"
    rows = [(f"{lang} {i}", say(lang, 60), lang) for lang in syllables for i in range(4) if lang != lacks]
    model = langid.train(spark.createDataFrame(rows, "doc_id string, text string, lang string"))
    assert model.languages == sorted(set(syllables) - {lacks})
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n))
    held = [(lang, say(lang, 60), None) for lang in syllables] + [("noise", noise(n), None) for n in (60, 400, 3000)]
    got = langid.identify(spark.createDataFrame(held, "doc_id string, text string, lang string"), model).collect()
    assert {r.doc_id for r in got if not r.language.kept} == {lacks, "noise"}
    assert all(r.language.lang == r.doc_id and r.language.kept for r in got if r.doc_id not in (lacks, "noise")) and not any(r.language.kept for r in got if r.doc_id == "noise")


def test_evidence_columns(spark):
    rows = spark.createDataFrame([('<!DOCTYPE html><html lang="fr-CA"><p>', "https://a.b.de:80/x"), ("<p>", "nothing")], "html string, url string")
    got = rows.select(langid.markup_language(F.col("html")).alias("l"), langid.suffix_of(F.col("url")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("fr", "de"), (None, None)]


def corpus(n=600, seed=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["tion", "the", "ing", "er", "an", "ou", "st"]) for _ in range(rng.randint(1, 4)))
    vocabulary = [word() for _ in range(300)]
    return [(i, " ".join(rng.choice(vocabulary) for _ in range(40)), "src/app") for i in range(n)]


def test_secrets_of_held_out_findings(spark):
    docs = spark.createDataFrame(corpus(1200), "doc_id long, text string, source string")
    known = secretscan.planted(docs).cache()
    held, fit = known.where("doc_id % 3 = 0"), known.where("doc_id % 3 <> 0")
    found = secretscan.scan(held.drop("secret"), F.col("path"), fit).collect()
    told = {r.doc_id: r.secret for r in held.collect()}
    caught = {(r.doc_id, r.candidate) for r in found if r.secret}
    real = {(i, s) for i, s in told.items() if s}
    recall, precision = len(caught & real) / len(real), len(caught & real) / len(caught)
    assert len(real) > 100 and len(told) - len(real) > 100 and recall >= 0.95 and precision >= 0.95, (precision, recall)
    assert {(r.doc_id, r.candidate) for r in found} >= real  # every planted secret is a candidate


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="the given tables aren't here")
def test_secrets_of_the_documents(spark):
    """Tokens that the given documents hold, found by a pattern of their own: all are told, and hardly anything else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    real = {(r.doc_id, t) for r in docs.where("text is not null").collect() for t in re.findall(r'(?:token|secret|password) = "([^"\s]{8,})"', r.text)}
    caught = {(r.doc_id, r.candidate) for r in secretscan.scan(docs, F.col("source")).where("secret").collect()}
    assert len(real) > 5 and real <= caught and len(caught - real) <= 0.1 * len(caught)


def test_secrets_edge_cases(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(i, t, s) for i, t, s in corpus()]
    rows += [(900, None, "x"), (901, "", None), (902, f'say token = "{key}" now', None), (902, f'say token = "{key}" now', None), (903, f"see commit {key} for that", "src"), (904, "the password: hunter2!x9 is old", "src"), (905, "a password and a token, no value", "src"), (906, f"{'x' * 300_000} token = \"{key}\"", "src")]
    rows += [(907, "token" * 60_000, "src"), (908, f"token='{';' * 200_000}x{'=' * 200_000}", "src")]  # a name again and again, a long tail: one pass each
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, path int, secret int, candidate int")
    got = secretscan.scan(frame, F.col("source")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [r.candidate for r in by[902]] == [key] * 2 and all(r.secret for r in by[902]) and len({r.probability for r in by[902]}) == 1
    assert [(r.candidate, r.secret) for r in by[903]] == [(key, False)] and [r.candidate for r in by[904]] == ["hunter2!x9"] and 905 not in by
    assert [len(r.candidate) for r in sorted(by[906], key=lambda r: r.nth)] == [300_000, 40] and not {900, 901} & set(by)
    assert [len(r.candidate) for r in by[907]] == [300_000] and {len(r.candidate) for r in by[908]} == {200_001, 400_001}
    assert secretscan.scan(frame.where("false"), F.col("source")).count() == 0
    one = secretscan.scan(spark.createDataFrame([(1, 'password="Abc123Abc123Abc123Abc1"', "")], "doc_id long, text string, source string"), F.col("source")).collect()
    assert [(r.candidate, r.probability, r.secret) for r in one] == [("Abc123Abc123Abc123Abc1", 1.0, True)]  # nothing to learn from: the rule decides
