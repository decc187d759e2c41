import random
import tracemalloc

import corpus_pipeline
import pyarrow as pa

from tallyfold.llm import decontam, queries
from tallyfold.llm.text import slices


def test_stages_keep_clean_documents(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = {"en": "the of and that with which was for from this have".split(), "de": "der die und nicht mit sich auch für über dass".split()}
    say = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) + str(rng.randrange(400)) for _ in range(n))
    rows = [(i, say(lang, 40) + "\n" + say(lang, 30), lang, "src", 0) for i, lang in enumerate(["en", "de"] * 15)]
    phrase = say("en", 14)
    rows.append((100, f"{say('en', 30)} {phrase} {say('en', 5)}", "en", "src", 0))
    rows.append((101, rows[0][1].replace("\n", " "), "en", "src", 0))  # a copy without its line ends
    rows.append((102, "12345 678", "en", "src", 0))
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, phrase)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(seen["language"]) == {*range(30), 100, 101}
    assert set(seen["near_duplicates"]) == {*range(30), 100}
    assert phrase not in seen["benchmark"][100].text and all(seen["benchmark"][i].text == rows[i][1] for i in range(30))
    assert all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in seen["tokens"].values())
    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == seen["tokens"]


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]


def test_rows_go_to_python_workers_by_bytes(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{i} the of and " * 100_000, "en", "src", 0) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    spark.createDataFrame([("a", "some words")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    corpus_pipeline.benchmark(spark, docs, str(tmp_path))
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) > 2 * corpus_pipeline.BATCH_BYTES and max(r.n for r in sizes) < 2 * corpus_pipeline.BATCH_BYTES


def test_an_index_takes_bounded_memory():
    texts = [f"{i} the of and with that which was for from this have " * 1_000 for i in range(120)]
    phrases = decontam.Phrases(["a"], ["the of and with that which was for from this have"], 10)
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("items", pa.list_(pa.string())), ("clean", pa.string())])
    batch = pa.RecordBatch.from_pydict({"text": texts})
    found = []
    tracemalloc.start()
    for part in slices(batch, "text", decontam.SHARD_BYTES):
        found += decontam._mark(part, "text", "hit", phrases, kind).field("items").to_pylist()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [["a"]] * 120
    assert most < 160 << 20
