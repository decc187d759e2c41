"""Secret scans: a random forest over candidate strings takes out false alarms; DataFrame functions only.

Features: length, character transitions, how much of the candidate words of the
corpus cover, what kind of path it is in, and the words beside it.  The forest
is trained from labelled findings: documents with the secret that is in each.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.text import written

#: A run of these characters is a candidate wherever it stands; a shorter value is one behind a secret's name and an assignment.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_VALUE = 8
#: Labelled documents that the forest is trained on: those of least hash.
TRAIN_DOCUMENTS = 4_000
#: Documents that must have a word for it to count as one.
KNOWN_IN = 3
FEATURES = ("length", "digits", "uppers", "symbols", "letter_digit", "case_change", "vowel_pairs", "distinct", "hex_only", "coverage", "example_path", "assigned", "quoted", "named", "linked", "before_known", "next_known")
_NAMES = "(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)"
_EXAMPLE = "(?i)(test|example|sample|fixture|doc|mock)"
_VALUE = rf"""([^"'\s]{{{LEAST_VALUE},}})"""
# A run of name characters is read once, from its start: the first name in it, then the rest of the run.
_INLINE = rf"""(?<![\w.-])(?>[\w.-]*?{_NAMES})[\w.-]*+["']?[=:]+["']?{_VALUE}"""
_AFTER = rf"""^["']?{_VALUE}"""


def candidates(docs: DataFrame) -> DataFrame:
    """Rows of docs (text, path, ...) for each candidate: nth (place of its word), part, candidate, word, the two words before it and the one behind."""
    words = F.split("text", r"\s+")
    rows = docs.where(F.col("text").rlike(f"{CANDIDATE}|{_NAMES}")).withColumn("w", words)
    w = lambda i: F.coalesce(F.get("w", i), F.lit(""))

    def parts(x: Column, i: Column) -> Column:
        behind_name = w(i - 1).rlike("[=:]$") & (w(i - 1).rlike(_NAMES) | w(i - 2).rlike(_NAMES)) | w(i - 2).rlike(_NAMES) & w(i - 2).rlike("[=:]$")
        value = F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(x, _INLINE, 1), F.lit("")), F.when(behind_name, F.regexp_extract(x, _AFTER, 1)), F.lit("")), r"(?<![;,.)\]}])[;,.)\]}]+$", "")
        return F.array_distinct(F.concat(F.regexp_extract_all(x, F.lit(CANDIDATE), F.lit(0)), F.when(F.length(value) >= LEAST_VALUE, F.array(value)).otherwise(F.array().cast("array<string>"))))

    found = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("x"), parts(x, i).alias("p"))), lambda s: F.size(s["p"]) > 0)
    rows = rows.select(*docs.columns, "w", F.explode(found).alias("s"))
    rows = rows.select(*(c for c in docs.columns if c != "text"), F.col("s.i").alias("nth"), F.col("s.x").alias("word"), w(F.col("s.i") - 1).alias("before"), w(F.col("s.i") - 2).alias("before2"), w(F.col("s.i") + 1).alias("behind"), F.posexplode("s.p").alias("part", "candidate"))
    return rows.withColumn("path", F.coalesce("path", F.lit("")))


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}]", "")


def _runs(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda r: F.char_length(r) >= 3)


def known_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of the wanted words (a column `known`) that KNOWN_IN documents of the whole corpus or more have; only they are counted."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("known"))
    return words.join(wanted, "known").groupBy("known").count().where(F.col("count") >= KNOWN_IN).select("known")


def _count(pattern: str) -> Column:
    return F.size(F.regexp_extract_all("candidate", F.lit(pattern), F.lit(0))).cast("double")


def features(found: DataFrame, docs: DataFrame) -> DataFrame:
    """found (see candidates()) with FEATURES; docs: the corpus whose words are the dictionary."""
    beside = F.array(_letters(F.col("before")), _letters(F.col("behind")))
    wanted = found.select(F.explode(F.concat(_runs(F.col("candidate")), F.filter(beside, lambda x: F.char_length(x) >= 3))).alias("known")).distinct()
    known = written(known_words(docs, wanted))
    strings = found.select("candidate").distinct()
    covered = strings.select("candidate", F.explode(_runs(F.col("candidate"))).alias("known")).join(known, "known").groupBy("candidate").agg(F.sum(F.char_length("known")).alias("covered"))
    rows = found.join(covered, "candidate", "left")
    for side in ("before", "behind"):
        rows = rows.withColumn("_word", _letters(F.col(side))).join(known.select(F.col("known").alias("_word"), F.lit(1.0).alias(f"{side}_is")), "_word", "left").drop("_word")
    n = F.char_length("candidate").cast("double")
    value = {
        "length": n,
        "digits": _count("[0-9]") / n,
        "uppers": _count("[A-Z]") / n,
        "symbols": _count("[^A-Za-z0-9]") / n,
        "letter_digit": _count("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]") / n,
        "case_change": _count("(?<=[a-z])[A-Z]") / n,
        "vowel_pairs": _count("(?i)(?<=[aeiou])[bcdfghjklmnpqrstvwxyz]|(?<=[bcdfghjklmnpqrstvwxyz])[aeiou]") / n,
        "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / n,
        "hex_only": F.col("candidate").rlike("^[0-9a-fA-F]+$").cast("double"),
        "coverage": F.coalesce("covered", F.lit(0)) / n,
        "example_path": F.col("path").rlike(_EXAMPLE).cast("double"),
        "assigned": (F.col("before").rlike("[=:]$") | F.col("word").rlike("[:=][\"']?[^\"']")).cast("double"),
        "quoted": F.col("word").rlike("[\"']").cast("double"),
        "named": (F.col("before").rlike(_NAMES) | F.col("before2").rlike(_NAMES) | F.col("word").rlike(_NAMES)).cast("double"),
        "linked": F.col("word").rlike("(?i)[a-z]://|sha[0-9]*[:-]|^www[.]").cast("double"),
        "before_known": F.col("before_is"),
        "next_known": F.col("behind_is"),
    }
    return rows.select(*found.columns, *(F.coalesce(value[c], F.lit(0.0)).alias(c) for c in FEATURES))


def planted(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """doc_id, text, path, secret (null: none): findings whose labels are known because they are put there.

    Into 30 words of each of at most `documents` documents of the corpus, those
    of least hash, goes one string: a random key, token or password in some
    form of assignment; or a commit, identifier, checksum, address, placeholder
    or long name made of the document's words; or a password in an example's
    path.  No feature takes part in the choice.
    """
    h = F.xxhash64("doc_id", "text")
    rows = docs.where("text is not null").select("doc_id", "text", h.alias("h"))
    least = rows.select("h").orderBy("h").limit(documents).distinct()  # hashes alone meet in one task
    some = rows.join(F.broadcast(least), "h").dropDuplicates(["h"])
    plain = F.filter(F.split("text", r"\s+"), lambda x: (F.length(x) > 0) & ~x.rlike(f"{CANDIDATE}|{_NAMES}"))
    rows = some.select("doc_id", "h", F.slice(plain, 1, 30).alias("w"), F.sha2(F.concat_ws("/", F.col("h").cast("string"), F.lit("planted")), 256).alias("hex"))
    rows = rows.where("size(w) > 5").withColumn("b", F.base64(F.unhex("hex"))).withColumn("kind", F.pmod("h", F.lit(14)).cast("int"))
    part = lambda c, a, n: F.substring(F.col(c), a, n)
    names = F.transform(F.slice("w", 1, 4), lambda x: F.regexp_replace(x, r"[^\p{L}]", ""))
    camel = F.array_join(F.transform(names, F.initcap), "")
    uuid = F.concat_ws("-", *(part("hex", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    short = F.concat(part("b", 1, 10), F.lit("!7"))
    secret = [part("hex", 1, 40), F.regexp_replace(part("b", 1, 32), "[+/]", "x"), short, F.upper(F.regexp_replace(part("b", 1, 24), "[+/]", "7")), F.regexp_replace(part("b", 1, 40), "[+/=]", "_"), part("hex", 1, 32)]
    forms = [
        ('token = "', '"'), ("api_key: ", ""), ('password="', '"'), ("export SECRET_KEY=", ""), ("Authorization: Bearer ", ""), ("private_key = '", "';"),
    ]
    harmless = [
        F.concat(F.lit("commit "), part("hex", 1, 40)), F.concat(F.lit("id "), uuid), F.concat(F.lit("https://example.org/"), F.lower(F.concat_ws("-", names)), F.lit("/index")), F.concat(F.lit('token = "YOUR_'), F.upper(F.concat_ws("_", names)), F.lit('"')),
        F.concat(F.lit("sha256:"), F.col("hex")), camel, F.array_join(names, ""), F.concat(F.lit('password = "'), short, F.lit('"')),
    ]
    text, told = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (value, (a, b)) in enumerate(zip(secret, forms, strict=True)):
        text, told = F.when(F.col("kind") == i, F.concat(F.lit(a), value, F.lit(b))).otherwise(text), F.when(F.col("kind") == i, value).otherwise(told)
    for i, value in enumerate(harmless):
        text = F.when(F.col("kind") == i + len(forms), value).otherwise(text)
    path = F.when(F.col("kind") == 13, "tests/fixtures/sample.json").otherwise(F.get(F.array(*(F.lit(x) for x in ("src/app.py", "deploy/config.yaml", "notes.md"))), F.pmod(F.floor(F.col("h") / 14), F.lit(3)).cast("int")))
    return rows.select("doc_id", F.concat_ws(" ", F.slice("w", 1, 5), text, F.expr("slice(w, 6, 30)")).alias("text"), path.alias("path"), told.alias("secret"))


def train(labelled: DataFrame) -> PipelineModel | None:
    """Forest from findings with FEATURES and label; None if they don't have both labels."""
    if labelled.select("label").distinct().limit(2).count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=40, maxDepth=8, seed=5, probabilityCol="chances")
    return PipelineModel([vectors, forest.fit(vectors.transform(labelled).select("vector", "label"))])


def scan(docs: DataFrame, path: Column, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, nth, part, candidate, probability, secret: a row for each candidate of the whole texts.

    docs: doc_id, text and what `path` needs; other columns are not looked at.
    A candidate is a run of 20 or more letters, digits and + / _ = -, or a value
    of LEAST_VALUE characters or more behind a secret's name and an assignment;
    nth is the place of its word, part its place among the word's candidates.
    labelled: doc_id, text, path, secret (null: none) of documents whose
    findings are known; a candidate of theirs is a secret if it is that string.
    Without, planted(docs) are used, and where these don't have both kinds, the
    rule named-and-assigned decides (probability 1 or 0).  Null and empty texts
    have no candidates; a null path is an empty one.  Repeated rows are repeated
    findings; equal candidates in equal company have one probability.  An empty
    table gives none.
    """
    docs = docs.select("doc_id", "text", path.alias("path"))
    known = (planted(docs) if labelled is None else labelled).select("doc_id", "text", "path", "secret", F.lit(True).alias("told"))
    rows = docs.select("*", F.lit(None).cast("string").alias("secret"), F.lit(False).alias("told")).unionByName(known)
    found = written(features(written(candidates(rows)), docs))  # read again by each pass of the training
    label = F.coalesce(F.col("candidate") == F.col("secret"), F.lit(False)).cast("double")
    model = train(found.where("told").select(label.alias("label"), *FEATURES))
    found = found.where("not told")
    if model is None:
        scored = found.withColumn("probability", F.when((F.col("named") > 0) & (F.col("assigned") > 0), 1.0).otherwise(0.0))
    else:
        scored = model.transform(found).withColumn("probability", vector_to_array("chances")[1])
    return scored.select("doc_id", "nth", "part", "candidate", "probability", (F.col("probability") >= 0.5).alias("secret"))
