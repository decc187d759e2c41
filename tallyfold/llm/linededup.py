"""Line dedup: a segment-partition edit join on distinct lines; DataFrame functions only.

Two lines within `edits` edits share one of edits + 1 segments, at a place that
the lengths bound.  Distinct lines are indexed by (length, segment number,
segment); each line probes the substrings that could be a segment of a line as
long as itself or shorter.  What meets is verified by a bit-parallel edit
distance on a band of 2 * edits + 1 diagonals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.text import likely_in, parallelism, shuffle_files_cleaned, unused, written

EDITS = 2
#: Only blank lines aren't compared.
MIN_CHARS = 1
#: With fewer characters than segments, a line has no segment to be found by.
FUZZY_CHARS = EDITS + 1


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines are within this many edits of single characters, for arrays of their characters.

    Bit d + edits of mask e says that the first j + d characters of a become
    the first j of b by e edits at most; a step takes the next character of b.
    """
    full = (1 << (2 * edits + 1)) - 1
    start = F.struct(*(F.lit(sum(1 << (edits + d) for d in range(e + 1))).alias(f"m{e}") for e in range(edits + 1)))

    def step(s: Column, j: Column) -> Column:
        c = F.get(b, j)
        equal = F.lit(0)
        for d in range(-edits, edits + 1):
            equal = equal + F.when(F.get(a, j + d) == c, 1 << (d + edits)).otherwise(0)
        masks = [s["m0"].bitwiseAND(equal)]
        for e in range(1, edits + 1):
            old = s[f"m{e - 1}"]
            new = s[f"m{e}"].bitwiseAND(equal).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(masks[-1], 1))
            masks.append(new.bitwiseAND(full))
        return F.struct(*(m.alias(f"m{e}") for e, m in enumerate(masks)))

    places = F.when(F.size(b) > 0, F.sequence(F.lit(0), F.size(b) - 1)).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(places, start, step)[f"m{edits}"]
    gap = F.size(a) - F.size(b)
    return (F.abs(gap) <= edits) & (F.call_function("getbit", last, F.greatest(F.least(gap, F.lit(edits)), F.lit(-edits)) + edits) == 1)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, no, line (trimmed), h1, h2 of the lines that aren't blank."""
    rows = docs.where("text is not null and doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("line", F.trim("line"))
    rows = rows.where(F.char_length("line") >= MIN_CHARS)
    return rows.withColumn("h1", F.xxhash64(F.lit(1), "line")).withColumn("h2", F.xxhash64(F.lit(2), "line"))


def _entries(distinct: DataFrame, edits: int) -> DataFrame:
    """key, id, index of distinct lines: what each looks for, and whether it is also found by it.

    Segments have equal sizes, with the rest in the last ones.  Lines have
    edits + 1 characters at least, so no segment is empty; nothing is looked for
    among shorter ones.  The probes are rows before the keys are computed, which
    keeps that to one short expression.
    """
    k = edits + 1
    probes = []
    for i in range(k):
        for shorter in range(k):
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1):
                probes.append(F.struct(F.lit(i).alias("i"), F.lit(shorter).alias("shorter"), F.lit(shift).alias("shift")))
    rows = distinct.select(F.col("h1").alias("id"), "line", F.char_length("line").alias("n"), F.explode(F.array(*probes)).alias("e"))
    rows = rows.select("id", "line", "e.i", "e.shift", (F.col("n") - F.col("e.shorter")).alias("n"), (F.col("e.shorter") == 0).alias("own")).where(F.col("n") > edits)
    rows = rows.select("*", F.expr(f"n div {k}").cast("int").alias("size"), (F.col("n") % k).alias("rest"))
    start = F.col("size") * F.col("i") + F.greatest(F.col("rest") - (F.lit(k) - F.col("i")), F.lit(0))
    size = F.col("size") + (F.col("i") >= k - F.col("rest")).cast("int")
    key = F.xxhash64("n", "i", F.substring(F.col("line"), start + F.col("shift") + 1, size))
    return rows.select(key.alias("key"), "id", (F.col("own") & (F.col("shift") == 0)).alias("index"))


def parities(chars: Column) -> Column:
    """Two 64-bit words for a line's characters and its pairs of neighbours: the parity of how many fall on each bit."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"), F.lit("").alias("last"))
    step = lambda a, x: F.struct(a["one"].bitwiseXOR(bit(x)).alias("one"), a["two"].bitwiseXOR(bit(F.concat(a["last"], x))).alias("two"), x.alias("last"))
    return F.aggregate(chars, start, step)


def links(docs: DataFrame, firsts: DataFrame, edits: int) -> DataFrame:
    """Pairs of distinct lines (a, b by h1) within the edits; firsts: h1, h2, doc_id, no of each distinct line.

    An edit changes two characters' parities and four pairs' at most, so lines
    of one segment whose parities are further apart are no pair; that is part
    of the join's condition and keeps many variants of one line from being
    written out against each other.
    """
    p = parallelism(docs.sparkSession)
    fuzzy = lines(docs).where(F.char_length("line") > edits)
    distinct = fuzzy.join(firsts, ["h1", "h2", "doc_id", "no"], "left_semi").select("h1", "line")
    of = Window.partitionBy("key")
    entries = _entries(distinct, edits).select("key", "id", "index", F.min("id").over(of).alias("x"), F.max("id").over(of).alias("y"), F.max("index").over(of).alias("i"))
    met = written(entries.where("x < y and i").select("key", "id", "index"))  # one shuffle of the entries; what no other line meets goes
    texts = likely_in(fuzzy, "h1", met.select(F.col("id").alias("h1")))
    # an inner join (firsts are distinct): a semi-join would be pushed below the bit table
    texts = texts.join(firsts, ["h1", "h2", "doc_id", "no"]).select(F.col("h1").alias("id"), F.split("line", "").alias("c"))
    texts = written(texts.withColumn("s", parities(F.col("c"))).select("id", "c", "s.one", "s.two"))
    signed = met.join(texts.select("id", "one", "two"), "id")
    a = signed.where("index").select("key", F.col("id").alias("a"), F.col("one").alias("a1"), F.col("two").alias("a2"))
    b = signed.select("key", F.col("id").alias("b"), F.col("one").alias("b1"), F.col("two").alias("b2"))
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    near = (a["key"] == b["key"]) & (F.col("a") != F.col("b")) & (apart("a1", "b1") <= 2 * edits) & (apart("a2", "b2") <= 4 * edits)
    pairs = a.join(b, near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("c").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("c").alias("y")), "b")
    return both.repartition(p, "a", "b").where(within_edits(F.col("x"), F.col("y"), edits)).select("a", "b")


def remove_lines(docs: DataFrame, edits: int = EDITS, out: str = "lines") -> DataFrame:
    """Adds to docs a struct column `out`: n_lines, n_removed, kept (the text of the lines that stay).

    Lines end at line feeds and are compared without blanks at their ends.  A
    line goes if the same line, or one within `edits` edits (insertions,
    deletions, substitutions of a character), is earlier: in a smaller doc_id,
    or above it in the same document.  Judged on the input, not on what is
    left.  Blank lines always stay, and lines of `edits` characters or fewer,
    which any other such line is within the edits of, go only for the same line.

    docs keeps its rows and columns; one named `out` is replaced.  Null text
    has no lines and null kept; an empty text is one empty line.  Rows of null
    doc_id stay whole.  Rows that repeat a doc_id are taken as one document, so
    the same line at the same place of both stays in both.  An empty table
    gives none.
    """
    spark = docs.sparkSession
    docs = docs.drop(out)
    with shuffle_files_cleaned(spark):
        place = F.struct("doc_id", "no")
        firsts = written(lines(docs).groupBy("h1", "h2").agg(F.min(place).alias("f")).select("h1", "h2", "f.doc_id", "f.no"))
        near = written(links(docs, firsts, edits))
        own = firsts.select("h1", place.alias("f"))
        both = near.join(own.select(F.col("h1").alias("a"), F.col("f").alias("fa")), "a").join(own.select(F.col("h1").alias("b"), F.col("f").alias("fb")), "b")
        late = both.select(F.when(F.col("fa") > F.col("fb"), F.col("a")).otherwise(F.col("b")).alias("h1")).distinct()
        keep = written(firsts.join(late, "h1", "left_anti").groupBy("doc_id").agg(F.collect_list(F.struct("no", "h1")).alias("keep")))
    doc, stays, kept_lines = unused(docs.columns, "_line_doc", "_line_keep", "_line_kept")
    stay = docs.join(keep.select(F.col("doc_id").alias(doc), F.col("keep").alias(stays)), docs["doc_id"] == F.col(doc), "left")
    all_lines = F.split("text", "\n")
    kept = F.filter(
        all_lines,
        lambda x, i: (F.char_length(F.trim(x)) < MIN_CHARS) | F.col("doc_id").isNull() | F.coalesce(F.array_contains(F.col(stays), F.struct(i.alias("no"), F.xxhash64(F.lit(1), F.trim(x)).alias("h1"))), F.lit(False)),
    )
    n = F.coalesce(F.size(all_lines), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(n).cast("long")
    stay = stay.withColumn(kept_lines, kept)
    left = F.when(F.col("text").isNull(), 0).otherwise(F.size(kept_lines)).cast("long")
    return stay.select(*(docs[c] for c in docs.columns), F.struct(n.alias("n_lines"), (n - left).alias("n_removed"), F.array_join(kept_lines, "\n").alias("kept")).alias(out))
