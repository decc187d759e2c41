"""Whole-record contracts: documents as rows of paths, contracts as a relation of paths, one join a level for all kinds of records.

A contract is told by JSON Schema documents, which come as a parameter.  Each
becomes rows of (kind, path): what the value there may be, which members it must
have and whether it may have others.  Documents are opened level by level, only
where the relation knows the path, so a level costs one pass over what is left
and deep members that no contract speaks of cost nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators.contracts import RFC3339
from tallyfold.operators.lineage import kept

#: Between the steps of a path in the relation; no member's name has it.
STEP = "\x1f"
ANY, EACH = f"{STEP}*", f"{STEP}[]"
#: Bytes of schema documents that may come to the driver, and steps that a path has at most (schemas may name themselves).
MOST_BYTES, MOST_STEPS = 16 << 20, 16
#: Levels that one pass opens.
LEVELS = 6


@dataclass
class Node:
    """What a contract says of the values at one path; null: nothing."""

    types: list[str] | None = None
    allowed: list[str] | None = None
    patterns: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
    closed: bool = False
    distinct: bool = False
    timed: bool = False
    least_length: int | None = None
    most_length: int | None = None
    least_items: int | None = None
    most_items: int | None = None
    least: float | None = None
    most: float | None = None
    above: float | None = None
    below: float | None = None


_KIND = (
    "kind string, path string, types array<string>, allowed array<string>, patterns array<string>, names array<string>, required array<string>, closed boolean, distinct boolean, timed boolean, "
    "least_length int, most_length int, least_items int, most_items int, least double, most double, above double, below double"
)


def _text(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


class Schemas:
    """Schema documents by name and by $id; contract() gives the relation of some of them."""

    def __init__(self, documents: dict[str, dict]):
        self.named = documents
        self.known = {d["$id"]: d for d in documents.values() if "$id" in d}

    def _target(self, ref: str, home: dict) -> tuple[dict, dict]:
        at, _, way = ref.partition("#")
        home = self.known[at] if at else home
        out = home
        for step in way.strip("/").split("/") if way.strip("/") else []:
            out = out[step.replace("~1", "/").replace("~0", "~")]
        return out, home

    def _walk(self, schema, path: str, home: dict, out: dict[str, Node], nullable: bool = False) -> None:
        """Adds what a schema says at a path to out; several (allOf, $ref) say it together."""
        if not isinstance(schema, dict) or path.count(STEP) > MOST_STEPS:
            return
        node = out.setdefault(path, Node())
        if "$ref" in schema:
            self._walk(*self._at(schema["$ref"], path, home), out, nullable=nullable)
        for part in schema.get("allOf", []):
            if "if" not in part:
                self._walk(part, path, home, out)
        for key in ("oneOf", "anyOf"):
            branches = schema.get(key, [])
            others = [b for b in branches if b != {"type": "null"}]
            if len(others) == 1:  # a value or null
                self._walk(others[0], path, home, out, nullable=len(branches) > 1)
        if "type" in schema:
            own = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
            own += ["null"] if nullable else []
            node.types = own if node.types is None else [t for t in node.types if t in own]
        values = [schema["const"]] if "const" in schema else schema.get("enum")
        if values is not None:
            told = [_text(v) for v in values]
            node.allowed = told if node.allowed is None else [v for v in node.allowed if v in told]
        node.patterns += [schema["pattern"]] if "pattern" in schema else []
        names = schema.get("propertyNames", {})
        node.names += [names["pattern"]] if "pattern" in names else [f"(?s)^.{{{names['minLength']},}}"] if "minLength" in names else []
        node.required += [r for r in schema.get("required", []) if r not in node.required]
        node.closed = node.closed or schema.get("additionalProperties") is False
        node.distinct = node.distinct or schema.get("uniqueItems") is True
        node.timed = node.timed or schema.get("format") == "date-time"
        pick = lambda name, key, best: setattr(node, name, schema[key] if getattr(node, name) is None else best(getattr(node, name), schema[key])) if key in schema else None
        for name, key, best in (
            ("least_length", "minLength", max), ("most_length", "maxLength", min), ("least_items", "minItems", max), ("most_items", "maxItems", min), ("least_items", "minProperties", max), ("most_items", "maxProperties", min),
            ("least", "minimum", max), ("most", "maximum", min), ("above", "exclusiveMinimum", max), ("below", "exclusiveMaximum", min),
        ):
            pick(name, key, best)
        for name, part in schema.get("properties", {}).items():
            out.setdefault(f"{path}{STEP}{name}", Node())
            self._walk(part, f"{path}{STEP}{name}", home, out)
        self._walk(schema.get("additionalProperties"), f"{path}{ANY}", home, out)
        self._walk(schema.get("items"), f"{path}{EACH}", home, out)

    def _at(self, ref: str, path: str, home: dict) -> tuple[dict, str, dict]:
        target, there = self._target(ref, home)
        return target, path, there

    def rows(self, names: list[str] | None = None) -> Iterator[tuple]:
        for name in self.named if names is None else names:
            out: dict[str, Node] = {}
            self._walk(self.named[name], "$", self.named[name], out)
            for path, node in out.items():
                yield name, path, *asdict(node).values()

    def contract(self, spark: SparkSession, names: list[str] | None = None) -> DataFrame:
        """The relation: kind (the document's name), path, and what Node has; a row for each path that a schema names.

        Schemas that name themselves are followed for MOST_STEPS steps.
        Conditions (if, then), not, prefixItems and choices between several
        values are no part of it; contracts.py has the rules that need them.
        """
        number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
        floats = {"least", "most", "above", "below"}
        at = {n: i + 2 for i, n in enumerate(Node.__dataclass_fields__)}
        rows = [tuple(number(v) if i in {at[f] for f in floats} else v for i, v in enumerate(r)) for r in self.rows(names)]
        return spark.createDataFrame(rows, _KIND)


def read_schemas(spark: SparkSession, path: str) -> Schemas:
    """Schema documents of a folder, by the file's name without its ending."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("name"), "value").where("name <> ''")
    size = files.agg(F.sum(F.length("value"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"schema documents of {size} characters: is {path} a folder of schemas?")
    return Schemas({r["name"]: json.loads(r["value"]) for r in files.collect()})


def _kind_of(text: Column) -> Column:
    start = F.substring(text, 1, 1)
    whole = text.rlike(r"^-?[0-9]+(?:\.0+)?\z")
    return F.when(start == "{", "object").when(start == "[", "array").when(start == '"', "string").when(start.isin("t", "f"), "boolean").when(start == "n", "null").when(whole, "integer").otherwise("number")


def _broken(n: str) -> dict[str, Column]:
    """Rules of a node with its contract as the struct n; kind_, text, string and number are its own."""
    c = lambda name: F.col(f"{n}.{name}")
    is_ = lambda k: F.col("kind_") == k
    numeric = F.col("kind_").isin("integer", "number")
    typed = F.array_contains(c("types"), F.col("kind_")) | ((F.col("kind_") == "integer") & F.array_contains(c("types"), "number"))
    text, number, size = F.col("string"), F.col("number"), F.when(is_("array"), F.size("items")).when(is_("object"), F.size("members"))
    unlike = lambda ps, x: F.exists(ps, lambda p: ~F.call_function("rlike", x, p))
    return {
        "wrong type": c("types").isNotNull() & ~typed,
        "not one of its values": c("allowed").isNotNull() & ~F.array_contains(c("allowed"), F.col("text")),
        "pattern": is_("string") & unlike(c("patterns"), text),
        "not a time with zone": is_("string") & c("timed") & ~(text.rlike(RFC3339) & F.try_to_timestamp(text).isNotNull()),
        "too short": is_("string") & (F.char_length(text) < c("least_length")),
        "too long": is_("string") & (F.char_length(text) > c("most_length")),
        "too few": size < c("least_items"),
        "too many": size > c("most_items"),
        "repeated element": is_("array") & c("distinct") & (F.size(F.array_distinct(F.transform("items", lambda x: F.to_json(x)))) < F.size("items")),
        "out of bounds": numeric & (F.coalesce(number < c("least"), F.lit(False)) | F.coalesce(number > c("most"), F.lit(False)) | F.coalesce(number <= c("above"), F.lit(False)) | F.coalesce(number >= c("below"), F.lit(False))),
    }


def document_breaches(documents: DataFrame, contract: DataFrame, key: list[str]) -> DataFrame:
    """key, kind, at, rule of each place of the documents (key, kind, raw: JSON text) that breaks its kind's contract.

    at: the way to the place, as in $.lines[2].flag.  A text that isn't JSON, or
    a kind without a contract, is one breach.  Members that a contract doesn't
    name are let be, or, where it is closed, are unknown fields.  Breaches pass by
    the levels below them, so LEVELS levels are one pass.
    """
    told = kept(contract)  # a row for each path that the schemas name
    width = F.struct(*[c for c in told.columns if c not in ("kind", "path")])
    relation = F.broadcast(told.select(F.col("kind").alias("_kind"), F.col("path").alias("_path"), width.alias("n")))
    kinds = [r[0] for r in told.select("kind").distinct().collect()]
    depth = told.agg(F.max(F.size(F.split("path", STEP)))).first()[0] or 0
    nothing, none = F.lit(None).cast("variant"), F.lit(None).cast("string")
    start = documents.select(*key, "kind", F.lit("$").alias("at"), F.lit("$").alias("path"), F.try_parse_json("raw").alias("v"))
    known = F.coalesce(F.col("kind").isin(kinds), F.lit(False))
    joined = start.join(relation, (F.col("kind") == F.col("_kind")) & (F.col("path") == F.col("_path")), "left").drop("_kind", "_path")
    level = joined.withColumn("rule", F.when(~known, F.lit("no contract")).when(F.col("v").isNull(), F.lit("no JSON"))).where("rule is not null or n is not null")
    shape = "array<struct<name:string,at:string,v:variant,rule:string>>"
    part = lambda name, at, v, rule: F.struct(name.alias("name"), at.alias("at"), v.alias("v"), rule.alias("rule"))
    for k in range(depth):
        open_ = F.col("rule").isNull()
        got = level.withColumn("text", F.when(open_, F.to_json("v"))).withColumn("kind_", _kind_of(F.col("text")))
        got = got.withColumn("string", F.when(F.col("kind_") == "string", F.try_variant_get("v", "$", "string"))).withColumn("number", F.when(F.col("kind_").isin("integer", "number"), F.col("text").cast("double")))
        got = got.withColumn("items", F.when(F.col("kind_") == "array", F.try_variant_get("v", "$", "array<variant>"))).withColumn("members", F.when(F.col("kind_") == "object", F.try_variant_get("v", "$", "map<string,variant>")))
        names = F.coalesce(F.map_keys("members"), F.array().cast("array<string>"))
        lacks = F.when(F.col("kind_") == "object", F.array_except("n.required", names))
        rules = _broken("n")
        odd = F.col("kind_") == "object"
        badly_named = odd & F.exists(names, lambda x: F.exists("n.names", lambda p: ~F.call_function("rlike", x, p)))
        here = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in (rules | {"badly named field": badly_named}).items())))
        empty = F.array().cast(shape)
        parts = [F.transform(here, lambda r: part(none, F.col("at"), nothing, r)), F.transform(lacks, lambda x: part(none, F.concat(F.col("at"), F.lit("."), x), nothing, F.lit("missing field")))]
        if k < depth - 1:
            parts.append(F.transform(F.map_entries("members"), lambda e: part(e["key"], F.concat(F.col("at"), F.lit("."), e["key"]), e["value"], none)))
            parts.append(F.transform("items", lambda x, i: part(none, F.concat(F.col("at"), F.lit("["), i.cast("string"), F.lit("]")), x, none)))
        # breaches found before pass by, so that all levels are one pass
        found = F.when(open_, F.concat(*(F.coalesce(p.cast(shape), empty) for p in parts))).otherwise(F.array(part(none, F.col("at"), nothing, F.col("rule"))).cast(shape))
        below = got.select(*key, "kind", "path", F.col("n.closed").alias("_closed"), F.explode(found).alias("c")).select(*key, "kind", "path", "_closed", F.col("c.at").alias("at"), F.col("c.name").alias("name"), F.col("c.v").alias("v"), F.col("c.rule").alias("rule"))
        if k == depth - 1:
            level = below
            break
        child = F.col("rule").isNull()
        named = F.when(child, F.when(F.col("name").isNull(), F.concat("path", F.lit(EACH))).otherwise(F.concat("path", F.lit(STEP), "name")))
        below = below.select(*key, "kind", "_closed", "at", "name", "v", "rule", named.alias("_own"), F.when(child, F.concat("path", F.lit(ANY))).alias("_any"))
        first = below.join(relation, (F.col("kind") == F.col("_kind")) & (F.col("_own") == F.col("_path")), "left").drop("_kind", "_path").withColumnRenamed("n", "_n")
        second = first.join(relation, (F.col("kind") == F.col("_kind")) & (F.col("_any") == F.col("_path")) & F.col("_n").isNull() & F.col("name").isNotNull(), "left").drop("_kind", "_path")
        rule = F.coalesce("rule", F.when(F.col("_n").isNull() & F.col("n").isNull() & F.col("_closed") & F.col("name").isNotNull(), F.lit("unknown field")))
        next_ = second.select(*key, "kind", "at", "v", F.when(F.col("_n").isNotNull(), F.col("_own")).otherwise(F.col("_any")).alias("path"), F.coalesce("_n", "n").alias("n"), rule.alias("rule"))
        level = next_.where("rule is not null or n is not null")
        if k % LEVELS == LEVELS - 1:
            level = kept(level)
    return level.where("rule is not null").select(*key, "kind", "at", "rule")
