"""Whole-record contracts against a plain reading of the same schemas."""

import json
import re

from tallyfold.operators import paths

SCHEMAS = {
    "record-1": {
        "$id": "https://x.test/record/1", "type": "object", "additionalProperties": False, "required": ["id", "source", "lines"],
        "properties": {
            "id": {"type": "string", "pattern": "^R-[0-9]+$"},
            "source": {"$ref": "https://x.test/common#/$defs/source"},
            "lines": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"$ref": "#/$defs/line"}},
            "open": {"type": "object"}, "level": {"type": "number", "exclusiveMinimum": 0, "maximum": 1}, "count": {"type": "integer", "minimum": 0},
            "at": {"type": "string", "format": "date-time"}, "parent": {"oneOf": [{"type": "null"}, {"type": "object", "required": ["why"], "additionalProperties": False, "properties": {"why": {"type": "string", "minLength": 1}}}]},
            "metrics": {"type": "object", "minProperties": 1, "propertyNames": {"minLength": 1}, "additionalProperties": {"type": "number"}}, "state": {"enum": ["OPEN", "DONE", None]}, "flag": {"const": True},
        },
        "$defs": {"line": {"allOf": [{"type": "object", "required": ["n"]}, {"properties": {"n": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string", "maxLength": 2}}}, "additionalProperties": False}]}},
    },
    "common": {"$id": "https://x.test/common", "$defs": {"source": {"type": "object", "additionalProperties": False, "required": ["uri"], "properties": {"uri": {"type": "string", "minLength": 1}, "next": {"$ref": "#/$defs/source"}}}}},
}
GOOD = {"id": "R-1", "source": {"uri": "u"}, "lines": [{"n": 1}, {"n": 2, "tags": ["a", "bc"]}]}


def test_breaches_at_any_depth(spark):
    cases = {
        "fine": (GOOD, set()),
        "all": (GOOD | {"open": {"x": {"y": 1}}, "level": 0.5, "count": 3.0, "at": "2024-01-01T00:00:00Z", "parent": None, "metrics": {"é": 1, "k.k": 2.5}, "state": None, "flag": True, "source": {"uri": "u", "next": {"uri": "v", "next": {"uri": "w"}}}}, set()),
        "missing": ({"id": "R-1", "source": {}}, {("$.lines", "missing field"), ("$.source.uri", "missing field")}),
        "unknown": (GOOD | {"more": 1, "source": {"uri": "u", "x": 1}, "lines": [{"n": 1, "z": []}]}, {("$.more", "unknown field"), ("$.source.x", "unknown field"), ("$.lines[0].z", "unknown field")}),
        "types": (GOOD | {"id": 5, "lines": [{"n": 1.5}, {"n": "1"}, {"n": 2, "tags": [1]}], "count": True}, {("$.id", "wrong type"), ("$.lines[0].n", "wrong type"), ("$.lines[1].n", "wrong type"), ("$.lines[2].tags[0]", "wrong type"), ("$.count", "wrong type")}),
        "sizes": (GOOD | {"lines": [], "metrics": {}, "source": {"uri": ""}}, {("$.lines", "too few"), ("$.metrics", "too few"), ("$.source.uri", "too short")}),
        "many": (GOOD | {"lines": [{"n": i, "tags": ["abc"]} for i in range(4)]}, {("$.lines", "too many"), *((f"$.lines[{i}].tags[0]", "too long") for i in range(4))}),
        "twice": (GOOD | {"lines": [{"n": 1, "tags": []}, {"tags": [], "n": 1}]}, {("$.lines", "repeated element")}),
        "values": (GOOD | {"state": "X", "flag": False, "id": "R-x"}, {("$.state", "not one of its values"), ("$.flag", "not one of its values"), ("$.id", "pattern")}),
        "bounds": (GOOD | {"level": 0, "count": -1}, {("$.level", "out of bounds"), ("$.count", "out of bounds")}),
        "over": (GOOD | {"level": 1.01, "at": "2024-01-01 00:00"}, {("$.level", "out of bounds"), ("$.at", "not a time with zone")}),
        "parent": (GOOD | {"parent": {"why": "", "x": 1}}, {("$.parent.why", "too short"), ("$.parent.x", "unknown field")}),
        "parent type": (GOOD | {"parent": "p"}, {("$.parent", "wrong type")}),
        "metrics": (GOOD | {"metrics": {"": 1, "m": "x", "deep": {}}}, {("$.metrics", "badly named field"), ("$.metrics.m", "wrong type"), ("$.metrics.deep", "wrong type")}),
        "next": (GOOD | {"source": {"uri": "u", "next": {"uri": "v", "next": {"y": 1}}}}, {("$.source.next.next.uri", "missing field"), ("$.source.next.next.y", "unknown field")}),
        "array": ([1], {("$", "wrong type")}),
    }
    rows = [(k, "record-1", json.dumps(d)) for k, (d, _) in cases.items()] + [("text", "record-1", "{x"), ("null", "record-1", None), ("other", "else", "{}")]
    contract = paths.Schemas(SCHEMAS).contract(spark, ["record-1"])
    got = {k: set() for k, *_ in rows}
    for r in paths.document_breaches(spark.createDataFrame(rows, "k string, kind string, raw string"), contract, ["k"]).collect():
        assert (r.at, r.rule) not in got[r.k]
        got[r.k].add((r.at, r.rule))
    assert got == {k: w for k, (_, w) in cases.items()} | {"text": {("$", "no JSON")}, "null": {("$", "no JSON")}, "other": {("$", "no contract")}}


def test_names_with_dots_are_one_step(spark):
    schema = {"a": {"type": "object", "additionalProperties": False, "properties": {"x": {"type": "object", "properties": {"y": {"type": "string"}}}}}}
    contract = paths.Schemas(schema).contract(spark)
    got = paths.document_breaches(spark.createDataFrame([("1", "a", '{"x.y": 1, "x": {"y": 2}}')], "k string, kind string, raw string"), contract, ["k"]).collect()
    assert {(r.at, r.rule) for r in got} == {("$.x.y", "unknown field"), ("$.x.y", "wrong type")}


def test_schemas_of_a_folder(spark, tmp_path):
    for name, schema in SCHEMAS.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(schema))
    read = paths.read_schemas(spark, str(tmp_path))
    assert {re.sub(paths.STEP, "/", r[1]) for r in read.rows(["common"])} == {"$"} and sorted(r[1] for r in read.rows()) == sorted(r[1] for r in paths.Schemas(SCHEMAS).rows())


def test_all_levels_are_one_pass(spark):
    inner = {"type": "object", "additionalProperties": False, "required": ["b"], "properties": {"b": {"type": "array", "items": {"type": "integer", "minimum": 2}}}}
    contract = paths.Schemas({"x": {"type": "object", "additionalProperties": {"type": "string"}, "properties": {"a": inner}}}).contract(spark, ["x"])
    rows = [(1, "x", '{"a":{"b":[1,"t",3],"c":1},"other":2}'), (2, "x", '{"a":{}}'), (3, "x", "no"), (4, "y", "{}"), (5, "x", None), (6, "x", '{"a":{"b":[]},"other":"t"}')]
    out = paths.document_breaches(spark.createDataFrame(rows, "k int, kind string, raw string"), contract, ["k"])
    assert sorted((r.k, r["at"], r.rule) for r in out.collect()) == [
        (1, "$.a.b[0]", "out of bounds"), (1, "$.a.b[1]", "wrong type"), (1, "$.a.c", "unknown field"), (1, "$.other", "wrong type"), (2, "$.a.b", "missing field"), (3, "$", "no JSON"), (4, "$", "no contract"), (5, "$", "no JSON"),
    ]
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
