"""JSON columns: fences, parsing, and validation against a JSON Schema that is compiled to column expressions.

Values are VARIANT. A schema's rules become one array of ``path, keyword`` structs in the order in which a validator that
stops at the first failure would meet them: applicators, type, enum, then what belongs to the container. References are
resolved while compiling; no Python runs per row.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "array<struct<path:string,keyword:string>>"


def strip_fence(text: Column) -> Column:
    """Text without a Markdown code fence around it; without an opening fence and line break, trimmed text as it is (JSN1)."""
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    inner = F.regexp_replace(F.regexp_replace(t, r"\A```[^\n]*\n", ""), r"\n?```\s*\z", "")
    return F.when(t.rlike(r"\A```[^\n]*\n"), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(t)


def parse_response(text: Column) -> Column:
    """VARIANT, or null where the text isn't JSON: E_MODEL_INVALID_JSON (JSN2)."""
    return F.try_parse_json(strip_fence(text))


def kind(v: Column) -> Column:
    """JSON class of a VARIANT: object, array, string, number, boolean, null; SQL null for a missing one."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null")
        .when(s.isNotNull(), "number")
    )


def as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def number(v: Column) -> Column:
    return F.when(kind(v) == "number", F.try_variant_get(v, "$", "double"))


def string(v: Column) -> Column:
    return F.when(kind(v) == "string", F.try_variant_get(v, "$", "string"))


def lenient_long(v: Column) -> Column:
    """A number, or a string that is one, as a long; else null (JSN9)."""
    return F.when(kind(v) == "number", F.try_variant_get(v, "$", "bigint")).when(kind(v) == "string", F.try_variant_get(v, "$", "string").try_cast("bigint"))


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Compiler:
    """Rules as SQL text, which is parsed once: a tree of Column calls costs more to build than to run."""

    NONE = f"cast(array() as {_NONE})"

    def __init__(self, schema: dict):
        self.root, self.names = schema, itertools.count()

    def resolve(self, ref: str):
        """A local reference, ``~1`` and ``~0`` unescaped (JSN4o)."""
        if not ref.startswith("#"):
            raise ValueError(f"only local references are supported: {ref}")
        at = self.root
        for part in ref[1:].split("/")[1:]:
            at = at[part.replace("~1", "/").replace("~0", "~")]
        return at

    def one(self, bad: str, path: str, keyword: str) -> str:
        return f"if(coalesce({bad}, false), array(struct({path} as path, '{keyword}' as keyword)), {self.NONE})"

    def ok(self, v: str, schema) -> str:
        return f"size({self.violations(v, schema, _text('$'))}) = 0"

    def violations(self, v: str, schema, path: str) -> str:
        if schema is True or schema == {}:
            return self.NONE
        if schema is False:
            return self.one("true", path, "false")
        if "$ref" in schema:  # its siblings are ignored
            return self.violations(v, self.resolve(schema["$ref"]), path)
        # what the rules read of a value is taken from it once, as the variable of a lambda
        n = next(self.names)
        x, y = f"x{n}", f"y{n}"
        kind = f"if({x}.m is not null, 'object', if({x}.a is not null, 'array', if({x}.v is null, null, case schema_of_variant({x}.v) when 'STRING' then 'string' when 'BOOLEAN' then 'boolean' when 'VOID' then 'null' else 'number' end)))"
        parts = f"array(struct({v} as v, try_variant_get({v}, '$', 'map<string,variant>') as m, try_variant_get({v}, '$', 'array<variant>') as a))"
        return f"get(transform(transform({parts}, {x} -> struct({x}.v, {x}.m, {x}.a, {kind} as k)), {y} -> {self._rules(y, schema, path)}), 0)"

    def _rules(self, x: str, schema: dict, path: str) -> str:
        v, k = f"{x}.v", f"{x}.k"
        out = [self.violations(v, s, path) for s in schema.get("allOf", [])]
        if "not" in schema:
            out.append(self.one(self.ok(v, schema["not"]), path, "not"))
        if "if" in schema:
            then, other = self.violations(v, schema.get("then", True), path), self.violations(v, schema.get("else", True), path)
            out.append(f"if({self.ok(v, schema['if'])}, {then}, {other})")
        if "type" in schema:
            types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            fits = [f"{k} = '{t}'" for t in types if t != "integer"]
            if "integer" in types:
                number = f"try_variant_get({v}, '$', 'double')"
                fits.append(f"({k} = 'number' and {number} = floor({number}))")
            out.append(self.one(f"not coalesce({' or '.join(fits)}, false)", path, "type"))
        if "enum" in schema:
            out.append(self.one(f"not ({self._in(v, k, schema['enum'])})", path, "enum"))
        out += self._object(x, schema, path) + self._array(x, schema, path) + self._string(f"if({k} = 'string', try_variant_get({v}, '$', 'string'), null)", schema, path)
        return f"concat({', '.join(out)})" if out else self.NONE

    def _in(self, v: str, k: str, values: list) -> str:
        texts, numbers = [x for x in values if isinstance(x, str)], [float(x) for x in values if isinstance(x, (int, float)) and not isinstance(x, bool)]
        others = [x for x in values if not isinstance(x, str) and (not isinstance(x, (int, float)) or isinstance(x, bool))]
        hits = ["false"]
        if texts:
            hits.append(f"coalesce({k} = 'string' and try_variant_get({v}, '$', 'string') in ({', '.join(map(_text, texts))}), false)")
        if numbers:
            hits.append(f"coalesce({k} = 'number' and try_variant_get({v}, '$', 'double') in ({', '.join(f'{n!r}D' for n in numbers)}), false)")
        hits += [f"coalesce(to_json({v}) = {_text(json.dumps(x, sort_keys=True, separators=(',', ':')))}, false)" for x in others]
        return " or ".join(hits)

    def _object(self, x: str, schema: dict, path: str) -> list[str]:
        is_object, names = f"{x}.k = 'object'", f"map_keys({x}.m)"
        has = lambda k: f"array_contains({names}, {_text(k)})"
        out = [self.one(f"{is_object} and not {has(k)}", path, "required") for k in schema.get("required", [])]
        known = schema.get("properties", {})
        for k, s in known.items():
            inner = self.violations(f"try_element_at({x}.m, {_text(k)})", s, f"concat({path}, {_text('.' + k)})")
            out.append(f"if(coalesce({is_object} and {has(k)}, false), {inner}, {self.NONE})")
        extra = schema.get("additionalProperties", True)
        listed = f"cast(array({', '.join(map(_text, known))}) as array<string>)"
        if extra is False:
            unknown = f"array_min(array_except({names}, {listed}))"
            out.append(self.one(f"{is_object} and {unknown} is not null", f"concat({path}, '.', coalesce({unknown}, ''))", "additionalProperties"))
        elif isinstance(extra, dict):
            n = next(self.names)
            inner = self.violations(f"try_element_at({x}.m, k{n})", extra, f"concat({path}, '.', k{n})")
            out.append(f"if(coalesce({is_object}, false), flatten(transform(array_sort(array_except({names}, {listed})), k{n} -> {inner})), {self.NONE})")
        return out

    def _array(self, x: str, schema: dict, path: str) -> list[str]:
        out, is_array = [], f"{x}.k = 'array'"
        if "minItems" in schema:
            out.append(self.one(f"{is_array} and size({x}.a) < {schema['minItems']}", path, "minItems"))
        if "maxItems" in schema:
            out.append(self.one(f"{is_array} and size({x}.a) > {schema['maxItems']}", path, "maxItems"))
        n = next(self.names)
        if "contains" in schema:
            out.append(self.one(f"{is_array} and not exists({x}.a, e{n} -> {self.ok(f'e{n}', schema['contains'])})", path, "contains"))
        if "items" in schema:
            each = self.violations(f"e{n}", schema["items"], f"concat({path}, '[', cast(i{n} as string), ']')")
            out.append(f"if(coalesce({is_array}, false), flatten(transform({x}.a, (e{n}, i{n}) -> {each})), {self.NONE})")
        return out

    def _string(self, s: str, schema: dict, path: str) -> list[str]:
        out = []
        if schema.get("minLength"):
            out.append(self.one(f"length({s}) < {schema['minLength']}", path, "minLength"))
        if "maxLength" in schema:
            out.append(self.one(f"length({s}) > {schema['maxLength']}", path, "maxLength"))
        if "pattern" in schema:
            out.append(self.one(f"not rlike({s}, {_text(schema['pattern'])})", path, "pattern"))
        return out


def schema_violations(v: Column, schema: dict) -> Column:
    """All violations of a VARIANT, in the order of a validator that stops at the first (JSN4); lengths are in code points."""
    rules = Compiler(schema).violations("value", schema, _text("$"))
    return F.get(F.call_function("transform", F.array(v), F.expr(f"value -> {rules}")), F.lit(0))


def first_violation(v: Column, schema: dict) -> Column:
    return F.get(schema_violations(v, schema), F.lit(0))  # JSN4p


def matches_schema(v: Column, schema: dict) -> Column:
    return F.size(schema_violations(v, schema)) == 0  # JSN4q


# Fixed values of the response schemas, version 1.3.0.
GENRES = [
    "architecture", "landscape", "seascape", "cityscape", "portrait_people", "group_portrait", "candid_people", "street_documentary", "wildlife", "bird_photography",
    "plant_botanical", "macro_closeup", "abstract", "still_life", "product", "food", "sports_action", "event", "travel", "night", "astrophotography", "aerial",
    "underwater", "interior", "fine_art_conceptual",
]
SPECIES_GENRES = ["wildlife", "bird_photography", "plant_botanical"]
LINE = r"^[^\r\n\t]+$"
BANDS = ["high", "medium", "low"]


def response_schema(role: str) -> dict:
    """The schema of a role's answers (JSN5, JSN6): whole images also name their scene and setting."""
    text = lambda most: {"type": "string", "minLength": 1, "maxLength": most, "pattern": LINE}

    def candidates(most: int, evidence: bool, term: dict | None = None, least: int = 0) -> dict:
        fields = {"term": term or text(80), "confidence": {"type": "string", "enum": BANDS}} | ({"evidence": text(220)} if evidence else {})
        return {"type": "array", "maxItems": most, "items": {"type": "object", "additionalProperties": False, "required": list(fields), "properties": fields}} | ({"minItems": least} if least else {})

    note = lambda most: {"type": "string", "maxLength": most}
    fields = {"summary": note(280), "genre_or_photography_type": candidates(4, True, {"type": "string", "enum": GENRES}, 1), "species": candidates(6, True), "main_subjects": candidates(6, True), "secondary_subjects": candidates(10, True)}
    if role == "whole_image":
        fields |= {"scene_context": candidates(8, False), "habitat_or_setting": candidates(8, False)}
    fields |= {"behavior_or_action": candidates(8, False), "proposed_keywords": candidates(30, True), "uncertainty_notes": note(600)}
    living = {"contains": {"type": "object", "required": ["term"], "properties": {"term": {"enum": SPECIES_GENRES}}}}
    rule = {"if": {"required": ["genre_or_photography_type"], "properties": {"genre_or_photography_type": living}}, "then": {"required": ["species"]}, "else": {"not": {"required": ["species"]}}}
    return {"type": "object", "additionalProperties": False, "required": [f for f in fields if f != "species"], "allOf": [rule], "properties": fields}


def species_rule(v: Column) -> Column:
    """The conditional rule by hand: species is there exactly if a genre is of SPECIES_GENRES (JSN5)."""
    genre = as_array(F.try_variant_get(v, "$.genre_or_photography_type", "variant"))
    living = F.coalesce(F.exists(genre, lambda g: F.coalesce(F.try_variant_get(g, "$.term", "string").isin(SPECIES_GENRES), F.lit(False))), F.lit(False))
    return living == F.array_contains(F.map_keys(as_map(v)), "species")


def violations_by_role(v: Column, role: Column, schemas: dict[str, dict] | None = None) -> Column:
    """Violations against the schema of the row's role; an unknown role violates ``role`` (JSN6)."""
    out = F.array(F.struct(F.lit("$").alias("path"), F.lit("role").alias("keyword")))
    for name, schema in (schemas or {r: response_schema(r) for r in ("whole_image", "subject_isolated")}).items():
        out = F.when(role == name, schema_violations(v, schema)).otherwise(out)
    return out


def classify_response(text: Column, schema: dict) -> Column:
    """``status`` (valid, schema_violation, invalid_json), ``error_code`` and the parsed value, kept on violations (JSN3)."""
    parsed = F.transform(F.array(parse_response(text)), lambda v: F.struct(v.alias("v"), F.when(v.isNotNull(), matches_schema(v, schema)).alias("ok")))
    status = lambda x: F.when(x["v"].isNull(), "invalid_json").when(x["ok"], "valid").otherwise("schema_violation").alias("status")
    code = lambda x: F.when(x["v"].isNull(), "E_MODEL_INVALID_JSON").when(~x["ok"], "E_MODEL_SCHEMA_VIOLATION").alias("error_code")
    return F.get(F.transform(parsed, lambda x: F.struct(status(x), code(x), x["v"].alias("parsed"))), F.lit(0))
