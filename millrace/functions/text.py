"""Templates, JSON paths and validation as columns."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.rows import truthy


def interpolate(template: str, values: dict[str, Column]) -> Column:
    """{key} becomes its value; unknown keys stay as written."""
    parts = re.split(r"(\{\w+\})", template)
    return F.concat(*[values[p[1:-1]].cast("string") if p[:1] == "{" and p[1:-1] in values else F.lit(p) for p in parts if p])


def prompt(*parts: str | Column | tuple[Column, list]) -> Column:
    """Texts and columns in a row; null is the empty text. A pair (condition, parts) is kept only if its condition is truthy."""
    done = []
    for p in parts:
        if isinstance(p, tuple):
            done.append(F.when(truthy(p[0]), prompt(*p[1])).otherwise(""))
        else:
            done.append(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")))
    return F.concat(*done) if done else F.lit("")


def context_keys(template: Column) -> Column:
    """The names in {ctx.NAME}, each once, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{ctx\.(\w+)\}"), F.lit(1))))


def json_path(body: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text; null without a match or for bad JSON."""
    return F.get_json_object(body, f"$.{path}")


def where_project(items: Column, keep, field: str) -> Column:
    """items[?keep].field of an array of structs."""
    return F.transform(F.filter(items, keep), lambda x: x.getField(field))


def validation(rules: list[tuple[str, str, Column, str]]) -> Column:
    """All failures as an array of structs; a rule is (place, keyword, condition that must hold, message)."""
    struct = lambda p, k, m: F.struct(F.lit(p).alias("instance_path"), F.lit(k).alias("keyword"), F.lit(m).alias("message"))
    found = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), struct(p, k, m)) for p, k, ok, m in rules])
    return F.filter(found, lambda x: x.isNotNull())


def map_result(df: DataFrame, result: dict[str, Column] | Column) -> DataFrame:
    """A script's result: a map becomes columns of its own, anything else the column ``result``."""
    return df.withColumns(result if isinstance(result, dict) else {"result": result})


def if_chain(*cases: tuple[Column, Column | str], otherwise: Column | str | None = None) -> Column:
    """The value of the first case whose condition is true; null counts as false."""
    asked = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.coalesce(*[F.when(c, F.struct(asked(v).alias("v"))) for c, v in cases], F.struct(asked(otherwise).alias("v"))).getField("v")


def ctx_get(context: Column, key: Column | str) -> Column:
    """The value of a map column; null if it is missing."""
    return F.try_element_at(context, key if isinstance(key, Column) else F.lit(key))


def ctx_has(context: Column, key: Column | str) -> Column:
    return F.coalesce(F.map_contains_key(context, key), F.lit(False))


def typed_scalar(text: Column) -> Column:
    """What a template that is one token stands for: struct(kind, long, double, boolean, text), by whole number, number, true/false, null or text."""
    t = F.trim(text)
    whole, number, flag = t.rlike(r"^-?\d+$") & t.try_cast("long").isNotNull(), t.rlike(r"^-?\d+\.\d+([eE][+-]?\d+)?$"), t.isin("true", "false")
    kind = F.when(t.isNull() | (t == "null"), "null").when(whole, "long").when(number, "double").when(flag, "boolean").otherwise("text")
    part = lambda k, v: F.when(kind == k, v)
    return F.struct(kind.alias("kind"), part("long", t.try_cast("long")).alias("long"), part("double", t.try_cast("double")).alias("double"), part("boolean", t == "true").alias("boolean"), part("text", text).alias("text"))


class UnsupportedQuery(ValueError):
    """A JSON query outside the supported forms."""


_STEP = re.compile(r"(?:^|\.)([A-Za-z_]\w*)|\[(\d+)\]|\[(\*)\]|\[\?\s*([A-Za-z_][\w.]*)\s*(?:(==|!=|<=|>=|<|>)\s*(?:`([^`]*)`|'([^']*)'))?\s*\]")


def json_query(body: Column, query: str, strict: bool = True) -> Column:
    """The JSON text that a query finds in a JSON text: dotted names, [n], [*] and one filter [?name], [?name op literal], followed by names.

    Literals stand in backquotes (JSON) or quotes (text). Null without a match. Bad JSON is an error if strict, else null.
    A filter or [*] gives an array; elements in which the rest of the path is missing are left out."""
    at, steps = 0, []
    for m in _STEP.finditer(query):
        if m.start() != at:
            break
        at = m.end()
        steps.append(m)
    if at != len(query) or not steps or sum(m[3] is not None or m[4] is not None for m in steps) > 1:
        raise UnsupportedQuery(query)
    path = lambda ms: "$" + "".join(f"['{m[1]}']" if m[1] else f"[{m[2]}]" for m in ms)
    split = next((i for i, m in enumerate(steps) if m[3] is not None or m[4] is not None), None)
    parsed = F.to_json(F.parse_json(body) if strict else F.try_parse_json(body))
    if split is None:
        return _bare(parsed, path(steps))
    m, rest = steps[split], steps[split + 1 :]
    items = F.from_json(F.get_json_object(parsed, path(steps[:split])), "array<string>")
    if m[4]:
        items = F.filter(items, lambda x: F.coalesce(_passes(x, m), F.lit(False)))
    found = F.filter(F.transform(items, lambda x: _bare(x, path(rest))), lambda x: x.isNotNull()) if rest else items
    return F.concat(F.lit("["), F.array_join(found, ","), F.lit("]"))


def _bare(text: Column, path: str) -> Column:
    """The JSON text at a path, texts in quotes."""
    return F.to_json(F.variant_get(F.try_parse_json(text), path, "variant"))


def _passes(item: Column, m: re.Match) -> Column:
    found = F.variant_get(F.try_parse_json(item), "$" + "".join(f"['{x}']" for x in m[4].split(".")), "variant")
    if m[5] is None:  # true in the query language: neither null, false nor empty
        return ~F.coalesce(F.to_json(found), F.lit("null")).isin("null", "false", '""', "[]", "{}")
    literal = json.loads(m[6]) if m[6] is not None else m[7]
    if isinstance(literal, int | float) and not isinstance(literal, bool):
        a, b, fits = F.try_variant_get(found, "$", "double"), F.lit(float(literal)), F.schema_of_variant(found).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    else:
        a, b, fits = F.to_json(found), F.lit(json.dumps(literal, ensure_ascii=False)), F.lit(m[5] in ("==", "!="))
    return fits & {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[m[5]]


_TYPES = {"integer": "^BIGINT", "number": "^(BIGINT|DOUBLE|DECIMAL|FLOAT)", "string": "^STRING", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID"}


def schema_errors(body: Column, schema: dict) -> Column:
    """All failures of a JSON text against a JSON Schema document, as array of struct(instance_path, schema_path, keyword, message).

    The document is compiled to one Column: type, required, properties, enum, minimum, maximum, minLength, maxLength,
    pattern, minItems and maxItems; other keywords are refused. Text that is no JSON fails at the root."""
    checks: list[Column] = []

    def add(ok: Column, place: str, where: str, keyword: str, message: str) -> None:
        said = F.struct(*[F.lit(v).alias(k) for k, v in (("instance_path", place), ("schema_path", f"{where}/{keyword}"), ("keyword", keyword), ("message", message))])
        checks.append(F.when(~F.coalesce(ok, F.lit(True)), said))

    def visit(value: Column, doc: dict, place: str, where: str) -> None:
        kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
        number, is_number, is_text = F.try_variant_get(value, "$", "double"), kind.rlike(_TYPES["number"]), kind.rlike(_TYPES["string"])
        items = F.size(F.try_variant_get(value, "$", "array<variant>"))
        rules = {
            "type": lambda x: kind.rlike("|".join(_TYPES[t] for t in ([x] if isinstance(x, str) else x))),
            "enum": lambda x: F.to_json(value).isin([json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in x]),
            "minimum": lambda x: ~is_number | (number >= x), "maximum": lambda x: ~is_number | (number <= x),
            "minLength": lambda x: ~is_text | (F.length(text) >= x), "maxLength": lambda x: ~is_text | (F.length(text) <= x),
            "pattern": lambda x: ~is_text | text.rlike(x),
            "minItems": lambda x: ~kind.rlike("^ARRAY") | (items >= x), "maxItems": lambda x: ~kind.rlike("^ARRAY") | (items <= x),
        }
        for keyword, x in doc.items():
            if keyword in rules:
                add(value.isNull() | rules[keyword](x), place, where, keyword, f"{keyword}: {json.dumps(x)}")
            elif keyword == "required":
                for name in x:
                    add(~kind.rlike("^OBJECT") | F.variant_get(value, f"$['{name}']", "variant").isNotNull(), place, where, keyword, f'"{name}" is required')
            elif keyword == "properties":
                for name, inner in x.items():
                    visit(F.try_variant_get(value, f"$['{name}']", "variant"), inner, f"{place}/{name}", f"{where}/properties/{name}")
            elif keyword not in ("$schema", "$id", "title", "description", "default"):
                raise UnsupportedQuery(f"schema keyword {keyword}")

    root = F.try_parse_json(body)
    add(body.isNull() | root.isNotNull(), "", "", "type", "no JSON")
    visit(root, schema, "", "")
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validated(df: DataFrame, errors: Column, passthrough: bool = True) -> DataFrame:
    """df with validation_ok and validation_error; or, without passthrough, an error as soon as a row fails."""
    if passthrough:
        return df.withColumns({"validation_ok": F.size(errors) == 0, "validation_error": errors})
    return df.where(F.when(F.size(errors) > 0, F.raise_error(F.to_json(errors)).cast("boolean")).otherwise(True))
