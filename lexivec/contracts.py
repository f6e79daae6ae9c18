"""JSON contracts compiled into expressions: the errors of each body, worked out where the rows lie.

A contract is a JSON Schema of ``type``, ``enum``, ``minimum``, ``maximum``, ``minLength``, ``maxLength``, ``required``, ``properties``,
``additionalProperties`` (false closes an object; a schema is that of all other fields) and ``items``. Other keywords are refused, so none is silently passed over.
A body that isn't JSON has one error; a null body isn't JSON.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The query call's request.
QUERY_REQUEST = {
    "type": "object",
    "required": ["query"],
    "additionalProperties": False,
    "properties": {
        "query": {"type": "string"},
        "top_k": {"type": "integer", "minimum": 0},
        "rewrite_strategies": {"type": "array", "items": {"type": "string", "enum": ["passthrough", "multi_query", "hyde", "step_back", "entity_expand"]}},
        "filters": {"type": "object"},
        "use_graph": {"type": "boolean"},
        "stream": {"type": "boolean"},
    },
}
KEYWORDS = {"type", "enum", "minimum", "maximum", "minLength", "maxLength", "required", "properties", "additionalProperties", "items", "title", "description", "default", "$schema", "$id"}
#: How the kinds of JSON values are told from a variant's own type.
_KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"}


def _if(fails: Column, message: Column | str) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(fails, F.lit(False)), F.array(F.lit(message) if isinstance(message, str) else message)).otherwise(none)


def _at(path: Column, key: str) -> Column:
    return F.when(path == "", F.lit(key)).otherwise(F.concat(path, F.lit(f".{key}")))


def _said(path: Column, what: str) -> Column:
    return F.concat(F.when(path == "", F.lit("body")).otherwise(path), F.lit(f": {what}"))


def _is(value: Column, kind: str) -> Column:
    if kind == "integer":
        number = F.try_variant_get(value, "$", "double")
        return _is(value, "number") & (number == F.floor(number))
    return F.schema_of_variant(value).rlike(_KINDS[kind])


def _errors(contract: dict, value: Column, path: Column) -> Column:
    """The errors of a variant, in the order of the contract; a value of another type has that error alone."""
    if unknown := set(contract) - KEYWORDS:
        raise ValueError(f"no keyword of a contract here: {', '.join(sorted(unknown))}")
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    kinds = contract.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    fits = reduce(lambda a, b: a | b, [_is(value, k) for k in kinds]) if kinds else F.lit(True)
    found = []
    if "enum" in contract:
        found.append(_if(~text.isin([str(x) for x in contract["enum"]]), _said(path, f"one of {', '.join(map(str, contract['enum']))} required")))
    numeric, is_text = _is(value, "number"), _is(value, "string")
    bounds: dict[str, tuple[Column, Callable[[float], str]]] = {
        "minimum": (numeric & (number < contract.get("minimum", 0)), lambda n: f"at least {n} required"),
        "maximum": (numeric & (number > contract.get("maximum", 0)), lambda n: f"at most {n} allowed"),
        "minLength": (is_text & (F.length(text) < contract.get("minLength", 0)), lambda n: f"at least {n} characters required"),
        "maxLength": (is_text & (F.length(text) > contract.get("maxLength", 0)), lambda n: f"at most {n} characters allowed"),
    }
    found += [_if(fails, _said(path, said(contract[name]))) for name, (fails, said) in bounds.items() if name in contract]
    fields, closed = contract.get("properties", {}), contract.get("additionalProperties", True)
    if fields or contract.get("required") or closed is not True:
        keys = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))
        is_object = _is(value, "object")
        found += [_if(is_object & ~F.array_contains(keys, k), _said(_at(path, k), "field required")) for k in contract.get("required", [])]
        for k, own in fields.items():
            field = F.try_variant_get(value, f'$["{k}"]', "variant")
            found.append(F.when(is_object & F.array_contains(keys, k), _errors(own, field, _at(path, k))).otherwise(F.array().cast("array<string>")))
        others = F.filter(keys, lambda k: ~k.isin([*fields])) if fields else keys
        if closed is False:
            found.append(F.when(is_object, F.transform(F.array_sort(others), lambda k: F.concat(F.when(path == "", k).otherwise(F.concat(path, F.lit("."), k)), F.lit(": unknown field")))).otherwise(F.array().cast("array<string>")))
        elif isinstance(closed, dict):
            values = F.try_variant_get(value, "$", "map<string,variant>")
            rest = F.map_entries(F.map_filter(values, lambda k, _: ~k.isin([*fields]) if fields else F.lit(True)))
            each = F.transform(F.array_sort(F.transform(rest, lambda e: e["key"])), lambda k: _errors(closed, F.element_at(values, k), F.when(path == "", k).otherwise(F.concat(path, F.lit("."), k))))
            found.append(F.coalesce(F.flatten(each), F.array().cast("array<string>")))
    if "items" in contract:
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda e, i: _errors(contract["items"], e, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.coalesce(F.flatten(each), F.array().cast("array<string>")))
    inner = F.concat(*found) if found else F.array().cast("array<string>")
    return F.when(~fits, F.array(_said(path, f"{' or '.join(kinds)} required"))).otherwise(inner) if kinds else inner


def errors(contract: dict, body: Column) -> Column:
    """What is wrong with a JSON text by a contract, as messages; none if nothing is."""
    parsed = F.try_parse_json(body)
    return F.when(parsed.isNull(), F.array(F.lit("body: not JSON"))).otherwise(_errors(contract, parsed, F.lit("")))
