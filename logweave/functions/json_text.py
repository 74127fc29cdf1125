"""JSON texts as Spark expressions: leaves of any depth and Python's ``repr`` (no UDF).

A JSON text is cut into its tokens by one regular expression; a string token takes the colon behind it
along, so keys are told from values at any depth without recursion.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING = r'"(?:[^"\\]|\\.)*+"'
_LITERAL = r"-?[0-9][0-9.eE+-]*|true|false|null"
_KEYED = rf"{_STRING}(?:\s*:)?|{_LITERAL}"
_ALL = rf"{_STRING}|{_LITERAL}|[\[\]{{}},:]"


def _tokens(json: Column, pattern: str) -> Column:
    return F.regexp_extract_all(json, F.lit(pattern), F.lit(0))


def _unquoted(token: Column) -> Column:
    return F.element_at(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), 1)


def py_quoted(text: Column) -> Column:
    """``repr`` of a string: quotes, backslash and line breaks as Python shows them."""
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    single = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')),
                  F.concat(F.lit('"'), text, F.lit('"'))).otherwise(single)


def _named(token: Column) -> Column:
    """Python's names of the JSON literals."""
    return F.when(token == "true", "True").when(token == "false", "False").when(token == "null", "None").otherwise(token)


def json_leaves(json: Column) -> Column:
    """All values of lists and objects of any depth, in order, as ``str`` shows them; nulls left out."""
    values = F.filter(_tokens(json, _KEYED), lambda t: ~F.endswith(t, F.lit(":")) & (t != "null"))
    return F.transform(values, lambda t: F.when(F.startswith(t, F.lit('"')), _unquoted(t)).otherwise(_named(t)))


def py_repr(json: Column) -> Column:
    """``repr(json.loads(s))`` of a JSON text of any depth."""
    def shown(t: Column) -> Column:
        return (F.when(F.startswith(t, F.lit('"')), py_quoted(_unquoted(t)))
                .when(t == ",", ", ").when(t == ":", ": ").otherwise(_named(t)))
    return F.array_join(F.transform(_tokens(json, _ALL), shown), "")


def json_items(json: Column) -> Column:
    """``str`` of a list's items or an object's values, one level deep; empty and false ones left out.

    Strings are themselves, nested lists and objects their ``repr``.  Other JSON values have no items.
    """
    listed = F.from_json(json, "array<variant>")
    mapped = F.map_values(F.from_json(json, "map<string,variant>"))
    items = (F.when(F.startswith(F.ltrim(json), F.lit("[")), listed)
             .when(F.startswith(F.ltrim(json), F.lit("{")), mapped).otherwise(F.array().cast("array<variant>")))
    as_json = F.transform(items, lambda v: F.coalesce(F.to_json(v), F.lit("null")))
    true = F.filter(as_json, lambda j: ~j.isin("null", "false", "0", "0.0", '""', "[]", "{}"))
    return F.transform(true, lambda j: F.when(F.startswith(j, F.lit('"')), _unquoted(j)).otherwise(py_repr(j)))
