"""JSON path functions with the SQL standard's behaviours, from Spark's JSON and variant functions.

Spark's parser stops after the first JSON value of a text; what follows it is not seen."""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What json_query may return instead of a value: fixed values of the standard
BEHAVIOURS = {"NULL": None, "EMPTY ARRAY": "[]", "EMPTY OBJECT": "{}"}


#: kinds that json_value does not return
NO_SCALAR = ("OBJECT", "ARRAY", "VOID", "MISSING", "BAD")


def normal_path(path: str) -> str:
    """The path with double-quoted keys as single-quoted ones, which Spark reads."""
    return re.sub(r'\["([^"\]]*)"\]', r"['\1']", path)


class Found(NamedTuple):
    """What is at a path: its kind, and its text where there is a value."""

    kind: Column
    text: Column


def look_up(df: DataFrame, json: str, *paths: str) -> tuple[DataFrame, dict[str, Found]]:
    """``df`` with columns that hold what is at the paths in the texts of the column ``json``, and these by path, to be
    given to the functions below as ``found``.  A text is parsed once, a path followed once a row, and both are read once."""
    value, kinds, texts = f"_{json}_value", {p: f"_{json}_kind{k}" for k, p in enumerate(paths)}, {p: f"_{json}_text{k}" for k, p in enumerate(paths)}
    df = df.withColumn(value, F.try_parse_json(json))
    # A projection for each step: what one makes by much work and the next reads more than once is not made again.
    df = df.withColumns({kinds[p]: _kind(F.col(json), normal_path(p), F.col(value)) for p in paths})
    df = df.withColumns({texts[p]: F.when(~F.col(kinds[p]).isin("VOID", "MISSING", "BAD"), F.get_json_object(json, normal_path(p))) for p in paths})
    return df, {p: Found(F.col(kinds[p]), F.col(texts[p])) for p in paths}


def _found(json: Column, path: str, found: Found | None) -> Found:
    return found or Found(_kind(json, path, F.try_parse_json(json)), F.get_json_object(json, path))


def _kind(json: Column, path: str, value: Column) -> Column:
    """OBJECT<..>, ARRAY<..>, a scalar type, VOID for JSON null, MISSING where nothing is found, BAD for text
    that is no JSON, or NULL for NULL."""
    found = F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit("MISSING"))
    return F.when(value.isNotNull(), found).when(json.isNotNull(), F.lit("BAD"))


def _is(kind: Column, *starts: str) -> Column:
    return reduce(lambda a, b: a | b, (kind.startswith(s) for s in starts))


def json_value(json: Column, path: str, found: Found | None = None) -> Column:
    """The scalar at ``path`` as text; NULL for what is missing, null, an object or an array."""
    kind, text = _found(json, normal_path(path), found)
    return F.when(~_is(kind, *NO_SCALAR), text)


def json_value_on(json: Column, path: str | None, on_empty: str = "NULL", on_error: str = "NULL", empty_default: str | None = None, error_default: str | None = None, found: Found | None = None) -> Column:
    """``json_value`` with NULL, ERROR or DEFAULT behaviour on empty and on error.

    Errors are null input, text that is no JSON, and a path that does not begin
    with ``$.`` or ``$[``; a missing value, JSON null, an object or an array is empty."""

    def instead(behaviour: str, default: str | None, what: str) -> Column:
        if behaviour == "ERROR":
            return F.raise_error(F.lit(f"json_value: {what}")).cast("string")
        return F.lit(default if behaviour == "DEFAULT" else None).cast("string")

    failed = instead(on_error, error_default, "error")
    if path is None or not re.match(r"\$[.\[]", path):
        return failed
    empty = instead(on_empty, empty_default, "empty")
    kind, text = _found(json, normal_path(path), found)
    return F.when(kind.isNull() | (kind == "BAD"), failed).when(_is(kind, *NO_SCALAR), empty).otherwise(text)


def json_query(json: Column, path: str | None, wrapper: str = "WITHOUT", on_empty: str = "NULL", on_error: str = "NULL", found: Found | None = None) -> Column:
    """The object or array at ``path`` as text.

    wrapper is WITHOUT, CONDITIONAL (all but arrays are wrapped in an array) or
    UNCONDITIONAL; the behaviours are NULL, EMPTY ARRAY, EMPTY OBJECT and ERROR.  A path
    may begin with ``lax`` (the default: what is not found or no container is empty) or
    ``strict`` (it is an error)."""

    def instead(behaviour: str, what: str) -> Column:
        if behaviour == "ERROR":
            return F.raise_error(F.lit(f"json_query: {what}")).cast("string")
        return F.lit(BEHAVIOURS[behaviour]).cast("string")

    if path is None:
        return F.lit(None).cast("string")
    mode, _, bare = path.partition(" ") if re.match(r"(lax|strict) ", path) else ("lax", "", path)
    empty, failed = instead(on_empty, "empty"), instead(on_error, "error")
    if not bare.startswith("$"):
        return F.when(json.isNotNull(), failed)
    missing = failed if mode == "strict" else empty

    kind, text = _found(json, normal_path(bare), found)
    # No branch is true where the kind is NULL, and the text is NULL there as well.  Few and flat branches, as generated
    # methods of more than 8000 bytes are not compiled by the JVM.
    if wrapper not in ("CONDITIONAL", "UNCONDITIONAL"):
        return F.when(_is(kind, "OBJECT", "ARRAY"), text).when(kind == "BAD", failed).when(kind == "VOID", empty).when(kind.isNotNull(), missing)
    wrapped = F.when(kind == "BAD", failed).when(kind == "MISSING", missing).when(kind == "VOID", F.lit("[null]"))
    if wrapper == "CONDITIONAL":
        wrapped = wrapped.when(_is(kind, "ARRAY"), text)
    # get_json_object takes the quotes off a string; to_json puts them on again.
    return wrapped.when(kind == "STRING", F.to_json(F.array(text))).otherwise(F.concat(F.lit("["), text, F.lit("]")))


def json_split(json: Column) -> Column:
    """The elements of a JSON array, joined by CR LF; NULL for anything else.  Single quotes are read too."""
    return F.when(F.ltrim(json).startswith("["), F.array_join(F.from_json(json, "array<string>"), "\r\n"))
