"""schema.org types in JSON-LD blocks and microdata.

Blocks are kept as VARIANT. The list of their types goes by the order of the document (the first that a
rule knows decides), which VARIANT does not keep: it sorts an object's keys. So that one walk is Python over
the text; only pages read with JSON-LD take it.
"""

from __future__ import annotations

import json
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def parsed_blocks(blocks: Column) -> Column:
    """The blocks that are JSON, as an array of VARIANT: paths into them need no second parse."""
    return F.filter(F.transform(blocks, lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())


def types_of(text: str) -> list[str]:
    """Every ``@type`` of one block: an object's own before those inside it; none of broken JSON."""
    try:
        todo = [json.loads(text)]
    except (ValueError, RecursionError):
        return []
    found: list[str] = []
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            kinds = value.get("@type", [])
            kinds = kinds if isinstance(kinds, list) else [kinds]
            found += [k for k in kinds if isinstance(k, str) and k]
            todo += reversed([v for k, v in value.items() if k != "@type"])
        elif isinstance(value, list):
            todo += reversed(value)
    return found


@F.arrow_udf(T.ArrayType(T.StringType()))
def all_types(blocks: pa.Array) -> pa.Array:
    """Every ``@type`` of a page's JSON-LD blocks at any depth, in the order in which a walk meets them."""
    pages = blocks.to_pylist()
    return pa.array([[t for b in page or [] for t in types_of(b)] for page in pages], pa.list_(pa.string()))


def top_types(blocks: Column) -> Column:
    """``@type`` of the top-level object or of each object of a top-level array; '' if missing."""

    def of_item(item: Column) -> Column:
        value = F.coalesce(F.get_json_object(item, "$.@type"), F.lit(""))
        many = F.from_json(value, "array<string>")
        return F.when(F.startswith(value, F.lit("[")), many).otherwise(F.array(value))

    def of_block(block: Column) -> Column:
        text = F.when(F.trim(block) == "", F.lit("{}")).otherwise(F.trim(block))
        items = F.when(
            F.startswith(text, F.lit("[")), F.from_json(text, "array<string>")
        ).otherwise(F.array(text))
        return F.flatten(F.transform(items, of_item))

    return F.flatten(
        F.transform(
            F.filter(blocks, lambda b: (F.trim(b) == "") | F.try_parse_json(b).isNotNull()),
            of_block,
        )
    )


def lowered(types: Column) -> Column:
    return F.transform(types, lambda t: F.lower(F.trim(t)))


def microdata_type(itemtype: Column) -> Column:
    """Last path segment of an itemtype value."""
    path = F.regexp_replace(F.lower(itemtype), "/+$", "")
    return F.trim(F.regexp_extract(path, "([^/]*)$", 1))
