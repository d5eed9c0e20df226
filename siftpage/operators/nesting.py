"""The one pass that needs a stack: tag names and text lengths of a page -> its element list.

This is the only Python in the data path. It sees no text and no attributes, is linear in the
number of tokens and works on Arrow batches. The module is pickled by value, so executors need no
copy of the package.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Scripts and styles arrive as one token with their content, so they never stay open either.
VOID = frozenset(
    "area base br col embed hr img input link meta param script source style track wbr".split()
)
BLOCK = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split()
)
# tag -> (kinds it closes, kinds that stop the search)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
HEAD_TAGS = frozenset("html head title meta link base script style noscript template body".split())

NODE_FIELDS = (
    "eid", "src", "stop", "parent", "depth", "kids", "same_kids", "article_kids", "off", "len",
)
NODE_TYPE = T.ArrayType(T.StructType([T.StructField(name, T.IntegerType()) for name in NODE_FIELDS]))
TREE_TYPE = T.StructType(
    [T.StructField("nodes", NODE_TYPE), T.StructField("repairs", T.IntegerType())]
)


def _nest_page(codes: list[str], lengths: list[int], out: dict[str, list[int]]) -> int:
    """One page: append its elements to the flat ``out`` lists, return the number of repairs.

    ``codes`` holds ``div`` for a start tag, ``/div`` for an end tag and ``""`` for everything else.
    """
    first = len(out["src"])
    parent, depth, stop = out["parent"], out["depth"], out["stop"]
    kids, same, articles, ends = out["kids"], out["same_kids"], out["article_kids"], out["len"]
    stack: list[int] = []
    names: list[str] = []
    counts: list[dict[str, int]] = []
    places: dict[str, list[int]] = {}  # where in the stack the open elements of each name are
    chars = repairs = 0
    body = -1

    def open_node(name: str, src: int) -> int:
        nonlocal body
        node = len(out["src"])
        up = stack[-1] if stack else -1
        if name == "body" and body < 0:
            body, level = node, 0
        elif up >= 0 and depth[up] >= 0:
            level = depth[up] + 1
        else:
            level = -1
        if up >= 0:
            kids[up] += 1
            seen = counts[-1][name] = counts[-1].get(name, 0) + 1
            if seen > same[up]:
                same[up] = seen
            if name == "article":
                articles[up] += 1
        out["eid"].append(node - first)
        out["src"].append(src)
        parent.append(up - first if up >= 0 else -1)
        depth.append(level)
        stop.append(src + 1)
        for zero in (kids, same, articles, ends):
            zero.append(0)
        out["off"].append(chars)
        return node

    def push(name: str, node: int) -> None:
        stack.append(node)
        names.append(name)
        places.setdefault(name, []).append(len(stack) - 1)
        counts.append({})

    def cut(size: int, at: int) -> None:
        while len(stack) > size:
            node = stack.pop()
            places[names.pop()].pop()
            counts.pop()
            stop[node] = at
            ends[node] = chars - out["off"][node]

    def last(kinds) -> int:
        return max((places[k][-1] for k in kinds if places.get(k)), default=-1)

    def nearest(kinds, barriers=()) -> int:
        found = last(kinds)
        return found if found > last(barriers) else -1

    for at, code in enumerate(codes):
        if not code:
            if lengths[at]:
                if body < 0 and (not names or names[-1] == "html"):
                    push("body", open_node("body", -1))
                    repairs += 1
                chars += lengths[at]
        elif code[0] == "/":
            name = code[1:]
            if name in ("body", "html"):
                keep = nearest(("body",))
                if keep >= 0:
                    repairs += int(len(stack) > keep + 1)
                    cut(keep + 1, at)
                continue
            found = nearest((name,))
            if found < 0:
                repairs += 1
            else:
                repairs += len(stack) - found - 1
                cut(found, at)
        else:
            if body < 0 and code not in HEAD_TAGS:
                cut(1 if names[:1] == ["html"] else 0, at)
                push("body", open_node("body", -1))
                repairs += 1
            elif body < 0 and code == "body":
                cut(1 if names[:1] == ["html"] else 0, at)
            if code in CLOSES:
                found = nearest(*CLOSES[code])
                if found >= 0:
                    repairs += 1
                    cut(found, at)
            if code in BLOCK and names and names[-1] == "p":
                repairs += 1
                cut(len(stack) - 1, at)
            node = open_node(code, at)
            if code not in VOID:
                push(code, node)
    repairs += len(stack)
    cut(0, len(codes))
    return repairs


@F.arrow_udf(TREE_TYPE)
def nest(codes: pa.Array, lengths: pa.Array) -> pa.Array:
    """Tag names and text lengths of a batch of pages -> their element lists."""
    bounds = codes.offsets.to_pylist()
    flat_codes = codes.values.to_pylist()
    flat_lengths = lengths.values.to_pylist()
    out: dict[str, list[int]] = {name: [] for name in NODE_FIELDS}
    offsets, repairs = [0], []
    for a, b in zip(bounds, bounds[1:]):
        repairs.append(_nest_page(flat_codes[a:b], flat_lengths[a:b], out))
        offsets.append(len(out["src"]))
    nodes = pa.StructArray.from_arrays(
        [pa.array(out[name], pa.int32()) for name in NODE_FIELDS], list(NODE_FIELDS)
    )
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes)
    return pa.StructArray.from_arrays(
        [lists, pa.array(repairs, pa.int32())], ["nodes", "repairs"]
    )


# Marked nondeterministic only to keep the optimizer from moving filters over parsed columns below
# the parse, where it would have to repeat the whole tokenisation inside them.
nest = nest.asNondeterministic()
