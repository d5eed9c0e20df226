"""HTML as tables: tokens, elements, page text.

A page stays one row from raw HTML to the last feature. The tokeniser, entity decoding, attribute
maps and texts are built-in expressions; only the nesting of tags needs a pass with a stack, and
that pass (``nest``) is an Arrow UDF that sees nothing but tag names and text lengths. There is no
shuffle, so a page is never grouped and no page can make a hot key.

Tree contract: void elements never open; ``li``, ``dt/dd``, ``tr``, ``td/th`` and ``option`` close
an open one of their kind up to the nearest enclosing list or table; a block-level start closes a
``p`` that is the current node; an end tag pops to the nearest open element of its name and is
ignored if there is none; ``</body>`` and ``</html>`` close what is inside the body but not the
body; a page without ``<body>`` gets one at its first content; the end of input closes everything.
``repairs`` counts how often one of the repair rules was used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpage.functions.entities import decode_entities
from siftpage.functions.jsonld import all_types
from siftpage.functions.reuse import built_once
from siftpage.functions.text import BLANK_CLASS, strip
from siftpage.operators.nesting import NODE_FIELDS, nest

#: A page with fewer words has nothing to say but a notice.
BRIEF_WORDS = 60
BREAK = "<!>"  # stands where code was, so that the texts around it stay two texts
INSIDE = r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+>"  # of a tag, quoted values included


def _token(*units: str) -> str:
    """Pattern of one token. Elements named in ``units`` are one token with all their content.

    Comments and quoted values come first, so that code is only seen where it really begins.
    """
    whole = "".join(rf"|<{u}(?=[\s/>]){INSIDE}.*?(?:</{u}\s*>|\z)" for u in units)
    return (
        r"(?is)<!--.*?(?:-->|\z)"
        + whole
        + rf"|</?[a-z]{INSIDE}"
        + r"|<[!?/][^>]*+>"
        + r"|(?:[^<]++|<(?![a-z/!?]))++"
        + r"|<.*+"
    )


TOKEN = _token("script", "style")
TOKEN_NO_CODE = _token("script", "style", "noscript")
TOKEN_VISIBLE = _token("script", "style", "noscript", "svg")
IS_CODE = r"(?i)^<(?:script|style|noscript)(?=[\s/>])"
ATTRIBUTE = r"([^\s\"'<>/=][^\s\"'>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?"

def is_code(raw: Column) -> Column:
    """Is the token a script, style or noscript element?"""
    return F.rlike(raw, F.lit(IS_CODE))


def raw_tokens(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(0))


@built_once
def token_list(column: str) -> Column:
    """array<struct<raw, code, text>> of a column of raw tokens, in document order."""

    def describe(raw: Column) -> Column:
        is_markup = F.rlike(raw, F.lit("^<[a-zA-Z/!?]"))
        name = F.lower(F.regexp_extract(raw, r"^<(/?[a-zA-Z][^\s/>]*)", 1))
        return F.struct(
            raw.alias("raw"),
            F.when(is_markup, name).otherwise("").alias("code"),
            F.when(~is_markup, strip(decode_entities(raw))).otherwise("").alias("text"),
        )

    return F.transform(column, describe)


def without_code(column: str) -> Column:
    """A column of raw tokens with a break mark in the place of each piece of code."""
    return F.transform(column, lambda raw: F.when(is_code(raw), F.lit(BREAK)).otherwise(raw))


def attribute_maps(tags: Column) -> Column:
    """Attribute map of each raw start tag; names lower-cased, the first of equal names wins."""

    def pairs(tag: Column) -> Column:
        def group(i: int) -> Column:
            return F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(i))

        quoted = F.zip_with(group(2), group(3), lambda a, b: F.concat(a, b))
        values = F.zip_with(quoted, group(4), lambda a, b: decode_entities(F.concat(a, b)))
        return F.when(
            F.rlike(tag, F.lit(r"[^\s/>]")),
            F.zip_with(
                group(1), values, lambda k, v: F.struct(F.lower(k).alias("k"), v.alias("v"))
            ),
        ).otherwise(F.array().cast("array<struct<k:string,v:string>>"))

    def to_map(entries: Column) -> Column:
        names = entries["k"]
        first = F.filter(entries, lambda p, i: F.array_position(names, p["k"]) == i + 1)
        unique = F.size(F.array_distinct(names)) == F.size(names)
        return F.map_from_entries(F.when(unique, entries).otherwise(first))

    bare = F.transform(tags, lambda tag: F.regexp_replace(tag, r"^<[^\s/>]+|>$", ""))
    return F.transform(F.transform(bare, pairs), to_map)


def parse(pages: DataFrame, jsonld: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page with everything later operators read; the HTML itself is left behind.

    Columns: page_id, url, clean_len, body, joined, texts, nodes, repairs (+ ``keep``).
    ``nodes`` is an array of element structs in document order.
    With ``jsonld`` the JSON-LD script texts of the page are kept as ``jsonld`` (else an empty list).
    """
    pages = pages.withColumn("html", F.coalesce("html", F.lit("")))
    nothing = F.array().cast("array<string>")
    blocks = jsonld_blocks(F.col("raw")) if jsonld else nothing
    staged = (
        pages.select("page_id", "url", "html", *keep, raw_tokens(F.col("html"), TOKEN_NO_CODE).alias("raw"))
        .select(
            "page_id",
            "url",
            *keep,
            (F.col("html") == "").alias("x_empty"),
            (~F.rlike("html", F.lit(r"(?U)\S"))).alias("x_blank"),
            (
                F.length("html")
                - F.aggregate(
                    F.filter("raw", is_code), F.lit(0), lambda total, raw: total + F.length(raw)
                )
            ).alias("clean_len"),
            blocks.alias("jsonld"),
            without_code("raw").alias("kept"),
        )
        .withColumn("tokens", token_list("kept"))
        .withColumn("jsonld_types", all_types(F.col("jsonld")) if jsonld else nothing)
        .drop("kept")
    )
    return _with_nodes(staged)


def parse_raw(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """As ``parse`` but over the un-stripped page, noscript parts included (for the snapshot)."""
    staged = pages.select(
        "page_id",
        "url",
        *keep,
        F.length("html").alias("html_length"),
        raw_tokens(F.col("html"), TOKEN).alias("raw"),
        page_words(F.col("html")).alias("visible"),
    ).withColumn("jsonld", jsonld_blocks(F.col("raw")))
    typed = staged.withColumn("jsonld_types", all_types(F.col("jsonld")))
    return _with_nodes(typed.withColumn("tokens", token_list("raw")).drop("raw"))


@built_once
def nested_tags() -> Column:
    return nest(F.col("tokens.code"), F.transform("tokens", lambda t: F.length(t["text"])))


@built_once
def element_list() -> Column:
    """The nested tags with their names and attributes."""

    def token(node: Column) -> Column:
        return F.try_element_at(F.col("tokens"), node["src"] + 1)

    def element(node: Column, attrs: Column) -> Column:
        tag = F.when(node["src"] < 0, F.lit("body")).otherwise(token(node)["code"])
        fields = [node[name].alias(name) for name in NODE_FIELDS]
        return F.struct(*fields, tag.alias("tag"), attrs.alias("attrs"))

    tags = F.transform(
        "tree.nodes", lambda n: F.when(n["src"] < 0, F.lit("<body>")).otherwise(token(n)["raw"])
    )
    return F.zip_with("tree.nodes", attribute_maps(tags), element)


def _with_nodes(staged: DataFrame) -> DataFrame:
    nested = staged.withColumn("tree", nested_tags())
    filled = F.filter("tokens.text", lambda t: t != "")
    others = [c for c in staged.columns if c != "tokens"]
    return nested.select(
        *others,
        F.col("tokens.text").alias("texts"),
        F.array_join(filled, " ").alias("body"),
        F.array_join(filled, "").alias("joined"),
        element_list().alias("nodes"),
        F.col("tree.repairs").alias("repairs"),
    )


def jsonld_blocks(raw: Column) -> Column:
    """Contents of the JSON-LD scripts among raw tokens, in order.

    A script in a comment or in an attribute's value is no token, so it is not seen; one inside a token
    of a whole noscript element is.
    """
    block = (
        r"(?is)^<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)"
        r"(?:</script\s*>|\z)"
    )
    known = F.filter(raw, lambda t: F.contains(t, F.lit("ld+json")) & is_code(t))
    inside = F.transform(
        known,
        lambda t: F.when(
            F.rlike(t, F.lit(r"(?i)^<noscript(?=[\s/>])")),
            raw_tokens(F.regexp_replace(t, rf"(?is)^<noscript(?=[\s/>]){INSIDE}", ""), TOKEN),
        ).otherwise(F.array(t)),
    )
    scripts = F.filter(F.flatten(inside), lambda t: F.rlike(t, F.lit(block)))
    return F.transform(scripts, lambda t: F.regexp_extract(t, block, 1))


def page_words(html: Column) -> Column:
    """Visible text without svg, blanks collapsed."""
    texts = F.transform(
        raw_tokens(html, TOKEN_VISIBLE),
        lambda raw: F.when(
            F.rlike(raw, F.lit("^<[a-zA-Z/!?]")), F.lit("")
        ).otherwise(strip(decode_entities(raw))),
    )
    joined = F.array_join(F.filter(texts, lambda t: t != ""), " ")
    return F.regexp_replace(joined, f"[{BLANK_CLASS}]+", " ")


# ---- per-page helpers over the parsed row ---------------------------------------------------


def inner_texts(node: Column) -> Column:
    size = F.greatest(node["stop"] - node["src"] - 1, F.lit(0))
    return F.slice(F.col("texts"), node["src"] + 2, size)


def text_of(node: Column) -> Column:
    """Element text, its text nodes run together."""
    return F.array_join(inner_texts(node), "")


def spaced_text_of(node: Column) -> Column:
    """Element text with single spaces between its text nodes."""
    return F.array_join(F.filter(inner_texts(node), lambda t: t != ""), " ")


def attr(node: Column, name: str) -> Column:
    return node["attrs"][name]


def has_attr(node: Column, name: str) -> Column:
    return F.map_contains_key(node["attrs"], name)


def nodes_of(*tags: str) -> Column:
    return F.filter("nodes", lambda e: e["tag"].isin(*tags))


def first_of(*tags: str) -> Column:
    """First element of one of the kinds in document order; null when there is none."""
    return F.try_element_at(nodes_of(*tags), F.lit(1))


def page_title() -> Column:
    """Text of the first title element, '' when missing or not plain text."""
    title = first_of("title")
    return F.coalesce(F.when(title["kids"] == 0, spaced_text_of(title)), F.lit(""))


def notice() -> Column:
    """What a page says first of all, lower-cased: title, headings of the upper three levels, and all
    its text if it has next to none. ``own_title``, ``body`` and ``nodes`` are read."""
    headings = F.array_join(F.transform(nodes_of("h1", "h2", "h3"), text_of), " ")
    # reads no further than the last of so many words
    enough = F.rlike("body", F.lit(rf"^\s*+(?:\S++\s++){{{BRIEF_WORDS - 1}}}\S"))
    brief = F.when(~enough, F.concat(F.lit(" "), F.col("body")))
    return F.lower(F.concat("own_title", F.lit(" "), headings, F.coalesce(brief, F.lit(""))))


def carries(marks: tuple[str, ...], names: tuple[str, ...] = ("id", "class", "name", "action")) -> Column:
    """Does an element have one of the marks in one of the named attributes?"""
    values = F.transform(
        "nodes", lambda e: F.lower(F.concat_ws(" ", *(attr(e, n) for n in names)))
    )
    pattern = "|".join(m.replace(".", r"\.") for m in marks)
    return F.exists(values, lambda v: F.rlike(v, F.lit(pattern)))


def exploded(df: DataFrame, array: str, position: str, item: str) -> DataFrame:
    """One row per array item.

    The outer form plus a filter on the position: for the plain form the optimizer first filters on
    the size of the array, which makes it compute the array twice.
    """
    others = [c for c in df.columns if c != array]
    rows = df.select(*others, F.posexplode_outer(array).alias(position, item))
    return rows.filter(F.col(position).isNotNull())


# ---- public tables --------------------------------------------------------------------------


def tokens(pages: DataFrame) -> DataFrame:
    """page_id, pos, kind (start, end, text, other), tag, raw - code removed, one row per token."""
    cut = pages.select("page_id", raw_tokens(F.col("html"), TOKEN_NO_CODE).alias("raw"))
    clean = cut.select("page_id", without_code("raw").alias("kept"))
    listed = clean.select("page_id", token_list("kept").alias("tokens"))
    rows = exploded(listed, "tokens", "pos", "t")
    kind = (
        F.when(F.startswith("t.code", F.lit("/")), "end")
        .when(F.col("t.code") != "", "start")
        .when(F.rlike("t.raw", F.lit("^<[a-zA-Z/!?]")), "other")
        .otherwise("text")
    )
    return rows.select(
        "page_id",
        "pos",
        kind.alias("kind"),
        F.regexp_replace("t.code", "^/", "").alias("tag"),
        F.col("t.raw").alias("raw"),
    )


def elements(pages: DataFrame, raw: bool = False) -> DataFrame:
    """One row per element: eid, parent_eid, start and stop (of its tokens), tag, depth under body, child
    counts, text, attributes. With ``raw`` of the page as it is, noscript parts included."""
    parsed = parse_raw(pages) if raw else parse(pages)
    rows = exploded(parsed.select("page_id", "joined", "nodes"), "nodes", "eid", "e")
    e = F.col("e")
    return rows.select(
        "page_id",
        "eid",
        F.when(e["parent"] >= 0, e["parent"]).alias("parent_eid"),
        e["src"].alias("start"),
        e["stop"].alias("stop"),
        e["tag"].alias("tag"),
        F.when(e["depth"] >= 0, e["depth"]).alias("depth"),
        e["kids"].alias("child_count"),
        e["attrs"].alias("attrs"),
        e["off"].alias("text_off"),
        e["len"].alias("text_len"),
        F.substring(F.col("joined"), e["off"] + 1, e["len"]).alias("text"),
    )


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, title, body (texts parted by spaces) and joined (texts run together)."""
    return parse(pages).select("page_id", page_title().alias("title"), "body", "joined", "repairs")
