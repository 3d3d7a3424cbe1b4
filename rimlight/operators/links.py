"""Link catalogue of HTML pages."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# An attribute: a name, and a value in quotes or up to white space or the tag's end.
_ATTRIBUTE = r"""=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
# What follows a tag's name; a tag that does not end takes the rest of the page, so no part is read twice.
_REST = rf"(?:[\s/]++|{_ATTRIBUTE}|=)*+(?:>|\z)"
# Markup in the order of the page: comments, elements whose content is text, and tags; what lies inside one is none.
_TEXT_ONLY = "script|style|textarea|title|xmp|iframe|noembed|noframes"
TOKEN = rf"(?is)<!--.*?(?:--!?>|\z)|<({_TEXT_ONLY})(?=[\s/>]){_REST}.*?(?:</\1(?=[\s/>]){_REST}|\z)|</?[a-z][^\s/>]*+{_REST}"
ANCHOR = r"(?is)^<a[\s/>].*>$"
HREF = r"(?is)^href(?:\s*=\s*(.*))?$"

_NUMERIC = r"^#(?:[xX]([0-9a-fA-F]++)|([0-9]++));?"
_NAMED = r"^([a-zA-Z][a-zA-Z0-9]*+;?)"
_UNKNOWN = "\ufffd"


def _reference_table() -> Column:
    """Named character references of the HTML standard, as Python has them; those with no semicolon end with none."""
    return F.from_json(F.lit(json.dumps(html5)), "map<string,string>")


def _control_table() -> Column:
    """What numbers 128 to 159 stand for: the Windows characters of these bytes, where there are some."""
    pairs = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
    return F.from_json(F.lit(json.dumps({str(n): c for n, c in pairs.items() if c})), "map<string,string>")


def _character(piece: Column) -> Column:
    """The character of the numeric reference that ``piece`` begins with, without its ampersand."""
    # numbers of more digits than any character has are cut to some that none has
    hexed, digits = (F.left(F.ltrim(F.regexp_extract(piece, _NUMERIC, n), F.lit("0")), F.lit(8)) for n in (1, 2))
    code = F.when(piece.rlike("^#[xX]"), F.coalesce(F.conv(hexed, 16, 10).try_cast("bigint"), F.lit(0))).otherwise(
        F.coalesce(digits.try_cast("bigint"), F.lit(0))
    )
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    place = F.when(valid, F.hex(code)).otherwise(F.lit("FFFD"))
    plain = F.decode(F.unhex(F.lpad(place, 8, "0")), "UTF-32")
    return F.coalesce(F.when(code.between(128, 159), F.get(F.array(F.try_element_at(_control_table(), code.cast("string"))), 0)), plain)


def _decoded(piece: Column) -> Column:
    """The text after an ampersand, which may begin with a reference."""
    name = F.regexp_extract(piece, _NAMED, 1)
    after = F.substring(piece, F.length(name) + 1, F.length(piece))
    # without a semicolon, and before a letter, digit or equals sign, it is none in an attribute
    ends = name.endswith(";") | ~after.startswith("=")
    meant = F.when((name != "") & ends, F.try_element_at(_reference_table(), name))
    return (
        F.when(piece.rlike(_NUMERIC), F.concat(_character(piece), F.regexp_replace(piece, _NUMERIC, "")))
        .when(meant.isNotNull(), F.concat(meant, after))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def unescape(text: Column) -> Column:
    """An attribute's value with its character references decoded, each once, from left to right."""
    pieces = F.split(text, "&", -1)
    rest = F.transform(F.slice(pieces, 2, F.size(pieces)), _decoded)
    return F.when(text.contains("&"), F.concat(F.get(pieces, 0), F.array_join(rest, ""))).otherwise(text)


def extract_links(
    pages: DataFrame,
    contains: str = "",
    drop: str = "",
    prefix: str = "",
    extension: str = "",
    keys: tuple[str, ...] = ("page_id",),
) -> DataFrame:
    """One row per ``<a href>`` whose address contains ``contains``. Narrow, whole pages.

    Columns: the keys, ``link_pos`` (position among the page's anchors), ``href``, ``url``
    (``prefix`` + address without ``drop``) and ``base_name`` (last path part before ``extension``). A page is read
    tag by tag, so what stands in comments, scripts, text fields or the values of attributes is no link; of
    repeated attributes the first counts, as in a browser.
    """
    tokens = F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))
    tags = pages.select(*keys, F.posexplode(F.filter(tokens, lambda t: t.rlike(ANCHOR))).alias("link_pos", "tag"))
    attributes = F.regexp_extract_all(F.substring("tag", 3, 1 << 30), F.lit(_ATTRIBUTE), F.lit(0))
    given = F.get(F.filter(attributes, lambda a: a.rlike(HREF)), 0)
    value = F.regexp_extract(given, HREF, 1)
    bare = F.when(value.rlike("^[\"']"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    links = tags.select(*keys, "link_pos", given.alias("given"), bare.alias("href")).where("given is not null")
    links = links.select(*keys, "link_pos", unescape(F.col("href")).alias("href"))
    if contains:
        links = links.where(F.col("href").contains(contains))
    path = F.replace(F.col("href"), F.lit(drop), F.lit("")) if drop else F.col("href")
    links = links.withColumn("url", F.concat(F.lit(prefix), path))
    stem = F.element_at(F.split("url", _literal(extension)), 1) if extension else F.col("url")
    return links.withColumn("base_name", F.element_at(F.split(stem, "/"), -1))


def _literal(text: str) -> str:
    """``text`` as a regular expression that matches just it."""
    return r"\Q" + text + r"\E"
