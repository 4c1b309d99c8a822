"""Column expressions for terms: tokens, field and meta parts, numbers, quotes, entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of this many bytes or more are dropped.
MAX_WORD_BYTES = 64
TOKEN = r"([\p{L}\p{N}]+)"


def tokens(text: Column) -> Column:
    """The words of a text as an array, case kept, repeats included."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def legal(term: Column) -> Column:
    """A term is kept if it has 1 to 63 bytes."""
    return F.octet_length(term).between(1, MAX_WORD_BYTES - 1)


def tag_end(text: Column) -> Column:
    """Position (from 1) of the colon that ends a field tag, 0 if there is none; a colon behind `=` is no tag."""
    colon, equals = F.instr(text, ":"), F.instr(text, "=")
    return F.when((colon > 1) & ((equals == 0) | (colon < equals)), colon).otherwise(F.lit(0))


def field_of(text: Column) -> Column:
    return F.when(tag_end(text) > 0, F.substr(text, F.lit(1), tag_end(text) - 1))


def value_of(text: Column) -> Column:
    """The part behind the field tag, or the whole text."""
    return F.when(tag_end(text) > 0, F.substr(text, tag_end(text) + 1)).otherwise(text)


def before(text: Column, sign: str) -> Column:
    at = F.instr(text, sign)
    return F.when(at > 1, F.substr(text, F.lit(1), at - 1))


def after(text: Column, sign: str) -> Column:
    at = F.instr(text, sign)
    return F.when(at > 1, F.substr(text, at + 1))


def stored_number(value: Column) -> Column:
    """The number of a stored meta value: `-?digits` only, else null."""
    return F.when(value.rlike("^-?[0-9]+$"), value.try_cast("bigint"))


def bound_number(text: Column) -> Column:
    """The number of a range bound: leading digits with a sign; zero only if the text begins with 0, else null."""
    n = F.regexp_extract(text, "^[+-]?[0-9]+", 0).try_cast("bigint")
    return F.when((n != 0) | F.startswith(text, F.lit("0")), n)


def dequote(text: Column) -> Column:
    """One leading and one trailing quote character gone, whichever they are, then the blanks around."""
    return F.trim(F.regexp_replace(text, "^[\"'`]|[\"'`]$", ""))


def decode_entities(text: Column) -> Column:
    """The five XML entities; the ampersand last, so that nothing is decoded twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def encode_entities(text: Column) -> Column:
    """Ampersand, less-than and greater-than as entities."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def normalise_space(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def url_parameter(url: Column, name: str) -> Column:
    """The text behind the first `name=` after ? or &, up to the next & or #; empty if there is none."""
    return F.regexp_extract(url, f"[?&]{name}=([^&#]*)", 1)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in the inside of a tag, in double, single or no quotes; null if it is not there."""
    start = rf"(?is)(?:^|\s){name}\s*=\s*"
    value = F.coalesce(*[F.when(tag.rlike(start + own), F.regexp_extract(tag, start + own, 1)) for own in ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)")])
    return value


def xml_path(xml: Column, path: str) -> Column:
    """The text of the first element at a path /a/b/c, empty if there is none."""
    return F.coalesce(F.xpath_string(xml, F.lit(path)), F.lit(""))
