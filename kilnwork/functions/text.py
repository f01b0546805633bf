"""String normalisation, identities and parsing, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that stand for a missing observation (fixed values).
EMPTY_VALUES = ["", "-", "--", "?", "N/A", "NA", "NONE", "NULL", "UNKNOWN", "*", "**"]
#: Extensions that a card's name may lose (fixed values).
CARD_EXTENSIONS = "png|jpe?g"


def clean_text(c: Column) -> Column:
    """Null, not-a-number, nan and None become the empty string; other text stays as it is."""
    t = c.cast("string")
    return F.when(t.isNull() | t.isin("nan", "NaN", "None"), F.lit("")).otherwise(t)


def strip_edges(c: Column, chars: str = r".,;:()\[\]") -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def normalize_number(c: Column) -> Column:
    """A printed item number: without ``no.``, white space, edge punctuation and leading zeros; other text is left as it is."""
    t = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    t = F.regexp_replace(F.regexp_replace(t, r"^no\.?\s*", ""), r"\s+", "")
    t = strip_edges(t)
    return F.when(t.rlike(r"^0*\d+[a-z]?$"), F.regexp_replace(t, r"^0+(?=\d)", "")).otherwise(t)


def is_positive_number(c: Column) -> Column:
    """Whether a normalised number has digits above zero and at most one letter."""
    return c.rlike(r"^\d+[a-z]?$") & ~c.rlike(r"^0+[a-z]?$")


def normalize_figure(c: Column) -> Column:
    """A figure's id from running text: after figure, fig, abb, tav, plate or pl if there, separators as dots, lower case."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    found = F.regexp_extract(t, r"(?i)\b(?:figure|fig\.?|abb\.?|tav\.?|plate|pl\.?)\s*([a-z]?\d+(?:[.:-]\d+)*[a-z]?)", 1)
    t = F.regexp_replace(strip_edges(F.trim(F.when(found != "", found).otherwise(t))), r"\s+", "")
    return F.lower(F.regexp_replace(t, "[:-]", "."))


def strict_figure(c: Column) -> Column:
    """As ``normalize_figure``, blank unless digits with at most one letter at either end."""
    t = normalize_figure(c)
    return F.when(t.rlike(r"^[a-z]?\d+(\.\d+)*[a-z]?$"), t).otherwise("")


#: A caption's beginning and the rest of its line (fixed value).
_CAPTION = r"(?i)\bfigure\s+([a-z]?\d+(?:\.\d+)+[a-z]?)\s*(,\s*continued\.)?[^\n]*"


def caption(c: Column) -> Column:
    """struct(figure, caption, continued) of the first caption; empty strings and false without one."""
    t = F.coalesce(c, F.lit(""))
    return F.struct(
        strict_figure(F.regexp_extract(t, _CAPTION, 1)).alias("figure"),
        F.trim(F.regexp_extract(t, _CAPTION, 0)).alias("caption"),
        (F.regexp_extract(t, _CAPTION, 2) != "").alias("continued"),
    )


def printed_page(c: Column, edge: int = 6, digits: int | None = 4) -> Column:
    """The printed page number among a page's first and last lines: the first bare number, else the first line of capitals
    with a number, else the first that is no part of another. Numbers have up to ``digits`` digits; None: any."""
    number = rf"\d{{1,{digits or ''}}}"
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(lines)
    edges = F.concat(F.slice(lines, 1, edge), F.slice(lines, F.greatest(n - edge + 1, F.lit(1)), edge))
    bare = F.filter(edges, lambda x: x.rlike(rf"^{number}$"))
    heads = F.filter(F.transform(edges, lambda x: F.concat(F.regexp_extract(x, rf"^[A-Z][A-Z ]{{2,}}\s+({number})$", 1), F.regexp_extract(x, rf"^({number})\s+[A-Z][A-Z ]{{2,}}$", 1))), lambda x: x != "")
    some = F.flatten(F.transform(edges, lambda x: F.regexp_extract_all(x, F.lit(rf"(?<![.\d])({number})(?![.\d])"), 1)))
    return F.coalesce(F.get(bare, 0), F.get(heads, 0), F.get(some, 0), F.lit(""))


def card_stem(c: Column) -> Column:
    """A file name without an image extension; other dots stay."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?i)\.({CARD_EXTENSIONS})$", "")


def parse_box(c: Column) -> Column:
    """Four numbers of any text as struct(x1, y1, x2, y2) of ints, fractions cut off; null unless there are four."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double").cast("int"))
    return F.when(F.size(found) == 4, F.struct(*[F.get(found, i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]))


def _digest(c: Column, size: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, size)


def box_fingerprint(image: Column, box: Column) -> Column:
    """A digest of an image's name and a box; null without a box."""
    return F.when(box.isNotNull(), _digest(F.concat(image, F.lit("|"), F.concat_ws(",", *[box[x].cast("string") for x in ("x1", "y1", "x2", "y2")])), 16))


def figure_key(members: Column) -> Column:
    """An identity of a set of strings, whatever their order."""
    return _digest(F.concat_ws("|", F.array_sort(members)), 20)


def warning_id(*fields: Column) -> Column:
    return _digest(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 16)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """A name-based UUID (version 5) from SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def split_of(key: Column) -> Column:
    """train, validation or test, 80/10/10, from a key's digest."""
    n = F.conv(_digest(key, 8), 16, 10).cast("long") % 10
    return F.when(n < 8, "train").when(n == 8, "validation").otherwise("test")


def natural_key(c: Column) -> Column:
    """array<string>: text and digit runs by turns, text in lower case, digits padded so that they compare as numbers."""
    t = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    t = F.when(t.rlike(r"^\d"), F.concat(F.lit("\x01"), t)).otherwise(t)
    parts = F.regexp_extract_all(t, F.lit(r"(\d+|\D+)"), 1)
    return F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.regexp_replace(x, r"^0+(?=\d)", ""), 30, "0")).when(x == "\x01", "").otherwise(x))


def leading_number(c: Column) -> Column:
    """A row's number at the start of its text: up to three digits and a letter as a word, or digits right before a capital; empty without one."""
    t = F.coalesce(c, F.lit(""))
    word = F.regexp_extract(t, r"(?i)^\s*(\d{1,3}[a-z]?)\b", 1)
    return F.when(word != "", word).otherwise(F.regexp_extract(t, r"^\s*(\d{1,3})(?=[A-Z])", 1))


def first_number(c: Column) -> Column:
    """The first signed number, with a decimal comma or point, as a double; null without one."""
    return F.replace(F.nullif(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"(-?\d+(?:[.,]\d+)?)", 1), F.lit("")), F.lit(","), F.lit(".")).cast("double")


def token_set(c: Column) -> Column:
    """Distinct capital words and numbers."""
    return F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(c.cast("string"), F.lit(""))), F.lit(r"([A-Z]+|\d+(?:\.\d+)?)"), 1))


def is_empty_value(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(EMPTY_VALUES)


def safe_piece(c: Column, fallback: str = "") -> Column:
    """Text for a file name: points and runs of characters other than letters, digits and hyphens become hyphens; the fallback where nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.replace(clean_text(c), F.lit("."), F.lit("-")), r"[^A-Za-z0-9-]+", "-"), r"^-+|-+$", "")
    return F.when(t == "", fallback).otherwise(t)


def citation(figure: Column, item: Column, fallback: Column) -> Column:
    """What is known of figure and item, else the card's name without extension."""
    part = lambda word, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(word), F.trim(c)))
    found = F.concat_ws(" ", part("Figure ", figure), part("Item ", item))
    return F.when(found != "", found).otherwise(card_stem(fallback))


def page_image_name(base: Column, index: Column, part: Column) -> Column:
    return F.concat(base, F.lit("_page_"), index.cast("string"), F.coalesce(part, F.lit("")), F.lit(".jpg"))


def bracket_fields(c: Column) -> Column:
    """Names in square brackets, each once, in order."""
    names = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[([^\[\]]+)\]"), 1), lambda x: F.trim(x))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def formula_guard(c: Column) -> Column:
    """Cells that a spreadsheet would take for a formula get an apostrophe."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def field_key(c: Column) -> Column:
    """A field's name for loose comparison."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "")
