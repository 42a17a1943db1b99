"""Text functions of notebook metadata, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the container's texts.
PAIR = r"<([^:<>]+):([^:<>]+)>"
LAYER = r"\{([^{}]*)\}"
LAYER_FIELD = r'"([^"]+)"#"?([^",}]*)"?'


def key_values(text: Column) -> Column:
    """array<struct<key, value>> of all ``<key:value>`` pairs in order. A part that is empty or
    holds one of ``:<>`` is no pair."""
    return F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(PAIR), F.lit(1)).alias("key"), F.regexp_extract_all(text, F.lit(PAIR), F.lit(2)).alias("value")),
        lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")),
    )


def nested(text: Column) -> Column:
    """array<struct<grp, name, value>> of the pairs whose key comes once, cut at its first underscore;
    pairs without a part on either side drop out."""
    pairs = key_values(text)
    single = lambda p: F.size(F.filter(pairs, lambda q: q["key"] == p["key"])) == 1
    at = lambda p: F.instr(p["key"], "_")
    kept = F.filter(pairs, lambda p: single(p) & (at(p) > 1) & (F.length(p["key"]) > at(p)))
    return F.transform(kept, lambda p: F.struct(F.substring_index(p["key"], "_", 1).alias("grp"), F.substr(p["key"], at(p) + 1).alias("name"), p["value"].alias("value")))


def layers(text: Column) -> Column:
    """array<map<string, string>> of the ``{"key"#value,…}`` objects; of a repeated key the last counts."""

    def fields(body: Column) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(LAYER_FIELD), F.lit(1)).alias("k"), F.regexp_extract_all(body, F.lit(LAYER_FIELD), F.lit(2)).alias("v"))
        return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))

    return F.transform(F.regexp_extract_all(text, F.lit(LAYER), F.lit(1)), fields)


def page_of_key(key: Column) -> Column:
    """The 1-based page that a title, keyword or link key begins with. It has four digits, and so have
    the coordinates after it; from page 10,000 on it is as many digits longer as the key is. What
    begins with 0 was filled up to four."""
    digits = F.when(key.startswith("0"), 4).otherwise(4 + F.length(key) % 4)
    return F.substring(key, F.lit(1), digits).try_cast("int")


def mark_key(page: Column, place: Column) -> Column:
    """A mark's key: its page, and eight digits of its place."""
    page = page.cast("string")
    return F.concat(F.lpad(page, F.greatest(F.length(page), F.lit(4)), F.lit("0")), F.lpad(place.cast("string"), 8, "0"))


def repair(label: Column) -> Column:
    """UTF-8 that was read as Latin-1, read rightly; null where that is impossible."""
    fits = ~label.rlike("[^\\x{00}-\\x{FF}]")
    raw = F.when(fits, F.encode(label, "ISO-8859-1"))
    return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8"))


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + F.lit(0.5))


def strip(text: Column) -> Column:
    """Without NULs, and without any white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, "\\x00", ""), r"^\s+|\s+$", "")


def data_base64(data: Column) -> Column:
    return F.regexp_replace(F.base64(data), "[\\r\\n]", "")


def file_name(path: Column) -> Column:
    """The last part of a path, without the note extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.note$", "")


def xml(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def grey_of_rgb(colour: Column) -> Column:
    """The first number of ``rgb(…)``, 0 without one."""
    return F.coalesce(F.regexp_extract(colour, r"rgb\((\d+)", 1).try_cast("int"), F.lit(0))


def points_of_pixels(px: Column, dpi: Column) -> Column:
    return px * F.lit(72.0) / dpi


def two_places(x: Column) -> Column:
    """A number with two decimals, halves of its exact decimal form away from zero."""
    return F.format_string("%s", x.cast("decimal(38,12)").cast("decimal(38,2)"))


def js_number(x: Column) -> Column:
    """A number as text, without the decimals of a whole one."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def title_style(code: Column) -> Column:
    """struct<background, foreground, hatched> of ``1BBBFFF``."""
    back, fore = F.substring(code, 2, 3).try_cast("int"), F.substring(code, 5, 3).try_cast("int")
    return F.struct(back.alias("background"), fore.alias("foreground"), ((back == 0) & (fore == 0)).alias("hatched"))
