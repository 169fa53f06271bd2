"""Cleaning of names and titles, and the keys that joins run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnOrName, col, let

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Nesting that the plain expression resolves; deeper text takes the general fold.
_FLAT_DEPTH = 6


def ascii_lower(value: ColumnOrName) -> Column:
    """Lower-case A-Z only, so other letters keep their form."""
    return F.translate(col(value), UPPER, LOWER)


def _fold_brackets(value: Column) -> Column:
    tokens = F.regexp_extract_all(value, F.lit(r"(?s)([\[({]|[\])}]|[^\[\](){}]+)"), F.lit(1))
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("depth"))

    def step(state: Column, token: Column) -> Column:
        depth = state["depth"]
        opens = token.isin("[", "(", "{")
        closes = token.isin("]", ")", "}")
        return F.struct(
            F.when(opens | closes | (depth > 0), state["kept"])
            .otherwise(F.concat(state["kept"], token))
            .alias("kept"),
            F.when(opens, depth + 1)
            .when(closes, F.greatest(depth - 1, F.lit(0)))
            .otherwise(depth)
            .alias("depth"),
        )

    return F.aggregate(tokens, start, step, lambda state: state["kept"])


def strip_brackets(value: ColumnOrName) -> Column:
    """Drop all bracketed text; bracket kinds are not told apart.

    Stray closers go; an opener that is never closed takes the rest with it.
    """

    def flatten(raw: Column) -> Column:
        flat = F.translate(raw, "[{]}", "(())")
        for _ in range(_FLAT_DEPTH):
            flat = F.regexp_replace(flat, r"\([^()]*\)", "")
        return flat

    def finish(raw: Column) -> Column:
        return let(
            flatten(raw),
            lambda flat: F.when(flat.rlike(r"\([^()]*\)"), _fold_brackets(raw)).otherwise(
                F.translate(F.regexp_replace(flat, r"(?s)\(.*$", ""), ")", "")
            ),
        )

    return let(col(value), lambda raw: F.when(raw.rlike(r"[\[\](){}]"), finish(raw)).otherwise(raw))


def clean_metadata(value: ColumnOrName) -> Column:
    """Bracket-free text without outer blanks."""
    return F.btrim(strip_brackets(value), F.lit(" \t\r\n"))


def normalize_key(value: ColumnOrName) -> Column:
    """Comparison key: no brackets, blanks or separators; ASCII lower case."""
    bare = F.regexp_replace(strip_brackets(value), r"[\x00-\x20\-_/\\,.~～]", "")
    return ascii_lower(bare)


def clean_album_title(value: ColumnOrName) -> Column:
    """Album folder name without brackets and without a leading date."""
    undated = F.regexp_replace(
        clean_metadata(value),
        r"^\s*([0-9]{4}[.-][0-9]{2}[.-][0-9]{2}|[0-9]{4}[.-][0-9]{2}|[0-9]{4})\s*",
        "",
    )
    return F.btrim(undated, F.lit(" \t\r\n.-_"))


def sanitize_filename(value: ColumnOrName) -> Column:
    """Name that is safe as a file or folder name.

    Only dots become empty; dots after leading blanks stay.
    """
    swapped = F.translate(col(value), '<>:"/\\|?*\t\r\n', "_________   ")
    started = F.ltrim(swapped)
    ended = F.rtrim(started, F.lit(" ."))
    return F.when(started == "", "_").when((ended == "") & F.startswith(swapped, F.lit(" ")), started).otherwise(ended)


def escape_lucene(value: ColumnOrName) -> Column:
    """Blank out the characters that have a meaning in a Lucene query."""
    marks = ';+-&|!(){}[]^"~*?:\\/'
    return F.btrim(F.translate(col(value), marks, " " * len(marks)), F.lit(" \t"))


def trim_markup(value: ColumnOrName) -> Column:
    """Trim blanks and Markdown marks from both ends."""
    return F.btrim(col(value), F.lit(" \t\r\n*#-_"))


def slashed(path: ColumnOrName) -> Column:
    """Path with one kind of separator."""
    return F.replace(col(path), F.lit("\\"), F.lit("/"))


def file_name(path: ColumnOrName) -> Column:
    """Text after the last path separator."""
    return F.substring_index(slashed(path), "/", -1)


def _named(path: ColumnOrName, use: Callable[[Column, Column], Column]) -> Column:
    """``use(name, size)``, the size being that of the extension with its dot; a dot in front begins none.

    The path is read once, as filters on the result are pushed down with all that it is made of.
    """

    def sized(name: Column) -> Column:
        size = F.length(F.substring_index(name, ".", -1)) + 1
        return use(name, F.when(size < F.length(name), size).otherwise(0))

    return let(file_name(path), sized)


def file_stem(path: ColumnOrName) -> Column:
    """File name without its last extension."""
    return _named(path, lambda name, size: F.substring(name, F.lit(1), F.length(name) - size))


def file_extension(path: ColumnOrName) -> Column:
    """Lower-case extension with its dot, or empty."""
    return ascii_lower(_named(path, lambda name, size: F.substring(name, F.length(name) - size + 1, size)))


def parent_folder(path: ColumnOrName) -> Column:
    """Path without its last part, or empty."""
    return let(col(path), lambda full: F.substring(full, F.lit(1), F.length(full) - F.length(file_name(full)) - 1))


def split_numbered(stem: ColumnOrName, separators: list[str], need_digit: bool) -> Column:
    """STRUCT<stem, numbered, before, after> of a file stem with a leading track number.

    Separators are tried in turn and the first one found anywhere decides, even
    when it lies too far right to end a number. ``after`` starts one place after
    the separator's start.
    """

    def head(s: Column) -> Column:
        chosen = F.when(F.contains(s, F.lit(separators[0])), F.lit(separators[0]))
        for sep in separators[1:]:
            chosen = chosen.when(F.contains(s, F.lit(sep)), F.lit(sep))
        return F.call_function("substring_index", s, chosen, F.lit(1))

    def split(s: Column, before: Column) -> Column:
        numbered = before.isNotNull() & (F.octet_length(before) <= 4)
        if need_digit:
            numbered = numbered & s.rlike("^[0-9]")
        return F.struct(
            s.alias("stem"),
            F.coalesce(numbered, F.lit(False)).alias("numbered"),
            before.alias("before"),
            F.substring(s, F.length(before) + 2, F.length(s)).alias("after"),
        )

    return let(col(stem), lambda s: let(head(s), lambda before: split(s, before)))


def normalize_track_name(value: ColumnOrName) -> Column:
    """Key of a file name or a title line, without its leading number."""
    parts = split_numbered(file_stem(value), [". ", "- ", "_"], need_digit=True)
    return normalize_key(let(parts, lambda p: F.when(p["numbered"], p["after"]).otherwise(p["stem"])))


def url_encode_rfc3986(value: ColumnOrName) -> Column:
    """Percent-encode all but letters, digits and -_.~"""
    encoded = F.url_encode(col(value))
    encoded = F.replace(encoded, F.lit("+"), F.lit("%20"))
    encoded = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


# One entity that decodes, or a run without "&", or a lone "&".
_ENTITY_TOKENS = (
    r"(?s)(&(?:amp|lt|gt|quot|apos);"
    r"|&(?=#[^;]{1,8};)#(?:\s*\+?0*(?:[1-9]|[1-9][0-9]|1[01][0-9]|12[0-7])(?![0-9])"
    r"|[xX]\s*\+?(?:0[xX])?0*(?:[1-9a-fA-F]|[1-7][0-9a-fA-F])(?![0-9a-fA-F]))[^;]*;"
    r"|[^&]+|&)"
)


def unescape_html(value: ColumnOrName) -> Column:
    """Decode the five named entities and numeric ones for ASCII, in one pass."""

    def decode(token: Column) -> Column:
        hexadecimal = F.regexp_extract(token, r"^&#[xX]\s*\+?(?:0[xX])?([0-9a-fA-F]+)", 1)
        decimal = F.regexp_extract(token, r"^&#\s*\+?([0-9]+)", 1)
        return (
            F.when(~F.startswith(token, F.lit("&")) | (token == "&"), token)
            .when(token == "&amp;", "&")
            .when(token == "&lt;", "<")
            .when(token == "&gt;", ">")
            .when(token == "&quot;", '"')
            .when(token == "&apos;", "'")
            .when(hexadecimal != "", F.char(F.conv(hexadecimal, 16, 10).cast("int")))
            .otherwise(F.char(decimal.cast("int")))
        )

    raw = col(value)
    tokens = F.regexp_extract_all(raw, F.lit(_ENTITY_TOKENS), F.lit(1))
    return F.when(F.contains(raw, F.lit("&")), F.array_join(F.transform(tokens, decode), "")).otherwise(raw)


def decode_base64_text(value: ColumnOrName) -> Column:
    """Text behind base64; characters outside the alphabet are skipped."""
    bare = F.regexp_replace(col(value), "[^A-Za-z0-9+/]", "")
    whole = F.when(F.length(bare) % 4 == 1, F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)
    return F.unbase64(whole).cast("string")
