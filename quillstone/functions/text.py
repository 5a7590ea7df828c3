"""Text columns: cleaning in fixed order, normal forms, word lists."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.lexicons import REMOVED_MARKS

# Fixed values: (pattern, replacement) in the order in which they apply. Links come before bare URLs.
# (?d) keeps \n the only line end, (?U) makes \s and \w follow Unicode.
ZERO_WIDTH = "[​-‏‪-‮﻿]"
CLEANING = (
    (ZERO_WIDTH, ""),
    (r"(?U)\[([^\]]+)\]\(\s*https?://[^\)]+\)", "$1"),
    (r"(?U)\[([^\]]+)\]\[\d+\]", "$1"),
    (r"(?U)https?://\S+|www\.\S+", " [URL] "),
    (r"(?iU)(?:^|(?<=\s))/?u/[A-Za-z0-9_\-]+", " [USER] "),
    (r"(?iU)(?:^|(?<=\s))/?r/[A-Za-z0-9_\-]+", " [SUB] "),
    (r"\*+([^*\n]+?)\*+", "$1"),
    (r"~~([^~\n]+?)~~", "$1"),
    (r"`([^`\n]+?)`", "$1"),
    (r"(?mdU)^#{1,6}\s*", ""),
    (r"(?mdU)^>+\s?", ""),
    (r"(?mdU)^[-*_]{3,}\s*$", ""),
    (r"(?U)&\w+;", " "),
    (r"\n{3,}", "\n\n"),
    (r"[ \t]{2,}", " "),
)


#: Of each pattern above, what every text that it fits contains: one of these.
NEEDS = (None, ("](",), ("][",), ("://", "www."), ("u/", "U/"), ("r/", "R/"), ("*",), ("~~",), ("`",), ("#",), (">",), ("--", "**", "__", "-*", "-_", "*-", "*_", "_-", "_*"), ("&",), ("\n\n\n",), ("  ", "\t"))
#: Buckets of the table of named references, so that a look-up compares few names.
NAME_BUCKETS = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _named(name: Column) -> Column:
    """The text of a named reference (with its semicolon, if it has one), else null. All names are of ASCII."""
    table: list[dict[str, str]] = [{} for _ in range(NAME_BUCKETS)]
    for k, v in html5.items():
        table[len(k) * 7 % NAME_BUCKETS ^ ord(k[0]) % NAME_BUCKETS].setdefault(k, v)
    at = (F.length(name) * 7 % NAME_BUCKETS).bitwiseXOR(F.ascii(name) % NAME_BUCKETS)
    return F.element_at(F.get(F.from_json(F.lit(json.dumps(table)), "array<map<string,string>>"), at), name)


def _numbered(digits: Column, base: int) -> Column:
    """The character of a number: what Windows-1252 has for 128 to 159, nothing for control and non-characters, U+FFFD beyond Unicode."""
    windows = {"0": "\ufffd"} | {str(b): bytes([b]).decode("cp1252", "replace") for b in range(128, 160)}
    windows = {k: v if k == "0" or v != "\ufffd" else chr(int(k)) for k, v in windows.items()}
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    n = F.when(F.length(short) > 7, 1 << 21).otherwise(F.conv(F.substring(short, 1, 7), base, 10).cast("int"))

    def character(n: Column) -> Column:
        other = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        none = n.between(1, 8) | n.between(14, 31) | (n == 11) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        listed = F.element_at(F.from_json(F.lit(json.dumps(windows)), "map<string,string>"), n.cast("string"))
        return F.when((n == 0) | n.between(128, 159), listed).when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").when(none, "").otherwise(other)

    return let(n, character)


def _referred(piece: Column) -> Column:
    """What followed an ampersand, decoded if it begins with a reference, else behind its ampersand again."""
    legacy = "|".join(sorted((re.escape(k) for k in html5 if not k.endswith(";")), key=len, reverse=True))
    number, hexadecimal = r"^#([0-9]+);?", r"^#[xX]([0-9a-fA-F]+);?"
    after = lambda found: F.substr(piece, F.length(found) + 1)

    def named(name: Column) -> Column:
        begin = F.regexp_extract(name, f"^(?:{legacy})", 0)  # the longest that the name begins with
        return let(_named(name), lambda v: F.when(v.isNotNull(), F.concat(v, after(name))).otherwise(let(begin, lambda b: F.when(b != "", F.concat(_named(b), after(b))).otherwise(F.concat(F.lit("&"), piece)))))

    return (
        F.when(piece.rlike(number), F.concat(_numbered(F.regexp_extract(piece, number, 1), 10), F.regexp_replace(piece, number, "")))
        .when(piece.rlike(hexadecimal), F.concat(_numbered(F.regexp_extract(piece, hexadecimal, 1), 16), F.regexp_replace(piece, hexadecimal, "")))
        .otherwise(named(F.regexp_extract(piece, r"^[^\t\n\f <&#;]{1,32};?", 0)))
    )


def unescape_entities(text: Column) -> Column:
    """Decode character references as HTML 5 has it: all names, with and without semicolon, and numbers. Rows without ``&`` keep their value."""

    def decoded(t: Column) -> Column:
        pieces = F.split(t, "&")
        return F.when(t.contains("&"), F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), _referred), ""))).otherwise(t)

    return let(text, decoded)


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends. Texts without any there are not searched."""
    ends = lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
    return let(text, lambda t: F.when(ends(t).rlike(r"(?U)\s"), F.regexp_replace(t, r"(?U)\A\s+|\s+\z", "")).otherwise(t))


def clean_text(text: Column, entities: bool = True) -> Column:
    out = F.coalesce(text, F.lit(""))
    if entities:
        out = unescape_entities(out)
    for (pattern, replacement), needs in zip(CLEANING, NEEDS, strict=True):
        out = let(out, lambda t: _replaced(t, pattern, replacement, needs))  # noqa: B023  called at once
    return strip(out)


def _replaced(text: Column, pattern: str, replacement: str, needs: tuple[str, ...] | None) -> Column:
    """Texts that contain nothing of what the pattern needs are not searched by it."""
    found = F.regexp_replace(text, pattern, replacement)
    return F.when(reduce(Column.__or__, [text.contains(n) for n in needs]), found).otherwise(text) if needs else found


def clean_text_simple(text: Column) -> Column:
    """The older cleaner: strip, squeeze newlines and spaces, unwrap links, drop URLs, squeeze all white space."""
    out = strip(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^\)]+\)", "$1")
    out = F.regexp_replace(out, r"(?U)https?://\S+|www\.\S+", "")
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def is_removed(text: Column, marks: tuple[str, ...] = REMOVED_MARKS) -> Column:
    return F.lower(strip(F.coalesce(text, F.lit("")))).isin(*marks)


def dedup_form(text: Column) -> Column:
    return strip(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def content_hash(text: Column, digits: int = 32) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, digits)


def simple_words(text: Column, lower: bool = True) -> Column:
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit("[a-zA-Z']+"), 0)


def count_in(words: Column, lexicon: tuple[str, ...]) -> Column:
    # A set for the engine: looked up by hash, however long the list is.
    return F.size(F.filter(words, lambda w: w.isin(*lexicon)))


def has_stem(text: Column, stems: tuple[str, ...]) -> Column:
    """Whether any stem is a part of the lower-cased text. Plain stems are searched as bytes, others as one alternation."""
    patterns = [s for s in stems if re.escape(s).replace("\\ ", " ").replace("\\-", "-") != s]
    plain = [s for s in stems if s not in patterns]

    def found(t: Column) -> Column:
        tests = [t.contains(s) for s in plain] + ([t.rlike("|".join(patterns))] if patterns else [])
        return reduce(Column.__or__, tests)

    return let(F.lower(text), found)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))


def preview(text: Column) -> Column:
    return F.when(F.length(text) > 45, F.concat(F.left(text, F.lit(20)), F.lit("..."), F.right(text, F.lit(20)))).otherwise(text)


def is_english(text: Column) -> Column:
    """Under 10 characters, or no word: yes. Else 85 % ASCII and a common word among 20 of the first 50."""
    from quillstone.functions.lexicons import COMMON_ENGLISH

    ascii_share = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / F.greatest(F.length(text), F.lit(1))
    common = let(F.slice(simple_words(text), 1, 50), lambda w: F.when(F.size(w) == 0, True).otherwise(count_in(w, COMMON_ENGLISH) / F.size(w) >= 0.05))
    return F.when(text.isNull() | (F.length(text) < 10), True).when(ascii_share < 0.85, False).otherwise(common)
