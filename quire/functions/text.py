"""Text expressions. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.constants import FOLDED, LINE_END, SUBSTITUTIONS, UNKNOWN, WS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(col(c), rf"\A{WS}+|{WS}+\z", "")


def is_said(c: Column | str) -> Column:
    """Whether strip() leaves anything."""
    return col(c).rlike(f"[^{WS[1:-1]}]")


def normalize_whitespace(c: Column | str) -> Column:
    """Runs of white space become one space; none at either end."""
    return F.trim(F.regexp_replace(col(c), f"{WS}+", " "))


def casefold(c: Column | str) -> Column:
    """lower(), and the letters that fold to others: sharp s, final sigma, Latin ligatures. Exact for Latin, Greek and Cyrillic."""
    low = F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))
    folded = low
    for sign, plain in FOLDED:
        folded = F.replace(folded, F.lit(sign), F.lit(plain))
    return F.when(low.rlike("[" + "".join(sign for sign, _ in FOLDED) + "]"), folded).otherwise(low)


def normalize_quote(c: Column | str) -> Column:
    return casefold(normalize_whitespace(c))


def clean_text(c: Column | str) -> Column:
    """Three or more line feeds become two; white space at either end goes."""
    return strip(F.regexp_replace(col(c), r"\n{3,}", "\n\n"))


def tokenize(c: Column | str) -> Column:
    """Words of the normalised text; none for a blank one."""
    n = normalize_whitespace(c)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def word_count(c: Column | str) -> Column:
    return F.size(tokenize(c))


def lines(c: Column | str) -> Column:
    """Lines without their ends; an end at the very end starts no further line."""
    parts = F.split(col(c), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def field_key(c: Column | str) -> Column:
    return F.translate(casefold(c), " _", "")


def preview(c: Column | str, most: int = 72) -> Column:
    """As it is up to ``most`` characters, else its start and three dots."""
    x = col(c)
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most - 3), F.lit("...")))


def book_stem(c: Column | str) -> Column:
    """The last part of a path without its last extension; a leading dot is no extension."""
    return F.regexp_replace(F.regexp_extract(col(c), r"([^/]*)$", 1), r"(?<=[^.])\.[^.]*$", "")


def quote_variants(c: Column | str) -> Column:
    """Distinct spellings to search for, in order: as given, stripped, normalised, then each substitution that applies, alone, and normalised."""
    raw = col(c)
    found = [F.array(raw, strip(raw), normalize_whitespace(raw))]
    for sign, plain in SUBSTITUTIONS:
        changed = F.replace(raw, F.lit(sign), F.lit(plain))
        found.append(F.when(F.instr(raw, sign) > 0, F.array(changed, normalize_whitespace(changed))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.flatten(F.array(*found)), lambda x: x != ""))


def quote_in_text(quote: Column | str, text: Column | str, plain_text: Column | None = None) -> Column:
    """Empty: false; the sentinel: true; else as it is or normalised (plain_text: text normalised already)."""
    q, t = col(quote), col(text)
    plain = plain_text if plain_text is not None else normalize_whitespace(t)
    return (q != "") & ((q == UNKNOWN) | F.contains(t, q) | F.contains(plain, normalize_whitespace(q)))


def verified_quote(c: Column | str) -> Column:
    s = strip(c)
    return (s != "") & (s != UNKNOWN)


def coerce_page(c: Column | str) -> Column:
    """Digits, perhaps between white space, as a number; else null."""
    s = strip(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.when(s.rlike(r"\A[0-9]+\z"), s.try_cast("int"))


def parse_color(c: Column | str) -> Column:
    """Three numbers; divided by 255 if any is above 1; null unless all are then from 0 to 1."""
    parts = F.transform(F.split(col(c), ","), lambda x: F.trim(x).try_cast("double"))
    scaled = F.when(F.exists(parts, lambda x: x > 1), F.transform(parts, lambda x: x / 255)).otherwise(parts)
    good = (F.size(parts) == 3) & ~F.exists(scaled, lambda x: x.isNull() | (x < 0) | (x > 1))
    return F.when(good, scaled)


def estimated_tokens(c: Column | str) -> Column:
    """A named stand-in for a tokeniser: a token for every four characters begun; 0 for no text."""
    return F.ceil(F.length(F.coalesce(col(c), F.lit(""))) / 4).cast("long")
