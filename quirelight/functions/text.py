"""Text functions as Column expressions (no Python on the rows)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelled out because regex engines differ about ``\s``.
SPACES = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
ELLIPSIS = "…"

# The letters that a slug folds, and what they fold to.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāćčēęěīńňøōūůłśšźžżřťď"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyyacceeeinnoouulsszzzrtd"
FOLD_MANY = {"ß": "ss", "æ": "ae", "œ": "oe"}

#: Named references and numbers of characters that XML allows; zeros before a number don't count.
_NUMBERS = (
    "#0*(?:9|10|13|3[2-9]|[4-9][0-9]|[1-9][0-9]{2,3}|[1-4][0-9]{4}|5[0-4][0-9]{3}|55[0-1][0-9]{2}|552[0-8][0-9]|5529[0-5]"
    "|5734[4-9]|573[5-9][0-9]|57[4-9][0-9]{2}|5[89][0-9]{3}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-3]|6553[6-9]|655[4-9][0-9]|65[6-9][0-9]{2}|6[6-9][0-9]{3}|[7-9][0-9]{4}"
    "|[1-9][0-9]{5}|10[0-9]{5}|110[0-9]{4}|111[0-3][0-9]{3}|11140[0-9]{2}|111410[0-9]|111411[01])"
    "|#[xX]0*(?:9|[aA]|[dD]|[2-9a-fA-F][0-9a-fA-F]|[1-9a-fA-F][0-9a-fA-F]{2}|[1-9a-cA-C][0-9a-fA-F]{3}|[dD][0-7][0-9a-fA-F]{2}|[eE][0-9a-fA-F]{3}|[fF][0-9a-eA-E][0-9a-fA-F]{2}|[fF]{2}[0-9a-eA-E][0-9a-fA-F]|[fF]{3}[0-9a-dA-D]"
    "|[1-9a-fA-F][0-9a-fA-F]{4}|10[0-9a-fA-F]{4})"
)
#: An ampersand that opens no valid reference.
REFERENCE = rf"&(?!(?:[A-Za-z0-9]+|{_NUMBERS});)"
#: Characters XML forbids.
FORBIDDEN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
#: Language tags: a primary subtag and further ones.
LANGUAGE_TAG = "^[A-Za-z0-9]{1,8}(-[A-Za-z0-9]{1,8})*$"


def collapse(text: Column) -> Column:
    """White space runs become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def _plain(text: Column) -> Column:
    return ~F.contains(text, F.lit("<")) & ~F.contains(text, F.lit("&"))


def has_letter(text: Column) -> Column:
    """A letter outside tags and references; a bare ampersand hides what follows up to a semicolon."""
    bare = F.regexp_replace(F.regexp_replace(text, "<[^>]*>?", ""), "&[^;]*;?", "")
    return F.when(_plain(text), text.rlike(r"\p{L}")).otherwise(bare.rlike(r"\p{L}"))


def blank(text: Column) -> Column:
    """Nothing but white space."""
    return ~text.rlike(SPACES.replace("[", "[^", 1)[:-1])


def strip_tags(text: Column) -> Column:
    """Text outside tags, which may nest to any depth, without extra white space; a closing bracket outside of them goes too.

    Each stretch up to the next bracket is a step of a fold that carries the depth.
    """
    pieces = F.split(F.regexp_replace(text, "([<>])", "\u0001$1"), "\u0001")  # the control character can't stand in XML
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, piece: Column) -> Column:
        mark = F.substring(piece, 1, 1)
        depth = F.when(mark == "<", s["depth"] + 1).when(mark == ">", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        said = F.when(mark.isin("<", ">"), F.substr(piece, F.lit(2))).otherwise(piece)
        return F.struct(depth.alias("depth"), F.when((depth == 0) & (said != ""), F.concat(s["kept"], F.array(said))).otherwise(s["kept"]).alias("kept"))

    nested = collapse(F.array_join(F.aggregate(pieces, start, step, lambda s: s["kept"]), ""))
    simple = collapse(F.regexp_replace(text, "<[^<>]*>", ""))
    flat = ~F.regexp_replace(text, "<[^<>]*>", "").rlike("[<>]")  # no tag holds another, none is open
    return F.when(flat, simple).otherwise(nested)


def plain_strip(text: str) -> str:
    """``strip_tags`` of one text, where the provider is called."""
    out, depth = [], 0
    for piece in re.split("([<>])", text):
        if piece == "<":
            depth += 1
        elif piece == ">":
            depth = max(0, depth - 1)
        elif not depth:
            out.append(piece)
    return " ".join("".join(out).split())


def first_runes(text: Column, n: int) -> Column:
    """At most n characters from the start, with an ellipsis where cut."""
    return F.when(F.length(text) > n, F.concat(F.trim(F.substring(text, 1, n)), F.lit(ELLIPSIS))).otherwise(text)


def last_runes(text: Column, n: int) -> Column:
    """At most n characters from the end, with an ellipsis where cut; nothing for n under 1."""
    if n <= 0:
        return F.lit("")
    return F.when(F.length(text) > n, F.concat(F.lit(ELLIPSIS), F.right(text, F.lit(n)))).otherwise(text)


def repair_ampersands(text: Column) -> Column:
    """Escape ampersands that open no valid reference; a number must be that of a character XML allows."""
    return F.when(F.contains(text, F.lit("&")), F.regexp_replace(text, REFERENCE, "&amp;")).otherwise(text)


def normalise(text: Column) -> Column:
    """Character data that is safe between tags."""
    return F.replace(F.replace(repair_ampersands(text), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_attribute(text: Column) -> Column:
    """Text that can stand in a quoted attribute."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def byte_excerpt(text: Column, most: int = 200) -> Column:
    """Collapsed text cut after ``most`` bytes, never inside a character, with an ellipsis where cut."""
    flat = collapse(text)
    raw = F.substring(flat.cast("binary"), 1, most)
    # bytes of a character that was cut stand at the end: at most three, which the length of the whole characters shows
    whole = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(4)])
    return F.when(F.octet_length(flat) <= most, flat).otherwise(F.concat(whole, F.lit(ELLIPSIS)))


def xml_safe(text: Column) -> Column:
    return ~text.rlike(FORBIDDEN)


def slug(text: Column, fallback: str = "untitled") -> Column:
    """Lower-case ASCII words joined by hyphens."""
    text = F.lower(text)
    for letter, plain in FOLD_MANY.items():
        text = F.replace(text, F.lit(letter), F.lit(plain))
    text = F.translate(text, FOLD_FROM, FOLD_TO)
    text = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(text == "", F.lit(fallback)).otherwise(text)


def thousands(number: Column) -> Column:
    """An integer with spaces between groups of three digits."""
    return F.replace(F.format_number(number, 0), F.lit(","), F.lit(" "))


def direct_language(code: Column) -> Column:
    """Language code as the direct translation service names it."""
    code = F.replace(F.upper(code), F.lit("_"), F.lit("-"))
    return F.when(code.isin("EN-GB", "EN-US", "PT-BR", "PT-PT", "ZH-HANT"), code).when(code == "ZH-HANS", "ZH").otherwise(F.split_part(code, F.lit("-"), F.lit(1)))


def tags(text: Column) -> Column:
    """Names of the opening tags of a fragment, lower-cased, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit("<([A-Za-z][A-Za-z0-9:-]*)"), F.lit(1)), lambda t: F.lower(t))


def tag_counts(text: Column) -> Column:
    """Tag multiset as a sorted array of (name, count), comparable with ``=``."""
    names = tags(text)
    return F.transform(F.array_sort(F.array_distinct(names)), lambda t: F.struct(t.alias("name"), F.size(F.filter(names, lambda x: x == t)).alias("n")))


def strip_fence(text: Column) -> Column:
    """An answer without its code fence."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), "^```[^\\n]*\\n", ""), "\\n?```\\s*$", "")


def recipe_key(*fields: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the NUL-joined fields; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256), 1, 16)
