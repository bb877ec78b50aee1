"""Text as Column expressions: cleaning, tests and small transforms (X, F rows of the inventory)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .rowwise import rowwise

#: White space as Python's str.split() has it; Java's and RE2's \s has less.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LETTER_WORD = r"[\p{L}\p{Nl}\p{No}]+"
WORD = r"[\p{L}\p{N}_]+"
SHINGLE_WORD = r"[A-Za-z0-9_\x{80}-\x{10FFFF}]+"

# English function words; a text whose words are a tenth of these reads as English.
ENGLISH_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an they "
    "you were her she there been one all we their its has had would will can if more when so no who what may also "
    "into than only other some these do such them could two then most our many"
).split()

# Common words of documentation.
COMMON_WORDS = (
    "the and of to a in is for with that this be are on as by or an it from can if use file files will not which you"
).split()

# What marks a line of display maths, and what ends a sentence.
MATHS_MARKS = ("$$", "\\begin{", "\\end{")
EMAIL = r"[\w.+-]+@[\w-]+(\.[\w-]+)+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\\x{FEFF}", "")


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def without_marker(text: Column) -> Column:
    """U+2581, which tokenizers use for a space, as an underscore."""
    return F.translate(text, "▁", "_")


def without_controls(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[\x0b\x0c]", "\n"), r"[\x00-\x08\x0e-\x1f\x7f]", "")


def squeezed(text: Column) -> Column:
    """No blanks before a line's end, two line ends in a row at most, nothing around the text."""
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def mojibake(text: Column) -> Column:
    return text.rlike(r"[\x{C2}\x{C3}][\x{80}-\x{BF}]")


#: Canonical composition; Spark has no native function for it.
nfc = rowwise(StringType(), lambda t: unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """NFC. Below U+0300 nothing composes, so only texts with characters from there on leave the JVM."""
    return F.coalesce(nfc(F.when(text.rlike(r"[^\x00-\x{2FF}]"), text)), text)


def cleaned(text: Column) -> Column:
    """All steps of cleaning in their fixed order: mark, line ends, composition, U+2581, controls, blanks."""
    return squeezed(without_controls(without_marker(composed(unix_newlines(without_bom(text))))))


def cleaning_changes(text: Column) -> dict[str, Column]:
    """What cleaning changes, as flags and counts."""
    first = without_bom(text)
    lines = unix_newlines(first)
    marked = without_marker(composed(lines))
    plain = without_controls(marked)
    return {
        "had_bom": text != first,
        "had_cr": first != lines,
        "n_markers": F.length(lines) - F.length(F.replace(lines, F.lit("▁"), F.lit(""))),
        "n_controls": F.length(marked) - F.length(plain),
        "mojibake": mojibake(plain),
    }


def repaired(text: Column) -> Column:
    """Lines of which U+FFFD is a fifth or more of what isn't space go; elsewhere the character goes."""
    bad = lambda line: F.length(line) - F.length(F.replace(line, F.lit("�"), F.lit("")))
    solid = lambda line: F.length(F.regexp_replace(line, SPACE, ""))
    lines = F.filter(F.split(text, "\n"), lambda line: ~((bad(line) > 0) & (bad(line) * 5 >= solid(line))))
    return squeezed(F.replace(F.array_join(lines, "\n"), F.lit("�"), F.lit("")))


def replacement_ratio(text: Column) -> Column:
    n = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return n / F.greatest(F.length(text), F.lit(1))


def squashed(text: Column) -> Column:
    return F.regexp_replace(strip(text), f"{SPACE}+", " ")


def tidied(text: Column) -> Column:
    """Lines without blanks at their ends, one blank line at most between paragraphs."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?md)[ \t]+$", ""), r"\n{3,}", "\n\n"))


def masked_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "[email]")


def without_markup(text: Column) -> Column:
    """Images go, links keep their text, comments and tags go."""
    text = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    text = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"</?[A-Za-z][^>]*>", "")


def home_masked(text: Column) -> Column:
    return F.regexp_replace(text, r"(/home|/Users)/[^/\s]+", "~")


def tsv_cell(text: Column) -> Column:
    return F.translate(text, "\t\r\n", "   ")


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, however often later expressions (and their lambdas) read it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def leading_words(text: Column, window: int = 8000) -> Column:
    """The letter words that decide first whether a text is English."""
    return words(F.substring(text, 1, window), LETTER_WORD)


def looks_english(
    text: Column, window: int = 8000, least: float = 0.10, few: int = 50, foreign: float = 0.005, head: Column | None = None
) -> Column:
    """Few words, enough function words at the start or in the middle, or hardly a letter beyond ASCII.

    ``head`` is leading_words() where a column has them already.
    """
    def share(found: Column) -> Column:
        hits = F.size(F.filter(found, lambda w: F.lower(w).isin(ENGLISH_WORDS)))
        return hits / F.greatest(F.size(found), F.lit(1))

    head = leading_words(text, window) if head is None else head
    middle = words(F.substr(text, F.floor(F.length(text) / 2).cast("int") + 1, F.lit(window)), LETTER_WORD)
    letters = F.array_join(head, "")
    beyond = F.length(F.regexp_replace(letters, r"[\x00-\x7f]", "")) / F.greatest(F.length(letters), F.lit(1))
    return (
        (F.size(head) < few)
        | (share(head) >= least)
        | (beyond <= foreign)
        | ((F.size(middle) >= few) & (share(middle) >= least))
    )


def looks_like_prose(text: Column) -> Column:
    """Mostly letters, enough English words, not a table."""
    sample = F.substring(text, 1, 20000)
    solid = F.regexp_replace(sample, SPACE, "")
    letters = F.length(F.regexp_replace(solid, r"\P{L}", ""))
    found = words(sample, "[A-Za-z]+")
    hits = F.size(F.filter(found, lambda w: F.lower(w).isin(COMMON_WORDS)))
    lines = F.filter(F.split(sample, "\n"), lambda x: F.length(strip(x)) > 0)
    tabs = F.size(F.filter(lines, lambda x: F.contains(x, F.lit("\t"))))
    return (
        (letters >= 0.6 * F.length(solid))
        & (F.length(solid) > 0)
        & (F.size(found) >= 30)
        & (hits >= 0.05 * F.size(found))
        & ((F.size(lines) == 0) | (tabs < 0.5 * F.size(lines)))
    )


def punctuated(text: Column) -> Column:
    """Short, or a sentence end for every forty words."""
    n = F.size(words(text, r"[^\s]+"))
    return (n < 60) | (F.regexp_count(text, F.lit(r"[.!?](?:\s|$)")) * 40 >= n)


def boilerplate_candidate(line: Column, following: Column) -> Column:
    """Whether a stripped line may be boilerplate, given the next line that isn't blank.

    Structure never is: lines without letters or digits, headings marked as such or set in
    capitals, display maths, and short titles right above a paragraph.
    """
    n = F.size(F.split(squashed(line), " "))
    maths = F.contains(line, F.lit(MATHS_MARKS[0]))
    for mark in MATHS_MARKS[1:]:
        maths = maths | F.contains(line, F.lit(mark))
    capitals = (line == F.upper(line)) & (line != F.lower(line))
    title = line.rlike(r"^[\p{L}\p{N}]") & ~line.rlike("[<>|`]") & ~line.rlike(r"[.!?;:,]$") & (F.length(following) >= 80)
    plain = line.rlike("[A-Za-z0-9]") & ~F.startswith(line, F.lit("#")) & ~maths
    return plain & ((n > 8) | (~capitals & ~title))
