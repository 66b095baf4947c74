"""Column functions over text that several operators share; code points throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that counts as white space: the regex class and Unicode separators beside the ASCII control ones.
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: What a word is made of, in a character class, and where one may begin.
LETTERS = r"\p{L}\p{N}_"
BEGIN = rf"(?<![{LETTERS}])"
SPECIAL = r"<\|[^|>]{0,64}\|>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+\\z", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WHITE}+", " "))


def folded(c: Column) -> Column:
    """Lower case, with the sharp s as in full case folding."""
    return F.lower(F.regexp_replace(c, "ß", "ss"))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def occurrences(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def numbers(c: Column) -> Column:
    """All digit runs as numbers; those too long for one count as null."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), 1), lambda x: x.try_cast("bigint"))


def quads(c: Column) -> Column:
    """The numbers of a text by fours; a last group of less than four goes."""

    def fours(found: Column) -> Column:
        n = F.floor(F.size(found) / 4).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.slice(found, (i - 1) * 4 + 1, 4))).otherwise(F.array().cast("array<array<bigint>>"))

    return let(numbers(c), fours)


def strip_special(c: Column, rounds: int = 8) -> Column:
    """Without control tokens and page markers, however deeply they are nested: passes until nothing changes, and after the last one no '<' stays if any is left."""
    once = lambda x: F.regexp_replace(F.regexp_replace(x, SPECIAL, ""), "<PAGE>", "")
    out = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), c, lambda acc, _: once(acc))
    return F.when(out.rlike(f"{SPECIAL}|<PAGE>"), F.replace(out, F.lit("<"), F.lit(" "))).otherwise(out)


def inert_markdown(c: Column, cap: int = 100_000, marker: str = "\n[truncated]") -> Column:
    """A text layer as an indented block: newlines and tabs normalised, control characters dropped, line ends trimmed; null without a letter or digit."""
    text = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "\t", "    ")
    text = F.regexp_replace(text, r"[\x00-\x09\x0b-\x1f\x7f]", "")
    text = F.array_join(F.transform(lines(text), lambda x: F.regexp_replace(x, f"{WHITE}+\\z", "")), "\n")
    text = F.regexp_replace(text, r"^\n+|\n+\z", "")
    text = F.when(F.length(text) > cap, F.concat(F.left(text, F.lit(cap)), F.lit(marker))).otherwise(text)
    return F.when(text.rlike(r"[\p{L}\p{N}]"), F.array_join(F.transform(lines(text), lambda x: F.concat(F.lit("    "), x)), "\n"))


def structure_counts(c: Column) -> dict[str, Column]:
    """Counts of a Markdown page's structure."""
    return {
        "chars": F.length(c).cast("long"),
        "figures": F.regexp_count(c, F.lit(r"!\[[^\]]*\]\(")).cast("long"),
        "tables": F.regexp_count(F.lower(c), F.lit("<table")).cast("long"),
        "formulas": F.regexp_count(c, F.lit(r"\\\[|\\\(|\$\$")).cast("long"),
    }
