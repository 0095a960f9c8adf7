"""String functions: titles, names, money, spans, keys and signatures."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x250)) if (d := unicodedata.decomposition(c)) and d[0] != "<")
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)
# Named entities of HTML text that occur in prose.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
NO_TEXT = "unknown_text"
FRANCHISE_WORDS = ("part", "chapter", "episode", "volume", "returns", "sequel", "saga")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def ascii_folded(c: Column) -> Column:
    """Letters without their accents; what is not ASCII after that is dropped."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"[^\x00-\x7F]", "")


def title_key(c: Column) -> Column:
    """Lower case, every run of other than a-z and 0-9 one blank, trimmed; null if nothing is left."""
    return blank_to_null(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")))


def title_key_without_year(c: Column) -> Column:
    """Without a year in brackets at the end; letters and digits of any alphabet are kept."""
    bare = F.regexp_replace(F.lower(c), r"\s*\([0-9]{4}\)\s*$", "")
    return blank_to_null(F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " ")))


def title_key_ascii(c: Column) -> Column:
    return title_key(ascii_folded(c))


def title_without_years(c: Column) -> Column:
    """Without years in brackets anywhere, blanks collapsed, letters as they are."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\([0-9]{4}\)", ""), r"\s+", " "))


def title_without_year_marks(c: Column) -> Column:
    """The loose form: brackets, braces, digits 4 and letters d vanish one by one."""
    return F.trim(F.regexp_replace(c, r"[(\[d{4})\]]", ""))


def year_in_title(c: Column) -> Column:
    return F.regexp_extract(c, r"\(([0-9]{4})\)", 1).try_cast("int")


def clean_text(c: Column, stop_words: Sequence[str] = (), sentinel: str | None = NO_TEXT) -> Column:
    """Entities, tags and punctuation removed, lower case, single blanks; nothing left gives the sentinel."""
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    c = F.regexp_replace(F.lower(c), r"<[^>]*>", " ")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " ")
    if stop_words:
        c = F.regexp_replace(c, rf"\b({'|'.join(stop_words)})\b", " ")
    c = blank_to_null(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.coalesce(c, F.lit(sentinel)) if sentinel is not None else c


def canonical_name(c: Column, aliases: Mapping[str, str]) -> Column:
    """The alias' target, else the words capitalised with `and` as `&`."""
    key = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(table[key], F.replace(F.initcap(key), F.lit(" And "), F.lit(" & ")))


def money(c: Column) -> Column:
    """The number in currency text: sign and separators removed, bn, b, m and k applied; null if it is no number."""
    t = F.lower(F.regexp_replace(c, r"[£€$,\s]", ""))
    scale = F.when(t.rlike("bn?$"), 1e9).when(t.endswith("m"), 1e6).when(t.endswith("k"), 1e3).otherwise(1.0)
    return F.regexp_replace(t, "(bn|b|m|k)$", "").try_cast("double") * scale


def whole_number(c: Column) -> Column:
    """A whole number with separators of thousands (comma or point)."""
    return F.regexp_replace(c, "[,.]", "").try_cast("long")


def tenure_months(c: Column) -> Column:
    """Months in a text such as `2 years 3 months 10 days`, days as thirtieths; null unless above 0."""
    n = lambda unit: F.coalesce(F.regexp_extract(F.lower(c), rf"([0-9]+)\s*{unit}", 1).try_cast("double"), F.lit(0.0))
    months = n("y") * 12 + n("m") + n("d") / 30
    return F.when(months > 0, months)


def clock(c: Column) -> Column:
    """HH:MM of `9:5`, `09.05` and the like; null if it is no time of day."""
    h, m = F.regexp_extract(c, r"^\s*(\d{1,2})[:.](\d{1,2})", 1), F.regexp_extract(c, r"^\s*(\d{1,2})[:.](\d{1,2})", 2)
    return F.when((h.try_cast("int") < 24) & (m.try_cast("int") < 60), F.concat(F.lpad(h, 2, "0"), F.lit(":"), F.lpad(m, 2, "0")))


def padded_id(c: Column, prefix: str = "tt", width: int = 7) -> Column:
    """prefix and the number padded with zeros; a longer number keeps all its digits."""
    digits = F.regexp_replace(F.regexp_extract(c.cast("string"), "([0-9]+)", 1), "^0+(?=.)", "")
    return F.when(digits != "", F.concat(F.lit(prefix), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))))


def flags(c: Column, patterns: Mapping[str, str]) -> dict[str, Column]:
    """name -> 1 if the lower-case text holds the pattern, else 0 (also for null)."""
    return {name: F.coalesce(F.lower(c).rlike(p), F.lit(False)).cast("int") for name, p in patterns.items()}


def before_dash(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*?)(?: - .*)?$", 1)


def split_trimmed(c: Column, separator: str = ",") -> Column:
    """Parts without blanks at their ends, empty ones left out; null stays null."""
    return F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != "")


def sha1_id(*cols: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *cols)), 1, length)


def combined_id(*cols: Column) -> Column:
    """MD5 over the parts in sorted order, nulls left out."""
    return F.md5(F.array_join(F.array_sort(F.filter(F.array(*cols), lambda x: x.isNotNull())), "|"))


def bucket_of(c: Column, buckets: int = 100) -> Column:
    """The first 8 hexadecimal digits of SHA-256, modulo the number of buckets: the same on every system."""
    return (F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def filter_signature(**parts: Column) -> Column:
    """One text for a set of filters, whatever the order their values were given in."""
    return F.concat_ws(";", *[F.concat(F.lit(f"{name}="), F.coalesce(F.array_join(F.array_sort(F.array_distinct(col)), ","), F.lit("*"))) for name, col in sorted(parts.items())])


def is_franchise(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(rf"\b({'|'.join(FRANCHISE_WORDS)}|[2-9]|ii|iii|iv)\b"), F.lit(False))
