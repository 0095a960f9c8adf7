"""Visually identical text brought to one form.

Compatibility normalisation in composed form, mapped white space, default-ignorable characters removed, letters of
other alphabets that look alike mapped to Latin; full case folding on request. Worked out once per distinct character
and applied once per distinct value of a batch. Differences that a reader sees are kept: case (unless folded), super-
and subscripts, fractions, circled and squared characters, joiners that shape emoji or Arabic and Indic letters.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.skew import HOT_ROWS, hot_split_join
from skeinwork.session import cut

# Letters and marks of other alphabets (Cyrillic, Greek, phonetic, Armenian, Cherokee, Lisu, Coptic) with the
# Latin (or ASCII) ones they look like. Letters that only resemble each other (Greek alpha and a) stay apart.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ρ": "p",
    "ϲ": "c", "ϳ": "j", "Ϲ": "C", "ү": "y", "Ԍ": "G",
    "Օ": "O", "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "յ": "j", "Ս": "U", "Տ": "S", "Լ": "L", "ɡ": "g", "ɑ": "a",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X", "ⲭ": "x",
    "‐": "-", "‑": "-",
}
# Compatibility decompositions that change what a reader sees.
SEEN = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>")
_SHAPED = r"[\p{Arabic}\p{Syriac}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Gujarati}\p{Gurmukhi}\p{Kannada}\p{Malayalam}\p{Oriya}\p{Sinhala}\p{Tamil}\p{Telugu}\p{Khmer}]\p{M}*"
_IGNORED = regex.compile(
    r"(?<=\p{Extended_Pictographic}[️\p{Emoji_Modifier}]*)‍(?=\p{Extended_Pictographic})(*SKIP)(*FAIL)"
    r"|(?<=\p{Extended_Pictographic})[︎️](*SKIP)(*FAIL)"
    r"|\U0001f3f4[\U000e0020-\U000e007f]+(*SKIP)(*FAIL)"
    rf"|(?<={_SHAPED})[‌‍](?={_SHAPED})(*SKIP)(*FAIL)"
    r"|\p{Default_Ignorable_Code_Point}+"
)


class _Characters(dict):
    """Code point -> what it becomes, worked out when first seen."""

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(self.base(c) for c in self.split(chr(code)))
        return out

    def split(self, c: str) -> str:
        parts = unicodedata.decomposition(c).split()
        if not parts or parts[0] in SEEN or c == "ſ":
            return unicodedata.normalize("NFD", c)
        return "".join(self.split(chr(int(p, 16))) for p in parts if p[0] != "<")

    def base(self, c: str) -> str:
        if c in "\u2028\u2029\x85":
            return "\n"
        if unicodedata.category(c) == "Zs" or c == "\u2800":
            return " "
        return LOOK_ALIKES.get(c, c)


_CHARACTERS = _Characters()


def look(text: str) -> str:
    """The form in which texts that look the same are equal."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", _IGNORED.sub("", text).translate(_CHARACTERS))


def look_folded(text: str) -> str:
    """The same with full case folding, for comparisons that ignore case."""
    return unicodedata.normalize("NFC", look(text).casefold())


def _vectorised(of):
    def run(values: pd.Series) -> pd.Series:
        distinct = {v: of(v) for v in values.unique() if v is not None and v == v}
        return pd.Series([distinct.get(v) for v in values], index=values.index, dtype=object)

    return run


def unified(text: Column | str, fold: bool = False) -> Column:
    """Text in its one form; null stays null, text of ignorable characters only becomes empty."""
    return F.pandas_udf(_vectorised(look_folded if fold else look), "string")(text)


def same_look_pairs(docs: DataFrame, doc_id: str, text: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents of different characters but equal look. Null texts are in no pair.

    Only fingerprints travel. Pairs are formed between distinct texts of a look and then expanded to their documents,
    so copies of one text never meet each other; the copies of a hot text are spread over tasks.
    """
    prints = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.sha2(text, 256).alias("t"), F.sha2(unified(text), 256).alias("f"))
    prints = cut(prints, "prints")
    texts = prints.groupBy("f", "t").agg(F.count("*").alias("n"))
    mixed = texts.groupBy("f").agg(F.count("*").alias("k")).filter("k > 1").select("f")
    texts = cut(texts.join(mixed, "f"), "texts")
    # Documents of a look with several texts; a text of very many copies is broadcast, which is bounded (see `skew`).
    members = cut(hot_split_join(prints.select("id", "t"), texts.select("t", "n", F.col("n").alias("of")), ["t"], "n", hot_rows), "members")
    parts = lambda n: F.ceil(F.col(n) / hot_rows).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    slot = F.pmod(F.xxhash64("id"), parts("of")).cast("int")
    one, two = texts.select("f", F.col("t").alias("t1"), F.col("n").alias("n1")), texts.select("f", F.col("t").alias("t2"), F.col("n").alias("n2"))
    pairs = one.join(two, "f").filter("t1 < t2").select("t1", "t2", "n2", every("n1").alias("s1"))
    left = members.select(F.col("id").alias("a"), F.col("t").alias("t1"), slot.alias("s1"))
    right = members.select(F.col("id").alias("b"), F.col("t").alias("t2"), slot.alias("s2"))
    out = pairs.join(left, ["t1", "s1"]).select("a", "t2", every("n2").alias("s2")).join(right, ["t2", "s2"])
    return out.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
