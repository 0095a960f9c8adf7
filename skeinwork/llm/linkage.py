"""Matching entities across sources that share no key: evidence per candidate pair, then loopy belief propagation.

Candidates agree on one of several block keys (the title; either end of the title with the year, or alone where a year is
missing; director with part of the title, genres or running time; director with year, tolerant of one typing error). Every
attribute adds to a pair's log odds. A factor of each record then allows it at most one entity, and a factor of each entity makes further records of it less likely but possible; both send messages along the pairs, as joins
on sums per node, until they settle. What results is each pair's marginal probability.
"""

from __future__ import annotations

import unicodedata
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.session import cut, drop_cut

# Base letters of Latin letters with accents, from Unicode's own decompositions.
_ACCENTED = [chr(c) for c in range(0xC0, 0x250) if unicodedata.decomposition(chr(c)) and unicodedata.decomposition(chr(c))[0] != "<"]
_BASE = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)
ARTICLES = "the|a|an"
#: Entities of a block in one slot.
SLOT_ROWS = 500
#: Log odds below which a pair takes no part: messages only ever lower odds, so it cannot come out, and moves others little.
FLOOR = -4.0
# Log odds of each level of agreement.
WEIGHTS = {
    "title": (0.0, -1.0, -2.5, -4.5, -9.0), "number": -6.0, "director": (7.0, 5.5, 4.0, -4.5), "year": (3.0, 1.0, -2.0, -5.0),
    "runtime": (2.5, 1.5, -1.0, -3.0), "genres": (2.0, 1.0, 0.0, -2.0), "language": (0.5, -1.0),
}
#: Each further record of one entity divides its odds by this, once another is certain.
REPEAT = 4.0


def folded(c: Column) -> Column:
    """Lower case without accents; apostrophes gone, other marks as single blanks."""
    c = F.translate(c, "".join(_ACCENTED), _BASE)
    c = F.regexp_replace(F.lower(F.regexp_replace(c, r"[\p{M}'’`]", "")), r"[^\p{L}\p{N}]+", " ")
    return F.trim(c)


def additions(entity_titles: DataFrame, record_titles: DataFrame, least: int = 5, per: int = 1000, ratio: float = 10.0) -> list[str]:
    """Folded phrases that the records' source adds to titles after a colon, learned from both tables (one column each).

    A phrase counts if one record in `per` (and `least` records) has it, which bounds their number by `per`, and if it is
    `ratio` times as common among the records as at the end of the entities' titles: a true subtitle is on both sides.
    """
    title = lambda df: F.col(df.columns[0])
    sizes = entity_titles.count(), record_titles.count()
    r = record_titles.select(folded(F.regexp_extract(title(record_titles), r":\s*([^:]+)$", 1)).alias("phrase")).filter("phrase <> ''").groupBy("phrase").agg(F.count("*").alias("n"))
    r = cut(r.filter(F.col("n") >= max(least, sizes[1] / per)), "phrases")
    words = F.split(folded(title(entity_titles)), " ")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(8))), lambda k: F.array_join(F.slice(words, F.size(words) - k + 1, k), " "))
    e = entity_titles.filter(title(entity_titles).isNotNull()).select(F.explode(ends).alias("phrase")).join(F.broadcast(r), "phrase", "left_semi").groupBy("phrase").agg(F.count("*").alias("there"))
    found = r.join(e, "phrase", "left").filter(F.col("n") / max(1, sizes[1]) > ratio * F.coalesce("there", F.lit(0)) / max(1, sizes[0]))
    return sorted((x["phrase"] for x in found.collect()), key=lambda x: (-len(x), x))


def title_parts(c: Column, added: Sequence[str] = ()) -> dict[str, Column]:
    """core: letters of the title without article, edition (`added`) and number; number: of a sequel; cut_off: the title was truncated."""
    bare = F.regexp_replace(c, r"[\(\[][^\)\]]*([\)\]]|…|$)", " ")
    inverted = F.regexp_replace(bare, rf"(?i)^\s*(.*),\s*({ARTICLES})\s*$", "$2 $1")
    t = folded(inverted)
    if added:
        t = F.regexp_replace(t, rf" ({'|'.join(added)})$", "")
    roman = F.regexp_extract(t, r" (ii|iii|iv|v|vi|vii|viii|ix)$", 1)
    digits = F.regexp_extract(t, r" ([0-9]+)$", 1)
    numbers = F.create_map(*[F.lit(x) for pair in zip(("ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"), "23456789", strict=True) for x in pair])
    number = F.when(digits != "", digits).when(roman != "", numbers[roman]).otherwise("")
    t = F.regexp_replace(F.regexp_replace(t, r" ([0-9]+|ii|iii|iv|v|vi|vii|viii|ix)$", ""), rf"^({ARTICLES}) ", "")
    core = F.regexp_replace(t, " ", "")
    return {"core": F.when(core != "", core), "number": number, "cut_off": F.coalesce(c.rlike(r"…\s*$"), F.lit(False))}


def people(c: Column) -> Column:
    """Names as `first last`: a list is split at commas, `Last, First` is turned round."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.regexp_replace(folded(F.regexp_replace(x, "-", "")), r"\s+", " ")), lambda x: x != "")
    one = F.size(F.filter(parts, lambda x: x.contains(" "))) == 0
    return F.when((F.size(parts) == 2) & one, F.array(F.concat_ws(" ", parts[1], parts[0]))).otherwise(parts)


def genres(c: Column, separator: str) -> Column:
    return F.array_sort(F.filter(F.transform(F.split(c, separator), lambda x: F.lower(F.trim(x))), lambda x: ~x.isin("", "unknown")))


def described(df: DataFrame, key: Column, title: Column, year: Column, runtime: Column, director: Column, kinds: Column, language: Column, added: Sequence[str] = ()) -> DataFrame:
    """One row per key in a common form; of several rows of one key the first in order of all columns."""
    p = title_parts(title, added)
    rows = df.select(key.alias("key"), p["core"].alias("core"), p["number"].alias("number"), p["cut_off"].alias("cut_off"), year.cast("int").alias("year"), runtime.cast("int").alias("runtime"), director.alias("people"), kinds.alias("genres"), language.alias("language"))
    rows = rows.filter(F.col("key").isNotNull())
    rest = [c for c in rows.columns if c != "key"]
    return rows.groupBy("key").agg(F.min(F.struct(*rest)).alias("m")).select("key", "m.*")


def _surname(name: Column) -> Column:
    return F.element_at(F.split(name, " "), -1)


def _near(value: str, by: int) -> Column:
    """value - by .. value + by; null if the value is."""
    return F.when(F.col(value).isNotNull(), F.sequence(F.col(value) - by, F.col(value) + by))


def _keys(wide: bool) -> Column:
    """Block keys of a record, hashed; `wide` for the side whose numbers are spread to neighbouring values.

    Two keys of one hash make a block of more pairs, never of fewer.
    """
    no_ends = F.array().cast("array<string>")
    years, times = (_near("year", 1), _near("runtime", 3)) if wide else (F.when(F.col("year").isNotNull(), F.array("year")), F.when(F.col("runtime").isNotNull(), F.array("runtime")))
    names = F.array_distinct(F.transform(F.coalesce("people", no_ends), _surname))
    # One end of a title survives a typing error; longer titles have longer ends, and those about 12 letters both.
    ends_of = lambda n: F.array(F.concat(F.lit(f"<{n}"), F.substring("core", 1, n)), F.concat(F.lit(f">{n}"), F.substring("core", -n, n)))
    ends = F.concat(F.when(F.length("core") <= 13, ends_of(5)).otherwise(no_ends), F.when(F.length("core") >= 12, ends_of(7)).otherwise(no_ends))
    # With a year even the shortest titles have ends apart from their middle.
    dated = F.concat(ends, F.when(F.length("core") <= 9, ends_of(3)).otherwise(no_ends), F.when(F.length("core") <= 7, ends_of(2)).otherwise(no_ends))
    # A pair that lacks a year on either side: that side's rows meet all of the other side's.
    undated = lambda tag, those: F.when(those, F.transform(ends, lambda t: F.concat_ws("|", F.lit(tag), t))).otherwise(no_ends)
    # And one end of a surname with one end of the first name; or the whole surname, whatever the first name is.
    name_ends = F.array_distinct(F.flatten(F.transform(F.coalesce("people", no_ends), _name_ends)))
    tagged = lambda tag, values, with_: F.transform(F.coalesce(values, no_ends), lambda v: F.concat_ws("|", F.lit(tag), with_, v.cast("string")))
    each = lambda tag, numbers, texts: F.flatten(F.transform(F.coalesce(numbers, F.array().cast("array<int>")), lambda y: F.transform(texts, lambda t: F.concat_ws("|", F.lit(tag), y.cast("string"), t))))
    every = F.concat(
        F.array(F.concat(F.lit("t|"), "core")),
        each("ye", years, dated),
        undated("ne", F.lit(True) if wide else F.col("year").isNull()),
        undated("nr", F.col("year").isNull() if wide else F.lit(True)),
        tagged("dp", names, F.substring("core", 1, 5)),
        tagged("ds", names, F.substring("core", -4, 4)),
        tagged("dg", names, F.when(F.size("genres") > 0, F.to_json("genres"))),
        each("dr", times, names),
        each("dy", years, name_ends),
        each("dn", years, names),
    )
    hashed = F.array_distinct(F.transform(every, lambda k: F.xxhash64(k)))
    return F.when(F.col("core").isNotNull(), hashed).otherwise(F.array().cast("array<bigint>"))


def _surname_ends(s: Column) -> Column:
    """Both ends of a surname, one of which survives a typing error."""
    n = F.when(F.length(s) <= 6, 2).otherwise(3)
    return F.array(F.concat(F.lit("<"), F.substr(s, F.lit(1), n)), F.concat(F.lit(">"), F.substr(s, F.greatest(F.length(s) - n + 1, F.lit(1)), n)))


def _name_ends(name: Column) -> Column:
    """Ends of the surname, each with either end of the first name.

    Two typing errors leave one of them or, if both are in the first name, the surname; an initial keeps its letter.
    """
    first = F.element_at(F.split(name, " "), 1)
    return F.flatten(F.transform(_surname_ends(_surname(name)), lambda s: F.array(F.concat(s, F.lit("<"), F.substring(first, 1, 1)), F.concat(s, F.lit(">"), F.substring(first, -2, 2)))))


def _bit(of: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(of, F.lit(64)).cast("int"))


def _letters(c: Column) -> Column:
    """A bit for every letter that occurs. An edit changes two bits at most, so texts d edits apart differ in 2 d bits."""
    bits = F.transform(F.split(c, ""), lambda x: _bit(F.ascii(x)))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _grams(c: Column, part: int = 0, parts: int = 2) -> Column:
    """Bits 64 * part to 64 * part + 63 of 64 * parts for the pairs of neighbouring letters. An edit removes two pairs at most
    and adds two, so of texts d edits apart either has 2 d bits at most that the other lacks."""
    padded = F.concat(F.lit("^"), c, F.lit("$"))
    hashes = F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.pmod(F.xxhash64(F.substr(padded, i, F.lit(2))), F.lit(64 * parts)))
    return F.aggregate(F.filter(hashes, lambda h: F.floor(h / 64) == part), F.lit(0).cast("long"), lambda a, h: a.bitwiseOR(_bit(h)))


def sketched(rows: DataFrame) -> DataFrame:
    """Rows with a number `n` and what `bound` needs of them, in a few integers (s_...)."""
    squeezed = F.regexp_replace(F.col("people")[0], " ", "")
    only = F.size("people") == 1
    # Of all names; null where a single letter may stand for a name.
    spelt = ~F.exists("people", lambda n: F.length(F.element_at(F.split(n, " "), 1)) <= 1)
    names = F.aggregate(F.transform("people", lambda n: _grams(F.regexp_replace(n, " ", ""), parts=1)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    kinds = F.aggregate(F.transform("genres", lambda g: _bit(F.xxhash64(g))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return rows.select(
        "*", F.monotonically_increasing_id().alias("n"), F.length("core").alias("s_length"), _letters(F.col("core")).alias("s_letters"), *[_grams(F.col("core"), k).alias(f"s_grams{k}") for k in range(2)], F.hash("number").alias("s_number"),
        # 0: nobody is known, 1: one name, 2: several names or an initial, of which the letters tell too little.
        F.when(F.coalesce(F.size("people"), F.lit(0)) <= 0, 0).when(only & (F.length(F.element_at(F.split(F.col("people")[0], " "), 1)) > 1), 1).otherwise(2).alias("s_named"),
        F.when(only, _letters(squeezed)).alias("s_name"), F.when(only, F.hash(_surname(F.col("people")[0]))).alias("s_surname"), F.when((F.size("people") > 0) & spelt, names).alias("s_name_grams"), F.when(only, F.length(squeezed)).alias("s_name_length"),
        F.when(F.size("genres") > 0, kinds).alias("s_genres"), F.hash("language").alias("s_language"),
    )


SKETCH = ("n", "year", "runtime", "cut_off", "s_length", "s_letters", "s_grams0", "s_grams1", "s_number", "s_named", "s_name", "s_surname", "s_name_grams", "s_name_length", "s_genres", "s_language")


def _once(value: Column, use) -> Column:
    """`use` of a value that is worked out once. A join with such a condition is not one method with its condition, which the
    JVM would leave uncompiled for its length."""
    return F.transform(F.array(value), use)[0]


def bound(e, r) -> Column:
    """No less than the log odds of a pair, from the two rows' sketches: what cannot reach the floor is not compared."""
    differ = lambda name: F.bit_count(e(name).bitwiseXOR(r(name)))
    apart = F.greatest(F.abs(e("s_length") - r("s_length")), F.ceil(differ("s_letters") / 2), F.ceil((differ("s_grams0") + differ("s_grams1")) / 4))
    title = F.when(r("cut_off"), 0.0).otherwise(_once(apart / F.greatest(e("s_length"), r("s_length")), lambda x: _step(x, (0.0, 0.12, 0.22, 0.34), WEIGHTS["title"])))
    number = F.when((e("s_number") != r("s_number")) & ~r("cut_off"), WEIGHTS["number"]).otherwise(0.0)
    off = F.greatest(F.abs(e("s_name_length") - r("s_name_length")), F.ceil(differ("s_name") / 2))
    exact, close, near, wrong = WEIGHTS["director"]
    # An initial agrees by its surname; otherwise so many letters differ.
    letters = lambda best: _once(off, lambda x: F.when((x == 0) & F.lit(best == exact), exact).when(x <= 1, close).when(x <= 2, near).otherwise(wrong))
    initial = F.when((e("s_name").isNotNull()) & (r("s_name").isNotNull()) & (e("s_surname") != r("s_surname")), letters(close)).otherwise(exact)
    # One name of the other side's several has nearly all pairs of letters of a single name; of two single names either has.
    lacks = lambda a, b: F.when(a("s_named") == 1, F.ceil(F.bit_count(a("s_name_grams").bitwiseAND(F.bitwise_not(b("s_name_grams")))) / 2))
    lacking = F.greatest(lacks(e, r), lacks(r, e))
    director = F.when((e("s_named") == 0) | (r("s_named") == 0), 0.0).when((e("s_named") == 1) & (r("s_named") == 1), letters(exact)).otherwise(initial)
    director = F.least(director, _once(lacking, lambda x: F.when(x <= 0, exact).when(x <= 1, close).when(x <= 2, near).when(x > 2, wrong)))
    year = _once(F.abs(e("year") - r("year")), lambda x: _step(x, (0, 1, 2), WEIGHTS["year"]))
    runtime = _once(F.abs(e("runtime") - r("runtime")), lambda x: _step(x, (1, 4, 8), WEIGHTS["runtime"]))
    same, some, _, none = WEIGHTS["genres"]
    kinds = F.when(e("s_genres").isNull() | r("s_genres").isNull(), 0.0).when(e("s_genres") == r("s_genres"), same).when(e("s_genres").bitwiseAND(r("s_genres")) == 0, none).otherwise(some)
    language = F.when(e("s_language") == r("s_language"), WEIGHTS["language"][0]).otherwise(0.0)
    return title + number + director + year + runtime + kinds + language - e("common")


def candidates(entities: DataFrame, records: DataFrame, floor: float | None = FLOOR, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Distinct (e, r), the numbers of the rows that share a block key, all of them whose log odds can reach `floor`.

    Both tables in `sketched` form, entities with `common`. Only keys and sketches travel, and a pair below its bound leaves
    in the join that makes it. The entities of a block of more than `slot_rows` are spread over slots, each of which meets
    the block's records, so that no task compares a large block alone. `floor` None: no pair is left out.
    """
    side = lambda df, name, wide, *more: df.select(F.explode(_keys(wide)).alias("block"), F.struct(*SKETCH, *more).alias(name))
    e, r = side(entities, "e", False, "common"), side(records, "r", True)
    large = cut(e.groupBy("block").agg(F.count("*").alias("rows")).filter(F.col("rows") > slot_rows).select("block", F.ceil(F.col("rows") / slot_rows).cast("int").alias("slots")), "blocks")
    on = ["block"]
    if not large.isEmpty():
        slots = F.coalesce("slots", F.lit(1))
        e = e.join(large, "block", "left").select("block", "e", F.pmod(F.col("e.n"), slots).cast("int").alias("slot"))
        r = r.join(large, "block", "left").select("block", "r", F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"))
        on = ["block", "slot"]
    pairs = e.join(r, on)
    if floor is not None:
        pairs = pairs.filter(bound(lambda c: F.col(f"e.{c}"), lambda c: F.col(f"r.{c}")) >= floor)
    return pairs.select(F.col("e.n").alias("e"), F.col("r.n").alias("r")).distinct()


def _step(value: Column, at: tuple, weights: tuple) -> Column:
    """The weight of the first limit that the value does not exceed, else the last; 0 for null."""
    out = F.lit(weights[-1])
    for limit, w in reversed(list(zip(at, weights, strict=False))):
        out = F.when(value <= limit, w).otherwise(out)
    return F.when(value.isNull(), 0.0).otherwise(out)


def evidence(entities: DataFrame, records: DataFrame, pairs: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(e, r, odds): the keys and the log odds of each candidate pair of at least `floor`, a common title counting for less."""
    columns = ("key", "core", "number", "cut_off", "year", "runtime", "people", "genres", "language")
    e = entities.select(F.col("n").alias("e"), "common", *[F.col(c).alias(f"e_{c}") for c in columns if c != "cut_off"])
    r = records.select(F.col("n").alias("r"), *[F.col(c).alias(f"r_{c}") for c in columns])
    p = pairs.join(e, "e").join(r, "r")
    core = F.when(F.col("r_cut_off"), F.substring(F.col("e_core"), F.lit(1), F.length("r_core"))).otherwise(F.col("e_core"))
    away = F.levenshtein(core, F.col("r_core")) / F.greatest(F.length(core), F.length("r_core"))
    title = _step(away, (0.0, 0.12, 0.22, 0.34), WEIGHTS["title"]) - F.when(F.col("r_cut_off") & (F.length("e_core") > F.length("r_core")), 1.0).otherwise(0.0)
    number = F.when((F.col("e_number") != F.col("r_number")) & ~F.col("r_cut_off"), WEIGHTS["number"]).otherwise(0.0)
    first = lambda n: F.element_at(F.split(n, " "), 1)

    def name_level(a: Column, b: Column) -> Column:
        initial = (_surname(a) == _surname(b)) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & ((F.length(first(a)) == 1) | (F.length(first(b)) == 1))
        squeezed_a, squeezed_b = F.regexp_replace(a, " ", ""), F.regexp_replace(b, " ", "")
        apart = F.levenshtein(squeezed_a, squeezed_b)
        return F.when(a == b, 0).when(initial | (apart <= 1), 1).when(apart <= 2, 2).otherwise(3)

    levels = F.array_min(F.flatten(F.transform("e_people", lambda a: F.transform("r_people", lambda b: name_level(a, b)))))
    level = F.when((F.size("e_people") == 1) & (F.size("r_people") == 1), name_level(F.col("e_people")[0], F.col("r_people")[0])).when((F.size("e_people") > 0) & (F.size("r_people") > 0), levels)
    director = _step(level, (0, 1, 2), WEIGHTS["director"])
    year = _step(F.abs(F.col("e_year") - F.col("r_year")), (0, 1, 2), WEIGHTS["year"])
    runtime = _step(F.abs(F.col("e_runtime") - F.col("r_runtime")), (1, 4, 8), WEIGHTS["runtime"])
    shared = F.size(F.array_intersect("e_genres", "r_genres")) / F.size(F.array_union("e_genres", "r_genres"))
    kinds = _step(F.when((F.size("e_genres") > 0) & (F.size("r_genres") > 0), 1 - shared), (0.0, 0.5, 0.99), WEIGHTS["genres"])
    language = F.when(F.col("e_language").isNull() | F.col("r_language").isNull(), 0.0).when(F.col("e_language") == F.col("r_language"), WEIGHTS["language"][0]).otherwise(WEIGHTS["language"][1])
    odds = title + number + director + year + runtime + kinds + language - F.col("common")
    return p.select(F.col("e_key").alias("e"), F.col("r_key").alias("r"), odds.alias("odds")).filter(F.col("odds") >= floor)


def marginals(pairs: DataFrame, repeat: float = REPEAT, floor: float = FLOOR, tolerance: float = 1e-3, max_rounds: int = 60, damping: float = 0.5) -> DataFrame:
    """(e, r, probability) of every pair whose log odds are at least `floor`, by belief propagation on (e, r, odds).

    A node's outgoing message depends on the sum over its pairs less the pair's own part, so each half-round is one
    aggregation and one join, and a node with millions of pairs costs no more than its pairs.
    """
    p = cut(pairs.filter(F.col("odds") >= floor).select("e", "r", "odds", F.lit(0.0).alias("from_r"), F.lit(0.0).alias("from_e")), "messages")
    rho = 1.0 / repeat
    for _ in range(max_rounds):
        to_r = F.exp(F.least(F.col("odds") + F.col("from_e"), F.lit(500.0)))
        to_e = F.log1p(F.lit(rho) * F.exp(F.least(F.col("odds") + F.col("from_r"), F.lit(500.0))))
        rs = p.groupBy("r").agg(F.sum(to_r).alias("sum_r"))
        es = p.groupBy("e").agg(F.sum(to_e).alias("sum_e"))
        q = p.join(rs, "r").join(es, "e")
        # r: none of the others may be on. e: others multiply the odds by rho each.
        others_r = F.greatest(F.col("sum_r") - to_r, F.lit(0.0))
        others_e = F.greatest(F.col("sum_e") - to_e, F.lit(0.0))
        new_r = -F.log1p(others_r)
        new_e = F.when(others_e < 1e-12, 0.0).otherwise(others_e - F.when(others_e > 500, others_e + F.log(F.lit(1 / rho))).otherwise(F.log1p((F.exp(others_e) - 1) / rho)))
        mixed = lambda old, new: F.col(old) * (1 - damping) + new * damping
        q = q.select("e", "r", "odds", mixed("from_r", new_r).alias("from_r"), mixed("from_e", new_e).alias("from_e"), F.greatest(F.abs(new_r - F.col("from_r")), F.abs(new_e - F.col("from_e"))).alias("moved"), F.col("from_r").alias("old_r"), F.col("from_e").alias("old_e"))
        sigmoid = lambda a, b: 1 / (1 + F.exp(-(F.col("odds") + F.col(a) + F.col(b))))
        q = cut(q.select("e", "r", "odds", "from_r", "from_e", F.abs(sigmoid("from_r", "from_e") - sigmoid("old_r", "old_e")).alias("moved")), "messages")
        drop_cut(p)
        p = q.drop("moved")
        p._skein_path = q._skein_path
        moved = q.agg(F.max("moved")).first()[0]
        if moved is None or moved < tolerance:
            break
    else:
        warnings.warn(f"probabilities still moved by {moved:.2g} after {max_rounds} rounds of propagation", stacklevel=2)
    total = F.col("odds") + F.col("from_r") + F.col("from_e")
    return p.select("e", "r", (1 / (1 + F.exp(-total))).alias("probability"))


def with_common(entities: DataFrame) -> DataFrame:
    """Entities with `common`, the log of how many of them have the same title and number."""
    same = entities.filter("core is not null").groupBy("core", "number").agg(F.log(F.count("*").cast("double")).alias("common"))
    return entities.join(same, ["core", "number"], "left").withColumn("common", F.coalesce("common", F.lit(0.0)))


def match(entities: DataFrame, records: DataFrame, **how) -> DataFrame:
    """(e, r, probability) of the pairs of two tables in `described` form.

    Records without a title get no candidate. Null attributes count neither for nor against. Either table empty: no rows.
    """
    entities, records = cut(sketched(with_common(entities)), "entities"), cut(sketched(records), "records")
    return marginals(evidence(entities, records, candidates(entities, records)), **how)
