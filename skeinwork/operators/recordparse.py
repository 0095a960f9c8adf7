"""Delimited records: valid rows typed, broken ones located.

A recursive-descent grammar, text = record (newline record)*, record = field (separator field)*, field = quoted | bare.
A broken quote ends the record it is in; the parser records where and why, then resumes at the next validated
record start: a line start that looks like one and from which a whole record parses.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.ordered import positions_by


class Broken(Exception):
    def __init__(self, at: int, column: int, opened: int):
        """opened: where the broken field begins; what follows may belong to other records."""
        self.at, self.column, self.opened = at, column, opened


@dataclass(frozen=True)
class Grammar:
    """`checks`: column number -> pattern that the whole value must match, and a test of the match."""

    separator: str
    columns: tuple[str, ...]
    quote: str = ""
    anchor: str = ""
    checks: dict = field(default_factory=dict)


@dataclass
class Record:
    start: int
    end: int
    fields: list[str]
    reason: str | None = None
    at: int | None = None
    column: int | None = None


class Parser:
    def __init__(self, grammar: Grammar, whole: bool):
        """whole: the text is one record, in which line breaks are data."""
        self.g, self.whole = grammar, whole
        stop = re.escape(grammar.separator) + ("" if whole else r"\n")
        self.bare_re = re.compile(f"[^{stop}]*")
        q = re.escape(grammar.quote)
        self.quoted_re = re.compile(f"{q}((?:[^{q}]|{q}{q})*){q}") if grammar.quote else None
        self.anchor_re = re.compile(r"(?:(?<=\n)|^)" + f"(?:{grammar.anchor})") if grammar.anchor else None

    def text(self, s: str) -> Iterator[Record]:
        pos = 0
        while True:
            record = self.record(s, pos)
            yield record
            if record.end >= len(s):
                return
            pos = record.end + (0 if record.reason == "quoting" else 1)

    def record(self, s: str, pos: int) -> Record:
        out = Record(pos, pos, [])
        try:
            out.end = self.fields(s, pos, out.fields)
        except Broken as e:
            out.reason, out.at, out.column = "quoting", e.at, e.column
            out.end = self.resume(s, e.opened)
            return out
        if not self.whole and out.fields[-1].endswith("\r") and s[out.end - 1 : out.end] == "\r":
            out.fields[-1] = out.fields[-1][:-1]
        self.judge(out)
        return out

    def fields(self, s: str, pos: int, into: list[str]) -> int:
        pos = self.field(s, pos, into)
        while s.startswith(self.g.separator, pos):
            pos = self.field(s, pos + len(self.g.separator), into)
        return pos

    def field(self, s: str, pos: int, into: list[str]) -> int:
        if self.g.quote and s.startswith(self.g.quote, pos):
            return self.quoted(s, pos, into)
        end = self.bare_re.match(s, pos).end()
        if self.g.quote and (at := s.find(self.g.quote, pos, end)) >= 0:
            raise Broken(at, len(into), pos)
        into.append(s[pos:end])
        return end

    def quoted(self, s: str, pos: int, into: list[str]) -> int:
        m = self.quoted_re.match(s, pos)
        if not m:
            raise Broken(pos, len(into), pos)
        end = m.end()
        after = s[end : end + 1]
        if after and after != self.g.separator and (self.whole or not re.match(r"\r?(\n|$)", s[end : end + 2])):
            raise Broken(end, len(into), pos)
        into.append(m[1].replace(self.g.quote * 2, self.g.quote))
        if not self.whole and after == "\r":
            end += 1
        return end

    def resume(self, s: str, pos: int) -> int:
        """The next record start from which a record of the right width parses; the end if there is none."""
        if self.whole or not self.anchor_re:
            return len(s)
        for m in self.anchor_re.finditer(s, pos):
            if m.start() <= pos:
                continue
            fields: list[str] = []
            try:
                self.fields(s, m.start(), fields)
            except Broken:
                continue
            if len(fields) == len(self.g.columns):
                return m.start()
        return len(s)

    def judge(self, record: Record) -> None:
        if len(record.fields) != len(self.g.columns):
            record.reason, record.at, record.column = "column_count", record.end, len(record.fields)
            return
        for column, (pattern, test) in self.g.checks.items():
            m = pattern.fullmatch(record.fields[column])
            if not m or not test(m):
                record.reason, record.at, record.column = "invalid_value", record.start, column
                return


def _number_between(low: int, high: int):
    return lambda m: m[0] == "\\N" or low <= int(m[0]) <= high


TITLES = Grammar(
    "\t",
    ("tconst", "titleType", "primaryTitle", "originalTitle", "isAdult", "startYear", "endYear", "runtimeMinutes", "genres"),
    anchor=r"tt[0-9]+\t",
    checks={5: (re.compile(r"\\N|[0-9]{4}"), _number_between(1870, 2030)), 7: (re.compile(r"\\N|[0-9]{1,9}"), _number_between(1, 1440))},
)
TOMATOES = Grammar(
    ",",
    ("id", "title", "audienceScore", "tomatoMeter", "releaseDateTheaters", "runtimeMinutes", "genre", "director", "boxOffice", "distributor"),
    quote='"',
    anchor=r'"?rt_[a-z0-9_]+"?,',
    checks={8: (re.compile(r"(?:\$?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]+)?[KMBkmb]?)?"), lambda m: True)},
)
FEEDS = {"title.basics": TITLES, "rt_movies": TOMATOES}

PARSED = "line_id long, feed string, reason string, error_at int, error_column string, record_id string, title string, original_title string, title_type string, is_adult boolean, start_year int, end_year int, runtime_minutes int, genres string, audience_score double, tomato_meter double, release_date string, director string, box_office double, distributor string"
_NAMES = [c.split(" ")[0] for c in PARSED.split(", ")]


def money(text: str) -> float | None:
    if not text:
        return None
    scale = {"k": 1e3, "m": 1e6, "b": 1e9}.get(text[-1].lower(), 1)
    return float(text.strip("$KMBkmb").replace(",", "")) * scale


def _whole(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"[0-9]{1,9}", text) else None


def _decimal(text: str) -> float | None:
    return float(text) if re.fullmatch(r"[0-9]+(\.[0-9]+)?", text) else None


def _typed(feed: str, fields: list[str]) -> dict:
    """All columns of a valid record; a value of a column that is not judged and does not fit its type is null."""
    if feed == "title.basics":
        f = [None if x == "\\N" else x for x in fields]
        return {"record_id": f[0], "title_type": f[1], "title": f[2], "original_title": f[3], "is_adult": {"0": False, "1": True}.get(f[4]), "start_year": _whole(f[5]), "end_year": _whole(f[6]), "runtime_minutes": _whole(f[7]), "genres": f[8]}
    f = fields
    return {"record_id": f[0], "title": f[1], "audience_score": _decimal(f[2]), "tomato_meter": _decimal(f[3]), "release_date": f[4], "runtime_minutes": _whole(f[5]), "genres": f[6], "director": f[7], "box_office": money(f[8]), "distributor": f[9]}


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parsers = {feed: Parser(g, whole=True) for feed, g in FEEDS.items()}
    for pdf in batches:
        out = []
        for line_id, feed, raw in zip(pdf["line_id"], pdf["feed"], pdf["raw_line"], strict=True):
            row = {"line_id": line_id, "feed": feed}
            parser = parsers.get(feed)
            if parser is None:
                out.append(row | {"reason": "unknown_feed", "error_at": 0})
                continue
            text = raw or ""
            r = next(parser.text(text[:-1] if text.endswith("\r") else text))
            if r.reason:
                names = parser.g.columns
                out.append(row | {"reason": r.reason, "error_at": r.at, "error_column": names[r.column] if r.column < len(names) else None})
            else:
                out.append(row | _typed(feed, r.fields))
        kinds = {"error_at": "Int32", "start_year": "Int32", "end_year": "Int32", "runtime_minutes": "Int32", "is_adult": "boolean"}
        yield pd.DataFrame(out, columns=_NAMES, dtype=object).astype(kinds)


def parse_records(raw: DataFrame) -> DataFrame:
    """One row per line: typed values if it parses, else `reason`, the offset of the error and its column.

    reason is the first that applies of quoting, column_count, invalid_value; a feed without grammar is `unknown_feed`.
    A null or empty line has one empty column. One carriage return at the end is no fault. Other columns are ignored.
    """
    return raw.select("line_id", "feed", "raw_line").mapInPandas(_rows, PARSED)


def parse_text(text: str, grammar: Grammar) -> list[Record]:
    """All records of a text of many lines, with recovery at validated record starts."""
    return list(Parser(grammar, whole=False).text(text))


def parse_files(raw: DataFrame, block_rows: int = 5_000, halo_rows: int = 50) -> DataFrame:
    """(feed, file_name, line_id, reason, error_at) of the broken records of whole files, with recovery.

    The lines of a file, in order of line_id, are one text again: nothing but line breaks tells where records begin, and a
    broken quote may swallow those. Files are cut into blocks of lines; each block is parsed with the first `halo_rows` lines
    of the next one, so that a record over a border ends where it should, and gives the records that begin in it. error_at
    counts from the record's start. Lines inside the remains of a broken record are skipped up to the next validated record
    start, which is what recovery means; a feed without grammar is left out.
    """
    by = ["feed", "file_name"]
    lines = raw.filter(F.col("feed").isin(*FEEDS)).select("feed", F.coalesce("file_name", F.lit("")).alias("file_name"), "line_id", F.coalesce("raw_line", F.lit("")).alias("raw_line"), (-F.col("line_id")).alias("__back"))
    p = positions_by(lines, by, "__back", [F.desc("__back")], "__p").withColumn("block", F.floor((F.col("__p") - 1) / block_rows))
    ahead = (F.col("block") > 0) & ((F.col("__p") - 1) % block_rows < halo_rows)
    p = p.withColumn("block", F.explode(F.when(ahead, F.array(F.col("block") - 1, F.col("block"))).otherwise(F.array("block")))).select(*by, "block", "__p", "line_id", "raw_line")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        feed, name, block = key
        pdf = pdf.sort_values("__p", kind="stable")
        texts, ids = pdf["raw_line"].tolist(), pdf["line_id"].tolist()
        own = int((pdf["__p"] <= (block + 1) * block_rows).sum())
        starts, at = [], 0
        for t in texts:
            starts.append(at)
            at += len(t) + 1
        out = []
        for r in Parser(FEEDS[feed], whole=False).text("\n".join(texts)):
            line = bisect_right(starts, r.start) - 1
            if line >= own:
                break
            if r.reason:
                out.append((feed, name, ids[line], r.reason, r.at - r.start))
        return pd.DataFrame(out, columns=["feed", "file_name", "line_id", "reason", "error_at"], dtype=object).astype({"line_id": "int64", "error_at": "int32"})

    return p.groupBy(*by, "block").applyInPandas(run, "feed string, file_name string, line_id long, reason string, error_at int")
