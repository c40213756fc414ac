"""Parsers of source labels: money, periods, dates, lists, units, names, secrets."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Tokens and patterns of the sources' labels.
MONEY = r"^([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(\.[0-9]+)?\s*원?$"
MONTHLY_AVERAGE, TOTALS = "월평균", ["합계", "총계", "소계", "계"]
ISO_MONTH, KOREAN_MONTH = r"^([0-9]{4})[-.]([0-9]{1,2})$", r"^([0-9]{1,2})월"
UNIT = r":\s*([^)\s]+)"
PREFIXES = ["서울특별시", "인천광역시", "경기도"]
#: Keys of requests and responses whose values are secret, in lower case.
SENSITIVE = [
    "authorization", "access_token", "accesstoken", "apikey", "api_key", "consumer_key", "consumer_secret", "key",
    "rcis_api_key", "rcis_user_id", "secret", "servicekey", "token", "usrid", "password",
]
#: Parts of a JSON text: blanks, a string, and a piece (a string, a mark, a number or word, blanks, or a quote that is never closed).
_BLANKS, _STRING = r"[ \t\n\x0b\f\r]*+", r'"(?:[^"\\]++|\\.)*+"'
_PIECE = re.compile(_STRING + r'|[\[\]{}:,]|[^\[\]{}:," \t\n\x0b\f\r]++|"')
_KEY, _MARK = re.compile(f"({_STRING}){_BLANKS}:{_BLANKS}"), re.compile(_STRING + r'|[\[\]{}"]')
#: What has no sensitive key: all but strings, strings that are no such key, and with escapes those that are no key.
_PASSED = re.compile(rf'(?:[^"]++|"(?!(?i:{"|".join(SENSITIVE)})"{_BLANKS}:)[^"\\]*+"|{_STRING}(?!{_BLANKS}:))*+')
_SENSITIVE = frozenset(SENSITIVE)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A column made of another one that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), 0)


def tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def money(c: Column) -> Column:
    """The exact amount of a text such as ``1,234.5 원``; null for all else, never zero."""
    digits = lambda t: F.concat(F.regexp_replace(F.regexp_extract(t, MONEY, 1), ",", ""), F.regexp_extract(t, MONEY, 2))
    return let(tidy(c), lambda t: F.when(t.rlike(MONEY), digits(t))).try_cast("decimal(38,6)")


def label_period(c: Column, year: Column) -> tuple[Column, Column]:
    """The fields of ``period_of``: month and kind."""
    found = period_of(c, year)
    return found["month"], found["kind"]


def period_of(c: Column, year: Column) -> Column:
    """month and kind of a label's last token: MONTHLY, ANNUAL, MONTHLY_AVERAGE or UNSPECIFIED."""

    def of(text: Column, tail: Column) -> Column:
        iso, korean = tail.rlike(ISO_MONTH), tail.rlike(KOREAN_MONTH)
        number = F.when(iso, F.regexp_extract(tail, ISO_MONTH, 2)).when(korean, F.regexp_extract(tail, KOREAN_MONTH, 1)).try_cast("int")
        own_year = F.when(iso, F.regexp_extract(tail, ISO_MONTH, 1)).otherwise(F.lpad(year.cast("string"), 4, "0"))
        return let(number, lambda n: kinds(text, tail, F.when(n.between(1, 12), F.concat(own_year, F.lit("-"), F.lpad(n.cast("string"), 2, "0")))))

    def kinds(text: Column, tail: Column, month: Column) -> Column:
        average = text.startswith(MONTHLY_AVERAGE)
        return let(F.when(~average, month), lambda m: F.struct(m.alias("month"), F.when(average, "MONTHLY_AVERAGE").when(m.isNotNull(), "MONTHLY").when(tail.isin(TOTALS), "ANNUAL").otherwise("UNSPECIFIED").alias("kind")))

    return let(tidy(c), lambda text: let(F.trim(F.regexp_extract(text, r"([^:]*)$", 1)), lambda tail: of(text, tail)))


def _date(token: Column, year: Column) -> Column:
    """A date from the last numbers between points, dashes and strokes: day, month, and the year if there is one."""

    def of(parts: Column) -> Column:
        day, month, own = (F.get(parts, F.size(parts) - i) for i in (1, 2, 3))
        text = F.concat_ws("-", F.when(own.rlike("^[0-9]{4}$"), own).otherwise(year.cast("string")), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
        return F.when(day.rlike("^[0-9]{1,2}$") & month.rlike("^[0-9]{1,2}$"), F.try_to_date(text, "yyyy-MM-dd"))

    return let(F.filter(F.transform(F.split(token, r"[.\-/]"), lambda x: F.trim(x)), lambda x: x != ""), of)


def date_range(c: Column, year: Column) -> tuple[Column, Column, Column]:
    """The fields of ``dates``: start, end and whether it is part of a year."""
    found = dates(c, year)
    return found["start"], found["end"], found["part"]


def dates(c: Column, year: Column) -> Column:
    """start, end and whether it is part of a year, of a label such as ``2024.2.26.~4.5``.

    The end takes the start's year if it names none. A bare year has no dates
    and is whole; a single date has none either, as it doesn't say where its
    time ends, but it is part of a year.
    """

    def of(text: Column) -> Column:
        ranged = F.instr(text, "~") > 0
        end = lambda start: F.when(ranged, _date(F.regexp_extract(text, "~(.*)$", 1), F.coalesce(F.year(start), year)))
        return let(F.when(ranged, _date(F.substring_index(text, "~", 1), year)), lambda s: F.struct(s.alias("start"), end(s).alias("end"), (ranged | text.rlike(r"^[0-9]{4}\s*[.\-/]")).alias("part")))

    return let(F.translate(tidy(c), "∼", "~"), of)


def list_cell(c: Column) -> Column:
    """The elements of a cell between ; and /, in order, without blank ones."""
    return F.filter(F.transform(F.split(tidy(c), "[;/]"), lambda x: F.trim(x)), lambda x: x != "")


def unit_token(c: Column) -> Column:
    found = F.regexp_extract(c, UNIT, 1)
    return F.when(found != "", found).otherwise(F.trim(c))


def organisation(c: Column) -> Column:
    """An office's name without its province in front and without the office's own last letter."""
    name = F.trim(c)
    for prefix in PREFIXES:
        name = F.when(name.startswith(prefix), F.trim(F.regexp_replace(name, "^" + prefix, ""))).otherwise(name)
    return F.trim(F.regexp_replace(name, "청$", ""))


def selected_option(html: Column, name: str) -> Column:
    """The value of the selected option of the select of that name, whatever other attributes there are; null without one."""
    attribute = lambda tag, key: F.regexp_extract(tag, rf'(?is)(?:^|\s){key}\s*=\s*["\']([^"\']*)["\']', 1)
    selects = F.transform(F.slice(F.split(html, r"(?i)<select\b"), 2, 2**30), lambda s: F.struct(F.substring_index(s, ">", 1).alias("tag"), F.element_at(F.split(s, r"(?i)</select"), 1).alias("body")))
    body = F.get(F.filter(selects, lambda s: attribute(s.tag, "name") == name), 0)["body"]
    tags = F.transform(F.slice(F.split(body, r"(?i)<option\b"), 2, 2**30), lambda o: F.substring_index(o, ">", 1))
    chosen = F.get(F.filter(tags, lambda t: F.regexp_replace(t, "\"[^\"]*\"|'[^']*'", "").rlike(r"(?i)\sselected(\s|=|/|$)")), 0)
    return F.when(chosen.rlike(r"(?i)\svalue\s*="), attribute(chosen, "value"))


def _redacted(text: str) -> str:
    """One text of ``redacted``; what lies between two values that go is passed over at once and copied as it stands."""
    out, copied, at = [], 0, 0
    while (at := _PASSED.match(text, at).end()) < len(text):
        key = _KEY.match(text, at)
        if key is None:  # a quote that is never closed
            at += 1
        elif _plain(key[1]) not in _SENSITIVE:
            at = key.end(1)
        elif (value := _PIECE.match(text, key.end())) is None:
            break
        else:
            out += [text[copied : value.start()], '"[REDACTED]"']
            at = copied = _closed(text, value.end()) if value[0] in ("{", "[") else value.end()
    return "".join([*out, text[copied:]])


def _closed(text: str, at: int) -> int:
    """Where the object or array ends that is open here; the text's end if it is never closed."""
    depth = 1
    for mark in _MARK.finditer(text, at):
        depth += (mark[0] in "{[") - (mark[0] in "}]")
        if not depth:
            return mark.end()
    return len(text)


def _plain(quoted: str) -> str | None:
    """A key in lower case, escapes read; null if it can't be read."""
    if "\\" not in quoted:
        return quoted.strip('"').lower()
    try:
        return json.loads(quoted, strict=False).lower()
    except ValueError:
        return None


@pandas_udf(StringType())
def redacted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A JSON text in which the values under sensitive keys, of any kind and at any depth, are redacted; other parts stay as they are.

    The text is walked piece by piece: a value that begins after a sensitive
    key's colon is replaced, an object or array up to the mark that closes it.
    Keys are compared in lower case, escapes read; blanks of every kind between
    a colon and its value stay. What isn't JSON comes back with what follows
    such keys replaced as far as it can be read.
    """
    for t in texts:
        yield t.map(lambda x: _redacted(x) if isinstance(x, str) else None)


def fixed_point(c: Column, places: int = 8) -> Column:
    """A weight as text with a fixed number of places, without the sign of a zero."""
    return c.cast(f"decimal({places + 4},{places})").cast("string")


#: Names of provinces with their official ones; marks of a company; labels of a contractor, the first wins.
SIDO_NAMES = {
    "서울특별시": "서울특별시", "서울시": "서울특별시", "서울": "서울특별시",
    "인천광역시": "인천광역시", "인천시": "인천광역시", "인천": "인천광역시",
    "경기도": "경기도", "경기": "경기도",
}
COMPANY_MARKS = ["(주)", "(유)", "㈜", "주식회사", "유한회사"]
CONTRACTOR_LABELS = ["계약상대자", "계약상대방", "업체"]
NAME_LENGTH = 200


def request_address(sido: Column, sigungu: Column, address: Column) -> Column:
    """The address after as many of province and district as it doesn't begin with; an unknown province is put in front as it is."""
    official = F.create_map(*[F.lit(x) for pair in SIDO_NAMES.items() for x in pair])

    def of(text: Column, words: Column, place: Column) -> Column:
        same_province = F.coalesce(official[F.get(words, 0)] == official[F.get(place, 0)], F.lit(False))
        missing = F.when(same_province, 0).when(F.startswith(text, F.get(place, 1)), 1).otherwise(2)
        return F.array_join(F.concat(F.slice(place, 1, missing), words), " ")

    return let(tidy(address), lambda text: let(F.split(text, " "), lambda words: let(F.array(tidy(sido), tidy(sigungu)), lambda place: of(text, words, place))))


def _first_lot(word: Column) -> Column:
    """A word that ends in lots between commas, up to the first lot; other words as they are."""

    def cut(w: Column, parts: Column, first: Column) -> Column:
        rest = F.array_join(F.slice(parts, first + 1, F.size(parts)), ",")
        return let(rest, lambda r: F.when((first > 0) & (first < F.size(parts)) & (r != ""), F.substring(w, F.lit(1), F.length(w) - F.length(r) - 1)).otherwise(w))

    parts_of = lambda w: F.split(F.substring(w, F.length(F.rtrim(w, F.lit("0123456789,-"))) + 1, F.length(w)), ",")
    first_of = lambda parts: F.array_position(F.transform(parts, lambda p: p.rlike("[0-9]$")), True).cast("int")
    return let(word, lambda w: let(parts_of(w), lambda parts: let(first_of(parts), lambda first: cut(w, parts, first))))


def simple_address(address: Column) -> Column:
    """The address without brackets and without further lots at its end; null if nothing goes, or all."""

    def bare(parts: Column) -> Column:
        closed = F.transform(F.slice(parts, 2, 2**30), lambda p: F.when(p.contains(")"), F.concat(F.lit(" "), F.substring(p, F.instr(p, ")") + 1, F.length(p)))).otherwise(F.concat(F.lit("("), p)))
        return F.split(tidy(F.concat(F.get(parts, 0), F.array_join(closed, ""))), " ")

    shortened = lambda words: F.array_join(F.concat(F.slice(words, F.lit(1), F.size(words) - 1), F.array(_first_lot(F.element_at(words, -1)))), " ")
    short_of = lambda text: let(let(F.split(text, r"\("), bare), shortened)
    return let(tidy(address), lambda text: let(short_of(text), lambda short: F.when((short != text) & (short != ""), short)))


def geocode_attempts(address: Column) -> Column:
    """The tries in their order: each form of the address by road, then by parcel."""
    forms, kinds = let(address, lambda a: F.array_compact(F.array(a, simple_address(a)))), F.array(F.lit("ROAD"), F.lit("PARCEL"))
    return F.flatten(F.transform(forms, lambda a: F.transform(kinds, lambda k: F.struct(a.alias("address"), k.alias("kind")))))


def contractor(name: Column, note: Column) -> Column:
    """The company that a note names after a label, else the one at the end of a contract's name; null without a company's mark.

    A note is read by clauses: the first that has the label, with a colon if one
    has, names the company.
    """

    def named(text: Column, clauses: Column, label: Column) -> Column:
        name_in = lambda own: let(F.get(F.filter(clauses, lambda c: F.contains(c, own)), 0), lambda c: F.btrim(F.substring(c, F.position(own, c) + F.length(own), F.length(c)), F.lit(" .")))
        return let(F.when(F.contains(text, F.concat(label, F.lit(":"))), F.concat(label, F.lit(":"))).otherwise(label), name_in)

    each = lambda text, clauses: F.transform(F.array(*[F.lit(x) for x in CONTRACTOR_LABELS]), lambda label: named(text, clauses, label))
    found = let(tidy(note), lambda text: let(F.split(text, r"[,;|]|\.\s"), lambda clauses: each(text, clauses)))
    titled = let(F.split(tidy(name), " - "), lambda title: F.when(F.size(title) > 1, F.array(F.trim(F.element_at(title, -1)))).otherwise(F.array().cast("array<string>")))
    company = F.filter(F.concat(found, titled), lambda c: F.exists(F.array(*[F.lit(m) for m in COMPANY_MARKS]), lambda m: F.contains(c, m)))
    return F.substring(F.get(company, 0), 1, NAME_LENGTH)
