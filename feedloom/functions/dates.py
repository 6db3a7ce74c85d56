"""Dates at the start of a text: a catalogue of patterns in eight languages, and matching as an expression."""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names by language, from January; forms of a month are separated by |.
MONTHS = {
    "en": "january|jan february|feb march|mar april|apr may june|jun july|jul august|aug september|sep|sept october|oct november|nov december|dec",
    "de": "januar|jänner februar|feber märz|mär|mrz april|apr mai juni|jun juli|jul august|aug september|sep|sept oktober|okt november|nov dezember|dez",
    "fr": "janvier|janv février|févr|fevrier mars avril|avr mai juin juillet|juil août|aout septembre|sept octobre|oct novembre|nov décembre|déc|decembre",
    "es": "enero|ene febrero|feb marzo|mar abril|abr mayo|may junio|jun julio|jul agosto|ago septiembre|setiembre|sep octubre|oct noviembre|nov diciembre|dic",
    "pt": "janeiro|jan fevereiro|fev março|mar abril|abr maio|mai junho|jun julho|jul agosto|ago setembro|set outubro|out novembro|nov dezembro|dez",
    "ru": "января|январь|янв февраля|февраль|фев марта|март|мар апреля|апрель|апр мая|май июня|июнь|июн июля|июль|июл августа|август|авг сентября|сентябрь|сен|сент октября|октябрь|окт ноября|ноябрь|ноя декабря|декабрь|дек",
    "bg": "януари|яну февруари|фев март|мар април|апр май юни|юн юли|юл август|авг септември|сеп октомври|окт ноември|ное декември|дек",
    "cz": "ledna|leden|led února|únor|úno března|březen|bře dubna|duben|dub května|květen|kvě června|červen|čvn července|červenec|čvc srpna|srpen|srp září|zář října|říjen|říj listopadu|listopad|lis prosince|prosinec|pro",
}

_DAY, _YEAR = r"(\d{1,2})", r"(\d{4})(?!\d)"
_ORDINAL = r"(?:st|nd|rd|th|er|\.|º)?"
_WORD = r"(\p{L}+)"
_OF = r"(?:of |de |do )?"
_WEEKDAY = r"(?:\p{L}+\.?,?\s+)?"
_TIME = r"(?:[T,]|\s)+(?:at |um |à |в |o )?(\d{1,2}):(\d{2})(?::(\d{2}))?"

#: Shapes of dates in the order in which they are tried: (expression, groups of year, month, day; group 0: no year).
#: Numeric dates are day first unless the year leads; a month may be a name.
SHAPES = [
    (rf"{_DAY}([/.-])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?!\d)", (4, 3, 1)),
    (r"(\d{4})([-/.])(\d{1,2})\6(\d{1,2})(?!\d)", (5, 7, 8)),
    (r"(\d{4})(\d{2})(\d{2})(?!\d)", (9, 10, 11)),
    (rf"{_DAY} (\d{{1,2}}) {_YEAR}", (14, 13, 12)),
    (rf"{_WEEKDAY}{_DAY}{_ORDINAL}[\s-]+{_OF}{_WORD}\.?,?[\s-]+{_OF}{_YEAR}", (17, 16, 15)),
    (rf"{_WEEKDAY}{_WORD}\.?\s+{_DAY}(?:st|nd|rd|th)?,?\s+{_YEAR}", (20, 18, 19)),
    (rf"(\d{{4}})[\s-]+{_WORD}\.?[\s-]+{_DAY}(?!\d)", (21, 22, 23)),
    (rf"{_DAY}{_ORDINAL}\s+{_OF}{_WORD}(?!\p{{L}})", (0, 25, 24)),
    (rf"{_WORD}\.?\s+{_DAY}(?:st|nd|rd|th)?(?![\d:/.])", (0, 26, 27)),
]
_GROUPS = 27
_ALL = "(?i)^(?:" + "|".join(e for e, _ in SHAPES) + f")(?:{_TIME})?[\\s\\S]*$"
#: Numbered keys of the numeric shapes, by separator and digits of the year.
NUMBERED = {"/4": 1, ".4": 2, "-4": 3, "Y-": 4, "Y/": 5, "Y.": 6, "/2": 7, ".2": 8, "-2": 9, "Y": 10, " 4": 11}
NAMED = {5: "dmy", 6: "mdy", 7: "ymd", 8: "dm", 9: "md"}

#: The first, second and any further form of a month's name; where a month has fewer, its last one.
STYLES = ("full", "short", "other")


def forms(month: str, style: str) -> list[str]:
    names = month.split("|")
    return names[2:] or names[-1:] if style == "other" else [names[min(STYLES.index(style), len(names) - 1)]]


@lru_cache
def named_months() -> list[tuple[str, int, str, str]]:
    """All (name, month, language, style), by language and style: what both the catalogue and match() go by."""
    return [(name, i, lang, style) for lang, text in MONTHS.items() for style in STYLES for i, month in enumerate(text.split(" "), 1) for name in forms(month, style)]


@lru_cache
def catalogue() -> list[tuple[str, str, str, bool]]:
    """All (key, expression, language, without a year): each shape and separator, or language and form of name,
    without and with a weekday where a name may follow one, without and with a time."""
    out = []
    times = (("", ""), (":time", _TIME))
    for mark, number in NUMBERED.items():
        sep = re.escape(mark[-1] if mark[0] == "Y" and len(mark) > 1 else mark[0] if mark[0] != "Y" else "")
        day, year = r"\d{1,2}", rf"\d{{{mark[-1]}}}(?!\d)" if mark[-1].isdigit() else r"\d{4}"
        body = (r"\d{4}\d{2}\d{2}(?!\d)" if mark == "Y" else f"{year}{sep}{day}{sep}{day}(?!\\d)") if mark[0] == "Y" else f"{day}{sep}{day}{sep}{year}"
        out += [(f"dt:date:date_{number}{end}", f"^{body}{time}", "", False) for end, time in times]
    for lang in MONTHS:
        for style in STYLES:
            names = "|".join(name for name, _, of, how in named_months() if (of, how) == (lang, style))
            for shape, name in NAMED.items():
                expr, (year, _, _) = SHAPES[shape - 1]
                expr = expr.replace(_WORD, f"({names})")
                for prefix, lead in (("", ""), ("w", r"\p{L}+\.?,?\s+")) if _WEEKDAY in expr else (("", ""),):
                    out += [(f"dt:date:{lang}_{prefix}{name}_{style}{end}", f"(?i)^{lead}{expr.replace(_WEEKDAY, '')}{time}", lang, not year) for end, time in times]
    return out


def patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalogue(), "key string, regex string, lang string, noyear boolean")


def _map(values: dict, kind: str) -> Column:
    """A constant map; the optimizer folds it into one literal."""
    return F.from_json(F.lit(json.dumps(values)), f"map<string,{kind}>")


def _names() -> Column:
    """Name to its (month, language, style), as an array: a name may be of several languages."""
    out: dict[str, list[dict]] = {}
    for name, month, lang, style in named_months():
        out.setdefault(name, []).append({"m": month, "l": lang, "s": style})
    return _map(out, "array<struct<m:int,l:string,s:string>>")


def match(text: Column, as_of_year: int | None = None, keys: Column | list[str] | None = None) -> Column:
    """struct(key, text, dt) of the date that text (as date_text gives it) starts with, or null.

    One expression takes the text apart; what it found is looked up in small constant maps. The text may fit several
    patterns: a month's name may be of several languages, and a pattern without a time fits a text that goes on with one. With
    keys, the first of these that is among them counts; without, the first: with its time, of the first language. A date
    without a year is of as_of_year, or of the current year. Impossible dates, and bare times, don't match.
    """
    if isinstance(keys, list):
        keys = F.array(*[F.lit(k) for k in keys]).cast("array<string>")
    cut = "\x01"
    groups = cut.join(f"${i}" for i in range(1, _GROUPS + 4))
    number = lambda c: c.try_cast("int")
    this_year = F.lit(as_of_year) if as_of_year else F.year(F.current_date())

    def told(g):
        part = lambda i: F.get(g, F.lit(i - 1))
        has = lambda i: part(i) != ""
        pick = lambda k, none: F.coalesce(*[F.when(has(at[2]) & has(at[1]), part(at[k]) if at[k] else none) for _, at in SHAPES])
        year = number(pick(0, F.lit("")))
        year = F.when(has(4) & (F.length(part(4)) == 2), year + 2000).otherwise(F.coalesce(year, this_year))
        return F.struct(year.alias("y"), F.lower(pick(1, F.lit(""))).alias("m"), number(pick(2, F.lit(""))).alias("d"), g.alias("g"))

    def found(x):
        """An array of (key, text, dt), of the patterns with a time first."""
        part = lambda i: F.get(x["g"], F.lit(i - 1))
        has = lambda i: part(i) != ""
        clock = [F.coalesce(number(part(_GROUPS + i)), F.lit(0)) for i in (1, 2, 3)]
        mark = F.when(has(1), F.concat(part(2), F.length(part(4)).cast("string"))).when(has(5), F.concat(F.lit("Y"), part(6))).when(has(9), F.lit("Y")).when(has(12), F.lit(" 4"))
        numbered = F.try_element_at(_map({k: f"date_{n}" for k, n in NUMBERED.items()}, "string"), mark)
        shape = F.coalesce(*[F.when(has(SHAPES[s - 1][1][2]) & has(SHAPES[s - 1][1][1]), F.lit(name)) for s, name in NAMED.items()])
        lead = F.when(shape.isin("dmy", "mdy") & text.rlike("(?i)^\\p{L}+\\.?,?\\s+(?:\\p{L}+\\.?\\s+)?\\d{1,2}[^\\d]") & ~((shape == "mdy") & F.lower(text).startswith(x["m"])), "w").otherwise("")
        as_name = lambda n: F.struct(F.concat(F.lit("dt:date:"), n["l"], F.lit("_"), lead, shape, F.lit("_"), n["s"]).alias("k"), n["m"].alias("m"))
        names = F.when(numbered.isNotNull(), F.array(F.struct(F.concat(F.lit("dt:date:"), numbered).alias("k"), number(x["m"]).alias("m")))).otherwise(F.transform(F.try_element_at(_names(), x["m"]), as_name))
        at = lambda n, hms, end: F.struct(F.concat(n["k"], F.lit(end)).alias("key"), text.alias("text"), F.call_function("try_make_timestamp_ntz", x["y"], n["m"], x["d"], *hms).alias("dt"))
        day = F.transform(names, lambda n: at(n, [F.lit(0)] * 3, ""))
        return F.when(has(_GROUPS + 1), F.concat(F.transform(names, lambda n: at(n, clock, ":time")), day)).otherwise(day)

    # array of one and transform: each step is computed once
    taken = F.when(text.rlike("[0-9]"), F.array(F.regexp_replace(text, _ALL, groups)))
    split = F.transform(F.filter(taken, lambda t: t != text), lambda t: F.split(t, cut, -1))
    hits = F.flatten(F.transform(F.transform(split, told), found))
    allowed = (lambda h: h["dt"].isNotNull() & F.coalesce(F.array_contains(keys, h["key"]), F.lit(True))) if keys is not None else (lambda h: h["dt"].isNotNull())
    return F.get(F.filter(hits, allowed), F.lit(0))
