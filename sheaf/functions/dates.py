"""Clinical dates. They are shown as seen and compared as ISO days in text, '' where there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import BLANKS, let, or_empty

#: Month names by their first three letters. Fixed values.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_FULL = "|".join(f"{n[:3]}(?:{n[3:]})?" if len(n) > 3 else n for n in MONTH_NAMES).replace("Sep(?:tember)?", "Sep(?:t(?:ember)?)?")
_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"


#: The months' first letters behind one another, so that a place in them tells the month.
_MONTH_PLACES = "|" + "|".join(MONTHS) + "|"


def _month(name: Column) -> Column:
    """The number of a month by its name; 0 if there is none. One search in a text: an array of names is compared name by name, each anew."""
    at = F.position(F.concat(F.lit("|"), F.lower(F.substring(name, 1, 3)), F.lit("|")), F.lit(_MONTH_PLACES))
    return F.floor((at + 3) / 4).cast("int")


def _year(text: Column) -> Column:
    """Two digits: from 70 on 19xx, else 20xx."""
    y = _int(text)
    return F.when(y >= 100, y).when(y >= 70, y + 1900).otherwise(y + 2000)


def _iso(y: Column, m: Column, d: Column) -> Column:
    """A calendar-checked day from 1900 on, else ''."""
    text = F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0"))
    return let(text, lambda own: F.when((own >= "1900") & own.try_cast("date").isNotNull(), own).otherwise(""))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def clinical_date_iso(c: Column) -> Column:
    """The first ISO day anywhere, as it stands; else a leading M/d/yy or M/d/yyyy; else a leading month name with day, comma and year."""
    numeric = rf"^[{BLANKS}]*+([0-9]{{1,2}}/[0-9]{{1,2}}/(?:[0-9]{{4}}|[0-9]{{2}}))(?:\b|[^0-9])"
    named = rf"(?i)^[{BLANKS}]*+((?:{_FULL})\s+[0-9]{{1,2}},\s*[0-9]{{4}})\b"
    iso = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"

    def by_name(found: Column) -> Column:
        # A month's name, blanks, a day, a comma, blanks, and four digits.
        day = F.regexp_extract(found, "([0-9]{1,2}),", 1)
        return F.when(found != "", _iso(_int(F.substring(found, -4, 4)), _month(found), _int(day))).otherwise("")

    def by_number(x: Column) -> Column:
        parts = lambda found: let(F.split(found, "/"), lambda p: _iso(_year(p[2]), _int(p[0]), _int(p[1])))
        return F.when(x["found"] != "", parts(x["found"])).otherwise(let(F.regexp_extract(x["text"], named, 1), by_name))

    # Each form is searched for once: what was found is the answer, or is taken apart.
    other = lambda text: let(_with(text, numeric, 1), by_number)
    return let(or_empty(c), lambda text: let(_with(text, iso, 0), lambda x: F.when(x["found"] != "", x["found"]).otherwise(other(x["text"]))))


def _with(text: Column, pattern: str, group: int) -> Column:
    """A text with what is found in it, as one value: an argument of a Python function cannot hold a lambda that names the value of another."""
    return F.struct(text.alias("text"), F.regexp_extract(text, pattern, group).alias("found"))


def extract_date(c: Column) -> Column:
    """The first date in free text as it stands: month names with, then without comma come before numbers; a number needs a possible month and day and no digit or dot beside it."""
    # No form is without four digits, or a slash before one; most texts have neither.
    return let(or_empty(c), lambda text: F.when(text.rlike("[0-9]{4}|/[0-9]"), _extracted(text)).otherwise(""))


def _extracted(text: Column) -> Column:
    comma = F.regexp_extract(text, rf"(?i)\b(?:{_SHORT})[a-z]*\.?\s+[0-9]{{1,2}},\s+[0-9]{{4}}\b", 0)
    plain = F.regexp_extract(text, rf"(?i)\b(?:{_SHORT})[a-z]*\.?\s+[0-9]{{1,2}}\s+[0-9]{{4}}\b", 0)
    numbers = F.regexp_extract_all(text, F.lit(r"(?<![0-9.])\b(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12][0-9]|3[01])/[0-9]{2,4}\b(?![0-9.])"), F.lit(0))
    return F.when(comma != "", comma).when(plain != "", plain).otherwise(F.coalesce(F.get(numbers, F.lit(0)), F.lit("")))


def group_date(c: Column, fallback: Column | None = None) -> Column:
    """A struct: `day_key` (ISO) and `display` (`Month d, yyyy`). Numbers come before month names here, in the text and then the fallback."""
    numeric = r"\b([0-9]{1,2})/([0-9]{1,2})/([0-9]{2,4})\b"
    named = rf"(?i)\b({_SHORT})[a-z]*\.?\s+([0-9]{{1,2}}),?\s+([0-9]{{4}})\b"
    names = F.array(*(F.lit(m) for m in MONTH_NAMES))

    def made(year: Column, month: Column, day: Column) -> Column:
        known = (year > 0) & (month > 0) & (day > 0)
        key = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
        display = F.concat(F.coalesce(F.get(names, month - 1), F.lit("undefined")), F.lit(" "), day.cast("string"), F.lit(", "), year.cast("string"))
        return F.struct(F.when(known, key).otherwise("").alias("day_key"), F.when(known, display).otherwise("").alias("display"))

    def by_name(said: Column) -> Column:
        none = F.struct(F.lit("").alias("day_key"), F.lit("").alias("display"))
        return F.when(said != "", made(_int(F.substring(said, -4, 4)), _month(said), _int(F.regexp_extract(said, r"([0-9]{1,2}),?\s+[0-9]{4}$", 1)))).otherwise(none)

    def found(x: Column) -> Column:
        # Each form is searched for once, and what was found is taken apart.
        parts = lambda said: let(F.split(said, "/"), lambda p: made(_year(p[2]), _int(p[0]), _int(p[1])))
        return F.when(x["found"] != "", parts(x["found"])).otherwise(let(F.regexp_extract(x["text"], named, 0), by_name))

    return let(F.concat_ws("\n", or_empty(c), or_empty(fallback) if fallback is not None else F.lit("")), lambda text: let(_with(text, numeric, 0), found))
