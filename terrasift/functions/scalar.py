"""Scalar column expressions: padding, ids, text normal forms, coercions, distances, buckets."""

from __future__ import annotations

from unicodedata import normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.7613

# Spellings of nothing, in lower case.
NULLISH = ("", "nan", "none", "null", "<na>", "nat")
# Letters with marks, and without.
_LATIN = [chr(i) for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for i in block if len(normalize("NFD", chr(i))) > 1]
_MARKED, _PLAIN = "".join(_LATIN), "".join(normalize("NFD", c)[0] for c in _LATIN)
# Numbers in words.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_pad(c, width: int) -> Column:
    """Left pad with zeros; longer values stay whole."""
    text = col(c).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def text_id(length: int, *parts) -> Column:
    """The first ``length`` hex digits of the MD5 of the parts joined by a bar; null parts count as empty."""
    return F.substring(F.md5(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])), 1, length)


def money_text(c) -> Column:
    """A price as decimal text, so ids do not depend on how an engine prints doubles."""
    return col(c).cast("decimal(18,2)").cast("string")


def null_if_blank(c) -> Column:
    text = F.trim(col(c).cast("string"))
    return F.when(~F.lower(text).isin(*NULLISH), text)


def number(c) -> Column:
    """Currency text to a number; what can't be read is null."""
    return F.regexp_replace(col(c).cast("string"), r"[$,\s]", "").try_cast("double")


def no_zero(c) -> Column:
    return F.nullif(col(c), F.lit(0.0))


def without_marks(c) -> Column:
    """Latin letters without their marks: those that Unicode decomposes lose them, and marks that stand alone go."""
    return F.regexp_replace(F.translate(col(c), _MARKED, _PLAIN), r"\p{Mn}", "")


def first_date(c, *formats: str) -> Column:
    """The first of ``formats`` that reads the text; a trailing offset is cut off."""
    text = F.split(col(c).cast("string"), r"\+")[0]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def sane_date(c, first: int = 2000, last: int = 2030) -> Column:
    return F.when(F.year(col(c)).between(first, last), col(c))


def miles(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in miles."""
    a, b, p, q = (F.radians(col(x)) for x in (lat1, lat2, lon1, lon2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((q - p) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Compass bearing in degrees, clockwise from north."""
    a, b, d = F.radians(col(lat1)), F.radians(col(lat2)), F.radians(col(lon2) - col(lon1))
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(angle + 360, F.lit(360.0))


def turn(before, after) -> Column:
    """Names the change of bearing; clockwise is right."""
    delta = F.pmod(col(after) - col(before) + 540, F.lit(360.0)) - 180
    return F.when(delta.isNull(), F.lit(None)).when(delta > 55, "right").when(delta > 25, "slight right").when(delta < -55, "left").when(delta < -25, "slight left").otherwise("straight")


def cell(c, size: float) -> Column:
    """The centre of the grid cell, ties away from zero."""
    return F.round(col(c) / size) * size


def cell_index(c, size: float) -> Column:
    """The cell's number, ties upwards."""
    return F.floor(col(c) / size + 0.5).cast("bigint")


def clamp(c, low, high) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def grid_degrees(zoom) -> Column:
    """Cell size for a map's zoom level."""
    return clamp(0.003 * F.pow(F.lit(2.0), 14 - col(zoom)), 0.0005, 0.5)


def is_true_or_null(c) -> Column:
    return F.coalesce(col(c), F.lit(True))


def json_safe(c) -> Column:
    """Null for numbers that JSON has no form for."""
    return F.when(~F.isnan(col(c)) & (F.abs(col(c)) != float("inf")), col(c))


def words(c, longer_than: int = 0) -> Column:
    return F.filter(F.array_distinct(F.split(col(c), r"[\s,\-]+")), lambda w: F.length(w) > longer_than)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def numbers_in(c) -> Column:
    """Numbers of a text, written in digits (with currency, commas, percent) or, from zero to twenty, in words."""
    digits = F.transform(F.regexp_extract_all(col(c), F.lit(r"(-?\$?\d[\d,]*\.?\d*%?)"), 1), lambda x: F.regexp_replace(x, "[$,%]", "").try_cast("double"))
    table = F.map_from_arrays(F.array(*map(F.lit, NUMBER_WORDS)), F.array(*[F.lit(float(i)) for i in range(len(NUMBER_WORDS))]))
    spelled = F.transform(F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z]+)"), 1), lambda w: F.try_element_at(table, w))
    return F.filter(F.concat(digits, spelled), lambda x: x.isNotNull())


def position_of(text, part) -> Column:
    """Zero-based place of the first occurrence, whatever the case; null if there is none."""
    at = F.locate(F.lower(col(part)), F.lower(col(text))) if isinstance(part, str) is False else F.instr(F.lower(col(text)), F.lower(F.lit(part)))
    return F.when(at > 0, at - 1)


def near(value, target, tolerance: float) -> Column:
    return F.abs(col(value) - col(target)) <= F.abs(col(target)) * tolerance


def status_bucket(c) -> Column:
    text = F.lower(F.coalesce(col(c), F.lit("")))
    return F.when(text.contains("sold"), "sold").when(text.contains("pend") | text.contains("conting"), "pending").when(text.contains("active"), "active").otherwise("other")


def score_bucket(c) -> Column:
    return F.when(col(c) >= 70, "high").when(col(c) >= 50, "middle").when(col(c).isNotNull(), "low").otherwise("none")


def city_key(c) -> Column:
    """``Pittsburgh, PA`` and ``pittsburgh pa`` as ``pittsburgh``."""
    text = F.lower(F.trim(F.split(col(c), ",")[0]))
    return F.regexp_replace(text, r"\s+[a-z]{2,3}$", "")
