"""Text functions: names, addresses, regions, header labels and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliopanel import constants as K
from heliopanel.functions.scale import from_units, to_units


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def any_of(words: list[str]) -> str:
    """Regular expression alternatives for plain words, longest first."""
    ordered = sorted(words, key=lambda w: (-len(w), w))
    return "(?:" + "|".join(ordered) + ")"


def norm(c: Column) -> Column:
    """Lower case without white space and the separators - _ / ( ) [ ] . """
    return F.regexp_replace(F.lower(strip(c)), r"(?U)[\s\-_/()\[\].]+", "")


def simplify_address(c: Column, provinces: list[str] | None = None) -> Column:
    """Province plus district words, three words at most.

    Falls back to the first three words when nothing is recognised. Blank stays blank
    and null stays null.
    """
    provinces = K.PROVINCES_LONG + K.PROVINCES_SHORT if provinces is None else provinces
    text = strip(c)
    words = F.split(text, r"\s+")
    has_province = F.element_at(words, 1).rlike("^" + any_of(provinces))
    province = F.when(has_province, F.slice(words, 1, 1)).otherwise(F.slice(words, 1, 0))
    rest = F.when(has_province, F.slice(words, 2, F.size(words))).otherwise(words)
    districts = F.filter(rest, lambda w: w.rlike("(?:" + "|".join(K.DISTRICT_ENDINGS) + ")$"))
    kept = F.concat(province, districts)
    chosen = F.when(F.size(kept) > 0, kept).otherwise(words)
    return F.when(text == "", text).otherwise(F.array_join(F.slice(chosen, 1, 3), " "))


def to_canonical(c: Column, anchored: bool = False) -> Column:
    """Canonical province of a free spelling; the first pattern found anywhere wins.

    `anchored` accepts a pattern only at the start, which keeps 경기도 광주시 in 경기도.
    Unknown spellings stay as they are (trimmed), null becomes "".
    """
    squeezed = F.regexp_replace(c, r"(?U)\s+", "")
    start = "^" if anchored else ""
    result = F.when(c.isNull(), F.lit(""))
    for name, pattern in K.REGION_PATTERNS.items():
        result = result.when(squeezed.rlike(f"{start}(?:{pattern})"), F.lit(name))
    return result.otherwise(strip(c))


def map_region_name(c: Column, mapping: dict[str, str]) -> Column:
    """Replace exact values; anything else stays."""
    if not mapping:
        return c
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.coalesce(F.create_map(*pairs)[c], c)


def display_region_name(c: Column) -> Column:
    return map_region_name(c, K.DISPLAY_NAMES)


def boundary_region_name(c: Column) -> Column:
    return map_region_name(c, K.BOUNDARY_NAMES)


def normalize_subregion(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(strip(c), r"(?U)\s+", " "), F.lit(""))


def strip_region_prefix_any(c: Column) -> Column:
    """Remove all leading canonical province names in one pass."""
    pattern = r"(?U)^(?:\s*" + any_of(K.REGION_PREFIXES) + r")+\s*"
    return F.coalesce(F.regexp_replace(strip(c), pattern, ""), F.lit(""))


def valid_region(c: Column) -> Column:
    return F.coalesce(~strip(c).isin(K.INVALID_REGION_LABELS), F.lit(False))


def extract_plant_name(file_name: Column) -> Column:
    """Text of the first [...] of a file name, null when there is none."""
    found = F.regexp_extract(file_name, K.PLANT_IN_FILE_NAME, 1)
    return F.when(file_name.rlike(K.PLANT_IN_FILE_NAME), strip(found))


def extract_hour(label: Column) -> Column:
    """Hour 1..24 that a column label names, null otherwise.

    A range such as 23-24 gives its end, then N시, then any number of one or two
    digits. The first rule that matches decides, even when its number is out of range.
    """
    text = F.lower(strip(label))
    number = F.lit(None).cast("int")
    for pattern, group in reversed(K.HOUR_LABELS):
        digits = F.regexp_extract(text, pattern, group)
        number = F.when(text.rlike(pattern), digits.try_cast("int")).otherwise(number)
    return F.when(number.between(1, 24), number)


def detect_unit(label: Column) -> Column:
    """mwh, kwh or wh when the label names one, in this order."""
    text = F.lower(label)
    result = F.lit(None).cast("string")
    for unit in reversed(list(K.UNIT_DIVISORS)):
        result = F.when(text.contains(unit), F.lit(unit)).otherwise(result)
    return result


def to_numeric_coerce(c: Column) -> Column:
    """Double, or null when the text is not a number; NaN counts as null."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def convert_to_mwh(value: Column, unit: Column) -> Column:
    """Megawatt hours rounded to 4 places; text that is no number, not finite or beyond a long gives 0."""
    number = F.coalesce(to_numeric_coerce(value), F.lit(0.0))
    divisor = F.lit(1.0)
    for name, by in K.UNIT_DIVISORS.items():
        divisor = F.when(unit == name, F.lit(by)).otherwise(divisor)
    return F.coalesce(from_units(to_units(number / divisor, K.MWH_SCALE), K.MWH_SCALE), F.lit(0.0))


def format_fixed4(c: Column) -> Column:
    return F.format_string("%.4f", c)
