"""Rule normalisation of numbers, scales, units, periods and subjects (Column -> Column)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import collapse, let, strip

# Multipliers of the scale words.
SCALE_WORDS = {
    "crore": 1e7,
    "cr": 1e7,
    "lakh": 1e5,
    "lac": 1e5,
    "million": 1e6,
    "mn": 1e6,
    "m": 1e6,
    "billion": 1e9,
    "bn": 1e9,
    "trillion": 1e12,
    "tn": 1e12,
    "thousand": 1e3,
    "k": 1e3,
}

# Long names of common physical units (case matters: MW is not mW).
UNIT_NAMES = {
    "g": "gram",
    "kg": "kilogram",
    "mg": "milligram",
    "t": "metric_ton",
    "tonne": "metric_ton",
    "lb": "pound",
    "oz": "ounce",
    "m": "meter",
    "metre": "meter",
    "km": "kilometer",
    "cm": "centimeter",
    "mm": "millimeter",
    "ft": "foot",
    "inch": "inch",
    "mi": "mile",
    "mile": "mile",
    "l": "liter",
    "L": "liter",
    "litre": "liter",
    "ml": "milliliter",
    "s": "second",
    "min": "minute",
    "h": "hour",
    "hour": "hour",
    "day": "day",
    "year": "year",
    "W": "watt",
    "kW": "kilowatt",
    "MW": "megawatt",
    "GW": "gigawatt",
    "kWh": "kilowatt_hour",
    "J": "joule",
    "Hz": "hertz",
    "K": "kelvin",
    "degC": "degree_Celsius",
    "ha": "hectare",
    "acre": "acre",
}

# ASCII punctuation without the hyphen.
SUBJECT_PUNCTUATION = "!\"#$%&'()*+,./:;<=>?@[\\]^_`{|}~"

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


_PERIOD = r"(?i)^(?:(?:Q([1-4]))?FY(\d{2,4})|(?:CY)?(\d{4})|as\s+of\s+(.+))$"
_MONTH_FIRST = r"^(\d{2})/(\d{2})/(\d{4})"
_YEAR_FIRST = r"^(\d{4})/(\d{2})/(\d{2})"


def _literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def parse_number(text: Column) -> Column:
    """``'8,142'`` to 8142.0; null when the rest is not a plain decimal number."""
    digits = F.translate(strip(text), ", ", "")
    return F.when(digits.rlike(_NUMBER), digits.try_cast("double"))


def resolve_scale(unit: Column) -> Column:
    """struct(multiplier, remainder): the first scale word is taken out of the unit.

    A unit that is only ``m`` stays a metre.
    """
    scales = _literal_map(SCALE_WORDS)

    def by_tokens(tokens: Column) -> Column:
        known = F.transform(tokens, lambda t: F.map_contains_key(scales, F.lower(t)))
        position = F.array_position(known, True).cast("int")
        lone_metre = (F.size(tokens) == 1) & (F.lower(F.get(tokens, F.lit(0))) == "m")
        multiplier = F.try_element_at(scales, F.lower(F.get(tokens, position - 1)))
        remainder = F.trim(F.array_join(F.filter(tokens, lambda _, i: i != position - 1), " "))
        return F.when(
            (position > 0) & ~lone_metre,
            F.struct(multiplier.alias("multiplier"), remainder.alias("remainder")),
        ).otherwise(F.struct(F.lit(1.0).alias("multiplier"), strip(unit).alias("remainder")))

    return let(F.split(strip(unit), r"[\s/]+"), by_tokens)


def canonical_unit(unit: Column) -> Column:
    """Scale words and % by their one spelling, physical units by long name, others unchanged."""
    bare = strip(unit)
    low = F.lower(bare)
    return (
        F.when(bare == "", F.lit(""))
        .when(low.isin(list(SCALE_WORDS)), low)
        .when(bare.isin("%", "percent", "percentage"), F.lit("%"))
        .otherwise(F.coalesce(F.try_element_at(_literal_map(UNIT_NAMES), bare), bare))
    )


def canonical_subject(subject: Column) -> Column:
    """Lower case, no punctuation but inner hyphens, single blanks."""
    bare = F.translate(F.lower(strip(subject)), SUBJECT_PUNCTUATION, "")
    return F.regexp_replace(collapse(bare), "^-+|-+$", "")


def _dates(start: Column, end: Column) -> Column:
    return F.struct(start.alias("period_start"), end.alias("period_end"))


def _day(year: Column, month_day: str) -> Column:
    return F.concat(year.cast("string"), F.lit(month_day))


def _period_parts(text: Column) -> Column:
    """Quarter, fiscal year, calendar year and date of a period; texts that are none have empty parts."""
    bare = strip(text)
    coded = F.when(bare.rlike(_PERIOD), F.regexp_replace(bare, _PERIOD, "$1\1$2\1$3\1$4"))
    return F.split(F.coalesce(coded, F.lit("\1\1\1")), "\1")


def parse_period(text: Column) -> Column:
    """struct(period_start, period_end) as ISO strings, both null when not recognised.

    ``FY24``/``FY2024`` (April of the year before to March), ``Q1FY24``..``Q4FY24``, ``CY2024``,
    ``2024``, and ``as of`` a date. Slash dates are read month first when the year is last, and
    are not checked against the calendar.
    """
    return let(_period_parts(text), _period_of)


def _period_of(parts: Column) -> Column:
    """The period that the parts of :func:`_period_parts` name."""

    def point(column: Column) -> Column:
        return _dates(column, column)

    def by_parts() -> Column:
        quarter, date = parts[0], strip(parts[3])
        # Parts are digits or empty; a cast that fails costs an exception a row.
        written, year = (F.when(part != "", part.cast("int")) for part in (parts[1], parts[2]))
        end = F.when(written < 100, written + 2000).otherwise(written)

        def rearranged(pattern: str, order: str) -> Column:
            return F.regexp_replace(date, pattern + ".*$", order)

        return (
            F.when(quarter == "1", _dates(_day(end - 1, "-04-01"), _day(end - 1, "-06-30")))
            .when(quarter == "2", _dates(_day(end - 1, "-07-01"), _day(end - 1, "-09-30")))
            .when(quarter == "3", _dates(_day(end - 1, "-10-01"), _day(end - 1, "-12-31")))
            .when(quarter == "4", _dates(_day(end, "-01-01"), _day(end, "-03-31")))
            .when(written.isNotNull(), _dates(_day(end - 1, "-04-01"), _day(end, "-03-31")))
            .when(year.isNotNull(), _dates(_day(year, "-01-01"), _day(year, "-12-31")))
            .when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), point(date))
            .when(date.rlike(_MONTH_FIRST), point(rearranged(_MONTH_FIRST, "$3-$1-$2")))
            .when(date.rlike(_YEAR_FIRST), point(rearranged(_YEAR_FIRST, "$1-$2-$3")))
            .otherwise(point(F.lit(None).cast("string")))
        )

    return by_parts()


def normalize_facts(facts: DataFrame) -> DataFrame:
    """Add the five normalised columns in one projection; nothing unknown is invented.

    A unit that is only a scale word stays as it is although the value is already scaled.
    """
    scaled = facts.withColumns(
        {
            "_scale": resolve_scale(F.coalesce("unit", F.lit(""))),
            "_parts": _period_parts(F.coalesce("temporal_context", F.lit(""))),
        }
    )
    # The parts and the period are made once a row, in columns of their own, and both dates are read from it.
    scaled = scaled.withColumn("_period", _period_of(F.col("_parts")))
    period = F.col("_period")
    multiplier, remainder = F.col("_scale.multiplier"), F.col("_scale.remainder")
    unit = (
        F.when(F.coalesce("unit", F.lit("")) == "", F.lit(None).cast("string"))
        .when((multiplier != 1.0) & (remainder != ""), remainder)
        .when(multiplier != 1.0, F.col("unit"))
        .otherwise(canonical_unit(F.col("unit")))
    )
    return scaled.withColumns(
        {
            "normalized_value": parse_number(F.col("value")) * multiplier,
            "normalized_unit": unit,
            "period_start": period.period_start,
            "period_end": period.period_end,
            "canonical_subject": canonical_subject(F.col("subject")),
        }
    ).drop("_scale", "_parts", "_period")
