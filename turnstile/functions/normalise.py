"""Row-level clean-up of ticket columns, all as built-in column expressions."""

from __future__ import annotations

from datetime import date, datetime, time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile import constants as C
from turnstile import schema as S

# Every character a text strip removes.
_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_DAY_MICROS = 86_400_000_000


def strip(col: Column) -> Column:
    """Strip all white space; the plain trim only strips blanks."""
    return F.btrim(col, F.lit(_WHITESPACE))


def utc_timestamp(col: Column, dtype: T.DataType) -> Column:
    """Timestamp in the UTC session zone; an unreadable value becomes null."""
    if isinstance(dtype, T.TimestampType):
        return col
    if isinstance(dtype, T.StringType):
        return F.try_to_timestamp(col)
    if isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        return col.cast("timestamp")
    return F.try_to_timestamp(col.cast("string"))


def local_timestamp(col: Column, dtype: T.DataType) -> Column:
    """Wall-clock timestamp: a zone in the text is dropped, not applied."""
    if isinstance(dtype, T.TimestampNTZType):
        return col
    return col.try_cast("timestamp_ntz")


def age(birthday: Column, as_of: date | datetime) -> Column:
    """Whole days lived, in years of 365.25 days, rounded."""
    moment = as_of if isinstance(as_of, datetime) else datetime.combine(as_of, time())
    now = F.unix_seconds(F.lit(moment.isoformat(sep=" ")).cast("timestamp"))
    days = F.floor((now - F.unix_seconds(birthday.cast("timestamp"))) / 86400)
    return F.round(days / 365.25).cast("int")


def decimal_cents(col: Column, dtype: T.DataType) -> Column:
    """The amount before rounding to whole cents; text and NaN that are no number give null."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        col = F.when(~F.isnan(col), col)
    return col.try_cast("decimal(20,4)")


def cents(col: Column, dtype: T.DataType) -> Column:
    """Whole cents as long."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return col.cast("long")
    return F.bround(decimal_cents(col, dtype)).cast("long")


def utm_source(col: Column) -> Column:
    """Acquisition channel: lower case, stripped, without a trailing ``.com``."""
    name = strip(F.lower(F.coalesce(col, F.lit(C.DIRECT))))
    name = F.when(name.endswith(".com"), name.substr(F.lit(1), F.length(name) - 4)).otherwise(name)
    return F.when(name.isin("", "direct"), C.DIRECT).otherwise(name)


def utm_medium(col: Column) -> Column:
    return F.coalesce(col, F.lit(C.UNKNOWN_MEDIUM))


def optin(col: Column, dtype: T.DataType) -> Column:
    """Boolean opt-in from a flag, 1/0 or exactly ``True``/``False``; all else is unknown."""
    if isinstance(dtype, T.BooleanType):
        return col
    if isinstance(dtype, T.NumericType):
        return F.when(col == 1, True).when(col == 0, False)
    return F.when(col == "True", True).when(col == "False", False)


def days_before(start: Column, ordered: Column) -> Column:
    """Fractional, signed days from the order to the start of the show."""
    return (F.unix_micros(start) - F.unix_micros(ordered)) / F.lit(float(_DAY_MICROS))


def weekday_no(day: Column) -> Column:
    """Monday = 0."""
    return F.weekday(day)


def weekday_label(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in C.WEEKDAY_LABELS]), number + 1)


def known_gender(col: Column) -> Column:
    return F.when(~col.isin(C.GENDER_PLACEHOLDERS), col)


def known_city(col: Column) -> Column:
    return F.when(~col.isin(C.CITY_PLACEHOLDERS), col)


def payment_method(col: Column) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(C.OTHER_PAYMENT))


def loyalty_label(n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" evento"), F.when(n > 1, "s").otherwise(""))


_BRL = T.DecimalType(18, 2)

# Columns a metric may name, with the type of the nulls that stand in for a missing one.
_FILLERS: dict[str, T.DataType] = {
    **{c: T.StringType() for c in S.TEXT},
    **{c: T.TimestampType() for c in S.TIMESTAMPS},
    **{f"{c}_cents": T.LongType() for c in S.MONEY},
    **{f"{c}_brl": _BRL for c in S.MONEY},
    "contact_newsletter_optin": T.BooleanType(),
    "contact_birthday": T.TimestampNTZType(),
    "age": T.IntegerType(),
    "order_date": T.DateType(),
    "order_hour": T.IntegerType(),
    "order_dow": T.StringType(),
    "days_before_event": T.DoubleType(),
}


def _known_columns(dtypes: dict[str, T.DataType], as_of: date | datetime) -> dict[str, Column]:
    """The clean and derived columns that the input has something for."""
    out: dict[str, Column] = {}

    def add(name: str, make) -> None:
        if name in dtypes:
            out[name] = make(F.col(name), dtypes[name])

    for name in S.TIMESTAMPS:
        add(name, utc_timestamp)
    add("ticket_id", lambda col, _: col.cast("string"))
    add("utm_source", lambda col, _: utm_source(col))
    add("utm_medium", lambda col, _: utm_medium(col))
    add("contact_newsletter_optin", optin)
    add("contact_birthday", local_timestamp)
    if "contact_birthday" in out:
        out["age"] = age(out["contact_birthday"], as_of)
    for name in S.MONEY:
        if name in dtypes:
            whole = cents(F.col(name), dtypes[name])
            out[f"{name}_cents"] = whole
            out[f"{name}_brl"] = (whole.cast("decimal(16,0)") / 100).cast(_BRL)
    if "ordered_at" in out:
        ordered = out["ordered_at"]
        out["order_date"] = F.to_date(ordered)
        out["order_hour"] = F.hour(ordered)
        out["order_dow"] = F.date_format(ordered, "EEEE")
        if "event_start_time" in out:
            out["days_before_event"] = days_before(out["event_start_time"], ordered)
    return out


def normalise(
    raw: DataFrame, as_of: date | datetime, channel: str | None = C.ONLINE
) -> tuple[DataFrame, frozenset[str]]:
    """Type and clean the columns of ``raw`` and add the derived ones.

    Columns the input lacks come out as typed nulls; the returned set names the
    columns (derived ones too) that rest on real input. No job runs.
    """
    known = _known_columns({f.name: f.dataType for f in raw.schema.fields}, as_of)
    if channel is not None:
        known["source"] = F.lit(channel)
    as_is = [c for c in raw.columns if c not in known and c not in S.MONEY]
    clean = raw.select(*as_is, *[col.alias(name) for name, col in known.items()])
    return with_fillers(clean), frozenset(raw.columns) | frozenset(known)


def with_fillers(df: DataFrame) -> DataFrame:
    """Add typed nulls for the columns a metric may name and ``df`` lacks."""
    missing = [
        T.StructField(name, dtype) for name, dtype in _FILLERS.items() if name not in df.columns
    ]
    return df.to(T.StructType([*df.schema.fields, *missing]))
