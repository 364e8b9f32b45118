"""Column expressions of the staging, model and mart layers.

Every function returns a built-in Spark ``Column`` (no Python UDF), so the whole
projection stays inside whole-stage codegen and is pushed through the optimizer.
Arguments accept a column name or a ``Column``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the source semantics.
NUMERIC = "decimal(18,3)"          # a bare `numeric` cast: precision 18, scale 3, half-up
SUM_NUMERIC = "decimal(38,3)"      # the type of a sum over `numeric`
LOCAL_ZONE = "Pacific/Auckland"    # zone of the human-facing snapshot date
DEFAULT_HOUSE_VALUE = 1450000.0    # parse-or-default fallback for the property value


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text cleaning and casts -------------------------------------------------

def blank_to_null(c) -> Column:
    """``nullif(c::text, '')``: an empty string becomes NULL, other text is kept."""
    return F.nullif(col(c).cast("string"), F.lit(""))


def to_numeric(c, strict: bool = True) -> Column:
    """``nullif(c::text,'')::numeric``; strict raises on bad text (ANSI), lenient gives NULL."""
    t = blank_to_null(c)
    return t.cast(NUMERIC) if strict else t.try_cast(NUMERIC)


def text_to_int(c, strict: bool = True) -> Column:
    """Text to int rounding half away from zero ('30.7' -> 31, '30.4996' -> 30).

    Spark's ANSI ``cast('30.7' as int)`` raises, so the value goes through an exact
    decimal with 18 fractional digits and one rounding step.
    """
    t = blank_to_null(c)
    d = t.cast("decimal(38,18)") if strict else t.try_cast("decimal(38,18)")
    return F.round(d, 0).cast("int")


def to_bool(c, strict: bool = True) -> Column:
    t = blank_to_null(c)
    return t.cast("boolean") if strict else t.try_cast("boolean")


def to_instant(c, strict: bool = True) -> Column:
    """``nullif(c::text,'')::timestamptz``: text with its own offset to an instant."""
    t = blank_to_null(c)
    return t.cast("timestamp") if strict else t.try_cast("timestamp")


def naive_utc(c) -> Column:
    """Instant -> naive UTC wall clock (``AT TIME ZONE 'UTC'``), independent of the session zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), col(c).cast("timestamp_ntz"))


def local_date(c, zone: str = LOCAL_ZONE, naive_is_utc: bool = True) -> Column:
    """Calendar date of an instant in ``zone`` (DST-aware).

    ``naive_is_utc`` – the column is a naive UTC wall clock (``timestamp_ntz``);
    otherwise it is an instant (``timestamp``).
    """
    c = col(c)
    src = F.lit("UTC") if naive_is_utc else F.current_timezone()
    return F.to_date(F.convert_timezone(src, F.lit(zone), c.cast("timestamp_ntz")))


def parse_or_default(c, default: float = DEFAULT_HOUSE_VALUE) -> Column:
    """Number from text, the default when blank or unparseable."""
    return F.coalesce(blank_to_null(c).try_cast("double"), F.lit(default))


def money_round(c) -> Column:
    """Round a money amount to cents in one step, on the exact value of the double (2.675 is a
    little less than that and gives 2.67); an exact half goes to the even cent."""
    return F.replace(F.format_number(col(c), 2), F.lit(","), F.lit("")).cast("decimal(38,2)")


# ISO-8601 text, whole: date (calendar or week, with or without hyphens), optionally any one
# character and a time (hours, minutes, seconds, fraction) with an optional offset.
_ISO_DATE = r"(\d{4})(?:-?(\d{2})-?(\d{2})|-?W(\d{2})(?:-?([1-7]))?)"
_ISO_TIME = r"(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
_ISO_OFFSET = r"(?: ?(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?))?"
ISO = f"^{_ISO_DATE}(?:[^0-9]{_ISO_TIME}{_ISO_OFFSET})?$"


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it: the
    optimizer would otherwise write the whole expression out at every place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _iso_parts(c: Column) -> Column:
    """The ten groups of ``ISO`` (from position 0; one that is absent is empty), in one match."""
    return F.split(F.regexp_replace(c, ISO, ",".join(f"${i}" for i in range(1, 11))), ",", -1)


def _iso_wall(part: Column) -> Column:
    """The wall clock that the groups tell (NULL if there is no such time)."""
    at = lambda i: F.get(part, F.lit(i))
    calendar = F.concat_ws("-", at(0), at(1), at(2)).try_cast("date")
    # week 1 is the week of 4 January
    monday = F.date_trunc("week", F.concat(at(0), F.lit("-01-04")).try_cast("date")).cast("date")
    day = F.when(at(4) == "", F.lit(1)).otherwise(at(4).try_cast("int"))
    week = F.when(at(3).between("01", "53"), F.date_add(monday, (at(3).try_cast("int") - 1) * 7 + day - 1))
    date = F.when(at(3) == "", calendar).otherwise(week)
    or_zero = lambda i: F.when(at(i) == "", F.lit("00")).otherwise(at(i))
    return F.concat(date.cast("string"), F.lit(" "), F.concat_ws(":", or_zero(5), or_zero(6), or_zero(7)), F.lit("."),
                    F.rpad(F.substring(at(8), 1, 6), 6, "0")).try_cast("timestamp_ntz")


def _iso_offset(sent: Column) -> Column:
    """``seconds`` and ``text`` of an offset as it was sent (``Z``, with or without colons)."""
    def told(digits: Column) -> Column:
        hms = [F.rpad(F.substring(digits, i, 2), 2, "0") for i in (2, 4, 6)]
        size = sum((h.try_cast("int") * n for h, n in zip(hms, (3600, 60, 1), strict=True)), F.lit(0))
        west = digits.startswith("-")
        text = F.concat(F.when(west & (size != 0), F.lit("-")).otherwise(F.lit("+")), hms[0], F.lit(":"), hms[1],
                        F.when(hms[2] == "00", F.lit("")).otherwise(F.concat(F.lit(":"), hms[2])))
        none = digits == ""
        return F.struct(F.when(none, F.lit(0)).otherwise(F.when(west, -size).otherwise(size)).alias("seconds"),
                        F.when(none, F.lit("")).otherwise(text).alias("text"))
    return bind(F.translate(F.when(sent == "Z", F.lit("+000000")).otherwise(sent), ":", ""), told)


def iso_instant(c) -> Column:
    """ISO-8601 text -> struct (``instant``, ``text``, ``naive``): the instant, the time as
    written, with its own offset, in extended form, and whether it has none; such a time is
    compared as UTC. NULL for anything else. The text is matched once to tell whether it is a
    time, and once to take it apart; every later step reads the parts."""
    c = col(c)

    def told(x: Column) -> Column:
        wall, offset = x.getField("wall"), x.getField("offset")
        micros = F.date_format(wall, "SSSSSS")
        text = F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"),
                        F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), offset.getField("text"))
        instant = wall - F.make_dt_interval(secs=offset.getField("seconds").cast("decimal(18,6)"))
        return F.when(wall.isNotNull(), F.struct(instant.alias("instant"), text.alias("text"),
                                                 (offset.getField("text") == "").alias("naive")))

    taken = bind(_iso_parts(c), lambda p: F.struct(_iso_wall(p).alias("wall"), _iso_offset(F.get(p, F.lit(9))).alias("offset")))
    return F.when(c.rlike(ISO), bind(taken, told))


# --- account-type predicates --------------------------------------------------

def normalise_type(c) -> Column:
    """``upper(trim(coalesce(type,'')))``."""
    return F.upper(F.trim(F.coalesce(col(c), F.lit(""))))


def credit_flag(c) -> Column:
    """A type mentioning 'credit' or 'card' (any case) is a credit card; NULL is not."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    return low.contains("credit") | low.contains("card")


def loan_pred(type_col="account_type", credit_col="is_credit_card") -> Column:
    """Loan rows: type equals LOAN ignoring case, and not flagged as a credit card."""
    is_loan = F.upper(F.coalesce(col(type_col), F.lit(""))) == F.lit("LOAN")
    return is_loan & (F.coalesce(col(credit_col), F.lit(False)) == F.lit(False))


def credit_pred(credit_col="is_credit_card") -> Column:
    return F.coalesce(col(credit_col), F.lit(False)) == F.lit(True)


def zero_if_null(c) -> Column:
    return F.coalesce(col(c), F.lit(0))


def sum_if(pred: Column, c, out_type: str = SUM_NUMERIC) -> Column:
    """``sum(case when pred then coalesce(c,0) else 0 end)`` with the result widened to ``out_type``."""
    return F.sum(F.when(pred, zero_if_null(c)).otherwise(F.lit(0))).cast(out_type)
