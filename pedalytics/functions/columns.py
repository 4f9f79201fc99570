"""Scalar functions and standardisers as Column expressions.

Every function takes and returns a ``Column`` so that it stays inside
whole-stage codegen; none of them is a Python UDF.

The staging SQL this mirrors casts text to numbers the lenient way: the
longest numeric prefix is used, a value without one becomes 0, and only
NULL stays NULL (``'10.0' -> 10``, ``'12abc' -> 12``, ``'nan' -> 0``).
Spark's ANSI casts would throw and ``try_cast('nan' as double)`` returns
NaN, so the prefix is extracted explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pedalytics import schemas as K

__all__ = [
    "as_col", "lenient_long", "lenient_double", "null_tokens", "to_int_coerce", "month_date",
    "strip_commas", "blank_to_null", "station_id_from_name",
    "station_name_from_name", "round_half_up", "safe_ratio", "age_band", "gender",
    "pass_group", "rack_cnt", "ops_flag", "clean_number", "clean_long", "strip_all",
    "is_numeric_text", "snapshot_ym_from_name", "keyword_score", "decoded_file_name",
    "now_text", "PANDAS_NA_TOKENS",
]

# numeric prefixes accepted by the lenient casts (leading whitespace ignored)
_INT_PREFIX = r"^\s*([+-]?[0-9]+)"
_REAL_PREFIX = r"^\s*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)"

# Text that pandas' CSV reader turns into a missing value by default.
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_long(c: Column | str) -> Column:
    """Text -> bigint, longest integer prefix, 0 when none, NULL only for NULL.

    The prefix regex always yields a well-formed number or '', so the cast
    never fails (no exception path per row).
    """
    c = as_col(c)
    digits = F.regexp_extract(c.cast("string"), _INT_PREFIX, 1)
    return F.when(c.isNotNull(), F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint")))


def lenient_double(c: Column | str) -> Column:
    """Text -> double, longest real prefix, 0.0 when none, NULL only for NULL.

    'nan' and 'inf' have no numeric prefix, so they become 0.0, never NaN or
    infinity.
    """
    c = as_col(c)
    digits = F.regexp_extract(c.cast("string"), _REAL_PREFIX, 1)
    return F.when(c.isNotNull(), F.coalesce(digits.try_cast("double"), F.lit(0.0)))


# The characters Python's str.strip() removes (str.isspace() is true).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                 "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip_all(c: Column | str) -> Column:
    """Strip leading/trailing whitespace exactly like Python's ``str.strip``.

    Includes the Unicode spaces (e.g. the ideographic space U+3000), which
    ``trim`` and the regex class ``\\s`` leave in place.
    """
    return F.btrim(as_col(c), F.lit(PY_WHITESPACE))


def null_tokens(c: Column | str) -> Column:
    """Value -> stripped text; missing values (NULL or a missing token) -> 'nan'."""
    c = as_col(c).cast("string")
    return F.when(c.isNull() | c.isin(*PANDAS_NA_TOKENS), F.lit("nan")).otherwise(strip_all(c))


# whole texts that are numbers (no type suffixes, no hexadecimal digits)
_WHOLE_INT = r"^[+-]?[0-9]+$"
_WHOLE_REAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITE = r"^[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?$"


def is_numeric_text(c: Column | str) -> Column:
    """The value is written as a finite or infinite number (not missing, not NaN)."""
    c = strip_all(as_col(c).cast("string"))
    return F.coalesce(c.rlike(_WHOLE_REAL) | c.rlike(_INFINITE), F.lit(False))


def to_int_coerce(c: Column | str) -> Column:
    """C4: value -> nullable bigint; unparseable -> NULL.

    Integers are read as such, with all digits.  An integral number written
    as real ('12.0') is accepted; a fractional value or one outside the range
    cannot be held by a nullable integer and is NULL too.
    """
    s = strip_all(as_col(c).cast("string"))
    d = F.when(s.rlike(_WHOLE_REAL), s.try_cast("double"))
    whole = (d == F.floor(d)) & (F.abs(d) < F.lit(9.2e18))
    return F.when(s.rlike(_WHOLE_INT), s.try_cast("bigint")).when(whole, d.try_cast("bigint"))


def month_date(ym: Column | str) -> Column:
    """Yyyymm -> 'yyyy-mm-01' as text (NULL-propagating)."""
    s = as_col(ym).cast("string")
    return F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 2), F.lit("-01"))


def strip_commas(c: Column | str) -> Column:
    """C11: drop thousands separators."""
    return F.replace(as_col(c), F.lit(","), F.lit(""))


def blank_to_null(c: Column | str) -> Column:
    """NULLIF(TRIM(c), '')."""
    return F.nullif(F.trim(as_col(c)), F.lit(""))


def clean_number(c: Column | str) -> Column:
    """Trim -> blank to NULL -> drop commas -> lenient real cast."""
    return lenient_double(strip_commas(blank_to_null(c)))


def clean_long(c: Column | str) -> Column:
    """T6 for integers: trim -> blank to NULL -> drop commas -> lenient integer cast."""
    return lenient_long(strip_commas(blank_to_null(c)))


def _dot(c: Column) -> Column:
    return F.instr(c, ".")


def station_id_from_name(c: Column | str) -> Column:
    """C13 (id part): ``'207. name' -> 207``; no dot -> NULL."""
    t = F.trim(as_col(c))
    return F.when(_dot(t) > 0, lenient_long(F.substr(t, F.lit(1), _dot(t) - 1)))


def station_name_from_name(c: Column | str) -> Column:
    """C13 (name part): text after the first dot, trimmed; no dot -> whole text trimmed."""
    t = F.trim(as_col(c))
    return F.when(_dot(t) > 0, F.trim(F.substr(t, _dot(t) + 1))).otherwise(t)


def round_half_up(c: Column | str, digits: int) -> Column:
    """ROUND(x, n), half away from zero, on doubles."""
    return F.round(as_col(c).cast("double"), digits)


def safe_ratio(num: Column | str, den: Column | str, scale: float = 1.0) -> Column:
    """``scale * num / den`` as double when ``den > 0``, else NULL."""
    num, den = as_col(num), as_col(den)
    value = num.cast("double") / den.cast("double")
    if scale != 1.0:
        value = F.lit(float(scale)) * num.cast("double") / den.cast("double")
    return F.when(den > 0, value)


def age_band(c: Column | str) -> Column:
    """Missing tokens -> UNKNOWN, else trimmed."""
    c = as_col(c)
    return F.when(c.isNull() | F.upper(F.trim(c)).isin(*K.AGE_BAND_MISSING), F.lit(K.UNKNOWN)) \
        .otherwise(F.trim(c))


def gender(c: Column | str) -> Column:
    """M / F (any case, trimmed), else UNKNOWN.

    ``upper(trim(x)) = 'M'`` holds exactly for 'M' and 'm', so the test is an
    ``isin`` on the trimmed text (no case mapping per row).
    """
    t = F.trim(as_col(c))
    return F.when(t.isin("M", "m"), F.lit("M")).when(t.isin("F", "f"), F.lit("F")) \
        .otherwise(F.lit(K.UNKNOWN))


def pass_group(c: Column | str) -> Column:
    """T4: trimmed subscription token -> SUBSCRIPTION, everything else (NULL too) -> NON_."""
    return F.when(F.trim(as_col(c)) == K.SUBSCRIPTION_TOKEN, F.lit(K.SUBSCRIPTION)) \
        .otherwise(F.lit(K.NON_SUBSCRIPTION))


def rack_cnt(op: Column | str, lcd: Column | str, qr: Column | str) -> Column:
    """Rack count by operation type."""
    op, lcd, qr = as_col(op), as_col(lcd), as_col(qr)
    zero = F.lit(0).cast("bigint")
    return (F.when(op == K.RACK_QR, F.coalesce(qr, zero))
            .when(op == K.RACK_LCD, F.coalesce(lcd, zero))
            .when(op == K.RACK_BOTH, F.coalesce(lcd, zero) + F.coalesce(qr, zero))
            .otherwise(F.coalesce(qr, lcd, zero)))


def ops_flag(station_id: Column | str, station_name_raw: Column | str) -> Column:
    """T5: 1 for the operations station (id 9980 or name containing AS센터), else 0.

    ``station_id`` is the already lenient-cast id.  Mirrors ``CASE WHEN
    id = 9980 OR name LIKE ... THEN 1 ELSE 0``: a NULL predicate falls to ELSE.
    """
    hit = (as_col(station_id) == K.OPS_STATION_ID) | \
        F.trim(as_col(station_name_raw)).ilike(K.OPS_STATION_PATTERN)
    return F.when(hit, F.lit(1)).otherwise(F.lit(0))


def snapshot_ym_from_name(name: Column | str) -> Column:
    """S11: '(YY.M월 기준)' in a file name -> 20YYMM (int); NULL when absent."""
    pat = r"\((\d{2})\.(\d{1,2})월 기준\)"
    n = as_col(name)
    yy = F.regexp_extract(n, pat, 1)
    mm = F.regexp_extract(n, pat, 2)
    return F.when(yy != "", F.concat(F.lit("20"), yy, F.lpad(mm.cast("int").cast("string"), 2, "0"))
                  .cast("int"))


def keyword_score(text: Column | str, keywords=K.HEADER_KEYWORDS) -> Column:
    """Number of keywords contained in a text."""
    t = as_col(text)
    return sum((F.coalesce(F.contains(t, F.lit(k)), F.lit(False)).cast("int") for k in keywords),
               F.lit(0))


def decoded_file_name(c: Column | str = "_metadata.file_name") -> Column:
    """File name from the scan metadata, URL-decoded ('+' kept literal)."""
    return F.url_decode(F.replace(as_col(c), F.lit("+"), F.lit("%2B")))


def now_text() -> Column:
    """Current time as 'yyyy-MM-dd HH:mm:ss' text."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
