"""Text, number and id coercion with the semantics of the web forms' language.

Trimming strips all Unicode white space, length counts UTF-16 units, and a
numeric string follows ECMAScript ``Number()``: empty is 0, exponents and
0x/0o/0b literals count, anything else is not a number (null here).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters ECMAScript treats as white space or line ends.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

EMAIL_PATTERN = rf"^[^@{WHITE_SPACE}]+@[^@{WHITE_SPACE}]+\.[^@{WHITE_SPACE}]+\z"
# The number literals of ECMAScript strings.
_DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_RADIX = {16: r"^0[xX]0*([0-9a-fA-F]+)\z", 8: r"^0[oO]0*([0-7]+)\z", 2: r"^0[bB]0*([01]+)\z"}
# Digits of each that fit into a long.
_FITTING = {16: 15, 8: 20, 2: 60}
# A bracketed address or a name without forbidden characters.
_HOST = r"^(?:\[[0-9a-fA-F:.]+\]|[^\x00-\x20#/:<>?@\[\\\]^|%\x7f]+)(?::[0-9]*)?\z"


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that many later expressions read.

    A projection would be merged into its readers and computed again for every
    use; a generator is evaluated once per row.
    """
    return df.select("*", F.inline(F.array(F.struct(
        *[value.alias(name) for name, value in columns.items()]))))


def norm_text(value: Column) -> Column:
    """Trimmed text; a missing value becomes the empty string."""
    return F.coalesce(F.btrim(value, F.lit(WHITE_SPACE)), F.lit(""))


def norm_email(value: Column) -> Column:
    return F.lower(norm_text(value))


def utf16_length(value: Column) -> Column:
    return (F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("int")


def _radix_number(digits: Column, radix: int) -> Column:
    """Value of digits of any number; those beyond a long only count by their place."""
    fitting = _FITTING[radix]
    beyond = F.greatest(F.length(digits) - fitting, F.lit(0))
    head = F.conv(F.substring(digits, 1, fitting), radix, 10).try_cast("double")
    return head * F.pow(F.lit(float(radix)), beyond)


def to_number(value: Column) -> Column:
    """Numeric value of a form field as a double, null when it is not a number."""
    text = norm_text(value)
    others = [_radix_number(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), radix)
              for radix, pattern in _RADIX.items()]
    return F.coalesce(F.when(text == "", F.lit(0.0)),
                      F.regexp_extract(text, _DECIMAL, 0).try_cast("double"), *others)


def is_whole(number: Column) -> Column:
    """True for finite values without a fraction; null input gives false."""
    return F.coalesce(number % 1 == 0, F.lit(False))


def is_long(number: Column) -> Column:
    """True for whole values that a long can hold."""
    return is_whole(number) & (F.abs(number) < 2.0**63)


def coerce_id(value: Column) -> Column:
    """A positive whole number as a long; anything else is null ("not found")."""
    number = to_number(value)
    return F.when(is_long(number) & (number > 0), number.try_cast("long"))


def full_name(first: Column, last: Column) -> Column:
    return F.concat(first, F.lit(" "), last)


def masked_name(first: Column, last: Column) -> Column:
    """First name and initial, as shown to other bidders; null without a person."""
    return F.concat(first, F.lit(" "), F.substring(last, 1, 1), F.lit("."))


def safe_image_url(value: Column) -> Column:
    """True when the value is an absolute http(s) address with a host and a port
    that exists."""
    authority = F.regexp_extract(value, r"(?i)^https?:[/\\]*([^/\\?#]*)", 1)
    place = F.regexp_replace(authority, r"^.*@", "")
    port = F.regexp_extract(place, r":0*([0-9]+)\z", 1)
    exists = (F.length(port) <= 5) & (F.coalesce(port.try_cast("int"), F.lit(0)) <= 65535)
    return F.coalesce(place.rlike(_HOST) & exists, F.lit(False))
