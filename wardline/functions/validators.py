"""If a text that looks like an identifier can be one: check digits, number ranges, calendar dates. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn(digits: Column) -> Column:
    """The check digit of card numbers: from the right, every second digit counts twice, the sum is a multiple of ten."""
    def worth(i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def card_number(value: Column) -> Column:
    """A check digit that fits, and a first digit that card issuers use."""
    return value.rlike("^[2-6]") & luhn(F.regexp_replace(value, "[ -]", ""))


def ssn(value: Column) -> Column:
    """No area 000, 666 or from 900, no group 00, no serial 0000: those are never issued."""
    return ~value.rlike("^(?:000|666|9)|-00-|-0000$")


def birth_date(value: Column) -> Column:
    """A day of the calendar."""
    return value.try_cast("date").isNotNull()


def ip_address(value: Column) -> Column:
    """Four numbers to 255, without leading zeros."""
    return value.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$")


def email(value: Column) -> Column:
    """Dots only between other characters, host labels without a dash at an end, a top level of two letters or more."""
    return value.rlike(
        r"^[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$")


def phone(value: Column) -> Column:
    """Area and exchange of the North American plan begin with 2 to 9, and are no service code (such as 911)."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return digits.rlike("^[2-9][0-9]{2}[2-9]") & ~digits.rlike("^[2-9]11|^[0-9]{3}[2-9]11")


BY_PATTERN = {
    "email": email, "ssn": ssn, "phone": phone, "card_number": card_number, "birth_date": birth_date, "ip_address": ip_address,
}
