"""Mask expressions by policy name, for identifiers and for free text.

A policy for a column fails closed: a value without the form that the policy expects is hidden as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.columns import as_column

SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
# The look-behind lets a match start only where a word starts, so long words without '@' are read once.
MAIL_NAME = r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*+@"
# A run of nine digits or more, of any length.
LONG_NUMBER = r"[0-9]{5,}([0-9]{4})"
HIDDEN = "***masked***"


def hidden(value: Column) -> Column:
    return F.when(value.isNotNull(), F.lit(HIDDEN))


def _if(value: Column, form: str, masked: Column) -> Column:
    return F.when(value.rlike(form), masked).otherwise(hidden(value))


def last_four(value: Column) -> Column:
    """Hide every digit but the last four, in a number with separators that has more than four."""
    tail = F.regexp_extract(value, r"((?:[0-9][^0-9]*){4})$", 1)
    head = F.substring(value, F.lit(1), F.length(value) - F.length(tail))
    return _if(value, r"^[ ()+./-]*(?:[0-9][ ()+./-]*){5,}$", F.concat(F.regexp_replace(head, "[0-9]", "*"), tail))


def full_ssn(value: Column) -> Column:
    return _if(value, r"^[0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4}$", F.lit("***-**-****"))


def patient_id(value: Column, secret: Column | None = None) -> Column:
    """A stable pseudonym under a secret: equal ids stay equal, so masked tables can still be joined, and without
    the secret the ids can't be found by trying. Without a secret the value is hidden."""
    if secret is None:
        return hidden(value)
    inner = F.sha2(F.concat(secret, F.lit("|"), value), 256)
    return F.concat(F.lit("pt_"), F.sha2(F.concat(secret, F.lit("|"), inner), 256))


def birth_year(value: Column) -> Column:
    """The first of January of the year; for dates by year-month-day (with or without dashes, and what follows), or with
    the year last after slashes, dots or dashes."""
    first = F.regexp_extract(value, r"^([0-9]{4})-?[0-9]{2}-?[0-9]{2}(?:[T ].*)?$", 1)
    last = F.regexp_extract(value, r"^[0-9]{1,2}[/.-][0-9]{1,2}[/.-]([0-9]{4})$", 1)
    year = F.coalesce(F.nullif(first, F.lit("")), F.nullif(last, F.lit("")))
    return F.when(year.isNotNull(), F.concat(year, F.lit("-01-01"))).otherwise(hidden(value))


def email(value: Column) -> Column:
    """Keep the first character and the host of one mail address."""
    return _if(value, r"^[^@\s]+@[^@\s]+$", F.concat(F.substring(value, 1, 1), F.lit("***@"), F.substring_index(value, "@", -1)))


def account(value: Column) -> Column:
    return F.when(F.length(value) > 4, F.concat(F.lit("****"), F.right(value, F.lit(4)))).otherwise(hidden(value))


BY_POLICY = {
    "MASK_PATIENT_ID": patient_id,
    "MASK_FULL_SSN": full_ssn,
    "MASK_DOB": birth_year,
    "MASK_EMAIL": email,
    "MASK_LAST_4": last_four,
    "MASK_ACCOUNT": account,
    "MASK_SENSITIVE_VALUE": hidden,
    "None": lambda value: value,
}


def _mask(text: Column, policy: str, secret: Column | None) -> Column:
    mask = BY_POLICY.get(policy, hidden)
    return mask(text, secret) if mask is patient_id else mask(text)


def _secret(secret: str | None) -> Column | None:
    return None if secret is None else F.lit(secret)


def by_policy(value: Column | str, policy: str, secret: str | None = None) -> Column:
    """The masked value; an unknown policy hides it."""
    return _mask(as_column(value).cast("string"), policy, _secret(secret))


def by_policy_column(value: Column | str, policy: Column | str, secret: str | None = None) -> Column:
    """As ``by_policy`` where the policy differs from row to row."""
    text, name = as_column(value).cast("string"), as_column(policy)
    chain = F.when(name == "None", text)
    for known in BY_POLICY:
        if known not in ("None", "MASK_SENSITIVE_VALUE"):
            chain = chain.when(name == known, _mask(text, known, _secret(secret)))
    return chain.otherwise(hidden(text))


# Forms that the value scan knows, inside running text: (needed character or form, form, what stays).
IN_TEXT = (
    ("@", MAIL_NAME, "$1***@"),
    ("-", SSN, "***-**-****"),
    ("[0-9]{3}[-. )]", r"\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}", "***-***-****"),
    ("[0-9][ -][0-9]", r"[0-9]{4}(?:[ -][0-9]{4}){2}[ -]([0-9]{4})", "**** **** **** $1"),
    ("-", r"((?:19|20)[0-9]{2})-[0-9]{2}-[0-9]{2}", "$1-**-**"),
    ("[0-9][.][0-9]", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "*.*.*.*"),
    ("[0-9]{9}", LONG_NUMBER, "****$1"),
)


def free_text(value: Column | str) -> Column:
    """Mask, inside running text of any length, what the value scan finds: mail names, social security, phone and card numbers,
    dates (the year stays), addresses of machines, and runs of nine digits or more."""
    text = as_column(value)
    for needed, form, stays in IN_TEXT:
        there = text.contains(needed) if len(needed) == 1 else text.rlike(needed)
        text = F.when(there, F.regexp_replace(text, form, stays)).otherwise(text)
    return text
