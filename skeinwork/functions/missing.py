"""What counts as a missing value, and how keys written in several ways are brought to one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that stand for no value, compared trimmed and in lower case.
PLACEHOLDERS = ("", "-", "--", "?", "n/a", "#n/a", "na", "nan", "none", "null", "nil", "\\n", "<na>", "unknown", "not available", "missing", "undefined")


def squeezed(c: Column | str) -> Column:
    """Without white space (also non-breaking) at either end."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def present(c: Column | str) -> Column:
    """The value trimmed and in lower case; null if null, blank or a placeholder."""
    v = F.lower(squeezed(c))
    return F.when(~v.isin(*PLACEHOLDERS), v)


def known(c: Column | str) -> Column:
    """The value as it is; null if null, blank or a placeholder."""
    raw = F.col(c) if isinstance(c, str) else c
    return F.when(present(raw).isNotNull(), raw)


def uuid_key(c: Column | str) -> Column:
    """One spelling of a UUID: lower case hexadecimal digits without `urn:uuid:`, braces, hyphens or spaces.

    Null for null, blank and placeholders. An incomplete or damaged UUID stays what is left of it
    and equals no complete one.
    """
    return F.regexp_replace(F.regexp_replace(present(c), r"^urn:uuid:", ""), r"[{}\s-]", "")


def sql_present(c: str) -> str:
    """`present` as SQL text for the oracle."""
    v = f"lower(regexp_replace({c}, '^[\\s\\x{{00a0}}]+|[\\s\\x{{00a0}}]+$', '', 'g'))"
    names = ", ".join("'" + p + "'" for p in PLACEHOLDERS)
    return f"(CASE WHEN {v} NOT IN ({names}) THEN {v} END)"
