"""Personal-data masks, and the tests that tell whether a value was masked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mask texts and the patterns that recognise unmasked values.
EMAIL_PATTERN = r"^[^@]+@[^@]+\.[^@]+$"
CARD_PATTERN = r"^[0-9]{13,19}$"
SHA256_PATTERN = r"^[0-9a-f]{64}$"
PHONE_PREFIX = "***"
CARD_PREFIX = "****-****-****-"
EMAIL_FILL = "***@"


def _tail(text: Column) -> Column:
    return F.substring(text, -4, 4)


def mask(method: str | None, column: Column) -> Column:
    """Masked value; NULL stays NULL. Without a method the value is removed."""
    text = column.cast("string")
    if method == "keep":
        return column
    if method in (None, "nullify"):
        return F.lit(None).cast("string")
    if method == "sha256":
        return F.sha2(text, 256)
    if method == "email_mask":
        local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
        return F.concat(F.substring(local, 1, 1), F.lit(EMAIL_FILL), domain)
    if method == "phone_mask":
        return F.concat(F.lit(PHONE_PREFIX), _tail(text))
    if method == "last4":
        return F.concat(F.lit(CARD_PREFIX), _tail(text))
    raise ValueError(f"unknown masking method: {method}")


def is_unmasked(method: str | None, column: Column) -> Column:
    """TRUE for a non-NULL value that a mask should have changed but did not."""
    text = column.cast("string")
    tests = {
        "email_mask": text.rlike(EMAIL_PATTERN) & ~text.contains("***"),
        "last4": text.rlike(CARD_PATTERN),
        "sha256": ~text.rlike(SHA256_PATTERN),
        "phone_mask": ~text.startswith(PHONE_PREFIX),
        "nullify": F.lit(True),
    }
    return column.isNotNull() & tests.get(method or "nullify", F.lit(False))
