"""Sealed reports and replacement secrets."""

from __future__ import annotations

import base64
import secrets
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, _c

# Shape of a replacement by rule: prefix, alphabet, length.
SHAPES = {
    "aws-access-key-id": ("AKIA", string.ascii_uppercase + string.digits, 16),
    "github-pat": ("ghp_", string.ascii_letters + string.digits, 36),
    "stripe-secret-key": ("sk_live_", string.ascii_letters + string.digits, 24),
    "slack-token": ("xoxb-", string.digits + string.ascii_lowercase, 40),
    "google-api-key": ("AIza", string.ascii_letters + string.digits + "_-", 35),
}


def seal(text: ColumnLike, key: ColumnLike) -> Column:
    """AES-GCM under a 16, 24 or 32-byte key, as base64."""
    return F.base64(F.aes_encrypt(_c(text).cast("binary"), _c(key).cast("binary"), F.lit("GCM")))


def unseal(sealed: ColumnLike, key: ColumnLike) -> Column:
    """The text, or null if the key does not fit."""
    return F.try_aes_decrypt(F.unbase64(_c(sealed)), _c(key).cast("binary"), F.lit("GCM")).cast("string")


def read_xor(sealed: str, key: str) -> str:
    """Reader of the older XOR form; nothing writes it."""
    raw, k = base64.b64decode(sealed), key.encode()
    return bytes(b ^ k[n % len(k)] for n, b in enumerate(raw)).decode("utf-8", "replace")


def replacement(rule_id: str) -> str:
    """A fresh random secret in the rule's shape; differs at every call."""
    prefix, alphabet, length = SHAPES.get(rule_id, ("", string.ascii_letters + string.digits, 32))
    return prefix + "".join(secrets.choice(alphabet) for _ in range(length))
