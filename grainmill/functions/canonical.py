"""Functions that need Python: canonical JSON, Unicode compatibility folding, keyed hashes."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(value) -> str:
    """Sorted keys, no spaces, no escapes beyond JSON's own; NaN and infinities are refused."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def strict_loads(text: str):
    """JSON in which a repeated key or a non-finite number is an error."""

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("repeated key")
        return out

    def refuse(name):
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)


@F.pandas_udf(T.StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """JSON text to its canonical form; null where it isn't strict JSON."""

    def one(text):
        try:
            return None if text is None else canonical(strict_loads(text))
        except ValueError:
            return None

    return values.map(one)


@F.pandas_udf(T.StringType())
def compatible_fold(values: pd.Series) -> pd.Series:
    """NFKC, then case folding, then white space collapsed."""
    return values.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


@F.pandas_udf(T.StringType())
def json_type(values: pd.Series) -> pd.Series:
    """null, boolean, integer, number, string, array or object; a boolean is no integer."""

    def one(text):
        try:
            v = json.loads(text) if text is not None else None
        except ValueError:
            return None
        if isinstance(v, bool):
            return "boolean"
        kinds = {int: "integer", float: "number", str: "string", list: "array", dict: "object", type(None): "null"}
        return kinds[type(v)]

    return values.map(one)


def keyed_hash(text: str, person: bytes = b"") -> int:
    """BLAKE2b of eight bytes as an unsigned integer."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8, person=person).digest(), "big")
