"""Content digests: canonical JSON, bytes, and a running digest over an ordered group."""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "sha256:"


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key is there twice")
    return out


def _finite(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError("not finite")
    return x


def _refuse(text: str):
    raise ValueError(text)


_READ = json.JSONDecoder(object_pairs_hook=_unique, parse_float=_finite, parse_constant=_refuse).decode
_WRITE = json.JSONEncoder(ensure_ascii=True, sort_keys=True, separators=(",", ":"), allow_nan=False).encode


def written(value) -> str:
    """Sorted, compact, ASCII JSON of a value in memory."""
    return _WRITE(value)


def canonicals(text: str | None, forms: list[tuple[tuple[str, ...], str | None]]) -> list[str | None]:
    """Sorted, compact, ASCII JSON of an object, read once, for each of some forms: (members left out, member to take instead, or null); None if it can't be read strictly."""
    try:
        whole = _READ(text)
    except (ValueError, TypeError):
        return [None] * len(forms)
    out = []
    for without, at in forms:
        try:
            value = whole if at is None else whole[at]
            out.append(_WRITE({k: v for k, v in value.items() if k not in without} if without else value))
        except (ValueError, KeyError, TypeError, AttributeError):
            out.append(None)
    return out


def canonical(text: str | None, without: tuple[str, ...] = (), at: str | None = None) -> str | None:
    """Sorted, compact, ASCII JSON of an object (or of its member `at`) without these members; None if it can't be read strictly."""
    return canonicals(text, [(without, at)])[0]


def json_digest_of(value) -> str:
    """Digest of a small value on the driver, as json_digest() gives it for its text."""
    return PREFIX + hashlib.sha256(canonical(json.dumps(value)).encode()).hexdigest()


def canonical_json(raw: Column, without: tuple[str, ...] = (), at: str | None = None) -> Column:
    """Canonical form of JSON text by Arrow batches; null where the text isn't strict JSON or lacks the member."""

    @F.pandas_udf("string")
    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: canonical(t, without, at))

    return batch(raw)


def json_digest(raw: Column, without: tuple[str, ...] = (), at: str | None = None) -> Column:
    return text_digest(canonical_json(raw, without, at))


def text_digest(text: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.sha2(F.encode(text, "utf-8"), 256))


def bytes_digest(content: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.sha2(content, 256))


def json_digests(raw: Column, forms: dict[str, tuple[tuple[str, ...], str | None]]) -> Column:
    """A struct of digests of one JSON text, by name: each of the text without some members, or of its member; one pass for all."""
    names, wanted = list(forms), list(forms.values())

    @F.pandas_udf("array<string>")
    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: canonicals(t, wanted))

    return F.transform(F.array(batch(raw)), lambda c: F.struct(*(text_digest(F.get(c, F.lit(i))).alias(n) for i, n in enumerate(names))))[0]


def running_digest(rows: Column, start: str = "") -> Column:
    """Digest after the last of an array of strings: each step hashes the digest so far and the next string."""
    return F.aggregate(rows, F.lit(start), lambda a, x: F.sha2(F.encode(F.concat(a, x), "utf-8"), 256))


SUM = "decimal(38,0)"


def id_hash(seed: int, c: Column) -> Column:
    """A 64-bit hash as a number whose sums don't overflow."""
    return F.xxhash64(F.lit(seed), c).cast("decimal(20,0)")


def id_sums(ids: Column) -> Column:
    """n, a, b of an array of texts: its length and two sums of hashes, which tell multisets apart whatever their order and merge by adding."""
    total = lambda seed: F.aggregate(ids, F.lit(0).cast(SUM), lambda s, x: (s + id_hash(seed, x)).cast(SUM))
    return F.struct(F.coalesce(F.size(ids), F.lit(0)).cast("long").alias("n"), F.coalesce(total(1), F.lit(0)).cast(SUM).alias("a"), F.coalesce(total(2), F.lit(0)).cast(SUM).alias("b"))


def draw(seed: Column, counter: Column, n: Column) -> Column:
    """Index from 0 below n: SHA-256 of "seed:counter" as a 256-bit number, modulo n (n below 2**31).

    A number beyond the last multiple of n would be drawn again for an exactly
    even choice; its chance is below n / 2**256, and it isn't.
    """
    digest = F.sha2(F.encode(F.concat(seed.cast("string"), F.lit(":"), counter.cast("string")), "utf-8"), 256)

    def folded(text: Column) -> Column:
        out = F.lit(0).cast("long")
        for i in range(8):
            out = (out * (1 << 32) + F.conv(F.substring(text, 8 * i + 1, 8), 16, 10).cast("long")) % n
        return out

    return F.get(F.transform(F.array(digest), folded), F.lit(0))  # a bound variable, so that the digest is computed once


def draws(seed: str, counter: int, n: int) -> np.ndarray:
    """n indexes below n, those of draw() for so many counters from this one on."""
    start, sha = f"{seed}:".encode(), hashlib.sha256
    return np.array([int.from_bytes(sha(start + str(i).encode()).digest(), "big") % n for i in range(counter, counter + n)], np.int64)


def list_digest(*parts: Column) -> Column:
    """SHA-256 of the canonical JSON list of some texts, in hexadecimal digits."""
    return F.sha2(F.encode(canonical_json(F.to_json(F.array(*parts))), "utf-8"), 256)


def deterministic_id(prefix: str, *parts: Column) -> Column:
    """prefix and the digest, in upper case, of the canonical JSON list of the parts."""
    return F.concat(F.lit(prefix), F.upper(list_digest(*parts)))
