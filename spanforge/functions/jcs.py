"""Canonical JSON (RFC 8785): members sorted by UTF-16 code units, numbers as ECMAScript writes them, shortest strings."""

from __future__ import annotations

import hashlib
import json
import math


def number(x) -> str:
    if isinstance(x, int):
        x = float(x)
    if math.isnan(x) or math.isinf(x):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    sign, digits, exponent = ("-" if x < 0 else ""), *_shortest(abs(x))
    n = len(digits)
    if n <= exponent <= 21:
        text = digits + "0" * (exponent - n)
    elif 0 < exponent <= 21:
        text = digits[:exponent] + "." + digits[exponent:]
    elif -6 < exponent <= 0:
        text = "0." + "0" * -exponent + digits
    else:
        e = exponent - 1
        text = digits[0] + ("." + digits[1:] if n > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return sign + text


def _shortest(x: float) -> tuple[str, int]:
    """Significant digits of the shortest text that reads back as ``x``, and where the point is from their start."""
    mantissa, e = f"{x!r}" if "e" in repr(x) else f"{x!r}e0", 0
    mantissa, _, tail = mantissa.partition("e")
    whole, _, fraction = mantissa.partition(".")
    digits = (whole + fraction).lstrip("0")
    e = int(tail) + len(whole) - (len(whole + fraction) - len((whole + fraction).lstrip("0")))
    return digits.rstrip("0") or "0", e


def canonical(value) -> str:
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return number(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"


def record_hash(value: dict) -> str:
    """``sha256:`` of the canonical text without the member ``record_hash``."""
    text = canonical({k: v for k, v in value.items() if k != "record_hash"})
    return "sha256:" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
