"""Conversions between texts and single values, with the dialect's rules."""

from __future__ import annotations

import math
import re
from datetime import datetime

INT = re.compile(r"[+-]?(?:0[xX](?:_?[0-9A-Fa-f])+|0[bB](?:_?[01])+|0[oO]?(?:_?[0-7])+|0|[1-9](?:_?[0-9])*)\Z")
FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")
HEX_FLOAT = re.compile(r"[+-]?0[xX](?:_?[0-9A-Fa-f])+\.?(?:[0-9A-Fa-f]*)[pP][+-]?[0-9]+\Z")
NAMED_FLOAT = re.compile(r"([+-]?)(inf|infinity)\Z|nan\Z", re.I)
DATE = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})\Z")
DATETIME = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{1,2}):([0-9]{2}):([0-9]{2})(?:[.,]([0-9]+))?\Z")


def wrap(n: int) -> int:
    """n as a 64-bit integer that wraps around."""
    return (n + 2**63) % 2**64 - 2**63


def parse_int(text: str) -> int | None:
    """An integer with the prefix of its base: none, 0x, 0o or 0, 0b."""
    if not INT.match(text):
        return None
    sign = -1 if text[0] == "-" else 1
    digits = text.lstrip("+-").replace("_", "").lower()
    base = {"0x": 16, "0b": 2, "0o": 8}.get(digits[:2])
    n = sign * (int(digits[2:], base) if base else int(digits, 8 if digits[0] == "0" else 10))
    return n if -(2**63) <= n < 2**63 else None


def parse_float(text: str) -> float | None:
    if FLOAT.match(text):
        x = float(text)
        return x if math.isfinite(x) else None
    if m := NAMED_FLOAT.match(text):
        return math.nan if m[2] is None else float(m[1] + "inf")
    if HEX_FLOAT.match(text):
        try:
            return float.fromhex(text.replace("_", ""))
        except OverflowError:
            return None
    return None


def parse_date(text: str) -> datetime | None:
    return _moment(DATE.match(text))


def parse_datetime(text: str) -> datetime | None:
    return _moment(DATETIME.match(text))


def _moment(m: re.Match | None) -> datetime | None:
    if not m:
        return None
    *parts, fraction = (*m.groups(), None) if m.re is DATE else m.groups()
    try:
        return datetime(*map(int, parts), microsecond=int((fraction or "0")[:6].ljust(6, "0")))
    except ValueError:
        return None


def format_float(x: float) -> str:
    """Shortest digits that give x back; exponents below -4 and from 6 on are written as such."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    mantissa, exponent = _scientific(x)
    if -4 <= exponent < 6:
        return ("-" if x < 0 else "") + _positional(mantissa, exponent)
    digits = mantissa[0] + ("." + mantissa[1:] if len(mantissa) > 1 else "")
    return f"{'-' if x < 0 else ''}{digits}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"


def _scientific(x: float) -> tuple[str, int]:
    """Shortest digits of |x| and the decimal exponent of the first one."""
    text = repr(abs(x))
    base, _, power = text.partition("e")
    whole, _, part = base.partition(".")
    digits = (whole + part).lstrip("0")
    exponent = int(power or 0) + (len(whole) - 1 if whole.strip("0") else -(len(part) - len(part.lstrip("0")) + 1))
    return digits.rstrip("0") or "0", exponent


def _positional(digits: str, exponent: int) -> str:
    if exponent < 0:
        return "0." + "0" * (-exponent - 1) + digits
    if len(digits) <= exponent + 1:
        return digits + "0" * (exponent + 1 - len(digits))
    return digits[: exponent + 1] + "." + digits[exponent + 1 :]


def wiki_link(text: str) -> tuple[str, str] | None:
    """(reference, title) of [[reference]] or [[reference|title]]."""
    if not (text.startswith("[[") and text.endswith("]]") and len(text) >= 5):
        return None
    reference, _, title = text[2:-2].partition("|")
    return reference, title


def markdown_link(text: str) -> tuple[str, str] | None:
    """(reference, title) of [title](reference)."""
    middle = text.find("](")
    if not (text.startswith("[") and text.endswith(")") and middle > 0):
        return None
    return text[middle + 2 : -1], text[1:middle]
