"""Regular expressions of the dialect (linear-time syntax, no look-around or back-references) for Java and for Python."""

from __future__ import annotations

import re
from collections.abc import Callable

#: POSIX class names inside brackets, as ranges.
CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
GROUP = re.compile(r"\(\?(?:P?<([A-Za-z_]\w*)>|([imsU]*(?:-[imsU]+)?)([:)]))")


class Memo:
    """A function that remembers its results, within bounds. What it remembers stays behind when it is sent to a task."""

    LIMIT = 1024

    def __init__(self, f: Callable):
        self.f, self.known = f, {}

    def __getstate__(self):
        return {"f": self.f, "known": {}}

    def __call__(self, *args):
        if args not in self.known:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            self.known[args] = self.f(*args)
        return self.known[args]


@Memo
def translate(pattern: str) -> tuple[str, str, int] | None:
    """(Java pattern, Python pattern, capture groups), or None where the dialect has no such pattern."""
    java, python, groups, at, n = [], [], 0, 0, len(pattern)
    multiline = False

    def both(j: str, p: str | None = None) -> None:
        java.append(j)
        python.append(j if p is None else p)

    while at < n:
        c = pattern[at]
        if c == "\\":
            e = pattern[at + 1 : at + 2]
            if not e or e in "123456789Zkg" or e in "<>GXRhHvVuU":
                return None
            if e == "z":
                both(r"\z", r"\Z")
            elif e == "Q":
                end = pattern.find(r"\E", at + 2)
                text = pattern[at + 2 :] if end < 0 else pattern[at + 2 : end]
                both("".join(_quote(x) for x in text))
                at = n if end < 0 else end + 2
                continue
            elif e in "pP":
                m = re.compile(r"\{\^?\w+\}|\w").match(pattern, at + 2)
                if not m:
                    return None
                # Python's own expressions have no such classes; letters and digits stand in for the common ones.
                name = m[0].strip("{}")
                stand_in = {"L": r"[^\W\d_]", "N": r"\d", "Nd": r"\d", "Lu": "[A-ZÀ-ÖØ-Þ]", "Ll": "[a-zß-öø-ÿ]"}.get(name)
                if stand_in is None or e == "P":
                    return None
                java.append(pattern[at : m.end()])
                python.append(stand_in)
                at = m.end()
                continue
            elif e == "C":
                return None
            else:
                both("\\" + e)
            at += 2
            continue
        if c == "[":
            end = _class_end(pattern, at)
            if end is None:
                return None
            body = pattern[at + 1 : end - 1]
            negated = body.startswith("^")
            body = body[negated:]
            body = re.sub(r"\[:(\w+):\]", lambda m: CLASSES.get(m[1], "\0"), body)
            if "\0" in body:
                return None
            # An opening bracket or '&&' would mean more to Java inside a class.
            body = re.sub(r"(\\.)|\[", lambda m: m[1] or r"\[", body).replace("&&", r"&\&")
            if body.startswith("]"):
                body = r"\]" + body[1:]
            both(f"[{'^' if negated else ''}{body}]")
            at = end
            continue
        if c == "(" and pattern.startswith("(?", at):
            m = GROUP.match(pattern, at)
            if not m:
                return None
            if m[1]:
                groups += 1
                both("(")
            else:
                flags = m[2] or ""
                if "U" in flags:
                    return None
                multiline = multiline or "m" in flags.split("-")[0]
                if m[3] == ")" and at != 0:
                    # A flag for the rest of its group: Python knows flags at the start or on a group only.
                    return None
                java.append("(?" + flags.replace("i", "iu") + m[3])
                python.append(f"(?{flags}{m[3]}" if flags or m[3] == ":" else "")
            at = m.end()
            continue
        if c == "(":
            groups += 1
        if c == "$" and not multiline:
            both(r"\z", r"\Z")
        elif c in "*+?}" and at + 1 < n and pattern[at + 1] == "+" :
            return None
        else:
            both(c)
        at += 1
    try:
        re.compile("".join(python), re.ASCII if "i" not in pattern[:6] else 0)
    except (re.error, OverflowError):
        return None
    return "(?d)" + "".join(java), "".join(python), groups


def _quote(c: str) -> str:
    return c if c.isalnum() or ord(c) > 127 else "\\" + c


def _class_end(pattern: str, at: int) -> int | None:
    i = at + 1
    if pattern.startswith("^", i):
        i += 1
    if pattern.startswith("]", i):
        i += 1
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 2
        elif pattern.startswith("[:", i) and ":]" in pattern[i:]:
            i = pattern.index(":]", i) + 2
        elif pattern[i] == "]":
            return i + 1
        else:
            i += 1
    return None


@Memo
def compiled(pattern: str) -> re.Pattern | None:
    """pattern for Python, or None where it is not valid."""
    found = translate(pattern)
    if found is None:
        return None
    return re.compile(found[1], 0 if "(?i" in found[1] else re.ASCII)


@Memo
def like(pattern: str, ignore_case: bool) -> re.Pattern:
    """A LIKE pattern for Python: % and _ match anything but a line break, nothing escapes them."""
    return re.compile("".join({"%": ".*", "_": "."}.get(c) or re.escape(c) for c in pattern) + r"\Z", re.I if ignore_case else 0)


def like_java(pattern: str, ignore_case: bool) -> str:
    body = "".join({"%": ".*", "_": "."}.get(c) or _quote(c) for c in pattern)
    return ("(?idu)" if ignore_case else "(?d)") + r"\A" + body + r"\z"
