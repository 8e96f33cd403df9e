"""Which files the words after FROM name."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterable

from .languages import EXTENSIONS, extension

MAGIC = re.compile(r"[*?\[]")


class SourceError(ValueError):
    """A word after FROM names nothing."""


def is_pattern(word: str) -> bool:
    return MAGIC.search(word) is not None


def regex(pattern: str) -> str:
    """A pattern as a regular expression for whole paths, for Java and Python alike: only "/" is out of its reach."""
    out = []
    for m in re.finditer(r"\*+|\?|\[([!^]?)(\]?[^\]]*)\]|.", pattern, re.S):
        if m[0][0] == "*":
            out.append("[^/]*")
        elif m[0] == "?":
            out.append("[^/]")
        elif m[2] is not None:
            body = re.sub(r"([\\\[\]&^])", r"\\\1", m[2])
            body = "\\" + body if body.startswith("-") else body
            out.append(f"[{'^/' if m[1] else ''}{body}]")
        else:
            out.append(m[0] if m[0].isalnum() or ord(m[0]) > 127 else "\\" + m[0])
    return r"\A" + "".join(out) + r"\z"


def expand(words: Iterable[str], include_hidden: bool = False, any_extension: bool = False, root: str = "") -> list[str]:
    """Paths in order: those of each pattern sorted, plain paths as they are given.

    A pattern whose last part has no dot finds only files of known kinds, and
    hidden files are found by their own name alone, unless asked for.
    """
    words = list(words)
    named = {w for w in words if not is_pattern(w)}
    found: list[str] = []
    for word in words:
        if not is_pattern(word):
            if not os.path.exists(os.path.join(root, word)):
                raise SourceError(f"no such file or pattern: {word}")
            found.append(word)
            continue
        # Only a whole-name "**" differs from "*" in glob; here it does not.
        for path in sorted(_matches(word, root)):
            if "." not in os.path.basename(word) and not any_extension and extension(path) not in EXTENSIONS:
                continue
            if os.path.isfile(os.path.join(root, path)) and (path in named or include_hidden or not os.path.basename(path).startswith(".")):
                found.append(path)
    return found


def _matches(pattern: str, root: str) -> list[str]:
    return glob.glob(pattern, root_dir=root or None, recursive=False, include_hidden=True)
