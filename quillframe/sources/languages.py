"""Which comments may carry a header in a file, by its extension or its interpreter line."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Language:
    name: str
    line: tuple[str, ...] = ()  # line-comment markers; the first is used for new headers
    block: tuple[tuple[str, str], ...] = ()  # block comments, opening and closing
    plain: bool = False  # a bare header on the first line


# Extensions and comment marks of each language.
C_BLOCK = (("/*", "*/"),)
TABLE: tuple[tuple[Language, str], ...] = (
    (Language("markdown", plain=True), ".md .markdown"),
    (Language("python", ("#",), (('"""', '"""'), ("'''", "'''"))), ".py .pyi"),
    (Language("shell", ("#",)), ".sh .bash .zsh .fish"),
    (Language("ruby", ("#",), (("=begin", "=end"),)), ".rb"),
    (Language("perl", ("#",)), ".pl .pm"),
    (Language("r", ("#",)), ".r"),
    (Language("config", ("#",)), ".yml .yaml .toml"),
    (Language("powershell", ("#",), (("<#", "#>"),)), ".ps1"),
    (Language("c", ("//",), C_BLOCK), ".c .h .cpp .hpp .cs .java .kt .go .rs .swift .scala .dart .js .mjs .cjs .jsx .ts .tsx .scss .less"),
    (Language("php", ("//", "#"), C_BLOCK), ".php"),
    (Language("css", (), C_BLOCK), ".css"),
    (Language("sql", ("--",), C_BLOCK), ".sql"),
    (Language("lua", ("--",), (("--[[", "]]"),)), ".lua"),
    (Language("haskell", ("--",), (("{-", "-}"),)), ".hs"),
    (Language("html", (), (("<!--", "-->"),)), ".html .htm .xml .svg"),
    (Language("tex", ("%",)), ".tex"),
    (Language("lisp", (";",)), ".el .lisp .clj"),
    (Language("ini", (";", "#")), ".ini"),
    (Language("vim", ('"',)), ".vim"),
)
INTERPRETERS = {
    "python": "python", "bash": "shell", "sh": "shell", "zsh": "shell", "fish": "shell", "dash": "shell", "ksh": "shell", "ruby": "ruby",
    "perl": "perl", "Rscript": "r", "node": "c", "deno": "c", "bun": "c", "lua": "lua", "php": "php",
}
# Fixed values end.

BY_NAME = {language.name: language for language, _ in TABLE}
BY_EXTENSION = {e: language for language, extensions in TABLE for e in extensions.split()}
EXTENSIONS = frozenset(BY_EXTENSION)


def extension(path: str) -> str:
    """The part of the last name from its last dot on, which may be all of it."""
    name = os.path.basename(path)
    return name[name.rindex(".") :].lower() if "." in name else ""


def language_of(path: str, content: str) -> Language:
    suffix = extension(path)
    if suffix in BY_EXTENSION:
        return BY_EXTENSION[suffix]
    name = "" if suffix else interpreter(content)
    return BY_NAME[INTERPRETERS.get(re.sub(r"[0-9.]+$", "", name), "markdown")]


def interpreter(content: str) -> str:
    """The program of a first line such as "#!/usr/bin/env -S name"."""
    first = content.split("\n", 1)[0].rstrip("\r")
    words = first[2:].split() if first.startswith("#!") else []
    if words and os.path.basename(words[0]) == "env":
        words = [w for w in words[1:] if not w.startswith("-")]
    return os.path.basename(words[0]) if words else ""


class SyntaxChoiceError(ValueError):
    """Options that name no comment syntax, or two."""


def chosen(lang: str = "", line_comment: str = "", block_open: str = "", block_close: str = "") -> Language | None:
    """One language for all files, from reader options; None where no option is given."""
    custom = line_comment or block_open or block_close
    if lang and custom:
        raise SyntaxChoiceError("--lang cannot be combined with --line-comment, --block-open or --block-close")
    if lang:
        found = BY_NAME.get(lang.lower()) or BY_EXTENSION.get("." + lang.lower().removeprefix("."))
        if not found:
            raise SyntaxChoiceError(f"unknown language {lang!r}: must be an extension or one of {', '.join(sorted(BY_NAME))}")
        return found
    if block_close and not block_open:
        raise SyntaxChoiceError("--block-close requires --block-open")
    if not custom:
        return None
    return Language("custom", (line_comment,) if line_comment else (), ((block_open, block_close or block_open),) if block_open else ())
