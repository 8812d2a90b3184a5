"""Message templates of log statements compiled to patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for a logged value in a template, by language.
PLACEHOLDERS = {
    "Rust": r"\{(?:([a-zA-Z_][a-zA-Z0-9_.]*)|(\d+))?\s*(?::[^}]*)?}",
    "Java": r"\{[^}]*}|\\\{([^}]*)}",
    "C++": r"%[-+ #0]*(?:\d+|\*)?(?:\.(?:\d+|\*))?[hlLzjt]*[diuoxXfFeEgGaAcspn%]|\{(?:([a-zA-Z_][a-zA-Z0-9_.]*)|(\d+))?\s*(?::[^}]*)?}",
    "Python": r"%[-+ #0]*(?:\d+|\*)?(?:\.(?:\d+|\*))?[hlLzjt]*[diuoxXfFeEgGaAcrspn%]",
}
# Words that name a logger or a level rather than a logged value, by language.
LOG_WORDS = {
    "Rust": {"debug", "info", "warn"},
    "Java": {"logger", "log", "fine", "debug", "info", "warn", "trace"},
    "C++": {"debug", "info", "warn", "trace"},
    "Python": {"debug", "info", "warn", "trace"},
}

_META = set(".*+?^${}()|[]")
#: Literal text as a pattern that is valid for sure, since what it escapes stands for itself.
_VALID = re.compile(r"(?:[^\\]|\\[.*+?^${}()|\[\]nrt\"'])*")
_WHITE = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
UNKNOWN = "<unknown>"


@dataclass(frozen=True)
class Arg:
    """What a placeholder names: kind is Named, Positional or Placeholder."""

    kind: str
    name: str | None = None
    pos: int | None = None


@dataclass(frozen=True)
class Template:
    """A compiled template. `pattern` is shown to users; `executable` is what Spark and RE2 run."""

    pattern: str
    executable: str
    quality: int
    args: tuple[Arg, ...]
    prefix: str


def escape(text: str, raw: bool = False) -> str:
    """A template's literal text as a pattern.

    Escapes of the source language that are regex escapes too pass through, unless the literal is raw; octal ones
    become hexadecimal, named characters match any word character, and white space is written as escapes.
    """
    out = []
    at = 0
    while at < len(text):
        c = text[at]
        if c in _META:
            out.append("\\" + c)
        elif c in _WHITE:
            out.append(_WHITE[c])
        elif c == "\\" and raw:
            out.append("\\\\")
        elif c == "\\" and (octal := re.match(r"\\([0-7]{3}|0)", text[at:])):
            out.append(f"\\x{int(octal[1], 8) & 0xFF:02X}")
            at += octal.end()
            continue
        elif c == "\\" and (named := re.match(r"\\N\{[^}]+}", text[at:])):
            out.append("\\w")
            at += named.end()
            continue
        else:
            out.append(c)
        at += 1
    return "".join(out)


def _arg(m: re.Match, language: str) -> Arg:
    if m.re.groups >= 1 and m[1] is not None:
        return Arg("Named", m[1])
    if m.re.groups >= 2 and m[2] is not None:
        return Arg("Positional", pos=int(m[2]))
    return Arg("Placeholder")


def compile_template(text: str, language: str, raw: bool = False, args: tuple[Arg, ...] | None = None) -> Template | None:
    """The template of a literal, None if it has no text of its own or no regex can be made of it.

    Quality counts the characters of the escaped literal text but white space. `args` replaces the placeholders'
    own names, as for interpolated strings.
    """
    parts: list[str] = []
    found: list[Arg] = []
    at = 0
    for m in re.finditer(PLACEHOLDERS[language], text):
        parts.append(escape(text[at : m.start()], raw))
        found.append(_arg(m, language))
        at = m.end()
    parts.append(escape(text[at:], raw))
    quality = sum(not c.isspace() for p in parts for c in p)
    if not quality:
        return None
    body = "(.+)".join(parts)
    if not all(map(_VALID.fullmatch, parts)):
        try:
            re.compile(body)
        except re.error:
            return None
    literal = re.match(r"[^\\(]*", parts[0])[0] if parts[0] else ""
    return Template(f"(?s)^{body}$", f"(?s)\\A{body}\\z", quality, args or tuple(found), literal)


def expressions(args: tuple[Arg, ...], names: list[str]) -> list[str]:
    """The source expression of each value: by name, by position, or the next unnamed one; <unknown> if there is none."""
    out, following = [], iter(names)
    for a in args:
        if a.kind == "Named":
            out.append(a.name or UNKNOWN)
        elif a.kind == "Positional":
            out.append(names[a.pos] if a.pos < len(names) else UNKNOWN)
        else:
            out.append(next(following, UNKNOWN))
    return out


#: Placeholders that name what they stand for: groups of a name and of a position in the patterns.
_NAMES, _POSITIONS = ("Rust", "C++", "Java"), ("Rust", "C++")


def _by_language(language: Column, made) -> Column:
    out = F.lit(None)
    for k in PLACEHOLDERS:
        out = F.when(language == k, made(k)).otherwise(out)
    return out


def arg_count(text: Column, language: Column) -> Column:
    """How many values a template logs."""
    return _by_language(language, lambda k: F.regexp_count(text, F.lit(PLACEHOLDERS[k])))


def arg_kinds(text: Column, language: Column) -> Column:
    """array<struct<kind, name, pos>> of a template's placeholders, as `Arg` has them."""

    def of(k: str) -> Column:
        group = lambda g: F.regexp_extract_all(text, F.lit(PLACEHOLDERS[k]), F.lit(g))
        names = group(1) if k in _NAMES else F.transform(group(0), lambda x: F.lit(""))
        places = group(2) if k in _POSITIONS else F.transform(group(0), lambda x: F.lit(""))
        kind = lambda n, p: F.when(n != "", "Named").when(p != "", "Positional").otherwise("Placeholder")
        return F.zip_with(names, places, lambda n, p: F.struct(kind(n, p).alias("kind"), F.nullif(n, F.lit("")).alias("name"), p.try_cast("int").alias("pos")))

    return _by_language(language, of)


def quality(text: Column, language: Column) -> Column:
    """The characters of a template's escaped literal text but white space, for literals that aren't raw."""
    rest = _by_language(language, lambda k: F.regexp_replace(text, PLACEHOLDERS[k], ""))
    for pattern, chars in ((r"\\(?:[0-7]{3}|0)", 4), (r"\\N\{[^}]+}", 2), (r"[.*+?^${}()|\[\]\n\r\t]", 2)):
        rest = F.regexp_replace(rest, pattern, "x" * chars)
    return F.length(F.regexp_replace(rest, r"(?U)\s", ""))
