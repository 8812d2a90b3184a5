"""Rules on source paths as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension, and names of folders that hold no sources.
LANGUAGES = {"rs": "Rust", "java": "Java", "h": "C++", "hh": "C++", "hpp": "C++", "hxx": "C++", "tpp": "C++", "cc": "C++", "cpp": "C++", "cxx": "C++", "py": "Python"}
VCS_NAMES = (".git", ".hg", ".svn", ".vscode")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)


def language(path: Column) -> Column:
    """The language of a path by its extension, null if none is known; letters count as they stand."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return table[extension(path)]


def file_name(path: Column) -> Column:
    """The last component of a path, null if it has no separator."""
    return F.nullif(F.regexp_extract(path, r"[/\\]([^/\\]+)$", 1), F.lit(""))


def is_vcs(path: Column) -> Column:
    """Whether a component of the path names a folder of a version control system or editor."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VCS_NAMES)))


def covered_by(path: Column, root: str) -> Column:
    """Whether the path is the root or lies below it, component by component."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def kind(path: Column, is_dir: Column, readable: Column, is_file: Column | None = None) -> Column:
    """Error, Directory, Unknown (as a link, which is neither file nor folder), File or UnsupportedFile."""
    found = F.when(~readable, "Error").when(is_dir, "Directory")
    found = found if is_file is None else found.when(~is_file, "Unknown")
    return found.when(language(path).isNotNull(), "File").otherwise("UnsupportedFile")


def _ignore_pattern(rule: str) -> str | None:
    """A glob rule as a pattern: * ? [...] within a component, ** over components, a backslash before a character as it is."""
    out, at = [], 0
    while at < len(rule):
        c = rule[at]
        if rule.startswith("**/", at) and (at == 0 or rule[at - 1] == "/"):
            out.append("(?:.*/)?")
            at += 3
            continue
        if rule.startswith("**", at):
            out.append(".*")
            at += 2
            continue
        if c == "[":
            shut = rule.find("]", at + 2 + (rule[at + 1 : at + 2] in ("!", "^")))
            if shut < 0:
                return None
            inner = rule[at + 1 : shut]
            mark = "^" if inner[0] in "!^" else ""
            inner = "".join("\\" + x if x in "\\[]&^~" else x for x in (inner[1:] if mark else inner))
            out.append(f"[{mark}{inner}{'/' if mark else ''}]")
            at = shut
        elif c == "\\":
            at += 1
            if at == len(rule):
                return None
            out.append(re.escape(rule[at]))
        else:
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
        at += 1
    try:
        re.compile("".join(out))
    except re.error:
        return None
    return "".join(out)


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """Rules of an ignore file as (ignored, pattern over relative paths), in order; lines that make no rule are left out."""
    rules = []
    for line in text.splitlines():
        while line.endswith((" ", "\t", "\r")) and not line.endswith("\\ "):
            line = line[:-1]
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        only_dir, line = line.endswith("/"), line.removesuffix("/")
        anchored, line = "/" in line, line.removeprefix("/")
        pattern = _ignore_pattern(line)
        if line and pattern is not None:
            rules.append((not negated, f"{'' if anchored else '(?:.*/)?'}{pattern}{'/' if only_dir else '/?'}"))
    return rules


def is_ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether the last rule that matches the path itself ignores it; else the path goes with its nearest parent that any rule matches.

    Folders are told by a final slash.
    """
    if not rules:
        return F.lit(False)
    def decision(part: Column) -> Column:
        found = F.lit(None).cast("boolean")
        for ignored, pattern in rules:
            found = F.when(part.rlike(rf"\A{pattern}\z"), F.lit(ignored)).otherwise(found)
        return found

    names = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "/$", ""), "/")
    # The path itself, then its parents upwards, each as a folder.
    parents = F.transform(F.sequence(F.size(names) - 1, F.lit(0), F.lit(-1)), lambda k: F.concat(F.array_join(F.slice(names, F.lit(1), k), "/"), F.lit("/")))
    parents = F.filter(parents, lambda p: p != "/")
    above = F.aggregate(parents, F.lit(None).cast("boolean"), lambda found, p: F.coalesce(found, decision(p)))
    own = F.regexp_replace(path, "^/", "")
    return F.coalesce(decision(own), above, F.lit(False))


def find_suffix(path: Column, wanted: Column) -> Column:
    """Whether the path ends with the wanted relative path at a component boundary."""
    return (path == wanted) | path.endswith(F.concat(F.lit("/"), wanted))


def holds_in_order(have: Column, wanted: Column) -> Column:
    """Whether a path's components `have` end with the last one of `wanted` and hold the others before it, in order."""
    last = F.size(wanted) - 1
    met = F.aggregate(F.slice(have, F.lit(1), F.size(have) - 1), F.lit(0), lambda k, c: F.when((k < last) & (F.get(wanted, k) == c), k + 1).otherwise(k))
    return (met == last) & (F.element_at(have, -1) == F.element_at(wanted, -1))


def in_order(wanted: list[str], have: list[str]) -> bool:
    """holds_in_order for lists of components."""
    above = iter(have[:-1])
    return have[-1:] == wanted[-1:] and all(x in above for x in wanted[:-1])
