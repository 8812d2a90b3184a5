"""Highlighting of log lines: which classes of tokens a line has, and where each token lies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a token of each class looks like.
CLASSES = {
    "verbose": [r"\bTrace\b:", r"(?i)\[(?:verbose|verb|vrb|vb|v)\]", r"^[\s\d[:punct:]]*\bV\b"],
    "debug": [r"\b(?:DEBUG|Debug)\b", r"(?i)\bdebug:", r"(?i)\[(?:debug|dbug|dbg|de|d)\]", r"^[\s\d[:punct:]]*\bD\b"],
    "info": [r"\b(?:HINT|INFO|INFORMATION|Info|NOTICE|II)\b", r"(?i)\b(?:info|information):", r"(?i)\[(?:information|info|inf|in|i)\]", r"^[\s\d[:punct:]]*\bI\b"],
    "warning": [r"\b(?:WARNING|WARN|Warn|WW)\b", r"(?i)\bwarning:", r"(?i)\[(?:warning|warn|wrn|wn|w)\]", r"^[\s\d[:punct:]]*\bW\b"],
    "error": [r"\b(?:ALERT|CRITICAL|EMERGENCY|ERROR|FAILURE|FAIL|Fatal|FATAL|Error|EE)\b", r"(?i)\berror:", r"(?i)\[(?:error|eror|err|er|e|fatal|fatl|ftl|fa|f)\]", r"^[\s\d[:punct:]]*\bE\b"],
    "date": [r"\b\d{4}-\d{2}-\d{2}(?:T|\b)", r"(?:^|\s)\d{2}[^\w\s]\d{2}[^\w\s]\d{4}\b", r"\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d{1,})?)?(?:Z| ?[+-]\d{1,2}:\d{2})?\b"],
    "hash": [r"\b(?:[0-9a-fA-F]{40}|[0-9a-fA-F]{10}|[0-9a-fA-F]{7})\b"],
    "guid": [r"\b[0-9a-fA-F]{8}-?(?:[0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}\b", r"\b(?:[0-9a-fA-F]{2,}[:-])+[0-9a-fA-F]{2,}\b"],
    "constant": [r"\b(?:[0-9]+|true|false|null)\b", r"\b0x[a-fA-F0-9]+\b"],
    "string": [r"\"[^\"]*\"", r"(?:^|\W)'[^']*'"],
    "exception": [r"\b[a-zA-Z.]*Exception\b"],
    "frame": [r"^[\t ]*at[\t ]"],
    "address": [r"\b[a-z]+://\S+\b/?"],
    "name": [r"(?:^|[^\w/\\.-])(?:[\w-]+\.)+[\w-]+(?:$|[^\w/\\.-])"],
}


def pattern(name: str) -> str:
    """One pattern for a class, in the dialect that Spark and RE2 share."""
    return "|".join(f"(?:{p})" for p in CLASSES[name])


def classes(line: Column) -> Column:
    """The classes of tokens that a line has, in the order of CLASSES."""
    java = lambda name: pattern(name).replace("[:punct:]", r"\p{Punct}")
    found = F.array(*[F.when(line.rlike(java(name)), F.lit(name)) for name in CLASSES])
    return F.filter(found, lambda x: x.isNotNull())


#: Patterns that look around a token where those above take in what surrounds it; a mark letter follows no more than
#: 999 marks, for Java's patterns look back no further than they say. A frame is its whole line.
_AROUND = {
    **{rf"^[\s\d[:punct:]]*\b{x}\b": rf"(?<=^[\s\d\p{{Punct}}]{{0,999}})\b{x}\b" for x in "VDIWE"},
    CLASSES["date"][1]: r"(?<!\S)\d{2}[^\w\s]\d{2}[^\w\s]\d{4}\b",
    CLASSES["string"][1]: r"(?<!\w)'[^']*'",
    CLASSES["frame"][0]: r"^[\t ]*at[\t ].*$",
    CLASSES["name"][0]: r"(?<![\w/\\])(?:[\w-]+\.)+[\w-]+(?![\w/\\])",
}
#: End what is before a token, each class's share of it, and the token. A line's own such characters count as U+FFFF.
_GAP, _CLASS, _END = "\x01", "\x02", "\x03"


def spans(line: Column) -> Column:
    """array<struct<start, end, class>> of a line's tokens from left to right; start counts from 0, end is behind the token.

    At each place the first class that has a token there wins, and the next token is looked for behind it. One pattern
    with a group for each class finds all tokens in one pass; what it puts between them tells gaps and classes apart.
    """
    own = "|".join("(" + "|".join(f"(?:{_AROUND.get(p, p)})" for p in CLASSES[name]) + ")" for name in CLASSES)
    clean = F.translate(line, _GAP + _CLASS + _END, "\uffff" * 3)
    put = f"$1{_GAP}" + _CLASS.join(f"${k + 2}" for k in range(len(CLASSES))) + _END
    # Behind the last end there is what follows the last token.
    pieces = F.split(F.regexp_replace(clean, f"(?s)(.*?)(?:{own})", put), _END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    names = F.array(*map(F.lit, CLASSES))
    none = F.array().cast("array<struct<start:int,end:int,class:string>>")

    def add(done: Column, piece: Column) -> Column:
        gap, shares = F.substring_index(piece, _GAP, 1), F.split(F.substring_index(piece, _GAP, -1), _CLASS)
        start = F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0)) + F.char_length(gap)
        # Only one share isn't empty.
        named = F.get(names, F.array_position(F.transform(shares, lambda x: x != ""), True).cast("int") - 1)
        token = F.struct(start.alias("start"), (start + F.char_length(F.array_join(shares, ""))).alias("end"), named.alias("class"))
        return F.concat(done, F.array(token))

    return F.aggregate(pieces, none, add)


def level_class(level: Column) -> Column:
    """The highlighting class of a record's level."""
    return F.when(level.rlike("(?i)^(error|fatal|severe|err)$"), "error").when(level.rlike("(?i)^warn(ing)?$"), "warning").when(level.rlike("(?i)^(debug|fine|trace)$"), "debug").otherwise("info")
