"""Log statements of a source file, by a token scan for Rust, Java and C++ and by the syntax tree for Python."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator
from dataclasses import dataclass, field

from logweave.functions.templates import LOG_WORDS, Arg, compile_template, expressions

_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>\"\"\".*?(?:\"\"\"|\Z)|b?r(?P<hash>\#*)\".*?\"(?P=hash)|(?:u8|u|U|L)?R\"(?P<delim>[^()\\\s]{0,16})\(.*?\)(?P=delim)\"|(?:u8|u|U|L|b|c)?\"(?:[^\"\\]|\\.)*\")
    |(?P<char>'(?:[^'\\\n]|\\[^\n]+?)')
    |(?P<word>[A-Za-z_$][A-Za-z0-9_$]*)
    |(?P<mark>::|->|=>|[^\sA-Za-z_$])""",
    re.S | re.X,
)
_CONTROL = {"if", "for", "while", "switch", "catch", "synchronized", "try", "else", "do", "return", "match", "loop", "unsafe"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Statement:
    """A log statement of one file; offsets are characters until they become lines and byte columns."""

    start: int
    end: int
    text: str
    name: str
    vars: list[str] = field(default_factory=list)
    raw: bool = False
    inner: str = ""
    args: tuple[Arg, ...] | None = None


def _tokens(code: str) -> list[Token]:
    return [Token(m.lastgroup if m.lastgroup not in ("hash", "delim") else "string", m[0], m.start(), m.end()) for m in _TOKEN.finditer(code) if not m["comment"]]


def _pairs(tokens: list[Token]) -> dict[int, int]:
    """For each opening bracket the position of its closing one."""
    found, stack = {}, []
    for i, t in enumerate(tokens):
        if t.kind == "mark" and t.text in _OPEN:
            stack.append(i)
        elif t.kind == "mark" and t.text in _CLOSE and stack:
            found[stack.pop()] = i
    return found


def _scopes(tokens: list[Token], pairs: dict[int, int], code: str, language: str) -> list[tuple[int, int, str]]:
    """(first, last, name) of the bodies of functions, methods and, for Java, classes."""
    closing = {v: k for k, v in pairs.items()}
    out = []
    for i, end in pairs.items():
        if tokens[i].text != "{":
            continue
        at, head = i - 1, []
        while at >= 0 and tokens[at].text not in (";", "{", "}"):
            if at in closing:
                head.append(at)
                at = closing[at]
            head.append(at)
            at -= 1
        words = [tokens[k].text for k in reversed(head)]
        places = list(reversed(head))
        if language == "Rust":
            if "fn" in words and words.index("fn") + 1 < len(words):
                out.append((i, end, words[words.index("fn") + 1]))
            continue
        kinds = [k for k in ("class", "interface", "enum", "record", "struct", "union", "namespace") if k in words]
        open_at = next((k for k in places if tokens[k].text == "(" and k in pairs and k > 0 and tokens[k - 1].kind == "word"), None)
        if open_at is None:
            if language == "Java" and "class" in kinds and words.index("class") + 1 < len(words):
                out.append((i, end, words[words.index("class") + 1]))
            continue
        called = tokens[open_at - 1].text
        first = open_at - 1
        if called in _CONTROL or "->" in words or "=" in words or (first > 0 and tokens[first - 1].text == "new"):
            continue
        if language == "Java":
            out.append((i, end, called))
        else:
            while first >= 2 and tokens[first - 1].text in ("::", "~"):
                first -= 1 if tokens[first - 1].text == "~" else 2
            out.append((i, end, code[tokens[first].start : tokens[pairs[open_at]].end]))
    return out


def _values(tokens: list[Token], pairs: dict[int, int], code: str, literal: int, close: int, language: str) -> tuple[list[str], int]:
    """The arguments after a literal as they are written, and where the last one ends.

    An argument whose text, white space included, is a word of the logger's own is left out.
    """
    out, last = [], tokens[literal].end
    at, begun = literal + 1, None
    while at <= close:
        if tokens[at].text == "," or at == close:
            if begun is not None:
                text = code[begun : tokens[at].start]
                if text and text.lower() not in LOG_WORDS[language]:
                    out.append(text.strip())
                    last = begun + len(text.rstrip()) if text.strip() else last
            begun = tokens[at].end
        at = pairs.get(at, at) + 1
    return out, last


def _literal(text: str, language: str) -> tuple[str, bool]:
    """The characters between a literal's quotes and whether escapes mean themselves. Prefixes and long quotes are taken off whole."""
    raw = re.match(r"(?:b?r|(?:u8|u|U|L)?R)(?=[#\"])", text)
    if raw and language == "C++":
        return re.sub(r"^[^(]*\(|\)[^)]*\Z", "", text), True
    if raw:
        return text[text.index('"') + 1 : text.rindex('"')], True
    body = text[text.index('"') :]
    long = 3 if body.startswith('"""') and len(body) >= 6 else 1
    return body[long:-long], False


def _by_tokens(code: str, language: str) -> Iterator[Statement]:
    tokens = _tokens(code)
    pairs = _pairs(tokens)
    scopes = _scopes(tokens, pairs, code, language)

    def statement(literal: int, close: int) -> Statement:
        around = [s for s in scopes if s[0] < literal < s[1]]
        name = max(around)[2] if around else code
        values, end = _values(tokens, pairs, code, literal, close, language)
        inner, raw = _literal(tokens[literal].text, language)
        return Statement(tokens[literal].start, end, tokens[literal].text, name, values, raw, inner)

    def alone(k: int, close: int) -> bool:
        """Whether a string is an argument by itself."""
        return tokens[k].kind == "string" and (k + 1 == close or tokens[k + 1].text == ",")

    for i, close in sorted(pairs.items()):
        if tokens[i].text not in ("(", "[", "{") or i + 1 >= close:
            continue
        if language == "Rust":
            if i >= 2 and tokens[i - 1].text == "!" and tokens[i - 2].kind == "word" and tokens[i + 1].kind == "string":
                plain = i < 3 or tokens[i - 3].text != "::"
                if not (plain and tokens[i - 2].text in ("format", "vec")):
                    yield statement(i + 1, close)
        elif language == "Java" and tokens[i].text == "(":
            if i < 3 or tokens[i - 2].text != "." or tokens[i - 1].kind != "word" or tokens[i - 3].kind != "word" or (i >= 4 and tokens[i - 4].text == "."):
                continue
            if not re.search(r"log(ger)?|LOG(GER)?", tokens[i - 3].text) or not re.search("fine|debug|info|warn|trace|error", tokens[i - 1].text):
                continue
            if alone(i + 1, close):
                yield statement(i + 1, close)
                continue
            at = i + 1
            while at < close:
                if tokens[at].kind == "string" and at >= 2 and tokens[at - 1].text == "." and tokens[at - 2].text == "STR":
                    yield statement(at, close)
                at = pairs.get(at, at) + 1
        elif language == "C++" and tokens[i].text == "(" and close + 1 < len(tokens) and tokens[close + 1].text == ";":
            first = i - 1
            while first > 0 and (tokens[first].kind == "word" or tokens[first].text in ("::", ".", "->")) and tokens[first - 1].text not in ("{", "}", ";"):
                first -= 1
            called = code[tokens[first].start : tokens[i].start]
            if first < 1 or tokens[first - 1].text not in ("{", "}", ";") or tokens[i - 1].kind != "word" or re.match(r"return\b", called) or re.search("snprintf|sprintf", called):
                continue
            at = i + 1
            while at < close:
                if alone(at, close) and tokens[at - 1].text in ("(", ","):
                    yield statement(at, close)
                at = pairs.get(at, at) + 1


def _by_tree(code: str) -> Iterator[Statement]:
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return
    lines = code.splitlines(keepends=True)
    begins = [0]
    for line in lines:
        begins.append(begins[-1] + len(line))

    def offset(row: int, col: int) -> int:
        return begins[row - 1] + len(lines[row - 1].encode()[:col].decode())

    def walk(node: ast.AST, name: str) -> Iterator[Statement]:
        for child in ast.iter_child_nodes(node):
            inner = child.name if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef) else name
            if isinstance(child, ast.Expr) and isinstance(child.value, ast.Call) and child.value.args:
                found = literal(child.value, inner)
                if found:
                    yield found
            yield from walk(child, inner)

    def literal(call: ast.Call, name: str) -> Statement | None:
        first = call.args[0]
        if not (isinstance(first, ast.JoinedStr) or (isinstance(first, ast.Constant) and isinstance(first.value, str))):
            return None
        start, end = offset(first.lineno, first.col_offset), offset(first.end_lineno, first.end_col_offset)
        text = code[start:end]
        prefix = re.match(r"[A-Za-z]*", text)[0]
        quote = text[len(prefix) : len(prefix) + 3]
        quote = quote if quote in ('"""', "'''") else quote[:1]
        # Strings written side by side are no single literal.
        kinds = [t.type for t in tokenize.generate_tokens(io.StringIO(f"({text})").readline)]
        if kinds.count(tokenize.STRING) + kinds.count(getattr(tokenize, "FSTRING_START", -1)) - _nested(first) != 1:
            return None
        inner = text[len(prefix) + len(quote) : -len(quote)]
        args = None
        if isinstance(first, ast.JoinedStr):
            parts = [v for v in first.values if isinstance(v, ast.FormattedValue)]
            spans = [_braces(code, offset(v.value.lineno, v.value.col_offset), offset(v.value.end_lineno, v.value.end_col_offset)) for v in parts]
            names, out, at = [], [], start + len(prefix) + len(quote)
            for v, (low, high) in zip(parts, spans, strict=True):
                out.append(code[at:low])
                names.append(Arg("Named", code[offset(v.value.lineno, v.value.col_offset) : offset(v.value.end_lineno, v.value.end_col_offset)]))
                at = high
            inner = "%s".join([*out, code[at : end - len(quote)]])
            args = tuple(names) or None
        rest = [*call.args[1:], *call.keywords]
        values, last = [], end
        for a in rest:
            low, last = offset(a.lineno, a.col_offset), offset(a.end_lineno, a.end_col_offset)
            values.append(code[low:last])
        return Statement(start, last, text, name, values, "r" in prefix.lower(), inner, args)

    yield from walk(tree, code)


def _nested(node: ast.AST) -> int:
    """Strings inside the interpolations of a literal."""
    if not isinstance(node, ast.JoinedStr):
        return 0
    return sum(isinstance(n, ast.JoinedStr) or (isinstance(n, ast.Constant) and isinstance(n.value, str)) for v in node.values if isinstance(v, ast.FormattedValue) for n in ast.walk(v.value))


def _braces(code: str, low: int, high: int) -> tuple[int, int]:
    """The interpolation around an expression, from its opening to its closing brace."""
    start = code.rindex("{", 0, low)
    depth, at = 1, high
    while depth:
        depth += {"{": 1, "}": -1}.get(code[at], 0)
        at += 1
    return start, at


def statements(code: str, language: str) -> list[dict]:
    """The statements of one file in order, as rows without path and root."""
    found = sorted(_by_tree(code) if language == "Python" else _by_tokens(code, language), key=lambda s: s.start)
    rows = []
    for s in found:
        template = compile_template(s.inner, language, s.raw, s.args)
        begin = code.rfind("\n", 0, s.start) + 1
        if template is None:
            continue
        rows.append(
            {
                "stmt_idx": len(rows), "line_no": code.count("\n", 0, s.start) + 1, "end_line_no": code.count("\n", 0, s.end) + 1,
                "column": len(code[begin : s.start].encode()), "name": s.name, "text": s.text, "quality": template.quality,
                "pattern": template.pattern, "executable": template.executable, "prefix": template.prefix,
                "args": [(a.kind, a.name, a.pos) for a in template.args], "vars": s.vars, "exprs": expressions(template.args, s.vars),
            }
        )
    return rows
