"""JavaScript and TypeScript functions, from a token stream with matched brackets."""

from __future__ import annotations

import re
from bisect import bisect_right

TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))"
    r"|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<word>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<number>\d[\w.]*)|(?P<arrow>=>)|(?P<dots>\.\.\.)|(?P<mark>.)",
    re.S,
)
CALL = re.compile(r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\(", re.A)
NO_CALL = {"if", "for", "while", "switch", "return"}
MODIFIERS = {"public", "private", "protected", "static", "async", "get", "set", "readonly", "override", "abstract", "declare", "accessor"}
PARAMETER = {"public", "private", "protected", "readonly", "override", "abstract", "declare", "static"}
NOT_METHODS = {"if", "for", "while", "switch", "catch", "with", "function", "return", "constructor_"}
CLOSES = {"(": ")", "[": "]", "{": "}"}
LEAST_SPAN = 2


class Token:
    __slots__ = ("kind", "text", "start", "end", "mate")

    def __init__(self, kind: str, text: str, start: int, end: int):
        self.kind, self.text, self.start, self.end, self.mate = kind, text, start, end, -1


def _template_end(text: str, at: int) -> int:
    """Past the template literal that starts at a back quote, with templates inside its holes."""
    i = at + 1
    while i < len(text):
        if text[i] == "\\":
            i += 2
        elif text[i] == "`":
            return i + 1
        elif text.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(text) and depth:
                if text[i] == "`":
                    i = _template_end(text, i)
                    continue
                depth += (text[i] == "{") - (text[i] == "}")
                i += 1
        else:
            i += 1
    return len(text)


def tokens(text: str) -> list[Token]:
    """Significant tokens; an opening bracket knows its closing one, or -1."""
    out: list[Token] = []
    opened: list[int] = []
    at = 0
    while at < len(text):
        if text[at] == "`":
            end = _template_end(text, at)
            out.append(Token("string", text[at:end], at, end))
            at = end
            continue
        m = TOKEN.match(text, at)
        at = m.end()
        if m.lastgroup in ("space", "line", "block"):
            continue
        token = Token(m.lastgroup, m[0], m.start(), m.end())
        if token.text in CLOSES:
            opened.append(len(out))
        elif token.text in (")", "]", "}"):
            for back in range(len(opened) - 1, -1, -1):
                if CLOSES[out[opened[back]].text] == token.text:
                    out[opened[back]].mate = len(out)
                    del opened[back:]
                    break
        out.append(token)
    return out


def split_parameters(text: str) -> list[str]:
    """Parts between top-level commas, without comments."""
    parts, depth, begin, kept = [], 0, 0, []
    at = 0
    while at < len(text):
        if text[at] == "`":
            end = _template_end(text, at)
        else:
            m = TOKEN.match(text, at)
            end = m.end()
            if m.lastgroup in ("line", "block"):
                at = end
                continue
            if m.lastgroup == "mark":
                depth += (m[0] in "([{<") - (m[0] in ")]}>")
                if m[0] == "," and depth <= 0:
                    parts.append("".join(kept))
                    kept, at = [], end
                    continue
        kept.append(text[at:end])
        at = end
    parts.append("".join(kept))
    return [p.strip() for p in parts if p.strip()]


def _top_level(text: str, wanted: str) -> int:
    depth = 0
    for m in TOKEN.finditer(text):
        if m.lastgroup == "mark":
            if m[0] == wanted and depth == 0 and text[m.end() : m.end() + 1] != "=":
                return m.start()
            depth += (m[0] in "([{<") - (m[0] in ")]}>")
    return -1


def parameter_types(text: str, typed: bool) -> list[str]:
    """Type of every parameter, or its name."""
    out = []
    for part in split_parameters(text):
        cut = _top_level(part, "=")
        part = (part[:cut] if cut >= 0 else part).strip().removeprefix("...").strip()
        while part.split(" ", 1)[0] in PARAMETER and " " in part:
            part = part.split(" ", 1)[1].strip()
        colon = _top_level(part, ":") if typed else -1
        kind = part[colon + 1 :].strip() if colon >= 0 else ""
        name = (part[:colon] if colon >= 0 else part).strip().rstrip("?").strip()
        if part:
            out.append(kind or name)
    return out


def imports(text: str) -> list[str]:
    """Sorted modules of one-line imports and of required constants."""
    found = set()
    for line in map(str.strip, text.split("\n")):
        if line.startswith("import "):
            quoted = re.findall(r"""(["'])([^"']*)\1""", line)
            if quoted and quoted[-1][1]:
                found.add(quoted[-1][1])
        elif line.startswith(("const ", "let ", "var ")):
            found.update(re.findall(r"""require\(["']([^"']+)["']\)""", line)[:1])
    return sorted(found, key=lambda x: x.encode())


def signature(code: str, name: str) -> str:
    """The first line that declares or points, up to its body; else the name with empty brackets."""
    for line in map(str.strip, code.split("\n")):
        if line and not line.startswith(("//", "/*")) and ("function " in line or "=>" in line):
            line = line.partition("{")[0].strip()
            head, arrow, _ = line.partition("=>")
            return (head + arrow).strip()
    return f"{name}()" if name else ""


def called(code: str) -> list[str]:
    return [n for n in dict.fromkeys(CALL.findall(code)) if n not in NO_CALL]


def doc_above(lines: list[str], row: int) -> str:
    """Text of the `//` run or `/** */` block that ends on the line above row (from 0)."""
    at = row - 1
    if at < 0:
        return ""
    last = lines[at].strip()
    if last.startswith("//"):
        run = []
        while at >= 0 and lines[at].strip().startswith("//"):
            run.append(lines[at].strip()[2:].strip())
            at -= 1
        return "\n".join(reversed(run)).strip()
    if not last.endswith("*/"):
        return ""
    block = []
    while at >= 0:
        block.append(lines[at].strip())
        if "/*" in lines[at]:
            break
        at -= 1
    text = "\n".join(reversed(block))
    if not text.startswith("/**"):
        return ""
    body = text[3:].removesuffix("*/").split("\n")
    return "\n".join(x.strip().removeprefix("*").strip() for x in body).strip()


class _Scanner:
    def __init__(self, path: str, code: bytes, typed: bool):
        self.text = code.decode("utf-8", "replace")
        self.typed = typed
        self.tokens = tokens(self.text)
        self.lines = self.text.split("\n")
        self.breaks = [m.start() for m in re.finditer("\n", self.text)]
        self.imports = imports(self.text)
        self.rows: list[dict] = []

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else ""

    def mate(self, i: int) -> int:
        return self.tokens[i].mate if 0 <= i < len(self.tokens) else -1

    def annotation(self, i: int, stop: set[str]) -> tuple[int, str]:
        """(next token, text) of a type after a colon; it ends at a line's end or one of stop outside brackets."""
        if not self.typed or self.at(i) != ":":
            return i, ""
        begin, i = i + 1, i + 1
        while i < len(self.tokens):
            text = self.at(i)
            fresh = i > begin and "\n" in self.text[self.tokens[i - 1].end : self.tokens[i].start]
            if fresh or text in stop and not (text == "{" and i == begin) or text in (";", "}"):
                break
            if text == "<":
                depth = 0
                while i < len(self.tokens):
                    depth += (self.at(i) == "<") - (self.at(i) == ">")
                    i += 1
                    if not depth:
                        break
                continue
            i = self.mate(i) + 1 if self.mate(i) > i else i + 1
        return i, self.text[self.tokens[begin].start : self.tokens[i - 1].end].strip() if i > begin else ""

    def emit(self, name: str, kind: str, first: int, last: int, takes: str, gives: str) -> None:
        begin, end = self.tokens[first].start, self.tokens[last].end
        a, b = bisect_right(self.breaks, begin - 1), bisect_right(self.breaks, end - 1)
        if b - a < LEAST_SPAN:
            return
        code = self.text[begin:end]
        self.rows.append(
            {
                "node_type": kind,
                "node_name": name,
                "start_line": a + 1,
                "end_line": b + 1,
                "content": code,
                "package_name": "",
                "imports": self.imports,
                "signature": signature(code, name),
                "receiver": "",
                "doc": doc_above(self.lines, a),
                "callees": called(code),
                "param_types": parameter_types(takes, self.typed),
                "return_types": [gives] if gives else [],
                "has_error_return": False,
            }
        )

    def inside(self, i: int) -> str:
        return self.text[self.tokens[i].end : self.tokens[self.mate(i)].start]

    def generics(self, i: int) -> int:
        if self.typed and self.at(i) == "<":
            depth = 0
            while i < len(self.tokens):
                depth += (self.at(i) == "<") - (self.at(i) == ">")
                i += 1
                if not depth:
                    break
        return i

    def body(self, i: int, first: int, name: str, kind: str, arrow: bool = False) -> int:
        """After parameters at i: a body in braces makes a row; gives the token past it, or -1."""
        i = self.generics(i)
        if arrow and self.kind(i) == "word":
            takes, i = self.at(i), i + 1
        elif self.at(i) == "(" and self.mate(i) > i:
            takes, i = self.inside(i), self.mate(i) + 1
        else:
            return -1
        i, gives = self.annotation(i, {"=>", "=", "{"} if arrow else {"{", "="})
        if arrow:
            if self.at(i) != "=>":
                return -1
            i += 1
        if self.at(i) != "{" or self.mate(i) < 0:
            return -1
        self.emit(name, kind, first, self.mate(i), takes, gives)
        return self.mate(i) + 1

    def function(self, i: int, first: int, name: str = "", star: bool = True) -> int:
        if self.at(i) == "async" and self.at(i + 1) == "function":
            i += 1
        if self.at(i) != "function":
            return -1
        i += 1
        if self.at(i) == "*":
            if not star:
                return -1
            i += 1
        if self.kind(i) == "word":
            name, i = name or self.at(i), i + 1
        return self.body(i, first, name, "function") if name else -1

    def variable(self, i: int) -> int:
        if self.at(i) not in ("const", "let", "var") or self.kind(i + 1) != "word" or self.at(i + 2) != "=":
            return -1
        name, j = self.at(i + 1), i + 3
        after = self.function(j, i, name, star=False)
        if after < 0:
            after = self.body(j + (self.at(j) == "async" and self.at(j + 1) not in ("=>", "")), i, name, "function", arrow=True)
        return after

    def class_body(self, i: int) -> int:
        """The token that opens the body of the class at i, or -1."""
        if self.at(i) != "class" or self.at(i - 1) == "." or self.kind(i + 1) != "word":
            return -1
        j = i + 2
        while j < len(self.tokens) and self.at(j) not in ("{", ";", "}"):
            j = self.mate(j) + 1 if self.at(j) in ("(", "[") and self.mate(j) > j else j + 1
        return j if self.at(j) == "{" and self.mate(j) > j else -1

    def methods(self, name: str, i: int, end: int) -> None:
        while i < end:
            first = i
            while self.at(i) == "@" and i < end:
                i += 2
                while self.at(i) == ".":
                    i += 2
                i = self.mate(i) + 1 if self.at(i) == "(" and self.mate(i) > i else i
            while self.at(i) in MODIFIERS and self.at(i + 1) not in ("(", "<", "=", ";", ":", "?", "!", ""):
                i += 1
            i += self.at(i) == "*"
            i += self.at(i) == "#"
            own = ""
            if self.at(i) == "[" and self.mate(i) > i:
                i = self.mate(i) + 1
            elif self.kind(i) in ("word", "string", "number"):
                own, i = self.at(i).strip("'\""), i + 1
            i += self.at(i) == "?"
            after = self.body(i, first, f"{name}.{own}" if own else name, "method") if self.at(i) in ("(", "<") and own not in NOT_METHODS else -1
            if after > 0:
                i = after
                continue
            # a field: on to the end of its statement
            i = max(i, first + 1)
            while i < end and self.at(i) not in (";", "@"):
                if self.mate(i) > i:
                    i = self.mate(i) + 1
                    if self.at(i - 1) == "}":
                        break
                    continue
                if i + 1 < end and self.kind(i) != "mark" and self.kind(i + 1) in ("word", "string") and "\n" in self.text[self.tokens[i].end : self.tokens[i + 1].start]:
                    i += 1
                    break
                i += 1
            i += self.at(i) == ";"

    def scan(self) -> list[dict]:
        i = 0
        while i < len(self.tokens):
            opens = self.class_body(i)
            if opens > 0:
                self.methods(self.at(i + 1), opens + 1, self.mate(opens))
                i = self.mate(opens) + 1
                continue
            after = -1
            if self.kind(i) == "word" and self.at(i - 1) != ".":
                after = self.function(i, i)
                after = self.variable(i) if after < 0 else after
            i = after if after > 0 else i + 1
        return self.rows


def chunks(path: str, code: bytes, typed: bool) -> list[dict]:
    """A row for every named function, arrow constant and method of three lines or more; not inside other rows."""
    return _Scanner(path, code, typed).scan()
