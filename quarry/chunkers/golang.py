"""Go functions, from a token stream; a file that does not hold together has no rows but an error."""

from __future__ import annotations

import re

TOKEN = re.compile(
    r"(?P<space>[ \t\r]+)|(?P<newline>\n)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|`[^`]*`)"
    r"|(?P<rune>'(?:\\.[^'\n]*|[^'\\\n])')|(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<dots>\.\.\.)|(?P<mark>[-+*/%&|^<>=!:.,;()\[\]{}~]+?)",
    re.S,
)
CLOSES = {"(": ")", "[": "]", "{": "}"}
KEYWORDS = {
    "break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto", "if", "import",
    "interface", "map", "package", "range", "return", "select", "struct", "switch", "type", "var",
}
LEAST_SPAN = 2


class Tokens:
    """Texts, kinds, bounds and bracket partners of the significant tokens."""

    def __init__(self, text: str):
        self.text: list[str] = []
        self.kind: list[str] = []
        self.span: list[tuple[int, int]] = []
        self.mate: list[int] = []
        open_at: list[int] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"line {text.count(chr(10), 0, at) + 1}: not Go")
            at = m.end()
            if m.lastgroup in ("space", "newline", "line", "block"):
                continue
            if m[0] in CLOSES:
                open_at.append(len(self.text))
            elif m[0] in (")", "]", "}"):
                if not open_at or CLOSES[self.text[open_at[-1]]] != m[0]:
                    raise ValueError(f"line {text.count(chr(10), 0, m.start()) + 1}: unmatched {m[0]}")
                self.mate[open_at.pop()] = len(self.text)
            self.text.append(m[0])
            self.kind.append(m.lastgroup)
            self.span.append(m.span())
            self.mate.append(-1)
        if open_at:
            raise ValueError("a bracket is left open")

    def shown(self, a: int, b: int) -> str:
        """Tokens a to b as one would write them in a type or a call."""
        out = ""
        for i in range(a, b):
            t = self.text[i]
            wordy = self.kind[i] in ("word", "number", "string", "rune")
            if out and (wordy and (self.kind[i - 1] in ("word", "number") or out[-1] in ")}") or t in ("*", "[", "(", "<") and self.text[i - 1] in ("chan",) or out[-1] == ")" and t in ("*", "[", "(", "<")):
                out += " "
            out += t + (" " if t in (",", ";") else "")
        return out


def _parts(t: Tokens, a: int, b: int) -> list[tuple[int, int]]:
    """Ranges between the commas of a list."""
    out, begin, i = [], a, a
    while i < b:
        if t.text[i] == ",":
            out.append((begin, i))
            begin = i + 1
        i = t.mate[i] + 1 if t.mate[i] > i else i + 1
    if begin < b:
        out.append((begin, b))
    return out


def fields(t: Tokens, a: int, b: int) -> list[tuple[str, str]]:
    """(name, type) of every parameter, names spread over their shared type; a bare type has no name."""
    parts = _parts(t, a, b)
    named = [t.kind[x] == "word" and t.text[x] not in KEYWORDS and y - x > 1 and t.text[x + 1] != "." and not (t.text[x + 1] == "[" and t.mate[x + 1] == y - 1 and t.mate[x + 1] > x + 2) for x, y in parts]
    if not any(named):
        return [("", t.shown(x, y)) for x, y in parts]
    out: list[tuple[str, str]] = []
    kind = ""
    for (x, y), own in zip(reversed(parts), reversed(named), strict=True):
        kind = t.shown(x + 1, y) if own else kind
        out.append((t.text[x], kind))
    return out[::-1]


def _type_end(t: Tokens, i: int) -> int:
    """Past the type that starts at i."""
    while i < len(t.text):
        x = t.text[i]
        if x in ("*", "...", "<", "-"):
            i += 1
        elif x == "[":
            i = t.mate[i] + 1
        elif x == "map":
            i = t.mate[i + 1] + 1
        elif x == "chan":
            i += 1
            if t.text[i : i + 2] == ["<", "-"]:
                i += 2
        elif x == "func":
            i = t.mate[i + 1] + 1
            return t.mate[i] + 1 if t.text[i] == "(" else _type_end(t, i) if t.kind[i] == "word" or t.text[i] in ("*", "[") else i
        elif x in ("interface", "struct"):
            return t.mate[i + 1] + 1
        elif x == "(":
            return t.mate[i] + 1
        else:
            i += 1
            while i < len(t.text) and t.text[i] == ".":
                i += 2
            return t.mate[i] + 1 if i < len(t.text) and t.text[i] == "[" else i
    return i


def _listed(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f"{n} {k}".strip() for n, k in pairs)


def _target(t: Tokens, i: int, low: int) -> str:
    """What the call whose bracket is at i calls, or empty."""
    j = i - 1
    if j < low:
        return ""
    back = {m: k for k, m in enumerate(t.mate) if m >= 0}
    begin = i
    while j >= low:
        if t.kind[j] == "word" and t.text[j] not in KEYWORDS:
            begin = j
            j -= 1
        elif t.text[j] in (")", "]") and back[j] >= low:
            begin = back[j]
            j = begin - 1
            if j >= low and t.kind[j] == "word" and t.text[j] not in KEYWORDS:
                continue
            if j >= low and t.text[j] == "func":
                return ""
        else:
            break
        if j >= low and t.text[j] == ".":
            j -= 1
            continue
        if t.kind[begin] == "word" and j >= low and t.text[j] == "]" and back[j] == j - 1:
            begin = j - 1
        break
    if begin == i or begin > low and t.text[begin - 1] == "func":
        return ""
    return t.shown(begin, i)


def called(t: Tokens, a: int, b: int) -> list[str]:
    found = {_target(t, i, a + 1) for i in range(a + 1, b) if t.text[i] == "("}
    return sorted(found - {""}, key=lambda x: x.encode())


def imports(t: Tokens) -> list[str]:
    found = []
    i = 0
    while i < len(t.text):
        if t.text[i] == "import":
            a, b = (i + 2, t.mate[i + 1]) if t.text[i + 1] == "(" else (i + 1, i + 3)
            alias = ""
            for k in range(a, min(b, len(t.text))):
                if t.kind[k] == "string":
                    path = t.text[k].strip('"`')
                    found.append(f"{alias}={path}" if alias else path)
                    alias = ""
                    if t.text[i + 1] != "(":
                        break
                elif t.text[k] not in (";", ","):
                    alias = t.text[k]
            i = b
        elif t.text[i] in ("func", "type", "var", "const"):
            break
        else:
            i += 1
    return sorted(found, key=lambda x: x.encode())


def _doc(text: str, start: int) -> str:
    """The comment that ends on the line above."""
    above = text[:start].rstrip(" \t")
    lines = above.split("\n")[:-1]
    run: list[str] = []
    if lines and lines[-1].rstrip().endswith("*/"):
        body = above[above.rfind("/*") + 2 : above.rfind("*/")]
        return body.strip()
    while lines and lines[-1].lstrip().startswith("//"):
        line = lines.pop().strip()
        if not re.match(r"//(line |extern |export |[a-z0-9]+:[a-z0-9])", line):
            run.append(line[2:].removeprefix(" ").rstrip())
    return "\n".join(reversed(run)).strip()


def _declares(t: Tokens, text: str, i: int) -> bool:
    """Whether the func at i begins a declaration: what is before it ends a statement, so it is no type or literal."""
    if not i or t.text[i - 1] == ";":
        return True
    ends = t.text[i - 1] in (")", "]", "}") or t.kind[i - 1] == "string" or t.kind[i - 1] == "word" and t.text[i - 1] not in KEYWORDS or t.text[i - 1][0].isdigit()
    return ends and "\n" in text[t.span[i - 1][1] : t.span[i][0]]


def chunks(path: str, code: bytes) -> list[dict]:
    """A row for every function and method declaration of three lines or more."""
    text = code.decode("utf-8")
    t = Tokens(text)
    if t.text[:1] != ["package"] or len(t.text) < 2 or t.kind[1] != "word":
        raise ValueError("no package clause")
    package, known, rows, i = t.text[1], imports(t), [], 2
    while i < len(t.text):
        if t.text[i] != "func" or not _declares(t, text, i):
            i = t.mate[i] + 1 if t.mate[i] > i else i + 1
            continue
        begin, j, receiver = i, i + 1, []
        if t.text[j] == "(":
            receiver, j = fields(t, j + 1, t.mate[j]), t.mate[j] + 1
        if j >= len(t.text) or t.kind[j] != "word":
            raise ValueError("func: no name")
        name, j = t.text[j], j + 1
        if t.text[j] == "[":
            j = t.mate[j] + 1
        if t.text[j] != "(":
            raise ValueError(f"{name}: no parameters")
        takes, j = fields(t, j + 1, t.mate[j]), t.mate[j] + 1
        gives: list[tuple[str, str]] = []
        if j < len(t.text) and t.text[j] == "(":
            gives, j = fields(t, j + 1, t.mate[j]), t.mate[j] + 1
        elif j < len(t.text) and t.text[j] != "{" and "\n" not in text[t.span[j - 1][1] : t.span[j][0]]:
            end = _type_end(t, j)
            gives, j = [("", t.shown(j, end))], end
        if j >= len(t.text) or t.text[j] != "{":
            i = j
            continue
        last = t.mate[j]
        a, b = t.span[begin][0], t.span[last][1]
        first_line, last_line = text.count("\n", 0, a) + 1, text.count("\n", 0, b) + 1
        if last_line - first_line >= LEAST_SPAN:
            owner = receiver[0][1] if receiver else ""
            results = "" if not gives else f" {gives[0][1]}" if len(gives) == 1 and not gives[0][0] else f" ({_listed(gives)})"
            rows.append(
                {
                    "node_type": "method_declaration" if receiver else "function_declaration",
                    "node_name": f"({owner}).{name}" if receiver else name,
                    "start_line": first_line,
                    "end_line": last_line,
                    "content": text[a:b],
                    "package_name": package,
                    "imports": known,
                    "signature": "func " + (f"({_listed(receiver)}) " if receiver else "") + f"{name}({_listed(takes)}){results}",
                    "receiver": owner,
                    "doc": _doc(text, a),
                    "callees": called(t, j, last),
                    "param_types": [k for _, k in takes],
                    "return_types": [k for _, k in gives],
                    "has_error_return": any(k == "error" for _, k in gives),
                }
            )
        i = last + 1
    return rows
