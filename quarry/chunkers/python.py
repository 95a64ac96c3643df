"""Python functions by indentation: `def` blocks with what belongs to them."""

from __future__ import annotations

import re

DEF = re.compile(r"[ \t]*def[ \t]+([A-Za-z_]\w*)[ \t]*\(", re.A)
CLASS = re.compile(r"[ \t]*class[ \t]+([A-Za-z_]\w*)", re.A)
CALL = re.compile(r"([A-Za-z_]\w*)\s*\(", re.A)
NO_CALL = {"if", "for", "while", "return"}
LEAST_SPAN = 2


def _indent(line: str) -> int:
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    return sum(4 if c == "\t" else 1 for c in lead)


def _says_nothing(line: str) -> bool:
    bare = line.strip()
    return not bare or bare[0] == "#"


def _aliased(spec: str, module: str = "") -> str:
    name, alias = (x.strip() for x in spec.split(" as ", 1)) if " as " in spec else (spec, "")
    if module:
        name = module if name in ("*", "") else f"{module}.{name}"
    return f"{alias}={name}" if alias and name else name if " as " in spec and module else spec if not module else name


def imports(lines: list[str]) -> list[str]:
    """Imported names in file order: `module`, `alias=module`, `module.name`."""
    found = []
    for line in map(str.strip, lines):
        if line.startswith("import "):
            found += [_aliased(p) for p in map(str.strip, line[7:].split(",")) if p]
        elif line.startswith("from "):
            module, _, names = (x.strip() for x in line[5:].strip().partition(" import "))
            if names[:1] == "(" and names[-1:] == ")":
                names = names[1:-1].strip()
            if module:
                found += [_aliased(p, module) for p in map(str.strip, names.split(",")) if p]
    return found


def _parameters(inside: str) -> list[str]:
    """A type for every comma-separated part, empty where none is given."""
    parts = [p.partition("=")[0].strip() for p in map(str.strip, inside.split(",")) if p]
    return [p.partition(":")[2].strip() for p in parts]


def signature(line: str) -> tuple[str, list[str], list[str]]:
    """(header up to its first colon, parameter types, return types) of a `def` line."""
    line = line.strip()
    opening, closing = line.find("("), line.rfind(")")
    if not 0 <= opening < closing:
        return line.partition(":")[0], [], []
    returned = line[closing:].partition("->")[2].partition(":")[0].strip()
    return line.partition(":")[0], _parameters(line[opening + 1 : closing]), [returned] if returned else []


def called(text: str) -> list[str]:
    """Distinct call targets in order of appearance."""
    return [n for n in dict.fromkeys(CALL.findall(text)) if n not in NO_CALL]


def chunks(path: str, code: bytes) -> list[dict]:
    """A row for every `def` of three lines or more, nested ones too; trailing blank lines and comments belong to it."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", code.decode("utf-8", "replace"))
    stem = path.rsplit("/", 1)[-1]
    package = stem[: stem.rfind(".")] if stem.rfind(".") > 0 else stem
    known = imports(lines)
    depth = [_indent(x) for x in lines]
    silent = [_says_nothing(x) for x in lines]
    classes: list[tuple[int, str]] = []
    rows = []
    for i, line in enumerate(lines):
        if silent[i]:
            continue
        while classes and depth[i] <= classes[-1][0]:
            classes.pop()
        if m := CLASS.match(line):
            classes.append((depth[i], m[1]))
        elif m := DEF.match(line):
            after = next((k for k in range(i + 1, len(lines)) if not silent[k] and depth[k] <= depth[i]), len(lines))
            if after - 1 - i < LEAST_SPAN:
                continue
            text = "".join(lines[i:after])
            header, takes, gives = signature(line)
            owner = classes[-1][1] if classes else ""
            rows.append(
                {
                    "node_type": "method" if owner else "function",
                    "node_name": f"{owner}.{m[1]}" if owner else m[1],
                    "start_line": i + 1,
                    "end_line": after,
                    "content": text,
                    "package_name": package,
                    "imports": known,
                    "signature": header,
                    "receiver": "",
                    "doc": "",
                    "callees": called(text),
                    "param_types": takes,
                    "return_types": gives,
                    "has_error_return": False,
                }
            )
    return rows
