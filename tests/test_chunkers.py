from __future__ import annotations

import pytest

from quarry.chunkers import chunked, chunker, detect, ecmascript, golang, python
from quarry.chunkers.ecmascript import split_parameters


def names(rows):
    return [r["node_name"] for r in rows]


def test_python_blocks_keep_trailing_blanks_and_comments():
    code = b"def a():\n    x()\n    return 1\n\n# end\n\nclass C:\n    def b(self, v: Dict[str, int] = 1, *args) -> List[int]:\n        pass\n        return 2\n"
    first, second = python.chunks("x/y.tar.py", code)
    assert (first["start_line"], first["end_line"], first["package_name"]) == (1, 6, "y.tar")
    assert (second["node_name"], second["node_type"], second["signature"]) == ("C.b", "method", "def b(self, v")
    assert second["param_types"] == ["", "Dict[str", "", ""] and second["return_types"] == ["List[int]"]
    assert first["callees"] == ["a", "x"]


@pytest.mark.parametrize("code", [b"", b"\n\n", b"async def a():\n    b\n    c\n", b"def a(): pass\n", b"def a():\n    return 1\n"])
def test_python_nothing_to_find(code):
    assert python.chunks("a.py", code) == []


def test_python_crlf_and_tabs():
    rows = python.chunks("a.py", b"class A:\r\n\tdef b(self):\r\n\t\tpass\r\n\t\treturn\r\nx = 1\r\n")
    assert names(rows) == ["A.b"] and rows[0]["end_line"] == 4


def test_go_shared_types_results_and_errors():
    code = b"package p\nimport (\n\tx \"a/b\"\n\t\"c\"\n)\nfunc F(a, b int, f func(int) (string, error)) (map[string][]*T, error) {\n\tx.G(a)(b)\n\treturn nil, nil\n}\n"
    (row,) = golang.chunks("f.go", code)
    assert row["param_types"] == ["int", "int", "func(int) (string, error)"]
    assert row["return_types"] == ["map[string][]*T", "error"] and row["has_error_return"]
    assert row["imports"] == ["c", "x=a/b"] and "x.G" in row["callees"]


@pytest.mark.parametrize("code", [b"package p\nfunc F() {\n\n", b"func F() {\n\n\n}\n", b"package p\nfunc F( {\n\n}\n", b'package p\nvar s = "open\n'])
def test_go_broken_file_is_an_error(code):
    with pytest.raises(ValueError):
        golang.chunks("f.go", code)


@pytest.mark.parametrize(
    "before",
    ["type H func(a int) error", "type H func(a int) List[int]", "var h = func(a int) int {\n\n\n\treturn a\n}", "var m = map[string]func(int) int{\n\t\"a\": nil,\n}", "var (\n\tx = func() {}\n)", "var v map[string]func()", "type S struct {\n\tf func(int) int\n}", "var k =\n\tfunc(a int) int { return a }"],
)
def test_go_function_types_and_literals_are_no_declarations(before):
    code = f"package p\n\n{before}\n\nfunc (r *T) G(x int) int {{\n\treturn x\n}}\n".encode()
    assert names(golang.chunks("f.go", code)) == ["(*T).G"]


def test_go_braces_in_text_and_literals():
    code = b'package p\nvar f = func() {\n\n\n}\nfunc G() {\n\ts := "}" + `{` + string(\'{\')\n\t// }\n\t_ = s\n}\n'
    assert names(golang.chunks("f.go", code)) == ["G"]


def test_ecmascript_classes():
    code = b"class A extends mixin(B, {}) {\n  get() {\n    return 1;\n  }\n  static async *gen() {\n    yield 1;\n  }\n  field = () => {\n    if (x) {\n      y();\n    }\n  };\n  #hidden(a) {\n    return a;\n  }\n  [k]() {\n    return 2;\n  }\n}\nfunction after() {\n  return `}${`{`}`;\n}\n"
    assert names(ecmascript.chunks("a.js", code, False)) == ["A.get", "A.gen", "A.hidden", "A", "after"]


@pytest.mark.parametrize("code", [b"", b"const f = (a) => a + 1;\n", b"export default function () {\n  a();\n}\n", b"interface I {\n  a(): void;\n  b(): void;\n}\n", b"function (", b"class A {"])
def test_ecmascript_nothing_to_find(code):
    assert ecmascript.chunks("a.ts", code, True) == []


def test_split_parameters():
    assert split_parameters("a, b = [1, 2], {c, d}: Map<x, y>, /* , */ e = ','") == ["a", "b = [1, 2]", "{c, d}: Map<x, y>", "e = ','"]


@pytest.mark.parametrize(("path", "language"), [("a.go", "go"), ("b.py", "python"), ("c.JS", "javascript"), ("d.jsx", "javascript"), ("e.tsx", "typescript"), ("f.mjs", "javascript"), ("g.txt", ""), ("h.d/x", "")])
def test_detect(path, language):
    assert detect(path) == language


def test_unknown_language():
    with pytest.raises(ValueError):
        chunker("cobol")


def test_chunked_reports_bad_files(spark):
    rows = [("a.py", "python", bytearray(b"def a():\n    b\n    c\n")), ("b.go", "go", bytearray(b"nonsense {")), ("c.xx", "xx", bytearray(b"")), ("d.py", "python", None)]
    got = {r["file_path"]: r for r in chunked(spark.createDataFrame(rows, "file_path string, language string, content binary")).collect()}
    assert set(got) == {"a.py", "b.go"}
    assert got["a.py"]["node_name"] == "a" and got["b.go"]["error"] and got["b.go"]["node_name"] is None
