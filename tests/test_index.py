from __future__ import annotations

import hashlib
import io
import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quarry import config
from quarry.functions import embedding
from quarry.functions.embedding import HashingProvider
from quarry.plans.index import Index
from quarry.rpc import Server, read_message
from quarry.sources import tree

PY = "def alpha(x):\n    y = beta(x)\n    return y\n\n\ndef gamma():\n    print('g')\n    return 1\n"


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "build"
    for path, text in {"a.py": PY, "_pkg/__init__.py": PY.replace("alpha", "delta"), ".hid/c.js": "function js() {\n  a();\n}\n", "node_modules/x.py": PY, "skip/d.py": PY, "bad.go": "package p\nfunc f( {\n", "note.txt": "x"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / ".gitignore").write_text("skip/\n# c\n")
    return root


def test_paths_keep_hidden_names_and_skip_ignored(project):
    found = [os.path.relpath(p, project) for p in tree.source_paths(str(project))]
    assert found == [".hid/c.js", "_pkg/__init__.py", "a.py", "bad.go"]


def test_manifest_hashes(spark, project):
    rows = {r["rel_path"]: r for r in tree.manifest(spark, str(project)).collect()}
    assert rows["a.py"]["file_hash"] == hashlib.sha256(PY.encode()).hexdigest() and rows["a.py"]["language"] == "python"


def test_names():
    assert tree.normal_path("  ") == "" and tree.normal_path("/a/../b") == "/b"
    assert tree.canonical_keys({"a": "1", "./b": "2", " ": "3", "": "4"}, "/r") == {"/r/a": "1", "/r/b": "2"}
    assert tree.project_id("/x/") == tree.project_id("/x") and len(tree.project_id("")) == 64


def test_index_lifecycle(spark, project, tmp_path):
    index = Index(spark, str(project), str(tmp_path / "store"))
    assert index.search("alpha").count() == 0 and index.count() == 0
    first = index.refresh()
    assert (first.added, first.failed, first.version) == (4, 1, 1)
    assert index.count() == 5
    again = index.refresh()
    # the broken file is tried again, the others are as they were
    assert again.unchanged == 3 and again.added == 1
    (project / "bad.go").unlink()
    (project / "a.py").write_text(PY.replace("alpha", "omega"))
    (project / ".hid/c.js").unlink()
    third = index.refresh()
    assert (third.modified, third.deleted) == (1, 1)
    names = {r[0] for r in index.chunks().select("node_name").collect()}
    assert names == {"omega", "gamma", "delta"}
    assert index.refresh().version == third.version
    hits = index.search("omega y beta", 2).collect()
    assert len(hits) == 2 and hits[0]["file_path"] == "a.py" and hits[0]["score"] >= hits[1]["score"]
    groups = index.duplicates(0.3).collect()
    assert groups and all(len(g["chunks"]) > 1 for g in groups)
    (project / "a.py").unlink()
    assert {r[0] for r in index.search("omega", 5).select("file_path").collect()} == {"_pkg/__init__.py"}
    with pytest.raises(ValueError):
        Index(spark, str(project), str(tmp_path / "store"), model="other").refresh()
    index.clear()
    index.clear()
    assert index.count() == 0


def test_index_checks_width_and_takes_other_sources(spark, project, tmp_path):
    store = f"file://{tmp_path}/store"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").load(str(project))
    source = lambda: tree.from_binary_files(files, str(project))
    index = Index(spark, str(project), store, source=source)
    assert index.refresh().added == 1 and index.count() == 2
    assert Index(spark, str(project), store, source=source).refresh().unchanged == 1
    with pytest.raises(ValueError, match="width 32"):
        Index(spark, str(project), store, lambda: HashingProvider(32), source=source).refresh()
    assert {r["file_path"] for r in index.search("alpha").collect()} == {"a.py"}
    assert index.delete_files([str(project / "a.py")]) == 2 and index.count() == 0
    index.clear()
    assert index.version() == 0


def test_provider_over_http(monkeypatch):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers["Authorization"], body["model"]))
            data = [{"index": i, "embedding": [float(len(t))]} for i, t in enumerate(body["input"])]
            reply = json.dumps({"data": data[::-1] if "few" not in body["input"] else []}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(reply)))
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *args):
            pass

    settings = (*embedding.KEY_SETTINGS, *embedding.BASE_SETTINGS, *embedding.MODEL_SETTINGS)
    for name in settings:
        monkeypatch.delenv(name, raising=False)
    assert embedding.selected() == (HashingProvider, "hashing-64")
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        monkeypatch.setenv(embedding.KEY_SETTINGS[0], "k")
        monkeypatch.setenv(embedding.BASE_SETTINGS[1], f"http://127.0.0.1:{server.server_port}/v1/")
        make, model = embedding.selected()
        assert model == embedding.DEFAULT_MODEL and make().embed([]) == []
        assert make().embed(["a", "bcd"]) == [[1.0], [3.0]]
        assert asked == [("/v1/embeddings", "Bearer k", model)]
        with pytest.raises(ValueError):
            make().embed(["few"])
        monkeypatch.setenv(embedding.MODEL_SETTINGS[0], "m")
        assert embedding.selected()[1] == "m"
    finally:
        server.shutdown()


def test_rpc(spark, project, tmp_path):
    index = Index(spark, str(project), str(tmp_path / "store"))
    index.refresh()
    server = Server(index)
    call = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "quarry-search", "arguments": {"query": "alpha", "top_k": 1}}}
    body = json.dumps(call).encode()
    source = io.BytesIO(b"Content-Length: %d\r\n\r\n%s" % (len(body), body) + b'\n{"id":2,"method":"nope"}\n{"method":"notifications/initialized"}\nbroken\n{"id":3,"method":"ping"}\n{"method":"exit"}\n')
    sink = io.BytesIO()
    server.run(source, sink)
    replies = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert len(json.loads(replies[0]["result"]["content"][0]["text"])) == 1
    assert [r.get("error", {}).get("code") for r in replies] == [None, -32601, -32700, None]
    assert server.answer('{"id":1,"method":"tools/call","params":{"name":"x"}}')["error"]["code"] == -32602
    assert server.answer('{"id":1,"method":"tools/list"}')["result"]["tools"][0]["inputSchema"]["required"] == ["query"]
    assert server.retrieve({"query": "alpha", "top_k": -1}) == []
    assert read_message(io.BytesIO(b"")) is None


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("QUARRY_A", "")
    monkeypatch.setenv("QUARRY_B", "b")
    assert config.first_set("", "QUARRY_A", "QUARRY_B") == "b" and config.first_set("QUARRY_A") == ""
    path = tmp_path / "c.json"
    assert config.load_file(str(path)) == {}
    path.write_text("")
    assert config.load_file(str(path)) == {}
    path.write_text('{"QUARRY_B": "c", "QUARRY_A": ""}')
    assert config.load_file(str(path)) == {"QUARRY_B": "c"} and os.environ["QUARRY_B"] == "c"


def test_cli_version(capsys):
    from quarry.cli import main

    assert main(["version"]) == 0 and capsys.readouterr().out.strip()
