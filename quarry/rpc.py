"""JSON-RPC over a pair of streams: one search tool. Progress never goes to the answer stream."""

from __future__ import annotations

import json
from typing import IO

from quarry.operators.search import SERVER_K
from quarry.plans.index import Index

TOOL = {
    "name": "quarry-search",
    "description": "Finds the functions of a source tree that are most like a question, from many files first.",
    "inputSchema": {
        "type": "object",
        "properties": {
            "query": {"type": "string", "description": "What to look for, in words or symbols."},
            "top_k": {"type": "integer", "description": f"Most hits to return; {SERVER_K} unless given."},
            "project_path": {"type": "string", "description": "Root of another indexed project."},
        },
        "required": ["query"],
    },
}


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Server:
    """Answers requests one at a time."""

    def __init__(self, index: Index, open_index=None):
        self.index, self.open_index = index, open_index

    def retrieve(self, arguments: dict) -> list[dict]:
        """Hits for query, top_k (0 is the default, below 0 is none) and project_path."""
        query = arguments.get("query")
        if not isinstance(query, str) or not isinstance(arguments.get("top_k") or 0, int):
            raise RpcError(-32602, "query must be text and top_k a whole number")
        path = (arguments.get("project_path") or "").strip()
        index = self.open_index(path) if path and self.open_index else self.index
        return [r.asDict() for r in index.search(query, arguments.get("top_k") or SERVER_K).collect()]

    def call(self, method: str, params: dict):
        if method == "initialize":
            return {"protocolVersion": "2024-11-05", "serverInfo": {"name": "quarry", "version": "1.0.0"}, "capabilities": {"tools": {}, "resources": {}, "prompts": {}}}
        if method in ("tools/list", "resources/list", "prompts/list"):
            kind = method.partition("/")[0]
            return {kind: [TOOL] if kind == "tools" else []}
        if method in ("ping", "shutdown"):
            return {"status": "ok"} if method == "ping" else None
        if method == "tools/call":
            if params.get("name") != TOOL["name"]:
                raise RpcError(-32602, f"unknown tool: {params.get('name')}")
            hits = self.retrieve(params.get("arguments") or {})
            return {"content": [{"type": "text", "text": json.dumps(hits, indent=2, ensure_ascii=False)}]}
        raise RpcError(-32601, f"unknown method: {method}")

    def answer(self, text: str) -> dict | None:
        """The reply to one message, or None for notifications."""
        try:
            request = json.loads(text)
            if not isinstance(request, dict):
                raise ValueError("not an object")
        except ValueError as error:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(error)}}
        number = request.get("id")
        try:
            result = self.call(request.get("method", ""), request.get("params") or {})
        except RpcError as error:
            reply = {"error": {"code": error.code, "message": str(error)}}
        except Exception as error:
            reply = {"error": {"code": -32603, "message": str(error)}}
        else:
            reply = {"result": result}
        return None if number is None else {"jsonrpc": "2.0", "id": number} | reply

    def run(self, source: IO[bytes], sink: IO[bytes]) -> None:
        """Serve until `exit` or the end of the stream."""
        while (text := read_message(source)) is not None:
            if text.strip() and '"exit"' in text and json.loads(text).get("method") == "exit":
                return
            if (reply := self.answer(text)) is not None:
                sink.write(json.dumps(reply, ensure_ascii=False).encode() + b"\n")
                sink.flush()


def read_message(source: IO[bytes]) -> str | None:
    """A message with a Content-Length header, or one line."""
    while True:
        line = source.readline()
        if not line:
            return None
        if line.lower().startswith(b"content-length:"):
            size = int(line.split(b":", 1)[1])
            while source.readline().strip():
                pass
            return source.read(size).decode()
        if line.strip():
            return line.decode()
