"""A model context server: tools and resources of a pipeline over JSON-RPC, one message for each line of standard input."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from . import context
from .base import ToolRegistry


def list_tools(registry: ToolRegistry) -> list[dict]:
    return registry.schemas()


def call_tool(registry: ToolRegistry, name: str, arguments: dict) -> str:
    return json.dumps(registry.run(name, **arguments).to_dict(), default=str)


def resources(registry: ToolRegistry) -> list[str]:
    return ["pipeline://schema", "pipeline://tables", *(f"pipeline://tables/{t}" for t in registry.pipeline.tables)]


def read_resource(registry: ToolRegistry, uri: str) -> str:
    if uri == "pipeline://schema":
        return context.schema_context(registry.pipeline)
    if uri == "pipeline://tables":
        return json.dumps(registry.run("list_tables").data)
    prefix = "pipeline://tables/"
    if uri.startswith(prefix):
        return json.dumps(registry.run("get_table_schema", table=uri[len(prefix) :]).to_dict())
    raise KeyError(uri)


VERSION = "2024-11-05"


def answer(registry: ToolRegistry, message: dict) -> dict | None:
    """The reply to one message; a notification has none."""
    method, given = message.get("method", ""), message.get("params") or {}
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    try:
        if method == "initialize":
            own = {"protocolVersion": VERSION, "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "plumbline", "version": "1"}}
        elif method == "ping":
            own = {}
        elif method == "tools/list":
            own = {"tools": [{"name": t["name"], "description": t["description"], "inputSchema": t.get("parameters") or t.get("inputSchema") or {"type": "object"}} for t in list_tools(registry)]}
        elif method == "tools/call":
            result = registry.run(given["name"], **(given.get("arguments") or {})).to_dict()
            own = {"content": [{"type": "text", "text": json.dumps(result, default=str)}], "isError": not result.get("success", True)}
        elif method == "resources/list":
            own = {"resources": [{"uri": u, "name": u.rpartition("/")[2], "mimeType": "application/json"} for u in resources(registry)]}
        elif method == "resources/read":
            own = {"contents": [{"uri": given["uri"], "mimeType": "application/json", "text": read_resource(registry, given["uri"])}]}
        else:
            return reply | {"error": {"code": -32601, "message": f"no method {method}"}}
    except (KeyError, TypeError) as e:
        return reply | {"error": {"code": -32602, "message": f"{type(e).__name__}: {e}"}}
    return reply | {"result": own}


def serve(registry: ToolRegistry, lines: TextIO | None = None, out: TextIO | None = None) -> None:
    """Answers messages until the input ends."""
    lines, out = lines or sys.stdin, out or sys.stdout
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(registry, json.loads(line))
        except json.JSONDecodeError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            print(json.dumps(reply), file=out, flush=True)
