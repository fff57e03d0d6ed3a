"""What a tool is: a name, a description, parameters and a function of a pipeline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": (list, tuple), "object": dict}


@dataclass(frozen=True)
class ParameterSpec:
    name: str
    type: str = "string"
    description: str = ""
    required: bool = True
    default: Any = None
    enum: tuple[str, ...] | None = None

    def schema(self) -> dict:
        out: dict[str, Any] = {"type": self.type, "description": self.description}
        if self.enum:
            out["enum"] = list(self.enum)
        if self.default is not None:
            out["default"] = self.default
        return out


@dataclass
class ToolResult:
    success: bool
    data: Any = None
    message: str = ""
    error: str | None = None
    metadata: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return {"success": self.success, "data": self.data, "message": self.message, "error": self.error, "metadata": self.metadata}


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: tuple[ParameterSpec, ...]
    function: Callable[..., tuple[Any, str]]
    needs_llm: bool = False

    def schema(self) -> dict:
        return {
            "name": self.name,
            "description": self.description,
            "parameters": {"type": "object", "properties": {p.name: p.schema() for p in self.parameters}, "required": [p.name for p in self.parameters if p.required]},
        }

    def check(self, given: dict) -> str | None:
        known = {p.name: p for p in self.parameters}
        for name in given:
            if name not in known:
                return f"unknown parameter {name}"
        for p in self.parameters:
            if p.name not in given:
                if p.required:
                    return f"missing parameter {p.name}"
            elif not isinstance(given[p.name], _TYPES[p.type]) or p.type == "integer" and isinstance(given[p.name], bool):
                return f"parameter {p.name} must be of type {p.type}"
            elif p.enum and given[p.name] not in p.enum:
                return f"parameter {p.name} must be one of {', '.join(p.enum)}"
        return None


class NotFound(LookupError):
    """A table or column that the pipeline does not have."""


class ToolRegistry:
    def __init__(self, pipeline, llm: Callable[[str], str] | None = None):
        self.pipeline, self.llm, self.tools = pipeline, llm, {}

    def register(self, tool: Tool) -> None:
        self.tools[tool.name] = tool

    def names(self) -> list[str]:
        return list(self.tools)

    def schemas(self) -> list[dict]:
        return [t.schema() for t in self.tools.values()]

    def run(self, name: str, **given) -> ToolResult:
        tool = self.tools.get(name)
        if tool is None:
            return ToolResult(False, error=f"no tool {name}")
        if wrong := tool.check(given):
            return ToolResult(False, error=wrong)
        values = {p.name: given.get(p.name, p.default) for p in tool.parameters}
        try:
            data, message = tool.function(self.pipeline, **values, **({"llm": self.llm} if tool.needs_llm else {}))
        except NotFound as e:
            return ToolResult(False, error=str(e))
        return ToolResult(True, data, message)
