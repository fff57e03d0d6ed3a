"""Questions to a pipeline as tools with named parameters: lineage, schema, governance and, with a language model, SQL."""

from .base import ParameterSpec, Tool, ToolRegistry, ToolResult
from .catalog import ALL_TOOLS, LLM_TOOLS


def create_registry(pipeline, llm=None) -> ToolRegistry:
    registry = ToolRegistry(pipeline, llm)
    for tool in ALL_TOOLS:
        registry.register(tool)
    if llm is not None:
        for tool in LLM_TOOLS:
            registry.register(tool)
    return registry


__all__ = ["ParameterSpec", "Tool", "ToolRegistry", "ToolResult", "ALL_TOOLS", "LLM_TOOLS", "create_registry"]
