"""From SQL text to plans: a lexer, and rewrites of what Spark's own grammar lacks."""

from .lexer import Token, split_statements, tokenize
from .rewrite import rewrite, run_sql

__all__ = ["Token", "tokenize", "split_statements", "rewrite", "run_sql"]
