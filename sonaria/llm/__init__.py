"""Training-data operators. Nothing outside this subpackage imports it."""

from sonaria.llm import memory  # noqa: F401  settles the memory of every process that works for an operator
