"""Operators for preparing training text, and the queries that apply them to the given tables."""

from concord.llm import decontaminate, language, lines, lm, mixing, near, phrases, pieces, quality, repair, rules, token_ids, warc  # noqa: F401
from concord.llm.registry import ORACLES, QUERIES  # noqa: F401
