"""Registered queries, each with the SQL that must give the same rows."""

from catalog import canonical, generation, ledgers, parity, sources, texts  # noqa: F401
from catalog.base import ORACLES, QUERIES  # noqa: F401
