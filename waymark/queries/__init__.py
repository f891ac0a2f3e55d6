"""Queries over the driver's tables, one for each operator, with SQL counterparts where SQL has them."""

from waymark.queries import files, tables, texts, trails  # noqa: I001
from waymark.queries import catalog, changes  # these reuse SQL of the others
from waymark.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "changes", "files", "tables", "texts", "trails"]
