"""corpusgraph: code-corpus analytics as Spark DataFrame queries."""

from corpusgraph.corpus import Corpus

__all__ = ["Corpus"]
