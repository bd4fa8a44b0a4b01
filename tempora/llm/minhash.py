"""The near-duplicate stage under its former name; it is in neardocs, and holds no MinHash any more."""

from tempora.llm.neardocs import representatives, shingles, similar

__all__ = ["representatives", "shingles", "similar"]
