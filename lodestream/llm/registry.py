"""Queries of this subpackage and their SQL."""

from lodestream.llm import decontaminate, fingerprint, html, jaccard, langid, licenses, packing, pii, quality, warc

PARTS = (fingerprint, warc, packing, decontaminate, html, jaccard, langid, licenses, pii, quality)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
