"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from assayline.llm import ann, exact, jaccard, langid, lines, merkle, mixing, packing, pii, quality, secrets, simhash, variants

MODULES = (langid, ann, packing, mixing, exact, secrets, pii, lines, jaccard, quality, simhash, variants, merkle)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
