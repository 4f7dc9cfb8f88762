"""The registered queries and their SQL."""

from __future__ import annotations

from loamline.plans import ingest, relational, retrieval, scalars

QUERIES = {**scalars.QUERIES, **relational.QUERIES, **retrieval.QUERIES, **ingest.QUERIES}
ORACLES = {**scalars.ORACLES, **relational.ORACLES, **retrieval.ORACLES, **ingest.ORACLES}
FLAGSHIP = "q1_retrieve"
