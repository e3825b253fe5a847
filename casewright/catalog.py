"""All queries of the library itself, with their SQL."""

from __future__ import annotations

from casewright.plans import answers, cases, chunks, contents, dashboards, details, evidence, files, filtering, fulltexts, graphs, judgments, knowledge, pieces, questions, queues, reads, retrieval, states, streams, texts, traces  # noqa: F401  they register their queries
from casewright.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
