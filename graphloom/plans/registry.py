"""Queries of the program-graph operators and their SQL."""

from __future__ import annotations

from graphloom.plans import carrying, dataflow, decoding, documents, drawing, facts, output, producing, ranking, seeding, structure, texts, tracing

_ALL = (structure, producing, decoding, ranking, seeding, texts, dataflow, facts, drawing, output, documents, carrying, tracing)
QUERIES = {k: f for m in _ALL for k, f in m.QUERIES.items()}
SQL = {k: s for m in _ALL for k, s in m.SQL.items()}
