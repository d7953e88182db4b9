"""All registered queries and their SQL."""

from __future__ import annotations

from sonaria.plans import audio_queries, frame_queries, interval_queries, signal_queries

QUERIES = interval_queries.QUERIES | frame_queries.QUERIES | signal_queries.QUERIES | audio_queries.QUERIES
SQL = interval_queries.SQL | frame_queries.SQL | signal_queries.SQL | audio_queries.SQL
