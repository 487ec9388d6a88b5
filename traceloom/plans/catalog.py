"""All registered queries."""

from traceloom.plans import block_queries, codec_queries, ledger_queries, registry, replay_queries, request_queries, session_queries, text_queries  # noqa: F401

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
