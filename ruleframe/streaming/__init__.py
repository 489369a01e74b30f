"""Rules over Structured Streaming sources."""

from ruleframe.streaming.stream import rules_on_stream, run_to_parquet, stream_rules

__all__ = ["rules_on_stream", "run_to_parquet", "stream_rules"]
