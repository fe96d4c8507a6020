"""The telemetry operators over an unbounded stream."""
