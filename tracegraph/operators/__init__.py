"""DataFrame operators of the trace dataflow (lines, extraction, validation,
coverage, rewrite)."""
