"""Column expressions: text, risk ranks, log fields, alert wording, JSON."""
