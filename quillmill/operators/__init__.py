"""DataFrame operators: text, code, routing, cache, security, privacy, analytics."""
