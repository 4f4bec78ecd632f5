"""Plan-shaping helpers (size-checked broadcast) and the registered queries."""
