"""Jobs composed from operators: Bronze, Silver, Gold, business queries, mart."""
