"""DataFrame operators: search, store, capture, graph, usages, reports."""
