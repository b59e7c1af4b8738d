"""DataFrame operators: keyed state, messages, statistics, search."""
