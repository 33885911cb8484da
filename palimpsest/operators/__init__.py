"""DataFrame operators: ledger, retrieval, metrics, dataset building."""
