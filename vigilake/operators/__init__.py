"""DataFrame operators: classification, policy evaluation, receipts, traces, history."""
