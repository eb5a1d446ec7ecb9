"""The reconciliation operators: netting, matching, adjustments, decomposition, decisions, ledger."""
