"""Document-ledger reconciliation as Spark DataFrame operators."""
