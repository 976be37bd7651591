"""Life-cycle-assessment analytics on Spark."""
