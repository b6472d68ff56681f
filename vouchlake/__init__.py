"""Document-evidence analytics on Spark: identifiers, rules, reconciliation, evaluation."""
