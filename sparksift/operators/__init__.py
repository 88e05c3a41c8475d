"""Facts, metrics, rules and the algebra of findings."""
