"""Plans composed of operators: facts, metric layer, services."""
