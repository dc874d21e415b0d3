"""Fleet analytics as DataFrame operators: placement, profiles, state folds, content, trust and streams."""
