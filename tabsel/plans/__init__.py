"""Models, evaluation and the registered queries."""
