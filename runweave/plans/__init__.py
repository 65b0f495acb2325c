"""Query plans, engine statistics and run reports."""
