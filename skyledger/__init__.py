"""Flight-trajectory and controller-decision analytics as Spark DataFrame operators."""
