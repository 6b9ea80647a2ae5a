"""terradelta: change detection between map snapshots, as PySpark queries."""
