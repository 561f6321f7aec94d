"""Dialogue, narrative and corpus analytics as composable Spark DataFrame transforms."""
