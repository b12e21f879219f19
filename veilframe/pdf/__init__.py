"""PDF bytes to relations and back. Pure Python: nothing here imports Spark."""
