"""Event-timeline analytics over long recordings, written for Spark."""
