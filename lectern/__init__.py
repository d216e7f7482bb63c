"""Lectern: narration-corpus analytics expressed as Spark DataFrame jobs."""
