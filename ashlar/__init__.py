"""Ashlar: content-addressed data operations as Spark DataFrame programs."""
