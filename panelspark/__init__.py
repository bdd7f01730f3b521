"""Spark library for entity x week panels."""
