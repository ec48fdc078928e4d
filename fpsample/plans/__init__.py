"""Recipes for plans that Spark has no operator for."""
