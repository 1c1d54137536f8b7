"""Recipes and the plans that turn them into column expressions over pixels."""
