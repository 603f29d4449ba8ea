"""Facades that join datasets, networks and systems: models and their layouts."""
