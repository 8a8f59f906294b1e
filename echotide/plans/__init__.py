"""Plug-in registry and whole runs from a configuration."""
