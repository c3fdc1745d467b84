"""Patch planning between snapshots."""
