"""Dataflow operators on edges and vertex states."""
