"""Readers and writers of edge lists and results."""

from tidegraph.sources.edgelist import read_edges, register
from tidegraph.sources.results import render, save

__all__ = ["read_edges", "register", "render", "save"]
