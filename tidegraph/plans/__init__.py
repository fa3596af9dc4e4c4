"""Interchangeable strategies: each returns (sid, v, val) for snapshots 0..S."""

from tidegraph.plans.strategies import STRATEGIES, common_graph, concurrent_common_graph, incremental, proxy_two_stage, reevaluate

__all__ = ["STRATEGIES", "common_graph", "concurrent_common_graph", "incremental", "proxy_two_stage", "reevaluate"]
