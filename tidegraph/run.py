"""From an edge file to results: ``python -m tidegraph.run --input g.el --algorithm sssp --source 2 --output out``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from tidegraph.config import EvolveConfig
from tidegraph.functions.semiring import SEMIRINGS
from tidegraph.operators import evolve
from tidegraph.plans import STRATEGIES
from tidegraph.session import Scratch
from tidegraph.sources import read_edges, save


def parser() -> argparse.ArgumentParser:
    own = EvolveConfig()
    p = argparse.ArgumentParser(prog="tidegraph", description=__doc__)
    p.add_argument("--input", required=True, help="edge list: .el, .wel, .txt, .bin or .parquet")
    p.add_argument("--output", help="folder for the results; without it, only the time is said")
    p.add_argument("--format", default="parquet", choices=("parquet", "csv", "text"))
    p.add_argument("--algorithm", default="sssp", choices=list(SEMIRINGS))
    p.add_argument("--strategy", default="reevaluate", choices=list(STRATEGIES))
    p.add_argument("--source", type=int, default=own.source)
    p.add_argument("--snap", type=int, default=own.snapshots, help="snapshots beside the first")
    p.add_argument("--init_percent", type=float, default=own.init_percent)
    p.add_argument("--delta_rate_add", type=float, default=own.add_percent, help="percent of all edges that each snapshot adds")
    p.add_argument("--delta_rate_del", type=float, default=own.del_percent, help="percent of all edges that each snapshot deletes")
    p.add_argument("--degree_limit", type=int, default=own.degree_limit)
    return p


def evolve_file(spark: SparkSession, path: str, cfg: EvolveConfig, scratch: Scratch) -> DataFrame:
    """Mirrored edges with lifetimes from an edge file; the weights of a weighted format are kept (the least of parallel edges)."""
    read = read_edges(spark, path)
    life = evolve.assign_lifetimes(evolve.canonical(read), cfg, scratch)
    edges = evolve.symmetrize(life, cfg.weight_modulus, cfg.snapshots)
    if "w" in read.columns:
        edges = evolve.with_weights(edges, read)
    return scratch.cut(edges.repartition("src"), "mirrored")


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """(sid, v, val) of the query that the arguments ask for; written to --output if there is one."""
    cfg = EvolveConfig(args.snap, args.init_percent, args.delta_rate_add, args.delta_rate_del, source=args.source, degree_limit=args.degree_limit)
    scratch = Scratch(spark, "run")
    edges = evolve_file(spark, args.input, cfg, scratch)
    began = time.perf_counter()
    out = scratch.cut(STRATEGIES[args.strategy](edges, SEMIRINGS[args.algorithm], cfg, scratch), "result")
    print(f">>Processing finished in {(time.perf_counter() - began) * 1000:.3f} (ms).")
    if args.output:
        save(out, args.output, args.format)
    return out


def main(argv: list[str] | None = None) -> None:
    run(SparkSession.builder.appName("tidegraph").getOrCreate(), parser().parse_args(argv))


if __name__ == "__main__":
    main()
