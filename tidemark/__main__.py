"""Command line: ``python -m tidemark experiment wim GRAPH``, ``dataset``, ``matrix-market``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .graph import Graph
from .plans import experiment
from .sources import dataset, edges


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="tidemark")
    sub = top.add_subparsers(dest="command", required=True)
    e = sub.add_parser("experiment", help="run an experiment on a stored graph")
    e.add_argument("kind", choices=sorted(experiment.RUNS))
    e.add_argument("graph")
    e.add_argument("--config", help="JSON file with parameters; flags come on top")
    e.add_argument("--out", help="JSON file for the result")
    e.add_argument("--n-sketches", type=int, nargs="+")
    e.add_argument("--n-chosen", type=int, nargs="+")
    e.add_argument("--tries", type=int)
    e.add_argument("--salt", type=int)
    d = sub.add_parser("dataset", help="make a graph from a MatrixMarket file")
    d.add_argument("source")
    d.add_argument("target")
    d.add_argument("--config", help="JSON file with parameters")
    m = sub.add_parser("matrix-market", help="make a MatrixMarket folder from a text edge list")
    m.add_argument("source")
    m.add_argument("target")
    m.add_argument("--skip", type=int, default=0)
    m.add_argument("--directed", action=argparse.BooleanOptionalAction)
    args = top.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    text = None
    if getattr(args, "config", None):
        with open(args.config) as f:
            text = f.read()
    try:
        if args.command == "experiment":
            model, run = experiment.RUNS[args.kind]
            params = experiment.Params.of(text, n_sketches=args.n_sketches, n_chosen=args.n_chosen, tries=args.tries, salt=args.salt)
            out = experiment.to_json(run(Graph.read(spark, args.graph, model), params), params)
            if args.out:
                with open(args.out, "w") as f:
                    f.write(out)
            else:
                print(out)
        elif args.command == "dataset":
            dataset.create_dataset(edges.read_matrix_market(spark, args.source), dataset.DatasetParams.from_json(text or "{}")).write(args.target)
        else:
            edges.text_to_matrix_market(spark, args.source, args.target, args.skip, args.directed)
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
