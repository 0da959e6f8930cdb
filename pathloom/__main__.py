"""Command line: build a path bank, answer questions from one, or evaluate results.

Models are named as module:function, a factory of generators or encoders that workers can import.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import SparkSession

from .operators import evaluate
from .operators.memo import Memo, Remembered
from .plans import inference, pathbank
from .sources import jsonl, kg, schemas
from .sources.result_log import ResultLog


def named(text: str) -> Callable:
    module, _, function = text.partition(":")
    return getattr(importlib.import_module(module), function)


def parser() -> argparse.ArgumentParser:
    own = pathbank.Config()
    out = argparse.ArgumentParser(prog="pathloom", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    build = commands.add_parser("build", help="path bank of the questions of a JSON-lines file")
    build.add_argument("--kg", required=True, help="folder of a graph store")
    build.add_argument("--questions", required=True)
    build.add_argument("--output", required=True)
    build.add_argument("--limit", type=int)
    build.add_argument("--beta", type=float, default=own.beta, help="a relation's share of an edge's weight")
    build.add_argument("--damping", type=float, default=own.damping)
    build.add_argument("--seeds", default=own.seeds, choices=("bidirectional", "uniform", "degree_inv", "degree_proportional"), help="a run from each end, or one from both with these resets")
    build.add_argument("--combine", default=own.combine, choices=("product", "rank_product"))
    build.add_argument("--floor", type=float, default=own.floor, help="residual under which a node waits")
    build.add_argument("--ladder", type=lambda s: tuple(map(int, s.split(","))), default=own.ladder, help="widths of corridors, by commas")
    build.add_argument("--k", type=int, default=own.k)
    build.add_argument("--k-per-hop", type=int, default=own.k_per_hop)
    build.add_argument("--max-hops", type=int, default=own.max_hops)
    build.add_argument("--order", default=own.order, choices=("hops", "raw"))
    build.add_argument("--raw-by-hop", type=int, default=own.raw_by_hop)
    build.add_argument("--alpha", type=float, default=own.alpha, help="an edge weight's share of a mixed cost")
    build.add_argument("--dedup", default=own.dedup, choices=("none", "type_sig", "first_type"))
    build.add_argument("--cost-mode", default=own.cost_mode, choices=("edge_weight", "ppr_only", "ppr_mix"))

    infer = commands.add_parser("infer", help="answers to the questions of a JSON-lines file, in batches that are added to a log; run again, it goes on where it was")
    for name in ("--kg", "--questions", "--trains", "--bank", "--output"):
        infer.add_argument(name, required=True)
    infer.add_argument("--generator", required=True, help="module:function")
    infer.add_argument("--encoder", required=True, help="module:function")
    infer.add_argument("--memo", help="folder of responses that are kept; equal prompts are asked once")
    infer.add_argument("--model", default="model", help="name of the model in the memo")
    infer.add_argument("--limit", type=int)
    infer.add_argument("--batches", type=int, default=1)
    infer.add_argument("--matched", type=int, default=inference.Config.matched)
    infer.add_argument("--width", type=int, default=inference.Config.width)
    infer.add_argument("--depth", type=int, default=inference.Config.depth)
    infer.add_argument("--subqueries", action="store_true")

    score = commands.add_parser("evaluate", help="accuracy by hop of a result file or log")
    score.add_argument("--kg", required=True)
    score.add_argument("--gold", required=True)
    score.add_argument("--results", required=True)
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("pathloom").getOrCreate()
    store = kg.Store(spark, args.kg)
    nodes = store.read("nodes")
    if args.command == "build":
        records = jsonl.questions(spark, args.questions, limit=args.limit)
        config = pathbank.Config(**{k: v for k, v in vars(args).items() if k in pathbank.Config.__dataclass_fields__})
        bank = pathbank.build(records, nodes, store.read("edges"), store.read("relations"), config)
        jsonl.write(pathbank.export(bank, records, nodes), args.output)
    elif args.command == "infer":
        factory = named(args.generator)
        if args.memo:
            factory = Remembered(factory, Memo(spark, args.memo, args.model))
        tests, trains = (jsonl.questions(spark, path, limit=limit) for path, limit in ((args.questions, args.limit), (args.trains, None)))
        config = inference.Config(matched=args.matched, width=args.width, depth=args.depth, subqueries=args.subqueries)
        log = ResultLog(spark, args.output, schemas.RESULT)
        bank = jsonl.path_bank(jsonl.read(spark, args.bank, schemas.PATH_BANK))
        print(f"{inference.logged(log, tests, trains, bank, nodes, store, factory, named(args.encoder), args.batches, config)} of {args.batches} batches run")
    else:
        gold = evaluate.valid_names(jsonl.last_of_each(jsonl.questions(spark, args.gold), "data_id"), nodes)
        log = ResultLog(spark, args.results, "data_id string, results string")
        results = log.read() if log.batches() else jsonl.read(spark, args.results, "data_id string, results string")
        evaluate.by_hop(evaluate.judged(results, gold)).orderBy("num_hops").show(truncate=False)


if __name__ == "__main__":
    main()
