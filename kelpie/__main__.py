"""Commands: python -m kelpie build|ask|evaluate|health."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from kelpie import config, providers, schemas
from kelpie.functions import chunking
from kelpie.plans import chat, evaluation, retrieve, stages
from kelpie.sources import files, shop


def build(spark: SparkSession, args: argparse.Namespace) -> str:
    """Chunks of both kinds and the index, as stages that don't stop each other."""
    made: dict = {}

    def products() -> None:
        made["products"] = chunking.product_chunks(files.read_json(spark, args.products, schemas.PRODUCT), files.read_json(spark, args.faqs, schemas.FAQ) if args.faqs else None)
        shop.write_json_array(made["products"], f"{args.out}/product_chunks", ["n"])

    def policies() -> None:
        made["policies"] = chunking.policy_chunks(files.read_json(spark, args.policies, schemas.POLICY))
        shop.write_json_array(made["policies"], f"{args.out}/policy_chunks", ["n"])

    def index() -> None:
        files.write_index(retrieve.build(made["products"], made["policies"]), f"{args.out}/index")

    return stages.summary(stages.run(spark, [("products", products), ("policies", policies), ("index", index)]))


def ask(spark: SparkSession, args: argparse.Namespace) -> str:
    own = providers.configured(spark)
    return json.dumps(chat.chat(spark, args.question, retrieve.open_index(spark, args.index), planner=own.planner, generate=own.generator), ensure_ascii=False, indent=2)


def evaluate(spark: SparkSession, args: argparse.Namespace) -> str:
    with open(args.golden, encoding="utf-8") as f:
        questions = evaluation.golden(spark, json.load(f))
    return evaluation.report(evaluation.evaluate_retrieval(questions, retrieve.open_index(spark, args.index), args.k)[1])


def health(spark: SparkSession, args: argparse.Namespace) -> str:
    return json.dumps(chat.health(spark, args.index).first().asDict())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    parser = argparse.ArgumentParser(prog="kelpie")
    commands = parser.add_subparsers(required=True)
    for f, flags, more in ((build, ["products", "policies", "out"], {"faqs": None}), (ask, ["index", "question"], {}), (evaluate, ["index", "golden"], {"k": config.EVAL_K}), (health, ["index"], {})):
        command = commands.add_parser(f.__name__, help=f.__doc__)
        command.set_defaults(run=f)
        for name in flags:
            command.add_argument(f"--{name}", required=True)
        for name, default in more.items():
            command.add_argument(f"--{name}", default=default, type=type(default) if default is not None else str)
    args = parser.parse_args(argv)
    return args.run(spark or SparkSession.builder.appName("kelpie").getOrCreate(), args)


if __name__ == "__main__":
    print(main())
