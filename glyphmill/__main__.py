"""The steps from the command line: ``python -m glyphmill COMMAND --root FOLDER ...``.

Artifacts are kept under the root, which all executors must share; each step reads what the ones before it have stored.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from glyphmill.functions import scalars
from glyphmill.operators import nextword, subword
from glyphmill.plans import flows, views
from glyphmill.plans.observe import logger, span
from glyphmill.sources import catalog
from glyphmill.sources.catalog import Catalog

SIZES = (1400, 10_000, 10)


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError(f"{text} is not a positive number")
    return n


def vocab_size(text: str) -> int:
    n = positive(text)
    if n < subword.MIN_VOCAB:
        raise argparse.ArgumentTypeError(f"a vocabulary has {subword.MIN_VOCAB} pieces at least")
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glyphmill", description=__doc__.splitlines()[0])
    top.add_argument("--root", default=os.environ.get("GLYPHMILL_ROOT"), help="folder of all artifacts; GLYPHMILL_ROOT if not given")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, /, **options) -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=about, description=about)
        for flag, how in options.items():
            made.add_argument(f"--{flag.replace('_', '-')}", **how)
        return made

    tables = {"required": True, "help": "folder of documents.parquet and labels.parquet"}
    command("describe", "schema and first rows of the corpus", tables=tables)
    command("prepare", "store the normalised corpus", tables=tables)
    command("compare", "sampled sentences before and after normalisation", tables=tables, sample={"type": positive, "default": 10}, seed={"type": int, "default": 0})
    command("weights", "distance weights as a table", most={"type": positive, "default": 100})
    command("sweep", "fit a vocabulary for each size and report on each", low={"type": positive, "default": SIZES[0]}, high={"type": positive, "default": SIZES[1]}, steps={"type": positive, "default": SIZES[2]})
    command("vocabulary", "fit the final vocabulary", size={"type": vocab_size, "required": True})
    command("vectorise", "store context windows", width={"type": positive, "default": scalars.WINDOW}, slide={"type": positive, "default": 1})
    command("windows", "sampled windows with their words", sample={"type": positive, "default": 5}, seed={"type": int, "default": 0})
    command("svd", "report on truncated SVD by dimension", step={"type": positive, "default": 200}, least={"type": positive, "default": 1000})
    command("pca", "report on PCA of one dimension", dim={"type": positive, "required": True})
    command("train", "train the network", mode={"choices": ("reset", "continue"), "default": "reset"}, epochs={"type": positive, "default": nextword.EPOCHS}, batch={"type": positive, "default": nextword.BATCH})
    command("generate", "generate text", mode={"choices": ("none", "none10", "take"), "default": "none"}, text={"default": ""}, seed={"type": int, "default": 0}, top_k={"type": int, "default": 2}, temperature={"type": float, "default": 1.0})
    command("view", "a stored TSV report as a table", report={"required": True, "help": "its name under the root"})
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    """What the command prints."""
    store, a = Catalog(args.root), args

    def stored(name: str) -> DataFrame:
        return spark.read.parquet(store.path(name))

    def model() -> tuple[subword.Vocabulary, int]:
        found = subword.load_model(spark, store.path("model_final"))
        return found, len(found)

    if a.command == "describe":
        return views.described(catalog.corpus(spark, a.tables))
    if a.command == "prepare":
        return f"{flows.prepare(spark, catalog.corpus(spark, a.tables), store).count()} sentences"
    if a.command == "compare":
        found, missing = views.before_and_after(catalog.corpus(spark, a.tables), stored("corpus_normalized"), a.sample, a.seed)
        if missing:
            logger().warning("%d of the sampled sentences are not in the normalised corpus", missing)
        return views.console_table(found)
    if a.command == "weights":
        catalog.write_tsv(scalars.distance_weights(spark, a.most).coalesce(1), store.path("distance_weights"))
        return views.console_table(scalars.distance_weights(spark, a.most).orderBy("d"))
    if a.command == "sweep":
        sizes = [r.vocab_size for r in scalars.vocab_grid(spark, a.low, a.high, a.steps).orderBy("i").collect()]
        return views.console_table(flows.sweep(spark, stored("corpus_normalized"), sizes, store).orderBy("vocab_size"))
    if a.command == "vocabulary":
        flows.final_vocabulary(spark, stored("corpus_normalized"), a.size, store)
        return "\n".join(r.value for r in spark.read.text(store.path("vocab_info")).collect())
    if a.command == "vectorise":
        return f"{flows.vectorise(spark, stored('corpus_normalized'), model()[0], store, a.width, a.slide).count()} windows"
    if a.command == "windows":
        return views.console_table(views.window_sample(stored("context_windows"), stored("vocab_final"), a.sample, a.seed))
    if a.command == "svd":
        return views.console_table(flows.compress(spark, stored("context_windows"), model()[1], store, a.step, a.least))
    if a.command == "pca":
        return views.console_table(flows.compress_pca(spark, stored("context_windows"), model()[1], a.dim, store))
    if a.command == "train":
        _, log = flows.train(stored("context_windows"), model()[1], store, mode=a.mode, epochs=a.epochs, batch_size=a.batch)
        return "\n".join(f"{epoch}\t{loss:.8f}\t{accuracy:.8f}" for epoch, loss, accuracy in log)
    if a.command == "generate":
        last = nextword.last_saved(spark, store.path("training"))
        if not last:
            raise FileNotFoundError(f"no trained weights under {store.path('training')}")
        weights = nextword.read_weights(spark.read.parquet(f"{store.path('training')}/epoch={last}"))
        lines = flows.generate(spark, weights, model()[0], a.mode, a.text, a.seed, store, top_k=a.top_k, temperature=a.temperature)
        return "\n".join(r.value for r in lines.collect())
    return views.console_table(spark.read.option("sep", "\t").option("header", True).csv(store.path(a.report)))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.root:
        parser().error("--root or GLYPHMILL_ROOT is needed")
    spark = spark or SparkSession.builder.appName("glyphmill").getOrCreate()
    with span(args.command):
        print(run(spark, args))
    return 0


if __name__ == "__main__":
    sys.exit(main())
