"""Command line: ``python -m postlake.cli score|files|train|query|replay ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from postlake.operators import classifier, media, scoring
from postlake.plans import registry
from postlake.plans.posts import N, templates
from postlake.streaming import replay


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="postlake")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("score", help="posts (text and context, Parquet) to labels, probabilities and flags")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--model", help="a saved classifier")
    c.add_argument("--threshold", type=float, default=0.6)
    c = sub.add_parser("files", help="files of a folder to labels, categories and tags")
    c.add_argument("source")
    c.add_argument("target")
    c = sub.add_parser("train", help="rows (doc_id, text, label, Parquet) to a saved classifier")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--max-features", type=int, default=40000)
    c.add_argument("--balanced", action="store_true")
    c = sub.add_parser("query", help="a registered query over a folder of tables")
    c.add_argument("name", choices=sorted(registry.queries()))
    c.add_argument("source")
    c.add_argument("target")
    c = sub.add_parser("replay", help="example posts as a load of so many seconds")
    c.add_argument("checkpoint")
    c.add_argument("--seconds", type=float, default=5.0)
    c.add_argument("--batch", type=int, default=25)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    s = spark or SparkSession.builder.appName("postlake").getOrCreate()
    if a.command == "replay":
        seen = replay.replay(templates(s), "tpl_id", N, lambda x: scoring.score_posts(x, aspects=False), a.checkpoint, a.seconds, a.batch)
        print(json.dumps(replay.report(seen, a.seconds)))
        return
    if a.command == "train":
        classifier.fit(s.read.parquet(a.source), max_features=a.max_features, balanced=a.balanced).save(s, a.target)
        return
    if a.command == "score":
        x = s.read.parquet(a.source)
        x = x if "context" in x.columns else x.withColumn("context", F.lit(None).cast("string"))
        out = scoring.score_posts(x, a.threshold, model=classifier.load(s, a.model) if a.model else None)
    elif a.command == "files":
        out = media.analyze_files(s, a.source, media.png_visual(s, a.source))
    else:
        out = registry.queries()[a.name](s, a.source)
    out.write.mode("errorifexists").parquet(a.target)


if __name__ == "__main__":
    main()
