"""python -m corvane COMMAND: index, append, kg-build, community-build, archrag-build, archrag-index, ask, eval, models."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .cluster import ship
from .engine import Engine
from .operators.metrics import run_summary
from .settings import Settings
from .sources import io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvane")
    p.add_argument("--root", help="the collection's folder")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "append", "archrag-index"):
        c = sub.add_parser(name)
        c.add_argument("folder")
        c.add_argument("--pattern", default="*.pdf")
        c.add_argument("--force", action="store_true")
    for name in ("kg-build", "community-build", "archrag-build", "models"):
        sub.add_parser(name)
    c = sub.add_parser("ask")
    c.add_argument("question")
    c.add_argument("--retrieval-mode")
    c.add_argument("--k", type=int)
    c.add_argument("--session")
    c = sub.add_parser("eval")
    c.add_argument("dataset")
    c.add_argument("--output", required=True)
    c.add_argument("--retrieval-mode")
    c.add_argument("--query-field", default="question")
    c.add_argument("--k", type=int)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    args = parser().parse_args(argv)
    settings = Settings.from_env()
    if args.root:
        settings = Settings(**{**settings.__dict__, "root": args.root})
    engine = Engine(ship(spark or SparkSession.builder.getOrCreate()), settings)
    if args.command in ("index", "append", "archrag-index"):
        pages = io.read_pages(engine.spark, args.folder, io.pdf_pages if args.pattern.endswith(".pdf") else io.plain_text_pages, args.pattern)
        if args.command == "index":
            out = {"chunks": engine.build_index(pages, args.force)}
        elif args.command == "append":
            out = {r.source: r.n_chunks for r in engine.append(pages).collect()}
        else:
            engine.build_all(pages, args.force)
            out = engine.status()
    elif args.command == "kg-build":
        out = {"entities": engine.build_graph().entities.count()}
    elif args.command == "community-build":
        out = {"communities": engine.build_communities()}
    elif args.command == "archrag-build":
        out = {"levels": engine.build_hierarchy().top() + 1}
    elif args.command == "models":
        out = {"embedder": type(engine.embedder).__name__, "extractor": type(engine.extractor).__name__, "generator": type(engine.generator).__name__ if engine.generator else None}
    elif args.command == "ask":
        out = engine.ask(args.question, args.retrieval_mode, args.k, args.session)
    else:
        rows = engine.evaluate(io.read_dataset(engine.spark, args.dataset, args.query_field), args.k, args.retrieval_mode)
        io.write_evaluation(rows, args.output, {"run_id": engine.spark.sparkContext.applicationId, "query_field": args.query_field})
        out = run_summary(rows.selectExpr("target_paper_hit AS hit", "all_target_papers_hit AS all_hit", "target_paper_recall AS recall", "mrr_target_paper AS mrr")).first().asDict()
    print(json.dumps(out, ensure_ascii=False, default=str))
    return out


if __name__ == "__main__":
    main()
