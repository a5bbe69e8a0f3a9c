"""Command line: one subcommand a stage, over Parquet tables in folders."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from tiesmith import stages
from tiesmith.operators import render
from tiesmith.operators.density import COMPONENTS, GRID, NEIGHBOURS, SETTING
from tiesmith.session import session
from tiesmith.sources import files
from tiesmith.sources.wiki import WikiClient, people_query


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tiesmith", description=__doc__)
    top.add_argument("--master", help="Spark master; the cluster's own if left out")
    sub = top.add_subparsers(dest="stage", required=True)

    def stage(name: str, *flags: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("--src", default="data")
        p.add_argument("--out", default="data")
        if "limit" in flags:
            p.add_argument("--limit", type=int, help="first rows by key, most frequent titles in resolve; 0 keeps none")
        if "web" in flags:
            p.add_argument("--contact", required=True)
            p.add_argument("--delay", type=float, default=1.0)
        return p

    given = stage("seed", "web").add_mutually_exclusive_group(required=True)
    given.add_argument("--query", type=Path, help="file with a query for ?person ?article ?birthYear ?deathYear ?gender")
    given.add_argument("--occupation", help="item of an occupation, such as Q169470; narrower ones count too")
    p = stage("estimate", "web")
    p.add_argument("--sample", type=int, default=40)
    stage("fetch", "web", "limit")
    stage("clean").add_argument("--lenient", action="store_true")
    stage("resolve", "web", "limit")
    stage("segment", "limit")
    p = stage("mentions", "limit")
    p.add_argument("--lenient", action="store_true")
    p.add_argument("--most-people", type=int, default=6)
    p = stage("cluster", "limit")
    p.add_argument("--components", type=int, default=15)
    p.add_argument("--least-size", type=int, default=5)
    p.add_argument("--method", choices=("eom", "leaf"), default="eom")
    p.add_argument("--neighbours", type=int, default=15)
    p.add_argument("--metric", choices=("cosine", "euclidean"), default="cosine")
    p = stage("cluster-sweep")
    p.add_argument("--limit", type=int, default=5000)
    p.add_argument("--components", type=int, nargs="+", default=list(COMPONENTS))
    p.add_argument("--neighbours", type=int, nargs="+", default=list(NEIGHBOURS))
    p.add_argument("--sizes", type=int, nargs="+", default=sorted({size for size, _ in GRID}))
    p.add_argument("--best", type=int, default=0, help="settings whose clusters are shown with typical sentences")
    stage("cluster-summary")
    stage("detect-attributes", "limit")
    stage("assemble-relations").add_argument("--least-coverage", type=float, default=0.5)
    stage("relations-summary")
    p = stage("render-graph")
    p.add_argument("--institution", required=True)
    p.add_argument("--high-coverage-only", action="store_true")
    p.add_argument("--engine", help="Graphviz layout; without it only DOT text is written")
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = session("tiesmith", a.master)
    client = WikiClient(a.contact, delay=a.delay) if hasattr(a, "contact") else None
    if a.stage == "cluster-summary":
        rows = spark.read.parquet(files.join(a.src, "cluster_summary.parquet")).orderBy("size", ascending=False)
        print(render.clusters(list(rows.toLocalIterator())))
        return 0
    if a.stage == "relations-summary":
        from tiesmith.operators.assemble import rendered

        found = False
        for r in rendered(spark.read.parquet(files.join(a.src, "relations.parquet"))).orderBy("relation_id").toLocalIterator():
            print(r.block + "\n")
            found = True
        print("" if found else "(no relations)", end="")
        return 0
    run = {
        "seed": lambda: stages.run_seed(spark, a.out, client, people_query(a.occupation) if a.occupation else a.query.read_text(encoding="utf-8")),
        "estimate": lambda: stages.run_estimate(spark, a.out, client, [r.title for r in spark.read.parquet(files.join(a.src, "seed.parquet")).toLocalIterator()], a.sample),
        "fetch": lambda: stages.run_fetch(spark, a.src, a.out, client, a.limit),
        "clean": lambda: stages.run_clean(spark, a.src, a.out, not a.lenient),
        "resolve": lambda: stages.run_resolve(spark, a.src, a.out, client, a.limit),
        "segment": lambda: stages.run_segment(spark, a.src, a.out, a.limit),
        "mentions": lambda: stages.run_mentions(spark, a.src, a.out, not a.lenient, a.most_people, a.limit),
        "cluster": lambda: stages.run_cluster(spark, a.src, a.out, a.components, a.least_size, a.method, a.limit, a.neighbours, a.metric),
        "cluster-sweep": lambda: stages.run_sweep(spark, a.src, a.out, a.components, [(s, m) for s in a.sizes for m in ("eom", "leaf")], a.limit, a.neighbours, best=a.best),
        "detect-attributes": lambda: stages.run_attributes(spark, a.src, a.out, a.limit),
        "assemble-relations": lambda: stages.run_assemble(spark, a.src, a.out, a.least_coverage),
        "render-graph": lambda: stages.run_graph(spark, a.src, a.out, a.institution, a.high_coverage_only, a.engine),
    }[a.stage]
    print(json.dumps(run(), indent=2, ensure_ascii=False, default=str))
    if a.stage == "cluster-sweep":
        results = spark.read.parquet(files.join(a.out, "sweep_results.parquet")).orderBy("largest_cluster_fraction", *SETTING).collect()
        print(render.sweep_table(results, SETTING))
        if a.best:
            print(render.sweep_exemplars(spark.read.parquet(files.join(a.out, "sweep_exemplars.parquet")).collect(), SETTING))
    return 0


if __name__ == "__main__":
    sys.exit(main())
