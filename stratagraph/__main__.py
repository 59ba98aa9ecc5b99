"""python -m stratagraph: list the registered queries, print the SQL of one, run one over a folder of tables; run strains as a project that can be resumed, and write its report."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import QUERIES, project, report
from .session import local_session, stage
from .sources import config


def _session(master: str) -> SparkSession:
    """A local session, or, with submit, that of spark-submit."""
    return SparkSession.builder.getOrCreate() if master == "submit" else local_session(master)


def _project(a: argparse.Namespace) -> project.Run:
    known = a.strains or config.names(a.folder, a.central)
    if not known:
        raise SystemExit(f"no strains in {a.folder}")
    given = {name: str(Path(a.annotations) / f"{name}.parquet") for name in project.ANNOTATIONS if (Path(a.annotations) / f"{name}.parquet").exists()} if a.annotations else {}
    return project.Run(_session(a.cpus), a.out, [config.load(s, a.folder, a.central) for s in known], a.markers, given, a.threshold, a.top_k, a.depth)


def _arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("folder", help="folder with a folder for each strain")
    p.add_argument("out", help="folder of the project")
    p.add_argument("--strains", nargs="*")
    p.add_argument("--central", help="one file with the configurations of all strains")
    p.add_argument("--markers", help="manifest of determinants")
    p.add_argument("--annotations", help=f"folder of Parquet tables with a strain column: {', '.join(project.ANNOTATIONS)}")
    p.add_argument("--threshold", type=float, default=0.7)
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--depth", type=int, default=4)
    p.add_argument("--cpus", default="*", help="cores of a local session, or submit for that of spark-submit")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="stratagraph", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries with the operators they use")
    sub.add_parser("sql", help="the SQL that gives the same rows").add_argument("name", choices=sorted(QUERIES))
    run = sub.add_parser("run", help="run a query; without --out its first rows are printed")
    run.add_argument("name", choices=sorted(QUERIES))
    run.add_argument("folder")
    run.add_argument("--out", help="folder for the result as Parquet")
    run.add_argument("--rows", type=int, default=20)
    run.add_argument("--cpus", default="*")
    strain = sub.add_parser("strain", help="make what isn't up to date of a project: layers, graph, hypergraph, traces, candidates")
    _arguments(strain)
    strain.add_argument("--until", help="last stage to make")
    written = sub.add_parser("report", help="the report of a project, and published counts that its tables don't agree with")
    _arguments(written)
    written.add_argument("--claims", help="CSV of metric, strain, relation, published")
    a = p.parse_args(args)
    if a.command == "list":
        for name, q in sorted(QUERIES.items()):
            print(f"{name}\t{q.operators}")
    elif a.command == "sql":
        if not QUERIES[a.name].sql:
            print(f"{a.name} has no SQL", file=sys.stderr)
            return 1
        print(QUERIES[a.name].sql.strip())
    elif a.command == "strain":
        run = _project(a)
        made = project.advance(run, a.until)
        for name, strains in made.items():
            print(f"{name}: {', '.join(strains)} ({run.seconds[name]:.1f} s)")
        if not made:
            print("all is up to date")
    elif a.command == "report":
        print(report.written(_project(a), a.claims))
    else:
        spark = _session(a.cpus)
        seconds: dict[str, float] = {}
        with stage(spark, a.name, seconds):
            df = QUERIES[a.name].run(spark, a.folder)
            if a.out:
                df.write.parquet(a.out)
            else:
                df.show(a.rows, truncate=False)
        print(f"{a.name}: {seconds[a.name]:.1f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
