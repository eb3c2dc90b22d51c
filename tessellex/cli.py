"""Command line: run a query or a chain over files and write the result.

python -m tessellex.cli query NAME --data FOLDER --out FOLDER
python -m tessellex.cli patents --csv FOLDER --static FILE --out FOLDER [--dry-run]
python -m tessellex.cli hierarchy --vectors FOLDER --static FOLDER --out FOLDER [--config FILE]
python -m tessellex.cli list
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import catalog, config
from .session import local_session


def _session() -> SparkSession:
    """The cluster's session where one is configured, else a local one."""
    return SparkSession.getActiveSession() or (SparkSession.builder.getOrCreate() if os.environ.get("SPARK_MASTER") else local_session())


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def run_query(args: argparse.Namespace) -> None:
    catalog.queries()[args.name](_session(), args.data).write.mode("overwrite").parquet(args.out)


def run_patents(args: argparse.Namespace) -> None:
    """Raw CSV rows to titles, library and patents; a table that is there already is kept unless --again."""
    from .functions import arrays as A
    from .plans.pipelines import patents
    from .sources import scans, sinks

    spark = _session()
    # ids follow the order of files and rows
    rows = scans.dry_run_rows(spark).withColumn("place", F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")) if args.dry_run else scans.patents_csv(spark, args.csv)
    static = scans.level_file(spark, args.static).select("name", "id") if args.static else spark.createDataFrame([], "name string, id long")
    done = patents(rows, static, "publication_number", "title", "ipc_code", "place")
    for name, df in (("titles", done["titles"].drop("first")), ("library", done["library"].select("new_id", "name", "ipc_codes")), ("patents", done["patents"].select("patent_id", A.format_spans(F.col("spans")).alias("fot")))):
        if args.again or not _exists(spark, f"{args.out}/{name}"):
            sinks.write_tsv(df, f"{args.out}/{name}")


def run_hierarchy(args: argparse.Namespace) -> None:
    from .plans.pipelines import build_hierarchy

    spark, options = _session(), config.load(args.config)
    read = lambda path: spark.read.parquet(path)
    build_hierarchy(read(args.vectors), read(args.static), options.cluster_eps, options.cluster_least, options.parent_threshold).write.mode("overwrite").parquet(args.out)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("--data", required=True)
    q.add_argument("--out", required=True)
    p = sub.add_parser("patents")
    p.add_argument("--csv")
    p.add_argument("--static")
    p.add_argument("--out", required=True)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--again", action="store_true")
    h = sub.add_parser("hierarchy")
    h.add_argument("--vectors", required=True)
    h.add_argument("--static", required=True)
    h.add_argument("--out", required=True)
    h.add_argument("--config")
    sub.add_parser("list")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.queries())))
    else:
        {"query": run_query, "patents": run_patents, "hierarchy": run_hierarchy}[args.command](args)


if __name__ == "__main__":
    main()
