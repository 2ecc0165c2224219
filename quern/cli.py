"""Command line: facts in a folder, new texts out.

    spark-submit -m quern.cli FACTS [-p PATH]... [--regex R --replacement T] [-n] [--check] [--force] [--out FOLDER]

The exit code is 0 when all is done or nothing was to do, 1 when something failed or a file is
blocked, 2 when --check finds files to adjust.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.model import FileProcessError, Settings
from quern.plans import session
from quern.sources.tables import encode_bodies, parse_settings, read_facts


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quern", description="Adjusts namespaces to folders.")
    p.add_argument("facts", help="folder with one <relation>.parquet each")
    p.add_argument("-p", "--path", action="append", default=[], help="only this file, or the files below this folder; may be repeated")
    p.add_argument("--project", help="only the files of this project file")
    p.add_argument("--regex", default="", help="rename of target namespaces; needs --replacement")
    p.add_argument("--replacement", default="")
    p.add_argument("--settings", help="text file with skipped folders")
    p.add_argument("--solution-folder", default="")
    p.add_argument("-n", "--dry-run", action="store_true", help="report only")
    p.add_argument("--check", action="store_true", help="report only; exit code 2 if files have to be adjusted")
    p.add_argument("--force", action="store_true", help="adjust although the solution has errors")
    p.add_argument("--out", help="folder for new bodies (Parquet: path, content)")
    p.add_argument("-v", "--verbose", action="store_true", help="also list blocked files' reasons")
    return p


def report(scan: DataFrame, verbose: bool) -> Iterator[str]:
    """Planned and blocked files by path, all of them, and the totals; lines are fetched a partition at a time."""
    for outcome, text in (("plan", F.concat_ws(" -> ", "path", "target_ns")), ("block", F.concat_ws(": ", "path", "message"))):
        rows = scan.where(F.col("outcome") == outcome)
        n = 0
        for n, r in enumerate(rows.orderBy("path").select(text).toLocalIterator(), 1):
            if outcome == "plan" or verbose:
                yield r[0]
        yield f"{outcome}: {n} file(s)"


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quern").getOrCreate()
    facts = read_facts(spark, args.facts)
    if args.path:
        facts.tables["path_root"] = spark.createDataFrame([(p,) for p in args.path], "root string")
    xml = None
    if args.settings:
        rows = spark.read.text(args.settings, wholetext=True).take(1)
        xml = rows[0][0] if rows else None
    settings = Settings(parse_settings(xml, args.solution_folder), args.regex, args.replacement, args.dry_run, args.check, args.force)
    try:
        out = session.run(facts, settings, args.project)
        for line in out.said:
            print(line)
        if out.scan is not None:
            for line in report(out.scan, args.verbose):
                print(line)
        if out.bodies is not None and args.out:
            # a task's files are in place as soon as it is done, so texts written before a stop are kept
            encode_bodies(out.bodies).write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(args.out)
    except KeyboardInterrupt:
        spark.sparkContext.cancelAllJobs()
        print("Cancelled; what was written is kept.")
        return session.ERROR
    except FileProcessError as e:
        print(e)
        return session.ERROR
    except PySparkException as e:
        if (found := FileProcessError.found_in(str(e))) is None:
            raise
        print(found)
        return session.ERROR
    return out.exit_code


if __name__ == "__main__":
    sys.exit(main())
