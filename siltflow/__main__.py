"""python -m siltflow run | ask | clean | reset"""

from __future__ import annotations

import argparse
import shutil
import sys
from pathlib import Path

from .plans import config


def ask(data: Path, command: str, what: str) -> int:
    from pyspark.sql import SparkSession, functions as F

    from .functions.naming import FORMATS
    from .operators.stats import user_stats
    from .plans import users
    from .schemas import USERS
    from .sources.files import Store, listing

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    files = lambda name: listing(spark, str(data / name)).drop("content") if (data / name).is_dir() else spark.createDataFrame([], "path string, name string, modified timestamp, size long")
    known = Store(spark, str(data / "state")).read("users", USERS)
    found = {
        "latest": lambda: users.latest(files("output")),
        "get": lambda: users.files_for(files("output"), files("archive"), what, F.current_timestamp()).drop("path"),
        "formats": lambda: users.formats_there(files("output"), tuple(FORMATS)),
        "myinfo": lambda: users.info(known, what),
        "stats": lambda: user_stats(known),
    }[command]()
    for row in found.toJSON().toLocalIterator():
        print(row)
    return 0


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siltflow")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("run", "ingest, transform, build, export"), ("clean", "delete outputs and stored blobs"), ("reset", "delete all, the state too")):
        s = sub.add_parser(name, help=text)
        s.add_argument("--data", required=True)
        if name == "run":
            s.add_argument("--config", required=True)
            s.add_argument("--feed", required=True)
            s.add_argument("--all", action="store_true", help="build from all records, not from the new files only")
        if name == "reset":
            s.add_argument("--yes", action="store_true", help="don't ask to type RESET")
        if name == "run":
            s.add_argument("--timeout", type=float, help="seconds for reading; what was read is built")
            s.add_argument("--keep-stale", action="store_true", help="keep outputs of the routes that this run doesn't make")
    s = sub.add_parser("ask", help="what a user's command returns, as JSON lines")
    s.add_argument("--data", required=True)
    s.add_argument("command_", metavar="what", choices=("latest", "get", "formats", "myinfo", "stats"))
    s.add_argument("what", nargs="?", default="npvt", help="the format to get, or the user")
    a = p.parse_args(args)
    data = Path(a.data)
    if a.command == "ask":
        return ask(data, a.command_, a.what)
    if a.command == "run":
        from pyspark.sql import SparkSession

        from .plans.run import Options, once

        once(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), config.load(a.config), a.feed, a.data, options=Options(delta=not a.all, timeout=a.timeout, remove_stale=not a.keep_stale))
        return 0
    if a.command == "reset" and not a.yes and input("Type RESET to delete everything: ") != "RESET":
        return 1
    for name in ("output", "archive", "rejects", "state/blobs") if a.command == "clean" else ("output", "archive", "history", "rejects", "state", "checkpoint"):
        shutil.rmtree(data / name, ignore_errors=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
