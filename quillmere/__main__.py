"""``python -m quillmere ROOT VERB …``: index, search, activity, metrics, trends, fluency, glance, themes, threads, rooms, status, forget, sweep."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from .engine import Engine
from .store import GRACE


def main() -> None:
    p = argparse.ArgumentParser(prog="quillmere")
    p.add_argument("root")
    verbs = p.add_subparsers(dest="verb", required=True)
    index = verbs.add_parser("index")
    index.add_argument("source")
    index.add_argument("folder")
    find = verbs.add_parser("search")
    find.add_argument("query")
    find.add_argument("--mode", default="hybrid", choices=["lexical", "semantic", "hybrid"])
    find.add_argument("-k", type=int, default=10)
    verbs.add_parser("forget").add_argument("session_key", nargs="+")
    verbs.add_parser("sweep").add_argument("--grace", type=float, default=GRACE, help="seconds for which readers may hold an older state")
    for name in ("status", "metrics", "threads", "rooms", "themes", "activity"):
        verbs.add_parser(name)
    for name in ("trends", "fluency", "glance"):
        verbs.add_parser(name).add_argument("--as-of", type=dt.date.fromisoformat, required=True)
    a = p.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, a.root)
    if a.verb == "index":
        print(engine.index(a.source, a.folder))
    elif a.verb == "search":
        engine.search(a.query, a.mode, a.k).select("score", "title", "tool", "snippet").show(a.k, truncate=120)
    elif a.verb == "forget":
        engine.forget(a.session_key)
    elif a.verb == "sweep":
        print(engine.sweep(a.grace))
    elif a.verb in ("trends", "fluency", "glance"):
        getattr(engine, a.verb)(a.as_of).show(50, truncate=80)
    else:
        getattr(engine, a.verb)().show(50, truncate=80)


if __name__ == "__main__":
    main()
