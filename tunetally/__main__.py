"""The jobs from the command line: `python -m tunetally <job> …`, also with spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunetally.operators import incremental, similarity
from tunetally.operators.decode import decode_text
from tunetally.plans import ingest, profiles, recommend
from tunetally.session import build_session, close_session


def _plays(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumnRenamed("song_id", "item_id")


def _show(parts: dict[str, DataFrame], order: dict[str, str]) -> None:
    for name, df in parts.items():
        print(f"\n{name}")
        if name in order:
            df = df.orderBy(order[name])
        # At most one row per column of the table, or a short list.
        df.show(max(df.count(), 1), truncate=False)


def _print_lines(lines: DataFrame, user: str) -> None:
    print(f"Recommendations for user: {user}")
    for row in lines.select("line").collect():  # at most n rows
        print(row["line"])


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tunetally")
    jobs = parser.add_subparsers(dest="job", required=True)

    plays = jobs.add_parser("ingest-plays", help="tab-separated plays to Parquet")
    plays.add_argument("source")
    plays.add_argument("target")
    plays.add_argument("--lenient", action="store_true", help="bad counts become null")

    for name, what in (
        ("ingest-songs", "song records to the typed table; bad records are dropped"),
        ("ingest-raw-songs", "song records to the raw table; bad fields become null"),
    ):
        songs = jobs.add_parser(name, help=what)
        songs.add_argument("source")
        songs.add_argument("target")
        songs.add_argument("--glob", default="*.json")
        songs.add_argument("--lines", action="store_true", help="one payload per line")
        songs.add_argument("--records", choices=("first", "all"), help="of an array of records")

    for name, what in (
        ("profile-plays", "profile of a plays table"),
        ("profile-songs", "profile of a typed song table"),
    ):
        table = jobs.add_parser(name, help=what)
        table.add_argument("table")
        table.add_argument("--exact", action="store_true", help="exact quartiles")

    titles = jobs.add_parser("titles", help="titles of a raw song table")
    titles.add_argument("table")
    titles.add_argument("-n", type=int, default=20)

    report = jobs.add_parser("recommend", help="recommendations for one user, with names")
    report.add_argument("plays")
    report.add_argument("songs", help="typed song table")
    report.add_argument("user")
    report.add_argument("-n", type=int, default=3)
    report.add_argument("-k", type=int, default=10)

    fit = jobs.add_parser("fit", help="nearest items of all items, to Parquet")
    fit.add_argument("plays")
    fit.add_argument("target")
    fit.add_argument("-k", type=int, default=10)

    ask = jobs.add_parser("recommend-from", help="recommendations for one user from fitted lists")
    ask.add_argument("neighbors", help="what `fit` has written")
    ask.add_argument("plays")
    ask.add_argument("songs", help="typed song table")
    ask.add_argument("user")
    ask.add_argument("-n", type=int, default=3)

    start = jobs.add_parser("start-lists", help="tables that keep nearest items up to date")
    start.add_argument("plays")
    start.add_argument("lists")
    more = jobs.add_parser("add-plays", help="add plays to the tables of `start-lists`")
    more.add_argument("lists")
    more.add_argument("plays")
    lists = jobs.add_parser("nearest-from-lists", help="nearest items from these tables, to Parquet")
    lists.add_argument("lists")
    lists.add_argument("target")
    lists.add_argument("-k", type=int, default=10)

    everyone = jobs.add_parser("recommend-all", help="recommendations for all users, to Parquet")
    everyone.add_argument("plays")
    everyone.add_argument("target")
    everyone.add_argument("-n", type=int, default=5)
    everyone.add_argument("-k", type=int, default=10)

    args = parser.parse_args(argv)
    spark = build_session(f"tunetally {args.job}")
    if args.job == "ingest-plays":
        done = ingest.ingest_plays(spark, args.source, args.target, strict=not args.lenient)
        print(f"{done.count()} plays")
    elif args.job == "ingest-songs":
        done = ingest.ingest_songs(
            spark, args.source, args.target, args.glob, not args.lines, args.records or "first"
        )
        print(f"{done.count()} songs")
    elif args.job == "ingest-raw-songs":
        done = ingest.ingest_raw_songs(
            spark, args.source, args.target, args.glob, not args.lines, args.records or "all"
        )
        print(f"{done.count()} songs")
    elif args.job == "profile-plays":
        parts = profiles.profile_plays(_plays(spark, args.table), args.exact)
        _show(parts, {"schema": "position"})
    elif args.job == "profile-songs":
        parts = profiles.profile_songs(spark.read.parquet(args.table), args.exact)
        _show(parts, {"schema": "position"})
    elif args.job == "titles":
        raw = decode_text(spark.read.parquet(args.table), "get_title")
        raw.select("get_title").show(args.n, truncate=False)
    elif args.job == "recommend":
        songs = spark.read.parquet(args.songs).withColumn("item_id", F.col("song_id"))
        lines = recommend.recommendation_report(
            _plays(spark, args.plays), songs, args.user, ["track_id"], args.n, args.k
        )
        _print_lines(lines, args.user)
    elif args.job == "fit":
        cells = similarity.interaction_matrix(_plays(spark, args.plays))
        similarity.nearest_items(cells, args.k).write.mode("overwrite").parquet(args.target)
    elif args.job == "recommend-from":
        songs = spark.read.parquet(args.songs).withColumn("item_id", F.col("song_id"))
        near = spark.read.parquet(args.neighbors)
        best = recommend.recommend_from(near, _plays(spark, args.plays), args.user, args.n)
        _print_lines(recommend.report(best, songs, ["track_id"]), args.user)
    elif args.job == "start-lists":
        incremental.start(_plays(spark, args.plays), args.lists)
    elif args.job == "add-plays":
        print(f"version {incremental.add(spark, args.lists, _plays(spark, args.plays))}")
    elif args.job == "nearest-from-lists":
        near = incremental.nearest_items(spark, args.lists, args.k)
        near.write.mode("overwrite").parquet(args.target)
    elif args.job == "recommend-all":
        best = recommend.recommend_all(_plays(spark, args.plays), args.n, args.k)
        best.write.mode("overwrite").parquet(args.target)


if __name__ == "__main__":
    try:
        main()
    finally:
        active = SparkSession.getActiveSession()
        if active:
            close_session(active)
