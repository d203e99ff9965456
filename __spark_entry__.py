"""

The given tables stand in for the two music tables:

* plays: `lineitem` with the buyer of its order, quantity as play count;
* songs: `part`, with brand as artist and name as title.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunetally.functions.columns import base_name
from tunetally.operators import (
    bounded,
    decode,
    ids,
    incremental,
    profile,
    projections,
    ragged,
    reaching,
    similarity,
    sketches,
)
from tunetally.plans import ingest, recommend
from tunetally.session import materialize, new_folder
from tunetally.sources import files, keyed, plays as plays_text
from tunetally.streaming import ingest as new_files

# Operators for training data are a package of their own that may be absent; what it needs
# itself may not.
OPTIONAL = {"tunetally.llm", "tunetally.llm.queries", "corpus_pipeline"}
try:
    from tunetally.llm import queries as llm_queries
except ImportError as error:
    if error.name not in OPTIONAL:
        raise
    llm_queries = None
try:
    import corpus_pipeline
except ImportError as error:
    if error.name not in OPTIONAL:
        raise
    corpus_pipeline = None

ENTRY_DIR = "/root/testdata/sf0.001"
USER = 13
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
PAYLOAD = T.StructType([T.StructField("k", T.IntegerType())])


# ---------------------------------------------------------------- stand-in tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    buyers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return items.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_quantity").cast("int").alias("play_count"),
    )


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_brand").alias("artist_name"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("release"),
        F.col("p_size").alias("year"),
        F.col("p_retailprice").alias("duration"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as JSON, every tenth one broken."""
    broken = F.expr("substring(props, 2)")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 10 == 0, broken).otherwise(F.col("props")).alias("payload"),
    )


def containers(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Conversation turns packed into arrays of at most a thousand records; by key, a
    container holds a thousand turns that follow each other."""
    pack = F.floor(F.col("turn") / 1000) if keys else F.floor(F.monotonically_increasing_id() / 1000)
    return (
        table(spark, sf_dir, "conversations")
        .withColumn("pack", pack)
        .groupBy(*keys, "pack")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("turn", "role", "text")
                    if keys
                    else F.struct("conv_id", "turn", "role", "text")
                )
            ).alias("records")
        )
    )


# ------------------------------------------------------------------------ queries


def cast_play_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as text, some of them no whole number, read leniently."""
    written = F.col("l_quantity").cast("int").cast("string")
    raw = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("x"), written)).otherwise(written)
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", raw.alias("play_count"))
        .withColumn("play_count", plays_text.whole_number(F.col("play_count"), strict=False))
    )


def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "plays-tsv")
    plays_text.write_plays_tsv(plays(spark, sf_dir), path)
    return plays_text.read_plays_tsv(spark, path)


def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "plays-parquet")
    for _ in range(2):
        files.write_table(plays(spark, sf_dir), path)
    return spark.read.parquet(path)


def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all tables, and the rows read from each."""
    read = [table(spark, sf_dir, name).select(files.source_file()) for name in TABLES]
    rows = reduce(DataFrame.unionAll, read).groupBy("source_file").agg(F.count("*").alias("rows"))
    listed = files.list_files(spark, sf_dir, "*.parquet")
    return listed.join(rows, F.col("path") == F.col("source_file"), "left").select(
        base_name(F.col("path")).alias("file"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows")
    )


def file_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read, kept and dropped of the files with event payloads."""
    broken = F.expr("substring(props, 2)")
    payload = F.when(F.col("event_id") % 10 == 0, broken).otherwise(F.col("props"))
    read = table(spark, sf_dir, "events").select(files.source_file(), payload.alias("payload"))
    listed = files.list_files(spark, sf_dir, "events.parquet")
    account = ingest.file_account(listed, read, PAYLOAD)
    return account.select(base_name(F.col("path")).alias("file"), "records", "kept", "dropped")


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = files.rows_per_file(table(spark, sf_dir, "lineitem"))
    return counted.unionByName(files.rows_per_file(table(spark, sf_dir, "orders")))


def song_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as song records in JSON, three in an array; every tenth part has a year that
    is no number."""
    number = F.col("p_partkey").cast("string")
    size = F.col("p_size")
    year = F.when(F.col("p_partkey") % 10 == 0, F.lit("unknown")).otherwise(size.cast("string"))
    record = F.struct(
        F.concat(F.lit("S"), number).alias("song_id"),
        F.concat(F.lit("T"), number).alias("track_id"),
        F.col("p_brand").alias("artist_id"),
        F.col("p_brand").alias("artist_name"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("release"),
        (size / 100.0).alias("artist_familiarity"),
        (size / 200.0).alias("artist_hotttnesss"),
        (size / 400.0).alias("song_hotttnesss"),
        year.alias("year"),
        F.col("p_retailprice").alias("duration"),
        (size * 2.0).alias("tempo"),
        (size * -1.0).alias("loudness"),
        (size / 50.0).alias("energy"),
        (size / 25.0).alias("danceability"),
        (size / 4.0).alias("key"),
        (size % 2).alias("mode"),
        (size % 7).alias("time_signature"),
        (size * 1.5 - 30).alias("artist_latitude"),
        F.array("p_brand", "p_type").alias("artist_terms"),
        F.array(size / 8.0, size / 16.0).alias("artist_terms_freq"),
        F.array(size / 32.0, size / 64.0).alias("artist_terms_weight"),
        F.array("p_name", "p_brand").alias("similar_artists"),
    )
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.floor(F.col("p_partkey") / 3))
        .agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.to_json(record).alias("r")))).alias("x"))
        .select(F.concat(F.lit("["), F.array_join("x.r", ","), F.lit("]")).alias("value"))
    )


def ingest_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = new_folder(spark, "song-records")
    song_records(spark, sf_dir).write.text(source)
    return ingest.ingest_songs(
        spark, source, new_folder(spark, "songs"), glob="*.txt", whole_file=False
    )


def ingest_songs_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pass that writes the songs has counted."""
    source, counts = new_folder(spark, "song-records"), Observation("songs")
    song_records(spark, sf_dir).write.text(source)
    ingest.ingest_songs(
        spark, source, new_folder(spark, "songs"), "*.txt", whole_file=False, records="all", counts=counts
    )
    row = tuple(counts.get[c] for c in ("records", "kept", "dropped"))
    return spark.createDataFrame([row], "records long, kept long, dropped long")


def ingest_new_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that arrive in two halves; the second run reads the second half only."""
    source, target, log = (new_folder(spark, x) for x in ("song-records", "songs", "songs-log"))
    records = song_records(spark, sf_dir)
    second = F.pmod(F.xxhash64("value"), F.lit(2)) == 1
    for half in (~second, second):
        records.where(half).write.mode("append").text(source)
        run = new_files.ingest_new_songs(spark, source, target, log, glob="*.txt", whole_file=False)
        if run.payloads != records.where(half).count():
            raise RuntimeError("a run has read other files than the new ones")
    return run.table


def songs_of_both_ingests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder that the typed ingest and the raw ingest have written to."""
    source, target = new_folder(spark, "song-records"), new_folder(spark, "both-songs")
    song_records(spark, sf_dir).write.text(source)
    ingest.ingest_songs(spark, source, f"{target}/typed", "*.txt", whole_file=False)
    ingest.ingest_raw_songs(spark, source, f"{target}/raw", "*.txt", whole_file=False)
    return ingest.read_songs(spark, target)


def ingest_raw_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = new_folder(spark, "song-records")
    song_records(spark, sf_dir).write.text(source)
    raw = ingest.ingest_raw_songs(
        spark, source, new_folder(spark, "raw-songs"), glob="*.txt", whole_file=False
    )
    shown = []
    for name, kind in raw.dtypes:
        if kind == "binary":
            shown.append(F.decode(name, "UTF-8").alias(name))
        elif kind == "array<binary>":
            texts = F.transform(name, lambda x: F.decode(x, "UTF-8"))
            shown.append(F.array_join(texts, "|").alias(name))
        elif kind == "array<double>":
            shown += [F.get(name, F.lit(i)).alias(f"{name}_{i}") for i in range(2)]
        elif name == "source_file":
            shown.append(F.col(name).endswith(".txt").alias("from_text"))
        else:
            shown.append(F.col(name))
    return raw.select(*shown)


def first_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of the first container of each conversation."""
    firsts = decode.first_record(containers(spark, sf_dir, "conv_id"))
    least = firsts.groupBy("conv_id").agg(F.min_by(F.struct("turn", "role", "text"), "pack").alias("first"))
    return least.select("conv_id", "first.*")


def decode_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = songs(spark, sf_dir).select("item_id", F.encode("title", "UTF-8").alias("title"))
    return decode.decode_text(stored, "title")


def song_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.song_projection(
        songs(spark, sf_dir)
        .withColumn("song_id", F.col("item_id").cast("string"))
        .withColumn("key", F.col("duration") / 7)
    )


def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    known = F.when(F.col("quality").isNotNull(), F.col("quality").cast("double"))
    return profile.null_counts(
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .withColumn("score", F.coalesce(known, F.lit(float("nan"))))
        .withColumn("size", F.nullif(F.col("n_chars") % 10, F.lit(0)))
    )


def rounded_summary(summary: DataFrame) -> DataFrame:
    """Means and deviations depend on the order of addition in the last digits."""
    return summary.withColumns({c: F.round(c, 4) for c in ("mean", "stddev", "p25", "p50", "p75")})


def conversation_tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The words of all turns of a role as one flat run, and the start offset of each turn."""
    turns = table(spark, sf_dir, "conversations").select(
        "role", "conv_id", "turn", F.split("text", " ").alias("tokens")
    )
    placed = ids.running_totals(
        turns,
        ["role", "conv_id", "turn"],
        {"row_no": ids.one_row(), "start": F.size("tokens").cast("long")},
    )
    values = placed.select("role", "start", F.posexplode("tokens").alias("place", "value"))
    return (
        placed.select("role", "row_no", "start", "conv_id", "turn"),
        values.select("role", (F.col("start") + F.col("place")).alias("pos"), "value"),
    )


def ragged_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back to one array per turn; a turn's text held all its words before."""
    offsets, values = conversation_tokens(spark, sf_dir)
    return ragged.slice_table(offsets, values, "role", "tokens").select(
        "conv_id", "turn", F.size("tokens").alias("n_tokens"),
        F.array_join("tokens", "|").alias("tokens"),
    )


def ragged_slice_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors end to end by label; a row owns the run of eight ids it starts."""
    placed = ids.running_totals(
        table(spark, sf_dir, "embeddings").withColumn("block", F.floor(F.col("vec_id") / 8)),
        ["label", "vec_id"],
        {"pos": ids.one_row()},
    )
    offsets = ids.running_totals(
        placed.groupBy("label", "block").agg(F.min("pos").alias("start")),
        ["label", "block"],
        {"row_no": ids.one_row()},
    )
    values = placed.select("label", "pos", F.col("embedding").alias("value"))
    return ragged.slice_rows(offsets, values, "label").select(
        "label",
        "block",
        (F.col("pos") - F.col("start")).alias("place"),
        F.size("value").alias("dims"),
        F.array_join(F.transform("value", lambda x: F.floor(x.cast("double") * 1e6 + 0.5)), " ").alias(
            "millionths"
        ),
    )


def slice_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a hundred turns with their words end to end in one array, and offsets."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 100))
    turns = turns.agg(F.array_sort(F.collect_list(F.struct("turn", F.split("text", " ").alias("w")))).alias("x"))
    sizes = F.transform("x.w", lambda w: F.size(w))

    def start(_: Column, place: Column) -> Column:
        return F.aggregate(F.slice(sizes, F.lit(1), place), F.lit(0), lambda s, n: s + n)

    packed = turns.select(
        "conv_id", F.col("x.turn").alias("turns"), F.flatten("x.w").alias("flat"),
        F.transform("x.w", start).alias("offsets"),
    )
    return ragged.slice_arrays(packed, "flat", "offsets", "words").select(
        "conv_id", F.get("turns", F.col("row_no")).alias("turn"), F.array_join("words", "|").alias("words")
    )


def song_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of words as a song field that goes by the offsets of another field."""
    offsets, words = conversation_tokens(spark, sf_dir)
    first = offsets.groupBy("role").agg(F.min("row_no").alias("first"))  # a row per role
    held = offsets.join(F.broadcast(first), "role").select(
        F.col("role").alias("source_file"),
        (F.col("row_no") - F.col("first")).alias("row_no"),
        F.col("start").alias("idx_artist_terms"),
    )
    lengths = words.select(
        F.col("role").alias("source_file"), "pos", F.char_length("value").cast("double").alias("value")
    )
    found = ragged.song_arrays(held, lengths, "artist_terms_freq")
    whole = F.transform("artist_terms_freq", lambda x: x.cast("int"))
    return found.select("source_file", "row_no", F.array_join(whole, "|").alias("lengths"))


def distinct_users_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of the users of two files, written and merged, beside the exact count."""
    bought = table(spark, sf_dir, "orders").select(files.source_file(), F.col("o_custkey").alias("user_id"))
    seen = table(spark, sf_dir, "events").select(files.source_file(), F.col("user_id").cast("long").alias("user_id"))
    users = bought.unionByName(seen)
    parts = materialize(sketches.distinct_sketches(users, ["user_id"], ["source_file"]), "user-sketches")
    told = sketches.distinct_counts(parts, ["user_id"]).first()["user_id"]
    exact = users.agg(F.count_distinct("user_id").alias("users"))
    near = F.abs(F.col("users") - told) <= F.ceil(sketches.DISTINCT_BOUND * F.col("users"))
    return exact.select(F.lit(parts.count()).alias("files"), "users", near.alias("within"))


def quantiles_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of counts and prices from written sketches, held against exact ranks."""
    both = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    parts = materialize(sketches.quantile_sketches(both, both.columns), "quantile-sketches")
    told = sketches.quantiles(parts, [0.01, 0.25, 0.5, 0.75, 0.99])
    checks = []
    for row in told.collect():  # ten rows
        value, target = F.col(row["column"]).cast("double"), row["share"] * row["n"]
        near = F.count_if(value < row["value"]) - row["error"] <= target
        near = near & (F.count_if(value <= row["value"]) + row["error"] >= target) & F.lit(row["error"] <= 0.01 * row["n"])
        names = F.lit(row["column"]).alias("column"), F.lit(row["share"]).alias("share"), F.lit(row["n"]).cast("long").alias("n")
        checks.append(F.struct(*names, near.alias("within")))
    return both.agg(F.array(*checks).alias("checks")).select(F.inline("checks"))


def nearest_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists after an update by a hundredth of the orders, equal to those of one fit."""
    path = new_folder(spark, "neighbours")
    buyers = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    rows = table(spark, sf_dir, "lineitem").join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
    late = F.pmod(F.xxhash64("o_orderkey"), F.lit(100)) == 0
    rows = rows.select(
        "user_id", F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("int").alias("play_count"), late.alias("late")
    )
    incremental.start(rows.where("not late").drop("late"), path)
    incremental.add(spark, path, rows.where("late").drop("late"))
    return incremental.nearest_items(spark, path, 10).withColumn("distance", F.round("distance", 9))


def recommend_all_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a matrix and lists that are stored by item."""
    path, name = new_folder(spark, "keyed"), f"keyed_{uuid.uuid4().hex}"
    cells = materialize(similarity.interaction_matrix(plays(spark, sf_dir)), "cells")
    near = similarity.nearest_items(cells, 10)
    stored = keyed.write_keyed(cells, f"{name}_cells", f"{path}/cells", "item_id", 8)
    lists = keyed.write_keyed(near, f"{name}_near", f"{path}/near", "item_id", 8, ("rank",))
    return recommend.recommend_all_from(lists, stored, n=5)


def user_history_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user's items from a matrix that is stored by user."""
    path, name = new_folder(spark, "keyed"), f"keyed_{uuid.uuid4().hex}"
    cells = similarity.interaction_matrix(plays(spark, sf_dir))
    stored = keyed.write_keyed(cells, name, path, "user_id", 8, ("item_id",))
    return recommend.user_history(stored, USER)


def nearest_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = bounded.nearest_items(similarity.interaction_matrix(plays(spark, sf_dir)), 10)
    return near.rows.withColumn("distance", F.round("distance", 9))


def encode_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = ids.distinct_ids(plays(spark, sf_dir), "user_id")
    return ids.encode_ids(users, "user_id", "user_index")


def recommend_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.recommend(plays(spark, sf_dir), USER, n=5, k=10)


def recommend_from_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a written neighbour table, which any number of users can be served from."""
    listened = plays(spark, sf_dir)
    near = similarity.nearest_items(similarity.interaction_matrix(listened), 10)
    return recommend.recommend_from(materialize(near, "neighbors"), listened, USER, n=5)


def recommendation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the sixteenth user, with metadata missing for every third item."""
    listened = plays(spark, sf_dir)
    user = ids.nth_seen(listened, "user_id", "user_id", 15).first()["user_id"]
    known = songs(spark, sf_dir).where(F.col("item_id") % 3 != 0)
    return recommend.recommendation_report(listened, known, user, ["release", "title"])


def entry(spark: SparkSession) -> DataFrame:
    """Five recommendations for one user."""
    return recommend_items(spark, ENTRY_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = library_queries()
    if llm_queries:
        found |= llm_queries.QUERIES
    if corpus_pipeline:
        found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    found = library_sql()
    if llm_queries:
        found |= llm_queries.ORACLE_SQL
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def library_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # sources and sinks
        "tsv_round_trip": tsv_round_trip,
        "parquet_round_trip": parquet_round_trip,
        "list_files": list_files,
        "file_account": file_account,
        "provenance": provenance,
        "ingest_songs": ingest_songs,
        "ingest_raw_songs": ingest_raw_songs,
        "ingest_songs_counts": ingest_songs_counts,
        "ingest_new_songs": ingest_new_songs,
        "songs_of_both_ingests": songs_of_both_ingests,
        # records
        "decode_drop_bad": lambda s, d: decode.decode_drop_bad(payloads(s, d), "payload", PAYLOAD),
        "decode_null_bad": lambda s, d: decode.decode_null_bad(payloads(s, d), "payload", PAYLOAD),
        "explode_records": lambda s, d: decode.explode_records(containers(s, d)).select(
            "conv_id", "turn", "role", "text"
        ),
        "first_record": first_record,
        "records_per_container": lambda s, d: decode.records_per_container(
            table(s, d, "conversations"), "conv_id"
        ),
        # projections
        "cast_play_count": cast_play_count,
        "decode_titles": decode_titles,
        "song_projection": song_projection,
        # filters
        "user_history": lambda s, d: recommend.user_history(plays(s, d), USER),
        # aggregates
        "plays_overview": lambda s, d: profile.overview(plays(s, d)),
        "numeric_summary": lambda s, d: rounded_summary(
            profile.numeric_summary(plays(s, d), ["play_count"], exact=True)
        ),
        "numeric_summary_songs": lambda s, d: rounded_summary(
            profile.numeric_summary(songs(s, d), ["duration", "year"], exact=True)
        ),
        "null_counts": null_counts,
        "schema_listing": lambda s, d: profile.schema_listing(songs(s, d)),
        "top_users": lambda s, d: profile.top_by_plays(plays(s, d), "user_id"),
        "top_songs": lambda s, d: profile.top_by_plays(plays(s, d), "item_id"),
        "top_users_by_counters": lambda s, d: sketches.top_by_counters(plays(s, d), "user_id"),
        "top_songs_by_counters": lambda s, d: sketches.top_by_counters(plays(s, d), "item_id"),
        "distinct_users_sketched": distinct_users_sketched,
        "quantiles_sketched": quantiles_sketched,
        "interaction_matrix": lambda s, d: similarity.interaction_matrix(plays(s, d)),
        "matrix_stats": lambda s, d: similarity.matrix_stats(
            similarity.interaction_matrix(plays(s, d))
        ).withColumn("density", F.round("density", 9)),
        "item_norms": lambda s, d: similarity.item_norms(
            similarity.interaction_matrix(plays(s, d))
        ).withColumn("norm", F.round("norm", 6)),
        "distinct_users": lambda s, d: ids.distinct_ids(table(s, d, "events"), "user_id"),
        "first_seen_users": lambda s, d: ids.first_seen(
            table(s, d, "events"), "user_id", "event_id"
        ).orderBy("first_seen"),
        # ranks and samples
        "sample_rows": lambda s, d: profile.sample_rows(
            plays(s, d), ["user_id", "item_id", "play_count"], 10
        ),
        "nth_user": lambda s, d: ids.nth_seen(table(s, d, "events"), "user_id", "event_id", 15),
        "first_song_per_id": lambda s, d: recommend.first_song_per_id(
            songs(s, d), "title", ["release", "artist_name", "item_id"]
        ),
        # arrays and codes
        "ragged_slice": ragged_slice,
        "ragged_slice_2d": ragged_slice_2d,
        "slice_arrays": slice_arrays,
        "song_arrays": song_arrays,
        "encode_ids": encode_users,
        "encoded_matrix": lambda s, d: similarity.encode_matrix(
            similarity.interaction_matrix(plays(s, d))
        ),
        # neighbours and recommendations
        "item_knn": lambda s, d: similarity.nearest_items(
            similarity.interaction_matrix(plays(s, d)), 10
        ).withColumn("distance", F.round("distance", 9)),
        "recommend_all_keyed": recommend_all_keyed,
        "user_history_keyed": user_history_keyed,
        "nearest_updated": nearest_updated,
        "nearest_bounded": nearest_bounded,
        "reaching_pairs": lambda s, d: reaching.reaching_pairs(
            similarity.interaction_matrix(plays(s, d)), 0.2
        ),
        "similar_pairs": lambda s, d: projections.similar_pairs(
            similarity.interaction_matrix(plays(s, d)), 0.2
        ),
        "recommend_items": recommend_items,
        "recommend_from_neighbors": recommend_from_neighbors,
        "recommend_all": lambda s, d: recommend.recommend_all(plays(s, d), n=5, k=10),
        "recommendation_report": recommendation_report,
    }


# ------------------------------------------------------------------------ oracles

PLAYS = """plays AS (
    SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(l_quantity AS INTEGER) AS play_count
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SONGS = """songs AS (
    SELECT p_partkey AS item_id, p_brand AS artist_name, p_name AS title, p_type AS release,
           p_size AS year, p_retailprice AS duration
    FROM part)"""
CELLS = f"""{PLAYS}, cells AS (
    SELECT user_id, item_id, CAST(sum(play_count) AS BIGINT) AS play_count
    FROM plays WHERE user_id IS NOT NULL AND item_id IS NOT NULL
    GROUP BY user_id, item_id)"""
NORMS = f"""{CELLS}, norms AS (
    SELECT item_id, sqrt(sum(CAST(play_count AS DOUBLE) * play_count)) AS norm,
           count(*) AS listeners
    FROM cells GROUP BY item_id)"""


def _knn(k: int, only: str = "") -> str:
    """Neighbour lists; `only` restricts the left items to those of a user."""
    where = f"WHERE a.item_id IN (SELECT item_id FROM cells WHERE user_id = {only})" if only else ""
    return f"""{NORMS}, dots AS (
    SELECT a.item_id, b.item_id AS neighbor_id,
           sum(CAST(a.play_count AS DOUBLE) * b.play_count) AS dot
    FROM cells a JOIN cells b ON a.user_id = b.user_id AND a.item_id <> b.item_id
    {where} GROUP BY 1, 2), sims AS (
    SELECT d.item_id, d.neighbor_id,
           round(coalesce(d.dot / nullif(x.norm * y.norm, 0), 0), 9) AS similarity
    FROM dots d JOIN norms x ON d.item_id = x.item_id
    JOIN norms y ON d.neighbor_id = y.item_id), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, neighbor_id) AS rank
    FROM sims), near AS (SELECT * FROM ranked WHERE rank <= {k})"""


SCORE = "CAST(round(sum(CAST(similarity AS DECIMAL(18, 9))), 6) AS DOUBLE) AS score"


def _summary(source: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS count,
        round(avg({column}), 4) AS mean, round(stddev_samp({column}), 4) AS stddev,
        CAST(min({column}) AS DOUBLE) AS min,
        round(quantile_cont(CAST({column} AS DOUBLE), 0.25), 4) AS p25,
        round(quantile_cont(CAST({column} AS DOUBLE), 0.5), 4) AS p50,
        round(quantile_cont(CAST({column} AS DOUBLE), 0.75), 4) AS p75,
        CAST(max({column}) AS DOUBLE) AS max FROM {source}"""


def _top(id_col: str) -> str:
    return f"""WITH {PLAYS} SELECT {id_col}, CAST(sum(play_count) AS BIGINT) AS total_plays
        FROM plays GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""


def library_sql() -> dict[str, str]:
    song_types = {
        "item_id": "bigint",
        "artist_name": "string",
        "title": "string",
        "release": "string",
        "year": "int",
        "duration": "double",
    }
    typed_null = {
        "track_id": "VARCHAR",
        "artist_id": "VARCHAR",
        "artist_familiarity": "DOUBLE",
        "artist_hotttnesss": "DOUBLE",
        "artist_location": "VARCHAR",
        "song_hotttnesss": "DOUBLE",
        "tempo": "DOUBLE",
        "loudness": "DOUBLE",
        "energy": "DOUBLE",
        "danceability": "DOUBLE",
        "mode": "INTEGER",
        "time_signature": "INTEGER",
    }
    all_sql = f"""WITH {_knn(10)}, scores AS (
            SELECT user_id, neighbor_id AS item_id, {SCORE}
            FROM cells JOIN near USING (item_id) GROUP BY 1, 2)
            SELECT * FROM (SELECT user_id, item_id, score, CAST(row_number() OVER (
                PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM scores)
            WHERE rank <= 5"""
    history_sql = f"WITH {PLAYS} SELECT DISTINCT item_id FROM plays WHERE user_id = {USER}"
    knn_sql = f"""WITH {_knn(10)} SELECT item_id, neighbor_id, similarity,
            round(1.0 - similarity, 9) AS distance, CAST(rank AS INTEGER) AS rank FROM near"""
    songs_sql = """SELECT 'S' || p_partkey AS song_id, 'T' || p_partkey AS track_id,
            p_brand AS artist_id, p_brand AS artist_name, p_name AS title, p_type AS release,
            p_size / 100.0::DOUBLE AS artist_familiarity,
            p_size / 200.0::DOUBLE AS artist_hotttnesss,
            CAST(NULL AS VARCHAR) AS artist_location, p_size / 400.0::DOUBLE AS song_hotttnesss,
            p_size AS year, p_retailprice AS duration, p_size * 2.0::DOUBLE AS tempo,
            p_size * -1.0::DOUBLE AS loudness, p_size / 50.0::DOUBLE AS energy,
            p_size / 25.0::DOUBLE AS danceability, p_size // 4 AS key, p_size % 2 AS mode,
            p_size % 7 AS time_signature
            FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey // 3 ORDER BY p_partkey)
            AS place FROM part) WHERE place = 1 AND p_partkey % 10 <> 0"""
    nulls = ", ".join(f"CAST(NULL AS {kind}) AS {name}" for name, kind in typed_null.items())
    return {
        "tsv_round_trip": f"""WITH {PLAYS} SELECT CAST(user_id AS VARCHAR) AS user_id,
            CAST(item_id AS VARCHAR) AS song_id, play_count FROM plays""",
        "parquet_round_trip": f"WITH {PLAYS} SELECT * FROM plays",
        "list_files": " UNION ALL ".join(
            f"SELECT '{name}.parquet' AS file, count(*) AS rows FROM {name}" for name in TABLES
        ),
        "file_account": """SELECT 'events.parquet' AS file, count(*) AS records,
            count(*) FILTER (json_valid(payload)) AS kept,
            count(*) FILTER (NOT json_valid(payload)) AS dropped FROM (
            SELECT CASE WHEN event_id % 10 = 0 THEN substr(props, 2) ELSE props END
            AS payload FROM events)""",
        "provenance": """SELECT 'lineitem.parquet' AS source_file, count(*) AS rows FROM lineitem
            UNION ALL SELECT 'orders.parquet', count(*) FROM orders""",
        "ingest_songs": songs_sql,
        "ingest_new_songs": songs_sql,
        "ingest_songs_counts": """SELECT count(*) AS records, count(*) FILTER (p_partkey % 10 <> 0) AS kept,
            count(*) FILTER (p_partkey % 10 = 0) AS dropped FROM part""",
        "songs_of_both_ingests": f"""{songs_sql} UNION ALL
            SELECT 'S' || p_partkey, CAST(NULL AS VARCHAR), p_brand, p_brand, p_name, p_type,
            p_size / 100.0::DOUBLE, p_size / 200.0::DOUBLE, NULL, p_size / 400.0::DOUBLE,
            CASE WHEN p_partkey % 10 <> 0 THEN p_size END, p_retailprice, p_size * 2.0::DOUBLE,
            p_size * -1.0::DOUBLE, p_size / 50.0::DOUBLE, p_size / 25.0::DOUBLE, p_size // 4,
            p_size % 2, NULL FROM part""",
        "distinct_users_sketched": """SELECT 2 AS files, count(DISTINCT u) AS users, true AS within FROM (
            SELECT o_custkey AS u FROM orders UNION ALL SELECT user_id FROM events)""",
        "quantiles_sketched": """SELECT "column", share, n, true AS within FROM (
            SELECT 'l_quantity' AS "column", count(l_quantity) AS n FROM lineitem UNION ALL
            SELECT 'l_extendedprice', count(l_extendedprice) FROM lineitem),
            (SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99])::DOUBLE AS share)""",
        "ingest_raw_songs": """SELECT 'S' || p_partkey AS get_song_id, p_name AS get_title,
            CASE WHEN p_partkey % 10 <> 0 THEN p_size END AS get_year, p_size // 4 AS get_key,
            p_retailprice AS get_duration, p_size * 1.5::DOUBLE - 30 AS get_artist_latitude,
            CAST(NULL AS DOUBLE) AS get_artist_longitude, CAST(NULL AS VARCHAR) AS get_artist_location,
            p_size / 100.0::DOUBLE AS get_artist_familiarity,
            p_size / 200.0::DOUBLE AS get_artist_hotttnesss,
            p_size / 400.0::DOUBLE AS get_song_hotttnesss, p_brand AS get_artist_id,
            p_brand AS get_artist_name, p_type AS get_release, p_size * 2.0::DOUBLE AS get_tempo,
            p_size * -1.0::DOUBLE AS get_loudness, p_size / 50.0::DOUBLE AS get_energy,
            p_size / 25.0::DOUBLE AS get_danceability, p_size % 2 AS get_mode,
            p_brand || '|' || p_type AS get_artist_terms,
            p_size / 8.0::DOUBLE AS get_artist_terms_freq_0,
            p_size / 16.0::DOUBLE AS get_artist_terms_freq_1,
            p_size / 32.0::DOUBLE AS get_artist_terms_weight_0,
            p_size / 64.0::DOUBLE AS get_artist_terms_weight_1,
            p_name || '|' || p_brand AS get_similar_artists, true AS from_text FROM part""",
        "decode_drop_bad": """SELECT event_id,
            CAST(json_extract_string(payload, '$.k') AS INTEGER) AS k FROM (
            SELECT event_id, CASE WHEN event_id % 10 = 0 THEN substr(props, 2) ELSE props END
            AS payload FROM events) WHERE json_valid(payload)""",
        "decode_null_bad": """SELECT event_id, CASE WHEN json_valid(payload)
            THEN TRY_CAST(regexp_extract(payload, '"k": *(-?[0-9]+)', 1) AS INTEGER) END AS k
            FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN substr(props, 2)
            ELSE props END AS payload FROM events)""",
        "explode_records": "SELECT conv_id, turn, role, text FROM conversations",
        "first_record": """SELECT conv_id, turn, role, text FROM (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place
            FROM conversations) WHERE place = 1""",
        "records_per_container": """SELECT conv_id, count(*) AS records FROM conversations
            GROUP BY conv_id""",
        "cast_play_count": """SELECT l_orderkey, l_linenumber, TRY_CAST(
            CASE WHEN l_linenumber = 7 THEN 'x' ELSE '' END
            || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS INTEGER) AS play_count
            FROM lineitem""",
        "decode_titles": "SELECT p_partkey AS item_id, p_name AS title FROM part",
        "song_projection": f"""SELECT CAST(p_partkey AS VARCHAR) AS song_id,
            p_brand AS artist_name, p_name AS title, p_type AS release, p_size AS year,
            p_retailprice AS duration, CAST(trunc(p_retailprice / 7) AS INTEGER) AS key, {nulls}
            FROM part""",
        "user_history": history_sql,
        "user_history_keyed": history_sql,
        "plays_overview": f"""WITH {PLAYS} SELECT count(*) AS interactions,
            count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM plays""",
        "numeric_summary": f"WITH {PLAYS} " + _summary("plays", "play_count"),
        "numeric_summary_songs": f"WITH {SONGS} "
        + _summary("songs", "duration")
        + " UNION ALL "
        + _summary("songs", "year"),
        "null_counts": """WITH t AS (SELECT d.doc_id, text, lang, source, n_chars, quality, toxic,
            nullif(n_chars % 10, 0) AS size
            FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
            SELECT 'doc_id' AS "column", count(*) - count(doc_id) AS nulls, 0::BIGINT AS nans FROM t
            UNION ALL SELECT 'text', count(*) - count(text), 0 FROM t
            UNION ALL SELECT 'lang', count(*) - count(lang), 0 FROM t
            UNION ALL SELECT 'source', count(*) - count(source), 0 FROM t
            UNION ALL SELECT 'n_chars', count(*) - count(n_chars), 0 FROM t
            UNION ALL SELECT 'quality', count(*) - count(quality), 0 FROM t
            UNION ALL SELECT 'toxic', count(*) - count(toxic), 0 FROM t
            UNION ALL SELECT 'score', 0, count(*) - count(quality) FROM t
            UNION ALL SELECT 'size', count(*) - count(size), 0 FROM t""",
        "schema_listing": f"WITH {SONGS} "
        + " UNION ALL ".join(
            f"""SELECT {i} AS position, '{name}' AS "column", '{kind}' AS type,
            true AS nullable, count({name}) AS "values" FROM songs"""
            for i, (name, kind) in enumerate(song_types.items())
        ),
        "top_users": _top("user_id"),
        "top_songs": _top("item_id"),
        "top_users_by_counters": _top("user_id"),
        "top_songs_by_counters": _top("item_id"),
        "interaction_matrix": f"WITH {CELLS} SELECT * FROM cells",
        "matrix_stats": f"""WITH {CELLS} SELECT count(DISTINCT user_id) AS users,
            count(DISTINCT item_id) AS items, count(*) AS cells,
            round(count(*) / (CAST(count(DISTINCT user_id) AS DOUBLE)
                * count(DISTINCT item_id)), 9) AS density FROM cells""",
        "item_norms": f"WITH {NORMS} SELECT item_id, round(norm, 6) AS norm, listeners FROM norms",
        "distinct_users": "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL",
        "first_seen_users": """SELECT user_id, min(event_id) AS first_seen FROM events
            GROUP BY user_id ORDER BY 2""",
        "sample_rows": f"""WITH {PLAYS} SELECT * FROM plays
            ORDER BY user_id, item_id, play_count LIMIT 10""",
        "nth_user": """SELECT user_id, min(event_id) AS first_seen FROM events
            GROUP BY user_id ORDER BY 2 LIMIT 1 OFFSET 15""",
        "first_song_per_id": f"""WITH {SONGS} SELECT title, item_id, artist_name, release, year,
            duration FROM (SELECT *, row_number() OVER (PARTITION BY title
            ORDER BY release, artist_name, item_id) AS place FROM songs) WHERE place = 1""",
        "ragged_slice": """SELECT conv_id, turn,
            CAST(len(string_split(text, ' ')) AS INTEGER) AS n_tokens,
            array_to_string(string_split(text, ' '), '|') AS tokens FROM conversations""",
        "ragged_slice_2d": """SELECT label, vec_id // 8 AS block, row_number() OVER (
            PARTITION BY label, vec_id // 8 ORDER BY vec_id) - 1 AS place,
            CAST(len(embedding) AS INTEGER) AS dims,
            array_to_string(list_transform(embedding, lambda x:
                CAST(floor(CAST(x AS DOUBLE) * 1e6 + 0.5) AS BIGINT)), ' ') AS millionths
            FROM embeddings""",
        "slice_arrays": """SELECT conv_id, turn,
            array_to_string(string_split(text, ' '), '|') AS words FROM conversations""",
        "song_arrays": """SELECT role AS source_file,
            row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS row_no,
            array_to_string(list_transform(string_split(text, ' '), lambda x: length(x)), '|')
            AS lengths FROM conversations""",
        "encode_ids": f"""WITH {PLAYS} SELECT user_id,
            row_number() OVER (ORDER BY user_id) - 1 AS user_index
            FROM (SELECT DISTINCT user_id FROM plays)""",
        "encoded_matrix": f"""WITH {CELLS} SELECT
            dense_rank() OVER (ORDER BY user_id) - 1 AS user_index,
            dense_rank() OVER (ORDER BY item_id) - 1 AS item_index, play_count FROM cells""",
        "reaching_pairs": f"""WITH {NORMS}, dots AS (
            SELECT a.item_id AS item_a, b.item_id AS item_b,
                sum(CAST(a.play_count AS DOUBLE) * b.play_count) AS dot
            FROM cells a JOIN cells b ON a.user_id = b.user_id AND a.item_id < b.item_id
            GROUP BY 1, 2), sims AS (
            SELECT item_a, item_b, round(dot / nullif(x.norm * y.norm, 0), 9) AS similarity
            FROM dots JOIN norms x ON x.item_id = item_a JOIN norms y ON y.item_id = item_b)
            SELECT * FROM sims WHERE similarity >= 0.2""",
        "similar_pairs": f"""WITH {NORMS}, marks AS (
            SELECT DISTINCT user_id, md5(CAST(user_id AS VARCHAR)) AS m FROM cells), digits AS (
            SELECT user_id, j, strpos('0123456789abcdef', substr(m, j, 1)) - 1 AS d
            FROM marks, (SELECT unnest(range(1, 33)) AS j)), sums AS (
            SELECT item_id, j, b, sum(play_count * (1 - 2 * ((d >> b) & 1))) AS s
            FROM cells JOIN digits USING (user_id), (SELECT unnest(range(4))::INTEGER AS b)
            GROUP BY 1, 2, 3), keys AS (
            SELECT item_id, (j - 1) // 2 AS band,
                sum(CASE WHEN s >= 0 THEN 1 << CAST(4 * (j % 2) + b AS INTEGER) ELSE 0 END) AS key
            FROM sums GROUP BY 1, 2), pairs AS (
            SELECT DISTINCT a.item_id AS item_a, b.item_id AS item_b FROM keys a
            JOIN keys b ON a.band = b.band AND a.key = b.key AND a.item_id < b.item_id), dots AS (
            SELECT item_a, item_b, sum(CAST(a.play_count AS DOUBLE) * b.play_count) AS dot
            FROM pairs JOIN cells a ON a.item_id = item_a
            JOIN cells b ON b.item_id = item_b AND b.user_id = a.user_id GROUP BY 1, 2), sims AS (
            SELECT item_a, item_b, round(coalesce(dot / nullif(x.norm * y.norm, 0), 0), 9) AS similarity
            FROM dots JOIN norms x ON x.item_id = item_a JOIN norms y ON y.item_id = item_b)
            SELECT * FROM sims WHERE similarity >= 0.2""",
        "item_knn": knn_sql,
        "nearest_updated": knn_sql,
        "nearest_bounded": knn_sql,
        "recommend_items": f"""WITH {_knn(10, str(USER))} SELECT neighbor_id AS item_id, {SCORE}
            FROM near GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
        "recommend_from_neighbors": f"""WITH {_knn(10, str(USER))}
            SELECT neighbor_id AS item_id, {SCORE}
            FROM near GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
        "recommend_all": all_sql,
        "recommend_all_keyed": all_sql,
        "recommendation_report": f"""WITH {_knn(
            10, "(SELECT DISTINCT user_id FROM plays ORDER BY 1 LIMIT 1 OFFSET 15)"
        )}, {SONGS}, best AS (
            SELECT neighbor_id AS item_id, {SCORE} FROM near
            GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3), named AS (
            SELECT CAST(row_number() OVER (ORDER BY score DESC, b.item_id) AS INTEGER) AS position,
                b.item_id, score, coalesce(artist_name, CAST(b.item_id AS VARCHAR)) AS artist,
                coalesce(title, CAST(b.item_id AS VARCHAR)) AS title
            FROM best b LEFT JOIN songs s ON b.item_id = s.item_id AND s.item_id % 3 <> 0)
            SELECT position, item_id, score, artist, title,
                CASE WHEN artist = title THEN position || '. [song_id] ' || artist
                ELSE position || '. ' || artist || ' - ' || title END AS line FROM named""",
    }
