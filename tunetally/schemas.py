"""Column names and types of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "binary": T.BinaryType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "array<binary>": T.ArrayType(T.BinaryType()),
    "array<double>": T.ArrayType(T.DoubleType()),
}


def _schema(columns: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


# The order and names of the columns in a plays file.
PLAYS_COLUMNS = ("user_id", "song_id", "play_count")

# The typed song columns, in table order.
SONG_COLUMNS = {
    "song_id": "string",
    "track_id": "string",
    "artist_id": "string",
    "artist_name": "string",
    "title": "string",
    "release": "string",
    "artist_familiarity": "double",
    "artist_hotttnesss": "double",
    "artist_location": "string",
    "song_hotttnesss": "double",
    "year": "int",
    "duration": "double",
    "tempo": "double",
    "loudness": "double",
    "energy": "double",
    "danceability": "double",
    "key": "int",
    "mode": "int",
    "time_signature": "int",
}
SONG_SCHEMA = _schema(SONG_COLUMNS)

# The fields of a raw song row. Text is kept as bytes there.
RAW_SONG_FIELDS = {
    "artist_familiarity": "double",
    "artist_hotttnesss": "double",
    "artist_id": "binary",
    "artist_latitude": "double",
    "artist_location": "binary",
    "artist_longitude": "double",
    "artist_name": "binary",
    "artist_terms": "array<binary>",
    "artist_terms_freq": "array<double>",
    "artist_terms_weight": "array<double>",
    "danceability": "double",
    "duration": "double",
    "energy": "double",
    "key": "int",
    "loudness": "double",
    "mode": "int",
    "release": "binary",
    "similar_artists": "array<binary>",
    "song_hotttnesss": "double",
    "song_id": "binary",
    "tempo": "double",
    "title": "binary",
    "year": "int",
}
RAW_SONG_SCHEMA = _schema(RAW_SONG_FIELDS)

# Every field a song file can hold, by shape. The ragged ones are stored
# as one flat run of values per file plus a start offset per song; the values of the
# two-dimensional ones are rows of numbers.
SCALAR_SONG_FIELDS = (
    "analysis_sample_rate", "artist_7digitalid", "artist_familiarity", "artist_hotttnesss",
    "artist_id", "artist_latitude", "artist_location", "artist_longitude", "artist_mbid",
    "artist_name", "artist_playmeid", "audio_md5", "danceability", "duration",
    "end_of_fade_in", "energy", "key", "key_confidence", "loudness", "mode",
    "mode_confidence", "release", "release_7digitalid", "song_hotttnesss", "song_id",
    "start_of_fade_out", "tempo", "time_signature", "time_signature_confidence", "title",
    "track_7digitalid", "track_id", "year",
)
RAGGED_SONG_FIELDS = (
    "artist_mbtags", "artist_mbtags_count", "artist_terms", "artist_terms_freq",
    "artist_terms_weight", "bars_confidence", "bars_start", "beats_confidence",
    "beats_start", "sections_confidence", "sections_start", "segments_confidence",
    "segments_loudness_max", "segments_loudness_max_time", "segments_loudness_start",
    "segments_pitches", "segments_start", "segments_timbre", "similar_artists",
    "tatums_confidence", "tatums_start",
)
# The ragged fields that go by the offsets of another one.
SHARED_OFFSETS = {
    "artist_mbtags_count": "artist_mbtags",
    "artist_terms_freq": "artist_terms",
    "artist_terms_weight": "artist_terms",
}


def offset_column(field: str) -> str:
    """The column of a song row that holds where its slice of a ragged field starts."""
    return f"idx_{SHARED_OFFSETS.get(field, field)}"
