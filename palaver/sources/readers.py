"""Readers: files, transcripts, logs, manifests, identity stores, turn files and calendars. Schemas are explicit throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver import schemas
from palaver.functions.scalars import strip
from palaver.operators.rules import glob_regex

#: File endings of recordings.
AUDIO = (".aac", ".flac", ".m4a", ".mp3", ".mp4", ".ogg", ".opus", ".wav", ".webm", ".wma")
#: Files beside transcripts that are none.
INTERNAL = ("manifest.json", ".manifest.json", "speaker_identities.json", "speakers.json", "hash_cache.json", "sync_cache.json")
INTERNAL_PARTS = (".embeddings.", "llm_costs", "manifest", "speaker_identities", "sync_cache")


def scan_files(
    spark: SparkSession, folder: str, extensions: tuple[str, ...] = AUDIO, recursive: bool = True, ignore: tuple[str, ...] = (), min_size: int = 0, max_size: int | None = None, modified_after: str | None = None
) -> DataFrame:
    """(path, name, size, mtime): files of a folder, the latest first. Contents are not read: the scan has no content column.

    ``ignore`` has shell patterns for the path below the folder or the name alone.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    files = reader.load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return filter_files(files, extensions, ignore, min_size, max_size, folder).orderBy(F.desc("mtime"), "path")


def filter_files(files: DataFrame, extensions: tuple[str, ...], ignore: tuple[str, ...] = (), min_size: int = 0, max_size: int | None = None, folder: str = "") -> DataFrame:
    """The predicates of ``scan_files`` on any table with path, name and size."""
    ending = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    keep = ending.isin(*extensions) & (F.col("size") >= min_size)
    if max_size is not None:
        keep = keep & (F.col("size") <= max_size)
    below = F.regexp_replace("path", r"^.*?\Q" + folder.rstrip("/") + r"\E/", "") if folder else F.col("path")
    for pattern in ignore:
        regex = F.lit(glob_regex(pattern))
        keep = keep & ~F.rlike(below, regex) & ~F.rlike("name", regex)
    return files.filter(keep)


def read_transcripts(spark: SparkSession, folder: str, by_parts: bool = False) -> DataFrame:
    """One row for each transcript document of a folder, with ``call_id``, ``file`` and ``file_mtime``; unreadable ones are left out.

    Internal files are told by name, or with ``by_parts`` by parts of it; embeddings and hidden files never count.
    """
    read = (
        spark.read.schema(f"{schemas.TRANSCRIPT}, _corrupt string")
        .options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", pathGlobFilter="*.json")
        .json(folder)
        .withColumns({"file": F.col("_metadata.file_name"), "file_mtime": F.col("_metadata.file_modification_time")})
    )
    name = F.col("file")
    internal = name.isin(*INTERNAL) | name.contains(".embeddings.") | name.startswith(".")
    if by_parts:
        for part in INTERNAL_PARTS:
            internal = internal | name.contains(part)
    good = read.filter(F.col("_corrupt").isNull() & ~internal)
    return good.drop("_corrupt").withColumn("call_id", F.regexp_replace("file", r"\.json$", ""))


def transcript_segments(calls: DataFrame) -> DataFrame:
    """The exploded segments of transcripts, with their position and the whole speaker list."""
    flat = calls.select("call_id", F.posexplode("segments").alias("pos", "s")).select("call_id", "pos", "s.*")
    listed = F.when(F.col("speaker").startswith("["), F.from_json("speaker", "array<string>")).when(F.col("speaker").isNotNull(), F.array("speaker"))
    return flat.withColumn("speakers", listed).withColumn("is_overlap", F.coalesce(F.size("speakers") > 1, F.lit(False))).withColumn("speaker", F.get("speakers", F.lit(0)))


def transcript_time(calls: DataFrame) -> Column:
    """Time of a recording: its own, then those of its file under either name, then that of the document's file."""
    texts = ("metadata.audio.creation_time", "metadata.file.modified_time", "metadata.file.modified", "metadata.file.created_time", "metadata.file.created")
    return F.coalesce(*[F.try_to_timestamp(F.col(t)) for t in texts], F.col("file_mtime"))


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage records, one JSON object a line; bad and blank lines are dropped."""
    return spark.read.schema(schemas.USAGE).option("mode", "DROPMALFORMED").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a manifest file {version, files: {hash: row}}; a corrupt file is an empty manifest."""
    form = f"version string, files map<string,{schemas.struct(schemas.MANIFEST_FIELDS)}>"
    read = spark.read.schema(form).options(multiLine=True, mode="PERMISSIVE").json(path)
    return read.select(F.explode("files").alias("hash", "row")).select("hash", "row.*")


def read_identities(spark: SparkSession, path: str, now: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Identities, occurrences and evidence of an identity store; the first format (a map of names to vectors) is migrated."""
    from palaver.operators.identity import migrate_v1

    form = (
        f"version string, identities map<string,{schemas.struct(schemas.IDENTITY)}>, occurrences array<{schemas.struct(schemas.OCCURRENCE)}>, evidence array<{schemas.struct(schemas.EVIDENCE)}>, "
        "speakers map<string,struct<embedding:array<double>,num_samples:bigint>>"
    )
    store = spark.read.schema(form).options(multiLine=True, mode="PERMISSIVE").json(path)
    current = store.select(F.explode("identities").alias("k", "i")).select("i.*", "k").withColumn("speaker_cluster_id", F.coalesce("speaker_cluster_id", "k")).drop("k")
    old = store.select(F.explode("speakers").alias("name", "s")).select("name", "s.*")
    return (
        current.unionByName(migrate_v1(old, now)),
        store.select(F.explode("occurrences").alias("o")).select("o.*"),
        store.select(F.explode("evidence").alias("e")).select("e.*"),
    )


def parse_rttm(lines: DataFrame, file_id: str | None = None) -> DataFrame:
    """(call_id, start, end, speaker) out of text lines (value); lines with under nine fields or of another type are skipped."""
    f = lines.select(F.split(F.trim("value"), r"\s+").alias("f")).filter((F.size("f") >= 9) & (F.col("f")[0] == "SPEAKER"))
    if file_id is not None:
        f = f.filter(F.col("f")[1] == file_id)
    start = F.col("f")[3].try_cast("double")
    return f.select(F.col("f")[1].alias("call_id"), start.alias("start"), (start + F.col("f")[4].try_cast("double")).alias("end"), F.col("f")[7].alias("speaker")).filter("start IS NOT NULL AND end IS NOT NULL")


def read_rttm(spark: SparkSession, path: str, file_id: str | None = None) -> DataFrame:
    return parse_rttm(spark.read.text(path), file_id)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Events (event_id, pos, subject, start, end, attendees) of JSON that is a list, or an object with ``value``; times in UTC seconds."""
    event = "struct<id:string,subject:string,start:struct<dateTime:string,timeZone:string>,end:struct<dateTime:string,timeZone:string>,attendees:array<struct<emailAddress:struct<name:string,address:string>,type:string>>>"
    text = spark.read.text(path, wholetext=True)
    events = F.coalesce(F.from_json("value", f"struct<value:array<{event}>>")["value"], F.from_json("value", f"array<{event}>"))
    flat = text.select(F.posexplode(events).alias("pos", "e"))
    seconds = lambda t: F.unix_micros(F.try_to_timestamp(F.regexp_replace(t, r"(\.\d{6})\d+", "$1"))) / 1e6
    people = F.transform("e.attendees", lambda a: F.struct(a["emailAddress"]["name"].alias("name"), a["emailAddress"]["address"].alias("email"), a["type"].alias("type")))
    return flat.select(F.col("e.id").alias("event_id"), "pos", F.col("e.subject").alias("subject"), seconds(F.col("e.start.dateTime")).alias("start"), seconds(F.col("e.end.dateTime")).alias("end"), people.alias("attendees"))


def _last_of_key(entries: Column) -> Column:
    """A map of entries without null or empty values, the last of each key."""
    kept = F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull() & (e["value"] != ""))
    one = F.aggregate(kept, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, e: F.concat(F.filter(acc, lambda x: x["key"] != e["key"]), F.array(e)))
    return F.map_from_entries(one)


def normalised_tags(tags: Column) -> Column:
    """A tag map with lower-case keys, their spaces as ``_``, and trimmed values; empty ones are left out."""
    key = lambda e: F.replace(F.lower(e["key"]), F.lit(" "), F.lit("_"))
    return _last_of_key(F.transform(F.map_entries(tags), lambda e: F.struct(key(e).alias("key"), strip(e["value"]).alias("value"))))


#: Tags that tell of a recording's circumstances, the beginnings of more, and frames of two container formats with the names they get.
RECORDING_TAGS = (
    "recording_device", "device", "microphone", "mic", "location", "gps", "gps_coordinates", "latitude", "longitude", "recording_location", "venue", "room", "studio",
    "recorder", "software", "hardware", "firmware", "recording_date", "recording_time", "session", "description", "notes", "producer", "engineer",
)
#: Plain comments, without the prefix of a container format, of these names count too.
PLAIN_TAGS = ("isrc", "barcode")
RECORDING_PREFIXES = ("recording_", "gps_", "device_")
RECORDING_FRAMES = {
    "TSSE": "encoder_settings", "TSRC": "isrc", "TOFN": "original_filename", "TOWN": "owner", "TOPE": "original_artist", "TDOR": "original_date", "TDRC": "recording_date", "TDRL": "release_date", "TRSN": "radio_station", "TRSO": "radio_station_owner", "TPE4": "remixer",
    "©too": "encoder", "©cmt": "comment", "©day": "date", "©des": "description", "©lyr": "lyrics", "purd": "purchase_date",
}


def recording_context(tags: Column) -> Column:
    """What a raw tag map tells of the recording: known frames under their names, and user-defined tags (``TXXX:name``, ``----:domain:name`` or plain) of known names or beginnings."""
    frames = F.create_map(*[F.lit(x) for pair in RECORDING_FRAMES.items() for x in pair])
    bare = lambda k: F.regexp_replace(F.regexp_replace(k, r"^TXXX:", ""), r"^----:[^:]*:", "")
    name = lambda k: F.translate(F.lower(strip(bare(k))), " -", "__")
    known = lambda n: n.isin(*RECORDING_TAGS) | F.rlike(n, F.lit("^(" + "|".join(RECORDING_PREFIXES) + ")"))
    plain = lambda k: F.lower(k).isin(*PLAIN_TAGS)
    key = lambda k: F.coalesce(F.element_at(frames, k), F.when(known(name(k)) | plain(k), name(k)))
    return _last_of_key(F.transform(F.map_entries(tags), lambda e: F.struct(key(e["key"]).alias("key"), strip(e["value"]).alias("value"))))


def paths_table(spark: SparkSession, lines: list[str]) -> DataFrame:
    """Paths of a pipe as a table; blank lines are left out."""
    return spark.createDataFrame([(x.strip(),) for x in lines if x.strip()], "path string")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, duration_seconds, bit_rate, format_name, channels, sample_rate, codec, tags, recording) out of media probe JSON documents, one a file."""
    stream = "struct<codec_type:string,codec_name:string,channels:int,sample_rate:string,tags:map<string,string>>"
    form = f"format struct<filename:string,duration:string,bit_rate:string,format_name:string,size:string,tags:map<string,string>>, streams array<{stream}>"
    docs = spark.read.schema(form).options(multiLine=True, mode="PERMISSIVE").json(path)
    audio = F.get(F.filter("streams", lambda s: s["codec_type"] == "audio"), F.lit(0))
    empty = F.create_map().cast("map<string,string>")
    tags = F.map_concat(
        F.map_filter(F.coalesce(audio["tags"], empty), lambda k, _: ~F.map_contains_key(F.coalesce(F.col("format.tags"), empty), k)), F.coalesce(F.col("format.tags"), empty)
    )
    return docs.select(
        F.col("format.filename").alias("file"), F.col("format.duration").try_cast("double").alias("duration_seconds"), F.col("format.bit_rate").try_cast("bigint").alias("bit_rate"), F.col("format.format_name").alias("format_name"),
        audio["channels"].alias("channels"), audio["sample_rate"].try_cast("int").alias("sample_rate"), audio["codec_name"].alias("codec"), normalised_tags(tags).alias("tags"), recording_context(tags).alias("recording"),
    )
