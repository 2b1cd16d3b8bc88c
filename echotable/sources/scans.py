"""Scans of what lies beside transcripts: manifests of joined audio, hash sidecars, question files, lists of recordings, backends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HASH = "^[0-9a-f]{64}$"
# Fixed value: the header of a manifest of joined audio.
JOINED = (
    "Source Order,Source Hash,Source Filename,Source Path,Source Duration,Source Duration (s),Source Format,Source Sample Rate,Source Channels,Source Bitrate (kbps),Source Title,Source Artist,Source Album,Source Date,"
    "Output Hash,Output Filename,Output Path,Output Duration,Output Duration (s),Output Format,Output Sample Rate,Output Channels,Output Bitrate (kbps),Output Title,Output Artist,Output Album,Output Comment,Source Count,Strategy,Fades,added_at"
).split(",")


def failing(df: DataFrame, label: Column, *rules: tuple[Column, str]) -> DataFrame:
    """df; reading a row for which a rule's condition isn't true fails with the label and the rule's text."""
    fault = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for ok, text in rules])
    return df.where(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(label, F.lit(": "), fault)).cast("boolean")))


def joined_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a manifest, as texts. Another header, a short row, a hash that isn't whole, or an order that isn't a number up to the count fails."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("mode", "FAILFAST").csv(path)
    if raw.columns != JOINED:
        raise ValueError(f"{path} hasn't the header of a joined manifest")
    c = lambda name: F.col(f"`{name}`")
    number = lambda name: c(name).rlike("^[1-9][0-9]*$")
    ordered = number("Source Order") & number("Source Count") & (F.expr("try_cast(`Source Order` AS decimal(38,0)) <= try_cast(`Source Count` AS decimal(38,0))"))
    whole = [(c(name).rlike(HASH), f"{name} isn't a whole hash") for name in ("Source Hash", "Output Hash")]
    return failing(raw.fillna(""), F.lit(path), *whole, (number("Source Order") & number("Source Count"), "an order or count isn't a positive number"), (ordered, "the order exceeds the count"))


def sidecars(spark: SparkSession, root: str, algorithm: str, sources: DataFrame) -> DataFrame:
    """path, audio_hash of the .audiohash files that hold for their source files (path, modified, sha256).

    The first word is the hash; one line must name the algorithm (`algorithm NAME`) and one the source's bytes (`source-sha256 HASH`); the
    sidecar must not be older than its source. Files of systems (`._*`, `@eaDir`) aren't sidecars.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.audiohash").load(root)
    files = files.where(~F.col("path").rlike(r"/\._[^/]*$") & ~F.col("path").contains("/@eaDir/"))
    lines = F.transform(F.split(F.col("content").cast("string"), r"\r\n|\r|\n"), lambda x: F.trim(x))
    rows = files.select(F.regexp_replace("path", r"\.audiohash$", "").alias("path"), F.col("modificationTime").alias("written"), lines.alias("lines"))
    said = F.regexp_extract(F.col("lines")[0], r"^(\S+)", 1)
    digests = F.filter(F.slice("lines", 2, 10**6), lambda x: x.startswith("source-sha256 "))
    rows = rows.select("path", "written", said.alias("hash"), F.array_contains(F.slice("lines", 2, 10**6), f"algorithm {algorithm}").alias("named"), F.when(F.size(digests) == 1, F.substring(digests[0], 15, 1000)).alias("bytes"))
    whole = F.lower("hash").rlike(HASH) & F.lower("bytes").rlike(HASH) & F.col("named")
    s = sources.select(F.col("path").alias("s_path"), "modified", "sha256")
    j = rows.where(whole).join(s, F.col("path") == F.col("s_path")).where((F.col("written") >= F.col("modified")) & (F.lower("bytes") == F.col("sha256")))
    return j.select("path", F.lower("hash").alias("audio_hash"))


def questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(targets, errors) of a JSON array of questions: targets are nth, question, target, chunk_id, audio_hash, start_sec, end_sec; errors nth, error.

    A question needs a text under `question` (`query` is retired) and a target or more; a target needs a chunk id or a whole hash as texts, and both ends
    of a time span or neither, numbers, the end behind the start, with a hash. The first fault of a record is its error, and none of its targets count.
    """
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    records = doc.select(F.posexplode(F.expr("variant_get(v, '$', 'array<variant>')")).alias("nth", "r"))
    kind = lambda of, name: F.coalesce(F.expr(f"schema_of_variant(variant_get({of}, '$.{name}', 'variant'))"), F.lit("absent"))
    text = lambda of, name: F.trim(F.expr(f"try_variant_get({of}, '$.{name}', 'string')"))
    is_text = lambda of, name: (kind(of, name) == "STRING") & (text(of, name) != "")
    own = F.when(~F.expr("schema_of_variant(r)").startswith("OBJECT"), "not an object").when(kind("r", "query") != "absent", "retired field query").when(~is_text("r", "question"), "no question")
    r = records.withColumns({"own": own, "targets": F.expr("try_variant_get(r, '$.targets', 'array<variant>')")})
    r = r.withColumn("own", F.coalesce("own", F.when(F.coalesce(F.size("targets"), F.lit(0)) < 1, "no target")))
    t = r.where("own IS NULL").select("nth", text("r", "question").alias("question"), F.posexplode("targets").alias("target", "t"))
    bad_text = lambda name: (kind("t", name) != "absent") & ~is_text("t", name)
    number = lambda name: kind("t", name).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$")
    there = lambda name: kind("t", name) != "absent"
    value = lambda name: F.expr(f"try_variant_get(t, '$.{name}', 'double')")
    fault = F.when(~F.expr("schema_of_variant(t)").startswith("OBJECT"), "not an object").when(bad_text("chunk_id"), "chunk_id must be a text").when(bad_text("audio_hash"), "audio_hash must be a text").when(there("audio_hash") & ~F.lower(text("t", "audio_hash")).rlike(HASH), "audio_hash isn't whole")
    fault = fault.when(there("start_sec") != there("end_sec"), "one end of a time span").when(there("start_sec") & ~(number("start_sec") & number("end_sec")), "times must be numbers").when(there("start_sec") & ((value("end_sec") <= value("start_sec")) | (value("start_sec") < 0)), "times out of order")
    fault = fault.when(~there("chunk_id") & ~there("audio_hash"), "neither chunk_id nor audio_hash").when(there("start_sec") & ~there("audio_hash"), "times without audio_hash")
    t = t.select("nth", "question", "target", text("t", "chunk_id").alias("chunk_id"), F.lower(text("t", "audio_hash")).alias("audio_hash"), value("start_sec").alias("start_sec"), value("end_sec").alias("end_sec"), fault.alias("fault"))
    broken = t.where("fault IS NOT NULL").groupBy("nth").agg(F.min_by(F.concat(F.lit("target "), F.col("target").cast("string"), F.lit(": "), F.col("fault")), "target").alias("error"))
    errors = r.where("own IS NOT NULL").select("nth", F.col("own").alias("error")).unionByName(broken)
    return t.where("fault IS NULL").drop("fault").join(broken.select(F.col("nth").alias("b")), F.col("nth") == F.col("b"), "left_anti"), errors


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """audio_hash, each once, of a list of recordings `{"version": 1, "audio_hashes": [...]}`; anything else fails."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    doc = doc.select(F.expr("schema_of_variant(variant_get(v, '$.version', 'variant'))").alias("kind"), F.expr("try_variant_get(v, '$.version', 'long')").alias("version"), F.expr("try_variant_get(v, '$.audio_hashes', 'array<string>')").alias("hashes"))
    doc = failing(doc, F.lit(path), ((F.col("kind") == "BIGINT") & (F.col("version") == 1), "not a list of version 1"), (F.col("hashes").isNotNull(), "no audio_hashes"))
    each = doc.select(F.explode("hashes").alias("h")).select(F.trim(F.coalesce("h", F.lit("null"))).alias("audio_hash")).where("audio_hash <> ''").distinct()
    return failing(each, F.lit(path), (F.col("audio_hash").rlike(HASH), "not a whole hash"))


def recent(spark: SparkSession, root: str, since: str, name: str = "transcript.json") -> DataFrame:
    """path, modified of files modified at `since` (a timestamp) or later, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("modifiedAfter", since).load(root)
    return files.select("path", F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path")


def samples(records: DataFrame) -> DataFrame:
    """One record of each model_key: that of the first path."""
    return records.withColumn("__nth", F.row_number().over(Window.partitionBy("model_key").orderBy("path"))).where("__nth = 1").drop("__nth")


def backends(spark: SparkSession, root: str, pattern: str = r"@lang-[a-z]{2}$") -> DataFrame:
    """workflow, backend, transcripts: the folders two levels below root whose name fits, those without a transcript too."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/*")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().toString().split("/")[-2:] for s in fs.globStatus(fs_path) or [] if s.isDirectory()]  # folders of models, of which there are few
    named = spark.createDataFrame([tuple(f) for f in found], "workflow string, backend string").where(F.col("backend").rlike(pattern))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "transcript.json").load(root)
    place = r"/([^/]+)/([^/]+)/[^/]+/transcript\.json$"
    n = files.select(F.regexp_extract("path", place, 1).alias("workflow"), F.regexp_extract("path", place, 2).alias("backend")).groupBy("workflow", "backend").agg(F.count("*").alias("transcripts"))
    return named.join(n, ["workflow", "backend"], "left").fillna(0, ["transcripts"])


def by_priority(records: DataFrame, priority: dict[str, int]) -> DataFrame:
    """records (audio_hash, model_key, ...) with nth from 1 in each recording: highest priority first, those without one last, by name."""
    p = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]) if priority else F.create_map().cast("map<string,int>")
    return records.withColumn("nth", F.row_number().over(Window.partitionBy("audio_hash").orderBy(F.desc_nulls_last(p[F.col("model_key")]), "model_key")).cast("long"))


def grouped(records: DataFrame) -> DataFrame:
    """audio_hash, models: the distinct model keys of each recording in order of names, and how many records it has."""
    return records.groupBy("audio_hash").agg(F.sort_array(F.collect_set("model_key")).alias("models"), F.count("*").alias("records"))
