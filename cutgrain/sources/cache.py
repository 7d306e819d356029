"""The result cache: lines of JSON, one a described clip, of which the last of each file counts.

The names in a line are fixed values: caches that exist already have them. A line whose object repeats a key counts as
unreadable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutgrain.functions.hashing import BASIS, fnv1a
from cutgrain.functions.text import trim
from cutgrain.functions.variants import items, kind, number, once, string, whole
from cutgrain.session import cut

#: The version of the lines that this engine reads and writes.
VERSION = 1
_RANGE = "struct<start_s:double,end_s:double>"
#: What a line says of a clip.
CLIP = (
    "struct<duration_s:double,usage:struct<input_tokens:decimal(20,0),output_tokens:decimal(20,0)>,summary:string,"
    f"main:{_RANGE},segments:array<struct<start_s:double,end_s:double,description:string>>,"
    f"tags:struct<tags:array<struct<name:string,confidence:double,ranges:array<{_RANGE}>>>,new_tag_ideas:array<string>>,"
    "frames:array<struct<t:double,fp:binary>>>"
)


def identity(size: Column, modified_ns: Column, sample_hash: Column) -> Column:
    """A file's identity as text; sample_hash is in 16 hexadecimal digits."""
    return F.concat_ws("-", size.cast("string"), modified_ns.cast("string"), sample_hash)


def hash_digits(h: Column) -> Column:
    """An unsigned 64-bit number, as decimal, in 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.conv(h.cast("string"), 10, 16), 16, "0"))


def _fingerprint(v: Column, path: str) -> Column:
    """Padded standard base64 without stray bits, or null."""
    said = string(v, path)
    data = F.try_to_binary(said, F.lit("base64"))
    return F.when(F.base64(data) == said, data)


def _whole_rows(a: Column, *names: str) -> Column:
    """Whether an array is there and each of its structs has all of the names."""
    ok = lambda x: ~F.array_contains(F.array(*[x[n].isNull() for n in names]), True)
    return a.isNotNull() & F.forall(a, ok)


def _span(v: Column) -> Column:
    return F.struct(number(v, "$.start_s").alias("start_s"), number(v, "$.end_s").alias("end_s"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A file of lines, or a folder that append() wrote -> (line_no, raw); line_no orders lines as they were written."""
    read = spark.read.text(path)
    part = F.col("part").cast("string") if "part" in read.columns else F.lit("")
    at = F.struct(F.col("_metadata.file_modification_time").alias("written"), part.alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return read.select(at.alias("line_no"), F.col("value").alias("raw"))


def _read(j: Column) -> Column:
    """A line's record, as far as it is there."""
    digits = F.regexp_extract(string(j, "$.sample_hash"), r"^\+?0*([0-9A-Fa-f]+)$", 1)
    sample = F.when((digits != "") & (F.char_length(digits) <= 16), F.lower(F.lpad(digits, 16, "0")))
    segments = F.transform(items(j, "$.segments"), lambda s: F.struct(number(s, "$.start_s").alias("start_s"), number(s, "$.end_s").alias("end_s"), string(s, "$.description").alias("description")))
    main = F.struct(number(j, "$.main.start_s").alias("start_s"), number(j, "$.main.end_s").alias("end_s"))
    tag = lambda t: F.struct(string(t, "$.name").alias("name"), number(t, "$.confidence").alias("confidence"), F.transform(items(t, "$.ranges"), _span).alias("ranges"))
    tags = F.struct(F.transform(items(j, "$.tags.tags"), tag).alias("tags"), F.transform(items(j, "$.tags.new_tag_ideas"), lambda x: string(x, "$")).alias("new_tag_ideas"))
    frames = F.transform(items(j, "$.frames"), lambda f: F.struct(number(f, "$.t").alias("t"), _fingerprint(f, "$.fp").alias("fp")))
    clip = F.struct(
        number(j, "$.duration_s").alias("duration_s"),
        F.struct(whole(j, "$.usage.input_tokens").alias("input_tokens"), whole(j, "$.usage.output_tokens").alias("output_tokens")).alias("usage"),
        string(j, "$.summary").alias("summary"),
        once(main, lambda m: F.when(m["start_s"].isNotNull() & m["end_s"].isNotNull(), m)).alias("main"),
        segments.alias("segments"),
        F.when(F.coalesce(kind(j, "$.tags"), F.lit("VOID")) != "VOID", tags).alias("tags"),
        frames.alias("frames"),
    )
    return F.struct(whole(j, "$.v").alias("v"), whole(j, "$.size").alias("size"), whole(j, "$.modified_ns").alias("modified_ns"), sample.alias("sample_hash"), *[string(j, f"$.{c}").alias(c) for c in ("settings", "file", "model")], clip.alias("clip"))


def _judged(r: Column) -> Column:
    """A record with `good`: whether nothing that must be there is missing or of another type; and its identity."""
    c = r["clip"]
    t = c["tags"]
    tagged = t.isNull() | (_whole_rows(t["tags"], "name", "confidence", "ranges") & F.forall(t["tags"], lambda x: _whole_rows(x["ranges"], "start_s", "end_s")) & t["new_tag_ideas"].isNotNull() & F.forall(t["new_tag_ideas"], lambda x: x.isNotNull()))
    good = (r["v"] == VERSION) & tagged & _whole_rows(c["segments"], "start_s", "end_s", "description") & _whole_rows(c["frames"], "t", "fp")
    for x in [r[n] for n in ("size", "modified_ns", "sample_hash", "settings", "file", "model")] + [c["duration_s"], c["usage"]["input_tokens"], c["usage"]["output_tokens"], c["summary"]]:
        good = good & x.isNotNull()
    return F.struct(r.alias("r"), F.coalesce(good, F.lit(False)).alias("good"), identity(r["size"], r["modified_ns"], r["sample_hash"]).alias("identity"))


def _parsed(lines: DataFrame) -> DataFrame:
    """(line_no, raw) -> with a line's record, its identity, and whether it is good."""
    p = F.col("p")
    # generated, so that no filter above reads a line again
    got = lines.select("line_no", "raw", F.explode_outer(F.array(once(once(F.try_parse_json("raw"), _read), _judged))).alias("p"))
    return got.select("line_no", "raw", p["good"].alias("good"), p["identity"].alias("identity"), p["r"].alias("r")).select("line_no", "raw", "good", "identity", "r.*")


def read_cache(lines: DataFrame) -> DataFrame:
    """(line_no, raw) -> the last good record of each identity: (line_no, identity, size, modified_ns, sample_hash, settings, file, model,
    clip). A line that can't be read, or lacks a field, or has one of another type doesn't count, so an earlier one stays; only
    `main` is then just none. Newer versions are left to compact()."""
    last = Window.partitionBy("identity").orderBy(F.col("line_no").desc())
    got = _parsed(lines).where("good").drop("good", "raw", "v").withColumn("__r", F.row_number().over(last)).where("__r = 1")
    return got.select("line_no", "identity", "size", "modified_ns", "sample_hash", "settings", "file", "model", "clip")


def compact(lines: DataFrame) -> DataFrame:
    """(line_no, raw) -> the lines that a cleaned cache keeps: each identity's last, and newer versions word for word."""
    got = _parsed(lines).withColumn("newer", F.coalesce(F.col("v") > VERSION, F.lit(False))).where("good or newer").select("line_no", "raw", "newer", "identity")
    last = Window.partitionBy("newer", F.when(F.col("newer"), F.xxhash64("line_no")).otherwise(F.xxhash64("identity")), F.when(~F.col("newer"), F.col("identity"))).orderBy(F.col("line_no").desc())
    return got.withColumn("__r", F.row_number().over(last)).where("newer or __r = 1").select("line_no", "raw")


def record_lines(records: DataFrame) -> DataFrame:
    """(size, modified_ns, sample_hash, settings, file, model, clip) -> (value): lines that read_cache() gives back. `clip` is CLIP."""
    c = F.col("clip").cast(CLIP)
    said = {f: c[f] for f in ("duration_s", "usage", "summary", "main", "segments", "tags")}
    frames = F.transform(c["frames"], lambda f: F.struct(f["t"].alias("t"), F.base64(f["fp"]).alias("fp")))
    own = [F.lit(VERSION).alias("v"), *[F.col(x) for x in ("size", "modified_ns", "sample_hash", "settings", "file", "model")]]
    return records.select(F.to_json(F.struct(*own, *[x.alias(f) for f, x in said.items()], frames.alias("frames")), {"ignoreNullFields": "false"}).alias("value"))


def append(records: DataFrame, path: str, part: str) -> None:
    """Write records to the cache folder as one part; writing the same part again replaces it. Of a file that is in it twice the
    record whose clip sorts last is kept, so a part has no order of its own."""
    own = Window.partitionBy("size", "modified_ns", "sample_hash").orderBy(F.to_json("clip").desc(), F.col("settings").desc())
    once = records.withColumn("__r", F.row_number().over(own)).where("__r = 1").drop("__r")
    record_lines(once).write.mode("overwrite").text(f"{path}/part={part}")


#: Buckets of identities that a compacted folder has.
BUCKETS = 64
_STATE = "gen long, merged array<string>, homes array<long>"


def _bucket(identity: Column, raw: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(identity, raw)), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))


def _state(spark: SparkSession, path: str):
    """The newest generation: which parts it has in it, and which generation each bucket was written in (-1: none yet)."""
    if not _exists(spark, f"{path}/_state"):
        return None
    return spark.read.schema(_STATE).json(f"{path}/_state").orderBy(F.col("gen").desc()).first()


def _parts(spark: SparkSession, path: str) -> list[str]:
    """Names of the parts of a folder, from its listing alone."""
    if not _exists(spark, path):
        return []
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return sorted(r[0] for r in files.select(F.regexp_extract("path", "/part=([^/]*)/[^/]*$", 1).alias("p")).where("p != ''").distinct().collect())


def _folder_lines(spark: SparkSession, path: str, state, parts: list[str], buckets: list[int] | None) -> DataFrame | None:
    """(line_no, raw) of compacted buckets and of parts, those of parts later."""
    got = None
    homes = [] if state is None else [(b, g) for b, g in enumerate(state["homes"]) if g >= 0 and (buckets is None or b in buckets)]
    for recent, paths in ((0, [f"{path}/_base/gen={g}/bucket={b}" for b, g in homes]), (1, [f"{path}/part={p}" for p in parts])):
        if paths:
            read = spark.read.text(paths)
            at = F.struct(F.lit(recent).alias("recent"), F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
            lines = read.select(at.alias("line_no"), F.col("value").alias("raw"))
            got = lines if got is None else got.unionByName(lines)
    return got


def compact_folder(spark: SparkSession, path: str, buckets: int = BUCKETS) -> int:
    """Merge the parts that no compaction has had yet into the folder's buckets of identities -> the folder's generation.

    Only new parts and the buckets that their identities fall into are read and written; other buckets stay where an earlier
    generation wrote them. A generation counts once its state is there, so one that fails before leaves nothing to be seen and is
    written anew by the next; lines of newer versions are kept word for word. A part mustn't change once it is merged.
    """
    state = _state(spark, path)
    done = set(state["merged"]) if state else set()
    fresh = [p for p in _parts(spark, path) if p not in done]
    gen = state["gen"] if state else 0
    if not fresh:
        return gen
    buckets = len(state["homes"]) if state else buckets
    new = cut(_kept_lines(_folder_lines(spark, path, None, fresh, None)).withColumn("bucket", _bucket(F.col("identity"), F.col("raw"), buckets)))
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
    merged = _folder_lines(spark, path, state, fresh, touched)
    kept = _kept_lines(compact(merged)).withColumn("bucket", _bucket(F.col("identity"), F.col("raw"), buckets))
    kept.select(F.col("raw").alias("value"), "bucket").repartition("bucket").write.partitionBy("bucket").mode("overwrite").text(f"{path}/_base/gen={gen + 1}")
    homes = state["homes"] if state else [-1] * buckets
    homes = [gen + 1 if b in touched else g for b, g in enumerate(homes)]
    spark.createDataFrame([(gen + 1, sorted(done | set(fresh)), homes)], _STATE).coalesce(1).write.mode("append").json(f"{path}/_state")
    return gen + 1


def _kept_lines(lines: DataFrame) -> DataFrame:
    """(line_no, raw) that are good or of newer versions, with their identity."""
    got = _parsed(lines)
    return got.where(F.col("good") | (F.col("v") > VERSION)).select("line_no", "raw", F.when(F.col("good"), F.col("identity")).alias("identity"))


def read_folder(spark: SparkSession, path: str, identities: list[str] | None = None) -> DataFrame:
    """A folder's lines (line_no, raw) for read_cache(): its compacted buckets, and the parts that aren't merged yet. Where some
    identities are asked for, only their buckets are read. A folder without anything gives no lines."""
    state = _state(spark, path)
    done = set(state["merged"]) if state else set()
    wanted = None
    if identities is not None and state:
        asked = spark.createDataFrame([(x,) for x in identities], "i string")
        wanted = [r[0] for r in asked.select(_bucket(F.col("i"), F.lit(""), len(state["homes"]))).distinct().collect()]
    got = _folder_lines(spark, path, state, [p for p in _parts(spark, path) if p not in done], wanted)
    if got is None:
        at = "cast(null as struct<recent:int,written:timestamp,part:string,block:bigint,row:bigint>) as line_no"
        return spark.range(0).select(F.expr(at), F.lit("").alias("raw"))
    return got


def cached_answers(clips: DataFrame, cache: DataFrame) -> DataFrame:
    """clips (identity, settings, ...) with `cached` and the cached clip: same identity and the same settings. `cache` holds one
    record an identity already, so other settings there hide older ones of the same."""
    c = cache.select("identity", F.col("settings").alias("__s"), F.col("clip").alias("cached_clip"))
    got = clips.join(c, "identity", "left").withColumn("cached", F.coalesce(F.col("settings") == F.col("__s"), F.lit(False)))
    return got.withColumn("cached_clip", F.when(F.col("cached"), F.col("cached_clip"))).drop("__s")


def vocabulary_key(tags: list[tuple[str, str | None]] | None) -> str:
    """Of (name, hint) in their order: a hash over both with their separators; none without a vocabulary."""
    if tags is None:
        return "none"
    h = int(BASIS)
    for name, hint in tags:
        for byte in f"{name}\x1f{hint or ''}\x1e".encode():
            h = (h ^ byte) * 1099511628211 % 2**64
    return f"{h:016x}"


#: How a key names the samplings (fixed values).
SAMPLINGS = {"key_frames": "keyframes", "interval": "interval", "shots": "shots"}


def settings_key(model: Column, language: Column, sampling: str, important: bool, tags: str, subtitles: Column, notes: Column) -> Column:
    """Everything that an answer depends on beside the file, as one text (its form is a fixed value). subtitles is `off`, `none`,
    `unreadable` or the identity of the file beside the clip; tags is vocabulary_key(). Notes count only where they say something."""
    parts = [("model", model), ("language", language), ("frames", F.lit(SAMPLINGS[sampling])), ("moments", F.lit("important" if important else "full")), ("tags", F.lit(tags)), ("subtitles", subtitles)]
    base = F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), v) for k, v in parts])
    said = trim(F.coalesce(notes, F.lit("")))
    return F.when(said != "", F.concat(base, F.lit(" instructions="), hash_digits(fnv1a(said.cast("binary"))))).otherwise(base)
