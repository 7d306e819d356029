"""Other inputs: vocabularies, file listings and identities, JPEG headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from cutgrain.functions.text import trim

#: Extensions of videos (fixed values).
VIDEO_EXTENSIONS = ("mp4", "mov", "m4v", "mkv", "webm", "avi", "mts", "m2ts", "mpg", "mpeg", "wmv", "3gp")
PART = 65_536


def parse_vocabulary(files: DataFrame) -> DataFrame:
    """(file_id, text) -> (file_id, pos, name, hint): a tag a line, with a hint behind the first em dash between spaces, or else
    the first hyphen between spaces. Blank lines and those that start with # are skipped; a blank hint is none."""
    lines = files.select("file_id", F.posexplode(F.split("text", "\r?\n")).alias("pos", "raw")).withColumn("line", trim(F.col("raw"))).where("line != '' and not startswith(line, '#')")
    at = F.instr("line", " \u2014 ")
    at = F.when(at > 0, at).otherwise(F.instr("line", " - "))
    name = F.when(at > 0, F.substr("line", F.lit(1), at - 1)).otherwise(F.col("line"))
    hint = F.when(at > 0, F.substr("line", at + 3))
    got = lines.select("file_id", "pos", trim(name).alias("name"), trim(hint).alias("h"))
    return got.where("name != ''").select("file_id", "pos", "name", F.when(F.col("h") != "", F.col("h")).alias("hint"))


def is_video(path):
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(*VIDEO_EXTENSIONS)


def find_videos(spark: SparkSession, folder: str) -> DataFrame:
    """Direct children of a folder with a video's extension -> (path, length, modificationTime) by path; contents aren't read.
    A missing folder raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length", "modificationTime")
    return files.where(is_video(F.col("path"))).orderBy("path")


def file_identities(paths: DataFrame) -> DataFrame:
    """(path) of files that every executor sees -> (path, size, modified_ns, sample_hash): FNV-1a over the first, middle and
    last 64 KiB, or the whole of a small file; only those ranges are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        from decimal import Decimal

        for b in batches:
            rows = []
            for p in b["path"]:
                local = p.removeprefix("file://").removeprefix("file:")
                st = os.stat(local)
                with open(local, "rb") as f:
                    if st.st_size <= 3 * PART:
                        data = f.read()
                    else:
                        data = b""
                        for at in (0, (st.st_size - PART) // 2, st.st_size - PART):
                            f.seek(at)
                            data += f.read(PART)
                h = 14695981039346656037
                for x in data:
                    h = (h ^ x) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
                rows.append((p, st.st_size, Decimal(st.st_mtime_ns), Decimal(h)))
            yield pd.DataFrame(rows, columns=["path", "size", "modified_ns", "sample_hash"])

    return paths.select("path").mapInPandas(run, "path string, size bigint, modified_ns decimal(20,0), sample_hash decimal(20,0)")


@F.pandas_udf(StructType().add("width", IntegerType()).add("height", IntegerType()))
def jpeg_size(data: pd.Series) -> pd.DataFrame:
    """Of JPEG bytes, from the first frame header; nulls where there is none."""

    def one(b) -> tuple:
        i = 2
        if not b or bytes(b[:2]) != b"\xff\xd8":
            return None, None
        while i + 9 <= len(b):
            if b[i] != 0xFF:
                return None, None
            kind = b[i + 1]
            if kind == 0xFF:
                i += 1
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", bytes(b[i + 5 : i + 9]))
                return w, h
            elif kind == 0x01 or 0xD0 <= kind <= 0xD7:
                i += 2
            else:
                i += 2 + struct.unpack(">H", bytes(b[i + 2 : i + 4]))[0]
        return None, None

    return pd.DataFrame([one(x) for x in data], columns=["width", "height"]).astype("Int32")
