"""Scanning images and archives (S1-S4). Bytes are inspected in Arrow batches inside Spark's tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.columns import crc32_hex, item_id, member_parts, subsampling_label
from tallymark.operators.catalog import nearest_quality
from tallymark.operators.validate import duplicates, require_non_empty, rule_rows, union_all, violation
from tallymark.sources.files import list_archives, list_files, read_listed
from tallymark.sources.sinks import materialize

PROFILE = (
    "path string, width int, height int, components int, progressive boolean, scan_count int, horizontal int, vertical int, "
    "luma_sum long, exif_bytes long, icc_bytes long, other_metadata_bytes long, exif_before_frame boolean, parse_error string"
)
#: Start-of-frame markers: all of 0xC0-0xCF but the Huffman (C4), extension (C8) and arithmetic (CC) tables.
FRAME_MARKERS = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def scan_images(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("jpg", "jpeg"), content: bool = True) -> DataFrame:
    """Files under ``root`` with one of the suffixes, in any case, empty ones too, by path (S1); an empty scan is an error."""
    files = list_files(spark, root).filter(F.lower("path").rlike(rf"\.({'|'.join(suffixes)})$")).select("path", F.col("length").alias("size"))
    require_non_empty(files, f"the scan of {root}")
    return read_listed(files, root) if content else files


def with_identity(images: DataFrame, root: str) -> DataFrame:
    """Adds relative path, digest, checksum and item id."""
    relative = F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/") + r"\E/", "")
    out = images.withColumn("relative_path", relative).withColumn("sha256", F.sha2("content", 256)).withColumn("crc32", crc32_hex(F.col("content")))
    return out.withColumn("item_id", item_id(F.col("relative_path"), F.col("sha256")))


def scan_sources(spark: SparkSession, root: str, smallest: int) -> tuple[DataFrame, DataFrame]:
    """Lossless sources under ``root`` and what disqualifies the set (S2): empty, not PNG, too small or repeated."""
    files = scan_images(spark, root, ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"))
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")
    png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    out = files.select("path", "size", png.alias("png"), F.sha2("content", 256).alias("sha256"), F.when(png, number(17)).alias("width"), F.when(png, number(21)).alias("height"))
    out = materialize(out, "sources")  # contents are read once
    rules = rule_rows(out, ["path"], {"empty": F.col("size") == 0, "not-png": ~F.col("png"), "too-small": F.greatest("width", "height") < smallest})
    return out.filter("png"), rules.unionByName(violation(duplicates(out, ["sha256"]), ["sha256"], "repeated-source", F.col("n")))


def scan_archive_catalog(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Members of many ZIP archives whose names follow the catalogue's rule (S3); second: repeated ones and archives that cannot be read, as violations.

    Of each archive only the directory at its end is read, whatever its size; no member is unpacked.
    """
    device, provenance, scene = member_parts(F.col("zip_member"))
    found = list_archives(spark, pattern)
    listed = found.withColumns({"device_id": device, "provenance": provenance, "scene_id": scene}).filter("scene_id is not null").drop("error")
    twice = violation(duplicates(listed, ["device_id", "provenance", "scene_id"]), ["device_id", "provenance", "scene_id"], "repeated-member", F.col("n"))
    return listed, twice.unionByName(violation(found.filter("error is not null"), ["archive_path"], "unreadable-archive", F.col("error")))


def header(data: bytes) -> dict[str, object]:
    """What a JPEG's segments say; a broken one keeps what came before, with ``parse_error``."""
    out: dict[str, object] = dict.fromkeys(("width", "height", "components", "progressive", "horizontal", "vertical", "luma_sum", "parse_error"))
    out |= {"scan_count": 0, "exif_bytes": 0, "icc_bytes": 0, "other_metadata_bytes": 0, "exif_before_frame": False}
    view = memoryview(data)
    if data[:2] != b"\xff\xd8":
        return out | {"parse_error": "no start-of-image marker"}
    at, size = 2, len(data)
    try:
        while (at := data.find(b"\xff", at)) >= 0:
            while at < size and data[at] == 0xFF:
                at += 1
            if at >= size or (marker := data[at]) == 0xD9:
                break
            at += 1
            if marker in (0x00, 0x01) or 0xD0 <= marker <= 0xD8:
                continue
            length = int.from_bytes(view[at : at + 2], "big")
            if at + 2 > size or length < 2 or at + length > size:
                raise ValueError("segment length out of range")
            body = view[at + 2 : at + length]
            at += length
            if marker == 0xDA:
                out["scan_count"] += 1
            elif marker in FRAME_MARKERS and out["width"] is None:
                n = body[5]
                out |= {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "components": n, "progressive": marker == 0xC2, "exif_before_frame": out["exif_bytes"] > 0}
                if len(body) < 6 + 3 * n:
                    raise ValueError("start of frame cut short")
                if n:
                    out |= {"horizontal": body[7] >> 4, "vertical": body[7] & 15}
            elif marker == 0xDB:
                pos = 0
                while pos < len(body):
                    wide, table = body[pos] >> 4, body[pos] & 15
                    step = 2 if wide else 1
                    values = body[pos + 1 : pos + 1 + 64 * step]
                    if wide > 1 or len(values) < 64 * step:
                        raise ValueError("quantization table cut short")
                    if table == 0:
                        out["luma_sum"] = sum(int.from_bytes(values[i : i + step], "big") for i in range(0, 64 * step, step))
                    pos += 1 + 64 * step
            elif marker == 0xE1 and body[:6] == b"Exif\0\0":
                out["exif_bytes"] += len(body)
            elif marker == 0xE2 and body[:12] == b"ICC_PROFILE\0":
                out["icc_bytes"] += len(body)
            elif 0xE0 <= marker <= 0xEF or marker == 0xFE:
                out["other_metadata_bytes"] += len(body)
    except (IndexError, ValueError) as error:
        out["parse_error"] = str(error) or "segment cut short"
    return out


def profile_images(images: DataFrame) -> DataFrame:
    """Header profile of ``images(path, content)`` with quality estimate and subsampling label.

    ``exif_before_frame`` is what a reader that stops at the first frame sees. Distinct contents should be profiled once.
    """

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in PROFILE.split(", ")]
        for batch in batches:
            rows = [{"path": p} | header(bytes(c)) for p, c in zip(batch["path"], batch["content"], strict=True)]
            frame = pd.DataFrame(rows, columns=names)
            whole = {"width": "Int32", "height": "Int32", "components": "Int32", "horizontal": "Int32", "vertical": "Int32", "luma_sum": "Int64", "scan_count": "Int32", "progressive": "boolean"}
            yield frame.astype(whole)

    out = images.select("path", "content").mapInPandas(profile, PROFILE)
    out = nearest_quality(out, "luma_sum").withColumn("quality_estimate", F.when(F.col("luma_sum").isNotNull(), F.col("quality_estimate")))
    return out.withColumn("subsampling", subsampling_label(F.col("components"), F.col("horizontal"), F.col("vertical")))


def archive_payload_rules(catalog: DataFrame, extracted: DataFrame) -> DataFrame:
    """Extracted bytes against the catalogue's length and checksum (V15): ``extracted(zip_member, content)``.

    Archives may have members of one name; then ``extracted`` has the ``archive_path`` too.
    """
    member = [c for c in ("archive_path", "zip_member") if c in extracted.columns]
    seen = extracted.select(*member, F.length("content").alias("_n"), crc32_hex(F.col("content")).alias("_crc"))
    joined = catalog.join(seen, member, "left")
    return union_all([rule_rows(joined, ["zip_member"], {"not-extracted": F.col("_n").isNull(), "length-mismatch": F.col("_n") != F.col("jpeg_bytes"), "checksum-mismatch": F.col("_crc") != F.col("crc32")})])
