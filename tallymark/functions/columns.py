"""Scalar expressions over evidence rows. All are native columns; none reads data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The luminance quantization table of the JPEG standard (Annex K.1), row by row.
LUMINANCE_Q50 = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]

STATISTICS = ("images_per_second", "elapsed_seconds", "microseconds_per_image")


def throughput(elapsed: Column, items: Column, statistic: str) -> Column:
    """One sample's value of a statistic (F6); null where the divisor is 0."""
    if statistic == "elapsed_seconds":
        return elapsed.cast("double")
    if statistic == "images_per_second":
        return F.try_divide(items.cast("double"), elapsed)
    if statistic == "microseconds_per_image":
        return F.try_divide(elapsed * 1e6, items)
    raise ValueError(f"unknown statistic {statistic!r}; one of {', '.join(STATISTICS)}")


def megapixels(width: Column, height: Column) -> Column:
    """F7; null unless both sides are positive."""
    return F.when((width > 0) & (height > 0), width.cast("long") * height / 1e6)


def bits_per_pixel(size: Column, width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), size * 8 / (width.cast("long") * height))


def subsampling_label(components: Column, horizontal: Column, vertical: Column) -> Column:
    """The name of the first component's sampling factors (F8); null where it has none."""
    is_ = lambda h, v: (horizontal == h) & (vertical == v)
    label = F.when(is_(1, 1), "4:4:4").when(is_(2, 1), "4:2:2").when(is_(2, 2), "4:2:0").otherwise("other")
    return F.when(components == 1, "grayscale").when((components == 3) & horizontal.isNotNull() & vertical.isNotNull(), label)


def process_context(protocol: Column, workers: Column) -> Column:
    """Loader runs with workers are checked inside the loader, all others in the main process."""
    return F.when((protocol == "loader-supply") & (F.coalesce(workers, F.lit(0)) > 0), "dataloader").otherwise("main-process")


def start_method_of_context(protocol: Column, workers: Column, method: Column) -> Column:
    return F.when(process_context(protocol, workers) == "dataloader", method)


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def location(provenance: Column, identity: Column) -> Column:
    """Where a platform ran (F13): its provenance's location, else its identity's; empty counts as missing."""
    return F.coalesce(non_empty(provenance), non_empty(identity))


def configuration_label(decoder: Column, threads: Column) -> Column:
    """``decoder[threads=n]``."""
    return F.concat(decoder, F.lit("[threads="), F.coalesce(threads.cast("string"), F.lit("default")), F.lit("]"))


def workload_name(long_edge: Column, quality: Column) -> Column:
    """F15; a null edge is the native size."""
    size = F.coalesce(F.format_string("le%04d", long_edge), F.lit("native"))
    size = F.when(long_edge.isNull(), "native").otherwise(size)
    return F.concat(F.lit("controlled-"), size, F.format_string("-q%03d", quality))


def scaled_short_edge(long_side: Column, short_side: Column, edge: Column) -> Column:
    """The short side after scaling the long one to ``edge``, rounded half up, 1 at least (F16)."""
    return F.greatest(F.lit(1).cast("long"), F.floor((short_side.cast("long") * edge + F.floor(long_side / 2)) / long_side).cast("long"))


def member_parts(path: Column) -> tuple[Column, Column, Column]:
    """``(device, provenance, scene)`` of a catalogue path whose parts agree with each other, else nulls."""
    pattern = r"^D(\d{2})_[^/]+/(orig|facebook|instagram|telegram|twitter|whatsapp)/D\1_img_\2_(\d{4})\.jpg$"
    part = lambda i: F.nullif(F.regexp_extract(path, pattern, i), F.lit(""))
    return F.concat(F.lit("D"), part(1)), part(2), part(3)


def crc32_hex(data: Column) -> Column:
    """X3."""
    return F.lpad(F.lower(F.hex(F.crc32(data))), 8, "0")


def normalized_name(name: Column) -> Column:
    """A distribution's name with runs of ``-_.`` as one hyphen."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def hyphenated_name(name: Column) -> Column:
    """An implementation's package name, each ``_`` or ``.`` a hyphen (the rule of J16)."""
    return F.lower(F.regexp_replace(name, "[_.]", "-"))


def luminance_sum(quality: Column) -> Column:
    """The sum of the standard luminance table scaled to an encoder quality of 1 to 100."""
    scale = F.when(quality < 50, F.floor(F.lit(5000) / quality)).otherwise(200 - 2 * quality)
    table = F.array(*[F.lit(v) for v in LUMINANCE_Q50])
    return F.aggregate(table, F.lit(0).cast("long"), lambda a, v: a + F.least(F.lit(255), F.greatest(F.lit(1), F.floor((v * scale + 50) / 100))).cast("long"))


def finite_positive(value: Column) -> Column:
    """X11; false for null."""
    return F.coalesce((value > 0) & ~F.isnan(value) & (value < float("inf")), F.lit(False))


def salted_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL, as lower-case hex: the key of seeded orders (W5, T1) and item ids."""
    joined = parts[0].cast("string")
    for p in parts[1:]:
        joined = F.concat(joined, F.char(F.lit(0)), p.cast("string"))
    return F.sha2(joined, 256)


def item_id(path: Column, digest: Column) -> Column:
    return salted_hash(path, digest)


def percent_change(new: Column, base: Column) -> Column:
    """X17."""
    return (F.try_divide(new, base) - 1) * 100


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_revision(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{40}([0-9a-f]{24})?$"), F.lit(False))


def unsafe_path(path: Column) -> Column:
    """Absolute, or with a parent step (V9)."""
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
