"""Image files: listing, header facts, decoding, and PNG export."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions import naming
from tilewright.functions.blocks import IMAGE_SCHEMA, flat_map, iter_rows, packed, pixels
from tilewright.session import arrow_uri, qualify, scratch_path

# The supported extensions in any case, checked while listing.
IMAGE_GLOB = "*.{" + ",".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext) for ext in naming.IMAGE_EXTENSIONS
) + "}"


# So many partitions of a scan make up one task. Spark puts few files into a partition, however small
# they are, so that a large folder would be read by many thousand tasks that do next to nothing.
LISTED_TOGETHER = 512
READ_TOGETHER = 64


def together(files: DataFrame, per_task: int) -> DataFrame:
    """A scan of files in fewer tasks, four to a core at least; larger scans get more."""
    parts = files.rdd.getNumPartitions()
    tasks = max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-parts // per_task))
    return files.coalesce(tasks) if tasks < parts else files


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All files directly in the folders: ``path, name, image_id, supported, length, modified``."""
    files = (
        spark.read.format("binaryFile")
        .load(path)
        .select(
            "path",
            naming.base_name(F.col("path")).alias("name"),
            naming.stem(F.col("path")).alias("image_id"),
            naming.is_supported_image(F.col("path")).alias("supported"),
            "length",
            F.col("modificationTime").alias("modified"),
        )
    )
    return together(files, LISTED_TOGETHER)


def scan_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Supported image files; file contents are not read."""
    return list_files(spark, path).filter("supported").drop("supported")


def stored_scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``image_id, path`` of the supported files as a table in the shared folder.

    The driver holds a listing, about a kilobyte to a file, as long as something refers to it; this
    one is let go once its names are stored.
    """
    folder = scratch_path(spark, "listing")
    scan_images(spark, path).select("image_id", "path").write.parquet(folder)
    return spark.read.parquet(folder)


def skipped_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return list_files(spark, path).filter("not supported").drop("supported")


def require_images(files: DataFrame) -> DataFrame:
    """The same table, or an error when it is empty."""
    if files.isEmpty():
        raise ValueError("no supported image files found")
    return files


def _png_header(data: memoryview) -> tuple[int, int, int, str]:
    width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
    # Channels per PNG colour type; palettes unfold to three.
    channels = {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}[colour]
    return height, width, channels, "uint16" if depth == 16 else "uint8"


def _jpeg_header(data: memoryview) -> tuple[int, int, int, str]:
    at = 2
    while at + 9 < len(data):
        marker, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        # Start-of-frame markers, without the three in their range that mean something else.
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width, channels = struct.unpack(">HHB", data[at + 5 : at + 10])
            return height, width, channels, "uint8"
        at += 2 + length
    raise ValueError("no frame header")


def _tiff_header(data: memoryview) -> tuple[int, int, int, str]:
    order = "<" if bytes(data[:2]) == b"II" else ">"
    (directory,) = struct.unpack(order + "I", data[4:8])
    (entries,) = struct.unpack(order + "H", data[directory : directory + 2])
    tags = {}
    for i in range(entries):
        at = directory + 2 + 12 * i
        tag, kind, count = struct.unpack(order + "HHI", data[at : at + 8])
        size = {1: 1, 3: 2, 4: 4}.get(kind)
        if size is None:
            continue
        where = at + 8
        if size * count > 4:
            (where,) = struct.unpack(order + "I", data[where : where + 4])
        code = {1: "B", 2: "H", 4: "I"}[size]
        (tags[tag],) = struct.unpack(order + code, data[where : where + size])
    # TIFF tags for width, height, bits, samples per pixel and sample format.
    width, height, bits = tags[256], tags[257], tags.get(258, 1)
    kind = {1: "uint", 2: "int", 3: "float"}[tags.get(339, 1)]
    return height, width, tags.get(277, 1), f"{kind}{max(bits, 8)}"


def _header(data: Any) -> dict[str, Any]:
    view = memoryview(data)
    start = bytes(view[:8])
    try:
        if start == b"\x89PNG\r\n\x1a\n":
            found = _png_header(view)
        elif start[:2] == b"\xff\xd8":
            found = _jpeg_header(view)
        elif start[:4] in (b"II*\x00", b"MM\x00*"):
            found = _tiff_header(view)
        else:
            raise ValueError("not a PNG, JPEG or TIFF file")
    except (ValueError, KeyError, IndexError, struct.error) as problem:
        return {"height": None, "width": None, "channels": None, "dtype": None, "error": str(problem)}
    return dict(zip(("height", "width", "channels", "dtype"), found, strict=True)) | {"error": None}


HEADER_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("image_id", T.StringType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def scan_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Size, channels and native number type per image, read off the file header.

    The decoded form always has 8 bits, so number types can only be told from here.
    """

    def one(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        yield {"path": row["path"], "image_id": row["image_id"], **_header(row["content"])}

    return _contents(spark, path).mapInArrow(flat_map(one, HEADER_SCHEMA), HEADER_SCHEMA)


def _contents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, image_id, content`` of the supported files, listed once for all that reads this table."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", IMAGE_GLOB)
        .load(path)
        .select("path", naming.stem(F.col("path")).alias("image_id"), "content")
    )
    return together(files, READ_TOGETHER)


# Chunks of a PNG that say nothing about its pixels.
PLAIN_CHUNKS = (b"pHYs", b"tEXt", b"zTXt", b"iTXt", b"tIME")


def plain_png(data: Any) -> np.ndarray | None:
    """The pixels of a PNG of 8-bit gray or RGB whose lines are stored as they are or as differences
    to the pixel before or above; nothing for any other file, or a broken one."""
    view, at, body, size = memoryview(data), 8, [], None
    if bytes(view[:8]) != b"\x89PNG\r\n\x1a\n":
        return None
    tag = b""
    while tag != b"IEND":
        if at + 12 > len(view):
            return None
        length, tag = struct.unpack(">I4s", view[at : at + 8])
        part = view[at + 8 : at + 8 + length]
        at += 12 + length
        if tag == b"IHDR" and length == 13 and len(part) == 13:
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", part)
            if depth != 8 or colour not in (0, 2) or any(rest) or not width or not height:
                return None
            size = height, width, 1 if colour == 0 else 3
        elif tag == b"IDAT":
            body.append(part)
        elif tag != b"IEND" and tag not in PLAIN_CHUNKS:
            return None
    if size is None:
        return None
    height, width, channels = size
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error:
        return None
    if len(raw) != height * (1 + width * channels):
        return None
    lines = np.frombuffer(raw, dtype=np.uint8).reshape(height, -1)
    kinds, array = lines[:, 0], lines[:, 1:]
    if kinds.max() > 2:
        return None
    if kinds.any():
        array = array.copy()
        for y in np.flatnonzero(kinds):
            if kinds[y] == 1:
                array[y] = array[y].reshape(-1, channels).cumsum(axis=0, dtype=np.uint8).ravel()
            elif y:
                array[y] += array[y - 1]
    return array.reshape(height, width) if channels == 1 else array.reshape(height, width, channels)


def image_path(origin):
    """The path of a decoded image, spelled as the file listing spells it.

    Its origin is URL-encoded (a literal ``+`` is not), and local files have three slashes there.
    """
    plain = F.url_decode(F.replace(origin, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "file:/")


DECODED_SCHEMA = T.StructType([T.StructField("path", T.StringType()), *IMAGE_SCHEMA.fields])


def _not_plain(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
    if plain_png(row["content"]) is None:
        yield {"path": row["path"], "image_id": row["image_id"], **_header(row["content"])}


def _plain(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
    array = plain_png(row["content"])
    if array is None:
        raise ValueError(f"{row['path']} was changed while it was read")
    yield {"path": row["path"], "image_id": row["image_id"], **packed(array)}


def _all_plain(others: DataFrame, refuse_deep: bool) -> bool:
    """Whether ``others``, the headers of files that numpy cannot decode, has no rows."""
    deep = F.col("dtype").isNotNull() & (F.col("dtype") != "uint8")
    found = others.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(deep, F.struct("path", "dtype"))).alias("deep")).head()
    if refuse_deep and found["deep"]:
        raise ValueError(f"only 8 bits per channel can be decoded, {found['deep']['path']} holds {found['deep']['dtype']}")
    return not found["n"]


def decode_images(spark: SparkSession, path: str | list[str], *, refuse_deep: bool = False) -> DataFrame:
    """``path`` and image rows (8 bits per channel, colour as red-green-blue).

    Undecodable files stay, with null size and data. Numpy decodes if all files are plain PNGs; if
    not, Spark's image source does, which takes milliseconds for the smallest file. It would cut
    off what a file holds beyond 8 bits; with ``refuse_deep`` such files are an error.
    """
    files = _contents(spark, path)
    if _all_plain(files.mapInArrow(flat_map(_not_plain, HEADER_SCHEMA), HEADER_SCHEMA), refuse_deep):
        return files.mapInArrow(flat_map(_plain, DECODED_SCHEMA), DECODED_SCHEMA)
    return _image_source(spark, path)


def _image_source(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same by Spark's image source, for all that it can decode."""

    def one(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        base = {"path": row["path"], "image_id": row["image_id"]}
        if row["height"] < 0:
            yield {**base, **dict.fromkeys(("height", "width", "channels", "dtype", "data"))}
            return
        array = pixels(row)
        if array.ndim == 3 and array.shape[2] == 3:
            array = array[..., ::-1]
        yield {**base, **packed(array)}

    decoded = (
        spark.read.format("image")
        .option("dropInvalid", False)
        .option("pathGlobFilter", IMAGE_GLOB)
        .load(path)
    )
    decoded = (
        together(decoded, READ_TOGETHER)
        .select(
            image_path(F.col("image.origin")).alias("path"),
            F.col("image.height").alias("height"),
            F.col("image.width").alias("width"),
            F.col("image.nChannels").alias("channels"),
            F.lit("uint8").alias("dtype"),
            F.col("image.data").alias("data"),
        )
        .withColumn("image_id", naming.stem(F.col("path")))
    )
    return decoded.mapInArrow(flat_map(one, DECODED_SCHEMA), DECODED_SCHEMA)


# So many chosen files are opened by one task at most.
OPENED_TOGETHER = 2048


@lru_cache(maxsize=16)
def _store(root: str) -> tuple[Any, str]:
    from pyarrow import fs as arrow_fs

    filesystem, base = arrow_fs.FileSystem.from_uri(arrow_uri(root))
    return filesystem, base.rstrip("/")


def read_file(path: str) -> bytes:
    """The bytes of a file by its path as a listing spells it: a scheme, and nothing is escaped."""
    scheme, authority, inside = re.fullmatch(r"([^:/]+):(?://([^/]*))?/*(.*)", path, re.DOTALL).groups()
    filesystem, base = _store(f"{scheme}://{authority or ''}/")
    with filesystem.open_input_file(f"{base}/{inside}") as file:
        return file.read()


def _opening(fn: Callable[[dict[str, Any]], Iterator[dict[str, Any]]]) -> Callable[[dict[str, Any]], Iterator[dict[str, Any]]]:
    """``fn`` for rows that have a ``path`` instead of the ``content``."""

    def run(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        return fn({**row, "content": read_file(row["path"])})

    return run


def decode_chosen(spark: SparkSession, chosen: DataFrame) -> DataFrame:
    """Image rows of the files in ``chosen`` (one ``path`` per row); nothing else is opened.

    Spark's readers would take the files as a list of paths, which the driver holds and lists one by
    one. So the paths stay a table, stored in the shared folder, and the tasks that get them open
    the files. If some need Spark's image source, all are copied to the shared folder, which it can
    read as a whole. Files that hold more than 8 bits are an error.
    """
    folder = scratch_path(spark, "chosen")
    chosen.select("path").distinct().write.parquet(f"{folder}/paths")
    paths = spark.read.parquet(f"{folder}/paths")
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-paths.count() // OPENED_TOGETHER))
    files = paths.repartition(tasks).withColumn("image_id", naming.stem(F.col("path")))

    def opened(fn: Callable[[dict[str, Any]], Iterator[dict[str, Any]]], schema: T.StructType) -> DataFrame:
        return files.mapInArrow(flat_map(_opening(fn), schema), schema)

    if _all_plain(opened(_not_plain, HEADER_SCHEMA), refuse_deep=True):
        return opened(_plain, DECODED_SCHEMA)

    def copy(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        parent, _, name = row["path"].rpartition("/")
        yield {"name": f"{hashlib.md5(parent.encode()).hexdigest()}/{name}", "content": row["content"]}

    write_files(opened(copy, FILE_SCHEMA), f"{folder}/copies")
    # The copies of a folder's files are in a folder of their own; there are few of these.
    parent = F.regexp_replace("path", "/[^/]*$", "")
    parents = paths.select(parent.alias("_parent")).distinct().withColumn("_key", F.md5("_parent"))
    decoded = _image_source(spark, f"{folder}/copies/*").withColumn("_key", F.element_at(F.split("path", "/"), -2))
    return decoded.join(F.broadcast(parents), "_key").select(
        F.concat("_parent", F.lit("/"), naming.base_name(F.col("path"))).alias("path"), *IMAGE_SCHEMA.names
    )


def readable(decoded: DataFrame) -> DataFrame:
    """The same image rows; a file that could not be decoded is an error."""
    message = F.concat(F.lit("cannot decode "), F.col("path"))
    return decoded.withColumn(
        "data",
        F.when(F.col("data").isNull(), F.raise_error(message).cast("binary")).otherwise(F.col("data")),
    )


def one_channel(masks: DataFrame) -> DataFrame:
    """The same mask rows; one with several channels is an error."""
    message = F.concat(F.lit("a mask has one channel: "), F.col("image_id"))
    return masks.withColumn(
        "channels",
        F.when(F.coalesce(F.col("channels"), F.lit(1)) == 1, F.col("channels")).otherwise(
            F.raise_error(message).cast("int")
        ),
    )


def decode_masks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Decoded masks; a mask with several channels is an error."""
    return one_channel(decode_images(spark, path))


def encode_png(array: np.ndarray) -> bytes:
    """An 8-bit gray or RGB picture as PNG bytes."""
    height, width = array.shape[:2]
    colour = 0 if array.ndim == 2 else 2
    lines = np.zeros((height, 1 + array[0].size), dtype=np.uint8)
    lines[:, 1:] = array.reshape(height, -1)

    def chunk(tag: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", header)
        + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6))
        + chunk(b"IEND", b"")
    )


FILE_SCHEMA = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType())]
)


def encode_images(images: DataFrame) -> DataFrame:
    """``name, content``: a PNG file per uint8 image row, named by its id."""

    def one(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        yield {"name": f"{row['image_id']}.png", "content": encode_png(pixels(row))}

    return images.select(*IMAGE_SCHEMA.names).mapInArrow(flat_map(one, FILE_SCHEMA), FILE_SCHEMA)


def write_files(files: DataFrame, folder: str) -> None:
    """Write rows ``name, content`` as files of ``folder``, from the tasks that hold the rows.

    A name may contain sub-folders. A file appears under its final name only when complete, and a
    repeated task writes it again with the same content.
    """
    target = arrow_uri(qualify(files.sparkSession, folder))

    def write(batches: Iterator) -> Iterator:
        from pyarrow import fs as arrow_fs

        filesystem, base = arrow_fs.FileSystem.from_uri(target)
        made = set()
        for row in iter_rows(batches):
            parent, _, name = f"{base}/{row['name']}".rpartition("/")
            if parent not in made:
                filesystem.create_dir(parent, recursive=True)
                made.add(parent)
            partial = f"{parent}/_{uuid.uuid4().hex}.partial"
            with filesystem.open_output_stream(partial) as out:
                out.write(row["content"])
            filesystem.move(partial, f"{parent}/{name}")
        return iter(())

    written = files.select("name", "content").mapInArrow(write, FILE_SCHEMA)
    written.write.format("noop").mode("overwrite").save()


def write_png(images: DataFrame, folder: str) -> None:
    """One PNG per uint8 image row."""
    write_files(encode_images(images), folder)
