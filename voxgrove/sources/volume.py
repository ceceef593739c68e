"""Sparse volumes: the proxy volume of the test tables, TIFF stacks, and dense arrays."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOXELS = "image_id string, idx long, x int, y int, z int, v int, width int, height int, depth int"


def proxy_volume(spark: SparkSession, sf_dir: str, modulus: int = 48) -> DataFrame:
    """One image of modulus x modulus x 7 voxels made of lineitem; v in 5..250."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x, y, z = (F.col("l_partkey") % modulus).cast("int"), (F.col("l_orderkey") % modulus).cast("int"), (F.col("l_linenumber") - 1).cast("int")
    rows = t.select(x.alias("x"), y.alias("y"), z.alias("z"), (F.col("l_quantity") * 5).alias("q")).groupBy("x", "y", "z").agg(F.max("q").cast("int").alias("v"))
    idx = ((F.col("z") * modulus + F.col("y")) * modulus + F.col("x")).cast("long")
    return rows.select(F.lit("proxy").alias("image_id"), idx.alias("idx"), "x", "y", "z", "v", F.lit(modulus).alias("width"), F.lit(modulus).alias("height"), F.lit(7).alias("depth"))


#: TIFF tags, and the formats of their value types.
WIDTH, LENGTH, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
VALUE_TYPES = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q", 18: "Q"}


def unpack_bits(raw: bytes) -> bytes:
    """PackBits: a run of literal bytes, or one byte repeated."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += raw[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(raw: bytes) -> bytes:
    """LZW as TIFF has it: most significant bit first, codes widen one entry early."""
    out, table, last = bytearray(), [], b""
    held, bits, width = 0, 0, 9
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        if not table:
            raise ValueError("an LZW strip must begin with a clear code")
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


#: Compression numbers and what undoes them.
DECODERS = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32773: unpack_bits, 32946: zlib.decompress}


def tiff_pages(raw: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each page, of a classic or a big TIFF in either byte order, with ``order``."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(raw[:2]))
    kind = struct.unpack_from(f"{order}H", raw, 2)[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF")
    big = kind == 43
    word, head, entry, room = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
    at = struct.unpack_from(f"{order}{word}", raw, 8 if big else 4)[0]
    while at:
        n = struct.unpack_from(f"{order}{head}", raw, at)[0]
        begin = at + struct.calcsize(head)
        tags: dict = {"order": order}
        for k in range(n):
            place = begin + entry * k
            tag, kind, count = struct.unpack_from(f"{order}HH{word}", raw, place)
            if kind in VALUE_TYPES:
                size = struct.calcsize(VALUE_TYPES[kind]) * count
                where = place + entry - room
                if size > room:
                    where = struct.unpack_from(f"{order}{word}", raw, where)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{VALUE_TYPES[kind]}", raw, where)
        yield tags
        at = struct.unpack_from(f"{order}{word}", raw, begin + entry * n)[0]


def _page(raw: bytes, tags: dict) -> tuple[np.ndarray, int]:
    one = lambda t, other=None: tags.get(t, (other,))[0]
    order, w, h, n, bits = tags["order"], one(WIDTH), one(LENGTH), one(SAMPLES, 1), one(BITS, 1)
    decode = DECODERS.get(one(COMPRESSION, 1))
    if not decode or bits not in (8, 16) or one(FORMAT, 1) != 1 or len(set(tags.get(BITS, (1,)))) > 1:
        raise ValueError("pages have unsigned samples of 8 or 16 bits, plain or by LZW, Deflate or PackBits")
    planar = one(PLANAR, 1) == 2 and n > 1
    layers, depth = (n, 1) if planar else (1, n)
    tiles = TILE_OFFSETS in tags
    tw, th = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiles else (w, min(one(ROWS, h), h))
    across, down = -(-w // tw), -(-h // th)
    out = np.zeros((layers, down * th, across * tw, depth), f"u{bits // 8}")
    blocks = zip(tags[TILE_OFFSETS if tiles else OFFSETS], tags[TILE_COUNTS if tiles else COUNTS], strict=True)
    for k, (at, size) in enumerate(blocks):
        layer, place = divmod(k, across * down)
        y, x = place // across * th, place % across * tw
        rows = th if tiles else min(th, h - y)
        data = np.frombuffer(decode(bytes(raw[at : at + size])), f"{order}u{bits // 8}", rows * tw * depth).reshape(rows, tw, depth)
        if one(PREDICTOR, 1) == 2:
            data = np.cumsum(data, axis=1, dtype=out.dtype)
        out[layer, y : y + rows, x : x + tw] = data
    pixels = out[:, :h, :w].max(axis=(0, 3))  # of several samples the brightest
    return pixels, bits


def decode_tiff(raw: bytes) -> Iterator[tuple[np.ndarray, int]]:
    """(pixels[height, width], bits) of each page: strips or tiles, unsigned samples of 8 or 16 bits,
    plain or compressed by LZW, Deflate or PackBits, with or without differences along rows. Of
    several samples the brightest is taken."""
    for tags in tiff_pages(raw):
        yield _page(raw, tags)


def encode_tiff(pages: list[np.ndarray]) -> bytes:
    """A classic little-endian TIFF of 8-bit pages, Deflate in strips of 64 rows."""
    out, at = bytearray(struct.pack("<2sHI", b"II", 42, 8)), []
    for k, page in enumerate(pages):
        h, w = page.shape
        strips = [zlib.compress(np.ascontiguousarray(page[y : y + 64], np.uint8).tobytes()) for y in range(0, h, 64)]
        n, base = len(strips), len(out) + 2 + 12 * 9 + 4
        starts = [base + 8 * n + sum(map(len, strips[:i])) for i in range(n)]
        tags = [(WIDTH, [w]), (LENGTH, [h]), (BITS, [8]), (COMPRESSION, [8]), (262, [1]), (OFFSETS, starts), (SAMPLES, [1]), (ROWS, [64]), (COUNTS, [len(x) for x in strips])]
        out += struct.pack("<H", len(tags))
        for tag, values in tags:
            where = values[0] if n == 1 or len(values) == 1 else base + (0 if tag == OFFSETS else 4 * n)
            out += struct.pack("<HHII", tag, 4, len(values), where)
        end = base + 8 * n + sum(map(len, strips))
        out += struct.pack("<I", end + end % 2 if k + 1 < len(pages) else 0)
        out += struct.pack(f"<{2 * n}I", *starts, *(len(x) for x in strips)) + b"".join(strips)
        out += b"\0" * (end % 2)
    return bytes(out)


def stack_names(path: str) -> bool:
    """Whether a path names one stack, not a folder."""
    return path.lower().endswith((".tif", ".tiff"))


STACKS = "*.[tT][iI][fF]*"


def read_tiff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-zero voxels of one .tif file, of a list of them, or of all those in a folder; 16-bit pixels
    are scaled to 8. Voxels leave a task page by page. A page is
    as deep in its image as its number; a file whose pages differ in size is refused."""
    reader = spark.read.format("binaryFile")
    if isinstance(path, str) and not stack_names(path):
        reader = reader.option("pathGlobFilter", STACKS)
    names = [c.split()[0] for c in VOXELS.split(", ")]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                name, raw = b.column(0)[i].as_py().rsplit("/", 1)[-1], b.column(1)[i].as_buffer()
                raw = memoryview(raw)
                depth = sum(1 for _ in tiff_pages(raw))
                shape = None
                for z, (p, bits) in enumerate(decode_tiff(raw)):
                    if (shape := shape or p.shape) != p.shape:
                        raise ValueError(f"the pages of {name} differ in size")
                    p = p >> (bits - 8) if bits > 8 else p
                    y, x = np.nonzero(p)
                    n, (h, w) = len(x), shape
                    whole = lambda v, n=n: np.full(n, v, np.int32)
                    cols = [(np.int64(z) * h + y) * w + x, x.astype(np.int32), y.astype(np.int32), whole(z), p[y, x].astype(np.int32), whole(w), whole(h), whole(depth)]
                    image = pa.array([name], pa.string()).take(pa.array(np.zeros(n, np.int32)))
                    yield pa.RecordBatch.from_arrays([image, *map(pa.array, cols)], names)

    # Spark bounds a batch by its bytes, so that files meet in one only while they are small
    return reader.load(path).select("path", "content").mapInArrow(run, VOXELS)


def write_tiff(volume: DataFrame, path: str) -> None:
    """One .tif file for each image in a folder, in whatever store it is. A stack is put together by
    one task, page by page; the driver moves one file at a time."""
    spark = volume.sparkSession
    pages = volume.groupBy("image_id", "z").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.first("depth").alias("depth"), F.collect_list(F.struct("x", "y", "v")).alias("at"))

    def page(batches):
        for b in batches:
            out = []
            for w, h, at in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("width", "height", "at")), strict=True):
                p = np.zeros((h, w), np.uint8)
                if at:
                    p[[q["y"] for q in at], [q["x"] for q in at]] = [q["v"] for q in at]
                out.append(zlib.compress(p.tobytes()))
            keep = [b.column(b.schema.get_field_index(c)) for c in ("image_id", "z", "width", "height", "depth")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.binary())], ["image_id", "z", "width", "height", "depth", "page"])

    drawn = pages.mapInArrow(page, "image_id string, z int, width int, height int, depth int, page binary")
    stacks = drawn.groupBy("image_id").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.first("depth").alias("depth"), F.collect_list(F.struct("z", "page")).alias("pages"))
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in stacks.toLocalIterator():
        have = {p["z"]: p["page"] for p in r["pages"]}
        none = np.zeros((r["height"], r["width"]), np.uint8)
        stack = [np.frombuffer(zlib.decompress(have[z]), np.uint8).reshape(none.shape) if z in have else none for z in range(r["depth"])]
        name = r["image_id"] if stack_names(r["image_id"]) else r["image_id"] + ".tif"
        out = store.create(hadoop.Path(f"{path}/{name}"), True)
        out.write(bytearray(encode_tiff(stack)))
        out.close()


def from_dense(spark: SparkSession, image_id: str, volume: np.ndarray) -> DataFrame:
    """Non-zero voxels of an array [z, y, x] on the driver; for small volumes."""
    d, h, w = volume.shape
    rows = [(image_id, int((z * h + y) * w + x), int(x), int(y), int(z), int(volume[z, y, x]), w, h, d) for z, y, x in np.argwhere(volume)]
    return spark.createDataFrame(rows, VOXELS)
