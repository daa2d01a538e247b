"""Digests of files of any size: byte ranges are hashed in tasks and joined by a hash tree.

A file of one range has its plain SHA-256. A longer one has the SHA-256 of its length and its nodes, each the SHA-256 of up to FAN ranges'
digests in order, so the result depends on the bytes and the range length alone, not on tasks. No row holds more than one list of FAN
digests or one of the nodes (a node is 256 GB). Tasks read through pyarrow's file systems (local, hdfs, s3, gs) in pieces of a megabyte.
"""

from __future__ import annotations

import hashlib
import urllib.parse
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Another range length gives other digests for files above it.
RANGE = 64 << 20
FAN = 4096
PIECE = 1 << 20


def opened(path: str):
    """A file of a listing, to read from any place; file:/x and s3a:// are spelled as pyarrow wants them."""
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return arrow_fs.LocalFileSystem().open_input_file("/" + (rest or scheme).lstrip("/"))
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    store, name = arrow_fs.FileSystem.from_uri(f"{scheme}:{urllib.parse.quote(rest, safe='/:@')}")
    return store.open_input_file(name)


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        digests = []
        for path, start, size in zip(batch["path"], batch["start"], batch["size"]):
            digest, left = hashlib.sha256(), int(size)
            with opened(path) as f:
                f.seek(int(start))
                while left:
                    piece = f.read(min(PIECE, left))
                    if not piece:
                        raise OSError(f"{path} is shorter than it was listed")
                    digest.update(piece)
                    left -= len(piece)
            digests.append(digest.hexdigest())
        yield batch[["path", "length", "start"]].assign(digest=digests)


def file_digests(found: DataFrame, tasks: int | None = None, length: int = RANGE) -> DataFrame:
    """A listing (path, length and others) with file_hash. A file that changed since it was listed raises or has the digest of the bytes listed.

    Ranges are dealt over tasks (by default as many as shuffle partitions), so one huge file is read by all of them. An empty file has one
    empty range; an empty listing gives no rows. Paths are taken as unique.
    """
    tasks = tasks or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(length).cast("long")))
    ranges = found.select("path", F.col("length").cast("long").alias("length")).select("path", "length", starts.alias("start"))
    ranges = ranges.withColumn("size", F.least(F.lit(length).cast("long"), F.col("length") - F.col("start"))).repartition(tasks, "path", "start")
    leaves = ranges.mapInPandas(_hashed, "path string, length long, start long, digest string")
    in_order = lambda at, what: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(at, what))), lambda x: x[what]))
    node = F.floor(F.col("start") / length / FAN).alias("node")
    nodes = leaves.groupBy("path", "length", node).agg(F.count("*").alias("n"), F.min("digest").alias("leaf"), F.sha2(in_order("start", "digest"), 256).alias("digest"))
    tree = nodes.groupBy("path", "length").agg(F.sum("n").alias("n"), F.min("leaf").alias("leaf"), in_order("node", "digest").alias("all"))
    whole = F.when(F.col("n") == 1, F.col("leaf")).otherwise(F.sha2(F.concat_ws(":", F.col("length").cast("string"), "all"), 256))
    return found.join(tree.select("path", whole.alias("file_hash")), "path")
