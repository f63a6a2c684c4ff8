"""Content digests of files."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import PART_BYTES, PART_THRESHOLD, etag
from .paths import listed_files, located


def file_digests(
    spark: SparkSession,
    path: str,
    part_bytes: int = PART_BYTES,
    threshold: int = PART_THRESHOLD,
    single_part: bool = False,
    pattern: str = "*",
) -> DataFrame:
    """``path, length, etag`` of every file under a folder.

    Files under the threshold are digested whole by a built-in expression.
    Larger files become one row per part; tasks read and digest the parts
    independently, so one huge file is spread over the cluster and no content
    crosses the shuffle.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    small = files.where(F.col("length") < threshold).select(
        "path", "length", etag("content", part_bytes, threshold, single_part=True).alias("etag")
    )
    # files of no bytes, which the file source passes over
    none = listed_files(spark, path, pattern).where("length = 0").select(
        "path", "length", etag(F.unhex(F.lit("")), part_bytes, threshold, single_part).alias("etag")
    )
    # A digest over the whole of a large file has to read it in order: one part.
    size = F.col("length") if single_part else F.lit(part_bytes).cast("bigint")
    count = F.greatest(F.ceil(F.col("length") / size), F.lit(1)).cast("bigint")
    parts = (
        files.where(F.col("length") >= threshold)
        .select("path", "length", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("part"))
        .repartition(max(spark.sparkContext.defaultParallelism, 1), "path", "part")
    )

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        block = 4 * 1024 * 1024
        for batch in batches:
            sums = []
            for row in batch.itertuples(index=False):
                system, inner = located(row.path)
                total = hashlib.md5()
                with system.open_input_file(inner) as source:
                    source.seek(int(row.part) * int(row.size))
                    left = int(row.size)
                    while left > 0:
                        chunk = source.read(min(block, left))
                        if not chunk:
                            break
                        total.update(chunk)
                        left -= len(chunk)
                sums.append(total.hexdigest())
            yield batch[["path", "length", "part"]].assign(md5=sums)

    digested = parts.mapInPandas(digest, "path string, length bigint, part bigint, md5 string")
    # At most a few thousand digests of 32 characters per file.
    joined = digested.groupBy("path", "length").agg(
        F.count(F.lit(1)).alias("parts"),
        F.array_sort(F.collect_list(F.struct("part", "md5"))).alias("digests"),
    )
    text = F.array_join(F.transform("digests", lambda d: d["md5"]), "")
    if single_part:
        whole = text
    else:
        whole = F.concat(F.md5(F.unhex(text)), F.lit("-"), F.col("parts").cast("string"))
    large = joined.select("path", "length", F.concat(F.lit('"'), whole, F.lit('"')).alias("etag"))
    return small.unionByName(large).unionByName(none)
