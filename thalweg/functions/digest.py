"""Content digests in the style of object-store entity tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Part size and the size from which a file is digested in parts.
PART_BYTES = 50 * 1024 * 1024
PART_THRESHOLD = 50 * 1024 * 1024


def etag(
    content: Column | str,
    part_bytes: int = PART_BYTES,
    threshold: int = PART_THRESHOLD,
    single_part: bool = False,
) -> Column:
    """Quoted MD5, or MD5 of the part digests with the part count, of binary content."""
    data = F.col(content) if isinstance(content, str) else content
    whole = F.md5(data)
    if not single_part:
        parts = F.ceil(F.octet_length(data) / F.lit(part_bytes)).cast("int")
        digests = F.transform(
            F.slice(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0))), F.lit(1), parts),
            lambda i: F.unhex(F.md5(F.substring(data, i * part_bytes + 1, F.lit(part_bytes)))),
        )
        joined = F.aggregate(digests, F.unhex(F.lit("")), lambda total, one: F.concat(total, one))
        split = F.concat(F.md5(joined), F.lit("-"), parts.cast("string"))
        whole = F.when(F.octet_length(data) < threshold, whole).otherwise(split)
    return F.concat(F.lit('"'), whole, F.lit('"'))
