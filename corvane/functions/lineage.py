"""Hashes, identities, seeds and byte ranges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document_id(content: Column) -> Column:
    """The first 16 hex digits of the content's SHA-256."""
    return F.left(F.sha2(content, 256), F.lit(16))


def is_digest(x: Column) -> Column:
    return x.rlike("^[0-9a-fA-F]{64}$")


def canonical(row: Column) -> Column:
    """JSON text of a struct or map: keys must be given sorted; null fields are written."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def cache_key(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON of named fields, whatever order they come in."""
    return F.sha2(canonical(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def _unsigned(hexadecimal: Column) -> Column:
    """Up to 16 hex digits, big-endian, as decimal(20, 0): they exceed a signed long."""
    return F.conv(hexadecimal, 16, 10).cast("decimal(20,0)")


def mix_seed(base: Column, *parts: Column) -> Column:
    """The first four bytes of the SHA-256 of the parts joined by bars."""
    return _unsigned(F.left(F.sha2(F.concat_ws("|", base.cast("string"), *parts), 256), F.lit(8))).cast("long")


def noise_offset(seed: Column, most: Column) -> Column:
    """A place from 0 to most: the first eight bytes of the SHA-256 of "seed|noise-offset", unsigned, modulo most + 1; null for a negative most."""
    key = F.concat(seed.cast("string"), F.lit("|noise-offset"))
    return F.when(most >= 0, (_unsigned(F.left(F.sha2(key, 256), F.lit(16))) % (most + 1).cast("decimal(20,0)")).cast("long"))


def identity(table: DataFrame, *columns: str) -> DataFrame:
    """One row: n, identity. SHA-256 over the sorted digests of the rows' canonical JSON in the columns' order.

    Order of rows and other columns don't matter; nulls are written as such, so no two different rows read alike. Rows
    are hashed where they lie; digests are gathered by their first four digits, and of each group one digest for all, so
    no task holds more than a 65,536th of the table or 65,536 digests. An empty table has the digest of nothing.
    """
    row = F.sha2(canonical(F.struct(*[F.col(c) for c in columns])), 256)
    together = lambda x: F.sha2(F.array_join(F.array_sort(F.collect_list(x)), "\n"), 256)
    groups = table.select(row.alias("d")).groupBy(F.left("d", F.lit(4)).alias("k")).agg(F.count("*").alias("n"), together("d").alias("d"))
    of_group = F.concat(F.col("k"), F.col("d"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), together(of_group).alias("identity"))


def code_fingerprint(files: DataFrame, bundle: str, paths: list[str]) -> DataFrame:
    """(bundle, fingerprint): SHA-256 over a bundle's listed files (bundle, path, content: binary), in the list's order.

    Each path and what it holds end with a zero byte; a listed file that isn't there, or whose content is null, is
    "<missing>". Of files that share a path the least content counts. Only listed files are gathered, one content for each
    entry of the list.
    """
    held = files.where(F.col("path").isin(paths)).groupBy(bundle, "path").agg(F.min("content").alias("content"))
    there = held.groupBy(bundle).agg(F.map_from_entries(F.collect_list(F.struct("path", "content"))).alias("held"))
    zero = F.unhex(F.lit("00"))
    parts = [x for p in paths for x in (F.encode(F.lit(p), "UTF-8"), zero, F.coalesce(F.try_element_at("held", F.lit(p)), F.encode(F.lit("<missing>"), "UTF-8")), zero)]
    every = files.select(bundle).distinct().join(there, bundle, "left")
    return every.select(bundle, F.sha2(F.concat(F.unhex(F.lit("")), *parts), 256).alias("fingerprint"))


def byte_range(header: Column, size: Column) -> Column:
    """struct<status, first, last> for an HTTP range header over size bytes: 200 whole, 206 part, 416 unsatisfiable."""
    whole = F.struct(F.lit(200).alias("status"), F.lit(0).cast("long").alias("first"), F.greatest(size - 1, F.lit(0).cast("long")).alias("last"))
    bad = F.struct(F.lit(416).alias("status"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    h = F.trim(header)
    a = F.regexp_extract(h, r"^bytes=(\d*)-(\d*)$", 1)
    b = F.regexp_extract(h, r"^bytes=(\d*)-(\d*)$", 2)
    first, last = a.try_cast("long"), b.try_cast("long")
    fits = h.rlike(r"^bytes=\d*-\d*$") & ((a != "") | (b != ""))
    suffix = F.when((last <= 0) | last.isNull(), bad).otherwise(F.struct(F.lit(206).alias("status"), F.greatest(size - last, F.lit(0).cast("long")).alias("first"), (size - 1).alias("last")))
    part = F.struct(F.lit(206).alias("status"), first.alias("first"), F.least(F.coalesce(last, size - 1), size - 1).alias("last"))
    return F.when(header.isNull() | (h == ""), whole).when(~fits | (size <= 0), bad).when(a == "", suffix).when((first >= size) | first.isNull() | ((b != "") & (last < first)), bad).otherwise(part)


def is_current(now: Column, version: Column, most: int = 0) -> Column:
    """Whether a result's version is at most so far behind, and not ahead."""
    return (now - version).between(0, most)
