"""A MinHash band index over the set-valued members of records, as a table of (id, band, bucket)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kenmark.functions.minhash import BANDS, HASHES, band_table, tokens


class BandIndex:
    """Immutable bands of records; ``add`` and ``remove`` give another index.

    A record without tokens has no bands and is never found. Adding an id again keeps its
    earlier bands too. Ids that share a bucket of a band with a query are its result.
    """

    def __init__(self, rows: DataFrame, hashes: int = HASHES, bands: int = BANDS) -> None:
        self.rows, self.hashes, self.bands = rows, hashes, bands

    @classmethod
    def build(cls, records: DataFrame, key: str, fingerprint: str, hashes: int = HASHES, bands: int = BANDS) -> BandIndex:
        listed = records.select(F.col(key).alias("id"), tokens(F.col(fingerprint)).alias("_t"))
        return cls(band_table(listed, "id", "_t", hashes, bands), hashes, bands)

    def add(self, records: DataFrame, key: str, fingerprint: str) -> BandIndex:
        more = BandIndex.build(records, key, fingerprint, self.hashes, self.bands)
        return BandIndex(self.rows.unionByName(more.rows).distinct(), self.hashes, self.bands)

    def remove(self, ids: DataFrame) -> BandIndex:
        """``ids`` has a column id."""
        return BandIndex(self.rows.join(ids.select("id"), "id", "left_anti"), self.hashes, self.bands)

    def clear(self) -> BandIndex:
        return BandIndex(self.rows.limit(0), self.hashes, self.bands)

    def size(self) -> int:
        return self.rows.select("id").distinct().count()

    def query(self, records: DataFrame, key: str, fingerprint: str) -> DataFrame:
        """(query_id, id) of each query and the ids that share a bucket with it."""
        asked = BandIndex.build(records, key, fingerprint, self.hashes, self.bands).rows
        return asked.withColumnRenamed("id", "query_id").join(self.rows, ["band", "bucket"]).select("query_id", "id").distinct()
