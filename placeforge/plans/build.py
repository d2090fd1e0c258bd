"""The gazetteer build: streets, localities, aliases, norm keys, as one set of frames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from placeforge.operators import alias, locality, street
from placeforge.sources import adapter
from placeforge.sources.tables import publish, read_published, settle


@dataclass
class Build:
    """Lazy frames of a build; only what is asked for is computed."""

    addresses: DataFrame
    postcodes: DataFrame
    bucket: DataFrame
    manual: DataFrame | None = None
    snapshot_id: str | None = None
    corrected: bool = False
    #: Tables that several others are made from are computed once, into the shared folder.
    settled: bool = False

    def _once(self, df: DataFrame) -> DataFrame:
        return settle(df) if self.settled else df

    @cached_property
    def variants(self) -> DataFrame:
        return street.counted_variants(self.addresses) if self.corrected else street.variants(self.addresses)

    @cached_property
    def streets(self) -> DataFrame:
        return self._once(street.canonical(self.variants, self.corrected))

    @cached_property
    def with_addresses(self) -> DataFrame:
        return self._once(locality.from_addresses(self.addresses))

    @cached_property
    def posts(self) -> DataFrame:
        return self._once(locality.postal(self.postcodes))

    @cached_property
    def places(self) -> DataFrame:
        """Merged localities without street counts."""
        own = self.with_addresses
        return self._once(locality.with_ids(locality.merge(own, locality.postcode_centroids(own, self.corrected), self.posts, self.snapshot_id)))

    @cached_property
    def localities(self) -> DataFrame:
        return locality.with_norm_key(locality.with_street_counts(self.places, self.streets))

    @cached_property
    def aliases(self) -> DataFrame:
        places = self.places.select("locality_id", "state", "locality", "postcode", "in_gnaf")
        kinds = [
            alias.from_principals(self.addresses, places),
            alias.from_state_bucket(self.bucket, places),
            alias.from_postal_variants(self.posts, places, self.with_addresses),
        ]
        if self.manual is not None:
            kinds.append(alias.from_manual(self.manual, places))
        return self._once(alias.finish(alias.combine(*kinds)))


def from_test_tables(spark: SparkSession, folder: str, snapshot_id: str = "2024-01", settled: bool = False) -> Build:
    addresses = adapter.address_ref(spark, folder)
    return Build(settle(addresses) if settled else addresses, adapter.postcodes(spark, folder), adapter.state_bucket(spark, folder), snapshot_id=snapshot_id, settled=settled)


def from_folder(spark: SparkSession, folder: str, snapshot_id: str | None = None) -> Build:
    """A build of the source tables address_ref, postcodes, state_bucket and, if it is there, alias_manual."""
    manual = read_published(spark, f"{folder}/alias_manual.parquet")
    given = [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("address_ref", "postcodes", "state_bucket")]
    return Build(*given, manual=manual, snapshot_id=snapshot_id, settled=True)


def publish_all(build: Build, folder: str) -> list[str]:
    """Builds and publishes in order: streets, then localities, which count them, then aliases; keys in the current version."""
    steps = {"streets": lambda: street.with_norm_key(build.streets), "localities": lambda: build.localities, "aliases": lambda: build.aliases}
    for name, table in steps.items():
        publish(table(), f"{folder}/{name}.parquet")
    return list(steps)
