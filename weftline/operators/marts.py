"""Gold marts over trips. Marts keep mergeable partial sums, so any split into batches gives the same mart."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import lookup

#: Labels of payment types.
PAYMENT_LABELS = {1: "Credit card", 2: "Cash", 3: "No charge", 4: "Dispute", 5: "Unknown", 6: "Voided trip"}


def with_zones(trips: DataFrame, zones: DataFrame, start: str, end: str, broadcast: bool = False) -> DataFrame:
    """Trips with pickup_borough, pickup_zone and dropoff_zone; zones (location_id, borough, zone) play two parts. ``broadcast`` is for zone tables of a known small size; otherwise Spark decides by measured size."""
    z = F.broadcast(zones) if broadcast else zones
    up = z.select(F.col("location_id").alias(start), F.col("borough").alias("pickup_borough"), F.col("zone").alias("pickup_zone"))
    down = z.select(F.col("location_id").alias(end), F.col("zone").alias("dropoff_zone"))
    return trips.join(up, start, "left").join(down, end, "left")


@dataclass(frozen=True)
class Mart:
    """Grouping keys (name to expression), rows that count, summed and averaged measures (name to column, digits)."""

    keys: dict[str, Column]
    where: Column
    sums: dict[str, tuple[str, int]]
    means: dict[str, tuple[str, int]]

    def partial(self, df: DataFrame) -> DataFrame:
        """trips, and for each measure a sum and a count of values."""
        aggs = [F.count("*").alias("trips")]
        for name, (c, _) in {**self.sums, **self.means}.items():
            aggs += [F.sum(c).alias(f"{name}__sum"), F.count(c).alias(f"{name}__n")]
        return df.withColumns(self.keys).filter(self.where).groupBy(*self.keys).agg(*aggs)

    def merged(self, *partials: DataFrame) -> DataFrame:
        """Partials of several batches as one."""
        both = partials[0]
        for p in partials[1:]:
            both = both.unionByName(p)
        return both.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in both.columns if c not in self.keys])

    def finished(self, partial: DataFrame) -> DataFrame:
        sums = [F.round(f"{n}__sum", d).alias(n) for n, (_, d) in self.sums.items()]
        means = [F.round(F.try_divide(F.col(f"{n}__sum"), F.col(f"{n}__n")), d).alias(n) for n, (_, d) in self.means.items()]
        return partial.select(*self.keys, "trips", *sums, *means)

    def of(self, df: DataFrame) -> DataFrame:
        return self.finished(self.partial(df))


def borough_hourly(pickup: str, total: str, fare: str, distance: str, tip_pct: str, unit: str = "hour") -> Mart:
    return Mart({"pickup_borough": F.col("pickup_borough"), "window_start": F.date_trunc(unit, pickup)}, F.col("pickup_borough").isNotNull(), {"total_revenue": (total, 2)}, {"avg_fare": (fare, 2), "avg_distance": (distance, 2), "avg_tip_pct": (tip_pct, 4)})


def zone_flows(fare: str, distance: str) -> Mart:
    return Mart({"pickup_zone": F.col("pickup_zone"), "dropoff_zone": F.col("dropoff_zone")}, F.col("pickup_zone").isNotNull() & F.col("dropoff_zone").isNotNull(), {}, {"avg_fare": (fare, 2), "avg_distance": (distance, 2)})


def payment_daily(pickup: str, total: str, payment: str = "payment_type") -> Mart:
    return Mart({"trip_date": F.to_date(pickup), "payment_type": F.col(payment), "payment_label": lookup(PAYMENT_LABELS, F.col(payment), "Unknown")}, F.col(payment).isNotNull(), {"total_revenue": (total, 2)}, {})


def upserted(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows, those with the key of a change replaced by it, new keys added. ``changes`` has a key once."""
    return target.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes)


def inserted(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows and those rows whose key is new; of rows with one key, the first in the order of all columns."""
    new = rows.join(target.select(*keys), list(keys), "left_anti")
    rest = [c for c in rows.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]) if rest else new.distinct()
    return target.unionByName(one)
