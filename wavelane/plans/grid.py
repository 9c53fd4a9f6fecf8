"""Where windows go, which frames they hold and what a resumed run still needs.

A frame's windows follow from its position by arithmetic, so assigning frames to
windows needs no join: the regular windows of a frame are an interval of ids, and
the appended last window takes the frames behind `total - win`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ModelError


@dataclass(frozen=True)
class Grid:
    """Windows of `win` frames, `overlap` of which the next window shares."""

    win: int
    overlap: int

    def __post_init__(self) -> None:
        if self.win <= 0:
            raise ModelError(f"a window of {self.win} frames is not a window")
        if not 0 <= self.overlap <= self.win // 2:
            raise ModelError(f"overlap {self.overlap} isn't between 0 and half of the window {self.win}")

    @property
    def hop(self) -> int:
        return self.win - self.overlap

    def regular(self, total: Column) -> Column:
        """How many windows lie on the hops."""
        return F.when(total <= self.win, F.lit(1)).otherwise(F.floor((total - self.win) / self.hop) + 1).cast("long")

    def has_tail(self, total: Column) -> Column:
        return (total > self.win) & ((total - self.win) % self.hop != 0)

    def starts(self, total: Column) -> Column:
        """All starts in order, as an array."""
        hops = F.transform(F.sequence(F.lit(0).cast("long"), self.regular(total) - 1), lambda i: i * self.hop)
        return F.when(self.has_tail(total), F.concat(hops, F.array((total - self.win).cast("long")))).otherwise(hops)

    def schedule(self, tracks: DataFrame, total: str = "total", *keys: str) -> DataFrame:
        """A row a window: keys, win_id, start, take, next_start, is_first, is_last."""
        n = F.col(total).cast("long")
        rows = tracks.select(*keys, n.alias("total"), F.posexplode(self.starts(n)).alias("win_id", "start"))
        over = Window.partitionBy(*keys, "total").orderBy("win_id")
        last = F.lead("start").over(over)
        return rows.select(
            *keys, "total", "win_id", "start",
            F.least(F.col("total") - F.col("start"), F.lit(self.win)).alias("take"),
            F.coalesce(last, F.col("total")).alias("next_start"),
            (F.col("win_id") == 0).alias("is_first"), last.isNull().alias("is_last"),
        )

    def windows_of(self, pos: Column, total: Column) -> Column:
        """Ids of the windows that hold a frame, as an array of long."""
        reg = self.regular(total)
        low = F.when(pos < self.win, F.lit(0)).otherwise(F.floor((pos - self.win) / self.hop) + 1).cast("long")
        high = F.least(F.floor(pos / self.hop).cast("long"), reg - 1)
        hops = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))
        tail = F.when(self.has_tail(total) & (pos >= total - self.win), F.array(reg)).otherwise(F.array().cast("array<long>"))
        return F.when(total <= self.win, F.array(F.lit(0).cast("long"))).otherwise(F.concat(hops, tail))

    def start_of(self, win_id: Column, total: Column) -> Column:
        return F.when(total <= self.win, F.lit(0)).when(win_id < self.regular(total), win_id * self.hop).otherwise(total - self.win).cast("long")

    def assign(self, frames: DataFrame, pos: str = "pos", total: str = "total") -> DataFrame:
        """frames once for each window: with win_id, start, k (place in it), is_first, is_last."""
        n = F.col(total)
        out = frames.withColumn("win_id", F.explode(self.windows_of(F.col(pos), n)))
        count = self.regular(n) + self.has_tail(n).cast("long")
        start = self.start_of(F.col("win_id"), n)
        return out.withColumns({"start": start, "k": F.col(pos) - start, "is_first": F.col("win_id") == 0, "is_last": F.col("win_id") == count - 1})

    def fade(self, k: Column, is_first: Column, is_last: Column) -> Column:
        """Weight of place k of a window: up over its head, down over its tail, not at the track's ends."""
        steps = float(max(self.overlap - 1, 1))
        up = F.when(~is_first & (k < self.overlap), k / steps)
        down = F.when(~is_last & (k >= self.win - self.overlap), (self.win - 1 - k) / steps)
        return F.coalesce(down, up, F.lit(1.0)).cast("double")

    def resume(self, total: Column, frames: Column) -> Column:
        """struct(first, prime_from, keep_frames) of a run that has `frames` written."""
        starts = self.starts(total)
        at = F.greatest(F.size(F.filter(starts, lambda s: s <= frames)) - 1, F.lit(0))
        keep = F.get(starts, at)
        # Windows that end at or before the kept frames don't reach past the seam; starts ascend.
        short = F.size(F.filter(F.slice(starts, F.lit(1), at), lambda s: s + F.least(total - s, F.lit(self.win)) <= keep))
        done = frames >= total
        n = F.size(starts)
        return F.struct(
            F.when(done, n).otherwise(at).cast("long").alias("first"),
            F.when(done, n).otherwise(short).cast("long").alias("prime_from"),
            F.when(done, total).otherwise(keep).cast("long").alias("keep_frames"),
        )


def every_position(tracks: DataFrame, total: Column, name: str = "pos", per: int = 1 << 16) -> DataFrame:
    """tracks once for each place 0 to total - 1; a long track's places are made in blocks, by many tasks."""
    blocks = tracks.withColumn("__n", total.cast("long")).filter("__n > 0").withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / per))))
    first = F.col("__block") * per
    places = F.explode(F.sequence(first, F.least(first + per, F.col("__n")) - 1))
    return blocks.repartition(*tracks.columns, "__block").withColumn(name, places).drop("__n", "__block")


def neighbours(rows: DataFrame, track: list[str], order: list[str], bucket: Column, value: str) -> DataFrame:
    """rows with `before`, the value that comes before in their track's order; ranked inside buckets, as in positions."""
    rows = rows.withColumn("__bucket", bucket)
    last = rows.groupBy(*track, "__bucket").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    last = last.select(*track, "__bucket", F.lag("__last").over(Window.partitionBy(*track).orderBy("__bucket")).alias("__last"))
    own = Window.partitionBy(*track, "__bucket").orderBy(*order)
    inside = rows.withColumns({"__first": F.row_number().over(own) == 1, "before": F.lag(value).over(own)})
    joined = inside.join(last, [*track, "__bucket"])
    return joined.withColumn("before", F.when(F.col("__first"), F.col("__last")).otherwise(F.col("before"))).drop("__bucket", "__last", "__first")


def positions(rows: DataFrame, track: list[str], order: list[str], bucket: Column) -> DataFrame:
    """rows with pos, the place in their track, and total, the track's length.

    bucket rises with the order within a track. Buckets are counted and summed
    up, and rows are ranked inside a bucket only, so a long track is no single
    task.
    """
    rows = rows.withColumn("__bucket", bucket)
    counts = rows.groupBy(*track, "__bucket").agg(F.count("*").alias("__n"))
    up = Window.partitionBy(*track).orderBy("__bucket")
    counts = counts.select(*track, "__bucket", (F.sum("__n").over(up) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(*track)).alias("total"))
    rank = F.row_number().over(Window.partitionBy(*track, "__bucket").orderBy(*order)) - 1
    return rows.withColumn("__rank", rank).join(counts, [*track, "__bucket"]).withColumn("pos", (F.col("__before") + F.col("__rank")).cast("long")).drop("__bucket", "__rank", "__before")
