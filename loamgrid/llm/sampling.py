"""Samples whose category shares match given targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.clusters import present
from loamgrid.storage import Staged, broadcast_upto

BINS = 256


def letters(col: Column) -> Column:
    """Lower case, letters only; null without any."""
    s = F.regexp_replace(F.lower(col), r"[^\p{L}]+", "")
    return F.when(s != "", s)


def unit(*cols: Column) -> Column:
    """A uniform number in [0, 1) that depends only on the values."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


class TargetSample:
    """For each request, a sample of its pool's positions whose category shares match the request's targets.

    ``targets``: request_id, pool, kind, category, needed, complete_only; one row a target. ``rows``: pool, kind, category, the
    ``place`` columns that identify what is sampled, id, complete; any number of rows a place (deliveries repeat).

    1. Places: the distinct places of each wanted (pool, kind, category), combined map-side, with the least id.
    2. Acceptance: available against needed gives each target its probability, with slight oversampling (six standard
       deviations and ten rows), at most 1.
    3. Draw: every place of the target's category is accepted independently by a hash of request and place.
    4. Correction: the accepted places with the smallest hashes are kept, exactly the needed number. Only the hash bin in which
       the count is reached is ranked, so no target is gathered in one task. A target whose draw came out short
       though enough was available is drawn once more at probability 1.
    5. Deficits: needed less drawn, for each target; also for categories, pools and requests without rows (nothing drawn).

    A null category, pool or place is never sampled. Ties of hashes go by place. Empty tables give empty results.
    """

    def __init__(self, targets: DataFrame, rows: DataFrame, place: Sequence[str], broadcast_rows: int = 200_000):
        self.place, self.limit = list(place), broadcast_rows
        self.targets = Staged(targets.select("request_id", "pool", "kind", "category", F.col("needed").cast("long").alias("needed"), "complete_only"))
        # Each wanted group gets a number, fixed by being written down.
        wanted = self.targets.df.where("pool is not null").select("pool", "kind", "category").distinct()
        self.groups = Staged(wanted.withColumn("gid", F.monotonically_increasing_id()))
        rows = rows.select("pool", "kind", "category", *self.place, "id", "complete").dropna(subset=["pool", "category", *self.place])
        mine = rows.join(broadcast_upto(self.groups, broadcast_rows), ["pool", "kind", "category"])
        self.places = mine.groupBy("gid", *self.place).agg(F.min("id").alias("id"), F.min(F.when(F.col("complete"), F.col("id"))).alias("complete_id"))

    def plan(self, places: DataFrame | None = None) -> DataFrame:
        """The targets with available and probability."""
        places = self.places if places is None else places
        counts = places.groupBy("gid").agg(F.count("*").alias("n"), F.count("complete_id").alias("n_complete"))
        counts = self.groups.df.join(counts, "gid")
        out = self.targets.df.join(counts, ["pool", "kind", "category"], "left")
        out = out.withColumn("available", F.coalesce(F.when(F.col("complete_only"), F.col("n_complete")).otherwise(F.col("n")), F.lit(0)))
        want = F.least("needed", "available")
        p = F.least(F.lit(1.0), (want + 6 * F.sqrt(want) + 10) / F.col("available"))
        return out.withColumn("probability", F.when((F.col("available") > 0) & (F.col("needed") > 0), p).otherwise(0.0)).drop("n", "n_complete")

    def _accept(self, plan: DataFrame, places: DataFrame) -> DataFrame:
        met = places.join(plan, "gid").withColumn("id", F.when(F.col("complete_only"), F.col("complete_id")).otherwise(F.col("id"))).where("id is not null")
        met = met.withColumn("u", unit(F.col("request_id"), F.col("category"), *(F.col(c) for c in self.place))).where("u < probability")
        return met.select("request_id", "category", "needed", *self.place, "id", "u", F.least(F.lit(BINS - 1), F.floor(F.col("u") / F.col("probability") * BINS)).cast("int").alias("bin"))

    def _drawn(self) -> tuple[Staged, DataFrame]:
        """The written plan, and the sampled rows."""
        places = Staged(self.places)
        plan = Staged(self.plan(places.df))
        live = plan.df.where("probability > 0").select("request_id", "category", "gid", "needed", "available", "complete_only", "probability")
        got = Staged(self._accept(broadcast_upto(plan, self.limit, live), places.df))
        drawn = got.df.groupBy("request_id", "category").agg(F.count("*").alias("drawn"))
        short = Staged(live.join(drawn, ["request_id", "category"], "left").where(F.coalesce("drawn", F.lit(0)) < F.least("needed", "available")).drop("drawn").withColumn("probability", F.lit(1.0)))
        rows = got.df
        if short.rows:
            again = self._accept(broadcast_upto(short, self.limit), places.df)
            rows = rows.join(short.df.select("request_id", "category"), ["request_id", "category"], "left_anti").unionByName(again)
        bins = rows.groupBy("request_id", "category", "bin").agg(F.count("*").alias("in_bin"))
        below = F.sum("in_bin").over(Window.partitionBy("request_id", "category").orderBy("bin")) - F.col("in_bin")
        bins = bins.select("request_id", "category", "bin", below.alias("below"), "in_bin")
        rows = rows.join(bins, ["request_id", "category", "bin"]).where("below < needed")
        whole = rows.where("below + in_bin <= needed")
        edge = rows.where("below + in_bin > needed").withColumn("rank", F.row_number().over(Window.partitionBy("request_id", "category").orderBy("u", *self.place))).where("below + rank <= needed")
        keep = ["request_id", "category", *self.place, "id"]
        return plan, whole.select(*keep).unionByName(edge.select(*keep))

    def draw(self) -> DataFrame:
        """``request_id, category, <place>, id``: exactly min(needed, available) rows a target."""
        return self._drawn()[1]

    def report(self) -> DataFrame:
        """Every target with ``needed, available, drawn, deficit``; drawn counts the rows of the sample itself, deficit is what it lacks."""
        plan, rows = self._drawn()
        drawn = rows.groupBy("request_id", "category").agg(F.count("*").alias("drawn"))
        out = plan.df.select("request_id", "category", "needed", "available").join(drawn, ["request_id", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        return out.withColumn("deficit", F.greatest(F.lit(0).cast("long"), F.col("needed") - F.col("drawn")))

    def deficits(self) -> DataFrame:
        """Targets that the sample could not meet: request_id, category, needed, available, drawn, deficit."""
        return self.report().where("deficit > 0")


def request_targets(requests: DataFrame, targets: DataFrame, scenes: DataFrame) -> DataFrame:
    """The targets of stratified requests for TargetSample; needed is the larger of the share and per_class."""
    requests = requests.where(F.lower(F.trim("sampling")) == "stratified").select("request_id", "raster_path", F.col("label_name").alias("kind"), "sample_size", "per_class", F.coalesce("drop_nodata", F.lit(False)).alias("complete_only"))
    pools = scenes.groupBy("raster_path").agg(F.min("scene_id").alias("pool"))
    wanted = targets.dropna(subset=["request_id", "category"]).groupBy("request_id", letters(F.col("category")).alias("category")).agg(F.max("share_pct").cast("long").alias("share"))
    joined = wanted.join(requests, "request_id").join(pools, "raster_path", "left")
    # In whole numbers: the share's count rounded up.
    share = F.expr("(share * sample_size + 99) div 100")
    return joined.select("request_id", "pool", "kind", "category", F.greatest(F.coalesce(share, F.lit(0)), F.coalesce("per_class", F.lit(0))).alias("needed"), "complete_only")


def pixel_rows(pixels: DataFrame, bands: Sequence[str], kinds: Sequence[str] = ("label", "crop"), missing: Sequence[float] = (-9999.0,)) -> DataFrame:
    """Pixels as TargetSample rows: one for each class column that is filled."""
    complete = F.lit(True)
    for b in bands:
        complete = complete & present(F.col(b), *missing)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), letters(F.col(k)).alias("category")) for k in kinds)))
    rows = pixels.select(F.col("scene_id").alias("pool"), F.col("sample_id").alias("id"), "pix_row", "pix_col", complete.alias("complete"), each.alias("c"))
    return rows.select("pool", "id", "pix_row", "pix_col", "complete", "c.kind", "c.category").where("category is not null")
