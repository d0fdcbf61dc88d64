"""The pN_ queries of the problems on training data, and their SQL where whole tables allow it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.llm.clusters import GridClusters
from loamgrid.llm.leaks import LeakSearch
from loamgrid.llm.packing import Packing
from loamgrid.llm.reading import fit_reading_model, reading_levels
from loamgrid.llm.sampling import TargetSample, letters, pixel_rows, request_targets
from loamgrid.llm.splits import grouped_split, hash_to_min, star_edges
from loamgrid.storage import Staged, read

BANDS = ("b02", "b03", "b04", "b08", "b11", "b12")
RANKS, CAPACITY = "/opt/tokenizers/byte_bpe_50k.tiktoken", 2048
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _clusters(spark: SparkSession, sf_dir: str) -> GridClusters:
    return GridClusters(read(spark, sf_dir, "pixels"), "sample_id", BANDS, eps=0.02, min_size=8)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).members().select("cluster_id", F.col("id").alias("sample_id"))


def p1_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's size, cells, the rows of its densest cell and its three most typical members."""
    return _clusters(spark, sf_dir).describe(3)


def _sample(spark: SparkSession, sf_dir: str) -> TargetSample:
    targets = request_targets(read(spark, sf_dir, "table_requests"), read(spark, sf_dir, "request_targets"), read(spark, sf_dir, "scenes"))
    return TargetSample(targets, pixel_rows(read(spark, sf_dir, "pixels"), BANDS), ["pix_row", "pix_col"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir).deficits().select("request_id", "category")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target with what was needed, available, drawn and lacking."""
    return _sample(spark, sf_dir).report().select("request_id", "category", "needed", "available", "drawn", "deficit")


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir).draw()


def p2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the sample: each target's exact count, of pixels of its class, at distinct positions."""
    pixels = pixel_rows(read(spark, sf_dir, "pixels"), BANDS).select("id", "category").distinct().withColumn("real", F.lit(True))
    rows = _sample(spark, sf_dir).draw().join(pixels, ["id", "category"], "left")
    each = rows.groupBy("request_id", "category", "pix_row", "pix_col").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("real", F.lit(False))).alias("real"))
    return each.groupBy("request_id", "category").agg(F.sum("n").alias("drawn"), F.bool_and("real").alias("of_the_class"), (F.max("n") == 1).alias("distinct_places"))


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with their tile as a number (the tile's least scene_id)."""
    scenes = read(spark, sf_dir, "scenes").where("scene_id is not null and tile is not null").groupBy("scene_id").agg(F.min("tile").alias("tile"))
    tiles = scenes.groupBy("tile").agg(F.min("scene_id").alias("tile_id"))
    return read(spark, sf_dir, "pixels").join(scenes.join(tiles, "tile").select("scene_id", "tile_id"), "scene_id", "left")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = _located(spark, sf_dir).where("poly_id > 0 and tile_id is not null")
    found = hash_to_min(star_edges(located, "poly_id", "tile_id", "pix_row", "pix_col")).df
    return found.where("node <> component").select(F.col("component").alias("group_id"), F.col("node").alias("poly_id"))


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Unlabelled rows link polygons as well; only the labelled ones come out.
    place = ["tile_id", "pix_row", "pix_col"]
    return grouped_split(_located(spark, sf_dir), "poly_id", place, place, SHARES, label=letters(F.col("label")), tries=16).where("label is not null")


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled pixel's group and split."""
    return _splits(spark, sf_dir).select("sample_id", "group_id", "split")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and share of each split, by class and overall (class null)."""
    rows = _splits(spark, sf_dir).select(letters(F.col("label")).alias("label"), "split")
    counts = rows.groupBy("label", "split").agg(F.count("*").alias("n"))
    both = counts.unionByName(counts.groupBy("split").agg(F.sum("n").alias("n")).withColumn("label", F.lit(None).cast("string")))
    total = F.sum("n").over(Window.partitionBy("label"))
    return both.select("label", "split", "n", F.round(F.col("n") / total, 4).alias("share"))


def _packing(spark: SparkSession, sf_dir: str) -> Packing:
    return Packing(read(spark, sf_dir, "documents"), "doc_id", "text", RANKS, CAPACITY)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each text that was split has one second piece in the containers.
    return _packing(spark, sf_dir).containers().where("piece = 1").select(F.col("key").alias("doc_id"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With as little unused space as possible: batches of several buckets in one container."""
    return _packing(spark, sf_dir).containers(mixed=True).withColumnRenamed("key", "doc_id")


def p7_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of one bucket each, for padded training batches."""
    return _packing(spark, sf_dir).containers().withColumnRenamed("key", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full containers are, of one bucket and mixed: one row a tenth of fill."""
    packing = _packing(spark, sf_dir)
    each = [packing.containers(mixed=m).groupBy("container_id").agg(F.sum("length").alias("used")).withColumn("filling", F.lit(n)) for m, n in ((False, "one bucket"), (True, "mixed"))]
    tenth = F.least(F.lit(9), F.floor(F.col("used") * 10 / CAPACITY)).cast("int")
    return each[0].unionByName(each[1]).groupBy("filling", tenth.alias("tenth")).agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))


def p7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: none above capacity, every token in one place, only longer texts split."""
    packing = _packing(spark, sf_dir)
    rows = packing.containers(mixed=True)
    full = rows.groupBy("container_id").agg(F.sum("length").alias("used")).agg(F.count(F.when(F.col("used") > CAPACITY, 1)).alias("overfull"))
    got = rows.groupBy("key").agg(F.sum("length").alias("length"), F.count("*").alias("pieces"))
    texts = packing.lengths.df.groupBy("key").agg(F.sum("tokens").alias("tokens"))
    both = texts.join(got, "key", "left").select("tokens", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("pieces", F.lit(0)).alias("pieces"))
    wrong = both.agg(
        F.count("*").alias("docs"),
        F.count(F.when(F.col("tokens") != F.col("length"), 1)).alias("wrong_length"),
        F.count(F.when(F.col("pieces") != F.ceil(F.col("tokens") / CAPACITY), 1)).alias("wrong_pieces"),
    )
    return wrong.join(F.broadcast(full))


def p6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the splits: all labelled rows are in one, no polygon and no ground position is in two."""
    place = ["tile_id", "pix_row", "pix_col"]
    out = Staged(_splits(spark, sf_dir).select("sample_id", "poly_id", "group_id", "split", *place))
    two = lambda df, *by: df.groupBy(*by).agg(F.count_distinct("split").alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("n"))
    got = out.df.agg(F.count("*").alias("labelled_rows"), F.count("split").alias("in_a_split"))
    for name, df in (("split_polygons", two(out.df.where("poly_id > 0"), "poly_id")), ("split_groups", two(out.df.where("group_id is not null"), "group_id")), ("split_places", two(out.df.dropna(subset=place), *place))):
        got = got.join(F.broadcast(df.withColumnRenamed("n", name)))
    return got


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LeakSearch(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "eval_items"), "item_id", "passage").leaks()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items leaked: documents and the largest share carried."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("docs"), F.round(F.max("share"), 3).alias("most"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_reading_model(read(spark, sf_dir, "graded_texts"), "text", "reading_level")
    docs = read(spark, sf_dir, "documents").where(F.lower(F.ltrim("lang")).startswith("en"))
    docs = docs.where(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= 60)
    return reading_levels(docs, "doc_id", "text", model)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select(F.col("key").alias("doc_id"), "reading_level")


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each level by category."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "category")
    return _levels(spark, sf_dir).join(docs, "key").groupBy("category", "reading_level").agg(F.count("*").alias("docs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_described, p2_found, p2_report, p2_sample, p2_rules, p6_found, p6_splits, p6_shares, p6_rules, p7_found, p7_containers, p7_batches, p7_fill, p7_rules, p8_found, p8_items, p9_found, p9_profile)}

_OK = " and ".join(f"{b} is not null and {b}::varchar <> 'nan' and {b} <> -9999" for b in BANDS)
_P2 = f"""
with need as (select r.request_id, t.category, greatest((max(t.share_pct) * any_value(sample_size) + 99) // 100, coalesce(any_value(per_class), 0)) as needed,
    any_value(label_name) as kind, coalesce(any_value(drop_nodata), false) as complete_only, any_value(scene_id) as scene_id
    from table_requests r join request_targets t using (request_id) left join scenes s using (raster_path)
    where lower(trim(sampling)) = 'stratified' group by 1, 2),
px as (select scene_id, pix_row, pix_col, ({_OK}) as ok, unnest(['label', 'crop']) as kind, unnest([label, crop]) as c from pixels),
places as (select scene_id, kind, regexp_replace(lower(c), '[^\\p{{L}}]', '', 'g') as category, pix_row, pix_col, bool_or(ok) as ok from px where c is not null group by all),
counts as (select scene_id, kind, category, count(*) as n, count(*) filter (ok) as n_ok from places group by all),
plan as (select request_id, need.category, needed, coalesce(case when complete_only then n_ok else n end, 0) as available
    from need left join counts on need.scene_id = counts.scene_id and need.kind = counts.kind and need.category = counts.category)
"""
ORACLE = {
    "p2_rules": _P2 + "select request_id, category, least(needed, available) as drawn, true as of_the_class, true as distinct_places from plan where least(needed, available) > 0",
    "p6_rules": "select count(*) as labelled_rows, count(*) as in_a_split, 0 as split_polygons, 0 as split_groups, 0 as split_places from pixels where label is not null",
    "p7_rules": "select count(distinct doc_id) as docs, 0 as wrong_length, 0 as wrong_pieces, 0 as overfull from documents",
    "p1_found": f"""
with v as (select sample_id, {', '.join(BANDS)}, floor(b02 / 0.02)::int as g, floor(b03 / 0.02)::int as h from pixels where {_OK}),
near as (select b.sample_id as s, a.sample_id as o, a.b02, a.b03, a.b04, a.b08, a.b11, a.b12, b.b02 as c02, b.b03 as c03, b.b04 as c04, b.b08 as c08, b.b11 as c11, b.b12 as c12
    from v a join (select *, unnest([g - 1, g, g + 1]) as ng from v) x on a.g = x.ng join v b on b.sample_id = x.sample_id and b.h between a.h - 1 and a.h + 1),
close_to as (select s, min(o) as cluster_id, count(*) as n from near
    where power(b02 - c02, 2) + power(b03 - c03, 2) + power(b04 - c04, 2) + power(b08 - c08, 2) + power(b11 - c11, 2) + power(b12 - c12, 2) <= 0.0004 group by s)
select cluster_id, s as sample_id from close_to where n >= 8""",
    "p2_found": _P2 + "select request_id, category from plan where available < needed",
    "p2_report": _P2 + "select request_id, category, needed, available, least(needed, available) as drawn, greatest(0, needed - available) as deficit from plan",
    "p6_found": """
with recursive put as (select distinct tile, pix_row, pix_col, poly_id from pixels join scenes using (scene_id) where poly_id > 0),
star as (select poly_id, min(poly_id) over (partition by tile, pix_row, pix_col) as least from put),
links as (select distinct poly_id as a, least as b from star where poly_id <> least),
both_ways as (select a, b from links union select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a)
select min(b) as group_id, a as poly_id from reach group by a having min(b) < a""",
}
