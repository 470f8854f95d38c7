"""Space-time patterns: change, flow, clusters, coverage and calendar frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.functions.geo import METRES_PER_DEGREE
from terralog.plans.disc import disc_least, disc_links, disc_totals
from terralog.plans.grid import whole_cell_near, with_cell
from terralog.plans.iterate import components
from terralog.plans.ranking import with_range
from terralog.plans.running import last_seen, running
from terralog.session import cut
from terralog.spec import LOW_COVERAGE

MAX_FRAMES = 10_000
CELLS_PER_EPS = 1.6


def time_bin(ts: Column, gran: str) -> Column:
    """Start of the UTC day, week (Monday) or month."""
    if gran not in ("hour", "day", "week", "month"):
        raise ValueError(f"unknown granularity {gran}")
    return F.date_trunc(gran, ts)


def _expected(lo: str, hi: str, gran: str) -> Column:
    step = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}[gran]
    return F.expr(f"sequence(date_trunc('{gran}', TIMESTAMP '{lo}'), TIMESTAMP '{hi}' - INTERVAL 1 MICROSECOND, {step})")


def _in(lo: str, hi: str, ts: str = "ts") -> Column:
    return (F.col(ts) >= F.lit(lo).cast("timestamp")) & (F.col(ts) < F.lit(hi).cast("timestamp"))


def bin_coverage(obs: DataFrame, lo: str, hi: str, gran: str) -> DataFrame:
    """Occupied and expected bins of the half-open window; rows outside are excluded and counted."""
    inside = _in(lo, hi)
    bins = obs.groupBy(F.when(inside, time_bin(F.col("ts"), gran)).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    out = bins.agg(F.count("b").alias("occupied"), F.coalesce(F.sum(F.when(F.col("b").isNull(), F.col("c"))), F.lit(0)).alias("excluded"))
    return out.withColumn("expected", F.size(_expected(lo, hi, gran))).withColumn("ratio", F.col("occupied") / F.col("expected"))


def calendar_frames(obs: DataFrame, lo: str, hi: str, gran: str, tz: str) -> DataFrame:
    """Local calendar frames over the window; frames without observations stay, ``occupied`` false.

    Hours go by elapsed time: the hour that a clock change repeats is two frames of one name, the one it skips is none.
    """
    spark = obs.sparkSession

    def local_start(t):
        here = F.from_utc_timestamp(t, tz)
        into = F.unix_micros(here) - F.unix_micros(F.date_trunc(gran, here))
        # an hour is known by its first instant, longer frames by their local name
        return F.timestamp_micros(F.unix_micros(t) - into) if gran == "hour" else F.date_trunc(gran, here)

    lo_at, hi_at = (F.to_timestamp(F.lit(t)) for t in (lo, hi))
    step = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}[gran]
    end = hi_at if gran == "hour" else F.from_utc_timestamp(hi_at, tz)
    frames = F.sequence(local_start(lo_at), end - F.expr("INTERVAL 1 MICROSECOND"), F.expr(step))
    n = spark.range(1).select(F.size(frames).alias("n")).first().n
    if n > MAX_FRAMES:
        raise ValueError(f"{n} frames exceed {MAX_FRAMES}")
    seen = obs.where(_in(lo, hi)).groupBy(local_start(F.col("ts").cast("timestamp")).alias("frame")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(1).select(F.explode(frames).alias("frame"))
    name = F.from_utc_timestamp("frame", tz) if gran == "hour" else F.col("frame")
    return grid.join(seen, "frame", "left").select(name.alias("frame"), F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("occupied"))


def change(obs: DataFrame, unit: str, base: tuple[str, str], comp: tuple[str, str], gran: str = "day",
           min_coverage: float = 0.6, holdout_bins: int = 2) -> DataFrame:
    """Mean per unit in two ordered windows. A unit missing either is unknown; poor bin coverage of a
    window makes the whole result not applicable. ``drift`` compares the comparison mean with and
    without its last bins."""
    if comp[0] < base[1]:
        raise ValueError("the comparison window must start after the baseline")
    expected = _expected(*comp, gran)
    cut_at = F.try_element_at(expected, F.lit(-holdout_bins)) if holdout_bins else F.lit(comp[1]).cast("timestamp")
    b, c = _in(*base), _in(*comp)
    v = F.col("value")
    rows = obs.where(b | c)
    cover = rows.agg(
        F.struct((F.count_distinct(F.when(b, time_bin(F.col("ts"), gran))) / F.size(_expected(*base, gran))).alias("b"),
                 (F.count_distinct(F.when(c, time_bin(F.col("ts"), gran))) / F.size(expected)).alias("c")).alias("r")).scalar()
    per = rows.groupBy(unit).agg(
        F.avg(F.when(b, v)).alias("base_mean"), F.avg(F.when(c, v)).alias("comp_mean"),
        F.avg(F.when(c & (F.col("ts") < cut_at), v)).alias("prefix_mean"))
    ok = (F.col("_c.b") >= min_coverage) & (F.col("_c.c") >= min_coverage)
    both = F.col("base_mean").isNotNull() & F.col("comp_mean").isNotNull()
    d = per.withColumn("_c", cover)
    return d.select(
        unit, F.when(ok, F.col("base_mean")).alias("base_mean"), F.when(ok, F.col("comp_mean")).alias("comp_mean"),
        F.when(ok & both, F.col("comp_mean") - F.col("base_mean")).alias("delta"),
        F.when(ok & both, F.col("comp_mean") - F.col("prefix_mean")).alias("drift"),
        F.when(~ok, "not_applicable").when(both, "succeeded").otherwise("unknown").alias("status"),
        F.when(~ok, LOW_COVERAGE).when(~both, "missing-window").alias("reason"))


def change_blocks(obs: DataFrame, base: tuple[str, str], comp: tuple[str, str], block_m: float) -> DataFrame:
    """Mean difference per spatial block."""
    step = block_m / METRES_PER_DEGREE
    b, c = _in(*base), _in(*comp)
    return obs.where(b | c).groupBy(F.floor(F.col("lon") / step).cast("long").alias("bx"), F.floor(F.col("lat") / step).cast("long").alias("by")).agg(
        (F.avg(F.when(c, F.col("value"))) - F.avg(F.when(b, F.col("value")))).alias("delta"), F.count(F.lit(1)).alias("n"))


def moves(obs: DataFrame, entity: str, order: list[str], cell_deg: float, gran: str, max_gap: int) -> DataFrame:
    """Consecutive observations of an entity as cell-to-cell moves; a gap over ``max_gap`` bins breaks the chain.

    ``order`` starts with the observation time.
    """
    cell = F.concat_ws(":", F.floor(F.col("lon") / cell_deg).cast("long"), F.floor(F.col("lat") / cell_deg).cast("long"))
    days = {"hour": F.floor(F.unix_timestamp("ts") / 3600), "day": F.unix_date(F.to_date("ts")),
            "week": F.floor((F.unix_date(F.to_date("ts")) + 3) / 7), "month": F.year("ts") * 12 + F.month("ts")}[gran].cast("long")
    d = obs.select(entity, *order, cell.alias("cell"), days.alias("bin"))
    # ranges of the whole time line, so that one busy entity or day is still cut
    d = with_range(d.withColumn("_t", F.unix_micros(F.col(order[0]).cast("timestamp"))), "_t")
    d = running(d, [entity], order, F.col("_range"), [last_seen("_p", order, F.struct("cell", "bin"), inclusive=False)])
    return d.where("_p IS NOT NULL").select(entity, *order, F.col("_p.v.cell").alias("from_cell"), F.col("cell").alias("to_cell"), "bin",
                                           (F.col("bin") - F.col("_p.v.bin") > max_gap).alias("broken"))


def flow(moved: DataFrame) -> DataFrame:
    return moved.where("NOT broken AND from_cell <> to_cell").groupBy("from_cell", "to_cell").agg(F.count(F.lit(1)).alias("n"))


def _top(flows: DataFrame, k: int) -> DataFrame:
    return flows.orderBy(F.desc("n"), "from_cell", "to_cell").limit(k).select(F.concat_ws(">", "from_cell", "to_cell").alias("key"))


def jaccard(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Set similarity of two bounded lists."""
    both = a.select(col).distinct().withColumn("a", F.lit(1)).join(b.select(col).distinct().withColumn("b", F.lit(1)), col, "full")
    return both.agg(F.try_divide(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()), F.count(F.lit(1))).alias("jaccard"), F.count(F.lit(1)).alias("union_size"))


def flow_stability(moved: DataFrame, k: int, holdout_bins: int) -> DataFrame:
    """Jaccard of the top-k flows of the whole window and of the window without its last bins, with chain counts."""
    moved = cut(moved, "moves")
    last = moved.agg(F.max("bin").alias("m")).scalar()
    prefix = moved.withColumn("_m", last).where(F.col("bin") <= F.col("_m") - holdout_bins)
    counts = moved.agg(F.count_if("broken").alias("broken"), F.count_if(~F.col("broken") & (F.col("from_cell") != F.col("to_cell"))).alias("moves"),
                       F.count_if(~F.col("broken") & (F.col("from_cell") == F.col("to_cell"))).alias("stays"))
    j = jaccard(_top(flow(moved), k), _top(flow(prefix), k), "key").select("jaccard").scalar()
    return counts.withColumn("jaccard", j)


def _near_bins(cells: DataFrame, reach: int) -> DataFrame:
    """Cell rows seen from every bin within reach (column ``bin`` is the looking bin)."""
    return cells.withColumn("bin", F.explode(F.sequence(F.col("bin") - reach, F.col("bin") + reach)))


def _headed(core: DataFrame, eps_m: float) -> DataFrame:
    """Core spots with ``head``: cells surely smaller than ``eps_m`` are one cluster, known by their least core, elsewhere each core stands for itself."""
    h = eps_m / CELLS_PER_EPS / METRES_PER_DEGREE
    cells = with_cell(core.select("site", "lon", "lat", "bin"), "lon", "lat", h).withColumn("_whole", whole_cell_near(F.col("_row"), eps_m, h))
    heads = cells.where("_whole").groupBy("_row", "_col", "bin").agg(F.min("site").alias("head"))
    return cells.join(heads, ["_row", "_col", "bin"], "left").select("site", "lon", "lat", "bin", F.when(F.col("_whole"), F.col("head")).otherwise(F.col("site")).alias("head"))


def cluster(obs: DataFrame, eps_m: float, eps_bins: int, min_pts: int) -> DataFrame:
    """Space-time DBSCAN over ``obs_id, lon, lat, bin``: role core|border|noise and the cluster label.

    Neighbours are counted as totals; cores are linked by cells and tiles, each of which gives less than one link for a cell of cores, so no row is
    a pair. The label is the smallest core id. An observation without a place or bin has no neighbours and is noise; one without an id counts for others and is noise.
    """
    sited = F.col("lon").isNotNull() & ~F.isnan("lon") & (F.abs("lon") < float("inf")) & (F.abs("lat") <= 90.0) & F.col("bin").isNotNull()
    spots = cut(_spots(obs.where(sited)), "spots")
    named = spots.where("site IS NOT NULL")
    counts = disc_totals(named, _seen(spots, eps_bins), eps_m, "site", ["n"], match=("bin",))
    marked = cut(named.drop("n").join(counts.where(F.col("n") >= min_pts).select("site", F.lit(True).alias("core")), "site", "left"), "marked")
    core = cut(_headed(marked.where("core"), eps_m), "core")
    # a link has no direction, so later bins are enough
    later = core.withColumn("bin", F.explode(F.sequence(F.col("bin"), F.col("bin") + eps_bins)))
    links = disc_links(later, core, eps_m, "site", "head", match=("bin",))
    heads = components(core.select(F.col("head").alias("id")).distinct(), links).select(F.col("id").alias("head"), "label")
    labelled = cut(core.join(heads, "head").drop("head"), "labelled")
    touch = disc_least(_near_bins(marked.where("core IS NULL"), eps_bins), labelled, eps_m, "site", "label", match=("bin",))
    border = marked.join(touch, "site").select("lon", "lat", "bin", F.lit("border").alias("role"), "label")
    done = labelled.select("lon", "lat", "bin", F.lit("core").alias("role"), "label").unionByName(border)
    own = F.col("obs_id").isNotNull()
    return obs.join(done, ["lon", "lat", "bin"], "left").select(
        "obs_id", F.when(own & F.col("role").isNotNull(), F.col("role")).otherwise("noise").alias("role"), F.when(own, F.col("label")).alias("label"))


def _spots(obs: DataFrame) -> DataFrame:
    """Equal positions in one bin, with their least observation and their count."""
    return obs.groupBy("lon", "lat", "bin").agg(F.min("obs_id").alias("site"), F.count(F.lit(1)).alias("n"))


def _seen(spots: DataFrame, reach: int) -> DataFrame:
    """Counts by position as every bin within reach sees them."""
    return _near_bins(spots, reach).groupBy("lon", "lat", "bin").agg(F.sum("n").alias("n"))


def _core_spots(obs: DataFrame, eps_m: float, eps_bins: int, min_pts: int) -> DataFrame:
    """Positions and bins whose observations are cores of ``cluster``; neighbours are counted as totals, so no row is a pair and nothing is labelled."""
    spots = cut(_spots(obs), "spots")
    counts = disc_totals(spots, _seen(spots, eps_bins), eps_m, "site", ["n"], match=("bin",))
    return cut(spots.join(counts.where(F.col("n") >= min_pts).select("site"), "site", "left_semi"), "core")


def cluster_reach(obs: DataFrame, eps_m: float, eps_bins: int, min_pts: int, holdout_bins: int) -> DataFrame:
    """Share of the last bins' observations within reach of a core fitted without them."""
    obs = cut(obs, "obs")
    edge = obs.agg((F.max("bin") - holdout_bins).alias("m")).first()["m"]
    fit = obs.where(F.col("bin") <= edge)
    late = obs.where(F.col("bin") > edge)
    core = _core_spots(fit, eps_m, eps_bins, min_pts)
    spots = cut(_spots(late), "spots")
    hit = disc_totals(spots, _seen(core, eps_bins), eps_m, "site", ["n"], match=("bin",)).select("site", F.lit(1).alias("hit"))
    return spots.join(hit, "site", "left").agg(F.sum("n").alias("later"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("reached")).withColumn(
        "share", F.try_divide(F.col("reached"), F.col("later")))


def recurrence(created: Column, every_s: Column, at: Column) -> tuple[Column, Column]:
    """Latest occurrence at or before ``at`` and the next, anchored at the first target (created + interval)."""
    step = every_s * 1000
    target = created + step
    k = F.floor((at - target) / step)
    return F.when(at >= target, target + k * step), F.when(at >= target, target + (k + 1) * step).otherwise(target)
