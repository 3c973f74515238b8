"""The catalogue of queries, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.functions import numeric as N
from tidemark.operators import cube, features, lattice, learning, metrics, raster, tasks, tcev
from tidemark.plans import views as V
from tidemark.schema import FEATURES, LAYERS, SERIES

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its name, with DuckDB SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


# ------------------------------------------------------------------ SQL shared by the oracles

KEY = 'grid_id, "row", col, season'
SEASON = "CASE WHEN month({0}) BETWEEN 3 AND 5 THEN 'spring' WHEN month({0}) BETWEEN 6 AND 8 THEN 'summer' WHEN month({0}) BETWEEN 9 AND 11 THEN 'autumn' ELSE 'winter' END"
PX = f"""px AS (SELECT l_suppkey % 12 + 1 AS grid_id, l_suppkey // 10 AS "row", l_suppkey % 10 AS col, CAST(l_shipdate AS DATE) AS scene_date,
  {SEASON.format("l_shipdate")} AS season, -l_extendedprice / 3000.0 AS db, l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM lineitem),
obs AS (SELECT *, CASE WHEN -CAST(db AS FLOAT) <= 30 THEN -CAST(db AS FLOAT) END AS x FROM px)"""
STATS = f"""{PX}, ranked AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY x, l_orderkey, l_linenumber, l_extendedprice) AS k,
  count(*) OVER (PARTITION BY {KEY}) AS n FROM obs WHERE x IS NOT NULL),
stats AS (SELECT *, CAST(k / (n + 1) AS FLOAT) AS f FROM ranked)"""
POINTS = f"""{STATS}, sv AS (SELECT {KEY}, k, CAST(x AS DOUBLE) AS x, CAST(f AS DOUBLE) AS f, -ln(-ln(CAST(f AS DOUBLE))) AS y FROM stats WHERE f > 0 AND f < 1 AND x <= 30),
pts AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY {KEY}) AS m FROM sv),
slopes AS (SELECT *, regr_slope(y, x) OVER (PARTITION BY {KEY} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s1,
  regr_slope(y, x) OVER (PARTITION BY {KEY} ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s2 FROM pts),
gaps AS (SELECT *, abs(CASE WHEN s2 IS NULL OR isnan(s2) THEN 0 ELSE s2 END - CASE WHEN s1 IS NULL OR isnan(s1) THEN 0 ELSE s1 END) AS gap FROM slopes),
picked AS (SELECT {KEY}, i AS b, gap FROM gaps WHERE i BETWEEN greatest(m // 2, m - 24) AND m - 5 QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY gap DESC, i DESC) = 1),
bk AS (SELECT g.*, CASE WHEN m >= 8 THEN coalesce(p.b, (m // 2 + m - 4) // 2) END AS b, p.gap AS best FROM (SELECT {KEY}, k, x, f, y, i, m FROM gaps) g LEFT JOIN picked p USING ({KEY})),
bp AS (SELECT *, max(CASE WHEN i = b THEN x END) OVER (PARTITION BY {KEY}) AS bp FROM bk)"""


def _line(side: str, cond: str) -> str:
    z = lambda e: f"CASE WHEN {e} IS NULL OR isnan({e}) THEN 0 ELSE {e} END"
    y, x = f"CASE WHEN {cond} THEN y END", f"CASE WHEN {cond} THEN x END"
    return f"{z(f'regr_slope({y}, {x})')} AS {side}_a, avg({y}) AS {side}_y, avg({x}) AS {side}_x, count({x}) AS {side}_n, regr_syy({y}, {x}) AS {side}_syy, regr_sxy({y}, {x}) AS {side}_sxy"


FIT = f"""{POINTS}, agg AS (SELECT {KEY}, max(m) AS m, max(bp) AS bp, arg_min(f, abs(x - bp) * 1e6 + i * 1e-9) AS bp_fx, {_line("l", "i < b")}, {_line("r", "i >= b")}, {_line("w", "true")} FROM bp GROUP BY {KEY}),
lines AS (SELECT *, l_y - l_a * l_x AS c1, l_a * bp + l_y - l_a * l_x - r_a * bp AS c2 FROM agg),
keys AS (SELECT DISTINCT {KEY} FROM stats),
errs AS (SELECT k.*, l.* EXCLUDE ({KEY}), CASE WHEN coalesce(m, 0) < 8 THEN 'too few points' WHEN abs(l_a) < 1e-10 OR abs(r_a) < 1e-10 THEN 'slope near zero' END AS fit_error FROM keys k LEFT JOIN lines l USING ({KEY})),
fit AS (SELECT {KEY}, fit_error,
  CASE WHEN fit_error IS NULL THEN r_a / l_a END AS R_index, CASE WHEN fit_error IS NULL THEN l_a END AS L1_alpha, CASE WHEN fit_error IS NULL THEN -c1 / l_a END AS L1_beta,
  CASE WHEN fit_error IS NULL THEN r_a END AS L2_alpha, CASE WHEN fit_error IS NULL THEN -c2 / r_a END AS L2_beta,
  CASE WHEN fit_error IS NULL THEN bp END AS breakpoint_DB, CASE WHEN fit_error IS NULL THEN bp_fx END AS breakpoint_FX,
  CASE WHEN fit_error IS NULL THEN sqrt(greatest(l_syy - l_a * l_sxy + r_syy - r_a * r_sxy + r_n * (r_y - r_a * r_x - c2) ** 2, 0) / m) END AS piecewise_residual,
  CASE WHEN fit_error IS NULL THEN sqrt(greatest(w_syy - w_a * w_sxy, 0) / m) END AS linear_residual,
  CASE WHEN fit_error IS NULL THEN CAST(m AS DOUBLE) END AS n_valid FROM errs)"""
SC = f"""{PX}, sc AS (SELECT *, 'month_' || lpad(CAST(month AS VARCHAR), 2, '0') || '/grid_' || lpad(CAST(grid_id AS VARCHAR), 2, '0') || '/' || file_name AS path FROM
  (SELECT DISTINCT grid_id, scene_date, season, month(scene_date) AS month, 'Image_' || strftime(scene_date, '%Y%m%d') || '_VH_' || grid_id || '.tif' AS file_name FROM px))"""
TL = f"""{PX}, tl0 AS (SELECT "row", col, l_returnflag AS ord, round(avg(CAST(x AS DOUBLE)), 6) AS v FROM obs GROUP BY ALL),
tl AS (SELECT "row", col, ord, CASE WHEN v <= 16 THEN v END AS value FROM tl0)"""
MK = """mk AS (SELECT s_suppkey // 10 AS "row", s_suppkey % 10 AS col, CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END AS mask FROM supplier WHERE s_suppkey % 7 <> 3)"""
LB = """lb AS (SELECT doc_id, quality AS label, round((n_chars - 1500) / 1000.0, 6) AS logit, round(1 / (1 + exp(-round((n_chars - 1500) / 1000.0, 6))), 6) AS score FROM documents JOIN labels USING (doc_id))"""
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in LAYERS)

# ------------------------------------------------------------------ names and the scene catalogue

_NAMES = ["Image_{d}_VH_{g}.tif", "Image_{d}_VV_{g}.TIFF", "S1-{d}-x_{g}.tif", "Image_20150230_VH.tif", "Fx_{d}.tif", "event-{g}_{d}.tif", "event_Fx_{d}_a.tif", "month_{g}", "plain.tif", "x_202301_y.img"]
_NAMES_SQL = "SELECT unnest([" + ", ".join("'" + n.replace("{d}", "' || strftime(scene_date, '%Y%m%d') || '").replace("{g}", "' || grid_id || '") + "'" for n in _NAMES) + "]) AS name FROM sc"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, grid = F.date_format("scene_date", "yyyyMMdd"), F.col("grid_id").cast("string")

    def filled(pattern: str) -> Column:
        parts = [p for p in pattern.replace("{d}", "\0d\0").replace("{g}", "\0g\0").split("\0") if p]
        return F.concat(*({"d": day, "g": grid}.get(p, F.lit(p)) for p in parts))

    return V.scenes(spark, sf_dir).select(F.explode(F.array(*map(filled, _NAMES))).alias("name")).distinct()


@query(f"""WITH {SC}, nm AS (SELECT DISTINCT name FROM ({_NAMES_SQL})),
t AS (SELECT name, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM nm), u AS (SELECT *, split_part(stem, '_', 2) AS tok, nullif(regexp_extract(name, '\\d{{4}}(\\d{{2}})\\d{{2}}', 1), '') AS loose, regexp_split_to_array(stem, '[_\\-]') AS toks FROM t),
v AS (SELECT *, CASE WHEN regexp_full_match(tok, '\\d{{8}}') THEN CAST(try_strptime(tok, '%Y%m%d') AS DATE) END AS day2 FROM u)
SELECT name, nullif(regexp_extract(name, '(?i)_(\\d+)\\.(tif|tiff)$', 1), '') AS orbit,
 CAST(coalesce(month(day2), CASE WHEN CAST(loose AS INT) BETWEEN 1 AND 12 THEN CAST(loose AS INT) END) AS INT) AS month, CAST(day2 AS VARCHAR) AS strict_date,
 list_filter(toks, lambda z: regexp_full_match(z, '\\d{{8}}'))[1] AS date_token,
 CAST(CAST(list_filter(list_transform(toks, lambda z: CASE WHEN regexp_full_match(z, '\\d{{8}}') THEN try_strptime(z, '%Y%m%d') END), lambda d: d IS NOT NULL)[1] AS DATE) AS VARCHAR) AS first_date,
 CASE WHEN CAST(nullif(regexp_extract(name, '(?i)month[_-]?(\\d{{1,2}})', 1), '') AS INT) BETWEEN 1 AND 12 THEN CAST(regexp_extract(name, '(?i)month[_-]?(\\d{{1,2}})', 1) AS INT) END AS folder_month,
 replace(name, 'event_Fx_', 'event_Fx_Masked_') AS masked_name FROM v""")
def filename_parse(spark, sf_dir):
    """PRJ1-5, 7, 18 on well-formed and malformed names."""
    n = F.col("name")
    return _names(spark, sf_dir).select(
        n, names.orbit(n).alias("orbit"), names.month(n).alias("month"), names.strict_date(n).cast("string").alias("strict_date"), names.date_token(n).alias("date_token"),
        names.first_date(n).cast("string").alias("first_date"), names.folder_month(n).alias("folder_month"), names.masked_name(n).alias("masked_name"),
    )


@query(f"""WITH {SC}, nm AS (SELECT name FROM ({_NAMES_SQL})),
i AS (SELECT coalesce(nullif(regexp_extract(name, '(?i)Fx[_-]?(\\d{{5}})', 1), ''), nullif(regexp_extract(name, '(?i)event[_-]?(\\d+)', 1), ''), nullif(regexp_extract(name, '(\\d{{8}})', 1), ''), nullif(regexp_extract(name, '(\\d{{6}})', 1), '')) AS date_id, name FROM nm)
SELECT date_id, count(DISTINCT name) AS files, min(name) AS first_file FROM i WHERE date_id IS NOT NULL GROUP BY date_id""")
def mosaic_groups(spark, sf_dir):
    """PRJ6, SRC9, SRT2: files by the key of their mosaic."""
    ids = _names(spark, sf_dir).withColumn("date_id", names.date_id(F.col("name"))).filter("date_id IS NOT NULL")
    return ids.groupBy("date_id").agg(F.count(F.lit(1)).alias("files"), F.min("name").alias("first_file")).orderBy("date_id")


@query("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, '{"k":' || CAST(json_extract_string(props, '$.k') AS INT) || '}' AS again FROM events GROUP BY ALL""")
def json_props(spark, sf_dir):
    """PRJ31: properties out of and into JSON."""
    e = V.table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("again", F.to_json(F.struct("k")))


@query(f"""WITH {SC} SELECT grid_id, season, path, CAST(scene_date AS VARCHAR) AS scene_date, row_number() OVER (PARTITION BY grid_id, season ORDER BY scene_date, path) - 1 AS slot FROM sc""")
def scene_slots(spark, sf_dir):
    """WIN7: place of a scene in time."""
    s = cube.slots(V.scenes(spark, sf_dir), ["grid_id", "season"], ["scene_date", "path"])
    return s.select("grid_id", "season", "path", F.col("scene_date").cast("string").alias("scene_date"), F.col("slot").cast("long").alias("slot"))


@query(f"""WITH {SC}, two AS (SELECT grid_id, season, path, scene_date FROM sc UNION ALL SELECT grid_id, season, 'grid_' || grid_id || '/' || file_name, scene_date FROM sc WHERE day(scene_date) <= 5 UNION ALL SELECT grid_id, season, path, scene_date FROM sc WHERE month = 7),
one AS (SELECT DISTINCT * FROM two) SELECT grid_id, season, path, row_number() OVER (PARTITION BY grid_id, season ORDER BY scene_date, path) - 1 AS slot FROM one""")
def scene_dedup(spark, sf_dir):
    """SRC18, SET2, AGG26: two layouts scanned into one, a path once."""
    s = V.scenes(spark, sf_dir)
    cols = ["grid_id", "season", "path", "scene_date"]
    flat = s.filter(F.dayofmonth("scene_date") <= 5).withColumn("path", F.concat(F.lit("grid_"), F.col("grid_id").cast("string"), F.lit("/"), F.col("file_name")))
    out = tasks.distinct_scenes(s.select(cols), flat.select(cols), s.filter("month = 7").select(cols))
    return out.select("grid_id", "season", "path", F.col("slot").cast("long").alias("slot"))


@query(f"""WITH {SC}, g AS (SELECT season, path, grid_id, 100.0 * grid_id AS ox, 1000.0 - 10 * grid_id AS oy, 90 + grid_id AS width, 80 + month AS height FROM sc)
SELECT season, CAST(min(ox) AS DOUBLE) AS x_min, CAST(max(ox + width * 10.0) AS DOUBLE) AS x_max, CAST(min(oy - height * 10.0) AS DOUBLE) AS y_min, CAST(max(oy) AS DOUBLE) AS y_max, CAST(10.0 AS DOUBLE) AS px_w, CAST(-10.0 AS DOUBLE) AS px_h, CAST(max(width) AS BIGINT) AS max_width, CAST(max(height) AS BIGINT) AS max_height, count(*) AS scenes FROM g GROUP BY season""")
def scene_extent(spark, sf_dir):
    """SRC2, PRJ21, AGG4, AGG19: union of extents by season."""
    g = F.col("grid_id").cast("double")
    gt = F.struct((100.0 * g).alias("origin_x"), F.lit(10.0).alias("px_w"), F.lit(0.0).alias("rot_x"), (1000.0 - 10 * g).alias("origin_y"), F.lit(0.0).alias("rot_y"), F.lit(-10.0).alias("px_h"))
    s = V.scenes(spark, sf_dir).withColumn("gt", gt).withColumn("width", F.col("grid_id") + 90).withColumn("height", (F.col("month") + 80).cast("long"))
    return raster.union_extent(s, ["season"])


@query(f"""WITH {SC} SELECT season, grid_id, list_position(['spring','summer','autumn','winter'], season) AS place FROM (SELECT DISTINCT season, grid_id FROM sc) WHERE season IN ('summer','winter') AND grid_id BETWEEN 2 AND 9 AND grid_id IN (1,2,3,5,8,13)""")
def task_list(spark, sf_dir):
    """SRC15, SRC17, SRC19, FLT4-6, SRT1, SET3."""
    out = tasks.task_list(V.scenes(spark, sf_dir), ["winter", "summer"], [1, 2, 3, 5, 8, 13], 2, 9)
    return out.withColumn("place", F.col("place").cast("int"))


@query(f"""WITH {SC}, fl AS (SELECT season, grid_id, ['sorted','index','normalized'][CAST(day(scene_date) % 3 AS INT) + 1] AS kind FROM sc WHERE day(scene_date) <= grid_id) SELECT season, grid_id FROM fl GROUP BY ALL HAVING count(DISTINCT kind) = 3""")
def task_required_files(spark, sf_dir):
    """SRC16, JN7: grids that have all three files."""
    kinds = F.array(*map(F.lit, ("sorted", "index", "normalized")))
    fl = V.scenes(spark, sf_dir).filter(F.dayofmonth("scene_date") <= F.col("grid_id")).withColumn("kind", F.element_at(kinds, (F.dayofmonth("scene_date") % 3 + 1).cast("int")))
    return tasks.complete(fl, ["sorted", "index", "normalized"], ["season", "grid_id"])


@query(f"""WITH {SC}, fo AS (SELECT DISTINCT CASE WHEN grid_id % 4 = 0 THEN 'old_' ELSE 'sar_a_' END || lpad(CAST(grid_id AS VARCHAR), 2, '0') AS folder FROM sc UNION SELECT 'readme'),
p AS (SELECT folder, nullif(regexp_extract(folder, '^(.+_)\\d{{2,}}$', 1), '') AS prefix FROM fo), b AS (SELECT prefix FROM p WHERE prefix IS NOT NULL GROUP BY prefix ORDER BY count(*) DESC, prefix LIMIT 1)
SELECT prefix, folder, CAST(substring(folder, length(prefix) + 1) AS INT) AS number, CAST(nullif(regexp_extract(folder, '_(\\d{{2}})(?:_|$)', 1), '') AS INT) AS grid_number FROM p WHERE prefix = (SELECT prefix FROM b)""")
def grid_prefix(spark, sf_dir):
    """SRC11-14, AGG21: the commonest prefix of numbered folders."""
    g = V.scenes(spark, sf_dir).select("grid_id").distinct()
    folder = F.concat(F.when(F.col("grid_id") % 4 == 0, "old_").otherwise("sar_a_"), F.lpad(F.col("grid_id").cast("string"), 2, "0"))
    folders = g.select(folder.alias("folder")).union(spark.range(1).select(F.lit("readme").alias("folder")))
    return tasks.prefix_of(folders).withColumn("grid_number", names.grid_number(F.col("folder")))


@query(f"""WITH {SC}, e AS (SELECT DISTINCT season, grid_id FROM sc), d AS (SELECT season, grid_id FROM e WHERE season = 'spring' OR grid_id % 3 > 0)
SELECT season, count(*) AS expected, count(d.grid_id) AS finished, count(*) = count(d.grid_id) AS complete FROM e LEFT JOIN d USING (season, grid_id) GROUP BY season""")
def season_complete(spark, sf_dir):
    """SET1: whether all grids of a season are done."""
    s = V.scenes(spark, sf_dir)
    return tasks.seasons_complete(s, s.filter("season = 'spring' OR grid_id % 3 > 0"))


@query(f"""WITH {SC} SELECT DISTINCT season, grid_id FROM sc WHERE NOT (season = 'spring' OR grid_id % 3 > 0)""")
def skip_existing(spark, sf_dir):
    """SNK12, JN8: tasks without an output."""
    s = V.scenes(spark, sf_dir)
    return tasks.pending(s.select("season", "grid_id").distinct(), s.filter("season = 'spring' OR grid_id % 3 > 0"), ["season", "grid_id"])


@query("""WITH s AS (SELECT n_name AS source, unnest(['spring','summer','autumn','winter'][1:CAST(n_nationkey % 4 + 1 AS INT)]) AS season FROM nation WHERE n_nationkey % 5 <> 0),
t AS (SELECT r_name AS target, unnest(['winter','autumn','summer'][1:CAST(r_regionkey % 3 + 1 AS INT)]) AS season FROM region) SELECT source, target, season FROM s JOIN t USING (season)""")
def run_matrix(spark, sf_dir):
    """JN10, FLT14: enabled sources x targets x seasons."""
    arr = lambda *x: F.array(*map(F.lit, x))
    s = V.table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), (F.col("n_nationkey") % 5 != 0).alias("enabled"), F.slice(arr("spring", "summer", "autumn", "winter"), F.lit(1), F.col("n_nationkey") % 4 + 1).alias("seasons"))
    t = V.table(spark, sf_dir, "region").select(F.col("r_name").alias("target"), F.slice(arr("winter", "autumn", "summer"), F.lit(1), F.col("r_regionkey") % 3 + 1).alias("seasons"))
    return tasks.run_matrix(s, t).select("source", "target", "season")


@query(f"""WITH {SC} SELECT season, grid_id, count(*) AS files FROM sc GROUP BY ROLLUP (season, grid_id)""")
def season_counts(spark, sf_dir):
    """AGG2-3, PRJ8: scenes by season and grid, with totals."""
    return tasks.totals(V.scenes(spark, sf_dir), "season", "grid_id")


@query(f"""WITH {SC} SELECT 'month_' || lpad(CAST(month AS VARCHAR), 2, '0') AS month, 'grid_' || lpad(CAST(grid_id AS VARCHAR), 2, '0') AS grid, count(*) AS files FROM sc GROUP BY ROLLUP (1, 2)""")
def month_grid_rollup(spark, sf_dir):
    """AGG1: files by month and grid, with totals."""
    s = V.scenes(spark, sf_dir).select(names.month_label(F.col("month")).alias("month"), names.grid_label(F.col("grid_id")).alias("grid"))
    return tasks.totals(s, "month", "grid")


@query(f"""WITH {SC} SELECT file_name, 'orbit_' || regexp_extract(file_name, '(?i)_(\\d+)\\.(tif|tiff)$', 1) AS by_orbit, 'month_' || lpad(CAST(month AS VARCHAR), 2, '0') || '/grid_' || lpad(CAST(grid_id AS VARCHAR), 2, '0') AS by_month, season || '/grid_' || lpad(CAST(grid_id AS VARCHAR), 2, '0') AS by_season FROM sc""")
def route_by_key(spark, sf_dir):
    """SNK1, SNK1b, PRJ29: the folder that each scene belongs in, as a dry run."""
    s, grid = V.scenes(spark, sf_dir), names.grid_label(F.col("grid_id"))
    return s.select("file_name", F.concat(F.lit("orbit_"), names.orbit(F.col("file_name"))).alias("by_orbit"), F.concat_ws("/", names.month_label(F.col("month")), grid).alias("by_month"), F.concat_ws("/", "season", grid).alias("by_season"))


@query(f"""WITH {SC} SELECT season, grid_id, path, CAST(scene_date AS VARCHAR) AS scene_date FROM sc QUALIFY row_number() OVER (PARTITION BY season, grid_id ORDER BY scene_date, path) = 1""")
def reference_scene(spark, sf_dir):
    """JN6, SRT3: earliest scene of each task."""
    s = V.scenes(spark, sf_dir)
    return tasks.reference_scenes(s, s).withColumn("scene_date", F.col("scene_date").cast("string"))


@query(f"""WITH {SC} SELECT grid_id, path, CAST(scene_date AS VARCHAR) AS scene_date FROM sc WHERE scene_date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'""")
def event_date_filter(spark, sf_dir):
    """FLT3, SRC10: scenes in a range of days, both ends in it."""
    return V.scenes(spark, sf_dir).filter(tasks.in_range(F.col("scene_date"), "1997-03-01", "1998-02-28")).select("grid_id", "path", F.col("scene_date").cast("string").alias("scene_date"))


# ------------------------------------------------------------------ the cube


@query(f"""WITH {PX} SELECT {KEY}, count(*) AS cells, count(x) AS valid, count(*) - count(x) AS masked, round(CAST(min(x) AS DOUBLE), 6) AS x_min, round(CAST(max(x) AS DOUBLE), 6) AS x_max FROM obs GROUP BY ALL""")
def obs_build(spark, sf_dir):
    """PRJ9-10, RST8: negated, masked values, and how many are masked."""
    o = V.observations(spark, sf_dir).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("cells"), F.count("x").alias("valid"), F.count_if(F.col("x").isNull()).alias("masked"), r6(F.min("x")).alias("x_min"), r6(F.max("x")).alias("x_max"))
    return o


@query(f"""WITH {STATS} SELECT {KEY}, k, n, round(CAST(x AS DOUBLE), 6) AS x, round(CAST(f AS DOUBLE), 6) AS f FROM stats""")
def rank_fx(spark, sf_dir):
    """WIN1-2, JN1: rank and plotting position."""
    s = V.statistics(spark, sf_dir)
    return s.select(*SERIES, F.col("k").cast("long").alias("k"), "n", r6("x").alias("x"), r6("f").alias("f"))


_SLOTTED = f"""{PX}, sl AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY scene_date, l_orderkey, l_linenumber, l_extendedprice) - 1 AS slot FROM obs),
a AS (SELECT {KEY}, x, slot, row_number() OVER (PARTITION BY {KEY} ORDER BY x, l_orderkey, l_linenumber, l_extendedprice) AS k FROM sl WHERE x IS NOT NULL),
b AS (SELECT {KEY}, slot, row_number() OVER (PARTITION BY {KEY} ORDER BY slot) AS k FROM sl WHERE x IS NOT NULL)"""


@query(f"""WITH {_SLOTTED}, j AS (SELECT {KEY}, b.slot AS slot, a.x AS x, a.slot AS src_slot FROM b JOIN a USING ({KEY}, k))
SELECT {KEY}, sl.slot AS slot, round(CAST(j.x AS DOUBLE), 6) AS x, coalesce(j.src_slot, -1) AS src_slot FROM sl LEFT JOIN j USING ({KEY}, slot)""")
def sort_order(spark, sf_dir):
    """WIN3: sorted values in the slots that hold one, and where they came from."""
    s = cube.sort_order(V.observations(spark, sf_dir), V.TIES, ["scene_date", *V.TIES])
    return s.select(*SERIES, F.col("slot").cast("long").alias("slot"), r6("x").alias("x"), F.col("src_slot").cast("long").alias("src_slot"))


@query(f"""WITH {PX}, mm AS (SELECT *, CAST(min(x) OVER (PARTITION BY {KEY}) AS DOUBLE) AS lo, CAST(max(x) OVER (PARTITION BY {KEY}) AS DOUBLE) AS hi FROM obs)
SELECT {KEY}, l_orderkey, l_linenumber, l_extendedprice, CASE WHEN hi > lo THEN round((CAST(x AS DOUBLE) - lo) / (hi - lo), 6) END AS x_norm, CASE WHEN hi > lo THEN round(lo, 6) END AS pixel_min, CASE WHEN hi > lo THEN round(hi, 6) END AS pixel_max FROM mm""")
def minmax_norm(spark, sf_dir):
    """PRJ16, AGG5: values between the bounds of their series."""
    return rounded(cube.normalised(V.observations(spark, sf_dir)).select(*SERIES, *V.TIES, "x_norm", "pixel_min", "pixel_max"), "x_norm", "pixel_min", "pixel_max")


@query(f"""WITH {STATS} SELECT {KEY}, k, round(-ln(-ln(CAST(f AS DOUBLE))), 6) AS y FROM stats""")
def gumbel(spark, sf_dir):
    """PRJ11: reduced variate."""
    return V.statistics(spark, sf_dir).select(*SERIES, F.col("k").cast("long").alias("k"), r6(N.gumbel(F.col("f"))).alias("y"))


# ------------------------------------------------------------------ fit and score


def _points(spark, sf_dir) -> DataFrame:
    return tcev.survivors(V.statistics(spark, sf_dir))


def _fit(spark, sf_dir) -> DataFrame:
    return tcev.fit(V.statistics(spark, sf_dir))


@query(f"""WITH {POINTS}, o AS (SELECT {KEY}, CASE WHEN regr_slope(y, x) IS NULL OR isnan(regr_slope(y, x)) THEN 0 ELSE regr_slope(y, x) END AS a, avg(x) AS mx, avg(y) AS my FROM pts GROUP BY {KEY}) SELECT {KEY}, round(a, 6) AS slope, round(my - a * mx, 6) AS intercept FROM o""")
def ols_fit(spark, sf_dir):
    """AGG6: one line through a series."""
    return rounded(tcev.ols(_points(spark, sf_dir)), "slope", "intercept")


@query(f"""WITH {POINTS} SELECT {KEY}, max(b) AS b, round(max(best), 6) AS gap, round(max(bp), 6) AS bp FROM bp GROUP BY {KEY} HAVING max(m) >= 8""")
def breakpoint_search(spark, sf_dir):
    """WIN4: where the slopes before and after differ most."""
    b = tcev.breakpoints(_points(spark, sf_dir)).filter("b IS NOT NULL")
    return rounded(b.groupBy(*SERIES).agg(F.max("b").alias("b"), F.max("gap").alias("gap"), F.max(F.when(F.col("i") == F.col("b"), F.col("x"))).alias("bp")), "gap", "bp")


@query(f"WITH {FIT} SELECT {KEY}, {ROUNDED}, fit_error FROM fit")
def tcev_fit(spark, sf_dir):
    """WIN5-6, FLT1, FLT10, AGG10-11, PRJ13: ten layers a series."""
    return rounded(_fit(spark, sf_dir), *LAYERS)


@query(f"""WITH {FIT} SELECT {KEY}, round(piecewise_residual, 6) AS piecewise_residual, round(linear_residual, 6) AS linear_residual, piecewise_residual <= linear_residual AS better FROM fit WHERE fit_error IS NULL""")
def tcev_residual(spark, sf_dir):
    """AGG8-9: residuals of the two lines and of one."""
    f = _fit(spark, sf_dir).filter("fit_error IS NULL").withColumn("better", F.col("piecewise_residual") <= F.col("linear_residual"))
    return rounded(f.select(*SERIES, "piecewise_residual", "linear_residual", "better"), "piecewise_residual", "linear_residual")


_SCORED = f"""{FIT}, ev AS (SELECT o.*, exp(-exp(-L1_alpha * (CAST(x AS DOUBLE) - L1_beta))) * exp(-exp(-L2_alpha * (CAST(x AS DOUBLE) - L2_beta))) AS fx FROM obs o LEFT JOIN fit USING ({KEY}) WHERE year(scene_date) = 2001)"""


def _scored(spark, sf_dir) -> DataFrame:
    event = V.observations(spark, sf_dir).filter(F.year("scene_date") == 2001)
    return tcev.score(event, _fit(spark, sf_dir), SERIES)


@query(f"WITH {_SCORED} SELECT {KEY}, CAST(scene_date AS VARCHAR) AS scene_date, l_orderkey, l_linenumber, l_extendedprice, round(fx, 6) AS fx FROM ev")
def event_fx(spark, sf_dir):
    """JN2, PRJ14-15: new scenes scored against their pixels' history."""
    return rounded(_scored(spark, sf_dir).select(*SERIES, F.col("scene_date").cast("string").alias("scene_date"), *V.TIES, "fx"), "fx")


@query(f"WITH {_SCORED} SELECT CAST(scene_date AS VARCHAR) AS scene_date, count(*) AS cells, count(fx) AS valid, round(min(fx), 6) AS fx_min, round(max(fx), 6) AS fx_max FROM ev GROUP BY 1")
def event_stats(spark, sf_dir):
    """AGG28: valid cells and range of each event."""
    e = _scored(spark, sf_dir).groupBy(F.col("scene_date").cast("string").alias("scene_date"))
    return rounded(e.agg(F.count(F.lit(1)).alias("cells"), F.count("fx").alias("valid"), F.min("fx").alias("fx_min"), F.max("fx").alias("fx_max")), "fx_min", "fx_max")


_SHORT = FIT.replace("l_suppkey % 12 + 1 AS grid_id", "l_partkey % 12 + 1 AS grid_id").replace('l_suppkey // 10 AS "row"', 'l_partkey // 10 AS "row"').replace("l_suppkey % 10 AS col", "l_partkey % 10 AS col")


@query(f"WITH {_SHORT} SELECT fit_error, count(*) AS count FROM fit WHERE fit_error IS NOT NULL GROUP BY fit_error ORDER BY 2 DESC, 1 LIMIT 3")
def error_topk(spark, sf_dir):
    """AGG20, SRT5: commonest errors, over short series (a pixel a part)."""
    t = V.table(spark, sf_dir, "lineitem").drop("l_suppkey").withColumnRenamed("l_partkey", "l_suppkey")
    p = t.select((F.col("l_suppkey") % 12 + 1).alias("grid_id"), F.expr("l_suppkey div 10").alias("row"), (F.col("l_suppkey") % 10).alias("col"), names.season_of(F.month("l_shipdate")).alias("season"), (-F.col("l_extendedprice") / 3000.0).alias("db"), *V.TIES)
    return tcev.error_histogram(tcev.fit(cube.order_statistics(cube.observations(p), V.TIES)))


@query(f"""WITH {FIT} SELECT {KEY}, {ROUNDED} FROM fit WHERE fit_error IS NULL ORDER BY ("row" - 3) ** 2 + (col - 5) ** 2, "row", col, grid_id, season LIMIT 1""")
def sample_pixel(spark, sf_dir):
    """SNK6, SRT4: the fitted pixel nearest to a place."""
    return rounded(tcev.sample_pixel(_fit(spark, sf_dir), 3, 5).select(*SERIES, *LAYERS), *LAYERS)


# ------------------------------------------------------------------ rasters


def _mosaic(method):
    def run(spark, sf_dir):
        return rounded(raster.mosaic(V.tiles(spark, sf_dir), ["row", "col"], method=method), "value")

    return run


for _name, _agg in (("mean", "avg(value)"), ("first", "arg_min(value, ord) FILTER (WHERE value IS NOT NULL)"), ("last", "arg_max(value, ord) FILTER (WHERE value IS NOT NULL)")):
    QUERIES[f"mosaic_{_name}"] = _mosaic(_name)
    SQL[f"mosaic_{_name}"] = f'WITH {TL} SELECT "row", col, round({_agg}, 6) AS value FROM tl GROUP BY ALL'


@query(f"""WITH {TL} SELECT "row", col, min(value) AS lo, max(value) AS hi FROM tl GROUP BY ALL""")
def mosaic_minmax(spark, sf_dir):
    """AGG16: smallest and largest value of a cell, in one pass."""
    return V.tiles(spark, sf_dir).groupBy("row", "col").agg(raster.combined(F.col("value"), F.col("ord"), "min").alias("lo"), raster.combined(F.col("value"), F.col("ord"), "max").alias("hi"))


@query(f"""WITH {TL}, c AS (SELECT *, CASE WHEN ("row" + col) % 3 > 0 THEN round(value * 2, 6) END AS two FROM tl)
SELECT "row", col, arg_min(struct_pack(a := value, b := two), ord) FILTER (WHERE value IS NOT NULL OR two IS NOT NULL).a AS one, arg_min(struct_pack(a := value, b := two), ord) FILTER (WHERE value IS NOT NULL OR two IS NOT NULL).b AS two FROM c GROUP BY ALL""")
def canvas(spark, sf_dir):
    """AGG18, FLT9, RST7: a cell is taken whole from the first tile that has any of it."""
    c = V.tiles(spark, sf_dir).withColumn("two", F.when((F.col("row") + F.col("col")) % 3 > 0, F.round(F.col("value") * 2, 6))).withColumnRenamed("value", "one")
    return raster.canvas(c, ["row", "col"], ["one", "two"])


@query(f"""WITH {TL}, {MK}, m AS (SELECT "row", col, avg(value) AS v FROM tl GROUP BY ALL) SELECT "row", col, round(v * coalesce(mask, 0), 6) AS fx FROM m LEFT JOIN mk USING ("row", col)""")
def mask_apply(spark, sf_dir):
    """JN4, PRJ17: values times a mask, 0 where it has no cell."""
    m = raster.mosaic(V.tiles(spark, sf_dir), ["row", "col"]).withColumnRenamed("value", "fx")
    return rounded(raster.apply_mask(m, V.mask(spark, sf_dir), ["row", "col"]), "fx")


@query(f"""WITH {TL}, m AS (SELECT "row", col, coalesce(avg(value), -9999.0004) AS v FROM tl GROUP BY ALL), p AS (SELECT DISTINCT c_custkey % 12 AS "row", c_custkey % 13 AS col FROM customer)
SELECT "row", col, CASE WHEN abs(v + 9999) > 1e-3 THEN round(v, 6) END AS value FROM p LEFT JOIN m USING ("row", col)""")
def pixel_lookup(spark, sf_dir):
    """SRC3, SRC3b, FLT12: one cell's value; outside or at the sentinel, none."""
    m = raster.mosaic(V.tiles(spark, sf_dir), ["row", "col"]).withColumn("value", F.coalesce("value", F.lit(-9999.0004)))
    p = V.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 12).alias("row"), (F.col("c_custkey") % 13).alias("col")).distinct()
    return rounded(raster.lookup(m, p, "value", -9999.0), "value")


@query(f"""WITH {TL}, m AS (SELECT "row" AS r, col AS c, avg(value) AS v FROM tl GROUP BY ALL), t AS (SELECT DISTINCT c_custkey % 15 AS "row", c_custkey % 16 AS col FROM customer),
s AS (SELECT *, ("row" + 0.5) * 0.6 - 0.5 AS sr, (col + 0.5) * 0.6 - 0.5 AS sc FROM t),
k AS (SELECT "row", col, CAST(floor(sr) AS BIGINT) + i AS r, CAST(floor(sc) AS BIGINT) + j AS c, abs((1 - i) - (sr - floor(sr))) * abs((1 - j) - (sc - floor(sc))) AS w FROM s, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
SELECT "row", col, round(sum(v * w) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0), 6) AS value FROM k LEFT JOIN m USING (r, c) GROUP BY ALL""")
def resample_bilinear(spark, sf_dir):
    """RST1: a lattice of the same origin by its four neighbours."""
    m = raster.mosaic(V.tiles(spark, sf_dir), ["row", "col"])
    t = V.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 15).alias("row"), (F.col("c_custkey") % 16).alias("col")).distinct()
    return rounded(raster.resample_bilinear(m, t, ["value"], 0.6, 0.6), "value")


_HD = """hd AS (SELECT unnest(['A', 'N', 'R']) AS ord, unnest([0, 1, 2]) AS k), hx AS (SELECT *, 10 + 1.25 * k AS ox, 50 - 0.74 * k AS oy FROM hd),
hw AS (SELECT min(ox) AS x0, max(oy) AS y1, max(ox + 5.0) AS x1, min(oy - 50.5) AS y0 FROM hx)"""
_ROUND = f"""{_HD}, off AS (SELECT ord, k, CAST(round_even((ox - x0) / 0.5, 0) AS INT) AS dc, CAST(round_even((oy - y1) / -0.5, 0) AS INT) AS dr, CAST(round_even((x1 - x0) / 0.5, 0) AS INT) AS w, CAST(round_even((y1 - y0) / 0.5, 0) AS INT) AS h FROM hx, hw)"""
_TRUNC = f"""{_HD}, off AS (SELECT ord, k, CAST(trunc((ox - x0) / 0.5) AS INT) AS dc, CAST(trunc((oy - y1) / -0.5) AS INT) AS dr, CAST(ceil((x1 - x0) / 0.5) AS INT) AS w, CAST(ceil((y1 - y0) / 0.5) AS INT) AS h FROM hx, hw)"""
_ON = """g AS (SELECT "row" + dr AS "row", col + dc AS col, k, value FROM tl JOIN off USING (ord) WHERE "row" + dr BETWEEN 0 AND h - 1 AND col + dc BETWEEN 0 AND w - 1)"""


@query(f"""WITH {TL}, {_ROUND}, {_ON} SELECT "row", col, round(avg(value), 4) AS value, count(*) AS covering FROM g GROUP BY ALL""")
def mosaic_offsets(spark, sf_dir):
    """RST5-6, PRJ23, SNK11: tiles of unlike origins on one lattice, offsets rounded half-even."""
    on = lattice.on_lattice(V.placed_tiles(spark, sf_dir), V.headers(spark), ["tile"], [])
    # Four digits: halves of values of six digits would lie right between two roundings.
    return on.groupBy("row", "col").agg(F.round(raster.combined(F.col("value"), F.col("ord"), "mean"), 4).alias("value"), F.count(F.lit(1)).alias("covering"))


@query(f"""WITH {TL}, {_TRUNC}, {_ON} SELECT "row", col, round(arg_max(value, k) FILTER (WHERE value IS NOT NULL), 6) AS value FROM g GROUP BY ALL""")
def mosaic_trunc(spark, sf_dir):
    """RST5, PRJ24: offsets cut toward zero, sizes rounded up; the last tile wins."""
    return rounded(lattice.mosaic(V.placed_tiles(spark, sf_dir), V.headers(spark), ["tile"], [], ["value"], "last", "trunc"), "value")


@query(f"""WITH {_HD}, s AS (SELECT ord AS tile, 10 + round_even((ox - 10) / 0.5, 0) * 0.5 AS x, 50 + round_even((oy - 50) / -0.5, 0) * -0.5 AS y FROM hx) SELECT tile, round(x, 6) AS x, round(y, 6) AS y FROM s""")
def lattice_snap(spark, sf_dir):
    """PRJ25: origins drawn to the nearest node of the first tile's lattice."""
    return lattice.snapped(V.headers(spark)).select("tile", r6(F.col("gt.origin_x")).alias("x"), r6(F.col("gt.origin_y")).alias("y"))


@query(f"""WITH {TL}, {_HD}, sn AS (SELECT ord, k, 10 + round_even((ox - 10) / 0.5, 0) * 0.5 AS ox, 50 + round_even((oy - 50) / -0.5, 0) * -0.5 AS oy FROM hx), sw AS (SELECT min(ox) AS x0, max(oy) AS y1, max(ox + 5.0) AS x1, min(oy - 50.5) AS y0 FROM sn),
off AS (SELECT ord, k, CAST(round_even((ox - x0) / 0.5, 0) AS INT) AS dc, CAST(round_even((oy - y1) / -0.5, 0) AS INT) AS dr, CAST(round_even((x1 - x0) / 0.5, 0) AS INT) AS w, CAST(round_even((y1 - y0) / 0.5, 0) AS INT) AS h FROM sn, sw), {_ON},
c AS (SELECT *, CASE WHEN value > 8 THEN round(value * 2, 6) END AS two FROM g)
SELECT "row", col, arg_min(struct_pack(a := value, b := two), k) FILTER (WHERE value IS NOT NULL OR two IS NOT NULL).a AS one, arg_min(struct_pack(a := value, b := two), k) FILTER (WHERE value IS NOT NULL OR two IS NOT NULL).b AS two FROM c GROUP BY ALL""")
def canvas_offsets(spark, sf_dir):
    """RST7, AGG18, PRJ25: a canvas of tiles of unlike origins, snapped to one lattice."""
    c = V.placed_tiles(spark, sf_dir).withColumn("two", F.when(F.col("value") > 8, F.round(F.col("value") * 2, 6))).withColumnRenamed("value", "one")
    return lattice.canvas(c, V.headers(spark), ["tile"], ["one", "two"])


_WARPED = f"""{TL}, m AS (SELECT "row" AS r, col AS c, avg(value) AS v FROM tl GROUP BY ALL), t AS (SELECT a.range AS "row", b.range AS col FROM range(7) a, range(6) b),
s AS (SELECT *, ((49.8 + ("row" + 0.5) * -0.7) - 50) / -0.5 - 0.5 AS sr, ((10.3 + (col + 0.5) * 0.8) - 10) / 0.5 - 0.5 AS sc FROM t)"""
_SOURCE, _TARGET = lattice.Profile(10, 101, 10.0, 50.0, 0.5, -0.5, "EPSG:4326"), lattice.Profile(6, 7, 10.3, 49.8, 0.8, -0.7, "EPSG:4326")


@query(f"""WITH {_WARPED}, k AS (SELECT "row", col, CAST(floor(sr) AS BIGINT) + i AS r, CAST(floor(sc) AS BIGINT) + j AS c, abs((1 - i) - (sr - floor(sr))) * abs((1 - j) - (sc - floor(sc))) AS w FROM s, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
SELECT "row", col, round(sum(v * w) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0), 6) AS value FROM k LEFT JOIN m USING (r, c) GROUP BY ALL""")
def resample_geo(spark, sf_dir):
    """RST1-2, RST4: a scene on a reference's lattice of other origin and pixel size."""
    return rounded(lattice.warp(raster.mosaic(V.tiles(spark, sf_dir), ["row", "col"]), ["value"], _SOURCE, _TARGET), "value")


@query(f"""WITH {_WARPED}, {MK}, u AS (SELECT "row", col, CAST(floor(((49.8 + ("row" + 0.5) * -0.7) - 50.4) / -1.1) AS BIGINT) AS r, CAST(floor(((10.3 + (col + 0.5) * 0.8) - 9.7) / 1.1) AS BIGINT) AS c FROM t),
n AS (SELECT u."row", u.col, coalesce(k.mask, 0) AS mask FROM u LEFT JOIN mk k ON k."row" = u.r AND k.col = u.c), f AS (SELECT "row", col, ("row" * 6 + col) / 50.0 AS fx FROM t)
SELECT "row", col, round(fx * mask, 6) AS fx FROM f JOIN n USING ("row", col)""")
def mask_nearest(spark, sf_dir):
    """RST3, JN4: a mask of another lattice drawn to the cells' by the nearest cell; outside it 0."""
    cells = _TARGET.cells(spark).withColumn("fx", (F.col("row") * 6 + F.col("col")) / 50.0)
    return rounded(lattice.masked(cells, "fx", _TARGET, V.mask(spark, sf_dir), lattice.Profile(10, 100, 9.7, 50.4, 1.1, -1.1, "EPSG:4326")), "fx")


@query("""SELECT * FROM (VALUES ('degrees', 30.0, 19, 187, 0.0002695, 5.0 / 19), ('metres', 30.0, 17, 17, 30.0, 500.0 / 17)) t(profile, metres, width, height, unit, px_w)""".replace("19, 187, 0.0002695, 5.0 / 19", "18553, 187389, 0.000269, 5.0 / 18553"))
def target_profile(spark, sf_dir):
    """PRJ26, RST4: shape and pixel size of a target in metres, in a geographic and a projected system."""
    rows = []
    for name, p in (("degrees", _SOURCE), ("metres", lattice.Profile(50, 50, 0.0, 0.0, 10.0, -10.0, "EPSG:32649"))):
        t = p.in_metres(30.0)
        rows.append((name, 30.0, t.width, t.height, round(30.0 / 111320.0, 6) if name == "degrees" else 30.0, t.px_w))
    return rounded(spark.createDataFrame(rows, "profile string, metres double, width int, height int, unit double, px_w double"), "px_w")


@query("""WITH p AS (SELECT s_suppkey, s_suppkey % 360 - 180 + 0.25 AS x, s_suppkey % 160 - 80 + 0.5 AS y FROM supplier), m AS (SELECT *, x * 111319.49079327358 AS mx, ln(tan((y + 90) * pi() / 360)) * 6378137 AS my FROM p)
SELECT s_suppkey, round(mx, 3) AS mx, round(my, 3) AS my, round(x, 6) AS x, round(y, 6) AS y FROM m""")
def crs_points(spark, sf_dir):
    """PRJ27: points to another reference system and back."""
    p = V.table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 360 - 180 + 0.25).alias("x"), (F.col("s_suppkey") % 160 - 80 + 0.5).alias("y"))
    mx, my = lattice.transform(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:3857")
    m = p.withColumn("mx", mx).withColumn("my", my)
    x, y = lattice.transform(F.col("mx"), F.col("my"), "EPSG:3857", "EPSG:4326")
    return m.select("s_suppkey", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"), r6(x).alias("x"), r6(y).alias("y"))


# ------------------------------------------------------------------ features

_EXTRA = f"""ex AS (SELECT {KEY}, CASE WHEN count(x) >= 2 THEN max(CAST(x AS DOUBLE)) - min(CAST(x AS DOUBLE)) END AS db_range, avg(CAST(x AS DOUBLE)) FILTER (WHERE k - 1 >= floor(0.9::DOUBLE * n)) AS top10_mean FROM stats GROUP BY {KEY})"""


@query(f"WITH {STATS}, {_EXTRA} SELECT {KEY}, round(db_range, 6) AS db_range, round(top10_mean, 6) AS top10_mean FROM ex")
def extra_features(spark, sf_dir):
    """AGG13-14: range of a series, and the mean of its largest tenth."""
    return rounded(features.extra_features(V.statistics(spark, sf_dir)), "db_range", "top10_mean")


@query(f"WITH {FIT}, {_EXTRA} SELECT {KEY}, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)} FROM fit JOIN ex USING ({KEY})")
def feature9(spark, sf_dir):
    """SRC20, JN9, ML14: nine features a pixel."""
    s = V.statistics(spark, sf_dir)
    return rounded(features.features9(tcev.fit(s), features.extra_features(s)), *FEATURES)


_CURVE = f"""{FIT}, cp AS (SELECT {KEY}, s.k, CAST(s.x AS DOUBLE) AS x, CAST(s.f AS DOUBLE) AS f, breakpoint_DB AS bp, CAST(CAST(-ln(-ln(least(greatest(CAST(s.f AS DOUBLE), 1e-6), 1 - 1e-6))) AS FLOAT) AS DOUBLE) AS y
  FROM stats s JOIN fit USING ({KEY}) WHERE s.f > 0 AND s.f < 1 AND breakpoint_DB IS NOT NULL), cm AS (SELECT *, count(*) OVER (PARTITION BY {KEY}) AS m FROM cp),
sr AS (SELECT {KEY}, CASE WHEN count(*) FILTER (WHERE x <= bp) >= 2 AND regr_sxx(y, CASE WHEN x <= bp THEN x END) >= 1e-12 THEN regr_slope(y, CASE WHEN x <= bp THEN x END) END AS lo,
  CASE WHEN count(*) FILTER (WHERE x > bp) >= 2 AND regr_sxx(y, CASE WHEN x > bp THEN x END) >= 1e-12 THEN regr_slope(y, CASE WHEN x > bp THEN x END) END AS hi, max(bp) AS bp,
  list(x ORDER BY k) AS xs, list(y ORDER BY k) AS ys, list(f ORDER BY k) AS fs, max(m) AS m FROM cm WHERE m >= 4 GROUP BY {KEY}),
cr AS (SELECT *, CASE WHEN abs(lo) >= 1e-12 THEN hi / lo END AS ratio FROM sr)"""


@query(f"WITH {_CURVE} SELECT {KEY}, round(ratio, 5) AS slope_ratio FROM cr")
def slope_ratio(spark, sf_dir):
    """AGG7, AGG12: slope above the breakpoint over that below."""
    s = V.statistics(spark, sf_dir)
    return features.slope_ratio(features.curve_points(s, tcev.fit(s))).withColumn("slope_ratio", F.round("slope_ratio", 5))


def _resampled_sql(c: str) -> str:
    return f"CASE WHEN m >= 16 THEN {c}[CAST(round_even(CAST(i * (m - 1) / 15 AS DOUBLE), 0) AS INT) + 1] ELSE coalesce({c}[i + 1], 0) END"


@query(f"""WITH {_CURVE}, ix AS (SELECT unnest(range(16)) AS i) SELECT {KEY}, i, round({_resampled_sql("xs")}, 5) AS raw_db, round({_resampled_sql("ys")}, 5) AS gumbel, round({_resampled_sql("fs")}, 5) AS fx, round(ratio, 5) AS slope_ratio, round(bp, 5) AS bp_db FROM cr, ix""")
def curve_features(spark, sf_dir):
    """ML1, SRC21, JN3, PRJ12, PRJ28, FLT2: five channels of a curve, one row an item."""
    s = V.statistics(spark, sf_dir)
    c = features.curves(features.curve_points(s, tcev.fit(s)), 16)
    c = c.select(*SERIES, F.posexplode(F.arrays_zip("raw_db", "gumbel", "fx")).alias("i", "v"), "slope_ratio", "bp_db")
    return c.select(*SERIES, F.col("i").cast("long").alias("i"), *(F.round(F.col(f"v.{n}"), 5).alias(n) for n in ("raw_db", "gumbel", "fx")), F.round("slope_ratio", 5).alias("slope_ratio"), F.round("bp_db", 5).alias("bp_db"))


_BOX = """bx AS (SELECT r_regionkey AS grid_id, -1000.0 + 2000 * r_regionkey AS x_min, 2500.0 + 2000 * r_regionkey AS x_max, 0.0 AS y_min, 1000.0 AS y_max, 350.0 AS px_w, 100.0 AS px_h, 10 AS width, 10 AS height FROM region),
cl AS (SELECT g.r_regionkey AS grid_id, "row", col, v + g.r_regionkey AS v FROM (SELECT "row", col, avg(value) AS v FROM tl GROUP BY ALL) CROSS JOIN region g),
ht AS (SELECT c_custkey AS point_id, c_acctbal AS x, CAST(c_custkey AS DOUBLE) AS y, bx.*, CAST(trunc((c_acctbal - x_min) / px_w) AS BIGINT) AS col, CAST(trunc((y_max - c_custkey) / px_h) AS BIGINT) AS "row" FROM customer JOIN bx ON c_acctbal BETWEEN x_min AND x_max AND c_custkey BETWEEN y_min AND y_max),
sm AS (SELECT point_id, grid_id, "row", col FROM ht WHERE col BETWEEN 0 AND width - 1 AND "row" BETWEEN 0 AND height - 1 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY grid_id) = 1),
sp AS (SELECT sm.*, round(v, 4) AS v FROM sm LEFT JOIN cl USING (grid_id, "row", col))"""


def _sampled(spark, sf_dir) -> DataFrame:
    g = F.col("r_regionkey")
    boxes = V.table(spark, sf_dir, "region").select(g.cast("long").alias("grid_id"), (-1000.0 + 2000 * g).alias("x_min"), (2500.0 + 2000 * g).alias("x_max"), F.lit(0.0).alias("y_min"), F.lit(1000.0).alias("y_max"), F.lit(350.0).alias("px_w"), F.lit(100.0).alias("px_h"), F.lit(10).alias("width"), F.lit(10).alias("height"))
    cells = raster.mosaic(V.tiles(spark, sf_dir), ["row", "col"], "value").join(F.broadcast(boxes.select("grid_id")))
    cells = cells.select("grid_id", "row", "col", F.round(F.col("value") + F.col("grid_id"), 4).alias("v"))
    points = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))
    return features.sample_points(points, boxes, cells, ["v"])


@query(f"WITH {TL}, {_BOX} SELECT * FROM sp")
def point_sample(spark, sf_dir):
    """JN5, FLT11, PRJ22, ML9: values under points; the first box that holds a point takes it."""
    return _sampled(spark, sf_dir).select("point_id", "grid_id", "row", "col", "v")


@query("SELECT c_custkey AS point_id, CASE c_custkey % 4 WHEN 1 THEN 0 ELSE 1 END AS label FROM customer WHERE c_custkey % 4 IN (1, 2)")
def label_recode(spark, sf_dir):
    """SRC7, PRJ30: codes 1 and 2 become 0 and 1, others go."""
    return features.recoded(V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), (F.col("c_custkey") % 4).alias("label")))


@query(f"WITH {TL}, {_BOX} SELECT point_id, v, CASE point_id % 4 WHEN 1 THEN 0 ELSE 1 END AS label FROM sp WHERE v IS NOT NULL AND point_id % 4 IN (1, 2)")
def training_samples(spark, sf_dir):
    """FLT8, FLT13, SNK9: complete samples with their label."""
    return features.training_samples(_sampled(spark, sf_dir).select("point_id", "v"), label_recode(spark, sf_dir), ["v"])


# ------------------------------------------------------------------ labels and measures


@query(f"WITH {LB} SELECT doc_id, CASE WHEN logit >= 0 THEN 1 ELSE 0 END AS by_logit, CASE WHEN 1 / (1 + exp(-logit)) >= 0.7 THEN 1 ELSE 0 END AS by_sigmoid, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS by_probability FROM lb")
def threshold_label(spark, sf_dir):
    """PRJ19-20: labels from logits and probabilities."""
    return V.scored(spark, sf_dir).select("doc_id", metrics.label_of_logit(F.col("logit")).alias("by_logit"), metrics.label_of_logit(F.col("logit"), 0.7).alias("by_sigmoid"), metrics.label_of_probability(F.col("score")).alias("by_probability"))


@query("SELECT lang, count(*) AS cells, count(quality) AS valid, count(*) FILTER (WHERE quality = 1) AS flood, round(count(*) FILTER (WHERE quality = 1) / greatest(count(quality), 1), 6) AS flood_ratio FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def flood_ratio(spark, sf_dir):
    """AGG22: cells, labelled cells, floods and their share."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "lang").join(V.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("pred")), "doc_id", "left")
    return rounded(metrics.counts(d, ["lang"]), "flood_ratio")


@query(f"WITH {LB} SELECT count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives, round(count(*) FILTER (WHERE label = 0) / (count(*) FILTER (WHERE label = 1) + 1e-7), 6) AS weight FROM lb")
def class_weight(spark, sf_dir):
    """AGG23: weight of the positive class."""
    return rounded(metrics.class_weight(V.scored(spark, sf_dir)), "weight")


@query(f"""WITH {LB}, c AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn FROM lb),
d AS (SELECT *, tp / (tp + fp + 1e-7) AS p, tp / (tp + fn + 1e-7) AS r FROM c) SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-7), 6) AS f1 FROM d""")
def clf_f1(spark, sf_dir):
    """AGG24: precision, recall, F1."""
    return rounded(metrics.f1(V.scored(spark, sf_dir)), "precision", "recall", "f1")


@query(f"""WITH {LB}, t AS (SELECT unnest(range(101)) AS s), n AS (SELECT count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM lb),
c AS (SELECT s, count(*) FILTER (WHERE label = 1 AND score >= s / 100) / any_value(pos) AS y, count(*) FILTER (WHERE label = 0 AND score >= s / 100) / any_value(neg) AS x FROM t, lb, n GROUP BY s
 UNION ALL SELECT 101, 0, 0 UNION ALL SELECT -1, 1, 1),
l AS (SELECT x, y, lag(x) OVER (ORDER BY s DESC) AS x0, lag(y) OVER (ORDER BY s DESC) AS y0 FROM c) SELECT round(sum((x - x0) * (y + y0) / 2), 6) AS auc FROM l""")
def clf_auc(spark, sf_dir):
    """AGG25, ML6b: area under the curve through 101 thresholds."""
    return rounded(metrics.auc(V.scored(spark, sf_dir)), "auc")


@query(f"""WITH {LB}, p AS (SELECT *, least(greatest(1 / (1 + exp(-logit)), 1e-7), 1 - 1e-7) AS p FROM lb), q AS (SELECT *, CASE WHEN label = 1 THEN p ELSE 1 - p END AS pt FROM p)
SELECT round(avg(CASE WHEN label = 1 THEN 0.25 ELSE 1.0 END * (1 - pt) ** 2 * -ln(pt)), 6) AS loss, count(*) AS n FROM q""")
def focal_loss(spark, sf_dir):
    """ML3: focal loss with a weighted positive class."""
    s = V.scored(spark, sf_dir)
    return s.agg(r6(F.avg(metrics.focal_loss(F.col("logit"), F.col("label"), 2.0, 0.25))).alias("loss"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SC}, g AS (SELECT DISTINCT grid_id FROM sc), o AS (SELECT grid_id, row_number() OVER (ORDER BY md5(CAST(grid_id AS VARCHAR) || ':42'), grid_id) AS place, count(*) OVER () AS n FROM g)
SELECT grid_id, CASE WHEN place <= CASE WHEN n >= 2 THEN greatest(1, CAST(floor(n * 0.2) AS INT)) ELSE 0 END THEN 'validation' ELSE 'training' END AS part FROM o""")
def grid_split(spark, sf_dir):
    """ML5: grids for validation and training."""
    return tasks.grid_split(V.scenes(spark, sf_dir))


@query("SELECT vec_id, CASE WHEN CAST('0x' || md5(CAST(vec_id AS VARCHAR) || ':42')[1:8] AS BIGINT) / 4294967296.0 < 0.2 THEN 'validation' ELSE 'training' END AS part FROM embeddings")
def row_split(spark, sf_dir):
    """ML6: rows for validation and training."""
    return tasks.row_split(V.table(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"])


@query("SELECT vec_id, label FROM embeddings WHERE vec_id BETWEEN 10 AND 19 OR vec_id BETWEEN 100 AND 139")
def range_read(spark, sf_dir):
    """SRC6: rows of some grids by their boundaries, as a filter on the scan."""
    return tasks.within(V.table(spark, sf_dir, "embeddings"), "vec_id", [(10, 20), (100, 140)]).select("vec_id", "label")


@query(f"""WITH {SC}, d AS (SELECT min(scene_date) AS day FROM sc WHERE season = 'summer') SELECT season, grid_id, min(path) AS path, CAST(scene_date AS VARCHAR) AS scene_date FROM sc WHERE scene_date = DATE '1998-07-01' GROUP BY season, grid_id, scene_date""")
def scene_on_date(spark, sf_dir):
    """FLT7: the scenes of a reference day."""
    return tasks.on_date(V.scenes(spark, sf_dir), "1998-07-01").withColumn("scene_date", F.col("scene_date").cast("string"))


@query("SELECT DISTINCT 'grid_' || CAST(l_suppkey % 12 + 1 AS VARCHAR) AS folder FROM lineitem")
def grid_names(spark, sf_dir):
    """SRC19: names of grids by their letters."""
    f = V.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("grid_"), (F.col("l_suppkey") % 12 + 1).cast("string")).alias("folder"))
    return tasks.grid_names(f.unionByName(f.select(F.concat(F.lit("x"), "folder").alias("folder"))))


@query("SELECT label AS grid, min(vec_id) AS start, max(vec_id) + 1 AS stop FROM embeddings GROUP BY label")
def grid_boundaries(spark, sf_dir):
    """AGG27, SRC6: first and last row of a grid."""
    return tasks.boundaries(V.table(spark, sf_dir, "embeddings").select(F.col("label").alias("grid"), "vec_id"), "grid", "vec_id")


@query("""WITH w AS (SELECT vec_id, embedding, list_sum(list_transform(range(len(embedding)), lambda i: CAST(embedding[i + 1] AS DOUBLE) * ((i % 7) - 3) / 4.0)) AS z FROM embeddings)
SELECT vec_id, round(1 / (1 + exp(-(z + 0.1))), 6) AS prob, CASE WHEN 1 / (1 + exp(-(z + 0.1))) >= 0.5 THEN 1 ELSE 0 END AS pred FROM w""")
def tab_infer(spark, sf_dir):
    """ML10-12: a linear classifier over feature vectors."""
    e = V.table(spark, sf_dir, "embeddings")
    return rounded(learning.linear_scores(e, "embedding", [((i % 7) - 3) / 4.0 for i in range(64)], 0.1).select("vec_id", "prob", "pred"), "prob")


@query()
def cnn_infer(spark, sf_dir):
    """ML2, ML4, ML7: the convolutional network over curves, with weights from a fixed seed."""
    s = V.statistics(spark, sf_dir)
    return rounded(learning.infer(features.curves(features.curve_points(s, tcev.fit(s)), 16), learning.FloodNet.seeded(42), SERIES), "prob")
