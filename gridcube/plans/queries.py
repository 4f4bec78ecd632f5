"""Registered queries: one per operator of the inventory.

Each query is ``fn(spark, sf_dir) -> DataFrame`` and builds a lazy plan over
the driver's parquet tables (through ``gridcube.plans.fixtures``). The
matching DuckDB SQL lives in ``ORACLE`` under the same key; both alias every
computed column identically.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcube.functions import calendar as CAL
from gridcube.functions.calendar import encode_time
from gridcube.functions.cf import mask_and_scale
from gridcube.functions.compare import allclose
from gridcube.functions.units import STANDARD_UNIT_CONVERSIONS, unit_table
from gridcube.model import TARGET_END, TARGET_START, Axes, Coord
from gridcube.operators import align as AL
from gridcube.operators import harmonize as H
from gridcube.operators import quality as QL
from gridcube.operators import schema as SC
from gridcube.operators import select as SL
from gridcube.plans import fixtures as FX
from gridcube.plans.sql import (CONTENTS, CUBE_B, LISTING_ABBREV, STORED_BEFORE, axis_sql, dbl,
                                listing_views, with_views)
from gridcube.session import shared_dir
from gridcube.sources import decode as DC
from gridcube.sources import ingest as IG
from gridcube.sources import listing as LS
from gridcube.sources import store as ST
from gridcube.streaming import ingest as SI

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


KELVIN = 273.15
PRATE_SCALE = 1000 * 60 * 60 * 24 / 1000


# ------------------------------------------------------------------ flagship
def harmonized_cube(spark: SparkSession, sf_dir: str):
    """Provider cube -> rename -> standardize (monthly leads) -> monthly totals."""
    cube = FX.raw_cube(spark, sf_dir)
    cube = SC.rename(cube, FX.STANDARD_NAMES)
    cube = H.standardize(cube, FX.ensemble_config())
    return H.monthly_total(cube, ["prcp"])


@query("standardize", with_views(f"""
SELECT S, M, L, Y, X,
       CAST(date_trunc('month', S) + to_months(L) AS TIMESTAMP) AS target,
       tas * {dbl(1)} + {dbl(-KELVIN)} AS tas,
       (prate * {dbl(PRATE_SCALE)} + {dbl(0)})
         * CAST(date_diff('day', date_trunc('month', S) + to_months(L),
                          date_trunc('month', S) + to_months(L + 1)) AS DOUBLE) AS prcp
FROM cube"""))
def q_standardize(spark, sf_dir):
    cube = harmonized_cube(spark, sf_dir)
    return cube.with_coords(Axes.target).select("S", "M", "L", "Y", "X", "target", "tas", "prcp")


# ------------------------------------------------------------------ listing (ops 1-8, 54)

FIRST = "1997-01-01"


def _parsed(spark, sf_dir, sidecars=False):
    lst = FX.listing_with_sidecars(spark, sf_dir) if sidecars else FX.listing(spark, sf_dir)
    return LS.parse_paths(lst, FX.descriptor())


@query("list_files")
def q_list_files(spark, sf_dir):
    return LS.list_files(spark, sf_dir).select("path", "length")


@query("parse_paths", with_views(
    "SELECT path, t, m, p, l FROM parsed", **listing_views(with_sidecars=True)))
def q_parse_paths(spark, sf_dir):
    return _parsed(spark, sf_dir, sidecars=True).select("path", "t", "m", "p", "l")


def lead_from_member(g):
    """A catalogue-specific hook: the number in the file name is a lead, not a member."""
    out = LS.default_parse_match({k: v for k, v in g.items() if k != "member"})
    out["l"] = g["member"].cast("int") - 1
    return out


@query("parse_paths_custom", with_views(
    "SELECT path, t, CAST(NULL AS INTEGER) AS m, p, m - 1 AS l FROM parsed", **listing_views()))
def q_parse_paths_custom(spark, sf_dir):
    d = FX.descriptor(parse_match=lead_from_member)
    return LS.parse_paths(FX.listing(spark, sf_dir), d).select("path", "t", "m", "p", "l")


@query("time_resolution", with_views(
    "SELECT path, t, 'days' AS time_res, "
    "CAST(date_diff('day', TIMESTAMP '1960-01-01', t) AS INTEGER) AS t_enc FROM parsed",
    **listing_views()))
def q_time_resolution(spark, sf_dir):
    d = FX.descriptor()
    res = d.time_res
    return (LS.parse_paths(FX.listing(spark, sf_dir), d)
            .select("path", "t", F.lit(res).alias("time_res"), encode_time(F.col("t"), res).alias("t_enc")))


@query("month_abbrev", with_views("""
SELECT path,
       make_timestamp(CAST(regexp_extract(path, 'fc_(\\d{4})-([A-Za-z]{3})_m(\\d+)\\.nc$', 1) AS BIGINT),
                      CAST(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'],
                           lower(regexp_extract(path, 'fc_(\\d{4})-([A-Za-z]{3})_m(\\d+)\\.nc$', 2))) AS BIGINT),
                      1, 0, 0, 0) AS t,
       CAST(regexp_extract(path, 'fc_(\\d{4})-([A-Za-z]{3})_m(\\d+)\\.nc$', 3) AS INTEGER) AS m
FROM listing_abbrev""", listing_abbrev=LISTING_ABBREV))
def q_month_abbrev(spark, sf_dir):
    d = FX.descriptor(pattern=FX.LISTING_PATTERN_ABBREV)
    return LS.parse_paths(FX.listing(spark, sf_dir, month_names=True), d).select("path", "t", "m")


@query("dedupe_paths", with_views("SELECT t, m, p, l, path FROM deduped", **listing_views(True)))
def q_dedupe_paths(spark, sf_dir):
    return LS.dedupe_paths(_parsed(spark, sf_dir, sidecars=True)).select("t", "m", "p", "l", "path")


def pressure_from_member(g):
    out = LS.default_parse_match(g)
    out["p"] = F.lit(1000) - F.lit(250) * (out["m"] - 1)
    return out


@query("coord_index", with_views("""
SELECT 'T' AS axis, CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS pos, t,
       CAST(NULL AS INTEGER) AS value FROM (SELECT DISTINCT t FROM parsed)
UNION ALL
SELECT 'M', CAST(row_number() OVER (ORDER BY m) - 1 AS INTEGER), NULL, m FROM (SELECT DISTINCT m FROM parsed)
UNION ALL
SELECT 'P', CAST(row_number() OVER (ORDER BY p DESC) - 1 AS INTEGER), NULL, p
FROM (SELECT DISTINCT 1000 - 250 * (m - 1) AS p FROM parsed)""", **listing_views()))
def q_coord_index(spark, sf_dir):
    d = FX.descriptor(parse_match=pressure_from_member)
    axes = LS.coord_index(LS.parse_paths(FX.listing(spark, sf_dir), d))
    assert axes.L is None
    null_i, null_t = F.lit(None).cast("int"), F.lit(None).cast("timestamp_ntz")
    return (axes.T.select(F.lit("T").alias("axis"), "pos", F.col("T").alias("t"), null_i.alias("value"))
            .unionByName(axes.M.select(F.lit("M").alias("axis"), "pos", null_t.alias("t"), F.col("M").alias("value")))
            .unionByName(axes.P.select(F.lit("P").alias("axis"), "pos", null_t.alias("t"), F.col("P").alias("value"))))


@query("list_times", with_views(
    f"SELECT DISTINCT t FROM parsed WHERE t >= TIMESTAMP '{FIRST}'", **listing_views()))
def q_list_times(spark, sf_dir):
    return LS.list_times(_parsed(spark, sf_dir), first=FIRST)


@query("path_lookup", with_views(
    f"SELECT t, m, p, l, path FROM deduped WHERE t >= TIMESTAMP '{FIRST}'", **listing_views()))
def q_path_lookup(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    return LS.path_lookup(LS.dedupe_paths(parsed), LS.list_times(parsed, first=FIRST)) \
        .select("t", "m", "p", "l", "path")


# ------------------------------------------------------------------ schema (ops 16-25)

DIMS = ("S", "M", "L", "Y", "X")
RAW_DIMS = ("init_time", "number", "step", "latitude", "longitude")


@query("select_data_vars", with_views("SELECT S, M, L, Y, X, tas FROM cube"))
def q_select_data_vars(spark, sf_dir):
    return SC.select_data_vars(FX.standard_cube(spark, sf_dir), "tas").cells


@query("drop_coords", with_views(
    "SELECT S AS init_time, M AS number, L AS step, Y AS latitude, X AS longitude, tas FROM cube"))
def q_drop_coords(spark, sf_dir):
    return SC.drop_coords(FX.raw_cube(spark, sf_dir), ["prate"]).cells


@query("set_aux_coords", with_views("SELECT DISTINCT Y, X, Y * 2 + X AS area FROM cube"))
def q_set_aux_coords(spark, sf_dir):
    c = FX.standard_cube(spark, sf_dir)
    c = c.replace(cells=c.cells.withColumn("area", F.col("Y") * 2 + F.col("X")),
                  data_vars=(*c.data_vars, "area"))
    c = SC.set_aux_coords(c, "area", {"area": ("Y", "X")})
    assert "area" not in c.cells.columns
    return c.coord_frame("area")


@query("expand_coords", with_views(
    "SELECT DISTINCT S AS init_time, L AS step, L * 30 AS lead_days_expanded FROM cube"))
def q_expand_coords(spark, sf_dir):
    c = FX.raw_cube(spark, sf_dir)
    c = c.replace(coords={"lead_days": Coord(("step",), expr=F.col("step") * 30)})
    c = SC.expand_coords(c, "lead_days", dim="init_time")
    return c.coord_frame("lead_days_expanded")


ASSIGNED = """
SELECT d.path, d.t AS init_time, d.m AS number, c.step, c.latitude, c.longitude, c.tas, c.prate
FROM deduped d JOIN parsed pa ON pa.path = d.path JOIN contents c ON c.o_orderkey = pa.o_orderkey"""
_ASSIGNED_SQL = with_views("SELECT * FROM assigned", **listing_views(), contents=CONTENTS, assigned=ASSIGNED)


def _assigned(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    files = LS.dedupe_paths(parsed).join(parsed.select("path", "o_orderkey"), "path")
    return IG.assign_file_dims(FX.file_contents(spark, sf_dir), files, key="o_orderkey", coords=["m"])


@query("assign_file_dims", _ASSIGNED_SQL)
def q_assign_file_dims(spark, sf_dir):
    return _assigned(spark, sf_dir).select("path", *RAW_DIMS[:3], "latitude", "longitude", "tas", "prate")


@query("promote_time_dim", with_views("""
SELECT d.path, d.t AS init_time, o.o_orderdate AS time, c.step, c.latitude, c.longitude, c.tas
FROM deduped d JOIN parsed pa ON pa.path = d.path JOIN contents c ON c.o_orderkey = pa.o_orderkey
JOIN orders o ON o.o_orderkey = pa.o_orderkey""", **listing_views(), contents=CONTENTS))
def q_promote_time_dim(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    files = LS.dedupe_paths(parsed).join(parsed.select("path", "o_orderkey"), "path")
    contents = FX.file_contents(spark, sf_dir).join(
        FX.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("time")),
        "o_orderkey")
    out = IG.promote_time_dim(contents, files, t_dim="time", key="o_orderkey", coords=["m"])
    return out.select("path", "init_time", "time", "step", "latitude", "longitude", "tas")


@query("drop_scalar_coords", with_views(
    "SELECT S, M, Y, X, tas, prate FROM cube WHERE L = (SELECT min(L) FROM cube)"))
def q_drop_scalar_coords(spark, sf_dir):
    from gridcube.operators.select import isel
    c = isel(FX.computed_cube(spark, sf_dir), L=0)
    assert "L" in c.coords and not c.coords["L"].dims
    c = SC.drop_scalar_coords(c)
    return c.with_coords()


@query("narrow_float", with_views(
    "SELECT S, M, L, Y, X, CAST(tas AS FLOAT) AS tas, CAST(prate AS FLOAT) AS prate FROM cube"))
def q_narrow_float(spark, sf_dir):
    return SC.narrow_float(FX.standard_cube(spark, sf_dir)).cells


@query("rename", with_views("SELECT S, M, L, Y, X, tas, prate AS prcp FROM cube"))
def q_rename(spark, sf_dir):
    c = SC.rename(FX.raw_cube(spark, sf_dir), FX.STANDARD_NAMES | {"nope": "whatever", "tas": "tas"})
    return c.cells


@query("drop_non_std", with_views(
    "SELECT S, CAST(M - 1 AS INTEGER) AS M, L, Y, X, tas, prate AS prcp FROM cube"))
def q_drop_non_std(spark, sf_dir):
    c = SC.rename(FX.raw_cube(spark, sf_dir), FX.STANDARD_NAMES)
    c = c.replace(cells=c.cells.withColumn("junk", F.col("tas") * 0), data_vars=(*c.data_vars, "junk"))
    std = {k: v for k, v in FX.DA_ATTRS.items() if k != "M"}
    out = SC.drop_non_std(c, std, bare_dims=["M"])
    assert "junk" not in out.cells.columns and "M" in out.bare_dims
    return out.cells


# ------------------------------------------------------------------ selection (ops 30-32)


@query("isel", with_views(f"""
SELECT c.* FROM cube c JOIN s USING (S) JOIN l USING (L)
WHERE s.pos % 3 = 1 AND l.pos BETWEEN 0 AND 2""", s=axis_sql("S"), l=axis_sql("L")))
def q_isel(spark, sf_dir):
    return SL.isel(FX.computed_cube(spark, sf_dir), S=slice(1, None, 3), L=slice(0, 3)).cells


@query("sel", with_views("""
SELECT * FROM cube WHERE S <= TIMESTAMP '1999-05-01' AND M IN (1, 3) AND Y BETWEEN -45 AND 45"""))
def q_sel(spark, sf_dir):
    return SL.sel(FX.standard_cube(spark, sf_dir), S=slice(None, "1999-05-01"), M=[1, 3],
                  Y=slice(-45.0, 45.0)).cells


@query("probe_first", with_views("""
SELECT S, M, L, Y, X, tas FROM cube
WHERE S = (SELECT min(S) FROM cube) AND M = (SELECT min(M) FROM cube) AND L = (SELECT min(L) FROM cube)
  AND Y = (SELECT max(Y) FROM cube) AND X = (SELECT min(X) FROM cube)"""))
def q_probe_first(spark, sf_dir):
    return SL.probe_first(FX.computed_cube(spark, sf_dir))


# ------------------------------------------------------------------ joins (ops 33-38)


def _stored(spark, sf_dir, of=None):
    c = of or FX.computed_cube(spark, sf_dir)
    return c.replace(cells=c.cells.filter(F.col("S") < F.lit(STORED_BEFORE).cast("timestamp_ntz")))


@query("new_times", with_views(f"""
SELECT DISTINCT t FROM parsed
WHERE t NOT IN (SELECT S FROM cube WHERE S < TIMESTAMP '{STORED_BEFORE}')
ORDER BY t LIMIT 6""", **listing_views()))
def q_new_times(spark, sf_dir):
    return AL.new_times(_parsed(spark, sf_dir), _stored(spark, sf_dir).cells.select("S"), limit=6)


@query("check_region", with_views(f"""
SELECT a.path, 'init_time' AS dim, CAST(a.init_time AS VARCHAR) AS label, 'KeyError' AS error
FROM (SELECT DISTINCT path, init_time FROM assigned) a
WHERE a.init_time NOT IN (SELECT S FROM cube WHERE S < TIMESTAMP '{STORED_BEFORE}')
UNION ALL
SELECT path, 'latitude', concat(CAST(min(pos) AS VARCHAR), ':', CAST(max(pos) AS VARCHAR)), 'ValueError'
FROM (SELECT DISTINCT a.path, a.latitude, y.pos FROM assigned a JOIN y ON y.Y = a.latitude)
GROUP BY path HAVING max(pos) - min(pos) + 1 <> count(*)
UNION ALL
SELECT path, 'step', concat(CAST(min(pos) AS VARCHAR), ':', CAST(max(pos) AS VARCHAR)), 'ValueError'
FROM (SELECT DISTINCT a.path, a.step, l.pos FROM assigned a JOIN l ON l.L = a.step)
GROUP BY path HAVING max(pos) - min(pos) + 1 <> count(*)""",
    **listing_views(), contents=CONTENTS, assigned=ASSIGNED,
    stored=f"SELECT * FROM cube WHERE S < TIMESTAMP '{STORED_BEFORE}'",
    y=axis_sql("Y", "stored", desc=True), l=axis_sql("L", "stored")))
def q_check_region(spark, sf_dir):
    stored = _stored(spark, sf_dir)
    assigned = FX.computed(_assigned(spark, sf_dir).select("path", "init_time", "step", "latitude"), "assigned")
    axes = {"init_time": stored.axis("S").withColumnRenamed("S", "init_time"),
            "step": stored.axis("L").withColumnRenamed("L", "step"),
            "latitude": stored.axis("Y").withColumnRenamed("Y", "latitude")}
    return AL.check_region(assigned, axes)


@query("align_to", with_views(f"SELECT * FROM cube WHERE S < TIMESTAMP '{STORED_BEFORE}'"))
def q_align_to(spark, sf_dir):
    c = FX.computed_cube(spark, sf_dir)
    return AL.align_to(c, _stored(spark, sf_dir, of=c)).cells


@query("densify", with_views("""
SELECT t.S, m.M, l.L, t.Y, t.X, c.tas, c.prate
FROM (SELECT DISTINCT S, Y, X FROM cube WHERE S = (SELECT min(S) FROM cube)) t
CROSS JOIN (SELECT DISTINCT M FROM cube) m CROSS JOIN (SELECT DISTINCT L FROM cube) l
LEFT JOIN cube c ON c.S = t.S AND c.M = m.M AND c.L = l.L AND c.Y = t.Y AND c.X = t.X"""))
def q_densify(spark, sf_dir):
    c = FX.computed_cube(spark, sf_dir)
    axes = c.axes(["S", "M", "L"])  # one pass for all three axes
    s0 = axes["S"].orderBy("pos").first()["S"]
    template = c.cells.filter(F.col("S") == F.lit(s0)).select("S", "Y", "X").distinct()
    return AL.densify(c, template, {"M": axes["M"], "L": axes["L"]}).cells


@query("align_positional", with_views("""
SELECT a.S, a.M, a.L, a.Y, a.X, a.tas AS a, b.tas AS b
FROM (SELECT * FROM cube JOIN s USING (S) JOIN m USING (M) JOIN l USING (L) JOIN y USING (Y) JOIN x USING (X)) a
FULL OUTER JOIN
     (SELECT c.*, s.pos AS s_pos, m.pos AS m_pos, l.pos AS l_pos, yb.pos AS y_pos, x.pos AS x_pos
      FROM cube_b c JOIN s USING (S) JOIN m USING (M) JOIN l USING (L) JOIN yb USING (Y) JOIN x USING (X)) b
ON a.s_pos = b.s_pos AND a.m_pos = b.m_pos AND a.l_pos = b.l_pos AND a.y_pos = b.y_pos AND a.x_pos = b.x_pos
""".replace("SELECT * FROM cube JOIN s USING (S)",
            "SELECT cube.*, s.pos AS s_pos, m.pos AS m_pos, l.pos AS l_pos, y.pos AS y_pos, x.pos AS x_pos "
            "FROM cube JOIN s USING (S)"),
    cube_b=CUBE_B, s=axis_sql("S"), m=axis_sql("M"), l=axis_sql("L"), y=axis_sql("Y", desc=True),
    yb=axis_sql("Y", "cube_b", desc=True), x=axis_sql("X")))
def q_align_positional(spark, sf_dir):
    a = FX.computed_cube(spark, sf_dir)
    b = FX.comparison_cube(spark, sf_dir, of=a)
    return AL.align_positional(a, b, "tas").select(*DIMS, "a", "b")


@query("broadcast_coord", with_views("""
SELECT S, M, L, Y, X, tas,
       prate * CAST(date_diff('day', date_trunc('month', S) + to_months(L),
                                     date_trunc('month', S) + to_months(L + 1)) AS DOUBLE) AS prate
FROM cube"""))
def q_broadcast_coord(spark, sf_dir):
    c = H.add_target_monthly(FX.standard_cube(spark, sf_dir))
    days = H.target_frame(c).withColumn("ndays", F.datediff(TARGET_END, TARGET_START))
    return AL.broadcast_coord(c, days, ["S", "L"], "ndays", ["prate"]).cells


# ------------------------------------------------------------------ aggregations (ops 39-44)


@query("error_rate_gate", """
SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day,
       count(*) FILTER (WHERE event_type <> 'error' OR event_type IS NULL) AS n_ok,
       count(*) FILTER (WHERE event_type = 'error') AS n_failed,
       count(*) AS n_done,
       count(*) FILTER (WHERE event_type = 'error') / count(*) AS failure_rate,
       count(*) FILTER (WHERE event_type = 'error') / count(*) <= 0.1 AS passed
FROM events GROUP BY 1""")
def q_error_rate_gate(spark, sf_dir):
    ev = FX.table(spark, sf_dir, "events")
    outcomes = ev.select(F.to_date("ts").cast("timestamp_ntz").alias("day"),
                         F.when(F.col("event_type") == "error", F.col("props")).alias("error"))
    return QL.load_outcomes(outcomes, by=["day"])


@query("running_error_rate", """
SELECT event_id, row_number() OVER (ORDER BY event_id) AS n_done,
       count(*) FILTER (WHERE event_type = 'error') OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n_failed
FROM events""")
def q_running_error_rate(spark, sf_dir):
    failed = F.when(F.col("event_type") == "error", F.lit("failed"))
    return QL.running_failures(FX.table(spark, sf_dir, "events").select("event_id", failed.alias("error")), ["event_id"])


@query("cube_shape", with_views("""
SELECT 'L' AS dim, count(DISTINCT L) AS size FROM cube UNION ALL
SELECT 'M', count(DISTINCT M) FROM cube UNION ALL SELECT 'S', count(DISTINCT S) FROM cube UNION ALL
SELECT 'X', count(DISTINCT X) FROM cube UNION ALL SELECT 'Y', count(DISTINCT Y) FROM cube"""))
def q_cube_shape(spark, sf_dir):
    return QL.cube_shape(FX.standard_cube(spark, sf_dir))


def _coords_sql() -> str:
    parts = []
    for d in DIMS:
        desc = d == "Y"
        pred = ("CASE WHEN a.v IS NULL AND b.v IS NULL THEN true WHEN a.v IS NULL OR b.v IS NULL THEN false "
                "ELSE abs(a.v - b.v) <= CAST('1e-08' AS DOUBLE) + CAST('1e-05' AS DOUBLE) * abs(b.v) END"
                if d in ("Y", "X") else "a.v IS NOT DISTINCT FROM b.v")
        ax_a, ax_b = (axis_sql(d, src, desc).replace(f"SELECT {d},", f"SELECT {d} AS v,", 1)
                      for src in ("cube", "cube_b"))
        parts.append(f"SELECT '{d}' AS coord, coalesce(bool_and({pred}), true) AS same, "
                     f"'present' AS a, 'present' AS b "
                     f"FROM ({ax_a}) a FULL OUTER JOIN ({ax_b}) b ON a.pos = b.pos")
    return "\nUNION ALL\n".join(parts)


@query("compare_coords", with_views(_coords_sql(), cube_b=CUBE_B))
def q_compare_coords(spark, sf_dir):
    a = FX.computed_cube(spark, sf_dir)
    return QL.compare_coords(a, FX.comparison_cube(spark, sf_dir, of=a))


_POS_VIEWS = dict(cube_b=CUBE_B, s=axis_sql("S"), m=axis_sql("M"), l=axis_sql("L"),
                  y=axis_sql("Y", desc=True), yb=axis_sql("Y", "cube_b", desc=True), x=axis_sql("X"))
_PAIRS = """
SELECT a.S, a.M, a.L, a.Y, a.X, a.s_pos, a.m_pos, a.l_pos, a.y_pos, a.x_pos, a.tas AS a, b.tas AS b
FROM (SELECT cube.*, s.pos AS s_pos, m.pos AS m_pos, l.pos AS l_pos, y.pos AS y_pos, x.pos AS x_pos
      FROM cube JOIN s USING (S) JOIN m USING (M) JOIN l USING (L) JOIN y USING (Y) JOIN x USING (X)) a
JOIN (SELECT c.*, s.pos AS s_pos, m.pos AS m_pos, l.pos AS l_pos, yb.pos AS y_pos, x.pos AS x_pos
      FROM cube_b c JOIN s USING (S) JOIN m USING (M) JOIN l USING (L) JOIN yb USING (Y) JOIN x USING (X)) b
ON a.s_pos = b.s_pos AND a.m_pos = b.m_pos AND a.l_pos = b.l_pos AND a.y_pos = b.y_pos AND a.x_pos = b.x_pos
"""


@query("max_diff", with_views("""
SELECT abs(a - b) AS max_diff, S, M, L, Y, X, a, b FROM pairs
WHERE abs(a - b) IS NOT NULL AND NOT isnan(abs(a - b))
ORDER BY abs(a - b) DESC, s_pos, m_pos, l_pos, y_pos, x_pos LIMIT 1""", **_POS_VIEWS, pairs=_PAIRS))
def q_max_diff(spark, sf_dir):
    a = FX.computed_cube(spark, sf_dir)
    b = FX.comparison_cube(spark, sf_dir, of=a)
    pairs = AL.align_positional(a, b, "tas")
    return QL.max_diff(pairs, list(DIMS))


def _compare_sql() -> str:
    shape = "\nUNION ALL\n".join(
        f"SELECT 'shape' AS check, '{d}' AS item, "
        f"(SELECT count(DISTINCT {d}) FROM cube) = (SELECT count(DISTINCT {d}) FROM cube_b) AS same"
        for d in sorted(DIMS))
    coords = f"SELECT 'coords', coord, same FROM ({_coords_sql()})"
    data = """
SELECT 'data', strftime(st.S, '%Y-%m-%d'),
       coalesce(bool_and(CASE WHEN p.a IS NULL AND p.b IS NULL THEN true
                              WHEN p.a IS NULL OR p.b IS NULL THEN false
                              ELSE abs(p.a - p.b) <= CAST('1e-08' AS DOUBLE) + CAST('1e-05' AS DOUBLE) * abs(p.b)
                         END), false)
FROM (SELECT S FROM s WHERE pos IN (0, (SELECT count(*) FROM s) // 2, (SELECT count(*) FROM s) - 1)) st
LEFT JOIN pairs p ON p.S = st.S GROUP BY st.S"""
    return f"{shape}\nUNION ALL\n{coords}\nUNION ALL\n{data}"


@query("compare_cubes", with_views(_compare_sql(), **_POS_VIEWS, pairs=_PAIRS))
def q_compare_cubes(spark, sf_dir):
    a = FX.computed_cube(spark, sf_dir)
    return QL.compare_cubes(a, FX.comparison_cube(spark, sf_dir, of=a), "tas")


# ------------------------------------------------------------------ windows, sorts (ops 45-48)
@query("axis_position", with_views(
    "SELECT c.S, c.M, c.L, y.pos AS Y, c.X, c.tas, c.prate FROM cube c JOIN y USING (Y)",
    y=axis_sql("Y", desc=True)))
def q_axis_position(spark, sf_dir):
    return H.axis_position(FX.computed_cube(spark, sf_dir), "Y").cells


_WS = "".join(f"' || chr({ord(c)}) || '" for c in QL.PY_WHITESPACE)  # same characters as Spark


@query("pair_lines", f"""
WITH split AS (
  SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS arr FROM documents),
lines AS (
  SELECT doc_id, trim(arr[i], ('{_WS}')) AS s, i
  FROM split, range(1, len(arr) + 1) r(i)),
kept AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k
  FROM lines WHERE s <> '' AND NOT starts_with(s, '#')),
pairs AS (
  SELECT a.doc_id, a.k // 2 AS i, a.s AS url1, b.s AS url2
  FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND b.k = a.k + 1 WHERE a.k % 2 = 0)
SELECT doc_id, url1, arg_max(url2, i) AS url2 FROM pairs GROUP BY doc_id, url1""")
def q_pair_lines(spark, sf_dir):
    return QL.pair_lines(FX.table(spark, sf_dir, "documents"), "doc_id")


@query("standardize_y", with_views(
    "SELECT c.S, c.M, c.L, c.Y, c.X, c.tas, y.pos AS y_pos FROM cube c JOIN y USING (Y)",
    y=axis_sql("Y")))
def q_standardize_y(spark, sf_dir):
    c = H.standardize_y(FX.computed_cube(spark, sf_dir), want_increasing=True)
    return AL.with_positions(c, ["Y"]).select(*DIMS, "tas", F.col("Y_pos").alias("y_pos"))


@query("sample_starts", with_views("""
SELECT c.S, c.M, c.L, c.Y, c.X, c.tas FROM cube c JOIN s USING (S)
WHERE s.pos IN (0, (SELECT count(*) FROM s) // 2, (SELECT count(*) FROM s) - 1)""", s=axis_sql("S")))
def q_sample_starts(spark, sf_dir):
    c = FX.computed_cube(spark, sf_dir)
    starts = QL.sample_starts(c)
    return c.cells.join(F.broadcast(starts.select("S")), "S", "left_semi").select(*DIMS, "tas")


# ------------------------------------------------------------------ set operations (ops 49-51)
@query("concat_slices", with_views(
    "SELECT init_time, number, step, latitude, longitude, tas FROM assigned "
    "WHERE init_time = (SELECT min(init_time) FROM assigned)",
    **listing_views(), contents=CONTENTS, assigned=ASSIGNED))
def q_concat_slices(spark, sf_dir):
    assigned = FX.computed(_assigned(spark, sf_dir), "assigned")
    t0 = assigned.agg(F.min("init_time")).first()[0]
    first = assigned.filter(F.col("init_time") == F.lit(t0))
    return IG.concat_slices(first, ["init_time", "number", "step", "latitude", "longitude"]) \
        .select("init_time", "number", "step", "latitude", "longitude", "tas")


@query("append_times", with_views("SELECT * FROM cube"))
def q_append_times(spark, sf_dir):
    c = FX.computed_cube(spark, sf_dir)
    stored = _stored(spark, sf_dir, of=c).cells
    new = c.cells.filter(F.col("S") >= F.lit(STORED_BEFORE).cast("timestamp_ntz"))
    return IG.append_times(stored, new, "S")


@query("snapshot_identical", with_views("""
SELECT 'cells' AS part,
       (SELECT count(*) FROM (SELECT * FROM cube EXCEPT ALL SELECT * FROM cube_b)) AS n_only_a,
       (SELECT count(*) FROM (SELECT * FROM cube_b EXCEPT ALL SELECT * FROM cube)) AS n_only_b,
       (SELECT count(*) FROM (SELECT * FROM cube EXCEPT ALL SELECT * FROM cube_b)) = 0
   AND (SELECT count(*) FROM (SELECT * FROM cube_b EXCEPT ALL SELECT * FROM cube)) = 0 AS identical""",
    cube_b="SELECT S, M, L, Y, X, tas + CASE WHEN S = TIMESTAMP '1997-01-01' THEN CAST(1 AS DOUBLE) "
           "ELSE CAST(0 AS DOUBLE) END AS tas, prate FROM cube"))
def q_snapshot_identical(spark, sf_dir):
    a = FX.standard_cube(spark, sf_dir)
    b = a.replace(cells=a.cells.withColumn("tas", F.col("tas") + F.when(
        F.col("S") == F.lit("1997-01-01").cast("timestamp_ntz"), F.lit(1.0)).otherwise(F.lit(0.0))))
    return QL.snapshot_identical(a.cells, b.cells, by="S")


# ------------------------------------------------------------------ scalar functions (ops 52-62)


@query("convert_units", with_views(f"""
SELECT S, M, L, Y, X, tas * {dbl(1)} + {dbl(-KELVIN)} AS tas,
       prate * {dbl(PRATE_SCALE)} + {dbl(0)} AS prate FROM cube"""))
def q_convert_units(spark, sf_dir):
    std = {"tas": {"units": "degree_Celsius"}, "prate": {"units": "mm/day"}}
    return H.convert_units(FX.standard_cube(spark, sf_dir), std).cells


@query("convert_units_float32", with_views("""
SELECT S, M, L, Y, X,
       CAST(tas AS FLOAT) * CAST(1 AS FLOAT) + CAST(-273.15 AS FLOAT) AS tas,
       CAST(prate AS FLOAT) AS prate FROM cube"""))
def q_convert_units_float32(spark, sf_dir):
    c = SC.narrow_float(FX.standard_cube(spark, sf_dir))
    std = {"tas": {"units": "degree_Celsius"}, "prate": {"units": None}}
    out = H.convert_units(c, std)
    assert "units" not in out.attrs["prate"]
    return out.cells


_UNIT_VALUES = ", ".join(
    f"('{a}', '{b}', {dbl(1 if v is None else v[0])}, {dbl(0 if v is None else v[1])})"
    for (a, b), v in STANDARD_UNIT_CONVERSIONS.items())


@query("unit_table", with_views(f"""
SELECT S, M, L, Y, X, var, units, value * scale + "offset" AS value
FROM (SELECT S, M, L, Y, X, 'tas' AS var, 'K' AS from_units, 'degree_Celsius' AS units, tas AS value FROM cube
      UNION ALL
      SELECT S, M, L, Y, X, 'prate', 'kg m-2 s-1', 'mm/day', prate FROM cube) v
JOIN (VALUES {_UNIT_VALUES}) u(from_units, to_units, scale, "offset")
  ON u.from_units = v.from_units AND u.to_units = v.units"""))
def q_unit_table(spark, sf_dir):
    c = FX.standard_cube(spark, sf_dir)
    target = {"tas": "degree_Celsius", "prate": "mm/day"}
    long = c.cells.unpivot(list(DIMS), ["tas", "prate"], "var", "value")
    long = long.withColumns({
        "from_units": F.when(F.col("var") == "tas", F.lit(c.attrs["tas"]["units"]))
                       .otherwise(F.lit(c.attrs["prate"]["units"])),
        "units": F.when(F.col("var") == "tas", F.lit(target["tas"])).otherwise(F.lit(target["prate"])),
    })
    return H.convert_units_long(long, unit_table(spark)).select(*DIMS, "var", "units", "value")


_TARGETS = """
SELECT DISTINCT S, L,
       CAST(date_trunc('month', S) + to_months(L) AS TIMESTAMP) AS target,
       CAST(date_trunc('month', S) + to_months(L) AS TIMESTAMP) AS target_start,
       CAST(date_trunc('month', S) + to_months(L + 1) AS TIMESTAMP) AS target_end
FROM cube"""


@query("add_target_monthly", with_views(_TARGETS))
def q_add_target_monthly(spark, sf_dir):
    return H.target_frame(H.add_target_monthly(FX.standard_cube(spark, sf_dir)))


@query("add_target_daily", with_views("""
SELECT S, M, L, Y, X, tas, S + to_days(L) AS target, S + to_days(L) + INTERVAL 1 DAY AS target_end
FROM cube"""))
def q_add_target_daily(spark, sf_dir):
    c = FX.standard_cube(spark, sf_dir)
    tgt = c.cells.select("S", "L").distinct().withColumn(
        "target", F.timestamp_add("DAY", F.col("L"), F.col("S")))
    c = c.replace(coords={"target": Coord(("S", "L"), table=tgt)})
    out = H.add_target_daily(c)
    return (out.with_coords("target", "target_bnds")
               .select(*DIMS, "tas", "target", F.col("target_bnds.target_end").alias("target_end")))


@query("monthly_total", with_views(f"""
SELECT S, M, L, Y, X,
       (prate * {dbl(PRATE_SCALE)} + {dbl(0)}) * CAST(date_diff('day', date_trunc('month', S) + to_months(L),
                                     date_trunc('month', S) + to_months(L + 1)) AS DOUBLE) AS prate
FROM cube"""))
def q_monthly_total(spark, sf_dir):
    c = SC.select_data_vars(FX.standard_cube(spark, sf_dir), "prate")
    c = H.convert_units(c, {"prate": {"units": "mm/day"}})
    c = H.monthly_total(H.add_target_monthly(c), ["prate"])
    assert c.attrs["prate"]["units"] == "mm"
    return c.cells


@query("cf_time", with_views("""
SELECT DISTINCT S, CAST(date_diff('hour', TIMESTAMP '1960-01-01', S) AS INTEGER) AS S_enc,
       TIMESTAMP '1960-01-01' + to_hours(date_diff('hour', TIMESTAMP '1960-01-01', S)) AS S_dec
FROM cube"""))
def q_cf_time(spark, sf_dir):
    s = FX.standard_cube(spark, sf_dir).cells.select("S").distinct()
    unit = CAL.parse_units(FX.ENCODINGS["S"]["units"])
    enc = s.withColumn("S_enc", CAL.encode_time(F.col("S"), unit))
    return enc.withColumn("S_dec", CAL.decode_time(F.col("S_enc"), unit))


PACKED_ATTRS = {"_FillValue": 50, "scale_factor": 0.5, "add_offset": 10.0}


@query("cf_mask_scale", f"""
SELECT l_orderkey, l_linenumber,
       CASE WHEN CAST(l_quantity AS INTEGER) = 50 THEN NULL
            ELSE CAST(l_quantity AS INTEGER) * {dbl(0.5)} + {dbl(10.0)} END AS value
FROM lineitem""")
def q_cf_mask_scale(spark, sf_dir):
    li = FX.table(spark, sf_dir, "lineitem")
    packed = F.col("l_quantity").cast("int")
    return li.select("l_orderkey", "l_linenumber", mask_and_scale(packed, PACKED_ATTRS).alias("value"))


@query("convert_calendar", """
SELECT event_id, S FROM (
  SELECT event_id,
         CAST(try(make_date(CAST(floor(event_id / 360) AS INTEGER) + 1960,
                            CAST(floor(event_id / 30) AS INTEGER) % 12 + 1,
                            CAST(event_id % 30 AS INTEGER) + 1)) AS TIMESTAMP) AS S
  FROM events) WHERE S IS NOT NULL""")
def q_convert_calendar(spark, sf_dir):
    ev = FX.table(spark, sf_dir, "events")
    assert CAL.fix_calendar_name("360") == "360_day"
    return (ev.select("event_id", CAL.day360_to_standard(F.col("event_id")).alias("S"))
              .filter(F.col("S").isNotNull()))


@query("shift_lead", with_views(f"SELECT S, M, L - {dbl(0.5)} AS L, Y, X, tas, prate FROM cube"))
def q_shift_lead(spark, sf_dir):
    return H.shift_lead(FX.standard_cube(spark, sf_dir)).cells


TEMPERATURE_VARS = ("tos", "tas", "tasmax", "tasmin")


@query("allclose", with_views("""
SELECT a.S, a.M, a.L, a.Y, a.X,
       CASE WHEN a.tas IS NULL AND b.tas IS NULL THEN true WHEN a.tas IS NULL OR b.tas IS NULL THEN false
            ELSE abs(a.tas - b.tas) <= CAST('0.0001' AS DOUBLE) + CAST('1e-05' AS DOUBLE) * abs(b.tas) END AS close
FROM cube a JOIN cube_b b USING (S, M, L, Y, X)""",
    cube_b=CUBE_B.replace("Y + CAST('1e-09' AS DOUBLE) AS Y", "Y")))
def q_allclose(spark, sf_dir):
    a = FX.standard_cube(spark, sf_dir).cells
    b = FX.comparison_cube(spark, sf_dir, shift=False).cells.select(*DIMS, F.col("tas").alias("tas_b"))
    atol = 1e-4 if "tas" in TEMPERATURE_VARS else 1e-8
    return a.join(b, list(DIMS)).select(*DIMS, allclose(F.col("tas"), F.col("tas_b"), atol).alias("close"))


# ------------------------------------------------------------------ sources and sinks (ops 9-15, 29)


@query("decode_files", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def q_decode_files(spark, sf_dir):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("l_orderkey", T.LongType()),
                           T.StructField("l_linenumber", T.IntegerType()),
                           T.StructField("l_quantity", T.DoubleType())])
    # a folder of files of 20,000 lines each, decoded file by file
    folder = shared_dir(spark, "files", "decode_files")
    lines = FX.table(spark, sf_dir, "lineitem").select(*[f.name for f in schema.fields])
    lines.write.option("maxRecordsPerFile", 20_000).parquet(folder)
    dec = DC.decode_files(spark, folder, DC.parquet_decoder([f.name for f in schema.fields]), schema)
    good = QL.error_rate_gate(dec)
    return good.select("l_orderkey", "l_linenumber", "l_quantity")


@query("read_cube", with_views("SELECT S, M, L, Y, X, tas FROM cube"))
def q_read_cube(spark, sf_dir):
    root = shared_dir(spark, "stores", "read_cube")
    ST.write_cube(FX.standard_cube(spark, sf_dir), root, mode="overwrite")
    cube = ST.read_cube(spark, root, drop_variables=["prate"])
    assert cube.data_vars == ("tas",) and cube.descending == frozenset({"Y"})
    return cube.cells


@query("write_cube", with_views(
    "SELECT S, M, L, Y, X, CAST(tas AS FLOAT) AS tas, CAST(prate AS FLOAT) AS prate FROM cube"))
def q_write_cube(spark, sf_dir):
    root = shared_dir(spark, "stores", "write_cube")
    ST.write_cube(SC.narrow_float(FX.standard_cube(spark, sf_dir)), root, mode="overwrite", layout="packed")
    return ST.read_cube(spark, root).cells


@query("packed_slice", with_views(f"""
SELECT S, M, L, Y, X, tas * {dbl(1)} + {dbl(-KELVIN)} AS tas, prate * {dbl(PRATE_SCALE)} + {dbl(0)} AS prate
FROM cube WHERE S IN (SELECT S FROM s WHERE pos % 2 = 0) AND L IN (SELECT L FROM l WHERE pos IN (0, 2, 5))
  AND Y IN (SELECT Y FROM y WHERE pos BETWEEN 1 AND 3) AND X >= 90""",
    s=axis_sql("S"), l=axis_sql("L"), y=axis_sql("Y", desc=True)))
def q_packed_slice(spark, sf_dir):
    roots = [shared_dir(spark, "stores", "packed_slice") for _ in range(2)]
    ST.write_cube(FX.standard_cube(spark, sf_dir), roots[0], layout="packed")
    cube = ST.read_cube(spark, roots[0]).isel(S=slice(None, None, 2), L=[0, 2, 5], Y=slice(1, 4), X=slice(None, None, -1))
    cube = H.convert_units(cube.sel(X=slice(90.0, None)), {"tas": {"units": "degree_Celsius"}, "prate": {"units": "mm/day"}})
    assert cube.packed is not None
    ST.write_cube(cube, roots[1], layout="packed")   # from chunks to chunks
    return ST.read_cube(spark, roots[1]).cells


@query("catalog_open", with_views(
    f"SELECT S, M, L, Y, X, prate * {dbl(PRATE_SCALE)} + {dbl(0)} AS prcp FROM cube"))
def q_catalog_open(spark, sf_dir):
    cat = FX.fixture_catalog(spark, sf_dir)
    assert cat.open_variable("/ens/model/hindcast/") is None
    assert cat.open_variable("/ens/model/hindcast/nope") is None
    cube = cat.open_variable("/ens/model/hindcast/prcp")
    return cube.cells


@query("transform_chain", with_views(f"SELECT S, M, L, Y, X, tas * {dbl(1)} + {dbl(-KELVIN)} AS tas FROM cube"))
def q_transform_chain(spark, sf_dir):
    cube = FX.fixture_catalog(spark, sf_dir).open_variable("/ens/model/hindcast/tas")
    assert cube.ds_attrs["Distributor"] == "gridcube.example"
    assert cube.attrs["tas"]["units"] == "degree_Celsius"
    return cube.cells


@query("describe_cube")
def q_describe_cube(spark, sf_dir):
    cube = harmonized_cube(spark, sf_dir)
    return SC.describe_cube(cube).select("name", "role", "dims", "dtype", "size")


# ------------------------------------------------------------------ ingest and streaming (ops 36, 39, 40, 49, 50, 64, 65)

_GRID = ("step", "latitude", "longitude")
# every label that files may have; single files hold few of them
_GRID_LABELS = {"step": range(7), "latitude": [90.0 - 45 * k for k in range(5)], "longitude": [90.0 * k for k in range(4)]}


def _run_update(spark, sf_dir, store, var, limit=None, first=None):
    d = FX.descriptor(name=var)
    return SI.update(spark, d, store, FX.listing(spark, sf_dir).drop("o_orderkey"),
                     FX.decode_fixture_files(spark, sf_dir), data_vars=[var], grid_dims=_GRID,
                     limit=limit, first=first, attrs={var: FX.RAW_ATTRS[var]}, ds_attrs=FX.RAW_DS_ATTRS, grid=_GRID_LABELS)


@query("ingest_update", with_views("""
SELECT tm.init_time, mm.number, tm.step, tm.latitude, tm.longitude, CAST(a.tas AS FLOAT) AS tas
FROM (SELECT DISTINCT init_time, step, latitude, longitude FROM assigned
      WHERE init_time = (SELECT min(init_time) FROM assigned)) tm
CROSS JOIN (SELECT DISTINCT m AS number FROM parsed) mm
LEFT JOIN assigned a ON a.init_time = tm.init_time AND a.number = mm.number AND a.step = tm.step
      AND a.latitude = tm.latitude AND a.longitude = tm.longitude
UNION ALL
SELECT init_time, number, step, latitude, longitude, CAST(tas AS FLOAT) FROM assigned
WHERE init_time > (SELECT min(init_time) FROM assigned)""",
    **listing_views(), contents=CONTENTS, assigned=ASSIGNED))
def q_ingest_update(spark, sf_dir):
    store = shared_dir(spark, "stores", "ingest_update")
    assert _run_update(spark, sf_dir, store, "tas", limit=3)          # first start + 2 more
    assert _run_update(spark, sf_dir, store, "tas")                   # the rest
    assert not _run_update(spark, sf_dir, store, "tas")               # nothing new: idempotent
    return ST.read_cube(spark, store).cells


@query("run_summary")
def q_run_summary(spark, sf_dir):
    root = shared_dir(spark, "stores", "run_summary")
    runs = {v: (lambda v=v: _run_update(spark, sf_dir, f"{root}/{v}", v)) for v in ("tas", "prate")}
    runs["zg"] = lambda: _run_update(spark, sf_dir, f"{root}/zg", "zg")
    return SI.run_summary(spark, runs)


@query("late_start_guard", with_views("""
SELECT DISTINCT t AS init_time,
       CASE WHEN t < (SELECT max(S) FROM stored) THEN 'late' ELSE 'accepted' END AS status
FROM parsed WHERE t NOT IN (SELECT S FROM stored)""", **listing_views(),
    stored="SELECT * FROM cube WHERE S >= TIMESTAMP '1997-01-01' AND S < TIMESTAMP '2000-01-01'"))
def q_late_start_guard(spark, sf_dir):
    c = FX.computed_cube(spark, sf_dir)
    stored = c.cells.filter(F.col("S").between(F.lit("1997-01-01").cast("timestamp_ntz"),
                                               F.lit("1999-12-31").cast("timestamp_ntz")))
    incoming = AL.new_times(_parsed(spark, sf_dir), stored.select("S"))
    stored_max = stored.agg(F.max("S")).first()[0]
    return SI.late_start_guard(incoming.withColumnRenamed("t", "init_time"), stored_max)


@query("ingest_stream", with_views("SELECT * FROM cube"))
def q_ingest_stream(spark, sf_dir):
    c = FX.standard_cube(spark, sf_dir)
    base = shared_dir(spark, "streams", "ingest_stream")
    # the provider drops decoded slices into a folder (starts hashed over 8 files,
    # read as one micro-batch; the stream's late-start guard would reject a
    # later batch holding an older start)
    c.cells.repartition(8, "S").write.parquet(f"{base}/source")
    q = SI.ingest_stream(spark, f"{base}/source", c.cells.schema, f"{base}/store",
                         f"{base}/checkpoint", DIMS, c.data_vars, time_col="S")
    q.awaitTermination()
    return ST.read_cube(spark, f"{base}/store").cells


@query("ingest_file_stream", with_views(
    "SELECT init_time, number, step, latitude, longitude, CAST(tas AS FLOAT) AS tas FROM assigned",
    **listing_views(), contents=CONTENTS, assigned=ASSIGNED))
def q_ingest_file_stream(spark, sf_dir):
    from pyspark.sql import types as T
    base = shared_dir(spark, "streams", "ingest_file_stream")
    # the provider's raw files: one Parquet file per (start, member), named like the
    # listing, in a folder for each delivery
    assigned, bounds = _assigned(spark, sf_dir), FX.delivery_bounds(LS.dedupe_paths(_parsed(spark, sf_dir)))
    file = F.concat(FX.delivery(F.col("init_time"), bounds), F.lit("/"), F.regexp_extract("path", r"(fc_[^/]+\.nc)$", 1))
    FX.write_files(assigned.select(file.alias("file"), "step", "latitude", "longitude", "tas"), f"{base}/raw")
    schema = T.StructType([T.StructField("step", T.IntegerType()), T.StructField("latitude", T.DoubleType()),
                           T.StructField("longitude", T.DoubleType()), T.StructField("tas", T.DoubleType())])
    for k in range(len(bounds) + 1):
        desc = FX.descriptor()
        desc.dir = f"{base}/raw/{k}"
        q = SI.ingest_file_stream(spark, desc, DC.parquet_decoder([f.name for f in schema.fields]), schema, f"{base}/store",
                                  f"{base}/checkpoint/{k}", _GRID, ["tas"], grid=_GRID_LABELS, delivery=f"delivery{k}-")
        q.awaitTermination()
    return ST.read_cube(spark, f"{base}/store").cells


@query("export_cube", with_views("""
SELECT CAST(date_diff('hour', TIMESTAMP '1960-01-01', S) AS INTEGER) AS S, M, L, Y, X,
       CAST(date_trunc('month', S) + to_months(L) AS TIMESTAMP) AS target,
       tas * CAST('1' AS DOUBLE) + CAST('-273.15' AS DOUBLE) AS tas
FROM cube WHERE S <= TIMESTAMP '1999-05-01' AND M IN (1, 3)"""))
def q_export_cube(spark, sf_dir):
    from gridcube.sources.export import export_cube
    cube = FX.fixture_catalog(spark, sf_dir).open_variable("/ens/model/hindcast/tas")
    cube = cube.sel(S=slice(None, "1999-05-01"), M=[1, 3])
    cube = cube.replace(coords={"target": cube.coords["target"]},
                        ds_attrs={**cube.ds_attrs, "title": 'quoted "title"'})
    path = shared_dir(spark, "exports", "tas")
    out = export_cube(cube, path)
    assert "title" not in out.ds_attrs and out.attrs["tas"]["coordinates"] == "target target_bnds"
    assert out.attrs["S"]["units"] == "hours since 1960-01-01"
    return spark.read.parquet(f"{path}/data")
