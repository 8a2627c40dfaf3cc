"""Queries over ships and areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from callwatch.functions import lexicons as L
from callwatch.functions import text as T
from callwatch.operators import inspection
from callwatch.plans import views
from callwatch.plans.sql import with_views
from callwatch.runtime import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TEMPLATE = "请{船名}注意，你船位于{区域}。"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_NUMBER = "try_cast(json_extract_string(geometry, '$.{0}') as double)"
_MATCH = "(trim({a}) = '' or len({t}) = 0 or len(list_filter({t}, lambda k: contains(upper({l}), k))) > 0 or contains({l}, substr({a}, 1, 2)))"
_TOKENS = "list_filter(string_split(replace(replace(replace(upper({a}), '段', ' '), '区', ' '), '主航道', ' '), ' '), lambda k: k <> '')"


def _area_sql(a: str, label: str) -> str:
    return _MATCH.format(a=a, l=label, t=_TOKENS.format(a=a))


_GEO = f"geo as (select area_id, area_name, case when json_valid(geometry) then json_extract_string(geometry, '$.type') end ty, {', '.join(f'case when json_valid(geometry) then {_NUMBER.format(k)} end {n}' for k, n in (('lng1', 'x1'), ('lat1', 'y1'), ('lng2', 'x2'), ('lat2', 'y2')))} from areas)"
_ALONG = "greatest(0.0, least(1.0, ((lng - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))"
_DISTANCE = f"sqrt((lng - (x1 + {_ALONG} * (x2 - x1))) * (lng - (x1 + {_ALONG} * (x2 - x1))) + (lat - (y1 + {_ALONG} * (y2 - y1))) * (lat - (y1 + {_ALONG} * (y2 - y1))))"
_RECT = "lng between least(x1, x2) and greatest(x1, x2) and lat between least(y1, y2) and greatest(y1, y2)"
_INSIDE = f"case when ty = 'rect' then {_RECT} when ty = 'line' then {_DISTANCE} <= 0.01 else {_area_sql('area_name', 'position_label')} end"
SH = with_views("ships", "areas", extra=f"{_GEO}, wanted as (select * from ships where draft_m >= 5 and tonnage_t >= 9200), matched as (select w.*, area_id, area_name from wanted w, geo where {_INSIDE})")


def _matched(spark, sf_dir):
    return inspection.inspect_ships(views.ships(spark, sf_dir), views.areas(spark), 5.0, 9200)


@query(SH + "select ship_id, draft_m, tonnage_t from ships where draft_m >= 5 and tonnage_t >= 9200")
def ship_filter(spark, sf_dir):
    return inspection.ship_filter(views.ships(spark, sf_dir), 5.0, 9200).select("ship_id", "draft_m", "tonnage_t")


@query("select p_partkey as ship_id from part where p_type in (select p_type from part where p_partkey < 10)")
def ship_type_semi(spark, sf_dir):
    s = views.ships(spark, sf_dir)
    wanted = s.filter("ship_id < 10").select(F.col("ship_type").alias("__t")).distinct()
    return s.join(wanted, F.col("ship_type") == F.col("__t"), "left_semi").select("ship_id")


_NAMES = ["a3段", "主航道 A1区", "段", " ", "A9"]


@query(with_views("ships") + f"select ship_id, area, {_area_sql('area', 'position_label')} as matched from ships, (values ('a3段'), ('主航道 A1区'), ('段'), (' '), ('A9')) t(area)")
def area_match(spark, sf_dir):
    rows = views.ships(spark, sf_dir).withColumn("area", F.explode(T.words_of(_NAMES)))
    return rows.select("ship_id", "area", inspection.area_match(F.col("area"), F.col("position_label")).alias("matched"))


# each ship's own shape, as JSON: some broken, some blank
_SHAPES = """own as (select p_partkey ship_id, case when p_partkey % 13 = 0 then '{broken' when p_partkey % 11 = 0 then '' else concat('{"type":"', case when p_size % 2 = 0 then 'rect' else 'line' end, '","lng1":"121.', 100 + p_partkey % 100, '","lat1":"29.', 100 + p_size, '","lng2":"122.', 100 + p_size, '","lat2":"', p_partkey % 90, '"}') end geometry from part)"""


@query("with " + _SHAPES + "," + _GEO.replace("area_id, area_name", "ship_id").replace("from areas", "from own") + " select ship_id, ty as type, x1, y1, x2, y2 from geo")
def parse_geometry(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    parts = [F.lit('{"type":"'), F.when(size % 2 == 0, F.lit("rect")).otherwise(F.lit("line")), F.lit('","lng1":"121.'), (100 + k % 100).cast("string"), F.lit('","lat1":"29.'), (100 + size).cast("string"), F.lit('","lng2":"122.'), (100 + size).cast("string"), F.lit('","lat2":"'), (k % 90).cast("string"), F.lit('"}')]
    shape = F.when(k % 13 == 0, F.lit("{broken")).when(k % 11 == 0, F.lit("")).otherwise(F.concat(*parts))
    return table(spark, sf_dir, "part").select(k.alias("ship_id"), inspection.parse_geometry(shape).alias("g")).select("ship_id", "g.type", "g.x1", "g.y1", "g.x2", "g.y2")


def _shape(x1, y1, x2, y2):
    return F.struct(*[F.lit(v).alias(k) for k, v in zip(inspection.CORNERS, (x1, y1, x2, y2), strict=True)])


@query(with_views("ships") + f", g as (select *, 121.86::double x1, 29.95::double y1, 121.82::double x2, 29.91::double y2 from ships) select ship_id, {_RECT} as inside from g")
def in_rect(spark, sf_dir):
    return views.ships(spark, sf_dir).select("ship_id", inspection.in_rect(F.col("lng"), F.col("lat"), _shape(121.86, 29.95, 121.82, 29.91)).alias("inside"))


@query(with_views("ships") + f", g as (select *, 121.80::double x1, 29.90::double y1, 121.90::double x2, 29.97::double y2 from ships) select ship_id, round({_DISTANCE}, 9) as distance, {_DISTANCE} <= 0.01 as near from g")
def near_line(spark, sf_dir):
    s, g = views.ships(spark, sf_dir), _shape(121.80, 29.90, 121.90, 29.97)
    return s.select("ship_id", F.round(inspection.line_distance(F.col("lng"), F.col("lat"), g), 9).alias("distance"), inspection.near_line(F.col("lng"), F.col("lat"), g).alias("near"))


@query(SH + "select ship_id, area_id from matched")
def inspect_ships(spark, sf_dir):
    return _matched(spark, sf_dir).select("ship_id", "area_id")


@query(SH + "select concat('notice_', substr(sha256(concat(ship_id, '|', area_id)), 1, 10)) as notice_id, ship_id, area_id, concat('请', ship_name, '注意，你船位于', area_name, '。') as notice_text from matched")
def notices(spark, sf_dir):
    return inspection.notices(_matched(spark, sf_dir), TEMPLATE)


@query(SH + "select area_id, area_name, count(*) as matched_count, min(ship_id) as first_ship, max(ship_id) as last_ship, count(*) as notices, 5.0::double as min_draft_m, 9200 as min_tonnage_t, '' as allowed_ship_types from matched group by 1, 2")
def inspection_meta(spark, sf_dir):
    m = _matched(spark, sf_dir)
    return inspection.inspection_meta(m, inspection.notices(m, TEMPLATE), 5.0, 9200)


@query(SH + """, per as (select area_id, area_name, count(*) n from matched group by 1, 2)
 select 'c' as channel_id, 'inspection_status' as type, concat('{"stage":"started","area_id":', area_id, ',"area_name":"', area_name, '","min_draft_m":5.0,"min_tonnage_t":9200}') as payload from per
 union all select 'c', 'inspection_status', concat('{"stage":"completed","area_id":', area_id, ',"area_name":"', area_name, '","matched_count":', n, '}') from per
 union all select 'c', 'inspection_notice', concat('{"notice_id":"notice_', substr(sha256(concat(ship_id, '|', area_id)), 1, 10), '","ship_id":', ship_id, ',"area_id":', area_id, ',"notice_text":"请', ship_name, '注意，你船位于', area_name, '。"}') from matched""")
def inspection_messages(spark, sf_dir):
    m = _matched(spark, sf_dir)
    return inspection.inspection_messages(m, inspection.notices(m, TEMPLATE), "c", 5.0, 9200)


@query("select p_partkey as ship_id, concat('请', p_name, '注意，你船位于', p_type, '。') as notice from part")
def render_notice(spark, sf_dir):
    return views.ships(spark, sf_dir).select("ship_id", T.render_notice(F.lit(TEMPLATE), F.col("ship_name"), F.col("ship_type")).alias("notice"))


@query("select event_id, case event_id % 3 when 0 then 'T0' when 1 then 'T1' else 'fallback' end as template from events")
def template_lookup(spark, sf_dir):
    known = spark.createDataFrame([("s0", "T0"), ("s1", "T1")], "scenario_id string, notice_template string")
    asked = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit(" s"), (F.col("event_id") % 3).cast("string")).alias("scenario_id"))
    return inspection.template_lookup(asked, known, "fallback").select("event_id", "template")


@query(with_views("ships") + "select ship_id, position_label, first_value(lng) over w as lng, first_value(lat) over w as lat from ships window w as (partition by position_label order by ship_id rows between unbounded preceding and unbounded following)")
def anchor_by_label(spark, sf_dir):
    return inspection.anchor_by_label(views.ships(spark, sf_dir)).select("ship_id", "position_label", "lng", "lat")


@query(with_views("ships") + ", n as (select cast(ship_id + 1000 as varchar) ship_id, concat(ship_name, '!') ship_name, 'L' position_label from ships where ship_id % 2 = 0 and ship_id % 10 <> 0), o as (select cast(ship_id as varchar) ship_id, ship_name, position_label from ships) select * from n union all select * from o where ship_id not in (select ship_id from n)")
def upsert_ships(spark, sf_dir):
    s = views.ships(spark, sf_dir).withColumn("ship_id", F.col("ship_id").cast("string"))
    k = F.col("ship_id").cast("long")
    new = s.filter(k % 2 == 0).withColumn("lng", F.when(k % 10 == 0, F.lit(999.0)).otherwise(F.col("lng"))).withColumn("ship_id", (k + 1000).cast("string")).withColumn("ship_name", F.concat("ship_name", F.lit("!"))).withColumn("position_label", F.lit("L"))
    return inspection.upsert_ships(s, new).select("ship_id", "ship_name", "position_label")


@query("select cast(p_partkey as varchar) as ship_id from part where p_partkey % 3 <> 0")
def remove_ships(spark, sf_dir):
    s = views.ships(spark, sf_dir).select(F.col("ship_id").cast("string").alias("ship_id"))
    return inspection.remove_ships(s, s.filter(F.col("ship_id").cast("long") % 3 == 0))
