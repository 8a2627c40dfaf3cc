"""Ships in an area: attributes, area names, geometry, notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwatch.functions import lexicons as L
from callwatch.functions import text as T

NEAR = 0.01
CORNERS = ("x1", "y1", "x2", "y2")
_KEYS = {"x1": ("lng1", "x1"), "y1": ("lat1", "y1"), "x2": ("lng2", "x2"), "y2": ("lat2", "y2")}
#: Areas that a join broadcasts; more are joined over grid cells.
MOST_AREAS = 10_000
#: Grids, of cells from ``NEAR`` degrees on, each four times as wide as the last.
LEVELS = 9
#: Degrees beyond which places lie in the outermost cells, whose pairs are still tested exactly.
OUTERMOST = 360.0
#: Ships of one cell of a band that meet in a task; more are dealt over several.
SHIPS_A_SHARE = 1_000_000


def ship_filter(ships: DataFrame, min_draft: float = 0.0, min_tonnage: int = 0, types: list[str] | None = None) -> DataFrame:
    wanted = [t.strip() for t in types or [] if t.strip()]
    out = ships.filter((F.col("draft_m") >= min_draft) & (F.col("tonnage_t") >= min_tonnage))
    return out.filter(F.col("ship_type").isin(wanted)) if wanted else out


def area_tokens(area: Column) -> Column:
    """The parts of an area's name, in capitals, without general words."""
    bare = T.text_or_empty(area)
    for word in L.AREA_WORDS:
        bare = F.replace(bare, F.lit(word), F.lit(" "))
    return F.filter(F.split(F.upper(bare), r"(?U)\s+"), lambda t: t != "")


def area_match(area: Column, label: Column) -> Column:
    """Whether a position label fits an area's name: a blank name fits all; some
    part of the name, or its first two characters, must be in the label."""
    tokens = area_tokens(area)
    where = T.text_or_empty(label)
    hit = F.exists(tokens, lambda t: F.contains(F.upper(where), t)) | F.contains(where, F.substring(T.text_or_empty(area), 1, 2))
    return F.when(T.nz(area).isNull() | (F.size(tokens) == 0), F.lit(True)).otherwise(hit)


def parse_geometry(x: Column) -> Column:
    """(type, x1, y1, x2, y2) of a JSON object of type rect or line all of whose
    other values are numbers, in quotes or not; null for anything else."""

    def of(m: Column) -> Column:
        others = F.map_filter(m, lambda k, v: k != "type")
        bad = F.exists(F.map_values(others), lambda v: v.try_cast("double").isNull())
        corner = lambda name: F.coalesce(*[F.element_at(others, k).try_cast("double") for k in _KEYS[name]])
        kind = F.element_at(m, F.lit("type"))
        return F.when(m.isNotNull() & kind.isin("rect", "line") & ~bad, F.struct(kind.alias("type"), *[corner(c).alias(c) for c in CORNERS]))

    return T.let(F.from_json(T.text_or_empty(x), "map<string,string>"), of)


def in_rect(lng: Column, lat: Column, g: Column) -> Column:
    """Whether a point is in a rectangle, corners in any order, edges included; a
    missing corner is the point's own."""
    x1, x2, y1, y2 = F.coalesce(g["x1"], lng), F.coalesce(g["x2"], lng), F.coalesce(g["y1"], lat), F.coalesce(g["y2"], lat)
    return lng.between(F.least(x1, x2), F.greatest(x1, x2)) & lat.between(F.least(y1, y2), F.greatest(y1, y2))


def line_distance(lng: Column, lat: Column, g: Column) -> Column:
    """Distance of a point to a line's segment, in degrees."""
    x1, x2, y1, y2 = F.coalesce(g["x1"], lng), F.coalesce(g["x2"], lng), F.coalesce(g["y1"], lat), F.coalesce(g["y2"], lat)
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    along = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lng - x1) * dx + (lat - y1) * dy) / F.nullif(square, F.lit(0.0)))))
    ex, ey = lng - (x1 + along * dx), lat - (y1 + along * dy)
    return F.sqrt(ex * ex + ey * ey)


def near_line(lng: Column, lat: Column, g: Column, limit: float = NEAR) -> Column:
    return line_distance(lng, lat, g) <= limit


def inside(lng: Column, lat: Column, label: Column, area: Column, geometry: Column) -> Column:
    """Whether a ship is in an area: by geometry if there is one, else by name."""
    shape = F.when(geometry["type"] == "rect", in_rect(lng, lat, geometry)).otherwise(near_line(lng, lat, geometry))
    return F.when(geometry.isNotNull(), shape).otherwise(area_match(area, label))


def _bounded(x: Column) -> Column:
    """``x`` within the outermost cells, which keeps the order of any two values."""
    return F.when(x.isNotNull(), F.greatest(F.lit(-OUTERMOST), F.least(F.lit(OUTERMOST), x)))


def _cell(x: Column, level: Column) -> Column:
    return F.floor(_bounded(x) / (NEAR * F.pow(F.lit(4.0), level))).cast("long")


def _level(span: Column) -> Column:
    """The finest grid of which ``span`` touches no more than some six cells."""
    return F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.ceil(F.log(4.0, (span + 2 * NEAR) / (4 * NEAR))))).cast("int")


def _inside_of_g() -> Column:
    return inside(F.col("lng"), F.col("lat"), F.col("position_label"), F.col("area_name"), F.col("g"))


def _in_cells(ships: DataFrame, parsed: DataFrame) -> DataFrame:
    """Ships in areas with whole geometries. An area lies in the finest grid of
    which it touches no more than some six cells a side."""
    whole = parsed.filter("g.x1 is not null and g.x2 is not null and g.y1 is not null and g.y2 is not null")
    side = lambda a, b: F.abs(_bounded(F.col(f"g.{a}")) - _bounded(F.col(f"g.{b}")))
    level = _level(F.greatest(side("x1", "x2"), side("y1", "y2")))

    def cells(a: str, b: str) -> Column:
        return F.explode(F.sequence(_cell(F.least(f"g.{a}", f"g.{b}") - NEAR, F.col("__level")), _cell(F.greatest(f"g.{a}", f"g.{b}") + NEAR, F.col("__level"))))

    shaped = whole.withColumn("__level", level).withColumn("__cx", cells("x1", "x2")).withColumn("__cy", cells("y1", "y2"))
    used = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    placed = ships.withColumn("__grid", used).withColumn("__sx", _cell(F.col("lng"), F.col("__grid"))).withColumn("__sy", _cell(F.col("lat"), F.col("__grid")))
    same = (F.col("__grid") == F.col("__level")) & (F.col("__sx") == F.col("__cx")) & (F.col("__sy") == F.col("__cy"))
    met = placed.join(shaped, same & _inside_of_g())
    return met.drop("__grid", "__sx", "__sy", "__level", "__cx", "__cy", "g", "geometry")


def _bands(g: Column) -> Column:
    """The bands, structs of (axis, low, high), in one of which a ship must lie to
    be in a geometry that lacks a corner; an empty array where any ship may be.

    A missing coordinate is the ship's own. So a shape that lacks longitudes only
    bounds the latitude, and the other way round. A line from (own, y) to
    (x, own) is near where a ship is close to that latitude or that longitude:
    its distance is at least the lesser of the two differences over the square
    root of two. Any other shape holds each ship: a rectangle has no bound left,
    and a line has one end at the ship.
    """
    band = lambda axis, a, b: F.struct(F.lit(axis).alias("axis"), (F.least(a, b) - 2 * NEAR).alias("low"), (F.greatest(a, b) + 2 * NEAR).alias("high"))
    x1, y1, x2, y2 = (g[c] for c in CORNERS)
    has_x, has_y = x1.isNotNull() & x2.isNotNull(), y1.isNotNull() & y2.isNotNull()
    line = g["type"] == "line"
    none = F.array().cast("array<struct<axis:string,low:double,high:double>>")
    return (
        F.when(has_y, F.array(band("y", y1, y2)))
        .when(has_x, F.array(band("x", x1, x2)))
        .when(line & y1.isNotNull() & x2.isNotNull(), F.array(band("y", y1, y1), band("x", x2, x2)))
        .when(line & x1.isNotNull() & y2.isNotNull(), F.array(band("y", y2, y2), band("x", x1, x1)))
        .otherwise(none)
    )


def _with_all(ships: DataFrame, areas: DataFrame, shares: int) -> DataFrame:
    """Each ship with each area, for areas that hold all ships: ships are dealt
    into shares, each of which has a copy of the areas."""
    dealt = ships.withColumn("__share", F.pmod(F.xxhash64("ship_id", "lng", "lat"), F.lit(shares)))
    copied = areas.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    return dealt.join(copied, F.col("__share") == F.col("__copy")).drop("__share", "__copy")


def _in_bands(ships: DataFrame, parsed: DataFrame, shares: int) -> DataFrame:
    """Ships in areas whose geometry lacks a corner: those that leave a band of
    longitudes or latitudes meet the ships in its cells, the finest of which it
    touches no more than some six; those that hold all ships take them all. A
    wide band's cells hold many ships, which are dealt into shares."""
    partial = parsed.filter("g is not null and (g.x1 is null or g.x2 is null or g.y1 is null or g.y2 is null)").withColumn("__bands", _bands(F.col("g")))
    # of a ship in both bands of a shape only the first counts, so that pairs don't repeat
    shaped = partial.select("*", F.posexplode("__bands").alias("__i", "__band"))
    low, high = F.col("__band.low"), F.col("__band.high")
    shaped = shaped.withColumn("__level", _level(_bounded(high) - _bounded(low)))
    shaped = shaped.withColumn("__cell", F.explode(F.sequence(_cell(low, F.col("__level")), _cell(high, F.col("__level")))))
    shaped = shaped.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    own = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).cast("double").alias("at")) for a, c in (("x", "lng"), ("y", "lat"))])
    placed = ships.withColumn("__own", F.explode(own)).withColumn("__grid", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    placed = placed.withColumn("__place", _cell(F.col("__own.at"), F.col("__grid"))).withColumn("__share", F.pmod(F.xxhash64("ship_id", "lng", "lat"), F.lit(shares)))
    same = (F.col("__own.axis") == F.col("__band.axis")) & (F.col("__grid") == F.col("__level")) & (F.col("__place") == F.col("__cell")) & (F.col("__share") == F.col("__copy"))
    first = F.get("__bands", F.lit(0))
    again = (F.col("__i") > 0) & F.col("lat").between(first["low"], first["high"])
    held = F.col("__own.at").between(low, high) & ~again & _inside_of_g()
    met = placed.join(shaped, same & held).drop("__own", "__grid", "__place", "__share", "__bands", "__i", "__band", "__level", "__cell", "__copy")
    every = _with_all(ships, partial.filter(F.size("__bands") == 0).drop("__bands"), shares).filter(_inside_of_g())
    return met.unionByName(every).drop("g", "geometry")


#: Characters by which an area's parts are looked up in labels.
GRAM = 3


def _by_name(ships: DataFrame, named: DataFrame, shares: int) -> DataFrame:
    """Ships whose label fits the name of an area. An area's parts and first two
    characters are looked up by their first characters, up to ``GRAM``, among
    those of each distinct label, and then sought in it, so the work grows with
    a label's length; areas that fit all labels, blank ones, take all ships."""
    labels = ships.select(F.col("position_label").alias("__label")).distinct()
    where = T.text_or_empty(F.col("__label"))
    starts = lambda x: F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1)))
    runs = lambda x, n: F.transform(starts(x), lambda i: F.substring(x, i, n))
    grams = lambda x: F.array_distinct(F.flatten(F.array(*[runs(x, F.lit(n)) for n in range(1, GRAM + 1)])))
    keys = F.concat(F.transform(grams(F.upper(where)), lambda k: F.concat(F.lit("t"), k)), F.transform(grams(where), lambda k: F.concat(F.lit("p"), k)))
    looked = labels.select("__label", F.explode(keys).alias("__key"))
    tokens, name = area_tokens(F.col("area_name")), T.text_or_empty(F.col("area_name"))
    blank = T.nz(F.col("area_name")).isNull() | (F.size(tokens) == 0)
    part = lambda kind, x: F.struct(F.concat(F.lit(kind), F.substring(x, 1, GRAM)).alias("key"), F.lit(kind).alias("kind"), x.alias("part"))
    wanted = named.filter(~blank).withColumn("__want", F.explode(F.array_append(F.transform(tokens, lambda t: part("t", t)), part("p", F.substring(name, 1, 2)))))
    held = F.contains(F.when(F.col("__want.kind") == "t", F.upper(where)).otherwise(where), F.col("__want.part"))
    fits = wanted.join(looked, (F.col("__want.key") == F.col("__key")) & held).drop("__want", "__key").distinct()
    all_ = named.filter(blank)
    return ships.join(fits, F.col("position_label").eqNullSafe(F.col("__label"))).drop("__label").unionByName(_with_all(ships, all_, shares))


def inspect_ships(ships: DataFrame, areas: DataFrame, min_draft: float = 0.0, min_tonnage: int = 0, types: list[str] | None = None) -> DataFrame:
    """Ships (attribute filters passed) with each area (area_id, area_name,
    geometry JSON) that holds them.

    Up to ``MOST_AREAS`` areas are broadcast. Beyond, areas with a geometry meet
    ships in the cells that their bounds touch, of a grid whose cells suit the
    area's size; those known by name alone meet the distinct position labels on
    what the two share. A missing corner is the ship's own, so geometries that
    lack one leave a band of longitudes or latitudes, or hold every ship.
    """
    wanted = ship_filter(ships, min_draft, min_tonnage, types)
    parsed = areas.withColumn("g", parse_geometry(F.col("geometry")))
    if areas.count() <= MOST_AREAS:
        return wanted.join(F.broadcast(parsed), _inside_of_g()).drop("g", "geometry")
    by_shape = _in_cells(wanted, parsed)
    shares = wanted.count() // SHIPS_A_SHARE + 1
    by_name = _by_name(wanted, parsed.filter("g is null").drop("g", "geometry"), shares)
    return by_shape.unionByName(by_name).unionByName(_in_bands(wanted, parsed, shares))


def notices(matches: DataFrame, template: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One notice for each matched ship and area; ids depend on both. Columns of
    the match that are to ``keep`` follow."""
    number = F.substring(F.sha2(F.concat_ws("|", F.col("ship_id").cast("string"), F.col("area_id").cast("string")), 256), 1, 10)
    return matches.select(F.concat(F.lit("notice_"), number).alias("notice_id"), "ship_id", "area_id", T.render_notice(F.lit(template), F.col("ship_name"), T.text_or_empty(F.col("area_name"))).alias("notice_text"), *keep)


def inspection_meta(matches: DataFrame, sent: DataFrame, min_draft: float = 0.0, min_tonnage: int = 0, types: list[str] | None = None) -> DataFrame:
    """The parameters, matched ships and notices by area, as counts; the ships
    and notices themselves are the rows of ``matches`` and ``sent``, as those of
    an area have no bound."""
    told = sent.groupBy(F.col("area_id").alias("__a")).agg(F.count("*").alias("notices"))
    return matches.groupBy("area_id", "area_name").agg(F.count("*").alias("matched_count"), F.min("ship_id").alias("first_ship"), F.max("ship_id").alias("last_ship")).join(told, F.col("area_id") == F.col("__a"), "left").drop("__a").withColumns({"min_draft_m": F.lit(min_draft), "min_tonnage_t": F.lit(min_tonnage), "allowed_ship_types": F.lit("|".join(types or []))})


def inspection_messages(matches: DataFrame, sent: DataFrame, channel: str, min_draft: float = 0.0, min_tonnage: int = 0) -> DataFrame:
    """(channel_id, type, payload): a status when the inspection of an area
    starts and one when it is completed, and a message for each notice."""
    areas = matches.groupBy("area_id", "area_name").agg(F.count("*").alias("matched_count"))
    message = lambda kind, *fields: (F.lit(channel).alias("channel_id"), F.lit(kind).alias("type"), F.to_json(F.struct(*fields)).alias("payload"))
    started = areas.select(*message("inspection_status", F.lit("started").alias("stage"), "area_id", "area_name", F.lit(min_draft).alias("min_draft_m"), F.lit(min_tonnage).alias("min_tonnage_t")))
    done = areas.select(*message("inspection_status", F.lit("completed").alias("stage"), "area_id", "area_name", "matched_count"))
    told = sent.select(*message("inspection_notice", "notice_id", "ship_id", "area_id", "notice_text"))
    return started.unionByName(done).unionByName(told)


def template_lookup(requests: DataFrame, scenarios: DataFrame, fallback: str) -> DataFrame:
    """Requests with the template of their scenario_id, or the fallback."""
    known = scenarios.select(F.col("scenario_id").alias("__s"), "notice_template")
    return requests.join(known, T.trim_ws(F.col("scenario_id")) == F.col("__s"), "left").withColumn("template", F.coalesce("notice_template", F.lit(fallback))).drop("__s", "notice_template")


def anchor_by_label(ships: DataFrame, order: str = "ship_id") -> DataFrame:
    """Ships with the coordinates of the first of their position label."""
    first = ships.groupBy(F.col("position_label").alias("__p")).agg(F.min_by(F.struct("lng", "lat"), order).alias("__at"))
    return ships.join(first, F.col("position_label") == F.col("__p")).withColumn("lng", F.col("__at.lng")).withColumn("lat", F.col("__at.lat")).drop("__p", "__at")


def upsert_ships(ships: DataFrame, new: DataFrame) -> DataFrame:
    """``ships`` with valid rows of ``new``, which replace those of their id:
    blank destinations and labels get defaults, missing ids depend on name and
    place, and coordinates must be on the globe."""
    made = F.concat(F.lit("ship_"), F.substring(F.sha1(F.concat_ws("_", F.col("ship_name"), F.col("lng").cast("string"), F.col("lat").cast("string"))), 1, 10))
    rows = new.filter(F.col("lng").between(-180, 180) & F.col("lat").between(-90, 90)).withColumn("ship_id", F.coalesce(T.nz(F.col("ship_id")), made))
    rows = rows.withColumn("destination", F.coalesce(T.nz(F.col("destination")), F.lit("-"))).withColumn("position_label", F.coalesce(T.nz(F.col("position_label")), F.lit("-")))
    both = ships.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    # of several new rows of one id that of the greatest hash, so that reruns agree
    last = Window.partitionBy("ship_id").orderBy(F.desc("__new"), F.desc(F.xxhash64(*[F.col(f"`{c}`") for c in ships.columns])))
    return both.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__new", "__n")


def remove_ships(ships: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select(T.trim_ws(F.col("ship_id")).alias("__id")).filter("__id <> ''")
    return ships.join(gone, F.col("ship_id") == F.col("__id"), "left_anti")


def append_scenarios(scenarios: DataFrame, new: DataFrame) -> DataFrame:
    """``scenarios`` with the trimmed rows of ``new`` that have a name and a
    template; ids depend on both."""
    rows = new.select(T.trim_ws(F.col("scenario_name")).alias("scenario_name"), T.trim_ws(F.col("notice_template")).alias("notice_template")).filter("scenario_name <> '' and notice_template <> ''")
    rows = rows.withColumn("scenario_id", F.concat(F.lit("custom_"), F.substring(F.sha1(F.concat_ws("|", "scenario_name", "notice_template")), 1, 8)))
    return scenarios.unionByName(rows.select(*scenarios.columns))
