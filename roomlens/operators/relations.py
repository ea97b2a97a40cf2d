"""Relations between the entities of a room, for axis-aligned rectangles: joins on the room with closed-form measures.

Frames have the columns of sources.driver_tables. Every self-join is an equi-join on the room with the cheap
conditions as a residual; a room has a handful of entities, so no group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metres: overlap area, distance of an opening from the wall, back-off before contact.
OVERLAP, ATTACHED, BACK_OFF = 1e-5, 0.05, 1e-5
DIRECTIONS = ("up", "down", "left", "right")
#: Rectangles that a room of each group is asked to hold (name, width, depth).
CATALOG = {
    "kitchen": (("compact kitchen cart", 0.8, 0.5), ("dining table", 1.8, 0.9), ("large kitchen island", 2.4, 1.2), ("commercial prep table", 3.0, 1.0)),
    "living_room": (("side table", 0.8, 0.8), ("antique storage chest", 2.5, 1.0), ("large sectional sofa", 3.8, 2.5), ("game table", 3.0, 1.7)),
    "bedroom": (("bedside table", 0.6, 0.5), ("desk table", 2.0, 1.0), ("wardrobe", 3.0, 0.8), ("large bed", 2.5, 2.2)),
    "hssd": (("small cabinet", 0.8, 0.5), ("desk table", 2.0, 1.0), ("antique storage chest", 2.5, 1.0), ("large storage unit", 3.5, 1.2)),
}
#: Label parts of preferred objects to move and of path ends, by group.
MOVABLE = {
    "kitchen": ("stove", "fridge", "sink", "dishwasher", "table", "chair"),
    "living_room": ("sofa", "loveseat", "armchair", "coffee table", "side table", "tv stand", "bookshelf", "plant"),
    "bedroom": ("bed", "dresser", "wardrobe", "desk", "chair", "bookshelf", "ottoman", "plant"),
}
PATH_ENDS = {
    "kitchen": ("stove", "fridge", "sink", "dishwasher", "door", "window", "table"),
    "living_room": ("door", "window", "sofa", "loveseat", "armchair", "coffee table", "side table", "tv stand", "television", "bookshelf", "fireplace"),
    "bedroom": ("door", "window", "bed", "dresser", "wardrobe", "desk", "bookshelf", "chair"),
}


def blocks() -> Column:
    """Neither a floor covering nor a ceiling fixture."""
    return ~F.col("is_soft") & ~F.col("is_ceiling")


def centred(entities: DataFrame) -> DataFrame:
    return entities.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})


def pairs(entities: DataFrame) -> DataFrame:
    """Unordered pairs of a room: columns a_* and b_*, a's seq below b's."""
    a = entities.select("room_id", *(F.col(c).alias(f"a_{c}") for c in entities.columns if c != "room_id"))
    b = entities.select("room_id", *(F.col(c).alias(f"b_{c}") for c in entities.columns if c != "room_id"))
    return a.join(b, "room_id").where("a_seq < b_seq")


def _apart() -> tuple[Column, Column]:
    return F.col("b_cx") - F.col("a_cx"), F.col("b_cy") - F.col("a_cy")


def pair_distance(entities: DataFrame) -> DataFrame:
    dx, dy = _apart()
    return pairs(centred(entities)).select("room_id", "a_label", "b_label", F.round(F.sqrt(dx * dx + dy * dy), 6).alias("distance"))


def view_angle(entities: DataFrame) -> DataFrame:
    """Degrees between the way from one centroid to the other and north; pairs with one centroid are left out."""
    dx, dy = _apart()
    size = F.sqrt(dx * dx + dy * dy)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dy / size))))
    return pairs(centred(entities)).where(size > 1e-12).select("room_id", "a_label", "b_label", F.round(angle, 6).alias("angle"))


def _corners() -> Column:
    """Distinct corners of a rectangle; one without width or depth has two or one."""
    return F.size(F.array_distinct(F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))))))


def inspect_entity(entities: DataFrame) -> DataFrame:
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return centred(entities).select("room_id", "label", "kind", *(F.round(c, 6).alias(c) for c in ("cx", "cy")), "x1", "y1", "x2", "y2", F.round(area, 6).alias("area"), _corners().alias("n_vertices"))


def inspect_room(rooms: DataFrame, entities: DataFrame) -> DataFrame:
    """Per room and type: how many, and the ids in order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("seq", "label"))), lambda e: e["label"])
    groups = entities.groupBy("room_id", "kind", "type").agg(F.count(F.lit(1)).alias("n"), F.array_join(ids, ", ").alias("ids"))
    return rooms.join(groups, "room_id").select("room_id", "source_group", F.round(F.col("room_w") * F.col("room_h"), 6).alias("room_area"), "kind", "type", "n", "ids")


def nearest(entities: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest entities of each, by centroid; ties by seq."""
    c = centred(entities)
    a = c.select("room_id", F.col("seq").alias("a_seq"), F.col("label").alias("a_label"), F.col("cx").alias("a_cx"), F.col("cy").alias("a_cy"))
    b = c.select("room_id", F.col("seq").alias("b_seq"), F.col("label").alias("b_label"), F.col("cx").alias("b_cx"), F.col("cy").alias("b_cy"))
    dx, dy = _apart()
    near = a.join(b, "room_id").where("a_seq <> b_seq").withColumn("distance", F.round(F.sqrt(dx * dx + dy * dy), 6))
    rank = F.row_number().over(Window.partitionBy("room_id", "a_seq").orderBy("distance", "b_seq"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("room_id", "a_label", "rank", "b_label", "distance")


def _shared(low_a: str, high_a: str, low_b: str, high_b: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(high_a, high_b) - F.greatest(low_a, low_b))


def overlap_pairs(entities: DataFrame) -> DataFrame:
    """Blocking objects whose overlap is larger than OVERLAP."""
    area = _shared("a_x1", "a_x2", "b_x1", "b_x2") * _shared("a_y1", "a_y2", "b_y1", "b_y2")
    return pairs(entities.where(blocks() & (F.col("kind") == "object"))).where(area > OVERLAP).select("room_id", "a_label", "b_label", F.round(area, 6).alias("area"))


def duplicate_labels(entities: DataFrame, label: str = "type") -> DataFrame:
    """Labels, case-folded, that a room has more than once."""
    return entities.groupBy("room_id", F.lower(label).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def validation(rooms: DataFrame, entities: DataFrame) -> DataFrame:
    """Per room: entities outside it (objects are errors, openings warnings), openings off the wall, overlapping blockers, and validity."""
    e = entities.join(rooms, "room_id")
    inside = _shared_with_room()
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    out = area - inside > OVERLAP
    opening = F.col("kind") != "object"
    zero = F.lit(0.0)
    within = (F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") <= F.col("room_w")) & (F.col("y2") <= F.col("room_h"))
    to_wall = F.least("x1", "y1", F.col("room_w") - F.col("x2"), F.col("room_h") - F.col("y2"))
    beyond_x, beyond_y = F.greatest(F.col("x1") - F.col("room_w"), -F.col("x2"), zero), F.greatest(F.col("y1") - F.col("room_h"), -F.col("y2"), zero)
    off = F.when(within, to_wall).otherwise(F.sqrt(beyond_x * beyond_x + beyond_y * beyond_y))
    per = e.groupBy("room_id").agg(
        F.count(F.lit(1)).alias("n_entities"), F.count_if(out & ~opening).alias("n_outside"), F.count_if(out & opening).alias("n_openings_outside"),
        F.count_if(opening & (off > ATTACHED)).alias("n_detached"),
    )
    overlaps = overlap_pairs(entities).groupBy("room_id").agg(F.count(F.lit(1)).alias("n_overlaps"))
    return per.join(overlaps, "room_id", "left").select(*per.columns, F.coalesce("n_overlaps", F.lit(0)).alias("n_overlaps"), ((F.col("n_entities") >= 2) & (F.col("n_outside") == 0)).alias("valid"))


def _shared_with_room() -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least("x2", "room_w") - F.greatest("x1", zero)) * F.greatest(zero, F.least("y2", "room_h") - F.greatest("y1", zero))


def occupied_area(rooms: DataFrame, entities: DataFrame, counted: Column | None = None) -> DataFrame:
    """Floor area under objects (coverings count, openings and ceiling fixtures don't; or what ``counted`` says), overlaps once, and what is free.

    Coordinate compression inside one row per room: the breaks in x and y make cells, a cell counts if an object covers it.
    """
    counted = (F.col("kind") == "object") & ~F.col("is_ceiling") if counted is None else counted
    boxes = entities.where(counted).join(rooms, "room_id")
    zero = F.lit(0.0)
    clipped = boxes.select("room_id", F.struct(F.greatest("x1", zero).alias("x1"), F.greatest("y1", zero).alias("y1"), F.least("x2", "room_w").alias("x2"), F.least("y2", "room_h").alias("y2")).alias("box"))
    by_room = clipped.where("box.x1 < box.x2 and box.y1 < box.y2").groupBy("room_id").agg(F.collect_list("box").alias("boxes"))
    cells = by_room.withColumns({
        "xs": F.array_sort(F.array_distinct(F.flatten(F.transform("boxes", lambda b: F.array(b["x1"], b["x2"]))))),
        "ys": F.array_sort(F.array_distinct(F.flatten(F.transform("boxes", lambda b: F.array(b["y1"], b["y2"]))))),
    })
    # explode keeps the arrays columns of their own, so none is computed again per element
    strips = cells.select("room_id", "boxes", "ys", F.posexplode("xs").alias("i", "x1"), F.col("xs")).withColumn("x2", F.get("xs", F.col("i") + 1)).where("x2 is not null")
    strips = strips.withColumn("own", F.expr("filter(boxes, b -> b.x1 <= x1 and x2 <= b.x2)")).where("size(own) > 0")
    covered = F.expr("aggregate(sequence(0, size(ys) - 2), 0D, (s, j) -> s + CASE WHEN exists(own, b -> b.y1 <= ys[j] and ys[j + 1] <= b.y2) THEN ys[j + 1] - ys[j] ELSE 0D END)")
    occupied = strips.groupBy("room_id").agg(F.sum((F.col("x2") - F.col("x1")) * covered).alias("occupied"))
    held = entities.select("room_id").distinct()
    area = F.col("room_w") * F.col("room_h")
    out = rooms.join(held, "room_id").join(occupied, "room_id", "left").withColumn("occupied", F.coalesce("occupied", F.lit(0.0)))
    return out.select("room_id", F.round("occupied", 6).alias("occupied"), F.round(area - F.col("occupied"), 6).alias("free"))


def slide_distance(rooms: DataFrame, entities: DataFrame) -> DataFrame:
    """How far each object that can move gets in four directions before another blocking object or the wall, less BACK_OFF.

    Zero where it isn't inside the room or overlaps a blocking object already. Openings neither move nor block.
    """
    movers = entities.where(blocks() & (F.col("kind") == "object"))
    others = movers.select("room_id", F.col("seq").alias("o_seq"), F.col("x1").alias("o_x1"), F.col("y1").alias("o_y1"), F.col("x2").alias("o_x2"), F.col("y2").alias("o_y2"))
    m = movers.join(rooms, "room_id")
    met = m.select("room_id", "seq", "x1", "y1", "x2", "y2").join(others, "room_id").where("seq <> o_seq")
    tight = 2e-7  # a flush neighbour doesn't stop a move along it
    over_x = F.least("x2", "o_x2") - F.greatest("x1", "o_x1")
    over_y = F.least("y2", "o_y2") - F.greatest("y1", "o_y1")

    def gap(across: Column, way: Column) -> Column:
        return F.min(F.when((across > tight) & (way >= -tight), F.greatest(way, F.lit(0.0))))

    gaps = met.groupBy("room_id", "seq").agg(
        gap(over_x, F.col("o_y1") - F.col("y2")).alias("up"), gap(over_x, F.col("y1") - F.col("o_y2")).alias("down"),
        gap(over_y, F.col("x1") - F.col("o_x2")).alias("left"), gap(over_y, F.col("o_x1") - F.col("x2")).alias("right"),
        F.max(F.greatest(F.lit(0.0), over_x) * F.greatest(F.lit(0.0), over_y)).alias("overlap"),
    )
    wall = {"up": F.col("room_h") - F.col("y2"), "down": F.col("y1"), "left": F.col("x1"), "right": F.col("room_w") - F.col("x2")}
    stuck = (F.col("x1") < 0) | (F.col("y1") < 0) | (F.col("x2") > F.col("room_w")) | (F.col("y2") > F.col("room_h")) | (F.coalesce("overlap", F.lit(0.0)) > 1e-8)
    ways = F.explode(F.array(*(F.struct(F.lit(d).alias("direction"), F.least(wall[d], F.coalesce(F.col(d), wall[d])).alias("way")) for d in DIRECTIONS)))
    all_ways = m.join(gaps, ["room_id", "seq"], "left").withColumn("w", ways)
    distance = F.when(stuck, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("w.way") - BACK_OFF))
    return all_ways.select("room_id", "label", "w.direction", F.round(distance, 6).alias("distance"))


def ray_trace(entities: DataFrame) -> DataFrame:
    """Per pair: the labels of other entities that the segment between the centroids touches, by place of entry, then label; a touch at an end alone doesn't count.

    Slab test: the segment is inside a rectangle between the latest entry and the earliest exit over both axes.
    """
    p = pairs(centred(entities).select("room_id", "seq", "label", "cx", "cy"))
    c = entities.select("room_id", F.col("seq").alias("c_seq"), F.col("label").alias("c_label"), "x1", "y1", "x2", "y2")
    dx, dy = _apart()
    met = p.join(c, "room_id").where("c_seq <> a_seq and c_seq <> b_seq")

    def slab(start: Column, d: Column, low: Column, high: Column) -> tuple[Column, Column]:
        flat = F.abs(d) < 1e-9
        never = flat & ((start < low - 1e-9) | (start > high + 1e-9))
        t1, t2 = F.try_divide(low - start, d), F.try_divide(high - start, d)
        enter = F.when(never, 2.0).when(flat, 0.0).otherwise(F.least(t1, t2))
        leave = F.when(never, -1.0).when(flat, 1.0).otherwise(F.greatest(t1, t2))
        return enter, leave

    ex, lx = slab(F.col("a_cx"), dx, F.col("x1"), F.col("x2"))
    ey, ly = slab(F.col("a_cy"), dy, F.col("y1"), F.col("y2"))
    met = met.withColumns({"enter": F.greatest(ex, ey, F.lit(0.0)), "leave": F.least(lx, ly, F.lit(1.0))}).where("enter <= leave + 1e-9 and (leave - enter > 1e-9 or enter between 1e-9 and 1 - 1e-9)")
    hits = F.array_sort(F.collect_list(F.struct(F.round("enter", 9).alias("enter"), F.lower("c_label").alias("c_label"))))
    return met.groupBy("room_id", "a_label", "b_label").agg(F.array_join(F.transform(hits, lambda h: h["c_label"]), ",").alias("hits"))


def catalog(spark) -> DataFrame:
    rows = [(group, *item) for group, items in CATALOG.items() for item in items]
    return spark.createDataFrame(rows, "source_group string, item string, width double, depth double")


def _asked(rooms: DataFrame) -> DataFrame:
    """Rooms with each rectangle of their group's catalog; a group without one takes that of hssd."""
    known = F.when(F.col("source_group").isin(*CATALOG), F.col("source_group")).otherwise("hssd")
    items = catalog(rooms.sparkSession).withColumnRenamed("source_group", "__group")
    return rooms.join(F.broadcast(items), known == F.col("__group")).drop("__group")  # sixteen rows


def placement_certificate(rooms: DataFrame, entities: DataFrame) -> DataFrame:
    """Catalog rectangles that can't fit because all free floor is smaller: an upper bound on any free part."""
    free = occupied_area(rooms, entities, blocks()).select("room_id", "free")
    asked = _asked(rooms).join(free, "room_id")
    return asked.select("room_id", "item", "free", F.round(F.col("width") * F.col("depth"), 6).alias("asked"), (F.col("free") + 1e-7 < F.col("width") * F.col("depth")).alias("certified_false"))


def placement_axis_aligned(rooms: DataFrame, entities: DataFrame) -> DataFrame:
    """Whether each catalog rectangle fits with sides along the axes, clear of blocking entities (openings included).

    If it fits anywhere, it fits pushed left and down against walls or blockers, so only such corners are tried.
    """
    boxes = entities.where(blocks()).groupBy("room_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("boxes"))
    asked = rooms.join(entities.select("room_id").distinct(), "room_id").join(boxes, "room_id", "left")
    asked = _asked(asked)
    asked = asked.withColumn("boxes", F.coalesce("boxes", F.expr("cast(array() as array<struct<x1:double,y1:double,x2:double,y2:double>>)")))
    # one way round is tried after the other, and each place in x only against the boxes that reach it
    places = "filter(array_distinct(concat(array(0D), transform(boxes, b -> b.{k}))), v -> v >= 0 and v + {s} <= {r} + 1e-9)"
    met = "filter(boxes, b -> x < b.x2 - 1e-9 and b.x1 + 1e-9 < x + {w})"
    clear = "exists(transform(array({met}), near -> exists(ys{n}, y -> not exists(near, b -> y < b.y2 - 1e-9 and b.y1 + 1e-9 < y + {d}))), v -> v)"
    ways = (("1", "width", "depth"), ("2", "depth", "width"))
    tried = asked.withColumns({f"{k}s{n}": F.expr(places.format(k=f"{k}2", s=s, r=r)) for n, w, d in ways for k, s, r in (("x", w, "room_w"), ("y", d, "room_h"))})
    fits = F.expr(" or ".join(f"exists(xs{n}, x -> {clear.format(met=met.format(w=w), n=n, d=d)})" for n, w, d in ways))
    return tried.groupBy("room_id", "item").agg(F.max(fits).alias("fits"))


def _preferred(entities: DataFrame, rooms: DataFrame, tokens: dict[str, tuple[str, ...]], least: int) -> DataFrame:
    """Those with a preferred label part of their group, if there are ``least`` of them in the room; else all."""
    e = entities.join(rooms.select("room_id", "source_group"), "room_id")
    liked = F.lit(False)
    for group, parts in tokens.items():
        liked = liked | ((F.col("source_group") == group) & F.lower("label").rlike("|".join(parts)))
    n = F.sum(F.col("liked").cast("int")).over(Window.partitionBy("room_id"))
    e = e.withColumn("liked", liked)
    return e.withColumn("n_liked", n).where((F.col("n_liked") < least) | F.col("liked")).select("room_id", "label", "liked")


def movable_objects(rooms: DataFrame, entities: DataFrame) -> DataFrame:
    return _preferred(entities.where(blocks() & (F.col("kind") == "object")), rooms, MOVABLE, 1)


def path_ends(rooms: DataFrame, entities: DataFrame) -> DataFrame:
    return _preferred(entities.where(blocks()), rooms, PATH_ENDS, 2)
