"""Entity resolution: address keys, name similarity, permit matching, ingest dedup, closure and exposure checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import normal_name
from tidemark.operators import dictionary


def bigrams(name: Column) -> Column:
    """Set of two-character pieces of a name; a name of one character is its own piece."""
    return F.transform(
        F.array(name), lambda n: F.array_distinct(F.when(F.char_length(n) >= 2, F.transform(F.sequence(F.lit(1), F.char_length(n) - 1), lambda i: F.substring(n, i, F.lit(2)))).otherwise(F.array(n)))
    )[0]


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal normalised names, 0.9 if one holds the other (three characters or more), else the Jaccard share of bigrams."""
    x, y = normal_name(a), normal_name(b)
    return _similarity(x, y, bigrams(x), bigrams(y))


def _similarity(x: Column, y: Column, pieces_x: Column, pieces_y: Column) -> Column:
    """``name_similarity`` of normalised names with their pieces."""
    shared = F.size(F.array_intersect(pieces_x, pieces_y))
    holds = (F.char_length(x) >= 3) & (F.char_length(y) >= 3) & (x.contains(y) | y.contains(x))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(holds, 0.9).otherwise(shared / (F.size(pieces_x) + F.size(pieces_y) - shared))


def road_key(address: Column) -> Column:
    """Province, district, road and number of an address: the last road with a number before the first comma."""
    head = F.trim(F.split(F.coalesce(address, F.lit("")), ",")[0])
    roads = F.regexp_extract_all(head, F.lit(r"([\p{L}0-9]+(?:로|길|Rd|St))\s+(\d+(?:-\d+)?)"), F.lit(0))
    parts = F.split(head, r"\s+")
    return F.when(F.size(roads) > 0, F.concat_ws("|", parts[0], parts[1], F.regexp_replace(F.element_at(roads, -1), r"\s+", "|")))


def match_permits(places: DataFrame, permits: DataFrame, one: float = 0.45, many: float = 0.62, grace_days: int = 60) -> DataFrame:
    """(id, permit, way, similarity, closed, live_after): the permit of each place.

    Places have (id, name, road, lot, last_review); permits (permit, pname, road, lot, open, closed_on). Candidates share the
    road key, or the lot key where a place has none on its road. A sole candidate needs ``one``, several need ``many``; among
    those good enough an open permit wins. A closure with a review more than ``grace_days`` later is rejected.
    """
    by = lambda way: places.where(F.col(way).isNotNull()).join(permits.where(F.col(way).isNotNull()).drop(*({"road", "lot"} - {way})), way).withColumn("way", F.lit(way))
    road = by("road").select("id", "name", "last_review", "permit", "pname", "open", "closed_on", "way")
    lot = by("lot").join(road.select("id").distinct(), "id", "left_anti").select(*road.columns)
    both = road.unionByName(lot).withColumn("similarity", F.round(name_similarity(F.col("name"), F.col("pname")), 6))
    w = Window.partitionBy("id")
    both = both.withColumn("need", F.when(F.count("*").over(w) == 1, one).otherwise(many)).where(F.col("similarity") >= F.col("need"))
    order = [F.desc(F.col("open").cast("int")), F.desc("similarity"), F.col("permit")]
    best = both.withColumn("rn", F.row_number().over(w.orderBy(*order))).where("rn = 1")
    alive = ~F.col("open") & F.coalesce(F.datediff("last_review", "closed_on") > grace_days, F.lit(False))
    return best.select("id", "permit", "way", "similarity", (~F.col("open") & ~alive).alias("closed"), alive.alias("live_after"))


def ingest_matches(old: DataFrame, new: DataFrame, cell: float = 0.0005, least: float = 0.5) -> DataFrame:
    """(id, match, how): the known row of each new row: by name, else within ``cell`` degrees with a similar name, else by address."""
    o = old.select(F.col("id").alias("o"), F.coalesce("name", F.lit("")).alias("oname"), F.col("lat").alias("olat"), F.col("lng").alias("olng"), F.trim(F.regexp_replace("address", r"\s+", " ")).alias("oaddr"))
    n = new.withColumn("name", F.coalesce("name", F.lit("")))
    # all sides grow with the tables: sorted joins at every size, so nothing of them goes to the driver
    by_name = new.join(old.groupBy(F.col("name").alias("oname")).agg(F.min("id").alias("o")).hint("merge"), F.col("name") == F.col("oname")).select("id", F.col("o").alias("match"), F.lit("name").alias("how"), F.lit(0).alias("no"))
    # rows of one name at one place are compared once, whatever their number; the smallest id stands for them
    grid = lambda c, at: F.floor(F.col(at) / cell).alias(c)
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    named = lambda df, name, short: df.withColumn(short, normal_name(F.col(name))).withColumn(f"{short}s", bigrams(F.col(short)))
    asked = named(n.select("name", "lat", "lng").distinct(), "name", "x_")
    asked = asked.select("*", grid("y", "lat"), grid("x", "lng"))
    known = named(o.groupBy("oname", "olat", "olng").agg(F.min("o").alias("o")), "oname", "y_").select("*", grid("y", "olat"), grid("x", "olng"))
    known = known.withColumn("dy", around).withColumn("dx", around).withColumn("y", F.col("y") + F.col("dy")).withColumn("x", F.col("x") + F.col("dx"))
    close = (F.abs(F.col("lat") - F.col("olat")) < cell) & (F.abs(F.col("lng") - F.col("olng")) < cell)
    alike = _similarity(F.col("x_"), F.col("y_"), F.col("x_s"), F.col("y_s")) >= least
    found = asked.join(known.hint("merge"), ["y", "x"]).where(close & alike).groupBy("name", "lat", "lng").agg(F.min("o").alias("match"))
    by_place = n.select("id", "name", "lat", "lng").join(found.hint("merge"), ["name", "lat", "lng"]).select("id", "match", F.lit("place").alias("how"), F.lit(1).alias("no"))
    addr = F.trim(F.regexp_replace("address", r"\s+", " "))
    by_addr = new.withColumn("a", addr).where(F.col("a") != "").join(o.groupBy("oaddr").agg(F.min("o").alias("o")).hint("merge"), F.col("a") == F.col("oaddr")).select("id", F.col("o").alias("match"), F.lit("address").alias("how"), F.lit(2).alias("no"))
    best = by_name.unionByName(by_place).unionByName(by_addr).groupBy("id").agg(F.min(F.struct("no", "match", "how")).alias("b"))
    return best.select("id", "b.match", "b.how")


def rivals_in_text(texts: DataFrame, names: DataFrame, least: int = 4, most_places: int = 8) -> DataFrame:
    """(id, rival): other places whose core name occurs in a text; names of chains with over ``most_places`` places do not count.

    ``texts`` has (id, place, text), ids unique. All names are found in one pass over each text by an automaton; of the places
    of a chain the one with the smallest id stands for it.
    """
    core = names.select(F.col("id").alias("rival"), normal_name(F.col("name")).alias("term")).where(F.char_length("term") >= least)
    chains = core.groupBy("term").agg(F.count("*").alias("n"), F.min("rival").alias("rival")).where(F.col("n") <= most_places)
    plain = texts.select("id", "place", normal_name(F.col("text")).alias("t"))
    hits = dictionary.term_hits(plain, "id", "t", chains)
    return hits.join(chains.select("term", "rival"), "term").join(plain.select("id", "place"), "id").where(F.col("rival") != F.col("place")).select("id", "rival").distinct()
