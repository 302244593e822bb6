"""Classifiers as rule tables over tag columns. A rule is a category, its evidence and a condition; all rules of a table are one projection and one explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_spaces, words

#: Categories by group, in display order. Fixed values.
GROUPS = {
    "Transport": ("bus_stop", "national_rail_station", "underground_station", "overground_station", "dlr_station", "tram_stop", "cycle_parking"),
    "Education and childcare": ("nursery", "primary_school", "secondary_school", "sixth_form", "fe_college", "university"),
    "Everyday needs": ("supermarket", "convenience_store", "post_office", "bank", "cashpoint", "petrol_station"),
    "Healthcare": ("gp_surgery", "pharmacy", "dentist", "hospital", "urgent_care", "optician"),
    "Leisure and community": ("park_open_space", "playground", "gym_leisure", "sports_facility", "library", "community_centre", "place_of_worship", "pub_bar", "cafe", "restaurant"),
}
#: Categories that a wider search may fill. Fixed values.
WIDE = ("national_rail_station", "underground_station", "overground_station", "dlr_station", "tram_stop", "sixth_form", "fe_college", "university", "hospital", "urgent_care", "secondary_school")

#: Name evidence. Fixed values.
PRIMARY = ("primary", "infant", "junior", "first school")
SECONDARY = ("secondary", "high school", "comprehensive", "upper school")
ADULT = ("adult learning", "adult education", "learning and skills", "training centre", "training center")
GP = ("gp", "surgery", "medical centre", "medical center", "health centre", "health center", "general practice")
NOT_GP = ("gym", "fitness", "wellbeing", "sports", "leisure")
URGENT = ("urgent treatment", "urgent care", "walk-in", "walk in", "minor injuries")
GYM = ("gym", "fitness", "health club", "leisure centre", "leisure center", "sports centre", "sports center")


class Tags:
    """Reads tags from a map column: value by name as text, '' where missing."""

    def __init__(self, column: str = "tags"):
        self.column = column

    def __call__(self, name: str) -> Column:
        return F.coalesce(F.try_element_at(F.col(self.column), F.lit(name)), F.lit(""))

    def low(self, name: str) -> Column:
        return F.lower(self(name))

    def eq(self, name: str, *values: str) -> Column:
        return self.low(name).isin(*values)

    def joined(self, *names: str) -> Column:
        return F.lower(F.concat_ws(" ", *[self(n) for n in names]))


def facility_rules(t: Tags, variant: str = "module") -> list[tuple[str, Column, Column]]:
    """(category, evidence, condition) in order. Variants: module (the default), engine (a primary school is never secondary too, academies are secondary, a sports centre with a fitness name is a gym
    only, no urgent care, no sixth form in schools) and catalogue (academies are secondary unless primary, parks include reserves)."""
    name = t.joined("name", "operator", "brand") if variant == "engine" else t.joined("name", "operator", "network", "brand")
    has = lambda *alternatives: name.rlike(words(*alternatives))
    is_ = t.eq
    lit = F.lit
    station = is_("railway", "station", "halt")
    mode = t.joined("station", "network", "operator")
    under = is_("station", "subway") | mode.contains("underground")
    over = ~under & mode.contains("overground")
    dlr = ~under & ~over & (mode.contains("dlr") | mode.contains("docklands"))
    levels = F.split(t("isced:level"), ";")
    school = is_("amenity", "school")
    primary = school & (F.array_contains(levels, "1") | has(*PRIMARY))
    secondary = school & (F.arrays_overlap(levels, F.array(lit("2"), lit("3"))) | has(*SECONDARY))
    if variant == "engine":
        secondary = (secondary | school & has("academy")) & ~primary
    if variant == "catalogue":
        secondary = secondary | school & has("academy") & ~primary
    college = is_("amenity", "college") & ~has(*ADULT)
    sixth = has("sixth form")
    clinic = is_("amenity", "clinic")
    sports = is_("leisure", "sports_centre")
    gym_name = (F.trim(t("name")) != "") & has(*GYM)
    amenity, leisure = t("amenity"), t("leisure")
    parks = ("park", "recreation_ground", "nature_reserve") if variant == "catalogue" else ("park", "recreation_ground")
    rules = [
        ("bus_stop", lit("bus-stop-specific OSM tags"), is_("highway", "bus_stop") | is_("public_transport", "platform", "stop_position") & is_("bus", "yes")),
        ("cycle_parking", lit("amenity=bicycle_parking"), is_("amenity", "bicycle_parking")),
        ("underground_station", lit("rail station with Underground/subway evidence"), station & under),
        ("overground_station", lit("rail station with Overground evidence"), station & over),
        ("dlr_station", lit("rail station with DLR evidence"), station & dlr),
        ("national_rail_station", lit("railway=station/halt"), station & ~under & ~over & ~dlr),
        ("tram_stop", lit("railway=tram_stop"), is_("railway", "tram_stop")),
        ("nursery", F.concat(lit("amenity="), amenity), is_("amenity", "kindergarten", "childcare")),
        ("primary_school", lit("school with primary evidence"), primary),
        ("secondary_school", lit("school with secondary evidence"), secondary),
        ("sixth_form", lit("school with sixth-form name evidence"), school & sixth if variant != "engine" else lit(False)),
        ("sixth_form", lit("amenity=college and sixth-form name"), college & sixth),
        ("fe_college", lit("amenity=college; adult-learning exclusions passed"), college & ~sixth),
        ("university", lit("amenity=university"), is_("amenity", "university")),
        ("supermarket", lit("shop=supermarket"), is_("shop", "supermarket")),
        ("convenience_store", lit("shop=convenience"), is_("shop", "convenience")),
        ("post_office", lit("post-office-specific tag"), is_("amenity", "post_office") | is_("shop", "post_office")),
        ("bank", lit("amenity=bank"), is_("amenity", "bank")),
        ("cashpoint", lit("amenity=atm"), is_("amenity", "atm")),
        ("petrol_station", lit("amenity=fuel"), is_("amenity", "fuel")),
        ("gp_surgery", lit("GP/doctor-specific tag"), is_("amenity", "doctors") | is_("healthcare", "general_practitioner", "doctor")),
        ("gp_surgery", lit("clinic tag plus controlled GP-name evidence"), clinic & has(*GP) & ~has(*NOT_GP)),
        ("pharmacy", lit("pharmacy-specific tag"), is_("amenity", "pharmacy") | is_("healthcare", "pharmacy")),
        ("dentist", lit("dentist-specific tag"), is_("amenity", "dentist") | is_("healthcare", "dentist")),
        ("hospital", lit("hospital-specific tag"), is_("amenity", "hospital") | is_("healthcare", "hospital")),
        ("urgent_care", lit("clinic tag with urgent-care evidence"), (clinic | is_("healthcare", "clinic")) & has(*URGENT) if variant != "engine" else lit(False)),
        ("optician", lit("optician-specific tag"), is_("healthcare", "optometrist") | is_("shop", "optician")),
        ("park_open_space", F.concat(lit("leisure="), leisure), is_("leisure", *parks)),
        ("playground", lit("leisure=playground"), is_("leisure", "playground")),
        ("gym_leisure", lit("leisure=fitness_centre"), is_("leisure", "fitness_centre")),
        ("gym_leisure", lit("named leisure=sports_centre with gym/leisure-centre evidence"), sports & (gym_name if variant != "engine" else lit(True))),
        ("sports_facility", lit("leisure=sports_centre"), sports if variant != "engine" else lit(False)),
        ("sports_facility", F.concat(lit("leisure="), leisure), is_("leisure", "sports_hall", "pitch", "track", "stadium")),
        ("library", lit("amenity=library"), is_("amenity", "library")),
        ("community_centre", lit("amenity=community_centre"), is_("amenity", "community_centre")),
        ("place_of_worship", lit("amenity=place_of_worship"), is_("amenity", "place_of_worship")),
        ("pub_bar", F.concat(lit("amenity="), amenity), is_("amenity", "pub", "bar")),
        ("cafe", lit("amenity=cafe"), is_("amenity", "cafe")),
        ("restaurant", lit("amenity=restaurant"), is_("amenity", "restaurant")),
    ]
    return rules


def classify_facilities(elements: DataFrame, variant: str = "module", tags: str = "tags") -> DataFrame:
    """elements with category, evidence and rule (its order), a row for each rule that holds."""
    rules = facility_rules(Tags(tags), variant)
    made = F.array(*[F.when(condition, F.struct(F.lit(i).alias("rule"), F.lit(key).alias("category"), evidence.alias("evidence"))) for i, (key, evidence, condition) in enumerate(rules)])
    return elements.select("*", F.explode(F.filter(made, lambda r: r.isNotNull())).alias("_r")).select(*[F.col(f"`{c}`") for c in elements.columns], "_r.rule", "_r.category", "_r.evidence")


def has_rail_evidence(t: Tags) -> Column:
    """Rail tags, a rail mode switched on, or a rail word in the context."""
    context = F.concat_ws(" ", *[F.nullif(t(n), F.lit("")) for n in ("network", "operator", "line", "route", "description", "name")])
    modes = [normal_spaces(t(n)) == "yes" for n in ("train", "subway", "tram", "light_rail", "monorail")]
    any_mode = modes[0] | modes[1] | modes[2] | modes[3] | modes[4]
    return normal_spaces(t("railway")).isin("station", "halt", "tram_stop") | normal_spaces(t("station")).isin("train", "subway", "light_rail", "monorail") | any_mode | normal_spaces(context).rlike(words("rail", "railway", "underground", "overground", "tram", "dlr", "metro"))


def station_mode(t: Tags) -> Column:
    s = normal_spaces(F.concat_ws(" ", *[F.nullif(t(n), F.lit("")) for n in ("network", "operator", "line", "station", "name")]))
    return (
        F.when((t("railway") == "tram_stop") | s.contains("tram"), "Tram/light rail")
        .when(s.contains("docklands light railway") | s.contains(" dlr") | s.startswith("dlr"), "DLR")
        .when(s.contains("overground"), "London Overground")
        .when((t("station") == "subway") | s.contains("underground"), "London Underground")
        .when(t("station") == "light_rail", "Tram/light rail")
        .otherwise("National Rail")
    )


def line_mode(t: Tags) -> Column:
    """The mode of a rail line by explicit evidence alone; empty without."""
    s = F.lower(F.concat_ws(" ", *[F.nullif(t(n), F.lit("")) for n in ("network", "operator", "line", "name")]))
    return (
        F.when(s.contains("docklands light railway") | s.rlike(words("dlr")), "DLR")
        .when(s.contains("overground"), "London Overground")
        .when((t("railway") == "subway") | s.contains("underground"), "London Underground")
        .when(t("railway").isin("tram", "light_rail") | s.contains("tram"), "Tram/light rail")
        .when(s.contains("national rail") | s.contains("network rail"), "National Rail")
        .otherwise("")
    )


#: States in which a cycle route isn't in use. Fixed values.
LAPSED = "^(proposed|planned|future|construction|disused|deprecated|abandoned|removed|razed|yes)$"


def is_current_cycle_route(t: Tags) -> Column:
    states = F.array(*[t.low(n) for n in ("state", "status", "lifecycle", "proposed")])
    building = F.trim(t.low("construction"))
    gone = (t("disused:route") != "") | (t("proposed:route") != "") | (t("abandoned:route") != "")
    return ~F.exists(states, lambda s: s.rlike(LAPSED)) & building.isin("", "no") & ~gone


#: Amenities that a drawing shows as community buildings. Fixed values.
COMMUNITY_AMENITY = ("school", "college", "university", "hospital", "clinic", "library", "community_centre", "place_of_worship", "police")


def drawing_class(t: Tags, geometry: str = "geometry_type") -> Column:
    """The drawing class of an element, by its tags and the type of its geometry (LineString, MultiLineString, Polygon, Point or null); null if it isn't drawn."""
    from ..functions.text import cycle_network

    g = F.col(geometry)
    line = F.coalesce(g.isin("LineString", "MultiLineString"), F.lit(False))
    area = F.coalesce(g.isin("Polygon", "MultiPolygon"), F.lit(False))
    network, current = cycle_network(t("network")), is_current_cycle_route(t)
    mode = station_mode(t)
    highway, rail = t("highway"), t("railway")
    cycle = F.when(~line | ~current, "cycle-review").when(network == "lcn", "cycle-network-local").when(network != "", "cycle-network-primary").otherwise("cycle-review")
    station_class = F.when(mode == "London Underground", "station-underground").when(mode == "London Overground", "station-overground").when(mode == "DLR", "station-dlr").when(mode == "Tram/light rail", "station-tram").otherwise("station-national-rail")
    is_station = has_rail_evidence(t) & (rail.isin("station", "halt", "tram_stop") | (t("public_transport") == "station"))
    return (
        F.when(t("route") == "bus", F.when(line, "bus-route").when(g.isNotNull(), "bus-route-review"))
        .when(t("route") == "bicycle", F.when(g.isNotNull(), cycle))
        .when(t("amenity").isin(*COMMUNITY_AMENITY) | t("shop").isin("supermarket", "convenience"), F.when(g.isNotNull(), "community-candidate"))
        .when(t("building") != "", F.when(area, "building-support"))
        .when(g.isNull(), None)
        .when(highway.rlike("^motorway"), "motorway")
        .when(highway.rlike("^(trunk|primary)"), "main-road")
        .when(highway.rlike("^(secondary|tertiary)"), "context-road-major")
        .when(highway.isin("unclassified", "residential", "living_street"), "context-road-minor")
        .when(highway == "cycleway", F.when(current, "cycle-route").otherwise("cycle-review"))
        .when(rail.isin("rail", "subway", "light_rail", "tram"), F.when(t("service").isin("siding", "yard", "crossover"), "railway-support").otherwise("railway"))
        .when(is_station, station_class)
        .when(t("waterway").isin("river", "canal"), F.when((t("boat") == "yes") | (t("motorboat") == "yes"), "waterway").otherwise("waterway-review"))
        .when(((t("landuse") != "") | t("natural").isin("wood", "water")) & area, "context-area")
        .when(t("place") != "", "context-place")
    )
