"""Fixed dimension tables: sites, areas, stations and published flood stages.

Fixed values: identifiers, coordinates and thresholds as published for each station.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hydrospark.schema import THRESHOLDS

HOME_LAT, HOME_LON = 35.5951, -82.5515
HOME_POINT = "asheville"
PRIMARY_SITE = "03451500"
DEFAULT_RADIUS_MI = 150.0

# Fixed values: (site_id, label, lat, lon, role)
GAUGES = [
    ("03439000", "French Broad @ Rosman (headwaters)", 35.1432, -82.8262, "headwaters"),
    ("03443000", "French Broad @ Blantyre", 35.3576, -82.6171, "upstream"),
    ("03446000", "Mills River nr Mills River", 35.3876, -82.5643, "tributary"),
    ("03451000", "Swannanoa River @ Biltmore", 35.5073, -82.5365, "tributary"),
    ("03451500", "French Broad @ Asheville", 35.6090, -82.5790, "primary"),
    ("03456991", "Pigeon River nr Canton", 35.5219, -82.8481, "regional"),
    ("02151500", "Broad River nr Boiling Springs", 35.2113, -81.6984, "regional"),
    ("03512000", "Oconaluftee @ Birdtown (Smokies)", 35.4623, -83.3457, "regional"),
    ("0351706800", "Cheoah River nr Tapoco", 35.4383, -83.9189, "regional"),
    ("0214267602", "Catawba River blw Mountain Island Dam", 35.3340, -80.9864, "statewide"),
    ("0214264790", "Catawba River @ Cowans Ford (Lake Norman dam)", 35.4277, -80.9573, "statewide"),
    ("02116500", "Yadkin River @ Yadkin College", 35.8567, -80.3869, "statewide"),
    ("02129000", "Pee Dee River nr Rockingham", 35.0079, -79.8703, "statewide"),
    ("02102500", "Cape Fear River @ Lillington", 35.4061, -78.8133, "statewide"),
    ("02105769", "Cape Fear River @ Lock 1 nr Kelly", 34.4040, -78.2980, "statewide"),
    ("02083500", "Tar River @ Tarboro", 35.8932, -77.5366, "statewide"),
    ("02089500", "Neuse River @ Kinston", 35.2578, -77.5856, "statewide"),
    ("02134500", "Lumber River @ Boardman", 34.4425, -78.9603, "statewide"),
    ("02087182", "Falls Lake above dam", 35.9411, -78.5833, "reservoir"),
    ("02098197", "Jordan Lake at dam nr Moncure", 35.6547, -79.0683, "reservoir"),
]

# Fixed values: (forest, site_id, label, lat, lon, role)
FOREST_GAUGES = [
    ("Pisgah", "03451500", "French Broad @ Asheville", 35.6090, -82.5790, "primary"),
    ("Pisgah", "03451000", "Swannanoa River @ Biltmore", 35.5073, -82.5365, "tributary"),
    ("Pisgah", "03456991", "Pigeon River nr Canton", 35.5219, -82.8481, "regional"),
    ("Pisgah", "02151500", "Broad River nr Boiling Springs", 35.2113, -81.6984, "regional"),
    ("Nantahala", "03512000", "Oconaluftee @ Birdtown", 35.4614, -83.3536, "primary"),
    ("Nantahala", "03513000", "Tuckasegee @ Bryson City", 35.4275, -83.4469, "tributary"),
    ("Nantahala", "03500000", "Little Tennessee nr Prentiss", 35.1500, -83.3797, "headwaters"),
    ("Nantahala", "03550000", "Valley River at Tomotla", 35.1389, -83.9806, "regional"),
    ("Uwharrie", "02123500", "Uwharrie River nr Eldorado", 35.4315, -80.0166, "primary"),
    ("Uwharrie", "02126000", "Rocky River nr Norwood", 35.1570, -80.1658, "tributary"),
    ("Uwharrie", "02116500", "Yadkin River at Yadkin College", 35.8567, -80.3869, "regional"),
    ("Croatan", "02092500", "Trent River nr Trenton", 35.0642, -77.4614, "tributary"),
    ("Croatan", "02091814", "Neuse River nr Fort Barnwell", 35.3139, -77.3028, "primary"),
    ("Croatan", "02093000", "New River nr Gum Branch", 34.8492, -77.5194, "regional"),
]

# Fixed values: (short, acres, lat, lon, region)
FORESTS = [
    ("Pisgah", 512758, 35.78, -82.30, "mountain"),
    ("Nantahala", 531286, 35.20, -83.60, "mountain"),
    ("Uwharrie", 50645, 35.40, -79.95, "piedmont"),
    ("Croatan", 160481, 34.85, -77.00, "coastal"),
]

# Fixed values: (forest, district, office, lat, lon)
DISTRICTS = [
    ("Pisgah", "Appalachian", "Burnsville", 35.9170, -82.3000),
    ("Pisgah", "Grandfather", "Nebo", 35.7380, -81.9430),
    ("Pisgah", "Pisgah", "Pisgah Forest", 35.2900, -82.7120),
    ("Nantahala", "Cheoah", "Robbinsville", 35.3230, -83.8060),
    ("Nantahala", "Nantahala", "Franklin", 35.1820, -83.3820),
    ("Nantahala", "Tusquitee", "Murphy", 35.0900, -84.0300),
    ("Uwharrie", "Uwharrie", "Troy", 35.3580, -79.8910),
    ("Croatan", "Croatan", "New Bern", 34.9400, -77.0400),
]

# Fixed values: (station_id, label, lat, lon, role)
BUOYS = [
    ("41025", "Diamond Shoals (off Hatteras)", 35.006, -75.402, "offshore"),
    ("41013", "Frying Pan Shoals (off Cape Fear)", 33.441, -77.764, "offshore"),
    ("41036", "Onslow Bay Outer", 34.207, -76.949, "offshore"),
    ("41037", "Wrightsville Beach Nearshore", 34.144, -77.715, "nearshore"),
    ("CLKN7", "Cape Lookout C-MAN", 34.622, -76.525, "cman"),
    ("DUKN7", "Duck Pier C-MAN (FRF)", 36.183, -75.747, "cman"),
    ("HCGN7", "Hatteras C-MAN", 35.209, -75.703, "cman"),
    ("41002", "South Hatteras (S Atlantic Bight)", 31.760, -74.840, "offshore"),
    ("41004", "Edisto SC (S of NC)", 32.501, -79.099, "offshore"),
]
COASTAL_STATIONS = [
    ("8651370", "Duck, NC (Outer Banks N)", 36.1833, -75.7467, "outer-banks"),
    ("8654467", "Hatteras, NC", 35.2086, -75.7036, "outer-banks"),
    ("8656483", "Beaufort, NC (Duke Marine Lab)", 34.7200, -76.6700, "central-coast"),
    ("8658120", "Wilmington, NC", 34.2275, -77.9536, "cape-fear"),
    ("8658163", "Wrightsville Beach, NC", 34.2133, -77.7867, "cape-fear"),
]

# Fixed values: (site_id, action, minor, moderate, major, record, lid), feet on each site's datum
FLOOD_STAGES = [
    ("02083500", 17.0, 19.0, 24.0, 32.0, 41.51, "TARN7"),
    ("02087182", 264.0, 265.0, 266.0, 267.0, None, "NUDN7"),
    ("02089500", 13.0, 14.0, 18.0, 21.0, 28.31, "KINN7"),
    ("02091814", 12.5, 13.0, 16.0, 18.0, 22.75, "FTBN7"),
    ("02092500", 13.5, 14.0, 17.0, 20.0, 24.24, "TNTN7"),
    ("02093000", 13.0, 14.0, 16.0, 22.0, 25.76, "GUMN7"),
    ("02098197", 240.0, 240.0, 241.0, 242.0, None, "NHPN7"),
    ("02102500", 13.0, 14.0, 19.0, 27.0, 33.19, "LLLN7"),
    ("02105769", 22.0, 24.0, 26.0, 28.0, 30.68, "CPFN7"),
    ("02116500", 17.0, 18.0, 25.0, 29.0, 36.3, "YADN7"),
    ("02126000", 16.0, 20.0, 30.0, 34.0, 46.37, "NRWN7"),
    ("02129000", None, 15.0, None, None, 31.28, "RCKN7"),
    ("02151500", 10.0, 12.0, 14.0, 20.0, 24.3, "BSPN7"),
    ("03439000", 7.0, 9.0, 13.0, 14.0, 14.95, "ROSN7"),
    ("03443000", 15.0, 16.0, 19.0, 23.0, 28.43, "BLAN7"),
    ("03446000", 7.5, 9.0, 14.0, 18.0, 13.62, "MRSN7"),
    ("03451000", 9.0, 10.0, 14.5, 16.5, 27.33, "BLTN7"),
    ("03451500", 6.5, 9.5, 13.0, 18.0, 24.82, "AVLN7"),
    ("03456991", 8.0, 10.0, 15.0, 19.0, 26.96, "CTPN7"),
    ("03500000", 8.0, 15.0, 17.0, 25.0, 17.3, "PRTN7"),
    ("03512000", 8.0, 10.0, 12.0, 13.0, 18.0, "BIRN7"),
    ("03513000", 8.0, 10.0, 13.5, 15.5, 15.96, "TKSN7"),
    ("0351706800", 8.0, 18.0, 22.0, 34.0, 13.3, "TAPN7"),
    ("03550000", 6.0, 12.0, 13.0, 14.0, 21.2, "TMVN7"),
]
# Stages used for the primary site where nothing is published.
DEFAULT_STAGES = {"action": 7.0, "minor": 9.5, "moderate": 12.0, "major": 16.0, "record": 23.10}
INDEX_STAGES = {"action": 6.5, "minor": 9.5, "major": 18.0}

UPSTREAM_ROLES = ["headwaters", "upstream", "tributary"]
# Role groups of the gauge network.
NETWORKS = {
    "french_broad": ["primary", "upstream", "headwaters", "tributary"],
    "regional": ["regional"],
    "statewide": ["statewide"],
    "reservoirs": ["reservoir"],
}

# Drainage basin ring as (lat, lon), closed.
BASIN_RING = [
    (35.65, -82.55), (35.55, -82.20), (35.40, -82.10), (35.20, -82.20), (35.05, -82.55),
    (35.10, -82.95), (35.40, -83.10), (35.60, -82.85), (35.65, -82.55),
]

# Season outlook and climatology.
SEASON_OUTLOOK = {"ace": 90.0, "named_storms": 13.0, "hurricanes": 6.0, "major_hurricanes": 2.0}
SEASON_CLIMO = {"ace": 123.0, "named_storms": 14.4, "hurricanes": 7.2, "major_hurricanes": 3.2}


def gauges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        GAUGES, "site_id string, label string, lat double, lon double, role string")


def forest_gauges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        FOREST_GAUGES,
        "forest string, site_id string, label string, lat double, lon double, role string")


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, "ft") for row in FLOOD_STAGES], THRESHOLDS)


def areas(spark: SparkSession) -> DataFrame:
    """Forests and their districts as one table of places."""
    region = {short: r for short, _, _, _, r in FORESTS}
    rows = [("forest", short, lat, lon, r) for short, _, lat, lon, r in FORESTS]
    rows += [("district", f"{f}/{d}", lat, lon, region[f]) for f, d, _, lat, lon in DISTRICTS]
    return spark.createDataFrame(
        rows, "area_type string, area_id string, lat double, lon double, region string")


def stations(spark: SparkSession) -> DataFrame:
    rows = [("buoy", *r) for r in BUOYS] + [("coastal", *r) for r in COASTAL_STATIONS]
    return spark.createDataFrame(
        rows,
        "station_type string, station_id string, label string, lat double, lon double, role string")


def weather_points(spark: SparkSession) -> DataFrame:
    """Every place weather is collected for."""
    rows = [("point", HOME_POINT, HOME_LAT, HOME_LON)]
    rows += [("forest", short, lat, lon) for short, _, lat, lon, _ in FORESTS]
    rows += [("district", f"{f}/{d}", lat, lon) for f, d, _, lat, lon in DISTRICTS]
    return spark.createDataFrame(
        rows, "entity_type string, entity_id string, lat double, lon double")


def upstream_edges(spark: SparkSession) -> DataFrame:
    """Gauge topology as (target_id, upstream_id)."""
    rows = [(PRIMARY_SITE, g[0]) for g in GAUGES if g[4] in UPSTREAM_ROLES and g[0] != PRIMARY_SITE]
    return spark.createDataFrame(rows, "target_id string, upstream_id string")
