"""Nested dashboard snapshots to long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark import dims
from hydrospark.functions.base import number
from hydrospark.schema import (
    BUOY_FIELDS, COASTAL_FIELDS, GAUGE_FIELDS, HAZARD_BLOCKS, HAZARD_FIELDS, HISTORY_COLS,
    SNAPSHOT, SOIL_FIELDS, WEATHER_FIELDS,
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files, one JSON document per line or per file."""
    return spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)


def parse(df: DataFrame, column: str = "value") -> DataFrame:
    """Snapshot documents held as text."""
    return df.withColumn("_doc", F.from_json(column, SNAPSHOT)).select(
        *[c for c in df.columns if c != column], "_doc.*")


#: What is kept of a block of each kind; of the index parts, all.
KEPT = {"gauge": GAUGE_FIELDS, "coastal": COASTAL_FIELDS, "buoy": BUOY_FIELDS, "weather": WEATHER_FIELDS, "soil": SOIL_FIELDS,
        "hazard": HAZARD_FIELDS}
_MAP = "map<string,string>"
#: The blocks of a place, with their kind and the prefix of their metrics.
_BLOCKS = {"weather": ("weather", "wx_"), "soil": ("soil", "soil_"), **{b: ("hazard", f"{p}_") for b, p in HAZARD_BLOCKS.items()}}
_PLACE = f"struct<name:string,{','.join(f'{b}:{_MAP}' for b in _BLOCKS)}>"
#: Lists of stations, with their kind and the key of a station.
_STATIONS = {"gauges": ("gauge", "site_id"), "coastal": ("coastal", "station_id"), "buoys": ("buoy", "station_id")}


def _choose(number: Column, values) -> Column:
    """The value at a position, null beyond the last."""
    out = F.when(number == 0, values[0])
    for at, value in enumerate(values[1:], 1):
        out = out.when(number == at, value)
    return out


def _blocks(df: DataFrame, home: str) -> DataFrame:
    """A row (ts, entity_type, entity_id, kind, prefix, block) for every block of every document.

    Lists become rows level by level: parts of a document, its forests, the places of a forest, their blocks. Each level is
    an explode without a lambda, since a plan with lambdas is interpreted and not compiled.
    """
    index, part, at, k = (F.col(c) for c in ("index", "part", "at", "k"))
    forests, lists = df.schema["forests"].dataType.simpleString(), list(_STATIONS)

    def of(number: int, blocks: Column | None, forest: Column | None = None) -> Column:
        return F.struct(F.lit(number).alias("part"), (F.lit(None).cast(f"array<{_MAP}>") if blocks is None else blocks).alias("blocks"),
                        (F.lit(None).cast(forests) if forest is None else forest).alias("forests"))

    parts = F.array(
        of(0, F.array(F.create_map(F.lit("score"), index["score"]), index["components"], F.col("weather"), F.col("soil"))),
        *[of(n, F.col(name)) for n, name in enumerate(lists, 1)], of(len(lists) + 1, None, F.col("forests")))
    epoch = F.when(F.col("as_of_epoch") > 0, F.col("as_of_epoch"))
    arrived = F.col("arrived") if "arrived" in df.columns else F.current_timestamp()
    rows = (df.select(F.coalesce(F.timestamp_seconds(epoch), arrived).alias("ts"), F.explode(parts).alias("p")).select("ts", "p.*")
            .select("ts", "part", "blocks", F.explode_outer("forests").alias("forest")))
    # A forest's places: itself at 0, without a name, then its districts.
    wooded, forest, place = part == len(lists) + 1, F.col("forest"), F.col("place")
    itself = F.struct(F.lit(None).cast("string").alias("name"), *[forest[b].alias(b) for b in _BLOCKS])
    districts = F.coalesce(forest["districts_data"], F.array().cast(f"array<{_PLACE}>"))
    rows = rows.select("ts", "part", "blocks", forest["short"].alias("short"),
                       F.posexplode_outer(F.when(wooded, F.concat(F.array(itself), districts))).alias("at", "place"))
    blocks = F.when(wooded, F.array(*[place[b] for b in _BLOCKS])).otherwise(F.col("blocks"))
    rows = rows.select("ts", "part", "at", "short", place["name"].alias("name"), F.posexplode(blocks).alias("k", "block"))
    block, district = F.col("block"), F.length("name") > 0
    stations = list(_STATIONS.values())
    point = [("index", "flood_index_"), ("index", "flood_index_"), _BLOCKS["weather"], _BLOCKS["soil"]]

    def either(i: int) -> Column:
        """Kind (0) or prefix (1) of a block."""
        return (F.when(wooded, _choose(k, [F.lit(b[i]) for b in _BLOCKS.values()])).when(part == 0, _choose(k, [F.lit(b[i]) for b in point]))
                .otherwise(F.lit("") if i else _choose(part - 1, [F.lit(kind) for kind, _ in stations])))

    entity = (F.when(wooded & (at > 0), F.when(district, F.concat_ws("/", "short", "name"))).when(wooded, F.col("short"))
              .when(part == 0, F.lit(home)).otherwise(_choose(part - 1, [block[key] for _, key in stations])))
    kinds = (F.when(wooded & (at > 0), F.lit("district")).when(wooded, F.lit("forest")).when(part == 0, F.lit("point"))
             .otherwise(_choose(part - 1, [F.lit(kind) for kind, _ in stations])))
    return (rows.filter(block.isNotNull())
            .select("ts", kinds.alias("entity_type"), entity.alias("entity_id"), either(0).alias("kind"), either(1).alias("prefix"), "block")
            .filter(F.length("entity_id") > 0))


def flatten(df: DataFrame, source: str = "snapshot", home: str = dims.HOME_POINT) -> DataFrame:
    """Every usable number of every snapshot as a history row.

    The documents are read once: their few blocks become rows first, and only then the fields that a block really has, so
    that absent fields cost nothing. Fields are picked and turned into numbers in generated code. A block of a place that
    carries an error is left out. An undated document takes the time in `arrived`, where there is that column, else the
    present.
    """
    rows = _blocks(df, home)
    failed = F.col("kind").isin("weather", "soil", "hazard") & F.coalesce(F.length(F.col("block")["error"]) > 0, F.lit(False))
    fields = rows.filter(~failed).select("ts", "entity_type", "entity_id", "kind", "prefix", F.explode("block").alias("field", "text"))
    kept = F.col("kind") == "index"
    for kind, names in KEPT.items():
        kept = kept | ((F.col("kind") == kind) & F.col("field").isin(names))
    # The text passes a generator as a number: filters stay behind it, where each of them would read the text anew.
    numbers = fields.filter(kept & F.col("text").isNotNull()).select(
        "ts", "entity_type", "entity_id", F.concat("prefix", "field").alias("metric"), F.explode(F.array(F.col("text").try_cast("double"))).alias("number"))
    return (numbers.withColumns({"source": F.lit(source), "value": number("number")})
            .filter(F.col("value").isNotNull()).select(*HISTORY_COLS))
