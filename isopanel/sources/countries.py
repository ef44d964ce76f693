"""The place dimension and its map positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import parse_grouped_integer, round_exact

SCHEMA = (
    "country string, code string, lat double, lon double, population string, area_km2 string, custom string"
)

# The 22 countries and territories with code, latitude, longitude, population, area and a note.
STANDARD_COUNTRIES = (
    ("American Samoa", "AS", -14.2710, -170.1320, "43,915", "199",
     "Fa'a Samoa places immense importance on the extended family and chiefs."),
    ("Cook Islands", "CK", -21.2360, -159.7770, "17,044", "236",
     "Tivaevae, hand-sewn patchwork quilts, are made as ceremonial gifts."),
    ("Fiji", "FJ", -17.7134, 178.0650, "936,376", "18,274",
     "The Kava ceremony, an earthy infusion from a coconut shell, centers traditional welcomes."),
    ("French Polynesia", "PF", -17.6797, -149.4068, "308,872", "4,167",
     "The Heiva i Tahiti is a massive annual dance and sporting festival."),
    ("Guam", "GU", 13.4443, 144.7937, "172,952", "544",
     "The Chenchule' is a Chamorro system of mutual gifts and assistance."),
    ("Kiribati", "KI", 1.8360, -157.3660, "133,515", "811",
     "The Maneaba, a traditional meeting house, anchors village life."),
    ("Marshall Islands", "MH", 7.1315, 171.1845, "41,996", "181",
     "Kemem celebrates a child's first birthday, historically a major survival milestone."),
    ("Micronesia, Federated State of", "FM", 7.4250, 150.5500, "115,224", "702",
     "On Yap, giant stone discs called Rai are traditionally used as currency."),
    ("Nauru", "NR", -0.5228, 166.9315, "12,780", "21",
     "Weight lifting is a revered national sport tied to traditional strength."),
    ("New Caledonia", "NC", -20.9043, 165.6180, "292,991", "18,576",
     "The Kanak custom of 'La Coutume' involves offering yams or fabric to hosts."),
    ("Niue", "NU", -19.0544, -169.8672, "1,681", "261",
     "Tāoga Niue preserves the island's language and traditional fishing ethos."),
    ("Northern Mariana Islands", "MP", 15.0979, 145.6739, "49,796", "464",
     "Local fiestas honoring patron saints feature abundant Chamorro food."),
    ("Palau", "PW", 7.5149, 134.5825, "18,058", "459",
     "The Bai, a men's meeting house, was traditionally built without nails."),
    ("Papua New Guinea", "PG", -6.3149, 143.9555, "10,329,931", "462,840",
     "The Huli Wigmen grow their hair for months to craft ceremonial wigs."),
    ("Pitcairn", "PN", -25.0667, -130.1000, "47", "47",
     "Culture is tied to the Bounty mutineers' legacy and the Pitkern language."),
    ("Samoa", "WS", -13.7590, -172.1046, "225,681", "2,842",
     "Pe'a is the traditional male tattoo covering waist to knees."),
    ("Solomon Islands", "SB", -9.6457, 160.1562, "740,425", "28,400",
     "Woven shell money is still used for traditional settlements and bride prices."),
    ("Tokelau", "TK", -9.2000, -171.8480, "1,500", "10",
     "The Inati system divides all resources and fish catches equally among residents."),
    ("Tonga", "TO", -21.1789, -175.1982, "107,773", "747",
     "Wearing a ta'ovala, a woven mat, around the waist shows respect in formal settings."),
    ("Tuvalu", "TV", -8.5146, 179.1940, "11,396", "26",
     "The Fatele dance is performed to the beat of a wooden box on festive occasions."),
    ("Vanuatu", "VU", -15.3767, 166.9592, "334,506", "12,189",
     "Land diving (Naghol) on Pentecost Island preceded modern bungee jumping."),
    ("Wallis and Futuna", "WF", -13.7687, -177.1560, "11,502", "142",
     "Traditional royalty remains influential, with ceremonial feasts and Kava central to island life."),
)

# The map box in degrees.
MAP_LON = (125.0, 235.0)
MAP_LAT = (-30.0, 20.0)


def standard_countries(spark: SparkSession) -> DataFrame:
    """The built-in dimension as a frame. Any other frame with a ``country`` column serves as well."""
    return with_flag(spark.createDataFrame(STANDARD_COUNTRIES, SCHEMA))


def with_flag(dim: DataFrame, code: str = "code") -> DataFrame:
    """Flag symbol from a two-letter code: each letter becomes its regional indicator symbol."""
    letters = [
        F.decode(
            F.unhex(F.concat(F.lit("F09F87"), F.hex(F.ascii(F.substring(code, n, 1)) - F.ascii(F.lit("A")) + F.lit(0xA6)))),
            "UTF-8",
        )
        for n in (1, 2)
    ]
    return dim.withColumn("flag", F.concat(*letters))


def with_counts(dim: DataFrame, *columns: str) -> DataFrame:
    """Add ``<column>_count``, the number behind a text with thousands separators."""
    return dim.withColumns({f"{name}_count": parse_grouped_integer(name) for name in columns})


def map_position(lat: Column | str, lon: Column | str) -> tuple[Column, Column]:
    """Position in percent of the map box, from its left and upper edge. Western longitudes continue past 180."""
    lat, lon = (F.col(x) if isinstance(x, str) else x for x in (lat, lon))
    eastward = F.when(lon < 0, lon + 360).otherwise(lon)
    x = (eastward - MAP_LON[0]) / (MAP_LON[1] - MAP_LON[0]) * 100
    y = (MAP_LAT[1] - lat) / (MAP_LAT[1] - MAP_LAT[0]) * 100
    return round_exact(x, 2), round_exact(y, 2)


def project_map_xy(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add ``x_pct`` and ``y_pct``."""
    x, y = map_position(lat, lon)
    return df.withColumns({"x_pct": x, "y_pct": y})
