"""The catalogue of public APIs and its operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.functions import catalogue_text
from citelake.operators.files import write_text
from citelake.schemas import CATALOGUE

# Id, category, name, base URL, authentication, description, and endpoints as method, path, description.
# Searches look into names and descriptions, so both are as users know them.
SEED = [
    (
        "api-weather-01", "Weather", "Open-Meteo API", "https://api.open-meteo.com/v1", "none",
        "Free weather forecast API for non-commercial use.",
        [("GET", "/forecast", "Retrieve weather forecasts based on coordinates")],
    ),
    (
        "api-finance-02", "Finance", "CoinGecko API", "https://api.coingecko.com/api/v3", "none",
        "Comprehensive cryptocurrency data analysis feed.",
        [("GET", "/ping", "Check API status"), ("GET", "/coins/list", "Get lists of all supported cryptocurrencies")],
    ),
    (
        "api-news-03", "News", "HackerNews API", "https://hacker-news.firebaseio.com/v0", "none",
        "Official HackerNews Firebase database endpoints wrapper.",
        [("GET", "/topstories.json", "Retrieve IDs of top HN postings")],
    ),
    (
        "api-education-04", "Education", "Universities List API", "http://universities.hipolabs.com", "none",
        "Simple search tool registry for worldwide universities metadata.",
        [("GET", "/search", "Find global colleges by name or country")],
    ),
    (
        "api-gov-05", "Government Open Data", "Data USA API", "https://datausa.io/api", "none",
        "Open public data platform visualization queries.",
        [("GET", "/data", "Queries public US demographic and economic logs")],
    ),
    (
        "api-scientific-06", "Scientific", "NASA APOD API", "https://api.nasa.gov/planetary", "apiKey",
        "Fetches scientific astronomy visuals and descriptions.",
        [("GET", "/apod", "Astronomy Picture of the Day feed")],
    ),
    (
        "api-ai-07", "AI", "Ollama API", "http://localhost:11434/api", "none",
        "Local large language model backend console endpoint.",
        [("POST", "/generate", "Trigger local LLM model generation loops"), ("POST", "/embeddings", "Generate dynamic float vectors")],
    ),
    (
        "api-mapping-08", "Mapping", "OSM Nominatim API", "https://nominatim.openstreetmap.org", "none",
        "OpenStreetMap reverse-geocoder lookup registry.",
        [("GET", "/search", "Reverse-geocode locations by names")],
    ),
    (
        "api-health-09", "Healthcare Public APIs", "OpenFDA API", "https://api.fda.gov", "none",
        "Public US FDA research records index catalog.",
        [("GET", "/drug/label.json", "Search drug warnings and label info")],
    ),
    (
        "api-geo-10", "Geospatial", "USGS Earthquake API", "https://earthquake.usgs.gov/fdsnws/event/1", "none",
        "US Geological Survey real-time seismic records database.",
        [("GET", "/query", "Fetch real-time seismic event listings")],
    ),
    (
        "api-opendata-11", "Open Data", "REST Countries API", "https://restcountries.com/v3.1", "none",
        "Informational borders and geopolitical profiles lookup database.",
        [("GET", "/all", "List political borders and country populations")],
    ),
    (
        "api-trans-12", "Transportation", "Transitland API", "https://transit.land/api/v2", "apiKey",
        "Global open transit routing and schedules index.",
        [("GET", "/operators", "Get transit systems operators directories")],
    ),
    (
        "api-astro-13", "Astronomy", "NASA SSCWeb API", "https://sscweb.gsfc.nasa.gov/WS/ssc/2", "none",
        "NASA Satellite Situation Center spacecraft orbits tracker.",
        [("GET", "/observatories", "List orbiting scientific spacecrafts")],
    ),
    (
        "api-chain-14", "Blockchain", "Blockchain.info API", "https://blockchain.info", "none",
        "Bitcoin block details and exchange metrics api.",
        [("GET", "/rawblock/{block_hash}", "Get transactions contained in block")],
    ),
    (
        "api-sec-15", "Cybersecurity", "HaveIBeenPwned API", "https://haveibeenpwned.com/api/v3", "apiKey",
        "Analyzes historical database compromises for specific emails.",
        [("GET", "/breaches", "Gets accounts compromise breaches details")],
    ),
]
# What a health probe puts in the places of a path.
PROBE_VALUES = {"block_hash": "00000000000000000003c2ffb514c3a9f0e1fb719eb7664d6fa9e1d88cc2e37f", "page": "1", "id": "1", "query": "test"}


def seed_entries() -> list[dict]:
    """The seed as rows of the catalogue's schema."""
    names = ("id", "category", "name", "base_url", "auth_type", "description")
    return [
        dict(zip(names, values, strict=True))
        | {"https": values[3].startswith("https"), "endpoints": [{"method": m, "path": p, "description": d} for m, p, d in endpoints]}
        for *values, endpoints in SEED
    ]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(seed_entries(), CATALOGUE)


def categories(apis: DataFrame) -> DataFrame:
    return apis.select("category").distinct()


def by_category(apis: DataFrame, category: str) -> DataFrame:
    return apis.where(F.lower("category") == category.lower())


def search(apis: DataFrame, keyword: str) -> DataFrame:
    word = F.lit(keyword.lower())
    return apis.where(F.contains(F.lower("name"), word) | F.contains(F.lower("description"), word))


def get(apis: DataFrame, api_id: str) -> DataFrame:
    return apis.where(F.col("id") == api_id)


def register(apis: DataFrame, entry: dict) -> DataFrame:
    """The catalogue with ``entry`` added, or put in the place of the one with its id."""
    for field in ("name", "base_url", "category"):
        if not entry.get(field):
            raise ValueError(f"an API needs {field}")
    held = dict(entry)
    held.setdefault("id", f"api-custom-{apis.count() + 1}")
    held = {"endpoints": [], "auth_type": "none", "https": held["base_url"].startswith("https"), "description": None} | held
    new = apis.sparkSession.createDataFrame([held], CATALOGUE)
    return apis.where(F.col("id") != held["id"]).unionByName(new)


def probe_targets(apis: DataFrame) -> DataFrame:
    """``id, name, url``: where a health probe of each API goes."""
    path = F.coalesce(F.try_element_at(F.col("endpoints"), F.lit(1))["path"], F.lit(""))
    for name, value in PROBE_VALUES.items():
        path = F.replace(path, F.lit("{" + name + "}"), F.lit(value))
    return apis.select("id", "name", F.concat("base_url", path).alias("url"))


def write_texts(apis: DataFrame, folder: str) -> None:
    """A client (``<id>.py``) and a reference page (``<id>.md``) for each API; a catalogue is a short list."""
    spark = apis.sparkSession
    for row in apis.toLocalIterator():
        api = row.asDict(recursive=True)
        for ending, text in (("py", catalogue_text.connector(api)), ("md", catalogue_text.reference_page(api))):
            write_text(spark.createDataFrame([(text,)], "value string"), f"{folder}/{api['id']}.{ending}")


def checked(apis: DataFrame, probes: DataFrame) -> DataFrame:
    """The reports of a round over all APIs (``id``): those of ``probes`` (``api_id, failed`` and any report columns) that
    came back.  A probe that failed to run is dropped from the round, as are probes of APIs that are not listed."""
    known = apis.select(F.col("id").alias("_known"))
    return probes.where(~F.coalesce("failed", F.lit(False))).join(known, F.col("api_id") == F.col("_known"), "left_semi").drop("failed")
