"""The closed registry of documents: an allowlist whose order is meaningful."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Document:
    document_id: str
    document_name: str
    publisher: str
    year: int
    source_url: str
    kind: str
    aliases: tuple[str, ...]
    landing_page: bool = False


# The registry. Order decides ties and the order of sections.
REGISTRY: tuple[Document, ...] = (
    Document("cold-food-storage", "Cold Food Storage Chart", "FoodSafety.gov (U.S. Department of Health and Human Services / FDA / USDA)", 2023, "https://www.foodsafety.gov/food-safety-charts/cold-food-storage-charts", "html", ("cold food storage", "cold food storage chart")),
    Document("who-healthy-diet", "Healthy diet (Fact sheet)", "World Health Organization", 2018, "https://www.who.int/docs/default-source/healthy-diet/healthy-diet-fact-sheet-394.pdf", "pdf", ("healthy diet", "healthy diet fact sheet", "who fact sheet")),
    Document("fao-who-healthy-diets", "What are healthy diets? Joint statement", "Food and Agriculture Organization of the United Nations and World Health Organization", 2024, "https://www.who.int/publications/i/item/9789240101876", "pdf", ("what are healthy diets", "fao and who"), True),
    Document("who-five-keys", "Five keys to safer food manual", "World Health Organization", 2006, "https://www.who.int/publications/i/item/9789241594639", "pdf", ("five keys", "five keys to safer food"), True),
    Document("eatwell-guide", "The Eatwell Guide booklet", "Public Health England (now Office for Health Improvement and Disparities)", 2018, "https://assets.publishing.service.gov.uk/media/5ba8a50540f0b605084c9501/Eatwell_Guide_booklet_2018v4.pdf", "pdf", ("eatwell", "eatwell guide")),
    Document("fsa-chill", "How to chill, freeze and defrost food safely", "Food Standards Agency (UK)", 2017, "https://www.gov.uk/government/publications/how-to-chill-freeze-and-defrost-food-safely/how-to-chill-freeze-and-defrost-food-safely", "html", ("food standards agency", "chill freeze and defrost")),
    Document("kitchen-companion", "Kitchen Companion: Your Safe Food Handbook", "USDA Food Safety and Inspection Service", 2008, "https://www.fsis.usda.gov/sites/default/files/media_file/2020-12/Kitchen-Companion.pdf", "pdf", ("kitchen companion",)),
)
# An alias that names a topic and selects nothing; required aliases; kinds; landing pages.
TOPIC_ALIASES = ("healthy diet",)
REQUIRED_ALIASES = ("eatwell", "eatwell guide", "kitchen companion", "five keys", "cold food storage", "healthy diet", "food standards agency")
HTML_IDS = ("cold-food-storage", "fsa-chill")
LANDING_IDS = ("fao-who-healthy-diets", "who-five-keys")
SIZE = 7

SCHEMA = "ordinal int, document_id string, document_name string, publisher string, year int, source_url string, kind string, aliases array<string>, landing_page boolean"


def registry(spark: SparkSession, documents: tuple[Document, ...] = REGISTRY) -> DataFrame:
    """The registry with each document's ordinal; a few rows, so joins broadcast it."""
    return spark.createDataFrame([(i, *asdict(d).values()) for i, d in enumerate(documents)], SCHEMA)


def names(reg: DataFrame) -> DataFrame:
    return reg.select("document_id", "document_name")


def violations(reg: DataFrame) -> DataFrame:
    """(rule, subject) of every broken rule; no rows for a sound registry."""
    spark = reg.sparkSession
    rule = lambda df, name, subject: df.select(F.lit(name).alias("rule"), subject.cast("string").alias("subject"))
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    aliases = reg.select("document_id", F.explode("aliases").alias("alias")).withColumn("folded", F.replace(F.lower("alias"), F.lit("ß"), F.lit("ss")))
    wanted = spark.createDataFrame([(d.source_url,) for d in REGISTRY], "source_url string")
    required = spark.createDataFrame([(a,) for a in REQUIRED_ALIASES], "folded string")
    ids = spark.createDataFrame([(d.document_id,) for d in REGISTRY], "document_id string")
    d = F.col("document_id")
    parts = [
        rule(reg.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != SIZE), "size", F.col("n")),
        rule(reg.where(blank("document_id") | blank("document_name") | blank("publisher") | F.col("year").isNull() | blank("source_url")), "missing field", d),
        rule(reg.groupBy("document_id").count().where("count > 1"), "duplicate document_id", d),
        rule(reg.where(~F.col("kind").isin("html", "pdf") | (F.col("kind") != F.when(d.isin(*HTML_IDS), "html").otherwise("pdf"))), "kind", d),
        rule(reg.where(F.col("landing_page") != d.isin(*LANDING_IDS)), "landing_page", d),
        rule(aliases.groupBy("folded").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared alias", F.col("folded")),
        rule(reg.select("document_id").exceptAll(ids).union(ids.exceptAll(reg.select("document_id"))), "unexpected document_id", d),
        rule(reg.select("source_url").distinct().exceptAll(wanted).union(wanted.exceptAll(reg.select("source_url").distinct())), "source_url", F.col("source_url")),
        rule(required.join(aliases, "folded", "left_anti"), "missing alias", F.col("folded")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
