"""Restriction enzymes and the remnants that their cuts leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Enzyme names and cut-site remnants.
REMNANTS = {
    "APEKI": ["CAGC", "CTGC"], "PSTI": ["TGCAG"], "ECOT22I": ["TGCAT"], "PASI": ["CAGGG", "CTGGG"], "HPAII": ["CGG"], "MSPI": ["CGG"],
    "PSTI-ECOT22I": ["TGCAG", "TGCAT"], "PSTI-MSPI": ["TGCAG"], "PSTI-TAQI": ["TGCAG"], "SBFI-MSPI": ["TGCAGG"], "ASISI-MSPI": ["ATCGC"],
    "BSSHII-MSPI": ["CGCGC"], "FSEI-MSPI": ["CCGGCC"], "SALI-MSPI": ["TCGAC"], "APOI": ["AATTC", "AATTT"], "BAMHI": ["GATCC"], "MSEI": ["TAA"],
    "SAU3AI": ["GATC"], "RBSTA": ["TA"], "RBSCG": ["CG"], "NSPI": ["CATGT", "CATGC"], "AVAII": ["GACC", "GTCC"], "NA": [""],
}


def enzymes(spark: SparkSession, extra: list[tuple[str, str]] = ()) -> DataFrame:
    """name and remnants of the known enzymes and of `extra` (name, sequence) pairs, which add to a name or make it."""
    rows = [(n, s) for n, ss in REMNANTS.items() for s in ss] + [(n.upper(), s.upper()) for n, s in extra]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at int, name string, seq string").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq"))), lambda x: x["seq"]).alias("remnants"))


def with_remnants(sheet: DataFrame, known: DataFrame) -> DataFrame:
    """A sample sheet with arrays remnants and r_remnants; a name that isn't known is an error when rows are read."""
    f = known.select(F.col("name").alias("enzyme"), F.col("remnants").alias("remnants"))
    r = known.select(F.col("name").alias("r_enzyme"), F.col("remnants").alias("r_remnants"))
    met = sheet.join(F.broadcast(f), "enzyme", "left").join(F.broadcast(r), "r_enzyme", "left")
    unknown = lambda c, e: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit("unknown enzyme: "), F.col(e)))).otherwise(F.col(c))
    return met.select("name", "barcode", "enzyme", "r_enzyme", "r_barcode", unknown("remnants", "enzyme").alias("remnants"), unknown("r_remnants", "r_enzyme").alias("r_remnants"))
