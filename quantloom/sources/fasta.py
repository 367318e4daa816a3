"""FASTA and GMT files."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A record separator that leaves one record in a row, so large files are split between tasks.
RECORD = "\n>"


def load_fasta(spark: SparkSession, path: str) -> DataFrame:
    """accession, gene, reviewed, header, sequence; of repeated accessions the last record in the order of headers."""
    raw = spark.read.option("lineSep", RECORD).text(path).where("trim(value) <> '' and trim(value) <> '>'")
    text = F.regexp_replace("value", r"^>", "")
    header = F.substring_index(text, "\n", 1)
    sequence = F.when(F.locate("\n", text) > 0, F.upper(F.regexp_replace(F.substr(text, F.locate("\n", text) + 1), r"[\s*>]", ""))).otherwise("")
    token = F.split(header, r"\s+")[0]
    accession = F.when(token.contains("|"), F.split(token, r"\|")[1]).otherwise(token)
    out = raw.select(accession.alias("accession"), F.regexp_extract(header, r"\bGN=(\S+)", 1).alias("gene"), header.startswith("sp|").alias("reviewed"), header.alias("header"), sequence.alias("sequence"))
    return out.groupBy("accession").agg(*(F.max_by(c, "header").alias(c) for c in ("gene", "reviewed", "header", "sequence")))


def fasta_accessions(path: str) -> set[str]:
    """Accessions of a small list of contaminants, from the first three tokens of headers, tagged and untagged."""
    found = set()
    with open(path) as lines:
        for line in lines:
            if line.startswith(">"):
                for token in re.split(r"[\s;]+", line[1:].strip())[:3]:
                    for part in token.split("|") if "|" in token else [token]:
                        name = part.rpartition(":")[2]
                        if re.fullmatch(r"[A-Z0-9_.]{5,}(-\d+)?", name):
                            found |= {part, name}
    return found


def resolve_accession(fasta: DataFrame, queries: DataFrame, column: str = "protein") -> DataFrame:
    """queries with `accession` and `sequence`: the name as it is, else without its contaminant tag, else without its isoform."""
    own = F.col(column)
    bare = F.regexp_replace(own, r"^(CON__|Cont_|contam_|cRAP[-_])", "")
    tries = F.array(*(F.struct(F.lit(i).alias("rank"), c.alias("name")) for i, c in enumerate((own, bare, F.substring_index(bare, "-", 1)))))
    wanted = queries.select(column).distinct().withColumn("t", F.explode(tries)).select(column, "t.rank", "t.name")
    found = wanted.join(fasta.select("accession", "sequence"), F.col("name") == F.col("accession")).groupBy(column).agg(F.min_by(F.struct("accession", "sequence"), "rank").alias("hit"))
    return queries.join(found, column, "left").select("*", F.col("hit.accession").alias("accession"), F.col("hit.sequence").alias("sequence")).drop("hit")


def window(sequence: Column, position: Column, residue: Column, size: int = 7) -> Column:
    """`_LEFT*S*RIGHT_` around a position, padded with `_`; or what is wrong with it."""
    padded = F.concat(F.lit("_" * size), sequence, F.lit("_" * size))
    cut = F.concat(F.lit("_"), F.substr(padded, position, F.lit(size)), F.lit("*"), residue, F.lit("*"), F.substr(padded, position + size + 1, F.lit(size)), F.lit("_"))
    return (
        F.when(sequence.isNull(), "FASTA_ERROR: protein not found")
        .when(position.isNull() | (position < 1) | (position > F.length(sequence)), F.concat(F.lit("POSITION_ERROR: "), F.coalesce(position.cast("string"), F.lit("none"))))
        .when(F.substr(sequence, position, F.lit(1)) != residue, F.concat(F.lit("SEQUENCE_MISMATCH: found "), F.substr(sequence, position, F.lit(1))))
        .otherwise(cut)
    )


def add_windows(features: DataFrame, fasta: DataFrame, size: int = 7, protein: str = "protein_group_id", position: str = "site_position", residue: str = "residue", out: str = "kinase_sequence") -> DataFrame:
    found = resolve_accession(fasta, features.withColumn("_p", F.trim(F.split(protein, ";")[0])), "_p")
    return found.withColumn(out, window(F.col("sequence"), F.col(position), F.col(residue), size)).drop("_p", "accession", "sequence")


def load_gmt(spark: SparkSession, path: str) -> DataFrame:
    """library, set_name, member of one file or all `.gmt` files of a folder; comments and short lines are passed over."""
    raw = spark.read.option("pathGlobFilter", "*.gmt").text(path).select("value", F.col("_metadata.file_name").alias("file"))
    cells = F.split("value", "\t")
    own = raw.where(~F.col("value").startswith("#") & (F.size(cells) >= 3))
    library = F.regexp_replace("file", r"\.gmt$", "")
    return own.select(library.alias("library"), F.get(cells, F.lit(0)).alias("set_name"), F.explode(F.slice(cells, F.lit(3), F.size(cells))).alias("member")).where("trim(member) <> ''").distinct()


def load_libraries(spark: SparkSession, path: str, names: Iterable[str] | None = None) -> DataFrame:
    """All libraries of a folder, or those named (by file name without suffix); a name that isn't there fails."""
    found = load_gmt(spark, path)
    if names is None:
        return found
    missing = set(names) - {r[0] for r in found.select("library").distinct().collect()}  # a row per file
    if missing:
        raise ValueError(f"there are no libraries {sorted(missing)} in {path}")
    return found.where(F.col("library").isin(*names))


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """Expected regulation of kinases: Condition ID, Condition, Kinase, Directionality, Pubmed, Time (min)."""
    return spark.read.csv(path, header=True)


def load_activities(spark: SparkSession, path: str) -> DataFrame:
    """A wide table of kinases by conditions -> Kinase, condition, activity; empty cells go."""
    wide = spark.read.csv(path, header=True)
    first, *conditions = wide.columns
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("condition"), F.col(f"`{c}`").try_cast("double").alias("activity")) for c in conditions)))
    return wide.select(F.col(f"`{first}`").alias("Kinase"), cells.alias("c")).select("Kinase", "c.condition", "c.activity").where("activity is not null")


def write_gmt(sets: DataFrame, path: str) -> None:
    """library, set_name, member -> one folder of text for each library."""
    lines = sets.groupBy("library", "set_name").agg(F.concat_ws("\t", F.array_sort(F.collect_set("member"))).alias("m"))
    lines.select("library", F.concat_ws("\t", "set_name", F.lit("na"), "m").alias("value")).write.partitionBy("library").mode("overwrite").text(path)
