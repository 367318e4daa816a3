"""Site keys: built, parsed, made unique. All are Column expressions or one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.schema import CONTAMINANT_PREFIXES

KEY_PATTERN = r"^([^|]+)\|([^|]*)\|([STY])(\d+)\|M(\d+)$"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def full_key(protein: Column, gene: Column, residue: Column, position: Column, multiplicity: Column) -> Column:
    """`P31749|AKT1|S473|M1`; `Error_key` if position or multiplicity is no number."""
    pos, mult = position.cast("string").try_cast("int"), multiplicity.cast("string").try_cast("int")
    key = F.concat(_text(protein), F.lit("|"), _text(gene), F.lit("|"), _text(residue), pos.cast("string"), F.lit("|M"), mult.cast("string"))
    return F.coalesce(key, F.lit("Error_key"))


def short_key(gene: Column, residue: Column, position: Column, multiplicity: Column) -> Column:
    return F.concat(_text(gene), F.lit("|"), _text(residue), position.cast("string"), F.lit("|M"), multiplicity.cast("string"))


def pg_key(protein: Column, residue: Column, position: Column, multiplicity: Column) -> Column:
    return short_key(protein, residue, position, multiplicity)


def resolve_collisions(sites: DataFrame, short: str = "short_key", full: str = "full_key") -> DataFrame:
    """Repeated short keys get `#2`, `#3`, ... in the order of full keys; adds `collision` (true from the second on)."""
    n = F.row_number().over(W.partitionBy(short).orderBy(full))
    out = sites.withColumn("_n", n)
    return out.withColumn(short, F.when(F.col("_n") > 1, F.concat(short, F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col(short))).withColumn("collision", F.col("_n") > 1).drop("_n")


def parse_key(key: Column) -> Column:
    """struct(protein, gene, residue, position, multiplicity) or null."""
    part = lambda i: F.regexp_extract(key, KEY_PATTERN, i)
    first = F.split(part(1), ";")[0]
    return F.when(
        key.rlike(KEY_PATTERN),
        F.struct(first.alias("protein"), part(2).alias("gene"), part(3).alias("residue"), part(4).try_cast("int").alias("position"), part(5).try_cast("int").alias("multiplicity")),
    )


def site_id(protein: Column, residue: Column, position: Column) -> Column:
    """`P31749_S473`."""
    return F.concat(protein, F.lit("_"), residue, position.cast("string"))


def canonical_id(key: Column) -> Column:
    parsed = parse_key(key)
    return site_id(parsed["protein"], parsed["residue"], parsed["position"])


def canonicalise(frame: DataFrame, key_col: str, drop_unparseable: bool = True) -> DataFrame:
    """Adds `site_id`; rows without one go or keep null."""
    out = frame.withColumn("site_id", canonical_id(F.col(key_col)))
    return out.where("site_id is not null") if drop_unparseable else out


def key_gene(key: Column) -> Column:
    """The second field; empty and `nan` are null."""
    gene = F.get(F.split(key, r"\|"), F.lit(1))
    return F.when(~gene.isin("", "nan"), gene)


def gene_of(key: Column, gene: Column | None = None) -> Column:
    own = F.trim(F.split(gene, ";")[0]) if gene is not None else F.lit(None).cast("string")
    return F.coalesce(F.when(~own.isin("", "nan"), own), key_gene(key))


def site_label(key: Column) -> Column:
    """`AKT1 S473` for plots."""
    parsed = parse_key(key)
    label = F.concat(F.when(parsed["gene"] != "", parsed["gene"]).otherwise(parsed["protein"]), F.lit(" "), parsed["residue"], parsed["position"].cast("string"))
    return F.coalesce(label, key)


def _members(group: Column) -> Column:
    return F.filter(F.transform(F.split(group, ";"), lambda p: F.trim(p)), lambda p: p != "")


def is_contaminant_tagged(group: Column) -> Column:
    """Some member begins with a prefix of contaminants."""
    return group.rlike("(^|;) *(" + "|".join(CONTAMINANT_PREFIXES) + ")")


def leading_protein(group: Column) -> Column:
    """The first member; of tagged contaminants the first, in the order of prefixes."""
    members = _members(group)

    def first_with(prefix: str) -> Column:
        return F.get(F.filter(members, lambda p: p.startswith(prefix)), F.lit(0))

    searched = F.coalesce(*map(first_with, CONTAMINANT_PREFIXES), F.get(members, F.lit(0)), F.lit(""))
    first = F.trim(F.substring_index(group, ";", 1))
    return F.when(~is_contaminant_tagged(group) & (first != ""), first).otherwise(searched)  # the search is seldom needed


def motif(kinase_sequence: Column) -> dict[str, Column]:
    """Neighbours of the marked residue of `_LEFT*S*RIGHT_` and what they say; null where the string isn't of that form."""
    pattern = r"^_?([A-Z_]*)\*([A-Za-z])\*([A-Z_]*?)_?$"
    ok = kinase_sequence.rlike(pattern)
    left, right = F.regexp_extract(kinase_sequence, pattern, 1), F.regexp_extract(kinase_sequence, pattern, 3)

    def at(side: Column, place: Column) -> Column:
        residue = F.substr(side, place, F.lit(1))
        return F.when(ok & (place >= 1) & ~residue.isin("", "_"), residue)

    before = lambda n: at(left, F.length(left) - n + 1)
    after = lambda n: at(right, F.lit(n))
    any_of = lambda cs, letters: F.when(ok, F.coalesce(cs[0].isin(*letters), F.lit(False)) | (any_of(cs[1:], letters) if len(cs) > 1 else F.lit(False)))
    return {
        "p_minus_1": before(1),
        "p_plus_1": after(1),
        "is_proline_directed": F.when(ok, F.coalesce(after(1) == "P", F.lit(False))),
        "is_basophilic": any_of([before(2), before(3), before(5)], "RK"),
        "is_acidic_motif": any_of([after(1), after(3)], "DE"),
    }
