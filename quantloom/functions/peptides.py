"""Modified-peptide strings as Column expressions. Nulls give nulls; nothing here needs Python on executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.schema import PHOSPHO, UNIMOD_PHOSPHO

_OTHER_BRACKET = r"\[(?!Phospho \(STY\))[^\]]*\]"
_PHOSPHO_MARK = r"\[Phospho \(STY\)\]"


def base_sequence(precursor: Column) -> Column:
    """Without the `_` or `*` wrappers and the charge; all brackets stay."""
    s = F.when(F.substring(precursor, 1, 2).isin("*.", "_."), F.substr(precursor, F.lit(3))).when(F.substring(precursor, 1, 1).isin("*", "_"), F.substr(precursor, F.lit(2))).otherwise(precursor)
    s = (
        F.when(s.contains(".*"), F.substring_index(s, ".*", 1))
        .when(s.contains("._"), F.substring_index(s, "._", 1))
        .when(F.substring(s, -1, 1).isin("*", "_"), F.substr(s, F.lit(1), F.length(s) - 1))
        .otherwise(s)
    )
    return F.when(F.length(precursor) < 4, precursor).otherwise(F.regexp_replace(s, r"\.\d+$", ""))


def clean_sequence(precursor: Column, base: Column | None = None) -> Column:
    """base: base_sequence(precursor), where it is a column already."""
    return F.replace(F.regexp_replace(base_sequence(precursor) if base is None else base, r"\[[^\]]*\]", ""), F.lit("_"), F.lit(""))


def phospho_count(precursor: Column) -> Column:
    return F.size(F.split(precursor, _PHOSPHO_MARK)) - 1


def modifications(precursor: Column, base: Column | None = None) -> Column:
    """Every bracket's content, in order."""
    return F.regexp_extract_all(base_sequence(precursor) if base is None else base, F.lit(r"\[([^\]]+)\]"), F.lit(1))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: inside a lambda an expression is computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ends(segments: Column) -> Column:
    """The summed lengths of the first 1, 2, ... segments, without the last."""

    def running(own: Column) -> Column:
        lengths = F.slice(F.transform(own, F.length), F.lit(1), F.greatest(F.size(own) - 1, F.lit(0)))
        zero = F.array().cast("array<int>")
        return F.aggregate(lengths, zero, lambda upto, n: F.concat(upto, F.array(F.coalesce(F.try_element_at(upto, F.lit(-1)), F.lit(0)) + n)))

    return _let(segments, lambda own: F.when(F.size(own) > 1, running(own)))


def phospho_positions(precursor: Column, base: Column | None = None) -> Column:
    """Positions (from 1) of the phosphorylated residues; null if there is none."""
    return _ends(F.split(F.regexp_replace(base_sequence(precursor) if base is None else base, _OTHER_BRACKET, ""), _PHOSPHO_MARK))


def encoded_positions(precursor: Column) -> Column:
    """Sorted phospho positions; empty for peptides without."""
    s = F.regexp_replace(F.regexp_replace(precursor, _OTHER_BRACKET, ""), r"^[_*. ]+|[_*. ]+$", "")
    return F.array_sort(F.coalesce(_ends(F.split(F.regexp_replace(s, r"\.\d+$", ""), _PHOSPHO_MARK)), F.array().cast("array<int>")))


def localization(loc_string: Column) -> Column:
    """Array of (pos, prob), one for each phospho bracket with a percentage, by position; a later bracket wins.

    Letters before a bracket are counted; a bracket that is never closed ends the string.
    """
    trimmed = F.regexp_replace(F.regexp_replace(F.regexp_replace(loc_string, r"^[_.* ]+|[_.* ]+$", ""), _OTHER_BRACKET, ""), r"\[[^\]]*$", "")

    def cells(s: Column) -> Column:
        letters = F.transform(F.split(s, r"\[Phospho \(STY\)[^\]]*\]"), lambda x: F.regexp_replace(x, r"[^\p{L}]", ""))
        ends = F.coalesce(_ends(letters), F.array().cast("array<int>"))
        brackets = F.regexp_extract_all(s, F.lit(r"\[(Phospho \(STY\)[^\]]*)\]"), F.lit(1))
        probs = F.transform(brackets, lambda b: F.try_divide(F.regexp_extract(b, r":\s*([\d.]+)%", 1).try_cast("double"), F.lit(100.0)))
        return F.filter(F.zip_with(ends, probs, lambda e, p: F.struct(e.alias("pos"), p.alias("prob"))), lambda c: c["prob"].isNotNull())

    def last(named: Column) -> Column:
        return F.filter(named, lambda c, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda d: d["pos"] == c["pos"]))

    return _let(_let(trimmed, cells), last)


def loc_at(cells: Column, position: Column) -> Column:
    """The probability at a position, or null."""
    return F.get(F.filter(cells, lambda c: c["pos"] == position), F.lit(0))["prob"]


def ranked_positions(cells: Column, n: Column) -> Column:
    """The n cells of highest probability; of equal ones the first positions."""

    def order(a: Column, b: Column) -> Column:
        return F.when(a["prob"] != b["prob"], F.when(a["prob"] > b["prob"], -1).otherwise(1)).otherwise(a["pos"] - b["pos"])

    return F.when(n > 0, F.slice(F.array_sort(cells, order), F.lit(1), n)).otherwise(F.array().cast("array<struct<pos:int,prob:double>>"))


def top_positions(cells: Column, n: Column) -> Column:
    return F.array_sort(F.transform(ranked_positions(cells, n), lambda c: c["pos"]))


def is_top_n(precursor: Column, loc_string: Column) -> Column:
    """Keeps rows without phospho, and rows whose encoded positions are the best localized ones."""
    found = encoded_positions(precursor)
    top = top_positions(F.coalesce(localization(loc_string), F.array().cast("array<struct<pos:int,prob:double>>")), F.size(found))
    return F.coalesce((F.size(found) == 0) | (found == top), F.lit(True))


def first_position(text: Column) -> Column:
    """`12,40;7` -> 12; null for anything else."""
    return F.trim(F.split(F.split(F.trim(text), ";")[0], ",")[0]).try_cast("int")


def residue_at(sequence: Column, position: Column) -> Column:
    """`X` beyond the sequence."""
    inside = (position >= 1) & (position <= F.length(sequence))
    return F.when(inside, F.substr(sequence, position, F.lit(1))).otherwise("X")


def marked_sequence(sequence: Column, position: Column) -> Column:
    """The residue at the position in lower case, with an asterisk after it."""
    inside = (position >= 1) & (position <= F.length(sequence))
    marked = F.concat(F.substr(sequence, F.lit(1), position - 1), F.lower(F.substr(sequence, position, F.lit(1))), F.lit("*"), F.substr(sequence, position + 1))
    return F.when(inside, marked).otherwise(sequence)


def diann_precursor(modified: Column, charge: Column) -> Column:
    s = F.regexp_replace(F.replace(modified, F.lit(UNIMOD_PHOSPHO), F.lit(PHOSPHO)), r"\(UniMod:\d+\)", "")
    return F.concat(F.lit("_"), s, F.lit("_."), charge.cast("int").cast("string"))


def diann_localization(occupancy: Column) -> Column:
    """The (pos, prob) cells of `AAS(UniMod:21){1.000000}LPT{0.848000}K2`, at four significant digits."""
    s = F.regexp_replace(F.regexp_replace(occupancy, r"\(UniMod:\d+\)", ""), r"\d+$", "")
    ends = F.coalesce(_ends(F.transform(F.split(s, r"\{[^}]*\}"), lambda x: F.regexp_replace(x, r"[^\p{L}]", ""))), F.array().cast("array<int>"))
    percent = F.transform(F.regexp_extract_all(s, F.lit(r"\{([\d.]+)\}"), F.lit(1)), lambda p: p.cast("double") * 100)
    digits = F.transform(percent, lambda p: F.when(p == 0, 0.0).otherwise(F.bround(p * F.pow(F.lit(10.0), 3 - F.floor(F.log10(p)))) / F.pow(F.lit(10.0), 3 - F.floor(F.log10(p))) / 100))
    return F.zip_with(ends, digits, lambda e, p: F.struct(e.alias("pos"), p.alias("prob")))


def first_site_position(protein_sites: Column, protein: Column | None = None) -> Column:
    """`[P1:S12,T20];[P2:C3,S5]` -> the first S, T or Y position of the protein (the first one by default)."""
    groups = F.transform(F.split(protein_sites, ";"), lambda g: F.regexp_replace(F.trim(g), r"^[\[\]]+|[\[\]]+$", ""))
    groups = F.filter(groups, lambda g: g.contains(":"))
    own = groups if protein is None else F.filter(groups, lambda g: F.trim(F.substring_index(g, ":", 1)) == protein)
    sites = F.split(F.trim(F.regexp_replace(F.get(own, F.lit(0)), r"^[^:]*:", "")), ",")
    first = F.get(F.filter(sites, lambda s: F.substring(s, 1, 1).isin("S", "T", "Y")), F.lit(0))
    return F.regexp_replace(first, r"\D", "").try_cast("int")


def diann_start(modified: Column, protein_sites: Column, protein: Column | None = None) -> Column:
    """Position of the peptide's first residue in its protein."""
    within = F.length(F.regexp_replace(F.substring_index(modified, UNIMOD_PHOSPHO, 1), r"\(UniMod:\d+\)", ""))
    return F.when(modified.contains(UNIMOD_PHOSPHO), first_site_position(protein_sites, protein) - within + 1)


def run_name(path: Column) -> Column:
    """The last part of a POSIX or Windows path, without the acquisition extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*[\\/]", ""), r"(?i)\.(raw|d|wiff2?|mzml|dia|htrms)$", "")


def window_to_kinase_sequence(window: Column, residue: Column) -> Column:
    """`KAGTRTDsREDEIsP` -> `_KAGTRTD*S*REDEISP_`, the middle residue marked; shorter than 3: empty."""
    middle = F.floor(F.length(window) / 2).cast("int")
    left, right = F.substr(window, F.lit(1), middle), F.substr(window, middle + 2)
    return F.when(F.length(window) < 3, "").otherwise(F.concat(F.lit("_"), F.upper(left), F.lit("*"), F.upper(residue), F.lit("*"), F.upper(right), F.lit("_")))
