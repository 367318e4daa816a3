"""MinHash near-dedup: circulant MinHash, banding, exact Jaccard verification.

Signatures: a shingle's hash is an element of [0, D). One permutation (sigma) breaks up structure; the
second (pi), shifted circularly by 0, 1, ... K-1, gives all K coordinates, so that a shingle's K values are
one contiguous piece of pi. Coordinates are banded; with the defaults (32 bands of 4) a pair at the
threshold 0.8 shares no band with a probability of 5e-8.

Links decide components, so links inside a component need not all be looked at:
1. Equal shingle sets are one class (a hot group of copies is one row from here on).
2. In each bucket (band value) every class is compared with the bucket's centre, the class that shares most
   buckets with others: as many pairs as members, and an original is the centre of its copies even where
   these are too far from each other. Verified links give components.
3. What is left are pairs of different components in one bucket. Up to SMALL members they are all compared.
   In a larger one the classes are described by what they differ in from the centre c: D(x) is the symmetric
   difference of x and c. As x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles, a link asks that
   D(x) and D(y) share at least (e(x) + e(y)) / 2 of them, where e(x) = |D(x)| - q |x| and q = (1 - t) / (1 + t).
   e(x) > q |c| for every x that isn't linked with c, so such an x has to share some of its differences with
   y: only pairs that share one of the rarest differences (a prefix filter, as long as the bound asks for)
   are compared. Copies with changes of their own share none and meet nobody; copies of changed copies do.
   It is exact: a pair that shares a band is compared whenever its sets can reach the threshold, in buckets
   of any size; there is no cap on buckets or candidates, and SMALL changes no result.
Before texts are fetched, pairs of small buckets and centres must agree in enough 4-bit remains of their K
coordinates (below 0.6 of them, a pair at the threshold is met with a probability of 3e-8). Every link is
confirmed on the full sets of its words, not on hashes.

Tables between the steps are written to the shared folder. The texts of classes that are in some pair
are fetched by a join whose small side is broadcast only after a count.

Defined results: null and empty texts and texts without words have no shingles and are linked with
nothing; a text with fewer words than a shingle has one shingle, all its words; rows that repeat a doc_id
share a component; a null doc_id is linked with nothing, its component is null and it isn't kept; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.llm.common import drop_scratch, read_table, scratch, sized_broadcast, trimmed
from quantloom.llm.graph import components

#: Percent of the union that the intersection must reach.
PERCENT = 80
BANDS, BAND_ROWS = 32, 4
SPACE_BITS = 20
#: Largest bucket whose pairs are all compared (at most half as many for each member); in larger ones, those that share a rare difference from the
#: centre, which costs a row for each of a member's differences. At this size both cost about the same; the result doesn't depend on it.
SMALL = 64
WORDS_HELD = 200_000
SETS_HELD = 64

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, runs of other than space and \\t to \\r."""
    return (text or "").encode().lower().split()


def shingle_set(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    """The full set, of the words themselves."""
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


class WordHashes(dict):
    """word -> 64-bit hash; forgets when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def shingles(self, text: str | None, k: int) -> np.ndarray:
        """Sorted distinct 64-bit shingle hashes."""
        words = words_of(text)
        if len(self) > WORDS_HELD:
            self.clear()
        own = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        n = max(len(own) - k + 1, 1) if len(own) else 0
        width = min(k, len(own))
        out = np.full(n, np.uint64(len(own) if len(own) < k else k))
        for i in range(width):
            out = mix(out * _M1 + own[i : i + n])
        return np.unique(out)


class Circulant:
    """K = bands * rows coordinates from two permutations of [0, D)."""

    def __init__(self, bands: int = BANDS, rows: int = BAND_ROWS, bits: int = SPACE_BITS, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.k, self.bands, self.rows, self.mask = bands * rows, bands, rows, np.uint64((1 << bits) - 1)
        self.sigma = rng.permutation(1 << bits).astype(np.int32)
        pi = rng.permutation(1 << bits).astype(np.int32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: self.k]]), self.k)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Coordinate c is the least pi[(sigma(x) + c) mod D] over the elements x."""
        at = self.sigma[(shingles & self.mask).astype(np.int64)]
        least = self.windows[at[:4096]].min(axis=0)
        for start in range(4096, len(at), 4096):
            least = np.minimum(least, self.windows[at[start : start + 4096]].min(axis=0))
        return least

    def band_values(self, signature: np.ndarray) -> np.ndarray:
        own = signature.reshape(self.bands, self.rows).astype(np.uint64)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for i in range(self.rows):
            out = mix(out * _M1 + own[:, i])
        return out.view(np.int64)

    @staticmethod
    def remains(signature: np.ndarray) -> np.ndarray:
        """The last four bits of each coordinate, sixteen in a number."""
        padded = np.zeros(-(-len(signature) // 16) * 16, np.uint64)
        padded[: len(signature)] = signature & 15
        return (padded.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def agreeing(a: Column, b: Column, bands: int = BANDS, rows: int = BAND_ROWS) -> Column:
    """How many coordinates may be equal, from their remains."""
    differ = F.lit(0)
    for i in range(-(-bands * rows // 16)):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        some = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        differ = differ + F.bit_count(some.bitwiseAND(F.lit(0x1111111111111111)))
    return F.lit(bands * rows) - differ


def least_agreeing(percent: int, k: int) -> int:
    """5.5 standard deviations below what a pair at the threshold agrees in."""
    p = percent / 100 + (1 - percent / 100) / 16
    return int(p * k - 5.5 * (p * (1 - p) * k) ** 0.5)


SIGNED = "doc_id long, th long, n long, set_key binary, bands array<long>, remains array<long>"
_SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("remains", pa.list_(pa.int64()))])


def _keyed(frame: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th (a hash of the text, which tells rows of a repeated doc_id apart), text."""
    text = F.col(text_col).cast("string")
    return frame.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def signatures(frame: DataFrame, k: int, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """frame: doc_id, th, text. Set size, a digest of the set and the band values of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, circulant, none = WordHashes(), Circulant(bands, rows), np.zeros(0, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                ids, ths, own = batch.slice(start, 1024).columns
                sizes, keys, values, remains = [], [], [], []
                for text in own:
                    shingles = hashes.shingles(text.as_py(), k)
                    sizes.append(len(shingles))
                    keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                    signature = circulant.signature(shingles) if len(shingles) else None
                    values.append(none if signature is None else circulant.band_values(signature))
                    remains.append(none if signature is None else circulant.remains(signature))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate(x))) for x in (values, remains)]
                yield pa.RecordBatch.from_arrays([ids, ths, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), *lists], schema=_SIGNED_ARROW)

    return frame.mapInArrow(trimmed(run), SIGNED)


class _Sets:
    """Hashes and full shingle sets of the last few texts, by (doc_id, th)."""

    def __init__(self, k: int):
        self.k, self.words, self.held, self.full = k, WordHashes(), OrderedDict(), OrderedDict()

    def _get(self, held: OrderedDict, key: tuple, make: Callable[[], object]):
        if key in held:
            held.move_to_end(key)
        else:
            held[key] = make()
            if len(held) > SETS_HELD:
                held.popitem(last=False)
        return held[key]

    def hashes(self, key: tuple, text: pa.Scalar) -> np.ndarray:
        return self._get(self.held, key, lambda: self.words.shingles(text.as_py(), self.k))

    def set(self, key: tuple, text: pa.Scalar) -> set:
        return self._get(self.full, key, lambda: shingle_set(words_of(text.as_py()), self.k))


def linked(a: set, b: set, percent: int) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


COMPARED = "a long, ath long, b long, bth long, linked boolean, delta array<long>"
_COMPARED_ARROW = pa.schema([*((c, pa.int64()) for c in ("a", "ath", "b", "bth")), ("linked", pa.bool_()), ("delta", pa.list_(pa.int64()))])


def compare(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs: a, ath, b, bth of classes, wide. Whether their full sets reach the threshold, and, of wide pairs, the hashes in which they differ.

    pairs must be materialised: it is read three times.
    """
    ends = pairs.select(F.col("a").alias("doc_id"), F.col("ath").alias("th")).unionAll(pairs.select("b", "bth")).distinct()
    ends = scratch(ends, "mh-ends")
    wanted = docs.join(sized_broadcast(ends), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])
    held = scratch(wanted, "mh-texts")
    one = held.select(F.col("doc_id").alias("a"), F.col("th").alias("ath"), F.col("text").alias("atext"))
    two = held.select(F.col("doc_id").alias("b"), F.col("th").alias("bth"), F.col("text").alias("btext"))
    sides = pairs.join(two, ["b", "bth"]).join(one, ["a", "ath"]).select("a", "ath", "b", "bth", "wide", "atext", "btext")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(k)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch, hits, deltas = whole.slice(start, 512), [], []
                for a, ath, b, bth, wide, atext, btext in zip(*batch.columns, strict=True):
                    one, two = (a.as_py(), ath.as_py()), (b.as_py(), bth.as_py())
                    x, y = sets.hashes(one, atext), sets.hashes(two, btext)
                    differ = np.setxor1d(x, y, assume_unique=True)
                    both = (len(x) + len(y) - len(differ)) // 2
                    hit = 100 * both >= percent * (both + len(differ))
                    hits.append(hit and linked(sets.set(one, atext), sets.set(two, btext), percent))
                    deltas.append(differ.view(np.int64) if wide.as_py() else None)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hits, pa.bool_()), pa.array(deltas, pa.list_(pa.int64()))], schema=_COMPARED_ARROW)

    out = scratch(sides.mapInArrow(trimmed(run), COMPARED), "mh-compared")
    drop_scratch(pairs.sparkSession, ends, held)
    return out


def _near_sizes(n: Column, m: Column, percent: int) -> Column:
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def _difference_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components under one centre that share a rare enough difference from it.

    members: a, ath (the centre), an, b, bth, n, component, linked (with the centre), delta.
    """
    spark = members.sparkSession
    q = (100 - percent) / (100 + percent)
    d = F.size("delta")
    excess, own = d - q * F.col("n"), q * F.col("an")

    def prefix(least: Column) -> Column:
        return (d - F.greatest(F.lit(1), F.ceil(least / 2 - 1e-6)) + 1).cast("int")

    # near: enough for partners that aren't linked with the centre; far: for any partner
    rows = members.withColumns({"near": prefix(excess + own), "far": prefix(excess - own), "d": d, "excess": excess})
    rows = rows.select("a", "ath", "b", "bth", "n", "component", "linked", "near", "far", "d", "excess", F.explode("delta").alias("s"))
    # differences in which a pair may meet; all others come first in the order, whatever their frequency
    shared = rows.groupBy("a", "ath", "s").agg(F.count("*").alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("linked").alias("all_linked"))
    shared = scratch(shared.where("lo < hi and not all_linked").select("a", "ath", "s", "f"), "mh-shared-differences")
    each = W.partitionBy("a", "ath", "b", "bth")
    ranked = rows.join(shared, ["a", "ath", "s"]).withColumn("place", F.col("d") - F.count("*").over(each) + F.row_number().over(each.orderBy("f", "s")))
    ranked = scratch(ranked.where((F.col("place") <= F.col("near")) | (~F.col("linked") & (F.col("place") <= F.col("far")))).withColumn("left", F.col("d") - F.col("place") + 1).drop("d", "f"), "mh-differences")
    names = ("b", "bth", "n", "component", "linked", "near", "place", "left", "excess")
    one = ranked.where("not linked").select("a", "ath", "s", *(F.col(c).alias(f"x_{c}") for c in names))
    two = ranked.where("place <= near").select("a", "ath", "s", *(F.col(c).alias(f"y_{c}") for c in names))
    first = (F.col("x_b") < F.col("y_b")) | ((F.col("x_b") == F.col("y_b")) & (F.col("x_bth") < F.col("y_bth")))
    once = F.col("y_linked") | ((F.col("x_place") <= F.col("x_near")) & first)
    # at the first difference that a pair shares, what is left must hold all that it has to share
    enough = F.least("x_left", "y_left") >= (F.col("x_excess") + F.col("y_excess")) / 2 - 1e-6
    met = one.join(two, ["a", "ath", "s"]).where(enough & (F.col("x_component") != F.col("y_component")) & _near_sizes(F.col("x_n"), F.col("y_n"), percent) & once)
    ends = (("x_b", "a"), ("x_bth", "ath"), ("y_b", "b"), ("y_bth", "bth"))
    turned = (("y_b", "a"), ("y_bth", "ath"), ("x_b", "b"), ("x_bth", "bth"))
    found = met.select(*(F.when(first, F.col(c)).otherwise(F.col(d)).alias(name) for (c, name), (d, _) in zip(ends, turned, strict=True)))
    out = scratch(found.distinct(), "mh-difference-pairs")
    drop_scratch(spark, shared, ranked)
    return out


def _pairs_of(rows: DataFrame, key: str, percent: int, least: int) -> DataFrame:
    """Pairs of different components under one key; rows: key, doc_id, th, n, component, remains."""
    several = rows.groupBy(key).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(key)
    own = rows.join(several, key)
    one = own.select(key, F.col("doc_id").alias("a"), F.col("th").alias("ath"), F.col("n").alias("an"), F.col("component").alias("ac"), F.col("remains").alias("ar"))
    two = own.select(key, F.col("doc_id").alias("b"), F.col("th").alias("bth"), F.col("n").alias("bn"), F.col("component").alias("bc"), F.col("remains").alias("br"))
    likely = agreeing(F.col("ar"), F.col("br")) >= least
    met = one.join(two, key).where((F.col("ac") < F.col("bc")) & _near_sizes(F.col("an"), F.col("bn"), percent) & likely)
    return met.select("a", "ath", "b", "bth").distinct()


def near_duplicates(frame: DataFrame, shingle: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, th, n_shingles, component_id, kept: one row per row of frame."""
    spark = frame.sparkSession
    docs = _keyed(frame, id_col, text_col)
    signed = scratch(signatures(docs, shingle, bands, rows), "mh-signed")
    usable = signed.where("set_key is not null and doc_id is not null")
    first = (F.first(c).alias(c) for c in ("n", "bands", "remains"))
    classes = usable.groupBy("set_key").agg(F.min(F.struct("doc_id", "th")).alias("rep"), *first)
    classes = scratch(classes.select("set_key", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th"), "n", "bands", "remains"), "mh-classes")
    least = least_agreeing(percent, bands * rows)

    # buckets of several classes; every class beside the centre of each of its buckets
    entries = classes.select("doc_id", "th", F.explode("bands").alias("bucket"))
    counts = entries.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    entries = scratch(entries.join(counts, "bucket"), "mh-entries")
    central = entries.groupBy("doc_id", "th").agg(F.sum("m").alias("shared"))
    bare, entries = entries, scratch(entries.join(classes.select("doc_id", "th", "n", "remains").join(central, ["doc_id", "th"]), ["doc_id", "th"]), "mh-shared")
    drop_scratch(spark, bare)
    me = F.struct(-F.col("shared"), "doc_id", "th", "n", "remains")
    centres = scratch(entries.groupBy("bucket").agg(F.min(me).alias("c")), "mh-centres")
    likely = _near_sizes(F.col("n"), F.col("c.n"), percent) & (agreeing(F.col("remains"), F.col("c.remains"), bands, rows) >= least)
    stars = entries.join(centres, "bucket").where((F.col("c.doc_id") != F.col("doc_id")) | (F.col("c.th") != F.col("th")))
    stars = stars.select(F.col("c.doc_id").alias("a"), F.col("c.th").alias("ath"), F.col("doc_id").alias("b"), F.col("th").alias("bth"), likely.alias("likely"), (F.col("m") > SMALL).alias("wide"))
    stars = scratch(stars.where("likely or wide").groupBy("a", "ath", "b", "bth").agg(F.max("likely").alias("likely"), F.max("wide").alias("wide")), "mh-stars")
    met = compare(stars, docs, shingle, percent)
    # rows of a repeated doc_id share a component
    own = signed.where("doc_id is not null").select(F.col("doc_id").alias("a"), "set_key")
    same = own.join(classes.select("set_key", F.col("doc_id").alias("b")), "set_key").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    labels = scratch(components(met.where("linked").select("a", "b")), "mh-labels")

    # buckets that still hold several components
    label = labels.withColumnRenamed("node", "doc_id")
    few = entries.where(F.col("m") <= SMALL).drop("shared").join(label, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    few = scratch(few, "mh-few")
    pairs = _pairs_of(few, "bucket", percent, least)
    wide = met.where("delta is not null").drop("wide")
    mixed = scratch(wide.where("not linked").select("a", "ath").distinct(), "mh-mixed")  # a hot centre's members are split over it
    sizes = classes.select("doc_id", "th", "n")
    wide = wide.join(sized_broadcast(mixed), ["a", "ath"]).join(sizes.toDF("a", "ath", "an"), ["a", "ath"]).join(sizes.toDF("b", "bth", "n"), ["b", "bth"])
    wide = scratch(wide.join(labels.toDF("b", "component"), "b", "left").withColumn("component", F.coalesce("component", "b")), "mh-wide")
    if wide.limit(1).count():
        pairs = pairs.unionAll(_difference_pairs(wide, percent)).distinct()
    done = met.select("a", "ath", "b", "bth").unionAll(met.select("b", "bth", "a", "ath"))
    rest = scratch(pairs.join(done, ["a", "ath", "b", "bth"], "left_anti").withColumn("wide", F.lit(False)), "mh-rest")
    more = compare(rest, docs, shingle, percent)
    stars_so_far = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))  # not the links again: components are stars by now
    found = components(stars_so_far.unionAll(more.where("linked").select("a", "b")).unionAll(same.select("a", "b")))
    drop_scratch(spark, few, wide, mixed, rest, stars, centres, labels, entries, met)
    component = F.coalesce("component", "doc_id")
    return signed.join(found.withColumnRenamed("node", "_node"), F.col("doc_id") == F.col("_node"), "left").select(
        "doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )


def drop_near_duplicates(frame: DataFrame, shingle: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of frame for each group of near duplicates (its smallest id), with all columns.

    Rows that repeat both id and text count as one; rows with a null id stay.
    """
    groups = near_duplicates(frame, shingle, percent, id_col, text_col)
    first = groups.where("kept").groupBy(F.col("doc_id").alias("doc")).agg(F.min("th").alias("th"))
    keyed = frame.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("th"))
    kept = keyed.where("doc is not null").join(first, ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"])
    return kept.unionByName(keyed.where("doc is null")).select(*(F.col("row").getField(c).alias(c) for c in frame.columns))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=2).drop("th")


_WORDS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
ORACLE_SQL = {
    "op1_near_duplicates": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS shared
  FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * shared >= 80 * (an + bn - shared)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, top) AS (SELECT doc_id, doc_id FROM s UNION SELECT g.a, r.top FROM r JOIN g ON g.b = r.node WHERE r.top < g.a),
c AS (SELECT node, min(top) AS component FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component AS component_id, s.doc_id = c.component AS kept FROM s JOIN c ON c.node = s.doc_id"""
}
QUERIES = {"op1_near_duplicates": op1_near_duplicates}
