"""Near-duplicates by likeness of word shingles, over SimHash fingerprints.

Two texts are near if the Jaccard likeness of their sets of five-word shingles is 0.8 or more. Balls around
SimHash fingerprints, as in simhash, give the first candidates. Alone they miss most such pairs, whose fingerprints
differ in 10 of 64 bits on average, far beyond what balls can cover. So more candidates come from MinHash keys, the
distance of fingerprints throws out those of them that can't be near, and the shingles decide on all.

A text has a key for each band, made of the least values of its shingles under as many hash functions
as a band has rows; texts of likeness s share a key with probability 1 - (1 - s**rows)**bands, which is
0.99997 at 0.8 on each of LEVELS. Under one key, each text is compared with the one that meets most others,
the star. Where that leaves more than one component, each text outside the largest one, the main component, is
compared with all texts of other components, but for pairs that bitmaps of their shingles prove to be apart.
Where more texts are outside than the next level has bands (SMALL), that would be more looks at pairs than the
key's texts have keys to list there; they go to that level, whose keys are stricter, so that they fall into smaller groups. On the
last level nothing is left out whatever the size. From the second level on, stars too meet only texts of other components that bitmaps leave possible.
So no candidate is dropped, and copies of one original cost one comparison each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, bound_batches, discard, materialize, materialize_by
from .components import connected_components
from .simhash import fingerprint, links as ball_links, shingle_hashes

WIDTH, LIKENESS = 5, 0.8
#: Rows and bands of each level.
LEVELS = ((4, 20), (8, 64), (16, 400))
#: Keys with up to so many texts outside their main component are compared in full on the first level; on the next
#: ones as many more as the level after has more bands (64, then 400).
SMALL = 64
#: Texts of likeness 0.8 have fingerprints that differ in more bits with probability 0.000002.
FAR = 24
#: Pairs of one text that are compared in one task.
TOGETHER = 256
#: Longs of a text's bitmap of shingles.
WORDS = 16


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted. Words are between ASCII white space, A-Z in
    lower case; fewer words than WIDTH: all of them; no word at all: one value for all such texts."""
    parts = list(shingle_hashes(text, WIDTH))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(1, np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets as sorted arrays, which aren't empty."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def bitmap(hashes: np.ndarray) -> list[int]:
    """WORDS signed longs; each hash of a set sets the bit that its lowest bits name."""
    bits = np.zeros(WORDS * 64, np.uint8)
    bits[(hashes % np.uint64(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64).tolist()


class Bands:
    """Keys of sets of hashes on one level."""

    def __init__(self, rows: int, bands: int):
        r = np.random.default_rng(rows)
        self.rows, self.bands, self.step = rows, bands, max(1, (1 << 18) // (rows * bands))
        self.factors = r.integers(0, 1 << 63, (rows * bands, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.masks = r.integers(0, 1 << 63, (rows * bands, 1), np.uint64)

    def keys(self, hashes: np.ndarray) -> list[int]:
        """A key for each band, as signed longs."""
        import xxhash

        least = np.full(self.rows * self.bands, np.iinfo(np.uint64).max)
        for at in range(0, len(hashes), self.step):
            np.minimum(least, ((hashes[at : at + self.step] ^ self.masks) * self.factors).min(1), out=least)
        rows = least.reshape(self.bands, self.rows)
        return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64).view(np.int64).tolist()


def text_hash(text: Column) -> Column:
    """What tells texts apart; a null text counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def distinct_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """h, row: of the rows with the same text the one with the smallest id (nulls last), of equal ids the
    one whose other columns hash least. Kept in buckets by h, so that joins on h don't move texts."""
    others = [c for c in docs.columns if c != text_col]
    tie = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in others]))) if others else F.lit(0)
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), tie.alias("tie"))
    tagged = docs.select(text_hash(F.col(text_col)).alias("h"), order.alias("o"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return materialize_by(tagged.groupBy("h").agg(F.min_by("row", "o").alias("row")), "h", "rows")


def _keyed(texts: DataFrame, rows: int, bands: int) -> DataFrame:
    """h, fp, size (shingles), bits (their bitmap), keys of texts (h, text)."""

    def compute(batch_rows):
        level = Bands(rows, bands)
        for hashes, found in batches(batch_rows, ["h", "text"]):
            sets = [shingle_set(t) for t in found]
            fps = np.array([fingerprint([s]) for s in sets], np.uint64).view(np.int64)
            longs = pa.list_(pa.int64())
            bits, keys = ([f(s) for s in sets] for f in (bitmap, level.keys))
            columns = [pa.array(hashes, pa.int64()), pa.array(fps), pa.array([len(s) for s in sets], pa.int64()), pa.array(bits, longs), pa.array(keys, longs)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "fp", "size", "bits", "keys"])

    return texts.select("h", "text").mapInArrow(compute, "h long, fp long, size long, bits array<long>, keys array<long>")


def _members(keyed: DataFrame) -> DataFrame:
    """h, fp, key, n for keys of n texts, two at least."""
    under = keyed.select("h", "fp", F.explode("keys").alias("key"))
    return under.join(under.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def _hopeful(pairs: DataFrame) -> DataFrame:
    """(a, b) once each, of pairs whose fingerprints don't rule out that they are near."""
    return pairs.where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= FAR).select("a", "b").distinct()


def _in_balls(keyed: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts whose fingerprints are equal or meet in balls: one text stands for each fingerprint."""
    least = keyed.groupBy("fp").agg(F.min("h").alias("least"))
    same = keyed.select("fp", "h").join(least, "fp").where("h != least").select(F.col("least").alias("a"), F.col("h").alias("b"))
    first, second = (least.select(F.col("fp").alias(x), F.col("least").alias(f"h_{x}")) for x in "ab")
    met = ball_links(least.select("fp")).join(first, "a").join(second, "b")
    return same.union(met.select(F.col("h_a").alias("a"), F.col("h_b").alias("b")))


def _stars(members: DataFrame) -> DataFrame:
    """Pairs of each text with the star of each of its keys: the text that meets most others."""
    met = members.join(members.groupBy("h").agg(F.sum("n").alias("met")), "h")
    star = met.groupBy("key").agg(F.max(F.struct("met", "h", "fp")).alias("s"))
    return _hopeful(met.join(star, "key").where("h != s.h").select(F.col("s.h").alias("a"), F.col("s.fp").alias("fa"), F.col("h").alias("b"), F.col("fp").alias("fb")))


def _rooted(rows: DataFrame, roots: DataFrame, of: str = "h", root: str = "root") -> DataFrame:
    """rows with the root of the text in column `of`."""
    return rows.join(roots.select(F.col("node").alias(of), F.col("root").alias(root)), of, "left").withColumn(root, F.coalesce(root, of))


def _parted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of keys whose texts are in several components: their columns, root, main (the component with
    most texts under the key), outside (how many texts under the key are in other ones)."""
    marked = _rooted(members, roots)
    counted = marked.groupBy("key", "root").agg(F.count("*").alias("m"))
    main = counted.groupBy("key").agg(F.max(F.struct("m", "root")).alias("x"), F.count("*").alias("r")).where("r > 1")
    return marked.join(main.select("key", F.col("x.root").alias("main"), F.col("x.m").alias("m")), "key").withColumn("outside", F.col("n") - F.col("m")).drop("m")


def _with_bits(parted: DataFrame, keyed: DataFrame) -> DataFrame:
    """parted with size and bits of its texts. They are a hundred bytes and more for each key of a text, so
    only what is left under keys of several components carries them."""
    return parted.join(keyed.select("h", "size", "bits"), "h")


def _may_be_near() -> Column:
    """False where bitmaps prove that a and b are apart. A bit that only one of two sets has stands for a
    shingle at least that the other one lacks, so the sets have at most the rest in common."""
    both = sum(F.bit_count(F.col("bits_a")[i].bitwiseAND(F.col("bits_b")[i])) for i in range(WORDS))
    common = F.least(F.col("over_a"), F.col("over_b")) + both
    return common * (1 + LIKENESS) >= (F.col("size_a") + F.col("size_b")) * LIKENESS - 1e-6


def _side(x: str) -> list[Column]:
    """Columns of one text of a pair, as _may_be_near and _hopeful take them; over: its shingles beyond one for each
    of its bits."""
    over = F.col("size") - sum(F.bit_count(F.col("bits")[i]) for i in range(WORDS))
    return [F.col("h").alias(x), F.col("fp").alias(f"f{x}"), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}"), over.alias(f"over_{x}")]


def _parted_at_once(keyed: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    """The columns of _members and _parted, and star, the text of main with most links. Texts get their roots
    before their keys are listed, so that keys and texts meet once."""
    ends = links.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count("*").alias("met"))
    rooted = _rooted(keyed.select("h", "fp", "keys"), roots).join(ends, "h", "left")
    under = rooted.select("h", "fp", "root", F.coalesce("met", F.lit(0)).alias("met"), F.explode("keys").alias("key"))
    counted = under.groupBy("key", "root").agg(F.count("*").alias("m"), F.max(F.struct("met", "h")).alias("s"))
    main = counted.groupBy("key").agg(F.max(F.struct("m", "root", "s")).alias("x"), F.sum("m").alias("n"), F.count("*").alias("r")).where("r > 1")
    outside = (F.col("n") - F.col("x.m")).alias("outside")
    return under.drop("met").join(main.select("key", "n", outside, F.col("x.root").alias("main"), F.col("x.s.h").alias("star")), "key")


def _stars_apart(parted: DataFrame, keyed: DataFrame) -> DataFrame:
    """Pairs that may be near of each text outside the main component of a key and the key's star. What is
    linked already isn't compared again."""
    pairs = parted.where("root != main").select(F.col("star").alias("a"), F.col("h").alias("b")).distinct()
    return _hopeful(pairs.join(keyed.select(*_side("a")), "a").join(keyed.select(*_side("b")), "b").where(_may_be_near()))


def _open(parted: DataFrame) -> DataFrame:
    """Pairs under one key of texts in different components that may be near: each text outside the main
    component with each text of another one. Pairs that can't be near never leave the join."""
    left = parted.where("root != main").select("key", *_side("a"), F.col("root").alias("ra"))
    right = parted.select(F.col("key").alias("_key"), *_side("b"), F.col("root").alias("rb"), (F.col("root") == F.col("main")).alias("in_main"))
    return _hopeful(left.join(right, (F.col("key") == F.col("_key")) & (F.col("ra") != F.col("rb")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & _may_be_near()))


def _near(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose likeness is LIKENESS or more. The text of b travels to that of a; a text with
    very many pairs is sent once for each TOGETHER of them."""

    def compare(rows):
        last = None, None
        for a, b, left, right in batches(rows, ["a", "b", "left", "right"]):
            near = []
            for x, y, s, t in zip(a, b, left, right):
                if last[0] != x:
                    last = x, shingle_set(s)
                if likeness(last[1], shingle_set(t)) >= LIKENESS:
                    near.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in near], pa.int64()) for k in (0, 1)], ["a", "b"])

    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("b"), F.col("shares")).cast("int")
    right = pairs.join(sizes, "a").select("a", F.col("b").alias("h"), share.alias("share")).join(texts.select("h", F.col("text").alias("right")), "h")
    left = texts.join(sizes.withColumnRenamed("a", "h"), "h").select(F.col("h").alias("_a"), F.col("text").alias("left"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("_share"))
    met = right.join(left, (F.col("a") == F.col("_a")) & (F.col("share") == F.col("_share")))
    return met.select("a", F.col("h").alias("b"), "left", "right").mapInArrow(compare, "a long, b long")


def components_of(texts: DataFrame, levels: tuple = LEVELS, small: int = SMALL) -> DataFrame:
    """(node, root) of all texts (h without repeats, text) that are near any other: root stands for what
    links reach."""
    links, roots = None, None

    def add(pairs: DataFrame) -> bool:
        """Whether the pairs give any link."""
        nonlocal links, roots
        pairs = materialize(pairs, "pairs")
        found = materialize(_near(pairs, texts), "links")
        discard(pairs)
        any_found = not found.isEmpty()
        if links is not None and any_found:
            found = materialize(links.union(found), "links")
        if links is None or any_found:
            links = found
            roots = connected_components(links)
        return any_found

    todo = texts
    for level, (rows, bands) in enumerate(levels):
        keyed = materialize(_keyed(todo, rows, bands), "keys")
        if level:
            parted = materialize(_parted_at_once(keyed, roots, links), "parted")
            if add(_stars_apart(parted, keyed)):
                before, now = parted, parted.select("h", "fp", "key", "n", "outside", F.col("main").alias("_main"))
                parted = materialize(_rooted(_rooted(now, roots), roots, "_main", "main"), "parted")
                discard(before)
        else:
            members = materialize(_members(keyed), "members")
            add(_in_balls(keyed).union(_stars(members)).distinct())
            parted = materialize(_parted(members, roots), "parted")
            discard(members)
        last = level == len(levels) - 1
        # no more looks at pairs under a key than rows that its texts would list on the next level
        closed = F.lit(True) if last else F.col("outside") <= small * levels[level + 1][1] // levels[1][1]
        large = parted.where(~closed)
        rest = None if last else materialize(large.join(large.where("root != main").select("key").distinct(), "key", "left_semi").select("h").distinct(), "rest")
        add(_open(_with_bits(parted.where(closed), keyed)))
        discard(parted)
        discard(keyed)
        if last or rest.isEmpty():
            return roots
        todo = texts.join(rest, "h", "left_semi")
    return roots


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, groups). rows: h, row, one for each different text (distinct_rows); groups: h, doc_id of that
    row, component_h, which stands for all texts that links of likeness LIKENESS reach."""
    bound_batches(docs.sparkSession)
    rows = distinct_rows(docs, id_col, text_col)
    texts = rows.select("h", F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).alias("text"))
    roots = components_of(texts)
    ids = rows.select("h", F.col(f"row.`{id_col}`").alias("doc_id"))
    return rows, ids.join(roots.withColumnRenamed("node", "h"), "h", "left").select("h", "doc_id", F.coalesce("root", "h").alias("component_h"))


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near-duplicates, with all its columns, whatever their names.

    Of a group's texts the one whose smallest id is smallest stays, a text without any id only where no other
    has one; of equal ids the one whose text hashes least; of rows with that text the one of distinct_rows.
    Different texts under one id are texts of their own, and equal rows are one. Null, empty and blank
    texts have no words and are one group. An empty table gives no rows. Texts are told apart by 64-bit
    hashes."""
    rows, groups = near_texts(docs, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = groups.groupBy("component_h").agg(F.min(order).alias("o")).select(F.col("o.h").alias("h"))
    return rows.join(first, "h", "left_semi").select("row.*")
