"""Document fingerprints by SimHash, next documents in id order, and a search by permuted block tables.

Terms are pairs of neighbouring words.  Every occurrence votes with its length on the 128 bits of its hash;
a bit is set where more than half of the weight is for it.  Votes are counted two per long (32 bits each), so
one aggregation with partial sums does all of it and a text never leaves the task that splits it.
Only built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import WORD

LANES = 32
_MASK = (1 << 32) | 1
#: Parts of the id range found from approximate quantiles (a list of that many numbers reaches the driver).
SEGMENTS = 1024
#: Documents per block in which neighbours are found.
BLOCK_ROWS = 64


def _terms(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))


def vote(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per key with the two longs `hi` and `lo` of its fingerprint.

    A null text, or one without words, has no votes: both longs are 0.  Equal texts have equal fingerprints.
    """
    terms = rows.select(*keys, F.explode_outer(_terms(F.col(text))).alias("t"))
    a, b = F.col("t")["a"], F.col("t")["b"]
    terms = terms.select(
        *keys, F.xxhash64(a, b).alias("h0"), F.xxhash64(F.lit(1), a, b).alias("h1"),
        F.coalesce(F.length(a) + F.coalesce(F.length(b), F.lit(0)), F.lit(0)).cast("long").alias("w"),
    )
    # two votes of 32 bits in each long
    lane = lambda h, i: F.sum(F.shiftright(F.col(h), i).bitwiseAND(F.lit(_MASK)) * F.col("w")).alias(f"{h}_{i}")
    counted = terms.groupBy(*keys).agg(F.sum("w").alias("w"), *[lane(h, i) for h in ("h0", "h1") for i in range(LANES)])

    def bits(h: str) -> Column:
        out = F.lit(0).cast("long")
        for i in range(LANES):
            low, high = F.col(f"{h}_{i}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(F.col(f"{h}_{i}"), 32)
            out = out.bitwiseOR(F.shiftleft((low * 2 > F.col("w")).cast("long"), i)).bitwiseOR(F.shiftleft((high * 2 > F.col("w")).cast("long"), i + LANES))
        return out

    return counted.select(*keys, bits("h0").alias("hi"), bits("h1").alias("lo"))


def as_text(hi: Column, lo: Column) -> Column:
    """32 hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(hi: Column, lo: Column, other_hi: Column, other_lo: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(other_hi)) + F.bit_count(lo.bitwiseXOR(other_lo))


def likeness(*longs: Column) -> Column:
    return F.lit(1.0) - distance(*longs) / F.lit(128.0)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add the next document in descending order of the key: `next_text`; `block`, `place` name the row, `next_block`, `next_place` the next.

    The last document is followed by the first.  Equal keys stand by a hash of their text; null keys come
    last.  The table is cut into blocks of the id range; each block also gets a copy of the first row of
    the block after it, so texts are shuffled once and no window holds more than a block.
    """
    docs = docs.select(key, text).withColumn("_tie", F.xxhash64(text))
    size = docs.agg(F.count("*").alias("n"), F.percentile_approx(key, [i / SEGMENTS for i in range(SEGMENTS + 1)], 10_000).alias("q")).first()
    bounds = sorted(set(size["q"] or [0]))
    many = max(1, -(-size["n"] // (BLOCK_ROWS * max(1, len(bounds) - 1))))
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    segment = F.greatest(F.size(F.filter(edges, lambda e: e <= F.col(key))), F.lit(1))
    start, end = F.element_at(edges, segment), F.try_element_at(edges, segment + 1)
    inner = F.coalesce(F.floor((F.col(key) - start).cast("double") * many / (end - start)), F.lit(0))
    within = F.least(F.greatest(inner, F.lit(0)), F.lit(many - 1)).cast("long")
    block = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(segment.cast("long") * many + within)
    placed = docs.withColumn("block", block)
    first = F.max_by(F.struct(key, text, "_tie"), F.struct(F.coalesce(key, F.lit(-(2**63))), "_tie")).alias("_first")
    heads = placed.groupBy("block").agg(first)
    order = placed.select("block").distinct()
    row = Window.orderBy(F.desc("block"))
    before = F.coalesce(F.lag("block").over(row), F.last("block").over(row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    order = order.select(F.col("block"), before.alias("_to"))
    ghosts = heads.join(order, "block").select(F.col("_to").alias("block"), "_first.*", F.col("block").alias("_home")).withColumn("_ghost", F.lit(True))
    both = placed.withColumns({"_home": F.col("block"), "_ghost": F.lit(False)}).unionByName(ghosts)
    line = Window.partitionBy("block").orderBy("_ghost", F.desc_nulls_last(key), F.desc("_tie"))
    both = both.withColumns({
        "place": F.row_number().over(line), "next_text": F.lead(text).over(line), "next_block": F.lead("_home").over(line),
        "_boundary": F.lead("_ghost").over(line),
    })
    both = both.withColumn("next_place", F.when(F.col("_boundary"), F.lit(1)).otherwise(F.col("place") + 1))
    return both.where(~F.col("_ghost")).drop("_ghost", "_tie", "_home", "_boundary")


def edited_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`with_next` and `edited`: the last third of the text replaced by the head of the next one."""
    rows = with_next(docs.select(key, F.coalesce(text, F.lit("")).alias(text)), key, text)
    third = F.floor(F.length(text) / 3).cast("int")
    head = F.when(third > 0, F.substring(F.col("next_text"), F.lit(1), third)).otherwise(F.lit(""))
    return rows.withColumn("edited", F.concat(F.substring(F.col(text), F.lit(1), F.length(text) - third), head))


def near(prints: DataFrame, key: str, radius: int, hi: str = "hi", lo: str = "lo") -> DataFrame:
    """Pairs of different fingerprints within `radius` bits, each pair once, with members by fingerprint.

    Equal fingerprints are one class, named by its smallest key, so copies are not paired with each other.
    The 128 bits are cut into radius + 2 blocks; two fingerprints within the radius agree on at least two
    blocks, so a table per pair of blocks (the permuted order that puts those two first) finds all of them.
    Returns (a, b, distance) of class names; `classes` gives membership.  Null or empty texts share the
    fingerprint 0 and so one class.
    """
    named = classes(prints, key, hi, lo).select(F.col("class"), hi, lo).distinct()
    parts = radius + 2
    cuts = [128 * i // parts for i in range(parts + 1)]
    binary = F.concat(F.lpad(F.bin(hi), 64, "0"), F.lpad(F.bin(lo), 64, "0"))
    blocks = [F.substring(F.col("_bits"), cuts[i] + 1, cuts[i + 1] - cuts[i]) for i in range(parts)]
    orders = [F.struct(F.lit(i * parts + j).alias("order"), F.concat(blocks[i], F.lit("/"), blocks[j]).alias("prefix")) for i in range(parts) for j in range(i + 1, parts)]
    rows = named.withColumn("_bits", binary).select("class", hi, lo, F.explode(F.array(*orders)).alias("t")).select("class", hi, lo, "t.*")
    left = rows.select(F.col("class").alias("a"), F.col(hi).alias("_ah"), F.col(lo).alias("_al"), "order", "prefix")
    right = rows.select(F.col("class").alias("b"), F.col(hi).alias("_bh"), F.col(lo).alias("_bl"), "order", "prefix")
    apart = distance(F.col("_ah"), F.col("_al"), F.col("_bh"), F.col("_bl"))
    met = left.join(right, ["order", "prefix"]).where("a < b").withColumn("distance", apart).where(F.col("distance") <= radius)
    return met.select("a", "b", "distance").distinct()


def classes(prints: DataFrame, key: str, hi: str = "hi", lo: str = "lo") -> DataFrame:
    """Add `class`, the smallest key with the same fingerprint."""
    least = prints.groupBy(hi, lo).agg(F.min(key).alias("class"))
    return prints.join(least, [hi, lo])
