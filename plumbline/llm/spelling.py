"""Spelling variants: words one letter apart, found with a bit-sliced position index, and the forms they stand for.

Two words one edit apart agree on two of three thirds of the shorter one (counted from the front before the
edit and from the back behind it).  So words meet by length of the shorter word, the pair of thirds and its letters;
a word of n letters meets words of n - 1, n and n + 1.  Within such a group an index holds, for every position and
letter, the set of the words that have it there, as the bits of one number.  A word is looked up with word-parallel recurrences:
the set of words without an error so far and the set with exactly one (a replaced letter at the same place, an
inserted one with the place shifted by one) are carried along its letters.  A deleted letter is the other word's inserted one.

Large groups are looked up in parts, each against the whole group's index in blocks.  A task hands on one row per
word of a group (its near words counted, the best of them), so pairs are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import salted_join
from plumbline.session import cut_lineage

# fixed values: what a run of letters is, the words that count, how much more frequent a form is
RUN = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, TIMES, DAMAGE = 7, 2, 10, 31
#: Words of a group that one task looks up, and words of one block of the index.
PART, BLOCK = 16_384, 8_192


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least seven letters that occur twice or more, over whole texts, after the damage of one run in 31.

    Only A-Z are lower-cased.  A null text has no words, a null key is an empty one, repeated rows count again, other columns
    are ignored.  Counts combine before the shuffle, so a frequent word is no single task.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(f"{RUN}{{{LEAST_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.explode(runs).alias("_run"))
    upper = "".join(map(chr, range(65, 91)))
    rows = rows.withColumn("_run", F.translate("_run", upper, upper.lower()))
    hash_ = F.crc32(F.concat("_key", F.lit(":"), "_run"))
    at = F.pmod(hash_, F.length("_run").cast("long")).cast("int")
    rows = rows.select(F.when(hash_ % DAMAGE == 0, F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))).otherwise(F.col("_run")).alias("word"))
    return rows.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def thirds(size: int) -> tuple[int, int]:
    """Lengths of the first and second third of a shorter word; the last third has the rest."""
    return size // 3, size // 3


def _keys(word: Column) -> Column:
    """The groups of a word: (length of the shorter word, which thirds, their letters)."""
    length, out = F.length(word), []
    for less in (0, 1):
        size = length - less
        third = F.floor(size / 3).cast("int")
        last = size - 2 * third
        front, back = (lambda n: F.substring(word, F.lit(1), n)), (lambda n, length=length: F.substring(word, length - n + 1, n))
        for kind, letters in ((0, front(2 * third)), (1, F.concat(front(third), back(last))), (2, back(third + last))):
            out.append(F.struct(size.alias("size"), F.lit(kind).alias("kind"), letters.alias("letters")))
    return F.filter(F.array(*out), lambda k: k["size"] >= LEAST_LENGTH)


class Index:
    """Bit-sliced position index of words of one length; a set of words is one whole number, word i its bit i."""

    def __init__(self, words: list[str]) -> None:
        self.size, self.every = len(words[0]), (1 << len(words)) - 1
        self.at: list[dict[str, int]] = [{} for _ in range(self.size)]
        for i, word in enumerate(words):
            bit = 1 << i
            for held, letter in zip(self.at, word, strict=True):
                held[letter] = held.get(letter, 0) | bit

    def near(self, word: str) -> list[int]:
        """Numbers of the words that are one replaced letter away (same length) or have one inserted letter more."""
        exact = self.every
        if self.size == len(word):
            one = 0
            for held, letter in zip(self.at, word, strict=True):
                here = held.get(letter, 0)
                one = (one & here) | (exact & ~here)
                exact &= here
                if not one and not exact:
                    break
        else:
            one = exact  # the letter more stands in front
            for held, shifted, letter in zip(self.at, self.at[1:], word, strict=False):
                exact &= held.get(letter, 0)
                one = (one & shifted.get(letter, 0)) | exact  # it stood before, or stands right here
                if not one:
                    break
        found = []
        while one:
            bit = one & -one
            found.append(bit.bit_length() - 1)
            one ^= bit
        return found


def _met_before(a: str, b: str, kind: int) -> bool:
    """Whether the pair stands together in a group of an earlier pair of thirds too."""
    size = min(len(a), len(b))
    first, second = thirds(size)
    last = size - first - second
    front, middle, back = a[:first] == b[:first], a[: first + second] == b[: first + second], a[len(a) - last :] == b[len(b) - last :]
    return kind > 0 and middle or kind > 1 and front and back


def _solve(size: int, kind: int, words: list[str], n: list[int], looked: list[bool]) -> dict[str, list]:
    """word -> [near words, largest n, that word] within a group; pairs are found from the word in `looked` that is the shorter or smaller one."""
    told: dict[str, list] = {}

    def tell(a: str, b: str, of_b: int) -> None:
        held = told.setdefault(a, [0, 0, ""])
        held[0] += 1
        if (-of_b, b) < (-held[1], held[2]):
            held[1:] = of_b, b

    short = [i for i, w in enumerate(words) if len(w) == size]
    queries = [i for i in short if looked[i]]
    long = [i for i, w in enumerate(words) if len(w) > size]
    for side in (short, long):
        for start in range(0, len(side) if queries else 0, BLOCK):
            block = side[start : start + BLOCK]
            index = Index([words[i] for i in block])
            for q in queries:
                word = words[q]
                for j in index.near(word):
                    other = block[j]
                    if (side is short and words[other] <= word) or _met_before(word, words[other], kind):
                        continue
                    tell(word, words[other], n[other])
                    tell(words[other], word, n[q])
    return told


def near_words(vocabulary: DataFrame, part: int = PART) -> DataFrame:
    """(word, n_near, near_n, near): words of (word, n), distinct, with near words; `near` is the most frequent, ties by code point.

    Words shorter than seven letters have none.  An empty vocabulary gives no rows.
    """
    rows = vocabulary.select("word", "n", F.explode(_keys(F.col("word"))).alias("_k")).select("word", "n", "_k.*")
    group = ["size", "kind", "letters"]
    sized = rows.groupBy(*group).agg(F.count("*").alias("_m"), F.max(F.length("word")).alias("_long"), F.min(F.length("word")).alias("_short"))
    # a group of one word, or of longer words only, holds no pair of its own
    sized = sized.where((F.col("_m") > 1) & (F.col("_short") == F.col("size"))).select(*group, F.ceil(F.col("_m") / part).cast("int").alias("_parts"))
    rows = rows.join(sized, group)
    # every part of a large group has all its words in the index and looks up its own
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    rows = rows.withColumn("looked", F.pmod(F.xxhash64("word"), F.col("_parts")) == F.col("part"))
    order = [*group, "part"]
    rows = rows.select(*order, "word", "n", "looked").repartition(*[F.col(c) for c in order]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, n, looked = None, [], [], []

        def batch() -> Iterator[pa.RecordBatch]:
            told = _solve(key[0], key[1], words, n, looked) if len(words) > 1 else {}
            if told:
                near, most, best = zip(*told.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(told)), pa.array(near, pa.int64()), pa.array(most, pa.int64()), pa.array(best)], ["word", "n_near", "near_n", "near"])

        for part in batches:
            for *now, word, count, look in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if now != key:
                    yield from batch()
                    key, words, n, looked = now, [], [], []
                words.append(word)
                n.append(count)
                looked.append(look)
        yield from batch()

    found = rows.mapInArrow(run, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n_near", (-F.col("_b.n")).alias("near_n"), F.col("_b.w").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), by doubling: the word that the forms lead to. Forms grow tenfold in n each step, so a few rounds do."""
    done = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = done.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = cut_lineage(salted_join(done, ahead, ["root"], "word", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if step.where("_moved").isEmpty():
            return step.select("word", "root")
        done = step.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `words`.

    `form` is the most frequent near word if it occurs at least ten times as often, else null; `root` the last of the
    forms from there, or the word itself.  Nulls, empty and very long texts and repeated rows count as `words` says;
    an empty table gives no rows.
    """
    vocabulary = cut_lineage(words(docs, key, text))
    near = near_words(vocabulary, part)
    rows = vocabulary.join(near, "word", "left")
    close = F.col("near_n") >= TIMES * F.col("n")
    rows = cut_lineage(rows.select(
        "word", F.when(close, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(close, F.col("near_n")).alias("form_n"),
    ))
    told = roots(rows.where("form is not null"))
    return rows.join(told, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
