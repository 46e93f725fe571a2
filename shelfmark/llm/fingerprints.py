"""One-permutation MinHash fingerprints with optimal densification, b-bit packed, in built-in functions.

Each word shingle is hashed once. The hash's top bits name one of `BINS` bins and a bin keeps its least hash,
which after sorting a text's hashes is the first of each run of one bin. An empty bin takes the value of the
first nonempty bin in a probing order of its own, the same for all texts. The low `BITS` bits of each value,
hashed with its bin's number, are packed into eight longs; the likeness of two fingerprints is the share of equal values, corrected for values
that agree by chance.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import bind, unused, words_of

WIDTH = 5
BINS = 128
BITS = 4
_SHIFT = 63 - 7
#: Bytes of text in one range of ids, on average, up to so many ranges; beyond that ranges grow, and their sorts spill.
RANGE_BYTES = 16 << 20
MOST_RANGES = 1 << 16
#: Rows sampled for each bound.
PER_RANGE = 20


def _probes(seed: int = 23) -> Column:
    """For each bin, the other bins in a seeded order; one constant of the plan."""
    orders = []
    for b in range(BINS):
        rest = [x for x in range(BINS) if x != b]
        random.Random(seed * 1000 + b).shuffle(rest)
        orders.append(rest)
    return F.from_json(F.lit(json.dumps(orders)), "array<array<int>>")


def shingle_hashes(words: Column) -> Column:
    """63-bit hashes of the runs of five words; of all words where there are fewer; none where there are none."""
    after = lambda i: [F.get(words, i + k) for k in range(1, WIDTH)]
    hashes = F.transform(words, lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *after(i)), 1))
    # entries past the last whole run hash fewer words
    return bind(hashes, lambda h: F.when(F.size(h) <= WIDTH, F.slice(h, 1, 1)).otherwise(F.slice(h, F.lit(1), F.size(h) - (WIDTH - 1))))


def packed_fingerprint(words: Column) -> Column:
    """Eight longs of sixteen 4-bit values each; an empty array where there are no words."""

    def least(s: Column) -> Column:
        of = lambda x: F.shiftright(x, _SHIFT)
        return F.filter(s, lambda x, i: (i == 0) | (of(x) != of(F.get(s, i - 1))))

    def densified(m: Column) -> Column:
        bins = F.transform(m, lambda x: F.shiftright(x, _SHIFT).cast("int"))

        def fill(bs: Column) -> Column:
            def value(b: Column) -> Column:
                own = F.array_position(bs, b)
                lent = F.array_position(bs, F.get(F.array_intersect(F.get(_probes(), b), bs), F.lit(0)))
                return F.get(m, (F.when(own > 0, own).otherwise(lent) - 1).cast("int"))

            return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)

        return F.when(F.size(m) == BINS, m).otherwise(bind(bins, fill))

    def pack(v: Column) -> Column:
        per = 64 // BITS
        # hashed anew with the bin's number, so that bins with one borrowed value do not agree by chance together
        low = F.transform(v, lambda x, i: F.xxhash64(x, i).bitwiseAND(2**BITS - 1))
        one = lambda u: lambda j: F.aggregate(F.slice(u, j * per + 1, F.lit(per)), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x))
        return bind(low, lambda u: F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), one(u)))

    filled = bind(bind(F.sort_array(shingle_hashes(words)), least), densified)
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(bind(filled, pack))


def as_text(packed: Column) -> Column:
    """A packed fingerprint as 128 lower-case hexadecimal digits; an empty one as an empty string."""
    return F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity that two packed fingerprints tell, 0 to 1; 1 for two empty ones, 0 for one."""

    def unequal(x: Column, y: Column) -> Column:
        def marks(z: Column) -> Column:
            any_bit = z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseOR(F.shiftrightunsigned(z, 3))
            return F.bit_count(any_bit.bitwiseAND(0x1111111111111111))

        return bind(x.bitwiseXOR(y), marks)

    apart = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / 2**BITS
    corrected = ((1 - apart / F.lit(float(BINS))) - chance) / (1 - chance)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), corrected)))


def fingerprinted(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `packed` (array of longs); a null text is an empty one, equal texts have equal fingerprints.

    A text of any length is hashed as a whole; a text without words has an empty array. Repeated rows stay, an empty table
    gives no rows, and columns may have any names; a `packed` of df is replaced.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c != "packed"]
    words = unused(df, "_words")
    base = df.select(*keep, words_of(F.col(f"`{text}`")).alias(words))
    return base.select(*keep, packed_fingerprint(F.col(words)).alias("packed"))


def _range_of(key: Column, bounds: Column, n: int) -> Column:
    """The index of the last bound that is at most key, by binary steps."""
    steps = [1 << k for k in reversed(range(max(1, n.bit_length())))]

    def step(at: Column, s: Column) -> Column:
        return F.when(F.coalesce(F.get(bounds, at + s) <= key, F.lit(False)), at + s).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def _bounds(places: DataFrame, n: int, ranges: int, seed: int = 31) -> list[str]:
    """Places that open ranges of about equal counts, as JSON in ascending order; the first is the least place of all.

    They are picked from a sample of about PER_RANGE rows a range, so what is sorted in one task and comes to the driver is
    bounded by MOST_RANGES whatever the table's size.
    """
    share = min(1.0, PER_RANGE * ranges / n)
    step = max(1, round(n * share / ranges))
    drawn = places if share == 1 else places.sample(share, seed)
    picked = drawn.withColumn("rn", F.row_number().over(Window.orderBy("place"))).where(F.col("rn") % step == 0).select("place")
    both = (picked if ranges > 1 else picked.limit(0)).unionByName(places.agg(F.min("place").alias("place"))).distinct()
    return [r[0] for r in both.orderBy("place").select(F.to_json("place")).collect()]


def with_next(df: DataFrame, columns: list[str], key: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """df with `next_` columns: those of the row that follows by ascending key; the first row follows the last.

    Rows are dealt by ranges of their place (key, then a hash of the text, null keys first), whose bounds are places of the
    table, so a key of many texts spreads over ranges. The row that opens a range is also sent to the range before,
    where it stands last; so one exchange of the rows is enough. A range is sorted with spilling and need not fit in
    memory. Rows alike in key and text follow each other in any order, in one range. Keys are of a type that JSON
    tells exactly (numbers, strings, dates). Texts may be of any length; an empty table gives no rows; columns may have
    any names, and `next_` columns of df with the same names are replaced.
    """
    place = F.struct(F.col(f"`{key}`").alias("k"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("h")).alias("place")
    new = [f"next_{c}" for c in columns]
    names = [c for c in df.columns if c not in new]
    n, volume = df.agg(F.count("*"), F.sum(F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long"))).first()
    ranges = min(MOST_RANGES, max(1, -(-(volume or 0) // range_bytes)))
    bounds = _bounds(df.select(place), n, ranges) if n else []
    kind = df.schema[key].dataType.simpleString()
    array = F.from_json(F.lit(f"[{','.join(bounds)}]"), f"array<struct<k:{kind},h:bigint>>")
    count = max(1, len(bounds))
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), place).withColumn("r", _range_of(F.col("place"), array, count))
    at = lambda r, guest: F.struct(r.alias("r"), F.lit(guest).alias("guest"))
    own, before = at(F.col("r"), False), at(F.pmod(F.col("r") - 1, F.lit(count)), True)
    opens = F.col("place").eqNullSafe(F.get(array, F.col("r")))
    dealt = row.select("row", "place", F.inline(F.when(opens, F.array(own, before)).otherwise(F.array(own))))
    # a range is a partition of its own, so no task gathers several
    dealt = dealt.repartitionById(count, F.col("r"))
    w = Window.partitionBy("r").orderBy("guest", "place")
    led = dealt.select("row", "guest", F.lead(F.struct(*[F.col("row").getField(c).alias(c) for c in columns])).over(w).alias("next"))
    return led.where(~F.col("guest")).select(*[F.col("row").getField(c).alias(c) for c in names], *[F.col("next").getField(c).alias(m) for c, m in zip(columns, new, strict=True)])


def edited(text: Column, n_chars: Column, following: Column) -> Column:
    """The text with its last half of code points replaced by as many of the following text's first, or all of them."""
    half = F.floor(n_chars / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n_chars.cast("int") - half), F.substring(following, F.lit(1), half))
