"""Operator 5: line dedup by an exact set-similarity join, with DataFrame operations only.

A line's tokens are its distinct words. Lines are in order of (id, hash of the text, line number), null ids last; a line
is removed if an earlier line has the same words or a Jaccard similarity of num / den or more. Lines without words stay.

Equal lines are one class, known by a 128-bit hash; its first line stands for it. Tokens are ordered by rarity: all
tokens of the corpus are counted in 131,072 hash buckets, and a token's place is its bucket's level, then its hash. With
n tokens, a line is indexed by its first n - ceil(n * num / den) + 1 tokens, which two similar lines must share one of.

Near copies of one line are settled first. A class is compared with the earliest class that has the same token, for four
of its index tokens from the rarest to the commonest; where many classes are near that one, those without a match yet
are compared with the first few of them too. So the pairs of a group of copies are not listed. The classes of a token
that occurs more than HOT times, as its level tells, are dealt into so many groups that each stays below about that.

The classes without an earlier match so far are open, and each meets every earlier class in the index. Entries that meet must
pass the length filter, the positional filter (what is shared up to this position and after it can be enough) and a
parity sketch of 64 bits, 128 for long lines, which must not differ in more bits than similar lines have tokens apart. A
pair must then share as many index tokens as two similar lines must. Pairs that remain are verified on their words, for
each class the most promising one first; pairs of which both ends were settled by those are not looked at.

Defined results: null text stays null; empty texts stay empty; rows with the same id and text are one document, and
decisions hold for all of them; a text of which all lines go becomes empty; other columns are carried along.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType

from quarryflow.sources.scratch import temporary_tables

from .common import BROADCAST_BYTES, Scratch, hinted

SPACE = r"[\x20\x09-\x0D]+"
SOLID = r"[^\x20\x09-\x0D]"
#: White space that a pattern must look for. Most texts have none of it and are split at single characters.
RARE = ("\t", "\x0b", "\f", "\r")
#: A token's code: its level, then its hash, in 63 bits.
BUCKET_BITS, HASH_BITS, STEPS = 17, 55, 6
NUM, DEN = 3, 4
#: Lines of more tokens have sketches of twice the bits; up to here 64 bits tell strangers apart, also from a line of a
#: third more tokens: strangers of 70 and 90 tokens differ in no more than the allowed 22 of 64 bits once in sixty times.
LONG = 40
#: From so many classes near the first one of a token on, a class is compared with the first LEADERS of them before it
#: enters the join.
CROWD, LEADERS = 16, 64
HOT = 1 << 20


def _has(text: Column, *parts: str) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(c)) for c in parts))


def _words(line: Column) -> Column:
    """The words of a text without line feeds, with empty strings among them."""
    return F.when(_has(line, *RARE), F.split(line, SPACE)).otherwise(F.split(line, " "))


def _distinct(line: Column, of: Callable[[Column], Column]) -> Column:
    """of(word) of a line's words, each once. Only lines with white space at an end or doubled can have empty strings."""
    odd = _has(line, "  ", *RARE) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    every = lambda by: F.array_distinct(F.transform(F.split(line, by), of))
    return F.when(odd, F.array_remove(every(SPACE), of(F.lit("")))).otherwise(every(" "))


def _bucket(code: Column) -> Column:
    return F.shiftrightunsigned(code, HASH_BITS - BUCKET_BITS).cast("int")


def _code(word: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(word), 64 - HASH_BITS)


def _levels(words: DataFrame) -> Column:
    """A constant array of fixed size with a level for each bucket, in the upper bits of a code: STEPS for each doubling
    of the codes counted in it, 255 at most."""
    counts = words.select(F.explode("codes").alias("code")).groupBy(_bucket(F.col("code")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    levels = [0] * (1 << BUCKET_BITS)
    for r in counts.collect():
        levels[r["bucket"]] = min(255, int(STEPS * math.log2(1 + r["n"]))) << HASH_BITS
    return F.from_json(F.lit(json.dumps(levels, separators=(",", ":"))), "array<long>")


def _groups(token: Column) -> Column:
    """Into how many groups the classes of a token are dealt, by the count that its level stands for."""
    return F.greatest(F.lit(1), F.pow(F.lit(2.0), F.shiftrightunsigned(token, HASH_BITS) / STEPS - math.log2(HOT)).cast("int"))


def _hashes(line: Column) -> Column:
    return _distinct(line, lambda w: F.xxhash64(w))


def _described(words: DataFrame, levels: Column) -> DataFrame:
    """Each line with its class (h, h2), number of tokens, parity sketch and first tokens in the order."""
    placed = lambda x: F.get(levels, _bucket(x)).bitwiseOR(x)
    ordered = words.select("id", "th", "at", "h", "h2", F.sort_array(F.transform("codes", placed)).alias("tokens"))
    flip = lambda one, x: F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)).cast("int"))
    nil, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    parity = F.aggregate("tokens", nil, lambda bits, x: bits.bitwiseXOR(flip(one, x)))
    odd = F.aggregate("tokens", nil, lambda bits, x: bits.bitwiseXOR(flip(F.shiftrightunsigned(x, 6).bitwiseAND(one), x)))
    n = F.size("tokens")
    prefix = n - _least(n) + 1
    return ordered.select("id", "th", "at", "h", "h2", n.alias("n"), parity.alias("parity"), F.when(n > LONG, odd).otherwise(nil).alias("odd"), F.slice("tokens", 1, prefix).alias("first"))


def _least(n: Column) -> Column:
    """Tokens that a line of n tokens shares with any similar line, at least."""
    return F.floor((n * NUM + DEN - 1) / DEN).cast("int")


def _near(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Length filter and parity sketches. NUM + DEN times the largest symmetric difference is (DEN - NUM) times both
    sizes. For two long lines the tokens with an odd seventh bit and the others have sketches of their own."""
    differ = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    even = lambda side: side("parity").bitwiseXOR(side("odd"))
    bits = F.when((a("n") > LONG) & (b("n") > LONG), differ(even(a), even(b)) + differ(a("odd"), b("odd"))).otherwise(differ(a("parity"), b("parity")))
    return (F.least(a("n"), b("n")) * DEN >= F.greatest(a("n"), b("n")) * NUM) & (bits * (NUM + DEN) <= (a("n") + b("n")) * (DEN - NUM))


def _ages(docs: DataFrame) -> Column:
    """A number from 0 to 511 that never falls from a document to a later one: the id's place between the least and the
    greatest, where ids are numbers, and the last for null ids. Documents of one number may stand in either order."""
    kind = docs.schema["id"].dataType
    if not isinstance(kind, (IntegralType, FractionalType)):
        return F.lit(0)
    low, high = docs.agg(F.min("id").cast("double"), F.max("id").cast("double")).first()
    if low is None or not low < high < math.inf or low == -math.inf:
        return F.lit(0)
    place = F.floor((F.col("id").cast("double") - F.lit(low)) / F.lit(high - low) * 510)
    return F.coalesce(F.greatest(F.least(place, F.lit(510)), F.lit(0)), F.lit(511))


def _candidates(stands: DataFrame, age: Column) -> DataFrame:
    """Pairs (ha, hb) of an open class and an earlier one that pass the filters, and c, the index tokens that they share;
    where age does not tell which is earlier, one of them is open, and two open classes give one pair."""
    index = stands.select("h", "n", "parity", "odd", "open", age.cast("long").alias("age"), F.posexplode("first").alias("at", "token"))
    # Size (28 bits), age (9), position (26) and state in one number, which keeps the exchange narrow.
    packed = F.shiftleft(F.col("n").cast("long"), 36) + F.shiftleft(F.col("age"), 27) + F.col("at").cast("long") * 2 + F.col("open").cast("long")
    index = index.select("token", "h", "parity", "odd", packed.alias("packed"))

    def unpacked(side: str) -> Callable[[str], Column]:
        p = F.col(f"{side}.packed")
        parts = {
            "n": F.shiftrightunsigned(p, 36).cast("int"),
            "age": F.shiftrightunsigned(p, 27).bitwiseAND(F.lit((1 << 9) - 1)),
            "at": F.shiftrightunsigned(p, 1).bitwiseAND(F.lit((1 << 26) - 1)).cast("int"),
            "open": p.bitwiseAND(F.lit(1)) == 1,
        }
        return lambda c: parts.get(c, F.col(f"{side}.{c}"))

    a, b = unpacked("a"), unpacked("b")
    both = a("n") + b("n")
    shared = F.least(a("at"), b("at")) + F.least(a("n") - a("at"), b("n") - b("at"))
    # In one expression, so that no part of it moves below the exchange and both sides read the same one.
    either = a("open") & (~b("open") | (a("h") < b("h")))
    once = F.when(a("age") < b("age"), b("open")).otherwise((a("age") == b("age")) & either)
    met = index.alias("a").join(index.alias("b"), (a("token") == b("token")) & once & _near(a, b) & (shared * (NUM + DEN) >= both * NUM))
    counted = met.groupBy(a("h").alias("ha"), b("h").alias("hb"), a("n").alias("na"), b("n").alias("nb")).agg(F.count(F.lit(1)).alias("c"))
    # Of the prefix that ends first, all tokens that the lines share are in the other prefix too.
    needed = F.ceil((F.col("na") + F.col("nb")) * NUM / (NUM + DEN)) + 1 - F.greatest(_least(F.col("na")), _least(F.col("nb")))
    return counted.where(F.col("c") >= needed).select("ha", "hb", "c")


def _later(pairs: DataFrame, docs: DataFrame, stands: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(h, h2) of the later class of each pair whose words are similar."""
    wanted = scratch.write(pairs.select(F.explode(F.array("ha", "hb")).alias("h")).distinct(), f"{name}-wanted")
    chosen = stands.join(hinted(wanted, 8), "h", "left_semi").groupBy("id", "th").agg(F.collect_list(F.struct("at", "h", "h2")).alias("parts"))
    chosen = scratch.write(chosen.withColumnsRenamed({"id": "cid", "th": "cth"}), f"{name}-chosen")
    held = docs.join(hinted(chosen, 64 + 40 * F.size("parts")), F.col("id").eqNullSafe(F.col("cid")) & (F.col("th") == F.col("cth")))
    rows = held.select("id", "th", F.split("text", "\n").alias("lines"), F.explode("parts").alias("p")).select("p.h", "p.h2", F.struct(F.col("id").isNull().alias("last"), "id", "th", "p.at").alias("place"), _hashes(F.get("lines", F.col("p.at"))).alias("words"))
    texts = scratch.write(rows.dropDuplicates(["h", "h2"]), f"{name}-texts")
    side = lambda h, k: texts.select(F.col("h").alias(h), F.col("h2").alias(f"{k}2"), F.col("place").alias(f"p{k}"), F.col("words").alias(f"w{k}"))
    both = pairs.join(side("ha", "a"), "ha").join(side("hb", "b"), "hb")
    counted = both.select("ha", "a2", "pa", "hb", "b2", "pb", (F.size("wa") + F.size("wb")).alias("total"), F.size(F.array_intersect("wa", "wb")).alias("shared"))
    found = counted.where(F.col("shared") * (NUM + DEN) >= F.col("total") * NUM)
    ends = lambda k: F.struct(F.col(f"h{k}").alias("h"), F.col(f"{k}2").alias("h2"))
    return scratch.write(found.select(F.when(F.col("pa") < F.col("pb"), ends("b")).otherwise(ends("a")).alias("k")).select("k.*").distinct(), name)


def _by_best_partner(pairs: DataFrame, docs: DataFrame, stands: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, h2) of the later class of each similar pair. One similar earlier class is enough, so each class is compared first
    with the one that it shares most index tokens with, and then only pairs are left in which an end was not settled so."""
    ends = pairs.select(F.col("ha").alias("h"), F.col("hb").alias("other"), "c").union(pairs.select("hb", "ha", "c"))
    best = ends.groupBy("h").agg(F.max_by("other", F.struct("c", "other")).alias("other"))
    best = scratch.write(best.select(F.least("h", "other").alias("ha"), F.greatest("h", "other").alias("hb")).distinct(), "best")
    found = _later(best, docs, stands, scratch, "more")
    gone = hinted(found.select("h").distinct(), 8)
    pairs = pairs.select(F.least("ha", "hb").alias("ha"), F.greatest("ha", "hb").alias("hb"))
    left = [pairs.join(gone.withColumnRenamed("h", c), c, "left_anti").select("ha", "hb") for c in ("ha", "hb")]
    rest = scratch.write(left[0].union(left[1]).distinct().join(hinted(best, 16), ["ha", "hb"], "left_anti"), "rest")
    return found.union(_later(rest, docs, stands, scratch, "more2")).distinct()


def removed_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, th, gone array<int>): numbers of the lines that go. docs: id, th (a hash of the text), text."""
    raw = docs.select("id", "th", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.col("line").rlike(SOLID))
    raw = raw.withColumns({"h": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), F.col("line"))})
    place = F.struct(F.col("id").isNull().alias("last"), "id", "th", "at")
    lines = scratch.write(raw.drop("line"), "lines")
    repeated = lines.groupBy("h", "h2").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    repeated = scratch.write(repeated, "repeated")
    # Where the first lines can be told by a broadcast, no copy is split into words; else copies go when they are described.
    small = repeated.count() * 64 <= BROADCAST_BYTES
    firsts = lambda df: df.join(hinted(repeated, 64), ["h", "h2"], "left").where(F.col("place").isNull() | (place == F.col("place"))).drop("place")
    with temporary_tables():
        codes = _distinct(F.col("line"), _code).alias("codes")
        words = Scratch(docs.sparkSession, "words").write((firsts(raw) if small else raw).select("id", "th", "at", "h", "h2", codes), "words")
        described = _described(words, _levels(words))
        stands = scratch.write(described if small else firsts(described), "stands")

    entry = F.struct(place.alias("place"), "h", "n", "parity", "odd")
    size = F.size("first")
    ends = F.array_distinct(F.array(F.get("first", F.lit(0)), F.get("first", F.floor(size / 4).cast("int")), F.get("first", F.floor(size / 2).cast("int")), F.get("first", size - 1)))
    keyed = stands.select(entry.alias("x"), F.explode(ends).alias("token"))
    # Two columns, not a struct, so that rows are sorted by the token's number.
    t = ["token", "part"]
    keyed = keyed.select("x", "token", F.pmod("x.h", _groups(F.col("token"))).alias("part"))
    by_token = Window.partitionBy(*t).orderBy("x")
    fits = (F.col("x.h") != F.col("y.h")) & _near(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
    led = keyed.select(*t, "x", F.first("x").over(by_token).alias("y"), F.row_number().over(by_token).alias("nth")).withColumn("fits", fits)
    led = led.withColumn("many", F.sum(F.col("fits").cast("int")).over(Window.partitionBy(*t)))
    as_pairs = lambda df: df.where(fits).select(F.col("y.h").alias("ha"), F.col("x.h").alias("hb")).distinct()
    led = scratch.write(led.where((F.col("many") >= CROWD) | F.col("fits")), "led")
    settled = _later(scratch.write(as_pairs(led), "near"), docs, stands, scratch, "settled")
    open_only = lambda df, k: df.join(hinted(settled.select(F.col("h").alias("sh")), 8), F.col(f"{k}.h") == F.col("sh"), "left_anti")
    crowded = led.where(F.col("many") >= CROWD)
    heads = crowded.where(F.col("nth").between(2, LEADERS)).select(*t, F.col("x").alias("y"))
    met = open_only(crowded.select(*t, "x"), "x").join(heads, t).where(F.col("y") < F.col("x"))
    settled = settled.union(_later(scratch.write(as_pairs(met), "near2"), docs, stands, scratch, "settled2")).distinct()

    marked = stands.join(hinted(scratch.write(settled.withColumn("settled", F.lit(True)), "settled-all"), 24), ["h", "h2"], "left").withColumn("open", F.col("settled").isNull())
    more = _by_best_partner(scratch.write(_candidates(marked, _ages(docs)), "pairs"), docs, stands, scratch)

    later = settled.union(more).distinct().withColumn("later", F.lit(True))
    decided = scratch.write(repeated.join(later, ["h", "h2"], "full").select("h", "h2", "place", F.coalesce("later", F.lit(False)).alias("later")), "decided")
    gone = lines.join(hinted(decided, 96), ["h", "h2"]).where(F.col("later") | (place != F.col("place"))).select("id", "th", "at")
    return scratch.write(gone.groupBy("id", "th").agg(F.collect_set("at").alias("gone")), "gone")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the text's later matches removed, and n_lines, n_removed (both 0 for null text)."""
    scratch = Scratch(df.sparkSession, "lines")
    th = F.xxhash64(text_col)
    gone = removed_lines(df.select(F.col(id_col).alias("id"), th.alias("th"), F.col(text_col).alias("text")), scratch)
    gone = gone.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    joined = df.withColumn("__h", th).join(hinted(gone, 64 + 8 * F.size("__gone")), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    lines = F.split(text_col, "\n")
    kept = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("__gone", i)), "\n"))
    counts = [F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed")]
    own = [kept.alias(c) if c == text_col else F.col(c) for c in df.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*own, *counts)
