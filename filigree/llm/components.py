"""Distributed union-find, and links from buckets of similar things. DataFrames only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import discard, written

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Verifier:
    """How pairs of some ids are judged.

    confirm turns pairs (a, b) into those that are links. sketch turns ids (id) into (id, sketch);
    parts gives a sketch's values place by place, and likely(x, y) is false only where two sketches rule
    a link out. once(key, x, y) is true in one of the buckets that a pair shares. finer turns ids into
    (id, finer), longer sketches for where many pairs are expected, which closer(x, y) judges as likely does. close frees what was read.
    """

    confirm: Step
    sketch: Step
    parts: Callable[[Column], Column]
    likely: Callable[[Column, Column], Column]
    once: Callable[[Column, Column, Column], Column]
    finer: Step | None = None
    closer: Callable[[Column, Column], Column] = lambda x, y: F.lit(True)
    close: Callable[[], None] = lambda: None


#: A graph of so many edges at most is worked on in one partition, which needs no shuffles.
ONE_PARTITION = 300_000


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of links (a, b), where component is the smallest id reachable.

    Alternating stars: each vertex first hangs its larger neighbours, then its smaller ones, on
    the smallest of them, until every tree is a star. A vertex's neighbours are never gathered;
    they are joined with its minimum, so a hub is a skewed join, which adaptive execution splits.
    """
    a, b = F.col("a"), F.col("b")
    edges = written(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    few = edges.count() <= ONE_PARTITION

    def dealt(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if few else df

    before = None
    while True:
        e = dealt(edges)
        both = dealt(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(dealt(small.unionByName(least.select("u", F.col("m").alias("v")))).distinct())
        state = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(edges)
        edges = after
        if state == before or state[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        before = state


#: Bits of a sketch, of which two sets of similarity J agree in a share of (1 + J) / 2.
SKETCH_LONGS = 64


def fewest(n: int, p: float) -> int:
    """The agreements among n places, each likely to agree with chance p, below which a pair is left out.

    That is 4.5 standard deviations less than expected, which loses one of 300,000 links at the
    least similarity and none well above it.
    """
    return int(n * p - 4.5 * (n * p * (1 - p)) ** 0.5)


def bits_agree(percent: int) -> Callable[[Column, Column], Column]:
    """For sketches of SKETCH_LONGS longs, one bit of each of many minima."""
    bits = 64 * SKETCH_LONGS
    most = bits - fewest(bits, (1 + percent / 100) / 2)
    return lambda x, y: reduce(lambda s, t: s + t, (F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SKETCH_LONGS))) <= most


#: One id in SAMPLED is counted to find hot buckets, which are dealt to PARTS tasks; a bucket is hot
#: from about SAMPLED * HOT members on. This decides where rows go and nothing else; buckets beyond the MOST hottest go to one task each.
SAMPLED, HOT, PARTS, MOST = 256, 40, 64, 100_000
#: Members of a bucket that meet in one task at a time, and members of its largest component that the others are held against first.
BLOCK, PICKS = 1024, 4
#: Blocks are compared in so many turns at least, each of which shuffles its share, unless there are few rows.
TURNS, FEW_ROWS = 8, 50_000
#: Rows of mixed buckets that a turn works on, up to so many turns: each reads all sketches, and disks grow with the input.
ROWS_IN_TURN, MOST_TURNS = 100_000, 16


def dealt_members(members: DataFrame) -> DataFrame:
    """members (key, id) with the part of a hot bucket they go to, -1 in all others, dealt by both."""
    sample = members.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).groupBy("key").count()
    hot = sample.where(F.col("count") >= HOT).orderBy(F.desc("count"), "key").limit(MOST).select("key", F.lit(True).alias("hot"))
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PARTS))).otherwise(-1).cast("int")
    # hot has MOST rows at most, some 2 MB
    return members.join(F.broadcast(hot), "key", "left").select("key", "id", part.alias("part")).repartition("key", "part")


def linked(members: DataFrame | Sequence[DataFrame], prepare: Callable[[DataFrame], Verifier]) -> DataFrame:
    """(id, component) of the ids that a confirmed link reaches.

    members (key, id) says which ids share a bucket; prepare makes a verifier for the ids that do. Members may come in
    several tables without common keys, which are dealt one after the other, so that only one's shuffle is on disk.
    Any two members of a bucket end in one component or are found not to be linked, yet a
    bucket's pairs aren't all made: first every member is held against the smallest of its bucket, or
    of its part of a hot one. In buckets that then still hold several components, members are held
    against the most central one, to which edited copies of one text are all nearer than to each other, and
    those outside the largest component against a few members of that; in what is still mixed, against
    all members of other components, unless sketches rule a link out. Members that repeat do no harm.
    """

    def shared_of(some: DataFrame) -> DataFrame:
        dealt = dealt_members(some)
        first = dealt.groupBy("key", "part").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1 or part >= 0")
        return written(dealt.join(first, ["key", "part"]).select("key", "part", "id", "pivot"))

    dealt_in = [shared_of(m) for m in ([members] if isinstance(members, DataFrame) else members)]
    shared = reduce(DataFrame.unionByName, dealt_in)
    verifier = prepare(shared.select("id").distinct())
    pairs = shared.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    heads = shared.where("part >= 0 and id = pivot").select("key", "id")  # PARTS at most for each hot bucket
    pairs = pairs.unionByName(heads.join(heads.groupBy("key").agg(F.min("id").alias("a")), "key").where("id != a").select("a", F.col("id").alias("b")))
    found = components(verifier.confirm(pairs.distinct()))

    def mixed(rows: DataFrame) -> DataFrame:
        """(key, id, c) of rows in buckets with several components c."""
        named = rows.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
        keys = named.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 != c2")
        return named.join(keys.select("key"), "key").distinct()

    def with_largest(rows: DataFrame) -> DataFrame:
        """rows with the bucket's size n and its largest component."""
        sizes = rows.groupBy("key", "c").agg(F.count("*").alias("size")).groupBy("key").agg(F.sum("size").alias("n"), F.max_by("c", F.struct("size", "c")).alias("largest"))
        return rows.join(sizes, "key")

    def central(rows: DataFrame) -> DataFrame:
        """(key, a, ca): the member of each bucket whose sketch agrees most with what is most frequent place by place."""
        about = rows.join(sketches, "id").select("key", "id", "c", verifier.parts(F.col("sketch")).alias("values"))
        counted = about.select("key", F.posexplode("values").alias("place", "value")).groupBy("key", "place", "value").agg(F.count("*").alias("n"))
        modes = counted.groupBy("key", "place").agg(F.max_by("value", F.struct("n", "value")).alias("value"))
        # a bucket's modes are one short array, so members meet them as whole rows
        listed = modes.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("modes"))
        agree = F.size(F.filter(F.zip_with("values", "modes", lambda x, y: x == y), lambda same: same))
        best = about.join(listed, "key").groupBy("key").agg(F.max_by(F.struct("id", "c"), F.struct(agree.alias("m"), "id")).alias("p"))
        return best.select("key", F.col("p.id").alias("a"), F.col("p.c").alias("ca"))

    def against_picks(rows: DataFrame) -> DataFrame:
        """Links of members with their bucket's central one, and of those outside its largest component with a few of that."""
        picks = [F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(PICKS)]
        turns = min(MOST_TURNS, -(-rows.count() // ROWS_IN_TURN))

        def met(mine: DataFrame) -> DataFrame:
            some = mine.where("c = largest").groupBy("key", "largest").agg(F.array_distinct(F.array(*picks)).alias("picks")).select("key", F.explode("picks").alias("a"), F.col("largest").alias("ca"))
            # a bucket has PICKS + 1 of them at most; sketches ride with them and with members, not with pairs
            tops = central(mine).unionByName(some).join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a")
            about = mine.join(sketches, "id").select("key", F.col("id").alias("b"), "c", F.col("sketch").alias("sketch_b"))
            both = about.join(tops, "key").where((F.col("c") != F.col("ca")) & verifier.likely(F.col("sketch_a"), F.col("sketch_b")))
            return both.select("a", "b").distinct()

        def share(df: DataFrame, turn: int, *of: str) -> DataFrame:
            return df.where(F.pmod(F.xxhash64(*of, F.lit(2)), F.lit(turns)) == turn)

        if turns <= 1:
            return verifier.confirm(met(rows))
        # a bucket's rows are of one turn; pairs, which are small, are made distinct over all turns and confirmed in turns again
        found_in = [written(met(share(rows, turn, "key"))) for turn in range(turns)]
        pairs = reduce(DataFrame.unionByName, found_in)
        out = [written(verifier.confirm(share(pairs, turn, "a", "b").distinct())) for turn in range(turns)]
        discard(*found_in)
        parts.extend(out)
        return reduce(DataFrame.unionByName, out)

    def against_all(rows: DataFrame) -> DataFrame:
        """Links of those outside a bucket's largest component with members of any other component, in blocks and turns."""
        n = rows.count()
        turns = max(TURNS, min(MOST_TURNS, -(-n // ROWS_IN_TURN))) if n > FEW_ROWS else 1
        ids = rows.select("id").distinct()
        finer = written(verifier.finer(ids)) if verifier.finer else ids.withColumn("finer", F.lit(0))
        blocks = F.ceil(F.col("n") / BLOCK)
        about = rows.join(sketches, "id").join(finer, "id")
        own = ["id", "c", "sketch", "finer"]
        out = []
        for turn in range(turns):
            mine = F.pmod(F.xxhash64("key", "block"), F.lit(turns)) == turn
            rest = about.where("c != largest").select("key", "largest", *(F.col(c).alias(f"{c}_a") for c in own), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block")).where(mine)
            every = about.select("key", *(F.col(c).alias(f"{c}_b") for c in own), F.pmod(F.xxhash64("id"), blocks).alias("block")).where(mine)
            met = rest.join(every, ["key", "block"]).where("c_a != c_b and (c_b = largest or id_a < id_b)")
            met = met.where(verifier.likely(F.col("sketch_a"), F.col("sketch_b")) & verifier.once(F.col("key"), F.col("sketch_a"), F.col("sketch_b")))
            met = written(met.where(verifier.closer(F.col("finer_a"), F.col("finer_b"))).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct())
            out.append(written(verifier.confirm(met)))
            discard(met)
        discard(finer)
        parts.extend(out)
        return reduce(DataFrame.unionByName, out)

    left, sketches, parts = shared, None, []
    for links_of in (against_picks, against_all):
        old, left = left, written(with_largest(mixed(left)))
        discard(old, *dealt_in)
        if left.isEmpty():
            break
        sketches = sketches or written(verifier.sketch(left.select("id").distinct()))
        more = written(links_of(left))
        if not more.isEmpty():
            found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
        discard(more, *parts)
    discard(left, *([sketches] if sketches else []))
    verifier.close()
    return found
