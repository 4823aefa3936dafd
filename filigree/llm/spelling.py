"""Spelling variants: pairs of words one edit apart, by merging light subtrees of a trie.

The trie of all words exists as rows: a node is the hash of a prefix, an edge a node and the next
character. The edge that most words take is heavy, the others are light; a word has at most
log2(words) light edges on its way, because each at least halves the words below. Where a word takes a
light edge, it is moved, once with that character replaced by a wildcard or by the heavy character, once with it skipped,
and once behind the heavy character, as its subtree is merged into its siblings' or its parent's (small to large).
Moved words that end where another word ends are one edit apart, and all such pairs are found: two words part
at one node, and at most one of them takes its heavy edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.common import discard, table, written

#: Maximal runs of these characters are words.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Words of fewer code points or occurrences don't count.
MIN_CHARS, MIN_COUNT = 5, 3
#: One run in so many loses a character, by the checksum of document and run.
NOISE = 97
#: Nodes so deep at most are joined by broadcast: 1 + 90 + 90 * 90 of them, with 90 letters.
TOP = 2
#: Stands for any character; no word holds it.
WILD = "\u0000"


def word_counts(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: words with a lost character here and there, and how often each occurs."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(f"({LETTERS})"))).alias("run"))
    runs = runs.where(F.length("run") >= min_chars).withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    run, at = F.col("run"), (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    made = runs.select(F.when(F.col("h") % NOISE == 0, cut).otherwise(run).alias("word")).where(F.length("word") >= min_chars)
    return made.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def light_edges(words: DataFrame) -> DataFrame:
    """word, n, i, heavy: where a word leaves its node, i characters from its beginning, by a light edge, and the heavy character there.

    Edges are rows of fixed size: a word that is very long makes many rows, but none of them holds it. Prefixes with
    equal hashes would be one node, which costs a move or two and loses none, because moved words are compared whole.
    """
    word, starts = F.col("word"), F.sequence(F.lit(1), F.length("word"))
    each = F.transform(starts, lambda i: F.struct((i - 1).alias("i"), F.xxhash64(F.substring(word, F.lit(1), i - 1)).alias("node"), F.substring(word, i, F.lit(1)).alias("char")))
    edges = words.select(F.xxhash64("word").alias("w"), F.explode(each).alias("e")).select("w", "e.*")
    weights = edges.groupBy("node", "char").agg(F.count("*").alias("below"), F.min("i").alias("depth"))
    # a node whose words all leave by one character has no light edge
    heaviest = weights.groupBy("node").agg(F.max_by("char", F.struct("below", "char")).alias("heavy"), F.count("*").alias("ways"), F.min("depth").alias("depth")).where("ways > 1")
    heavy = written(heaviest.select("node", "heavy", "depth"))
    # near the root few nodes, some 8,200 at most, hold all words; they are sent to the edges
    top = edges.where(F.col("i") <= TOP).join(F.broadcast(heavy.where(F.col("depth") <= TOP).select("node", "heavy")), "node")
    deep = edges.where(F.col("i") > TOP).join(heavy.select("node", "heavy"), "node")
    light = top.unionByName(deep).where("char != heavy").select("w", "i", "heavy")
    return words.withColumn("w", F.xxhash64("word")).join(light, "w").drop("w")


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb), both ways round, for all pairs of different words (word, n) that are one edit apart."""
    light = written(light_edges(words))
    word, i, heavy = F.col("word"), F.col("i"), F.col("heavy")
    head, tail, rest = F.substring(word, F.lit(1), i), F.substring(word, i + 2, F.length(word)), F.substring(word, i + 1, F.length(word))
    moves = light.select(F.col("word").alias("a"), F.col("n").alias("na"), F.explode(F.array(F.concat(head, heavy, tail), F.concat(head, tail), F.concat(head, heavy, rest))).alias("b"))
    # a word that is its parent with one character more, the heavy one too
    last = words.select(F.col("word").alias("a"), F.col("n").alias("na"), F.expr("substring(word, 1, length(word) - 1)").alias("b"))
    ends = moves.unionByName(last).where("a != b").distinct().join(words.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    # light siblings meet under a wildcard: no more of them than there are characters
    merged = light.select("word", "n", F.concat(head, F.lit(WILD), tail).alias("under"))
    siblings = merged.select(F.col("word").alias("a"), F.col("n").alias("na"), "under").join(merged.select(F.col("word").alias("b"), F.col("n").alias("nb"), "under"), "under").where("a != b")
    one_way = ends.select("a", "na", "b", "nb").unionByName(siblings.select("a", "na", "b", "nb"))
    back = one_way.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb"))
    pairs = written(one_way.unionByName(back).distinct())
    discard(light)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last, by doubling the distance in each round.

    A form occurs twice as often as its word at least, so a chain is shorter than 63 and six rounds do.
    """
    at = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved = not after.where("moved").isEmpty()
        discard(at)
        at = after.drop("moved")
        at._filigree_path = after._filigree_path
        if not moved:
            return at


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the texts; see the module.

    Null and empty texts have no words; texts are read whole. Repeated rows count each. A row without doc_id
    takes the empty string in its checksum, whatever the id's type. Of near words that occur equally often the first
    in code-point order is the form. An empty table gives no rows. Other columns are neither read nor returned.
    """
    words = written(word_counts(docs))
    pairs = one_edit_pairs(words)
    better = F.when(F.col("nb") >= 2 * F.col("na"), F.struct((-F.col("nb")).alias("n"), F.col("b").alias("word")))
    near = written(pairs.groupBy("a").agg(F.count("*").alias("n_near"), F.min(better).alias("f")).select(F.col("a").alias("word"), "n_near", F.col("f.word").alias("form"), (-F.col("f.n")).alias("form_n")))
    discard(pairs)
    last = roots(near.where("form is not null"))
    return words.join(near, "word", "left").join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


QUERIES = {"op11_spelling": op11_spelling}
ORACLES: dict[str, str] = {}
