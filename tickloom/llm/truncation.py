"""Texts cut off by a field's limit or in transfer.

Two kinds of evidence are combined. Of length: a source's texts pile up at a
greatest length, in characters or in bytes; a text that stands there and does
not close with an end mark was cut. A text without a source is held against the
lengths of all sources. Of the ending, for the others: a trie of the corpus's
vocabulary says of the last token, before an ellipsis too, whether it is an
unknown proper prefix of known words (the text stops inside a word), a known
word (it stops in a sentence, unless the line is of a shape that pages end with,
such as a signature, which is learned too) or neither, such as a name nobody
else uses, which is no evidence. A text may also stop at a hyphen, an opening
mark or half a character.

The trie is a table with one row per node, keyed by the node's prefix, that
knows whether its prefix is a word and whether words go on below; only the
nodes that final tokens lead to are made. Looking tokens up is a join, so
neither vocabulary nor documents meet in one place.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.plans.storage import materialise

BLANKS = " \t\n\u000b\f\r"
BROKEN = "\u0001"  # stands where a word was broken at a line's end
#: Occurrences, other than as a text's last token, from which a word counts as known.
KNOWN_FROM = 3
#: A limit: at least so many texts within 4 units up to it, and so many times the average of the stretch before it.
PILE, PILE_RATIO, STRETCH = 5, 12.0, 400
#: A closing line's shape is learned from this share of the documents, and this many of them.
SHAPE_SHARE, SHAPE_LEAST = 0.002, 3


def vocabulary(texts: Column, df: DataFrame) -> DataFrame:
    """``word, n``: lower-case words of whole texts, without each text's last token and words broken at line ends."""
    joined = F.replace(F.rtrim(texts, F.lit("-" + BLANKS)), F.lit("-\n"), F.lit(BROKEN))
    words = F.split(F.lower(joined), rf"[^\p{{L}}{BROKEN}]+")
    words = df.select(F.explode(F.slice(words, 1, F.size(words) - 1)).alias("word")).where((F.col("word") != "") & ~F.contains("word", F.lit(BROKEN)))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def trie(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """``prefix, is_word, goes_on``: the nodes of the trie of ``word`` that a ``token`` leads to.

    Of each word only prefixes as long as some token are made (the distinct
    lengths of tokens pass through the driver), so that an endless run of
    letters in the vocabulary does not multiply.
    """
    asked = tokens.where("token IS NOT NULL").select(F.col("token").alias("prefix")).distinct()
    lengths = sorted(r["n"] for r in asked.select(F.length("prefix").alias("n")).distinct().collect())
    nodes = words.select("word", F.explode(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("word"))).alias("n")).select(F.expr("left(word, n)").alias("prefix"), (F.col("n") == F.length("word")).alias("ends"))
    return nodes.join(asked, "prefix", "left_semi").groupBy("prefix").agg(F.max("ends").alias("is_word"), F.max(~F.col("ends")).alias("goes_on"))


def length_limits(tails: DataFrame) -> DataFrame:
    """``source, unit, top``: lengths at which a source's texts pile up."""
    lengths = tails.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("x")).select("source", "x.*")
    sizes = lengths.groupBy("source", "unit", "size").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("source", "unit").orderBy("size")
    piled = sizes.select(
        "source", "unit", "size", "n",
        F.sum("n").over(order.rangeBetween(-3, 0)).alias("near"),
        F.coalesce(F.sum("n").over(order.rangeBetween(-STRETCH, -4)), F.lit(0)).alias("before"),
        F.coalesce(F.sum("n").over(order.rangeBetween(1, STRETCH)), F.lit(0)).alias("after"),
    )
    density = F.col("before") / (STRETCH - 3)
    # Few go beyond a limit; a block size of a transfer may be exceeded by the next block.
    top = (F.col("near") >= PILE) & (F.col("n") >= 2) & (F.col("near") >= PILE_RATIO * 4 * density) & (F.col("near") >= 4 * F.col("after"))
    # A stripped blank or half a character shortens a cut text by up to 3.
    marked = piled.withColumn("below_top", F.max(top).over(order.rangeBetween(0, 3))).withColumn("much", F.col("n") >= F.greatest(F.lit(3.0), PILE_RATIO * density))
    return marked.where(top | (F.col("below_top") & F.col("much"))).select("source", "unit", F.col("size").alias("top"))


def _shape(line: Column) -> Column:
    """Tokens with a digit become 9, single capitals I, words in capitals AA, other words A or a; marks stay."""
    line = F.regexp_replace(line, r"(?<![\p{L}\p{N}])\p{L}*+\p{N}[\p{L}\p{N}]*+", "9")  # each run of letters is read once
    line = F.regexp_replace(line, r"(?<!\p{L})\p{Lu}(?![\p{L}\p{N}])", "\u0001")
    line = F.regexp_replace(line, r"(?<!\p{L})\p{Lu}{2,}+(?!\p{L})", "\u0002")
    line = F.regexp_replace(line, r"\p{Lu}\p{L}++", "\u0003")
    line = F.regexp_replace(line, r"\p{L}++", "a")
    return F.translate(line, "\u0001\u0002\u0003", "IHA")


def text_tails(df: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """What the decision needs of each text: ``doc_id, source, chars, bytes, ending, token, shape``."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).where("text IS NOT NULL")
    bare = F.rtrim("text", F.lit(BLANKS))
    rows = rows.select("doc_id", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.right(bare, F.lit(2)).alias("last2"), F.substring_index(bare, "\n", -1).alias("line"))
    ending = (
        F.when(F.col("last2") == "", "empty")
        .when(F.col("last2").rlike(r"�$"), "broken")
        .when(F.col("last2").rlike(r"\p{L}-$"), "hyphen")
        .when(F.col("last2").rlike(r"\p{L}$"), "letter")
        .when(F.col("last2").rlike(r"[,;:(\[&“„«]$"), "open")
        .when(F.col("last2").rlike(r"(\.\.|…)$"), "dots")
        .when(F.col("last2").rlike(r"[.!?][^\p{L}\p{N}]?$"), "closed")
        .otherwise("other")
    )
    letter = F.col("ending") == "letter"
    token = F.when(letter, F.regexp_extract("line", r"(?<!\p{L})(\p{L}++)$", 1)).when(F.col("ending") == "dots", F.regexp_extract("line", r"(?<!\p{L})(\p{L}++)(?:\.\.\.|…)$", 1))
    return rows.withColumn("ending", ending).select("doc_id", "source", "chars", "bytes", "ending", F.nullif(F.lower(token), F.lit("")).alias("token"), F.when(letter, _shape(F.col("line"))).alias("shape"))


def truncated(df: DataFrame, doc_id: str, source: str, text: str, known_from: int = KNOWN_FROM) -> DataFrame:
    """``doc_id, source, evidence`` of every document whose text was cut; evidence is limit, broken, word or sentence.

    A null text or one of white space only is no cut text, nor is one that
    closes with an end mark, wherever it stands. A text with a null source may
    stand at any source's limit. A last token that is neither a word that
    occurs ``known_from`` times elsewhere nor the beginning of one is no
    evidence. Repeated documents come out as often as they occur, each judged
    by itself. Trailing white space or an ellipsis alone is no evidence. No
    documents give no rows. Whole lines are read, however long; other columns
    are not.
    """
    tails = materialise(text_tails(df, doc_id, source, text), "tails")
    tops = length_limits(tails.where("source IS NOT NULL AND ending <> 'empty'"))
    # The null source has the limits of all.
    limits = tops.withColumn("limited", F.explode(F.array("source", F.lit(None).cast(tops.schema["source"].dataType)))).groupBy("limited").agg(
        F.collect_set(F.when(F.col("unit") == "chars", F.col("top"))).alias("char_tops"), F.collect_set(F.when(F.col("unit") == "bytes", F.col("top"))).alias("byte_tops")
    )
    at = F.array_contains("char_tops", F.col("chars")) | F.array_contains("byte_tops", F.col("bytes"))
    rated = tails.where("ending NOT IN ('empty', 'closed')").join(limits, F.col("source").eqNullSafe(F.col("limited")), "left").withColumn("at_limit", F.coalesce(at, F.lit(False)))
    plain = rated.where("at_limit OR ending IN ('broken', 'hyphen', 'open')").select("doc_id", "source", F.when(F.col("at_limit"), "limit").when(F.col("ending") == "broken", "broken").otherwise("sentence").alias("evidence"))
    open_ = rated.where("NOT at_limit AND ending IN ('letter', 'dots')")
    often = max(SHAPE_LEAST, SHAPE_SHARE * tails.count())
    closing = open_.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).where(F.col("shape").rlike(r"[^aA\s]") & (F.col("n") >= often)).select("shape", F.lit(True).alias("closes"))
    words = vocabulary(F.col(text), df.where(F.col(text).isNotNull())).where(F.col("n") >= known_from).select("word")
    # Every final token is asked for, so that the trie does not wait for the limits.
    nodes = trie(words, tails.where("ending IN ('letter', 'dots')"))
    judged = open_.join(nodes, F.col("token") == F.col("prefix")).join(closing, "shape", "left")
    heading = F.col("shape").rlike("^[HI9\\W]*H[HI9\\W]*$")
    ended = judged.select("doc_id", "source", F.when(~F.col("is_word"), "word").when((F.col("ending") == "letter") & F.col("closes").isNull() & ~heading, "sentence").alias("evidence"))
    return plain.unionByName(ended.where("evidence IS NOT NULL"))


def truncation_rates(df: DataFrame, cut: DataFrame, source: str) -> DataFrame:
    """``source, n_docs, n_cut, rate`` for each source, null included."""
    whole = df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    found = cut.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("found"))
    return whole.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n_docs", F.coalesce("found", F.lit(0)).alias("n_cut"), (F.coalesce("found", F.lit(0)) / F.col("n_docs")).alias("rate"))
