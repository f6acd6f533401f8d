"""Tables of word patterns against texts: an inverted index of each pattern's rarest n-gram, candidates by equi-join, then verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed

GRAM, ANY = 3, "*"
WORD = r"[^\x20\x09-\x0D.,;:!?]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A text's words: runs without white space and ``.,;:!?``, A-Z lower-cased; null texts have none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def cut(texts: DataFrame, key: str, text: str, least: int = 5) -> DataFrame:
    """key, passage (from 1), words: the sentences of texts, from ``.``, ``!``, ``?`` or a line's end to the next, that have ``least`` words and more."""
    pieces = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"[.!?\n]", -1)).alias("passage", "piece"))
    return pieces.select(key, (F.col("passage") + 1).cast("bigint").alias("passage"), words(F.col("piece")).alias("words")).where(F.size("words") >= least)


def _grams(words: Column, size: Column | int) -> Column:
    """struct(at, gram) of all windows of ``size`` words, from 0."""
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.slice(words, i + 1, size).alias("gram"))))


def search(docs: DataFrame, patterns: DataFrame, id_col: str, text_col: str, words_col: str = "words", gram: int = GRAM, anything: str = ANY) -> DataFrame:
    """The columns of ``patterns`` but its words, with id and ``word``: every place (from 0) of a text at which a pattern's words stand, one row for each.

    A pattern is an array of words as ``words()`` gives them; ``anything`` stands for any one word. Its rarest ``gram`` words in a row over all texts (fewer, where
    wildcards leave fewer) are looked for; where they stand, the whole pattern is compared. What no text has costs nothing more. Any number of
    patterns; equal ones have rows of their own. A pattern of no word or wildcards only, and one with a null word, is found nowhere. Texts are told apart by id and
    content, so a repeated row counts once. The names of patterns' columns must not be ``id_col`` or ``word``.
    """
    keys = [c for c in patterns.columns if c != words_col]
    own = checkpointed(patterns.where(F.forall(words_col, lambda w: w.isNotNull())).select(F.struct(*keys).alias("__key"), F.col(words_col).alias("__p"), F.xxhash64(F.array_join(words_col, " ")).alias("__text")))
    # the longest stretch of words without a wildcard, up to ``gram``, decides how many words are looked for
    fits = [F.exists(_grams(F.col("__p"), n), lambda g: ~F.array_contains(g["gram"], anything)) for n in range(gram, 0, -1)]
    size = F.coalesce(*[F.when(f, n) for f, n in zip(fits, range(gram, 0, -1), strict=True)])
    own = own.withColumn("__size", size).where("__size is not null")
    seeds = own.dropDuplicates(["__p"]).select("__p", "__text", F.explode(_grams(F.col("__p"), F.col("__size"))).alias("g")).where(~F.array_contains("g.gram", anything))
    seeds = checkpointed(seeds.select("__p", "__text", F.col("g.at").alias("__off"), F.xxhash64("g.gram").alias("__g"), F.size("g.gram").alias("__n")))
    sizes = sorted(r[0] for r in seeds.select("__n").distinct().collect())  # ``gram`` numbers at most
    empty = docs.select(F.col(id_col)).limit(0).crossJoin(patterns.select(*keys).limit(0)).select(*keys, id_col, F.lit(0).cast("bigint").alias("word"))
    if not sizes:
        return empty
    texts = docs.where(F.col(text_col).isNotNull()).select(F.struct(F.col(id_col).alias("id")).alias("__id"), F.xxhash64(text_col).alias("__key_of"), words(F.col(text_col)).alias("__w"))
    windows = F.concat(*[F.coalesce(F.transform(_grams(F.col("__w"), n), lambda g, n=n: F.struct(g["at"].alias("at"), F.xxhash64(g["gram"]).alias("gram"))), F.lit([]).cast("array<struct<at:int,gram:bigint>>")) for n in sizes])
    found = texts.select("__id", "__key_of", F.explode(windows).alias("x")).select("__id", "__key_of", F.col("x.at").alias("__at"), F.col("x.gram").alias("__g"))
    wanted = seeds.select("__g").distinct()
    often = checkpointed(found.join(wanted, "__g", "left_semi").groupBy("__g").agg(F.count(F.lit(1)).alias("__often")))
    # a gram that no text has means that the pattern is nowhere
    rare = seeds.join(often, "__g", "left").groupBy("__p").agg(F.min(F.struct(F.coalesce("__often", F.lit(0)).alias("n"), F.col("__off"), F.col("__g"))).alias("r")).where("r.n > 0")
    index = checkpointed(rare.select("__p", F.col("r.__off").alias("__off"), F.col("r.__g").alias("__g")))
    places = found.join(index, "__g").select("__id", "__key_of", (F.col("__at") - F.col("__off")).alias("__start"), "__p").where("__start >= 0").distinct()
    places = checkpointed(places)
    compared = texts.join(places.select("__id", "__key_of").distinct(), ["__id", "__key_of"], "left_semi").dropDuplicates(["__id", "__key_of"]).join(places, ["__id", "__key_of"])
    window = F.slice("__w", F.col("__start") + 1, F.size("__p"))
    equal = (F.size(window) == F.size("__p")) & F.forall(F.zip_with(window, "__p", lambda a, b: (a == b) | (b == anything)), lambda x: x)
    hits = compared.where(equal).select(F.col("__id.id").alias(id_col), "__p", F.col("__start").cast("bigint").alias("word"))
    return hits.join(own.select("__key", "__p"), "__p").select(*[F.col(f"__key.{k}").alias(k) for k in keys], id_col, "word")
