"""Line deduplication by a log-template tree of fixed depth, in DataFrame functions only.

A line is parsed down a tree: its number of words, its first two words, then its words in four blocks. Words with a digit are
variable fields from the start. A leaf's template is the whole line; four more templates for each longer line leave
one block open, so a field that varies without digits is generalised too. A template recurs if it is found in enough different
texts. Lines with a recurring template are dropped, except in the first document that has it; a copy of a document loses all of them. Where document
deduplication follows, ``copies`` leaves that to it: of documents that would lose most of their words, those stay that are shown to be near duplicates
of the document that most of it comes from, and what recurs in third documents goes from them as it does from that one.

Texts are parsed once, to one row of numbers for each document. Keys of 60 bits are shuffled once to find those that recur and once, with
the document's place and the line's number, to meet them; never lines, until the lines to drop are joined to the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

LONG, SHORT, SLOTS, MOST_PERCENT = 8, 3, 8, 100
_NO_ID = 2**62  # codes of rows without an id begin here; they come last
_GAP = r"[\x20\x09-\x0D]+"
_VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def _key(text: Column) -> Column:
    """60 bits of MD5, as any SQL engine can compute them."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def templates(line: Column, long: int = LONG, short: int = SHORT) -> Column:
    """struct(n, keys): a line's number of words and its template keys, that of the whole line first."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, _VARIABLE, "<*>")).otherwise(line)
    words = F.split(F.trim(F.regexp_replace(masked, _GAP, " ")), " ")

    def built(words: Column) -> Column:
        n = F.size(words)
        head = F.array_join(F.slice(words, F.lit(1), F.lit(2)), " ")
        quarter = ((n - 2) / 4).cast("int")
        block = lambda i: F.array_join(F.slice(words, 3 + i * quarter, F.greatest(n - 2 - 3 * quarter, F.lit(0)) if i == 3 else quarter), " ")
        blocks = F.array(*[block(i) for i in range(4)])

        def keys(b: Column) -> Column:
            whole = F.concat_ws("|", n.cast("string"), head, *[b[i] for i in range(4)])
            open_ones = [F.concat_ws("|", n.cast("string"), head, *[F.lit("<*>") if i == j else b[i] for i in range(4)]) for j in range(4)]
            return F.when(n >= long + 2, F.array(_key(whole), *[_key(x) for x in open_ones])).when(n >= short, F.array(_key(whole))).otherwise(F.lit([]).cast("array<bigint>"))

        return F.struct(n.alias("n"), F.transform(F.array(blocks), keys)[0].alias("keys"))

    return F.transform(F.array(words), built)[0]


def parsed(docs: DataFrame, id_col: str, text_col: str, long: int = LONG, short: int = SHORT) -> DataFrame:
    """row, code, doc_id, text_key, xs (n and keys of each line): one row per document. code: its place in the order of documents.

    A text's digest is made in the array that is exploded, so it is computed once for each text and not for each of its lines.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = F.transform(F.array("text"), lambda t: F.struct(_key(t).alias("k"), F.transform(F.split(t, "\n", -1), lambda x: templates(x, long, short)).alias("xs")))
    out = plain.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.explode(made).alias("x"))
    code = F.coalesce("doc_id", F.lit(_NO_ID).bitwiseOR(F.col("x.k")))
    return out.select("row", code.alias("code"), "doc_id", F.col("x.k").alias("text_key"), F.col("x.xs").alias("xs"))


def recurring(keyed: DataFrame, long: int = LONG, slots: int = SLOTS) -> DataFrame:
    """key, first (the code of the first document) of the templates that recur. keyed: code, text_key, n, key. Sums are combined before the shuffle."""
    of_long = F.when(F.col("n") >= long, F.col("text_key"))
    slot = F.bit_or(F.when(F.col("n") < long, F.expr("shiftleft(1L, cast(pmod(text_key, 63) as int))")).otherwise(F.lit(0).cast("bigint")))
    seen = keyed.groupBy("key").agg(F.min("code").alias("first"), F.min(of_long).alias("low"), F.max(of_long).alias("high"), slot.alias("slots"))
    return seen.where((F.col("low") < F.col("high")) | (F.bit_count("slots") >= slots)).select("key", "first")


def near_copies(docs: DataFrame, pairs: DataFrame, threshold: int, size: int = 5) -> DataFrame:
    """Those of ``pairs`` (text_key, other) whose sets of ``size``-word shingles have a similarity of ``threshold`` percent.

    docs: text. The texts stay where they are as long as the keys of ``pairs`` are few enough to be broadcast.
    """
    pairs = written(pairs.distinct())
    needed = written(pairs.where("text_key <> other").select(F.explode(F.array("text_key", "other")).alias("text_key")).distinct())
    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, F.lit(size))))
    texts = docs.select(_key(F.col("text")).alias("text_key"), "text").join(needed, "text_key", "left_semi")
    sets = texts.select("text_key", words.alias("words")).select("text_key", F.array_distinct(shingles).alias("items"))
    sets = written(sets.groupBy("text_key").agg(F.first("items").alias("items")))
    both = pairs.join(sets.withColumnRenamed("items", "of_a"), "text_key").join(sets.select(F.col("text_key").alias("other"), F.col("items").alias("of_b")), "other")
    both = both.select("text_key", "other", F.size("of_a").alias("a"), F.size("of_b").alias("b"), F.size(F.array_intersect("of_a", "of_b")).alias("c"))
    near = both.where(100 * F.col("c") >= threshold * (F.col("a") + F.col("b") - F.col("c")))
    return near.select("text_key", "other").unionByName(pairs.where("text_key = other"))


def drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: int | None = None, most: int = MOST_PERCENT, long: int = LONG, short: int = SHORT, slots: int = SLOTS) -> DataFrame:
    """doc_id, text_key, dropped (line numbers from 0), distinct, for documents with lines to drop."""
    rows = written(parsed(docs, id_col, text_col, long, short))
    lines = rows.select("row", "code", "text_key", F.posexplode("xs").alias("line", "x"))
    keyed = lines.select("row", "code", "text_key", "line", F.col("x.n").alias("n"), F.explode("x.keys").alias("key"))
    found = written(recurring(keyed, long, slots))
    hits = keyed.select("row", "code", "line", "key").join(found, "key").where("code <> first")
    hits = hits.select("row", "line") if copies is None or most >= 100 else written(hits.select("row", "line", "first").distinct())
    gone = hits.groupBy("row").agg(F.sort_array(F.collect_set("line")).alias("dropped"))
    if most >= 100:
        return gone.join(rows.select("row", "doc_id", "text_key"), "row").select("doc_id", "text_key", "dropped").dropDuplicates(["doc_id", "text_key"])
    sizes = rows.select("row", "code", "doc_id", "text_key", F.transform("xs", lambda x: x.n).alias("sizes"))
    both = gone.join(sizes, "row")
    words = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, n: s + n)
    lost = words(F.transform("dropped", lambda i: F.col("sizes")[i]))
    both = both.withColumn("most", 100 * lost > most * words(F.col("sizes")))
    if copies is None:
        return both.where("not most").select("doc_id", "text_key", "dropped").dropDuplicates(["doc_id", "text_key"])
    both = written(both)
    mine = hits.join(both.where("most").select("row", F.col("text_key"), "sizes"), "row").select("row", "text_key", "line", "first", F.col("sizes")[F.col("line")].alias("n"))
    shared = mine.groupBy("row", "text_key", "first").agg(F.sum("n").alias("n"))
    wanted = written(shared.select("first").distinct())
    texts = written(rows.select(F.col("code").alias("first"), F.col("text_key").alias("other")).join(wanted, "first", "left_semi").groupBy("first").agg(F.min("other").alias("other")))  # many documents may come from one
    best = F.max(F.struct((F.col("other") == F.col("text_key")).alias("equal"), "n", "other", "first")).alias("best")
    source = written(shared.join(texts, "first").groupBy("row", "text_key").agg(best).select("row", "text_key", F.col("best.other").alias("other"), F.col("best.first").alias("source")))
    plain = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    copied = written(source.join(near_copies(plain, source.select("text_key", "other"), copies), ["text_key", "other"]).select("row", "source"))
    third = mine.join(copied, "row").where("first <> source").groupBy("row").agg(F.sort_array(F.collect_set("line")).alias("dropped"))
    third = third.join(both.select("row", "doc_id", "text_key"), "row").select("doc_id", "text_key", "dropped")
    own = both.join(copied, "row", "left_anti").select("doc_id", "text_key", "dropped")
    return own.unionByName(third).dropDuplicates(["doc_id", "text_key"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: int | None = None, most: int = MOST_PERCENT, long: int = LONG, short: int = SHORT, slots: int = SLOTS) -> DataFrame:
    """``docs`` with the lines of recurring templates dropped, and columns n_lines and n_dropped.

    Lines end at ``\\n``. A template of ``long`` words and more recurs if two different texts have it; one of ``short`` and more,
    if its texts fill ``slots`` of 63 hash slots (8: about nine texts); shorter ones never do. Null texts stay null, and
    texts without a dropped line stay as they are. Equal rows share their fate. Documents are in the order of their ids, which are
    below 2^62; rows without an id come last, in the order of their digests; rows of one id count as one document here.
    By default no document stays whole. With ``most`` under 100, documents that would lose more than that percentage of their words do: all of them, or,
    if ``copies`` is given, those whose five-word shingles have that similarity in percent to an equal text or that which most of these words
    come from; of these, lines that recur in third texts are dropped.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    gone = drops(docs, id_col, text_col, copies, most, long, short, slots).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("dropped").alias("__gone"))
    rows = docs.withColumn("__text", _key(text)).join(gone, F.col(id_col).cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")), "left")

    def left(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        return F.array_join(F.transform(F.array_except(every, F.col("__gone")), lambda i: lines[i]), "\n")

    cut = F.transform(F.array(F.split(F.col(text_col), "\n", -1)), left)[0]  # split once
    names = {"n_lines": F.size(F.split(text, "\n", -1)).cast("bigint"), "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint"), text_col: F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(cut)}
    return rows.withColumns(names).select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_chars and the digest of what is left."""
    text = F.coalesce("text", F.lit(""))
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.length(text).cast("bigint").alias("n_chars"), F.sha2(text, 256).alias("clean_sha256"))


#: The same in DuckDB's SQL.
ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, ('0x' || md5(text)[1:15])::BIGINT AS text_key, string_split(text, chr(10)) AS lines FROM docs),
lines AS (SELECT DISTINCT doc_id, text_key, i - 1 AS line, string_split(trim(regexp_replace(list_aggregate(list_transform(string_split_regex(lines[i], '[ \t\v\f\r]'),
  lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END), 'string_agg', ' '), ' +', ' ', 'g')), ' ') AS w FROM split, range(1, len(lines) + 1) r(i)),
sized AS (SELECT doc_id, text_key, line, len(w)::BIGINT AS n, ((len(w) - 2) // 4)::BIGINT AS q, w FROM lines),
blocks AS (SELECT doc_id, text_key, line, n, n::VARCHAR AS c, array_to_string(w[1:2], ' ') AS h, array_to_string(w[3:2+q], ' ') AS b0, array_to_string(w[3+q:2+2*q], ' ') AS b1,
  array_to_string(w[3+2*q:2+3*q], ' ') AS b2, array_to_string(w[3+3*q:n], ' ') AS b3 FROM sized WHERE n >= 3),
named AS (SELECT doc_id, text_key, line, n, unnest(CASE WHEN n >= 10 THEN [concat_ws('|', c, h, b0, b1, b2, b3), concat_ws('|', c, h, '<*>', b1, b2, b3), concat_ws('|', c, h, b0, '<*>', b2, b3),
  concat_ws('|', c, h, b0, b1, '<*>', b3), concat_ws('|', c, h, b0, b1, b2, '<*>')] ELSE [concat_ws('|', c, h, b0, b1, b2, b3)] END) AS key FROM blocks),
found AS (SELECT key, min(coalesce(doc_id, 4611686018427387904 | text_key)) AS first FROM named GROUP BY key
  HAVING CASE WHEN max(n) >= 8 THEN count(DISTINCT text_key) > 1 ELSE count(DISTINCT text_key % 63) >= 8 END),
gone AS (SELECT DISTINCT doc_id, text_key, line, n FROM named JOIN found USING (key) WHERE first <> coalesce(doc_id, 4611686018427387904 | text_key)),
dropped AS (SELECT doc_id, text_key, list(line) AS dropped FROM gone GROUP BY ALL),
clean AS (SELECT s.doc_id, len(lines)::BIGINT AS n_lines, coalesce(len(dropped), 0)::BIGINT AS n_dropped,
  CASE WHEN dropped IS NULL THEN text ELSE coalesce(array_to_string([lines[i] for i in range(1, len(lines) + 1) if NOT list_contains(dropped, i - 1)], chr(10)), '') END AS t
  FROM split s LEFT JOIN dropped d ON s.doc_id = d.doc_id AND s.text_key = d.text_key)
SELECT doc_id, n_lines, n_dropped, length(t)::BIGINT AS n_chars, sha256(t) AS clean_sha256 FROM clean
"""
