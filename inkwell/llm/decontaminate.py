"""Spans of documents that also stand in a benchmark, by native operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, need, own_names, with_few, words_apart

#: A-Z, which are lower-cased, and what no word holds (before and after that).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
APART = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Benchmark windows that are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
#: Words whose hash finds the windows that may start at a word.
LEAD = 3


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased and other letters unchanged; none for null.

    ``lower`` is fast but lower-cases all letters, so it serves for texts
    without others only.
    """
    plain = F.when(F.octet_length(text) != F.length(text), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return words_apart(plain, BETWEEN)


def item_windows(items: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """(item, words) of every ``size`` consecutive words, or of all if there are fewer, but not none."""
    split = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    last = F.greatest(F.size("w") - size, F.lit(0))
    windows = split.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, size))).alias("window"))
    return windows.distinct()


def _lead(words: list[Column]) -> Column:
    return F.xxhash64(*words)


SPANS = "array<struct<at:int,n:int>>"


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Columns ``id_col``, ``row`` (hash of the text), ``n_words``, ``n_hit``, ``item_ids`` and ``hits``, one row a row of ``docs``.

    ``hits`` are the spans (``at``, ``n``, counted in words from 0), merged and
    in order; ``item_ids`` the items with a window in the document, sorted as
    strings. Null and empty texts have no words and no hits; items without
    words, or whose id is null, have no windows. Repeated rows each get the
    same result, and a null id is an id like any other. Texts of any length are
    split once. An empty table gives no rows. Other columns are not read.

    Each document word looks up the hash of itself and the two next (the lead)
    among the windows' leads and verifies the whole windows of that lead. The
    windows are broadcast if there are at most ``BROADCAST_WINDOWS``, and a
    document is scanned once. Otherwise the leads alone are shuffled, 24 bytes a
    word, and whole windows are verified in the documents that have one.
    """
    need(docs, id_col, text_col)
    need(items, item_col, item_text_col)
    windows = item_windows(items.where(F.col(item_col).isNotNull()), window, item_col, item_text_col)
    windows = windows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    size = F.least(F.size("window"), F.lit(LEAD))
    lead = F.when(size == 1, _lead([F.get("window", F.lit(0))]))
    for k in range(2, LEAD + 1):
        lead = lead.when(size == k, _lead([F.get("window", F.lit(i)) for i in range(k)]))
    # one row a lead, so that looking up never multiplies a word
    windows = cut(windows.groupBy(size.alias("k"), lead.alias("lead")).agg(F.collect_list(F.struct("window", "items")).alias("windows"), F.count("*").alias("n")))
    lengths = {r[0]: r[1] for r in windows.groupBy("k").agg(F.sum("n")).collect()}

    split = docs.select(F.col(id_col), F.xxhash64(text_col).alias("row"), words_of(F.col(text_col)).alias("w"))
    few = sum(lengths.values()) <= BROADCAST_WINDOWS
    per_row = _scanned(split, windows, lengths, id_col) if few else _looked_up(docs, split, windows, lengths, id_col, text_col)
    merged = F.aggregate("spans", F.array().cast(SPANS), _merge)
    counted = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["n"])
    return per_row.select(id_col, "row", "n_words", "item_ids", merged.alias("hits")).select(
        id_col, "row", "n_words", counted.alias("n_hit"), "item_ids", "hits"
    )


def _there(windows: Column) -> Column:
    """Those of the windows of a lead that stand in words ``w`` from ``at`` on."""
    none = F.array().cast("array<struct<window:array<string>,items:array<string>>>")
    return F.when(windows.isNull(), none).otherwise(
        F.filter(windows, lambda x: F.slice("w", F.col("at") + 1, F.size(x["window"])) == x["window"])
    )


def _spans(hits: Column, at: Column) -> Column:
    return F.transform(hits, lambda x: F.struct(at.cast("int").alias("at"), F.size(x["window"]).alias("n")))


def _gathered() -> list[Column]:
    # a document's occurrences are no more than its words times the window lengths
    return [
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("found")))).alias("item_ids"),
    ]


def _scanned(split: DataFrame, windows: DataFrame, lengths: dict[int, int], id_col: str) -> DataFrame:
    """Every word looks up its leads in the broadcast windows; a row's first word, or its lack of words, stands for the row."""
    placed = split.select(id_col, "row", "w", F.posexplode_outer("w").alias("at", "word"))
    hits = F.array().cast("array<struct<window:array<string>,items:array<string>>>")
    for k in lengths:
        mine = _lead([F.col("word"), *[F.get("w", F.col("at") + i) for i in range(1, k)]])
        side = windows.where(F.col("k") == k).select(F.col("lead").alias(f"lead{k}"), F.col("windows").alias(f"windows{k}"))
        placed = placed.withColumn(f"lead{k}", mine).join(F.broadcast(side), f"lead{k}", "left")
        hits = F.concat(hits, _there(F.col(f"windows{k}")))
    first = F.col("at").isNull() | (F.col("at") == 0)
    some = F.lit(False)
    for k in lengths:
        some = some | F.col(f"windows{k}").isNotNull()
    # no other filter: one by the hits would be merged into this and have every word's row, with all of w, written before it
    kept = placed.where(first | some).select(
        id_col, "row", first.alias("first"), F.coalesce(F.size("w"), F.lit(0)).cast("long").alias("n_words"), "at", hits.alias("hits")
    )
    spans = kept.select(id_col, "row", "first", "n_words", _spans(F.col("hits"), F.col("at")).alias("spans"), F.flatten(F.transform("hits", lambda x: x["items"])).alias("found"))
    by_text = spans.groupBy(id_col, "row").agg(F.count_if("first").alias("rows"), F.max("n_words").alias("n_words"), *_gathered())
    return by_text.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))


def _looked_up(docs: DataFrame, split: DataFrame, windows: DataFrame, lengths: dict[int, int], id_col: str, text_col: str) -> DataFrame:
    """The same for windows of any number: leads meet in a shuffle, and only texts that share one are split again to verify."""
    sizes = split.select(F.col(id_col), "row", F.size("w").cast("long").alias("n_words"))
    placed = split.select(F.xxhash64(id_col).alias("id"), "row", "w", F.posexplode("w").alias("at", "word"))
    starts = [F.struct(F.lit(k).alias("k"), _lead([F.col("word"), *[F.get("w", F.col("at") + i) for i in range(1, k)]]).alias("lead")) for k in lengths]
    leads = placed.select("id", "row", "at", F.explode(F.array(*starts)).alias("s")).select("id", "row", "at", "s.k", "s.lead")
    shared = cut(leads.join(windows.select("k", "lead"), ["k", "lead"], "left_semi"))
    texts = docs.select(F.xxhash64(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    texts = with_few(texts, cut(shared.select("id", "row").distinct()), ["id", "row"], "left_semi").dropDuplicates(["id", "row"])
    # the few words from a start on, so that a text is not carried along with each
    own = shared.groupBy("id", "row").agg(F.collect_list(F.struct("at", "k", "lead")).alias("starts"))
    own = texts.join(own, ["id", "row"]).select("id", "row", words_of(F.col("text")).alias("w"), F.explode("starts").alias("s"))
    longest = F.lit(windows.agg(F.max(F.array_max(F.transform("windows", lambda x: F.size(x["window"]))))).first()[0] or 0)
    own = own.select("id", "row", "s.at", "s.k", "s.lead", F.slice("w", F.col("s.at") + 1, longest).alias("w")).join(windows, ["k", "lead"])
    here = F.filter("windows", lambda x: F.slice("w", 1, F.size(x["window"])) == x["window"])
    found = own.select("id", "row", "at", here.alias("hits")).where("size(hits) > 0")
    found = found.select("id", "row", _spans(F.col("hits"), F.col("at")).alias("spans"), F.flatten(F.transform("hits", lambda x: x["items"])).alias("found"))
    per_text = found.groupBy("id", "row").agg(*_gathered())
    rows = sizes.withColumn("id", F.xxhash64(id_col)).join(per_text, ["id", "row"], "left")
    return rows.select(
        id_col, "row", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def _merge(done: Column, span: Column) -> Column:
    """Adds a span to merged ones, none of which starts after it."""
    last = F.get(done, F.size(done) - 1)
    end = last["at"] + last["n"]
    joined = F.struct(last["at"].alias("at"), (F.greatest(end, span["at"] + span["n"]) - last["at"]).alias("n"))
    apart = F.struct(span["at"].alias("at"), span["n"].alias("n"))
    touches = (F.size(done) > 0) & (end >= span["at"])
    return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(apart)))


@own_names
def decontaminate(docs: DataFrame, items: DataFrame, most_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``docs`` without benchmark text: hit spans are cut out, and documents with a share of hit words over ``most_share`` dropped.

    All else stays byte for byte, but for the white space before a span, which
    goes with it. A hit is of its text, whatever its id, null included.
    """
    found = contamination(docs, items, id_col=id_col, text_col=text_col, **names).where("n_hit > 0").dropDuplicates([id_col, "row"])
    share = (F.col("n_hit") / F.col("n_words")).alias("__share")
    # a hash of the id, which a null has, too
    found = cut(found.select(F.xxhash64(id_col).alias("__id"), F.col("row").alias("__row"), F.col("hits").alias("__hits"), share))
    rows = docs.withColumn("__id", F.xxhash64(id_col)).withColumn("__row", F.xxhash64(text_col))
    joined = with_few(rows, found, ["__id", "__row"], "left", lists="__hits")
    # a word with what stands before it is a piece; what follows the last word is the last piece
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"[{APART}]*+[^{APART}]++|[{APART}]++"), 0)

    def left(piece: Column, i: Column) -> Column:
        before = F.regexp_replace(F.regexp_extract(piece, f"^[{APART}]*+", 0), r"[\x20\x09-\x0D]++$", "")
        hit = F.exists("__hits", lambda h: (h["at"] <= i) & (i < h["at"] + h["n"]))
        return F.when(~hit, piece).when(F.exists("__hits", lambda h: h["at"] == i), before).otherwise("")

    text = F.when(F.col("__hits").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(pieces, left), ""))
    kept = joined.where(f"__share is null or __share <= {most_share}")
    return kept.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
