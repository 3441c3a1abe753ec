"""Benchmark decontamination with DataFrame operations alone: no Python runs on the executors.

Words are runs of digits, letters and non-ASCII characters in ASCII lower case. A window is 10 consecutive words of a
benchmark item, or the whole of a shorter one. The distinct windows form a hash table by a 64-bit hash of their words,
which is broadcast while its size is below a bound. One scan of the documents hashes the words from each place on, looks
the hash up, and verifies each find by comparing the words; what leaves the scan is one row for each document, and one
for each hit. Beyond the bound the hashes alone are broadcast, up to some millions of them, so that only places whose hash is
a window's are shuffled, and the few documents with finds are read again; beyond that all places' hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import ascii_lower, free_name, once, own_columns, written
from patchloom.llm.near_dup import bounded

#: What is not a word character, capital letters among the words' characters; text is cut at runs of these.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Windows of up to so many bytes are broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes of a hash in a broadcast table.
KEY_BYTES = 24
#: Documents with hits, of some 100 bytes each in a table of them, are broadcast up to so many.
BROADCAST_HITS = 300_000


def _cut(text: Column) -> Column:
    """Array of text's words in ASCII lower case; the first and the last are empty where text begins or ends with a gap."""
    lower = lambda w: F.when(F.lower(w) == w, w).otherwise(ascii_lower(w))  # noqa: E731  most words have no capital letter
    return F.transform(F.split(F.coalesce(text, F.lit("")), _GAPS), lower)


def words(text: Column) -> Column:
    """Array of text's words in ASCII lower case, empty for a null text."""
    return F.filter(_cut(text), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows with the items they occur in: window (its words), size, key (hash of the words), item_ids."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    each = items.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s") + 1, window).alias("window"))
    distinct = each.groupBy("window").agg(F.collect_set("item_id").alias("item_ids"))
    return distinct.select("window", F.size("window").alias("size"), F.xxhash64("window").alias("key"), "item_ids")


def _places(docs: DataFrame, sizes: list[int], *others: str) -> DataFrame:
    """A row for each word of docs and each size: doc_id, tie (hash of the text), w, others, n_words, i, size, key.

    key hashes the size words from place i on, null where so many don't follow. A text without words has one row.
    """
    cut = docs.select("doc_id", F.xxhash64("text").alias("tie"), _cut(F.col("text")).alias("w"), *others)
    blank = lambda w: (w == "").cast("int")
    n = F.size("w") - blank(F.element_at("w", 1)) - F.when(F.size("w") > 1, blank(F.element_at("w", -1))).otherwise(0)
    placed = cut.select("doc_id", "tie", "w", *others, n.cast("long").alias("n_words"), F.posexplode("w").alias("i", "word"))
    # An array's hash is its elements' hash one after another, as that of as many columns.
    key = lambda s: F.when(F.col("i") + s <= F.size("w"), F.xxhash64(*[F.get("w", F.col("i") + j) for j in range(s)]))
    columns = [F.col(c) for c in ("doc_id", "tie", "w", *others, "n_words", "i")]
    if len(sizes) == 1:
        return placed.select(*columns, F.lit(sizes[0]).alias("size"), key(sizes[0]).alias("key"))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("size"), key(s).alias("key")) for s in sizes]))
    return placed.select(*columns, each.alias("x")).select(*columns, "x.size", "x.key")


def found_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_BYTES, key_limit: int = BROADCAST_BYTES) -> DataFrame:
    """Verified occurrences, and a row with a null start for each row of docs: doc_id, tie, n_words, start, size, item_ids."""
    table = benchmark_windows(benchmark, window)
    # One small job: the windows' bytes, and the sizes that occur, of which there are at most as many as window.
    n = F.sum(64 + 24 * F.size("window") + F.length(F.array_join("window", "")) * 4 + 8 * F.size("item_ids"))
    total, sizes, count = table.agg(n, F.array_sort(F.collect_set("size")), F.count("*")).first()
    sizes = list(sizes) or [window]
    by_key = table.groupBy("key").agg(F.collect_list(F.struct("window", "size", "item_ids")).alias("windows"))
    own = lambda x: (x["size"] == F.col("size")) & (F.slice("w", F.col("i") + 1, x["size"]) == x["window"])
    once_a_row = (F.col("i") == 0) & (F.col("size") == sizes[0])
    if (total or 0) <= limit:
        met = _places(docs, sizes).join(F.broadcast(by_key), "key", "left").filter(F.col("windows").isNotNull() | once_a_row)
        hits = F.transform(F.filter(F.coalesce("windows", F.array()), own), lambda x: F.struct(F.col("i").alias("start"), x["size"].alias("size"), x["item_ids"].alias("item_ids")))
        row = F.when(once_a_row, F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("size"), F.lit(None).cast(table.schema["item_ids"].dataType).alias("item_ids"))))
        both = F.concat(F.coalesce(row, F.array().cast(_hit_type(table))), hits.cast(_hit_type(table)))
        return met.select("doc_id", "tie", "n_words", F.explode(both).alias("x")).select("doc_id", "tie", "n_words", "x.*")
    places = _places(docs, sizes)
    kind = table.schema["item_ids"].dataType
    rows = places.filter(once_a_row).select("doc_id", "tie", "n_words", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("size"), F.lit(None).cast(kind).alias("item_ids"))
    known = table.select("key").distinct()
    known = F.broadcast(known) if count * KEY_BYTES <= key_limit else known
    keys = places.filter("key IS NOT NULL").select("doc_id", "tie", "i", "size", "key").join(known, "key", "left_semi")
    at = keys.join(table.select("key", F.col("size").alias("of"), "window", "item_ids"), "key").filter("size = of").select("doc_id", "tie", "i", "size", "window", "item_ids")
    few = at.select(F.col("doc_id").alias("its_doc"), F.col("tie").alias("its_tie")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("its_doc")) & (F.col("tie") == F.col("its_tie"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").join(few, same, "left_semi").dropDuplicates(["doc_id", "tie"])
    cut = texts.select(F.col("doc_id").alias("its_doc"), F.col("tie").alias("its_tie"), _cut(F.col("text")).alias("w"))
    true = at.join(cut, same).filter(F.slice("w", F.col("i") + 1, F.col("size")) == F.col("window"))
    return rows.union(true.select("doc_id", "tie", F.lit(None).cast("long"), "i", "size", "item_ids"))


def _hit_type(table: DataFrame) -> str:
    return f"array<struct<start: int, size: int, item_ids: {table.schema['item_ids'].dataType.simpleString()}>>"


def _of_documents(found: DataFrame) -> DataFrame:
    """doc_id, tie, times (rows alike), n_words, hits (distinct start and size), item_ids (distinct)."""
    hit = F.col("start").isNotNull()
    grouped = found.groupBy("doc_id", "tie").agg(
        F.sum((~hit).cast("int")).alias("times"), F.max("n_words").alias("n_words"),
        F.collect_set(F.when(hit, F.struct("start", "size"))).alias("hits"), F.collect_set(F.when(hit, F.col("item_ids"))).alias("sets"),
    )
    return grouped.select("doc_id", "tie", "times", "n_words", "hits", F.array_distinct(F.flatten("sets")).alias("item_ids"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    docs and benchmark need doc_id or item_id, and text; other columns are ignored. Null and empty texts, and items
    without words, have no words and hit nothing. Repeated rows get equal results each; a null doc_id is kept, and its
    rows are told apart by their texts. An empty benchmark hits nothing.
    """
    rows = _of_documents(found_windows(docs, benchmark, window, limit))
    places = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    each = rows.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"),
    )
    return each.drop("time")


def _with_hits(docs: DataFrame, benchmark: DataFrame, window: int, limit: int) -> tuple[DataFrame, Column, str]:
    """Documents with hits under names that docs doesn't have, the condition that a row is one of them, and the name of the hits."""
    doc, tie, hits = (free_name(docs, name) for name in ("hit_doc", "hit_tie", "hit_spans"))
    found = found_windows(docs, benchmark, window, limit).filter(F.col("start").isNotNull())
    spans = found.groupBy(F.col("doc_id").alias(doc), F.col("tie").alias(tie)).agg(F.collect_set(F.struct("start", "size")).alias(hits))
    return spans, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(tie)), hits


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_BYTES, hit_limit: int = BROADCAST_HITS) -> DataFrame:
    """docs without the rows that hold an occurrence of a window; all columns kept, whatever their names, and null texts kept.

    The documents with hits are found and counted first; up to hit_limit of them are broadcast, so that no text is shuffled.
    """
    spans, same, hits = _with_hits(docs, benchmark, window, limit)
    return docs.join(bounded(written(spans.drop(hits), "contaminated"), hit_limit), same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_BYTES) -> DataFrame:
    """docs with the hit words of its texts cut out; texts without hits stay as they are, and all rows and columns are kept.

    A text with hits becomes its other words, each with the gap before it; the gap before a hit word goes too.
    """
    spans, same, hits = _with_hits(docs, benchmark, window, limit)
    joined, parts = docs.join(spans, same, "left"), free_name(docs, "cut_parts")
    # Parts: each word with the gap before it, so that the place of a word is that of its part; a last gap is one more.
    pattern = F.lit(f"(?:{_GAPS})?[^{_GAPS[1:-2]}]+|{_GAPS}$")
    lead = F.when(F.col("text").rlike(f"^{_GAPS}"), 1).otherwise(0)  # an empty word stands before a gap that begins the text
    cut = joined.select("*", once(F.when(F.col(hits).isNotNull(), F.struct(F.regexp_extract_all("text", pattern, F.lit(0)).alias("parts"), lead.alias("lead")))).alias(parts))
    place = lambda i: i + F.col(f"{parts}.lead")
    kept = F.filter(f"{parts}.parts", lambda p, i: ~F.exists(F.col(hits), lambda s: (place(i) >= s["start"]) & (place(i) < s["start"] + s["size"])))
    text = F.when(F.col(hits).isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    return cut.withColumn("text", text).select(*own_columns(docs))


#: DuckDB SQL for contamination() on the tables documents and benchmark.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS w
  FROM documents),
docs AS (SELECT doc_id, list_filter(w, lambda x: x <> '') AS w FROM words),
item_words AS (
  SELECT item_id, list_filter(string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' '), lambda x: x <> '') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + 10], ' ') AS k, least(len(w), 10) AS size
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (
  SELECT doc_id, s, size, array_to_string(w[s + 1 : s + size], ' ') AS k
  FROM (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS s FROM docs, sizes WHERE len(w) >= size)),
hits AS (SELECT a.doc_id, a.s, a.size, b.item_id FROM runs a JOIN windows b ON a.k = b.k AND a.size = b.size),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
