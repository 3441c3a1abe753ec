"""Queries on deduplication, splits, balancing, contexts, reports and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.operators import aggregates, contexts, filters, models, rows, splits
from patchloom.plans.inputs import given
from patchloom.plans.registry import query
from patchloom.sinks import context_lines, neighbour_report, vocabularies

_FIRST = "row_number() OVER (PARTITION BY label, text ORDER BY id) = 1"


def _random(seed: int, key: str) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


def _fraction(seed: int, key: str) -> str:
    return f"(('0x' || substr({_random(seed, key)}, 1, 8))::BIGINT / 4294967296.0)"


def _split(seed: int, key: str, test: float = 0.1, val: float = 0.2) -> str:
    return f"CASE WHEN {_fraction(seed, key)} < {test} THEN 'test' WHEN {_fraction(seed, key)} < {val} THEN 'val' ELSE 'train' END"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, d, "samples")


@query(f"SELECT id, label FROM samples_in QUALIFY {_FIRST}", ("samples",))
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """W03."""
    return rows.keep_first(_samples(spark, d), ["label", "text"], ["id"]).select("id", "label")


@query("SELECT id, label FROM samples_in QUALIFY row_number() OVER (PARTITION BY label, text ORDER BY id) > 1", ("samples",))
def dedup_repeats(spark: SparkSession, d: str) -> DataFrame:
    """W03's repeats."""
    return rows.repeats(_samples(spark, d), ["label", "text"], ["id"]).select("id", "label")


@query("SELECT max(id) AS id, text_hash, label FROM (SELECT id, md5(text) AS text_hash, label FROM samples_in) GROUP BY text_hash, label", ("samples",))
def dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    """W02."""
    s = _samples(spark, d).select("id", F.md5("text").alias("text_hash"), "label", F.lit(1.0).alias("score"), "project")
    return rows.dedup_fix_rows(s, "id").select("id", "text_hash", "label")


@query("SELECT DISTINCT project, label, tag FROM samples_in", ("samples",))
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    """W04."""
    return _samples(spark, d).select("project", "label", "tag").distinct()


@query(f"SELECT id, row_number() OVER (ORDER BY {_random(5, 'id')}, id)::INT AS place FROM samples_in ORDER BY place LIMIT 50", ("samples",))
def shuffled_top(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty in seeded order, which is the query's own limit."""
    top = rows.shuffled(_samples(spark, d).select("id"), 5, "id").limit(50)
    from pyspark.sql.window import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(rows.seeded(5, "id"), "id")))


@query(f"SELECT id, tag FROM samples_in QUALIFY tag <> 'fix' OR row_number() OVER (PARTITION BY tag ORDER BY {_random(3, 'id')}, id) > round(count(*) OVER (PARTITION BY tag) * 0.3)", ("samples",))
def drop_tag(spark: SparkSession, d: str) -> DataFrame:
    """F14."""
    return rows.drop_tag(_samples(spark, d), "fix", 0.3, 3).select("id", "tag")


@query(f"SELECT id, {_split(1, 'id')} AS split FROM samples_in", ("samples",))
def split_random(spark: SparkSession, d: str) -> DataFrame:
    """B01."""
    return splits.split_random(_samples(spark, d), 1).select("id", "split")


@query(f"""WITH r AS (SELECT id, project, count(*) OVER (PARTITION BY project) AS n, row_number() OVER (PARTITION BY project ORDER BY {_random(2, 'id')}, id) AS r FROM samples_in)
SELECT id, project, CASE WHEN r <= ceil(n * 0.1) THEN 'test' WHEN r <= ceil(n * 0.1) + ceil((n - ceil(n * 0.1)) / 9.0) THEN 'val' ELSE 'train' END AS split FROM r""", ("samples",))
def split_stratified(spark: SparkSession, d: str) -> DataFrame:
    """B02."""
    return splits.split_stratified(_samples(spark, d), "project", 2).select("id", "project", "split")


@query(f"""WITH s AS (SELECT id, label, pair_hash, {_split(4, 'pair_hash')} AS split FROM samples_in), f AS (SELECT *, row_number() OVER (PARTITION BY split, pair_hash ORDER BY id) = 1 AND label = 'safe' AND split = 'train' AS first FROM s)
SELECT id, label, pair_hash, split FROM f WHERE NOT (first AND {_fraction(5, 'id')} < 0.4)""", ("samples",))
def split_by_pair(spark: SparkSession, d: str) -> DataFrame:
    """B03."""
    return splits.split_by_pair(_samples(spark, d), 4, 0.4).select("id", "label", "pair_hash", "split")


@query(f"SELECT id, ((row_number() OVER (PARTITION BY label, coalesce(nullif(project, 'src1'), 'unk') ORDER BY {_random(6, 'id')}, id) - 1) % 5)::INT AS fold FROM samples_in", ("samples",))
def k_fold(spark: SparkSession, d: str) -> DataFrame:
    """B04."""
    s = _samples(spark, d).withColumn("project", F.nullif("project", F.lit("src1")))
    return splits.k_fold_stratified(s, 5, ["label", "project"], 6).select("id", "fold")


@query(f"SELECT id, label, {_split(7, 'id')} AS split FROM samples_in QUALIFY {_FIRST}", ("samples",))
def split_unique(spark: SparkSession, d: str) -> DataFrame:
    """B05."""
    return splits.split_unique(_samples(spark, d), 7).select("id", "label", "split")


@query(f"""WITH f AS (SELECT * FROM samples_in QUALIFY {_FIRST}), u AS (SELECT count(*) FILTER (label = 'unsafe') AS u FROM f)
SELECT id, label, {_split(8, 'id')} AS split FROM f, u QUALIFY label = 'unsafe' OR row_number() OVER (PARTITION BY label ORDER BY {_random(8, 'id')}, id) <= u""", ("samples",))
def split_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    """B06."""
    return splits.split_one_to_one(_samples(spark, d), 8).select("id", "label", "split")


def _disjoint(seed: int, test: float, val: float) -> str:
    return f"""WITH f AS (SELECT *, {_split(seed, 'id', test, val)} AS split FROM samples_in QUALIFY {_FIRST}),
h AS (SELECT DISTINCT text FROM f WHERE split <> 'train'), q AS (SELECT * FROM samples_in QUALIFY row_number() OVER (PARTITION BY label, text ORDER BY id) > 1),
a AS (SELECT id, label, split FROM f UNION ALL SELECT id, label, 'train' FROM q WHERE text NOT IN (SELECT text FROM h))"""


_RATIO = """c AS (SELECT count(*) FILTER (label = 'safe') AS s, count(*) FILTER (label <> 'safe') AS u FROM a WHERE split = 'train'),
r AS (SELECT CASE WHEN u = 0 OR u >= s THEN 10 ELSE greatest(ceil(floor(s / u) * 2 / 3), 1) END::BIGINT AS ratio FROM c),
x AS (SELECT id, label, split, unnest(range(0, CASE WHEN split = 'train' AND label = 'unsafe' THEN ratio ELSE 1 END))::INT AS "copy" FROM a, r)"""


@query(f"{_disjoint(9, 0.2, 0.4)}, {_RATIO} SELECT * FROM x", ("samples",))
def split_disjoint(spark: SparkSession, d: str) -> DataFrame:
    """B07."""
    return splits.split_disjoint(_samples(spark, d), 9).select("id", "label", "split", "copy")


@query(f"WITH a AS (SELECT id, label, {_split(10, 'id')} AS split FROM samples_in), {_RATIO} SELECT * FROM x", ("samples",))
def split_oversample(spark: SparkSession, d: str) -> DataFrame:
    """B08, A04."""
    return splits.split_oversample(_samples(spark, d), 10).select("id", "label", "split", "copy")


@query(f"""{_disjoint(11, 0.1, 0.2)}, u AS (SELECT count(*) FILTER (label = 'unsafe') AS u FROM a WHERE split = 'train')
SELECT id, label, split FROM a, u WHERE split <> 'train' OR label <> 'safe' UNION ALL
SELECT id, label, split FROM (SELECT id, label, split, u FROM a, u WHERE split = 'train' AND label = 'safe' QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_random(11, 'id')}, id) <= 3 * u)""", ("samples",))
def split_undersample(spark: SparkSession, d: str) -> DataFrame:
    """B09."""
    return splits.split_undersample(_samples(spark, d), 11).select("id", "label", "split")


@query("SELECT count(*) FILTER (label = 'safe') AS safe, count(*) FILTER (label <> 'safe') AS unsafe FROM samples_in", ("samples",))
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    """A03."""
    return aggregates.label_distribution(_samples(spark, d))


def _bags(spark: SparkSession, d: str) -> DataFrame:
    """Words of each document."""
    return _samples(spark, d).filter(F.col("text").isNotNull()).select("id", "label", F.split("text", " ").alias("tokens"))


@query("""WITH bags AS (SELECT id, unnest(string_split(text, ' ')) AS token FROM samples_in), c AS (SELECT id, token, count(*) AS n FROM bags GROUP BY 1, 2), m AS (SELECT id, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1)
SELECT a.id AS a, b.id AS b, round(sum(a.n * b.n) / first(x.norm) / first(y.norm), 6) AS similarity FROM c a JOIN c b ON a.token = b.token AND a.id <> b.id JOIN m x ON x.id = a.id JOIN m y ON y.id = b.id WHERE a.id % 100 = 0 GROUP BY 1, 2""", ("samples",))
def bag_cosine(spark: SparkSession, d: str) -> DataFrame:
    """A search of the bags whose id is divisible by 100 against all."""
    b = _bags(spark, d)
    return splits.bag_cosine(b, queries=b.filter("id % 100 = 0")).withColumn("similarity", F.round("similarity", 6))


def _tokens(rows: str, where: str = "") -> str:
    return f"""c AS (SELECT id, token, count(*) AS n FROM (SELECT id, unnest(string_split(text, ' ')) AS token FROM {rows} WHERE text IS NOT NULL {where}) GROUP BY 1, 2), m AS (SELECT id, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1)"""


def _nearest_sql(k: int, asked: str = "true") -> str:
    return f"""s AS (SELECT a.id AS a, b.id AS b, sum(a.n * b.n) / first(x.norm) / first(y.norm) AS similarity FROM c a JOIN c b ON a.token = b.token AND a.id <> b.id JOIN m x ON x.id = a.id JOIN m y ON y.id = b.id WHERE {asked} GROUP BY 1, 2),
near AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(similarity, 12) DESC, b) <= {k})"""


def _grown(seed: int, bags: str) -> str:
    """Bags of smote_bags as id, label, tokens (joined); bags has id, label, text."""
    return f"""{_tokens(bags, "AND label = 'unsafe'")}, {_nearest_sql(5)}, u AS (SELECT count(*) FILTER (label = 'unsafe') AS ones, count(*) AS every, greatest(0, count(*) // 2 - count(*) FILTER (label = 'unsafe')) AS wanted FROM {bags}),
ns AS (SELECT a, list_sort(list(b)) AS near FROM near GROUP BY 1), r AS (SELECT greatest(1, (10 * wanted + greatest(1, ones) - 1) // greatest(1, ones)) AS rounds FROM u),
tries AS (SELECT a, near, unnest(range(0, rounds))::INT AS t FROM ns, r), chosen AS (SELECT a, t, near[floor({_fraction(seed, "a || ':' || t")} * len(near))::INT + 1] AS b FROM tries),
mixed AS (SELECT ch.a, ch.t, c.token, sum(c.n) / 2.0 AS mean FROM chosen ch JOIN c ON c.id = ch.a OR c.id = ch.b GROUP BY 1, 2, 3),
times AS (SELECT a, t, token, round(mean + ({_fraction(seed + 1, "a || ':' || t || ':' || token")} - 0.5) * 0.4)::INT AS k FROM mixed),
made AS (SELECT a, t, array_to_string(list_sort(flatten(list(list_resize([token], k, token)))), ' ') AS tokens FROM times WHERE k > 0 GROUP BY 1, 2),
sorted AS (SELECT id, label, array_to_string(list_sort(string_split(text, ' ')), ' ') AS tokens FROM {bags}),
fresh AS (SELECT * FROM made WHERE tokens NOT IN (SELECT tokens FROM sorted WHERE label = 'unsafe') QUALIFY row_number() OVER (PARTITION BY tokens ORDER BY t, a) = 1),
grown AS (SELECT id, label, tokens FROM sorted, u WHERE label = 'safe' QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_random(seed, 'id')}, id) <= every // 2
 UNION ALL SELECT id, label, tokens FROM sorted WHERE label = 'unsafe'
 UNION ALL SELECT NULL, 'unsafe', tokens FROM fresh, u QUALIFY row_number() OVER (ORDER BY {_random(seed + 2, "t || ':' || a")}, t, a) <= wanted)"""


@query(f"WITH bags AS (SELECT id, label, text FROM samples_in WHERE text IS NOT NULL), {_grown(12, 'bags')} SELECT id, label, tokens FROM grown", ("samples",))
def smote_bags(spark: SparkSession, d: str) -> DataFrame:
    """B12."""
    return splits.smote_bags(_bags(spark, d), 12).withColumn("tokens", F.array_join("tokens", " "))


@query(f"""WITH f AS (SELECT id, label, text, {_split(13, 'id', 0.2, 0.4)} AS split FROM samples_in WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label, array_to_string(list_sort(string_split(text, ' ')), ' ') ORDER BY id) = 1),
bags AS (SELECT id, label, text FROM f WHERE split = 'train'), {_grown(13, 'bags')} SELECT id, label, text AS tokens, split FROM f WHERE split <> 'train' UNION ALL SELECT id, label, tokens, 'train' FROM grown""", ("samples",))
def split_disjoint_smote(spark: SparkSession, d: str) -> DataFrame:
    """B10."""
    return splits.split_disjoint_smote(_bags(spark, d), 13).withColumn("tokens", F.array_join("tokens", " "))


@query(f"""WITH e AS (SELECT vec_id AS id, CASE WHEN label % 5 = 0 THEN 'unsafe' ELSE 'safe' END AS label, embedding AS vector FROM embeddings), u AS (SELECT count(*) FILTER (label = 'unsafe') AS ones, count(*) AS every FROM e), w AS (SELECT *, greatest(0, every // 2 - ones) AS wanted FROM u),
x AS (SELECT * FROM e WHERE label = 'unsafe'), p AS (SELECT a.id AS a, b.id AS b, list_sum(list_transform(list_zip(a.vector, b.vector), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM x a JOIN x b ON a.id <> b.id),
n AS (SELECT a, b FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 5), k AS (SELECT wanted, greatest(1, (wanted + greatest(1, ones * least(5, greatest(1, ones - 1))) - 1) // greatest(1, ones * least(5, greatest(1, ones - 1)))) AS times FROM w),
t AS (SELECT a, b, unnest(range(1, times + 1)) AS t, wanted FROM n, k), c AS (SELECT a, b, {_fraction(15, "a || ':' || b || ':' || t")} AS share FROM t QUALIFY row_number() OVER (ORDER BY {_random(14, "a || ':' || b || ':' || t")}, a, b, t) <= wanted),
g AS (SELECT id, label, vector FROM e, w WHERE label = 'safe' QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_random(14, 'id')}, id) <= every // 2 UNION ALL SELECT id, label, vector FROM x
 UNION ALL SELECT NULL, 'unsafe', list_transform(list_zip(y.vector, z.vector), lambda v: (v[1] + (v[2] - v[1]) * c.share)::FLOAT) FROM c JOIN x y ON y.id = c.a JOIN x z ON z.id = c.b)
SELECT id, label, array_to_string(list_transform(vector, lambda v: round(v::DOUBLE * 1000000)::BIGINT), ' ') AS vector FROM g""")
def smote_vectors(spark: SparkSession, d: str) -> DataFrame:
    """B11; entries in millionths."""
    e = given(spark, d, "SELECT vec_id AS id, CASE WHEN label % 5 = 0 THEN 'unsafe' ELSE 'safe' END AS label, embedding AS vector FROM {embeddings}")
    return splits.smote_vectors(e, 14).withColumn("vector", F.array_join(F.transform("vector", lambda v: F.round(v.cast("double") * 1000000).cast("long").cast("string")), " "))


@query(f"""WITH {_tokens('samples_in')}, {_nearest_sql(3, 'a.id % 100 = 0')} SELECT n.a, count(*) OVER (PARTITION BY n.a) AS neighbours, round(similarity, 9) AS similarity, x.text AS bag, y.text AS neighbour FROM near n JOIN samples_in x ON x.id = n.a JOIN samples_in y ON y.id = n.b""", ("samples",))
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """J14 with the three nearest, K09's report of nearest bags: the bags whose id is divisible by 100 against all."""
    bags = _bags(spark, d)
    return neighbour_report(splits.bag_cosine(bags, 3, queries=bags.filter("id % 100 = 0")), bags).withColumn("similarity", F.round("similarity", 9))


def _contexts(spark: SparkSession, d: str, first_only: bool = False) -> DataFrame:
    """Contexts "word,path,word" of neighbouring words of the whole text, or its first one; the path is the length of the middle one.

    Words are exploded from an array of one, so that they are cut once a row and not again for every context.
    """
    w = given(spark, d, "words").select("id", "label", F.explode(F.array(F.split(F.regexp_replace("text", "[,\n]", " "), " "))).alias("w"))
    n = F.size("w")
    made = F.transform(F.sequence(F.lit(0), F.lit(0) if first_only else n - 3), lambda i: F.concat_ws(",", F.get("w", i), F.length(F.get("w", i + 1)).cast("string"), F.get("w", i + 2)))
    return w.filter(n >= 3).select("id", "label", made.alias("contexts"))


_CONTEXT_SQL = """w AS (SELECT id, label, string_split(regexp_replace(text, '[,\\n]', ' ', 'g'), ' ') AS w FROM words_in),
ctx AS (SELECT id, label, w, unnest(range(0, len(w) - 2)) AS pos FROM w WHERE len(w) >= 3), c AS (SELECT id, label, pos, w[pos + 1] AS a, length(w[pos + 2])::VARCHAR AS p, w[pos + 3] AS b FROM ctx),
terms AS (SELECT 'word' AS kind, a AS term FROM c WHERE pos = 0 UNION ALL SELECT 'path', p FROM c WHERE pos = 0 UNION ALL SELECT 'word', b FROM c WHERE pos = 0),
n AS (SELECT kind, term, count(*) AS n FROM terms GROUP BY 1, 2), e AS (SELECT kind, n AS edge FROM n QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC) = 40),
v AS (SELECT kind, term, n FROM n LEFT JOIN e USING (kind) WHERE n >= coalesce(edge, 0))"""


@query(f"WITH {_CONTEXT_SQL} SELECT * FROM v", ("words",))
def vocab(spark: SparkSession, d: str) -> DataFrame:
    """A09."""
    return contexts.vocab_histogram(contexts.context_terms(_contexts(spark, d, first_only=True)), 40)


@query(f"""WITH {_CONTEXT_SQL}, m AS (SELECT id, pos, (x.term IS NOT NULL)::INT + (y.term IS NOT NULL)::INT + (z.term IS NOT NULL)::INT AS k FROM c LEFT JOIN v x ON x.kind = 'word' AND x.term = a LEFT JOIN v y ON y.kind = 'path' AND y.term = p LEFT JOIN v z ON z.kind = 'word' AND z.term = b)
SELECT id, count(*) FILTER (k = 3) AS full_found, count(*) FILTER (k > 0) AS partial_found FROM m GROUP BY 1""", ("words",))
def context_membership(spark: SparkSession, d: str) -> DataFrame:
    """J15."""
    m = contexts.context_membership(_contexts(spark, d), vocab(spark, d))
    return m.groupBy("id").agg(F.count_if("is_full").alias("full_found"), F.count_if("is_partial").alias("partial_found"))


@query(f"""WITH {_CONTEXT_SQL}, m AS (SELECT id, pos, a || ',' || p || ',' || b AS context, (x.term IS NOT NULL)::INT + (y.term IS NOT NULL)::INT + (z.term IS NOT NULL)::INT AS k FROM c LEFT JOIN v x ON x.kind = 'word' AND x.term = a LEFT JOIN v y ON y.kind = 'path' AND y.term = p LEFT JOIN v z ON z.kind = 'word' AND z.term = b),
s AS (SELECT id, pos, context FROM (SELECT *, count(*) OVER (PARTITION BY id) AS size FROM m) WHERE size <= 90 OR k > 0 QUALIFY size <= 90 OR row_number() OVER (PARTITION BY id ORDER BY k = 3 DESC, md5('0:' || id || ':' || pos), pos) <= 90)
SELECT id, md5(string_agg(context, ' ' ORDER BY pos)) AS contexts, count(*)::INT AS n FROM s GROUP BY 1""", ("words",))
def sample_contexts(spark: SparkSession, d: str) -> DataFrame:
    """W07."""
    out = contexts.sample_contexts(_contexts(spark, d), vocab(spark, d), 90)
    return out.select("id", F.md5(F.array_join("contexts", " ")).alias("contexts"), F.size("contexts").alias("n"))


@query(f"WITH {_CONTEXT_SQL}, s AS (SELECT id, count(*) AS n FROM c GROUP BY 1) SELECT max(n)::INT AS max_unfiltered, sum(n) / count(*)::DOUBLE AS average, sum(least(n, 7)) / count(*)::DOUBLE AS average_sampled, count(*) AS total, 0::BIGINT AS empty FROM s", ("words",))
def context_stats(spark: SparkSession, d: str) -> DataFrame:
    """A10."""
    c = _contexts(spark, d)
    return contexts.context_stats(c, c.withColumn("contexts", F.slice("contexts", 1, 7)))


@query(f"WITH {_CONTEXT_SQL}, s AS (SELECT id, label, count(*) AS n, string_agg(a || ',' || p || ',' || b, ' ' ORDER BY pos) AS t FROM c GROUP BY 1, 2) SELECT md5(label || ' ' || t || repeat(' ', greatest(200 - n, 0)::INT)) AS line FROM s", ("words",))
def context_text(spark: SparkSession, d: str) -> DataFrame:
    """The lines that are written."""
    return context_lines(_contexts(spark, d), 200).select(F.md5("value").alias("line"))


@query(f"WITH {_CONTEXT_SQL}, l AS (SELECT DISTINCT id, label FROM c) SELECT kind, term, n FROM v WHERE kind = 'word' UNION ALL SELECT 'target', label, count(*) FROM l GROUP BY label UNION ALL SELECT 'examples', '', count(*) FROM l", ("words",))
def vocabulary_table(spark: SparkSession, d: str) -> DataFrame:
    """K06."""
    c = _contexts(spark, d)
    return vocabularies(contexts.context_terms(c), c.select("label"), {"word": 40, "target": 100})


@query("SELECT l_shipdate::DATE::VARCHAR AS day, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, day LIMIT 15")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    """The top fifteen, which is the report's own limit."""
    return aggregates.value_counts(given(spark, d, "SELECT CAST(CAST(l_shipdate AS DATE) AS STRING) AS day FROM {lineitem}"), "day", 15)


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, [0.1, 0.9]) AS e FROM lineitem), f AS (SELECT l_extendedprice AS x, l_returnflag FROM lineitem, q WHERE l_extendedprice BETWEEN e[1] AND e[2]),
m AS (SELECT min(x) AS lo, max(x) AS hi FROM f) SELECT l_returnflag, least(floor((x - lo) / ((hi - lo) / 20)) + 1, 20)::INT AS bin, count(*) AS n, round(avg(x), 4) AS mean FROM f, m GROUP BY 1, 2""")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    """A07, F15."""
    items = given(spark, d, "SELECT l_extendedprice, l_returnflag FROM {lineitem}")
    return aggregates.histogram(items, "l_extendedprice", 20, "l_returnflag", filter_outliers=True).withColumn("mean", F.round("mean", 4))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, [0.1, 0.9]) AS e FROM orders) SELECT o_orderkey FROM orders, q WHERE o_totalprice BETWEEN e[1] AND e[2]""")
def quantile_filter(spark: SparkSession, d: str) -> DataFrame:
    """F15."""
    return filters.between_quantiles(given(spark, d, "SELECT o_orderkey, o_totalprice FROM {orders}"), "o_totalprice").select("o_orderkey")


_PREDICTED = "SELECT doc_id AS id, quality AS label, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS predicted, CAST(doc_id % 100 AS DOUBLE) / 100 AS score FROM {labels}"
_PREDICTED_SQL = _PREDICTED.replace("{labels}", "labels")


@query(f"""WITH p AS ({_PREDICTED_SQL}), c AS (SELECT count(*) FILTER (label = 0 AND predicted = 0)::DOUBLE AS tn, count(*) FILTER (label = 0 AND predicted = 1)::DOUBLE AS fp, count(*) FILTER (label = 1 AND predicted = 0)::DOUBLE AS fn, count(*) FILTER (label = 1 AND predicted = 1)::DOUBLE AS tp FROM p)
SELECT tn::BIGINT AS "TN", fp::BIGINT AS "FP", fn::BIGINT AS "FN", tp::BIGINT AS "TP", (tp + tn) / (tp + tn + fp + fn) AS "Acc", (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS "MCC", 2 * tp / (2 * tp + fp + fn) AS "F1", tp / (tp + fn) AS "Recall", tp / (tp + fp) AS "Precision", (tp + fp) / (tp + tn + fp + fn) AS preds_share FROM c""")
def metrics(spark: SparkSession, d: str) -> DataFrame:
    """A14."""
    return aggregates.confusion_metrics(given(spark, d, _PREDICTED))


_ROC = f"""WITH p AS ({_PREDICTED_SQL}), g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS q FROM p GROUP BY 1),
r AS (SELECT score, sum(p) OVER (ORDER BY score DESC)::BIGINT AS "TP", sum(q) OVER (ORDER BY score DESC)::BIGINT AS "FP" FROM g), t AS (SELECT sum(p) AS "P", sum(q) AS "Q" FROM g),
x AS (SELECT score, "TP", "FP", "FP" / "Q"::DOUBLE AS fpr, "TP" / "P"::DOUBLE AS tpr, "TP" / ("TP" + "FP")::DOUBLE AS precision FROM r, t)"""


@query(f"{_ROC} SELECT * FROM x")
def roc_points(spark: SparkSession, d: str) -> DataFrame:
    """A15."""
    return aggregates.curve_points(given(spark, d, _PREDICTED)).drop("fpr_before", "tpr_before")


@query(f"""{_ROC}, s AS (SELECT *, coalesce(lag(fpr) OVER (ORDER BY score DESC), 0) AS x0, coalesce(lag(tpr) OVER (ORDER BY score DESC), 0) AS y0 FROM x)
SELECT round(sum((fpr - x0) * (tpr + y0) / 2), 9) AS roc_auc, round(sum((tpr - y0) * precision), 9) AS average_precision FROM s""")
def roc_area(spark: SparkSession, d: str) -> DataFrame:
    """A15."""
    return aggregates.area_under_curve(aggregates.curve_points(given(spark, d, _PREDICTED))).select(F.round("roc_auc", 9).alias("roc_auc"), F.round("average_precision", 9).alias("average_precision"))


def _negatives(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = given(spark, d, "SELECT doc_id AS id, source AS project, 'u/' || source AS project_url, CASE WHEN doc_id % 10 < 3 THEN 'a.js' ELSE 'f' || CAST(doc_id % 9 AS STRING) END AS file_path, CASE WHEN doc_id % 13 = 0 THEN 'aes fix' ELSE 'change' END AS message FROM {documents}")
    negatives = docs.filter("id % 3 > 0").select("project", F.md5(F.col("id").cast("string")).alias("sha"), "file_path", "message")
    return docs.filter("id % 3 = 0").drop("message"), negatives


_NEG_SQL = """docs AS (SELECT doc_id AS id, source AS project, 'u/' || source AS project_url, CASE WHEN doc_id % 10 < 3 THEN 'a.js' ELSE 'f' || (doc_id % 9) END AS file_path FROM documents)"""


@query(f"""WITH {_NEG_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY project, file_path ORDER BY {_random(15, 'id')}, id) AS r FROM docs WHERE id % 3 = 0),
n AS (SELECT DISTINCT project, md5(id::VARCHAR) AS sha, file_path FROM docs WHERE id % 3 > 0 AND id % 13 > 0), b AS (SELECT *, row_number() OVER (PARTITION BY project, file_path ORDER BY md5('15:' || sha || ':' || file_path), sha) AS r FROM n),
g AS (SELECT project, file_path AS path, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM (SELECT project, file_path, 1 AS a, 0 AS b FROM v UNION ALL SELECT project, file_path, 0, 1 FROM n) GROUP BY 1, 2), z AS (SELECT project, sum(a) AS sa, sum(b) AS sb, greatest(sum(a), sum(b), max(a + b))::BIGINT AS m FROM g GROUP BY 1),
o AS (SELECT project, path, a, b, 0 AS over FROM g UNION ALL SELECT project, NULL, m - sa, m - sb, 1 FROM z),
w AS (SELECT *, sum(a) OVER p - a AS at_a, sum(b) OVER p - b AS at_b FROM o WINDOW p AS (PARTITION BY project ORDER BY over, {_random(16, "coalesce(path, '')")}, path)), s AS (SELECT project, max(at_b + b - at_a) AS shift, sum(a) AS m FROM w GROUP BY 1),
x AS (SELECT v.*, (at_a + v.r - 1 + shift) % m AS place FROM v JOIN w ON v.project = w.project AND v.file_path = w.path JOIN s ON s.project = v.project), y AS (SELECT b.*, at_b + b.r - 1 AS place FROM b JOIN w ON b.project = w.project AND b.file_path = w.path)
SELECT x.id, x.project, x.project_url, x.file_path, y.sha AS non_vuln_commit_hash, y.file_path AS non_vuln_file_path FROM x LEFT JOIN y ON x.project = y.project AND x.place = y.place""")
def pair_negatives(spark: SparkSession, d: str) -> DataFrame:
    """J12."""
    vulnerable, negatives = _negatives(spark, d)
    return rows.pair_negatives(vulnerable, negatives, 15, ["aes", "access role"])


@query(f"""WITH {_NEG_SQL}, a AS (SELECT project, project_url, row_number() OVER (PARTITION BY project ORDER BY {_random(16, 'id')}, id) AS r FROM docs WHERE id % 3 = 0),
n AS (SELECT project, md5(id::VARCHAR) AS sha, file_path FROM docs WHERE id % 3 > 0), b AS (SELECT project, sha, file_path, row_number() OVER (PARTITION BY project ORDER BY md5('16:' || sha || ':' || file_path), file_path) AS r FROM n)
SELECT a.project, a.project_url, sha AS non_vuln_commit_hash, file_path AS non_vuln_file_path, 'non-vuln' AS dataset FROM a, (VALUES (1), (2)) u(i) JOIN b ON a.project = b.project AND b.r = (a.r - 1) * 2 + u.i""")
def augment(spark: SparkSession, d: str) -> DataFrame:
    """J13."""
    vulnerable, negatives = _negatives(spark, d)
    return rows.augment(vulnerable, negatives, 2, 16)


@query(f"""WITH {_NEG_SQL}, f AS (SELECT project, (id % 40)::VARCHAR AS sha, file_path FROM docs), p AS (SELECT project, sha, count(*) AS n FROM f GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY project ORDER BY {_random(17, 'sha')}, sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY project ORDER BY {_random(17, 'sha')}, sha) AS r FROM p)
SELECT f.project, f.sha, f.file_path FROM f JOIN r ON f.project = r.project AND f.sha = r.sha WHERE before < 20 AND r <= 8""")
def random_files(spark: SparkSession, d: str) -> DataFrame:
    """W09."""
    vulnerable, _ = _negatives(spark, d)
    docs = given(spark, d, "SELECT source AS project, CAST(doc_id % 40 AS STRING) AS sha, CASE WHEN doc_id % 10 < 3 THEN 'a.js' ELSE 'f' || CAST(doc_id % 9 AS STRING) END AS file_path FROM {documents}")
    return rows.random_files(docs, docs.select("project").distinct().withColumn("target", F.lit(20)), 17, 8)


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = given(spark, d, "SELECT l.doc_id AS id, quality AS label, text AS input FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id")
    parts = splits.split_random(s, 18)
    model = models.count_features(parts.filter("split = 'train'"), 200)
    made = models.with_features(parts, model).select("id", F.col("label").cast("double").alias("label"), "features", "split").persist()
    return made.filter("split = 'train'"), made.filter("split <> 'train'")


@query()
def forest_metrics(spark: SparkSession, d: str) -> DataFrame:
    """M01, M02, M06, M07."""
    train, test = _features(spark, d)
    return models.evaluate(models.train_forest(train, grid={"maxDepth": [3, 5], "numTrees": [10]}), test, "RFC")


@query()
def svc_metrics(spark: SparkSession, d: str) -> DataFrame:
    """M03, M06."""
    train, test = _features(spark, d)
    return models.evaluate(models.train_linear_svc(train, grid={"regParam": [0.1]}), test, "SVC")


@query()
def adaboost_metrics(spark: SparkSession, d: str) -> DataFrame:
    """M04."""
    train, test = _features(spark, d)
    return models.evaluate(models.train_adaboost(train, 4), test, "AB")


@query()
def knn_metrics(spark: SparkSession, d: str) -> DataFrame:
    """M05."""
    train, test = _features(spark, d)
    found = models.knn_classify(train, test, 5, "distance").join(test.select("id", "label"), "id")
    return aggregates.confusion_metrics(found, "label", "prediction")
