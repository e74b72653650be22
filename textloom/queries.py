"""One query for each operator, over whole tables, and the SQL each equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textloom.functions import stats
from textloom.functions import text as tx
from textloom.operators import aggregate, heuristics, logits, prepare
from textloom.session import ship_package

#: Window budget, overlap and least length of the queries.
BUDGET, OVERLAP, LEAST = 256, 16, 80
SPACE = tx.SPACE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """One row group of a small file is one task; heavy text work wants more."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def paragraphed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as examples, each line a paragraph, labels attached, doc_id as source order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("label"))
    return spread(docs).join(labels, "doc_id", "left").select("text", "label", F.col("doc_id").alias("seq"))


def windows(spark: SparkSession, sf_dir: str, overlap: int = 0) -> DataFrame:
    return prepare.prepare(paragraphed(spark, sf_dir), prepare.PrepareOptions(BUDGET, overlap, LEAST))


# SQL pieces ---------------------------------------------------------------------------------------------------------
def q_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def q_newlines(x: str) -> str:
    return f"regexp_replace(replace(replace({x}, '\\r\\n', chr(10)), '\\n', chr(10)), '\\r\\n|[\\r\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g')"


def q_normal(x: str) -> str:
    return f"regexp_replace(regexp_replace({q_strip(q_newlines(x))}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


def q_tokens(x: str) -> str:
    return f"((length({x}) + 3) // 4)::INT"


def q_parts(lists: str) -> str:
    return f"list_filter(list_transform({lists}, lambda z: {q_strip('z')}), lambda z: z <> '')"


def q_sentences(x: str) -> str:
    return q_parts(f"regexp_split_to_array(regexp_replace({q_strip(x)}, '([.!?])[{SPACE}]+', '\\1' || chr(1), 'g'), '\\x01|\\n+')")


def q_packing(x: str) -> str:
    return q_parts(f"string_split(regexp_replace({x}, '([.!?])[{SPACE}]+([A-Z0-9\"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1))")


def q_words(x: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_{SPACE}]', ' ', 'g'), '[{SPACE}]+'), lambda z: z <> '')"


def q_key(x: str) -> str:
    return f"trim(regexp_replace({q_strip(f'lower({x})')}, '[{SPACE}]+', ' ', 'g'), ' .,!?:;\"''()[]{{}}')"


def q_clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


Q_EXAMPLES = "ex AS (SELECT doc_id AS seq, replace(text, chr(10), chr(10) || chr(10)) AS text, l.label FROM documents LEFT JOIN (SELECT doc_id, max(quality)::VARCHAR AS label FROM labels GROUP BY doc_id) l USING (doc_id))"
Q_WINDOWS = f"""
{Q_EXAMPLES},
nm AS (SELECT seq, label, text, {q_normal('text')} AS n FROM ex),
kp AS (SELECT seq, label, n, sha1(text) AS text_id, {q_tokens('text')} AS estimated_tokens FROM nm WHERE n <> '' AND {q_tokens('n')} >= {LEAST}),
pu AS (SELECT seq, unnest(ps) AS p, generate_subscripts(ps, 1) AS pi FROM (SELECT seq, {q_parts("string_split(n, chr(10) || chr(10))")} AS ps FROM kp WHERE {q_tokens('n')} > {BUDGET})),
un AS (SELECT seq, pi, 1::BIGINT AS si, p AS t, false AS first, true AS whole FROM pu WHERE {q_tokens('p')} <= {BUDGET}
  UNION ALL SELECT seq, pi, si, t, si = 1, false FROM (SELECT seq, pi, unnest(ss) AS t, generate_subscripts(ss, 1) AS si FROM (SELECT seq, pi, {q_packing('p')} AS ss FROM pu WHERE {q_tokens('p')} > {BUDGET}))),
od AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY pi, si) AS i, {q_tokens('t')} AS c FROM un),
rc AS (SELECT seq, i, t, whole, c AS used, 0 AS w FROM od WHERE i = 1
  UNION ALL SELECT o.seq, o.i, o.t, o.whole,
    CASE WHEN o.first OR (o.whole AND NOT r.whole) OR r.used + o.c > {BUDGET} THEN o.c ELSE r.used + o.c END,
    r.w + (o.first OR (o.whole AND NOT r.whole) OR r.used + o.c > {BUDGET})::INT
  FROM rc r JOIN od o ON o.seq = r.seq AND o.i = r.i + 1),
pk AS (SELECT seq, w AS window_index, CASE WHEN bool_and(whole) THEN array_to_string(list(t ORDER BY i), chr(10) || chr(10)) ELSE array_to_string(list(t ORDER BY i), ' ') END AS text FROM rc GROUP BY seq, w
  UNION ALL SELECT seq, 0, n FROM kp WHERE {q_tokens('n')} <= {BUDGET}),
wd AS (SELECT pk.seq, kp.label, kp.text_id, kp.estimated_tokens, window_index, pk.text, lag(pk.text) OVER (PARTITION BY pk.seq ORDER BY window_index) AS before FROM pk JOIN kp USING (seq))"""


def q_features(source: str) -> str:
    """From a relation wd(seq, label, text_id, window_index, text): ft with the features, sc with the score as well."""
    stop = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"
    grams = lambda n: f"list_transform(range(1, greatest(len(k) - {n - 2}, 1)), lambda i: array_to_string(k[i:i + {n - 1}], ' '))"
    repeat = " ".join(f"WHEN len(k) < {2 * n} OR len(list_distinct({grams(n)})) = len({grams(n)}) THEN {n - 1 if n > 2 else 0}" for n in range(2, 13))
    return f"""{source},
pt AS (SELECT *, {q_sentences('text')} AS s, {q_words('text')} AS k, {q_strip(f"regexp_replace(lower(text), '[{SPACE}]+', ' ', 'g')")} AS low FROM wd),
ft AS (SELECT seq, label, text_id, estimated_tokens, window_index,
  CASE WHEN len(k) < 4 THEN 1.0 ELSE len(list_distinct({grams(3)})) / len({grams(3)}) END AS distinct_3gram_ratio,
  CASE {repeat} ELSE 12 END AS longest_repeat_ngram,
  CASE WHEN len(s) <= 1 THEN 0.0 ELSE (len(s) - len(list_distinct(list_transform(s, lambda z: {q_key('z')})))) / len(s) END AS repeated_sentence_ratio,
  coalesce(list_var_samp(list_transform(s, lambda z: len({q_words('z').replace('lambda z', 'lambda y').replace('z <>', 'y <>')})::DOUBLE)), 0.0) AS sentence_len_var,
  coalesce(list_entropy(regexp_extract_all(text, '[.,;:!?()\\[\\]"''—\\-]')), 0.0) AS punctuation_entropy,
  coalesce(list_var_samp(list_transform(list_transform(s, lambda z: {q_words('z').replace('lambda z', 'lambda y').replace('z <>', 'y <>')}),
    lambda q: CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_filter(q, lambda y: list_contains({stop}, y))) / len(q) END)), 0.0) AS stopword_ratio_var,
  CASE WHEN length(low) < 20 THEN 0.0 ELSE list_entropy(list_transform(range(1, length(low) - 1), lambda i: substr(low, i, 3))) END AS char_trigram_entropy,
  CASE WHEN len(k) < 20 THEN 0.0 ELSE list_entropy(k) END AS word_entropy,
  len(s)::INT AS n_sentences, len(k)::INT AS n_words, length(text)::INT AS n_chars FROM pt),
s1 AS (SELECT *, ({q_clamp('(0.80 - distinct_3gram_ratio) / 0.30')} + {q_clamp('(longest_repeat_ngram - 6.0) / 10.0')} + {q_clamp('(repeated_sentence_ratio - 0.02) / 0.15')}) / 3.0 AS rep,
  ({q_clamp('(8.0 - sentence_len_var) / 12.0')} + {q_clamp('(1.6 - punctuation_entropy) / 1.6')} + {q_clamp('(0.020 - stopword_ratio_var) / 0.020')}) / 3.0 AS eve,
  ({q_clamp('(3.5 - char_trigram_entropy) / 2.0')} + {q_clamp('(6.5 - word_entropy) / 3.0')}) / 2.0 AS pov, {q_clamp('(n_words - 80) / 200.0')} AS gate FROM ft),
s2 AS (SELECT *, CASE WHEN gate < 0.25 THEN 0.6 * (0.5 * rep + 0.3 * eve + 0.2 * pov) + 0.2 ELSE 0.5 * rep + 0.3 * eve + 0.2 * pov END AS raw FROM s1),
sc AS (SELECT *, {q_clamp('0.5 + gate * (raw - 0.5)')} AS heuristics_score FROM s2)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


DECIMALS = 6
rounded = lambda c: F.round(F.col(c).cast("double"), DECIMALS).alias(c.rsplit(".", 1)[-1])


# Scalar text functions ----------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, {q_normal('text')} AS normalized, {q_tokens(q_normal('text'))} AS estimated_tokens, sha1({q_normal('text')}) AS text_id FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("normalized", tx.normalize_text(F.col("text")))
    return docs.select("doc_id", "normalized", tx.estimated_tokens(F.col("normalized")).alias("estimated_tokens"), tx.text_id(F.col("normalized")).alias("text_id"))


@query(f"SELECT page_id, sha1({q_newlines('html')}) AS lines_id, length({q_newlines('html')}) AS n FROM pages")
def normalize_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.normalize_newlines(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", tx.text_id(t).alias("lines_id"), F.length(t).cast("long").alias("n"))


@query("SELECT doc_id, sha1(text) AS text_id, ((length(text) + 3) // 4)::INT AS estimated_tokens, right(text, 64) AS tail FROM documents")
def text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.text_id(t).alias("text_id"), tx.estimated_tokens(t).alias("estimated_tokens"), tx.tail(t, 64).alias("tail"))


@query(f"SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1)::INT - 1 AS place FROM (SELECT doc_id, {q_sentences('text')} AS s FROM documents)")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("place", "sentence"))


@query(f"SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1)::INT - 1 AS place FROM (SELECT doc_id, {q_packing('text')} AS s FROM documents)")
def split_packing_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(tx.packing_sentences(F.col("text"))).alias("place", "sentence"))


@query(f"SELECT doc_id, len(k)::INT AS n_words, sha1(array_to_string(k, ' ')) AS words_id FROM (SELECT doc_id, {q_words('text')} AS k FROM documents)")
def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("k", tx.words(F.col("text")))
    return docs.select("doc_id", F.size("k").alias("n_words"), tx.text_id(F.array_join("k", " ")).alias("words_id"))


@query(f"SELECT doc_id, {q_key('z')} AS k, count(*) AS n FROM (SELECT doc_id, unnest({q_sentences('text')}) AS z FROM documents) GROUP BY 1, 2")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("z")).groupBy("doc_id", tx.normalize_sentence(F.col("z")).alias("k")).agg(F.count("*").alias("n"))


# Filters and windows ------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, n <> '' AND {q_tokens('n')} >= {LEAST} AS kept FROM (SELECT doc_id, {q_normal('text')} AS n FROM documents)")
def keep_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("n", tx.normalize_text(F.col("text")))
    return docs.select("doc_id", prepare.keep_text(F.col("n"), LEAST).alias("kept"))


@query(f"WITH RECURSIVE {Q_WINDOWS} SELECT seq, label, text_id, estimated_tokens, window_index, sha1(text) AS window_text_id, {q_tokens('text')} AS window_estimated_tokens, text FROM wd")
def prepare_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).select("seq", "label", "meta.text_id", "meta.estimated_tokens", "meta.window_index", "meta.window_text_id", "meta.window_estimated_tokens", "text")


@query(f"""WITH RECURSIVE {Q_WINDOWS}, ov AS (SELECT *, CASE WHEN before IS NULL THEN text ELSE {q_strip(f"right(before, {4 * OVERLAP}) || chr(10) || chr(10) || text")} END AS full FROM wd)
SELECT seq, text_id, window_index, sha1("full") AS window_text_id, {q_tokens('"full"')} AS window_estimated_tokens FROM ov""")
def prepare_overlapping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir, OVERLAP).select("seq", "meta.text_id", "meta.window_index", "meta.window_text_id", "meta.window_estimated_tokens")


@query(f"SELECT count(*) AS examples, count(*) FILTER (NOT (n <> '' AND {q_tokens('n')} >= {LEAST})) AS dropped FROM (SELECT {q_normal('text')} AS n FROM documents)")
def dropped_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many examples there were and how many were too short, observed while they are prepared."""
    seen = Observation()
    docs = spread(table(spark, sf_dir, "documents").select("text", F.col("doc_id").alias("seq")))
    prepare.prepare(docs, prepare.PrepareOptions(min_estimated_tokens=LEAST), seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["examples"], seen.get["dropped"])], "examples long, dropped long")


@query(f"WITH {Q_EXAMPLES} SELECT seq, label, sha1(n) AS text_id, {q_tokens('n')} AS estimated_tokens FROM (SELECT seq, label, {q_normal('text')} AS n FROM ex) WHERE n <> '' AND {q_tokens('n')} >= {LEAST}")
def prepare_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = prepare.prepare(paragraphed(spark, sf_dir), prepare.PrepareOptions(normalize=True))
    return done.select("seq", "label", "meta.text_id", "meta.estimated_tokens")


@query(f"""WITH RECURSIVE {Q_WINDOWS} SELECT seq, sha1(array_to_string(list(text ORDER BY window_index), chr(10) || chr(10) || '--- WINDOW ---' || chr(10) || chr(10))) AS joined_id, count(*) AS n FROM wd GROUP BY seq""")
def joined_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.plans.pipelines import SEPARATOR

    kept = paragraphed(spark, sf_dir).withColumn("n", tx.normalize_text(F.col("text"))).filter(prepare.keep_text(F.col("n"), LEAST))
    split = prepare.split_into_windows(kept, BUDGET)
    return split.select("seq", tx.text_id(F.array_join("windows", SEPARATOR)).alias("joined_id"), F.size("windows").cast("long").alias("n"))


# Features -----------------------------------------------------------------------------------------------------------
INTS = ("longest_repeat_ngram", "n_sentences", "n_words", "n_chars")
Q_ROUND = ", ".join(f"{n}::INT AS {n}" if n in INTS else f"round({n}, {DECIMALS}) AS {n}" for n in heuristics.FEATURES)
Q_ALL = "WITH RECURSIVE " + q_features(Q_WINDOWS)


@query(f"{Q_ALL} SELECT seq, window_index, {Q_ROUND}, round(heuristics_score, {DECIMALS}) AS heuristics_score FROM sc")
def heuristics_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = heuristics.window_features(windows(spark, sf_dir))
    return rows.select("seq", "meta.window_index", *[F.col(f"features.{n}").cast("int").alias(n) if n in INTS else rounded(f"features.{n}") for n in heuristics.FEATURES], rounded("heuristics_score"))


Q_FIRST = "SELECT seq, label, row_number() OVER (PARTITION BY text_id ORDER BY seq, window_index) AS r, text_id FROM sc"


@query(f"""{Q_ALL} SELECT text_id, min(seq) AS seq, any_value(f.label) AS label, 'doc' AS level, {', '.join(f'round(avg({n}), {DECIMALS}) AS {n}' for n in heuristics.FEATURES)}, round(avg(heuristics_score), {DECIMALS}) AS heuristics_score
FROM sc JOIN (SELECT text_id, label FROM ({Q_FIRST}) WHERE r = 1) f USING (text_id) GROUP BY text_id""")
def heuristics_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = heuristics.document_means(heuristics.window_features(windows(spark, sf_dir)))
    return rows.select("meta.text_id", "seq", "label", "meta.level", *[rounded(f"features.{n}") for n in heuristics.FEATURES], rounded("heuristics_score"))


@query(f"""{Q_ALL} SELECT coalesce(level, 'window') AS level, count(*) AS n, round(sum(heuristics_score), 4) AS total FROM (
SELECT NULL AS level, heuristics_score FROM sc UNION ALL SELECT 'doc', avg(heuristics_score) FROM sc GROUP BY text_id) GROUP BY 1""")
def heuristics_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = heuristics.compute_heuristics(windows(spark, sf_dir))
    own, docs = heuristics.by_level(rows)
    both = own.withColumn("kind", F.lit("window")).unionByName(docs.withColumn("kind", F.lit("doc")))
    return both.groupBy(F.col("kind").alias("level")).agg(F.count("*").alias("n"), F.round(F.sum("heuristics_score"), 4).alias("total"))


@query(f"""{Q_ALL} SELECT text_id, {', '.join(f'round(avg({n}), {DECIMALS}) AS mean_{n}, round(stddev_pop({n}), {DECIMALS}) AS std_{n}' for n in sorted(heuristics.FEATURES))} FROM sc GROUP BY text_id""")
def aggregate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregate.aggregate_documents(heuristics.window_features(windows(spark, sf_dir)), "features")
    return rows.select("meta.text_id", *[rounded(f"features.{p}_{n}") for n in sorted(heuristics.FEATURES) for p in ("mean", "std")])


@query(f"""WITH d AS (SELECT doc_id, text, {q_words('text')} AS k FROM documents)
SELECT doc_id, round(coalesce(list_entropy(regexp_extract_all(text, '[.,;:!?()\\[\\]"''—\\-]')), 0.0), {DECIMALS}) AS punctuation_entropy,
round(CASE WHEN len(k) < 20 THEN 0.0 ELSE list_entropy(k) END, {DECIMALS}) AS word_entropy,
round(CASE WHEN len(k) = 0 THEN 0.0 ELSE len(list_filter(k, lambda y: list_contains({list(tx.STOPWORDS)}, y))) / len(k) END, {DECIMALS}) AS stopword_ratio FROM d""")
def document_variety(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumns({"k": tx.words(F.col("text")), "e": heuristics.features(F.col("text"))})
    values = {"punctuation_entropy": stats.punctuation_entropy(F.col("text")), "word_entropy": F.col("e.word_entropy"), "stopword_ratio": stats.stopword_ratio(F.col("k"))}
    return docs.select("doc_id", *[F.round(v, DECIMALS).alias(n) for n, v in values.items()])


@query("SELECT label, count(*) AS n, min(doc_id) AS first FROM (SELECT d.doc_id, coalesce(l.quality::VARCHAR, 'none') AS label FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY label")
def attach_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("label")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query(f"""SELECT coalesce(d.source, 'unknown') AS doc_id, any_value(f.label) AS label, round(avg(n_chars) FILTER (doc_id % 3 <> 0), {DECIMALS}) AS mean_n_chars, round(stddev_pop(n_chars) FILTER (doc_id % 3 <> 0), {DECIMALS}) AS std_n_chars,
round(avg((n_chars > 1500)::INT) FILTER (doc_id % 3 <> 0), {DECIMALS}) AS mean_long, round(stddev_pop((n_chars > 1500)::INT) FILTER (doc_id % 3 <> 0), {DECIMALS}) AS std_long
FROM documents d JOIN (SELECT source, lang AS label, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) f ON f.source = d.source AND f.r = 1 GROUP BY 1""")
def aggregate_mixed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a source as windows of one document: text among the features, and rows without any."""
    docs = table(spark, sf_dir, "documents")
    some = F.struct("lang", F.col("n_chars").alias("n_chars"), (F.col("n_chars") > 1500).alias("long"))
    rows = docs.select(F.col("lang").alias("label"), F.col("doc_id").alias("seq"), F.struct(F.col("source").alias("doc_id")).alias("meta"), F.when(F.col("doc_id") % 3 != 0, some).alias("own"))
    done = aggregate.aggregate_documents(rows, "own", "doc_id")
    return done.select("meta.doc_id", "label", *[rounded(f"own.{p}_{n}") for n in ("n_chars", "long") for p in ("mean", "std")])


# Logits -------------------------------------------------------------------------------------------------------------
SEQUENCE, SHARPNESS, PAD = 25, 10.0, 3


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as logits of a 64-word model: 25 of them a sequence, the last two of each masked."""
    x = F.transform("embedding", lambda v: v.cast("double") * SHARPNESS)
    pos = (F.col("vec_id") % SEQUENCE).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / SEQUENCE).alias("seq_id"), pos.alias("pos"), x.alias("logits"), F.col("label").alias("token"), (pos < SEQUENCE - 2).alias("attended"))


Q_POSITIONS = f"""p0 AS (SELECT vec_id // {SEQUENCE} AS seq_id, (vec_id % {SEQUENCE})::INT AS pos, list_transform(embedding, lambda v: v::DOUBLE * {SHARPNESS}) AS x, label AS token, vec_id % {SEQUENCE} < {SEQUENCE - 2} AS att FROM embeddings),
p1 AS (SELECT *, lead(token) OVER (PARTITION BY seq_id ORDER BY pos) AS y, lead(att) OVER (PARTITION BY seq_id ORDER BY pos) AS m, list_reverse(x) AS r FROM p0),
p2 AS (SELECT *, ln(list_sum(list_transform(x, lambda v: exp(v)))) AS z FROM p1 WHERE y IS NOT NULL),
tk AS (SELECT seq_id, pos, m, y, x, r, z, x[y + 1] - z AS logprob, z - list_sum(list_transform(x, lambda v: exp(v - z) * v)) AS entropy, exp(list_max(x) - z) AS top1_prob,
  list_reverse_sort(x)[1] - list_reverse_sort(x)[2] AS top1_margin, len(list_filter(x, lambda v: v > x[y + 1])) < 10 AS in_top10 FROM p2)"""


@query(f"WITH {Q_POSITIONS} SELECT seq_id, pos, round(logprob, {DECIMALS}) AS logprob, round(entropy, {DECIMALS}) AS entropy, round(top1_prob, {DECIMALS}) AS top1_prob, round(top1_margin, {DECIMALS}) AS top1_margin, in_top10 FROM tk")
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logits.token_statistics(logits.shifted(positions(spark, sf_dir)))
    return rows.select("seq_id", "pos", *map(rounded, ("logprob", "entropy", "top1_prob", "top1_margin")), "in_top10")


Q_SUMMARY = f"""SELECT seq_id, avg(logprob) AS mean_logprob, stddev_pop(logprob) AS std_logprob, quantile_cont(logprob, 0.1) AS p10_logprob, quantile_cont(logprob, 0.5) AS p50_logprob, quantile_cont(logprob, 0.9) AS p90_logprob,
avg(entropy) AS mean_entropy, avg(top1_prob) AS mean_top1_prob, avg((top1_prob > 0.8)::INT) AS frac_top1_gt_0p8, avg(top1_margin) AS mean_top1_margin, avg(in_top10::INT) AS frac_true_in_top10, count(*) + 1 AS n_tokens FROM tk WHERE m GROUP BY seq_id"""


@query(f"WITH {Q_POSITIONS} SELECT seq_id, {', '.join(f'round({n}, {DECIMALS}) AS {n}' for n in logits.SUMMARY)}, n_tokens::INT AS n_tokens FROM ({Q_SUMMARY})")
def logits_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits.summarize_logits(positions(spark, sf_dir)).select("seq_id", *map(rounded, logits.SUMMARY), "n_tokens")


@query(f"SELECT vec_id // 2 AS seq_id, {', '.join(f'0.0::DOUBLE AS {n}' for n in logits.SUMMARY)}, count(*)::INT AS n_tokens FROM embeddings GROUP BY 1")
def logits_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of two tokens or fewer have zeros and their length."""
    pairs = positions(spark, sf_dir).withColumns({"n": F.col("seq_id") * SEQUENCE + F.col("pos"), "attended": F.lit(True)})
    short = pairs.select(F.floor(F.col("n") / 2).alias("seq_id"), (F.col("n") % 2).cast("int").alias("pos"), "logits", "token", "attended")
    return logits.summarize_logits(short).select("seq_id", *logits.SUMMARY, "n_tokens")


@query(f"""WITH {Q_POSITIONS} SELECT (seq_id // 4)::VARCHAR AS doc_id, {', '.join(f'round(avg({n}), {DECIMALS}) AS mean_{n}, round(stddev_pop({n}), {DECIMALS}) AS std_{n}' for n in sorted([*logits.SUMMARY, 'n_tokens']))} FROM ({Q_SUMMARY}) GROUP BY 1""")
def logits_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logits.summarize_logits(positions(spark, sf_dir))
    names = [*logits.SUMMARY, "n_tokens"]
    own = rows.select(F.lit(None).cast("string").alias("label"), F.col("seq_id").alias("seq"), F.struct(F.floor(F.col("seq_id") / 4).cast("string").alias("doc_id")).alias("meta"), F.struct(*names).alias("logits_features"))
    done = aggregate.aggregate_documents(own, "logits_features", "doc_id")
    # document 0 has the id '0': a string, so not a missing one
    return done.select("meta.doc_id", *[rounded(f"logits_features.{p}_{n}") for n in sorted(names) for p in ("mean", "std")])


@query(f"""WITH {Q_POSITIONS}, b AS (SELECT seq_id, m, y, -logprob AS o, -(r[y + 1] - z) AS p, -list_sum(list_transform(range(1, 65), lambda i: exp(x[i] - z) * (r[i] - z))) AS h FROM tk),
g AS (SELECT seq_id, sum(CASE WHEN m THEN o ELSE 0 END) / greatest(count(*) FILTER (m), 1) AS obs_ppl_nll_mean, sum(CASE WHEN m THEN p ELSE 0 END) / greatest(count(*) FILTER (m), 1) AS perf_ppl_nll_mean,
  sum(CASE WHEN y <> {PAD} THEN h ELSE 0 END) / greatest(count(*) FILTER (y <> {PAD}), 1) AS xent_mean FROM b GROUP BY seq_id)
SELECT seq_id, round(obs_ppl_nll_mean / (xent_mean + 1e-8), {DECIMALS}) AS score_obs_raw, round(perf_ppl_nll_mean / (xent_mean + 1e-8), {DECIMALS}) AS score_perf_raw, round(obs_ppl_nll_mean, {DECIMALS}) AS obs_ppl_nll_mean,
  round(perf_ppl_nll_mean, {DECIMALS}) AS perf_ppl_nll_mean, round(xent_mean, {DECIMALS}) AS xent_mean, round({logits.LOW_FPR_THRESHOLD}, {DECIMALS}) AS threshold FROM g""")
def two_model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = positions(spark, sf_dir).withColumnRenamed("logits", "observer").withColumn("performer", F.reverse("observer"))
    names = ("score_obs_raw", "score_perf_raw", "obs_ppl_nll_mean", "perf_ppl_nll_mean", "xent_mean", "threshold")
    return logits.two_model_scores(both, PAD).select("seq_id", *map(rounded, names))


# Files, scorers, streams --------------------------------------------------------------------------------------------
def scored(spark: SparkSession, sf_dir: str) -> tuple:
    from textloom.operators import scoring

    return scoring, *scoring.byte_scorers(table(spark, sf_dir, "documents")), windows(spark, sf_dir)


# Byte models: counts of byte pairs over all documents, then a row for each byte of a window with the byte before it.
Q_BYTES = f"""WITH RECURSIVE {Q_WINDOWS},
dx AS (SELECT hex(encode(text)) AS h FROM documents),
db AS (SELECT ('0x' || h[2 * i - 1:2 * i])::INT AS a, ('0x' || h[2 * i + 1:2 * i + 2])::INT AS b FROM (SELECT h, unnest(range(1, len(h) // 2)) AS i FROM dx)),
dc AS (SELECT a, b, count(*) AS n FROM db GROUP BY a, b),
bv AS (SELECT unnest(range(0, 256))::INT AS v),
lp AS (SELECT x.v AS a, y.v AS b, ln(coalesce(n, 0) + 1.0) AS l FROM bv x CROSS JOIN bv y LEFT JOIN dc ON dc.a = x.v AND dc.b = y.v UNION ALL SELECT v, 256, -30.0 FROM bv),
zp AS (SELECT a, ln(sum(exp(l))) AS z FROM lp GROUP BY a),
pp AS (SELECT a, b, l - z AS logp, (count(*) OVER (PARTITION BY a ORDER BY l DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY a, l)) < 10 AS top FROM lp JOIN zp USING (a)),
ls AS (SELECT v AS b, ln(coalesce(sum(n), 0) + 1.0) AS l FROM bv LEFT JOIN dc ON dc.b = v GROUP BY v UNION ALL SELECT 256, -30.0),
ps AS (SELECT b, l - (SELECT ln(sum(exp(l))) FROM ls) AS logq FROM ls),
pr AS (SELECT a, -sum(exp(logp) * logp) AS entropy, exp(max(logp)) AS top1, (max(logp, 2))[1] - (max(logp, 2))[2] AS margin, -sum(exp(logp) * logq) AS cross_ FROM pp JOIN ps USING (b) GROUP BY a),
wx AS (SELECT seq, text_id, window_index, hex(encode(text)) AS h FROM wd),
wb AS (SELECT seq, text_id, window_index, ('0x' || h[2 * i - 1:2 * i])::INT AS a, ('0x' || h[2 * i + 1:2 * i + 2])::INT AS b FROM (SELECT *, unnest(range(1, len(h) // 2)) AS i FROM wx)),
ws AS (SELECT * FROM wb JOIN pp USING (a, b) JOIN pr USING (a) JOIN ps USING (b))"""


@query(f"""{Q_BYTES}, g AS (SELECT seq, window_index, avg(logp) AS mean_logprob, stddev_pop(logp) AS std_logprob, quantile_cont(logp, 0.1) AS p10_logprob, quantile_cont(logp, 0.5) AS p50_logprob, quantile_cont(logp, 0.9) AS p90_logprob,
  avg(entropy) AS mean_entropy, avg(top1) AS mean_top1_prob, avg((top1 > 0.8)::INT) AS frac_top1_gt_0p8, avg(margin) AS mean_top1_margin, avg(top::INT) AS frac_true_in_top10 FROM ws GROUP BY seq, window_index)
SELECT wx.seq, wx.window_index, {', '.join(f'round(CASE WHEN len(h) < 6 THEN 0.0 ELSE {n} END, {DECIMALS}) AS {n}' for n in logits.SUMMARY)}, (len(h) // 2)::INT AS n_tokens FROM wx LEFT JOIN g USING (seq, window_index)""")
def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logit features of each whole window under a byte-pair model counted over all documents."""
    scoring, pair, _, digest, prepared = scored(spark, sf_dir)
    rows = scoring.logits_features(prepared, pair, f"pair:{digest}", max_tokens=None)
    return rows.select("seq", "meta.window_index", *[rounded(f"logits_features.{n}") for n in logits.SUMMARY], "logits_features.n_tokens")


@query(f"""{Q_BYTES}, g AS (SELECT seq, window_index, -avg(logp) AS o, -avg(logq) AS p, avg(cross_) AS x FROM ws GROUP BY seq, window_index),
w AS (SELECT text_id, coalesce(o, 0.0) / (coalesce(x, 0.0) + 1e-8) AS score_obs_raw, coalesce(p, 0.0) / (coalesce(x, 0.0) + 1e-8) AS score_perf_raw, coalesce(x, 0.0) AS xent_mean FROM wx LEFT JOIN g USING (seq, window_index))
SELECT text_id, round(avg(score_obs_raw), {DECIMALS}) AS score_obs_raw, round(avg(score_perf_raw), {DECIMALS}) AS score_perf_raw, round(avg(xent_mean), {DECIMALS}) AS xent_mean, round({logits.LOW_FPR_THRESHOLD}, {DECIMALS}) AS threshold FROM w GROUP BY text_id""")
def two_model_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-model features of each whole window, means by document."""
    scoring, pair, single, digest, prepared = scored(spark, sf_dir)
    rows = scoring.two_model_features(prepared, pair, single, scoring.TwoModelOptions(f"pair:{digest}", f"single:{digest}", max_tokens=None))
    done = aggregate.aggregate_documents(rows, "binoculars_features")
    return done.select("meta.text_id", *[rounded(f"binoculars_features.mean_{n}").alias(n) for n in ("score_obs_raw", "score_perf_raw", "xent_mean", "threshold")])


Q_JSON = f"WITH RECURSIVE {Q_WINDOWS} SELECT text_id, window_index, label, sha1(text) AS window_text_id, length(text)::BIGINT AS n FROM wd"


@query(Q_JSON)
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared windows written as lines of JSON and read back."""
    from textloom.session import Workspace
    from textloom.sources.readers import read_prepared
    from textloom.sources.writers import write_jsonl

    work = Workspace(spark, "jsonl")
    write_jsonl(windows(spark, sf_dir), work.path("prepared"))
    rows = read_prepared(spark, work.path("prepared"))
    return rows.select("meta.text_id", "meta.window_index", F.try_variant_get("label", "$", "string").alias("label"), tx.text_id(F.col("text")).alias("window_text_id"), F.length("text").cast("long").alias("n"))


@query("SELECT sha1(text || chr(10)) AS text_id, count(*) AS n FROM (SELECT replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM benchmark) GROUP BY 1")
def text_files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file for each benchmark item, found again by its suffix."""
    from textloom.session import Workspace
    from textloom.sources.readers import read_files
    from textloom.sources.writers import write_texts

    work = Workspace(spark, "texts")
    write_texts(table(spark, sf_dir, "benchmark"), work.path("files"), one_each=True)
    return read_files(spark, work.path("files") + "/*.txt").groupBy(tx.text_id(F.col("text")).alias("text_id")).agg(F.count("*").alias("n"))


@query(f"""{Q_ALL} SELECT text_id, 'doc' AS level, any_value(f.label) AS label, round(avg(heuristics_score), {DECIMALS}) AS heuristics_score, round(avg(n_words), {DECIMALS}) AS n_words
FROM sc JOIN (SELECT text_id, label FROM ({Q_FIRST}) WHERE r = 1) f USING (text_id) GROUP BY text_id""")
def document_object_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rows written as one JSON object and read back."""
    from textloom.session import Workspace
    from textloom.sources.writers import write_documents

    work = Workspace(spark, "documents")
    write_documents(heuristics.document_means(heuristics.window_features(windows(spark, sf_dir))), work.path("doc.json"))
    schema = "docs array<struct<label: string, meta: struct<text_id: string, level: string>, features: struct<n_words: double>, heuristics_score: double>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(work.path("doc.json")).select(F.explode("docs").alias("d"))
    return rows.select("d.meta.text_id", "d.meta.level", "d.label", rounded("d.heuristics_score"), rounded("d.features.n_words"))
