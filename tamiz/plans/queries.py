"""Queries over the driver's tables, one for each operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import kernels, phonetic
from tamiz.functions import measures as m
from tamiz.functions import text as tx
from tamiz.operators import edit, hamming, jaccard, vectors
from tamiz.operators import phonetic as ph
from tamiz.plans.search import Algorithm, query_tokens, search, search_batch
from tamiz.sources import catalog as cat
from tamiz.sources.scratch import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, d: str) -> cat.Catalog:
    return cat.from_dataframe(table(spark, d, "part"), "p_partkey", "p_name", order="p_partkey", active=F.lit(1))


def customers(spark: SparkSession, d: str) -> cat.Catalog:
    """Customers by name; those with a negative balance are inactive."""
    return cat.from_dataframe(table(spark, d, "customer"), "c_name", "c_mktsegment", order="c_custkey", active=(F.col("c_acctbal") >= 0).cast("int"))


def r9(c: Column) -> Column:
    return F.round(c.cast("double"), 9)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", r9(F.col("score")))


TOP = "SELECT CAST(rank AS INTEGER) AS rank, id, name, round(score, 9) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, k) AS rank FROM s WHERE score > 0.1) WHERE rank <= 50"
BITS = "CAST(list_sum([bit_count(xor(ord(substr({a}, i, 1)), ord(substr({b}, i, 1)))) FOR i IN range(1, length({a}) + 1)]) AS INTEGER)"
CODE = "Customer#000000123"


@query(f"WITH s AS (SELECT c_custkey AS k, c_name AS id, c_mktsegment AS name, 1 - {BITS.format(a='c_name', b=repr(CODE))} / length(c_name) AS score FROM customer WHERE c_acctbal >= 0 AND length(c_name) = {len(CODE)}) {TOP}")
def search_hamming(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search(customers(spark, d), CODE, Algorithm.HAMMING))


@query(f"SELECT c_custkey, c_name FROM customer WHERE length(c_name) = {len(CODE)} AND {BITS.format(a='c_name', b=repr(CODE))} = 1")
def sku_typos(spark: SparkSession, d: str) -> DataFrame:
    return hamming.sku_typos(table(spark, d, "customer"), CODE, "c_name").select("c_custkey", "c_name")


@query(f"SELECT c_custkey, c_name FROM customer WHERE length(c_name) = {len(CODE)} AND hamming(c_name, '{CODE}') = 1")
def position_typos(spark: SparkSession, d: str) -> DataFrame:
    return hamming.position_typos(table(spark, d, "customer"), CODE, "c_name").select("c_custkey", "c_name")


@query(f"SELECT a.c_custkey, {BITS.format(a='a.c_name', b='b.s_name')} AS bits, CAST(hamming(a.c_name, b.s_name) AS INTEGER) AS positions FROM customer a JOIN supplier b ON a.c_custkey = b.s_suppkey")
def hamming_distances(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey"))
    return both.select("c_custkey", m.hamming_bits(F.col("c_name"), F.col("s_name")).alias("bits"), m.hamming_positions(F.col("c_name"), F.col("s_name")).alias("positions"))


WORDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("SELECT * FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(bit_count(xor(CAST(l_orderkey AS BIGINT), 4096::BIGINT)) + bit_count(xor(CAST(l_partkey AS BIGINT), 511::BIGINT)) + bit_count(xor(CAST(l_suppkey AS BIGINT), 7::BIGINT)) + bit_count(xor(CAST(l_linenumber AS BIGINT), 3::BIGINT)) AS INTEGER) AS distance FROM lineitem) WHERE distance <= 12")
def attribute_distance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(*WORDS, F.array(*[F.col(w).cast("long") for w in WORDS]).alias("attributes"))
    return hamming.attribute_distance(rows, [4096, 511, 7, 3], 12).select(*WORDS, "distance")


def bigrams(c: str) -> str:
    return f"list_distinct([substr({c}, i, 2) FOR i IN range(1, length({c}))])"


@query(f"WITH s AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, 2.0 * len(list_intersect({bigrams('p_name')}, {bigrams(repr('red plates'))})) / (len({bigrams('p_name')}) + len({bigrams(repr('red plates'))})) AS score FROM part) {TOP}")
def search_dice(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search(parts(spark, d), "red plates", Algorithm.DICE))


def _bag_sql(words: str, q: list[str]) -> str:
    """Bag Jaccard of a list of words with a fixed one, in single precision."""
    fixed = "[" + ", ".join(f"'{t}'" for t in q) + "]"
    inter = f"coalesce(list_sum([least(len(list_filter({words}, lambda x: x = t)), len(list_filter({fixed}, lambda x: x = t))) FOR t IN list_distinct({fixed})]), 0)"
    return f"CAST(CAST({inter} / (len({words}) + {len(q)} - {inter}) AS FLOAT) AS DOUBLE)"


PLATE = "red red plate"
STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
PART_WORDS = f"list_filter(regexp_extract_all(p_name, '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({STOP}, w))"


@query(f"WITH w AS (SELECT *, {PART_WORDS} AS words FROM part), s AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, {_bag_sql('words', query_tokens(PLATE))} AS score FROM w) {TOP}")
def search_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search(parts(spark, d), PLATE, Algorithm.JACCARD))


@query(f"WITH w AS (SELECT p_partkey, p_name, {PART_WORDS} AS words FROM part), q AS (SELECT words AS qw FROM w WHERE p_partkey = 7), s AS (SELECT p_partkey AS row_idx, p_name AS name, len(list_intersect(words, qw)) / (len(words) + len(qw) - len(list_intersect(words, qw))) AS score FROM w, q WHERE p_partkey <> 7) SELECT row_idx, name, round(CAST(CAST(score AS FLOAT) AS DOUBLE), 9) AS score FROM s ORDER BY CAST(s.score AS FLOAT) DESC, row_idx LIMIT 50")
def recommend_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(jaccard.recommend(parts(spark, d).tokens, 7, 50))


def _decomposed(c: str) -> str:
    """Text in which an accented letter is a letter and an end of its word."""
    for base, accented in {"a": "áàâäãå", "e": "éèêë", "i": "íìîï", "o": "óòôöõ", "u": "úùûü", "c": "ç", "n": "ñ", "y": "ýÿ"}.items():
        c = f"regexp_replace({c}, '[{accented}]', '{base}' || chr(769), 'g')"
        c = f"regexp_replace({c}, '[{accented.upper().replace('Ÿ', '')}]', '{base.upper()}' || chr(769), 'g')"
    return c


DOC_TOKENS = f"""
t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all({_decomposed('text')}, '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({STOP}, w))) AS w FROM documents),
f AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS n FROM documents d LEFT JOIN f USING (doc_id) GROUP BY ALL)"""


@query(f"""WITH {DOC_TOKENS},
p AS (SELECT a.doc_id AS i, b.doc_id AS j, sum(least(a.tf, b.tf)) AS x FROM f a JOIN f b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY ALL),
s AS (SELECT i, j, CAST(x / (a.n + b.n - x) AS FLOAT) AS score FROM p JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j
      UNION ALL SELECT a.doc_id, b.doc_id, 1 FROM n a JOIN n b ON a.n = 0 AND b.n = 0 AND a.doc_id < b.doc_id)
SELECT i, j, round(CAST(score AS DOUBLE), 5) AS score FROM s WHERE score >= CAST(0.8 AS FLOAT)""")
def duplicates_jaccard(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), tx.word_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return jaccard.duplicates(docs, 0.8).withColumn("score", F.round(F.col("score").cast("double"), 5))


@query(f"""WITH {DOC_TOKENS}, x AS (SELECT doc_id, list_sort(list(w || chr(1) || tf)) AS bag FROM f GROUP BY ALL), y AS (SELECT d.doc_id, x.bag FROM documents d LEFT JOIN x USING (doc_id))
SELECT doc_id AS row_idx, min(doc_id) OVER (PARTITION BY bag) AS bag FROM y""")
def duplicate_bags(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), tx.word_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return jaccard.duplicate_groups(docs, 0.8)[0]


NEAR = "red plato"
#: Jaro-Winkler similarity of a part's name and {q}, with the length rule, and a prefix bonus at any similarity.
_WINK = "CASE WHEN (greatest(length(p_name), length({q})) // 2 - 1 > 0 AND abs(length(p_name) - length({q})) >= 2 * (greatest(length(p_name), length({q})) // 2 - 1)) OR jaro_similarity(p_name, {q}) = 0 THEN 0 ELSE least(1.0, jaro_similarity(p_name, {q}) + len([i FOR i IN range(1, 5) IF substr(p_name, 1, i) = substr({q}, 1, i) AND i <= least(length(p_name), length({q}))]) * 0.1 * (1 - jaro_similarity(p_name, {q}))) END"
_REACH = f"greatest(0, greatest(length(p_name), {len(NEAR)}) // 2 - 1)"
_SAME = f"[i FOR i IN range(1, 5) IF substr(p_name, 1, i) = substr('{NEAR}', 1, i) AND i <= least(length(p_name), {len(NEAR)})]"


@query(f"WITH j AS (SELECT *, CASE WHEN {_REACH} > 0 AND abs(length(p_name) - {len(NEAR)}) >= 2 * {_REACH} THEN 0 ELSE jaro_similarity(p_name, '{NEAR}') END AS jaro, len({_SAME}) AS same FROM part), s AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CASE WHEN jaro = 0 THEN 0 ELSE least(1.0, jaro + same * 0.1 * (1 - jaro)) END AS score FROM j) {TOP}")
def search_jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search(parts(spark, d), NEAR, Algorithm.JARO_WINKLER))


@query(f"WITH s AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, damerau_levenshtein(p_name, '{NEAR}') AS dist FROM part WHERE 1 - damerau_levenshtein(p_name, '{NEAR}') / greatest(length(p_name), {len(NEAR)}) >= 0.85) SELECT CAST(rank AS INTEGER) AS rank, id, name, CAST(1.0 AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (ORDER BY dist, k) AS rank FROM s) WHERE rank <= 50")
def search_damerau(spark: SparkSession, d: str) -> DataFrame:
    return search(parts(spark, d), NEAR, Algorithm.DAMERAU)


@query(f"SELECT p_partkey, CAST(damerau_levenshtein(p_name, '{NEAR}') AS INTEGER) AS distance, round(1 - damerau_levenshtein(p_name, '{NEAR}') / greatest(length(p_name), {len(NEAR)}), 9) AS similarity FROM part WHERE 1 - damerau_levenshtein(p_name, '{NEAR}') / greatest(length(p_name), {len(NEAR)}) >= 0.6")
def edit_range(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    return edit.search(names, NEAR, 0.6).select("p_partkey", "distance", r9(F.col("similarity")).alias("similarity"))


ASKED = ["red plate", "hot bolts", "smal ring", "blue wigdet", "old rod"]
_VALUES = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(ASKED)) + ") q(q_idx, q)"


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ASKED)), "q_idx int, q string")


@query(f"WITH s AS (SELECT q_idx, p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, damerau_levenshtein(p_name, q) AS dist FROM part, {_VALUES} WHERE 1 - damerau_levenshtein(p_name, q) / greatest(length(p_name), length(q)) >= 0.85) SELECT CAST(q_idx AS BIGINT) AS q_idx, CAST(rank AS INTEGER) AS rank, id, name, CAST(1.0 AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_idx ORDER BY dist, k) AS rank FROM s) WHERE rank <= 50")
def batch_damerau(spark: SparkSession, d: str) -> DataFrame:
    return search_batch(parts(spark, d), asked(spark), Algorithm.DAMERAU)


@query(f"""WITH {DOC_TOKENS},
bt AS (SELECT item_id, unnest(list_filter(regexp_extract_all({_decomposed('text')}, '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({STOP}, w))) AS w FROM benchmark),
bf AS (SELECT item_id, w, count(*) AS tf FROM bt GROUP BY ALL), bn AS (SELECT item_id, sum(tf) AS n FROM bf GROUP BY ALL),
p AS (SELECT item_id, doc_id, sum(least(a.tf, b.tf)) AS x FROM bf a JOIN f b ON a.w = b.w GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(CAST(x / (bn.n + n.n - x) AS FLOAT) AS DOUBLE) AS score FROM p JOIN bn USING (item_id) JOIN n USING (doc_id))
SELECT CAST(item_id AS BIGINT) AS q_idx, CAST(rank AS INTEGER) AS rank, id, '' AS name, round(score, 5) AS score FROM (SELECT *, CAST(doc_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0.1) WHERE rank <= 50""")
def batch_jaccard(spark: SparkSession, d: str) -> DataFrame:
    docs = cat.from_dataframe(table(spark, d, "documents"), "doc_id", "text", order="doc_id")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("q_idx"), F.col("text").alias("q"))
    return search_batch(docs, items, Algorithm.JACCARD).withColumn("name", F.lit("")).withColumn("score", F.round("score", 5))


def _plain_sql(c: str) -> str:
    c = f"replace(replace(lower({c}), 'ñ', 'ny'), 'ß', 'ss')"
    for base, accented in tx.PLAIN.items():
        c = f"regexp_replace({c}, '[{accented}]', '{base}', 'g')"
    return f"upper(regexp_replace({c}, '[^a-z0-9]', '', 'g'))"


def _coded_sql(source: str) -> str:
    """CTEs that end in codes(name, pri, sec), the phonetic codes of source's column name: a step for each rule that applies."""
    fits, eaten = [], []
    for pattern, _, _ in phonetic.RULES:
        first, pattern = pattern.startswith(r"\A"), pattern.removeprefix(r"\A")
        behind, pattern = pattern.startswith("(?<=S)"), pattern.removeprefix("(?<=S)")
        body, _, ahead = pattern.partition("(?=")
        whole = f"^({body})" + (f"(?:{ahead[:-1]})" if ahead else "")
        fits.append(f"regexp_matches(rest, '{whole}')" + " AND spot = 1" * first + " AND before = 'S'" * behind)
        eaten.append(f"length(regexp_extract(rest, '{whole}', 1))")
    rule = "CASE " + " ".join(f"WHEN {c} THEN {i + 1}" for i, c in enumerate(fits)) + " ELSE 0 END"
    size = "CASE r " + " ".join(f"WHEN {i + 1} THEN {e}" for i, e in enumerate(eaten)) + " ELSE 1 END"
    out = lambda k: "coalesce([" + ", ".join(f"'{x[k]}'" for x in phonetic.RULES) + "][r], '')"
    return f"""words AS (SELECT DISTINCT name, {_plain_sql('name')} AS word FROM {source}),
steps AS (
  SELECT name, word, CASE WHEN regexp_matches(word, '^(GN|KN|PN|WR)') THEN 2 ELSE 1 END::BIGINT AS spot, '' AS pri, '' AS sec FROM words
  UNION ALL
  SELECT name, word, spot + {size}, left(pri || {out(1)}, 6), left(sec || {out(2)}, 6)
  FROM (SELECT *, {rule} AS r FROM (SELECT *, substr(word, spot) AS rest, substr(word, spot - 1, 1) AS before FROM steps WHERE spot <= length(word) AND length(pri) < 6))),
codes AS (SELECT name, pri, sec FROM steps WHERE spot > length(word) OR length(pri) >= 6)"""


CODED_PARTS = f"WITH RECURSIVE names AS (SELECT DISTINCT p_name AS name FROM part), {_coded_sql('names')}, rows AS (SELECT p_partkey AS row_idx, p_name AS name, pri, sec FROM part JOIN codes ON name = p_name)"
#: A row's distance from a code that differs from it, and whether edits of letters may lead there.
_NEAR = "damerau_levenshtein({a}, {b}) BETWEEN 1 AND 2 AND length(replace({b}, '0', '')) >= length({b}) - length({a}) + length(replace({a}, '0', ''))"


def _sounds_sql(queries: list[tuple[int, str]]) -> str:
    """CTEs that end in sounds(q_idx, row_idx, name, o, score): rows that share a code with a query, or else those near one."""
    values = ", ".join(f"({i}, '{p}', '{s}')" for i, (p, s) in ((i, phonetic.encode(q)) for i, q in queries))
    ring = lambda q, k: f"SELECT q_idx, row_idx, {k} AS ring, min(damerau_levenshtein({q}, code)) AS d FROM rest, (SELECT row_idx, unnest([pri, sec]) AS code FROM rows) WHERE {_NEAR.format(a=q, b='code')} GROUP BY ALL"
    return f"""{CODED_PARTS}, asked AS (SELECT * FROM (VALUES {values}) v(q_idx, qp, qs)),
exact AS (SELECT q_idx, row_idx, CASE WHEN pri = qp THEN 0 WHEN sec = qp THEN 1 WHEN pri = qs THEN 2 ELSE 3 END AS o FROM asked JOIN rows ON pri IN (qp, qs) OR sec IN (qp, qs)),
rest AS (SELECT * FROM asked WHERE q_idx NOT IN (SELECT q_idx FROM exact)),
rings AS ({ring('qp', 0)} UNION ALL {ring('qs', 1)}),
near AS (SELECT q_idx, row_idx, arg_min(d, ring) AS o FROM rings GROUP BY ALL),
sounds AS (SELECT q_idx, row_idx, name, o, score FROM (SELECT *, 1.0::DOUBLE AS score FROM exact UNION ALL SELECT *, 1 - o * 0.3 FROM near) JOIN rows USING (row_idx))"""


@query(f"{_sounds_sql(list(enumerate(ASKED)))} SELECT CAST(q_idx AS BIGINT) AS q_idx, CAST(rank AS INTEGER) AS rank, CAST(row_idx AS VARCHAR) AS id, name, score FROM (SELECT *, row_number() OVER (PARTITION BY q_idx ORDER BY o, row_idx) AS rank FROM sounds) WHERE rank <= 50")
def batch_phonetic(spark: SparkSession, d: str) -> DataFrame:
    return search_batch(parts(spark, d), asked(spark), Algorithm.PHONETIC)


_RANKED = "SELECT CAST(q_idx AS BIGINT) AS q_idx, CAST(rank AS INTEGER) AS rank, id, name, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_idx ORDER BY score DESC, k) AS rank FROM s WHERE score > 0.1) WHERE rank <= 50"
CODES = [CODE, "Customer#000000777", "customer 000000777", "Customer#1"]
_CODES = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(CODES)) + ") q(q_idx, q)"


@query(f"WITH s AS (SELECT q_idx, c_custkey AS k, c_name AS id, c_mktsegment AS name, 1 - {BITS.format(a='c_name', b='q')} / length(c_name) AS score FROM customer, {_CODES} WHERE c_acctbal >= 0 AND length(c_name) = length(q)) {_RANKED}")
def batch_hamming(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search_batch(customers(spark, d), spark.createDataFrame(list(enumerate(CODES)), "q_idx int, q string"), Algorithm.HAMMING))


@query(f"WITH s AS (SELECT q_idx, p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, 2.0 * len(list_intersect({bigrams('p_name')}, {bigrams('q')})) / (len({bigrams('p_name')}) + len({bigrams('q')})) AS score FROM part, {_VALUES}) {_RANKED}")
def batch_dice(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search_batch(parts(spark, d), asked(spark), Algorithm.DICE))


@query(f"WITH s AS (SELECT q_idx, p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, {_WINK.format(q='q')} AS score FROM part, {_VALUES}) {_RANKED}")
def batch_jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search_batch(parts(spark, d), asked(spark), Algorithm.JARO_WINKLER))


_Q0 = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"


def first_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


def labelled_vectors(spark: SparkSession, d: str) -> DataFrame:
    return cat.vectors(table(spark, d, "embeddings"), "label", "embedding", 64, "vec_id")


@query(f"SELECT vec_id AS row_idx, CAST(label AS VARCHAR) AS label, round(list_dot_product(CAST(embedding AS DOUBLE[]), {_Q0}), 5) AS score FROM embeddings ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), {_Q0}) DESC, vec_id DESC LIMIT 10")
def linear_search(spark: SparkSession, d: str) -> DataFrame:
    return vectors.linear_search(labelled_vectors(spark, d), first_vector(spark, d), 10, True).withColumn("score", F.round(F.col("score").cast("double"), 5))


@query(f"SELECT vec_id AS row_idx, CAST(label AS VARCHAR) AS label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q0}), 5) AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q0}) DESC, vec_id DESC LIMIT 10")
def linear_search_cosine(spark: SparkSession, d: str) -> DataFrame:
    return vectors.linear_search(labelled_vectors(spark, d), first_vector(spark, d), 10, False).withColumn("score", F.round(F.col("score").cast("double"), 5))


@query(f"SELECT vec_id AS row_idx, round(pow(list_distance(CAST(embedding AS DOUBLE[]), {_Q0}), 2), 6) AS d2, round(1 - pow(list_distance(CAST(embedding AS DOUBLE[]), {_Q0}), 2) / 2, 6) AS score FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_Q0}), vec_id LIMIT 50")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors.nearest(labelled_vectors(spark, d), first_vector(spark, d), 50)
    return rows.select("row_idx", F.round("d2", 6).alias("d2"), F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS row_idx, round(pow(list_distance(CAST(embedding AS DOUBLE[]), {_Q0}), 2), 6) AS d2, round(1 - pow(list_distance(CAST(embedding AS DOUBLE[]), {_Q0}), 2) / 2, 6) AS score FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_Q0}), vec_id LIMIT 50")
def indexed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The same by an index of cells, exactly."""
    rows = vectors.search_index(vectors.build_index(labelled_vectors(spark, d), 16), first_vector(spark, d), 50)
    return rows.select("row_idx", F.round("d2", 6).alias("d2"), F.round("score", 6).alias("score"))


@query("SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dot, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine, round(pow(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 2), 6) AS d2, round(sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))), 6) AS norm FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_measures(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    a, b = e.select("vec_id", F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "vec_id").select("vec_id", F.round(m.dot(x, y), 6).alias("dot"), F.round(m.cosine(x, y), 6).alias("cosine"), F.round(m.squared_euclid(x, y), 6).alias("d2"), F.round(m.l2_norm(x), 6).alias("norm"))


def _vectors_sql(source: str) -> str:
    """CTEs that end in vecs(name, vec), the mock embeddings of source's column name: the generator's state after each number
    of steps, by the multiplier and increment of so many steps."""
    a, c = kernels._lcg_steps(kernels.DIM)
    big = lambda xs: "[" + ", ".join(f"{x}::UHUGEINT" for x in xs) + "]"
    whole = "18446744073709551616::UHUGEINT"
    seed = f"list_reduce(list_prepend({kernels.FNV_OFFSET}::UHUGEINT, [ord(x)::UHUGEINT FOR x IN string_split(name, '')]), lambda h, b: (xor(h, b) * {kernels.FNV_PRIME}::UHUGEINT) % {whole})"
    part = f"CAST(CAST(((seed * steps.a[i] + steps.c[i]) % {whole}) // 8589934592::UHUGEINT AS FLOAT) / CAST(4294967295 AS FLOAT) * 2 - 1 AS FLOAT)"
    return f"""steps AS (SELECT {big(a)} AS a, {big(c)} AS c), seeds AS (SELECT DISTINCT name, {seed} AS seed FROM {source}),
raws AS (SELECT name, [{part} FOR i IN range(1, {kernels.DIM + 1})] AS raw FROM seeds, steps),
vecs AS (SELECT name, [CAST(x / sqrt(list_dot_product(raw, raw)) AS FLOAT) FOR x IN raw] AS vec FROM raws)"""


RED = "red plate"


@query(f"WITH names AS (SELECT p_name AS name FROM part UNION SELECT '{RED}'), {_vectors_sql('names')}, q AS (SELECT vec AS qv FROM vecs WHERE name = '{RED}'), d AS (SELECT name, round(pow(list_distance(CAST(vec AS DOUBLE[]), CAST(qv AS DOUBLE[])), 2), 9) AS d2 FROM vecs, q) SELECT CAST(row_number() OVER (ORDER BY d2, p_partkey) AS INTEGER) AS rank, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, round(1 - d2 / 2, 5) AS score FROM part JOIN d ON p_name = name ORDER BY d2, p_partkey LIMIT 50")
def search_cosine(spark: SparkSession, d: str) -> DataFrame:
    return search(parts(spark, d), RED, Algorithm.COSINE).withColumn("score", F.round("score", 5))


@query(f"WITH names AS (SELECT p_name AS name FROM part UNION SELECT q FROM {_VALUES}), {_vectors_sql('names')}, d AS (SELECT q_idx, a.name, round(pow(list_distance(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])), 2), 9) AS d2 FROM vecs a, vecs b JOIN {_VALUES} ON b.name = q), r AS (SELECT *, row_number() OVER (PARTITION BY q_idx ORDER BY d2, p_partkey) AS rank FROM part JOIN d ON p_name = name) SELECT CAST(q_idx AS BIGINT) AS q_idx, CAST(rank AS INTEGER) AS rank, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, round(1 - d2 / 2, 5) AS score FROM r WHERE rank <= 50")
def batch_cosine(spark: SparkSession, d: str) -> DataFrame:
    return search_batch(parts(spark, d), asked(spark), Algorithm.COSINE).withColumn("score", F.round("score", 5))


@query(f"WITH names AS (SELECT DISTINCT p_name AS name FROM part), {_vectors_sql('names')} SELECT p_partkey AS row_idx, CAST(len(vec) AS INTEGER) AS dim, round(sqrt(list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[]))), 4) AS norm, round(CAST(vec[1] AS DOUBLE), 3) AS head, round(CAST(vec[{kernels.DIM}] AS DOUBLE), 3) AS tail FROM part JOIN vecs ON p_name = name")
def mock_embeddings(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.round(F.get("vec", F.lit(i)).cast("double"), 3)
    catalog = parts(spark, d)
    return catalog.rows.join(catalog.vectors, "name").select("row_idx", F.size("vec").alias("dim"), F.round(m.l2_norm(F.col("vec")), 4).alias("norm"), at(0).alias("head"), at(kernels.DIM - 1).alias("tail"))


HEARD, MISHEARD = "red pleit", "rad plxate"


@query(f"{_sounds_sql([(0, HEARD)])} SELECT CAST(rank AS INTEGER) AS rank, CAST(row_idx AS VARCHAR) AS id, name, score FROM (SELECT *, row_number() OVER (ORDER BY o, row_idx) AS rank FROM sounds) WHERE rank <= 50")
def phonetic_search(spark: SparkSession, d: str) -> DataFrame:
    return search(parts(spark, d), HEARD, Algorithm.PHONETIC)


@query(f"{_sounds_sql([(0, MISHEARD)])} SELECT row_idx, name, CAST(CASE WHEN EXISTS (FROM exact) THEN 0 ELSE o END AS INTEGER) AS distance, score FROM sounds")
def phonetic_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return ph.fuzzy(parts(spark, d).codes, MISHEARD, 2).select("row_idx", "name", "distance", m.phonetic_score(F.col("distance")).cast("double").alias("score"))


@query(f"{CODED_PARTS} SELECT row_idx, pri, sec FROM rows")
def phonetic_codes(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).codes.select("row_idx", "pri", "sec")


@query(f"{CODED_PARTS} SELECT pri AS code, 'pri' AS slot, row_idx FROM rows UNION ALL SELECT sec, 'sec', row_idx FROM rows")
def phonetic_index(spark: SparkSession, d: str) -> DataFrame:
    return ph.index(parts(spark, d).codes)


@query(f"{CODED_PARTS} SELECT count(DISTINCT pri) AS primary_keys, count(DISTINCT sec) AS secondary_keys, count(*) AS total_records FROM rows")
def phonetic_keys(spark: SparkSession, d: str) -> DataFrame:
    return ph.key_counts(parts(spark, d).codes)


@query(f"{CODED_PARTS} SELECT p_type AS grp, count(DISTINCT pri) = 1 AS alike FROM rows JOIN part ON p_partkey = row_idx GROUP BY ALL")
def phonetic_groups(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "part").select(F.col("p_type").alias("grp"), phonetic.codes(F.col("p_name")).alias("c"))
    return ph.sound_alike(codes.select("grp", "c.pri"))


@query()
def minhash_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Estimated and exact set similarity of neighbouring documents."""
    docs = table(spark, d, "documents").select("doc_id", tx.word_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    signed = jaccard.signatures(docs, 64)
    a, b = signed.select("doc_id", F.col("tokens").alias("x"), F.col("signature").alias("p")), signed.select((F.col("doc_id") - 1).alias("doc_id"), F.col("tokens").alias("y"), F.col("signature").alias("q"))
    exact = F.size(F.array_intersect("x", "y")) / F.greatest(F.size(F.array_union("x", "y")), F.lit(1))
    return a.join(b, "doc_id").select("doc_id", m.minhash_estimate(F.col("p"), F.col("q")).alias("estimate"), exact.alias("exact"))


@query("SELECT c_custkey, regexp_replace(c_name || '-' || c_mktsegment || ' x', '[-\\s]', '', 'g') AS sku FROM customer")
def sku_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", tx.normalize_sku(F.concat("c_name", F.lit("-"), "c_mktsegment", F.lit(" x"))).alias("sku"))


@query(f"SELECT doc_id, md5({_plain_sql('text')}) AS normal, length({_plain_sql('text')}) AS n FROM documents")
def phonetic_normalise(spark: SparkSession, d: str) -> DataFrame:
    normal = tx.normalize_phonetic_upper(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(normal).alias("normal"), F.char_length(normal).cast("long").alias("n"))


@query("SELECT doc_id, length_grapheme(text) AS n_graphemes, length_grapheme(lower(nfc_normalize(text))) AS n_prepared FROM documents")
def graphemes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(tx.graphemes(F.col("text"))).cast("long").alias("n_graphemes"), F.size(tx.preprocess(F.col("text"))).cast("long").alias("n_prepared"))


@query(f"WITH {DOC_TOKENS} SELECT doc_id, w AS token, tf FROM f")
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "documents").select("doc_id", F.explode(tx.word_tokens(F.col("text"))).alias("token"))
    return each.groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


@query(f"SELECT p_partkey, b AS shingle FROM (SELECT p_partkey, unnest({bigrams('p_name')}) AS b FROM part)")
def bigram_shingles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.explode(tx.bigram_shingles(F.col("p_name"))).alias("shingle"))


@query("SELECT p_brand AS id, arg_min(p_name, p_partkey) AS first_name FROM part GROUP BY ALL")
def first_names(spark: SparkSession, d: str) -> DataFrame:
    return cat.from_dataframe(table(spark, d, "part"), "p_brand", "p_name", order="p_partkey").first_names


@query("SELECT c_custkey, printf('%.4f', (c_custkey + 0.25) / 1e6) AS score, printf('%.2f%%', (c_custkey + 0.25) / 1e4) AS percent, printf('%.1f%%', (c_custkey + 0.25) / 1e4) AS shown, least(1.0, greatest(0.0, c_acctbal / 5000)) AS clamped, CASE WHEN c_name = '' THEN NULL ELSE regexp_matches(substr(c_name, 18, 1), '^[0-9]$') END AS digit, regexp_matches(substr(c_name, 18, 1), '^[A-Za-z]$') AS letter FROM customer")
def score_formats(spark: SparkSession, d: str) -> DataFrame:
    share, last = (F.col("c_custkey") + 0.25) / 1e6, F.substring("c_name", 18, 1)
    return table(spark, d, "customer").select(
        "c_custkey", m.format_score(share).alias("score"), m.format_percent(share).alias("percent"), m.format_percent(share, 1).alias("shown"),
        m.clamped(F.col("c_acctbal") / 5000).alias("clamped"), tx.is_numeric_ascii(last).alias("digit"), tx.is_alphabetic_ascii(last).alias("letter"),
    )


@query("SELECT c_name AS id, c_mktsegment AS name, c_name || ', \"' || c_mktsegment || '\"' AS long_name, CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS active FROM customer WHERE c_nationkey NOT IN (3, 5, 7)")
def csv_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as a catalogue file, some rows of it unreadable, too short or too long, and loaded again."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    active = F.when(F.col("c_nationkey") == 3, "no").otherwise((F.col("c_acctbal") >= 0).cast("int").cast("string"))
    fields = ["c_name", "c_mktsegment", quoted(F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))), F.lit(""), F.col("c_acctbal").cast("string"), active]
    line = F.when(F.col("c_nationkey") == 5, F.concat_ws(",", *fields[:4])).when(F.col("c_nationkey") == 7, F.concat_ws(",", *fields, F.lit("1"))).otherwise(F.concat_ws(",", *fields))
    path = scratch(spark, "catalogue")
    head = spark.createDataFrame([(",".join(cat.CSV_COLUMNS),)], "value string")
    head.unionByName(table(spark, d, "customer").select(line.alias("value"))).coalesce(1).write.text(path)  # a file with one header
    return cat.load_csv(spark, path).rows.select("id", "name", "long_name", "active")


@query("SELECT p_type, p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS price, grouping_id(p_type, p_brand) AS level FROM part GROUP BY CUBE (p_type, p_brand)")
def sql_passthrough(spark: SparkSession, d: str) -> DataFrame:
    """Plain SQL over a catalogue table."""
    return spark.sql("SELECT p_type, p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS price, grouping_id() AS level FROM {part} GROUP BY CUBE (p_type, p_brand)", part=table(spark, d, "part"))


@query(f"SELECT p_name AS name, round(max(2.0 * len(list_intersect({bigrams('p_name')}, {bigrams(repr(NEAR))})) / (len({bigrams('p_name')}) + len({bigrams(repr(NEAR))}))), 9) AS dice, CAST(max(damerau_levenshtein(p_name, '{NEAR}')) AS INTEGER) AS edits FROM part GROUP BY ALL")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The measures, called from SQL."""
    from tamiz.functions.sql import register

    register(spark)
    names = table(spark, d, "part").select(F.col("p_name").alias("name"), tx.bigram_shingles(F.col("p_name")).alias("g")).distinct()
    pairs = list(dict.fromkeys(a + b for a, b in zip(NEAR, NEAR[1:], strict=False)))
    return spark.sql(f"SELECT name, round(dice_similarity(g, array({', '.join(repr(x) for x in pairs)})), 9) AS dice, true_damerau(name, '{NEAR}') AS edits FROM {{names}}", names=names)


@query(f"SELECT p_name, count(*) AS n, round(any_value({_WINK.format(q=repr(RED))}), 9) AS score FROM part GROUP BY ALL")
def recommendation_quality(spark: SparkSession, d: str) -> DataFrame:
    """How many rows share a name, by Jaro-Winkler with one name: the kernels over different names only."""
    names = table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    return names.select("p_name", "n", r9(kernels.jaro_winkler_similarity(F.col("p_name"), F.lit(RED))).alias("score"))
