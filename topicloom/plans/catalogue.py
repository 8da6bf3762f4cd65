"""Registered queries of the topic engine and their SQL twins, over whole tables.

Vectors are cast to double and floats rounded to six decimals on both sides; every top-k ends in a unique key.
The given partitions (``lang``, ``source``, ``label``, ``quality``) stand in for topics where a query needs one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.functions import text as X
from topicloom.functions import vectors as V
from topicloom.functions.stopwords import ENGLISH
from topicloom.operators import community, coreset, graph, guided, keywords, knn, metrics, rollups, topics
from topicloom.plans.model import Config, TopicModel, pca
from topicloom.streaming import cumulative

K = 15
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounds(c: F.Column, decimals: int) -> F.Column:
    """As the SQL rounds: halves of the scaled double, away from zero. Spark's round takes the halves of its shortest decimal form."""
    x = F.abs(c) * F.lit(10.0**decimals)
    near = F.rint(x)
    return F.signum(c) * F.when(x - near == 0.5, near + 1).otherwise(near) / F.lit(10.0**decimals)


def r6(c: F.Column) -> F.Column:
    return rounds(c, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})


# ---- shared parts ------------------------------------------------------------------------------------------

LANGS = "CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 ELSE -1 END"


def docs(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("doc_id", "text", F.expr(LANGS).alias("topic_id"))


def vecs(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("int").alias("topic_id"))


def near(s: SparkSession, d: str, k: int = K) -> DataFrame:
    return knn.self_knn(vecs(s, d).select(F.col("doc_id").alias("id"), "v"), k, backend="exact")


D = f"d AS (SELECT doc_id, coalesce(text, '') AS text, {LANGS} AS topic_id FROM documents)"
E = "e AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label AS topic_id FROM embeddings)"
STOP = "(" + ", ".join(f"'{w}'" for w in sorted(ENGLISH)) + ")"
TOK = D + f""", tk AS (SELECT doc_id, topic_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN {STOP}) AS ts FROM d),
tg AS (SELECT doc_id, topic_id, unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]))) AS term FROM tk),
tf AS (SELECT doc_id, topic_id, term, count(*) AS tf FROM tg GROUP BY ALL)"""
UNI = D + """, tk AS (SELECT doc_id, topic_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS ts FROM d),
tf AS (SELECT doc_id, topic_id, term, count(*) AS tf FROM (SELECT doc_id, topic_id, unnest(ts) AS term FROM tk) GROUP BY ALL)"""
CENT = E + """, cp AS (SELECT topic_id, i, avg(x) AS x FROM (SELECT topic_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY ALL),
c AS (SELECT topic_id, list(x ORDER BY i) AS centroid FROM cp GROUP BY topic_id)"""
COS = "list_cosine_similarity"
SIMS = CENT + f", s AS (SELECT e.doc_id, c.topic_id, round({COS}(e.v, c.centroid), 9) AS sim FROM e, c)"
PROB = SIMS + ", p AS (SELECT doc_id, topic_id, exp(5 * (sim - max(sim) OVER (PARTITION BY doc_id))) AS x FROM s), prob AS (SELECT doc_id, topic_id, x / sum(x) OVER (PARTITION BY doc_id) AS prob FROM p)"
KNN = E + f""", pr AS (SELECT a.doc_id AS src, b.doc_id AS dst, round({COS}(a.v, b.v), 9) AS sim FROM e a, e b WHERE a.doc_id <> b.doc_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM pr) WHERE rank <= {K})"""
MUT = KNN + ", mu AS (SELECT a.src, a.dst, (a.sim + b.sim) / 2 AS weight FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst AND least(a.sim, b.sim) > 0)"
SNN = f""", nb AS (SELECT src, list(dst) AS nb FROM knn GROUP BY src), ps AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM knn),
sn AS (SELECT ps.src, ps.dst, len(list_intersect(a.nb, b.nb)) / {K}.0 AS weight FROM ps JOIN nb a ON ps.src = a.src JOIN nb b ON ps.dst = b.src WHERE len(list_intersect(a.nb, b.nb)) > 0)"""
HYB = MUT + SNN + """, hy AS (SELECT coalesce(m.src, s.src) AS src, coalesce(m.dst, s.dst) AS dst, 0.5 * coalesce(m.w, 0) + 0.5 * coalesce(s.w, 0) AS weight
FROM (SELECT src, dst, weight / max(weight) OVER () AS w FROM mu) m FULL JOIN (SELECT src, dst, weight / max(weight) OVER () AS w FROM sn) s ON m.src = s.src AND m.dst = s.dst)"""


# ---- text ----------------------------------------------------------------------------------------------------


@query(f"WITH {TOK} SELECT doc_id, term, tf FROM tf")
def tokenize_ngrams(s, d):
    return keywords.term_counts(docs(s, d), ENGLISH).select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


@query(f"WITH {TOK}, n AS (SELECT count(*) AS n FROM d) SELECT term, count(*) AS df, round(ln((1 + any_value(n)) / (1.0 + count(*))) + 1, 6) AS idf FROM tf, n GROUP BY term")
def doc_freq_idf(s, d):
    x = docs(s, d)
    n = F.broadcast(x.agg(F.count(F.lit(1)).alias("n")))
    return keywords.document_frequency(x, ENGLISH).crossJoin(n).select("term", "df", r6(F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


_TFIDF = TOK + """, n AS (SELECT count(*) AS n FROM d), vc AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
vo AS (SELECT term, ln((1.0 + n) / (1 + df)) + 1 AS idf FROM vc, n WHERE df >= 2 AND df <= 0.95 * n ORDER BY cf DESC, term LIMIT 10000),
w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN vo USING (term)), m AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w)"""


@query(f"WITH {_TFIDF} SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 9) DESC, term) AS r FROM m) WHERE r <= 5")
def tfidf_top_terms(s, d):
    m = graph.tfidf(docs(s, d), ENGLISH)
    w = Window.partitionBy("doc_id").orderBy(F.desc(rounds(F.col("tfidf"), 9)), "term")
    return m.withColumn("r", F.row_number().over(w)).where("r <= 5").select("doc_id", "term", r6(F.col("tfidf")).alias("tfidf"))


_CTF = TOK + """, n AS (SELECT count(*) AS n FROM d), df AS (SELECT term, count(*) AS df FROM tf, n GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.95 * n),
per AS (SELECT topic_id, term, sum(tf) AS tf, any_value(df) AS df FROM tf JOIN df USING (term) GROUP BY topic_id, term),
ct AS (SELECT topic_id, term, tf / (sum(tf) OVER (PARTITION BY topic_id) + 1e-10) * ln(n / (1.0 + df)) AS score FROM per, n),
kw AS (SELECT topic_id, term, score, row_number() OVER (PARTITION BY topic_id ORDER BY round(score, 9) DESC, term) AS rank FROM ct)"""


@query(f"WITH {_CTF} SELECT topic_id, term, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM kw WHERE rank <= 10")
def ctfidf_keywords(s, d):
    return rounded(keywords.top_terms(keywords.ctfidf(docs(s, d), ENGLISH), 10), "score")


_BM = D + f""", tk AS (SELECT doc_id, topic_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{3,}}'), lambda w: w NOT IN {STOP}) AS ts FROM d),
st AS (SELECT count(*) AS n, avg(len(ts)) AS al FROM tk), tf AS (SELECT doc_id, topic_id, len(ts) AS l, term, count(*) AS tf FROM (SELECT *, unnest(ts) AS term FROM tk) GROUP BY ALL),
rw AS (SELECT term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM rw),
bm AS (SELECT doc_id, topic_id, term, tf, n, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al)) AS bm FROM tf JOIN idf USING (term), st),
al AS (SELECT term, sum(bm) / any_value(n) AS ma FROM bm GROUP BY term), sz AS (SELECT topic_id, count(*) AS size FROM d GROUP BY topic_id),
p AS (SELECT topic_id, term, sum(bm) / any_value(size) / (any_value(ma) + 1e-10) * ln(1 + sum(tf)) AS raw FROM bm JOIN al USING (term) JOIN sz USING (topic_id) GROUP BY topic_id, term),
kw AS (SELECT topic_id, term, raw / max(raw) OVER (PARTITION BY topic_id) AS score FROM p)"""


@query(f"WITH {_BM} SELECT topic_id, term, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(score, 9) DESC, term) AS rank FROM kw) WHERE rank <= 10")
def bm25_keywords(s, d):
    return rounded(keywords.top_terms(keywords.bm25(docs(s, d), stop=ENGLISH), 10), "score")


@query(
    f"""WITH {D}, tk AS (SELECT topic_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN {STOP}) AS ts FROM d),
g AS (SELECT topic_id, unnest(list_concat(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])), list_transform(range(1, len(ts) - 1), lambda i: ts[i] || ' ' || ts[i + 1] || ' ' || ts[i + 2]))) AS term FROM tk),
c AS (SELECT topic_id, term, count(*) AS tf FROM g GROUP BY ALL), sc AS (SELECT topic_id, term, tf / max(tf) OVER (PARTITION BY topic_id) AS score FROM c)
SELECT topic_id, term, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(score, 9) DESC, term) AS rank FROM sc) WHERE rank <= 10"""
)
def keyphrase_ngrams(s, d):
    return rounded(keywords.keyphrases(docs(s, d), 10, 3, ENGLISH), "score")


@query(f"WITH {_CTF}, l AS (SELECT topic_id, list(term ORDER BY rank) AS k FROM kw WHERE rank <= 10 GROUP BY topic_id) SELECT topic_id, array_to_string(list_transform(k[1:3], lambda x: array_to_string(list_transform(string_split(x, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')), ' & ') AS label, 'Documents about ' || array_to_string(k[1:6], ', ') AS description FROM l")
def topic_labels(s, d):
    w = keywords.top_terms(keywords.ctfidf(docs(s, d), ENGLISH), 10).groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
    return keywords.labels(w)


@query("SELECT label_key, count(*) AS n, array_to_string(list(p_partkey ORDER BY p_partkey), ',') AS topics FROM (SELECT p_partkey, array_to_string(string_split(lower(trim(p_name)), ' ')[1:3], ' ') AS label_key FROM part) GROUP BY label_key HAVING count(*) >= 2")
def label_collisions(s, d):
    x = keywords.collisions(t(s, d, "part").select(F.col("p_partkey").alias("topic_id"), F.col("p_name").alias("label")))
    return x.withColumn("topics", F.array_join(F.transform("topics", lambda i: i.cast("string")), ","))


@query("SELECT doc_id, sha256(concat_ws(chr(1), text, lang)) AS digest, CASE WHEN ('0x' || substr(sha256(concat_ws(chr(1), text, lang)), 1, 13))::BIGINT / 4503599627370496.0 < 0.2 THEN 'holdout' ELSE 'train' END AS split FROM documents")
def hash_split(s, d):
    h = X.content_hash(F.col("text"), F.col("lang"))
    return t(s, d, "documents").select("doc_id", h.alias("digest"), X.split_for_hash(h).alias("split"))


@query("SELECT doc_id, CASE WHEN length(text) > 150 THEN text[1:150] || '...' ELSE text END AS snippet FROM documents")
def snippets(s, d):
    return t(s, d, "documents").select("doc_id", X.snippet(F.col("text"), 150).alias("snippet"))


@query(r"SELECT * FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, '|'), lambda p: trim(regexp_replace(trim(p), '^(?:[-*•–]|\(?(?:[0-9]{1,3}|[A-Za-z])[.)])\s+', ''))), lambda p: p <> '')) AS part FROM documents)")
def explode_clean_documents(s, d):
    return t(s, d, "documents").select("doc_id", F.explode(X.explode_clean(F.col("text"))).alias("part"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, length(props) AS n FROM events")
def event_json(s, d):
    return t(s, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.length("props").cast("long").alias("n"))


@query()
def json_answers_parse(s, d):
    """answers: of the whole text; built: of a JSON reply that carries the whole text and its first and last letter."""
    x = F.coalesce("text", F.lit(""))
    reply = F.concat(F.lit("Sure: "), F.to_json(F.struct(x.alias("note"), F.array(F.lit("B"), F.substring(x, 1, 1), F.substring(x, -1, 1)).alias("answers"))), F.lit(" as asked."))
    return t(s, d, "conversations").select("conv_id", "turn", X.answers(F.col("text"), n=F.lit(4)).alias("answers"), X.answers(reply, n=F.lit(4)).alias("built"))


@query()
def quote_check(s, d):
    """Narratives quote the whole item, piece by piece (a quotation has 200 characters at most), and words of nobody."""
    pieces = F.regexp_extract_all("text", F.lit(r'[^"“”\n]{3,199}(?=[\s"“”]|$)|[^"“”\n]{3,200}'), F.lit(0))
    quoted = F.array_join(F.transform(pieces, lambda p: F.concat(F.lit('"'), p, F.lit('"'))), " and ")
    b = t(s, d, "benchmark").select("item_id", F.concat(F.lit("It says "), quoted, F.lit(' and "words that nobody wrote" there, and much else besides that is not in any quotation at all.')).alias("narrative"), F.array("text").alias("sources"))
    return b.select("item_id", X.unverified_quotes(F.col("narrative"), F.col("sources")).alias("unverified"))


# ---- vectors and neighbours -----------------------------------------------------------------------------------


@query(f"WITH {E} SELECT doc_id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM e")
def l2_norms(s, d):
    return vecs(s, d).select("doc_id", r6(V.norm(F.col("v"))).alias("norm"))


@query(f"WITH {KNN} SELECT src, dst, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM knn")
def knn_exact(s, d):
    return rounded(near(s, d), "sim")


@query()
def knn_ann(s, d):
    """Approximate neighbours through the index: queries are the rows whose id is divisible by 20, against all."""
    x = vecs(s, d).select(F.col("doc_id").alias("id"), "v")
    return knn.inverted(x.where("id % 20 = 0"), x, K)


@query(f"WITH {KNN} SELECT src, dst, round(sim, 6) AS weight FROM knn")
def knn_directed_edges(s, d):
    return rounded(graph.directed(near(s, d)), "weight")


@query(f"WITH {MUT} SELECT src, dst, round(weight, 6) AS weight FROM mu")
def mutual_knn(s, d):
    return rounded(graph.mutual(near(s, d)), "weight")


@query(f"WITH {KNN} {SNN} SELECT src, dst, round(weight, 6) AS weight FROM sn")
def snn(s, d):
    return rounded(graph.snn(near(s, d), K), "weight")


def _hybrid(s, d) -> DataFrame:
    n = near(s, d)
    return graph.hybrid(graph.mutual(n), graph.snn(n, K))


@query(f"WITH {HYB} SELECT src, dst, round(weight, 6) AS weight FROM hy WHERE weight > 0")
def hybrid_graph(s, d):
    return rounded(_hybrid(s, d), "weight")


_LEX = _TFIDF + f""", lp AS (SELECT a.doc_id AS src, b.doc_id AS dst, round(sum(a.tfidf * b.tfidf), 9) AS sim FROM m a JOIN m b USING (term) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
lk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM lp) WHERE rank <= {K}),
lx AS (SELECT a.src, a.dst, (a.sim + b.sim) / 2 AS weight FROM lk a JOIN lk b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst AND least(a.sim, b.sim) > 0)"""


def _lexical(s, d) -> DataFrame:
    return graph.mutual(graph.lexical_knn(graph.tfidf(docs(s, d), ENGLISH), K))


@query(f"WITH {_LEX} SELECT src, dst, round(weight, 5) AS weight FROM lx")
def lexical_graph(s, d):
    return _lexical(s, d).withColumn("weight", rounds(F.col("weight"), 5))


def _meta(s, d) -> DataFrame:
    e = t(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return t(s, d, "documents").join(e, "doc_id").select("doc_id", "lang", "source", "n_chars")


_M = "m AS (SELECT d.doc_id, lang, source, n_chars FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"
_CAT = _M + ", ca AS (SELECT a.doc_id AS src, b.doc_id AS dst, (coalesce((a.lang = b.lang)::INT, 0) + coalesce((a.source = b.source)::INT, 0))::DOUBLE AS weight FROM m a JOIN m b ON a.doc_id < b.doc_id AND (a.lang = b.lang OR a.source = b.source))"
_NUM = f""", sc AS (SELECT doc_id, (n_chars - min(n_chars) OVER ())::DOUBLE / (max(n_chars) OVER () - min(n_chars) OVER ()) AS x FROM m),
np AS (SELECT a.doc_id AS src, b.doc_id AS dst, round(abs(a.x - b.x), 9) AS dd FROM sc a JOIN sc b ON a.doc_id <> b.doc_id),
nk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dd, dst) AS r FROM np) WHERE r <= {K} AND 1 - dd > 0.8),
nu AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(1 - dd) AS weight FROM nk GROUP BY ALL)"""


@query(f"WITH {_CAT} SELECT * FROM ca")
def metadata_categorical(s, d):
    return graph.categorical_edges(_meta(s, d), ["lang", "source"])


@query(f"WITH {_M}{_NUM} SELECT src, dst, round(weight, 6) AS weight FROM nu")
def metadata_numeric(s, d):
    return rounded(graph.numeric_edges(_meta(s, d), "n_chars", K), "weight")


_META = (_CAT + _NUM).replace("m AS (", "mm AS (", 1).replace("FROM m ", "FROM mm ").replace("JOIN m ", "JOIN mm ").replace("FROM m)", "FROM mm)")
_FUSE = f"""{HYB}, {_LEX.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))")}, {_META},
me AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM ca UNION ALL SELECT * FROM nu) GROUP BY ALL),
fs AS (SELECT src, dst, weight / max(weight) OVER () AS s FROM hy WHERE weight > 0), fl AS (SELECT src, dst, weight / max(weight) OVER () AS l FROM lx), fm AS (SELECT src, dst, weight / max(weight) OVER () AS m FROM me),
fu AS (SELECT src, dst, max(s) AS s, max(l) AS l, max(m) AS m FROM (SELECT src, dst, s, NULL AS l, NULL AS m FROM fs UNION ALL SELECT src, dst, NULL, l, NULL FROM fl UNION ALL SELECT src, dst, NULL, NULL, m FROM fm) GROUP BY ALL)"""


@query(f"WITH {_FUSE} SELECT src, dst, round(0.5 * coalesce(s, 0) + 0.3 * coalesce(l, 0) + 0.2 * coalesce(m, 0) + 0.1 * least(coalesce(s, 0), coalesce(l, 0)), 6) AS weight FROM fu WHERE src < dst")
def multiview_fusion(s, d):
    e = t(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    x = docs(s, d).join(e, "doc_id", "left_semi")
    lex = graph.mutual(graph.lexical_knn(graph.tfidf(x, ENGLISH, max_terms=10_000), K))
    return rounded(graph.fuse(_hybrid(s, d), lex, graph.metadata_edges(_meta(s, d), K)), "weight")


@query(f"WITH {HYB}, b AS (SELECT src, weight FROM hy WHERE weight > 0 UNION ALL SELECT dst, weight FROM hy WHERE weight > 0) SELECT src AS doc_id, count(*) AS degree, round(sum(weight), 6) AS strength FROM b GROUP BY src")
def graph_degree_stats(s, d):
    return rounded(graph.degrees(_hybrid(s, d)), "strength")


# ---- topics -----------------------------------------------------------------------------------------------------


@query(f"WITH {CENT} SELECT topic_id, CAST(i - 1 AS INT) AS pos, round(x, 6) AS x FROM cp")
def topic_centroids(s, d):
    return topics.centroids(vecs(s, d)).select("topic_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", r6(F.col("x")))


@query(f"WITH {E} SELECT topic_id, CAST(i - 1 AS INT) AS pos, round(sum(x * w) / sum(w), 6) AS x FROM (SELECT topic_id, 1.0 + doc_id % 3 AS w, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY ALL")
def weighted_centroids(s, d):
    x = topics.centroids(vecs(s, d).withColumn("weight", F.lit(1.0) + F.col("doc_id") % 3), "weight")
    return x.select("topic_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", r6(F.col("x")))


@query(f"WITH {SIMS} SELECT doc_id, CASE WHEN sim < 0.35 THEN -1 ELSE topic_id END AS topic_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, topic_id) AS r FROM s) WHERE r = 1")
def assign_nearest(s, d):
    x = vecs(s, d)
    return rounded(topics.assign(x, topics.centroids(x)), "sim")


@query(f"WITH {PROB} SELECT doc_id, topic_id, round(prob, 6) AS prob FROM prob")
def softmax_probabilities(s, d):
    x = vecs(s, d)
    return rounded(topics.probabilities(x, topics.centroids(x)), "prob")


@query(f"WITH {HYB}, b AS (SELECT src, dst, weight FROM hy WHERE weight > 0 UNION ALL SELECT dst, src, weight FROM hy WHERE weight > 0), ms AS (SELECT b.src AS doc_id, e.topic_id, sum(weight) AS w FROM b JOIN e ON b.dst = e.doc_id GROUP BY ALL), pr2 AS (SELECT doc_id, topic_id, w / sum(w) OVER (PARTITION BY doc_id) AS prob FROM ms), tt AS (SELECT DISTINCT topic_id FROM e) SELECT doc_id, topic_id, round(prob, 6) AS prob FROM pr2 UNION ALL SELECT e.doc_id, tt.topic_id, round(1.0 / (SELECT count(*) FROM tt), 6) FROM e, tt WHERE e.doc_id NOT IN (SELECT doc_id FROM pr2)")
def graph_soft_assignment(s, d):
    x = vecs(s, d)
    return rounded(topics.graph_probabilities(_hybrid(s, d), x, x.select("topic_id").distinct()), "prob")


@query(f"WITH {PROB} SELECT doc_id, topic_id, round(prob, 6) AS prob, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(prob, 9) DESC, topic_id) AS r FROM prob) WHERE r <= 3")
def top3_topics_per_doc(s, d):
    x = vecs(s, d)
    return rounded(topics.top_topics(topics.probabilities(x, topics.centroids(x)), 3), "prob")


@query(f"WITH {PROB}, a AS (SELECT * FROM prob WHERE round(prob, 9) >= 0.12) SELECT a.topic_id AS topic_a, b.topic_id AS topic_b, count(*) AS n FROM a JOIN a b USING (doc_id) GROUP BY ALL")
def topic_overlap_matrix(s, d):
    x = vecs(s, d)
    return topics.overlap(topics.probabilities(x, topics.centroids(x)).withColumn("prob", rounds(F.col("prob"), 9)), 0.12)


_DIST = CENT + ", ds AS (SELECT e.doc_id, e.topic_id, round(list_distance(e.v, c.centroid), 9) AS dist FROM e JOIN c USING (topic_id))"


@query(f"WITH {_DIST} SELECT doc_id, topic_id, round(dist, 6) AS dist, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY dist, doc_id) AS r FROM ds) WHERE r <= 3")
def representative_docs_centroid(s, d):
    return rounded(topics.representatives(vecs(s, d), 3), "dist")


@query(
    f"""WITH {_DIST}, b AS (SELECT *, ntile(3) OVER w AS bin, row_number() OVER w AS near FROM ds WINDOW w AS (PARTITION BY topic_id ORDER BY dist, doc_id)),
q AS (SELECT *, row_number() OVER (PARTITION BY topic_id, bin ORDER BY dist, doc_id) AS ib FROM b), f AS (SELECT *, ib <= [6, 3, 1][bin] AS first FROM q)
SELECT topic_id, doc_id, round(dist, 6) AS dist, CAST(bin AS INT) AS bin, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY first DESC, near) AS rank FROM f) WHERE rank <= 10"""
)
def representative_docs_stratified(s, d):
    return rounded(topics.representatives_stratified(vecs(s, d), 10), "dist")


@query()
def representative_docs_mmr(s, d):
    return topics.representatives_mmr(vecs(s, d), 5)


@query("WITH n AS (SELECT source, count(*) AS c FROM documents GROUP BY source), k AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS id FROM n), l AS (SELECT doc_id, k.id AS s FROM documents JOIN k USING (source)), z AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS new FROM (SELECT s, count(*) AS c FROM l GROUP BY s) WHERE c >= (SELECT 1 + avg(c) FROM n)) SELECT doc_id, CAST(coalesce(new, -1) AS INT) AS topic_id FROM l LEFT JOIN z USING (s)")
def prune_small_topics(s, d):
    x = t(s, d, "documents")
    ids = x.groupBy("source").agg(F.count(F.lit(1)).alias("c")).withColumn("topic_id", (F.row_number().over(Window.orderBy("source")) - 1).cast("int"))
    least = ids.agg(F.avg("c")).first()[0] + 1
    return community.prune(x.join(ids.select("source", "topic_id"), "source").select("doc_id", "topic_id"), least)


_OUT = E.replace("label AS topic_id", "CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS topic_id") + """, cp AS (SELECT topic_id, i, avg(x) AS x FROM (SELECT topic_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e WHERE topic_id <> -1) GROUP BY ALL),
c AS (SELECT topic_id, list(x ORDER BY i) AS centroid FROM cp GROUP BY topic_id)"""


def _with_outliers(s, d) -> DataFrame:
    return vecs(s, d).withColumn("topic_id", F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("topic_id")))


@query(f"WITH {_OUT}, s AS (SELECT doc_id, topic_id, sim FROM (SELECT e.doc_id, c.topic_id, round({COS}(e.v, c.centroid), 9) AS sim, row_number() OVER (PARTITION BY e.doc_id ORDER BY round({COS}(e.v, c.centroid), 9) DESC, c.topic_id) AS r FROM e, c WHERE e.topic_id = -1) WHERE r = 1) SELECT e.doc_id, CASE WHEN s.doc_id IS NULL THEN e.topic_id WHEN sim < 0.1 THEN -1 ELSE s.topic_id END AS topic_id FROM e LEFT JOIN s USING (doc_id)")
def outlier_reassign_embeddings(s, d):
    x = _with_outliers(s, d)
    return topics.reduce_outliers(x, topics.centroids(x), 0.1)


@query(f"WITH {_OUT}, p AS (SELECT a.doc_id AS src, b.doc_id AS dst, b.topic_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY round({COS}(a.v, b.v), 9) DESC, b.doc_id) AS r FROM e a, e b WHERE a.topic_id = -1 AND b.topic_id <> -1), n AS (SELECT src, topic_id, count(*) AS c FROM p WHERE r <= {K} GROUP BY ALL) SELECT src AS doc_id, topic_id FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY c DESC, topic_id) AS r FROM n) WHERE r = 1")
def outlier_reassign_neighbors(s, d):
    x = _with_outliers(s, d).select(F.col("doc_id").alias("id"), "v", "topic_id")
    votes = knn.exact(x.where("topic_id = -1"), x.where("topic_id <> -1"), K)
    return topics.vote_outliers(votes, x.select(F.col("id").alias("doc_id"), "topic_id"))


@query(f"WITH {CENT} SELECT a.topic_id AS topic_a, b.topic_id AS topic_b, round({COS}(a.centroid, b.centroid), 6) AS sim FROM c a JOIN c b ON a.topic_id < b.topic_id")
def pairwise_topic_similarity(s, d):
    return rounded(topics.pairwise(topics.centroids(vecs(s, d))), "sim")


@query(f"WITH {CENT}, z AS (SELECT topic_id, count(*) AS n FROM e GROUP BY topic_id) SELECT a.topic_id AS topic_a, b.topic_id AS topic_b, round({COS}(a.centroid, b.centroid) * pow(least(x.n, y.n) / greatest(x.n, y.n), 0.3), 6) AS score FROM c a JOIN c b ON a.topic_id < b.topic_id JOIN z x ON x.topic_id = a.topic_id JOIN z y ON y.topic_id = b.topic_id")
def size_aware_merge_scores(s, d):
    x = vecs(s, d)
    return rounded(topics.merge_scores(topics.centroids(x), topics.sizes(x)), "score")


@query()
def reduce_topics(s, d):
    x = vecs(s, d)
    return topics.relabel(x.select("doc_id", "topic_id"), topics.reduction_map(topics.centroids(x), topics.sizes(x), 5))


@query(f"WITH {E}, z AS (SELECT topic_id, count(*) AS n FROM e GROUP BY topic_id), w AS (SELECT topic_id FROM z WHERE topic_id IN (1, 2, 3) ORDER BY n DESC, topic_id LIMIT 1) SELECT doc_id, CASE WHEN topic_id IN (1, 2, 3) THEN (SELECT topic_id FROM w) ELSE topic_id END AS topic_id FROM e")
def merge_topics(s, d):
    x = vecs(s, d)
    return topics.relabel(x.select("doc_id", "topic_id"), topics.merge_map(topics.sizes(x), [[1, 2, 3]]))


@query("WITH x AS (SELECT vec_id AS doc_id, label AS c, label % 3 AS p FROM embeddings ), n AS (SELECT c, p, count(*) AS n FROM x GROUP BY ALL) SELECT c AS topic_id, p AS parent_id FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, p) AS r FROM n) WHERE r = 1")
def parent_majority_vote(s, d):
    x = vecs(s, d)
    return topics.parents(x.select("doc_id", "topic_id"), x.select("doc_id", (F.col("topic_id") % 3).alias("topic_id")))


@query(
    f"""WITH {CENT}, j AS (SELECT e.doc_id, e.v, c.centroid, 0.3 * sqrt(greatest(0, least(1, {COS}(e.v, c.centroid)))) AS b FROM e JOIN c USING (topic_id)),
m AS (SELECT doc_id, list_transform(list_zip(v, centroid), lambda z: z[1] * (1 - b) + z[2] * b) AS y FROM j)
SELECT doc_id, CAST(unnest(range(0, len(y))) AS INT) AS pos, round(unnest(y) / sqrt(list_inner_product(y, y)), 6) AS x FROM m"""
)
def refine_blend(s, d):
    x = vecs(s, d)
    v = topics.refine(x, topics.centroids(x), topics.blend_schedule(0, 3))
    return rounded(v.select("doc_id", F.posexplode("v").alias("pos", "x")), "x")


@query(f"WITH {PROB}, m AS (SELECT doc_id, list(prob ORDER BY prob DESC) AS p FROM prob GROUP BY doc_id) SELECT doc_id, round(m, 6) AS margin FROM (SELECT doc_id, round(p[1] - p[2], 9) AS m FROM m) WHERE m < 0.15 ORDER BY m, doc_id LIMIT 200")
def low_margin_docs(s, d):
    x = vecs(s, d)
    return rounded(topics.low_margin(topics.probabilities(x, topics.centroids(x))), "margin")


@query(f"WITH {PROB}, h AS (SELECT doc_id, round(-sum(greatest(1e-12, least(1, prob)) * ln(greatest(1e-12, least(1, prob)))), 9) AS entropy FROM prob GROUP BY doc_id) SELECT doc_id, round(entropy, 6) AS entropy FROM (SELECT *, row_number() OVER (ORDER BY round(entropy, 6) DESC, doc_id) AS r, count(*) OVER () AS n FROM h) WHERE r <= ceil(0.5 * n)")
def entropy_anchors(s, d):
    x = vecs(s, d)
    return topics.entropy_anchors(topics.probabilities(x, topics.centroids(x)))


# ---- metrics ----------------------------------------------------------------------------------------------------

CT = "ct AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY ALL)"


def _ct(s, d) -> DataFrame:
    return metrics.contingency(t(s, d, "documents").select("doc_id", F.col("lang").alias("a"), F.col("source").alias("b")))


@query(f"WITH {CT} SELECT * FROM ct")
def contingency(s, d):
    return _ct(s, d)


@query(f"WITH {CT}, s AS (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n) AS t FROM ct), a AS (SELECT sum(n * (n - 1) / 2.0) AS a FROM (SELECT sum(n) AS n FROM ct GROUP BY a)), b AS (SELECT sum(n * (n - 1) / 2.0) AS b FROM (SELECT sum(n) AS n FROM ct GROUP BY b)) SELECT round((s - a * b / (t * (t - 1) / 2.0)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2.0)), 6) AS ari FROM s, a, b")
def ari(s, d):
    return rounded(metrics.ari(_ct(s, d)), "ari")


@query(f"WITH {CT}, t AS (SELECT sum(n)::DOUBLE AS t FROM ct), a AS (SELECT a, sum(n) AS na FROM ct GROUP BY a), b AS (SELECT b, sum(n) AS nb FROM ct GROUP BY b), mi AS (SELECT sum(n / t * ln(t * n / (na * nb))) AS mi FROM ct JOIN a USING (a) JOIN b USING (b), t), ha AS (SELECT -sum(na / t * ln(na / t)) AS h FROM a, t), hb AS (SELECT -sum(nb / t * ln(nb / t)) AS h FROM b, t) SELECT round(mi / ((ha.h + hb.h) / 2), 6) AS nmi FROM mi, ha, hb")
def nmi(s, d):
    return rounded(metrics.nmi(_ct(s, d)), "nmi")


def _runs(s, d) -> DataFrame:
    x = vecs(s, d)
    return x.select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("run"), "doc_id", "topic_id").select("run", "doc_id", F.when(F.col("doc_id") % (F.col("run") + 4) == 0, 0).otherwise(F.col("topic_id")).alias("community"))


RUNS = "rn AS (SELECT run, vec_id AS doc_id, CASE WHEN vec_id % (run + 4) = 0 THEN 0 ELSE label END AS community FROM embeddings, (SELECT unnest(range(0, 4)) AS run))"


@query(f"WITH {RUNS}, c AS (SELECT x.run AS r1, y.run AS r2, x.community AS a, y.community AS b, count(*)::DOUBLE AS n FROM rn x JOIN rn y ON x.doc_id = y.doc_id AND x.run < y.run GROUP BY ALL), s AS (SELECT r1, r2, sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c GROUP BY ALL), a AS (SELECT r1, r2, sum(n * (n - 1) / 2) AS a FROM (SELECT r1, r2, sum(n) AS n FROM c GROUP BY r1, r2, a) GROUP BY ALL), b AS (SELECT r1, r2, sum(n * (n - 1) / 2) AS b FROM (SELECT r1, r2, sum(n) AS n FROM c GROUP BY r1, r2, b) GROUP BY ALL) SELECT round(avg((s - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2))), 6) AS stability FROM s JOIN a USING (r1, r2) JOIN b USING (r1, r2)")
def run_stability(s, d):
    return rounded(metrics.stability(_runs(s, d)), "stability")


@query(f"WITH {RUNS} SELECT x.doc_id AS src, y.doc_id AS dst, count(*) AS n, count(*) / 4.0::DOUBLE AS freq FROM rn x JOIN rn y ON x.run = y.run AND x.community = y.community AND x.doc_id < y.doc_id GROUP BY ALL")
def cooccurrence_counts(s, d):
    return community.cooccurrence(_runs(s, d))


@query(f"WITH {RUNS} SELECT x.doc_id AS src, y.doc_id AS dst, count(*) / 4.0::DOUBLE AS weight FROM rn x JOIN rn y ON x.run = y.run AND x.community = y.community AND x.doc_id < y.doc_id GROUP BY ALL HAVING count(*) >= 3")
def consensus_edges(s, d):
    return community.cooccurrence(_runs(s, d), 0.75).select("src", "dst", F.col("freq").alias("weight"))


@query(f"WITH {E}, p AS (SELECT a.doc_id, a.topic_id AS own, b.topic_id AS t, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM e a, e b GROUP BY ALL), q AS (SELECT doc_id, max(CASE WHEN own = t THEN s / (n - 1) END) AS a, min(CASE WHEN own <> t THEN s / n END) AS b FROM p GROUP BY doc_id) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM q")
def silhouette(s, d):
    return rounded(metrics.silhouette(vecs(s, d)), "silhouette")


@query(f"WITH {CENT}, s AS (SELECT e.topic_id, avg(list_distance(v, centroid)) AS s FROM e JOIN c USING (topic_id) GROUP BY e.topic_id), x AS (SELECT c.topic_id, centroid, s FROM c JOIN s USING (topic_id)) SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a.topic_id, max((a.s + b.s) / list_distance(a.centroid, b.centroid)) AS r FROM x a JOIN x b ON a.topic_id <> b.topic_id GROUP BY a.topic_id)")
def davies_bouldin(s, d):
    return rounded(metrics.davies_bouldin(vecs(s, d)), "davies_bouldin")


@query(f"WITH {CENT}, g AS (SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY i)), n AS (SELECT topic_id, count(*) AS n FROM e GROUP BY topic_id), b AS (SELECT sum(n * pow(list_distance(centroid, m), 2)) AS b, count(*) AS t, sum(n) AS n FROM c JOIN n USING (topic_id), g), w AS (SELECT sum(pow(list_distance(v, centroid), 2)) AS w FROM e JOIN c USING (topic_id)) SELECT round(b / (t - 1) / (w / (n - t)), 6) AS calinski_harabasz FROM b, w")
def calinski_harabasz(s, d):
    return rounded(metrics.calinski_harabasz(vecs(s, d)), "calinski_harabasz")


def _words(s, d) -> DataFrame:
    return keywords.top_terms(keywords.ctfidf(docs(s, d), ENGLISH, most=1), 8).select("topic_id", "term", "rank")


_COH = _CTF.replace("unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])))", "unnest(ts)") + """, k8 AS (SELECT topic_id, term, rank FROM kw WHERE rank <= 8),
t1 AS (SELECT doc_id, ts, greatest(1, len(ts) - 9) AS nw FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{1,}') AS ts FROM d) WHERE len(ts) > 0), tw AS (SELECT sum(nw)::DOUBLE AS w FROM t1),
ps AS (SELECT doc_id, nw, pos, term FROM (SELECT doc_id, nw, unnest(range(0, len(ts))) AS pos, unnest(ts) AS term FROM t1) WHERE term IN (SELECT term FROM k8)),
wi AS (SELECT DISTINCT doc_id, term, unnest(range(greatest(0, pos - 9), least(pos, nw - 1) + 1)) AS win FROM ps), fr AS (SELECT term, count(*)::DOUBLE AS f FROM wi GROUP BY term),
pr AS (SELECT a.topic_id, a.term AS x, b.term AS y FROM k8 a JOIN k8 b ON a.topic_id = b.topic_id AND a.rank < b.rank),
co AS (SELECT a.term AS p, b.term AS q, count(*)::DOUBLE AS f FROM wi a JOIN wi b ON a.doc_id = b.doc_id AND a.win = b.win AND a.term < b.term GROUP BY ALL),
sc AS (SELECT topic_id, (coalesce(co.f, 0) + 1) / (w + 1) AS pab, (fa.f + 1) / (w + 1) AS pa, (fb.f + 1) / (w + 1) AS pb, coalesce(co.f, 0) AS fab, fb.f AS fy FROM pr JOIN fr fa ON fa.term = x JOIN fr fb ON fb.term = y LEFT JOIN co ON co.p = least(x, y) AND co.q = greatest(x, y), tw)"""


@query(f"WITH {_COH} SELECT topic_id, round(avg(ln(pab / (pa * pb)) / (-ln(pab) + 1e-12)), 6) AS npmi, round(avg(ln(pab / (pa * pb + 1e-12))), 6) AS uci, round(avg(ln((fab + 1) / fy)), 6) AS umass FROM sc GROUP BY topic_id")
def coherence(s, d):
    return rounded(metrics.coherence(docs(s, d), _words(s, d)), "npmi", "uci", "umass")


@query(f"WITH {_CTF} SELECT round(count(DISTINCT lower(term)) / count(*), 6) AS diversity FROM kw WHERE rank <= 10")
def diversity(s, d):
    return rounded(metrics.diversity(keywords.top_terms(keywords.ctfidf(docs(s, d), ENGLISH), 10)), "diversity")


@query(f"WITH {_CTF}, l AS (SELECT topic_id, list(lower(term)) AS k FROM kw WHERE rank <= 10 GROUP BY topic_id) SELECT a.topic_id AS topic_a, b.topic_id AS topic_b, round(len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))), 6) AS jaccard FROM l a JOIN l b ON a.topic_id < b.topic_id")
def keyword_jaccard(s, d):
    k = keywords.top_terms(keywords.ctfidf(docs(s, d), ENGLISH), 10).groupBy("topic_id").agg(F.collect_list("term").alias("k"))
    a, b = k.select(F.col("topic_id").alias("topic_a"), F.col("k").alias("ka")), k.select(F.col("topic_id").alias("topic_b"), F.col("k").alias("kb"))
    return a.join(topics.few(b), F.col("topic_a") < F.col("topic_b")).select("topic_a", "topic_b", r6(metrics.jaccard(F.col("ka"), F.col("kb"))).alias("jaccard"))


@query("SELECT (SELECT max(c) FROM (SELECT (SELECT count(*) FROM labels WHERE quality = toxic) AS c UNION ALL SELECT (SELECT count(*) FROM labels WHERE quality <> toxic))) / count(*) AS accuracy FROM labels")
def hungarian_accuracy(s, d):
    x = metrics.hungarian_accuracy(metrics.contingency(t(s, d, "labels").select("doc_id", F.col("quality").alias("a"), F.col("toxic").alias("b"))))
    return s.createDataFrame([(x,)], "accuracy double")


@query(f"WITH {CENT}, z AS (SELECT topic_id, count(*) AS n FROM e GROUP BY topic_id), r AS (SELECT c.* FROM c JOIN z USING (topic_id) WHERE n < 0.1 * (SELECT count(*) FROM e)), f AS (SELECT centroid FROM c WHERE topic_id % 2 = 0) SELECT avg(CASE WHEN m >= 0.7 THEN 1.0 ELSE 0.0 END) AS recall FROM (SELECT r.topic_id, max({COS}(r.centroid, f.centroid)) AS m FROM r, f GROUP BY r.topic_id)")
def rare_topic_recall(s, d):
    x = vecs(s, d)
    c = topics.centroids(x)
    return metrics.rare_topic_recall(c.join(topics.sizes(x), "topic_id"), c.where("topic_id % 2 = 0"), x.count(), 0.1)


#: Neighbours among which the nearest with the same and with another label are sought.
TRIPLET_K = 64
_TRIP = KNN.replace(f"rank <= {K}", f"rank <= {TRIPLET_K}") + """, j AS (SELECT k.src, k.dst, k.sim, a.topic_id = b.topic_id AS same FROM knn k JOIN e a ON k.src = a.doc_id JOIN e b ON k.dst = b.doc_id),
tr AS (SELECT p.src AS anchor, p.dst AS positive, n.dst AS negative, p.sim - n.sim AS margin FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM j WHERE same) WHERE r = 1) p JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM j WHERE NOT same) WHERE r = 1) n USING (src))"""


def _near_anchors(s, d):
    x = vecs(s, d).select(F.col("doc_id").alias("id"), "v")
    return lambda anchors: knn.exact(x.join(F.broadcast(anchors), F.col("id") == F.col("src"), "left_semi"), x, TRIPLET_K)  # a drawn number


def _triplets(s, d) -> DataFrame:
    return guided.nearest_same_different(near(s, d, TRIPLET_K), vecs(s, d))


@query(f"WITH {_TRIP} SELECT anchor, positive, negative, round(margin, 6) AS margin FROM tr")
def nearest_same_diff(s, d):
    return rounded(_triplets(s, d), "margin")


def _u(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(sha256({key} || ':{seed}'), 1, 13))::BIGINT / 4503599627370496.0"


def _drawn(n: int) -> str:
    return f"a AS (SELECT doc_id AS anchor FROM e ORDER BY {_u('doc_id')}, doc_id LIMIT {n})"


@query(f"WITH {_TRIP}, {_drawn(60)} SELECT anchor, positive, negative, round(margin, 6) AS margin FROM tr JOIN a USING (anchor)")
def triplets_fast(s, d):
    return rounded(guided.sample_triplets(_near_anchors(s, d), vecs(s, d), 60), "margin")


@query(f"WITH {_TRIP}, {_drawn(160)} SELECT anchor, positive, negative, round(margin, 6) AS margin FROM tr JOIN a USING (anchor) ORDER BY tr.margin + {_u('anchor', 43)} * 1e-6, anchor LIMIT 40")
def triplets_hard(s, d):
    return rounded(guided.sample_triplets(_near_anchors(s, d), vecs(s, d), 40, "hard"), "margin")


@query(f"WITH {_TRIP}, ct AS (SELECT topic_id, i, avg(x) AS x FROM (SELECT topic_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY ALL), cv AS (SELECT topic_id, list(x ORDER BY i) AS c FROM ct GROUP BY 1), ex AS (SELECT doc_id, exp(5.0 * list_cosine_similarity(v, c)) AS z FROM e, cv), zp AS (SELECT doc_id, z / sum(z) OVER (PARTITION BY doc_id) AS p FROM ex), h AS (SELECT doc_id, round(-sum(p * ln(p)), 6) AS entropy FROM zp GROUP BY 1), hi AS (SELECT doc_id FROM (SELECT *, row_number() OVER (ORDER BY entropy DESC, doc_id) AS r, count(*) OVER () AS n FROM h) WHERE r <= ceil(0.5 * n)), a AS (SELECT doc_id AS anchor FROM hi ORDER BY {_u('doc_id')}, doc_id LIMIT 60) SELECT anchor, positive, negative, round(margin, 6) AS margin FROM tr JOIN a USING (anchor)")
def triplets_entropy(s, d):
    x = vecs(s, d)
    return rounded(guided.sample_triplets(_near_anchors(s, d), x, 60, "entropy", topics.probabilities(x, topics.centroids(x))), "margin")


@query(f"WITH {_TRIP} SELECT avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END) AS accuracy FROM tr")
def triplet_accuracy(s, d):
    return metrics.triplet_accuracy(_triplets(s, d), vecs(s, d))


@query(f"WITH {_TRIP} SELECT (count(*) FILTER (WHERE anchor % 3 <> 0) + 1) / (count(*) + 2) AS agreement, count(*) AS counted FROM tr WHERE anchor % 4 <> 0")
def triplet_agreement(s, d):
    x = _triplets(s, d).select("anchor", F.col("positive").alias("b"), F.col("negative").alias("c"), F.when(F.col("anchor") % 4 == 0, None).when(F.col("anchor") % 3 == 0, "C").otherwise("B").alias("answer"))
    return metrics.triplet_agreement(x, vecs(s, d))


@query("WITH r AS (SELECT doc_id, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS a, rank() OVER (ORDER BY length(lang || source)) + (count(*) OVER (PARTITION BY length(lang || source)) - 1) / 2.0 AS b FROM documents) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman_check(s, d):
    x = t(s, d, "documents").select("n_chars", F.length(F.concat("lang", "source")).alias("w"))
    return rounded(metrics.spearman(x, "n_chars", "w"), "spearman")


# ---- reduced sets and streams -------------------------------------------------------------------------------------


@query("WITH x AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY vec_id) AS pos, count(*) OVER () - 50 AS old FROM embeddings) SELECT doc_id, round(CASE WHEN pos > old THEN 1.0 ELSE 0.25 + 0.75 * (pos - 1) / greatest(old, 1) END, 6) AS weight FROM x")
def recency_weights(s, d):
    return rounded(coreset.recency_weights(vecs(s, d), 50), "weight")


@query(f"WITH {E}, m AS (SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY i)), q AS (SELECT doc_id, pow(list_distance(v, m), 2) AS d2 FROM e, m) SELECT doc_id, round(0.5 / count(*) OVER () + 0.5 * d2 / sum(d2) OVER (), 9) AS weight FROM q")
def sensitivity_weights(s, d):
    return coreset.sensitivity_weights(vecs(s, d)).withColumn("weight", rounds(F.col("weight"), 9))


@query("SELECT doc_id FROM (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY -ln(greatest(('0x' || substr(sha256(vec_id || ':42'), 1, 13))::BIGINT / 4503599627370496.0, 1e-15)) / (1.0 + vec_id % 3), vec_id) AS r FROM embeddings) WHERE r <= 100")
def coreset_sample(s, d):
    return coreset.sample(vecs(s, d).select("doc_id", (F.lit(1.0) + F.col("doc_id") % 3).alias("weight")), 100).select("doc_id")


@query()
def stratified_coreset(s, d):
    return coreset.stratified(vecs(s, d), 120)


@query()
def micro_clusters(s, d):
    return coreset.micro_clusters(vecs(s, d).select("doc_id", "v"), 20)


@query(f"WITH {SIMS} SELECT doc_id // 100 AS batch, round(avg(CASE WHEN m < 0.35 THEN 1.0 ELSE 0.0 END), 6) AS novelty FROM (SELECT doc_id, max(sim) AS m FROM s GROUP BY doc_id) GROUP BY ALL")
def novelty_by_batch(s, d):
    x = vecs(s, d)
    a = topics.assign(x, topics.centroids(x))
    return a.groupBy(F.expr("doc_id div 100").alias("batch")).agg(r6(F.avg((F.col("topic_id") == -1).cast("double"))).alias("novelty"))


@query(f"WITH {E}, b AS (SELECT topic_id AS g, doc_id % 2 AS h, i, avg(x) AS x, count(*) AS m FROM (SELECT topic_id, doc_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY ALL), s AS (SELECT g, i, sum(x * m) / sum(m) AS x, sum(m) AS mass FROM b GROUP BY ALL), n AS (SELECT g, sqrt(sum(x * x)) AS n FROM s GROUP BY g) SELECT g AS global_id, CAST(i - 1 AS INT) AS pos, round(x / n, 6) AS x, round(mass, 6)::DOUBLE AS mass FROM s JOIN n USING (g)")
def registry_merge(s, d):
    x = vecs(s, d)
    side = [topics.centroids(x.where(f"doc_id % 2 = {h}")).join(x.where(f"doc_id % 2 = {h}").groupBy("topic_id").agg(F.count(F.lit(1)).cast("double").alias("mass")), "topic_id").withColumnRenamed("topic_id", "global_id") for h in (0, 1)]
    return cumulative.merge_registry(*side).select("global_id", F.posexplode("centroid").alias("pos", "x"), r6(F.col("mass")).alias("mass")).withColumn("x", r6(F.col("x")))


@query("SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(s, d):
    x = cumulative.windowed(t(s, d, "events"))
    return x.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", rounds(F.col("total"), 4).alias("total"))


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, g")
def event_sessions(s, d):
    return cumulative.sessions(t(s, d, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


# ---- reports --------------------------------------------------------------------------------------------------------


@query("WITH m AS (SELECT date_trunc('month', ts) AS month, event_type AS topic, count(*) AS n FROM events GROUP BY ALL) SELECT CAST(month AS TIMESTAMP) AS month, topic, n, round(100.0 * n / sum(n) OVER (PARTITION BY month), 6) AS share FROM m")
def topics_over_time(s, d):
    m = t(s, d, "events").groupBy(F.date_trunc("MONTH", "ts").cast("timestamp_ntz").alias("month"), F.col("event_type").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(m.withColumn("share", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("month"))), "share")


@query("WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT source, row_number() OVER (ORDER BY n DESC, source) AS r FROM c) SELECT CASE WHEN r <= 5 THEN source ELSE 'Other' END AS bucket, count(*) AS n FROM documents JOIN r USING (source) GROUP BY 1")
def topn_other_bucket(s, d):
    x = t(s, d, "documents")
    top = x.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(5).select("source", F.col("source").alias("bucket"))
    return x.join(F.broadcast(top), "source", "left").groupBy(F.coalesce("bucket", F.lit("Other")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, lang, count(*) AS n, grouping(lang) AS level FROM documents GROUP BY ROLLUP (source, lang)")
def group_topic_rollup(s, d):
    return t(s, d, "documents").rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.grouping("lang").cast("long").alias("level"))


@query("WITH p AS (SELECT DISTINCT user_id, event_type FROM events) SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM p a JOIN p b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL HAVING count(*) >= 3 ORDER BY n DESC, a, b LIMIT 80")
def label_cooccurrence(s, d):
    p = t(s, d, "events").select("user_id", "event_type").distinct()
    j = p.select("user_id", F.col("event_type").alias("a")).join(p.select("user_id", F.col("event_type").alias("b")), "user_id").where("a < b")
    return j.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").orderBy(F.desc("n"), "a", "b").limit(80)


@query("WITH u AS (SELECT floor(epoch(max(ts) - min(ts)) / 86400) AS days FROM events), c AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) AS r FROM events WHERE event_type IS NOT NULL GROUP BY 1) SELECT CASE WHEN days <= 31 THEN date_trunc('day', ts)::TIMESTAMP WHEN days <= 365 THEN date_trunc('week', ts)::TIMESTAMP + INTERVAL 6 DAYS ELSE date_trunc('month', ts)::TIMESTAMP END AS start, CASE WHEN r <= 3 THEN event_type ELSE 'Other' END AS label, count(*) AS n FROM events LEFT JOIN c USING (event_type), u GROUP BY ALL")
def topic_timeline(s, d):
    x = rollups.over_time(t(s, d, "events"), "ts", "event_type", 3)
    return x.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT date_trunc('week', ts)::TIMESTAMP + INTERVAL 6 DAYS AS start, coalesce(event_type, 'Other') AS label, count(*) AS n FROM events GROUP BY ALL")
def topic_timeline_weekly(s, d):
    x = rollups.over_time(t(s, d, "events"), "ts", "event_type", 10, "week")
    return x.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT source AS \"group\", count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE lang = '{x}') AS n_{x}, round(count(*) FILTER (WHERE lang = '{x}') / count(*), 6) AS share_{x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source")
def source_shares(s, d):
    x = rollups.share_table(t(s, d, "documents"), "source", "lang")
    return rounded(x, *(c for c in x.columns if c.startswith("share_")))


@query("WITH c AS (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents WHERE lang IS NOT NULL GROUP BY source, lang) SELECT source AS \"group\", string_agg(lang || ' (' || n || ')', '; ' ORDER BY r) AS leaders FROM c WHERE r <= 3 GROUP BY source")
def source_leaders(s, d):
    return rollups.leading_in_group(t(s, d, "documents"), "source", "lang")


@query(f"WITH c AS (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY lang), q AS (SELECT lang, 200 * n // total AS q, 200 * n % total AS rest FROM c), k AS (SELECT lang, q, row_number() OVER (ORDER BY rest DESC, lang) AS r, 200 - sum(q) OVER () AS short FROM q), x AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_u('doc_id')}, doc_id) AS rn FROM documents) SELECT doc_id, lang FROM x JOIN k USING (lang) WHERE rn <= q + CASE WHEN r <= short THEN 1 ELSE 0 END")
def stratified_subsample(s, d):
    return rollups.stratified_sample(t(s, d, "documents").select("doc_id", "lang"), "lang", 200)


@query()
def pca_reduce(s, d):
    return pca(vecs(s, d), 10).select("doc_id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


# ---- communities and the whole model --------------------------------------------------------------------------------


@query()
def leiden_communities(s, d):
    return community.runs(_hybrid(s, d), vecs(s, d).select("doc_id"), [42])


@query()
def consensus_labels(s, d):
    return community.prune(community.consensus(_runs(s, d)).withColumnRenamed("community", "topic_id"), 5)


@query()
def fit_topics(s, d):
    x = docs(s, d).select("doc_id", "text").join(vecs(s, d).select("doc_id", "v"), "doc_id")
    return TopicModel(Config(n_runs=3, min_size=3)).fit(x).topic_info()
