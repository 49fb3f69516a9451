"""Queries that learn: several classes, token expiry, unlearning, training sets, the perceptron."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from gristmill.operators import bayes, maps, neural, scoring
from gristmill.plans import catalog
from gristmill.plans.registry import documents, query, read

_TOKENS_SQL = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
p AS (SELECT DISTINCT doc_id, w[i] || chr(31) || w[i + 1] || chr(31) || '1' AS pair FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)),
t AS (SELECT doc_id, ('0x' || substr(md5(pair), 1, 15))::BIGINT AS token FROM p)"""
#: Classes of a labelled text: quality * 2 + toxic.
CLASSES = [0, 1, 2, 3]


@query(f"""WITH {_TOKENS_SQL}, lab AS (SELECT doc_id, quality * 2 + toxic AS c FROM labels WHERE quality * 2 + toxic IN (0, 1, 2, 3)),
  k AS (SELECT token, count(*)::DOUBLE AS n, [count(*) FILTER (c = 0), count(*) FILTER (c = 1), count(*) FILTER (c = 2), count(*) FILTER (c = 3)] AS ns FROM t JOIN lab USING (doc_id) GROUP BY token),
  l AS (SELECT [count(*) FILTER (c = 0), count(*) FILTER (c = 1), count(*) FILTER (c = 2), count(*) FILTER (c = 3)] AS ls FROM lab),
  pc AS (SELECT token, c, least((n / (1 + n) / 4 + n * ns[c + 1] / greatest(ls[c + 1], 1)) / (n / (1 + n) + n), 1.0) AS p FROM k, l, range(4) r(c)),
  e AS (SELECT doc_id, token, c, CASE WHEN abs(p - 0.25) >= 0.05 THEN round(ln(p) * 1e9)::BIGINT END AS e FROM t JOIN pc USING (token)),
  s AS (SELECT doc_id, c, coalesce(sum(e), 0)::DOUBLE / 1e9 AS s, count(DISTINCT token) FILTER (e IS NOT NULL) AS n FROM e GROUP BY 1, 2),
  m AS (SELECT *, exp(s - max(s) OVER (PARTITION BY doc_id)) AS x FROM s),
  nt AS (SELECT doc_id, count(DISTINCT token) AS n_tokens FROM e WHERE e IS NOT NULL GROUP BY doc_id)
  SELECT doc_id, n_tokens, c::INT AS class, round(1 / total, 6) AS prob FROM (SELECT *, sum(x) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, c) AS r FROM m)
  JOIN nt USING (doc_id) WHERE r = 1""")
def bayes_classes(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("label"))
    counts, learns = bayes.learn_class_texts(docs, labels, CLASSES)
    return bayes.classify_classes(bayes.tokens(docs), counts, learns, CLASSES).withColumn("prob", F.round("prob", 6))


_COUNTS_SQL = f"{_TOKENS_SQL}, c AS (SELECT token, count(*) FILTER (toxic = 1) AS spam_n, count(*) FILTER (toxic = 0) AS ham_n FROM t JOIN labels USING (doc_id) GROUP BY token)"


@query(f"""WITH {_COUNTS_SQL}, m AS (SELECT avg(spam_n + ham_n) AS mean FROM c),
  k AS (SELECT token, spam_n + ham_n AS n, greatest(spam_n, ham_n) AS most, mean FROM c, m)
  SELECT token, n, CASE WHEN n = 0 OR most / n <= 0.99 THEN 'common' WHEN n < mean THEN 'infrequent' WHEN most / n > 0.75 THEN 'significant' ELSE 'insignificant' END AS kind FROM k""")
def bayes_expiry(spark, sf_dir):
    counts = bayes.learn_texts(documents(spark, sf_dir), read(spark, sf_dir, "labels"), label_col="toxic")[0]
    return bayes.expiry(counts, ["spam_n", "ham_n"]).select("token", (F.col("spam_n") + F.col("ham_n")).alias("n"), "kind")


@query(f"""WITH {_TOKENS_SQL} SELECT token, count(*) FILTER (toxic = 1 AND quality = 1) AS spam_n, count(*) FILTER (toxic = 0 AND quality = 1) AS ham_n FROM t JOIN labels USING (doc_id) GROUP BY token""")
def bayes_unlearn(spark, sf_dir):
    """All labels are learned, then those of low quality are taken back."""
    docs, labels = documents(spark, sf_dir), read(spark, sf_dir, "labels")
    learned = bayes.learn_texts(docs, labels, label_col="toxic")[0]
    return bayes.merge(learned, bayes.learn_texts(docs, labels.filter("quality is null or quality != 1"), label_col="toxic")[0], -1)


@query("""SELECT md5(text) AS digest, min(doc_id) AS learned_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY md5(text)""")
def learn_cache(spark, sf_dir):
    """A text is learned once, under its smallest id."""
    rows = documents(spark, sf_dir).filter("text is not null")
    return rows.groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.min("doc_id").alias("learned_id"), F.count("*").alias("copies"))


@query(f"""{catalog._SCORE_SQL}, l AS (SELECT count(*) FILTER (toxic = 1) AS sl, count(*) FILTER (toxic = 0) AS hl FROM labels)
  SELECT doc_id, CASE WHEN score >= 3.5 AND sl * 0.9 <= hl THEN 'spam' WHEN score <= 0 AND hl * 0.9 <= sl THEN 'ham' WHEN score >= 3.5 OR score <= 0 THEN 'unbalanced' END AS learn FROM a, l""")
def autolearn_decisions(spark, sf_dir):
    learns = read(spark, sf_dir, "labels").agg(F.count_if(F.col("toxic") == 1).alias("sl"), F.count_if(F.col("toxic") == 0).alias("hl"))
    rows = catalog.scored_documents(spark, sf_dir).crossJoin(F.broadcast(learns))  # learns is one row
    return rows.select("doc_id", bayes.autolearn(F.col("score"), 3.5, 0.0, F.col("sl"), F.col("hl")).alias("learn"))


@query(f"""{catalog._SCORE_SQL}, c AS (SELECT symbol, count(*) FILTER (a.score >= 3.5) AS spam, count(*) FILTER (a.score < 2) AS ham FROM f JOIN a USING (doc_id) GROUP BY symbol)
  SELECT symbol, spam, ham, spam + ham >= 10 AND spam <> ham AS kept FROM c""")
def neural_profile(spark, sf_dir):
    return neural.profile(catalog.scored_documents(spark, sf_dir), 3.5, 2.0)


@query("""WITH s AS (SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic), c AS (SELECT toxic, floor((SELECT min(n) FROM s) * 1000000 / n) AS cut FROM s)
  SELECT doc_id, toxic FROM labels JOIN c USING (toxic) WHERE ('0x' || substr(md5('train:' || doc_id), 1, 15))::BIGINT % 1000000 < cut""")
def balanced_training_set(spark, sf_dir):
    return bayes.balanced(read(spark, sf_dir, "labels"), "doc_id", "toxic").select("doc_id", "toxic")


@query()
def neural_scores(spark, sf_dir):
    """A perceptron over symbol scores, trained on the balanced set of labels; scores every document."""
    names = [r.symbol for r in catalog._rules()]
    made = neural.symbol_features(names)

    def features(docs):
        return scoring.findings(docs, catalog._rules()).withColumns(made)

    docs = documents(spark, sf_dir).select("doc_id", "text")
    # Training reads the drawn texts alone; every text's rules run once more, for its score.
    sample = maps.small(bayes.balanced(read(spark, sf_dir, "labels"), "doc_id", "toxic").select("doc_id", F.col("toxic").cast("double").alias("y")), bayes.LABELS_BROADCAST)
    drawn = features(docs.join(sample, "doc_id")).select(*made, "y").persist(StorageLevel.DISK_ONLY)
    model = neural.train(drawn, list(made), "y")
    drawn.unpersist()
    rows = features(docs).select("doc_id", *made)
    return neural.score(model, rows).select("doc_id", F.round("neural_score", 6).alias("neural_score"))


@query()
def vector_components(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    axes = neural.components(rows, "embedding", 4)
    dot = [F.aggregate(F.zip_with("embedding", F.array(*[F.lit(x) for x in axis]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) for axis in axes]
    return rows.select("vec_id", *[F.round(d, 4).alias(f"pc{k}") for k, d in enumerate(dot)])


@query("""WITH u AS (SELECT vec_id, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), n AS (SELECT vec_id, sqrt(sum(v * v)) AS norm FROM u GROUP BY vec_id)
  SELECT vec_id, dim::INT AS dim, round(v / CASE WHEN norm = 0 THEN NULL ELSE norm END, 4) AS v FROM u JOIN n USING (vec_id)""")
def vector_unit(spark, sf_dir):
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    unit = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.try_divide(x.cast("double"), norm)).alias("unit"))
    return unit.select("vec_id", F.posexplode("unit").alias("dim", "v")).withColumn("v", F.round("v", 4))
