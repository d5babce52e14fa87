"""VEC, MOD, MET, RSM, SRT-5/6 and UDF over the given tables."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from runsift.functions import strings as S
from runsift.operators import metrics as M
from runsift.operators import models as Q
from runsift.operators import pivots as P
from runsift.operators import resampling as X
from runsift.operators import sorts as O
from runsift.operators import textmodel
from runsift.operators import trajectories
from runsift.operators import vectors as V
from runsift.plans import standins  # noqa: F401
from runsift.plans.registry import query
from runsift.plans.summary_queries import r6
from runsift.plans.vector_data import VECTORS_SQL, vectors
from runsift.session import cut_lineage, written

c = F.col
UNIT = VECTORS_SQL.rstrip() + """,
u AS (SELECT *, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS norm, list_transform(vec, lambda x: x / greatest(sqrt(list_sum(list_transform(vec, lambda y: y * y))), 1e-12)) AS unit FROM v),
e AS (SELECT row_id, group_id, label, depth, unnest(unit) AS x, generate_subscripts(unit, 1) AS i FROM u),
t AS (SELECT depth, label, i, sum(x) AS s, count(*) AS n FROM e GROUP BY ALL)
"""


@query("vec01_l2_normalise", UNIT + "SELECT row_id, depth, round(norm, 6) AS norm, round(unit[1], 6) AS first_value FROM u")
def _(t):
    rows = vectors(t.embeddings).withColumn("v", V.doubles(c("vec")))
    return rows.select("row_id", "depth", F.round(V.norm(c("v")), 6).alias("norm"), F.round(V.l2_normalise(c("v"))[0], 6).alias("first_value"))


@query("vec02_cosine", """
WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)) AS x, list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)) AS y
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT a, b, round(list_dot_product(x, y), 6) AS dot, round(list_cosine_similarity(x, y), 6) AS cosine FROM p""")
def _(t):
    v = t.embeddings.select("vec_id", V.doubles(c("embedding")).alias("v"))
    a, b = v.select(c("vec_id").alias("a"), c("v").alias("x")), v.select(c("vec_id").alias("b"), c("v").alias("y"))
    rows = a.withColumn("b", c("a") + 1).join(b, "b")
    return rows.select("a", "b", F.round(V.dot(c("x"), c("y")), 6).alias("dot"), F.round(V.cosine(c("x"), c("y")), 6).alias("cosine"))


@query("vec03_mean_pooling", VECTORS_SQL + """
, e AS (SELECT row_id, depth, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v WHERE depth >= 2 AND depth < 6)
SELECT row_id, i, round(avg(x), 6) AS mean FROM e GROUP BY 1, 2""")
def _(t):
    rows = vectors(t.embeddings).withColumn("vec", V.doubles(c("vec")))
    out = V.mean_pool(rows, ["row_id"], "vec", "depth", F.lit(2), F.lit(6))
    return out.select("row_id", F.posexplode("pooled").alias("i", "mean")).select("row_id", (c("i") + 1).alias("i"), F.round("mean", 6).alias("mean"))


def _pairs(t):
    n = t.embeddings.count()
    return t.embeddings.select(c("vec_id").alias("run"), ((c("vec_id") * 7 + 3) % n).alias("q"), ((c("vec_id") * 5 + 11) % n).alias("qstar"))


PAIRS_SQL = """, p AS (SELECT vec_id AS run, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS q, (vec_id * 5 + 11) % (SELECT count(*) FROM embeddings) AS qstar FROM embeddings)"""


@query("vec04_similarity_by_layer", VECTORS_SQL.rstrip() + PAIRS_SQL + """
SELECT a.row_id AS run, b.row_id AS q, a.depth, round(list_cosine_similarity(a.vec, b.vec), 6) AS similarity FROM p JOIN v a ON a.row_id = p.run JOIN v b ON b.row_id = p.q AND a.depth = b.depth""")
def _(t):
    rows = vectors(t.embeddings).withColumn("vec", V.doubles(c("vec")))
    return r6(V.similarity_by_layer(rows, _pairs(t).select("run", "q"), "row_id", "depth", "vec", "run", "q"), "similarity")


@query("vec05_q_or_qstar", VECTORS_SQL.rstrip() + PAIRS_SQL + """
SELECT a.row_id AS run, a.depth, CASE WHEN round(list_cosine_similarity(a.vec, s.vec), 9) > round(list_cosine_similarity(a.vec, b.vec), 9) THEN 'QSTAR' ELSE 'Q' END AS closer_to
FROM p JOIN v a ON a.row_id = p.run JOIN v b ON b.row_id = p.q AND a.depth = b.depth JOIN v s ON s.row_id = p.qstar AND a.depth = s.depth""")
def _(t):
    rows = vectors(t.embeddings).withColumn("vec", V.doubles(c("vec")))
    return V.q_or_qstar(rows, _pairs(t), "row_id", "depth", "vec").select("run", "depth", "closer_to")


@query("vec06_feature_moments", VECTORS_SQL + """
SELECT depth, i, j, round(sum(vec[i + 1] * vec[j + 1]), 5) AS moment FROM v, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j) GROUP BY 1, 2, 3""")
def _(t):
    rows = vectors(t.embeddings).withColumn("vec", V.doubles(c("vec")))
    out = V.feature_moments(rows, "depth", "vec")
    return out.withColumn("moment", F.round("moment", 5))


CENTROID = UNIT.rstrip() + """,
g AS (SELECT depth, group_id, label, i, sum(x) AS s, count(*) AS n FROM e GROUP BY ALL),
k AS (SELECT DISTINCT depth, group_id FROM e),
m AS (SELECT k.depth, k.group_id, t.label, t.i, t.s - coalesce(g.s, 0) AS x FROM k JOIN t ON k.depth = t.depth LEFT JOIN g ON g.depth = k.depth AND g.group_id = k.group_id AND g.label = t.label AND g.i = t.i),
w AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY depth, group_id, label)) AS y FROM m),
s AS (SELECT e.row_id, e.group_id, e.label, e.depth, sum(CASE WHEN w.label = 1 THEN e.x * w.y ELSE -e.x * w.y END) AS score FROM e JOIN w ON e.depth = w.depth AND e.group_id = w.group_id AND e.i = w.i GROUP BY ALL)
"""


def _scores(t):
    return V.centroid_scores(vectors(t.embeddings), "row_id", "group_id", "label", "vec", ["depth"])


@query("vec07_centroid_scores", CENTROID + "SELECT row_id, depth, round(score, 6) AS score FROM s")
def _(t):
    return r6(_scores(t).select("row_id", "depth", "score"), "score")


@query("vec08_weighted_centroid_scores", CENTROID.replace("sum(x) AS s, count(*) AS n FROM e GROUP BY ALL", "sum(x * rw) AS s, count(*) AS n FROM (SELECT e.*, 1.0 / z.n AS rw FROM e JOIN (SELECT vec_id % 29 AS group_id, count(*) AS n FROM embeddings GROUP BY 1) z USING (group_id)) GROUP BY ALL")
       + "SELECT row_id, depth, round(score, 6) AS score FROM s")
def _(t):
    out = V.centroid_scores(vectors(t.embeddings), "row_id", "group_id", "label", "vec", ["depth"], weighted=True, strict=True)
    return r6(out.select("row_id", "depth", "score"), "score")


LOO = UNIT.rstrip() + """,
m AS (SELECT e.row_id, e.depth, e.label AS truth, t.label, e.x, t.s - CASE WHEN e.label = t.label THEN e.x ELSE 0 END AS y FROM e JOIN t ON e.depth = t.depth AND e.i = t.i),
s AS (SELECT row_id, depth, truth, label, sum(x * y) / sqrt(sum(y * y)) AS sim FROM m GROUP BY ALL),
a AS (SELECT row_id, depth, truth, max(sim) FILTER (WHERE label = 1) > max(sim) FILTER (WHERE label = 0) AS pick FROM s GROUP BY ALL),
l AS (SELECT depth, round(avg((pick::INT = truth)::INT), 6) AS accuracy, count(*) AS "rows" FROM a GROUP BY 1)
"""


@query("vec09_leave_one_out_accuracy", LOO + "SELECT * FROM l")
def _(t):
    return r6(V.leave_one_out_accuracy(vectors(t.embeddings), "row_id", "label", "vec", "depth"), "accuracy")


@query("srt05_best_layers", LOO + "SELECT * FROM l ORDER BY accuracy DESC, depth DESC LIMIT 3")
def _(t):
    return O.best_layers(r6(V.leave_one_out_accuracy(vectors(t.embeddings), "row_id", "label", "vec", "depth"), "accuracy"), "depth", "accuracy", 3)


@query("srt06_nearest_runs", """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT min(vec_id) AS query_id FROM v GROUP BY label),
s AS (SELECT query_id, b.vec_id, list_cosine_similarity(a.v, b.v) AS similarity FROM q JOIN v a ON a.vec_id = query_id JOIN v b ON b.vec_id <> query_id)
SELECT query_id, vec_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS "rank" FROM s QUALIFY "rank" <= 8""")
def _(t):
    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id"))
    return r6(V.nearest_runs(t.embeddings, first, "vec_id", "embedding", 8), "similarity")


BUNDLE = """
, b AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY depth, group_id) AS w, (score >= 0)::INT AS p FROM s),
kk AS (SELECT depth, count(*) AS n, sum(p * label) AS tp, sum((1 - p) * label) AS fn, sum(p * (1 - label)) AS fp, sum((1 - p) * (1 - label)) AS tn,
  sum(w * p * label) AS wtp, sum(w * (1 - p) * label) AS wfn, sum(w * p * (1 - label)) AS wfp, sum(w * (1 - p) * (1 - label)) AS wtn FROM b GROUP BY 1),
a AS (SELECT x.depth, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) AS roc_auc,
  sum(x.w * y.w * CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) / sum(x.w * y.w) AS weighted_roc_auc
  FROM b x JOIN b y ON x.depth = y.depth AND x.label = 1 AND y.label = 0 GROUP BY 1),
f AS (SELECT kk.depth, n, round((tp + tn) / n, 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((wtp / (wtp + wfn) + wtn / (wtn + wfp)) / 2, 6) AS weighted_balanced_accuracy,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(roc_auc, 6) AS roc_auc, round(weighted_roc_auc, 6) AS weighted_roc_auc
  FROM kk JOIN a ON kk.depth = a.depth)
"""
METRICS = ["accuracy", "balanced_accuracy", "weighted_balanced_accuracy", "f1", "mcc", "roc_auc", "weighted_roc_auc"]


@query("vec10_layer_sweep", CENTROID.rstrip() + BUNDLE + "SELECT * FROM f")
def _(t):
    return r6(M.metric_bundle(_scores(t), ["depth"], "label", "score", "group_id"), *METRICS)


@query("met01_confusion", CENTROID + "SELECT depth, label, (score >= 0)::INT AS prediction, count(*) AS \"count\" FROM s GROUP BY ALL")
def _(t):
    return M.confusion(_scores(t), ["depth"], "label", "score")


MARGIN_SQL = """
WITH s AS (SELECT category AS depth, pair_id AS group_id, (trace_branch = 'QSTAR')::INT AS label, floor(margin / 700) AS score FROM runs)
"""


def _margins(t):
    return t.runs.select(
        c("category").alias("depth"), c("pair_id").alias("group_id"), (c("trace_branch") == "QSTAR").cast("int").alias("label"),
        F.floor(c("margin") / 700).cast("double").alias("score"))


COUNTED_BUNDLE = (BUNDLE.replace("FROM b x JOIN b y ON x.depth = y.depth AND x.label = 1 AND y.label = 0 GROUP BY 1",
                  "FROM (SELECT depth, score, 1 AS label, count(*) AS k, sum(w) AS w FROM b WHERE label = 1 GROUP BY 1, 2) x JOIN (SELECT depth, score, count(*) AS k, sum(w) AS w FROM b WHERE label = 0 GROUP BY 1, 2) y ON x.depth = y.depth GROUP BY 1")
                  .replace("avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END)", "sum(x.k * y.k * CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) / sum(x.k * y.k)"))


@query("met02_metric_bundle", MARGIN_SQL.rstrip() + COUNTED_BUNDLE + "SELECT * FROM f")
def _(t):
    return r6(M.metric_bundle(_margins(t), ["depth"], "label", "score", "group_id"), *METRICS)


@query("met03_weighted_balanced_accuracy", """
WITH b AS (SELECT (trace_branch = 'QSTAR')::INT AS y, (margin >= 0)::INT AS p, 1.0 / count(*) OVER (PARTITION BY pair_id) AS w FROM runs)
SELECT round((sum(w * y * p) / sum(w * y) + sum(w * (1 - y) * (1 - p)) / sum(w * (1 - y))) / 2, 6) AS weighted_balanced_accuracy FROM b""")
def _(t):
    rows = t.runs.select("pair_id", (c("trace_branch") == "QSTAR").cast("int").alias("label"), c("margin").cast("double").alias("score"), F.lit(1).alias("one"))
    return r6(M.metric_bundle(rows, ["one"], "label", "score", "pair_id").select("weighted_balanced_accuracy"), "weighted_balanced_accuracy")


@query("met04_roc_auc", """
WITH b AS (SELECT condition, (trace_branch = 'QSTAR')::INT AS y, margin, count(*) AS k FROM runs GROUP BY ALL),
a AS (SELECT x.condition, sum(x.k * y.k * CASE WHEN x.margin > y.margin THEN 1.0 WHEN x.margin = y.margin THEN 0.5 ELSE 0 END) / sum(x.k * y.k) AS r FROM b x JOIN b y ON x.condition = y.condition AND x.y = 1 AND y.y = 0 GROUP BY 1)
SELECT condition, round(r, 6) AS roc_auc FROM a""")
def _(t):
    rows = t.runs.select("condition", (c("trace_branch") == "QSTAR").cast("int").alias("label"), c("margin").cast("double").alias("score"))
    return r6(M.roc_auc(rows, ["condition"], "label", "score"), "roc_auc")


@query("met05_spearman", """
WITH r AS (SELECT condition, rank() OVER (PARTITION BY condition ORDER BY margin) + (count(*) OVER (PARTITION BY condition, margin) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY condition ORDER BY pair_id) + (count(*) OVER (PARTITION BY condition, pair_id) - 1) / 2.0 AS b FROM runs),
s AS (SELECT condition, count(*) AS n, corr(a, b) AS r, count(*) - 2 AS df FROM r GROUP BY 1),
u AS (SELECT *, sqrt(1 - r * r) AS c FROM s),
f AS (SELECT *, CASE WHEN df % 2 = 0 THEN abs(r) * list_sum(list_transform(range(df // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0) - ln(pi()) / 2 + 2 * k * ln(c))))
  ELSE 2 / pi() * (asin(abs(r)) + abs(r) * list_sum(list_transform(range((df - 1) // 2), lambda k: exp(lgamma(k + 1.0) + lgamma(1.5) - lgamma(k + 1.5) + (2 * k + 1) * ln(c))))) END AS inner_share FROM u)
SELECT condition, n, round(r, 6) AS spearman, round(1 - inner_share, 6) AS spearman_p FROM f""")
def _(t):
    return r6(M.spearman(t.runs, ["condition"], "margin", "pair_id"), "spearman", "spearman_p")


def _texts(t):
    return t.documents.join(t.labels, "doc_id").select("doc_id", c("source").alias("grp"), "text", "quality")


TFIDF = r"""
WITH d AS (SELECT doc_id, source AS grp, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}_](?:[\p{L}\p{M}\p{Nd}_/+=-]*[\p{L}\p{M}\p{Nd}_])?') AS w FROM documents JOIN labels USING (doc_id)),
x AS (SELECT doc_id, grp, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM d),
tf AS (SELECT doc_id, grp, term, count(*) AS tf FROM x GROUP BY ALL),
own AS (SELECT grp, term, count(*) AS df, sum(tf) AS n FROM tf GROUP BY ALL), tot AS (SELECT term, sum(df) AS df, sum(n) AS n FROM own GROUP BY 1 HAVING sum(df) >= 2),
f AS (SELECT DISTINCT grp AS fold FROM tf), docs AS (SELECT grp, count(DISTINCT doc_id) AS n FROM tf GROUP BY 1),
adj AS (SELECT fold, tot.term, tot.df - coalesce(own.df, 0) AS df, tot.n - coalesce(own.n, 0) AS n FROM f CROSS JOIN tot LEFT JOIN own ON own.grp = fold AND own.term = tot.term),
voc AS (SELECT fold, term, ln((1 + (SELECT sum(n) FROM docs) - docs.n) / (1 + df)) + 1 AS idf FROM (SELECT * FROM adj WHERE df >= 2 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY n DESC, term) <= 3000) JOIN docs ON docs.grp = fold),
w AS (SELECT doc_id, tf.term, (1 + ln(tf)) * idf AS w FROM tf JOIN voc ON fold = grp AND voc.term = tf.term),
s AS (SELECT doc_id, count(*) AS terms, sum(w) / sqrt(sum(w * w)) AS total FROM w GROUP BY 1)
SELECT doc_id, terms, round(total, 5) AS total FROM s
"""


@query("mod01_tfidf", TFIDF)
def _(t):
    terms = written(Q.ngrams(_texts(t), "doc_id", "grp", "text"), "terms")
    vocab = Q.fold_vocabulary(terms, "doc_id", "grp")
    out = Q.held_out_tfidf(terms, vocab, "doc_id", "grp")
    out = out.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("weight").alias("total"))
    return out.withColumn("total", F.round("total", 5))


@query("mod01_text_monitor")
def _(t):
    return r6(textmodel.text_scores(_texts(t), "doc_id", "grp", "quality", "text"), "score")


def _flat(t):
    return t.embeddings.select(
        c("vec_id").alias("row_id"), (c("vec_id") % 29).alias("group_id"), F.when(c("label") < 5, 1).otherwise(0).alias("label"),
        V.l2_normalise(V.doubles(c("embedding"))).alias("x"), (c("vec_id") % 3).alias("variant"))


@query("mod02_held_out_logistic")
def _(t):
    return r6(Q.group_held_out_scores(_flat(t), "row_id", "group_id", "label", c("x"), 64), "score")


@query("mod03_scaled_metadata_model")
def _(t):
    rows = _texts(t).select("doc_id", "grp", "quality", *S.trace_features(c("text")))
    x = F.array(*[F.log1p(k).cast("double") for k in ("cot_chars", "cot_lines", "cot_fraction_slashes", "cot_verify_mentions", "cot_question_mentions", "cot_wait_mentions")])
    rows = rows.select("doc_id", "grp", "quality", x.alias("x"))
    return r6(Q.group_held_out_scores(rows, "doc_id", "grp", "quality", c("x"), 6, transform="scale"), "score")


@query("mod04_pca_logistic")
def _(t):
    return r6(Q.group_held_out_scores(_flat(t), "row_id", "group_id", "label", c("x"), 64, transform="pca"), "score")


@query("mod05_cross_condition")
def _(t):
    out = Q.group_held_out_scores(_flat(t), "row_id", "group_id", "label", c("x"), 64, transform="pca", train=c("variant") != 2, test=c("variant") == 2)
    return r6(out, "score")


PRIOR = """
WITH r AS (SELECT run_id, condition, pair_id, (trace_branch = 'QSTAR')::INT AS y FROM runs),
g AS (SELECT condition, pair_id, sum(y) AS s, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT condition, sum(s) AS s, sum(n) AS n FROM g GROUP BY 1),
p AS (SELECT g.condition, g.pair_id, (k.s - g.s + 1) / (k.n - g.n + 2) AS p FROM g JOIN k ON g.condition = k.condition)
SELECT run_id, round(ln(p / (1 - p)), 6) AS score FROM r JOIN p ON r.condition = p.condition AND r.pair_id = p.pair_id
"""


def _labelled(t):
    return t.runs.select("run_id", "condition", "pair_id", c("margin").cast("double").alias("margin"), (c("trace_branch") == "QSTAR").cast("int").alias("label"))


@query("mod06_condition_prior", PRIOR)
def _(t):
    return r6(Q.condition_prior(_labelled(t), "condition", "pair_id", "label").select("run_id", "score"), "score")


@query("mod07_baselines", "SELECT run_id, 'majority' AS monitor, 1.0::DOUBLE AS score FROM runs UNION ALL SELECT run_id, 'direct_margin', CAST(margin AS DOUBLE) FROM runs")
def _(t):
    rows = _labelled(t)
    return Q.long_predictions({"majority": Q.majority(rows), "direct_margin": rows.withColumn("score", c("margin"))}, ["run_id"])


# Bounds of the balanced accuracy over draws of groups, from a table s(depth, group_id, label, score).
BOUNDS = """,
ix AS (SELECT group_id, row_number() OVER (ORDER BY group_id) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM s)),
dw AS (SELECT rep, CAST('0x' || substr(sha256(concat('20260710:', rep, ':', i)), 1, 12) AS BIGINT) % n + 1 AS i FROM ix, (SELECT unnest(range(5000)) AS rep)),
tm AS (SELECT rep, i, count(*) AS times FROM dw GROUP BY ALL),
ce AS (SELECT depth, group_id, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 1 AND score >= 0) AS tp,
  count(*) FILTER (WHERE label = 0) AS q, count(*) FILTER (WHERE label = 0 AND score < 0) AS tn FROM s GROUP BY ALL),
dr AS (SELECT depth, rep, sum(p * times) AS p, sum(tp * times) AS tp, sum(q * times) AS q, sum(tn * times) AS tn FROM ce JOIN ix USING (group_id) JOIN tm USING (i) GROUP BY ALL),
bo AS (SELECT depth, count(*) AS repetitions, round(quantile_cont(ba, 0.025), 6) AS ci_low, round(quantile_cont(ba, 0.975), 6) AS ci_high
  FROM (SELECT depth, (tp / p + tn / q) / 2 AS ba FROM dr WHERE p > 0 AND q > 0) GROUP BY 1)
"""
COMPARED = PRIOR[:PRIOR.rstrip().rindex("\n")].rstrip() + """,
o AS (SELECT run_id, pair_id AS group_id, (trace_branch = 'QSTAR')::INT AS label, margin FROM runs),
s AS (SELECT 'majority' AS depth, group_id, label, 1.0::DOUBLE AS score FROM o UNION ALL SELECT 'direct_margin', group_id, label, margin::DOUBLE FROM o
  UNION ALL SELECT 'condition_prior', o.group_id, label, ln(p.p / (1 - p.p)) FROM o JOIN r USING (run_id) JOIN p ON r.condition = p.condition AND r.pair_id = p.pair_id)
"""


@query("mod08_monitor_comparison", COMPARED.rstrip() + COUNTED_BUNDLE.rstrip() + BOUNDS
       + "SELECT f.* EXCLUDE (depth) REPLACE (CASE WHEN isnan(mcc) OR mcc IS NULL THEN 0 ELSE mcc END AS mcc), f.depth AS monitor, repetitions, ci_low, ci_high FROM f JOIN bo USING (depth)")
def _(t):
    rows = _labelled(t)
    monitors = {"majority": Q.majority(rows), "direct_margin": rows.withColumn("score", c("margin")),
                "condition_prior": Q.condition_prior(rows, "condition", "pair_id", "label")}
    long = Q.long_predictions(monitors, ["run_id", "pair_id", "label"])
    return r6(X.comparison(long, ["monitor"], "label", "score", "pair_id"), *METRICS, "ci_low", "ci_high")


# Draws of a repetition: the groups of equal coverage by SHA-256 of seed, repetition and group.
MOVES = """
WITH l AS (SELECT vec_id, vec_id % 29 AS g, vec_id // 29 AS variant, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, embedding FROM embeddings),
st AS (SELECT g, string_agg(variant::VARCHAR, ',' ORDER BY variant) AS stratum FROM l GROUP BY 1),
pl AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY g) AS pos FROM st),
dr AS (SELECT rep, stratum, g AS source, row_number() OVER (PARTITION BY rep, stratum ORDER BY sha256(concat('SEED:', rep, ':', g)), g) AS pos FROM pl, (SELECT unnest(range(REPS)) AS rep)),
mv AS (SELECT rep, pl.g, source FROM dr JOIN pl USING (stratum, pos))
"""
TRAJECTORIES = MOVES.replace("SEED", "7").replace("REPS", "400") + """
SELECT rep, mv.g AS group_id, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(y * (variant + 1)) AS BIGINT) AS places, count(*) AS "rows" FROM mv JOIN l ON l.g = source GROUP BY 1, 2"""


def _variants(t):
    return c("vec_id").alias("row_id"), (c("vec_id") % 29).alias("group_id"), F.floor(c("vec_id") / 29).alias("variant")


@query("rsm01_trajectory_permutation", TRAJECTORIES)
def _(t):
    one = t.embeddings.select(*_variants(t), F.when(c("label") < 5, 1).otherwise(0).alias("label"))
    moved = X.permute_labels(one, "group_id", "variant", "label", 400, 7)
    return moved.groupBy("rep", "group_id").agg(
        F.sum("permuted").alias("positives"), F.sum(c("permuted") * (c("variant") + 1)).alias("places"), F.count("*").alias("rows"))


def _null(t, reps):
    rows = vectors(t.embeddings).withColumn("variant", F.floor(c("row_id") / 29))
    return trajectories.null_aucs(rows, "row_id", "group_id", "variant", "label", "vec", ["depth"], reps, 20260717)


@query("rsm02_permutation_p")
def _(t):
    observed = M.roc_auc(_scores(t), ["depth"], "label", "score").agg(F.max("roc_auc")).scalar()
    null = X.max_statistic(cut_lineage(_null(t, 2000)), "rep", "roc_auc")
    return r6(X.permutation_p(null, observed, "roc_auc"), "p_value", "null_q95")


@query("rsm03_cluster_bootstrap", MARGIN_SQL.rstrip() + BOUNDS + "SELECT * FROM bo")
def _(t):
    return r6(X.cluster_bootstrap(_margins(t), ["depth"], "group_id", "label", "score", repetitions=5000), "ci_low", "ci_high")


@query("rsm04_null_quantile", "SELECT round(quantile_cont(m, 0.95), 6) AS null_q95 FROM (SELECT pair_id, max(margin) AS m FROM runs GROUP BY 1)")
def _(t):
    null = X.max_statistic(t.runs, "pair_id", "margin")
    return r6(X.permutation_p(null, F.lit(0), "margin").select("null_q95"), "null_q95")


@query("udf01_fold_estimator")
def _(t):
    rows = P.group_row_weight(_flat(t).withColumn("group_id", c("row_id") % 3), "group_id").withColumn("features", array_to_vector("x"))
    fit = Q.spark_logistic("features", "label", "weight", ["row_id", "group_id", "label"])
    return Q.scores_by_fold(rows.select("row_id", "group_id", "label", "weight", "features"), "group_id", fit)


@query("udf02_row_selectors", CENTROID.replace("g AS (SELECT depth, group_id, label, i, sum(x) AS s, count(*) AS n FROM e GROUP BY ALL)", "g AS (SELECT depth, group_id, label, i, sum(x) AS s, count(*) AS n FROM e WHERE row_id % 3 <> 2 GROUP BY ALL)")
       .replace("FROM e GROUP BY ALL)\n", "FROM e WHERE row_id % 3 <> 2 GROUP BY ALL)\n").replace("t AS (SELECT depth, label, i, sum(x) AS s, count(*) AS n FROM e GROUP BY ALL)", "t AS (SELECT depth, label, i, sum(x) AS s, count(*) AS n FROM e WHERE row_id % 3 <> 2 GROUP BY ALL)")
       + "SELECT row_id, depth, round(score, 6) AS score FROM s WHERE row_id % 3 = 2")
def _(t):
    out = V.centroid_scores(vectors(t.embeddings), "row_id", "group_id", "label", "vec", ["depth"], train=c("row_id") % 3 != 2, test=c("row_id") % 3 == 2)
    return r6(out.select("row_id", "depth", "score"), "score")


@query("udf03_expression_aggregates", """
SELECT condition, round(avg((final_branch = 'Q')::INT), 6) AS q_share, round(avg((final_branch NOT IN ('Q', 'QSTAR'))::INT), 6) AS other_share, count(*) FILTER (WHERE final_branch = 'Q') AS q_rows FROM runs GROUP BY 1""")
def _(t):
    b = c("final_branch")
    out = t.runs.groupBy("condition").agg(
        F.avg((b == "Q").cast("double")).alias("q_share"), F.avg((~b.isin("Q", "QSTAR")).cast("double")).alias("other_share"), F.count_if(b == "Q").alias("q_rows"))
    return r6(out, "q_share", "other_share")
