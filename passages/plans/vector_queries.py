"""Profiles and vector features on the embeddings: blocks of 50 vectors are sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.functions import vectors as V
from passages.operators import profiles as P
from passages.operators.scan import neighbours
from passages.plans.registry import query, table

VI_ANCHORS = """CASE WHEN vec_id % 12 = 0 THEN {arr}label, CAST((label + 3) % 10 AS INT){end} WHEN vec_id % 4 = 0 THEN {arr}label{end} ELSE {empty} END"""
VI = f"""vi AS (SELECT vec_id, vec_id // 50 AS seq, vec_id % 50 AS pos, embedding::DOUBLE[] AS v, label,
     {VI_ANCHORS.format(arr="[", end="]", empty="[]::INT[]")} AS anchors FROM embeddings)"""


def items(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(
        "vec_id", F.floor(F.col("vec_id") / 50).alias("seq"), (F.col("vec_id") % 50).alias("pos"),
        V.doubles("embedding").alias("vector"), "label",
        F.expr(VI_ANCHORS.format(arr="array(", end=")", empty="cast(array() AS array<int>)")).alias("anchors"),
    )


def texts(spark, d):
    """Catalogue entries: the first vector of each label, and the last one as fallback."""
    return items(spark, d).groupBy("label").agg(
        F.min_by("vector", "vec_id").alias("text_vector"), F.max_by("vector", "vec_id").alias("fallback")
    )


TX = "tx AS (SELECT label, min_by(v, vec_id) AS t, max_by(v, vec_id) AS fb FROM vi GROUP BY label)"


def fingerprint(v):
    """Three numbers that pin a vector without printing it."""
    w = F.transform(v, lambda x, i: x * (i + 1))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return [
        F.round(total(F.col(v)), 5).alias("s1"),
        F.round(total(w), 4).alias("s2"),
        F.round(F.get(F.col(v), F.lit(7)), 6).alias("x8"),
    ]


def fp_sql(v):
    return (
        f"round(list_sum({v}), 5) AS s1, round(list_sum(list_transform(range(1, len({v}) + 1), lambda i: {v}[i] * i)), 4) AS s2, "
        f"round({v}[8], 6) AS x8"
    )


@query("l2_normalise", f"WITH {VI}, n AS (SELECT vec_id, list_transform(v, lambda x: (x * 3) / sqrt(list_sum(list_transform(v, lambda y: y * y * 9)))) AS u FROM vi) SELECT vec_id, {fp_sql('u')} FROM n")
def l2_normalise(spark, d):
    tripled = F.transform("vector", lambda x: x * 3)
    rows = items(spark, d).withColumn("tripled", tripled).withColumn("u", V.l2_normalise("tripled"))
    return rows.select("vec_id", *fingerprint("u"))


def sums_sql(stop=False):
    guard = (
        " AND NOT EXISTS (SELECT 1 FROM vi o, unnest(o.anchors) t(x) WHERE o.seq = a.seq AND o.pos > a.pos AND o.pos <= j.pos AND x <> a.l)"
        if stop
        else ""
    )
    return f"""pr AS (SELECT a.seq, a.l AS label, j.v FROM (SELECT seq, pos, unnest(anchors) AS l FROM vi) a
            JOIN vi j ON j.seq = a.seq AND j.pos BETWEEN a.pos AND a.pos + 2{guard}),
        ps AS (SELECT seq, label, list(s ORDER BY i) AS total, any_value(n) AS n FROM
               (SELECT seq, label, i, sum(x) AS s, count(*) AS n FROM (SELECT seq, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pr) GROUP BY ALL) GROUP BY seq, label)"""


@query("profile_sums", f"WITH {VI}, {sums_sql()} SELECT seq, label, n, {fp_sql('total')} FROM ps")
def profile_sums(spark, d):
    return P.profile_sums(items(spark, d)).select("seq", "label", "n", *fingerprint("total"))


@query("profile_sums_stop", f"WITH {VI}, {sums_sql(stop=True)} SELECT seq, label, n, {fp_sql('total')} FROM ps")
def profile_sums_stop(spark, d):
    return P.profile_sums(items(spark, d), stop=True).select("seq", "label", "n", *fingerprint("total"))


# total per label, then per (sequence, label) the profile without the sequence's own part
LOO = f"""{VI}, {TX}, {sums_sql()},
   ct AS (SELECT label, list(s ORDER BY i) AS total, any_value(n) AS n FROM (SELECT label, i, sum(x) AS s, sum(n) AS n
          FROM (SELECT label, n, unnest(total) AS x, generate_subscripts(total, 1) AS i FROM ps) GROUP BY ALL) GROUP BY label),
   sl AS (SELECT s.seq, tx.label, tx.t, tx.fb, coalesce(ct.n, 0) - coalesce(ps.n, 0) AS n,
            list_transform(range(1, 65), lambda i: coalesce(ct.total[i], 0) - coalesce(ps.total[i], 0)) AS r
          FROM (SELECT DISTINCT seq FROM vi) s JOIN tx ON true LEFT JOIN ct USING (label) LEFT JOIN ps ON ps.seq = s.seq AND ps.label = tx.label),
   bs AS (SELECT seq, label, t, CASE WHEN n > 0 THEN list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) ELSE fb END AS b FROM sl),
   mx AS (SELECT seq, label, list_transform(range(1, 65), lambda i: 0.5 * b[i] + 0.5 * t[i]) AS m FROM bs),
   mu AS (SELECT seq, label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS u FROM mx)"""


@query("loo_profiles", f"WITH {LOO} SELECT mu.seq, mu.label, {fp_sql('u')} FROM mu JOIN ps ON ps.seq = mu.seq AND ps.label = mu.label")
def loo_profiles(spark, d):
    out = P.loo_profiles(P.profile_sums(items(spark, d)), texts(spark, d))
    return out.select("seq", "label", *fingerprint("profile"))


@query(
    "label_profiles",
    f"""WITH {VI}, {TX}, {sums_sql()},
        ct AS (SELECT label, list(s ORDER BY i) AS total FROM (SELECT label, i, sum(x) AS s FROM (SELECT label, unnest(total) AS x, generate_subscripts(total, 1) AS i FROM ps) GROUP BY ALL) GROUP BY label),
        m AS (SELECT label, list_transform(range(1, 65), lambda i: 0.5 * total[i] / sqrt(list_dot_product(total, total)) + 0.5 * t[i]) AS m FROM tx JOIN ct USING (label)),
        u AS (SELECT label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS u FROM m) SELECT label, {fp_sql('u')} FROM u""",
)
def label_profiles(spark, d):
    out = P.label_profiles(P.profile_sums(items(spark, d)), texts(spark, d))
    return out.select("label", *fingerprint("profile"))


@query(
    "cos_z_gain",
    f"""WITH {LOO}, c AS (SELECT vi.seq, vi.pos, mu.label, list_dot_product(vi.v, mu.u) AS cos FROM vi JOIN mu ON mu.seq = vi.seq)
        SELECT seq, pos, label, round(cos, 6) AS cos, round((cos - avg(cos) OVER w) / stddev_pop(cos) OVER w, 5) AS z,
               round(coalesce(cos - lag(cos) OVER (PARTITION BY seq, pos ORDER BY label), 0), 6) AS gain FROM c WINDOW w AS (PARTITION BY seq, pos)""",
)
def cos_z_gain(spark, d):
    scores = P.meaning_scores(items(spark, d), P.profile_sums(items(spark, d)), texts(spark, d))
    rows = P.pair_features(scores, ["cos", "z", "gain"], ["seq", "pos"])
    return rows.select(
        "seq", "pos", "label", F.round("cos", 6).alias("cos"), F.round("z", 5).alias("z"), F.round("gain", 6).alias("gain")
    )


@query("adjacent_cosine", f"WITH {VI} SELECT vec_id, round(coalesce(list_dot_product(v, lag(v) OVER (PARTITION BY seq ORDER BY pos)), 1), 6) AS adjacent FROM vi")
def adjacent_cosine(spark, d):
    return P.adjacent_cosine(items(spark, d)).select("vec_id", F.round("adjacent", 6).alias("adjacent"))


@query(
    "window_concat",
    f"""WITH {VI}, w AS (SELECT vec_id, [lag(v, 2) OVER o, lag(v) OVER o, v, lead(v) OVER o, lead(v, 2) OVER o] AS vs FROM vi WINDOW o AS (PARTITION BY seq ORDER BY pos)),
        f AS (SELECT vec_id, list_concat(flatten(list_transform(vs, lambda x: coalesce(x, list_transform(range(64), lambda i: 0.0::DOUBLE)))),
              list_transform([vs[1], vs[2], vs[4], vs[5]], lambda x: (x IS NULL)::INT::DOUBLE)) AS w FROM w) SELECT vec_id, len(w) AS width, {fp_sql('w')} FROM f""",
)
def window_concat(spark, d):
    rows = P.window_concat(items(spark, d), 64)
    return rows.select("vec_id", F.size("window").alias("width"), *fingerprint("window"))


@query(
    "item_features",
    f"""WITH {LOO}, c AS (SELECT vi.seq, vi.pos, any_value(len(anchors)) AS na, max(list_dot_product(vi.v, mu.u)) AS cos FROM vi JOIN mu ON mu.seq = vi.seq GROUP BY vi.seq, vi.pos)
        SELECT seq, pos, round(cos, 6) AS max_cos, (na > 0)::INT AS any_anchor FROM c""",
)
def item_features(spark, d):
    rows = items(spark, d)
    scores = P.meaning_scores(rows, P.profile_sums(rows), texts(spark, d))
    f = P.item_features("cos", "cos", "cos", "anchors")
    joined = rows.join(scores, ["seq", "pos"])
    return joined.select("seq", "pos", F.round(f["max_cos"], 6).alias("max_cos"), f["any_anchor"].alias("any_anchor"))


@query(
    "margin_stats",
    f"""WITH {LOO}, c AS (SELECT vi.seq, vi.pos, list_sort(list(list_dot_product(vi.v, mu.u)), 'DESC') AS s FROM vi JOIN mu ON mu.seq = vi.seq GROUP BY vi.seq, vi.pos)
        SELECT seq, pos, round(s[1], 6) AS abs, round(s[1] - s[2], 6) AS margin, round((s[1] - list_avg(s)) / list_stddev_pop(s), 5) AS z FROM c""",
)
def margin_stats(spark, d):
    rows = items(spark, d)
    scores = P.meaning_scores(rows, P.profile_sums(rows), texts(spark, d)).drop("z")
    s = P.abstention_statistics("cos")
    return scores.select(
        "seq", "pos", F.round(s["abs"], 6).alias("abs"), F.round(s["margin"], 6).alias("margin"), F.round(s["z"], 5).alias("z")
    )


@query(
    "z_scores_guarded",
    """SELECT vec_id, round(list_max(list_transform(v, lambda x: (x - list_avg(v)) / (list_stddev_pop(v) + 1e-6))), 5) AS top
       FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""",
)
def z_scores_guarded(spark, d):
    z = V.z_scores("vector", 1e-6)
    return items(spark, d).select("vec_id", F.round(F.array_max(z), 5).alias("top"))


@query(
    "position_weights",
    f"""WITH {VI}, n AS (SELECT seq, count(*) AS n FROM vi GROUP BY seq), s AS (SELECT vi.seq, vi.pos, label, abs(v[1]) * CASE WHEN pos / n.n < 0.2 THEN 0.9 ELSE 1 END AS score FROM vi JOIN n USING (seq))
        SELECT seq, pos, label, round(score, 6) AS score FROM s WHERE score >= 0.05 AND label NOT IN (3, 7)""",
)
def position_weights(spark, d):
    from passages.operators.match import position_weight

    rows = items(spark, d).withColumn("score", F.abs(F.get("vector", F.lit(0))))
    stop = spark.createDataFrame([(3,), (7,)], "label int")
    sizes = rows.groupBy("seq").agg(F.count(F.lit(1)).alias("items"))
    out = position_weight(rows.filter("score >= 0.05"), sizes, stop, threshold=0.05)
    return out.select("seq", "pos", "label", F.round("score", 6).alias("score"))


@query(
    "neighbour",
    f"WITH {VI} SELECT vec_id, lag(vec_id) OVER w AS before, lead(vec_id) OVER w AS after FROM vi WINDOW w AS (PARTITION BY seq ORDER BY pos)",
)
def neighbour(spark, d):
    rows = neighbours(
        items(spark, d), ["seq"], "pos", lambda w: {"before": F.lag("vec_id").over(w), "after": F.lead("vec_id").over(w)}, 1, 1
    )
    return rows.select("vec_id", "before", "after")
