"""Decoding of the event sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.operators import decode as D
from passages.operators import sequence as S
from passages.plans.registry import query
from passages.plans.sequence_queries import COUNTS, N_LABELS, OFF, P_OFF, scored, shown

LOG_A = """la AS (SELECT list(log_p ORDER BY a, b) AS A FROM (SELECT a, b, ln(mass / sum(mass) OVER (PARTITION BY a)) AS log_p FROM
   (SELECT a, b, CASE WHEN a = 12 AND b = 12 THEN stay_off WHEN a = 12 THEN from_off / 12.0 WHEN b = 12 THEN to_off
              WHEN a = b THEN stay WHEN b - a IN (1, 2) THEN next / least(2.0, 11 - a) ELSE jump / (11.0 - least(2.0, 11 - a)) END::DOUBLE AS mass
    FROM cn, range(13) x(a), range(13) y(b))))"""
EMIT = f"""em AS (SELECT seq, unit, pos, list_append(list_transform(scores, lambda s: ln(least(1, greatest(1e-12, (1 - {P_OFF}) * s / list_sum(scores))))),
                       ln(least(1, greatest(1e-12, {P_OFF}))) - 1.5) AS e FROM ev)"""


def with_states(spark, d):
    return scored(spark, d).withColumn("state", S.state_of("gold", OFF))


def plain_model(spark, d):
    matrix = S.transition_matrix(S.transition_counts(with_states(spark, d), OFF), N_LABELS)
    return D.Model.plain(D.matrix_of(matrix, N_LABELS + 1))


@query(
    "viterbi",
    f"""WITH RECURSIVE {COUNTS}, {LOG_A}, {EMIT},
        vt AS (SELECT seq, pos, e AS score, []::BIGINT[] AS back FROM em WHERE pos = 0
               UNION ALL
               SELECT em.seq, em.pos, list_transform(range(1, 14), lambda j: list_max(list_transform(range(1, 14), lambda i: vt.score[i] + A[(i - 1) * 13 + j])) + em.e[j]),
                      list_transform(range(1, 14), lambda j: list_position(list_transform(range(1, 14), lambda i: vt.score[i] + A[(i - 1) * 13 + j]),
                                     list_max(list_transform(range(1, 14), lambda i: vt.score[i] + A[(i - 1) * 13 + j]))))
               FROM vt, la, em WHERE em.seq = vt.seq AND em.pos = vt.pos + 1),
        ls AS (SELECT seq, max(pos) AS last FROM vt GROUP BY seq),
        bt AS (SELECT vt.seq, vt.pos, list_position(score, list_max(score)) AS s FROM vt JOIN ls ON ls.seq = vt.seq AND ls.last = vt.pos
               UNION ALL SELECT bt.seq, bt.pos - 1, cur.back[bt.s] FROM bt, vt cur WHERE cur.seq = bt.seq AND cur.pos = bt.pos AND bt.pos > 0)
        SELECT seq, pos, (s - 1)::INT AS state FROM bt""",
)
def viterbi(spark, d):
    items = scored(spark, d).withColumn("emit", S.emissions("scores", "p_off", -1.5))
    return D.viterbi(items, plain_model(spark, d))


@query("viterbi_anchored")
def viterbi_anchored(spark, d):
    items = scored(spark, d).withColumn("emit", S.emissions("scores", "p_off", -1.5))
    return D.viterbi(items, plain_model(spark, d), gamma=0.5, delta=2.0, anchors="anchors")


@query("viterbi_resume")
def viterbi_resume(spark, d):
    matrix = S.transition_matrix_resume(S.transition_counts_resume(with_states(spark, d), OFF), N_LABELS)
    model = D.Model.resume(D.matrix_of(matrix, 2 * N_LABELS + 1), N_LABELS)
    items = scored(spark, d).withColumn("emit", S.emissions("scores", "p_off", -1.5))
    return D.viterbi(items, model)


@query(
    "forward_backward",
    f"""WITH RECURSIVE {COUNTS}, {LOG_A}, {EMIT},
        fa AS (SELECT seq, pos, list_transform(e, lambda x: exp(x)) AS f FROM em WHERE pos = 0
               UNION ALL
               SELECT em.seq, em.pos, list_transform(range(1, 14), lambda j: exp(em.e[j]) * list_sum(list_transform(range(1, 14), lambda i: fa.f[i] / list_sum(fa.f) * exp(A[(i - 1) * 13 + j]))))
               FROM fa, la, em WHERE em.seq = fa.seq AND em.pos = fa.pos + 1),
        ls AS (SELECT seq, max(pos) AS last FROM em GROUP BY seq),
        ba AS (SELECT seq, last AS pos, list_transform(range(13), lambda i: 1.0::DOUBLE) AS b FROM ls
               UNION ALL
               SELECT ba.seq, ba.pos - 1, list_transform(range(1, 14), lambda i: list_sum(list_transform(range(1, 14), lambda j: exp(A[(i - 1) * 13 + j]) * exp(em.e[j]) * ba.b[j] / list_sum(ba.b))))
               FROM ba, la, em WHERE em.seq = ba.seq AND em.pos = ba.pos AND ba.pos > 0),
        g AS (SELECT fa.seq, fa.pos, list_transform(range(1, 14), lambda i: f[i] * b[i]) AS g FROM fa JOIN ba ON ba.seq = fa.seq AND ba.pos = fa.pos)
        SELECT seq, pos, round(g[13] / list_sum(g), 6) AS p_off, round(list_max(g[1:12]) / list_sum(g), 6) AS p_best FROM g""",
)
def forward_backward(spark, d):
    items = scored(spark, d).withColumn("emit", S.emissions("scores", "p_off", -1.5))
    out = D.forward_backward(items, plain_model(spark, d))
    best = F.array_max(F.slice("posterior", 1, N_LABELS))
    return out.select("seq", "pos", F.round(F.get("posterior", F.lit(OFF)), 6).alias("p_off"), F.round(best, 6).alias("p_best"))


@query("decode")
def decode(spark, d):
    out = D.decode(scored(spark, d), plain_model(spark, d), "scores", "p_off", OFF, tau=0.9, beta=-1.5)
    return out.select("seq", "unit", "state", shown("extra"), F.round("p_state", 6).alias("p_state"))
