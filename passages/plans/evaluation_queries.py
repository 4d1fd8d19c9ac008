"""Scoring, agreement and log operators on events, orders, embeddings and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.operators import annotations as A
from passages.operators import evaluate as E
from passages.operators import sequence as S
from passages.plans.registry import query, table
from passages.plans.sequence_queries import CARRIED, EV, GOLD, both, events

N_BOOT = 200
THEMES = [v // 3 for v in range(12)]

PRED_A = f"""CASE WHEN event_id % 9 = 0 THEN {{empty}}
  WHEN event_id % 7 = 0 THEN {{arr}}CAST((user_id + event_id % 2 + 1) % 12 AS INT){{end}}
  WHEN event_id % 5 = 0 THEN {{arr}}CAST((user_id * 3 + event_id) % 12 AS INT){{end}}
  WHEN event_type = 'error' AND event_id % 4 = 0 THEN {{arr}}3{{end}}
  ELSE {GOLD} END"""
PRED_B = f"""CASE WHEN event_id % 8 = 0 THEN {{empty}}
  WHEN event_id % 6 = 0 THEN {{arr}}CAST((user_id + event_id % 2 + 11) % 12 AS INT), CAST((user_id + event_id % 2) % 12 AS INT){{end}}
  WHEN event_type = 'error' AND event_id % 3 = 0 THEN {{arr}}5{{end}}
  ELSE {GOLD} END"""
A_SPARK, A_SQL = both(PRED_A)
B_SPARK, B_SQL = both(PRED_B)
GOLD_SPARK, GOLD_SQL = both(GOLD)
TIER_SPARK = "transform(gold, (v, i) -> named_struct('label', v, 'tier', 'T' || (1 + (unit + i) % 5)))"

LB = f"""lb AS (SELECT user_id AS seq, event_id AS unit, event_type, {GOLD_SQL} AS gold, {A_SQL} AS a, {B_SQL} AS b FROM events),
   g AS (SELECT seq, unit, unnest(gold) AS l, generate_subscripts(gold, 1) - 1 AS i FROM lb),
   pa AS (SELECT seq, unit, unnest(a) AS l FROM lb), pb AS (SELECT seq, unit, unnest(b) AS l FROM lb),
   ja AS (SELECT coalesce(g.seq, p.seq) AS seq, (g.l IS NOT NULL AND p.l IS NOT NULL)::INT AS tp, (g.l IS NULL)::INT AS fp, (p.l IS NULL)::INT AS fn
          FROM g FULL JOIN pa p ON g.unit = p.unit AND g.l = p.l),
   jb AS (SELECT coalesce(g.seq, p.seq) AS seq, (g.l IS NOT NULL AND p.l IS NOT NULL)::INT AS tp, (g.l IS NULL)::INT AS fp, (p.l IS NULL)::INT AS fn
          FROM g FULL JOIN pb p ON g.unit = p.unit AND g.l = p.l)"""


def prf_sql(tp="tp", fp="fp", fn="fn"):
    return (
        f"round(coalesce({tp} / nullif({tp} + {fp}, 0), 0), 6) AS precision, round(coalesce({tp} / nullif({tp} + {fn}, 0), 0), 6) AS recall, "
        f"round(coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0), 6) AS f1"
    )


def labelled(spark, d):
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("seq"), F.col("event_id").alias("unit"), "event_type",
        F.expr(GOLD_SPARK).alias("gold"), F.expr(A_SPARK).alias("a"), F.expr(B_SPARK).alias("b"),
    )
    return rows.withColumn("tiers", F.expr(TIER_SPARK))


def rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


P3 = ("precision", "recall", "f1")


@query(
    "prf_strict",
    f"""WITH {LB}, c AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ja)
        SELECT tp, fp, fn, (SELECT count(*) FROM lb) AS items, (SELECT count(*) FROM lb WHERE len(a) > 0) AS fired, {prf_sql()} FROM c""",
)
def prf_strict(spark, d):
    return rounded(E.prf(labelled(spark, d), pred="a"), *P3)


@query(
    "prf_by_sequence",
    f"""WITH {LB}, c AS (SELECT seq, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ja GROUP BY seq),
        n AS (SELECT seq, count(*) AS items, count(*) FILTER (WHERE len(a) > 0) AS fired FROM lb GROUP BY seq)
        SELECT seq, tp, fp, fn, items, fired, {prf_sql()} FROM c JOIN n USING (seq)""",
)
def prf_by_sequence(spark, d):
    return rounded(E.prf(labelled(spark, d), ["seq"], pred="a"), *P3)


@query(
    "prf_near",
    f"""WITH {LB}, h AS (SELECT pa.*, EXISTS (SELECT 1 FROM g WHERE g.unit = pa.unit AND g.seq = pa.seq AND abs(g.l - pa.l) <= 1) AS hit FROM pa),
        k AS (SELECT g.*, EXISTS (SELECT 1 FROM pa WHERE g.unit = pa.unit AND g.seq = pa.seq AND abs(g.l - pa.l) <= 1) AS hit FROM g),
        c AS (SELECT (SELECT count(*) FILTER (WHERE hit) FROM h) AS pred_hits, (SELECT count(*) FROM h) AS n_pred,
                     (SELECT count(*) FILTER (WHERE hit) FROM k) AS gold_hits, (SELECT count(*) FROM k) AS n_gold),
        r AS (SELECT *, pred_hits / n_pred AS p, gold_hits / n_gold AS r FROM c)
        SELECT pred_hits, n_pred, gold_hits, n_gold, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM r""",
)
def prf_near(spark, d):
    return rounded(E.near_prf(labelled(spark, d), 1, pred="a"), *P3)


@query(
    "prf_theme",
    f"""WITH {LB}, tg AS (SELECT DISTINCT unit, l // 3 AS t FROM g), tp AS (SELECT DISTINCT unit, l // 3 AS t FROM pa),
        j AS (SELECT (tg.t IS NOT NULL AND tp.t IS NOT NULL)::INT AS tp, (tg.t IS NULL)::INT AS fp, (tp.t IS NULL)::INT AS fn FROM tg FULL JOIN tp ON tg.unit = tp.unit AND tg.t = tp.t),
        c AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM j)
        SELECT tp, fp, fn, (SELECT count(*) FROM lb) AS items, (SELECT count(*) FROM lb WHERE len(a) > 0) AS fired, {prf_sql()} FROM c""",
)
def prf_theme(spark, d):
    return rounded(E.theme_prf(labelled(spark, d), THEMES, pred="a"), *P3)


@query(
    "tier_recall",
    f"""WITH {LB}, t AS (SELECT 'T' || (1 + (g.unit + g.i) % 5) AS tier, (pa.l IS NOT NULL)::INT AS hit FROM g LEFT JOIN pa ON g.unit = pa.unit AND g.l = pa.l)
        SELECT tier, sum(hit)::BIGINT AS hits, count(*) AS n, grouping(tier)::INT AS pooled, round(sum(hit) / count(*), 6) AS recall FROM t GROUP BY ROLLUP (tier)""",
)
def tier_recall(spark, d):
    out = rounded(E.tier_recall(labelled(spark, d), pred="a"), "recall")
    return out.withColumn("pooled", F.col("pooled").cast("int"))


@query(
    "recall_by_group",
    f"""WITH {LB}, t AS (SELECT g.seq % 10 AS part, 'T' || (1 + (g.unit + g.i) % 5) AS tier, (pa.l IS NOT NULL)::INT AS hit FROM g LEFT JOIN pa ON g.unit = pa.unit AND g.l = pa.l)
        SELECT part, tier, sum(hit)::BIGINT AS hits, count(*) AS n, grouping(tier)::INT AS pooled, round(sum(hit) / count(*), 6) AS recall
        FROM t GROUP BY GROUPING SETS ((part, tier), (part))""",
)
def recall_by_group(spark, d):
    items = labelled(spark, d).withColumn("part", F.col("seq") % 10)
    out = rounded(E.tier_recall(items, pred="a", by=["part"]), "recall")
    return out.withColumn("pooled", F.col("pooled").cast("int"))


@query(
    "attractors",
    f"""WITH {LB} SELECT pa.l AS label, count(*) AS false_positives FROM pa LEFT JOIN g ON g.unit = pa.unit AND g.l = pa.l
        WHERE g.l IS NULL GROUP BY pa.l""",
)
def attractors(spark, d):
    return E.attractors(labelled(spark, d), pred="a")


DRAW = "(('0x' || substr(md5(rep || '-' || slot), 1, 8))::BIGINT % (SELECT count(*) FROM {t}))"
PER = LB + """, ca AS (SELECT seq, sum(tp) AS tp_a, sum(fp) AS fp_a, sum(fn) AS fn_a FROM ja GROUP BY seq),
   cb AS (SELECT seq, sum(tp) AS tp_b, sum(fp) AS fp_b, sum(fn) AS fn_b FROM jb GROUP BY seq),
   per AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS idx FROM ca JOIN cb USING (seq)),
   draws AS (SELECT rep, """ + DRAW.format(t="per") + f""" AS idx FROM range({N_BOOT}) r(rep), range((SELECT count(*) FROM per)::BIGINT) s(slot)),
   sums AS (SELECT rep, sum(tp_a) AS ta, sum(fp_a) AS pa_, sum(fn_a) AS na, sum(tp_b) AS tb, sum(fp_b) AS pb_, sum(fn_b) AS nb FROM draws JOIN per USING (idx) GROUP BY rep),
   fs AS (SELECT rep, 2 * ta / (2 * ta + pa_ + na) AS fa, 2 * tb / (2 * tb + pb_ + nb) AS fb FROM sums)"""
LO, HI = int(0.025 * N_BOOT) + 1, min(int(0.975 * N_BOOT), N_BOOT - 1) + 1


def per_sequence(spark, d):
    items = labelled(spark, d)
    counts = E.strict_counts("gold", "a") + E.strict_counts("gold", "b")
    names = [f"{c}_{s}" for s in "ab" for c in ("tp", "fp", "fn")]
    return items.groupBy("seq").agg(*[c.alias(n) for c, n in zip(counts, names, strict=True)])


@query(
    "bootstrap_ci",
    f"""WITH {PER} SELECT (SELECT count(*) FROM per) AS groups, (SELECT round(2 * sum(tp_a) / (2 * sum(tp_a) + sum(fp_a) + sum(fn_a)), 6) FROM per) AS f1,
          round(list_sort(list(fa))[{LO}], 6) AS f1_lo, round(list_sort(list(fa))[{HI}], 6) AS f1_hi FROM fs""",
)
def bootstrap_ci(spark, d):
    per = per_sequence(spark, d).select("seq", *[F.col(f"{c}_a").alias(c) for c in ("tp", "fp", "fn")])
    return rounded(E.bootstrap_ci(per, "seq", N_BOOT), "f1", "f1_lo", "f1_hi")


@query(
    "paired_bootstrap",
    f"""WITH {PER}, w AS (SELECT 2 * tp_a / nullif(2 * tp_a + fp_a + fn_a, 0) - 2 * tp_b / nullif(2 * tp_b + fp_b + fn_b, 0) AS x FROM per),
        wtl AS (SELECT count(*) FILTER (WHERE x > 1e-9) AS wins, count(*) FILTER (WHERE abs(x) <= 1e-9) AS ties, count(*) FILTER (WHERE x < -1e-9) AS losses FROM w),
        st AS (SELECT wins, ties, losses, least(1.0, 2 * list_sum(list_transform(range(least(wins, losses) + 1),
                 lambda k: exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2.0))))) AS p FROM wtl)
        SELECT (SELECT round(2 * sum(tp_a) / (2 * sum(tp_a) + sum(fp_a) + sum(fn_a)) - 2 * sum(tp_b) / (2 * sum(tp_b) + sum(fp_b) + sum(fn_b)), 6) FROM per) AS diff,
          round(list_sort(list(fa - fb))[{LO}], 6) AS lo, round(list_sort(list(fa - fb))[{HI}], 6) AS hi, round(avg((fa - fb <= 0)::INT), 6) AS share_le_0,
          any_value(wins) AS wins, any_value(ties) AS ties, any_value(losses) AS losses, round(any_value(p), 6) AS p_value FROM fs, st""",
)
def paired_bootstrap(spark, d):
    return rounded(E.paired_bootstrap(per_sequence(spark, d), "seq", N_BOOT), "diff", "lo", "hi", "share_le_0", "p_value")


@query(
    "rate_bootstrap",
    f"""WITH {LB}, per AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS idx FROM (SELECT seq, count(*) FILTER (WHERE len(a) > 0) AS a,
             count(*) FILTER (WHERE len(b) > 0) AS b, count(*) AS n FROM lb WHERE len(gold) = 0 GROUP BY seq)),
        draws AS (SELECT rep, {DRAW.format(t="per")} AS idx FROM range({N_BOOT}) r(rep), range((SELECT count(*) FROM per)::BIGINT) s(slot)),
        s AS (SELECT rep, sum(a) AS a, sum(b) AS b, sum(n) AS n FROM draws JOIN per USING (idx) GROUP BY rep),
        q AS (SELECT quantile_cont((a - b) / n, [0.025, 0.975]) AS dq, quantile_cont(a / greatest(b, 1), [0.025, 0.975]) AS rq FROM s)
        SELECT (SELECT round((sum(a) - sum(b)) / sum(n), 6) FROM per) AS diff, round(dq[1], 6) AS diff_lo, round(dq[2], 6) AS diff_hi,
               (SELECT round(sum(a) / sum(b), 6) FROM per) AS ratio, round(rq[1], 6) AS ratio_lo, round(rq[2], 6) AS ratio_hi FROM q""",
)
def rate_bootstrap(spark, d):
    empty = F.size("gold") == 0
    per = labelled(spark, d).groupBy("seq").agg(
        F.count_if(empty & (F.size("a") > 0)).alias("a"),
        F.count_if(empty & (F.size("b") > 0)).alias("b"),
        F.count_if(empty).alias("n"),
    )
    out = E.rate_bootstrap(per, "seq", N_BOOT)
    return rounded(out, *out.columns)


@query(
    "recall_ci",
    f"""WITH {LB}, per AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS idx FROM (SELECT g.seq, count(pa.l) AS hits, count(*) AS n
             FROM g LEFT JOIN pa ON g.unit = pa.unit AND g.l = pa.l WHERE (g.unit + g.i) % 5 = 1 GROUP BY g.seq)),
        draws AS (SELECT rep, {DRAW.format(t="per")} AS idx FROM range({N_BOOT}) r(rep), range((SELECT count(*) FROM per)::BIGINT) s(slot)),
        s AS (SELECT rep, sum(hits) / sum(n) AS r FROM draws JOIN per USING (idx) GROUP BY rep)
        SELECT (SELECT sum(hits)::BIGINT FROM per) AS hits, (SELECT sum(n)::BIGINT FROM per) AS n, (SELECT round(sum(hits) / sum(n), 6) FROM per) AS recall,
               round(list_sort(list(r))[{LO}], 6) AS lo, round(list_sort(list(r))[{HI}], 6) AS hi, (SELECT sum(n) < 20 FROM per) AS few FROM s""",
)
def recall_ci(spark, d):
    pairs = labelled(spark, d).select("seq", "a", F.explode("tiers").alias("g")).filter("g.tier = 'T2'")
    hit = F.array_contains("a", F.col("g.label")).cast("int")
    per = pairs.groupBy("seq").agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    return rounded(E.recall_ci(per, "seq", N_BOOT), "recall", "lo", "hi")


@query(
    "recall_ci_by",
    f"""WITH {LB}, x AS (SELECT g.seq, 'T' || (1 + (g.unit + g.i) % 5) AS tier, g.seq % 3 AS part, (pa.l IS NOT NULL)::INT AS hit FROM g LEFT JOIN pa ON g.unit = pa.unit AND g.l = pa.l),
        per AS (SELECT *, row_number() OVER (PARTITION BY part, tier ORDER BY seq) - 1 AS idx, count(*) OVER (PARTITION BY part, tier) AS m
                FROM (SELECT part, tier, seq, sum(hit) AS hits, count(*) AS n FROM x GROUP BY 1, 2, 3)),
        draws AS (SELECT part, tier, rep, ('0x' || substr(md5(rep || '-' || idx), 1, 8))::BIGINT % m AS idx FROM per, range({N_BOOT}) r(rep)),
        s AS (SELECT part, tier, rep, sum(hits) / sum(n) AS r FROM draws JOIN per USING (part, tier, idx) GROUP BY 1, 2, 3),
        ci AS (SELECT part, tier, list_sort(list(r)) AS rs FROM s GROUP BY 1, 2),
        point AS (SELECT part, tier, sum(hits)::BIGINT AS hits, sum(n)::BIGINT AS n, count(*) AS groups FROM per GROUP BY 1, 2)
        SELECT part, tier, hits, n, round(hits / n, 6) AS recall, CASE WHEN groups >= 5 THEN round(rs[{LO}], 6) END AS lo, CASE WHEN groups >= 5 THEN round(rs[{HI}], 6) END AS hi, n < 20 AS few
        FROM point JOIN ci USING (part, tier)""",
)
def recall_ci_by(spark, d):
    """Recall per part and tier, each with its interval over sequences and the mark of a thin sample."""
    pairs = labelled(spark, d).select("seq", (F.col("seq") % 3).alias("part"), "a", F.explode("tiers").alias("g"))
    hit = F.array_contains("a", F.col("g.label")).cast("int")
    per = pairs.groupBy("part", F.col("g.tier").alias("tier"), "seq").agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    return rounded(E.recall_ci(per, "seq", N_BOOT, by=["part", "tier"]), "recall", "lo", "hi")


@query(
    "verdicts",
    f"""WITH {PER}, x AS (SELECT seq, 2 * tp_a / nullif(2 * tp_a + fp_a + fn_a, 0) - 2 * tp_b / nullif(2 * tp_b + fp_b + fn_b, 0) AS diff FROM per)
        SELECT seq, CASE WHEN diff - 0.03 > 0 THEN 'better' WHEN diff + 0.03 < 0 THEN 'worse' WHEN diff - 0.03 > -0.02 THEN 'matches within margin'
               ELSE 'inconclusive' END AS verdict FROM x""",
)
def verdicts(spark, d):
    f1 = {s: E.prf_columns(*[F.col(f"{c}_{s}") for c in ("tp", "fp", "fn")])["f1"] for s in "ab"}
    diff = f1["a"] - f1["b"]
    return per_sequence(spark, d).select("seq", E.verdict(diff, diff - 0.03, diff + 0.03).alias("verdict"))


RATED = LB + """, rt AS (SELECT seq, unit, coalesce(list_min(a), 12) AS ra, coalesce(list_min(b), 12) AS rb FROM lb)"""
KAPPA = """SELECT count(*) AS n, round(avg(({rel})::INT), 6) AS observed,
   round((avg(({rel})::INT) - (SELECT sum(x.n * y.n) FROM (SELECT ra, count(*) AS n FROM rt GROUP BY ra) x, (SELECT rb, count(*) AS n FROM rt GROUP BY rb) y WHERE {rel}) / count(*) / count(*))
     / (1 - (SELECT sum(x.n * y.n) FROM (SELECT ra, count(*) AS n FROM rt GROUP BY ra) x, (SELECT rb, count(*) AS n FROM rt GROUP BY rb) y WHERE {rel}) / count(*) / count(*)), 6) AS kappa FROM rt"""


def rated(spark, d):
    return labelled(spark, d).select("seq", "unit", S.state_of("a", 12).alias("a"), S.state_of("b", 12).alias("b"))


def catalogue(spark):
    return spark.range(13).select(F.col("id").cast("int").alias("x"))


@query("kappa_strict", f"WITH {RATED} " + KAPPA.format(rel="ra = rb"))
def kappa_strict(spark, d):
    return rounded(E.kappa(rated(spark, d), E.relation_equal(catalogue(spark))), "observed", "kappa")


@query("kappa_near", f"WITH {RATED} " + KAPPA.format(rel="(ra = rb OR (ra <> 12 AND rb <> 12 AND abs(ra - rb) <= 1))"))
def kappa_near(spark, d):
    return rounded(E.kappa(rated(spark, d), E.relation_near(catalogue(spark), 1, 12)), "observed", "kappa")


@query("kappa_theme", f"WITH {RATED} " + KAPPA.format(rel="(ra = rb OR (ra <> 12 AND rb <> 12 AND ra // 3 = rb // 3))"))
def kappa_theme(spark, d):
    theme = F.when(F.col("x") != 12, F.floor(F.col("x") / 3))
    return rounded(E.kappa(rated(spark, d), E.relation_grouped(catalogue(spark), theme)), "observed", "kappa")


@query(
    "kappa_quality_toxic",
    """WITH rt AS (SELECT quality AS ra, 1 - toxic AS rb FROM labels) """ + KAPPA.format(rel="ra = rb"),
)
def kappa_quality_toxic(spark, d):
    pairs = table(spark, d, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return rounded(E.kappa(pairs, E.relation_equal(spark.range(2).select(F.col("id").cast("int").alias("x")))), "observed", "kappa")


@query(
    "confusion",
    f"WITH {RATED} SELECT ra AS a, " + ", ".join(f'count(*) FILTER (WHERE rb = {v}) AS "{v}"' for v in range(13)) + " FROM rt GROUP BY ra",
)
def confusion(spark, d):
    return E.confusion(rated(spark, d), range(13))


@query(
    "disagreements",
    f"""WITH {RATED}, d AS (SELECT unit, ra, rb, least(ra, rb) AS lo, greatest(ra, rb) AS hi FROM rt WHERE ra <> rb)
        SELECT unit, ra AS a, rb AS b, abs(ra - rb) AS apart, count(*) OVER (PARTITION BY lo, hi) AS n_alike FROM d""",
)
def disagreements(spark, d):
    return E.disagreements(rated(spark, d), ["unit"], range(13))


@query(
    "set_overlap",
    f"""WITH {LB} SELECT seq, count(*) AS items, count(*) FILTER (WHERE list_sort(list_distinct(a)) = list_sort(list_distinct(b))) AS identical,
          count(*) FILTER (WHERE list_has_any(a, b)) AS overlapping FROM lb WHERE len(a) > 0 AND len(b) > 0 GROUP BY seq""",
)
def set_overlap(spark, d):
    return E.set_overlap(labelled(spark, d), "a", "b", ["seq"])


CAUSES = CARRIED + """, x AS (SELECT seq, unit, gold, anchors, active AS pred FROM act),
   fp AS (SELECT x.*, unnest(pred) AS l FROM x), fn AS (SELECT x.*, unnest(gold) AS l FROM x),
   c AS (SELECT CASE WHEN list_contains(anchors, l) THEN 'wrong anchor' WHEN len(gold) = 0 THEN 'carried into empty' ELSE 'carried past a switch' END AS cause
         FROM fp WHERE NOT list_contains(gold, l)
         UNION ALL SELECT CASE WHEN len(pred) = 0 THEN 'none yet' WHEN list_has_any(pred, gold) THEN 'extra' ELSE 'stale' END FROM fn WHERE NOT list_contains(pred, l))"""


@query("error_causes", f"WITH {CAUSES} SELECT cause, count(*) AS n FROM c GROUP BY cause")
def error_causes(spark, d):
    return E.error_causes(S.carry(events(spark, d)), pred="held")


RELATION = """CASE WHEN len(gold) = 0 AND len({p}) = 0 THEN 'both empty' WHEN len(gold) = 0 THEN 'invented' WHEN len({p}) = 0 THEN 'silent'
   WHEN NOT list_has_any(gold, {p}) THEN CASE len(list_filter({p}, lambda x: list_contains(gold, x - 1) OR list_contains(gold, x + 1)))
     WHEN 0 THEN 'apart' WHEN len({p}) THEN 'beside' ELSE 'partly beside' END
   WHEN list_has_all(gold, {p}) AND list_has_all({p}, gold) THEN 'equal' WHEN list_has_all({p}, gold) THEN 'wider' WHEN list_has_all(gold, {p}) THEN 'narrower'
   ELSE 'crossing' END"""
CALLED = """calls(name, coarse, hit, fine) AS (VALUES ('both empty', 'right', 'rest', 'right'), ('equal', 'right', 'found', 'right'), ('invented', 'invented', 'invented', 'invented'),
   ('silent', 'silent', 'silent', 'silent'), ('wider', 'shared', 'found', 'too many'), ('narrower', 'shared', 'found', 'too few'), ('crossing', 'shared', 'found', 'shared'),
   ('beside', 'neighbour', 'near', 'neighbour'), ('partly beside', 'apart', 'near', 'neighbour'), ('apart', 'apart', 'apart', 'apart'))"""


@query(
    "outcomes",
    f"WITH {LB}, {CALLED} SELECT unit, coarse, hit, fine FROM lb JOIN calls ON name = {RELATION.format(p='a')}",
)
def outcomes(spark, d):
    return labelled(spark, d).select(
        "unit",
        E.outcome_coarse("gold", "a").alias("coarse"),
        E.outcome_hit("gold", "a").alias("hit"),
        E.outcome_fine("gold", "a").alias("fine"),
    )


@query(
    "outcome_transitions",
    f"""WITH {LB}, {CALLED} SELECT x.fine AS from_outcome, y.fine AS to_outcome, count(*) AS n
        FROM lb JOIN calls x ON x.name = {RELATION.format(p='a')} JOIN calls y ON y.name = {RELATION.format(p='b')} GROUP BY 1, 2""",
)
def outcome_transitions(spark, d):
    return E.outcome_transitions(labelled(spark, d), "a", "b")


@query(
    "outcome_changes",
    f"""WITH {LB} SELECT seq, CASE WHEN list_sort(gold) = list_sort(a) AND list_sort(gold) = list_sort(b) THEN 'both right' WHEN list_sort(gold) = list_sort(a) THEN 'only a right'
          WHEN list_sort(gold) = list_sort(b) THEN 'only b right' ELSE 'both wrong' END AS change, count(*) AS n FROM lb GROUP BY 1, 2""",
)
def outcome_changes(spark, d):
    return labelled(spark, d).groupBy("seq", E.change("a", "b").alias("change")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f1_without_empty",
    f"""WITH {LB}, c AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ja),
        e AS (SELECT count(*) AS fp_empty FROM lb, unnest(a) WHERE len(gold) = 0)
        SELECT tp, fp, fn, fp_empty, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(2 * tp / (2 * tp + fp - fp_empty + fn), 6) AS f1_without_empty FROM c, e""",
)
def f1_without_empty(spark, d):
    return rounded(E.f1_without_empty(labelled(spark, d), pred="a"), "f1", "f1_without_empty")


@query(
    "pk_windowdiff",
    f"""WITH {EV}, p AS (SELECT event_id AS unit, {A_SQL} AS a FROM events),
        x AS (SELECT seq, pos, coalesce(list_min(gold), -1) AS r, coalesce(list_min(a), -1) AS h FROM ev JOIN p USING (unit)),
        b AS (SELECT *, (r <> lead(r) OVER w)::INT AS rb, (h <> lead(h) OVER w)::INT AS hb FROM x WINDOW w AS (PARTITION BY seq ORDER BY pos)),
        k AS (SELECT seq, count(*) AS n, greatest(1, round_even(count(*) / (2 * (sum(coalesce(rb, 0)) + 1)), 0))::BIGINT AS k FROM b GROUP BY seq),
        w AS (SELECT s.seq, s.pos, sum(e.rb) AS rs, sum(e.hb) AS hs FROM b s JOIN k ON k.seq = s.seq AND s.pos < k.n - k.k
              JOIN b e ON e.seq = s.seq AND e.pos BETWEEN s.pos AND s.pos + k.k - 1 GROUP BY ALL),
        t AS (SELECT count(*) FILTER (WHERE (rs = 0) <> (hs = 0)) AS pk_errors, count(*) FILTER (WHERE rs <> hs) AS wd_errors, count(*) AS windows FROM w)
        SELECT *, round(pk_errors / windows, 6) AS pk, round(wd_errors / windows, 6) AS windowdiff FROM t""",
)
def pk_windowdiff(spark, d):
    a = A_SPARK.replace("event_id", "unit").replace("user_id", "seq")
    items = events(spark, d).select("seq", "pos", S.state_of("gold", -1).alias("ref"), F.coalesce(F.array_min(F.expr(a)), F.lit(-1)).alias("hyp"))
    return rounded(E.pk_windowdiff(items), "pk", "windowdiff")


AUC = """r AS (SELECT *, rank() OVER (PARTITION BY part ORDER BY s) + (count(*) OVER (PARTITION BY part, s) - 1) / 2.0::DOUBLE AS rk,
            sum(y) OVER (PARTITION BY part ORDER BY s DESC) AS tp, count(*) OVER (PARTITION BY part ORDER BY s DESC) AS n FROM x)
   SELECT {part} round((sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc,
          round(avg(tp / n) FILTER (WHERE y = 1), 6) AS ap, sum(y)::BIGINT AS positives, (count(*) - sum(y))::BIGINT AS negatives FROM r {group}"""


@query(
    "auc_ap",
    "WITH x AS (SELECT 0 AS part, round(value, 0) AS s, (event_type = 'purchase')::INT AS y FROM events), " + AUC.format(part="", group=""),
)
def auc_ap(spark, d):
    rows = table(spark, d, "events").select(F.round("value", 0).alias("score"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    return rounded(E.auc_ap(rows), "auc", "ap")


@query(
    "auc_by_source",
    """WITH x AS (SELECT source AS part, n_chars AS s, quality AS y FROM labels JOIN documents USING (doc_id)), """
    + AUC.format(part="part,", group="GROUP BY part HAVING sum(y) > 0 AND sum(y) < count(*)"),
)
def auc_by_source(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    rows = rows.select(F.col("source").alias("part"), F.col("n_chars").alias("score"), F.col("quality").alias("y"))
    return rounded(E.auc_ap(rows, by=["part"]).filter("positives > 0 AND negatives > 0"), "auc", "ap")


@query(
    "soft_log_loss",
    """SELECT event_type, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS loss FROM (
         SELECT event_type, least(1 - 1e-6, greatest(1e-6, value / 50)) AS p, (event_id % 5) / 4 AS y FROM events) GROUP BY event_type""",
)
def soft_log_loss(spark, d):
    loss = E.log_loss(F.col("value") / 50, F.col("event_id") % 5 / 4)
    return table(spark, d, "events").groupBy("event_type").agg(F.round(loss, 6).alias("loss"))


ANSWERS_SQL = """an AS (SELECT o_orderkey, o_orderpriority AS mode, [(o_orderkey * 7) % 20, (o_orderkey * 7 + 3) % 20, (o_orderkey + 11) % 20 + 20, (o_orderkey + 5) % 20 + 40, (o_custkey) % 20 + 60] AS retrieved,
    CASE WHEN o_orderkey % 6 = 0 THEN []::BIGINT[] ELSE [o_custkey % 20, o_custkey % 20 + 60, o_custkey % 7 + 20] END AS relevant, o_orderkey % 4 = 0 AS abstained FROM orders)"""


def answers(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("mode"),
        F.expr("array((o_orderkey * 7) % 20, (o_orderkey * 7 + 3) % 20, (o_orderkey + 11) % 20 + 20, (o_orderkey + 5) % 20 + 40, o_custkey % 20 + 60)").alias("retrieved"),
        F.expr("CASE WHEN o_orderkey % 6 = 0 THEN cast(array() AS array<bigint>) ELSE array(o_custkey % 20, o_custkey % 20 + 60, o_custkey % 7 + 20) END").alias("relevant"),
        (F.col("o_orderkey") % 4 == 0).alias("abstained"),
    )


@query(
    "hit_at_k",
    f"""WITH {ANSWERS_SQL}, s AS (SELECT mode, len(list_intersect(retrieved, relevant)) AS r, len(relevant) AS n FROM an WHERE len(relevant) > 0)
        SELECT mode, count(*) AS queries, round(avg((r > 0)::INT), 6) AS hit, round(avg(r / 5), 6) AS precision, round(avg(r / n), 6) AS recall FROM s GROUP BY ROLLUP (mode)""",
)
def hit_at_k(spark, d):
    return rounded(E.hit_p_r_at_k(answers(spark, d)), "hit", "precision", "recall")


@query(
    "label_hits",
    f"""WITH {ANSWERS_SQL} SELECT mode, count(*) AS queries, round(avg(list_has_any(retrieved[1:1], relevant)::INT) FILTER (WHERE len(relevant) > 0), 6) AS hit1,
          round(avg(list_has_any(retrieved[1:3], relevant)::INT) FILTER (WHERE len(relevant) > 0), 6) AS hit3,
          round(avg(abstained::INT) FILTER (WHERE len(relevant) = 0), 6) AS abstained, round(avg(abstained::INT) FILTER (WHERE len(relevant) > 0), 6) AS wrongly_abstained
        FROM an GROUP BY ROLLUP (mode)""",
)
def label_hits(spark, d):
    a = answers(spark, d).withColumnsRenamed({"retrieved": "ranked", "relevant": "expected"})
    return rounded(E.label_hits(a), "hit1", "hit3", "abstained", "wrongly_abstained")


@query(
    "claim_precision",
    f"""WITH {LB}, h AS (SELECT (unit % 12)::INT AS label, coalesce(list_min(a), 12) AS prim, b, gold FROM lb),
        k AS (SELECT CASE WHEN prim = label THEN 'primary' WHEN list_contains(b, label) THEN 'passing' END AS kind, list_contains(gold, label)::INT AS ok FROM h)
        SELECT kind, sum(ok)::BIGINT AS "right", count(*) AS n, round(sum(ok) / count(*), 6) AS precision FROM k WHERE kind IS NOT NULL GROUP BY kind""",
)
def claim_precision(spark, d):
    hits = labelled(spark, d).select(
        (F.col("unit") % 12).cast("int").alias("label"), S.state_of("a", 12).alias("primary"), F.col("b").alias("secondary"), "gold"
    )
    return rounded(E.claim_precision(hits), "precision")


# ---- annotation logs on orders: customers are items, priorities are annotators ------------

LOG_LABEL = "CASE WHEN o_orderstatus = 'P' THEN 'NONE' WHEN o_orderkey % 11 = 0 AND {reset} THEN 'RESET' ELSE 'BG 2.' || (o_orderkey % 5 + 1) END"
LOG_TIER = "CASE WHEN o_orderkey % 17 = 0 THEN 'x9' ELSE 't' || (1 + o_orderkey % 5) END"


def log(spark, d, reset=False):
    return table(spark, d, "orders").selectExpr(
        "o_custkey AS item", "o_orderpriority AS annotator", LOG_LABEL.format(reset=str(reset).lower()) + " AS label",
        LOG_TIER + " AS tier", "o_orderdate AS created_at", "o_orderkey AS row_no",
    )


LOG = f"""lg AS (SELECT o_custkey AS item, o_orderpriority AS annotator, {LOG_LABEL.format(reset='false')} AS label, {LOG_TIER} AS tier, o_orderdate AS created_at, o_orderkey AS row_no FROM orders)"""


def view_sql(source, name):
    return f"""{name}_n AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY item, annotator, label ORDER BY created_at DESC, row_no) = 1),
   {name}_t AS (SELECT *, max(created_at) FILTER (WHERE label = 'NONE') OVER (PARTITION BY item, annotator) AS nn, max(created_at) FILTER (WHERE label <> 'NONE') OVER (PARTITION BY item, annotator) AS nr FROM {name}_n),
   {name} AS (SELECT item, annotator, label, tier, created_at, row_no FROM {name}_t WHERE nn IS NULL OR nr IS NULL OR (label = 'NONE') = (nn > nr))"""


def gold_sql(view, name):
    return f"""{name}_b AS (SELECT item, label, upper(trim(tier)) AS tier FROM {view} WHERE label NOT IN ('', 'NONE')
     QUALIFY row_number() OVER (PARTITION BY item, label ORDER BY CASE WHEN upper(tier) IN ('T1', 'T2', 'T3', 'T4', 'T5') THEN substr(tier, 2)::INT - 1 ELSE 9 END, created_at, row_no) = 1),
   {name}_l AS (SELECT item, string_agg(label || ':' || tier, ';' ORDER BY label) AS labels FROM {name}_b GROUP BY item),
   {name} AS (SELECT DISTINCT v.item, coalesce(l.labels, '') AS labels FROM {view} v LEFT JOIN {name}_l l ON l.item = v.item)"""


def label_text(column="labels"):
    return F.array_join(F.transform(column, lambda x: F.concat(x["label"], F.lit(":"), x["tier"])), ";").alias("labels")


@query("latest_view", f"WITH {LOG}, {view_sql('lg', 'vw')} SELECT * FROM vw")
def latest_view(spark, d):
    return A.latest_view(log(spark, d))


@query("gold_view", f"WITH {LOG}, {view_sql('lg', 'vw')}, {gold_sql('vw', 'gd')} SELECT item, labels FROM gd")
def gold_view(spark, d):
    return A.gold(A.latest_view(log(spark, d))).select("item", label_text())


@query("malformed_tiers", f"WITH {LOG}, {view_sql('lg', 'vw')} SELECT item, annotator, label, tier FROM vw WHERE label <> 'NONE' AND tier = 'x9'")
def malformed_tiers(spark, d):
    return A.malformed_tiers(A.latest_view(log(spark, d))).select("item", "annotator", "label", "tier")


@query(
    "adjudicate",
    f"""WITH {LOG}, {view_sql('lg', 'vw')}, {gold_sql('vw', 'gd')},
        ex AS (SELECT o_custkey AS item, 'expert' AS annotator, {LOG_LABEL.format(reset='true')} AS label, {LOG_TIER} AS tier, o_orderdate AS created_at, o_orderkey AS row_no FROM orders WHERE o_orderpriority = '1-URGENT'),
        rs AS (SELECT item, max(created_at) AS reset_at FROM ex WHERE label = 'RESET' GROUP BY item),
        ar AS (SELECT ex.* FROM ex LEFT JOIN rs USING (item) WHERE label <> 'RESET' AND (reset_at IS NULL OR created_at > reset_at)),
        {view_sql('ar', 'av')}, {gold_sql('av', 'ag')}
        SELECT gd.item, coalesce(ag.labels, gd.labels) AS labels, ag.item IS NOT NULL AS adjudicated FROM gd LEFT JOIN ag USING (item)""",
)
def adjudicate(spark, d):
    expert = log(spark, d, reset=True).filter("annotator = '1-URGENT'").withColumn("annotator", F.lit("expert"))
    out = A.adjudicate(A.gold(A.latest_view(log(spark, d))), expert)
    return out.select("item", label_text(), "adjudicated")


MERGE_KEY = ["item", "annotator", "label", "created_at"]


def two_logs(spark, d):
    rows = log(spark, d)
    return rows.filter("row_no % 3 <> 0"), rows.filter("row_no % 3 = 0 OR row_no % 4 = 0")


TWO_LOGS = LOG + """, m AS (SELECT * FROM lg WHERE row_no % 3 <> 0), nw AS (SELECT * FROM lg WHERE row_no % 3 = 0 OR row_no % 4 = 0),
   ad AS (SELECT DISTINCT item, annotator, label, created_at FROM nw n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.item = n.item AND m.annotator = n.annotator
          AND m.label = n.label AND m.created_at = n.created_at))"""


@query("merge_logs", f"WITH {TWO_LOGS} SELECT item, annotator, label, created_at FROM ad")
def merge_logs(spark, d):
    return A.merge_logs(*two_logs(spark, d), MERGE_KEY).select(*MERGE_KEY)


@query(
    "merge_report",
    f"""WITH {TWO_LOGS}, c AS (SELECT item, annotator FROM m UNION SELECT item, annotator FROM ad), s AS (SELECT item FROM c GROUP BY item HAVING count(*) > 1)
        SELECT (SELECT count(*) FROM nw) AS offered, (SELECT count(*) FROM ad) AS added, (SELECT count(*) FROM s) AS shared_items,
               (SELECT count(*) FROM nw) - (SELECT count(*) FROM ad) AS duplicates""",
)
def merge_report(spark, d):
    return A.merge_report(*two_logs(spark, d), MERGE_KEY)


@query(
    "coverage_report",
    f"""WITH {LOG}, {view_sql('lg', 'vw')}, pi AS (SELECT item, count(*) FILTER (WHERE label NOT IN ('', 'NONE')) AS mentions FROM vw GROUP BY item)
        SELECT c_nationkey AS seq, count(*) AS items, count(mentions) AS reviewed, coalesce(sum(mentions), 0)::BIGINT AS mentions, count(mentions) >= count(*) AS complete
        FROM customer LEFT JOIN pi ON pi.item = c_custkey GROUP BY c_nationkey""",
)
def coverage_report(spark, d):
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.col("c_nationkey").alias("seq"))
    return E.coverage_report(items, A.latest_view(log(spark, d)))


@query(
    "mention_projection",
    f"""WITH {LOG}, {view_sql('lg', 'vw')}, pi AS (SELECT item, count(*) FILTER (WHERE label NOT IN ('', 'NONE')) AS mentions FROM vw GROUP BY item),
        r AS (SELECT c_custkey % 400 AS seq, count(*) AS items, count(mentions) AS reviewed, coalesce(sum(mentions), 0) AS mentions FROM customer LEFT JOIN pi ON pi.item = c_custkey GROUP BY 1)
        SELECT count(*) AS done, round(avg(mentions), 6) AS per_sequence, round(avg(mentions) * 1000, 6) AS projected FROM r WHERE reviewed >= items""",
)
def mention_projection(spark, d):
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("item"), (F.col("c_custkey") % 400).alias("seq"))
    out = E.projection(E.coverage_report(items, A.latest_view(log(spark, d))), 1000)
    return rounded(out, "per_sequence", "projected")


@query(
    "tier_distribution",
    f"""WITH {LOG}, {view_sql('lg', 'vw')} SELECT tier, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM vw
        WHERE label NOT IN ('', 'NONE') GROUP BY tier""",
)
def tier_distribution(spark, d):
    return rounded(E.tier_distribution(A.latest_view(log(spark, d))), "share")


@query(
    "second_pass_kappa",
    f"""WITH f AS (SELECT c_custkey AS item, c_mktsegment AS who, c_nationkey % 4 AS a FROM customer),
        s AS (SELECT o_custkey AS item, max_by(o_orderpriority, o_orderkey) AS annotator, (max(o_orderkey) % 4)::INT AS b FROM orders GROUP BY o_custkey),
        rt AS (SELECT a AS ra, b AS rb FROM f JOIN s USING (item) WHERE who <> CASE WHEN annotator = '5-LOW' THEN 'HOUSEHOLD' ELSE annotator END) """
    + KAPPA.format(rel="ra = rb"),
)
def second_pass_kappa(spark, d):
    first = table(spark, d, "customer").selectExpr("c_custkey AS item", "c_mktsegment AS annotator", "c_nationkey % 4 AS label")
    second = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("item")).agg(
        F.max_by("o_orderpriority", "o_orderkey").alias("annotator"), (F.max("o_orderkey") % 4).cast("int").alias("label")
    )
    second = second.withColumn("annotator", F.when(F.col("annotator") == "5-LOW", "HOUSEHOLD").otherwise(F.col("annotator")))
    relation = E.relation_equal(spark.range(4).select(F.col("id").cast("int").alias("x")))
    return rounded(E.kappa(E.second_pass_pairs(first, second), relation), "observed", "kappa")


H31 = "(('0x' || substr(md5('{seed}-' || {key}), 1, 8))::BIGINT % 2147483648)"


@query(
    "deal_folds",
    f"""WITH h AS (SELECT c_custkey AS seq, c_mktsegment AS stratum, {H31.format(seed='7', key='c_custkey')} AS h FROM customer),
        r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, seq) - 1 AS r FROM h),
        s AS (SELECT stratum, coalesce(sum(n) OVER (ORDER BY n DESC, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM (SELECT stratum, count(*) AS n FROM h GROUP BY stratum))
        SELECT seq, stratum, ((st + r) % 5)::INT AS fold, ((st + r + 1) % 5)::INT AS calibration FROM r JOIN s USING (stratum)""",
)
def deal_folds(spark, d):
    groups = table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_mktsegment").alias("stratum"))
    return E.deal_folds(groups, 5, seed="7")


SAMPLE_SIZES = {"1-URGENT": 30, "2-HIGH": 50, "5-LOW": 20}
SAMPLE_SQL = """sp AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('3-' || o_orderkey), o_orderkey) AS rank
   FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
   ss AS (SELECT * FROM sp WHERE rank <= CASE o_orderpriority WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 50 WHEN '5-LOW' THEN 20 ELSE 0 END)"""


def sample(spark, d):
    exclude = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return E.stratified_sample(orders, SAMPLE_SIZES, "o_orderpriority", "o_orderkey", exclude, "3")


@query("stratified_sample", f"WITH {SAMPLE_SQL} SELECT * FROM ss")
def stratified_sample(spark, d):
    return sample(spark, d)


@query(
    "second_raters",
    f"""WITH {SAMPLE_SQL}, f AS (SELECT *, ['ann', 'bob', 'cy'][(o_orderkey % 3 + 1)::INT] AS first_annotator FROM ss)
        SELECT o_orderkey, first_annotator, list_filter(['ann', 'bob', 'cy'], lambda x: x <> first_annotator)[((rank - 1) % 2 + 1)::INT] AS second_annotator FROM f""",
)
def second_raters(spark, d):
    first = F.element_at(F.array(*map(F.lit, ("ann", "bob", "cy"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    out = E.second_raters(sample(spark, d).withColumn("first_annotator", first), ["bob", "ann", "cy"])
    return out.select("o_orderkey", "first_annotator", "second_annotator")


@query(
    "cost_shares",
    """WITH u AS (SELECT l_returnflag AS system, sum(l_quantity) AS ti, sum(l_linenumber) AS tout FROM lineitem GROUP BY 1),
       i AS (SELECT l_returnflag AS system, l_suppkey AS seq, count(*) AS n FROM lineitem GROUP BY 1, 2)
       SELECT system, seq, round((ti / 1e6 * 0.25 + tout / 1e6 * 2) * n / sum(n) OVER (PARTITION BY system), 9) AS cost FROM i JOIN u USING (system)""",
)
def cost_shares(spark, d):
    li = table(spark, d, "lineitem").withColumnsRenamed({"l_returnflag": "system", "l_suppkey": "seq"})
    usage = li.groupBy("system").agg(
        F.sum("l_quantity").alias("tokens_in"), F.sum("l_linenumber").alias("tokens_out"),
        F.lit(0.25).alias("price_in"), F.lit(2.0).alias("price_out"),
    )
    items = li.groupBy("system", "seq").agg(F.count(F.lit(1)).alias("n"))
    return rounded(E.cost_shares(usage, items), "cost", places=9)


VERDICT = "CASE l_returnflag WHEN 'N' THEN 'supported' WHEN 'A' THEN 'partial' ELSE 'unsupported' END"
GROUNDED = f"""v AS (SELECT l_orderkey AS answer, l_orderkey % 4 AS kind, {VERDICT} AS verdict FROM lineitem),
   a AS (SELECT kind, answer, avg(CASE verdict WHEN 'supported' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0 END) AS groundedness, count(*) AS claims,
              count(*) FILTER (WHERE verdict = 'unsupported') AS unsupported FROM v GROUP BY 1, 2)"""


def grounded(spark, d):
    v = table(spark, d, "lineitem").selectExpr("l_orderkey AS answer", "l_orderkey % 4 AS kind", VERDICT + " AS verdict")
    return E.groundedness(v)


@query("groundedness", f"WITH {GROUNDED} SELECT kind, answer, round(groundedness, 6) AS groundedness, claims, unsupported FROM a")
def groundedness(spark, d):
    return rounded(grounded(spark, d), "groundedness")


@query(
    "groundedness_by_kind",
    f"""WITH {GROUNDED} SELECT kind, count(*) AS answers, round(avg(groundedness), 6) AS groundedness, count(*) FILTER (WHERE groundedness = 1) AS fully_grounded,
          count(*) FILTER (WHERE unsupported > 0) AS with_unsupported FROM a GROUP BY kind""",
)
def groundedness_by_kind(spark, d):
    return rounded(E.groundedness_by_kind(grounded(spark, d)), "groundedness")


SETS = LB + """, sg AS (SELECT DISTINCT seq, l FROM g), sp AS (SELECT DISTINCT seq, l FROM pa),
   sj AS (SELECT coalesce(sg.seq, sp.seq) AS seq, (sg.l IS NOT NULL AND sp.l IS NOT NULL)::INT AS tp, (sg.l IS NULL)::INT AS fp, (sp.l IS NULL)::INT AS fn FROM sg FULL JOIN sp ON sg.seq = sp.seq AND sg.l = sp.l),
   sc AS (SELECT seq, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM sj GROUP BY seq)"""


@query("sequence_sets", f"WITH {SETS} SELECT * FROM sc")
def sequence_sets(spark, d):
    return E.sequence_sets(labelled(spark, d), pred="a")


@query(
    "micro_macro",
    f"""WITH {SETS}, m AS (SELECT sum(tp) AS t, sum(fp) AS p, sum(fn) AS n FROM sc)
        SELECT round(t / (t + p), 6) AS micro_precision, round(t / (t + n), 6) AS micro_recall, round(2 * t / (2 * t + p + n), 6) AS micro_f1,
          (SELECT round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 6) FROM sc) AS macro_precision, (SELECT round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 6) FROM sc) AS macro_recall,
          (SELECT round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) FROM sc) AS macro_f1 FROM m""",
)
def micro_macro(spark, d):
    out = E.micro_macro(E.sequence_sets(labelled(spark, d), pred="a"))
    return rounded(out, *out.columns)


@query(
    "teacher_stats",
    """WITH x AS (SELECT source, quality AS y, toxic AS f, n_chars AS s FROM labels JOIN documents USING (doc_id)),
       r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY s) + (count(*) OVER (PARTITION BY source, s) - 1) / 2.0::DOUBLE AS rk FROM x),
       c AS (SELECT source, count(*) AS n, sum(y)::BIGINT AS n_off, sum(f) AS nf, avg((y = f)::INT) AS acc, avg(f) FILTER (WHERE y = 1) AS rec, avg(f) FILTER (WHERE y = 0) AS ff,
              CASE WHEN sum(y) * (count(*) - sum(y)) = 0 THEN 0 ELSE (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) END AS auc FROM r GROUP BY source),
       k AS (SELECT *, (n_off * nf + (n - n_off) * (n - nf)) / (n * n) AS pe FROM c)
       SELECT source, n, n_off, round(acc, 6) AS accuracy, round(rec, 6) AS recall, round(ff, 6) AS false_flags,
              CASE WHEN pe < 1 THEN round((acc - pe) / (1 - pe), 6) END AS kappa, round(auc, 6) AS auc FROM k""",
)
def teacher_stats(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    rows = rows.withColumnsRenamed({"quality": "y", "toxic": "flag", "n_chars": "score"})
    return rounded(E.teacher_stats(rows, ["source"]), "accuracy", "recall", "false_flags", "kappa", "auc")


@query(
    "unseen_label_score",
    f"""WITH {LB}, u AS (SELECT DISTINCT unit FROM g WHERE l > 8), n AS (SELECT count(*) AS items, count(*) FILTER (WHERE len(a) > 0) AS fired FROM lb WHERE unit IN (SELECT unit FROM u)),
        j AS (SELECT (x.l IS NOT NULL AND p.l IS NOT NULL)::INT AS tp, (x.l IS NULL)::INT AS fp, (p.l IS NULL)::INT AS fn
              FROM (SELECT * FROM g WHERE unit IN (SELECT unit FROM u)) x FULL JOIN (SELECT * FROM pa WHERE unit IN (SELECT unit FROM u)) p ON x.unit = p.unit AND x.l = p.l),
        c AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM j)
        SELECT tp, fp, fn, items, fired, {prf_sql()} FROM c, n""",
)
def unseen_label_score(spark, d):
    return rounded(E.unseen_label_score(labelled(spark, d), 8, pred="a"), *P3)


@query(
    "off_report",
    f"""WITH {LB}, x AS (SELECT event_type AS grp, gold, CASE WHEN unit % 10 = 0 THEN NULL ELSE a END AS p, unit % 20 <> 0 AS came, (unit % 100) / 1000 AS cost FROM lb)
        SELECT grp, count(*) FILTER (WHERE len(gold) = 0) AS empty_items, count(*) FILTER (WHERE len(gold) = 0 AND len(p) > 0) AS false_labels,
          count(*) FILTER (WHERE len(gold) > 0) AS labelled_items, count(*) FILTER (WHERE len(gold) > 0 AND coalesce(len(p), 0) = 0) AS missed,
          count(*) FILTER (WHERE NOT came) AS missing_answers, count(*) FILTER (WHERE came AND p IS NULL) AS unparsed_answers, round(sum(cost), 6) AS cost
        FROM x GROUP BY ROLLUP (grp)""",
)
def off_report(spark, d):
    unit = F.col("unit")
    items = labelled(spark, d).select(
        F.col("event_type").alias("grp"), "gold", F.when(unit % 10 != 0, F.col("a")).alias("pred"), (unit % 20 != 0).alias("answered"), (unit % 100 / 1000).alias("cost")
    )
    return rounded(E.off_report(items, "grp"), "cost")
