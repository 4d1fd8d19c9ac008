"""Ensembles, thresholds and fitted scorers on the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.operators import decode as D
from passages.operators import ensemble as N
from passages.operators import evaluate as E
from passages.operators import learn as L
from passages.operators import sequence as S
from passages.plans.evaluation_queries import GOLD_SQL, LB, labelled, rounded
from passages.plans.registry import query, table
from passages.plans.sequence_queries import EV, N_LABELS, OFF, SCORES_SQL, STATES, events, scored, states

P_OFF = "((unit * 13) % 97 + 1) / CAST(99.0 AS DOUBLE)"
CONF = "((unit * 29) % 101) / CAST(100.0 AS DOUBLE)"


def systems(spark, d):
    rows = labelled(spark, d).withColumns(
        {"p_off": F.expr(P_OFF), "conf": F.expr(CONF), "language": F.col("seq") % 2}
    )
    return rows.withColumn("anchor", F.when(F.col("event_type") == "purchase", F.col("a")).otherwise(S.none_of()))


SY = LB + f""", sy AS (SELECT *, {P_OFF} AS p_off, {CONF} AS conf, seq % 2 AS language, CASE WHEN event_type = 'purchase' THEN a ELSE []::INT[] END AS anchor FROM lb),
   ok AS (SELECT *, list_sort(list_distinct(a)) = list_sort(list_distinct(gold)) AS oa, list_sort(list_distinct(b)) = list_sort(list_distinct(gold)) AS ob,
             list_sort(list_distinct(anchor)) = list_sort(list_distinct(gold)) AS oc, list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS ag FROM sy)"""


def layers():
    return [N.Layer("anchors", F.size("anchor") > 0, "anchor"), N.Layer("confident", F.col("conf") >= 0.9, "a")]


@query(
    "cascade",
    f"""WITH {SY} SELECT unit, CASE WHEN len(anchor) > 0 THEN 'anchors' WHEN conf >= 0.9 THEN 'confident' ELSE 'fallback' END AS layer,
          array_to_string(CASE WHEN len(anchor) > 0 THEN anchor WHEN conf >= 0.9 THEN a ELSE b END, ';') AS out FROM sy""",
)
def cascade(spark, d):
    out = N.override_cascade(systems(spark, d), layers(), "b")
    return out.select("unit", "layer", F.array_join("out", ";").alias("out"))


def strict_sql(p):
    return f"""sum(len(list_intersect(gold, {p}))) AS tp, sum(len(list_filter({p}, lambda x: NOT list_contains(gold, x)))) AS fp,
          sum(len(list_filter(gold, lambda x: NOT list_contains({p}, x)))) AS fn"""


@query(
    "layer_report",
    f"""WITH {SY}, r AS (SELECT language, CASE WHEN len(anchor) > 0 THEN 'anchors' WHEN conf >= 0.9 THEN 'confident' ELSE 'fallback' END AS layer, CASE WHEN len(gold) = 0 THEN 'OFF' ELSE 'T' || (1 + unit % 5) END AS tier,
             CASE WHEN len(anchor) > 0 THEN oc WHEN conf >= 0.9 THEN oa ELSE ob END AS r, ob, gold, b, CASE WHEN len(anchor) > 0 THEN anchor WHEN conf >= 0.9 THEN a ELSE b END AS p FROM ok),
        c AS (SELECT language, layer, tier, grouping(layer)::INT AS all_layers, grouping(tier)::INT AS all_tiers, count(*) AS accepted, count(*) FILTER (WHERE r) AS "right", count(*) FILTER (WHERE ob) AS fallback_right,
             {strict_sql('p')}, {strict_sql('b').replace('AS tp', 'AS btp').replace('AS fp', 'AS bfp').replace('AS fn', 'AS bfn')} FROM r GROUP BY GROUPING SETS ((language, layer, tier), (language, layer), (language, tier), (language))),
        w AS (SELECT language, accepted AS n FROM c WHERE all_layers = 1 AND all_tiers = 1)
        SELECT language, layer, tier, all_layers, all_tiers, accepted, round(accepted / n, 6) AS share, "right", fallback_right,
          round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(2 * btp / nullif(2 * btp + bfp + bfn, 0), 0), 6) AS fallback_f1 FROM c JOIN w USING (language)""",
)
def layer_report(spark, d):
    out = N.override_cascade(systems(spark, d), layers(), "b")
    tier = F.when(F.size("gold") == 0, "OFF").otherwise(F.get("tiers", F.lit(0))["tier"])
    rows = E.layer_report(out.withColumn("tier", tier), fallback="b", by=["language"])
    return rows.withColumns({c: F.round(c, 6) for c in ("share", "f1", "fallback_f1")})


KEEP = """SELECT {by} sum(oc::INT - ob::INT) FILTER (WHERE len(anchor) > 0) AS d1, sum(oa::INT - ob::INT) FILTER (WHERE conf >= 0.9) AS d2,
   sum(oa::INT - ob::INT) FILTER (WHERE conf >= 0.9 AND len(anchor) = 0) AS d21 FROM ok {group}"""


@query(
    "keep_rule",
    f"WITH {SY}, s AS ({KEEP.format(by='language,', group='GROUP BY language')}) SELECT language, coalesce(d1, 0) >= 0 AS anchors, CASE WHEN coalesce(d1, 0) >= 0 THEN coalesce(d21, 0) >= 0 ELSE coalesce(d2, 0) >= 0 END AS confident FROM s",
)
def keep_rule(spark, d):
    return N.keep_rule(systems(spark, d), layers(), "b", by=["language"])


KEEP_CV = f"""{SY}, s AS ({KEEP.format(by='seq,', group='GROUP BY seq')}), t AS (SELECT sum(d1) AS t1, sum(d2) AS t2, sum(d21) AS t21 FROM s),
   kf AS (SELECT seq, t1 - coalesce(d1, 0) >= 0 AS anchors, CASE WHEN t1 - coalesce(d1, 0) >= 0 THEN t21 - coalesce(d21, 0) >= 0 ELSE t2 - coalesce(d2, 0) >= 0 END AS confident FROM s, t)"""


@query("keep_rule_cv", f"WITH {KEEP_CV} SELECT * FROM kf")
def keep_rule_cv(spark, d):
    return N.keep_rule_cv(systems(spark, d), layers(), "b", "seq")


@query("keep_rule_designs", f"WITH {KEEP_CV} SELECT anchors, confident, count(*) AS folds, count(*) / sum(count(*)) OVER () AS share FROM kf GROUP BY ALL")
def keep_rule_designs(spark, d):
    flags = N.keep_rule_cv(systems(spark, d), layers(), "b", "seq")
    return N.design_shares(flags, ["anchors", "confident"])


@query(
    "veto_fill",
    f"""WITH {SY} SELECT unit, CASE WHEN len(a) = 0 AND p_off >= 0.9 THEN 'veto' WHEN len(b) = 0 AND len(a) > 0 AND conf >= 0.5 THEN 'fill' ELSE 'external' END AS layer,
          array_to_string(CASE WHEN len(a) = 0 AND p_off >= 0.9 THEN []::INT[] WHEN len(b) = 0 AND len(a) > 0 AND conf >= 0.5 THEN a ELSE b END, ';') AS out FROM sy""",
)
def veto_fill(spark, d):
    out = systems(spark, d).withColumns(N.veto_fill("a", "b", "p_off", "conf", 0.9, 0.5))
    return out.select("unit", "layer", F.array_join("out", ";").alias("out"))


@query(
    "own_confidence",
    f"""WITH {EV}, x AS (SELECT seq, unit, gold, scores, {P_OFF} AS p_off FROM ev)
        SELECT unit, round(CASE WHEN len(gold) = 0 THEN p_off ELSE (1 - p_off) * scores[gold[1] + 1] / list_sum(scores) END, 6) AS conf FROM x""",
)
def own_confidence(spark, d):
    return scored(spark, d).select("unit", F.round(N.confidence("gold", "scores", "p_off"), 6).alias("conf"))


@query("hard_rule", f"WITH {SY} SELECT unit, array_to_string(CASE WHEN language = 1 AND len(a) > 0 AND len(b) > 0 THEN b ELSE a END, ';') AS out FROM sy")
def hard_rule(spark, d):
    out = N.hard_rule("a", "b", F.col("language") == 1)
    return systems(spark, d).select("unit", F.array_join(out, ";").alias("out"))


@query(
    "bonus_share",
    f"""WITH {EV}, w AS (SELECT unit, list_transform(range(12), lambda i: scores[i + 1] * CASE WHEN list_contains(gold, i::INT) THEN exp(0.5) ELSE 1 END) AS s FROM ev)
        SELECT unit, round(list_sum(s), 6) AS total, round(list_max(s), 6) AS top FROM w""",
)
def bonus_share(spark, d):
    s = N.bonus_share("scores", "gold", 0.5)
    rows = events(spark, d).withColumn("s", s)
    total = F.aggregate("s", F.lit(0.0), lambda x, y: x + y)
    return rows.select("unit", F.round(total, 6).alias("total"), F.round(F.array_max("s"), 6).alias("top"))


@query(
    "arbitration",
    f"""WITH {SY}, e AS (SELECT unit, len(list_filter(a, lambda x: NOT list_contains(gold, x))) + len(list_filter(gold, lambda x: NOT list_contains(a, x))) AS ea,
          len(list_filter(b, lambda x: NOT list_contains(gold, x))) + len(list_filter(gold, lambda x: NOT list_contains(b, x))) AS eb FROM sy)
        SELECT unit, CASE WHEN ea <= eb THEN 'a' ELSE 'b' END AS best FROM e""",
)
def arbitration(spark, d):
    return systems(spark, d).select("unit", N.oracle_arbitration(["a", "b"]).alias("best"))


@query(
    "self_consistency",
    f"""WITH {SY}
        SELECT ag AS agree, count(*) AS items, count(*) FILTER (WHERE oa) AS a_right, count(*) FILTER (WHERE ob) AS b_right, count(*) FILTER (WHERE oc) AS own_right,
               count(*) FILTER (WHERE CASE WHEN NOT ag AND conf >= 0.9 THEN oc ELSE oa END) AS rule_right, count(*) FILTER (WHERE conf >= 0.9) AS confident FROM ok GROUP BY ag""",
)
def self_consistency(spark, d):
    return N.self_consistency(systems(spark, d), "a", "b", "anchor", "conf")


@query(
    "disagreement_table",
    f"""WITH {SY} SELECT event_type, CASE WHEN len(a) = 0 THEN 'a none' WHEN len(b) = 0 THEN 'b none' ELSE 'both label' END AS kind, count(*) AS items,
          count(*) FILTER (WHERE oa) AS a_right, count(*) FILTER (WHERE ob) AS b_right, count(*) FILTER (WHERE NOT oa AND NOT ob) AS both_wrong
        FROM ok WHERE NOT ag GROUP BY CUBE (event_type, kind)""",
)
def disagreement_table(spark, d):
    return N.disagreement_table(systems(spark, d), "event_type", "a", "b")


@query(
    "adopt_per_language",
    f"""WITH {LB}, sa AS (SELECT seq, sum(tp) AS t, sum(fp) AS p, sum(fn) AS n FROM ja GROUP BY seq), sb AS (SELECT seq, sum(tp) AS t2, sum(fp) AS p2, sum(fn) AS n2 FROM jb GROUP BY seq),
        x AS (SELECT seq % 2 AS language, *, (coalesce(2 * t2 / nullif(2 * t2 + p2 + n2, 0), 0) < coalesce(2 * t / nullif(2 * t + p + n, 0), 0))::INT AS w FROM sa JOIN sb USING (seq)),
        y AS (SELECT language, 2 * sum(t) / (2 * sum(t) + sum(p) + sum(n)) AS fa, 2 * sum(t2) / (2 * sum(t2) + sum(p2) + sum(n2)) AS fb, sum(w)::BIGINT AS worse, count(*) AS sequences FROM x GROUP BY language)
        SELECT language, round(fa, 6) AS f1_a, round(fb, 6) AS f1_b, worse, sequences, fb >= fa AND worse <= sequences / 2 AS adopt FROM y""",
)
def adopt_per_language(spark, d):
    return rounded(N.adopt_per_language(systems(spark, d), "a", "b", "language", "seq"), "f1_a", "f1_b")


@query(
    "neutralise_weak",
    f"""WITH {SY} SELECT unit, round(CASE WHEN p_off > 0.5 AND unit % 5 + 1 < 5 THEN 0.5 ELSE p_off END, 6) AS p FROM sy""",
)
def neutralise_weak(spark, d):
    rows = systems(spark, d).withColumn("level", F.col("unit") % 5 + 1)
    return rows.select("unit", F.round(N.neutralise_weak("p_off", "level", F.col("p_off") > 0.5), 6).alias("p"))


# ---- thresholds ------------------------------------------------------------------------------

TAUS = [0.3, 0.5, 0.7, 0.9, 1.01]
STAT = f"""st AS (SELECT unit, gold, list_max(scores) AS stat, (list_position(scores, list_max(scores)) - 1)::INT AS label FROM ev)"""


def stat_rows(spark, d):
    rows = events(spark, d)
    return rows.select("unit", "gold", F.array_max("scores").alias("stat"), (F.array_position("scores", F.array_max("scores")) - 1).cast("int").alias("label"))


SWEPT = """SELECT t.tau, count(*) FILTER (WHERE stat >= t.tau AND list_contains(gold, label)) AS tp, count(*) FILTER (WHERE stat >= t.tau AND NOT list_contains(gold, label)) AS fp,
   sum(len(gold))::BIGINT - count(*) FILTER (WHERE stat >= t.tau AND list_contains(gold, label)) AS fn FROM st, {taus} t(tau) GROUP BY t.tau"""


@query(
    "threshold_sweep",
    f"""WITH {EV}, {STAT}, s AS ({SWEPT.format(taus='(VALUES ' + ', '.join(f'({t}::DOUBLE)' for t in TAUS) + ')')})
        SELECT tau, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
               round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM s""",
)
def threshold_sweep(spark, d):
    return rounded(L.sweep(stat_rows(spark, d), TAUS, "stat", "label"), "precision", "recall", "f1")


@query(
    "percentile_candidates",
    f"""WITH {EV}, {STAT}, q AS (SELECT unnest(quantile_cont(stat, list_transform(range(0, 100, 2), lambda i: i / 100))) AS tau FROM st), s AS ({SWEPT.format(taus='(SELECT DISTINCT tau FROM q)')})
        SELECT round(tau, 6) AS tau, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s""",
)
def percentile_candidates(spark, d):
    return rounded(L.percentile_candidates(stat_rows(spark, d), "stat", "label"), "tau", "f1")


@query(
    "best_threshold",
    f"""WITH {EV}, {STAT}, q AS (SELECT unnest(quantile_cont(stat, list_transform(range(0, 100, 2), lambda i: i / 100))) AS tau FROM st), s AS ({SWEPT.format(taus='(SELECT DISTINCT tau FROM q)')}),
        f AS (SELECT tau, 2 * tp / (2 * tp + fp + fn) AS f1 FROM s) SELECT round(tau, 6) AS tau, round(f1, 6) AS f1 FROM f ORDER BY f1 DESC, tau LIMIT 1""",
)
def best_threshold(spark, d):
    return rounded(L.best_threshold(L.percentile_candidates(stat_rows(spark, d), "stat", "label")), "tau", "f1")


def balanced_sql(signal, i):
    return f"""v{i} AS (SELECT {signal} AS v, sum(y) AS a, sum(1 - y) AS u FROM x GROUP BY 1),
   c{i} AS (SELECT (v + lead(v) OVER o) / 2 AS t, ((sum(a) OVER () - sum(a) OVER o) / sum(a) OVER () + sum(u) OVER o / sum(u) OVER ()) / 2 AS acc FROM v{i} WINDOW o AS (ORDER BY v)),
   k{i} AS (SELECT t, acc, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n FROM c{i} WHERE t IS NOT NULL AND acc >= (SELECT max(acc) FROM c{i} WHERE t IS NOT NULL) - 1e-12),
   m{i} AS (SELECT {i} AS i, '{signal}' AS signal, t, acc FROM k{i} WHERE pos = n // 2)"""


@query(
    "balanced_threshold",
    f"""WITH x AS (SELECT n_chars::DOUBLE AS n_chars, doc_id % 100 + quality * 20.0::DOUBLE AS mixed, quality AS y FROM labels JOIN documents USING (doc_id)),
        {balanced_sql('n_chars', 0)}, {balanced_sql('mixed', 1)}
        SELECT signal, round(t, 6) AS threshold, round(acc, 6) AS accuracy FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m1) ORDER BY round(acc, 12) DESC, i LIMIT 1""",
)
def balanced_threshold(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(
        F.col("n_chars").cast("double").alias("n_chars"), (F.col("doc_id") % 100 + F.col("quality") * 20.0).alias("mixed"), F.col("quality").alias("answerable")
    )
    return rounded(L.balanced_threshold(rows, ["n_chars", "mixed"]), "threshold", "accuracy")


@query(
    "training_pairs",
    f"""WITH {EV}, h AS (SELECT *, last_value(gold[1] IGNORE NULLS) OVER (PARTITION BY seq ORDER BY pos) AS held FROM ev),
        g AS (SELECT unit, gold, held, v::INT AS v, md5(unit || '-' || v) AS hsh, row_number() OVER (PARTITION BY unit ORDER BY scores[v + 1] DESC, v) AS rk FROM h, range(12) t(v)),
        f AS (SELECT *, CASE WHEN len(gold) > 0 THEN abs(v - gold[1]) IN (1, 2) OR rk <= 5 ELSE v IN (held, held + 1) END AS fixed FROM g WHERE NOT list_contains(gold, v)),
        s AS (SELECT unit, v, row_number() OVER (PARTITION BY unit ORDER BY hsh) AS o, len(gold) > 0 AS has FROM f WHERE NOT coalesce(fixed, false))
        SELECT unit, unnest(gold) AS label, 1 AS y FROM ev
        UNION ALL SELECT unit, v, 0 FROM f WHERE fixed UNION ALL SELECT unit, v, 0 FROM s WHERE o <= CASE WHEN has THEN 5 ELSE 8 END""",
)
def training_pairs(spark, d):
    return L.training_pairs(events(spark, d), N_LABELS).select("unit", "label", "y")


@query(
    "target_grid",
    f"""WITH g AS (SELECT event_id AS unit, {GOLD_SQL} AS gold FROM events) SELECT v::INT AS label, count(*) AS items, count(*) FILTER (WHERE list_contains(gold, v::INT)) AS positives FROM g, range(12) t(v) GROUP BY v""",
)
def target_grid(spark, d):
    grid = L.target_grid(labelled(spark, d), N_LABELS)
    return grid.groupBy("label").agg(F.count(F.lit(1)).alias("items"), F.sum("y").alias("positives"))


@query(
    "restricted_counts",
    f"""WITH {STATES}, ab AS (SELECT lag(state) OVER (PARTITION BY seq ORDER BY pos) AS a, state AS b FROM st), k AS (SELECT * FROM ab WHERE a IS NOT NULL AND (a < 7 OR a = 12) AND (b < 7 OR b = 12))
        SELECT count(*) FILTER (WHERE a <> 12 AND b = a) + 1 AS stay, count(*) FILTER (WHERE a <> 12 AND b <> 12 AND b - a IN (1, 2)) + 1 AS next,
          count(*) FILTER (WHERE a <> 12 AND b <> 12 AND b <> a AND b - a NOT IN (1, 2)) + 1 AS jump, count(*) FILTER (WHERE a <> 12 AND b = 12) + 1 AS to_off,
          count(*) FILTER (WHERE a = 12 AND b = 12) + 1 AS stay_off, count(*) FILTER (WHERE a = 12 AND b <> 12) + 1 AS from_off FROM k""",
)
def restricted_counts(spark, d):
    return L.restricted_counts(states(spark, d), 7, OFF)


# ---- fitted models (checked by rows and by tests) -----------------------------------------------


def fit_rows(spark, d):
    """One row per event: is it an error, from its value, place in the day and score."""
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("unit"), (F.col("user_id") % 3).alias("fold"), "value",
        F.hour("ts").cast("double").alias("hour"), F.length("props").cast("double").alias("width"),
        (F.col("event_type") == "error").cast("int").alias("y"),
    )
    hint = F.col("y") * 0.8 + F.col("unit") % 7 / 4
    return rows.withColumn("hint", hint).withColumn("p", F.least(F.lit(0.98), F.greatest(F.lit(0.02), F.col("y") * 0.6 + F.col("unit") % 5 / 12)))


COLUMNS = ["value", "hour", "width", "hint"]


@query("fit_scorer")
def fit_scorer(spark, d):
    rows = fit_rows(spark, d)
    model = L.fit_scorer(rows, COLUMNS)
    return rows.select("unit", F.round(model.probability(), 6).alias("p"))


@query("leave_one_group_out")
def leave_one_group_out(spark, d):
    out = L.leave_one_group_out(fit_rows(spark, d).drop("p"), "fold", COLUMNS)
    return out.select("unit", "fold", F.round("p", 6).alias("p"))


@query("soft_label_fit")
def soft_label_fit(spark, d):
    rows = fit_rows(spark, d)
    model = L.soft_label_fit(rows, ["value", "hint"])
    return rows.select("unit", F.round(model.probability(), 6).alias("p"))


@query("choose_c")
def choose_c(spark, d):
    return rounded(L.choose_c(fit_rows(spark, d), ["value", "hint"], "p", "fold", [1e-5, 1e-4, 1e-3, 1e-2, 0.1, 1.0])[1], "loss")


@query("out_of_fold")
def out_of_fold(spark, d):
    out = L.out_of_fold(fit_rows(spark, d).drop("y"), ["value", "hint"], "p", "fold")
    return out.select("unit", F.round("oof", 6).alias("oof"))


@query("stacker")
def stacker(spark, d):
    """Two views with C by nested folds, and a fit on their out-of-fold scores."""
    rows = fit_rows(spark, d).drop("y").withColumn("fold", F.col("unit") % 5)
    out = L.stacker(rows, {"wide": ["value", "hint"], "narrow": ["hour", "width"]}, "p", "fold", [1e-5, 1e-4, 1e-3, 1e-2, 0.1, 1.0])
    return out.select("unit", "fold", *[F.round(c, 6).alias(c) for c in ("wide", "narrow", "stacked")])


@query("platt")
def platt(spark, d):
    rows = fit_rows(spark, d).withColumn("logit", F.ln(F.col("p") / (1 - F.col("p"))))
    model = L.platt(rows)
    return rows.select("unit", F.round(model.probability(), 6).alias("p"))


@query("learning_curve")
def learning_curve(spark, d):
    rows = fit_rows(spark, d).withColumn("grp", F.col("unit") % 20)
    return rounded(L.learning_curve(rows, rows, ["value", "hint"], "p", "grp", [2, 5, 10, 15, 20], 3), "auc")


@query("ablation")
def ablation(spark, d):
    return rounded(L.ablation(fit_rows(spark, d).drop("p"), "fold", ["value", "hint"]), "auc", "delta")


@query("grid_choose")
def grid_choose(spark, d):
    items = scored(spark, d).withColumns({"language": F.col("seq") % 2, "state0": S.state_of("gold", OFF)})
    counts = S.transition_counts(items, OFF, "state0")
    model = D.Model.plain(D.matrix_of(S.transition_matrix(counts, N_LABELS), N_LABELS + 1))
    out, _ = L.grid_choose(items.drop("state0"), model, OFF, [0.5, 1.0], [-2.0, 0.0], [0.9, 1.01], probs="scores")
    return rounded(out, "macro_f1")


@query("annotator_reliability")
def annotator_reliability(spark, d):
    from passages.plans.evaluation_queries import A_SPARK

    items = events(spark, d).withColumn("labels", F.expr(A_SPARK.replace("event_id", "unit").replace("user_id", "seq")))
    items = items.select("seq", "pos", "labels")
    counts = S.transition_counts(items.withColumn("state", S.state_of("labels", OFF)), OFF)
    log_a = D.matrix_of(S.transition_matrix(counts, N_LABELS), N_LABELS + 1)
    p_on, p_off, _ = L.annotator_reliability(items, log_a, N_LABELS)
    names = ["correct", "next to it", "other", "none", "off: none", "off: some"]
    rows = [(n, round(v, 6)) for n, v in zip(names, [*p_on, *p_off], strict=True)]
    return spark.createDataFrame(rows, "bucket string, share double")
