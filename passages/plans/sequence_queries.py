"""Sequence operators on the events: users are sequences, purchases are anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.operators import sequence as S
from passages.operators.scan import ordinal
from passages.plans.registry import query, table

N_LABELS = 12
OFF = N_LABELS

# the same arithmetic in both dialects: labels, gates, scores per event
ANCHORS = """CASE WHEN event_type <> 'purchase' THEN {empty}
  WHEN event_id % 4 = 0 THEN {arr}CAST((7 * user_id + event_id) % 12 AS INT), CAST((7 * user_id + event_id + 3) % 12 AS INT){end}
  ELSE {arr}CAST((7 * user_id + event_id) % 12 AS INT){end} END"""
GOLD = """CASE WHEN event_type = 'error' THEN {empty}
  WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN {arr}CAST((7 * user_id + event_id) % 12 AS INT), CAST((user_id + event_id % 2 + 5) % 12 AS INT){end}
  WHEN event_type = 'purchase' THEN {arr}CAST((7 * user_id + event_id) % 12 AS INT){end}
  ELSE {arr}CAST((user_id + event_id % 2) % 12 AS INT){end} END"""


def both(template):
    spark = template.format(empty="CAST(array() AS array<int>)", arr="array(", end=")")
    duck = template.format(empty="[]::INT[]", arr="[", end="]")
    return spark, duck


ANCHORS_SPARK, ANCHORS_SQL = both(ANCHORS)
GOLD_SPARK, GOLD_SQL = both(GOLD)
GATE_SPARK = "filter(sequence(0, 11), l -> (event_id + l) % 5 <> 0)"
GATE_SQL = "list_filter(range(12), lambda l: (event_id + l) % 5 <> 0)"
SCORES_SPARK = "transform(sequence(0, 11), l -> ((event_id * 37 + l * 101) % 1000 + 1) / 1001.0D)"
SCORES_SQL = "list_transform(range(12), lambda l: ((event_id * 37 + l * 101) % 1000 + 1) / 1001.0::DOUBLE)"

EV = f"""ev AS (SELECT user_id AS seq, event_id AS unit, event_type, value, ts,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
            {ANCHORS_SQL} AS anchors, {GOLD_SQL} AS gold, list_transform({GATE_SQL}, lambda x: x::INT) AS gate, {SCORES_SQL} AS scores
         FROM events)"""


def events(spark, d):
    rows = table(spark, d, "events").withColumnsRenamed({"user_id": "seq", "event_id": "unit"}).drop("props")
    placed = ordinal(rows, ["seq"], ["ts", "unit"])

    def expr(sql):
        return F.expr(sql.replace("user_id", "seq").replace("event_id", "unit"))

    return placed.withColumns(
        {"anchors": expr(ANCHORS_SPARK), "gold": expr(GOLD_SPARK), "gate": expr(GATE_SPARK), "scores": expr(SCORES_SPARK)}
    )


def shown(column, name=None):
    return F.array_join(column, ";").alias(name or column)


@query(
    "ordinal",
    f"WITH {EV} SELECT seq, unit, pos FROM ev",
)
def ordinal_query(spark, d):
    return events(spark, d).select("seq", "unit", "pos")


CARRIED = EV + """, la AS (SELECT *, last_value(CASE WHEN len(anchors) > 0 THEN pos END IGNORE NULLS)
                              OVER (PARTITION BY seq ORDER BY pos) AS anchor_pos FROM ev),
   act AS (SELECT la.*, coalesce(a.anchors, []::INT[]) AS active FROM la LEFT JOIN ev a ON a.seq = la.seq AND a.pos = la.anchor_pos)"""


@query("carry_unbounded", f"WITH {CARRIED} SELECT seq, unit, array_to_string(active, ';') AS held FROM act")
def carry_unbounded(spark, d):
    return S.carry(events(spark, d)).select("seq", "unit", shown("held"))


@query(
    "carry_max_gap",
    f"WITH {CARRIED} SELECT seq, unit, CASE WHEN pos - anchor_pos <= 2 THEN array_to_string(active, ';') ELSE '' END AS held FROM act",
)
def carry_max_gap(spark, d):
    return S.carry(events(spark, d), max_gap=2).select("seq", "unit", shown("held"))


@query(
    "carry_monotonic",
    f"""WITH {EV}, f AS (SELECT *, max(list_max(anchors)) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor FROM ev),
        h AS (SELECT *, list_filter(anchors, lambda v: v >= coalesce(floor, v)) AS hits FROM f),
        la AS (SELECT *, last_value(CASE WHEN len(hits) > 0 THEN pos END IGNORE NULLS) OVER (PARTITION BY seq ORDER BY pos) AS ap FROM h)
        SELECT la.seq, la.unit, coalesce(array_to_string(a.hits, ';'), '') AS held FROM la LEFT JOIN h a ON a.seq = la.seq AND a.pos = la.ap""",
)
def carry_monotonic(spark, d):
    return S.carry(events(spark, d), monotonic=True).select("seq", "unit", shown("held"))


@query(
    "carry_gate_drop",
    f"""WITH {CARRIED}, p AS (SELECT seq, unit, pos, anchor_pos, unnest(active) AS l, generate_subscripts(active, 1) AS i, gate, len(anchors) = 0 AS silent FROM act),
        k AS (SELECT *, bool_and(NOT silent OR list_contains(gate, l)) OVER (PARTITION BY seq, anchor_pos, l ORDER BY pos) AS alive FROM p),
        g AS (SELECT seq, unit, string_agg(l, ';' ORDER BY i) FILTER (WHERE alive) AS held FROM k GROUP BY seq, unit)
        SELECT ev.seq, ev.unit, coalesce(g.held, '') AS held FROM ev LEFT JOIN g USING (seq, unit)""",
)
def carry_gate_drop(spark, d):
    return S.carry(events(spark, d), gate="gate").select("seq", "unit", shown("held"))


# item by item in SQL: the recursion holds the labels in force and how many items ago they were set
def rules_sql(gap, gate):
    reach = "true" if gap is None else f"s.gap < {gap}"
    stay = "s.active" if gate is None else f"list_filter(s.active, lambda l: list_contains(e.{gate}, l))"
    return f"""WITH RECURSIVE {EV}, s AS (
          SELECT seq, unit, pos, anchors AS active, 0 AS gap FROM ev WHERE pos = 0
          UNION ALL
          SELECT e.seq, e.unit, e.pos,
                 CASE WHEN len(list_filter(e.anchors, lambda v: v >= coalesce(list_max(s.active), v))) > 0
                      THEN list_filter(e.anchors, lambda v: v >= coalesce(list_max(s.active), v))
                      WHEN {reach} THEN {stay} ELSE []::INT[] END,
                 CASE WHEN len(list_filter(e.anchors, lambda v: v >= coalesce(list_max(s.active), v))) > 0 THEN 0 ELSE s.gap + 1 END
          FROM s JOIN ev e ON e.seq = s.seq AND e.pos = s.pos + 1)
        SELECT seq, unit, array_to_string(active, ';') AS held FROM s"""


@query("carry_monotonic_gap", rules_sql(4, None))
def carry_monotonic_gap(spark, d):
    return S.carry(events(spark, d), monotonic=True, max_gap=4).select("seq", "unit", shown("held"))


@query("carry_monotonic_gate", rules_sql(None, "gate"))
def carry_monotonic_gate(spark, d):
    return S.carry(events(spark, d), monotonic=True, gate="gate").select("seq", "unit", shown("held"))


@query(
    "carry_gate_resume",
    f"""WITH {CARRIED} SELECT seq, unit, array_to_string(CASE WHEN len(anchors) > 0 THEN active
          ELSE list_filter(active, lambda l: list_contains(gate, l)) END, ';') AS held FROM act""",
)
def carry_gate_resume(spark, d):
    return S.carry(events(spark, d), gate="gate", resume=True).select("seq", "unit", shown("held"))


@query(
    "carry_oracle_gate",
    f"""WITH {CARRIED} SELECT seq, unit, array_to_string(CASE WHEN len(anchors) > 0 THEN active
          ELSE list_filter(active, lambda l: list_contains(gold, l)) END, ';') AS held FROM act""",
)
def carry_oracle_gate(spark, d):
    return S.carry(events(spark, d), gate="gold", resume=True).select("seq", "unit", shown("held"))


@query(
    "carry_oracle_anchors",
    f"""WITH {EV}, o AS (SELECT *, CASE WHEN unit % 5 IN (0, 1) THEN gold ELSE []::INT[] END AS recited FROM ev),
        la AS (SELECT *, last_value(CASE WHEN len(recited) > 0 THEN pos END IGNORE NULLS) OVER (PARTITION BY seq ORDER BY pos) AS ap FROM o)
        SELECT la.seq, la.unit, array_to_string(CASE WHEN len(la.recited) > 0 THEN la.recited
                 ELSE list_filter(coalesce(a.recited, []::INT[]), lambda l: list_contains(la.gold, l)) END, ';') AS held
        FROM la LEFT JOIN o a ON a.seq = la.seq AND a.pos = la.ap""",
)
def carry_oracle_anchors(spark, d):
    """Anchors are the gold labels of the two most faithful tiers, the gate is gold."""
    recited = F.when(F.col("unit") % 5 < 2, F.col("gold")).otherwise(S.none_of())
    items = events(spark, d).withColumn("recited", recited)
    return S.carry(items, anchors="recited", gate="gold", resume=True).select("seq", "unit", shown("held"))


@query(
    "recency_last_next",
    f"""WITH {EV}, g AS (SELECT seq, unit, pos, anchors, v FROM ev, range(12) t(v)),
        r AS (SELECT *, max(CASE WHEN list_contains(anchors, v) THEN pos END) OVER w AS seen FROM g
              WINDOW w AS (PARTITION BY seq, v ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        la AS (SELECT seq, unit, last_value(CASE WHEN len(anchors) > 0 THEN anchors END IGNORE NULLS)
                 OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM ev)
        SELECT r.seq, r.unit, r.v::INT AS label, round(coalesce(1.0 / (1 + pos - seen), 0), 6)::DOUBLE AS recency,
               coalesce(list_contains(s, v::INT), false)::INT AS last, coalesce(list_contains(s, v::INT - 1), false)::INT AS next
        FROM r JOIN la USING (seq, unit)""",
)
def recency_last_next(spark, d):
    rows = S.memory_features(events(spark, d), range(N_LABELS))
    z = F.arrays_zip("recency", "last", "next")
    return rows.select("seq", "unit", F.posexplode(z).alias("label", "z")).select(
        "seq", "unit", "label", F.round("z.recency", 6).alias("recency"), "z.last", "z.next"
    )


@query(
    "carried_score",
    f"""WITH {CARRIED} SELECT seq, unit, round(coalesce(list_max(list_transform(active, lambda l: scores[l + 1])), 0.0), 6) AS score FROM act""",
)
def carried_score(spark, d):
    rows = S.carry(events(spark, d))
    return rows.select("seq", "unit", F.round(S.carried_score("held", "scores"), 6).alias("score"))


@query(
    "since_anchor",
    f"""WITH {CARRIED} SELECT seq, unit, pos - anchor_pos AS since,
          round(avg(list_max(scores)) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS mean FROM act""",
)
def since_anchor(spark, d):
    rows = S.carry(events(spark, d)).withColumn("top", F.array_max("scores"))
    rows = S.moving_mean(rows, "top")
    return rows.select("seq", "unit", (F.col("pos") - F.col("anchor_pos")).alias("since"), F.round("mean", 6).alias("mean"))


def turns(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), "role", "text")


@query(
    "context_window",
    """WITH x AS (SELECT conv_id AS seq, turn AS pos, text, lag(text) OVER w AS p, lead(text) OVER w AS n,
              lag(text, 2) OVER w AS p2, lead(text, 2) OVER w AS n2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
       SELECT seq, pos, md5(concat_ws(chr(10) || chr(10), '[BEFORE]' || chr(10) || p2, '[BEFORE]' || chr(10) || p, '[TARGET]' || chr(10) || text,
              '[AFTER]' || chr(10) || n, '[AFTER]' || chr(10) || n2)) AS context,
              md5('PREVIOUS: ' || right(coalesce(p, ''), 700) || ' || NEXT: ' || left(coalesce(n, ''), 700)) AS neighbour_text,
              md5(concat_ws(chr(10) || chr(10), p2, p)) AS earlier FROM x""",
)
def context_window(spark, d):
    rows = S.context_window(turns(spark, d))
    return rows.select("seq", "pos", *[F.md5(c).alias(c) for c in ("context", "neighbour_text", "earlier")])


@query(
    "leftover_view",
    f"""WITH {EV}, x AS (SELECT seq, unit, pos, event_type IN ('purchase', 'view') AS decided, event_type AS label FROM ev),
        s AS (SELECT *, bool_or(NOT decided) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS vis,
                last_value(CASE WHEN decided THEN pos END IGNORE NULLS) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb,
                first_value(CASE WHEN decided THEN pos END IGNORE NULLS) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS pa FROM x),
        v AS (SELECT *, lag(pos) OVER (PARTITION BY seq ORDER BY pos) AS pp FROM s WHERE vis)
        SELECT v.seq, v.unit, NOT v.decided AS target, coalesce(pp <> v.pos - 1, false) AS gap_before,
               b.label AS label_before, v.pos - pb AS distance_before, a.label AS label_after, pa - v.pos AS distance_after
        FROM v LEFT JOIN x b ON b.seq = v.seq AND b.pos = pb LEFT JOIN x a ON a.seq = v.seq AND a.pos = pa""",
)
def leftover_view(spark, d):
    items = events(spark, d).select(
        "seq", "unit", "pos", F.col("event_type").isin("purchase", "view").alias("decided"), F.col("event_type").alias("label")
    )
    return S.leftover_view(items).drop("pos", "decided", "label")


STATES = EV + f", st AS (SELECT seq, unit, pos, coalesce(list_min(gold), {OFF}) AS state FROM ev)"


def states(spark, d):
    return events(spark, d).withColumn("state", S.state_of("gold", OFF))


@query("state_of", f"WITH {STATES} SELECT seq, unit, state FROM st")
def state_of(spark, d):
    return states(spark, d).select("seq", "unit", "state")


COUNTS = STATES + """, ab AS (SELECT lag(state) OVER (PARTITION BY seq ORDER BY pos) AS a, state AS b FROM st),
  cn AS (SELECT count(*) FILTER (WHERE a <> 12 AND b = a) + 1 AS stay, count(*) FILTER (WHERE a <> 12 AND b <> 12 AND b - a IN (1, 2)) + 1 AS next,
    count(*) FILTER (WHERE a <> 12 AND b <> 12 AND b <> a AND b - a NOT IN (1, 2)) + 1 AS jump, count(*) FILTER (WHERE a <> 12 AND b = 12) + 1 AS to_off,
    count(*) FILTER (WHERE a = 12 AND b = 12) + 1 AS stay_off, count(*) FILTER (WHERE a = 12 AND b <> 12) + 1 AS from_off FROM ab)"""


@query("transition_counts", f"WITH {COUNTS} SELECT * FROM cn")
def transition_counts(spark, d):
    return S.transition_counts(states(spark, d), OFF)


@query(
    "transition_matrix",
    f"""WITH {COUNTS}, m AS (SELECT a, b, CASE WHEN a = 12 AND b = 12 THEN stay_off WHEN a = 12 THEN from_off / 12.0 WHEN b = 12 THEN to_off
              WHEN a = b THEN stay WHEN b - a IN (1, 2) THEN next / least(2.0, 11 - a) ELSE jump / (11.0 - least(2.0, 11 - a)) END::DOUBLE AS mass
          FROM cn, range(13) x(a), range(13) y(b))
        SELECT a::INT AS a, b::INT AS b, round(ln(mass / sum(mass) OVER (PARTITION BY a)), 6) AS log_p FROM m""",
)
def transition_matrix(spark, d):
    m = S.transition_matrix(S.transition_counts(states(spark, d), OFF), N_LABELS)
    return m.withColumn("log_p", F.round("log_p", 6))


RESUME_COUNTS = STATES + """, h AS (SELECT lag(state) OVER w AS a, state AS b,
     last_value(nullif(state, 12) IGNORE NULLS) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held
     FROM st WINDOW w AS (PARTITION BY seq ORDER BY pos)),
  rc AS (SELECT count(*) FILTER (WHERE a <> 12 AND b = a) + 1 AS stay, count(*) FILTER (WHERE a <> 12 AND b <> 12 AND b - a IN (1, 2)) + 1 AS next,
    count(*) FILTER (WHERE a <> 12 AND b <> 12 AND b <> a AND b - a NOT IN (1, 2)) + 1 AS jump, count(*) FILTER (WHERE a <> 12 AND b = 12) + 1 AS to_off,
    count(*) FILTER (WHERE a = 12 AND held IS NULL AND b = 12) + 1 AS pre_stay, count(*) FILTER (WHERE a = 12 AND held IS NULL AND b <> 12) + 1 AS pre_exit,
    count(*) FILTER (WHERE a = 12 AND held IS NOT NULL AND b = 12) + 1 AS stay_off,
    count(*) FILTER (WHERE a = 12 AND held IS NOT NULL AND b <> 12 AND b - held IN (0, 1, 2)) + 1 AS resume,
    count(*) FILTER (WHERE a = 12 AND held IS NOT NULL AND b <> 12 AND b - held NOT IN (0, 1, 2)) + 1 AS from_off_other FROM h)"""


@query("transition_counts_resume", f"WITH {RESUME_COUNTS} SELECT * FROM rc")
def transition_counts_resume(spark, d):
    return S.transition_counts_resume(states(spark, d), OFF)


@query(
    "transition_matrix_resume",
    f"""WITH {RESUME_COUNTS}, g AS (SELECT rc.*, a, b, a - 13 AS h, least(2, 11 - a) AS nn, least(3, 12 - (a - 13)) AS nb FROM rc, range(25) x(a), range(25) y(b)),
        m AS (SELECT a, b, CASE WHEN a < 12 AND b = 13 + a THEN to_off WHEN a < 12 AND b >= 12 THEN 0 WHEN a < 12 AND a = b THEN stay
               WHEN a < 12 AND b - a IN (1, 2) THEN next::DOUBLE / nn WHEN a < 12 THEN jump::DOUBLE / (11 - nn)
               WHEN a = 12 AND b = 12 THEN pre_stay WHEN a = 12 AND b < 12 THEN pre_exit / 12.0::DOUBLE WHEN a = 12 THEN 0
               WHEN a = b THEN stay_off WHEN b >= 12 THEN 0 WHEN b - h IN (0, 1, 2) THEN resume::DOUBLE / nb ELSE from_off_other::DOUBLE / (12 - nb) END::DOUBLE AS mass FROM g)
        SELECT a::INT AS a, b::INT AS b, CASE WHEN mass > 0 THEN round(ln(mass / t), 6) END AS log_p
        FROM (SELECT *, sum(mass) OVER (PARTITION BY a) AS t FROM m)""",
)
def transition_matrix_resume(spark, d):
    m = S.transition_matrix_resume(S.transition_counts_resume(states(spark, d), OFF), N_LABELS)
    return m.withColumn("log_p", F.round("log_p", 6))


P_OFF = "((unit * 13) % 97 + 1) / CAST(99.0 AS DOUBLE)"


def scored(spark, d):
    return events(spark, d).withColumn("p_off", F.expr(P_OFF).cast("double"))


@query(
    "emissions",
    f"""WITH {EV}, p AS (SELECT seq, unit, unnest(scores) AS s, generate_subscripts(scores, 1) - 1 AS state, list_sum(scores) AS total, {P_OFF} AS po FROM ev),
        e AS (SELECT seq, unit, state, ln(least(1, greatest(1e-12, (1 - po) * s / total))) AS e FROM p
              UNION ALL SELECT seq, unit, 12, ln(least(1, greatest(1e-12, {P_OFF}))) - 1.5 FROM ev)
        SELECT seq, unit, state::INT AS state, round(e, 6) AS e FROM e""",
)
def emissions(spark, d):
    rows = scored(spark, d).select("seq", "unit", F.posexplode(S.emissions("scores", "p_off", -1.5)).alias("state", "e"))
    return rows.withColumn("e", F.round("e", 6))


@query(
    "adapt_counts",
    f"""WITH {COUNTS}, an AS (SELECT seq, anchors, lag(anchors) OVER (PARTITION BY seq ORDER BY pos) AS prev FROM ev WHERE len(anchors) > 0),
        ch AS (SELECT seq, count(*) FILTER (WHERE prev IS NOT NULL AND NOT list_has_any(prev, anchors)) AS changes FROM an GROUP BY seq),
        pr AS (SELECT seq, count(*) AS n, sum({P_OFF}) AS off_sum FROM ev GROUP BY seq),
        k AS (SELECT pr.seq, pr.n, pr.off_sum, coalesce(ch.changes, 0) AS changes, cn.*, from_off / (from_off + stay_off) AS u, stay + next + jump + to_off AS tot
              FROM pr LEFT JOIN ch USING (seq), cn),
        s AS (SELECT *, (100 * (stay / tot) + greatest(n - off_sum - changes, 0)) / (100 + n - off_sum) AS s,
                     (100 * ((to_off / tot) / (to_off / tot + u)) + off_sum) / (100 + n) AS r FROM k),
        q AS (SELECT *, least(r / (1 - r) * u, 0.99 - s) AS q FROM s),
        z AS (SELECT *, (1 - s - q) / (next + jump) AS rest FROM q)
        SELECT seq, round(s * tot, 4) AS stay, round(next * rest * tot, 4) AS next, round(jump * rest * tot, 4) AS jump,
               round(q * tot, 4) AS to_off, stay_off::DOUBLE AS stay_off, from_off::DOUBLE AS from_off FROM z""",
)
def adapt_counts(spark, d):
    counts = S.transition_counts(states(spark, d), OFF)
    out = S.adapt_counts(scored(spark, d), counts, 100)
    return out.select("seq", *[F.round(c, 4).alias(c) for c in counts.columns])


SEGMENT_ITEMS = EV + """, it AS (SELECT seq, unit, pos, CASE event_type WHEN 'error' THEN 'OFF' WHEN 'purchase' THEN 'L1' WHEN 'view' THEN 'L1' ELSE 'L2' END AS primary_label,
       value, 1 + unit % 7 AS n_words FROM ev),
   fl AS (SELECT *, CASE WHEN primary_label IS DISTINCT FROM lag(primary_label) OVER (PARTITION BY seq ORDER BY pos) OR pos = 0 THEN 1 ELSE 0 END AS new,
       sum(n_words) OVER (PARTITION BY seq ORDER BY pos) AS word_end, sum(n_words) OVER (PARTITION BY seq) AS total FROM it),
   rn AS (SELECT *, sum(new) OVER (PARTITION BY seq ORDER BY pos) AS run FROM fl)"""


def segment_items(spark, d):
    primary = (
        F.when(F.col("event_type") == "error", "OFF")
        .when(F.col("event_type").isin("purchase", "view"), "L1")
        .otherwise("L2")
    )
    return events(spark, d).select(
        "seq", "unit", "pos", primary.alias("primary"), F.col("value").alias("p_primary"), (1 + F.col("unit") % 7).alias("n_words")
    )


@query(
    "segments",
    f"""WITH {SEGMENT_ITEMS} SELECT seq, run::BIGINT AS run, any_value(primary_label) AS "primary", min_by(unit, pos) AS first_unit, max_by(unit, pos) AS last_unit,
          count(*) AS dwell, round(sum(value), 3) AS effective_dwell, round(min(word_end - n_words) / any_value(total), 4) AS pos_start,
          round(max(word_end) / any_value(total), 4) AS pos_end FROM rn GROUP BY seq, run""",
)
def segments(spark, d):
    return S.segments(segment_items(spark, d)).select(
        "seq", "run", "primary", "first_unit", "last_unit", "dwell",
        F.round("effective_dwell", 3).alias("effective_dwell"),
        F.round("pos_start", 4).alias("pos_start"), F.round("pos_end", 4).alias("pos_end"),
    )


@query(
    "index_rows",
    f"""WITH {SEGMENT_ITEMS} SELECT seq, unit, run::BIGINT AS run, (word_end - n_words)::BIGINT AS word_start, word_end::BIGINT AS word_end, total::BIGINT AS total_words FROM rn""",
)
def index_rows(spark, d):
    return S.index_rows(segment_items(spark, d)).select("seq", "unit", "run", "word_start", "word_end", "total_words")


STEPS_SQL = "(VALUES " + ", ".join(f"({k})" for k in S.SURVIVAL_STEPS) + ") k(k)"


@query(
    "survival_curve",
    f"""WITH {EV}, g AS (SELECT seq, pos, unnest(gold) AS l FROM ev), n AS (SELECT seq, max(pos) AS last FROM ev GROUP BY seq)
        SELECT k.k, count(b.l) AS kept, count(*) AS total FROM {STEPS_SQL} JOIN g ON true JOIN n ON n.seq = g.seq AND g.pos + k.k <= n.last
        LEFT JOIN g b ON b.seq = g.seq AND b.pos = g.pos + k.k AND b.l = g.l GROUP BY k.k""",
)
def survival_curve(spark, d):
    return S.survival(events(spark, d))


@query(
    "carry_precision",
    f"""WITH {EV}, nx AS (SELECT seq, pos, anchors, min(CASE WHEN len(anchors) > 0 THEN pos END) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
             max(pos) OVER (PARTITION BY seq) AS last FROM ev),
        p AS (SELECT seq, pos, nxt, last, unnest(anchors) AS l FROM nx)
        SELECT k.k, count(*) FILTER (WHERE list_contains(t.gold, p.l)) AS kept, count(p.seq) AS total
        FROM {STEPS_SQL} LEFT JOIN p ON p.pos + k.k <= p.last AND (p.nxt IS NULL OR p.nxt > p.pos + k.k)
        LEFT JOIN ev t ON t.seq = p.seq AND t.pos = p.pos + k.k GROUP BY k.k""",
)
def carry_precision(spark, d):
    return S.carry_precision(events(spark, d))


@query(
    "label_runs",
    f"""WITH {EV}, g AS (SELECT seq, pos, unnest(gold) AS label, lead(gold) OVER (PARTITION BY seq ORDER BY pos) AS nx FROM ev),
        r AS (SELECT *, pos - row_number() OVER (PARTITION BY seq, label ORDER BY pos) AS grp FROM g)
        SELECT seq, label, min(pos) AS first_pos, count(*) AS length,
               CASE WHEN max_by(coalesce(len(nx), -1), pos) = -1 THEN 'sequence ends' WHEN max_by(coalesce(len(nx), -1), pos) > 0 THEN 'another label' ELSE 'empty item' END AS follows
        FROM r GROUP BY seq, label, grp""",
)
def label_runs(spark, d):
    return S.label_runs(events(spark, d))


@query(
    "empty_stretches",
    f"""WITH {EV}, r AS (SELECT seq, pos, pos - row_number() OVER (PARTITION BY seq ORDER BY pos) AS grp FROM ev WHERE len(gold) = 0)
        SELECT seq, min(pos) AS first_pos, count(*) AS length FROM r GROUP BY seq, grp""",
)
def empty_stretches(spark, d):
    return S.empty_stretches(events(spark, d))


@query(
    "timeline",
    f"""WITH {CARRIED} SELECT seq, pos, CASE WHEN len(gold) = 0 THEN 'OFF' ELSE array_to_string(list_sort(list_distinct(gold)), ';') END AS gold,
          CASE WHEN len(active) = 0 THEN 'OFF' ELSE array_to_string(list_sort(list_distinct(active)), ';') END AS carried,
          CASE WHEN len(anchors) = 0 THEN 'OFF' ELSE array_to_string(list_sort(list_distinct(anchors)), ';') END AS detected FROM act""",
)
def timeline(spark, d):
    rows = S.carry(events(spark, d))
    return rows.select(
        "seq", "pos", S.cell("gold").alias("gold"), S.cell("held").alias("carried"), S.cell("anchors").alias("detected")
    )


@query(
    "reference_context",
    f"""WITH {CARRIED}, t AS (SELECT seq, unit, unnest(scores) AS s, generate_subscripts(scores, 1) - 1 AS l FROM ev),
        k AS (SELECT seq, unit, l, row_number() OVER (PARTITION BY seq, unit ORDER BY s DESC, l) AS rn FROM t),
        b AS (SELECT seq, unit, string_agg(l, ';' ORDER BY rn) AS top FROM k WHERE rn <= 3 GROUP BY seq, unit)
        SELECT act.seq, act.unit, CASE WHEN anchor_pos IS NULL THEN b.top ELSE array_to_string(active, ';') END AS reference,
               CASE WHEN anchor_pos IS NULL THEN 'candidates' ELSE 'anchor' END AS kind FROM act JOIN b USING (seq, unit)""",
)
def reference_context(spark, d):
    return S.reference_context(events(spark, d)).select("seq", "unit", shown("reference"), "kind")


@query(
    "masked_sequence",
    """SELECT conv_id AS seq, turn // 4 AS part, count(*) AS items,
              md5(string_agg(printf('P%03d: ', turn + 1) || CASE WHEN role = 'user' THEN '[resolved]' ELSE text END, chr(10) || chr(10) ORDER BY turn)) AS body
       FROM conversations GROUP BY ALL""",
)
def masked_sequence(spark, d):
    items = turns(spark, d).withColumn("skip", F.col("role") == "user")
    return S.masked_sequence(items, "skip", part_rows=4).withColumn("body", F.md5("body"))
