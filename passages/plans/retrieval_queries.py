"""Matching and retrieval: embeddings are the index, benchmark rows are the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.functions import text as T
from passages.functions import vectors as V
from passages.operators import chunk as C
from passages.operators import match as M
from passages.operators import profiles as P
from passages.operators import retrieve as R
from passages.operators import sequence as S
from passages.plans import vector_queries as VQ
from passages.plans.registry import documents, query, table
from passages.plans.text_queries import FOLD_SQL, STOP, STOP_SQL

# ---- text matching -----------------------------------------------------------------------


def benchmark(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").cast("int").alias("label"), "text")


def docs(spark, d):
    return documents(spark, d, "doc_id", "text")


def grams_sql(name, source, key, n):
    return f"""{name} AS (SELECT DISTINCT {key}, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM (
        SELECT {key}, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM (SELECT {key}, list_filter(string_split({FOLD_SQL.format('text')}, ' '), lambda w: w <> '') AS ws FROM {source})))"""


NGRAM_SQL = f"""{grams_sql('dg', 'documents', 'doc_id', 5)}, {grams_sql('bg', 'benchmark', 'item_id', 5)},
   sz AS (SELECT item_id, count(*) AS n FROM bg GROUP BY 1),
   mt AS (SELECT doc_id, item_id AS label, count(*) AS shared FROM dg JOIN bg USING (g) GROUP BY 1, 2),
   an AS (SELECT doc_id, label::INT AS label, shared / n AS score FROM mt JOIN sz ON sz.item_id = label WHERE shared / n >= 0.9)"""


@query("ngram_match", f"WITH {NGRAM_SQL} SELECT doc_id, label, round(score, 6) AS score FROM an")
def ngram_match(spark, d):
    return M.ngram_match(docs(spark, d), benchmark(spark, d)).withColumn("score", F.round("score", 6))


@query(
    "best_anchor",
    f"""WITH {NGRAM_SQL.replace('>= 0.9', '>= 0.02')} SELECT doc_id, label, round(score, 6) AS score FROM an
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1""",
)
def best_anchor(spark, d):
    anchors = M.ngram_match(docs(spark, d), benchmark(spark, d), threshold=0.02)
    return M.best_anchor(anchors).withColumn("score", F.round("score", 6))


@query("fuzzy_candidates")
def fuzzy_candidates(spark, d):
    """Passages of 100 words against the catalogue, scored letter by letter."""
    passages = C.word_windows(docs(spark, d), 100).withColumn("passage", F.concat_ws("-", "doc_id", "pos"))
    out = M.fuzzy_candidates(passages, benchmark(spark, d), "passage", 0.65)
    return out.withColumn("score", F.round("score", 6))


@query("fuzzy_matrix")
def fuzzy_matrix(spark, d):
    parts = table(spark, d, "part")
    kinds = parts.select("p_type").distinct()
    catalogue = kinds.select(F.ascii("p_type").alias("label"), F.lower("p_type").alias("text"))
    items = parts.select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("text"))
    rows = M.fuzzy_matrix(items, catalogue)
    return rows.select("p_partkey", F.round(F.array_max("string"), 6).alias("best"), F.size("string").alias("entries"))


@query("two_pass_anchors")
def two_pass_anchors(spark, d):
    def density(s):
        return T.foreign_density(s, "th|er|on|en", ["que", "und"])

    out = M.two_pass_anchors(docs(spark, d), benchmark(spark, d), density)
    hits = out.select("doc_id", F.inline("hits"))
    return hits.select("doc_id", "label", "start", "end", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "method")


def positions_sql(name, pattern, kind):
    return f"""{name}_m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS hit, unnest(list_slice(regexp_split_to_array(text, '{pattern}'), 1, len(regexp_extract_all(text, '{pattern}')))) AS piece,
           generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS i FROM documents),
        {name} AS (SELECT doc_id, (sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) - length(hit))::INT AS pos, '{kind}' AS type FROM {name}_m)"""


@query(
    "near_cues",
    f"""WITH {positions_sql('h', ' that ', 'hit')}, {positions_sql('ci', ' on the ', 'intro_marker')}, {positions_sql('cc', ' and ', 'closing_marker')},
        c AS (SELECT * FROM ci UNION ALL SELECT * FROM cc),
        n AS (SELECT h.doc_id, h.pos, count(c.pos) FILTER (WHERE abs(c.pos - h.pos) < 500) AS near, max(c.pos) FILTER (WHERE c.type = 'intro_marker' AND c.pos < h.pos) AS ip,
                min(c.pos) FILTER (WHERE c.type = 'closing_marker' AND c.pos > h.pos) AS cp FROM h LEFT JOIN c ON c.doc_id = h.doc_id GROUP BY h.doc_id, h.pos)
        SELECT doc_id, pos AS start, near AS cues, CASE WHEN pos - ip < 1000 THEN 'near_introduction' WHEN cp - pos < 500 THEN 'near_closing' ELSE 'explanation_body' END AS section FROM n""",
)
def near_cues(spark, d):
    hits = F.transform(T.positions(F.col("text"), " that "), lambda x: F.struct(x["pos"].alias("start"), F.lit(1).alias("label")))
    cues = T.cues(F.col("text"), {"intro_marker": (" on the ",), "closing_marker": (" and ",)})
    rows = docs(spark, d).withColumns({"hits": hits, "cues": cues}).select("doc_id", F.inline(M.near_cues()))
    return rows.select("doc_id", "start", F.size("cues").cast("long").alias("cues"), "section")


@query(
    "hits_near_cues",
    f"""WITH {positions_sql('h', ' that ', 'hit')}, {positions_sql('ci', ' on the ', 'intro_marker')}, {positions_sql('cc', ' and ', 'closing_marker')},
        c AS (SELECT * FROM ci UNION ALL SELECT * FROM cc),
        n AS (SELECT h.doc_id, h.pos, count(c.pos) FILTER (WHERE abs(c.pos - h.pos) < 500) AS near, max(c.pos) FILTER (WHERE c.type = 'intro_marker' AND c.pos < h.pos) AS ip,
                min(c.pos) FILTER (WHERE c.type = 'closing_marker' AND c.pos > h.pos) AS cp FROM h LEFT JOIN c ON c.doc_id = h.doc_id GROUP BY h.doc_id, h.pos)
        SELECT doc_id, pos AS start, near AS cues, CASE WHEN pos - ip < 1000 THEN 'near_introduction' WHEN cp - pos < 500 THEN 'near_closing' ELSE 'explanation_body' END AS section FROM n""",
)
def hits_near_cues(spark, d):
    hits = docs(spark, d).select("doc_id", F.explode(T.positions(F.col("text"), " that ")).alias("x")).select("doc_id", F.col("x.pos").alias("start"))
    cues = docs(spark, d).select("doc_id", F.explode(T.cues(F.col("text"), {"intro_marker": (" on the ",), "closing_marker": (" and ",)})).alias("c"))
    rows = M.hits_near_cues(hits, cues.select("doc_id", "c.pos", "c.type"), ["doc_id"])
    return rows.select("doc_id", "start", F.size("cues").cast("long").alias("cues"), "section")


@query(
    "vote_filter",
    """SELECT user_id AS seq, event_type AS label, count(*) AS votes FROM events GROUP BY 1, 2 HAVING count(*) >= 14""",
)
def vote_filter(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("seq"), F.col("event_type").alias("label"))
    return M.vote_filter(e, 14)


# ---- the index -----------------------------------------------------------------------------

IX_PRIMARY = "CASE WHEN vec_id % 6 = 0 OR label = 4 THEN -1 ELSE label END"
IX_P = "(vec_id % 10 + 1) / CAST(11.0 AS DOUBLE)"
IX = VQ.VI + f""", ix AS (SELECT vec_id AS item, seq, pos, v, {IX_PRIMARY} AS prim, {IX_P} AS p,
     CASE WHEN vec_id % 3 = 0 THEN [CAST((label + 1) % 10 AS INT)] ELSE []::INT[] END AS secondary, 's' || (seq % 4) AS speaker, 't' || (seq % 3) AS tradition, label FROM vi)"""


def index(spark, d):
    rows = VQ.items(spark, d)
    return rows.select(
        F.col("vec_id").alias("item"), "seq", "pos", "vector", F.expr(IX_PRIMARY).alias("primary"), F.expr(IX_P).alias("p"),
        F.expr("CASE WHEN vec_id % 3 = 0 THEN array(CAST((label + 1) % 10 AS INT)) ELSE cast(array() AS array<int>) END").alias("secondary"),
        F.concat(F.lit("s"), (F.col("seq") % 4).cast("string")).alias("speaker"),
        F.concat(F.lit("t"), (F.col("seq") % 3).cast("string")).alias("tradition"), "label",
    )


# every benchmark row is a query; its vector is that of the row of the same number, some name a label
Q_TEXT = """text || CASE item_id % 5 WHEN 0 THEN ' verse ' || (item_id % 13) WHEN 1 THEN ' as in 2.' || (item_id % 9 + 1) || ' ' ELSE '' END"""
Q_SHORT = "CASE WHEN item_id % 7 = 3 THEN 'verse ' || (item_id % 10) ELSE {} END".format(Q_TEXT)
QU = f"qu AS (SELECT item_id AS query, v AS qv, {Q_SHORT} AS qt FROM benchmark JOIN vi ON vec_id = item_id)"


def queries(spark, d):
    v = VQ.items(spark, d).select(F.col("vec_id").alias("item_id"), "vector")
    b = table(spark, d, "benchmark").join(v, "item_id")
    return b.select(F.col("item_id").alias("query"), "vector", F.expr(Q_SHORT).alias("text"))


SIM = IX + f", {QU}, sm AS (SELECT query, item, seq, prim, p, speaker, tradition, secondary, round(list_dot_product(qv, v), 10) AS sim FROM qu, ix)"


@query(
    "topk_cosine",
    f"WITH {SIM} SELECT query, item, round(sim, 4) AS sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) AS rank FROM sm WHERE sim >= 0.1 QUALIFY rank <= 5",
)
def topk_cosine(spark, d):
    out = R.topk_cosine(queries(spark, d), index(spark, d), 5, min_sim=0.1)
    return out.select("query", "item", F.round("sim", 4).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(
    "context_block",
    f"""WITH {SIM}, t AS (SELECT query, item, prim, sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) AS rank FROM sm QUALIFY rank <= 5)
        SELECT query, string_agg('[Source ' || rank || ' | Label: ' || prim || ']' || chr(10) || 'item ' || item, chr(10) || chr(10) ORDER BY rank) AS context FROM t GROUP BY query""",
)
def context_block(spark, d):
    """The few retrieved items of each query as one text."""
    ix = index(spark, d)
    hits = R.topk_cosine(queries(spark, d), ix, 5).join(ix.select("item", "primary"), "item")
    header = F.format_string("[Source %d | Label: %d]", "rank", "primary")
    body = F.concat(F.lit("item "), F.col("item").cast("string"))
    return hits.groupBy("query").agg(T.context_block(header, body, F.col("rank")).alias("context"))


@query(
    "topk_per_group",
    f"WITH {SIM} SELECT query, tradition, item, round(sim, 4) AS sim, row_number() OVER (PARTITION BY query, tradition ORDER BY sim DESC, item) AS rank FROM sm QUALIFY rank <= 3",
)
def topk_per_group(spark, d):
    out = R.topk_cosine(queries(spark, d), index(spark, d), 3, group="tradition")
    return out.select("query", "tradition", "item", F.round("sim", 4).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(
    "vector_match",
    f"""WITH {VQ.VI}, en AS (SELECT label, unnest([min_by(v, vec_id), max_by(v, vec_id)]) AS e FROM vi GROUP BY label),
        s AS (SELECT vec_id AS item, en.label, max(round(list_dot_product(v, e), 10)) AS score FROM vi, en GROUP BY ALL)
        SELECT item, label, round(score, 6) AS score, row_number() OVER (PARTITION BY item ORDER BY score DESC, label) AS rank FROM s QUALIFY rank <= 3 AND score >= 0.2""",
)
def vector_match(spark, d):
    t = VQ.texts(spark, d)
    entries = t.select("label", F.col("text_vector").alias("vector")).unionByName(t.select("label", F.col("fallback").alias("vector")))
    rows = VQ.items(spark, d).withColumnRenamed("vec_id", "item")
    out = R.vector_match(rows, entries, 0.2, 3)
    return out.select("item", "label", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


TOK = f"list_filter(string_split({FOLD_SQL}, ' '), lambda w: w <> '' AND NOT list_contains({STOP_SQL}, w))"
BM = f"""dt AS (SELECT item_id::INT AS label, {TOK.format('text')} AS ts FROM benchmark), co AS (SELECT count(*) AS n, avg(len(ts)) AS av FROM dt),
   tf AS (SELECT label, len(ts) AS dl, t, count(*) AS tf FROM (SELECT label, ts, unnest(ts) AS t FROM dt) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
   w AS (SELECT label, t, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av)) AS w FROM tf JOIN df USING (t), co)"""


def tokens(column="text"):
    return T.keep_tokens(F.col(column), STOP)


@query(
    "bm25",
    f"""WITH {BM}, q AS (SELECT conv_id * 100 + turn AS query, unnest({TOK.format('text')}) AS t FROM conversations)
        SELECT query, label, round(sum(w), 6) AS score FROM q JOIN w USING (t) GROUP BY query, label""",
)
def bm25(spark, d):
    asked = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("query"), tokens().alias("tokens"))
    entries = benchmark(spark, d).select("label", tokens().alias("tokens"))
    return R.bm25(asked, entries).withColumn("score", F.round("score", 6))


@query(
    "bm25_topk",
    f"""WITH {BM}, q AS (SELECT conv_id * 100 + turn AS query, unnest({TOK.format('text')}) AS t FROM conversations),
        s AS (SELECT query, label, sum(w) AS score FROM q JOIN w USING (t) GROUP BY query, label)
        SELECT query, label, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 10) DESC, label) AS rank FROM s QUALIFY rank <= 3""",
)
def bm25_topk(spark, d):
    asked = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("query"), tokens().alias("tokens"))
    return R.bm25(asked, benchmark(spark, d).select("label", tokens().alias("tokens")), k=3).withColumn("score", F.round("score", 6))


TOP5 = SIM + ", t5 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) AS rank FROM sm QUALIFY rank <= 5)"


@query("vote", f"WITH {TOP5} SELECT query, prim AS label, round(sum(sim * p), 6) AS score FROM t5 WHERE prim <> -1 GROUP BY ALL")
def vote(spark, d):
    return R.vote(queries(spark, d), index(spark, d)).withColumn("score", F.round("score", 6))


# label profiles: the sum of each label's vectors, normalised
PF = """pf AS (SELECT label, list_transform(t, lambda x: x / sqrt(list_dot_product(t, t))) AS u FROM (
   SELECT label, list(s ORDER BY i) AS t FROM (SELECT label, i, sum(x) AS s FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vi) GROUP BY ALL) GROUP BY label)),
   ps AS (SELECT query, qt, label, round(list_dot_product(qv, u), 10) AS s FROM qu, pf)"""


def profiles(spark, d):
    from pyspark.ml.functions import array_to_vector

    v = VQ.items(spark, d).withColumn("__v", array_to_vector("vector"))
    return v.groupBy("label").agg(P.vector_sum("__v").alias("t")).select("label", V.l2_normalise("t").alias("profile"))


@query(
    "z_fusion",
    f"""WITH {TOP5}, {PF}, {BM}, vt AS (SELECT query, prim AS label, sum(sim * p) AS s FROM t5 WHERE prim <> -1 GROUP BY ALL),
        qk AS (SELECT query, unnest({TOK.format('qt')}) AS t FROM qu), bs AS (SELECT query, label, sum(w) AS s FROM qk JOIN w USING (t) GROUP BY ALL),
        g AS (SELECT ps.query, ps.label, ps.s AS a, coalesce(bs.s, 0) AS b, coalesce(vt.s, 0) AS c FROM ps LEFT JOIN bs USING (query, label) LEFT JOIN vt USING (query, label))
        SELECT query, label, round(coalesce((a - avg(a) OVER o) / nullif(stddev_pop(a) OVER o, 0), 0) + coalesce((b - avg(b) OVER o) / nullif(stddev_pop(b) OVER o, 0), 0)
          + coalesce((c - avg(c) OVER o) / nullif(stddev_pop(c) OVER o, 0), 0), 5) AS combined FROM g WINDOW o AS (PARTITION BY query)""",
)
def z_fusion(spark, d):
    q, ix = queries(spark, d), index(spark, d)
    pf = profiles(spark, d)
    scored, labels = R.label_scores(q.select("query", "vector"), pf.withColumnRenamed("profile", "vector"))
    place = F.array(*map(F.lit, labels))
    grid = scored.select("query", F.posexplode("scores").alias("i", "profile")).select(
        "query", F.get(place, F.col("i")).alias("label"), "profile"
    )
    words = R.bm25(q.select("query", tokens().alias("tokens")), benchmark(spark, d).select("label", tokens().alias("tokens")))
    grid = grid.join(words.withColumnRenamed("score", "bm25"), ["query", "label"], "left")
    grid = grid.join(R.vote(q, ix).withColumnRenamed("score", "vote"), ["query", "label"], "left").fillna(0.0, ["bm25", "vote"])
    return R.z_fusion(grid, ["profile", "bm25", "vote"]).select("query", "label", F.round("combined", 5).alias("combined"))


# text matches: word 5-grams of the query against the catalogue (labels are benchmark rows)
RK = f"""{grams_sql('qg', '(SELECT query, qt AS text FROM qu)', 'query', 5)}, {grams_sql('bg', 'benchmark', 'item_id', 5)}, sz AS (SELECT item_id, count(*) AS n FROM bg GROUP BY 1),
   mx AS (SELECT query, item_id::INT AS label, count(*) / any_value(n) AS score FROM qg JOIN bg USING (g) JOIN sz USING (item_id) GROUP BY ALL HAVING count(*) / any_value(n) >= 0.9),
   tt AS (SELECT query, qt, regexp_replace(qt, '([^\\d.])', '\\1\\1', 'g') AS dq FROM qu),
   rx AS (SELECT query, list_concat(regexp_extract_all(dq, '(?:^|[^\\d.])2\\s*(?:\\.|::)\\s*(\\d{{1,2}})(?:$|[^\\d.])', 1), regexp_extract_all(qt, '(?i)\\b(?:verse|shloka|sloka|śloka)\\s+(\\d{{1,2}})\\b', 1)) AS f FROM tt),
   rf AS (SELECT query, unnest(f)::INT AS label, generate_subscripts(f, 1) AS o FROM rx),
   al AS (SELECT query, label, 0 AS src, o::DOUBLE AS o FROM rf WHERE label BETWEEN 1 AND 9
          UNION ALL SELECT mx.query, mx.label, 1, -score FROM mx JOIN tt USING (query) WHERE label <= 9 AND len(regexp_extract_all(regexp_replace(regexp_replace(qt, '2\\.\\d+', ' ', 'g'), '(?i)verse\\s+\\d+', ' ', 'g'), '\\p{{L}}')) >= 15
          UNION ALL SELECT query, label, 2, -s FROM ps),
   mn AS (SELECT query, label, min(src * 1000.0 + o) AS k FROM al GROUP BY ALL),
   rk AS (SELECT query, label, CASE WHEN k < 500 THEN 'reference' WHEN k < 1500 THEN 'match' ELSE 'profile' END AS how, row_number() OVER (PARTITION BY query ORDER BY k, label) AS rank FROM mn)"""
FULL = SIM + ", " + PF + ", " + RK


def ranked(spark, d):
    q, pf = queries(spark, d), profiles(spark, d)
    items = q.select("query", "text")
    matches = M.ngram_match(items, benchmark(spark, d), "query")
    return R.rank_labels(q, pf, matches)


@query("rank_labels", f"WITH {FULL} SELECT query, label, how, rank FROM rk")
def rank_labels(spark, d):
    return ranked(spark, d).select("query", "label", "how", F.col("rank").cast("long").alias("rank"))


HY = f"""cv AS (SELECT DISTINCT prim AS label FROM ix WHERE prim <> -1), tl AS (SELECT query, min_by(label, rank) AS label FROM rk JOIN cv USING (label) GROUP BY query),
   cs AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) AS r FROM sm QUALIFY r <= 5),
   ow AS (SELECT sm.query, item, row_number() OVER (PARTITION BY sm.query ORDER BY round(sim * p, 10) DESC, item) AS r FROM sm JOIN tl ON tl.query = sm.query AND tl.label = sm.prim QUALIFY r <= 5),
   un AS (SELECT query, item, 0 AS src, r FROM cs WHERE r <= 2 UNION ALL SELECT query, item, 1, r FROM ow UNION ALL SELECT query, item, 2, r FROM cs),
   de AS (SELECT query, item, min(src * 100 + r) AS k FROM un GROUP BY ALL),
   hy AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY k) AS rank FROM de QUALIFY rank <= 5)"""


@query("hybrid_topk", f"WITH {FULL}, {HY} SELECT query, item, rank, label FROM hy JOIN tl USING (query)")
def hybrid_topk(spark, d):
    items, top = R.hybrid_topk(queries(spark, d), index(spark, d), ranked(spark, d))
    return items.join(top, "query").select("query", "item", F.col("rank").cast("long").alias("rank"), "label")


@query(
    "split_topk",
    f"""WITH {FULL}, {HY}, tw AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM rk JOIN cv USING (label) QUALIFY place <= 2),
        pl AS (SELECT sm.query, item, place, row_number() OVER (PARTITION BY sm.query, sm.prim ORDER BY round(sim * p, 10) DESC, item) AS r FROM sm JOIN tw ON tw.query = sm.query AND tw.label = sm.prim),
        u2 AS (SELECT query, item, place AS src, r FROM pl WHERE r <= CASE place WHEN 1 THEN 3 ELSE 2 END UNION ALL SELECT query, item, 3, r FROM cs),
        d2 AS (SELECT query, item, min(src * 100 + r) AS k FROM u2 GROUP BY ALL)
        SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY k) AS rank FROM d2 QUALIFY rank <= 5""",
)
def split_topk(spark, d):
    out = R.split_topk(queries(spark, d), index(spark, d), ranked(spark, d))
    return out.select("query", "item", F.col("rank").cast("long").alias("rank"))


AB = """ab AS (SELECT rk.query, NOT bool_or(how <> 'profile') AND max(s) < 0.62 AS abstained FROM rk JOIN ps USING (query) GROUP BY rk.query)"""


@query("abstain", f"WITH {FULL}, {AB} SELECT * FROM ab")
def abstain(spark, d):
    return R.abstain(ranked(spark, d), 0.62)


@query(
    "answer",
    f"""WITH {FULL}, {HY}, {AB}, fs AS (SELECT rk.query, rk.label AS first, how, cv.label IS NOT NULL AS has FROM rk LEFT JOIN cv USING (label) WHERE rank = 1),
        ca AS (SELECT query, first, tl.label AS top, CASE WHEN abstained THEN 'abstained' WHEN how <> 'profile' AND NOT has THEN 'not covered' WHEN how = 'reference' THEN 'reference'
                 WHEN tl.label <> first THEN 'other label' ELSE '' END AS note FROM fs JOIN ab USING (query) LEFT JOIN tl USING (query)),
        bp AS (SELECT prim, item, row_number() OVER (PARTITION BY prim ORDER BY p DESC, item) AS rank FROM ix WHERE prim <> -1 QUALIFY rank <= 5),
        it AS (SELECT query, item, rank FROM ca JOIN bp ON bp.prim = ca.first WHERE note = 'reference' UNION ALL SELECT ca.query, item, rank FROM ca JOIN hy ON hy.query = ca.query WHERE note IN ('', 'other label')),
        li AS (SELECT query, string_agg(item, ',' ORDER BY rank) AS items FROM it GROUP BY query)
        SELECT ca.query, CASE WHEN note IN ('abstained', 'not covered') THEN NULL WHEN note = 'reference' THEN first ELSE top END AS label, note, items FROM ca LEFT JOIN li USING (query)""",
)
def answer(spark, d):
    out = R.answer(queries(spark, d), index(spark, d), ranked(spark, d), 0.62)
    return out.select("query", "label", "note", F.array_join("items", ",").alias("items"))


@query(
    "route_then_search",
    f"""WITH {SIM}, rt AS (SELECT query, unnest([query % 10, (query + 4) % 10, query % 17])::INT AS label FROM qu), r1 AS (SELECT DISTINCT * FROM rt),
        cs AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) AS r FROM sm QUALIFY r <= 5),
        ro AS (SELECT sm.query, item, row_number() OVER (PARTITION BY sm.query ORDER BY sim DESC, item) AS r FROM sm JOIN r1 ON r1.query = sm.query AND r1.label = sm.prim QUALIFY r <= 5),
        de AS (SELECT query, item, min(k) AS k FROM (SELECT query, item, r AS k FROM ro UNION ALL SELECT query, item, 100 + r FROM cs) GROUP BY ALL)
        SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY k) AS rank FROM de QUALIFY rank <= 5""",
)
def route_then_search(spark, d):
    q = queries(spark, d)
    out, _ = R.route_then_search(q, index(spark, d), routes(q))
    return out.select("query", "item", F.col("rank").cast("long").alias("rank"))


def routes(q):
    picks = F.expr("array(query % 10, (query + 4) % 10, query % 17)")
    return q.select("query", F.explode(picks.cast("array<int>")).alias("label")).distinct()


@query(
    "routes_not_indexed",
    f"""WITH {IX}, {QU}, rt AS (SELECT DISTINCT query, unnest([query % 10, (query + 4) % 10, query % 17])::INT AS label FROM qu)
        SELECT qu.query, count(rt.label) FILTER (WHERE rt.label NOT IN (SELECT prim FROM ix)) AS not_indexed FROM qu LEFT JOIN rt USING (query) GROUP BY qu.query""",
)
def routes_not_indexed(spark, d):
    q = queries(spark, d)
    return R.route_then_search(q, index(spark, d), routes(q))[1]


def bag_vector(s):
    """A small bag-of-words vector, enough to compare sentences."""
    words = F.filter(F.split(T.fold_text(s), " "), lambda w: w != "")
    slots = F.transform(words, lambda w: (F.length(w) * 7 + F.ascii(w)) % 16)
    counts = F.aggregate(
        slots, F.array_repeat(F.lit(0.0), 16), lambda acc, x: F.transform(acc, lambda v, i: v + F.when(i == x, 1.0).otherwise(0.0))
    )
    return V.l2_normalise(counts)


@query("extractive")
def extractive(spark, d):
    conv = table(spark, d, "conversations")
    asked = conv.filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query"), "conv_id", "turn", "text")
    replies = conv.filter("role <> 'user'").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("item"), "text")
    retrieved = asked.drop("text").join(replies.withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"]).select("query", "item", "text")
    vectors = asked.select("query", bag_vector(F.col("text")).alias("vector"))
    out = R.extractive(retrieved, vectors, bag_vector)
    return out.select("query", "item", F.md5("sentence").alias("sentence"), F.round("score", 6).alias("score"), "rank")


# ---- reports -------------------------------------------------------------------------------


@query(
    "related",
    f"""WITH {IX}, p AS (SELECT prim, unnest(secondary) AS s FROM ix WHERE prim <> -1)
        SELECT label, other, count(*) AS n FROM (SELECT prim AS label, s AS other FROM p UNION ALL SELECT s, prim FROM p) GROUP BY ALL""",
)
def related(spark, d):
    return R.related(index(spark, d))


SEG = IX + """, rn AS (SELECT *, sum(nw) OVER (PARTITION BY seq ORDER BY pos) AS run FROM (SELECT *, (prim IS DISTINCT FROM lag(prim) OVER (PARTITION BY seq ORDER BY pos) OR pos = 0)::INT AS nw FROM ix)),
   sg AS (SELECT seq, run, any_value(prim) AS prim, any_value(speaker) AS speaker, any_value(tradition) AS tradition, count(*) AS dwell, sum(p) AS ed, min(item) AS first_unit FROM rn GROUP BY seq, run)"""


def indexed_segments(spark, d):
    rows = index(spark, d).withColumnsRenamed({"item": "unit"}).withColumn("n_words", F.lit(1))
    seg = S.segments(rows, p="p")
    where = rows.select("seq", "speaker", "tradition").distinct()
    return seg.join(where, "seq")


@query(
    "coverage",
    f"""WITH {SEG}, dp AS (SELECT prim AS label, speaker, tradition, count(*) AS segments, sum(dwell)::BIGINT AS items, max(ed) AS deepest FROM sg WHERE prim <> -1 GROUP BY ALL),
        pa AS (SELECT label, speaker, tradition, count(*) AS passing FROM (SELECT speaker, tradition, prim, unnest(secondary) AS label FROM ix) WHERE prim <> label GROUP BY ALL)
        SELECT label, speaker, tradition, coalesce(segments, 0) AS segments, coalesce(items, 0) AS items, round(deepest, 6) AS deepest, coalesce(passing, 0) AS passing
        FROM dp FULL JOIN pa USING (label, speaker, tradition)""",
)
def coverage(spark, d):
    out = R.coverage(index(spark, d), indexed_segments(spark, d))
    return out.withColumn("deepest", F.round("deepest", 6))


@query(
    "coverage_ordered",
    f"""WITH {SEG}, dp AS (SELECT prim AS label, speaker, tradition, max(ed) AS deepest FROM sg WHERE prim <> -1 GROUP BY ALL),
        pa AS (SELECT DISTINCT label, speaker, tradition FROM (SELECT speaker, tradition, prim, unnest(secondary) AS label FROM ix) WHERE prim <> label)
        SELECT label, speaker, tradition, round(deepest, 6) AS deepest, CASE tradition WHEN 't2' THEN 1 ELSE 2 END AS place FROM dp FULL JOIN pa USING (label, speaker, tradition) WHERE tradition IN ('t2', 't0')""",
)
def coverage_ordered(spark, d):
    cover = R.coverage(index(spark, d), indexed_segments(spark, d))
    out = R.ordered_coverage(cover, ["t2"], keep=["t2", "t0"])
    return out.select("label", "speaker", "tradition", F.round("deepest", 6).alias("deepest"), "place")


@query("segment_items", f"WITH {SEG} SELECT rn.seq, rn.run::BIGINT AS run, rn.pos, rn.item, sg.first_unit, sg.dwell FROM rn JOIN sg ON sg.seq = rn.seq AND sg.run = rn.run")
def segment_items(spark, d):
    rows = index(spark, d).withColumns({"n_words": F.lit(1), "unit": F.col("item")})
    indexed = S.index_rows(rows)
    return R.segment_items(indexed, indexed_segments(spark, d))


@query("browse", f"WITH {IX}, th AS (SELECT DISTINCT label, label // 3 AS theme FROM vi) SELECT th.label, theme::BIGINT AS theme, count(DISTINCT seq) AS sequences FROM th LEFT JOIN ix ON ix.prim = th.label GROUP BY ALL")
def browse(spark, d):
    themes = VQ.items(spark, d).select("label").distinct().withColumn("theme", F.floor(F.col("label") / 3))
    return R.browse(index(spark, d), themes)


@query(
    "speaker_alias",
    """WITH s AS (SELECT n_regionkey AS speaker, CASE WHEN n_regionkey = 2 THEN '' WHEN n_regionkey IN (0, 1) THEN 'name ' || n_regionkey ELSE n_name END AS name FROM nation)
       SELECT speaker, max(name) AS name FROM s GROUP BY speaker HAVING count(DISTINCT name) = 1 AND max(name) <> ''""",
)
def speaker_alias(spark, d):
    name = F.when(F.col("n_regionkey") == 2, " ").when(F.col("n_regionkey") < 2, F.concat(F.lit("name "), F.col("n_regionkey").cast("string"))).otherwise(F.col("n_name"))
    return R.speaker_alias(table(spark, d, "nation").select(F.col("n_regionkey").alias("speaker"), name.alias("name")))


@query(
    "ground_time",
    f"""WITH {TOP5}, ts AS (SELECT seq, label, min(pos) * 30.5 AS start_sec, max(pos) * 30.5 + 30 AS end_sec FROM vi GROUP BY ALL HAVING count(*) > 3)
        SELECT query, item, t5.seq, prim AS label, round(start_sec, 1)::DOUBLE AS start_sec, round(end_sec, 1)::DOUBLE AS end_sec,
          row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) AS citation FROM t5 JOIN ts ON ts.seq = t5.seq AND ts.label = t5.prim QUALIFY citation <= 3""",
)
def ground_time(spark, d):
    ix = index(spark, d)
    stamps = VQ.items(spark, d).groupBy("seq", "label").agg(
        (F.min("pos") * 30.5).alias("start_sec"), (F.max("pos") * 30.5 + 30).alias("end_sec"), F.count(F.lit(1)).alias("n")
    ).filter("n > 3").drop("n")
    hits = R.topk_cosine(queries(spark, d), ix, 5).join(ix.select("item", "seq", F.col("primary").alias("label")), "item")
    out = R.ground_time(hits, stamps)
    return out.select("query", "item", "seq", "label", F.round("start_sec", 1).alias("start_sec"), F.round("end_sec", 1).alias("end_sec"), F.col("citation").cast("long").alias("citation"))


@query("sources", "SELECT lang, source, count(*) AS items, count(DISTINCT doc_id % 7) AS sequences FROM documents GROUP BY ALL")
def sources(spark, d):
    rows = table(spark, d, "documents").withColumn("seq", F.col("doc_id") % 7)
    return R.sources(rows, ["lang", "source"])


@query(
    "hit_labels",
    f"""WITH {TOP5}, r AS (SELECT query, CASE WHEN len(secondary) > 0 THEN 'L' || prim || ', L' || secondary[1] ELSE 'L' || prim END AS refs FROM t5)
        SELECT DISTINCT query, trim(unnest(string_split(refs, ','))) AS label FROM r""",
)
def hit_labels(spark, d):
    ix = index(spark, d)
    hits = R.topk_cosine(queries(spark, d), ix, 5).join(ix.select("item", "primary", "secondary"), "item")
    label = F.concat(F.lit("L"), F.col("primary").cast("string"))
    both = F.concat(label, F.lit(", L"), F.get("secondary", F.lit(0)).cast("string"))
    return R.hit_labels(hits.withColumn("refs", F.when(F.size("secondary") > 0, both).otherwise(label)))


# ---- one query through all stages ------------------------------------------------------------


@query(
    "coverage_end_to_end",
    f"""WITH {NGRAM_SQL}, wn AS (SELECT source, d.doc_id, row_number() OVER (PARTITION BY source ORDER BY d.doc_id) - 1 AS pos, an.label, n_chars FROM documents d
          LEFT JOIN (SELECT doc_id, label FROM an QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1) an ON an.doc_id = d.doc_id),
        la AS (SELECT *, last_value(CASE WHEN label IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY source ORDER BY pos) AS ap FROM wn),
        hd AS (SELECT la.source, la.pos, la.doc_id, la.n_chars, CASE WHEN la.pos - ap <= 3 THEN a.label ELSE -1 END AS prim FROM la LEFT JOIN wn a ON a.source = la.source AND a.pos = la.ap),
        h2 AS (SELECT source, pos, doc_id, n_chars, coalesce(prim, -1) AS prim FROM hd),
        rn AS (SELECT *, sum(nw) OVER (PARTITION BY source ORDER BY pos) AS run FROM (SELECT *, (prim IS DISTINCT FROM lag(prim) OVER (PARTITION BY source ORDER BY pos) OR pos = 0)::INT AS nw FROM h2)),
        sg AS (SELECT source, run, any_value(prim) AS prim, count(*) AS dwell, sum(n_chars) AS chars FROM rn GROUP BY source, run)
        SELECT prim AS label, source, count(*) AS segments, sum(dwell)::BIGINT AS items, sum(chars)::BIGINT AS chars FROM sg WHERE prim <> -1 GROUP BY ALL""",
)
def coverage_end_to_end(spark, d):
    """Documents of a source are its items: match, carry over three items, segment, roll up."""
    from passages.operators.scan import ordinal

    placed = ordinal(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"])
    anchors = M.best_anchor(M.ngram_match(docs(spark, d), benchmark(spark, d)))
    items = placed.join(anchors, "doc_id", "left").select(
        F.col("source").alias("seq"), "pos", F.col("doc_id").alias("unit"), F.col("n_chars").alias("n_words"),
        F.array_compact(F.array("label")).alias("anchors"),
    )
    held = S.carry(items, max_gap=3).withColumn("primary", F.coalesce(F.get("held", F.lit(0)), F.lit(R.OFF)))
    seg = S.segments(held.withColumn("p", F.lit(1.0)), p="p").filter(F.col("primary") != R.OFF)
    return seg.groupBy(F.col("primary").alias("label"), F.col("seq").alias("source")).agg(
        F.count(F.lit(1)).alias("segments"), F.sum("dwell").alias("items"),
        F.sum(F.col("word_end") - F.col("word_start")).alias("chars"),
    )
