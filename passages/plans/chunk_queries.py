"""Chunkers over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.functions import text as T
from passages.operators import chunk as C
from passages.operators.replies import parse_answer_lines
from passages.operators.table_functions import register
from passages.plans.registry import documents, query, table
from passages.plans.text_queries import MENTIONED, WORDS_SQL


def docs(spark, d):
    return documents(spark, d, "doc_id", "text")


def timed(spark, d, seconds=20.0):
    """Documents with their lines as segments of equal length in time."""
    segments = F.transform(
        F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""),
        lambda x, i: F.struct(
            (i * F.lit(seconds)).alias("start"), ((i + 1) * F.lit(seconds)).alias("end"), F.trim(x).alias("text")
        ),
    )
    return docs(spark, d).select("doc_id", F.explode(F.array(segments)).alias("segments"))


LINES_SQL = """l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls
                     FROM documents)"""


# letter by letter: a sentence is a run without [.?] and the mark behind it, a mark behind a mark belongs to none; words are runs inside a sentence
PACKED_SQL = """WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
   ch AS (SELECT doc_id, i - 1 AS i, substr(t, i, 1) AS c FROM t, unnest(range(1, length(t) + 1)) AS r(i)),
   cl AS (SELECT *, c IN ('.', '?') AS mark, regexp_matches(c, '\\s') AS gap, coalesce(lag(c) OVER w IN ('.', '?'), true) AS after FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
   sn AS (SELECT *, coalesce(sum((mark AND NOT after)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM cl),
   wd AS (SELECT *, NOT coalesce(lag(i) OVER w = i - 1 AND lag(sid) OVER w = sid, false) AS first FROM sn WHERE NOT gap AND NOT (mark AND after) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
   wn AS (SELECT *, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY i) AS word FROM wd),
   w AS (SELECT doc_id, sid, word, min(i) AS a, max(i) + 1 AS b FROM wn GROUP BY 1, 2, 3),
   k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sid ORDER BY word) - 1 AS nth, count(*) OVER (PARTITION BY doc_id, sid) AS n FROM w),
   sp AS (SELECT doc_id, sid, CASE WHEN n > 200 THEN nth // 100 ELSE 0 END AS part, min(a) AS a, max(b) AS b, count(*) AS n FROM k GROUP BY 1, 2, 3),
   o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sid, part) AS i FROM sp),
   g AS (SELECT doc_id, i, n AS total, 0 AS pos FROM o WHERE i = 1
         UNION ALL SELECT o.doc_id, o.i, CASE WHEN g.total >= 100 THEN 0 ELSE g.total END + o.n, g.pos + (g.total >= 100)::INT FROM g JOIN o ON o.doc_id = g.doc_id AND o.i = g.i + 1),
   p AS (SELECT doc_id, pos, min(a) AS a, max(b) AS b, sum(n) AS n FROM g JOIN o USING (doc_id, i) GROUP BY 1, 2)
   SELECT doc_id, pos::INT AS pos, a::INT AS char_start, b::INT AS char_end, n::INT AS n_words, md5(substr(t, a::INT + 1, (b - a)::INT)) AS text FROM p JOIN t USING (doc_id)"""


@query("pack_sentences", PACKED_SQL)
def pack_sentences(spark, d):
    out = C.pack_sentences(docs(spark, d))
    return out.select("doc_id", "pos", "char_start", "char_end", "n_words", F.md5("text").alias("text"))


@query(
    "pack_sentences_cover",
    """SELECT doc_id, length(regexp_replace(regexp_replace(text, '[.?]', '', 'g'), '\\s', '', 'g')) AS letters FROM documents
       WHERE regexp_matches(text, '[^.?\\s]')""",
)
def pack_sentences_cover(spark, d):
    """No letter is lost or doubled by the packing."""
    letters = F.length(F.regexp_replace("text", r"[.?\s]", ""))
    return C.pack_sentences(docs(spark, d)).groupBy("doc_id").agg(F.sum(letters).alias("letters")).filter("letters > 0")


@query("sentence_passages", PACKED_SQL)
def sentence_passages(spark, d):
    """The same through SQL: a table function with a lateral join."""
    register(spark)
    docs(spark, d).createOrReplaceTempView("packed_documents")
    return spark.sql("SELECT d.doc_id, p.pos, p.char_start, p.char_end, p.n_words, md5(p.passage) AS text FROM packed_documents d, LATERAL sentence_passages(d.text, 100) p")


@query("pack_segments")
def pack_segments(spark, d):
    out = C.pack_segments(timed(spark, d))
    return out.select(
        "doc_id", "pos", "char_start", "char_end", "time_start", "time_end", "n_words", F.md5("text").alias("text")
    )


@query(
    "word_windows",
    f"""WITH w AS (SELECT doc_id, {WORDS_SQL.format('text')} AS ws FROM documents),
        s AS (SELECT doc_id, ws, unnest(range(0, len(ws), 225)) AS word_start FROM w)
        SELECT doc_id, word_start, least(300, len(ws) - word_start) AS n_words, md5(array_to_string(ws[word_start + 1:word_start + 300], ' ')) AS text
        FROM s WHERE least(300, len(ws) - word_start) >= 50""",
)
def word_windows(spark, d):
    out = C.word_windows(docs(spark, d), 300, 75, 50)
    return out.select("doc_id", "word_start", "n_words", F.md5("text").alias("text"))


@query(
    "char_windows",
    """WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS char_start FROM documents),
       c AS (SELECT doc_id, char_start, regexp_replace(substring(text, char_start + 1, 1200), '^\\s+|\\s+$', '', 'g') AS t FROM s)
       SELECT doc_id, char_start, length(t) AS n_chars, md5(t) AS text FROM c WHERE t <> ''""",
)
def char_windows(spark, d):
    out = C.char_windows(docs(spark, d))
    return out.select("doc_id", "char_start", F.length("text").alias("n_chars"), F.md5("text").alias("text"))


@query(
    "time_merge",
    f"""WITH {LINES_SQL}, e AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM l),
        g AS (SELECT doc_id, i, line, CASE WHEN n % 4 = 1 AND i = n - 1 AND i > 0 THEN i // 4 - 1 ELSE i // 4 END AS pos FROM e)
        SELECT doc_id, pos, min(i) * 20.0::DOUBLE AS "start", (max(i) + 1) * 20.0::DOUBLE AS "end", md5(string_agg(line, ' ' ORDER BY i)) AS text
        FROM g GROUP BY doc_id, pos""",
)
def time_merge(spark, d):
    return C.time_merge(timed(spark, d)).select("doc_id", "pos", "start", "end", F.md5("text").alias("text"))


def mentioned(spark, d):
    t = documents(spark, d).select("doc_id", F.expr(MENTIONED).alias("text"))
    return t.withColumn("mentions", T.mentions(F.col("text")))


@query("boundary_chunks_merge")
def boundary_chunks_merge(spark, d):
    out = C.boundary_chunks(mentioned(spark, d), min_words=20, max_words=100, overlap=20)
    return out.select("doc_id", "kind", "char_start", "part", F.array_join("labels", ",").alias("labels"), F.md5("text").alias("text"))


@query("boundary_chunks_drop")
def boundary_chunks_drop(spark, d):
    out = C.boundary_chunks(mentioned(spark, d), short="drop", min_words=80, overlap=50, fallback_min=1)
    return out.select("doc_id", "kind", "char_start", "part", F.array_join("labels", ",").alias("labels"), F.md5("text").alias("text"))


@query(
    "pos_to_time",
    f"""WITH {LINES_SQL}, e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM l),
        b AS (SELECT doc_id, i, length(line) AS n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM e),
        t AS (SELECT doc_id, max(a + n) AS total, (max(i) + 1) * 20.0 AS last FROM b GROUP BY doc_id),
        p AS (SELECT doc_id, unnest(range(0, total::BIGINT + 500, 500)) AS point, last FROM t)
        SELECT p.doc_id, point, round(coalesce((i * 20.0 + (point - a) / greatest(1, n) * 20.0), last)::DOUBLE, 6) AS seconds
        FROM p LEFT JOIN b ON p.doc_id = b.doc_id AND a <= point AND point < a + n""",
)
def pos_to_time(spark, d):
    t = timed(spark, d).filter(F.size("segments") > 0)
    segments = t.select("doc_id", F.posexplode("segments").alias("pos", "s")).select("doc_id", "pos", "s.*")
    total = t.select("doc_id", F.length(F.array_join(F.transform("segments", lambda s: s["text"]), " ")).alias("n"))
    points = total.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") + 499) / 500).cast("int") * 500, F.lit(500))).alias("point"))
    return C.pos_to_time(points, segments).select("doc_id", "point", F.round("seconds", 6).alias("seconds"))


@query(
    "density_windows",
    """WITH w AS (SELECT doc_id, text, unnest(range(0, length(text) - 80, 20)) AS a FROM documents),
       s AS (SELECT doc_id, a, a + 80 AS b, greatest(0.0, least(1.0, len(regexp_extract_all(substring(text, a + 1, 80), 'th|er')) / 80.0
                    - least(0.15, 0.03 * (contains(substring(text, a + 1, 80), 'que')::INT + contains(substring(text, a + 1, 80), 'und')::INT)))) AS dens FROM w),
       h AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 20 THEN 0 ELSE 1 END AS new
             FROM s WHERE dens >= 0.11),
       r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM h)
       SELECT doc_id, min(a) AS "start", max(b) AS "end", round(max(dens), 6) AS density FROM r GROUP BY doc_id, run""",
)
def density_windows(spark, d):
    def density(s):
        return T.foreign_density(s, "th|er", ["que", "und"])

    out = docs(spark, d).select("doc_id", F.inline_outer(C.density_windows(F.col("text"), density, threshold=0.11)))
    return out.filter("start IS NOT NULL").withColumn("density", F.round("density", 6))


CUES = {"intro_marker": (" on the ",), "closing_marker": (" and ",), "shloka_marker": (" of ", r"\bque ")}


@query(
    "cues",
    """WITH m AS (SELECT doc_id, p, k, unnest(regexp_extract_all(text, p)) AS hit,
                         unnest(list_slice(regexp_split_to_array(text, p), 1, len(regexp_extract_all(text, p)))) AS piece,
                         generate_subscripts(regexp_extract_all(text, p), 1) AS i
                  FROM documents, (VALUES (' on the ', 'intro_marker'), (' and ', 'closing_marker'), (' of ', 'shloka_marker')) v(p, k))
       SELECT doc_id, k AS type, (sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id, p ORDER BY i))::BIGINT AS "end" FROM m""",
)
def cues(spark, d):
    patterns = {"intro_marker": (" on the ",), "closing_marker": (" and ",), "shloka_marker": (" of ",)}
    found = docs(spark, d).select("doc_id", F.inline(T.cues(F.col("text"), patterns)))
    return found.select("doc_id", "type", "end")


@query("detection_chunks")
def detection_chunks(spark, d):
    t = docs(spark, d)
    hits = F.transform(
        T.positions(F.col("text"), " on the "),
        lambda x: F.struct(x["pos"].alias("start"), (x["pos"] + 150).alias("end"), (x["pos"] % 72 + 1).alias("label")),
    )
    closings = F.transform(T.positions(F.col("text"), " and "), lambda x: x["pos"])
    out = C.detection_chunks(t.withColumns({"hits": hits, "closings": closings}))
    return out.select("doc_id", "kind", "label", "start", "end", F.md5("text").alias("text"))


@query(
    "span_between",
    """WITH k AS (SELECT doc_id, text, regexp_split_to_array(text, '\\s+') AS ws FROM documents),
       w AS (SELECT doc_id, text, ws[10:12] AS a, ws[60:62] AS b FROM k),
       p AS (SELECT doc_id, text, array_to_string(list_transform(a, lambda x: regexp_escape(x)), '.*?') AS pa,
                    array_to_string(list_transform(b, lambda x: regexp_escape(x)), '.*?') AS pb FROM w),
       s AS (SELECT *, CASE WHEN regexp_extract(text, pa) = '' THEN NULL ELSE strpos(text, regexp_extract(text, pa)) END AS start FROM p),
       r AS (SELECT *, substring(text, start + 100) AS rest FROM s WHERE start IS NOT NULL),
       e AS (SELECT doc_id, text, start, CASE WHEN regexp_extract(rest, pb) = '' THEN 2000 ELSE strpos(rest, regexp_extract(rest, pb)) - 1 + 100 END AS n FROM r)
       SELECT d.doc_id, md5(regexp_replace(substring(e.text, start, n), '^\\s+|\\s+$', '', 'g')) AS span FROM documents d LEFT JOIN e USING (doc_id)""",
)
def span_between(spark, d):
    """A text too short for the second key reaches to its end, one too short for the first has no span."""
    t = docs(spark, d).withColumn("ws", F.split("text", r"\s+"))
    key = F.array_join(F.slice("ws", 10, 3), " ")
    following = F.array_join(F.slice("ws", 60, 3), " ")
    return t.select("doc_id", F.md5(C.span_between(F.col("text"), key, following)).alias("span"))


REPLY_SPARK = """concat_ws('\n', '`P001|2.' || (conv_id % 80) || ';2.' || (turn + 3) || '`', 'P002\t2.' || (conv_id % 71 + 1) || ', 3.4',
    'P001 2.9', 'P00' || (turn % 4 + 2) || ': NONE', 'P777|2.1', role || ' says no')"""
REPLY_SQL = REPLY_SPARK.replace("'\n'", "chr(10)").replace("'P002\t2.'", "'P002' || chr(9) || '2.'")


def replies(spark, d):
    c = table(spark, d, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    ids = c.select(key.alias("reply_id"), F.explode(F.array(*map(F.lit, ("P001", "P002", "P003", "P004")))).alias("item"))
    return parse_answer_lines(c.select(key.alias("reply_id"), F.expr(REPLY_SPARK).alias("text")), ids)


REPLIES_SQL = f"""r AS (SELECT conv_id || '-' || turn AS reply_id, {REPLY_SQL} AS text FROM conversations),
   x AS (SELECT reply_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM r),
   p AS (SELECT reply_id, no, trim(raw, '` ') AS line FROM x),
   q AS (SELECT reply_id, no, line, regexp_extract(line, '^(P\\d{{3}})[\\t |:]+(.+)$', 1) AS item, regexp_extract(line, '^(P\\d{{3}})[\\t |:]+(.+)$', 2) AS body FROM p),
   i AS (SELECT reply_id, unnest(['P001', 'P002', 'P003', 'P004']) AS item FROM r),
   k AS (SELECT *, row_number() OVER (PARTITION BY reply_id, item ORDER BY no) AS rn FROM q WHERE item IN ('P001', 'P002', 'P003', 'P004')),
   t AS (SELECT reply_id, item, list_filter(regexp_split_to_array(trim(body), '[;,\\s]+'), lambda w: w <> '' AND upper(w) <> 'NONE') AS ws FROM k WHERE rn = 1),
   n AS (SELECT reply_id, item, ws, list_filter(list_transform(ws, lambda w: TRY_CAST(regexp_extract(w, '^2\\.(\\d{{1,2}})$', 1) AS INT)), lambda v: v BETWEEN 1 AND 72) AS labels FROM t)"""


@query(
    "answer_lines",
    f"""WITH {REPLIES_SQL} SELECT i.reply_id, i.item, CASE WHEN n.item IS NULL THEN 'missing' ELSE array_to_string(n.labels, ';') END AS labels
        FROM i LEFT JOIN n USING (reply_id, item)""",
)
def answer_lines(spark, d):
    labels, _ = replies(spark, d)
    return labels.select("reply_id", "item", F.coalesce(F.array_join("labels", ";"), F.lit("missing")).alias("labels"))


@query(
    "answer_line_problems",
    f"""WITH {REPLIES_SQL},
        b AS (SELECT reply_id, count(*) FILTER (WHERE item NOT IN ('P001', 'P002', 'P003', 'P004')) AS unparsed FROM q GROUP BY reply_id),
        m AS (SELECT i.reply_id, count(*) FILTER (WHERE n.item IS NULL) AS missing, coalesce(sum(len(n.ws) - len(n.labels)), 0)::BIGINT AS outside
              FROM i LEFT JOIN n USING (reply_id, item) GROUP BY i.reply_id)
        SELECT m.*, coalesce(b.unparsed, 0) AS unparsed FROM m LEFT JOIN b USING (reply_id)""",
)
def answer_line_problems(spark, d):
    return replies(spark, d)[1]
