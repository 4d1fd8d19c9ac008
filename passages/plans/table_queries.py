"""Scans, sinks, updates and checks; streams over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.operators import annotations as A
from passages.plans.chunk_queries import timed
from passages.plans.evaluation_queries import LOG, gold_sql, log, view_sql
from passages.plans.registry import query, table
from passages.plans.retrieval_queries import benchmark
from passages.plans.sequence_queries import CARRIED, events
from passages.sources import tables as S
from passages.streaming import streams as K


@query(
    "read_table",
    "SELECT p_partkey, p_name, p_brand, p_size, round(p_retailprice, 2) AS p_retailprice FROM part",
)
def read_table(spark, d):
    path = S.scratch(spark, "csv")
    table(spark, d, "part").write.option("header", True).csv(path)
    out = S.read_table(spark, path, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    return out.select("p_partkey", "p_name", "p_brand", "p_size", F.round("p_retailprice", 2).alias("p_retailprice"))


def text_files(spark, d):
    """Every catalogue entry as a text file of its own."""
    path = S.scratch(spark, "texts")
    table(spark, d, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(path)
    return path


@query("read_transcripts", "SELECT md5(text || chr(10)) AS text, length(text) + 1 AS chars FROM benchmark")
def read_transcripts(spark, d):
    rows = S.read_transcripts(spark, text_files(spark, d))
    return rows.select(F.md5("text").alias("text"), F.length("text").alias("chars"))


@query(
    "read_segment_json",
    """SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN 'text of ' || doc_id WHEN 1 THEN 'whole ' || doc_id
         ELSE array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') END) AS text FROM documents""",
)
def read_segment_json(spark, d):
    path = S.scratch(spark, "json")
    number = F.col("doc_id").cast("string")
    timed(spark, d).select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("text of "), number)).alias("text"),
        F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("whole "), number)).alias("full_transcript"),
        "segments",
    ).write.json(path)
    return S.read_segment_json(spark, path, False, "doc_id bigint").select("doc_id", F.md5("text").alias("text"))


@query("jsonl_chunks", "SELECT doc_id, md5(text) AS text, lang FROM documents")
def jsonl_chunks(spark, d):
    path = S.scratch(spark, "jsonl")
    S.write_jsonl(table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return S.read_jsonl(spark, path, "doc_id bigint, text string, lang string").select("doc_id", F.md5("text").alias("text"), "lang")


EXPECTED_SQL = """SELECT item_id, md5(text) AS text, CASE WHEN item_id % 4 = 0 THEN '' WHEN item_id % 9 = item_id % 7 THEN 'BG 2.' || (item_id % 9)
         ELSE 'BG 2.' || (item_id % 9) || ';BG 2.' || (item_id % 7) END AS expected FROM benchmark"""


def asked_questions(spark, d, layout):
    """The catalogue entries as a file of questions in one of the two layouts, read back."""
    path = S.scratch(spark, "questions")
    expected = F.expr("CASE WHEN item_id % 4 = 0 THEN 'NONE' ELSE 'BG 2.' || (item_id % 9) || ', BG 2.' || (item_id % 7) END")
    rows = table(spark, d, "benchmark").select("item_id", "text", expected.alias("expected_verse"))
    rows.write.json(path) if layout == "json" else rows.write.options(header=True, quoteAll=True, escape='"').csv(path)
    out = S.read_questions(spark, path, "item_id bigint, text string, expected_verse string", "expected_verse", layout)
    return out.select("item_id", F.md5("text").alias("text"), F.array_join("expected", ";").alias("expected"))


@query("read_questions", EXPECTED_SQL)
def read_questions(spark, d):
    return asked_questions(spark, d, "json")


@query("read_questions_csv", EXPECTED_SQL)
def read_questions_csv(spark, d):
    return asked_questions(spark, d, "csv")


@query("union_tables", "SELECT DISTINCT o_orderkey, o_custkey FROM orders")
def union_tables(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    parts = [o.filter("o_orderkey % 3 < 2"), o.filter("o_orderkey % 3 > 0"), o]
    return S.union_tables(parts, ["o_orderkey", "o_custkey"])


@query("write_by_key", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def write_by_key(spark, d):
    path = S.scratch(spark, "by-key")
    S.write_by_key(table(spark, d, "events"), path, "event_type", max_records=1000)
    back = spark.read.parquet(path)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "upsert",
    """SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey % 2, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey""",
)
def upsert(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    rows = o.withColumn("version", F.struct("o_orderdate", F.col("o_orderkey") % 2, "o_orderkey"))
    out = S.upsert(rows.filter("o_orderkey % 2 = 0"), rows.filter("o_orderkey % 2 = 1"), ["o_custkey"], "version")
    return out.select("o_custkey", "o_orderkey", "o_orderdate")


@query("delete_where", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 200000)")
def delete_where(spark, d):
    o = table(spark, d, "orders")
    return S.delete_where(o, (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000)).select("o_orderkey")


@query(
    "replace_slice",
    """SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT event_type, value FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE user_id % 2 = 0 AND event_type IN ('click', 'view'))
         UNION ALL SELECT event_type, value + 1 FROM events WHERE user_id % 2 = 0 AND event_type IN ('click', 'view')) GROUP BY event_type""",
)
def replace_slice(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value")
    new = e.filter("user_id % 2 = 0 AND event_type IN ('click', 'view')").withColumn("value", F.col("value") + 1)
    out = S.replace_slice(e, new, "event_type")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("incremental", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def incremental(spark, d):
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.incremental(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query(
    "completeness",
    """SELECT count(*) AS total, count(*) FILTER (WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS missing,
         count(*) FILTER (WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) <= count(*) * 0.02 AS ok FROM orders""",
)
def completeness(spark, d):
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.completeness(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("write_complete", "SELECT count(*) AS total, count(*) FILTER (WHERE nullif(trim(c_mktsegment), '') IS NULL) AS missing FROM customer")
def write_complete(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    total, missing = S.write_complete(rows, S.scratch(spark, "answers"), F.trim("c_mktsegment") != "")
    return spark.range(1).select(F.lit(total).cast("long").alias("total"), F.lit(missing).cast("long").alias("missing"))


@query(
    "grid_diff",
    """WITH o AS (SELECT doc_id, text, source FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text, source FROM documents WHERE doc_id % 11 <> 0),
       d AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'vanished' WHEN o.doc_id IS NULL THEN 'new' WHEN o.text <> n.text OR o.source <> n.source THEN 'changed' END AS change
             FROM o FULL JOIN n ON o.doc_id = n.doc_id)
       SELECT doc_id, change, change <> 'new' AND doc_id IN (SELECT doc_id FROM labels) AS labelled FROM d WHERE change IS NOT NULL""",
)
def grid_diff(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    new = docs.filter("doc_id % 11 <> 0").withColumn("text", F.expr("CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END"))
    return S.grid_diff(docs.filter("doc_id % 7 <> 0"), new, table(spark, d, "labels"), "doc_id", ["text", "source"])


@query(
    "validate",
    """WITH g AS (SELECT conv_id, max(turn) - min(turn) + 1 <> count(*) OR count(DISTINCT turn) <> count(*) AS gaps, min(role) <> max(role) AS varies FROM conversations GROUP BY conv_id)
       SELECT 'required' AS rule, 'text' AS column, count(*) FILTER (WHERE text IS NULL OR text = '') AS violations FROM conversations
       UNION ALL SELECT 'enum', 'role', count(*) FILTER (WHERE role <> 'user') FROM conversations
       UNION ALL SELECT 'range', 'turn', count(*) FILTER (WHERE turn NOT BETWEEN 0 AND 5) FROM conversations
       UNION ALL SELECT 'no gaps', 'turn', count(*) FILTER (WHERE gaps) FROM g UNION ALL SELECT 'constant', 'role', count(*) FILTER (WHERE varies) FROM g""",
)
def validate(spark, d):
    return S.validate(table(spark, d, "conversations"), ["text"], {"role": ["user"]}, {"turn": (0, 5)}, "conv_id", "turn", ["role"])


@query(
    "catalogue_complete",
    """SELECT coalesce(c.label, i.label) AS label, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, 61)) AS label) i
       FULL JOIN (SELECT item_id % 70 AS label, count(*) AS n FROM benchmark GROUP BY 1) c ON c.label = i.label WHERE coalesce(n, 0) <> 1 OR coalesce(c.label, i.label) NOT BETWEEN 1 AND 60""",
)
def catalogue_complete(spark, d):
    return S.catalogue_complete(table(spark, d, "benchmark").select((F.col("item_id") % 70).alias("label")), "label", 60)


@query(
    "answers_complete",
    """WITH i AS (SELECT conv_id, turn FROM conversations), a AS (SELECT conv_id, turn FROM conversations WHERE NOT (conv_id % 7 = 0 AND turn = 1) UNION ALL SELECT conv_id, turn FROM conversations WHERE conv_id % 5 = 0 AND turn = 0),
       g AS (SELECT conv_id, turn, count(*) AS n FROM a GROUP BY ALL)
       SELECT i.conv_id, count(*) AS expected, count(g.n) AS answered, bool_and(coalesce(g.n = 1, false)) AS complete FROM i LEFT JOIN g USING (conv_id, turn) GROUP BY i.conv_id""",
)
def answers_complete(spark, d):
    ids = table(spark, d, "conversations").select("conv_id", "turn")
    answers = ids.filter("NOT (conv_id % 7 = 0 AND turn = 1)").unionByName(ids.filter("conv_id % 5 = 0 AND turn = 0"))
    return S.answers_complete(answers, ids, "conv_id", "turn")


# ---- streams ---------------------------------------------------------------------------------


@query(
    "stream_carry",
    f"WITH {CARRIED} SELECT seq, unit, CASE WHEN pos - anchor_pos <= 2 THEN array_to_string(active, ';') ELSE '' END AS held FROM act",
)
def stream_carry(spark, d):
    source, out, state = (S.scratch(spark, n) for n in ("events", "carried", "state"))
    rows = events(spark, d).select("seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("order"), "unit", "anchors")
    # the events come in four feeds in the order of time, so that the state is restored between them
    cuts = rows.approxQuantile("order", [0.25, 0.5, 0.75], 0.01)
    feed = sum(((F.col("order") > c).cast("int") for c in cuts), F.lit(0))
    for k in range(len(cuts) + 1):
        rows.filter(feed == k).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        K.run_to_folder(K.stream_carry(stream, max_gap=2), out, state)
    return spark.read.parquet(out).select("seq", "unit", F.array_join("held", ";").alias("held"))


def streamed_log(spark, d, reset):
    source, out, state = (S.scratch(spark, n) for n in ("log", "view", "state"))
    rows = log(spark, d, reset)
    rows.repartitionByRange(4, "row_no").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    K.stream_latest_view(stream, out, state)
    return K.latest_view_of(spark, out)


@query("stream_latest_view", f"WITH {LOG}, {view_sql('lg', 'vw')} SELECT * FROM vw")
def stream_latest_view(spark, d):
    return streamed_log(spark, d, False).select("item", "annotator", "label", "tier", "created_at", "row_no")


RESET_LOG = LOG.replace("AND false", "AND true")


@query(
    "stream_gold",
    f"""WITH {RESET_LOG}, rs AS (SELECT item, max(created_at) AS reset_at FROM lg WHERE label = 'RESET' GROUP BY item),
        ar AS (SELECT lg.* FROM lg LEFT JOIN rs USING (item) WHERE label <> 'RESET' AND (reset_at IS NULL OR created_at > reset_at)),
        {view_sql('ar', 'vw')}, {gold_sql('vw', 'gd')} SELECT item, labels FROM gd""",
)
def stream_gold(spark, d):
    from passages.plans.evaluation_queries import label_text

    return A.gold(streamed_log(spark, d, True)).select("item", label_text())


@query("stream_ingest")
def stream_ingest(spark, d):
    source, out, state = (S.scratch(spark, n) for n in ("documents", "passages", "state"))
    rows = table(spark, d, "documents").select("doc_id", "text")
    rows.repartitionByRange(3, "doc_id").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    K.stream_ingest(stream, benchmark(spark, d), out, state)
    return spark.read.parquet(out).select("passage", "n_words", "label", F.round("score", 6).alias("score"))
