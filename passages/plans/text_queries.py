"""Text expressions over the documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.functions import text as T
from passages.plans.registry import documents, query, table

STOP = "the of and to in is for that on with as was at by it from are this be an".split()
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
WORDS_SQL = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"

FOLD_SQL = "trim(regexp_replace(strip_accents(replace(lower({0}), 'ß', ' ')), '[^a-z]+', ' ', 'g'))"


@query(
    "norm_key",
    """SELECT doc_id, replace(lower(regexp_replace(trim(source || ' Part ' || doc_id || '.TXT '), '\\.(txt|json)$', '', 'i')),
              ' ', '_') AS key FROM documents""",
)
def norm_key(spark, d):
    name = F.concat("source", F.lit(" Part "), "doc_id", F.lit(".TXT "))
    return documents(spark, d).select("doc_id", T.norm_key(name).alias("key"))


@query(
    "spelling_key",
    """SELECT doc_id, md5(regexp_replace(replace(replace(text, 'ಽ', ''), 'ಃ', 'ಹ'), '[ \\t\\n\\r\\f]+', '', 'g')) AS key
       FROM documents""",
)
def spelling_key(spark, d):
    return documents(spark, d).select("doc_id", F.md5(T.spelling_key("text")).alias("key"))


@query("fold_text", f"SELECT doc_id, md5({FOLD_SQL.format('text')}) AS folded FROM documents")
def fold_text(spark, d):
    return documents(spark, d).select("doc_id", F.md5(T.fold_text(F.col("text"))).alias("folded"))


@query(
    "loosen",
    "SELECT doc_id, md5("
    + FOLD_SQL.format(
        "".join("replace(" for _ in T.LOOSE)
        + "lower(text)"
        + "".join(f", '{k}', '{v}')" for k, v in T.LOOSE.items())
    )
    + ") AS loose FROM documents",
)
def loosen(spark, d):
    return documents(spark, d).select("doc_id", F.md5(T.loosen(F.col("text"))).alias("loose"))


@query(
    "script_of",
    """SELECT doc_id, CASE WHEN regexp_extract(text, '[\\x{0900}-\\x{097F}\\x{0C80}-\\x{0CFF}]') = '' THEN 'en'
              WHEN regexp_extract(text, '[\\x{0900}-\\x{097F}\\x{0C80}-\\x{0CFF}]') >= 'ಀ' THEN 'kn' ELSE 'hi' END AS script
       FROM documents""",
)
def script_of(spark, d):
    return documents(spark, d).select("doc_id", T.script_of(F.col("text")).alias("script"))


@query(
    "label_number",
    """WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'bg 2.' WHEN 1 THEN 'BG 2.' WHEN 2 THEN 'Bg2.'
                         ELSE 'BG 3.' END || (event_id % 90) AS raw FROM events),
       f AS (SELECT event_id, regexp_replace(trim(raw), '^bg\\s*', 'BG ', 'i') AS ref FROM r)
       SELECT event_id, ref, TRY_CAST(nullif(regexp_extract(ref, '^BG 2\\.(\\d+)$', 1), '') AS INT) AS label FROM f""",
)
def label_number(spark, d):
    prefix = (
        F.when(F.col("event_id") % 4 == 0, "bg 2.")
        .when(F.col("event_id") % 4 == 1, "BG 2.")
        .when(F.col("event_id") % 4 == 2, "Bg2.")
        .otherwise("BG 3.")
    )
    ref = T.repair_ref(F.concat(prefix, (F.col("event_id") % 90).cast("string")))
    return (
        table(spark, d, "events").select("event_id", ref.alias("ref")).withColumn("label", T.label_number(F.col("ref")))
    )


# references are written into the text at every " the ", so that whole documents are scanned
REFERRED = "replace(replace(text, ' the ', ' 2.' || (doc_id % 80) || ' '), ' of ', ' verse ' || (doc_id % 75) || ' ')"


@query(
    "explicit_refs",
    f"""WITH t AS (SELECT doc_id, regexp_replace({REFERRED}, '([^\\d.])', '\\1\\1', 'g') AS a, {REFERRED} AS b FROM documents),
        f AS (SELECT doc_id, list_concat(
                 regexp_extract_all(a, '(?:^|[^\\d.])2\\s*(?:\\.|::)\\s*(\\d{{1,2}})(?:$|[^\\d.])', 1),
                 regexp_extract_all(b, '(?i)\\b(?:verse|shloka|sloka|śloka)\\s+(\\d{{1,2}})\\b', 1)) AS found FROM t),
        e AS (SELECT doc_id, unnest(found)::INT AS n, generate_subscripts(found, 1) AS i FROM f),
        k AS (SELECT doc_id, n, min(i) AS i FROM e WHERE n BETWEEN 1 AND 72 GROUP BY doc_id, n)
        SELECT d.doc_id, coalesce(string_agg(k.n, ',' ORDER BY k.i), '') AS refs
        FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id""",
)
def explicit_refs(spark, d):
    docs = documents(spark, d).select("doc_id", F.expr(REFERRED).alias("text"))
    return docs.select("doc_id", F.array_join(T.explicit_refs(F.col("text")), ",").alias("refs"))


MENTIONED = "replace(replace(text, ' the ', ' verse ' || (doc_id % 80) || ' '), ' of ', ' fourteenth verse ')"


@query(
    "mentions",
    f"""WITH RECURSIVE t AS (SELECT doc_id, lower({MENTIONED}) AS low FROM documents),
        m AS (SELECT doc_id, low, unnest(regexp_extract_all(low, p)) AS hit,
                     unnest(list_slice(regexp_split_to_array(low, p), 1, len(regexp_extract_all(low, p)))) AS piece,
                     generate_subscripts(regexp_extract_all(low, p), 1) AS i, p
              FROM t, (VALUES ('\\bverse\\s*(\\d{{1,2}})\\b'), ('\\bfourteenth\\s+verse\\b')) v(p)),
        s AS (SELECT doc_id, hit, sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id, p ORDER BY i) - length(hit) AS pos
              FROM m),
        l AS (SELECT doc_id, pos, CASE WHEN hit LIKE 'fourteenth%' THEN 14 ELSE regexp_extract(hit, '(\\d+)', 1)::INT END AS label
              FROM s),
        v AS (SELECT doc_id, pos, label, row_number() OVER (PARTITION BY doc_id ORDER BY pos, label) AS i FROM l
              WHERE label BETWEEN 1 AND 72),
        k AS (SELECT doc_id, i, pos, label, pos AS kept, true AS keep FROM v WHERE i = 1
              UNION ALL
              SELECT v.doc_id, v.i, v.pos, v.label, CASE WHEN v.pos - k.kept < 20 THEN k.kept ELSE v.pos END, v.pos - k.kept >= 20
              FROM k JOIN v ON v.doc_id = k.doc_id AND v.i = k.i + 1)
        SELECT doc_id, pos::INT AS pos, label FROM k WHERE keep""",
)
def mentions(spark, d):
    docs = documents(spark, d).select("doc_id", F.expr(MENTIONED).alias("text"))
    return docs.select("doc_id", F.inline(T.mentions(F.col("text"))))


@query(
    "quotation_density",
    """SELECT doc_id, round(CASE WHEN length(text) < 10 THEN 0.0 ELSE greatest(0.0, least(1.0,
              (3 * len(regexp_extract_all(text, '[ಕ-ಹ]್[ಕ-ಹ]')) + 2 * len(regexp_extract_all(text, '[ಃಂ]'))
               + 1.5 * len(regexp_extract_all(text, '್'))) / length(text))) END, 6) AS density FROM documents""",
)
def quotation_density(spark, d):
    return documents(spark, d).select(
        "doc_id", F.round(T.quotation_density(F.col("text")), 6).alias("density")
    )


@query(
    "keep_tokens",
    f"""SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS tokens FROM (
          SELECT doc_id, list_filter(string_split({FOLD_SQL.format('text')}, ' '),
                 lambda w: w <> '' AND NOT list_contains({STOP_SQL}, w)) AS k FROM documents)""",
)
def keep_tokens(spark, d):
    kept = T.keep_tokens(F.col("text"), STOP)
    return (
        documents(spark, d)
        .select("doc_id", kept.alias("k"))
        .select("doc_id", F.size("k").alias("n"), F.md5(F.array_join("k", " ")).alias("tokens"))
    )


SENT_SQL = """s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.?!।])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)))
                      AS sentence FROM documents),
   c AS (SELECT doc_id, regexp_replace(sentence, '^\\s+|\\s+$', '', 'g') AS sentence FROM s)"""


@query(
    "sentences",
    f"""WITH {SENT_SQL} SELECT doc_id, md5(sentence) AS sentence, {WORDS_SQL.format('sentence')}.len() AS n_words
        FROM c WHERE {WORDS_SQL.format('sentence')}.len() >= 5""",
)
def sentences(spark, d):
    return (
        documents(spark, d)
        .select("doc_id", F.explode_outer(T.sentences(F.col("text"))).alias("s"))
        .filter("s IS NOT NULL")
        .select("doc_id", F.md5("s").alias("sentence"), T.n_words(F.col("s")).alias("n_words"))
    )


@query(
    "domain_density",
    f"""WITH vocab AS (SELECT DISTINCT unnest(string_split({FOLD_SQL.format('text')}, ' ')) AS w FROM benchmark),
        v AS (SELECT list(w) AS ws FROM vocab WHERE w <> '' AND NOT list_contains({STOP_SQL}, w)),
        k AS (SELECT doc_id, list_filter(string_split({FOLD_SQL.format('text')}, ' '),
                     lambda w: w <> '' AND NOT list_contains({STOP_SQL}, w)) AS ws FROM documents),
        e AS (SELECT doc_id, unnest(ws) AS w FROM k),
        n AS (SELECT e.doc_id, count(*) FILTER (WHERE vocab.w IS NOT NULL) AS known FROM e LEFT JOIN vocab ON e.w = vocab.w
              GROUP BY e.doc_id)
        SELECT k.doc_id, round(coalesce(n.known, 0) / greatest(len(k.ws), 1), 6) AS density FROM k LEFT JOIN n USING (doc_id)""",
)
def domain_density(spark, d):
    from passages.operators.match import domain_density as op

    docs = documents(spark, d).select("doc_id", T.keep_tokens(F.col("text"), STOP).alias("tokens"))
    vocab = table(spark, d, "benchmark").select(F.explode(T.keep_tokens(F.col("text"), STOP)).alias("word")).distinct()
    return op(docs, vocab).select("doc_id", F.round("density", 6).alias("density"))


@query(
    "narrative_features",
    f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents)
        SELECT doc_id,
          round(len(list_filter(ws, lambda x: list_contains({[w for w in T.PAST]}, lower(x)) OR (length(x) > 4 AND lower(x) LIKE '%ed')))
                / greatest(len(ws), 1), 6) AS past,
          round(len(list_filter(ws[2:], lambda x: regexp_matches(x, '^[A-Z]') AND NOT list_contains({STOP_SQL}, lower(x))))
                / greatest(len(ws), 1), 6) AS capitals,
          len(regexp_extract_all(text, '{T.STORY}')) AS stories, len(regexp_extract_all(text, '{T.DIALOGUE}')) AS dialogue,
          (len(ws) = 0)::INT AS no_words FROM w""",
)
def narrative_features(spark, d):
    known = F.array(*map(F.lit, STOP))
    f = T.narrative_features(F.col("text"), known)
    return documents(spark, d).select(
        "doc_id",
        F.round(f["past"], 6).alias("past"),
        F.round(f["capitals"], 6).alias("capitals"),
        f["stories"].alias("stories"),
        f["dialogue"].alias("dialogue"),
        f["no_words"].alias("no_words"),
    )


@query(
    "has_keywords",
    """SELECT doc_id, (contains(lower(text), 'that')::INT + contains(lower(text), 'erent')::INT + contains(lower(text), 'license')::INT
              + contains(lower(text), 'tion')::INT) >= 2 AS kept FROM documents""",
)
def has_keywords(spark, d):
    return documents(spark, d).select(
        "doc_id", T.has_keywords(F.col("text"), ["that", "erent", "license", "tion"]).alias("kept")
    )


@query(
    "clean_text",
    """SELECT page_id, md5(regexp_replace(regexp_replace(replace(replace(h, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
              '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS cleaned
       FROM (SELECT page_id, regexp_replace(html, '<[^>]*>', chr(10) || chr(10), 'g') AS h FROM pages)""",
)
def clean_text(spark, d):
    body = F.regexp_replace("html", "<[^>]*>", "\n\n")
    return table(spark, d, "pages").select("page_id", F.md5(T.clean_text(body)).alias("cleaned"))


@query(
    "position_labels",
    """WITH e AS (SELECT event_id, value, event_id % 3 AS k, (event_id % 97) / 97.0::DOUBLE AS a, (event_id % 89 + 8) / 97.0::DOUBLE AS b,
                         CASE WHEN event_id % 3 = 0 THEN NULL ELSE (value * 60)::DOUBLE END AS dur FROM events),
       s AS (SELECT *, round_even(a * dur, 0)::BIGINT AS sa, round_even(b * dur, 0)::BIGINT AS sb FROM e)
       SELECT event_id,
         CASE WHEN coalesce(dur, 0) > 0 THEN '~' ||
           CASE WHEN sa >= 3600 THEN format('{}:{:02d}:{:02d}', sa // 3600, sa % 3600 // 60, sa % 60) ELSE format('{:02d}:{:02d}', sa // 60, sa % 60) END
           || ' – ' ||
           CASE WHEN sb >= 3600 THEN format('{}:{:02d}:{:02d}', sb // 3600, sb % 3600 // 60, sb % 60) ELSE format('{:02d}:{:02d}', sb // 60, sb % 60) END
           || ', estimated'
         ELSE '~' || round_even(a * 100, 0)::INT || '%–' || round_even(b * 100, 0)::INT || '% of the recording, estimated' END AS label,
         'https://example.org/watch?v=' || event_id || CASE WHEN coalesce(dur, 0) > 0 THEN '&t=' || floor(a * dur)::BIGINT || 's' ELSE '' END AS link
       FROM s""",
)
def position_labels(spark, d):
    e = table(spark, d, "events").select(
        "event_id",
        (F.col("event_id") % 97 / F.lit(97.0)).alias("a"),
        ((F.col("event_id") % 89 + 8) / F.lit(97.0)).alias("b"),
        F.when(F.col("event_id") % 3 != 0, F.col("value") * 60).alias("dur"),
    )
    link = T.deep_link(F.lit("https://example.org/watch?v="), F.col("event_id").cast("string"), F.col("a"), F.col("dur"))
    return e.select(
        "event_id", T.position_label(F.col("a"), F.col("b"), F.col("dur"), whole=" of the recording", note=", estimated").alias("label"), link.alias("link")
    )


@query(
    "compose_text",
    """SELECT p_partkey, concat_ws(chr(10), 'Name: ' || trim(p_name), CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN NULL
              ELSE 'Brand: ' || p_brand END, 'Type: ' || p_type) AS body FROM part""",
)
def compose_text(spark, d):
    brand = F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "-").otherwise(F.col("p_brand"))
    return table(spark, d, "part").select(
        "p_partkey",
        T.compose_text([("Name: ", F.col("p_name")), ("Brand: ", brand), ("Type: ", F.col("p_type"))]).alias("body"),
    )


@query(
    "label_reply",
    """WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '2.' || (event_id % 90) || ', 2.' || (event_id % 71)
              WHEN 1 THEN 'Verse ' || (event_id % 80) WHEN 2 THEN '' || (event_id % 100) || ' and ' || (event_id % 60)
              WHEN 3 THEN 'None of 2.5' WHEN 4 THEN 'BG 2.' || (event_id % 77) ELSE event_type END AS raw FROM events),
       t AS (SELECT event_id, lower(trim(raw)) AS low FROM r),
       p AS (SELECT event_id, low, list_filter(list_transform(list_concat(list_concat(regexp_extract_all(low, '2\\.(\\d+)', 1),
                regexp_extract_all(low, 'verse\\s*(\\d+)', 1)), regexp_extract_all(low, '(?:bg|gita)\\s*2?\\.?(\\d+)', 1)),
                lambda x: x::INT), lambda n: n BETWEEN 1 AND 72) AS a,
                list_filter(list_transform(regexp_extract_all(low, '\\b(\\d+)\\b', 1), lambda x: x::INT), lambda n: n BETWEEN 1 AND 72) AS b
             FROM t)
       SELECT event_id, CASE WHEN contains(low, 'none') OR low = '' THEN ''
              ELSE array_to_string(list_sort(list_distinct(CASE WHEN len(a) > 0 THEN a ELSE b END)), ';') END AS labels FROM p""",
)
def label_reply(spark, d):
    raw = F.expr(
        """CASE event_id % 6 WHEN 0 THEN '2.' || (event_id % 90) || ', 2.' || (event_id % 71)
           WHEN 1 THEN 'Verse ' || (event_id % 80) WHEN 2 THEN '' || (event_id % 100) || ' and ' || (event_id % 60)
           WHEN 3 THEN 'None of 2.5' WHEN 4 THEN 'BG 2.' || (event_id % 77) ELSE event_type END"""
    )
    return table(spark, d, "events").select("event_id", F.array_join(T.label_reply(raw), ";").alias("labels"))


@query(
    "json_reply",
    "SELECT event_id, 'k' AS label, json_extract(props, '$.k')::DOUBLE / 100 AS probability FROM events",
)
def json_reply(spark, d):
    raw = F.concat(
        F.lit("Sure: {\"label\": \"k\", \"probability\": "),
        F.get_json_object("props", "$.k").cast("double") / 100,
        F.lit("}\nthank you"),
    )
    return table(spark, d, "events").select("event_id", T.json_reply(raw).alias("r")).select("event_id", "r.*")


@query(
    "soft_target",
    """WITH s AS (SELECT event_id, greatest(0.02, least(0.98, ((value % 13) - 6 + 5) / 10))::DOUBLE AS p FROM events)
       SELECT event_id, round(p, 6) AS p, round(ln(p / (1 - p)), 6) AS logit FROM s""",
)
def soft_target(spark, d):
    p = T.soft_target(F.col("value") % 13 - 6)
    return table(spark, d, "events").select(
        "event_id", F.round(p, 6).alias("p"), F.round(T.logit(p), 6).alias("logit")
    )


@query(
    "note_prefix",
    """SELECT regexp_extract(note, '^([A-Z_]+):', 1) AS tag, count(*) AS n FROM (
         SELECT CASE WHEN event_id % 3 = 0 THEN upper(event_type) || ': seen' ELSE event_type END AS note FROM events)
       WHERE regexp_matches(note, '^[A-Z_]+:') GROUP BY 1""",
)
def note_prefix(spark, d):
    note = F.when(F.col("event_id") % 3 == 0, F.concat(F.upper("event_type"), F.lit(": seen"))).otherwise(F.col("event_type"))
    tags = table(spark, d, "events").select(T.note_prefix(note).alias("tag"))
    return tags.filter("tag IS NOT NULL").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "merged_metadata",
    """SELECT c.c_custkey, coalesce(nullif(trim(CASE WHEN c.c_custkey % 3 = 0 THEN ' ' ELSE c.c_mktsegment END), ''), n.n_name) AS organisation,
              coalesce(CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE c.c_acctbal END, 0.0) AS balance
       FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
)
def merged_metadata(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    segment = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment"))
    balance = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        "c_custkey",
        T.first_known(F.col("n_name"), segment).alias("organisation"),
        F.coalesce(balance, F.lit(0.0)).alias("balance"),
    )
