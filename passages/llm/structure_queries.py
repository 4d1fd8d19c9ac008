"""Queries on the lines of texts, on conversations and on phrases, each with its SQL."""

from pyspark.sql import functions as F

from passages.llm.conversations import summaries
from passages.llm.line_rules import BOILERPLATE, CLOSERS, clean_lines
from passages.llm.overlap_queries import FOLDED, SPLIT
from passages.llm.phrases import collocations
from passages.llm.registry import query, table

_WORDS = SPLIT.format(text="{0}")
_ENDS = "rtrim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '" + CLOSERS.replace("'", "''") + "')"
_PHRASES = " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)

LINES_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM texts, unnest(range(1, len(w) - 6)) AS r(i)),
twice AS (SELECT doc_id, s FROM windows GROUP BY doc_id, s HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM windows JOIN twice USING (doc_id, s), unnest(range(0, 8)) AS r(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, l, {_WORDS.format("l")} AS lw FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM texts)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
judged AS (
  SELECT doc_id, l, len(lw) AS n,
    NOT (right({_ENDS}, 1) IN ('.', '!', '?', ':', '…'))
    OR 5 * len(list_filter(lw, lambda x: regexp_matches(x, '([!?][!?]|[#*$%&|<>][#*$%&|<>])$'))) > len(lw)
    OR (len(regexp_extract_all(l, '[|>«»•→]')) >= 3 AND 4 * len(regexp_extract_all(l, '[|>«»•→]')) >= len(lw))
    OR {_PHRASES} AS bad
  FROM lines),
counts AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS dup, coalesce(sum(n) FILTER (WHERE bad), 0) AS lost FROM judged GROUP BY doc_id),
joined AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN counts USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * lost > 50 * n_words) AS kept
FROM joined
"""


@query("op12_quality_rules", LINES_SQL)
def op12_quality_rules(spark, sf_dir):
    rows = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


PHRASES_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex({FOLDED}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM words, unnest([1, 2, 3, 4]) AS s(k), unnest(range(1, len(w) + 1)) AS r(i) WHERE i + k - 1 <= len(w)),
often AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM often WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f + r.f))::BIGINT AS score
  FROM cand c, unnest(range(1, c.k)) AS x(j)
  JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.w, 1, j), ' ')
  JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.w, j + 1, c.k), ' ')),
best AS (SELECT lang, phrase, any_value(a) AS a, min({{'score': score, 'j': j, 'l': l, 'r': r}}) AS cut FROM cuts GROUP BY lang, phrase),
inside AS (
  SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS f
  FROM cand, unnest(range(2, k)) AS y(m), unnest(range(1, k - m + 2)) AS z(i) GROUP BY 1, 2),
kept AS (
  SELECT b.lang, b.phrase, a, cut.l AS l, cut.r AS r, cut.score AS score FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE f IS NULL OR 100 * f::HUGEINT < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_phrases", PHRASES_SQL)
def op13_phrases(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


_CRC = """xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT),
  lambda c, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295)"""

REPAIR_SQL = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS t,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
base AS (SELECT *, {_CRC.format("name")} % 20 AS d FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text
  FROM base, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(c)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged)),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    substr(role, 1, 1) AS i, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS h FROM placed),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE h || i NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
moves(p, c, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits AS (
  SELECT conv_id, pos, p, p AS q, 2 AS cost, 'D' AS audit, []::VARCHAR[] AS told FROM judged, unnest([0, 1, 2, 3]) AS s(p)
  UNION ALL
  SELECT conv_id, pos, p, q, CASE fault WHEN '' THEN 0 ELSE 5 END, 'K', [role || ':' || text] FROM judged JOIN moves ON c = i WHERE fault IN ('', 'truncated')
  UNION ALL
  SELECT conv_id, pos, p, q, CASE fault WHEN '' THEN 1 ELSE 6 END, 'R', [CASE c WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text]
  FROM judged, moves WHERE c <> 's' AND fault IN ('', 'truncated')),
gap(p, q, cost, audit, told) AS (VALUES
  (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']),
  (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
reach AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS q, {{'cost': 0, 'audit': '', 'told': []::VARCHAR[]}} AS b FROM conversations
  UNION ALL
  SELECT r.conv_id, e.pos, e.q, min({{'cost': (b).cost + g.cost + e.cost, 'audit': (b).audit || g.audit || e.audit, 'told': (b).told || g.told || e.told}})
  FROM reach r JOIN gap g ON g.p = r.q JOIN edits e ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.pos = r.pos + 1 AND e.p = g.q
  GROUP BY r.conv_id, e.pos, e.q),
ends AS (
  SELECT r.conv_id, min({{'cost': (b).cost + g.cost, 'audit': (b).audit || g.audit, 'told': (b).told || g.told}}) AS b
  FROM reach r JOIN gap g ON g.p = r.q LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM r.conv_id
  WHERE g.q IN (0, 3) AND r.pos = coalesce(c.n, 0) GROUP BY r.conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, (b).cost::BIGINT AS cost, (b).audit AS audit,
  sha256(array_to_string((b).told, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def damaged(conversations):
    """Rows of (conv_id, turn, role, text) with the faults that a digest of conversation and turn deals out; nulls count as one space."""
    space = F.lit(" ")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("deal"))
    text = F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat("turn", F.when(F.col("deal") == 0, 0).when(F.col("deal") == 3, 2).otherwise(1)))
    return rows.select("conv_id", copies.alias("turn"), F.when(F.col("deal") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


@query("op11_conversations", REPAIR_SQL)
def op11_conversations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    found = summaries(damaged(rows)).withColumnRenamed("conv_id", "found")
    ids = rows.select("conv_id").distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left").drop("found")
    out = out.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna("", ["audit"])
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
