"""Queries on near copies, repeated passages and benchmark passages, each with its SQL."""

from passages.llm.decontaminate import contained_items
from passages.llm.jaccard import jaccard_classes
from passages.llm.registry import query, table
from passages.llm.substrings import remove_repeats

SPLIT = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SHINGLES = """
{name}_words AS (SELECT {key}, {split} AS w FROM {table}),
{name}_sets AS (
  SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM {name}_words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0)"""

CLASSES_SQL = f"""
WITH RECURSIVE {SHINGLES.format(name="d", key="doc_id", table="documents", split=SPLIT.format(text=FOLDED)).strip()},
size AS (SELECT doc_id, count(*) AS n FROM d_sets GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM d_sets a JOIN d_sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM met JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN size USING (doc_id) GROUP BY r.doc_id
"""

# positions joined one by one; documents without words have no rows to join
REPEATS_SQL = f"""
WITH words AS (SELECT doc_id, {SPLIT.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM words, unnest(range(1, len(w) - 11)) AS r(i)),
firsts AS (SELECT s, min(doc_id) AS owner FROM windows GROUP BY s),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE owner < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS at FROM hits, unnest(range(0, 13)) AS r(k)),
places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM words),
kept AS (
  SELECT p.doc_id, count(g.at) AS n_removed, string_agg(word, ' ' ORDER BY p.at) FILTER (WHERE g.at IS NULL) AS text
  FROM places p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.at = p.at GROUP BY p.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

CONTAINED_SQL = f"""
WITH {SHINGLES.format(name="d", key="doc_id", table="documents", split=SPLIT.format(text="lower(coalesce(text, ''))")).strip()},
{SHINGLES.format(name="b", key="item_id", table="benchmark", split=SPLIT.format(text="lower(coalesce(text, ''))")).strip()},
size AS (SELECT item_id, count(*) AS n FROM b_sets GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_shingles
FROM d_sets JOIN b_sets USING (s) JOIN size USING (item_id)
GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n)
"""


@query("op2_jaccard_classes", CLASSES_SQL)
def op2_jaccard_classes(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"))


@query("op4_substring_dedup", REPEATS_SQL)
def op4_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, 13).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op10_decontamination", CONTAINED_SQL)
def op10_decontamination(spark, sf_dir):
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
