"""DuckDB statements of the same semantics, used as the independent correctness oracle.

The helpers build SQL expressions text-wise, mirroring the fixed rules of
``relevo.functions.text`` (the rule tables are shared, the engine is not).
RE2 differs from Java regex in two places that matter here:

* ``\\W`` is ASCII in RE2, so the Unicode word class is spelled out;
* replacement groups are written ``\\1`` instead of ``$1``.
"""

from __future__ import annotations

from relevo.functions.stopwords import sql_list
from relevo.functions.text import MEASURE_RULES, UNIT_RULES, GLUED_WORD_PATTERN

UNICODE_NON_WORD = r"[^\pL\pM\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def units(e: str) -> str:
    s = f"(' ' || {e} || ' ')"
    for pat, rep in UNIT_RULES:
        s = f"regexp_replace({s}, {q(pat)}, {q(rep)}, 'g')"
    return s


def clean(e: str, search: bool = False) -> str:
    s = f"replace({e}, 'in.', ' inch ')"
    s = f"lower(regexp_replace({s}, {q(UNICODE_NON_WORD)}, ' ', 'g'))"
    s = f"regexp_replace({s}, '([A-Za-z]+)', ' \\1 ', 'g')"
    s = units(s)
    if search:
        s = f"replace({s}, ' in ', ' inch ')"
    return f"trim(regexp_replace({s}, ' +', ' ', 'g'))"


def split_ws(e: str) -> str:
    t = f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"
    return f"(CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE string_split({t}, ' ') END)"


def strip_stopwords(e: str) -> str:
    toks = split_ws(f"replace({e}, '_', ' _ ')")
    return f"array_to_string(list_filter({toks}, lambda t: NOT list_contains({sql_list()}, t)), ' ')"


def remove_special(e: str) -> str:
    return f"lower(regexp_replace({e}, '[^A-Za-z0-9]+', ' ', 'g'))"


def measures(e: str) -> str:
    s = e
    for kind, pat, rep in MEASURE_RULES:
        if kind == "re":
            rep2 = rep.replace("$1", "\\1").replace("$4", "\\4")
            s = f"regexp_replace({s}, {q(pat)}, {q(rep2)}, 'g')"
        else:
            s = f"replace({s}, {q(pat)}, {q(rep)})"
    return s


def glued(e: str) -> str:
    return f"array_to_string(regexp_extract_all({e}, {q(GLUED_WORD_PATTERN)}), ' ')"


def substring_count(d: str, w: str) -> str:
    return (f"(CASE WHEN length({w}) = 0 THEN length({d}) + 1 ELSE "
            f"CAST(floor((length({d}) - length(replace({d}, {w}, ''))) / length({w})) AS INTEGER) END)")


# Fixture views, stated over the raw driver tables.
PRODUCTS = """products AS (
  SELECT doc_id AS product_uid, string_split(text, chr(10))[1] AS product_title, text AS product_description
  FROM documents)"""

ATTRIBUTES = """attributes AS (
  SELECT doc_id AS product_uid, 1 AS pos, 'Language' AS name,
         CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS value FROM documents WHERE doc_id % 13 <> 0
  UNION ALL
  SELECT doc_id, 2, 'Size', CAST(n_chars AS VARCHAR) FROM documents WHERE doc_id % 13 <> 0
  UNION ALL
  SELECT doc_id, 3, 'MFG Brand Name', source FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 13 <> 0
  UNION ALL
  SELECT doc_id, 4, 'MFG Brand Name', source || ' ' || lang FROM documents WHERE doc_id % 17 = 0 AND doc_id % 13 <> 0)"""

PAIRS = """searches AS (SELECT conv_id AS search_id, text AS search_term FROM conversations WHERE turn = 0),
n_searches AS (SELECT max(search_id) + 1 AS n FROM searches),
pairs AS (
  SELECT l.doc_id * 2 + k AS id, l.doc_id AS product_uid, string_split(d.text, chr(10))[1] AS product_title, s.search_term,
         CAST(1 + l.quality + (1 - l.toxic) AS DOUBLE) AS relevance,
         ((l.doc_id * 2 + k) % 5 <> 0) AS is_train
  FROM (SELECT *, 0 AS k, doc_id % n AS search_id FROM labels, n_searches
        UNION ALL SELECT *, 1, (doc_id * 7 + 3) % n FROM labels, n_searches WHERE doc_id % 3 = 0) l
  JOIN searches s USING (search_id) JOIN documents d ON l.doc_id = d.doc_id)"""

QUERIES = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"

PART_PRODUCTS = """part_products AS (
  SELECT p_partkey AS product_uid, p_name AS product_title, p_brand AS brand,
         concat_ws(' ', p_name, p_type, p_brand) AS product_description FROM part)"""

PART_QUERIES = """part_queries AS (
  SELECT truth, rule, text, rule || '|' || truth AS query_id FROM (
    SELECT truth, 'drop2' AS rule, substr(truth, 1, 1) || substr(truth, 3) AS text FROM (SELECT DISTINCT p_name AS truth FROM part)
    UNION ALL SELECT truth, 'swap23', substr(truth, 1, 1) || substr(truth, 3, 1) || substr(truth, 2, 1) || substr(truth, 4) FROM (SELECT DISTINCT p_name AS truth FROM part)
    UNION ALL SELECT truth, 'double_last', truth || right(truth, 1) FROM (SELECT DISTINCT p_name AS truth FROM part)
    UNION ALL SELECT truth, 'q_first', 'q' || substr(truth, 2) FROM (SELECT DISTINCT p_name AS truth FROM part)))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def first_n_words(e: str, n: int, missing: str = "error101") -> str:
    t = split_ws(e)
    return f"(CASE WHEN len({t}) < {n} THEN '{missing}' ELSE array_to_string({t}[1:{n}], ' ') END)"


def nb(e: str) -> str:
    """Notebook cleaning: special characters, then measurement units."""
    return measures(remove_special(e))


def digits(l: str) -> str:
    return f"list_distinct(list_filter({l}, lambda t: regexp_full_match(t, '[0-9]+')))"


def n_bigrams(l: str) -> str:
    return f"len(list_distinct(list_transform(range(1, len({l})), lambda i: {l}[i] || ' ' || {l}[i + 1])))"


def char_set(w: str) -> str:
    return f"(CASE WHEN length({w}) = 0 THEN []::VARCHAR[] ELSE list_distinct(string_split({w}, '')) END)"


def jaccard(a: str, b: str) -> str:
    u = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {u} = 0 THEN NULL ELSE ({u} - len(list_intersect({a}, {b})))::DOUBLE / {u} END)"


def pairwise_min(qa: str, fa: str, fn) -> str:
    return f"list_min(flatten(list_transform({qa}, lambda x: list_transform({fa}, lambda y: {fn('x', 'y')}))))"


NB_INPUTS = f"""nb_pairs AS (
  SELECT id AS pair_id, product_uid, {nb('search_term')} AS q, relevance, is_train FROM pairs),
nb_a AS (SELECT * FROM attributes WHERE product_uid IS NOT NULL AND name IS NOT NULL AND value IS NOT NULL),
nb_summ AS (SELECT product_uid, string_agg(name || ' ' || value, ' ' ORDER BY pos) AS attribute_summary FROM nb_a GROUP BY product_uid),
nb_br AS (SELECT product_uid, (list(value ORDER BY pos))[1] AS brand FROM nb_a WHERE name = 'MFG Brand Name' GROUP BY product_uid),
nb_products AS (
  SELECT p.product_uid, {nb('p.product_title')} AS title, {nb('p.product_description')} AS description,
         {nb("coalesce(s.attribute_summary, 'NoAttribute')")} AS attributes, coalesce(b.brand, 'NoBrand') AS brand
  FROM products p LEFT JOIN nb_summ s USING (product_uid) LEFT JOIN nb_br b USING (product_uid)
  WHERE p.product_uid IN (SELECT product_uid FROM pairs)),
nb_j AS (SELECT * FROM nb_pairs JOIN nb_products USING (product_uid))"""

UNICODE_WORD = r"[\pL\pM\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]+"


def edits_sql(src: str) -> str:
    """All one-edit strings of column ``s`` of CTE ``src`` (carrying ``word``), as (word, x)."""
    return f"""SELECT word, substr(s, 1, i - 1) || substr(s, i + 1) AS x FROM (SELECT word, s, unnest(range(1, length(s) + 1)) AS i FROM {src})
UNION ALL SELECT word, substr(s, 1, i - 1) || substr(s, i + 1, 1) || substr(s, i, 1) || substr(s, i + 2) FROM (SELECT word, s, unnest(range(1, length(s))) AS i FROM {src})
UNION ALL SELECT word, substr(s, 1, i - 1) || c || substr(s, i + 1) FROM (SELECT word, s, unnest(range(1, length(s) + 1)) AS i FROM {src}) CROSS JOIN letters
UNION ALL SELECT word, substr(s, 1, i) || c || substr(s, i + 1) FROM (SELECT word, s, unnest(range(0, length(s) + 1)) AS i FROM {src}) CROSS JOIN letters"""


def inverse_edits_sql(src: str) -> str:
    """All strings from which one edit leads to column ``s`` of CTE ``src`` (carrying ``word``), as (word, x); ``chars`` holds the
    characters that a deleted or replaced one may have been. Only a-z can have been inserted or put in place of another."""
    is_letter = "regexp_matches(substr(s, i, 1), '^[a-z]$')"
    each = f"(SELECT word, s, unnest(range(1, length(s) + 1)) AS i FROM {src})"
    return f"""SELECT word, substr(s, 1, i - 1) || substr(s, i + 1) AS x FROM {each} WHERE {is_letter}
UNION ALL SELECT word, substr(s, 1, i - 1) || substr(s, i + 1, 1) || substr(s, i, 1) || substr(s, i + 2) FROM (SELECT word, s, unnest(range(1, length(s))) AS i FROM {src})
UNION ALL SELECT word, substr(s, 1, i - 1) || c || substr(s, i + 1) FROM {each} CROSS JOIN chars WHERE {is_letter}
UNION ALL SELECT word, substr(s, 1, i) || c || substr(s, i + 1) FROM (SELECT word, s, unnest(range(0, length(s) + 1)) AS i FROM {src}) CROSS JOIN chars"""
