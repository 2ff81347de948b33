"""DuckDB statements for the queries in ``relevo.plans.catalog`` (same names, same aliases)."""

from __future__ import annotations

from relevo import oracle_sql as S

ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- retrieval ---

ORACLE["bm25_topn"] = S.with_(
    S.QUERIES,
    f"docs AS (SELECT doc_id AS product_uid, string_split({S.clean('text')}, ' ') AS toks FROM documents)",
    "occ AS (SELECT product_uid, len(toks) AS dl, unnest(toks) AS term FROM docs)",
    "tf AS (SELECT term, product_uid, dl, count(*) AS tf FROM occ GROUP BY ALL)",
    "st AS (SELECT count(*) AS n, sum(len(toks))::DOUBLE / count(*) AS avgdl FROM docs)",
    "dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term)",
    "raw AS (SELECT term, ln(st.n - df + 0.5) - ln(df + 0.5) AS idf FROM dfs, st)",
    "idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw)",
    f"qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(string_split({S.clean('text', True)}, ' ')) AS term FROM queries) GROUP BY ALL)",
    """sc AS (SELECT q.query_id, t.product_uid,
         round(sum(q.qtf * i.idf * t.tf * 2.5 / (t.tf + 1.5 * (1 - 0.75 + 0.75 * t.dl / st.avgdl))), 6) AS score
       FROM qt q JOIN tf t ON q.term = t.term JOIN idf i ON i.term = t.term CROSS JOIN st GROUP BY ALL)""",
) + """SELECT CAST(query_id AS BIGINT) AS query_id, CAST(product_uid AS BIGINT) AS product_uid,
       CAST(rank AS BIGINT) AS rank, CAST(score AS DOUBLE) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_uid) AS rank FROM sc)
WHERE rank <= 10"""

# ------------------------------------------------------------ text cleaning ---

ORACLE["clean_text"] = f"SELECT doc_id, {S.clean('text')} AS cleaned FROM documents"
ORACLE["clean_search"] = f"SELECT item_id, {S.clean('text', True)} AS cleaned FROM benchmark"
ORACLE["clean_units"] = f"SELECT doc_id, {S.units('lower(text)')} AS units FROM documents"
ORACLE["strip_stopwords"] = f"SELECT doc_id, {S.strip_stopwords(S.clean('text'))} AS stripped FROM documents"
ORACLE["clean_measures"] = f"SELECT doc_id, {S.measures(S.remove_special('text'))} AS measured FROM documents"
ORACLE["camel_split"] = f"SELECT doc_id, {S.glued('text')} AS split_text FROM documents"

# ------------------------------------------------------------------ assembly ---

_BOTH = """both_ AS (
  SELECT id, product_uid, product_title, search_term, 0 AS src FROM pairs WHERE is_train
  UNION ALL SELECT id, product_uid, product_title, search_term, 1 FROM pairs WHERE NOT is_train)"""

_IMPUTE = f"""known AS (SELECT DISTINCT brand AS cand FROM cat WHERE brand IS NOT NULL),
miss AS (SELECT product_uid, n, CASE n WHEN 4 THEN {S.first_n_words('product_title', 4)}
                                     WHEN 3 THEN {S.first_n_words('product_title', 3)}
                                     ELSE {S.first_n_words('product_title', 2)} END AS cand
         FROM (SELECT product_uid, product_title, unnest([4, 3, 2]) AS n FROM cat WHERE brand IS NULL)),
best AS (SELECT product_uid, arg_max(cand, n) AS imp FROM miss WHERE cand IN (SELECT cand FROM known) GROUP BY product_uid),
imputed AS (SELECT c.*, coalesce(c.brand, b.imp, {S.first_n_words('c.product_title', 1)}) AS brand_i
            FROM cat c LEFT JOIN best b USING (product_uid))"""

_CATALOG = S.with_(
    S.PRODUCTS, S.ATTRIBUTES, S.PAIRS, _BOTH,
    "present AS (SELECT DISTINCT product_uid FROM both_)",
    "attrs AS (SELECT * FROM attributes WHERE product_uid IN (SELECT product_uid FROM present))",
    """at_ AS (SELECT product_uid, string_agg(coalesce(name, '') || ' ' || coalesce(value, ''), ' ' ORDER BY pos) AS combined_attr
             FROM attrs WHERE product_uid IS NOT NULL GROUP BY product_uid)""",
    "br AS (SELECT product_uid, (list(value ORDER BY pos))[1] AS brand FROM attrs WHERE name = 'MFG Brand Name' GROUP BY product_uid)",
    f"desc_ AS (SELECT product_uid, {S.glued('product_description')} AS product_description FROM products)",
    """first_ AS (SELECT product_uid, product_title FROM
                (SELECT *, row_number() OVER (PARTITION BY product_uid ORDER BY src, id) AS rn FROM both_) WHERE rn = 1)""",
    """cat AS (SELECT f.product_uid, f.product_title, a.combined_attr, b.brand, d.product_description
             FROM first_ f LEFT JOIN at_ a USING (product_uid) LEFT JOIN br b USING (product_uid)
             LEFT JOIN desc_ d USING (product_uid))""",
    _IMPUTE,
    f"""catalog AS (SELECT product_uid, product_title, coalesce(combined_attr, product_description) AS combined_attr,
                  brand_i AS brand, product_description,
                  {S.clean("product_title || ' ' || brand_i || ' ' || product_description")} AS text FROM imputed)""",
)

ORACLE["assemble_catalog"] = _CATALOG + "SELECT * FROM catalog"

ORACLE["attr_concat"] = S.with_(S.ATTRIBUTES) + """SELECT product_uid,
  string_agg(coalesce(name, '') || ' ' || coalesce(value, ''), ' ' ORDER BY pos) AS combined_attr
FROM attributes WHERE product_uid IS NOT NULL GROUP BY product_uid"""

ORACLE["attr_concat_rows"] = S.with_(S.ATTRIBUTES) + """SELECT product_uid, pos,
  string_agg(coalesce(name, '') || ' ' || coalesce(value, ''), ' ' ORDER BY pos) OVER (PARTITION BY product_uid) AS combined_attr
FROM attributes"""

ORACLE["brand_impute"] = S.with_(
    S.PRODUCTS, S.ATTRIBUTES,
    "br AS (SELECT product_uid, (list(value ORDER BY pos))[1] AS brand FROM attributes WHERE name = 'MFG Brand Name' GROUP BY product_uid)",
    "cat AS (SELECT p.product_uid, p.product_title, b.brand FROM products p LEFT JOIN br b USING (product_uid))",
    _IMPUTE,
) + "SELECT product_uid, brand_i AS brand FROM imputed"

ORACLE["dedupe_first"] = S.with_(S.PAIRS, _BOTH) + """SELECT id, product_uid, search_term FROM
  (SELECT *, row_number() OVER (PARTITION BY product_uid ORDER BY src, id) AS rn FROM both_) WHERE rn = 1"""

ORACLE["assemble_pairs"] = S.with_(
    S.PRODUCTS, S.ATTRIBUTES, S.PAIRS,
    "a AS (SELECT * FROM attributes WHERE product_uid IS NOT NULL AND name IS NOT NULL AND value IS NOT NULL)",
    "summ AS (SELECT product_uid, string_agg(name || ' ' || value, ' ' ORDER BY pos) AS attribute_summary FROM a GROUP BY product_uid)",
    "br AS (SELECT product_uid, (list(value ORDER BY pos))[1] AS brand FROM a WHERE name = 'MFG Brand Name' GROUP BY product_uid)",
) + """SELECT p.id, p.product_uid, p.product_title, p.search_term, p.relevance, d.product_description,
  coalesce(s.attribute_summary, 'NoAttribute') AS attribute_summary, coalesce(b.brand, 'NoBrand') AS brand
FROM pairs p LEFT JOIN products d USING (product_uid) LEFT JOIN summ s USING (product_uid) LEFT JOIN br b USING (product_uid)"""

ORACLE["bucket_relevance"] = S.with_(S.PAIRS) + """SELECT id, round(score, 6) AS score,
  ([3.00, 2.33, 2.67, 2.00, 1.67, 1.33, 1.00]::DOUBLE[])[list_position(d, list_min(d))] AS relevance_class
FROM (SELECT id, score, list_transform([3.00, 2.33, 2.67, 2.00, 1.67, 1.33, 1.00]::DOUBLE[], lambda v: abs(score - v)) AS d
      FROM (SELECT id, relevance + (id % 7 - 3) * 0.11::DOUBLE AS score FROM pairs))"""

ORACLE["clip_predictions"] = S.with_(S.PAIRS) + """SELECT id,
  round(greatest(1.0::DOUBLE, least(3.0::DOUBLE, relevance * 1.4::DOUBLE - 0.9::DOUBLE)), 6) AS relevance FROM pairs"""

# ----------------------------------------------------------------- profiling ---


def _nulls(table, cols):
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS null_count FROM {table}"
        for c in cols)


ORACLE["null_profile"] = _CATALOG + _nulls(
    "attributes", ["product_uid", "pos", "name", "value"]) + " UNION ALL " + _nulls(
    "catalog", ["product_uid", "product_title", "combined_attr", "brand", "product_description", "text"])


def _describe(cols):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        for stat, e in [("count", f"CAST(count({x}) AS DOUBLE)"), ("mean", f"avg({x})"), ("std", f"stddev_samp({x})"),
                        ("min", f"min({x})"), ("p25", f"quantile_cont({x}, 0.25)"), ("p50", f"quantile_cont({x}, 0.5)"),
                        ("p75", f"quantile_cont({x}, 0.75)"), ("max", f"max({x})")]:
            parts.append(f"SELECT '{c}' AS column_name, '{stat}' AS stat, round({e}, 6) AS value FROM documents")
    return " UNION ALL ".join(parts)


ORACLE["describe_numeric"] = _describe(["n_chars", "doc_id"])

ORACLE["distinct_dups"] = S.with_(S.PAIRS) + " UNION ALL ".join(
    f"SELECT '{name}' AS key_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT {k}) AS BIGINT) AS n_distinct, "
    f"CAST(count(*) - count(DISTINCT {k}) AS BIGINT) AS n_duplicates FROM pairs"
    for name, k in [("product_uid", "product_uid"), ("search_term", "search_term"), ("product_title", "product_title"),
                    ("search_term+product_uid", "(search_term, product_uid)")])

ORACLE["value_counts"] = S.with_(S.ATTRIBUTES) + \
    "SELECT value, CAST(count(*) AS BIGINT) AS cnt FROM attributes WHERE value IS NOT NULL GROUP BY value"

ORACLE["histogram_len"] = S.with_(
    S.PAIRS,
    "v AS (SELECT CAST(length(search_term) AS DOUBLE) AS v FROM pairs)",
    "mm AS (SELECT min(v) AS lo, max(v) AS hi, CASE WHEN max(v) > min(v) THEN max(v) - min(v) ELSE 1.0 END AS w FROM v)",
) + """SELECT CAST(bin AS BIGINT) AS bin, round(any_value(lo) + bin * (any_value(w) / 10.0), 6) AS lower_edge,
  CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT least(floor((v - lo) * 10.0 / w), 9) AS bin, lo, w FROM v, mm) GROUP BY bin"""

ORACLE["class_hist"] = S.with_(S.PAIRS) + \
    "SELECT relevance, CAST(count(*) AS BIGINT) AS cnt FROM pairs GROUP BY relevance"


def _overlap(name, l, r, keys):
    on = " AND ".join(f"l.{k} IS NOT DISTINCT FROM r.{k}" for k in keys)
    ks = ", ".join(keys)
    return f"""SELECT '{name}' AS key_name,
  CAST(sum(CASE WHEN r.{keys[0]}_x IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS left_only,
  CAST(sum(CASE WHEN l.{keys[0]}_x IS NOT NULL AND r.{keys[0]}_x IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS both_sides,
  CAST(sum(CASE WHEN l.{keys[0]}_x IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS right_only
FROM (SELECT DISTINCT {ks}, 1 AS {keys[0]}_x FROM {l}) l FULL OUTER JOIN (SELECT DISTINCT {ks}, 1 AS {keys[0]}_x FROM {r}) r ON {on}"""


ORACLE["set_overlap"] = S.with_(
    S.PRODUCTS, S.ATTRIBUTES, S.PAIRS,
    "tr AS (SELECT * FROM pairs WHERE is_train)", "te AS (SELECT * FROM pairs WHERE NOT is_train)",
    "brands AS (SELECT * FROM attributes WHERE name = 'MFG Brand Name')",
) + " UNION ALL ".join([
    _overlap("product_uid", "tr", "te", ["product_uid"]),
    _overlap("search_term", "tr", "te", ["search_term"]),
    _overlap("pair", "tr", "te", ["search_term", "product_uid"]),
    _overlap("brand_vs_desc", "brands", "products", ["product_uid"]),
    _overlap("attr_vs_desc", "attributes", "products", ["product_uid"])])

ORACLE["value_counts_more"] = S.with_(S.PAIRS, S.ATTRIBUTES) + " UNION ALL ".join(
    f"SELECT '{n}' AS key_name, CAST({k} AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS cnt FROM {t} GROUP BY {k}"
    for n, k, t in (("pairs_per_product", "product_uid", "pairs"), ("pairs_per_search", "search_term", "pairs"),
                    ("attributes_per_product", "product_uid", "attributes")))

ORACLE["histogram_uid"] = ORACLE["histogram_len"].replace("length(search_term)", "product_uid")

# ------------------------------------------------------------ pair features ---

_NB = S.with_(S.PRODUCTS, S.ATTRIBUTES, S.PAIRS, S.NB_INPUTS)


def _r(e, name):
    return f"round(CAST({e} AS DOUBLE), 6) AS {name}"


def _last_in(f):
    return f"(CASE WHEN len({S.split_ws('q')}) = 0 THEN 0 ELSE list_contains({S.split_ws(f)}, {S.split_ws('q')}[-1])::INT END)"


def _setcos(f):
    a, b = f"list_distinct({S.split_ws('q')})", f"list_distinct({S.split_ws(f)})"
    return (f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE "
            f"len(list_intersect({a}, {b})) / (sqrt(len({a})) * sqrt(len({b}))) END)")


def _n1(f):
    return f"len(list_distinct(string_split({f}, ' ')))"


def _n2(f):
    return S.n_bigrams(f"string_split({f}, ' ')")


def _dig(f):
    return S.digits(f"string_split({f}, ' ')")


ORACLE["feat_basic"] = _NB + "SELECT pair_id, " + ", ".join([
    _r("length(q)", "search_term_length"),
    _r(_last_in("title"), "last_word_in_title"), _r(_last_in("description"), "last_word_in_desc"),
    _r("(brand <> 'NoBrand')::INT", "have_brand_or_not"), _r("(attributes <> 'noattribute')::INT", "have_attr_or_not"),
    _r(f"len(list_intersect({_dig('q')}, {_dig('attributes')}))", "numbers_in_attr"),
    _r(f"len(list_intersect({_dig('q')}, {_dig('title')}))", "numbers_in_title"),
    _r(f"len(list_intersect({_dig('q')}, {_dig('description')}))", "numbers_in_desc"),
    _r(f"{_n1('q')} * {_n1('title')}", "title_common_word_count"),
    _r(f"{_n1('q')} * {_n1('description')}", "desc_common_word_count"),
    _r(f"{_n1('q')} * {_n1('attributes')}", "attr_common_words_count"),
    _r(f"{_n2('q')} * {_n2('title')}", "title_common_word_count_bigram"),
    _r(f"{_n2('q')} * {_n2('description')}", "desc_common_word_count_bigram"),
    _r(f"{_n2('q')} * {_n2('attributes')}", "attr_common_word_count_bigram"),
]) + " FROM nb_j"

_QS, _BS, _TS = "string_split(trim(q), ' ')", "string_split(trim(brand), ' ')", "string_split(trim(title), ' ')"
_QB, _BB, _TB = "string_split(q, ' ')", "string_split(brand, ' ')", "string_split(title, ' ')"


def _cj(x, y):
    return S.jaccard(S.char_set(x), S.char_set(y))


ORACLE["feat_similarity"] = _NB + "SELECT pair_id, " + ", ".join([
    _r(_setcos("title"), "cosine_search_term_Title"), _r(_setcos("description"), "cosine_search_term_desc"),
    _r(f"list_sum(list_transform({_QB}, lambda x: len(list_filter({_BB}, lambda y: y = x))))", "search_term_contains_brand"),
    _r(S.pairwise_min(_QS, _BS, _cj), "min_jcc_brand_with_search_term"),
    _r(S.pairwise_min(_QB, _BB, lambda x, y: f"levenshtein({x}, {y})"), "min_edit_brand_with_search_term"),
    _r(S.pairwise_min(_QS, _TS, _cj), "min_jcc_title_with_search_term"),
    _r(S.pairwise_min(_QB, _TB, lambda x, y: f"levenshtein({x}, {y})"), "min_edit_title_with_search_term"),
    _r(S.jaccard(f"list_distinct({_QS})", f"list_distinct({_TS})"), "sum_jaccard_product_title_with_search_term"),
    _r("levenshtein(q, title)", "sum_edit_product_title_with_search_term"),
    _r(S.jaccard(f"list_distinct({_QS})", "list_distinct(string_split(trim(description), ' '))"),
       "sum_jcc_prod_desc_with_search_term"),
]) + " FROM nb_j"


def _mean_jcc(field, out):
    return f"""{out}_qw AS (SELECT pair_id, product_uid, x FROM (SELECT pair_id, product_uid, unnest({_QS}) AS x FROM nb_pairs) WHERE x <> ''),
{out}_fw AS (SELECT DISTINCT product_uid, y FROM (SELECT product_uid, unnest(string_split(trim({field}), ' ')) AS y FROM nb_products) WHERE y <> ''),
{out}_best AS (SELECT q.product_uid, q.x, min({S.jaccard(S.char_set('q.x'), S.char_set('f.y'))}) AS m
   FROM (SELECT DISTINCT product_uid, x FROM {out}_qw) q JOIN {out}_fw f ON q.product_uid = f.product_uid GROUP BY q.product_uid, q.x),
{out}_s AS (SELECT w.pair_id, sum(coalesce(b.m, 99999.0)) AS s FROM {out}_qw w LEFT JOIN {out}_best b
   ON w.product_uid = b.product_uid AND w.x = b.x GROUP BY w.pair_id),
{out} AS (SELECT p.pair_id, coalesce(s.s, 0.0) / len({_QS}) AS {out} FROM nb_pairs p LEFT JOIN {out}_s s USING (pair_id))"""


ORACLE["feat_mean_jaccard"] = S.with_(
    S.PRODUCTS, S.ATTRIBUTES, S.PAIRS, S.NB_INPUTS,
    _mean_jcc("title", "mean_jcc_product_title_with_search_term"),
    _mean_jcc("description", "mean_jcc_product_desc_with_search_term"),
    _mean_jcc("attributes", "mean_jcc_attr_with_search_term"),
) + """SELECT pair_id, round(mean_jcc_product_title_with_search_term, 6) AS mean_jcc_product_title_with_search_term,
  round(mean_jcc_product_desc_with_search_term, 6) AS mean_jcc_product_desc_with_search_term,
  round(mean_jcc_attr_with_search_term, 6) AS mean_jcc_attr_with_search_term
FROM mean_jcc_product_title_with_search_term JOIN mean_jcc_product_desc_with_search_term USING (pair_id)
JOIN mean_jcc_attr_with_search_term USING (pair_id)"""


def _bm25(field, name):
    return f"""{name}_c AS (SELECT {field} AS t FROM nb_j WHERE is_train),
{name}_st AS (SELECT count(*) AS n, avg(len({S.split_ws('t')})) AS avgdl FROM {name}_c),
{name}_idf AS (SELECT term, ln((SELECT n FROM {name}_st) / count(*)) + 1 AS idf FROM
   (SELECT unnest(list_distinct(regexp_extract_all(lower(t), '\\w+'))) AS term FROM {name}_c) GROUP BY term),
{name}_w AS (SELECT pair_id, unnest({S.split_ws('q')}) AS term FROM nb_j),
{name}_sc AS (SELECT w.pair_id, sum(coalesce(i.idf, ln((SELECT n FROM {name}_st) + 1)) * ({S.substring_count('j.' + field, 'w.term')} * 2.2)
     / ({S.substring_count('j.' + field, 'w.term')} + 1.2 * 0.25 + 0.75 * len({S.split_ws('j.' + field)}) / (SELECT avgdl FROM {name}_st))) AS s
   FROM {name}_w w JOIN nb_j j ON w.pair_id = j.pair_id LEFT JOIN {name}_idf i ON i.term = w.term GROUP BY w.pair_id),
{name} AS (SELECT j.pair_id, coalesce(s.s, 0.0) AS {name} FROM nb_j j LEFT JOIN {name}_sc s USING (pair_id))"""


ORACLE["bm25_pair_score"] = S.with_(
    S.PRODUCTS, S.ATTRIBUTES, S.PAIRS, S.NB_INPUTS,
    _bm25("title", "bm25_ST"), _bm25("description", "bm25_SD"), _bm25("brand", "bm25_SB"),
) + """SELECT pair_id, round(bm25_ST, 6) AS bm25_ST, round(bm25_SD, 6) AS bm25_SD, round(bm25_SB, 6) AS bm25_SB
FROM bm25_ST JOIN bm25_SD USING (pair_id) JOIN bm25_SB USING (pair_id)"""

_STOP = S.sql_list()


def _v1_tokens(e):
    return f"list_filter(regexp_extract_all(lower({e}), '\\b\\w\\w+\\b'), lambda t: NOT list_contains({_STOP}, t))"


_VOCAB = f"""v_docs AS (SELECT DISTINCT title || '. ' || description AS t FROM nb_j),
v_toks AS (SELECT {_v1_tokens('t')} AS toks FROM v_docs),
v_n AS (SELECT count(*) AS n FROM v_docs),
v_tot AS (SELECT term, count(*) AS tf_total FROM (SELECT unnest(toks) AS term FROM v_toks) GROUP BY term),
v_df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM v_toks) GROUP BY term),
v_kept AS (SELECT d.term, d.df FROM v_df d JOIN v_tot t USING (term) WHERE d.df >= 2 ORDER BY t.tf_total DESC, d.term LIMIT 10000),
vocab AS (SELECT term, df, ln((1.0 + (SELECT n FROM v_n)) / (1.0 + df)) + 1.0 AS idf,
          row_number() OVER (ORDER BY term) - 1 AS term_index FROM v_kept)"""

ORACLE["tfidf_weights"] = _NB[:-1] + ",\n" + _VOCAB + """
SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf, CAST(term_index AS BIGINT) AS term_index FROM vocab"""

ORACLE["tfidf_minmax"] = _NB[:-1] + ",\n" + _VOCAB + f""",
w AS (SELECT pair_id, title, unnest({S.split_ws('q')}) AS term FROM nb_j),
v AS (SELECT w.pair_id, CAST({S.substring_count('w.title', 'w.term')} AS DOUBLE) AS tf,
             coalesce(vocab.idf, ln((SELECT n FROM v_n) + 1)) AS idf FROM w LEFT JOIN vocab USING (term)),
agg AS (SELECT pair_id, max(tf) AS max_tf_ST, max(idf) AS max_idf_ST, max(tf * idf) AS max_tfidf_ST,
               min(tf) AS min_tf_ST, min(idf) AS min_idf_ST, min(tf * idf) AS min_tfidf_ST,
               sum(tf) AS sum_tf_ST, sum(idf) AS sum_idf_ST, sum(tf * idf) AS sum_tfidf_ST FROM v GROUP BY pair_id)
SELECT p.pair_id, {", ".join(f"round({c}, 6) AS {c}" for c in ["max_tf_ST", "max_idf_ST", "max_tfidf_ST", "min_tf_ST", "min_idf_ST", "min_tfidf_ST"])},
  round(coalesce(sum_tf_ST, 0.0), 6) AS sum_tf_ST, round(coalesce(sum_idf_ST, 0.0), 6) AS sum_idf_ST,
  round(coalesce(sum_tfidf_ST, 0.0), 6) AS sum_tfidf_ST
FROM nb_pairs p LEFT JOIN agg USING (pair_id)"""


def _weights(src, key, text, name):
    return f"""{name}_occ AS (SELECT {key} AS k, unnest({_v1_tokens(text)}) AS term FROM {src}),
{name}_w AS (SELECT k, term, count(*) * any_value(idf) AS w FROM {name}_occ JOIN vocab USING (term) GROUP BY k, term),
{name} AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS weight FROM {name}_w)"""


ORACLE["tfidf_cosine"] = _NB[:-1] + ",\n" + _VOCAB + ",\n" + _weights("nb_pairs", "pair_id", "q", "wa") + ",\n" + \
    _weights("nb_j", "pair_id", "title || '. ' || description", "wb") + """,
cos AS (SELECT a.k AS pair_id, sum(a.weight * b.weight) AS c FROM wa a JOIN wb b ON a.k = b.k AND a.term = b.term GROUP BY a.k)
SELECT p.pair_id, round(coalesce(c, 0.0), 6) AS cosine_tfidf FROM nb_pairs p LEFT JOIN cos USING (pair_id)"""

# ------------------------------------------------------------------ spelling ---

_VOCAB_PART = f"""lines AS MATERIALIZED (SELECT {S.strip_stopwords(S.clean('product_title') + " || ' ' || " + S.clean('brand'))} AS line FROM part_products),
pvocab AS MATERIALIZED (SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(lower(line), '{S.UNICODE_WORD}')) AS word FROM lines) GROUP BY word)"""

ORACLE["word_freq"] = S.with_(S.PART_PRODUCTS, _VOCAB_PART) + \
    "SELECT word, CAST(cnt AS BIGINT) AS cnt, round(cnt / (SELECT sum(cnt) FROM pvocab), 6) AS freq FROM pvocab"

_SPELL = S.with_(
    S.PART_PRODUCTS, S.PART_QUERIES, _VOCAB_PART,
    "letters AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS c)",
    f"qtok AS MATERIALIZED (SELECT query_id, unnest({S.split_ws('lower(' + S.clean('text', True) + ')')}) AS word, "
    f"generate_subscripts({S.split_ws('lower(' + S.clean('text', True) + ')')}, 1) AS pos FROM part_queries)",
    "toks AS MATERIALIZED (SELECT DISTINCT word FROM qtok)",
    "k0 AS MATERIALIZED (SELECT word, word AS corrected, 0 AS level FROM toks WHERE word IN (SELECT word FROM pvocab))",
    "r1 AS MATERIALIZED (SELECT word, word AS s FROM toks WHERE word NOT IN (SELECT word FROM pvocab))",
    f"e1 AS MATERIALIZED ({S.edits_sql('r1')})",
    """k1 AS MATERIALIZED (SELECT e.word, (list(v.word ORDER BY v.cnt DESC, v.word))[1] AS corrected, 1 AS level
            FROM (SELECT DISTINCT word, x FROM e1) e JOIN pvocab v ON e.x = v.word GROUP BY e.word)""",
    "r2 AS MATERIALIZED (SELECT word, word AS s FROM r1 WHERE word NOT IN (SELECT word FROM k1))",
    # two edits meet in the middle: strings one edit from the word, and strings that are one edit before a known word
    f"e2 AS MATERIALIZED (SELECT DISTINCT word, x FROM ({S.edits_sql('r2')}))",
    "chars AS MATERIALIZED (SELECT c FROM letters UNION SELECT unnest(string_split(word, '')) FROM r2)",
    "vs AS (SELECT word, word AS s FROM pvocab)",
    f"v1 AS MATERIALIZED (SELECT DISTINCT word, x FROM ({S.inverse_edits_sql('vs')}))",
    """k2 AS MATERIALIZED (SELECT e.word, (list(v.word ORDER BY v.cnt DESC, v.word))[1] AS corrected, 2 AS level
            FROM (SELECT DISTINCT e2.word, v1.word AS cand FROM e2 JOIN v1 USING (x)) e JOIN pvocab v ON e.cand = v.word GROUP BY e.word)""",
    """fixed AS MATERIALIZED (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2
              UNION ALL SELECT word, word, -1 FROM r2 WHERE word NOT IN (SELECT word FROM k2))""",
)

ORACLE["spell_correct"] = _SPELL + "SELECT word, corrected, CAST(level AS INTEGER) AS level FROM fixed"

ORACLE["spell_text"] = _SPELL + """SELECT p.query_id, coalesce(t.corrected, '') AS corrected FROM part_queries p LEFT JOIN
  (SELECT query_id, string_agg(f.corrected, ' ' ORDER BY q.pos) AS corrected FROM qtok q JOIN fixed f USING (word) GROUP BY query_id) t
  USING (query_id)"""

# ---------------------------------------------------------------- embeddings ---


def _cos(a, b):
    d = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"(CASE WHEN {d} = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / {d} END)"


_SP = S.with_(
    "wv AS (SELECT vec_id AS word_id, CAST(embedding AS DOUBLE[]) AS vector, label AS sentence_id FROM embeddings)",
    """s AS (SELECT CAST(floor(word_id / 8) AS BIGINT) AS pair_id, 'a' AS side, word_id, vector FROM wv
          UNION ALL SELECT CAST(floor(word_id / 8) AS BIGINT) - 1, 'b', word_id, vector FROM wv)""",
    "sp AS (SELECT * FROM s WHERE pair_id IN (SELECT pair_id FROM s GROUP BY pair_id HAVING count(DISTINCT side) = 2))",
)

ORACLE["emb_max_cosine"] = _SP + f"""SELECT pair_id, round(avg(m), 6) AS max_cosine_sim_per_word FROM
  (SELECT a.pair_id, a.word_id, max({_cos('a.vector', 'b.vector')}) AS m
   FROM sp a JOIN sp b ON a.pair_id = b.pair_id AND a.side = 'a' AND b.side = 'b' GROUP BY a.pair_id, a.word_id)
GROUP BY pair_id"""

_CENTROID = """cen AS (SELECT pair_id, side, list(x ORDER BY dim) AS c FROM
  (SELECT pair_id, side, dim, avg(x) AS x FROM
     (SELECT pair_id, side, unnest(vector) AS x, generate_subscripts(vector, 1) AS dim FROM sp) GROUP BY pair_id, side, dim)
  GROUP BY pair_id, side)"""

ORACLE["emb_centroid"] = _SP[:-1] + ",\n" + _CENTROID + f"""
SELECT a.pair_id, round({_cos('a.c', 'b.c')}, 6) AS w2v_n_similarity,
  round(list_sum(list_transform(list_zip(a.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(a.c), 6) AS w2v_centroid_rmse
FROM cen a JOIN cen b ON a.pair_id = b.pair_id AND a.side = 'a' AND b.side = 'b'"""

ORACLE["emb_neighbors"] = _SP[:-1] + """,
lc AS (SELECT sentence_id AS query_id, list(x ORDER BY dim) AS q FROM
  (SELECT sentence_id, dim, avg(x) AS x FROM
     (SELECT sentence_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS dim FROM wv) GROUP BY sentence_id, dim)
  GROUP BY sentence_id),
sc AS (SELECT lc.query_id, wv.word_id, round(""" + _cos("lc.q", "wv.vector") + """, 9) AS cosine FROM lc CROSS JOIN wv)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(word_id AS BIGINT) AS word_id, CAST(rank AS BIGINT) AS rank,
  round(cosine, 6) AS cosine FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, word_id) AS rank FROM sc) WHERE rank <= 10"""

# -------------------------------------------------------------------- models ---

from relevo.operators.features import FEATURE_ORDER as _ORDER  # noqa: E402

_BASIC = _ORDER[:14]

ORACLE["standard_scale"] = f"WITH fb AS ({ORACLE['feat_basic']})\nSELECT pair_id, " + ", ".join(
    f"round((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1.0), 6) AS {c}"
    for c in _BASIC) + " FROM fb"

_HASH = "(CAST(('0x' || substr(md5('122:' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0)"

ORACLE["stratified_split"] = S.with_(S.PAIRS) + f"""SELECT relevance_class, split, CAST(count(*) AS BIGINT) AS n_rows FROM
  (SELECT relevance_class, CASE WHEN h <= quantile_disc(h, 0.8) OVER (PARTITION BY relevance_class) THEN 'train' ELSE 'test' END AS split
   FROM (SELECT ([3.00, 2.33, 2.67, 2.00, 1.67, 1.33, 1.00]::DOUBLE[])[list_position(d, list_min(d))] AS relevance_class, h
   FROM (SELECT {_HASH} AS h, list_transform([3.00, 2.33, 2.67, 2.00, 1.67, 1.33, 1.00]::DOUBLE[], lambda v: abs(relevance - v)) AS d FROM pairs)))
GROUP BY ALL"""

_FB_REL = f"WITH fb0 AS ({ORACLE['feat_basic']}), " + S.PAIRS + \
    ", fb AS (SELECT fb0.*, p.relevance FROM fb0 JOIN pairs p ON p.id = fb0.pair_id)\n"
_CORR_COLS = ["relevance", "search_term_length", "numbers_in_title", "title_common_word_count",
              "desc_common_word_count", "last_word_in_title"]
ORACLE["corr_matrix"] = _FB_REL + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(covar_samp(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) / nullif(stddev_samp(CAST({a} AS DOUBLE)) * stddev_samp(CAST({b} AS DOUBLE)), 0), 6) AS corr FROM fb"
    for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:])

_RANK_COLS = ["search_term_length", "last_word_in_title", "last_word_in_desc", "numbers_in_title",
              "title_common_word_count", "desc_common_word_count", "title_common_word_count_bigram"]
ORACLE["corr_rank"] = _FB_REL + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(covar_samp(CAST({c} AS DOUBLE), CAST(relevance AS DOUBLE)) / nullif(stddev_samp(CAST({c} AS DOUBLE)) * stddev_samp(CAST(relevance AS DOUBLE)), 0), 6) AS corr FROM fb"
    for c in _RANK_COLS)

ORACLE["error_box"] = S.with_(
    S.PAIRS,
    "d AS (SELECT relevance - (SELECT avg(relevance) FROM pairs WHERE is_train) AS diff FROM pairs WHERE NOT is_train)",
    "q AS (SELECT quantile_cont(diff, 0.25) AS q1, quantile_cont(diff, 0.5) AS med, quantile_cont(diff, 0.75) AS q3 FROM d)",
) + """SELECT round(min(diff), 6) AS min_v, round(max(diff), 6) AS max_v, round(any_value(q1), 6) AS q1,
  round(any_value(med), 6) AS median, round(any_value(q3), 6) AS q3,
  round(min(diff) FILTER (WHERE diff >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo,
  round(max(diff) FILTER (WHERE diff <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
  CAST(sum(CASE WHEN diff < q1 - 1.5 * (q3 - q1) OR diff > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers
FROM d, q"""

ORACLE["rmse_fixed"] = S.with_(
    S.PAIRS,
    """w AS (SELECT is_train, relevance, (SELECT avg(relevance) FROM pairs WHERE is_train) AS train_mean, 2.0 AS constant_two,
       greatest(1.0, least(3.0, length(search_term) / 40.0)) AS search_length FROM pairs)""",
) + " UNION ALL ".join(f"SELECT '{m}' AS model, is_train, round(sqrt(avg((relevance - {m}) * (relevance - {m}))), 6) AS rmse FROM w GROUP BY is_train"
                      for m in ("train_mean", "constant_two", "search_length"))


def _w2v(field, suffix):
    wid = "(CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % (SELECT n FROM n_vec))"
    unit = lambda k: f"{k}.unit"
    return f"""q_{suffix} AS (SELECT pair_id, product_uid, {wid} AS word_id FROM (SELECT pair_id, product_uid, unnest({S.split_ws('q')}) AS w FROM nb_pairs)),
f_{suffix} AS (SELECT product_uid, {wid} AS word_id FROM (SELECT product_uid, unnest({S.split_ws(field)}) AS w FROM nb_products)),
b_{suffix} AS (SELECT x.product_uid, x.word_id, max(list_dot_product({unit('u')}, {unit('v')})) AS m
  FROM (SELECT DISTINCT product_uid, word_id FROM q_{suffix}) x JOIN vec u ON u.word_id = x.word_id
  JOIN (SELECT DISTINCT product_uid, word_id FROM f_{suffix}) y ON y.product_uid = x.product_uid JOIN vec v ON v.word_id = y.word_id GROUP BY ALL),
t_{suffix} AS (SELECT pair_id, avg(coalesce(m, 0.0)) AS best FROM q_{suffix} LEFT JOIN b_{suffix} USING (product_uid, word_id) GROUP BY pair_id),
cq_{suffix} AS (SELECT pair_id, list(x ORDER BY dim) AS c FROM (SELECT pair_id, dim, avg(x) AS x FROM
  (SELECT pair_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS dim FROM q_{suffix} JOIN vec USING (word_id)) GROUP BY ALL) GROUP BY pair_id),
cf_{suffix} AS (SELECT product_uid, list(x ORDER BY dim) AS c FROM (SELECT product_uid, dim, avg(x) AS x FROM
  (SELECT product_uid, unnest(vector) AS x, generate_subscripts(vector, 1) AS dim FROM f_{suffix} JOIN vec USING (word_id)) GROUP BY ALL) GROUP BY product_uid),
o_{suffix} AS (SELECT p.pair_id, round(coalesce(best, 0.0), 6) AS max_cosine_sim_per_word_{suffix},
  round(coalesce({_cos('a.c', 'b.c')}, 0.0), 6) AS w2v_n_similarity_{suffix},
  round(coalesce(list_sum(list_transform(list_zip(a.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(a.c), 0.0), 6) AS w2v_centroid_rmse_{suffix}
  FROM nb_pairs p LEFT JOIN t_{suffix} USING (pair_id) LEFT JOIN cq_{suffix} a USING (pair_id) LEFT JOIN cf_{suffix} b ON b.product_uid = p.product_uid)"""


ORACLE["w2v_pair_features"] = S.with_(
    S.PRODUCTS, S.ATTRIBUTES, S.PAIRS, S.NB_INPUTS,
    """vec AS (SELECT word_id, vector, list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector))) AS unit FROM
      (SELECT vec_id AS word_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings))""",
    "n_vec AS (SELECT max(word_id) + 1 AS n FROM vec)",
    _w2v("title", "title"), _w2v("description", "desc"),
) + "SELECT * FROM o_title JOIN o_desc USING (pair_id)"

# ----------------------------------------------------------------- streaming ---

ORACLE["stream_bm25_topn"] = ORACLE["bm25_topn"]

# ------------------------------------------------------------- sources/sinks ---

ORACLE["csv_roundtrip"] = S.with_(S.PRODUCTS) + "SELECT * FROM products"
ORACLE["csv_utf8_roundtrip"] = S.with_(S.PAIRS) + "SELECT id, product_uid, product_title, search_term, relevance FROM pairs"
ORACLE["corpus_roundtrip"] = ORACLE["word_freq"]
ORACLE["json_records"] = "SELECT CAST(to_json({'query_id': query_id, 'product_uid': product_uid, 'rank': rank}) AS VARCHAR) AS json FROM (" + \
    ORACLE["bm25_topn"] + ")"

# -------------------------------------------------------------- app features ---

_APP = S.with_(
    S.PART_PRODUCTS, S.PART_QUERIES,
    f"""app_pairs AS (SELECT pair_id, product_uid, CASE WHEN q0 = '' THEN 'missing_search' ELSE q0 END AS q FROM
      (SELECT q.query_id || '#' || CAST(p.product_uid AS VARCHAR) AS pair_id, p.product_uid,
              {S.strip_stopwords(S.clean('q.text', True))} AS q0
       FROM part_queries q JOIN part_products p ON q.truth = p.product_title))""",
    f"""app_products AS (SELECT product_uid, {S.strip_stopwords(S.clean('product_title'))} AS title,
       regexp_replace({S.strip_stopwords(S.clean('product_description'))}, 'bullet [0-9][0-9] ', '', 'g') AS description,
       regexp_replace({S.strip_stopwords(S.clean('product_description'))}, 'bullet [0-9][0-9] ', '', 'g') AS attributes,
       CASE WHEN {S.strip_stopwords(S.clean('brand'))} = '' THEN 'missing_brand' ELSE {S.strip_stopwords(S.clean('brand'))} END AS brand
     FROM part_products)""",
    "nb_j AS (SELECT * FROM app_pairs JOIN app_products USING (product_uid))",
)


def _cols_of(sql_select):
    return sql_select[sql_select.index("SELECT pair_id, ") + len("SELECT pair_id, "):sql_select.rindex(" FROM nb_j")]


ORACLE["app_features"] = _APP + "SELECT pair_id, " + _cols_of(ORACLE["feat_basic"]) + ", " + \
    _cols_of(ORACLE["feat_similarity"]) + " FROM nb_j"

# ------------------------------------------------------- full feature table ---

from relevo.operators.features import FEATURE_ORDER as _FEATURE_ORDER  # noqa: E402

_LATENT = _NB[:-1] + ",\n" + _VOCAB + ",\n" + _weights("nb_pairs", "pair_id", "q", "wa") + ",\n" + \
    _weights("nb_j", "pair_id", "title || '. ' || description", "wb") + ",\n" + \
    _weights("nb_j", "pair_id", "description", "wd") + """,
c1 AS (SELECT a.k AS pair_id, sum(a.weight * b.weight) AS c FROM wa a JOIN wb b ON a.k = b.k AND a.term = b.term GROUP BY a.k),
c2 AS (SELECT a.k AS pair_id, sum(a.weight * d.weight) AS c FROM wa a JOIN wd d ON a.k = d.k AND a.term = d.term GROUP BY a.k)
SELECT p.pair_id, round(coalesce(c1.c, 0.0), 6) AS cosine_similarity_tfidf_search_title_des,
  round(coalesce(c2.c, 0.0), 6) AS cosine_similarity_tfidf_search_des
FROM nb_pairs p LEFT JOIN c1 USING (pair_id) LEFT JOIN c2 USING (pair_id)"""

ORACLE["pair_features"] = f"""WITH fb AS ({ORACLE['feat_basic']}),
fs AS ({ORACLE['feat_similarity']}),
fm AS ({ORACLE['feat_mean_jaccard']}),
fl AS ({_LATENT}),
f25 AS ({ORACLE['bm25_pair_score']}),
ftf AS ({ORACLE['tfidf_minmax']}),
lab AS ({S.with_(S.PAIRS)} SELECT id AS pair_id, relevance, is_train FROM pairs)
SELECT lab.pair_id, lab.relevance, lab.is_train, {", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in _FEATURE_ORDER)}
FROM lab JOIN fb USING (pair_id) JOIN fs USING (pair_id) JOIN fm USING (pair_id) JOIN fl USING (pair_id)
JOIN f25 USING (pair_id) JOIN ftf USING (pair_id)"""

ORACLE["shared_pairs"] = S.with_(S.PAIRS) + """SELECT a.product_title, a.search_term, a.id AS id_x, a.relevance, b.id AS id_y
FROM pairs a JOIN pairs b ON a.product_title = b.product_title AND a.search_term = b.search_term
WHERE a.is_train AND NOT b.is_train"""

ORACLE["attr_null_rows"] = S.with_(S.ATTRIBUTES) + """SELECT
  CAST(sum(CASE WHEN product_uid IS NOT NULL AND value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS uid_no_value,
  CAST(sum(CASE WHEN product_uid IS NULL AND name IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_uid_no_name,
  CAST(sum(CASE WHEN product_uid IS NOT NULL AND name IS NOT NULL AND value IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS complete
FROM attributes"""

ORACLE["catalog_preview"] = _CATALOG + "SELECT product_uid, product_title, brand FROM catalog ORDER BY product_uid LIMIT 5"


def _bigr(l):
    return f"list_transform(range(1, len({l})), lambda i: {l}[i] || ' ' || {l}[i + 1])"


ORACLE["feat_ngram_overlap"] = _NB + f"""SELECT pair_id,
  CAST(len(list_intersect(string_split(q, ' '), string_split(title, ' '))) AS BIGINT) AS title_unigram_overlap,
  CAST(len(list_intersect(string_split(q, ' '), string_split(description, ' '))) AS BIGINT) AS desc_unigram_overlap,
  CAST(len(list_intersect({_bigr("string_split(q, ' ')")}, {_bigr("string_split(title, ' ')")})) AS BIGINT) AS title_bigram_overlap,
  CAST(len(list_intersect({_bigr("string_split(q, ' ')")}, {_bigr("string_split(description, ' ')")})) AS BIGINT) AS desc_bigram_overlap
FROM nb_j"""

ORACLE["tfidf_cosine_title"] = _NB[:-1] + ",\n" + _VOCAB + ",\n" + _weights("nb_pairs", "pair_id", "q", "wa") + ",\n" + \
    _weights("nb_j", "pair_id", "title", "wt") + """,
cos AS (SELECT a.k AS pair_id, sum(a.weight * b.weight) AS c FROM wa a JOIN wt b ON a.k = b.k AND a.term = b.term GROUP BY a.k)
SELECT p.pair_id, round(coalesce(c, 0.0), 6) AS cosine_similarity_tfidf_search_title FROM nb_pairs p LEFT JOIN cos USING (pair_id)"""

ORACLE["bm25_topn_padded"] = "WITH top AS (" + ORACLE["bm25_topn"] + "),\n" + S.QUERIES + """,
cnt AS (SELECT q.query_id, count(t.product_uid) AS m FROM queries q LEFT JOIN top t USING (query_id) GROUP BY q.query_id),
firstd AS (SELECT doc_id AS product_uid FROM documents ORDER BY doc_id LIMIT 20),
pad AS (SELECT c.query_id, f.product_uid, c.m FROM cnt c CROSS JOIN firstd f
        WHERE c.m < 10 AND NOT EXISTS (SELECT 1 FROM top t WHERE t.query_id = c.query_id AND t.product_uid = f.product_uid)),
padr AS (SELECT query_id, product_uid, m + row_number() OVER (PARTITION BY query_id ORDER BY product_uid) AS rank FROM pad)
SELECT query_id, product_uid, rank, score FROM top
UNION ALL SELECT CAST(query_id AS BIGINT), CAST(product_uid AS BIGINT), CAST(rank AS BIGINT), CAST(0.0 AS DOUBLE) FROM padr WHERE rank <= 10"""

# texts and words as Spark's trim and split on \s+ give them: measures keep single blanks only
ORACLE["word_pair_counts"] = _NB[:-1] + """,
wt AS (SELECT row_number() OVER (ORDER BY t) AS doc, t FROM (SELECT description AS t FROM nb_products UNION SELECT q FROM nb_pairs UNION SELECT title FROM nb_products)),
wp AS MATERIALIZED (SELECT doc, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM (SELECT doc, list_filter(regexp_split_to_array(trim(t), '\\s+'), lambda x: x <> '') AS w FROM wt)),
wn AS MATERIALIZED (SELECT a.word, b.word AS context, count(*) AS n FROM wp a JOIN wp b ON a.doc = b.doc AND a.pos <> b.pos AND b.pos BETWEEN a.pos - 5 AND a.pos + 5 GROUP BY 1, 2),
wc AS MATERIALIZED (SELECT word, sum(n) AS c FROM wn GROUP BY word),
cx AS MATERIALIZED (SELECT word AS context, c FROM wc ORDER BY c DESC, word LIMIT 200),
wv AS (SELECT wn.word, ln(n / wc.c * (SELECT sum(pow(c, 0.75)) FROM cx) / pow(cx.c, 0.75)) AS v FROM wn JOIN cx USING (context) JOIN wc ON wn.word = wc.word)
SELECT word, count(*)::BIGINT AS n_contexts, round(sum(v), 6) AS weight FROM wv WHERE v > 0 GROUP BY word"""


_CORR_COLS = [*_FEATURE_ORDER, "relevance"]
_CORR = "WITH f AS (" + ORACLE["pair_features"] + "),\ncorrs AS (SELECT unnest([" + ", ".join(
    f"{{'col_a': '{a}', 'col_b': '{b}', 'corr': CASE WHEN min({a}) = max({a}) OR min({b}) = max({b}) THEN NULL ELSE round(corr({a}, {b}), 6) + 0.0 END}}"
    for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]) + "], recursive := true) FROM f)\n"
ORACLE["corr_features"] = _CORR + "SELECT col_a, col_b, corr FROM corrs"
ORACLE["corr_features_rank"] = _CORR + "SELECT col_a AS feature, corr FROM corrs WHERE col_b = 'relevance'"
ORACLE["table_shapes"] = _CATALOG + """SELECT 'pairs' AS table_name, count(*) AS n_rows, 6::BIGINT AS n_columns FROM pairs
UNION ALL SELECT 'products', count(*), 3 FROM products UNION ALL SELECT 'attributes', count(*), 4 FROM attributes UNION ALL SELECT 'catalog', count(*), 6 FROM catalog"""
