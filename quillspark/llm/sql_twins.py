"""SQL twins of the numbered queries that SQL can express, over the whole tables."""

_USABLE = """u AS (SELECT vec_id, aggregate_embedding::DOUBLE[] AS e FROM condition_embeddings WHERE len(aggregate_embedding) = 128
  AND NOT list_bool_or(list_transform(aggregate_embedding, lambda x: x IS NULL OR isnan(x))) AND list_bool_or(list_transform(aggregate_embedding, lambda x: x <> 0)))"""

_P1 = f"""WITH {_USABLE}, s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS cos FROM u a JOIN u b ON a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS n FROM s), k AS (SELECT * FROM r WHERE n <= 10 AND cos >= 0.8)
  SELECT x.a AS vec_a, x.b AS vec_b FROM k x JOIN k y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b"""


def _p3(field: str, limit: int) -> str:
    space = r"[\s\x{00A0}]"
    text = rf"regexp_replace(regexp_replace({field}, '^{space}+', ''), '{space}+$', '')"
    marked = rf"string_split(regexp_replace(t, '([.!?])({space})', '\1' || chr(1) || '\2', 'g'), chr(1))"
    stretch = rf"list_max(list_transform(string_split_regex(t, '{space}+'), lambda x: length(x)))"
    part = rf"list_max(list_transform({marked}, lambda x: length(regexp_replace(regexp_replace(x, '^{space}+', ''), '{space}+$', ''))))"
    return rf"""SELECT record_id, '{field}' AS field, CASE WHEN {stretch} > {limit} THEN 'forced' WHEN {part} <= {limit} THEN 'sentence' ELSE 'word' END AS cut
      FROM (SELECT record_id, {text} AS t FROM papers) WHERE length(t) > {limit}"""


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_P7 = f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM eval_items), n AS (SELECT item_id, w, least(12, len(w)) AS n FROM i WHERE len(w) > 0),
  ig AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM n)),
  d AS (SELECT doc_id, {_WORDS} AS w FROM documents), sizes AS (SELECT DISTINCT n FROM n),
  dg AS (SELECT DISTINCT doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n))
  SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (n, g)"""

_SIMPLE = r"list_filter(list_transform(string_split(mesh_terms, ';'), lambda x: lower(regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', ''))), lambda x: x <> '')"
_TERMS = f"t AS (SELECT record_id, unnest({_SIMPLE}) AS term FROM papers), total AS (SELECT count(DISTINCT record_id) AS n FROM t)"
_P2 = f"""WITH {_TERMS}, c AS (SELECT term, count(*) AS occurrences, count(DISTINCT record_id) AS records FROM t GROUP BY ALL)
  SELECT term, occurrences, records, n AS total_records, CASE WHEN records < 3 THEN 'rare' WHEN records > n * 0.2::DOUBLE THEN 'common' END AS mark FROM c, total"""
_P4 = f"""WITH {_TERMS}, d AS (SELECT DISTINCT record_id, term FROM t), c AS (SELECT term, count(*) AS n FROM d GROUP BY ALL),
  p AS (SELECT a.term AS item_a, b.term AS item_b, count(*) AS together FROM d a JOIN d b ON a.record_id = b.record_id AND a.term < b.term GROUP BY ALL),
  l AS (SELECT item_a, item_b, together, x.n AS count_a, y.n AS count_b, total.n AS total, together::DOUBLE / x.n * total.n / y.n AS lift FROM p JOIN c x ON x.term = item_a JOIN c y ON y.term = item_b, total)
  SELECT item_a, item_b, together, count_a, count_b, total, round(lift, 6) AS lift, round(log2(lift), 6) AS pmi FROM l"""

_BLANK = r"[\s\v\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_P8 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), k AS (SELECT list(DISTINCT lower(word)) AS known FROM common_words WHERE word IS NOT NULL),
  w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_BLANK}+'), lambda x: x <> '') AS words,
    list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x{{85}}\x{{2028}}]'), lambda x: regexp_matches(x, '\S')) AS lines FROM d),
  t AS (SELECT *, list_filter(list_transform(lines, lambda x: regexp_matches(rtrim(x), '[.!?]["'')\]»”]{{0,5}}$')), lambda x: x) AS ended,
    list_filter(flatten(list_transform(lines, lambda x: regexp_split_to_array(lower(x), '[^\p{{L}}\p{{N}}''’-]+'))), lambda x: x <> '') AS tokens FROM w),
  s AS (SELECT doc_id, length(text) AS n_chars, len(words) AS n_words, len(lines) AS n_lines, coalesce(list_sum(list_transform(words, lambda x: length(x))) / nullif(len(words), 0), 0.0)::DOUBLE AS mean_word_len,
    coalesce(len(ended) / nullif(len(lines), 0), 0.0)::DOUBLE AS end_punct_share, len(list_filter(tokens, lambda x: list_contains(known, x))) AS common_words, len(tokens) AS n_tokens FROM t, k)
  SELECT doc_id, n_chars, n_words, n_lines, round(mean_word_len, 6) AS mean_word_len, round(end_punct_share, 6) AS end_punct_share, round(coalesce(common_words / nullif(n_tokens, 0), 0.0), 6)::DOUBLE AS common_share,
    list_filter([CASE WHEN n_words < 50 OR n_words > 100000 THEN 'gopher_word_count' END, CASE WHEN mean_word_len < 3 OR mean_word_len > 10 THEN 'gopher_mean_word_length' END, CASE WHEN common_words < 2 THEN 'gopher_stop_words' END,
      CASE WHEN end_punct_share <= 0.12 THEN 'fineweb_line_punctuation' END], lambda x: x IS NOT NULL) AS failed FROM s"""

SQL = {"p1_found": _P1, "p2_semicolon_terms": _P2, "p3_found": f"{_p3('abstract', 2000)} UNION ALL {_p3('title', 250)}", "p4_semicolon_pairs": _P4, "p7_found": _P7, "p8_statistics": _P8}
