"""SQL with the results of the queries in ``queries.py`` that SQL can express on whole tables."""

from __future__ import annotations

_FOLD = r"strip_accents(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')))"
_ACT = "regexp_replace(" + _FOLD.format("act") + ", '^ato_', '')"
_TYPE = r"lower(regexp_replace(entity_type, '^\s+|\s+$', '', 'g'))"
_SPLIT = r"lower(regexp_replace(split, '^\s+|\s+$', '', 'g'))"
_SPLIT = f"CASE WHEN {_SPLIT} IN ('valid', 'validation') THEN 'dev' ELSE {_SPLIT} END"
_SOURCE = r"translate(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), ' _', '--')"
_PUB = "try_cast(regexp_replace(publication, '[^0-9]', '', 'g') AS BIGINT)"

_CELLS = f"""
WITH cell AS (
  SELECT DISTINCT record_id, {_ACT} AS act, {_TYPE} AS entity_type, is_negative::INT AS is_negative FROM gner_records
), known AS (
  SELECT * FROM cell WHERE record_id IS NOT NULL AND act IS NOT NULL AND entity_type IS NOT NULL AND is_negative IS NOT NULL
), size AS (SELECT count(DISTINCT record_id) // 10 AS n FROM gner_records
), asked AS (
  SELECT act, entity_type, is_negative, greatest(min_rows::BIGINT, (target_bp * n + 9999) // 10000) AS wanted FROM sample_targets, size
), supply AS (SELECT act, entity_type, is_negative, count(*) AS supply FROM known GROUP BY ALL
), report AS (
  SELECT act, entity_type, is_negative, wanted, coalesce(supply, 0) AS supply FROM asked LEFT JOIN supply USING (act, entity_type, is_negative)
)"""

#: Words, and distinct three-word sequences by act, with the split of the act.
_ACTS = rf"""
WITH act AS (
  SELECT act_id, arg_min(input, record_id) FILTER (regexp_matches(input, '[\p{{L}}\p{{N}}]')) AS text, max({_SPLIT}) AS split
  FROM gner_records WHERE act_id IS NOT NULL GROUP BY act_id
), word AS (
  SELECT act_id, split, list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(text)), '\p{{Mn}}', '', 'g'), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM act
), sets AS (
  SELECT act_id, split, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s
  FROM word WHERE len(w) >= 3
), entry AS (SELECT act_id, unnest(s) AS e FROM sets
), common AS (
  SELECT x.act_id AS a, y.act_id AS b, count(*) AS c FROM entry x JOIN entry y ON x.e = y.e AND x.act_id < y.act_id GROUP BY ALL
), near AS (
  SELECT a, b, x.split AS sa, y.split AS sb, c, len(x.s) AS na, len(y.s) AS nb
  FROM common JOIN sets x ON x.act_id = a JOIN sets y ON y.act_id = b WHERE 2 * c >= len(x.s) + len(y.s) - c
), sides AS (
  SELECT * FROM near WHERE (sa = 'train' AND sb IN ('dev', 'test')) OR (sb = 'train' AND sa IN ('dev', 'test'))
), overlap AS (
  SELECT CASE WHEN sa = 'train' THEN b ELSE a END AS eval_id, CASE WHEN sa = 'train' THEN a ELSE b END AS train_id,
         CASE WHEN sa = 'train' THEN sb ELSE sa END AS eval_split, c / (na + nb - c) AS similarity,
         c / (CASE WHEN sa = 'train' THEN nb ELSE na END) AS containment
  FROM sides
)"""

_BY_RECORD = """ SELECT eval_id, eval_split, count(*) AS pairs, count(*) FILTER (similarity = 1) AS copies, max(similarity) AS similarity,
        max(containment) AS containment FROM overlap GROUP BY ALL"""

_CHARS = "coalesce(length(input), 0) + coalesce(length(output), 0)"

_WORDS = rf"""
WITH doc AS (
  SELECT {_SOURCE} AS source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\r\n]+'), lambda w: w <> '')) AS n
  FROM documents WHERE source IS NOT NULL
), total AS (SELECT coalesce(sum(n), 0)::BIGINT AS total FROM doc
), units AS (SELECT source, sum(n)::BIGINT AS units FROM doc GROUP BY source
), plan AS (
  SELECT {_SOURCE} AS source, target_bp::BIGINT AS target_bp, max_repeats::BIGINT AS max_repeats FROM source_weights
), offer AS (
  SELECT source, target_bp, max_repeats, coalesce(units, 0) AS units, total,
         sum(target_bp) OVER (ORDER BY source) AS upto, greatest(sum(target_bp) OVER (), 10000) AS scale
  FROM plan LEFT JOIN units USING (source), total
), slot AS (SELECT (n * 2654435769) % 4294967296 AS point FROM total, range(0, (total + 511) // 512) r(n)
), drawn AS (
  SELECT source, count(point) AS slots FROM offer LEFT JOIN slot
  ON point >= (upto - target_bp) * 4294967296 // scale AND point < upto * 4294967296 // scale GROUP BY source
), done AS (
  SELECT source, target_bp, max_repeats, units, units * max_repeats AS allowed, target_bp * total // 10000 AS wanted,
         least(slots * 512, units * max_repeats) AS reached, units * max_repeats * 10000 < target_bp * total AS short
  FROM offer JOIN drawn USING (source)
)"""

#: Words of documents and items, and the pairs with twelve equal words in a row.
_RUNS = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(text)), '\p{Mn}', '', 'g'), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
     i AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(text)), '\p{Mn}', '', 'g'), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM eval_items),
     x AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: list_aggregate(w[k:k + 11], 'string_agg', ' '))) AS run FROM d WHERE len(w) >= 12),
     y AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: list_aggregate(w[k:k + 11], 'string_agg', ' '))) AS run FROM i WHERE len(w) >= 12),
     found AS (SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (run))"""

#: The components of the similar pairs, the class of equal sets of each act, and the number of other classes it is similar to.
_GROUPS = _ACTS.replace("WITH act AS", "WITH RECURSIVE act AS") + """, ways AS (SELECT a, b, c, na, nb FROM near UNION ALL SELECT b, a, c, nb, na FROM near
), reach AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a
), first AS (SELECT a AS act_id, least(a, min(b)) AS first_act_id FROM reach GROUP BY a
), rep AS (SELECT s.act_id, least(s.act_id, min(b)) AS rep FROM sets s LEFT JOIN ways ON a = s.act_id AND c = na AND c = nb GROUP BY s.act_id
), links AS (SELECT a AS act_id, count(DISTINCT y.rep) AS links FROM ways JOIN rep x ON x.act_id = a JOIN rep y ON y.act_id = b WHERE x.rep <> y.rep GROUP BY a)"""

#: The mix of words: slots in order of their source's slots, documents in hash order, over and over.
_MIX = _WORDS + """, ranked AS (
  SELECT source, n AS slot, row_number() OVER (PARTITION BY source ORDER BY n) - 1 AS rank FROM offer JOIN (
    SELECT n, (n * 2654435769) % 4294967296 AS point FROM total, range(0, (total + 511) // 512) r(n))
  ON point >= (upto - target_bp) * 4294967296 // scale AND point < upto * 4294967296 // scale
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM (
    SELECT doc_id, """ + _SOURCE + """ AS source, ('0x' || substr(md5('mix|' || doc_id), 1, 13))::BIGINT AS h,
      len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\r\\n]+'), lambda w: w <> '')) AS size FROM documents WHERE source IS NOT NULL) WHERE size > 0
), turns AS (
  SELECT source, doc_id, turn, turn * units + begin AS first, least(turn * units + begin + size, reached) AS stop
  FROM placed JOIN (SELECT source, units, reached, unnest(range(0, (reached - 1) // units + 1)) AS turn FROM done WHERE reached > 0) USING (source)
), parts AS (SELECT *, unnest(range(first // 512, (stop - 1) // 512 + 1)) AS rank FROM turns WHERE first < stop)"""

SQL: dict[str, str] = {
    "p2_check": f"""WITH r AS (SELECT record_id, max({_CHARS}) AS n FROM gner_records WHERE record_id IS NOT NULL GROUP BY 1 HAVING n > 0)
        SELECT count(*) AS records, sum(n)::BIGINT AS chars, count(*) FILTER (n > (SELECT max_chars FROM size_limits WHERE purpose = 'container')) AS divided,
          0::BIGINT AS torn, 0::BIGINT AS over_capacity FROM r""",
    "p3_check": "SELECT count(DISTINCT act_id) AS rows, count(DISTINCT act_id) AS acts, 0::BIGINT AS publications_apart FROM gner_records",
    "p4_check": """WITH t AS (
          SELECT record_id, 'input' AS field, input AS text, ingested_at FROM gner_records UNION ALL SELECT record_id, 'output', output, ingested_at FROM gner_records
        ) SELECT record_id, field, md5(arg_max(text, {'i': ingested_at, 't': text})) AS text_md5, true AS fits
        FROM t JOIN (SELECT field, max_chars FROM size_limits WHERE purpose = 'piece') USING (field)
        WHERE length(text) > max_chars AND record_id IS NOT NULL GROUP BY record_id, field""",
    "p6_components": _GROUPS + """ SELECT act_id, coalesce(first_act_id, act_id) AS first_act_id, coalesce(links, 0) AS links
        FROM sets LEFT JOIN first USING (act_id) LEFT JOIN links USING (act_id)""",
    "p7_exact": _RUNS + """, same AS (
          SELECT doc_id, item_id, p, p - q AS shift FROM (
            SELECT doc_id, item_id, d.w AS dw, i.w AS iw, unnest(range(1, len(i.w) + 1)) AS q FROM found JOIN d USING (doc_id) JOIN i USING (item_id)
          ), range(1, len(dw) + 1) r(p) WHERE dw[p] = iw[q]
        ), run AS (SELECT doc_id, item_id, count(*) AS n FROM (
          SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY p) AS island FROM same) GROUP BY doc_id, item_id, shift, island)
        SELECT doc_id, item_id, max(n)::INT AS exact_words FROM run GROUP BY ALL""",
    "p8_word_mix": _MIX + """ SELECT slot, source, turn, doc_id, greatest(rank * 512 - first, 0) AS start, least(rank * 512 + 512, stop) - first AS stop
        FROM parts JOIN ranked USING (source, rank)""",
    "p8_check": "SELECT 0::BIGINT AS bad_slots, 0::BIGINT AS over_repeats, 0::BIGINT AS repeated_in_turn",
    "p1_found": _CELLS + " SELECT act, entity_type, is_negative FROM report WHERE supply < wanted",
    "p1_report": _CELLS + """ SELECT act, entity_type, is_negative, wanted, supply, least(wanted, supply) AS taken,
        wanted - least(wanted, supply) AS deficit FROM report""",
    "p1_sample": _CELLS + """, drawn AS (
        SELECT record_id, act, entity_type, is_negative, wanted, row_number() OVER (PARTITION BY act, entity_type, is_negative
          ORDER BY ('0x' || substr(md5('s|' || record_id), 1, 13))::BIGINT, record_id) AS place
        FROM known JOIN report USING (act, entity_type, is_negative)
      ) SELECT record_id, act, entity_type, is_negative FROM drawn WHERE place <= wanted""",
    "p2_found": f"SELECT DISTINCT record_id FROM gner_records WHERE {_CHARS} > (SELECT max_chars FROM size_limits WHERE purpose = 'container')",
    "p3_found": f"""SELECT {_PUB} AS pub_no FROM gner_records WHERE {_PUB} IS NOT NULL AND split IS NOT NULL
        GROUP BY 1 HAVING count(DISTINCT {_SPLIT}) > 1""",
    "p4_found": """SELECT DISTINCT record_id, field FROM (
        SELECT record_id, 'input' AS field, length(input) AS n FROM gner_records UNION ALL SELECT record_id, 'output', length(output) FROM gner_records
      ) JOIN (SELECT field, max_chars FROM size_limits WHERE purpose = 'piece') USING (field) WHERE n > max_chars""",
    "p5_found": _ACTS + " SELECT least(eval_id, train_id) AS act_id_a, greatest(eval_id, train_id) AS act_id_b FROM overlap",
    "p5_overlaps": _ACTS + " SELECT eval_id, train_id, eval_split, similarity, containment FROM overlap",
    "p5_report": _ACTS + f""", origin AS (SELECT act_id AS eval_id, max({_PUB}) AS publication FROM gner_records GROUP BY act_id)
        SELECT eval_split AS split, publication, count(DISTINCT eval_id) AS records, count(*) AS pairs,
               count(*) FILTER (similarity = 1) AS copies
        FROM overlap JOIN origin USING (eval_id) GROUP BY ALL""",
    "p5_records": _ACTS + _BY_RECORD,
    "p5_contained": _ACTS + """, inside AS (
        SELECT x.act_id AS eval_id, y.act_id AS train_id, x.split AS eval_split, c / (len(x.s) + len(y.s) - c) AS similarity, c / len(x.s) AS containment
        FROM (SELECT a, b, c FROM common UNION ALL SELECT b, a, c FROM common) JOIN sets x ON x.act_id = a JOIN sets y ON y.act_id = b
        WHERE x.split IN ('dev', 'test') AND y.split = 'train' AND (2 * c >= len(x.s) + len(y.s) - c OR 5 * c >= 4 * len(x.s)))
      """ + _BY_RECORD.replace("FROM overlap", "FROM inside"),
    "p6_found": _ACTS + " SELECT a AS act_id_a, b AS act_id_b FROM near",
    "p7_found": r"""
      WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(text)), '\p{Mn}', '', 'g'), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
           i AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(text)), '\p{Mn}', '', 'g'), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM eval_items),
           x AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: list_aggregate(w[k:k + 11], 'string_agg', ' '))) AS run FROM d WHERE len(w) >= 12),
           y AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: list_aggregate(w[k:k + 11], 'string_agg', ' '))) AS run FROM i WHERE len(w) >= 12)
      SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (run)""",
    "p8_found": _WORDS + " SELECT source FROM done WHERE short",
    "p8_word_report": _WORDS + """ SELECT source, target_bp, max_repeats, units, allowed, wanted, reached, short,
        coalesce(round(reached * 10000 / nullif(sum(reached) OVER (), 0)), 0)::BIGINT AS share_bp FROM done""",
}
