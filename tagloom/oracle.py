"""SQL with the results of the named queries, written for DuckDB: windows over single tags instead of array functions."""

from __future__ import annotations

from tagloom.functions import prompts

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_ACT = "regexp_replace(strip_accents(lower(" + _TRIM.format("act") + ")), '^ato_', '')"
_TYPE = "lower(" + _TRIM.format("entity_type") + ")"
_PUB = "try_cast(regexp_replace(publication, '[^0-9]', '', 'g') AS BIGINT)"
_SPLIT = "lower(" + _TRIM.format("split") + ")"
_SPLIT = f"CASE WHEN {_SPLIT} IN ('valid', 'validation') THEN 'dev' ELSE {_SPLIT} END"


def _h(*parts: str) -> str:
    """52 bits of the MD5 of the parts joined by bars."""
    return "('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 13))::BIGINT"


PRED = f"""pred AS (
  SELECT idx, max({_PUB}) AS publication, max({_ACT}) AS act, max({_TYPE}) AS entity_type, max(is_negative) AS is_negative,
         min(gold) AS gold, min(pred) AS pred, max(gen) AS gen
  FROM predictions WHERE idx IS NOT NULL GROUP BY idx
)"""
DOC = f"""doc AS (
  SELECT act_id, act, publication, m.tokens AS tokens, m.tags AS tags FROM (
    SELECT act_id, max({_ACT}) AS act, max({_PUB}) AS publication, min({{'tokens': tokens, 'tags': tags}}) AS m
    FROM act_documents WHERE act_id IS NOT NULL GROUP BY act_id)
)"""
REC = f"""rec AS (
  SELECT record_id, max(act_id) AS act_id, max({_ACT}) AS act, max({_TYPE}) AS entity_type, max({_PUB}) AS publication,
         max(is_negative) AS is_negative, max({_SPLIT}) AS split, max(instruction) AS instruction, max(instruction_fmt) AS instruction_fmt,
         max(input) AS input, max(output) AS output
  FROM gner_records WHERE record_id IS NOT NULL GROUP BY record_id
)"""
#: The second model: the tags of the last document with the record's publication and act, sliced to its type.
SECOND = f"""{PRED}, {DOC}, last AS (
  SELECT publication, act, arg_max(tags, act_id) AS labels FROM doc WHERE publication IS NOT NULL AND act IS NOT NULL GROUP BY ALL
), second AS (
  SELECT p.idx, p.publication, p.act, p.entity_type, p.is_negative, p.gold, labels IS NOT NULL AS matched,
         list_transform(range(1, len(gold) + 1), lambda i: CASE WHEN labels[i] IN ('B-' || coalesce(p.entity_type, ''), 'I-' || coalesce(p.entity_type, '')) THEN labels[i] ELSE 'O' END) AS pred
  FROM pred p LEFT JOIN last USING (publication, act)
)"""


def _spans(source: str, key: str, sides: tuple[str, ...], name: str = "") -> str:
    """CTEs run{name}, span{name} and strict{name}: every run of tags of one type, with the first tag's prefix."""
    tags = " UNION ALL ".join(f"SELECT {key}, '{s}' AS side, unnest({s}) AS tag, generate_subscripts({s}, 1) - 1 AS pos FROM {source}" for s in sides)
    return f"""tag{name} AS ({tags}), brk{name} AS (
  SELECT *, CASE WHEN tag LIKE 'I-%' AND (lag(tag) OVER w LIKE 'B-%' OR lag(tag) OVER w LIKE 'I-%') AND substr(tag, 3) = substr(lag(tag) OVER w, 3)
            THEN 0 ELSE 1 END AS b FROM tag{name} WINDOW w AS (PARTITION BY {key}, side ORDER BY pos)
), run{name} AS (SELECT *, sum(b) OVER (PARTITION BY {key}, side ORDER BY pos) AS r FROM brk{name}
), span{name} AS (
  SELECT {key}, side, substr(arg_min(tag, pos), 3) AS etype, min(pos)::INT AS s, (max(pos) + 1)::INT AS e, arg_min(tag, pos)[1] AS opened
  FROM run{name} WHERE tag LIKE 'B-%' OR tag LIKE 'I-%' GROUP BY {key}, side, r
), strict{name} AS (SELECT * FROM span{name} WHERE opened = 'B')"""


def _counts(source: str, spans: str, out: str) -> str:
    """CTE out: idx, tp, n_pred, n_gold of every record of source."""
    return f"""{out} AS (
  SELECT p.idx, p.publication, p.act, p.entity_type, coalesce(tp, 0)::BIGINT AS tp, coalesce(np, 0)::BIGINT AS n_pred, coalesce(ng, 0)::BIGINT AS n_gold
  FROM {source} p
  LEFT JOIN (SELECT idx, count(*) FILTER (side = 'pred') AS np, count(*) FILTER (side = 'gold') AS ng FROM {spans} GROUP BY idx) USING (idx)
  LEFT JOIN (SELECT idx, count(*) AS tp FROM (SELECT idx, etype, s, e FROM {spans} GROUP BY ALL HAVING count(DISTINCT side) = 2) GROUP BY idx) USING (idx)
)"""


GP = ("gold", "pred")
BASE = f"WITH {PRED}, {_spans('pred', 'idx', GP)}"
STRICT = f"{BASE}, {_counts('pred', 'strict', 'cnt')}"
MODES = f"{BASE}, {_counts('pred', 'strict', 'st')}, {_counts('pred', 'span', 'le')}"
PAIR = f"WITH {SECOND}, {_spans('pred', 'idx', GP)}, {_spans('second', 'idx', GP, '2')}, {_counts('pred', 'strict', 'ca')}, {_counts('second', 'strict2', 'cb')}"


def _ratio(a: str, b: str) -> str:
    return f"coalesce({a} / nullif({b}, 0)::DOUBLE, 0)"


def _modes(keys: str) -> str:
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""{MODES}, j AS (
      SELECT le.act, le.entity_type, le.tp, le.n_pred, le.n_gold, st.tp AS stp, st.n_pred AS snp, st.n_gold AS sng FROM le JOIN st USING (idx))
    SELECT {lead}{_ratio('2 * sum(tp)', 'sum(n_pred) + sum(n_gold)')} AS f1, {_ratio('sum(tp)', 'sum(n_pred)')} AS precision,
      {_ratio('sum(tp)', 'sum(n_gold)')} AS recall, {_ratio('2 * sum(stp)', 'sum(snp) + sum(sng)')} AS f1_strict,
      {_ratio('sum(stp)', 'sum(snp)')} AS precision_strict, {_ratio('sum(stp)', 'sum(sng)')} AS recall_strict, count(*) AS n_records FROM j {group}"""


def _support(key: str) -> str:
    return f"""{STRICT} SELECT {key}, sum(tp)::BIGINT AS tp, sum(n_pred - tp)::BIGINT AS fp, sum(n_gold - tp)::BIGINT AS fn, sum(n_gold)::BIGINT AS support,
      {_ratio('sum(tp)', 'sum(n_pred)')} AS precision, {_ratio('sum(tp)', 'sum(n_gold)')} AS recall,
      {_ratio('2 * sum(tp)', 'sum(n_pred) + sum(n_gold)')} AS f1, count(*) AS n_records FROM cnt GROUP BY {key}"""


def _template() -> str:
    return f"tmpl AS (SELECT entity_type, {_ratio('2 * sum(tp)', 'sum(n_pred) + sum(n_gold)')} AS f1, sum(n_gold)::BIGINT AS support FROM cnt GROUP BY 1 HAVING f1 > 0.9e0 AND support > 0)"


def _errors(key: str, where: str) -> str:
    shares = ", ".join(f"{_ratio(c, 'exact + boundary + omission')} AS {c}_share" for c in ("exact", "boundary", "omission"))
    return f""", outcome AS (
      SELECT g.idx, CASE WHEN EXISTS (FROM strict p WHERE p.side = 'pred' AND p.idx = g.idx AND p.etype = g.etype AND p.s = g.s AND p.e = g.e) THEN 'exact'
        WHEN EXISTS (FROM strict p WHERE p.side = 'pred' AND p.idx = g.idx AND p.etype = g.etype AND p.s < g.e AND p.e > g.s) THEN 'boundary' ELSE 'omission' END AS kind
      FROM strict g WHERE g.side = 'gold'
    ), total AS (
      SELECT {key}, count(*) FILTER (kind = 'exact') AS exact, count(*) FILTER (kind = 'boundary') AS boundary, count(*) FILTER (kind = 'omission') AS omission
      FROM pred LEFT JOIN outcome USING (idx) WHERE {where} GROUP BY ROLLUP ({key})
    ) SELECT {key}, exact, boundary, omission, exact + boundary + omission AS spans, {shares} FROM total"""


def _compare(key: str) -> str:
    f = _ratio("2 * sum(tp)", "sum(n_pred) + sum(n_gold)")
    return f""", x AS (SELECT {key}, {f} AS f1_a, sum(n_gold)::BIGINT AS support FROM ca GROUP BY 1), y AS (SELECT {key}, {f} AS f1_b FROM cb GROUP BY 1),
      cmp AS (SELECT x.{key}, support, f1_a, f1_b, f1_a - f1_b AS delta FROM x JOIN y ON x.{key} IS NOT DISTINCT FROM y.{key})"""


def _draws(units: str, seed: str) -> str:
    """CTE drawn: it and the summed counts of 200 draws from numbered units."""
    return f""", n AS (SELECT count(*) AS n FROM {units}), turns AS (
      SELECT it, ({_h(f"'{seed}'", 'it', 'turn')} % n) AS k FROM n, range(200) a(it), range(n) b(turn))"""


_UNITS = """, ua AS (SELECT {0}, sum(tp) AS tp_a, sum(n_pred) AS np_a, sum(n_gold) AS ng_a FROM ca WHERE {0} IS NOT NULL GROUP BY 1),
  ub AS (SELECT {0}, sum(tp) AS tp_b, sum(n_pred) AS np_b, sum(n_gold) AS ng_b FROM cb WHERE {0} IS NOT NULL GROUP BY 1),
  units AS (SELECT *, row_number() OVER (ORDER BY {1}, {0}) - 1 AS k FROM ua JOIN ub USING ({0}))"""
_REPS = f"""{PAIR}{_UNITS.format('publication', _h("'unit'", 'publication'))}{_draws('units', 'boot')}, rep AS (
  SELECT it, {_ratio('2 * sum(tp_a)', 'sum(np_a) + sum(ng_a)')} AS f1_a, {_ratio('2 * sum(tp_b)', 'sum(np_b) + sum(ng_b)')} AS f1_b
  FROM turns JOIN units USING (k) GROUP BY it)"""


def _poisson() -> str:
    from tagloom.operators.resample import EDGES

    h = _h("'poisson'", "it", "idx")
    weight = " + ".join(f"(h >= {e})::INT" for e in EDGES)
    return f"""{PAIR}{_UNITS.format('idx', _h("'unit'", 'idx'))}, w AS (
      SELECT it, u.*, {weight} AS w FROM (SELECT it, units.*, {h} AS h FROM units, range(200) a(it)) u
    ), rep AS (SELECT it, {_ratio('2 * sum(tp_a * w)', 'sum(np_a * w) + sum(ng_a * w)')} - {_ratio('2 * sum(tp_b * w)', 'sum(np_b * w) + sum(ng_b * w)')} AS d
      FROM w WHERE w > 0 GROUP BY it)
    SELECT avg(d) AS mean, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM rep"""


_SPLITTED = f"""WITH {DOC}, body AS (SELECT act_id, act, md5(array_to_string(tokens, ' ')) AS h FROM doc WHERE act IS NOT NULL
), grp AS (SELECT act, h, count(*) AS size, {_h("'42'", 'h')} AS o FROM body GROUP BY act, h
), run AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY act ORDER BY o, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(size) OVER (PARTITION BY act) AS n FROM grp
), aim AS (SELECT *, round_even(n * 0.15e0, 0) AS n_dev, n - 2 * round_even(n * 0.15e0, 0) AS n_train FROM run
), filled AS (SELECT *, sum(CASE WHEN before < n_train THEN size ELSE 0 END) OVER (PARTITION BY act) AS train FROM aim
), placed AS (SELECT act, h, CASE WHEN before < n_train THEN 'train' WHEN before - train < n_dev THEN 'dev' ELSE 'test' END AS split FROM filled
), splitted AS (SELECT act_id, act, split FROM body JOIN placed USING (act, h))"""

_q = lambda s: "'" + s.replace("'", "''") + "'"


def _fill(template: str, **values: str) -> str:
    """A template as an SQL concatenation."""
    return " || ".join(x for text, name in prompts.pieces(template) for x in ([_q(text)] if text else []) + ([values[name]] if name else []))


def _inst(t: str) -> str:
    return _fill(prompts.INSTRUCTION, etype=t)


def _format(t: str) -> str:
    return _fill(prompts.FORMAT, etype=t)


_GNER = f"""WITH {DOC}, typ AS (SELECT regexp_replace(strip_accents(lower(act)), '^ato_', '') AS act, unnest(etypes) AS entity_type FROM entity_schema
), wide AS (SELECT act_id, act, publication, entity_type, tokens, list_transform(tags, lambda t: CASE WHEN t IN ('B-' || entity_type, 'I-' || entity_type) THEN t ELSE 'O' END) AS lab
  FROM doc JOIN typ USING (act))
SELECT act_id, act, publication, entity_type, {_inst('entity_type')} AS instruction, {_inst('entity_type')} || chr(10) || chr(10) || {_format('entity_type')} AS instruction_fmt,
  array_to_string(tokens, ' ') AS input, array_to_string(list_transform(range(1, least(len(tokens), len(lab)) + 1), lambda i: tokens[i] || '(' || lab[i] || ')'), ' ') AS output,
  len(list_filter(lab, lambda x: x <> 'O')) = 0 AS is_negative FROM wide"""

_UNIT = r"'^(.+)\(([BI]-[\p{L}\p{N}_]+|O)\)$'"
_SPACES = r"'[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"


def _units(text: str) -> str:
    return f"regexp_split_to_array(coalesce({text}, ''), {_SPACES})"


def _labels(text: str) -> str:
    return f"list_filter(list_transform({_units(text)}, lambda u: regexp_extract(u, {_UNIT}, 2)), lambda x: x <> '')"


_SCORES = """WITH long AS (
  SELECT model, tag, task_set, unnest(map_keys(scores)) AS bench, unnest(map_values(scores)) AS score FROM (SELECT DISTINCT * FROM benchmark_results)
), s AS (
  SELECT model, tag, bench, arg_max(coalesce(score, 'NaN'::DOUBLE), {'f': task_set, 's': coalesce(score, -1)}) AS v, try_cast(regexp_extract(tag, '_s([0-9]+)$', 1) AS INT) AS seed
  FROM long GROUP BY model, tag, bench
), sc AS (SELECT model, tag, seed, bench, CASE WHEN isnan(v) THEN NULL ELSE v END AS score FROM s)"""
_DELTAS = _SCORES + """, delta AS (
  SELECT m.model AS method, m.seed, m.bench, m.score, b.score AS base_score, (m.score - b.score) * 100 AS delta_pp
  FROM sc m LEFT JOIN (SELECT * FROM sc WHERE model = 'base') b USING (seed, bench) WHERE m.model <> 'base')"""

_CAND = """last AS (SELECT run, max(step) AS last FROM checkpoints GROUP BY run
), aim AS (SELECT DISTINCT run, t FROM (SELECT run, unnest([round_even(last / 3, 0)::BIGINT, round_even(last * 2 / 3, 0)::BIGINT, last]) AS t FROM last)
), cand AS (SELECT DISTINCT run, step FROM (SELECT run, t, step, row_number() OVER (PARTITION BY run, t ORDER BY abs(step - t), step) AS r FROM checkpoints JOIN aim USING (run)) WHERE r = 1)"""

_QUERY = "coalesce(instruction_fmt, instruction, '') || chr(10) || chr(10) || coalesce(input, '')"


def _turn(role: str, text: str) -> str:
    return _fill(prompts.TURN, role=_q(role), content=text)


_OPEN = "chr(10) || " + _q(prompts.OPEN_TURN)
_DIGIT = r"0-9\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"


def _shape(w: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({w}, '[A-ZÀ-Ý]', 'X', 'g'), '[a-zà-ÿ]', 'x', 'g'), '[0-9]', 'd', 'g')"


def _upper(w: str) -> str:
    return rf"(regexp_matches({w}, '\p{{Lu}}') AND NOT regexp_matches({w}, '[\p{{Ll}}\p{{Lt}}ºª]'))"


def _title(w: str) -> str:
    """Without look-behind: no small letter first in a run of cased ones, no capital after a cased one."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}ºª"
    return (rf"(regexp_matches({w}, '[\p{{Lu}}\p{{Lt}}]') AND NOT regexp_matches({w}, '[{cased}][\p{{Lu}}\p{{Lt}}]') "
            rf"AND NOT regexp_matches({w}, '(^|[^{cased}])[\p{{Ll}}ºª]'))")


def _digit(w: str) -> str:
    return f"regexp_matches({w}, '^[{_DIGIT}]+$')"


def _near(p: str, c: str) -> str:
    return f"lower({c}) AS {p}_lower, {_title(c)} AS {p}_istitle, {_upper(c)} AS {p}_isupper, {_digit(c)} AS {p}_isdigit, {_shape(c)} AS {p}_shape"


_TOKENS = f"tok AS (SELECT act_id, unnest(tokens) AS token, (generate_subscripts(tokens, 1) - 1)::INT AS pos FROM {{0}})"
_DEMO = f"row_number() OVER (PARTITION BY act, entity_type ORDER BY {_h(chr(39) + 'demo' + chr(39), 'record_id')}, record_id)"
_DONE = f"done AS (SELECT idx FROM pred WHERE {_h(chr(39) + 'done' + chr(39), 'idx')} % 4 > 0), asked AS (SELECT record_id AS idx, split FROM rec WHERE split IN ('dev', 'test'))"

SQL: dict[str, str] = {
    "span_decode_strict": f"{BASE} SELECT idx, side, etype, s, e FROM strict",
    "span_decode_lenient": f"{BASE} SELECT idx, side, etype, s, e FROM span",
    "span_decode_window": f"WITH {DOC}, {_spans('doc', 'act_id', ('tags',))} SELECT act_id, etype, s, e FROM strict",
    "ner_f1_overall": _modes(""),
    "ner_f1_by_act": _modes("act"),
    "ner_f1_by_entity": _modes("act, entity_type"),
    "ner_class_report": f"""{BASE}, hit AS (SELECT etype, count(*) AS tp FROM (SELECT idx, etype, s, e FROM span GROUP BY ALL HAVING count(DISTINCT side) = 2) GROUP BY 1),
      per AS (SELECT etype AS label, coalesce(any_value(tp), 0) AS tp, count(*) FILTER (side = 'pred') AS np, count(*) FILTER (side = 'gold') AS ng FROM span LEFT JOIN hit USING (etype) GROUP BY 1),
      rows AS (SELECT label, {_ratio('tp', 'np')} AS precision, {_ratio('tp', 'ng')} AS recall, {_ratio('2 * tp', 'np + ng')} AS f1, ng AS support FROM per)
      SELECT * FROM rows UNION ALL
      SELECT 'micro avg', {_ratio('sum(tp)', 'sum(np)')}, {_ratio('sum(tp)', 'sum(ng)')}, {_ratio('2 * sum(tp)', 'sum(np) + sum(ng)')}, sum(ng)::BIGINT FROM per UNION ALL
      SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM rows UNION ALL
      SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM rows""",
    "ner_counts_by_act_support": _support("act"),
    "ner_counts_by_type_support": _support("entity_type"),
    "ner_error_decomposition": BASE + _errors("act", "act IS NOT NULL"),
    "ner_template_types": f"{STRICT}, {_template()} SELECT entity_type, f1, support FROM tmpl",
    "ner_error_decomposition_subset": f"{STRICT}, {_template()}" + _errors("entity_type", "entity_type IN (SELECT entity_type FROM tmpl)"),
    "ner_compare_delta": PAIR + _compare("act") + " SELECT act, support, f1_a, f1_b, delta FROM cmp",
    "ner_weighted_gap": PAIR + _compare("entity_type") + f""" SELECT CASE WHEN f1_a > 0.9e0 THEN 'template' ELSE 'free-form' END AS type_group, count(*) AS types,
      sum(support)::BIGINT AS support, {_ratio('sum(delta * support)', 'sum(support)')} AS gap FROM cmp GROUP BY 1""",
    "doc_counts": f"""{STRICT} SELECT publication, sum(tp)::BIGINT AS tp, sum(n_pred)::BIGINT AS n_pred, sum(n_gold)::BIGINT AS n_gold, min(idx) AS first_idx
      FROM cnt WHERE publication IS NOT NULL GROUP BY 1""",
    "doc_order": f"WITH {PRED}, f AS (SELECT publication, min(idx) AS first_idx FROM pred WHERE publication IS NOT NULL GROUP BY 1) SELECT *, row_number() OVER (ORDER BY first_idx, publication) - 1 AS place FROM f",
    "bootstrap_cluster_ci": f"{_REPS} SELECT avg(f1_a) AS mean, quantile_cont(f1_a, 0.025) AS lo, quantile_cont(f1_a, 0.975) AS hi FROM rep",
    "bootstrap_paired_delta": f"{_REPS} SELECT avg(f1_a - f1_b) AS mean, quantile_cont(f1_a - f1_b, 0.025) AS lo, quantile_cont(f1_a - f1_b, 0.975) AS hi, lo > 0 AS supported FROM rep",
    "bootstrap_record_ci": f"""{STRICT}, units AS (SELECT *, row_number() OVER (ORDER BY {_h(chr(39) + 'unit' + chr(39), 'idx')}, idx) - 1 AS k FROM cnt){_draws('units', 'record')}, rep AS (
      SELECT it, {_ratio('2 * sum(tp)', 'sum(n_pred) + sum(n_gold)')} AS f FROM turns JOIN units USING (k) GROUP BY it)
      SELECT avg(f) AS mean, list_sort(list(f))[6] AS ci_lower, list_sort(list(f))[196] AS ci_upper FROM rep""",
    "bootstrap_record_delta": f"""{PAIR}{_UNITS.format('idx', _h("'unit'", 'idx'))}{_draws('units', 'record')}, rep AS (
      SELECT it, {_ratio('2 * sum(tp_a)', 'sum(np_a) + sum(ng_a)')} - {_ratio('2 * sum(tp_b)', 'sum(np_b) + sum(ng_b)')} AS f FROM turns JOIN units USING (k) GROUP BY it)
      SELECT avg(f) AS mean, list_sort(list(f))[6] AS ci_lower, list_sort(list(f))[196] AS ci_upper, list_sort(list(f))[6] > 0 AS supported FROM rep""",
    "bootstrap_poisson_ci": _poisson(),
    "split_stratified": _SPLITTED + " SELECT act_id, act, split FROM splitted",
    "split_stats": _SPLITTED + """ SELECT act, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'dev') AS dev,
      count(*) FILTER (split = 'test') AS test, count(*) AS total FROM splitted GROUP BY ROLLUP (act)""",
    "record_counts": f"WITH {REC} SELECT split, count(*) AS records, count(*) FILTER (is_negative) AS negatives, count(*) FILTER (is_negative) / count(*) AS negative_share FROM rec GROUP BY split",
    "duplicate_bodies": f"WITH {DOC} SELECT act, md5(array_to_string(tokens, ' ')) AS body, count(*) AS docs, min(act_id) AS first_act_id FROM doc WHERE act IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "entity_schema_by_act": f"""WITH {DOC}, t AS (SELECT DISTINCT act, regexp_extract(tag, '-(.*)$', 1) AS t FROM (SELECT act, unnest(tags) AS tag FROM doc WHERE act IS NOT NULL)
      WHERE tag <> 'O' AND contains(tag, '-')) SELECT act, list(t ORDER BY t) AS etypes FROM t GROUP BY act""",
    "gner_records": _GNER,
    "conll_render": f"""WITH {DOC} SELECT act_id, 'Publication: ' || coalesce(publication::VARCHAR, 'None') || chr(10) || 'Act: ' || coalesce(act, 'None') || chr(10) ||
      array_to_string(list_transform(range(1, len(tokens) + 1), lambda i: tokens[i] || ' ' || tags[i]), chr(10)) || chr(10) AS text FROM doc""",
    "parse_inline_bio": f"""WITH {REC}, u AS (SELECT record_id, list_filter({_units('output')}, lambda u: regexp_extract(u, {_UNIT}, 2) <> '') AS u FROM rec)
      SELECT record_id, list_transform(u, lambda x: regexp_extract(x, {_UNIT}, 1)) AS tokens, list_transform(u, lambda x: regexp_extract(x, {_UNIT}, 2)) AS labels FROM u""",
    "parse_inline_bio_align": f"""WITH {PRED}, a AS (SELECT idx, pred, len(gold)::INT AS n, {_labels('gen')} AS l FROM pred WHERE gen IS NOT NULL),
      b AS (SELECT idx, n, pred, list_transform(range(1, n + 1), lambda i: coalesce(l[i], 'O')) AS parsed FROM a)
      SELECT idx, n, parsed, n - len(list_filter(range(1, n + 1), lambda i: parsed[i] = pred[i])) AS differing FROM b""",
    "slice_to_entity_join": f"WITH {SECOND} SELECT idx, pred, matched FROM second",
    "slice_unmatched": f"WITH {SECOND} SELECT count(*) AS records, count(*) FILTER (NOT matched) AS missing FROM second",
    "few_shot_demos": f"""WITH {REC}, r AS (SELECT act, entity_type, record_id, {_DEMO} AS place FROM rec
      WHERE split = 'train' AND NOT is_negative AND act IS NOT NULL AND entity_type IS NOT NULL) SELECT * FROM r WHERE place <= 3""",
    "sample_fixed_n": f"WITH {PRED} SELECT idx, act, entity_type FROM pred ORDER BY {_h(chr(39) + 'sample' + chr(39), 'idx')}, idx LIMIT 200",
    "train_fraction": f"""WITH {REC}, r AS (SELECT record_id, row_number() OVER (ORDER BY {_h(chr(39) + 'fraction' + chr(39), 'record_id')}, record_id) - 1 AS rank, count(*) OVER () AS n
      FROM rec WHERE split = 'train') SELECT record_id, rank FROM r WHERE rank < greatest(1, round_even(n * 0.25e0, 0))""",
    "limit_prefix": f"WITH {PRED} SELECT idx, entity_type FROM pred WHERE idx < 1000",
    "benchmark_scores": _SCORES + " SELECT model, tag, seed, bench, score FROM sc",
    "benchmark_first_metric": "SELECT DISTINCT tag, task_set, coalesce(scores['logica_b'], scores['historia']) AS score FROM benchmark_results",
    "forgetting_delta": _DELTAS + """ SELECT *, CASE WHEN delta_pp IS NULL THEN 'N/A' WHEN abs(delta_pp) < 1 THEN 'negligible' WHEN abs(delta_pp) < 3 THEN 'moderate'
      ELSE 'SIGNIFICANT' END AS reading FROM delta""",
    "forgetting_bench_summary": _DELTAS + " SELECT method, bench, avg(delta_pp) AS mean_delta, count(delta_pp) AS seeds FROM delta GROUP BY ALL",
    "forgetting_seed_summary": _DELTAS + """, m AS (SELECT method, seed, avg(delta_pp) AS m FROM delta WHERE bench <> 'probe_vies' GROUP BY ALL)
      SELECT method, avg(m) AS mean_delta, stddev_samp(m) AS std_delta, count(m) AS seeds FROM m GROUP BY method""",
    "run_registry_files": """SELECT method, seed, family, path, EXISTS (FROM benchmark_results b WHERE b.tag = method || '_s' || seed AND b.task_set = family) AS found FROM run_registry""",
    "checkpoint_candidates": f"WITH {_CAND} SELECT run, step FROM cand",
    "checkpoint_argmax": f"""WITH {_CAND}, r AS (SELECT run, step, dev_f1, row_number() OVER (PARTITION BY run ORDER BY dev_f1 DESC, step) AS r
      FROM checkpoints JOIN cand USING (run, step) WHERE dev_f1 IS NOT NULL AND NOT isnan(dev_f1)) SELECT run, step, dev_f1 FROM r WHERE r = 1""",
    "chat_render": f"""WITH {REC} SELECT record_id, {_turn('user', _QUERY)} || {_OPEN} AS prompt,
      {_turn('user', _QUERY)} || chr(10) || {_turn('assistant', "coalesce(output, '')")} AS training_text FROM rec""",
    "teacher_prompt": f"WITH {REC} SELECT record_id, {_fill(prompts.TEACHER, query=_QUERY, output="coalesce(output, '')")} AS teacher_prompt FROM rec",
    "few_shot_prompt": f"""WITH {REC}, demo AS (SELECT act, entity_type, {_DEMO} AS place,
        {_turn('user', "instruction || chr(10) || chr(10) || input")} || chr(10) || {_turn('assistant', 'output')} || chr(10) AS t FROM rec
        WHERE split = 'train' AND NOT is_negative AND act IS NOT NULL AND entity_type IS NOT NULL AND instruction IS NOT NULL AND input IS NOT NULL AND output IS NOT NULL),
      pool AS (SELECT act, entity_type, string_agg(t, '' ORDER BY place) AS t, count(*) AS n FROM demo WHERE place <= 2 GROUP BY ALL),
      p AS (SELECT record_id, (coalesce(n, 0) * 2 + 1)::INT AS messages, coalesce(t, '') || {_turn('user', _QUERY)} || {_OPEN} AS p FROM rec LEFT JOIN pool USING (act, entity_type) WHERE split IN ('dev', 'test')),
      w AS (SELECT *, list_filter({_units('p')}, lambda x: x <> '') AS w FROM p)
      SELECT record_id, messages, md5(CASE WHEN len(w) > {prompts.budget(2)} THEN array_to_string(w[len(w) - {prompts.budget(2) - 1}:], ' ') ELSE p END) AS prompt_md5 FROM w""",
    "token_features": f"""WITH {DOC}, {_TOKENS.format('doc')}, n AS (SELECT *, lag(token) OVER w AS p, lead(token) OVER w AS n, lag(token, 2) OVER w AS pp, lead(token, 2) OVER w AS nn
        FROM tok WINDOW w AS (PARTITION BY act_id ORDER BY pos))
      SELECT act_id, pos, token, lower(token) AS lower, right(token, 3) AS suffix3, right(token, 2) AS suffix2, left(token, 2) AS prefix2, left(token, 3) AS prefix3,
        {_upper('token')} AS isupper, {_title('token')} AS istitle, {_digit('token')} AS isdigit, regexp_matches(token, '[{_DIGIT}]') AS hasdigit,
        regexp_matches(token, '[^\\p{{L}}\\p{{N}}]') AS haspunct, length(token)::INT AS len, {_shape('token')} AS shape, {_near('prev', 'p')}, {_near('next', 'n')},
        lower(pp) AS prev2_lower, lower(nn) AS next2_lower, p IS NULL AS bos, n IS NULL AS eos FROM n""",
    "word_shape": f"""WITH {DOC}, {_TOKENS.format('doc')} SELECT token, count(*) AS n, {_shape('token')} AS shape, {_upper('token')} AS isupper,
      regexp_matches(token, '[{_DIGIT}]') AS hasdigit FROM tok GROUP BY token""",
    "label_vocab": f"""WITH {DOC}, l AS (SELECT DISTINCT unnest(tags) AS label FROM doc) SELECT 'O' AS label, 0::BIGINT AS id UNION ALL
      SELECT label, row_number() OVER (ORDER BY label) FROM l WHERE label <> 'O'""",
    "label_encode": f"""WITH {DOC}, l AS (SELECT DISTINCT unnest(tags) AS label FROM doc), v AS (SELECT ['O'] || list(label ORDER BY label) FILTER (label <> 'O') AS v FROM l)
      SELECT act_id, list_transform(tags, lambda t: list_position(v, t) - 1) AS ids FROM doc, v""",
    "resume_todo": f"WITH {PRED}, {REC}, {_DONE} SELECT idx, split FROM asked ANTI JOIN done USING (idx)",
    "completeness_gate": f"""WITH {PRED}, {REC}, {_DONE} SELECT split, count(*) AS asked, count(*) FILTER (done.idx IS NULL) AS missing,
      count(*) FILTER (done.idx IS NULL) = 0 AS complete FROM asked LEFT JOIN done USING (idx) GROUP BY split""",
}

#: Columns whose last digits depend on the order of summation.
_ROUNDED = {
    "ner_class_report": "precision recall f1", "ner_weighted_gap": "gap", "bootstrap_cluster_ci": "mean lo hi", "bootstrap_paired_delta": "mean lo hi",
    "bootstrap_record_ci": "mean ci_lower ci_upper",
    "bootstrap_record_delta": "mean ci_lower ci_upper", "bootstrap_poisson_ci": "mean lo hi", "forgetting_delta": "delta_pp",
    "forgetting_bench_summary": "mean_delta", "forgetting_seed_summary": "mean_delta std_delta", "record_counts": "negative_share",
}
for _name, _columns in _ROUNDED.items():
    SQL[_name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _columns.split())}) FROM ({SQL[_name]})"

# the bootstraps with 1,000 replicates: the same SQL, its order statistics at the places of 1,000
for _name in ("cluster_ci", "paired_delta", "record_ci", "record_delta", "poisson_ci"):
    SQL[f"bootstrap_{_name}_1000"] = SQL[f"bootstrap_{_name}"].replace("range(200)", "range(1000)").replace("[6]", "[26]").replace("[196]", "[976]")
