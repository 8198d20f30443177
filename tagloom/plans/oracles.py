"""The same results as the registered queries, in plain SQL over the same tables."""

from __future__ import annotations

from tagloom.functions.stopwords import ENGLISH
from tagloom.functions.text import CONTRACTIONS, SPACE, WORD

ORACLES: dict[str, str] = {}

DOCS = """docs AS (
  SELECT doc_id AS row_id, CAST(replace(source, 'src', '') AS INTEGER) + 1 AS sdg,
         'SDG' || (CAST(replace(source, 'src', '') AS INTEGER) + 1) || '.00' AS raw_label,
         lang AS faculty, CAST(2010 + doc_id % 10 AS VARCHAR) AS year,
         split_part(text, chr(10), 1) AS title, text AS abstract
  FROM documents)"""

SKEWED = DOCS + """, docs_skewed AS (
  SELECT * REPLACE (CAST(least(17, length(bin(row_id + 1))) AS INTEGER) AS sdg) FROM docs)"""

VOTES = """votes AS (
  SELECT user_id, CAST(pos AS INTEGER) AS labels_positive, CAST(neg AS INTEGER) AS labels_negative,
         CAST(abs(pos - neg) AS DOUBLE) / nullif(pos + neg, 0) AS agreement
  FROM (SELECT event_id // 10 AS user_id, count(*) FILTER (event_type = 'purchase') AS pos,
               count(*) FILTER (event_type = 'error') AS neg FROM events GROUP BY event_id // 10))"""


def _preds(seeds: str = "(0)") -> str:
    return f"""preds AS (
  SELECT vec_id, CAST(vec_id % 3 AS INTEGER) AS condition, CAST(vec_id % 2 AS INTEGER) AS model, seed,
         label + 1 AS label,
         CASE WHEN (vec_id + seed) % 7 = 0 THEN (label + 1) % 10 + 1 ELSE label + 1 END AS prediction
  FROM embeddings, (VALUES {seeds}) AS s(seed))"""


PREDS = _preds()
GRID_PREDS = _preds("(0), (13), (27), (30), (77)")

_SUMS = ", ".join(" + ".join(f"embedding[{i + 1}]::DOUBLE" for i in range(start, 64, 10)) for start in range(10))
PROBS = f"""tenths AS (SELECT vec_id, label, [{_SUMS}] AS s FROM embeddings), lifted AS (
  SELECT vec_id, label + 1 AS label, list_transform(s, lambda v: v - list_min(s) + 0.1::DOUBLE) AS v
  FROM tenths), probs AS (
  SELECT vec_id, label, list_transform(v, lambda x: round(x / list_sum(v), 6)) AS probs FROM lifted)"""


def _sub(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"


def _collapse(text: str) -> str:
    return _sub(text, f"[{SPACE}]+", " ")


def _no_digits(text: str) -> str:
    return _sub(text, r"\p{Nd}+")


def _no_punctuation(text: str) -> str:
    return _sub(text, f"[^{WORD}{SPACE}]+")


def _no_links(text: str) -> str:
    return _sub(text, f"http[^{SPACE}]+")


def _clean(text: str) -> str:
    return _no_punctuation(_no_digits(_collapse(_no_links(f"lower({text})"))))


_PAIRS = ", ".join(f"'{first}{rest}': ['{first}', '{rest}']" for first, rest in CONTRACTIONS)
_STOP = ", ".join("'" + word.replace("'", "''") + "'" for word in ENGLISH)

TOKENS = f"""pieces AS (
  SELECT doc_id, flatten(list_transform(regexp_split_to_array({_clean('text')}, '[{SPACE}]+'),
    lambda t: coalesce(MAP {{{_PAIRS}}}[t], [t]))) AS t FROM documents), tokens AS (
  SELECT doc_id, list_filter(t, lambda x: x <> '' AND x NOT IN ({_STOP})) AS tokens FROM pieces)"""

ORACLES["label_parse"] = f"""WITH {DOCS}
SELECT row_id, TRY_CAST(replace(replace(raw_label, 'SDG', ''), '.00', '') AS INTEGER) AS sdg FROM docs"""

ORACLES["drop_missing"] = f"""WITH {DOCS}
SELECT row_id, abstract FROM docs WHERE row_id % 13 > 1 AND abstract <> 'unknown'"""

ORACLES["agreement_filter"] = f"""WITH {VOTES}
SELECT user_id, labels_positive, labels_negative, round(agreement, 6) AS agreement FROM votes WHERE agreement >= 0.5"""

ORACLES["negative_filter"] = f"""WITH {VOTES}, shares AS (
  SELECT user_id, labels_positive, labels_negative,
         CAST(labels_negative AS DOUBLE) / nullif(labels_negative + labels_positive, 0) AS p FROM votes)
SELECT user_id, labels_positive, labels_negative, round(p, 6) AS prob_neg FROM shares WHERE p <= 0.5"""

ORACLES["class_filter"] = f"WITH {DOCS} SELECT row_id, sdg, faculty, year FROM docs WHERE sdg = 4"

ORACLES["lang_filter_column"] = "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'"

ORACLES["strip_quotes"] = """SELECT doc_id,
  rtrim(ltrim('""' || text || '"' || chr(10), '"'), '"' || chr(10)) AS line FROM documents"""

ORACLES["collapse_ws"] = f"SELECT doc_id, {_collapse('text')} AS text FROM documents"
ORACLES["lower_text"] = "SELECT doc_id, lower(text) AS text FROM documents"
ORACLES["drop_digits"] = f"SELECT doc_id, {_no_digits('text')} AS text FROM documents"
ORACLES["drop_punct"] = f"SELECT doc_id, {_no_punctuation('text')} AS text FROM documents"
ORACLES["link_removal"] = f"""SELECT page_id, {_no_links("html || ' ' || url || ' ' || page_id")} AS text FROM pages"""
ORACLES["clean_text"] = f"SELECT doc_id, {_clean('text')} AS text FROM documents"

ORACLES["clean_author"] = f"""WITH written AS (
  SELECT c_custkey, {_no_punctuation("lower(c_name || ', A. B.; ' || c_mktsegment || ' x')")} AS a FROM customer)
SELECT c_custkey, array_to_string(list_filter(regexp_split_to_array(a, '[{SPACE}]+'),
  lambda t: length(t) > 1), '') AS author FROM written"""

ORACLES["title_concat"] = f"""WITH {DOCS}, dotted AS (
  SELECT row_id, abstract, translate(title, '?!', '..') AS d FROM docs), cut AS (
  SELECT row_id, abstract, d, strpos(d, '.') AS mark FROM dotted)
SELECT row_id, CASE WHEN mark > 0 THEN left(d, mark - 1) ELSE d END AS title,
  CASE WHEN mark > 0 THEN left(d, mark - 1) ELSE substr(d, 1, greatest(length(d) - 1, 0)) END AS title_compat,
  CASE WHEN mark > 0 THEN left(d, mark - 1) ELSE d END || '. ' || abstract AS abstract FROM cut"""

ORACLES["tokens_no_stop"] = f"""WITH {TOKENS}
SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM tokens"""

ORACLES["token_array_parse"] = f"""WITH {TOKENS}
SELECT doc_id, CAST(greatest(len(tokens), 1) AS INTEGER) AS n,
  array_to_string(list_transform(tokens, lambda t: '''' || t || ''''), '|') AS tokens FROM tokens"""


def _name(label: str) -> str:
    return f"CASE WHEN {label} > 9 OR {label} = -1 THEN 'sdg_' || ({label}) ELSE 'sdg_0' || ({label}) END"


ORACLES["label_format"] = f"""WITH {PREDS}
SELECT vec_id, {_name('label')} AS name, {_name('label - 2')} AS shifted FROM preds"""

ORACLES["index_anti"] = f"""WITH {DOCS}
SELECT row_id, sdg FROM docs WHERE row_id NOT IN (SELECT doc_id FROM labels)"""

ORACLES["project_cast"] = f"""WITH {DOCS}
SELECT row_id, CAST(sdg AS BIGINT) AS label, CAST(year AS INTEGER) AS year, 'a' AS subset, faculty FROM docs"""

ORACLES["drop_if_present"] = f"WITH {DOCS} SELECT row_id, sdg FROM docs"

ORACLES["union_flag_resplit"] = f"""WITH {DOCS}
SELECT row_id, sdg, CASE WHEN row_id % 3 = 0 THEN 'test' ELSE 'train' END AS part FROM docs"""

ORACLES["append_back"] = f"WITH {SKEWED} SELECT row_id, sdg FROM docs_skewed"

ORACLES["head_per_class"] = f"""WITH {SKEWED}
SELECT row_id, sdg, faculty FROM docs_skewed
QUALIFY row_number() OVER (PARTITION BY sdg ORDER BY row_id) <= 2"""

ORACLES["head_rows"] = f"WITH {DOCS} SELECT row_id, sdg FROM docs ORDER BY row_id LIMIT 121"

MERGED = DOCS + """, merged AS (
  SELECT row_number() OVER (ORDER BY subset, row_id) - 1 AS row_id, subset, row_id AS subset_index, sdg, faculty, year
  FROM (SELECT row_id, 'a' AS subset, sdg, faculty, year FROM docs WHERE faculty = 'en'
        UNION ALL SELECT row_id, 'b', sdg, NULL, NULL FROM docs WHERE faculty <> 'en'))"""

ORACLES["corpus_concat"] = f"WITH {MERGED} SELECT * FROM merged"

ORACLES["provenance_slice"] = f"""WITH {MERGED}
SELECT row_id, subset, subset_index, sdg, coalesce(faculty, 'NA') AS faculty, coalesce(year, 'NA') AS year
FROM merged WHERE subset = 'b'"""


def _split(name: str, source: str, size: float, flag: str) -> str:
    """Exact stratified split of ``source`` by hash order inside each class."""
    return f"""{name}_sizes AS (SELECT sdg, CAST(count(*) AS HUGEINT) AS n FROM {source} GROUP BY sdg),
{name}_total AS (SELECT sum(n) - CAST(ceil({size}::DOUBLE * sum(n)) AS HUGEINT) AS k, sum(n) AS t FROM {name}_sizes),
{name}_parts AS (SELECT sdg, n * k // t AS whole, n * k % t AS rest, k FROM {name}_sizes, {name}_total),
{name}_quotas AS (
  SELECT sdg, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, sdg) <= k - sum(whole) OVER ()
         THEN 1 ELSE 0 END AS quota FROM {name}_parts),
{name} AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.sdg ORDER BY md5(s.row_id || ':13'), s.row_id) > q.quota AS {flag}
  FROM {source} s JOIN {name}_quotas q USING (sdg))"""


def _dev(name: str, source: str) -> str:
    return f"""{name}_counted AS (
  SELECT *, count(*) OVER (PARTITION BY sdg) AS class_n, min(row_id) OVER (PARTITION BY sdg) AS first_id FROM {source}),
{name}_common AS (SELECT row_id, sdg FROM {name}_counted WHERE class_n > 1),
{_split(name + '_drawn', name + '_common', 0.1, 'drawn')},
{name}_got AS (SELECT sdg, count(*) FILTER (drawn) AS devs FROM {name}_drawn GROUP BY sdg),
{name} AS (
  SELECT c.row_id, c.sdg, CASE WHEN c.class_n = 1 THEN false
         WHEN g.devs = 0 THEN c.row_id = c.first_id ELSE d.drawn END AS is_dev
  FROM {name}_counted c LEFT JOIN {name}_drawn d USING (row_id) LEFT JOIN {name}_got g ON g.sdg = c.sdg)"""


SKEWED_SPLIT = f"{SKEWED}, few AS (SELECT row_id, sdg FROM docs_skewed), {_split('flagged', 'few', 0.3, 'is_test')}"

ORACLES["strat_split_rows"] = f"WITH {SKEWED_SPLIT} SELECT row_id, sdg, is_test FROM flagged"

ORACLES["strat_split_sizes"] = f"""WITH {DOCS}, {_split('flagged', 'docs', 0.3, 'is_test')}
SELECT sdg, count(*) FILTER (NOT is_test) AS n_train, count(*) FILTER (is_test) AS n_test FROM flagged GROUP BY sdg"""

ORACLES["dev_split_rare"] = f"""WITH {SKEWED}, few AS (SELECT row_id, sdg FROM docs_skewed), {_dev('devs', 'few')}
SELECT row_id, sdg, is_dev FROM devs"""

NAMED = f"""{SKEWED_SPLIT}, rest AS (SELECT row_id, sdg FROM flagged WHERE NOT is_test), {_dev('devs', 'rest')},
named AS (SELECT f.row_id, f.sdg, CASE WHEN f.is_test THEN 'test' WHEN d.is_dev THEN 'dev' ELSE 'train' END AS split
  FROM flagged f LEFT JOIN devs d USING (row_id))"""

ORACLES["train_dev_test"] = f"WITH {NAMED} SELECT row_id, sdg, split FROM named"

SHARES = """shares AS (
  SELECT sdg, count(*) FILTER (NOT is_test) AS n_train, count(*) FILTER (is_test) AS n_test FROM flagged GROUP BY sdg)"""

ORACLES["class_distribution"] = f"""WITH {SKEWED_SPLIT}, {SHARES}
SELECT sdg, n_train, n_test, round(100.0::DOUBLE * n_train / sum(n_train) OVER (), 1) AS train_percent FROM shares"""

ORACLES["corpus_profile"] = f"""WITH {DOCS}, kept AS (SELECT row_id, sdg FROM docs WHERE abstract <> 'unknown'),
{_split('flagged', 'kept', 0.3, 'is_test')}, {SHARES}, {TOKENS},
counted AS (SELECT sdg, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens FROM kept JOIN tokens ON row_id = doc_id GROUP BY sdg)
SELECT sdg, n_train, n_test, round(100.0::DOUBLE * n_train / sum(n_train) OVER (), 1) AS train_percent, n_tokens
FROM shares JOIN counted USING (sdg)"""

ORACLES["vocab_min3"] = f"""WITH {TOKENS}
SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM tokens) GROUP BY token HAVING count(*) >= 3"""


def _grams(n: int) -> str:
    joined = " || ' ' || ".join(f"tokens[i + {k}]" for k in range(n))
    return f"""placed AS (SELECT doc_id, tokens, unnest(range(1, len(tokens) - {n - 2})) AS i FROM tokens),
grams AS (SELECT doc_id, {joined} AS ngram FROM placed)"""


ORACLES["ngram_counts"] = f"""WITH {TOKENS}, {_grams(2)}
SELECT ngram, count(*) AS n FROM grams GROUP BY ngram"""

ORACLES["doc_ngram_counts"] = f"""WITH {TOKENS}, {_grams(3)}
SELECT doc_id, ngram, count(*) AS n FROM grams GROUP BY doc_id, ngram"""

ORACLES["source_ngram_counts"] = f"""WITH {TOKENS}, words AS (
  SELECT source, unnest(tokens) AS ngram FROM tokens JOIN documents USING (doc_id))
SELECT source, ngram, count(*) AS n FROM words GROUP BY source, ngram"""

ORACLES["span_chunks"] = f"""WITH {TOKENS}, placed AS (
  SELECT doc_id, tokens, unnest(range(0, 1 + CAST(ceil(greatest(len(tokens) - 128, 0) / 96.0::DOUBLE) AS BIGINT))) AS span
  FROM tokens), cut AS (
  SELECT doc_id, span, tokens[span * 96 + 1 : span * 96 + 128] AS chunk FROM placed)
SELECT doc_id, CAST(span AS INTEGER) AS span, CAST(span * 96 AS INTEGER) AS start, CAST(len(chunk) AS INTEGER) AS n,
       array_to_string(chunk, ' ') AS tokens FROM cut"""

ORACLES["mean_pool"] = """WITH parts AS (
  SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(embedding) AS value FROM embeddings)
SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(CAST(value AS DOUBLE)), 6) AS value FROM parts GROUP BY label, dim"""

ORACLES["string_index"] = f"""WITH {DOCS}
SELECT faculty, n, row_number() OVER (ORDER BY n DESC, faculty) - 1 AS faculty_indexed
FROM (SELECT faculty, count(*) AS n FROM docs GROUP BY faculty)"""

ORACLES["one_hot_index"] = f"""WITH {DOCS},
f AS (SELECT faculty, row_number() OVER (ORDER BY count(*) DESC, faculty) - 1 AS i, count(*) OVER () AS k FROM docs GROUP BY faculty),
y AS (SELECT year, row_number() OVER (ORDER BY count(*) DESC, year) - 1 AS i, count(*) OVER () AS k FROM docs GROUP BY year)
SELECT row_id, CAST(CASE WHEN f.i < f.k - 1 THEN f.i ELSE -1 END AS INTEGER) AS faculty_slot,
       CAST(CASE WHEN y.i < y.k - 1 THEN y.i ELSE -1 END AS INTEGER) AS year_slot,
       CAST(f.k - 1 AS INTEGER) AS faculty_width, CAST(y.k - 1 AS INTEGER) AS year_width
FROM docs JOIN f USING (faculty) JOIN y USING (year)"""

PROFILE = f"""squeezed AS (SELECT doc_id, lang, {_collapse('lower(text)')} AS t FROM documents),
placed AS (SELECT doc_id, lang, t, unnest(range(1, length(t) - 1)) AS i FROM squeezed),
grams AS (SELECT doc_id, lang, substr(t, i, 3) AS gram FROM placed),
profile AS (SELECT lang, gram, count(*) AS n FROM grams GROUP BY lang, gram)"""

ORACLES["lang_profile"] = f"WITH {PROFILE} SELECT lang, gram, n FROM profile"

DETECTED = f"""{PROFILE},
totals AS (SELECT lang, sum(n) AS total, (SELECT count(DISTINCT gram) FROM profile) AS v FROM profile GROUP BY lang),
vocabulary AS (SELECT DISTINCT gram FROM profile),
weights AS (
  SELECT gram, lang, ln((coalesce(n, 0) + 1) / CAST(total + v AS DOUBLE)) AS w
  FROM vocabulary CROSS JOIN totals LEFT JOIN profile USING (gram, lang)),
seen AS (SELECT doc_id, gram, count(*) AS c FROM grams GROUP BY doc_id, gram),
scores AS (SELECT doc_id, w.lang, sum(c * w) AS score FROM seen JOIN weights w USING (gram) GROUP BY doc_id, w.lang),
detected AS (
  SELECT doc_id, lang AS detected FROM scores
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)"""

ORACLES["lang_detect"] = f"WITH {DETECTED} SELECT doc_id, detected FROM detected"

ORACLES["lang_filter_detected"] = f"""WITH {DETECTED}
SELECT d.doc_id, d.lang, d.source FROM documents d JOIN detected x ON x.doc_id = d.doc_id AND x.detected = 'en'"""

ORACLES["prepared_titled"] = f"""WITH {DOCS}, {DETECTED}, kept AS (
  SELECT row_id, sdg, faculty, year, translate(title, '?!', '..') AS d, {_collapse('abstract')} AS body
  FROM docs JOIN detected ON doc_id = row_id AND detected = 'en' WHERE abstract <> 'unknown')
SELECT row_id, sdg, faculty, year,
  CASE WHEN strpos(d, '.') > 0 THEN left(d, strpos(d, '.') - 1) ELSE d END || '. ' || body AS abstract FROM kept"""

ORACLES["prepared_voted"] = f"""WITH {DOCS}, {VOTES}, shares AS (
  SELECT user_id, sdg, abstract, labels_positive, labels_negative, agreement,
         CAST(labels_negative AS DOUBLE) / nullif(labels_negative + labels_positive, 0) AS p
  FROM docs JOIN votes ON user_id = row_id WHERE faculty = 'en')
SELECT user_id, sdg, abstract, labels_positive, labels_negative, round(agreement, 6) AS agreement,
       round(p, 6) AS prob_neg FROM shares WHERE agreement >= 0.5 AND p <= 0.5"""

ORACLES["label_map"] = f"""WITH {DOCS}
SELECT row_id, CAST(label AS VARCHAR) AS label, CAST(label = sdg AS INTEGER) AS hit
FROM docs, (SELECT unnest(range(1, 18)) AS label)"""

ORACLES["argmax_label"] = f"""WITH {PROBS}
SELECT vec_id, label, CAST(list_position(probs, list_max(probs)) AS INTEGER) AS prediction,
       list_max(probs) AS probability FROM probs"""

ORACLES["argmax_label_map"] = f"""WITH {PROBS}
SELECT vec_id, CAST(list_position(probs, list_max(probs)) AS VARCHAR) AS prediction,
       list_max(probs) AS probability FROM probs"""


ORACLES["predictions_table"] = f"""WITH {DOCS}, {PROBS}
SELECT row_id, abstract, sdg AS label, CAST(list_position(probs, list_max(probs)) AS INTEGER) AS prediction,
       list_max(probs) AS probability
FROM docs LEFT JOIN probs ON vec_id = row_id"""


def _confusion(preds: str, labels: str, keys: str = "") -> str:
    key_list = f"{keys}, " if keys else ""
    from_keys = f"(SELECT DISTINCT {keys} FROM preds), " if keys else ""
    on = f"{keys}, label, prediction" if keys else "label, prediction"
    return f"""{preds}, grid AS (
  SELECT * FROM {from_keys}(SELECT unnest({labels}) AS label), (SELECT unnest({labels}) AS prediction)),
pairs AS (SELECT {key_list}label, prediction, count(*) AS n FROM preds GROUP BY ALL),
matrix AS (SELECT {key_list}prediction::INTEGER AS prediction, label::INTEGER AS label, coalesce(n, 0) AS n
           FROM grid LEFT JOIN pairs USING ({on}))"""


ORACLES["confusion_long"] = f"WITH {_confusion(PREDS, 'range(1, 9)')} SELECT * FROM matrix"

ORACLES["confusion_wide"] = f"""WITH {_confusion(PREDS, 'range(1, 9)')}
SELECT prediction, {', '.join(f'CAST(sum(n) FILTER (label = {i}) AS BIGINT) AS true_{i}' for i in range(1, 9))}
FROM matrix GROUP BY prediction"""

ORACLES["eval_grid_confusion"] = f"""WITH {_confusion(GRID_PREDS, 'range(1, 11)', 'condition, model, seed')}
SELECT * FROM matrix"""

ORACLES["eval_grid_lists"] = f"""WITH {_confusion(GRID_PREDS, 'range(1, 11)', 'condition, model, seed')}
SELECT * FROM matrix WHERE condition > 0 OR (label < 10 AND prediction < 10)"""


def _report(preds: str, labels: str, keys: str = "") -> str:
    key_list = f"{keys}, " if keys else ""
    from_keys = f"(SELECT DISTINCT {keys} FROM preds), " if keys else ""
    using = f"{keys}, cls" if keys else "cls"
    return f"""{preds},
sides AS (
  SELECT {key_list}label AS cls, CAST(label = prediction AS INTEGER) AS tp, 0 AS predicted, 1 AS support FROM preds
  UNION ALL SELECT {key_list}prediction, 0, 1, 0 FROM preds),
listed AS (SELECT * FROM {from_keys}(SELECT CAST(unnest({labels}) AS INTEGER) AS cls)),
sums AS (
  SELECT {key_list}cls, coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(predicted), 0)::BIGINT AS predicted,
         coalesce(sum(support), 0)::BIGINT AS support
  FROM listed LEFT JOIN sides USING ({using}) GROUP BY ALL),
report AS (
  SELECT {key_list}cls AS label, tp, predicted, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision,
         coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall,
         coalesce(2 * tp / nullif(predicted + support, 0)::DOUBLE, 0) AS f1, support FROM sums)"""


_ROUNDED = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
_GRID_KEYS = "condition, model, seed"

ORACLES["class_report"] = f"WITH {_report(PREDS, 'range(1, 18)')} SELECT label, {_ROUNDED}, support FROM report"

ORACLES["eval_grid"] = f"""WITH {_report(GRID_PREDS, 'range(1, 18)', _GRID_KEYS)}
SELECT {_GRID_KEYS}, label, {_ROUNDED}, support FROM report"""


def _averages(keys: str = "") -> str:
    key_list = f"{keys}, " if keys else ""
    weighted = ", ".join(f"coalesce(sum({s} * support) / nullif(sum(support), 0), 0) AS {s}" for s in ("precision", "recall", "f1"))
    return f"""averages AS (
  SELECT {key_list}'macro avg' AS label, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1,
         sum(support)::BIGINT AS support FROM report GROUP BY ALL
  UNION ALL SELECT {key_list}'weighted avg', {weighted}, sum(support)::BIGINT FROM report GROUP BY ALL)"""


ORACLES["report_averages"] = f"""WITH {_report(PREDS, 'range(1, 18)')}, {_averages()}
SELECT label, {_ROUNDED}, support FROM averages"""


def _overall(last: int, keys: str) -> str:
    key_list = f"{keys}, " if keys else ""
    return f"""SELECT {key_list}CASE WHEN bool_and(label <= {last} AND prediction <= {last}) THEN 'accuracy' ELSE 'micro avg' END AS label,
  count(*) FILTER (label = prediction AND label <= {last}) / count(*) FILTER (prediction <= {last})::DOUBLE AS precision,
  count(*) FILTER (label = prediction AND label <= {last}) / count(*) FILTER (label <= {last})::DOUBLE AS recall,
  2 * count(*) FILTER (label = prediction AND label <= {last})
    / (count(*) FILTER (prediction <= {last}) + count(*) FILTER (label <= {last}))::DOUBLE AS f1,
  count(*) FILTER (label <= {last}) AS support FROM preds GROUP BY ALL"""


ORACLES["report_micro"] = f"""WITH {PREDS}, both_lists AS (
  SELECT *, 'all' AS listed FROM ({_overall(17, 'condition')})
  UNION ALL SELECT *, 'some' FROM ({_overall(8, 'condition')}))
SELECT condition, label, {_ROUNDED}, support, listed FROM both_lists"""

AUC = f"""{PROBS}, scored AS (
  SELECT unnest(range(1, 11)) AS cls, unnest(probs) AS score, label FROM probs),
ranked AS (
  SELECT cls, label = cls AS hit,
         rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0::DOUBLE AS r
  FROM scored),
ranks AS (
  SELECT cls, count(*) FILTER (hit) AS n_pos, count(*) FILTER (NOT hit) AS n_neg, sum(r) FILTER (hit) AS r
  FROM ranked GROUP BY cls),
auc AS (SELECT CAST(cls AS INTEGER) AS label, n_pos, n_neg,
  (r - n_pos * (n_pos + 1) / 2.0::DOUBLE) / nullif(n_pos * n_neg, 0)::DOUBLE AS auc FROM ranks)"""

ORACLES["macro_auc"] = f"WITH {AUC} SELECT label, n_pos, n_neg, round(auc, 6) AS auc FROM auc"

_PROB_PREDS = "preds AS (SELECT label, CAST(list_position(probs, list_max(probs)) AS INTEGER) AS prediction FROM probs)"

ORACLES["category_scores"] = f"""WITH {AUC}, {_report(_PROB_PREDS, 'range(1, 11)')}, scores AS (
  SELECT CAST(label AS VARCHAR) AS label, precision, recall, f1, support, auc FROM report JOIN auc USING (label)
  UNION ALL SELECT 'micro', sum(tp) / sum(predicted)::DOUBLE, sum(tp) / sum(support)::DOUBLE,
    2 * sum(tp) / (sum(predicted) + sum(support))::DOUBLE, sum(support)::BIGINT, NULL FROM report
  UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT, avg(coalesce(auc, 0))
    FROM report JOIN auc USING (label))
SELECT label, {_ROUNDED}, support, round(auc, 6) AS auc FROM scores"""


def _number(name: str) -> str:
    return f"lpad(printf('%.4f', {name}), 9, ' ')"


ORACLES["report_text"] = f"""WITH {_report(PREDS, 'range(1, 9)')}, {_averages()}, lines AS (
  SELECT label AS line, {_name('label')} AS label, precision, recall, f1, support FROM report
  UNION ALL SELECT 9, * FROM ({_overall(8, '')})
  UNION ALL SELECT CASE label WHEN 'macro avg' THEN 10 ELSE 11 END, * FROM averages)
SELECT CAST(line AS BIGINT) AS line, lpad(label, 12, ' ') || ' ' || {_number('precision')} || ' ' || {_number('recall')} || ' '
  || {_number('f1')} || ' ' || lpad(CAST(support AS VARCHAR), 9, ' ') AS text FROM lines"""

ORACLES["tsv_round_trip"] = f"""WITH {VOTES}
SELECT user_id, labels_positive, labels_negative, round(agreement, 6) AS agreement FROM votes"""

ORACLES["quoted_lines_scan"] = f"""WITH {VOTES}
SELECT user_id, labels_positive, labels_negative FROM votes"""

ORACLES["null_token"] = f"""WITH {MERGED}
SELECT row_id, coalesce(faculty, 'NA') AS faculty, coalesce(year, 'NA') AS year, subset,
       CAST(faculty IS NULL AS INTEGER) AS missing FROM merged"""

ORACLES["predictions_scan"] = f"""WITH {PREDS}
SELECT label, prediction, count(*) AS n FROM preds GROUP BY label, prediction"""

_STORE_PREDS = PREDS + """, keyed AS (
  SELECT 'm' || model AS model, 'a' AS train_set, 't' || condition AS test_set, CAST(seed AS VARCHAR) AS seed, label, prediction FROM preds)"""
_STORE_KEYS = "model, train_set, test_set, seed"
_STORE_REPORT = _report("preds AS (SELECT * FROM keyed)", "range(1, 18)", _STORE_KEYS).replace("preds", "stored")
_STORE_OVERALL = _overall(17, _STORE_KEYS).replace("FROM preds", "FROM stored")

ORACLES["json_report"] = f"""WITH {_STORE_PREDS}, {_STORE_REPORT}, {_averages(_STORE_KEYS)}, rows AS (
  SELECT {_STORE_KEYS}, {_name('label')} AS label, precision, recall, f1, support FROM report
  UNION ALL SELECT * FROM ({_STORE_OVERALL})
  UNION ALL SELECT * FROM averages)
SELECT {_STORE_KEYS}, label, {_ROUNDED}, support FROM rows"""

ORACLES["label_docs_sink"] = f"""WITH {NAMED}
SELECT n.row_id, 'a' AS dataset, n.split, CAST(length(d.abstract) AS INTEGER) AS n_chars,
       CAST(l.label AS VARCHAR) AS label, CAST(l.label = n.sdg AS INTEGER) AS hit
FROM named n JOIN docs d USING (row_id), (SELECT unnest(range(1, 18)) AS label) l"""

ORACLES["w2v_vocabulary"] = f"""WITH {TOKENS}
SELECT word, 10 AS dims FROM (SELECT unnest(tokens) AS word FROM tokens) GROUP BY word HAVING count(*) >= 3"""

ORACLES["lr_predict_rules"] = f"""WITH vectors AS (SELECT vec_id AS row_id, label + 1 AS sdg FROM embeddings),
{_split('flagged', 'vectors', 0.3, 'is_test')}
SELECT row_id, sdg AS label, CAST((SELECT max(sdg) FROM flagged WHERE NOT is_test) + 1 AS INTEGER) AS slots,
       true AS sums_to_one, true AS is_best FROM flagged WHERE is_test"""

ORACLES["text_round_trip"] = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '  ' || text || ' ' WHEN 1 THEN '"' || text || '" "q"'
  WHEN 2 THEN chr(9) || text ELSE text END AS text FROM documents"""

ORACLES["encode_many"] = ORACLES["one_hot_index"]
ORACLES["lang_detect_join"] = ORACLES["lang_detect"]

ORACLES["rejected_rows"] = f"""WITH {DOCS}
SELECT row_id, CASE WHEN row_id % 14 = 0 THEN 'no label' END AS sdg FROM docs WHERE row_id % 7 = 0"""

ORACLES["stored_runs"] = f"""WITH {_preds("(0), (13)")}, runs AS (
  SELECT 'a' AS train_set, 'a' AS test_set, seed, label, prediction FROM preds WHERE condition = 0
  UNION ALL SELECT 'ab', 'ab', seed, label, prediction FROM preds
  UNION ALL SELECT 'ab', CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END, seed, label, prediction FROM preds
  UNION ALL SELECT 'b', 'a', seed, label, prediction FROM preds WHERE condition = 1)
SELECT 'linear' AS model, train_set, test_set, CAST(seed AS VARCHAR) AS seed, prediction, label, count(*) AS n
FROM runs GROUP BY ALL"""

ORACLES["w2v_rules"] = f"""WITH {DOCS} SELECT row_id, 10 AS dims, true AS is_mean FROM docs"""


def _rules(name: str, source: str, more: str = "") -> str:
    return f"""{_split(name, source, 0.3, 'is_test')}, {name}_rules AS (SELECT row_id, sdg AS label, {more}
  true AS sums_to_one, true AS is_best FROM {name} WHERE is_test)"""


ORACLES["ablation_rules"] = f"""WITH {DOCS}, {_rules('flagged', 'docs')}
SELECT r.*, c.condition FROM flagged_rules r, (VALUES ('authors'), ('default'), ('none')) c(condition)"""

ORACLES["cross_corpus_rules"] = f"""WITH {DOCS}, a AS (SELECT * FROM docs WHERE faculty = 'en'), b AS (SELECT * FROM docs WHERE faculty <> 'en'),
{_rules('own', 'b')}, {_rules('other', 'a')}
SELECT *, 'own' AS test_set FROM own_rules UNION ALL SELECT *, 'other' FROM other_rules"""

ORACLES["bow_rules"] = f"""WITH {DOCS}, {_rules('flagged', 'docs')} SELECT * FROM flagged_rules"""

ORACLES["bow_first_order"] = f"""WITH {DOCS}, {_split('flagged', 'docs', 0.3, 'is_test')}
SELECT sdg AS label, count(*) AS n, true AS sums_to_rows FROM flagged WHERE NOT is_test GROUP BY sdg"""


def _pooled(window: int, stride: int, keys: str) -> str:
    return f"""WITH {TOKENS}, placed AS (
  SELECT doc_id, tokens, unnest(range(0, 1 + CAST(ceil(greatest(len(tokens) - {window}, 0) / {stride}.0::DOUBLE) AS BIGINT))) AS span
  FROM tokens), cut AS (
  SELECT doc_id, CAST(span AS INTEGER) AS span, CAST(span * {stride} AS INTEGER) AS start,
         tokens[span * {stride} + 1 : span * {stride} + {window}] AS chunk FROM placed),
words AS (SELECT token FROM (SELECT unnest(tokens) AS token FROM tokens) GROUP BY token HAVING count(*) >= 3),
vectors AS (SELECT token, dim, CAST('0x' || substr(md5(token), 2 * dim + 1, 2) AS INTEGER) / 256.0::DOUBLE - 0.5 AS value
  FROM words, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS dim)),
each AS (SELECT doc_id, span, unnest(chunk) AS token FROM cut),
sums AS (SELECT {keys}, dim, sum(value) AS total FROM each JOIN vectors USING (token) GROUP BY {keys}, dim)"""


ORACLES["span_pool"] = f"""{_pooled(128, 96, 'doc_id')},
sizes AS (SELECT doc_id, sum(len(chunk)) AS size FROM cut GROUP BY doc_id)
SELECT doc_id, dim, total / greatest(size, 1) AS value FROM sizes LEFT JOIN sums USING (doc_id)"""

ORACLES["span_vectors"] = f"""{_pooled(64, 48, 'doc_id, span')}
SELECT doc_id, span, start, CAST(len(chunk) AS INTEGER) AS size, dim, total / greatest(len(chunk), 1) AS value
FROM cut LEFT JOIN sums USING (doc_id, span)"""

ORACLES["word_vectors_by_layout"] = f"""WITH {TOKENS}
SELECT token AS word, count(*) AS n, true AS equal, true AS trained
FROM (SELECT unnest(tokens) AS token FROM tokens) GROUP BY token HAVING count(*) >= 3"""

ORACLES["record_scan"] = """SELECT doc_id, nullif(text, '') AS text FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 19 <> 0"""

ORACLES["record_rejects"] = """SELECT CASE WHEN doc_id % 17 = 0 THEN 'number of fields' ELSE 'doc_id is no bigint' END AS cause,
  CASE WHEN doc_id % 17 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'x' || doc_id || chr(9) || '5" disk' END AS record
FROM documents WHERE doc_id % 17 = 0 OR doc_id % 19 = 0"""

ORACLES["vocab_floor"] = ORACLES["vocab_min3"]

ORACLES["ngram_floor"] = f"{ORACLES['ngram_counts']} HAVING count(*) >= 2"
