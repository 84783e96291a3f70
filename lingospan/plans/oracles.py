"""Reference SQL of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from lingospan.plans.queries import VOCABULARY_SIZE

VIEWS = {
    "logits": r"""
        SELECT e.vec_id AS example_id, d.lang, split_part(d.text, chr(10), 1) AS premise,
               substr(d.text, length(split_part(d.text, chr(10), 1)) + 2) AS hypothesis,
               e.label % 3 AS gold_label,
               CAST(embedding[1] AS DOUBLE) AS l0, CAST(embedding[2] AS DOUBLE) AS l1,
               CAST(embedding[3] AS DOUBLE) AS l2, CAST(embedding[4] AS DOUBLE) AS m0,
               CAST(embedding[5] AS DOUBLE) AS m1, CAST(embedding[6] AS DOUBLE) AS m2
        FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id""",
    "soft": r"""
        SELECT *, exp(l0 - m) / s AS p0, exp(l1 - m) / s AS p1, exp(l2 - m) / s AS p2, 1 / s AS confidence
        FROM (SELECT *, exp(l0 - m) + exp(l1 - m) + exp(l2 - m) AS s
              FROM (SELECT * EXCLUDE (m0, m1, m2), greatest(l0, l1, l2) AS m FROM logits) a) b""",
    "preds": r"""
        SELECT *, CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS predicted_label
        FROM soft""",
    "lang_dim": r"""
        SELECT * FROM (VALUES ('en','English','Germanic','Latin','Low','SVO'),
          ('de','German','Germanic','Latin','Medium','V2/SOV'), ('zh','Chinese','Sino-Tibetan','Hanzi','Low','SVO'),
          ('ar','Arabic','Semitic','Arabic','High','VSO'), ('ru','Russian','Slavic','Cyrillic','High','Free'),
          ('hi','Hindi','Indo-Aryan','Devanagari','High','SOV'))
          AS t(language, name, family, script, morphology, word_order)""",
    "names": "SELECT * FROM (VALUES (0,'entailment'),(1,'neutral'),(2,'contradiction')) AS t(id, name)",
    "errors": r"""
        SELECT p.* EXCLUDE (lang), p.lang AS language, l.name AS language_name, l.family, l.script, l.morphology,
               l.word_order, g.name AS gold_name, q.name AS predicted_name,
               row_number() OVER (PARTITION BY p.lang ORDER BY p.example_id) AS id
        FROM preds p LEFT JOIN lang_dim l ON p.lang = l.language
        JOIN names g ON g.id = p.gold_label JOIN names q ON q.id = p.predicted_label
        WHERE p.predicted_label <> p.gold_label AND p.premise <> '' AND p.hypothesis <> ''""",
    "annotated": r"""
        SELECT *, CASE example_id % 7 WHEN 0 THEN 'E1' WHEN 1 THEN 'E2' WHEN 2 THEN 'E3' WHEN 3 THEN 'E4'
                  WHEN 4 THEN 'E5' WHEN 5 THEN 'E9' END AS error_category FROM errors""",
    "wanted": r"""
        SELECT * FROM (VALUES (0,'en'),(1,'de'),(2,'zh'),(3,'ar'),(4,'ru'),(5,'hi'),(6,'fr'),(7,'es'))
        AS t(position, lang)""",
    "by_lang": r"""
        SELECT w.position, w.lang, count(p.example_id) AS n,
               count(*) FILTER (WHERE p.predicted_label = p.gold_label) AS correct,
               avg(CASE WHEN p.predicted_label = p.gold_label THEN 1e0 WHEN p.example_id IS NOT NULL THEN 0e0 END)
                 AS accuracy
        FROM wanted w LEFT JOIN preds p ON p.lang = w.lang GROUP BY ALL""",
    "gaps": r"""
        SELECT *, coalesce((SELECT max(accuracy) FROM by_lang WHERE lang = 'en'), 0) - accuracy AS gap FROM by_lang""",
    "pairs_long": r"""
        SELECT doc_id AS example_id,
               CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split,
               lang, split_part(text, chr(10), 1) AS premise,
               substr(text, length(split_part(text, chr(10), 1)) + 2) AS hypothesis, n_chars % 3 AS label
        FROM documents""",
    "aligned": r"""
        SELECT example_id // 10 AS id, lang, string_agg(premise, chr(10) ORDER BY example_id) AS premise,
               string_agg(hypothesis, chr(10) ORDER BY example_id) AS hypothesis, (example_id // 10) % 3 AS label
        FROM pairs_long GROUP BY example_id // 10, lang""",
    "turns": r"""
        SELECT conv_id, turn, text AS premise, next_text AS hypothesis FROM (
          SELECT conv_id, turn, role, text,
                 lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text,
                 lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
                 lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn
          FROM conversations) t
        WHERE role = 'user' AND next_role = 'assistant' AND next_turn = turn + 1""",
    "turn_logits": r"""
        SELECT conv_id, turn, premise, hypothesis, (length(premise) % 7) / 2e0 AS l0, (length(hypothesis) % 5) / 2e0 AS l1,
               ((length(premise) + length(hypothesis)) % 6) / 2e0 AS l2
        FROM turns""",
    "turn_scores": r"""
        SELECT *, CASE WHEN l0 >= l1 AND l0 >= l2 THEN 'entailment' WHEN l1 >= l2 THEN 'neutral' ELSE 'contradiction' END
                 AS predicted_name,
               1 / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2)))
                 AS confidence
        FROM turn_logits""",
    "epochs": r"""
        SELECT CAST(day(ts) AS BIGINT) AS epoch,
               avg(CASE WHEN event_type IN ('view', 'click') THEN 1e0 ELSE 0e0 END) AS val_accuracy
        FROM events GROUP BY 1""",
    "train_tokens": r"""
        SELECT unnest(regexp_extract_all(premise, '[\p{L}\p{M}\p{N}]+|[^\s]')) AS word
        FROM pairs_long WHERE split = 'train' AND lang = 'en'
        UNION ALL
        SELECT unnest(regexp_extract_all(hypothesis, '[\p{L}\p{M}\p{N}]+|[^\s]')) AS word
        FROM pairs_long WHERE split = 'train' AND lang = 'en'""",
    "vocab": rf"""
        SELECT * FROM (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) + 3 AS token_id
                       FROM train_tokens GROUP BY word) v
        WHERE token_id < {VOCABULARY_SIZE} + 4""",
}


def _needs(sql: str) -> list[str]:
    """The views a text uses, directly or through other views, in definition order."""
    import re

    used, queue = set(), [sql]
    while queue:
        words = set(re.findall(r"\w+", queue.pop()))
        for name in VIEWS:
            if name in words and name not in used:
                used.add(name)
                queue.append(VIEWS[name])
    return [name for name in VIEWS if name in used]


def _with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    extra = extra or {}
    names = _needs(" ".join([sql, *extra.values()]))
    parts = [f"{name} AS ({VIEWS[name]})" for name in names] + [f"{k} AS ({v})" for k, v in extra.items()]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


def _encoding(source: str, keys: str, max_length: int, padding: str, batch: str = "0") -> str:
    """Ids of each pair in ``source`` (columns a text, b text, keys, label), as text."""
    budget = max_length - 4
    extra = {
        "source": source,
        "words": rf"""SELECT *, regexp_extract_all(a, '[\p{{L}}\p{{M}}\p{{N}}]+|[^\s]') AS wa,
                             regexp_extract_all(b, '[\p{{L}}\p{{M}}\p{{N}}]+|[^\s]') AS wb FROM source""",
        "cut_a": f"""SELECT *, least(len(wa), greatest({budget} - len(wb), {(budget + 1) // 2})) AS na FROM words""",
        "cut": f"SELECT *, least(len(wb), {budget} - na) AS nb, {batch} AS batch FROM cut_a",
        "ids_a": """SELECT key, string_agg(CAST(coalesce(v.token_id, 3) AS VARCHAR), ' ' ORDER BY pos) AS ids
                    FROM (SELECT key, unnest(wa[1:na]) AS w, unnest(range(1, na + 1)) AS pos FROM cut) t
                    LEFT JOIN vocab v ON v.word = t.w GROUP BY key""",
        "ids_b": """SELECT key, string_agg(CAST(coalesce(v.token_id, 3) AS VARCHAR), ' ' ORDER BY pos) AS ids
                    FROM (SELECT key, unnest(wb[1:nb]) AS w, unnest(range(1, nb + 1)) AS pos FROM cut) t
                    LEFT JOIN vocab v ON v.word = t.w GROUP BY key""",
        "width": {
            "max_length": f"SELECT *, {max_length} AS total FROM cut",
            "none": "SELECT *, na + nb + 4 AS total FROM cut",
            "longest": "SELECT *, max(na + nb + 4) OVER (PARTITION BY batch) AS total FROM cut",
        }[padding],
    }
    sql = f"""SELECT w.{keys}, CAST(w.total AS BIGINT) AS n_ids, CAST(na + nb + 4 AS BIGINT) AS n_real,
                     concat_ws(' ', '0', ia.ids, '2 2', ib.ids, '2') || repeat(' 1', CAST(w.total - na - nb - 4 AS BIGINT))
                       AS input_ids, CAST(w.label AS BIGINT) AS labels
              FROM width w LEFT JOIN ids_a ia ON ia.key = w.key LEFT JOIN ids_b ib ON ib.key = w.key"""
    return _with_views(sql, extra)


PAIR_SOURCE = "SELECT example_id AS key, example_id, premise AS a, hypothesis AS b, label FROM pairs_long"
PARAPHRASE_SOURCE = """SELECT id || '-' || lang AS key, id || '-' || lang AS id, premise AS a, hypothesis AS b,
                              id % 2 AS label FROM aligned"""

FLAT_RECORD = """id, language, language_name, family, script, morphology, word_order, premise, hypothesis,
    gold_name AS gold_label, predicted_name AS predicted_label, round(confidence, 6) AS confidence,
    round(p0, 6) AS p_entailment, round(p1, 6) AS p_neutral, round(p2, 6) AS p_contradiction,
    '' AS error_category, '' AS notes"""

WHITESPACE = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)||chr(133)||chr(160)"
    "||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)"
    "||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
)

SCRIPT_COUNTS = r"""SELECT lang, CASE WHEN regexp_full_match(ch, '\p{Latin}') THEN 'LATIN'
      WHEN regexp_full_match(ch, '\p{Greek}') THEN 'GREEK' WHEN regexp_full_match(ch, '\p{Cyrillic}') THEN 'CYRILLIC'
      WHEN regexp_full_match(ch, '\p{Han}') THEN 'CJK' ELSE 'OTHER' END AS script, count(*) AS n
    FROM (SELECT lang, unnest(regexp_extract_all(text, '\p{L}')) AS ch FROM documents) c GROUP BY 1, 2"""

LABEL_COUNTS = """SELECT s.split, CAST(k.id AS BIGINT) AS label, k.name,
      count(*) FILTER (WHERE p.label = k.id) AS count,
      count(*) FILTER (WHERE p.label = k.id) * 100e0 / nullif(count(p.example_id), 0) AS pct
    FROM (VALUES ('train'), ('validation'), ('test')) s(split) CROSS JOIN names k
    LEFT JOIN pairs_long p ON p.split = s.split GROUP BY ALL"""


def _texts(keys: str, premise: str, hypothesis: str, source: str) -> str:
    return f"SELECT {keys}, {premise} AS premise, {hypothesis} AS hypothesis, CAST(label AS BIGINT) AS label FROM {source}"


def _wide(lang: str, fallback: str) -> str:
    """Text of one language per block; ``fallback`` is the value where the block lacks it."""
    return _with_views(
        f"""SELECT id AS example_id,
              coalesce(max(CASE WHEN lang = '{lang}' THEN premise END), {fallback.format(c='premise')}) AS premise,
              coalesce(max(CASE WHEN lang = '{lang}' THEN hypothesis END), {fallback.format(c='hypothesis')}) AS hypothesis,
              CAST(max(label) AS BIGINT) AS label
            FROM aligned GROUP BY id"""
    )


def _crosstab(key: str) -> str:
    counts = ", ".join(
        f"count(*) FILTER (WHERE error_category = '{c}') AS \"{c}\"" for c in ("E1", "E2", "E3", "E4", "E5", "E9")
    )
    return _with_views(
        f"SELECT {key}, {counts}, 0 AS other FROM annotated WHERE error_category IS NOT NULL AND {key} IS NOT NULL GROUP BY {key}"
    )


CATEGORIES = """(VALUES ('E1', 'Lexical Overlap – High word similarity led to wrong Entailment prediction'),
    ('E2', 'Negation Failure – Missed negation markers (not, لا, 不, nicht, etc.)'),
    ('E3', 'Script/Tokenization – Subword splits disrupted semantic meaning'),
    ('E4', 'Morphological – Case endings or inflections caused misinterpretation'),
    ('E5', 'Word Order – Non-SVO syntax confused the English-trained model')) AS c(code, description)"""

SCORED = r"""SELECT example_id, lang,
      CASE WHEN trim(premise, {w}) = '' THEN 'missing_premise' WHEN trim(hypothesis, {w}) = '' THEN 'missing_hypothesis'
           ELSE 'ok' END AS status,
      CASE WHEN status = 'ok' THEN n.name END AS predicted_name,
      CASE WHEN status = 'ok' THEN round(p0, 6) END AS p0, CASE WHEN status = 'ok' THEN round(p1, 6) END AS p1,
      CASE WHEN status = 'ok' THEN round(p2, 6) END AS p2,
      CASE WHEN status = 'ok' THEN round(confidence, 6) END AS confidence
    FROM preds JOIN names n ON n.id = predicted_label""".replace("{w}", WHITESPACE)

PRF_PARTS = """SELECT lang, k.id,
      count(*) FILTER (WHERE gold_label = k.id AND predicted_label = k.id) AS tp,
      count(*) FILTER (WHERE predicted_label = k.id) AS np, count(*) FILTER (WHERE gold_label = k.id) AS ng
    FROM preds, names k GROUP BY ALL"""

SUGGEST = {
    "measured": r"""SELECT *, regexp_extract_all(premise, '[\p{L}\p{M}\p{N}]+|[^\s]') AS ta,
          regexp_extract_all(hypothesis, '[\p{L}\p{M}\p{N}]+|[^\s]') AS tb,
          len(regexp_extract_all(premise || ' ' || hypothesis, '[\p{L}\p{M}\p{N}]+|[^\s]'))
          / nullif(CAST(len(regexp_extract_all(premise || ' ' || hypothesis, '\S+')) AS DOUBLE), 0) AS ratio
        FROM errors""",
    "flags": r"""SELECT *, len(list_intersect(ta, tb)) / nullif(CAST(len(list_distinct(tb)) AS DOUBLE), 0) AS overlap,
          list_has_any(regexp_extract_all(lower(premise), '[\p{L}\p{M}\p{N}]+|[^\s]'), ['not', 'لا', 'nicht'])
            OR contains(premise, '不') AS nega,
          list_has_any(regexp_extract_all(lower(hypothesis), '[\p{L}\p{M}\p{N}]+|[^\s]'), ['not', 'لا', 'nicht'])
            OR contains(hypothesis, '不') AS negb,
          avg(ratio) OVER (PARTITION BY language) AS mean_ratio FROM measured""",
}

ORACLES: dict[str, str] = {
    "load_splits": """SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END
        AS split, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1""",
    "ingest_status": """SELECT CAST(r.run AS BIGINT) AS run, l.lang,
          CASE WHEN l.lang = 'ja' THEN 'error' WHEN r.run = 1 THEN 'saved' ELSE 'skipped' END AS status,
          count(d.doc_id) AS n
        FROM (VALUES (1), (2)) r(run) CROSS JOIN (VALUES ('de'), ('en'), ('es'), ('fr'), ('ja')) l(lang)
        LEFT JOIN documents d ON d.lang = l.lang GROUP BY ALL""",
    "load_languages": """SELECT l.lang, CASE l.lang WHEN 'zh' THEN 'no rows' ELSE 'saved' END AS status,
          CASE WHEN l.lang IN ('de', 'en') THEN count(d.doc_id) END AS n,
          CASE WHEN l.lang IN ('de', 'en') THEN CAST(sum(d.n_chars) AS BIGINT) END AS chars
        FROM (VALUES ('de'), ('en'), ('fr'), ('zh')) l(lang) LEFT JOIN documents d ON d.lang = l.lang GROUP BY l.lang""",
    "dataset_sizes": _with_views("""SELECT lang, count(*) FILTER (WHERE split = 'train') AS train,
          count(*) FILTER (WHERE split = 'validation') AS validation, count(*) FILTER (WHERE split = 'test') AS test
        FROM pairs_long GROUP BY lang"""),
    "errors_csv_roundtrip": _with_views("""SELECT example_id AS id, language, language_name, md5(premise) AS premise,
          md5(hypothesis) AS hypothesis, gold_name AS gold_label, predicted_name AS predicted_label,
          round(confidence, 6) AS confidence, CAST(NULL AS VARCHAR) AS error_category,
          'say "why", then' || chr(10) || 'more' AS notes, family, script, morphology FROM errors"""),
    "errors_json_roundtrip": _with_views(f"SELECT {FLAT_RECORD} FROM errors WHERE id <= 15"),
    "annotation_progress": _with_views("""SELECT language, count(*) AS total, count(error_category) AS annotated
        FROM annotated GROUP BY language"""),
    "bulk_score_csv": _with_views("""SELECT conv_id, turn, predicted_name, round(confidence, 6) AS confidence,
          'ok' AS status FROM turn_scores"""),
    "encoded_shape_check": """SELECT count(*) AS rows, c AS "column", 128::BIGINT AS min_size, 128::BIGINT AS max_size
        FROM documents, (VALUES ('input_ids'), ('attention_mask')) t(c) GROUP BY c""",
    "attach_ids": "SELECT row_number() OVER () - 1 AS example_id, doc_id FROM documents",
    "select_lang_strict": _with_views(_texts("id AS example_id", "premise", "hypothesis", "aligned WHERE lang = 'de'")),
    "select_lang_default": _wide("fr", "''"),
    "select_lang_first": _wide("fr", "min_by({c}, lang)"),
    "unpivot_languages": _with_views(
        _texts("id AS example_id, lang", "premise", "hypothesis", "aligned WHERE lang IN ('en', 'de', 'fr')")
    ),
    "nonempty_pairs": _with_views(
        _texts("example_id", "premise", "hypothesis", "pairs_long WHERE premise <> '' AND hypothesis <> ''")
    ),
    "validate_pairs": _with_views(f"""SELECT example_id,
          CASE WHEN trim(premise, {WHITESPACE}) = '' THEN 'missing_premise'
               WHEN trim(hypothesis, {WHITESPACE}) = '' THEN 'missing_hypothesis' ELSE 'ok' END AS status,
          md5(trim(premise, {WHITESPACE})) AS premise, md5(trim(hypothesis, {WHITESPACE})) AS hypothesis
        FROM pairs_long"""),
    "train_eval_split": _with_views("""SELECT CASE split WHEN 'train' THEN 'train' ELSE 'eval' END AS "use", lang, split,
          count(*) AS n, CAST(sum(length(premise) + length(hypothesis)) AS BIGINT) AS chars FROM pairs_long
        WHERE (split = 'train' AND lang = 'en') OR split = 'validation' GROUP BY ALL"""),
    "decode_labels": _with_views("""SELECT example_id, g.name AS gold_name, q.name AS predicted_name,
          coalesce(o.name, 'contradiction') AS open_name
        FROM preds JOIN names g ON g.id = gold_label JOIN names q ON q.id = predicted_label
        LEFT JOIN names o ON o.id = gold_label + 1"""),
    "encode_labels": """SELECT conv_id, turn, CAST(CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 END AS BIGINT)
        AS role_id FROM conversations""",
    "decode_paraphrase": _with_views("""SELECT id, lang, CASE WHEN id % 2 = 1 THEN 'Paraphrase' ELSE 'Not paraphrase' END
        AS name FROM aligned"""),
    "decode_ner_tags": r"""SELECT doc_id AS id, len(regexp_extract_all(text, '\S+')) AS tokens,
          md5(coalesce(array_to_string(list_transform(regexp_extract_all(text, '\S+'),
            lambda t: ['O', 'B-PER', 'I-PER', 'B-ORG', 'I-ORG', 'B-LOC', 'I-LOC'][length(t) % 7 + 1]), ' '), '')) AS tags
        FROM documents""",
    "preview_pairs": _with_views(r"""SELECT example_id, substr(premise, 1, 80) || '...' AS premise,
          substr(hypothesis, 1, 50) || '...' AS hypothesis,
          '[' || coalesce(array_to_string(regexp_extract_all(premise, '\S+')[1:15], ', '), '') || ']'
            || CASE WHEN len(regexp_extract_all(premise, '\S+')) > 15 THEN '...' ELSE '' END AS words
        FROM pairs_long"""),
    "format_predictions": _with_views("""SELECT example_id,
          ['✅', '🤔', '❌'][predicted_label + 1] || ' **' || ['Entailment', 'Neutral', 'Contradiction'][predicted_label + 1]
          || '** (' || format('{:.1f}', confidence * 100) || '% confidence)' AS shown FROM preds"""),
    "confidence_long": _with_views("""SELECT example_id, n.name AS label,
          round(CASE n.id WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END * 100, 6) AS confidence FROM preds, names n"""),
    "enrich_errors": _with_views("""SELECT example_id, language, language_name, family, script, morphology, word_order
        FROM errors"""),
    "align_languages": _with_views("""SELECT id, max(CASE WHEN lang = 'de' THEN premise END) AS de,
          max(CASE WHEN lang = 'en' THEN premise END) AS en, max(CASE WHEN lang = 'es' THEN premise END) AS es,
          max(CASE WHEN lang = 'fr' THEN premise END) AS fr FROM aligned GROUP BY id"""),
    "pairs_from_turns": _with_views("SELECT conv_id, turn, premise, hypothesis FROM turns"),
    "compare_models": _with_views("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE a = b) AS agree,
          count(*) FILTER (WHERE a = g AND b = g) AS both_right, count(*) FILTER (WHERE a = g AND b <> g) AS only_a,
          count(*) FILTER (WHERE a <> g AND b = g) AS only_b,
          round(count(*) FILTER (WHERE a = b) / CAST(count(*) AS DOUBLE), 6) AS agreement,
          round((count(*) FILTER (WHERE b = g) - count(*) FILTER (WHERE a = g)) / CAST(count(*) AS DOUBLE), 6)
            AS accuracy_delta, 0 AS missing_a, 0 AS missing_b
        FROM (SELECT lang, gold_label AS g,
                CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS a,
                CASE WHEN m0 >= m1 AND m0 >= m2 THEN 0 WHEN m1 >= m2 THEN 1 ELSE 2 END AS b FROM logits) t
        GROUP BY lang"""),
    "accuracy": _with_views("""SELECT count(*) AS n, count(*) FILTER (WHERE predicted_label = gold_label) AS correct,
          round(avg(CASE WHEN predicted_label = gold_label THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM preds"""),
    "zero_shot_eval": _with_views("""SELECT CAST(position AS BIGINT) AS position, lang, n, correct,
          round(accuracy, 6) AS accuracy, round(gap, 6) AS gap FROM gaps"""),
    "zero_shot_report": _with_views("""SELECT CAST(position AS BIGINT) AS position, lang AS language,
          round(accuracy, 6) AS accuracy, round(gap, 6) AS gap FROM gaps
        UNION ALL SELECT 8, 'Average', round(avg(accuracy), 6), NULL FROM gaps"""),
    "macro_average": _with_views("""SELECT count(accuracy) AS languages, round(avg(accuracy), 6) AS macro_accuracy
        FROM by_lang"""),
    "confusion_by_language": _with_views("""SELECT lang, CAST(g.id AS BIGINT) AS gold_label,
          CAST(q.id AS BIGINT) AS predicted_label,
          count(*) FILTER (WHERE gold_label = g.id AND predicted_label = q.id) AS n
        FROM preds, names g, names q GROUP BY ALL"""),
    "macro_prf": _with_views(f"""SELECT lang, round(avg(coalesce(tp / CAST(nullif(np, 0) AS DOUBLE), 0)), 6) AS macro_precision,
          round(avg(coalesce(tp / CAST(nullif(ng, 0) AS DOUBLE), 0)), 6) AS macro_recall,
          round(avg(coalesce(2 * tp / CAST(nullif(np + ng, 0) AS DOUBLE), 0)), 6) AS macro_f1
        FROM ({PRF_PARTS}) t GROUP BY lang"""),
    "typology_gap": _with_views("""SELECT feature, value, count(*) AS languages, round(avg(accuracy), 6) AS avg_accuracy,
          round(avg(gap), 6) AS avg_gap
        FROM (SELECT accuracy, gap, 'family' AS feature, family AS value FROM gaps JOIN lang_dim ON lang = language
              UNION ALL SELECT accuracy, gap, 'script', script FROM gaps JOIN lang_dim ON lang = language
              UNION ALL SELECT accuracy, gap, 'morphology', morphology FROM gaps JOIN lang_dim ON lang = language
              UNION ALL SELECT accuracy, gap, 'word_order', word_order FROM gaps JOIN lang_dim ON lang = language) t
        WHERE accuracy IS NOT NULL GROUP BY ALL"""),
    "typology_corr": _with_views("""SELECT count(*) AS languages, round(corr(level, gap), 6) AS morphology_gap_corr
        FROM gaps JOIN (SELECT language, CASE morphology WHEN 'Low' THEN 1e0 WHEN 'Medium' THEN 2e0 ELSE 3e0 END AS level
                        FROM lang_dim UNION ALL SELECT 'fr', 2e0 UNION ALL SELECT 'es', 3e0) d ON lang = language
        WHERE gap IS NOT NULL"""),
    "error_records": _with_views(f"SELECT {FLAT_RECORD} FROM errors WHERE id <= 15"),
    "union_language_errors": _with_views("""SELECT id, language, gold_name AS gold_label, predicted_name AS predicted_label,
          round(confidence, 6) AS confidence FROM errors WHERE id <= 15"""),
    "rows_checked": _with_views("""SELECT lang, count(*) AS checked, CAST(sum(wrong) AS BIGINT) AS errors
        FROM (SELECT lang, wrong, sum(wrong) OVER (PARTITION BY lang ORDER BY example_id) AS run
              FROM (SELECT lang, example_id, CASE WHEN predicted_label <> gold_label THEN 1 ELSE 0 END AS wrong
                    FROM preds WHERE premise <> '' AND hypothesis <> '') a) b
        WHERE run - wrong < 15 GROUP BY lang"""),
    "errors_by_language": _with_views("""SELECT language_name, count(*) AS count, round(avg(confidence), 6) AS avg_confidence
        FROM errors WHERE language_name IS NOT NULL GROUP BY 1"""),
    "errors_by_script": _with_views("""SELECT script, count(*) AS count FROM errors WHERE script IS NOT NULL GROUP BY 1"""),
    "errors_by_morphology": _with_views("""SELECT morphology, count(*) AS count FROM errors
        WHERE morphology IS NOT NULL GROUP BY 1"""),
    "error_summary_sets": _with_views("""SELECT dimension, value, count(*) AS count, round(avg(confidence), 6) AS avg_confidence
        FROM (SELECT 'language_name' AS dimension, language_name AS value, confidence FROM errors
              UNION ALL SELECT 'family', family, confidence FROM errors
              UNION ALL SELECT 'script', script, confidence FROM errors
              UNION ALL SELECT 'morphology', morphology, confidence FROM errors
              UNION ALL SELECT 'word_order', word_order, confidence FROM errors
              UNION ALL SELECT 'total', 'all', confidence FROM errors) t
        WHERE value IS NOT NULL GROUP BY ALL"""),
    "error_confusion": _with_views("""SELECT gold_name AS gold_label,
          count(*) FILTER (WHERE predicted_name = 'entailment') AS entailment,
          count(*) FILTER (WHERE predicted_name = 'neutral') AS neutral,
          count(*) FILTER (WHERE predicted_name = 'contradiction') AS contradiction FROM errors GROUP BY 1"""),
    "category_distribution": _with_views(f"""SELECT a.code, a.count, round(a.count * 100e0 / t.total, 6) AS pct,
          round(a.count * 100e0 / t.known, 6) AS pct_of_annotated, coalesce(c.description, 'Unknown') AS description
        FROM (SELECT error_category AS code, count(*) AS count FROM annotated WHERE error_category IS NOT NULL GROUP BY 1) a
        CROSS JOIN (SELECT count(*) AS total, count(error_category) AS known FROM annotated) t
        LEFT JOIN {CATEGORIES} ON c.code = a.code"""),
    "category_by_language": _crosstab("language_name"),
    "category_by_script": _crosstab("script"),
    "suggest_category": _with_views("""SELECT example_id, language,
          CASE WHEN overlap >= 0.5 AND predicted_name = 'entailment' THEN 'E1' WHEN nega <> negb THEN 'E2'
               WHEN ratio > mean_ratio THEN 'E3' WHEN morphology = 'High' THEN 'E4' WHEN word_order <> 'SVO' THEN 'E5'
          END AS suggested_category FROM flags""", SUGGEST),
    "label_distribution": _with_views(f"SELECT split, label, name, count, round(pct, 6) AS pct FROM ({LABEL_COUNTS}) t"),
    "label_balance": _with_views(f"SELECT split, round(max(pct) - min(pct), 6) AS pct_spread FROM ({LABEL_COUNTS}) t GROUP BY 1"),
    "char_script_counts": r"""SELECT lang, ch, count(*) AS n
        FROM (SELECT lang, unnest(regexp_extract_all(text, '\p{L}')) AS ch FROM documents) t GROUP BY 1, 2""",
    "script_histogram": SCRIPT_COUNTS,
    "top_scripts": f"""SELECT * FROM (SELECT lang, script, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, script)
        AS rank FROM ({SCRIPT_COUNTS}) t) r WHERE rank <= 3""",
    "token_word_ratio": r"""SELECT doc_id, tokens, words, round(tokens / CAST(nullif(words, 0) AS DOUBLE), 6) AS ratio
        FROM (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\s]')) AS tokens,
                     len(regexp_extract_all(text, '\S+')) AS words FROM documents) t""",
    "token_word_ratio_by_language": r"""SELECT lang, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(w) AS BIGINT) AS words,
          round(sum(t) / CAST(sum(w) AS DOUBLE), 6) AS ratio
        FROM (SELECT lang, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\s]')) AS t,
                     len(regexp_extract_all(text, '\S+')) AS w FROM documents) x GROUP BY lang""",
    "text_length_stats": """SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS avg_chars,
          quantile_disc(length(text), 0.5) AS p50_chars, quantile_disc(length(text), 0.95) AS p95_chars,
          max(length(text)) AS max_chars FROM documents GROUP BY lang""",
    "sample_rows": """SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank, doc_id, text
        FROM documents) t WHERE rank <= 100""",
    "first_rows": "SELECT doc_id, lang, text FROM documents ORDER BY doc_id LIMIT 3",
    "feature_types": """SELECT CAST(0 AS BIGINT) AS position, 'doc_id' AS "column", 'bigint' AS type, count(doc_id) AS filled
        FROM labels UNION ALL SELECT 1, 'quality', 'int', count(quality) FROM labels
        UNION ALL SELECT 2, 'toxic', 'int', count(toxic) FROM labels""",
    "epoch_loss": """SELECT CAST(day(ts) AS BIGINT) AS epoch, count(*) AS steps, round(avg(value), 6) AS avg_loss
        FROM events GROUP BY 1""",
    "best_epoch": _with_views("""SELECT epoch, round(val_accuracy, 6) AS val_accuracy, round(best, 6) AS best_before,
          val_accuracy > best AS is_best
        FROM (SELECT *, greatest(0e0, coalesce(max(val_accuracy) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING
              AND 1 PRECEDING), 0e0)) AS best FROM epochs) t"""),
    "assign_batches": """SELECT doc_id AS example_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index,
        (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM documents""",
    "assign_batches_shuffled": """SELECT batch_id, count(*) AS n, min(row) AS first_row,
          (SELECT count(DISTINCT doc_id) FROM documents) AS ids, (SELECT CAST(sum(doc_id) AS BIGINT) FROM documents) AS id_sum
        FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, row // 16 AS batch_id FROM documents) t GROUP BY 1""",
    "number_rows_by_language": """SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS row_index
        FROM documents""",
    "fit_vocab": rf"""SELECT * FROM (SELECT row_number() OVER (ORDER BY count(*) DESC, word) + 3 AS token_id, word,
          count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}]+|[^\s]')) AS word
          FROM documents) t GROUP BY word) v WHERE token_id < {VOCABULARY_SIZE} + 4""",
    "encode_pairs": _encoding(PAIR_SOURCE, "example_id", 128, "max_length"),
    "encode_nopad": _encoding(PAIR_SOURCE, "example_id", 128, "none"),
    "encode_longest": _encoding(
        PAIR_SOURCE, "example_id", 128, "longest", "(row_number() OVER (ORDER BY example_id) - 1) // 16"
    ),
    "encode_longest_all": _encoding(PAIR_SOURCE, "example_id", 4096, "longest"),
    "encode_paraphrase": _encoding(PARAPHRASE_SOURCE, "id", 128, "max_length"),
    "softmax_probs": _with_views("""SELECT example_id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM soft"""),
    "argmax_label": _with_views("""SELECT example_id, CAST(predicted_label AS BIGINT) AS predicted_label,
          round(confidence, 6) AS confidence FROM preds"""),
    "score_pairs": _with_views(SCORED),
    "score_callable": _with_views(f"""SELECT conv_id, turn, CASE WHEN status = 'ok' THEN predicted_name END AS predicted_name,
          CASE WHEN status = 'ok' THEN round(confidence, 6) END AS confidence, status
        FROM (SELECT conv_id, turn, CASE WHEN a = '' THEN 'missing_premise' WHEN b = '' THEN 'missing_hypothesis'
                     ELSE 'ok' END AS status,
                CASE WHEN l0 >= l1 AND l0 >= l2 THEN 'entailment' WHEN l1 >= l2 THEN 'neutral' ELSE 'contradiction' END
                  AS predicted_name,
                1 / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2)))
                  AS confidence
              FROM (SELECT *, (length(a) % 7) / 2e0 AS l0, (length(b) % 5) / 2e0 AS l1,
                           ((length(a) + length(b)) % 6) / 2e0 AS l2
                    FROM (SELECT conv_id, turn, trim(premise, {WHITESPACE}) AS a, trim(hypothesis, {WHITESPACE}) AS b
                          FROM turns) s) t) u"""),
    "stream_score_pairs": _with_views(SCORED),
    "stream_accuracy": _with_views("""SELECT lang, count(*) AS n,
          count(*) FILTER (WHERE predicted_label = gold_label) AS correct,
          round(avg(CASE WHEN predicted_label = gold_label THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM preds GROUP BY lang"""),
}

ORACLES |= {
    "error_total": _with_views("SELECT count(*) AS errors FROM errors"),
    "category_ranked": _with_views("""SELECT code, count, row_number() OVER (ORDER BY count DESC, code) AS rank
        FROM (SELECT error_category AS code, count(*) AS count FROM annotated WHERE error_category IS NOT NULL GROUP BY 1) t"""),
    "errors_by_language_ranked": _with_views("""SELECT language_name, count, row_number() OVER (ORDER BY language_name) AS rank
        FROM (SELECT language_name, count(*) AS count FROM errors WHERE language_name IS NOT NULL GROUP BY 1) t"""),
    "category_unlisted": _with_views("""SELECT language, count(*) FILTER (WHERE error_category = 'E1') AS "E1",
          count(*) FILTER (WHERE error_category = 'E2') AS "E2",
          count(*) FILTER (WHERE error_category NOT IN ('E1', 'E2')) AS other
        FROM annotated WHERE error_category IS NOT NULL GROUP BY language"""),
    "char_scripts_shifted": """SELECT lang, ch, count(*) AS n FROM (
          SELECT lang, unnest(string_split(translate(text, 'abcdefghijklmnopqrstuvwxyz', s), '')) AS ch, s FROM documents,
            (SELECT 'абвгдежзийклмαβγδεζηθ猫犬鳥' || chr(201552) || chr(191472) AS s) o) t
        WHERE contains(s, ch) AND ch <> '' GROUP BY 1, 2""",
    "number_rows_null_key": """SELECT doc_id, k AS lang, row_number() OVER (PARTITION BY k ORDER BY doc_id) - 1 AS row_index
        FROM (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN lang END AS k FROM documents) t""",
    "first_n_large": """SELECT doc_id, k AS lang, rank, md5(text) AS text FROM (
          SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS rank
          FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 > 0 THEN lang END AS k FROM documents) t) r WHERE rank <= 5000""",
    "fit_vocab_all": r"""SELECT row_number() OVER (ORDER BY count(*) DESC, word) + 3 AS token_id, word, count(*) AS n
        FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\s]')) AS word FROM documents) t GROUP BY word""",
    "encode_tokens_256": _encoding(PAIR_SOURCE, "example_id", 256, "max_length"),
    "encode_single": _with_views(r"""SELECT doc_id AS example_id, CAST(128 AS BIGINT) AS n_ids, CAST(n + 2 AS BIGINT) AS n_real,
          concat_ws(' ', '0', ids, '2') || repeat(' 1', CAST(126 - n AS BIGINT)) AS input_ids, CAST(0 AS BIGINT) AS labels
        FROM (SELECT doc_id, count(w) AS n, string_agg(CAST(coalesce(v.token_id, 3) AS VARCHAR), ' ' ORDER BY pos) AS ids
              FROM (SELECT doc_id, unnest(t[1:126]) AS w, unnest(range(1, len(t[1:126]) + 1)) AS pos
                    FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\s]') AS t FROM documents) a) b
              LEFT JOIN vocab v ON v.word = b.w GROUP BY doc_id) c"""),
    "predict_single": """SELECT doc_id AS example_id, 'ok' AS status,
          CASE WHEN a >= b AND a >= c THEN 'entailment' WHEN b >= c THEN 'neutral' ELSE 'contradiction' END AS predicted_name,
          round(1 / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))), 6) AS confidence
        FROM (SELECT doc_id, (length(text) % 7) / 2e0 AS a, (length(text) % 5) / 2e0 AS b, (length(text) % 3) / 2e0 AS c
              FROM documents) t""",
    "compare_models_failed": _with_views("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE a = b) AS agree,
          count(*) FILTER (WHERE a = g AND b IS NOT DISTINCT FROM g) AS both_right,
          count(*) FILTER (WHERE a = g AND b IS DISTINCT FROM g) AS only_a, count(*) FILTER (WHERE a <> g AND b = g) AS only_b,
          0 AS missing_a, count(*) FILTER (WHERE b IS NULL) AS missing_b,
          round(count(*) FILTER (WHERE a = b) / CAST(count(*) AS DOUBLE), 6) AS agreement,
          round((count(*) FILTER (WHERE b = g) - count(*) FILTER (WHERE a = g)) / CAST(count(*) AS DOUBLE), 6) AS accuracy_delta
        FROM (SELECT lang, gold_label AS g,
                CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS a,
                CASE WHEN example_id % 7 = 0 OR example_id % 5 = 0 THEN NULL
                     WHEN m0 >= m1 AND m0 >= m2 THEN 0 WHEN m1 >= m2 THEN 1 ELSE 2 END AS b FROM logits) t GROUP BY lang"""),
    "model_roundtrip": _with_views("""SELECT lang, count(*) AS n, count(*) AS same FROM pairs_long
        WHERE split = 'validation' GROUP BY lang"""),
    "score_latency": _with_views("SELECT lang, count(*) AS n, true AS positive, true AS ordered FROM pairs_long GROUP BY lang"),
    "zero_shot_transfer": _with_views("""SELECT lang, count(*) AS n, true AS counted, true AS divided, true AS compared
        FROM pairs_long WHERE split = 'validation' GROUP BY lang"""),
    "zero_shot_epochs": _with_views("""SELECT epoch, lang, count(*) AS n, true AS counted, true AS divided, true AS ruled
        FROM pairs_long, (SELECT unnest([1, 2, 3]) AS epoch) e WHERE split = 'validation' GROUP BY ALL"""),
    "select_lang_plain": _with_views(_texts("example_id", "premise", "hypothesis", "pairs_long")),
    "catalog_open": _with_views("""SELECT lang, split, count(*) AS n, CAST(sum(length(premise)) AS BIGINT) AS chars
        FROM pairs_long WHERE lang IN ('de', 'fr') GROUP BY ALL"""),
}

_DECODED = r"""SELECT example_id, string_agg(tok, ' ' ORDER BY pos) AS tokens FROM (
    SELECT t.example_id, t.pos, CASE t.id WHEN 0 THEN '<s>' WHEN 1 THEN '<pad>' WHEN 2 THEN '</s>' WHEN 3 THEN '<unk>'
           ELSE v.word END AS tok
    FROM (SELECT example_id, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS pos
          FROM (SELECT example_id, CAST(string_split(input_ids, ' ') AS INTEGER[]) AS ids FROM ({encoded}) e) s) t
    LEFT JOIN vocab v ON v.token_id = t.id) x GROUP BY example_id"""
ORACLES["decode_ids"] = _with_views(_DECODED.replace("{encoded}", ORACLES["encode_pairs"]))
ORACLES["error_records_progressive"] = ORACLES["error_records"]
ORACLES["rows_checked_progressive"] = ORACLES["rows_checked"]
ORACLES["encode_shuffled"] = ORACLES["encode_pairs"]
ORACLES["stream_accuracy_versions"] = ORACLES["stream_accuracy"]
