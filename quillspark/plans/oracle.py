"""DuckDB SQL with the results of the registered queries, from the same fixed values."""

from __future__ import annotations

import re

import numpy as np

from ..functions.fixed_values import ABBREVIATION_SIGNS, ABBREVIATIONS, CANDIDATE_OPTIONS, CORRECTION_LEXICON, CURVE_DECAY, CURVE_FALL, CURVE_FLOOR, CURVE_LEAST, CURVE_NOISE, CURVE_PLATEAU, CURVE_START, FUNCTION_WORDS, KRAKEN_DRAWS, PAGE_CREATOR, PAGE_NAMESPACE, PALETTE, PIXELS_PER_WORD, SIMULATED_WORDS, TROCR_DRAWS, TEI_NAMESPACE, TEI_PUBLICATION, TEI_SOURCE, TEI_TAGS, TILDES, VERBS
from ..functions.sequences import LABEL_IDS
from ..operators.evaluation import POISSON
from .derive import CORPUS_LEXICON, CORPUS_VERBS, CORPUS_WORDS

#: DuckDB's levenshtein counts bytes: letters beyond ASCII become control characters first.
LETTERS = "éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍõ⁊ꝑꝗꝓẜꝫ"
CONTROLS = [*range(1, 9), 11, 12, *range(14, 32), 127][: len(LETTERS)]


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def replaced(x: str, table: dict[str, str]) -> str:
    for a, b in table.items():
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


def single(x: str) -> str:
    return f"translate({x}, {quoted(LETTERS)}, {' || '.join(f'chr({c})' for c in CONTROLS)})"


def lev(a: str, b: str) -> str:
    return f"CAST(levenshtein({single(a)}, {single(b)}) AS BIGINT)"


def normal(x: str) -> str:
    x = f"translate({replaced(replaced(x, ABBREVIATIONS), TILDES)}, 'jJ', 'iI')"
    x = rf"regexp_replace({x}, '(^| )v([^ aeiouAEIOU])', '\1u\2', 'g')"
    return rf"regexp_replace({x}, '(^| )V([^ aeiouAEIOU])', '\1U\2', 'g')"


def words_in(words) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


LINES = """
texts AS (
  SELECT doc_id, lang, source, unnest(range(len(a))) AS ln, unnest(a) AS x FROM (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), chunks AS (
  SELECT doc_id, lang, source, ln, w, unnest(range(0, len(w), 40)) AS s FROM (SELECT doc_id, lang, source, ln, string_split(x, ' ') AS w FROM texts)
), lines AS (
  SELECT doc_id, lang, source, CAST(ln * 1000000 + s // 40 AS BIGINT) AS pos, array_to_string(list_slice(w, s + 1, s + 40), ' ') AS line FROM chunks
)"""
VERSIONS = f"""{LINES}, raws AS (
  SELECT *, replace(replace(replace(replace(line, ' un', ' vn'), 'que', 'q~'), 'on', 'õ'), 'et', '⁊') AS raw FROM lines
), versions AS (
  SELECT *, {normal("raw")} AS norm FROM raws
)"""


def percents(n: str) -> str:
    return f"list_transform(range(1, {n} + 1), lambda k: (doc_id * 31 + pos * 17 + k * 7) % 61 + 40)"


CONTRACT = f"""{VERSIONS}, contract AS (
  SELECT *, {percents("length(raw)")} AS percent, CAST(length(raw) AS BIGINT) AS n FROM versions
), judged AS (
  SELECT *, coalesce(list_sum(percent), 0)::BIGINT AS total, CASE WHEN n = 0 THEN true ELSE list_reduce(list_transform(percent, lambda p: p::DOUBLE / 100), lambda a, x: a + x) / n < 0.7::DOUBLE END AS needs_review, CASE WHEN n = 0 THEN 0.0 ELSE format('{{:.4f}}', list_reduce(list_transform(percent, lambda p: p::DOUBLE / 100), lambda a, x: a + x) / n)::DOUBLE END AS confidence, pos // 1000000 * 10000 + pos % 1000000 AS reading_order FROM contract
)"""

SIGNS = "length({0}) - length(translate({0}, " + quoted(ABBREVIATION_SIGNS) + ", ''))"


def type_of(word: str) -> str:
    """Corpus entity type of a cleaned word."""
    cases = " ".join(f"WHEN {word} IN {words_in(getattr(CORPUS_LEXICON, t))} THEN '{t}'" for t in ("PER", "LOC", "TITLE", "ORG", "DATE"))
    return f"CASE {cases} WHEN regexp_matches({word}, '^[0-9]+$') THEN 'DATE' END"


TOKENS = f"""{LINES}, split AS (
  SELECT doc_id, lang, pos, list_filter(string_split(line, ' '), lambda x: x <> '') AS words FROM lines
), tokens AS (
  SELECT doc_id, lang, pos, unnest(range(len(words))) AS tok_pos, unnest(words) AS word FROM split
), typed AS (
  SELECT *, trim(lower(word), '.,;:!?') AS low, {type_of("trim(lower(word), '.,;:!?')")} AS type FROM tokens
), labelled AS (
  SELECT *, CASE WHEN type IS NULL THEN 'O' WHEN type = lag(type) OVER w THEN 'I-' || type ELSE 'B-' || type END AS label FROM typed WINDOW w AS (PARTITION BY doc_id, pos ORDER BY tok_pos)
)"""
ENTITIES = f"""{TOKENS}, islands AS (
  SELECT *, max(CASE WHEN label NOT LIKE 'I-%' THEN tok_pos END) OVER (PARTITION BY doc_id, pos ORDER BY tok_pos) AS island FROM labelled
), entity AS (
  SELECT doc_id, lang, pos, island, string_agg(word, ' ' ORDER BY tok_pos) AS texte, min(substr(label, 3)) FILTER (tok_pos = island) AS type FROM islands WHERE label <> 'O' GROUP BY doc_id, lang, pos, island
)"""
RELATIONS = f"""{TOKENS}, around AS (
  SELECT *, last_value(CASE WHEN label <> 'O' THEN word END IGNORE NULLS) OVER b AS source, last_value(type IGNORE NULLS) OVER b AS type_source,
    first_value(CASE WHEN label <> 'O' THEN word END IGNORE NULLS) OVER a AS cible, first_value(type IGNORE NULLS) OVER a AS type_cible
  FROM labelled WINDOW b AS (PARTITION BY doc_id, pos ORDER BY tok_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY doc_id, pos ORDER BY tok_pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), relation AS (
  SELECT doc_id, pos, CAST(tok_pos AS BIGINT) AS ord, source, type_source, CASE {" ".join(f"WHEN low = {quoted(k)} THEN {quoted(v)}" for k, v in CORPUS_VERBS.items())} END AS relation, cible, type_cible FROM around
  WHERE low IN {words_in(CORPUS_VERBS)} AND source IS NOT NULL AND cible IS NOT NULL
), mentions AS (
  SELECT source AS name, type_source AS type, doc_id, pos, ord, 0 AS side FROM relation UNION ALL SELECT cible, type_cible, doc_id, pos, ord, 1 FROM relation
), nodes AS (
  SELECT name, type FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id DESC, pos DESC, ord DESC, side DESC) AS r FROM mentions) WHERE r = 1
), edges AS (
  SELECT source, cible, relation FROM (SELECT *, row_number() OVER (PARTITION BY source, cible ORDER BY doc_id DESC, pos DESC, ord DESC) AS r FROM relation) WHERE r = 1
)"""


def escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


TEI = f"""{ENTITIES}, pieces AS (
  SELECT doc_id, pos, tok_pos AS place, {escaped("word")} || ' ' AS piece FROM labelled WHERE label = 'O'
  UNION ALL SELECT doc_id, pos, island, '<' || t || '>' || {escaped("texte")} || '</' || t || '> ' FROM (SELECT *, CASE {" ".join(f"WHEN type = '{k}' THEN '{v}'" for k, v in TEI_TAGS.items())} ELSE 'name' END AS t FROM entity)
), tei AS (
  SELECT l.doc_id, l.pos, coalesce(string_agg(piece, '' ORDER BY place), '') AS tei FROM lines l LEFT JOIN pieces p ON l.doc_id = p.doc_id AND l.pos = p.pos GROUP BY l.doc_id, l.pos
)"""
SPLIT = """ranked AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY coalesce(lang, 'inconnu') ORDER BY md5('42:' || doc_id), doc_id::VARCHAR) AS r, count(*) OVER (PARTITION BY coalesce(lang, 'inconnu')) AS n FROM documents
), parts AS (
  SELECT doc_id, lang, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ranked
)"""
ERRORS = f"""{VERSIONS}, errors AS (
  SELECT doc_id, pos, lang, source, line, raw, norm, {lev("line", "raw")} AS dist, CAST(length(line) AS BIGINT) AS chars FROM versions
)"""


def hex_int(h: str, at: int, n: int) -> str:
    return f"('0x' || substr({h}, {at}, {n}))::BIGINT"


DRAWS = f"""{ERRORS}, indexed AS (
  SELECT dist, chars, row_number() OVER (ORDER BY substr(md5(doc_id || ':' || pos), 1, 2), doc_id, pos) - 1 AS idx FROM errors
), draws AS (
  SELECT it, {hex_int("md5(it || ':' || slot || ':42')", 1, 12)} % (SELECT count(*) FROM indexed) AS idx FROM (SELECT unnest(range(1000)) AS it), (SELECT idx AS slot FROM indexed)
), replicates AS (
  SELECT it AS iteration, sum(dist)::DOUBLE / sum(chars) AS cer FROM draws JOIN indexed USING (idx) GROUP BY it
)"""
RASTER = """numbered AS (
  SELECT doc_id, pos // 1000000 AS p, max(length(line)) AS n FROM lines GROUP BY 1, 2
), band AS (
  SELECT doc_id, p, p * 18 + 4 AS a, p * 18 + CASE WHEN p % 7 = 6 THEN 12 ELSE 16 END AS b, p % 5 AS x0, least(47, 10 + n % 40) AS x1, (max(p) OVER (PARTITION BY doc_id) + 1) * 18 AS height FROM numbered
)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


PAGE_LINE = """'      <TextLine id="line_' || reading_order || '">' || chr(10) || '        <Coords points="0,0 100,0 100,30 0,30"/>' || chr(10) || '        <TextEquiv>' || chr(10) || '          <Unicode>' || {0} || '</Unicode>' || chr(10) || '        </TextEquiv>' || chr(10) || '      </TextLine>' || chr(10)""".format(escaped("raw"))
PAGE = f"""{CONTRACT}, files AS (
  SELECT 'd' || doc_id || '.xml' AS path, '<?xml version="1.0" ?>' || chr(10) || '<PcGts xmlns="{PAGE_NAMESPACE}">' || chr(10) || '  <Metadata>' || chr(10) || '    <Creator>{PAGE_CREATOR}</Creator>' || chr(10) || '    <Created>2024-01-01T00:00:00</Created>' || chr(10)
    || '    <LastChange>2024-01-01T00:00:00</LastChange>' || chr(10) || '  </Metadata>' || chr(10) || '  <Page imageFilename="d' || doc_id || '.png" imageWidth="1000" imageHeight="1500">' || chr(10) || '    <TextRegion id="region_0">' || chr(10)
    || '      <Coords points="0,0 1000,0 1000,1500 0,1500"/>' || chr(10) || string_agg({PAGE_LINE}, '' ORDER BY reading_order, format('d_{{:03d}}', reading_order), pos) || '    </TextRegion>' || chr(10) || '  </Page>' || chr(10) || '</PcGts>' || chr(10) AS content
  FROM judged GROUP BY doc_id
)"""


POISSON_DRAW = "substr(md5((it // 5) || ':' || doc_id || ':' || pos || ':42'), CAST(6 * (it % 5) + 1 AS BIGINT), 6)"


def thousandths(seed: int, share: int, high: tuple[int, int], low: tuple[int, int]) -> str:
    h = f"md5(doc_id || ':' || i || ':{seed}')"
    pick = lambda s: f"{s[0]} + {hex_int(h, 9, 8)} % {s[1] - s[0] + 1}"
    return f"list_transform(range(length(text)), lambda i: CASE WHEN {hex_int(h, 1, 8)} % 100 < {share} THEN {pick(high)} ELSE {pick(low)} END)"


_cycle = "[" + ", ".join(map(quoted, SIMULATED_WORDS)) + "]"
_pos = " ".join(f"WHEN low = {quoted(k)} THEN {quoted(p)}" for k, (p, _) in FUNCTION_WORDS.items())
_lemma = " ".join(f"WHEN low = {quoted(k)} THEN {quoted(v)}" for k, v in ({k: l for k, (_, l) in FUNCTION_WORDS.items()} | {k: v for k, v in VERBS.items() if k not in FUNCTION_WORDS}).items())
_upper = r"regexp_matches(word, '^\p{Lu}')"
_lemma_of = f"CASE {_lemma} WHEN {_upper} THEN low WHEN length(low) > 3 THEN rtrim(low, 's') ELSE low END"


def _fits(option: str) -> str:
    t = f"(substr(line, 1, p) || '{option}' || substr(line, p + 2))"
    return f"lower(regexp_extract(substr({t}, 1, p), '[^ ]*$') || regexp_extract(substr({t}, p + 1), '^[^ ]*')) IN {words_in(CORPUS_WORDS)}"


_points = "list_transform(range(8), lambda i: [CAST(floor(abs(embedding[2 * i + 1]::DOUBLE) * 1000) AS BIGINT), CAST(floor(abs(embedding[2 * i + 2]::DOUBLE) * 1000) AS BIGINT)])"
_colours = "[" + ", ".join(quoted(",".join(map(str, c))) for c in PALETTE) + "]"
_label_ids = " ".join(f"WHEN labels[i] = '{k}' THEN {v}" for k, v in LABEL_IDS.items())

SQL: dict[str, str] = {
    "lines_flatten": with_(LINES, "SELECT doc_id, lang, pos, line, CAST(length(line) AS BIGINT) AS n_chars FROM lines"),
    "normalize_rules": with_(VERSIONS, "SELECT doc_id, pos, raw, norm FROM versions"),
    "nfc_roundtrip": with_(
        f"{LINES}, apart AS (SELECT doc_id, pos, replace(replace(replace(replace(line, 'é', 'e' || chr(769)), 'ó', 'o' || chr(769)), 'ñ', 'n' || chr(771)), 'ü', 'u' || chr(776)) AS a FROM lines)",
        "SELECT doc_id, pos, CAST(length(a) AS BIGINT) AS n_apart, nfc_normalize(a) AS composed FROM apart",
    ),
    "abbreviations_by_source": with_(VERSIONS, f"SELECT source, CAST(sum({SIGNS.format('raw')}) AS BIGINT) AS raw_signs, CAST(sum({SIGNS.format('norm')}) AS BIGINT) AS left_signs, count(*) AS n_lines FROM versions GROUP BY source"),
    "lexicon_correct": with_(
        f"{LINES}, placed AS (SELECT *, CAST((doc_id * 13 + pos * 5) % length(line) AS BIGINT) AS p FROM lines WHERE length(line) > 0), seen AS (SELECT *, (doc_id * 31 + pos * 17 + (p + 1) * 7) % 61 + 40 AS c FROM placed)",
        "SELECT doc_id, pos, CASE WHEN c >= 70 THEN line " + " ".join(f"WHEN {_fits(o)} THEN substr(line, 1, p) || '{o}' || substr(line, p + 2)" for o in "eao") + " ELSE line END AS corrected FROM seen",
    ),
    "cer_line": with_(VERSIONS, f"SELECT doc_id, pos, {lev('line', 'raw')} AS dist_raw, {lev('line', 'norm')} AS dist_norm, CAST(length(line) AS BIGINT) AS chars FROM versions"),
    "cer_by_stage": with_(
        f"{VERSIONS}, staged AS (SELECT lang, line, 'brut' AS stage, raw AS t FROM versions UNION ALL SELECT lang, line, 'regles', norm FROM versions)",
        f"SELECT lang, stage, CAST(sum({lev('line', 't')}) AS BIGINT) AS dist, CAST(sum(length(line)) AS BIGINT) AS chars, count(*) AS n_lines, CASE WHEN sum(length(line)) > 0 THEN sum({lev('line', 't')})::DOUBLE / sum(length(line)) ELSE 0.0 END AS cer FROM staged GROUP BY lang, stage",
    ),
    "cer_rollup": with_(
        ERRORS,
        "SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, CAST(2 - grouping(lang) - grouping(source) AS INT) AS level, CAST(sum(dist) AS BIGINT) AS dist, CAST(sum(chars) AS BIGINT) AS chars, CASE WHEN sum(chars) > 0 THEN sum(dist)::DOUBLE / sum(chars) ELSE 0.0 END AS cer FROM errors GROUP BY ROLLUP (lang, source)",
    ),
    "wer_by_lang": with_(
        f"""{VERSIONS}, pairs AS (
  SELECT lang, list_filter(string_split(line, ' '), lambda x: x <> '') AS a, list_filter(string_split(raw, ' '), lambda x: x <> '') AS b FROM versions
), coded AS (
  SELECT lang, a, array_to_string(list_transform(a, lambda w: chr(CAST(list_position(v, w) AS INT))), '') AS x, array_to_string(list_transform(b, lambda w: chr(CAST(list_position(v, w) AS INT))), '') AS y FROM (SELECT *, list_distinct(list_concat(a, b)) AS v FROM pairs)
)""",
        "SELECT lang, CAST(sum(levenshtein(x, y)) AS BIGINT) AS word_dist, CAST(sum(len(a)) AS BIGINT) AS words, CASE WHEN sum(len(a)) > 0 THEN sum(levenshtein(x, y))::DOUBLE / sum(len(a)) ELSE 0.0 END AS wer FROM coded GROUP BY lang",
    ),
    "stage_transitions": with_(
        f"{VERSIONS}, steps AS (SELECT 'modele→brut' AS transition, line AS a, raw AS b FROM versions UNION ALL SELECT 'brut→regles', raw, norm FROM versions), d AS (SELECT transition, a, b, {lev('a', 'b')} AS dist FROM steps)",
        "SELECT transition, round(avg(CASE WHEN length(a) = 0 THEN CASE WHEN length(b) = 0 THEN 0.0 ELSE 1.0 END ELSE dist::DOUBLE / length(a) END), 9) AS mean_distance, CAST(sum(dist) AS BIGINT) AS dist, count(*) FILTER (dist > 0) AS n_changed, count(*) AS n_lines FROM d GROUP BY transition",
    ),
    "bootstrap_replicates": with_(DRAWS, "SELECT iteration, round(cer, 10) AS cer FROM replicates"),
    "bootstrap_ci": with_(DRAWS, "SELECT round(quantile_cont(cer, 0.025), 9) AS low, round(quantile_cont(cer, 0.975), 9) AS high FROM replicates"),
    "poisson_bootstrap": with_(
        f"{ERRORS}, drawn AS (SELECT it AS iteration, dist, chars, {POISSON_DRAW} AS u FROM errors, (SELECT unnest(range(1000)) AS it)), times AS (SELECT *, {' + '.join(f"(u >= '{p:06x}')::INT" for p in POISSON if p < 1 << 24)} AS k FROM drawn)",
        "SELECT iteration, round(sum(dist * k)::DOUBLE / sum(chars * k), 10) AS cer FROM times GROUP BY iteration",
    ),
    "mcnemar_counts": with_(
        f"{VERSIONS}, c AS (SELECT count(*) FILTER (raw <> line AND norm = line) AS n01, count(*) FILTER (raw = line AND norm <> line) AS n10 FROM versions)",
        "SELECT n01, n10, round(CASE WHEN n01 + n10 > 0 THEN power(abs(n01 - n10) - 1, 2)::DOUBLE / (n01 + n10) ELSE 0.0 END, 9) AS statistic FROM c",
    ),
    "compare_models": with_(
        f"{VERSIONS}, c AS (SELECT CAST(sum({lev('line', 'raw')}) AS BIGINT) AS dist_a, CAST(sum({lev('line', 'norm')}) AS BIGINT) AS dist_b, CAST(sum(length(line)) AS BIGINT) AS chars, count(*) FILTER (raw <> line AND norm = line) AS n01, count(*) FILTER (raw = line AND norm <> line) AS n10 FROM versions)",
        "SELECT *, CASE WHEN dist_a < dist_b THEN 'raw' WHEN dist_b < dist_a THEN 'norm' ELSE 'égalité' END AS best FROM c",
    ),
    "train_eval_join": with_(
        f"{ERRORS}, d AS (SELECT doc_id, sum(dist) AS dist, sum(chars) AS chars FROM errors GROUP BY doc_id)",
        "SELECT quality, toxic, CAST(sum(dist) AS BIGINT) AS dist, CAST(sum(chars) AS BIGINT) AS chars, count(*) AS n_docs FROM d JOIN labels USING (doc_id) GROUP BY quality, toxic",
    ),
    "paired_lines": with_(VERSIONS, "SELECT doc_id || ':' || pos AS line_id, line = raw AS same, CAST(length(raw) AS BIGINT) AS n_raw FROM versions"),
    "make_lines": with_(CONTRACT, "SELECT doc_id, pos, format('{}_line{:03d}', doc_id, reading_order) AS line_id, n AS n_confidences, total AS percent, confidence, needs_review FROM judged"),
    "review_rate": with_(CONTRACT, "SELECT 'd' || doc_id AS document_id, count(*) AS n_lines, count(*) FILTER (needs_review)::DOUBLE / count(*) AS review_rate FROM judged GROUP BY doc_id"),
    "documents_nested": with_(
        CONTRACT,
        "SELECT 'd' || doc_id AS document_id, doc_id % 10 + 8 AS century, CASE doc_id % 3 WHEN 0 THEN 'texte_simple' WHEN 1 THEN 'deux_colonnes' ELSE 'registre_tabulaire' END AS document_type, 'CC-BY-SA-4.0' AS license, sha256(string_agg(format('{}_line{:03d}', doc_id, reading_order), ' ' ORDER BY reading_order, format('{}_line{:03d}', doc_id, reading_order))) AS line_ids FROM judged GROUP BY doc_id",
    ),
    "contract_violations": """
WITH d AS (SELECT doc_id, doc_id % 12 + 7 AS c, CASE WHEN doc_id % 5 = 0 THEN 'format_inconnu' WHEN doc_id % 7 <> 0 THEN 'texte_simple' END AS t FROM documents), v AS (
  SELECT doc_id, list_filter([CASE WHEN t IS NULL THEN '$.metadata.document_type : is required' END, CASE WHEN c NOT BETWEEN 8 AND 17 THEN '$.metadata.century : is out of range' END, CASE WHEN t = 'format_inconnu' THEN '$.metadata.document_type : is not a known type' END], lambda x: x IS NOT NULL) AS v FROM d
)
SELECT 'd' || doc_id AS document_id, len(v) = 0 AS valid, CASE WHEN len(v) = 0 THEN 'OK' ELSE v[1] END AS message, coalesce(array_to_string(v, '; '), '') AS violations FROM v""",
    "eda_by_lang": with_(CONTRACT, f"SELECT lang, count(*) AS n_lines, CAST(sum(total) AS BIGINT) AS percent, CAST(sum(n) AS BIGINT) AS n_chars, count(*) FILTER (needs_review) AS n_review, CAST(sum({SIGNS.format('raw')}) AS BIGINT) AS n_abbreviations FROM judged GROUP BY lang"),
    "eda_report": with_(
        f"{CONTRACT}, c AS (SELECT * FROM judged)",
        f"SELECT lang, count(*) AS n_lines, round(avg(confidence), 3) AS mean_confidence, round(min(confidence), 3) AS min_confidence, round(max(confidence), 3) AS max_confidence, round(avg(needs_review::INT), 3) AS review_rate, round(avg(n), 3) AS mean_length, CAST(sum({SIGNS.format('raw')}) AS BIGINT) AS n_abbreviations FROM c GROUP BY lang",
    ),
    "lines_by_century": with_(LINES, "SELECT CASE WHEN doc_id % 11 <> 0 THEN CAST(doc_id % 10 + 8 AS VARCHAR) ELSE 'inconnu' END AS century, count(*) AS n_lines FROM lines GROUP BY 1"),
    "candidate_positions": with_(
        f"{LINES}, c AS (SELECT doc_id, pos, {percents('length(line)')} AS p FROM lines), f AS (SELECT doc_id, pos, list_filter(range(len(p)), lambda i: p[i + 1] < 70) AS i FROM c)",
        "SELECT doc_id, pos, CAST(len(i) AS BIGINT) AS n, coalesce(array_to_string(i, ','), '') AS positions FROM f",
    ),
    "confidence_resize": with_(
        f"{LINES}, c AS (SELECT doc_id, pos, {percents('length(line)')} AS p FROM lines)",
        "SELECT doc_id, pos, array_to_string(list_transform(range(100), lambda i: CASE WHEN len(p) = 0 THEN 0 WHEN i < len(p) THEN p[i + 1] ELSE p[len(p)] END), ',') AS percents FROM c",
    ),
    "token_to_char": with_(
        f"{LINES}, c AS (SELECT doc_id, pos, line, string_split(line, ' ') AS w FROM lines), d AS (SELECT *, {percents('len(w) - 1')} AS p FROM c), e AS (SELECT doc_id, pos, length(line) AS n, flatten(list_transform(range(len(p)), lambda i: list_transform(range(length(w[i + 1])), lambda k: p[i + 1]))) AS s FROM d)",
        "SELECT doc_id, pos, coalesce(array_to_string(list_transform(range(n), lambda i: CASE WHEN len(s) = 0 THEN 0 WHEN i < len(s) THEN s[i + 1] ELSE s[len(s)] END), ','), '') AS percents FROM e",
    ),
    "softmax_confidence": """
WITH s AS (SELECT vec_id, unnest(range(8)) AS step, embedding FROM embeddings), x AS (SELECT vec_id, step, list_transform(list_slice(embedding, step * 8 + 1, step * 8 + 8), lambda v: v::DOUBLE) AS x FROM s)
SELECT vec_id, CAST(step AS BIGINT) AS step, round(1 / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))), 9) AS p FROM x""",
    "subtoken_labels": with_(
        f"{TOKENS}, arrays AS (SELECT doc_id, pos, list(label ORDER BY tok_pos) AS labels FROM labelled GROUP BY doc_id, pos), ids AS (SELECT *, list_transform(range(2 * len(labels) + 1), lambda i: CASE WHEN i % 7 <> 0 THEN (i - 1) // 2 END) AS ids FROM arrays)",
        f"SELECT doc_id, pos, array_to_string(list_transform(range(len(ids)), lambda k: CASE WHEN ids[k + 1] IS NULL OR (k > 0 AND ids[k + 1] = ids[k]) THEN -100 ELSE list_transform([ids[k + 1] + 1], lambda i: CASE {_label_ids} END)[1] END), ',') AS label_ids FROM ids",
    ),
    "tokens_clean": with_(TOKENS, "SELECT low AS word, count(*) AS n FROM typed GROUP BY low"),
    "bio_tags": with_(TOKENS, "SELECT doc_id, label, count(*) AS n, CAST(sum(pos * 100 + tok_pos) AS BIGINT) AS places FROM labelled GROUP BY doc_id, label"),
    "entities": with_(ENTITIES, "SELECT doc_id, pos, CAST(row_number() OVER (PARTITION BY doc_id, pos ORDER BY island) - 1 AS BIGINT) AS ord, texte, type FROM entity"),
    "entity_counts": with_(ENTITIES, "SELECT lang, type, count(*) AS n FROM entity GROUP BY lang, type"),
    "relations": with_(RELATIONS, "SELECT * FROM relation"),
    "graph_nodes": with_(RELATIONS, "SELECT * FROM nodes"),
    "graph_edges": with_(RELATIONS, "SELECT * FROM edges"),
    "graph_size": with_(RELATIONS, "SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'multi_edges', count(*) FROM relation"),
    "pos_lemma": with_(TOKENS, f"SELECT word AS mot, CASE {_pos} WHEN low IN {words_in(VERBS)} THEN 'VERB' WHEN {_upper} THEN 'PROPN' ELSE 'NOUN' END AS pos, {_lemma_of} AS lemme, count(*) AS n FROM typed GROUP BY ALL"),
    "lemma_index": with_(TOKENS, f"SELECT {_lemma_of} AS lemma, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM typed GROUP BY 1"),
    "piece_labels": with_(TOKENS, "SELECT lang, CASE WHEN contains(lower(word), 'the') THEN 'B-PER' WHEN contains(lower(word), 'ción') THEN 'B-LOC' WHEN contains(lower(word), 'ein') THEN 'B-ORG' WHEN contains(lower(word), 'eau') THEN 'B-DATE' ELSE 'O' END AS label, count(*) AS n FROM tokens GROUP BY 1, 2"),
    "tei_paragraph": with_(TEI, "SELECT doc_id, pos, tei FROM tei"),
    "tei_documents": with_(
        TEI,
        f"""SELECT doc_id, pos, replace('<?xml version="1.0" ?>~<TEI xmlns="{TEI_NAMESPACE}">~  <teiHeader>~    <fileDesc>~      <titleStmt>~        <title>Document ', '~', chr(10)) || doc_id || replace('</title>~      </titleStmt>~      <publicationStmt>~        <p>{TEI_PUBLICATION}</p>~      </publicationStmt>~      <sourceDesc>~        <p>{TEI_SOURCE}</p>~      </sourceDesc>~    </fileDesc>~  </teiHeader>~  <text>~    <body>~      <p>', '~', chr(10)) || tei || replace('</p>~    </body>~  </text>~</TEI>~', '~', chr(10)) AS xml FROM tei""",
    ),
    "stratified_split": with_(SPLIT, "SELECT doc_id, lang, split FROM parts"),
    "split_distribution": with_(SPLIT, "SELECT split, coalesce(lang, 'inconnu') AS stratum, count(*) AS n FROM parts GROUP BY 1, 2"),
    "split_overlap": with_(SPLIT, "SELECT a.doc_id FROM parts a JOIN parts b ON a.doc_id = b.doc_id AND a.split < b.split"),
    "seal_digest": """
WITH r AS (SELECT sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS d FROM documents), f AS (SELECT substr(d, 1, 6) AS g, sha256(string_agg(d, '' ORDER BY d)) AS d, count(*) AS n FROM r GROUP BY 1), g AS (SELECT substr(g, 1, 3) AS g, sha256(string_agg(d, '' ORDER BY f.g)) AS d, sum(n) AS n FROM f GROUP BY 1)
SELECT sha256(string_agg(d, '' ORDER BY g)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM g""",
    "row_islands": """
WITH h AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT event_type, hour, hour - row_number() OVER (PARTITION BY event_type ORDER BY hour) AS run FROM h WHERE n >= 3)
SELECT event_type, min(hour) AS start, max(hour) + 1 AS "end" FROM r GROUP BY event_type, run""",
    "segment_lines": with_(
        f"{LINES}, {RASTER}, kept AS (SELECT *, greatest(a - 3, 0) AS y0, least(b + 3, height) AS y1, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS reading_order FROM band WHERE b - a >= 10)",
        "SELECT doc_id AS page_id, CAST(reading_order AS BIGINT) AS reading_order, CAST(x0 AS BIGINT) AS x, CAST(y0 AS BIGINT) AS y, CAST(x1 - x0 AS BIGINT) AS w, CAST(y1 - y0 AS BIGINT) AS h, x0 || ',' || y0 || ' ' || x1 || ',' || y0 || ' ' || x1 || ',' || y1 || ' ' || x0 || ',' || y1 AS points FROM kept",
    ),
    "array_runs": """
WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings), r AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS run FROM x WHERE v > 0)
SELECT vec_id, min(i) AS start, max(i) + 1 AS "end" FROM r GROUP BY vec_id, run""",
    "polygons": f"""
WITH p AS (SELECT vec_id, {_points} AS p FROM embeddings)
SELECT vec_id, array_to_string(list_transform(p, lambda q: q[1] || ',' || q[2]), ' ') AS points, true AS same_size, greatest(list_min(list_transform(p, lambda q: q[1])), 0) AS x0, greatest(list_min(list_transform(p, lambda q: q[2])), 0) AS y0,
  least(list_max(list_transform(p, lambda q: q[1])), 200) AS x1, least(list_max(list_transform(p, lambda q: q[2])), 150) AS y1 FROM p""",
    "alto_boxes": """
WITH n AS (SELECT vec_id, list_transform(list_slice(embedding, 1, vec_id % 9), lambda v: CAST(floor(abs(v::DOUBLE) * 1000) AS BIGINT)) AS n, list_transform(list_slice(embedding, 21, 24), lambda v: CAST(floor(v::DOUBLE * 1000) AS BIGINT)) AS b FROM embeddings), p AS (
  SELECT vec_id, CASE WHEN len(n) // 2 >= 3 THEN list_transform(range(len(n) // 2), lambda i: [n[2 * i + 1], n[2 * i + 2]]) WHEN b[3] > 0 AND b[4] > 0 THEN [[b[1], b[2]], [b[1] + b[3], b[2]], [b[1] + b[3], b[2] + b[4]], [b[1], b[2] + b[4]]] ELSE [] END AS p FROM n
)
SELECT vec_id, CAST(len(p) AS BIGINT) AS n_points, coalesce(array_to_string(list_transform(p, lambda q: q[1] || ',' || q[2]), ' '), '') AS points FROM p""",
    "panel_rows": with_(LINES, f"SELECT doc_id, pos, CASE WHEN pos % 3 = 0 OR line = '' THEN '(non transcrite)' WHEN length(line) > 52 THEN substr(line, 1, 49) || '...' ELSE line END AS panel, {_colours}[CAST(pos % 1000 % {len(PALETTE)} AS INT) + 1] AS colour FROM lines"),
    "page_documents": with_(PAGE, "SELECT path, CAST(length(content) AS BIGINT) AS n_chars, sha256(content) AS sha256, 'page' AS format FROM files"),
    "xml_lines": with_(CONTRACT, "SELECT 'd' || doc_id || '.xml' AS path, row_number() OVER (PARTITION BY doc_id ORDER BY reading_order, pos) - 1 AS line_idx, trim(raw) AS text, '0,0 100,0 100,30 0,30' AS points FROM judged QUALIFY trim(raw) <> ''"),
    "xml_page_lines": with_(CONTRACT, "SELECT 'd' || doc_id || '.xml' AS path, row_number() OVER (PARTITION BY doc_id ORDER BY reading_order, pos) - 1 AS line_idx, 'line_' || reading_order AS line_id, raw AS text, '0,0 100,0 100,30 0,30' AS points FROM judged"),
    "pair_images": """
SELECT 'corpus/d' || (page_id % 7) || '/p' || page_id || '.xml' AS xml, CASE WHEN page_id % 3 = 0 THEN 'corpus/d' || (page_id % 7) || '/p' || page_id || '.png' ELSE 'scans/x/p' || page_id || '.jpg' END AS image FROM pages WHERE page_id % 5 <> 0""",
    "journal_flatten": "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1, 2",
    "simulated_engine": f"""
WITH d AS (SELECT doc_id, greatest(1, (n_chars % 900) // 60) AS n FROM documents), t AS (SELECT doc_id, array_to_string(list_transform(range(n), lambda i: {_cycle}[CAST(i % 8 AS INT) + 1]), ' ') AS text FROM d),
c AS (SELECT doc_id, text, {thousandths(42, 85, (800, 1000), (400, 700))} AS a, {thousandths(43, 80, (750, 1000), (350, 700))} AS b FROM t)
SELECT doc_id, text, array_to_string(a, ',') AS trocr, array_to_string(b, ',') AS kraken, CAST(len(list_filter(a, lambda x: x < 700)) AS BIGINT) AS n_candidates FROM c""",
    "early_stopping": """
WITH d AS (SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS epoch, 1000 - count(*) AS cer FROM events GROUP BY 1, 2), b AS (
  SELECT *, row_number() OVER w AS n, coalesce(cer < min(cer) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM d WINDOW w AS (PARTITION BY event_type ORDER BY epoch)
), s AS (
  SELECT *, n - max(CASE WHEN better THEN n END) OVER (PARTITION BY event_type ORDER BY epoch) >= 3 AS stop FROM b
)
SELECT event_type, epoch, cer FROM (SELECT *, coalesce(bool_or(stop) OVER (PARTITION BY event_type ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM s) WHERE NOT stopped""",
    "best_epoch": """
WITH d AS (SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS epoch, 1000 - count(*) AS cer FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY cer, epoch) AS r, count(*) OVER (PARTITION BY event_type) AS n_epochs FROM d)
SELECT event_type, cer AS best_value, epoch AS best_epoch, n_epochs FROM r WHERE r = 1""",
}


def _raw_entities() -> str:
    """The entities of the raw lines, as raw_entity."""
    ctes = ENTITIES.removeprefix(TOKENS).strip().removeprefix(",").strip()
    whole = TOKENS.removeprefix(LINES).strip().removeprefix(",").strip() + ", " + ctes
    whole = whole.replace("string_split(line, ' ')", "string_split(raw, ' ')").replace("FROM lines", "FROM versions")
    for name in ("split", "tokens", "typed", "labelled", "islands", "entity"):
        whole = re.sub(rf"\b{name} AS \(", f"raw_{name} AS (", whole)
        whole = re.sub(rf"\bFROM {name}\b", f"FROM raw_{name}", whole)
    return whole


_noise = [float(x) for x in np.random.default_rng(42).normal(0, CURVE_NOISE, 10)]
_simulated = f"array_to_string(list_transform(range(greatest(1, width // {PIXELS_PER_WORD})), lambda i: {_cycle}[CAST(i % 8 AS INT) + 1]), ' ')"
_seals = """r AS (SELECT what, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS d FROM versions), f AS (SELECT what, substr(d, 1, 6) AS g, sha256(string_agg(d, '' ORDER BY d)) AS d, count(*) AS n FROM r GROUP BY 1, 2), g AS (SELECT what, substr(g, 1, 3) AS g, sha256(string_agg(d, '' ORDER BY f.g)) AS d, sum(n) AS n FROM f GROUP BY 1, 2), seals AS (SELECT what, sha256(string_agg(d, '' ORDER BY g)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1)"""


def _option(o: str) -> str:
    """Whether option o at the place p of the text t makes a word of the correction lexicon."""
    w = f"(substr(t, 1, p::INT) || '{o}' || substr(t, p::INT + 2))"
    return f"lower(regexp_extract(substr({w}, 1, p::INT), '[^ ]*$') || regexp_extract(substr({w}, p::INT + 1), '^[^ ]*')) IN {words_in(CORRECTION_LEXICON)}"


_corrected = "list_reduce(list_prepend(norm, list_transform(list_filter(range(length(raw)), lambda i: percent[i + 1] < 70 AND i < length(norm)), lambda i: i::VARCHAR)), lambda t, p: CASE " + " ".join(f"WHEN {_option(o)} THEN substr(t, 1, p::INT) || '{o}' || substr(t, p::INT + 2)" for o in CANDIDATE_OPTIONS) + " ELSE t END)"
#: Cells of the alignment by anti-diagonals: scores and steps of the last two, in places of a from 0 on.
PATHS = f"""{LINES}, words AS (SELECT DISTINCT unnest(list_filter(string_split(line, ' '), lambda x: x <> '')) AS a FROM lines), pairs AS (
  SELECT a, substr(replace(replace(replace(replace(' ' || a, ' un', ' vn'), 'que', 'q~'), 'on', 'õ'), 'et', '⁊'), 2) AS b FROM words
), cells AS (
  SELECT a, b, 0 AS k, [0] || list_transform(range(length(a)), lambda i: NULL::INT) AS s, list_transform(range(length(a) + 1), lambda i: NULL::INT) AS s2, [''] || list_transform(range(length(a)), lambda i: NULL::VARCHAR) AS p, list_transform(range(length(a) + 1), lambda i: NULL::VARCHAR) AS p2 FROM pairs
  UNION ALL
  SELECT a, b, k + 1, list_transform(moves, lambda m: m.s), s, list_transform(moves, lambda m: m.p), p FROM (
    SELECT *, list_transform(range(length(a) + 1), lambda i: CASE
      WHEN k + 1 - i < 0 OR k + 1 - i > length(b) THEN {{'s': NULL::INT, 'p': NULL::VARCHAR}}
      WHEN i = 0 THEN {{'s': -(k + 1), 'p': repeat('L', k + 1)}}
      WHEN i = k + 1 THEN {{'s': -(k + 1), 'p': repeat('U', k + 1)}}
      WHEN s2[i] + CASE WHEN substr(a, i, 1) = substr(b, k + 1 - i, 1) THEN 1 ELSE -1 END >= greatest(s[i], s[i + 1]) - 1 THEN {{'s': (s2[i] + CASE WHEN substr(a, i, 1) = substr(b, k + 1 - i, 1) THEN 1 ELSE -1 END)::INT, 'p': p2[i] || 'D'}}
      WHEN s[i] >= s[i + 1] THEN {{'s': (s[i] - 1)::INT, 'p': p[i] || 'U'}}
      ELSE {{'s': (s[i + 1] - 1)::INT, 'p': p[i + 1] || 'L'}} END) AS moves FROM cells WHERE k < length(a) + length(b)
  )
), paths AS (SELECT a, b, p[length(a) + 1] AS steps FROM cells WHERE k = length(a) + length(b))"""
FUSED = f"""{PATHS}, placed AS (
  SELECT a, b, list_transform(range(length(steps)), lambda k: {{'m': substr(steps, k + 1, 1), 'i': length(replace(substr(steps, 1, k + 1), 'L', '')), 'j': length(replace(substr(steps, 1, k + 1), 'U', ''))}}) AS m FROM paths
), chosen AS (
  SELECT a, b, list_transform(m, lambda x: {{'p': CASE WHEN x.m <> 'L' THEN (length(a) * 31 + x.i * 7) % 61 + 40 END, 'q': CASE WHEN x.m <> 'U' THEN (length(b) * 17 + x.j * 11) % 61 + 40 END, 'i': x.i, 'j': x.j}}) AS c FROM placed
)"""
_grey = "list_transform(embedding, lambda v: CAST(floor(abs(v::DOUBLE) * 1000) AS BIGINT) % 256)"
_mirror = lambda c: f"CASE {c} WHEN -1 THEN 1 WHEN 8 THEN 6 ELSE {c} END"

SQL |= {
    "stage_windows": SQL["stage_transitions"],
    "metrics_report": with_(
        f"""{DRAWS}, pairs AS (
  SELECT list_filter(string_split(line, ' '), lambda x: x <> '') AS wa, list_filter(string_split(raw, ' '), lambda x: x <> '') AS wb FROM versions
), coded AS (
  SELECT wa, array_to_string(list_transform(wa, lambda w: chr(CAST(list_position(v, w) AS INT))), '') AS x, array_to_string(list_transform(wb, lambda w: chr(CAST(list_position(v, w) AS INT))), '') AS y FROM (SELECT *, list_distinct(list_concat(wa, wb)) AS v FROM pairs)
), w AS (SELECT sum(levenshtein(x, y))::DOUBLE / sum(len(wa)) AS wer FROM coded), c AS (SELECT sum(dist)::DOUBLE / sum(chars) AS cer, count(*) AS n FROM errors), b AS (SELECT quantile_cont(cer, 0.025) AS low, quantile_cont(cer, 0.975) AS high FROM replicates)""",
        "SELECT format('{:.4f}', cer)::DOUBLE AS CER, format('{:.4f}', wer)::DOUBLE AS WER, format('{:.4f}', low)::DOUBLE AS CER_low, format('{:.4f}', high)::DOUBLE AS CER_high, cer < 0.15 AS CER_sous_15pct, cer < 0.08 AS CER_sous_8pct, wer < 0.25 AS WER_sous_25pct, n AS n_lignes FROM w, c, b",
    ),
    "contract_files": with_(CONTRACT, "SELECT 'd' || doc_id AS document_id, doc_id % 12 + 7 AS century, count(*) AS n_lines, CAST(sum(length(raw)) AS BIGINT) AS n_chars FROM judged WHERE doc_id % 12 + 7 BETWEEN 8 AND 17 GROUP BY doc_id"),
    "file_digests": with_(PAGE, "SELECT path, sha256(content) AS sha256 FROM files"),
    "seal_check": f"""
WITH versions AS (
  SELECT 'same' AS what, doc_id, lang, source FROM documents UNION ALL SELECT 'lost', doc_id, lang, source FROM documents WHERE doc_id <> (SELECT min(doc_id) FROM documents)
  UNION ALL SELECT 'changed', doc_id, lang, CASE WHEN doc_id = (SELECT min(doc_id) FROM documents) THEN 'x' ELSE source END FROM documents UNION ALL SELECT 'sealed', doc_id, lang, source FROM documents
), {_seals}
SELECT what, digest = (SELECT digest FROM seals WHERE what = 'sealed') AS intact, n FROM seals WHERE what <> 'sealed'""",
    "alto_lines": with_(
        f"{LINES}, placed AS (SELECT doc_id, line, pos // 1000000 * 10000 + pos % 1000000 AS o, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS line_idx, length(line) + 11 AS x FROM lines)",
        "SELECT 'd' || doc_id || '.xml' AS path, line_idx, trim(array_to_string(list_filter(string_split(line, ' '), lambda x: x <> ''), ' ')) AS text, '10,' || o * 40 || ' ' || x || ',' || o * 40 || ' ' || x || ',' || o * 40 + 30 || ' 10,' || o * 40 + 30 AS points FROM placed WHERE o % 5 <> 4 AND trim(line) <> ''",
    ),
    "journal_metrics": """
WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%dT%H:00:00') AS timestamp, count(*)::DOUBLE AS n, max(event_id)::DOUBLE AS last FROM events GROUP BY 1, 2)
SELECT timestamp, event_type AS nom, 'n' AS metric, n AS value FROM d UNION ALL SELECT timestamp, event_type, 'last', last FROM d""",
    "fusion_engine": f"""
WITH d AS (SELECT doc_id, n_chars % 900 AS width FROM documents), t AS (SELECT doc_id, {_simulated} AS text FROM d),
c AS (SELECT doc_id, text, {thousandths(*TROCR_DRAWS)} AS a, {thousandths(*KRAKEN_DRAWS)} AS b FROM t)
SELECT doc_id, text, array_to_string(list_transform(range(len(a)), lambda i: greatest(a[i + 1], b[i + 1])), ',') AS confidences, CAST(len(a) AS BIGINT) AS n FROM c""",
    "engine_comparison": with_(
        f"{LINES}, w AS (SELECT doc_id, pos, line, length(line) * 6 AS width FROM lines), r AS (SELECT doc_id, pos, line, {_simulated} AS b FROM w), x AS (SELECT CASE WHEN doc_id % 4 = 0 THEN b ELSE line END AS line, b, CASE WHEN pos % 3 = 0 THEN regexp_replace(b, ' [^ ]*$', '') ELSE b END AS a FROM r), c AS (SELECT CAST(sum({lev('line', 'a')}) AS BIGINT) AS dist_a, CAST(sum({lev('line', 'b')}) AS BIGINT) AS dist_b, CAST(sum(length(line)) AS BIGINT) AS chars, count(*) FILTER (a <> line AND b = line) AS n01, count(*) FILTER (a = line AND b <> line) AS n10 FROM x)",
        "SELECT *, round(CASE WHEN n01 + n10 > 0 THEN power(abs(n01 - n10) - 1, 2)::DOUBLE / (n01 + n10) ELSE 0.0 END, 9) AS statistic, CASE WHEN dist_a < dist_b THEN 'a' WHEN dist_b < dist_a THEN 'b' ELSE 'égalité' END AS best FROM c",
    ),
    "word_alignment": "WITH RECURSIVE " + PATHS.strip() + "\nSELECT a, b, steps FROM paths",
    "word_fusion": "WITH RECURSIVE " + FUSED.strip() + "\nSELECT a, b, array_to_string(list_transform(c, lambda x: CASE WHEN x.q IS NULL OR x.p >= x.q THEN substr(a, x.i, 1) ELSE substr(b, x.j, 1) END), '') AS text, array_to_string(list_transform(c, lambda x: CASE WHEN x.q IS NULL OR x.p >= x.q THEN x.p ELSE x.q END), ',') AS percents FROM chosen",
    "entity_f1": with_(
        f"{ENTITIES}, versions AS (SELECT *, replace(replace(replace(replace(line, ' un', ' vn'), 'que', 'q~'), 'on', 'õ'), 'et', '⁊') AS raw FROM lines), {_raw_entities()}, t AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, pos ORDER BY island) AS ord, texte, type FROM entity), f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, pos ORDER BY island) AS ord, texte, type FROM raw_entity), j AS (SELECT coalesce(t.type, f.type) AS type, t.doc_id IS NOT NULL AS t, f.doc_id IS NOT NULL AS f FROM t FULL OUTER JOIN f ON t.doc_id = f.doc_id AND t.pos = f.pos AND t.ord = f.ord AND t.texte = f.texte AND t.type = f.type), s AS (SELECT type, count(*) FILTER (t AND f) AS tp, count(*) FILTER (NOT t) AS fp, count(*) FILTER (NOT f) AS fn FROM j GROUP BY type)",
        "SELECT type, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0.0 END, 9) AS f1 FROM s",
    ),
    "simulated_curve": f"""
WITH n AS (SELECT greatest({CURVE_LEAST}::DOUBLE, {CURVE_PLATEAU}::DOUBLE - count(*) * {CURVE_FALL}::DOUBLE) AS plateau FROM labels), e AS (SELECT unnest(range(1, 11)) AS epoch, unnest({_noise}) AS noise), d AS (
  SELECT epoch, greatest(plateau * {CURVE_FLOOR}::DOUBLE, {CURVE_START}::DOUBLE - ({CURVE_START}::DOUBLE - plateau) * (1 - exp(-{CURVE_DECAY}::DOUBLE * epoch)) + noise) AS cer FROM n, e
), b AS (
  SELECT *, coalesce(cer < min(cer) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM d
), s AS (SELECT *, epoch - max(CASE WHEN better THEN epoch END) OVER (ORDER BY epoch) >= 3 AS stop FROM b)
SELECT epoch, round(cer, 9) AS cer FROM (SELECT *, coalesce(bool_or(stop) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM s) WHERE NOT stopped""",
    "pages_to_documents": with_(
        f"{LINES}, {RASTER}, kept AS (SELECT doc_id, count(*) AS n FROM band WHERE b - a >= 10 GROUP BY doc_id)",
        "SELECT d.doc_id::VARCHAR AS document_id, true AS valid, coalesce(n, 0) AS n_lines FROM documents d LEFT JOIN kept USING (doc_id)",
    ),
    "normalisation_impact": with_(
        f"{CONTRACT}, corrected AS (SELECT raw, norm, {_corrected} AS corr FROM judged), steps AS (SELECT 'brut→regles' AS transition, raw AS a, norm AS b FROM corrected UNION ALL SELECT 'regles→correction', norm, corr FROM corrected), d AS (SELECT transition, a, b, {lev('a', 'b')} AS dist FROM steps)",
        "SELECT transition, round(avg(CASE WHEN length(a) = 0 THEN CASE WHEN length(b) = 0 THEN 0.0 ELSE 1.0 END ELSE dist::DOUBLE / length(a) END), 9) AS mean_distance, CAST(sum(dist) AS BIGINT) AS dist, count(*) FILTER (dist > 0) AS n_changed, count(*) AS n_lines FROM d GROUP BY transition",
    ),
    "preprocessed_images": f"""
WITH px AS (SELECT vec_id, unnest(range(64)) AS i, unnest({_grey}) AS v FROM embeddings), counts AS (SELECT vec_id, v, count(*) AS c FROM px GROUP BY 1, 2), excess AS (SELECT vec_id, sum(c - 1) AS e FROM counts GROUP BY 1),
bins AS (SELECT vec_id, v, CASE WHEN c IS NULL THEN 0 ELSE 1 END + e // 256 + CASE WHEN v < e % 256 THEN 1 ELSE 0 END AS c FROM (SELECT vec_id, e, unnest(range(256)) AS v FROM excess) LEFT JOIN counts USING (vec_id, v)),
maps AS (SELECT vec_id, v, least(255, greatest(0, round_even(sum(c) OVER (PARTITION BY vec_id ORDER BY v) * 255.0::DOUBLE / 64, 0))) AS m FROM bins),
eq AS (SELECT p.vec_id, p.i // 8 AS y, p.i % 8 AS x, m / 255.0::DOUBLE AS m FROM px p JOIN maps USING (vec_id, v)),
near AS (SELECT vec_id, y, x, dy, dx, {_mirror("(y + dy)")} AS ny, {_mirror("(x + dx)")} AS nx, m FROM eq, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)),
local AS (SELECT a.vec_id, a.y, a.x, any_value(a.m) AS m, sum(b.m) / 9 AS mean, sqrt(greatest(sum(b.m * b.m) / 9 - (sum(b.m) / 9) * (sum(b.m) / 9), 0)) AS dev FROM near a JOIN eq b ON a.vec_id = b.vec_id AND a.ny = b.y AND a.nx = b.x GROUP BY 1, 2, 3),
two AS (SELECT vec_id, y, x, m > mean * (1 + 0.2::DOUBLE * (dev / 0.5::DOUBLE - 1)) AS w FROM local),
low AS (SELECT a.vec_id, a.y, a.x, bool_and(b.w) AS w FROM two a JOIN two b ON a.vec_id = b.vec_id AND b.y BETWEEN a.y - 1 AND a.y AND b.x BETWEEN a.x - 1 AND a.x GROUP BY 1, 2, 3),
high AS (SELECT a.vec_id, a.y, a.x, bool_or(b.w) AS w FROM low a JOIN low b ON a.vec_id = b.vec_id AND b.y BETWEEN a.y AND a.y + 1 AND b.x BETWEEN a.x AND a.x + 1 GROUP BY 1, 2, 3)
SELECT vec_id, string_agg(CASE WHEN w THEN '#' ELSE '.' END, '' ORDER BY y, x) AS signs FROM high GROUP BY vec_id""",
}
