"""SQL for the queries, in the dialect of DuckDB, written independently of the operators."""

from __future__ import annotations

from inkstone.plans import fixtures

_WS = r"\t-\r\x1c-\x20\x{85}\p{Z}"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+\z', '', 'g')"


def lines(x: str) -> str:
    a = rf"regexp_split_to_array({x}, '\r\n|[\n-\r\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    return f"(CASE WHEN ({a})[-1] = '' THEN ({a})[:-2] ELSE {a} END)"


_DOCS = "(SELECT doc_id, text FROM documents)"
_CHUNKS = "(SELECT doc_id, chunk_index, r.section AS section, r.text AS text FROM (SELECT doc_id, chunk_index, min(struct_pack(text := text, section := section)) AS r FROM chunks GROUP BY ALL))"
_SECS = "(SELECT doc_id, section_no, any_value(section) AS section, any_value(bullets) AS bullets, any_value(chart_spec) AS chart_spec FROM section_summaries GROUP BY doc_id, section_no)"
_PAIRS = "(SELECT id, any_value(output) AS prediction, any_value(input) AS reference FROM steps WHERE type = 'llm' GROUP BY id)"


def line_table(src: str) -> str:
    return f"(SELECT doc_id, CAST(i AS BIGINT) AS line_no, a[i] AS line, {strip('a[i]')} AS key FROM (SELECT doc_id, {lines('text')} AS a FROM {src} WHERE text IS NOT NULL) q, UNNEST(range(1, len(a) + 1)) AS u(i))"


def joined(src: str, kept: str) -> str:
    return f"SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.t, '') END AS text FROM {src} d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM ({kept}) GROUP BY doc_id) k USING (doc_id)"


def titles(src: str) -> str:
    return joined(src, f"SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n, row_number() OVER (PARTITION BY doc_id, key ORDER BY line_no) AS rn FROM {line_table(src)} QUALIFY key = '' OR n < 3 OR rn = 1")


def repeats(src: str) -> str:
    return joined(src, rf"SELECT *, regexp_replace(key, '^#+[{_WS}]*', '') AS norm, count(*) FILTER (key <> '') OVER (PARTITION BY doc_id, norm) AS n FROM {line_table(src)} QUALIFY n < 2")


def consecutive(src: str) -> str:
    return joined(src, f"SELECT *, last_value(nullif(key, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {line_table(src)} QUALIFY key = '' OR prev IS NULL OR key <> prev")


def notes(src: str) -> str:
    return joined(src, rf"SELECT *, regexp_matches(key, '^(주[{_WS}]*\d+\)|[*☞])') AS note, regexp_replace(key, '[{_WS}]+', '', 'g') AS bare, row_number() OVER (PARTITION BY doc_id, note, bare ORDER BY line_no) AS rn FROM {line_table(src)} QUALIFY NOT note OR rn = 1")


def page_numbers(x: str) -> str:
    return rf"regexp_replace({x}, '(?m)^[{_WS}]*\p{{Nd}}{{1,3}}[{_WS}]*$', '', 'g')"


def bullets(x: str) -> str:
    return rf"regexp_replace({x}, '(?m)^[{_WS}▪•\-–—]+[{_WS}]*$', '', 'g')"


def ws(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g')")


def pictures(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\*\*==>?\s*picture\s*\[\d+\s*x\s*\d+\]\s*intentionally omitted\s*<==\*\*\n?', '', 'g'), '(?s)\*\*----- Start of picture text -----\*\*.*?\*\*----- End of picture text -----\*\*\n?', '', 'g')"


def notice(x: str) -> str:
    return rf"regexp_replace({x}, '(?m)^☞.*출처.*바랍니다.*$', '', 'g')"


_MARKED = r"(SELECT doc_id, regexp_replace(text, '\\(?:sub)?section\*?\{([^{}]*)\}', chr(10) || '## \1' || chr(10), 'g') AS text FROM documents)"

_SECTIONS = rf"""
WITH p AS (SELECT doc_id, i, a[i] AS part FROM (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(#{{1,3}} .+)$', chr(1) || '\1', 'g'), chr(1)) AS a FROM {_MARKED} WHERE text IS NOT NULL) q, UNNEST(range(1, len(a) + 1)) AS u(i)),
c AS (SELECT doc_id, i, regexp_extract(part, '^#{{1,3}} (.+)', 0) AS head, {strip("regexp_replace(part, '^#{1,3} .+', '')")} AS body FROM p),
h AS (SELECT *, bool_or(head <> '') OVER (PARTITION BY doc_id) AS headed FROM c WHERE body <> ''),
b AS (SELECT doc_id, i, {strip('a[i]')} AS body FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS a FROM {_MARKED} WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM h WHERE headed)) q, UNNEST(range(1, len(a) + 1)) AS u(i)),
s AS (SELECT doc_id, i, regexp_replace({strip('head')}, '^#{{1,3}} ', '') AS title, body FROM h WHERE headed UNION ALL SELECT doc_id, i, '', body FROM b WHERE body <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS section_no, title, body FROM s
"""

_TERMS = "regexp_extract_all({}, '[가-힣a-zA-Z0-9]+')"


def bm25(corpus: str, asked: str, k: int) -> str:
    """CTEs ending in hits(query columns q1, q2, item, score, rank)."""
    return f"""
t AS (SELECT scope, item, {_TERMS.format('text')} AS w FROM {corpus} WHERE text IS NOT NULL),
p AS (SELECT scope, item, len(w) AS n, term, count(*) AS tf FROM (SELECT scope, item, w, unnest(w) AS term FROM t) GROUP BY ALL),
c AS (SELECT scope, count(*) AS docs, avg(len(w)) AS mean FROM t WHERE len(w) > 0 GROUP BY scope),
r AS (SELECT scope, term, mean, ln(docs - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p JOIN c USING (scope) GROUP BY scope, term, docs, mean),
i AS (SELECT scope, term, mean, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY scope) ELSE raw END AS idf FROM r),
a AS (SELECT q1, q2, scope, term, count(*) AS m FROM (SELECT q1, q2, scope, unnest({_TERMS.format('text')}) AS term FROM {asked} WHERE text IS NOT NULL) GROUP BY ALL),
s AS (SELECT q1, q2, scope, item, sum(m * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))) AS score FROM a JOIN p USING (scope, term) JOIN i USING (scope, term) GROUP BY ALL HAVING score >= 0.1),
hits AS (SELECT *, row_number() OVER (PARTITION BY q1, q2 ORDER BY round(score, 9) DESC, item) AS rank FROM s QUALIFY rank <= {k})"""


_CORPUS = f"(SELECT doc_id AS scope, chunk_index AS item, text FROM {_CHUNKS})"
_FIRST = f"(SELECT doc_id AS q1, section_no AS q2, doc_id AS scope, bullets[1] AS text FROM {_SECS})"
_TITLE = f"(SELECT doc_id AS q1, section_no AS q2, doc_id AS scope, chart_spec.title AS text FROM {_SECS})"
_SEC_CORPUS = f"(SELECT doc_id AS scope, section_no AS item, concat_ws(' ', section, array_to_string(bullets, ' ')) AS text FROM {_SECS})"

_RRF = f"""
WITH x AS (WITH {bm25(_CORPUS, _FIRST, 5)} SELECT q1, q2, scope, item, rank, 0 AS l FROM hits),
y AS (WITH {bm25(_CORPUS, _TITLE, 5)} SELECT q1, q2, scope, item, rank, 1 AS l FROM hits),
z AS (SELECT q1, q2, text, sum(1.0 / (60 + rank)) AS score, min(l * 1000 + rank) AS f FROM (SELECT * FROM x UNION ALL SELECT * FROM y) h JOIN {_CORPUS} c ON h.scope = c.scope AND h.item = c.item GROUP BY q1, q2, text)
SELECT q1 AS doc_id, q2 AS section_no, text, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY q1, q2 ORDER BY round(score, 12) DESC, f) AS INTEGER) AS rank FROM z QUALIFY rank <= 5
"""

_RERANK = f"""
WITH {bm25(_CORPUS, _FIRST, 5)},
j AS (SELECT q1, q2, c.text, rank, list_distinct({_TERMS.format('f.text')}) AS q, {_TERMS.format('c.text')} AS w, count(*) OVER (PARTITION BY q1, q2) AS n FROM hits h JOIN {_CORPUS} c USING (scope, item) JOIN (SELECT q1, q2, text FROM {_FIRST}) f USING (q1, q2)),
m AS (SELECT q1, q2, text, rank, CASE WHEN n > 3 THEN round(len(list_intersect(q, w)) / len(q), 9) END AS s FROM j)
SELECT q1 AS doc_id, q2 AS section_no, text, CAST(row_number() OVER (PARTITION BY q1, q2 ORDER BY s DESC NULLS LAST, rank) AS INTEGER) AS r FROM m QUALIFY r <= 3
"""


def dense(extra: str) -> str:
    d = "CAST({} AS DOUBLE[])"
    cos = f"list_dot_product({d.format('q.embedding')}, {d.format('v.embedding')}) / sqrt(list_dot_product({d.format('q.embedding')}, {d.format('q.embedding')}) * list_dot_product({d.format('v.embedding')}, {d.format('v.embedding')}))"
    return f"""SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT q.vec_id AS query_id, v.vec_id, {cos} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cos}, 9) DESC, v.vec_id) AS rank
      FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 {extra}) WHERE rank <= 5"""


_DATE = r"\d{4}\.\d{1,2}(?:\.\d{1,2})?|\d{4}년\s*\d{1,2}월|\d{2}/\d{2}"
_UNIT = r"(?:\s*(?:조|억|만)?\s*(?:원|달러|엔|위안))?(?:\s*[%％](?:p|P)?)?(?:\s*bp)?(?:\s*개월)?"
_ONE = r"[\+\-]?[\d,]+\.?\d*"


def numbers(x: str) -> str:
    dated = f"regexp_replace({x}, '{_DATE}', '', 'g')"
    both = f"list_concat(regexp_extract_all({dated}, '{_ONE}~{_ONE}{_UNIT}'), regexp_extract_all(regexp_replace({dated}, '{_ONE}~{_ONE}{_UNIT}', '', 'g'), '{_ONE}{_UNIT}'))"
    flat = f"list_filter(list_transform({both}, lambda n: regexp_replace(trim(n, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '[, ]', '', 'g')), lambda n: n NOT IN ('', '.', '-', '+'))"
    return f"list_filter({flat}, lambda n_, k_: list_position({flat}, n_) = k_)"


_STOP = "['이곳', '저곥', '그곳', '이것', '저것', '그것', '한다', '하는', '되는', '있다', '없다', '서말', '대비', '대해', '대한', '따릅', '위한', '목표', '결과', '수준', '기준', 'N/A', '문서', '내용', '없음', '없는']"

_ENTITY = f"""
WITH t AS (SELECT id, prediction, reference, list_distinct(list_concat({numbers('reference')}, list_filter(regexp_extract_all(reference, '[가-힣]{{2,10}}'), lambda e: NOT list_contains({_STOP}, e)))) AS want FROM {_PAIRS} WHERE reference IS NOT NULL),
u AS (SELECT *, len(list_filter(want, lambda e: contains(regexp_replace(prediction, '[, ]', '', 'g'), regexp_replace(e, '[, ]', '', 'g')) OR contains(prediction, e))) AS hit FROM t)
SELECT id, CASE WHEN coalesce(prediction, '') = '' OR reference = '' THEN 0.0 WHEN len(want) = 0 THEN 1.0 ELSE round(hit / len(want), 4) END AS coverage, CAST(CASE WHEN coalesce(prediction, '') = '' OR reference = '' THEN 0 ELSE len(want) END AS INTEGER) AS total FROM u
"""


def rouge(n: int) -> str:
    g = lambda x: f"list_transform(range(1, len({x}) - {n} + 2), lambda i: array_to_string({x}[i:i + {n - 1}], ' '))"
    return f"""
WITH w AS (SELECT id, {_TERMS.format("coalesce(prediction, '')")} AS a, {_TERMS.format("coalesce(reference, '')")} AS b FROM {_PAIRS}),
g AS (SELECT id, {g('a')} AS a, {g('b')} AS b FROM w),
x AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(a) AS t FROM g) GROUP BY ALL), y AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(b) AS t FROM g) GROUP BY ALL),
o AS (SELECT id, sum(least(x.n, y.n)) AS o FROM x JOIN y USING (id, t) GROUP BY id)
SELECT g.id, CASE WHEN o > 0 THEN round(2 * (o / len(a)) * (o / len(b)) / (o / len(a) + o / len(b)), 4) ELSE 0.0 END AS rouge{n} FROM g LEFT JOIN o USING (id)
"""


_FLOATS = "list_transform({}, lambda v: TRY_CAST(trim(v) AS DOUBLE))"
_FIG = f"""
WITH s AS (SELECT doc_id, section_no, chart_spec AS c, lower(trim(chart_spec.chart_type)) AS k FROM {_SECS} WHERE chart_spec IS NOT NULL),
n AS (SELECT *, least(len(c.labels), len(c.values)) AS m, {_FLOATS.format('c.values[1:least(len(c.labels), len(c.values))]')} AS v,
  list_filter(c.series[1:5], lambda x: least(len(c.labels), len(x.values)) >= 3 AND len(list_filter({_FLOATS.format('x.values[1:least(len(c.labels), len(x.values))]')}, lambda y: y IS NULL)) = 0) AS tr FROM s),
f AS (SELECT *, CASE WHEN k = 'multiline' THEN coalesce(len(tr), 0) > 0 AND c.labels IS NOT NULL WHEN k IN ('line', 'bar', 'pie', 'waterfall') THEN coalesce(len(c.values) >= 3 AND c.labels IS NOT NULL AND len(list_filter(v, lambda y: y IS NULL)) = 0, false) ELSE false END AS ok FROM n)
"""


def oracle_sql() -> dict[str, str]:
    fx = fixtures.for_sql
    rec = fixtures.records("steps")
    mean = "round(avg(rougeL), 6) AS rouge_l, round(avg(num_accuracy), 6) AS num_accuracy"
    clean_pdf_1 = f"(SELECT doc_id, {pictures('text')} AS text FROM documents)"
    clean_pdf_2 = f"({titles(clean_pdf_1)})"
    clean_pdf_3 = f"(SELECT doc_id, {page_numbers('text')} AS text FROM {clean_pdf_2})"
    clean_docx = f"({notes('(' + consecutive(_DOCS) + ')')})"
    years = r"list_transform(list_filter(regexp_extract_all(concat_ws(' ', section, text), '[\p{L}\p{M}\p{N}_]+'), lambda w: regexp_full_match(w, '20[1-3][0-9]년?')), lambda w: w[1:4])"
    kinds = {"실적": "실적 매출 영업이익 순이익 매출액 revenue earnings profit 손익", "리스크": "리스크 위험 risk 충당금 부실 손실 불확실", "전망": "전망 outlook guidance 목표 계획 전략 성장 로드맵 방향"}
    head = "lower(coalesce(section, '') || ' ' || coalesce(text, '')[1:100])"
    type_case = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({head}, {w!r})' for w in ws_.split())} THEN '{k}'" for k, ws_ in kinds.items()) + " END"
    metric_words = "영업이익 순이익 매출 매출액 ROE ROA EPS PER PBR BIS 부채비율 자본 자산 배당 배당수익률 EBITDA 영업현금흐름 잉여현금흐름 FCF 영업이익률 순이익률 시가총액 주가 EV ROIC 레버리지".split()
    is_table = f"(SELECT *, list_filter(list_transform({lines('text')}, lambda l: {strip('l')}), lambda l: l <> '') AS ls FROM {_CHUNKS} WHERE text IS NOT NULL)"
    table_test = "CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda l: starts_with(l, '|') OR ends_with(l, '|'))) / len(ls) >= 0.5 ELSE false END"
    skip = " OR ".join(f"contains(h, '{w}')" for w in ("compliance", "면책", "투자등급", "산업 투자의견", "조사분석자료", "본 자료는", "보도출처"))
    evidence = f"""
WITH s AS (SELECT doc_id, string_agg('[' || section || ']' || chr(10) || array_to_string(list_transform(bullets, lambda b: '- ' || b), chr(10)), chr(10) || chr(10) ORDER BY section_no) AS t FROM {_SECS} WHERE section_no < 3 AND section IS NOT NULL AND bullets IS NOT NULL AND len(list_filter(bullets, lambda b: b IS NULL)) = 0 GROUP BY doc_id),
c AS (SELECT doc_id, string_agg('[원문 ' || n || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_index) AS t FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS n FROM {_CHUNKS} WHERE chunk_index < 3 AND text IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, '## 원문 발췌' || chr(10) || chr(10) || c.t || chr(10) || chr(10) || '## 요약 섹션' || chr(10) || chr(10) || s.t AS context FROM s JOIN c USING (doc_id)"""
    told = {
        "en": "the of and to in is that with each this one", "fr": "le la les des et une du est dans sous par",
        "de": "der die das und ein eine ist am im auf von", "es": "el los las y un del con que por bajo una",
    }
    votes = ", ".join(f"struct_pack(n := len(list_filter(w, lambda x: list_contains({v.split()!r}, x))), k := '{k}')" for k, v in told.items())
    languages = f"SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^가-힣]', '', 'g')) >= 2 THEN 'ko' WHEN best.n > 0 THEN best.k END AS language FROM (SELECT doc_id, text, list_reverse_sort([{votes}])[1] AS best FROM (SELECT doc_id, text, list_transform({_TERMS.format('text')}, lambda x: lower(x)) AS w FROM documents))"
    dims = ["is_image_based", "chunk_size", "chunk_overlap", "temperature", "type", "doc"]
    board = " UNION ALL ".join(f"SELECT {d!r} AS dimension, coalesce(CAST({d} AS VARCHAR), '기본값') AS value, count(*) AS n, {mean}, count(*) FILTER (faithfulness = 'Faithful') AS faithful, round(avg(completeness), 6) AS completeness FROM r {'WHERE type <> ' + repr('other') if d == 'type' else ''} GROUP BY {d}" for d in dims)
    windows = lambda width, slide: f"SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest(generate_series(time_bucket(INTERVAL '{slide} minutes', ts) - INTERVAL '{width - slide} minutes', time_bucket(INTERVAL '{slide} minutes', ts), INTERVAL '{slide} minutes')) AS start FROM events WHERE ts IS NOT NULL) GROUP BY start, event_type"
    return {
        "image_based_sources": f"SELECT source, avg(length({strip(chr(99) + 'oalesce(text, ' + repr('') + ')')})) < 500 AS is_image_based FROM documents GROUP BY source",
        "blank_pages": f"SELECT doc_id, coalesce({strip('text')} = '', true) AS blank, coalesce(contains(text, 'intentionally omitted'), false) AS omitted FROM documents",
        "source_classes": r"SELECT filename, ext, CASE WHEN ext = 'pdf' AND regexp_matches(lower(stem), '실적|분기|연간|ir') THEN 'ir_report' WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('docx', 'doc') THEN 'docx' WHEN ext = 'hwp' THEN 'hwp' ELSE 'generic' END AS source FROM (SELECT DISTINCT filename, lower(regexp_extract(filename, '\.([^./\\]+)$', 1)) AS ext, regexp_replace(filename, '\.[^./\\]*$', '') AS stem FROM doc_metadata)",
        "content_hashes": "SELECT doc_id, sha256(text)[1:16] AS content_hash, sha256(text)[1:16] || '_p0' AS page_key FROM documents WHERE text IS NOT NULL",
        "recognition_cache": "SELECT DISTINCT sha256(text)[1:16] AS content_hash FROM documents WHERE text IS NOT NULL AND sha256(text)[1:16] NOT IN (SELECT sha256(text)[1:16] FROM documents WHERE lang = 'en' AND text IS NOT NULL)",
        "merged_pages": f"SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text FROM (SELECT doc_id, page_no, arg_min(text, reading) AS text FROM {fx('pages')} WHERE {strip('text')} <> '' GROUP BY doc_id, page_no) GROUP BY doc_id",
        "supplemented_pages": rf"SELECT id, CASE WHEN coalesce(nullif(tables, ''), nullif(recognised, '')) IS NOT NULL THEN replace(regexp_replace(text, '\*\*==>?\s*picture\s*\[\d+\s*x\s*\d+\]\s*intentionally omitted\s*<==\*\*\n?', chr(1), 'g'), chr(1), coalesce(nullif(tables, ''), nullif(recognised, ''))) ELSE text END AS text FROM {fx('omitted')}",
        "table_markdown": f"SELECT doc_id, section_no, '| ' || array_to_string(list_transform(chart_spec.labels, lambda c: coalesce(trim(replace(c, chr(10), ' ')), '')), ' | ') || ' |' || chr(10) || '|' || repeat('---|', len(chart_spec.labels)) || chr(10) || '| ' || array_to_string(list_transform(chart_spec.values, lambda c: coalesce(trim(replace(c, chr(10), ' ')), '')), ' | ') || ' |' AS markdown FROM {_SECS} WHERE chart_spec.labels IS NOT NULL AND chart_spec.values IS NOT NULL",
        "tags_to_text": f"SELECT id, {ws('replace(replace(replace(replace(replace(regexp_replace(text, ' + repr('<[^>]+>') + ', ' + repr(' ') + ', ' + repr('g') + '), ' + repr('&nbsp;') + ', chr(160)' + '), ' + repr('&lt;') + ', ' + repr('<') + '), ' + repr('&gt;') + ', ' + repr('>') + '), ' + repr('&quot;') + ', chr(34)), ' + repr('&amp;') + ', ' + repr('&') + ')')} AS text FROM {fx('markup')}",
        "pdf_dates": rf"SELECT id, try_strptime(regexp_extract(text, '^D:(\d{{14}})', 1), '%Y%m%d%H%M%S') AS created_at FROM {fx('dates')}",
        "metadata_by_format": "SELECT lower(m.file_format) AS file_format, count(*) AS files, CAST(sum(m.file_size_bytes) AS BIGINT) AS bytes, CAST(sum(m.page_count) AS BIGINT) AS pages FROM (SELECT filename, max_by(struct_pack(file_size_bytes := file_size_bytes, page_count := page_count, file_format := file_format), (coalesce(file_size_bytes, -1), coalesce(page_count, -1), coalesce(file_format, ''))) AS m FROM doc_metadata GROUP BY filename) GROUP BY 1",
        "repeated_titles": titles(_DOCS),
        "repeated_lines": repeats(_DOCS),
        "consecutive_dedup": consecutive(_DOCS),
        "footnote_dedup": notes(fx("notes")),
        "br_table_dedup": rf"""
WITH p AS (SELECT doc_id, i, a[i] AS part FROM (SELECT doc_id, string_split(replace(replace(replace(replace(text, '<br>', chr(10)), '<br/>', chr(10)), '<br />', chr(10)), chr(10) || '|', chr(1) || chr(10) || '|'), chr(1)) AS a FROM {fx('tables')}) q, UNNEST(range(1, len(a) + 1)) AS u(i)),
k AS (SELECT *, list_filter({lines(strip('part'))}, lambda l: contains(l, '|')) AS t FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN len(t) > 0 THEN regexp_replace(t[1], '[|*{_WS}]', '', 'g')[1:60] ELSE {strip('part')}[1:120] END ORDER BY i) AS rn FROM k)
SELECT doc_id, string_agg(part, '' ORDER BY i) AS text FROM r WHERE rn = 1 GROUP BY doc_id""",
        "page_numbers": f"SELECT doc_id, chunk_index, {page_numbers('text')} AS text FROM {_CHUNKS}",
        "empty_bullets": f"SELECT doc_id, {bullets('text')} AS text FROM documents",
        "normalize_ws": f"SELECT doc_id, {ws('text')} AS text FROM documents",
        "css_blocks": rf"SELECT id, regexp_replace(regexp_replace(text, '(?s)<style[^>]*>.*?</style>', '', 'g'), '(?s)\.[A-Za-z][\w\-]*[^{{]*\{{[^}}]*\}}', '', 'g') AS text FROM {fx('markup')}",
        "picture_marks": f"SELECT id, {pictures('text')} AS text FROM {fx('omitted')}",
        "clean_generic": f"SELECT doc_id, {ws(bullets('text'))} AS text FROM documents",
        "clean_pdf": f"SELECT doc_id, {ws(bullets('text'))} AS text FROM ({repeats(clean_pdf_3)})",
        "clean_docx": f"SELECT doc_id, {ws(bullets(notice('text')))} AS text FROM {clean_docx}",
        "heading_sections": _SECTIONS,
        "skipped_sections": f"SELECT doc_id, chunk_index FROM (SELECT doc_id, chunk_index, lower(coalesce(section, '') || ' ' || coalesce({lines('text')}[1], '')) AS h FROM {_CHUNKS} WHERE text IS NOT NULL) WHERE {skip}",
        "paragraph_chunks": f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS para_no, {strip('a[i]')} AS text FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS a FROM documents WHERE text IS NOT NULL) q, UNNEST(range(1, len(a) + 1)) AS u(i) WHERE {strip('a[i]')} <> ''",
        "fixed_windows": "SELECT doc_id, CAST(i // 500 AS INTEGER) AS window_no, substring(text, i + 1, 700) AS text FROM documents, UNNEST(range(0, greatest(length(text) - 201, 0) + 1, 500)) AS u(i) WHERE text IS NOT NULL AND text <> ''",
        "table_blocks": f"SELECT doc_id, chunk_index, {table_test} AS is_table FROM {is_table}",
        "table_dedup": rf"SELECT doc_id, chunk_index, key FROM (SELECT doc_id, chunk_index, regexp_replace(coalesce({lines(strip('text'))}[1], ''), '[|{_WS}]', '', 'g')[1:60] AS key, {table_test} AS t FROM {is_table}) WHERE t QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY chunk_index) = 1",
        "numbered_chunks": f"SELECT doc_id, chunk_index AS source_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS INTEGER) AS chunk_index FROM {_CHUNKS} c WHERE length({strip('text')}) >= 50".replace("chunk_index AS source_index", "c.chunk_index AS source_index").replace("ORDER BY chunk_index) - 1", "ORDER BY c.chunk_index) - 1"),
        "doc_years": f"SELECT doc_id, chunk_index, (SELECT y FROM (SELECT unnest({years}) AS y) GROUP BY y ORDER BY count(*) DESC, y DESC LIMIT 1) AS doc_year FROM {_CHUNKS}",
        "section_types": f"SELECT doc_id, chunk_index, {type_case} AS section_type FROM {_CHUNKS}",
        "metric_terms": f"SELECT doc_id, chunk_index, list_sort(list_filter({metric_words!r}, lambda w: contains(text, w))) AS metrics FROM {_CHUNKS} WHERE text IS NOT NULL",
        "token_stats": f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT scope, item, term, count(*) AS tf FROM (SELECT scope, item, unnest({_TERMS.format('text')}) AS term FROM {_CORPUS} WHERE text IS NOT NULL) GROUP BY ALL) GROUP BY term",
        "bm25_topk": f"WITH {bm25(_CORPUS, _FIRST, 5)} SELECT q1 AS doc_id, q2 AS section_no, item AS chunk_index, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits",
        "bm25_sections": f"WITH {bm25(_SEC_CORPUS, _TITLE, 3)} SELECT q1 AS doc_id, q2 AS section_no, item AS found_no, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits",
        "rrf_fusion": _RRF,
        "rerank_topk": f"SELECT doc_id, section_no, text, r AS rank FROM ({_RERANK})",
        "dense_topk": dense(""),
        "dense_topk_filtered": dense("AND q.label = v.label"),
        "collection_names": "SELECT DISTINCT filename, 'doc_' || md5(filename)[1:8] AS collection FROM doc_metadata",
        "best_bullet": f"SELECT doc_id, section_no, b AS bullet FROM (SELECT doc_id, section_no, bullets[i] AS b, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY len(list_intersect({_TERMS.format('chart_spec.title')}, {_TERMS.format('bullets[i]')})) DESC, i) AS rn FROM {_SECS}, UNNEST(range(1, len(bullets) + 1)) AS u(i) WHERE chart_spec.title IS NOT NULL AND len(list_filter(bullets, lambda x: x IS NULL)) = 0) WHERE rn = 1",
        "context_build": evidence,
        "unanswerable": f"SELECT id, coalesce(contains(prediction, '문서에서 해당 내용을 찾을 수 없') OR contains(prediction, '문서에서 확인할 수 없') OR contains(prediction, '제공된 문서에는 해당 내용이 없') OR contains(prediction, '해당 정보는 문서에 포함되어 있지 않'), false) AS unanswerable FROM {_PAIRS}",
        "tilde_fix": rf"SELECT id, regexp_replace(text, '(\d+\.?\d*)~+(\d+\.?\d*)', '\1-\2', 'g') AS text, {strip(chr(114) + 'egexp_replace(text, ' + repr('[[]OCR [^]]*[]]|[[]OCR[]]|※ 이미지 기반 PDF[^' + chr(92) + 'n]*|원문:[ ]*[^]]*').replace(chr(92) * 2, chr(92)) + ', ' + repr('') + ', ' + repr('g') + ')')} AS plain FROM {fx('tildes')}",
        "bullet_budgets": f"SELECT doc_id, CASE WHEN count(*) <= 10 THEN 5 WHEN count(*) <= 25 THEN 8 ELSE 12 END AS bullets FROM {_CHUNKS} GROUP BY doc_id",
        "multi_doc_merge": f"SELECT qa_id, string_agg('=== ' || d.doc_id || ' ===' || chr(10) || d.text, chr(10) || chr(10) ORDER BY i) AS text, string_agg('[' || d.doc_id || ']' || chr(10) || d.overall, chr(10) || chr(10) ORDER BY i) AS overall, bool_or(d.is_image_based) AS is_image_based, count(*) AS n_docs FROM (SELECT qa_id, i, trim(a[i]) AS doc_id FROM (SELECT qa_id, string_split(doc, ',') AS a FROM {fx('merge_groups')}) q, UNNEST(range(1, len(a) + 1)) AS u(i)) g LEFT JOIN {fx('merge_docs')} d USING (doc_id) GROUP BY qa_id HAVING bool_and(coalesce(d.status = 'ok', false))",
        "chart_route": f"{_FIG} SELECT doc_id, section_no, CASE WHEN ok THEN k END AS kind, CAST(CASE WHEN ok AND k <> 'multiline' THEN len(v) END AS INTEGER) AS points, CAST(CASE WHEN ok AND k = 'multiline' THEN len(tr) END AS INTEGER) AS traces, CASE WHEN ok THEN CASE k WHEN 'waterfall' THEN 300 WHEN 'multiline' THEN 320 ELSE 260 END END AS height FROM f",
        "bar_colours": f"{_FIG} SELECT doc_id, section_no, array_to_string(list_transform(v, lambda x: CASE WHEN x >= 0 THEN '#4C78A8' ELSE '#E45756' END), ',') AS colours, len(list_filter(v, lambda x: x < 0)) > 0 AS zero_line FROM f WHERE ok AND k = 'bar'",
        "waterfall_measures": f"{_FIG} SELECT doc_id, section_no, array_to_string(list_transform(c.labels[1:len(v)], lambda x, i: CASE WHEN i = len(v) AND ({' OR '.join(f'contains(lower(x), {w!r})' for w in ('합계', '순이익', 'net profit', 'net income', 'total', 'ebitda'))}) THEN 'total' ELSE 'relative' END), ',') AS measures, array_to_string(list_transform(v, lambda x: CAST(round(x, 6) AS VARCHAR)), ',') AS bars FROM f WHERE ok AND k = 'waterfall'",
        "document_languages": languages,
        "chart_budget": f"{_FIG} SELECT doc_id, section_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_no) AS INTEGER) AS chart_no FROM f WHERE ok QUALIFY chart_no <= 2",
        "numbers_extract": f"SELECT doc_id, section_no, CAST(i - 1 AS INTEGER) AS pos, array_to_string({numbers('bullets[i]')}, '|') AS numbers FROM {_SECS}, UNNEST(range(1, len(bullets) + 1)) AS u(i) WHERE bullets[i] IS NOT NULL",
        "numerical_accuracy": f"SELECT id, CASE WHEN len(want) = 0 THEN 1.0 ELSE round(len(list_filter(want, lambda n: list_contains(have, n))) / len(want), 4) END AS accuracy, array_to_string(list_filter(want, lambda n: list_contains(have, n)), '|') AS matched FROM (SELECT id, {numbers('reference')} AS want, {numbers('prediction')} AS have FROM {_PAIRS} WHERE prediction IS NOT NULL AND reference IS NOT NULL)",
        "entity_coverage": _ENTITY,
        "rouge1": rouge(1),
        "rouge2": rouge(2),
        "semantic_similarity": "SELECT a.vec_id, round(greatest(0.0, least(1.0, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))), 4) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
        "leaderboard": f"WITH r AS ({rec}) SELECT 'overall' AS dimension, '' AS value, count(*) AS n, {mean}, count(*) FILTER (faithfulness = 'Faithful') AS faithful, round(avg(completeness), 6) AS completeness FROM r UNION ALL {board}",
        "faithful_rate": f"WITH r AS ({rec}) SELECT doc, count(*) FILTER (faithfulness = 'Faithful') || '/' || count(*) || ' (' || printf('%.1f', 100.0 * count(*) FILTER (faithfulness = 'Faithful') / count(*)) || '%)' AS rate FROM r GROUP BY doc",
        "combo_report": f"WITH r AS ({rec}) SELECT chunk_size, chunk_overlap, count(*) AS n, {mean}, round(count(*) FILTER (faithfulness = 'Faithful') / count(*), 6) AS faithful_share FROM r WHERE (chunk_size, chunk_overlap) IN ((500, 50), (500, 100), (700, 50)) GROUP BY ALL",
        "doc_label_report": f"WITH r AS ({rec}) SELECT coalesce(l.label, r.doc[1:30]) AS label, count(*) AS n, {mean}, coalesce(round(avg(completeness), 6), 0.0) AS completeness FROM r LEFT JOIN {fx('labels')} l ON r.doc = l.doc GROUP BY 1",
        "summary_report": f"WITH r AS ({rec}) " + " UNION ALL ".join(f"SELECT {d!r} AS dimension, CAST({d} AS VARCHAR) AS value, count(*) AS n, {mean} FROM r {'WHERE (SELECT count(DISTINCT doc_mode) FROM r) > 1' if d == 'doc_mode' else ''} GROUP BY {d}" for d in ("qa_set", "type", "doc_mode")),
        "sweep_cross": f"SELECT doc_id AS doc, section_no, s AS chunk_size, o AS chunk_overlap FROM {_SECS} SEMI JOIN (SELECT filename AS doc_id FROM doc_metadata) m USING (doc_id), (VALUES (300), (500), (700)) a(s), (VALUES (50), (100), (200)) b(o)",
        "stage_elapsed": f"SELECT thread_id, stage, started, round(seconds, 6) AS seconds FROM (SELECT user_id AS thread_id, ts AS started, regexp_extract(e, '^(.*)_(start|done)$', 1) AS stage, regexp_extract(e, '_(start|done)$', 1) AS kind, lead(kind) OVER w AS nk, CASE WHEN nk = 'done' THEN (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 END AS seconds FROM (SELECT user_id, ts, {fixtures.STAGE_EVENT} AS e FROM events) WHERE e <> 'other' WINDOW w AS (PARTITION BY user_id, regexp_extract(e, '^(.*)_(start|done)$', 1) ORDER BY ts, regexp_extract(e, '_(start|done)$', 1) DESC)) WHERE kind = 'start'",
        "feedback_counts": "SELECT CASE WHEN value = 1 THEN 'up' ELSE 'down' END AS verdict, count(*) AS n FROM (SELECT id, any_value(value) AS value FROM feedbacks GROUP BY id) GROUP BY 1",
        "tumbling_windows": windows(60, 60),
        "sliding_windows": windows(60, 15),
        "session_windows": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS s FROM events)) GROUP BY user_id, g",
    }
