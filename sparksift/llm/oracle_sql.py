"""Some operators once more, as plain DuckDB SQL: every block with every template, every page with every rule, every document with every item."""

from __future__ import annotations

from . import hosts, infill, licenses, reverse_search


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values: list[str]) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


PLAIN = r"trim(regexp_replace(lower({}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"
SPLIT = "CASE WHEN {0} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({0}, ' ') END"


def license_sql() -> str:
    phrases = ", ".join(f"({words(p.split())}, {text(label)})" for p, label in licenses.PHRASES.items())
    templates = ", ".join(
        f"({text(label)}, {words(s)}, {licenses.least_common(len(s))}, {n})" for (label, s), n in zip(licenses.template_sets(), licenses.block_lengths(), strict=True)
    )
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT doc_id, {SPLIT.format('plain')} AS w FROM (SELECT doc_id, {PLAIN.format('text')} AS plain FROM docs)),
phrases(p, label) AS (VALUES {phrases}),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(len(w) - len(p) + 1), lambda i: w[i + 1 : i + len(p)] = p)) AS place FROM worded, phrases WHERE len(w) >= len(p)),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY doc_id),
templates(label, t, alpha, length) AS (VALUES {templates}),
near AS (SELECT * FROM worded, templates WHERE len(list_intersect(list_distinct(w), t)) >= alpha),
held AS (
  SELECT doc_id, label, len(t) AS size, alpha, list_max(list_transform(range(len(w)), lambda i: len(list_intersect(list_distinct(w[i + 1 : i + length]), t)))) AS n FROM near),
own AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(CAST(n AS DOUBLE) / size) AS share FROM held WHERE n >= alpha GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(o.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(o.share, 0.0::DOUBLE) END AS score
FROM worded d LEFT JOIN base b ON d.doc_id = b.doc_id LEFT JOIN own o ON d.doc_id = o.doc_id
"""


STRENGTH = f"""1.0 / greatest({hosts.LEAST_RHO}, least({hosts.MOST_RHO}, coalesce(
    (sum((k - n * m) * (k - n * m)) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), {hosts.MOST_RHO}))) - 1"""


def url_sql() -> str:
    rules = ", ".join(f"({text(kind)}, {text(h)}, {text(p)})" for kind, h, p in hosts.RULES)
    two = ", ".join(map(text, hosts.TWO_LABEL_SUFFIXES))
    return rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS raw FROM rest),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM cut),
rules(kind, h, p) AS (VALUES {rules}),
fits AS (SELECT DISTINCT host, path, kind, concat(h, p) AS rule FROM urls, rules WHERE (host = h OR ends_with(host, concat('.', h))) AND starts_with(path, p)),
ruled AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(kind, length(rule)) AS kind FROM fits GROUP BY host, path),
outcomes AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1.0 WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0.0 END) AS bad FROM labels GROUP BY doc_id),
bare AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS b FROM urls),
hosts AS (
  SELECT host, CASE WHEN regexp_matches(b, '{hosts.ADDRESS}') THEN b WHEN regexp_extract(b, '[^.]*\.?[^.]*$') IN ({two}) THEN regexp_extract(b, '[^.]*\.?[^.]*\.?[^.]*$')
      ELSE regexp_extract(b, '[^.]*\.?[^.]*$') END AS domain,
    CASE WHEN regexp_matches(b, '{hosts.ADDRESS}') THEN b WHEN regexp_extract(b, '[^.]*\.?[^.]*$') IN ({two}) THEN regexp_extract(b, '[^.]*\.?[^.]*$') ELSE regexp_extract(b, '[^.]*$') END AS suffix,
    CAST(count(bad) AS DOUBLE) AS n, coalesce(sum(bad), 0.0) AS k
  FROM bare LEFT JOIN outcomes ON page_id = doc_id GROUP BY host, b),
s1 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1.0) / (sum(n) + 2.0) FROM hosts) AS m FROM hosts GROUP BY suffix),
s2 AS (SELECT suffix, (k + m * g) / (n + g) AS m FROM s1, (SELECT {STRENGTH} AS g FROM s1)),
d1 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM hosts JOIN s2 USING (suffix) GROUP BY domain, suffix),
d2 AS (SELECT domain, suffix, (k + m * g) / (n + g) AS m FROM d1, (SELECT {STRENGTH} AS g FROM d1)),
h1 AS (SELECT host, n, k, m FROM hosts JOIN d2 USING (domain, suffix)),
h2 AS (SELECT host, n + g AS total, (k + m * g) / (n + g) AS mean FROM h1, (SELECT {STRENGTH} AS g FROM h1))
SELECT page_id, u.host, u.path, rule, coalesce(kind, CASE WHEN mean - {hosts.Z} * sqrt(mean * (1 - mean) / (total + 1)) > {hosts.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM urls u JOIN h2 USING (host) LEFT JOIN ruled r ON u.host = r.host AND u.path = r.path
"""


def infill_sql() -> str:
    draw = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
    sentinels = " OR ".join(f"contains(t, '{s}')" for s in (infill.PREFIX, infill.SUFFIX, infill.MIDDLE))
    part = "array_to_string(list_slice(lines, {}, {}), '')"
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{infill.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
lined AS (SELECT *, CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_extract_all(t, '[^\n]*\n|[^\n]+') END AS lines FROM docs),
drawn AS (
  SELECT doc_id, t, lines, CAST(len(lines) AS BIGINT) AS n, {draw.format(1)} % (len(lines) + 1) AS x, {draw.format(9)} % (len(lines) + 1) AS y,
    CASE WHEN t = '' OR {sentinels} OR {draw.format(17)} % 100 >= {infill.RATE} THEN 'plain' WHEN {draw.format(25)} % 100 < {infill.SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form
  FROM lined),
parts AS (SELECT doc_id, n, form, t, {part.format(1, 'least(x, y)')} AS p, {part.format('least(x, y) + 1', 'greatest(x, y)')} AS m, {part.format('greatest(x, y) + 1', 'n')} AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{infill.PREFIX}' || p || '{infill.SUFFIX}' || s || '{infill.MIDDLE}' || m
    ELSE '{infill.SUFFIX}' || s || '{infill.PREFIX}' || p || '{infill.MIDDLE}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""


def search_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = rf"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
WITH asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark) GROUP BY item_id, term),
docs AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS terms FROM documents),
totals AS (SELECT count(*) AS big_n, sum(len(terms))::BIGINT AS big_l FROM docs WHERE len(terms) > 0),
held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, totals GROUP BY term),
sized AS (SELECT r, doc_id, 75 + (25 * len(terms) * big_n) // big_l AS m FROM docs, totals),
scores AS (
  SELECT item_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sized USING (r) GROUP BY item_id, r),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores JOIN docs USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {reverse_search.TOP}
"""
