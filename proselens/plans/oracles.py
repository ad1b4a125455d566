"""DuckDB SQL for the prose rules, over the same seeded texts. Written apart from the DataFrame plans: RE2 has neither
look-around nor match places, so a place is the length of what stands before the leftmost match."""

from __future__ import annotations

import re

from proselens.functions import lexicon as L
from proselens.functions.patterns import exact_re2, re2
from proselens.operators import prose as R
from proselens.plans.seeds import PAGES_SQL, SEEDED_SQL


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def before(text: str, pattern: str, flags: str) -> str:
    """SQL for the part of `text` before the leftmost match."""
    return f"regexp_replace({text}, {q(f'(?s{flags})(?:{pattern})' + '.*$')}, '')"


LINES = "lines AS (SELECT path, unnest(range(len(l))) AS i, unnest(l) AS s FROM (SELECT path, string_split(text, chr(10)) AS l FROM seeded))"
WORDS = "len(list_filter(string_split_regex({t}, '\\s+'), w -> w <> ''))"


def n_words(text: str) -> str:
    return WORDS.replace("{t}", text)


def with_(*parts: str) -> str:
    return "WITH " + ", ".join((SEEDED_SQL, *parts)) + " "


def line_rule(code: str, pattern: str, flags: str = "i", unless: str | None = None, where: str = "", plus: str = "0") -> str:
    full = f"(?{flags}){pattern}" if flags else pattern
    also = f" AND NOT regexp_matches(s, {q(unless)})" if unless else ""
    return with_(LINES) + f"SELECT '{code}' AS code, path, CAST(i + 1 AS INTEGER) AS line, CAST(length({before('s', pattern, flags)}) + 1 + {plus} AS INTEGER) AS col FROM lines WHERE regexp_matches(s, {q(full)}){also}{where}"


def place(pre: str) -> str:
    return f"CAST(length({pre}) - length(replace({pre}, chr(10), '')) + 1 AS INTEGER) AS line, CAST(length(string_split({pre}, chr(10))[-1]) + 1 AS INTEGER) AS col"


def dense(code: str, pattern: str, least: int, repeats: int = 2) -> str:
    pat = exact_re2(pattern)
    found = f"found AS (SELECT path, text, list_transform(regexp_extract_all(text, {q('(?i)' + pat)}), x -> lower(x)) AS m, {n_words('text')} AS n FROM seeded)"
    return with_(found) + f"SELECT '{code}' AS code, path, {place(before('text', pat, 'i'))} FROM found WHERE len(m) > 0 AND (len(m) >= greatest({least}, ceil({least} * n / 1000.0)) OR len(list_filter(list_distinct(m), x -> len(list_filter(m, y -> y = x)) >= {repeats})) > 0)"


def both(panels) -> str:
    return exact_re2(R.any_of(panels))


PARAGRAPHS = (
    LINES
    + ", numbered AS (SELECT *, sum(CASE WHEN regexp_full_match(s, '\\s*') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS g FROM lines)"
    + f", paragraphs AS (SELECT path, min(i) + 1 AS first, string_agg(s, chr(10) ORDER BY i) AS text FROM numbered WHERE NOT regexp_full_match(s, '\\s*') GROUP BY path, g HAVING NOT bool_or(regexp_matches(s, {q(R.NOT_PROSE)})))"
)
_MARKED = r"""string_split(regexp_replace(text, '([.!?]+["'')\]]*)\s+', '\1' || chr(1), 'g'), chr(1))"""
_MARKED_WHOLE = r"""string_split(regexp_replace(text, '([.!?]+["'')\]]*\s+)', '\1' || chr(1), 'g'), chr(1))"""


def sql() -> dict[str, str]:
    out = {
        "PL011": line_rule("PL011", f"{both(L.RESIDUE)}|{both(L.RESIDUE_EDGES)}"),
        "PL012": line_rule("PL012", exact_re2(L.TOOL_TOKENS), ""),
        "PL013": line_rule("PL013", exact_re2(f"(?i:{L.TEMPLATE_BRACKET})|{L.TEMPLATE_CAPITALS}"), ""),
        "PL014": line_rule("PL014", both(L.CLICHE)),
        "PL024": line_rule("PL024", both(L.PUFFERY)),
        "PL025": line_rule("PL025", both(L.WEASEL), unless=exact_re2(L.CITED)),
        "PL015": dense("PL015", R.any_of(L.HEDGING), 3),
        "PL031": dense("PL031", R.any_of(L.PROMO), 3),
        "PL032": dense("PL032", L.HYPHENS, 4, 3),
    }
    opener = exact_re2(f"{L.SENTENCE_START}({R.any_of(L.OPENERS)})")
    out["PL022"] = line_rule("PL022", opener, plus=f"length(regexp_extract(s, {q('(?i)' + opener)}, 0)) - length(regexp_extract(s, {q('(?i)' + opener)}, 1))")
    denial = exact_re2(f"{L.SENTENCE_START}({L.NEGATIVE_LISTING})")
    listed_ = line_rule("PL023", denial, plus=f"length(regexp_extract(s, {q('(?i)' + denial)}, 0)) - length(regexp_extract(s, {q('(?i)' + denial)}, 1))")
    out["PL023"] = f"SELECT code, path, line, min(col) AS col FROM (SELECT * FROM ({line_rule('PL023', both(L.CONTRAST))}) UNION ALL SELECT * FROM ({listed_})) GROUP BY ALL"
    reveal = both(L.REVEAL)
    out["PL026"] = line_rule("PL026", reveal, "", plus=f"length(regexp_extract(regexp_extract(s, {q(reveal)}, 0), {q('^(?:[.!?]' + chr(92) + 's+|[ ' + chr(92) + 't]*)')}, 0))", where=f" AND NOT regexp_matches(s, {q(R.HEADING)})")
    strong, weak, either = exact_re2(L.VOCABULARY_STRONG), exact_re2(L.VOCABULARY_WEAK), exact_re2(f"(?:{L.VOCABULARY_STRONG}|{L.VOCABULARY_WEAK})")
    found = f"found AS (SELECT path, text, {n_words('text')} AS n, 2 * len(regexp_extract_all(text, {q('(?i)' + strong)})) + len(regexp_extract_all(text, {q('(?i)' + weak)})) AS w, len(list_distinct(list_transform(regexp_extract_all(text, {q('(?i)' + either)}), x -> lower(x[1:6])))) AS k FROM seeded)"
    out["PL016"] = with_(found) + f"SELECT 'PL016' AS code, path, {place(before('text', either, 'i'))} FROM found WHERE CASE WHEN n >= 250 THEN floor(w * 1000 / n) >= 12 AND k >= 6 ELSE w >= 6 AND k >= 4 END"
    triple, negative, trailing = exact_re2(L.TRICOLON), both(L.NEGATIVE_PARALLELISM), exact_re2(R.any_of(L.TRAILING_PARTICIPLE))
    found = f"found AS (SELECT path, text, len(regexp_extract_all(text, {q(triple)})) AS a, len(regexp_extract_all(text, {q('(?i)' + negative)})) + len(regexp_extract_all(text, {q(trailing)})) AS b, CASE WHEN regexp_matches(text, {q('(?i)' + negative)}) THEN length({before('text', negative, 'i')}) END AS n1, CASE WHEN regexp_matches(text, {q(trailing)}) THEN length({before('text', trailing, '')}) END AS n2, length({before('text', triple, '')}) AS n3 FROM seeded)"
    out["PL017"] = with_(found) + f", at_ AS (SELECT path, left(text, CASE WHEN b >= 2 THEN least(n1, n2) ELSE n3 END) AS pre FROM found WHERE b >= 2 OR a >= 3) SELECT 'PL017' AS code, path, {place('pre')} FROM at_"
    hidden = r"regexp_replace(regexp_replace(s, '(\d ?)–( ?\d)', '\1' || chr(2) || '\2', 'g'), '^(\s*(?:[-*+>]\s+)*)[—–]', '\1' || chr(2))"
    out["PL018"] = with_(LINES) + f", parts AS (SELECT path, i, string_split_regex({hidden}, '[—–]') AS p FROM lines WHERE regexp_matches(s, '[—–]')), each_ AS (SELECT path, i, p, unnest(range(1, len(p))) AS k FROM parts) SELECT 'PL018' AS code, path, CAST(i + 1 AS INTEGER) AS line, CAST(list_sum(list_transform(p[1:k], x -> length(x))) + k AS INTEGER) AS col FROM each_"
    bold = r"\*\*[^*\n]+\*\*"
    lead = r"^\s*(?:[-*+]|\d+[.)])\s+\*\*[^*\n]+(?:\*\*:|:\*\*|\*\*\s+[-–—]|\*\*)"
    out["PL019"] = with_(LINES) + f", many AS (SELECT path, text FROM seeded WHERE len(regexp_extract_all(text, {q(bold)})) >= 4 AND 40 * len(regexp_extract_all(text, {q(bold)})) > {n_words('text')}), items AS (SELECT path, i, i - row_number() OVER (PARTITION BY path ORDER BY i) AS g FROM lines WHERE regexp_matches(s, {q(lead)})), runs AS (SELECT path, min(i) AS i FROM items GROUP BY path, g HAVING count(*) >= 3) SELECT 'PL019' AS code, path, {place(before('text', bold, ''))} FROM many UNION ALL SELECT 'PL019', path, CAST(min(i) + 1 AS INTEGER), 1 FROM runs GROUP BY path"
    out["PL020"] = with_() + f"SELECT 'PL020' AS code, path, {place(before('text', '[‘’“”]', ''))} FROM seeded WHERE len(regexp_extract_all(text, '[‘’“”]')) >= 2"
    small = ", ".join(f"'{w}'" for w in "a an and as at but by for from in nor of on or the to with de da do das dos e em para por com o os um uma".split())
    heads = f"heads AS (SELECT path, i, list_filter(string_split_regex(regexp_replace(s, '^ {{0,3}}#{{1,6}}\\s+|\\s+#*\\s*$', '', 'g'), '\\s+'), x -> x <> '') AS w FROM lines WHERE regexp_matches(s, {q(R.HEADING)})), judged AS (SELECT path, i, list_filter(w, x -> regexp_matches(x, '^\\p{{L}}') AND lower(x) NOT IN ({small})) AS plain FROM heads WHERE len(w) >= 3)"
    body = "CASE WHEN NOT h THEN s END"
    sections = f"marked AS (SELECT *, regexp_matches(s, {q(R.HEADING)}) AS h FROM lines), numbered AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS g FROM marked), per AS (SELECT path, g, min(i) AS i, max(CASE WHEN h THEN length(regexp_extract(s, '^ {{0,3}}(#{{1,6}})', 1)) END) AS level, max(CASE WHEN h THEN lower(trim(regexp_replace(s, '^ {{0,3}}#{{1,6}}\\s+|\\s+#*\\s*$', '', 'g'))) END) AS title, coalesce(sum({n_words(body)}), 0) AS n, coalesce(sum(len(regexp_extract_all({body}, '[.!?](?:\\s|$)'))), 0) AS ends, coalesce(bool_or(regexp_matches({body}, '^\\s*(?:```|~~~|[|])')), false) AS other FROM numbered WHERE g > 0 GROUP BY path, g), after_ AS (SELECT *, lead(level) OVER (PARTITION BY path ORDER BY g) AS after, count(*) OVER (PARTITION BY path) AS heads FROM per), thin AS (SELECT path, i FROM after_ WHERE heads >= 2 AND n < 25 AND ends < 2 AND NOT other AND NOT (g = 1 AND level = 1) AND NOT coalesce(after > level, false) AND title NOT IN ({', '.join(q(x) for x in R.REFERENCES)}))"
    out["PL021"] = with_(LINES, heads, sections) + f"SELECT 'PL021' AS code, path, CAST(min(i) + 1 AS INTEGER) AS line, 1 AS col FROM judged GROUP BY path HAVING count(*) >= 3 AND count(*) FILTER (len(list_filter(plain, x -> regexp_matches(x, '^\\p{{Lu}}'))) >= 0.8 * len(plain) AND len(plain) >= 2) >= 0.75 * count(*) UNION ALL SELECT 'PL021', path, CAST(min(i) + 1 AS INTEGER), 1 FROM lines WHERE regexp_matches(s, {q(R.EMOJI_LINE)}) GROUP BY path HAVING count(*) >= 2 UNION ALL SELECT 'PL021', path, CAST(min(i) + 1 AS INTEGER), 1 FROM thin GROUP BY path HAVING count(*) >= 2"
    said, adverb = both(L.FILLER), exact_re2(L.FILLER_ADVERB)
    found = f"found AS (SELECT path, text, list_transform(regexp_extract_all(text, {q('(?i)' + said)}), x -> lower(x)) AS m, len(regexp_extract_all(text, {q('(?im)' + adverb)})) AS a, {n_words('text')} AS n FROM seeded)"
    out["PL027"] = with_(found) + f"SELECT 'PL027' AS code, path, {place(before('text', f'{said}|{adverb}', 'im').replace('.*$', '(?-m:.*$)'))} FROM found WHERE 2 * len(m) + a >= greatest(6, ceil(6 * n / 1000.0)) OR len(m) > len(list_distinct(m))"
    vague, any_ = both(L.VAGUE), exact_re2(f"(?:{R.any_of(L.WEAK_VERB)}|{R.any_of(L.VAGUE)})")
    shown = f"array_to_string(list_transform(string_split(text, chr(10)), s -> CASE WHEN regexp_matches(s, '[0-9]') THEN regexp_replace(s, {q('(?i)' + vague)}, ' ', 'g') ELSE s END), chr(10))"
    out["PL028"] = with_(f"shown AS (SELECT path, {shown} AS text, {n_words('text')} AS n FROM seeded)", f"found AS (SELECT *, list_transform(regexp_extract_all(text, {q('(?i)' + any_)}), x -> lower(x)) AS m FROM shown)") + f"SELECT 'PL028' AS code, path, {place(before('text', any_, 'i'))} FROM found WHERE len(m) > 0 AND (len(m) >= greatest(3, ceil(3 * n / 1000.0)) OR len(m) > len(list_distinct(m)))"
    recap, end = both(L.RECAP), exact_re2(f"(?:{R.any_of(L.KICKER)}|{R.any_of(L.POSITIVE_END)})")
    out["PL029"] = with_(PARAGRAPHS) + f", last_ AS (SELECT path, max_by(text, first) AS text, max(first) AS first FROM paragraphs GROUP BY path) SELECT 'PL029' AS code, path, CAST(first AS INTEGER) AS line, 1 AS col FROM last_ WHERE (regexp_matches(text, {q('(?i)' + recap)}) AND {n_words('text')} <= 20) OR (regexp_matches(text, {q('(?i)' + end)}) AND {n_words('text')} <= 12)"
    out["PL030"] = with_(PARAGRAPHS) + f", cut AS (SELECT path, first, list_filter({_MARKED}, x -> regexp_matches(x, '\\S')) AS s FROM paragraphs), counted AS (SELECT path, first, list_transform(s, x -> {n_words('x')}) AS n, list_transform(s, x -> regexp_matches(x, '(?i)^\\s*(?:and|but|or)\\b')) AS c FROM cut) SELECT 'PL030' AS code, path, CAST(first AS INTEGER) AS line, 1 AS col FROM counted WHERE len(list_filter(range(1, len(n) - 1), k -> n[k] <= 5 AND n[k + 1] <= 5 AND n[k + 2] <= 5)) > 0 OR len(list_filter(range(1, len(n)), k -> c[k] AND c[k + 1])) > 0 OR (len(n) >= 4 AND list_max(n) - list_min(n) <= 2)"
    out["PL033"] = with_(PARAGRAPHS) + f", cut AS (SELECT path, first, text, {_MARKED_WHOLE} AS p FROM paragraphs), each_ AS (SELECT path, first, text, p, unnest(range(1, len(p) + 1)) AS k FROM cut), long AS (SELECT path, first, left(text, CAST(coalesce(list_sum(list_transform(p[1:k - 1], x -> length(x))), 0) AS BIGINT)) AS pre FROM each_ WHERE {n_words('p[k]')} > 50) SELECT 'PL033' AS code, path, CAST(first + length(pre) - length(replace(pre, chr(10), '')) AS INTEGER) AS line, CAST(length(string_split(pre, chr(10))[-1]) + 1 AS INTEGER) AS col FROM long"
    forms = ", ".join(f"('{f}', '{g}', '{m}')" for f, g, m in R.synonym_forms())
    out["PL034"] = with_(PARAGRAPHS, f"forms(form, grp, member) AS (VALUES {forms})") + ", tokens AS (SELECT path, first, unnest(range(len(w))) AS k, unnest(w) AS t FROM (SELECT path, first, list_filter(string_split_regex(text, '\\s+'), x -> x <> '') AS w FROM paragraphs)), hits AS (SELECT path, first, k, grp, member FROM tokens JOIN forms ON form = lower(regexp_replace(t, '^[^\\p{L}]+|[^\\p{L}]+$', '', 'g'))), near AS (SELECT path, grp, first, list(member) OVER (PARTITION BY path, grp, first ORDER BY k RANGE BETWEEN 199 PRECEDING AND CURRENT ROW) AS m FROM hits) SELECT 'PL034' AS code, path, CAST(min(first) AS INTEGER) AS line, 1 AS col FROM near WHERE len(list_filter(list_distinct(m), x -> len(list_filter(m, y -> y = x)) >= 2)) >= 2 GROUP BY path, grp"
    title = "lower(trim(regexp_replace(s, '^ {0,3}#{1,6}\\s+|\\s+#*\\s*$', '', 'g')))"
    listed = lambda names: ", ".join(q(x) for x in sorted(names))
    body = both(L.FILLER_BODY)
    out["PL035"] = with_(LINES) + f"SELECT 'PL035' AS code, path, CAST(i + 1 AS INTEGER) AS line, 1 AS col FROM lines WHERE regexp_matches(s, {q(R.HEADING)}) AND {title} IN ({listed(L.FILLER_HEADINGS)}) UNION ALL SELECT 'PL035', path, CAST(i + 1 AS INTEGER), CAST(length({before('s', body, 'i')}) + 1 AS INTEGER) FROM lines WHERE regexp_matches(s, {q('(?i)' + body)})"
    diff = both(L.DIFF)
    out["PL036"] = with_(LINES) + f", under AS (SELECT *, last_value(CASE WHEN regexp_matches(s, {q(R.HEADING)}) THEN {title} END IGNORE NULLS) OVER (PARTITION BY path ORDER BY i) AS h FROM lines) SELECT 'PL036' AS code, path, CAST(i + 1 AS INTEGER) AS line, CAST(length({before('s', diff, 'i')}) + 1 AS INTEGER) AS col FROM under WHERE regexp_matches(s, {q('(?i)' + diff)}) AND NOT coalesce(h IN ({listed(L.DIFF_HEADINGS)}), false) AND NOT regexp_matches(path, {q(R.DIFF_PATHS)})"
    out["PL041"] = with_() + f", rows_ AS (SELECT path, list_transform(list_filter(string_split_regex(text, '\\s+'), x -> x <> ''), x -> lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}''-]', '', 'g'))) AS w, list_transform(list_filter({_MARKED}, x -> regexp_matches(x, '\\S')), x -> {n_words('x')}) AS n FROM seeded), measured AS (SELECT path, CASE WHEN len(n) >= 2 THEN round(list_aggregate(n, 'stddev_pop') / list_avg(n), 6) END AS cv, round(len(list_distinct(w[1:500])) / len(w[1:500]), 6) AS ttr, list_transform(range(1, least(len(w), 30000) - 1), k -> concat_ws(' ', w[k], w[k + 1], w[k + 2])) AS t FROM rows_ WHERE len(w) >= 200) SELECT 'PL041' AS code, path, 1 AS line, 1 AS col FROM measured WHERE cv < 0.45 AND (ttr < 0.45 OR round(1 - len(list_distinct(t)) / len(t), 6) > 0.04)"
    out["stack"] = with_(LINES) + f", parts AS (SELECT path, i, regexp_extract_all(s, {q('(?i)' + both(L.HEDGE_STACK))}) AS m, string_split_regex(s, {q('(?i)' + both(L.HEDGE_STACK))}) AS p FROM lines), each_ AS (SELECT path, i, m, p, unnest(range(1, len(m) + 1)) AS k FROM parts) SELECT 'PL015' AS code, path, CAST(i + 1 AS INTEGER) AS line, CAST(list_sum(list_transform(p[1:k], x -> length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], x -> length(x))), 0) + 1 AS INTEGER) AS col FROM each_"
    out["PL044"] = f"WITH {PAGES_SQL} SELECT 'PL044' AS code, path, {place(before('text', '<title', 'i'))} FROM p WHERE regexp_matches(text, '(?is)<title[^>]*>.*?</title') AND trim(regexp_replace(regexp_extract(text, '(?is)<title[^>]*>(.*?)</title', 1), '\\s+', ' ', 'g')) IN ('', 'Document')"
    # RE2 has no look-around: a separator is a whole word between two spaces
    out["PL057"] = f"WITH {PAGES_SQL}, l AS (SELECT path, unnest(range(len(x))) AS i, unnest(x) AS s FROM (SELECT path, string_split(text, chr(10)) AS x FROM p)), t AS (SELECT path, i, string_split(s, ' ') AS w FROM l), e AS (SELECT path, i, w, unnest(range(2, len(w))) AS k FROM t), h AS (SELECT path, i, list_sum(list_transform(w[1:k - 1], x -> length(x) + 1)) + 1 AS c, count(*) OVER (PARTITION BY path) AS n FROM e WHERE regexp_full_match(w[k], '[·•→]|&(?:middot|bull|rarr|#183|#8226|#8594);')) SELECT 'PL057' AS code, path, CAST(i + 1 AS INTEGER) AS line, CAST(c AS INTEGER) AS col FROM h WHERE n >= 2"
    return {code: re.sub(r"\b([a-z]) -> ", r"lambda \1: ", text) for code, text in out.items()}


def others(sql: dict[str, str]) -> dict[str, str]:
    """SQL for derivations, pipeline and corpus queries."""
    from proselens.operators import corpus as C
    from proselens.plans import catalog
    from proselens.plans.registry import USED

    found = "f AS (" + " UNION ALL ".join(f"SELECT code, path, line, col FROM ({sql[c]})" for c in USED) + ")"
    rules = "rules(code, grp, name, tier, default_on, path_gated, message, fix) AS (VALUES " + ", ".join(f"('{r.code}', '{r.group}', '{r.name}', '{r.tier}', {r.default_on}, {r.path_gated}, {q(catalog.MESSAGES[r.code][0])}, {q(catalog.MESSAGES[r.code][1])})" for r in catalog.RULES.values()) + ")"
    full = f"WITH {found}, {rules}, g AS (SELECT f.*, name, tier, message, fix FROM f JOIN rules USING (code)) "
    files = f"files AS (SELECT s.path, s.text, s.source AS dataset, CASE quality WHEN 1 THEN 'human' WHEN 0 THEN 'ai' ELSE 'none' END AS label, {n_words('s.text')} AS words FROM seeded s LEFT JOIN labels USING (doc_id))"
    both_ = f"WITH {SEEDED_SQL}, {files}, {found}, h AS (SELECT code, path, dataset, label, n FROM (SELECT code, path, count(*) AS n FROM f GROUP BY ALL) JOIN files USING (path)) "
    # the same texts with directives: the first line is the directive, so places move down by one
    directed = SEEDED_SQL.replace("text || CASE doc_id", "CASE doc_id % 5 WHEN 0 THEN '<!-- proselens: ignore-file[PL018] -->' || chr(10) WHEN 1 THEN '# proselens: ignore-file' || chr(10) WHEN 2 THEN '// proselens: ignore[PL033, PL020]' || chr(10) ELSE '' END || text || CASE doc_id", 1)
    moved = "f AS (" + " UNION ALL ".join(f"SELECT code, path, line, col FROM ({sql[c].replace(SEEDED_SQL, directed)})" for c in USED) + ")"
    covers = "((k = 0 AND code = 'PL018') OR k = 1 OR (k = 2 AND line <= 2 AND code IN ('PL033', 'PL020')))"
    grams = " UNION ALL ".join(f"SELECT DISTINCT path, label, {n} AS n, array_to_string(w[k:k + {n - 1}], ' ') AS phrase FROM (SELECT path, label, w, unnest(range(1, len(w) - {n} + 2)) AS k FROM w) x" for n in (1, 2, 3, 4))
    scope = {"line": "text", "first-line": "string_split(text, chr(10))[1]", "last-block": "ltrim(list_filter(string_split_regex(text, '\\n[ \\t]*\\n'), lambda b: regexp_matches(b, '\\S'))[-1])"}
    cand = " UNION ALL ".join(f"SELECT label, '{n}' AS candidate, count(*) FILTER (" + (f"len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) >= {p}" if s == "file" else f"regexp_matches({scope[s]}, {q(p)})") + ") AS files FROM files GROUP BY label" for n, s, p in C.CANDIDATES)
    spot = "path || ':' || line || ':' || col"
    out = {
        "derive_lines": with_(LINES) + "SELECT path, CAST(i AS INTEGER) AS i, s FROM lines",
        "derive_paragraphs": with_(PARAGRAPHS) + "SELECT path, CAST(first AS INTEGER) AS first, text FROM paragraphs",
        "derive_sentences": with_() + f"SELECT path, CAST(unnest(range(len(x))) AS INTEGER) AS k, trim(unnest(x), ' ') AS s, CAST(unnest(list_transform(x, lambda y: {n_words('y')})) AS INTEGER) AS words FROM (SELECT path, list_filter({_MARKED}, lambda y: regexp_matches(y, '\\S')) AS x FROM seeded)",
        "catalog_rules": f"WITH {rules} SELECT * FROM rules",
        "pipeline_select": f"WITH {found} SELECT * FROM f WHERE code IN ('PL018', 'PL033')",
        "pipeline_suppression": f"WITH {moved}, d AS (SELECT 'doc/' || doc_id AS path, doc_id % 5 AS k FROM documents) SELECT f.* FROM f JOIN d USING (path) WHERE NOT {covers}",
        "pipeline_dead_suppressions": f"WITH {moved}, d AS (SELECT 'doc/' || doc_id AS path, doc_id % 5 AS k FROM documents) SELECT path, 1 AS line, k < 2 AS file_wide FROM d WHERE k < 3 AND NOT EXISTS (SELECT 1 FROM f WHERE f.path = d.path AND {covers})",
        "pipeline_path_ignores": f"WITH {found} SELECT * FROM f WHERE NOT (regexp_matches(path, '^doc/1[^/]*$') AND code = 'PL018') AND NOT (regexp_matches(path, '^doc/[23].$') AND code IN ('PL018', 'PL020'))",
        "pipeline_baseline": full + ", p AS (SELECT *, path || '|' || code || '|' || regexp_replace(message, '[0-9]', '#', 'g') AS fp FROM g), b AS (SELECT fp, count(*) AS accepted FROM p WHERE col % 2 = 0 GROUP BY fp), r AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY path, line, col) AS k FROM p) SELECT code, path, line, col FROM r LEFT JOIN b USING (fp) WHERE k > coalesce(accepted, 0)",
        "pipeline_stats": f"WITH {found} SELECT code, count(*) AS n, count(DISTINCT path) AS files FROM f GROUP BY code",
        "pipeline_sorted": f"WITH {found} SELECT * FROM f ORDER BY path, line, col, code",
        "pipeline_custom_rules": with_(LINES) + f", ing AS (SELECT path, i, string_split(s, 'ing ') AS p FROM lines WHERE regexp_matches(path, '^doc/1[^/]*$')), each_ AS (SELECT path, i, p, unnest(range(1, len(p))) AS k FROM ing) SELECT 'PL900' AS code, path, CAST(i + 1 AS INTEGER) AS line, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * 4 + 1 AS INTEGER) AS col FROM each_ UNION ALL SELECT 'PL901', path, 13, 1 FROM seeded WHERE len(string_split(text, chr(10))) > 12 UNION ALL SELECT 'PL902', path, {place(before('text', 'of_word', '')).replace('of_word', chr(92) + 'bof' + chr(92) + 'b')} FROM seeded WHERE regexp_matches(text, '\\bof\\b') UNION ALL SELECT 'PL903', path, 1, 1 FROM seeded WHERE NOT regexp_matches(text, '[.]')",
        "sink_text": full + f"SELECT {spot} || ' ' || code || ' ' || message || chr(10) || '    fix: ' || fix AS value FROM g",
        "sink_json": full + "SELECT '{\"code\":\"' || code || '\",\"name\":\"' || name || '\",\"tier\":\"' || tier || '\",\"path\":\"' || path || '\",\"line\":' || line || ',\"col\":' || col || ',\"message\":\"' || message || '\",\"fix\":\"' || fix || '\"}' AS value FROM g",
        "sink_markdown": full + f"SELECT tier, '- `' || {spot} || '` ' || code || ' ' || message AS value FROM g",
        "sink_sarif": full + "SELECT '{\"ruleId\":\"' || code || '\",\"level\":\"' || CASE tier WHEN 'A' THEN 'error' WHEN 'B' THEN 'warning' ELSE 'note' END || '\",\"message\":{\"text\":\"' || message || '. Fix: ' || fix || '\"},\"locations\":[{\"physicalLocation\":{\"artifactLocation\":{\"uri\":\"' || path || '\"},\"region\":{\"startLine\":' || line || ',\"startColumn\":' || col || '}}}]}' AS value FROM g",
        "corpus_cells": both_ + "SELECT code, dataset, label, t.files, count(*) AS hit_files, CAST(sum(n) AS BIGINT) AS findings, round(count(*) / t.files, 6) AS hit_rate, round(1000 * sum(n) / t.words, 6) AS per_1k_words FROM h JOIN (SELECT dataset, label, count(*) AS files, sum(words) AS words FROM files GROUP BY ALL) t USING (dataset, label) GROUP BY code, dataset, label, t.files, t.words",
        "corpus_scoreboard": both_ + "SELECT code, dataset, label, count(*) AS hit_files, CAST(sum(n) AS BIGINT) AS findings FROM h GROUP BY GROUPING SETS ((code, dataset, label), (code, label), (code))",
        "corpus_pooled": both_ + f", z AS (SELECT count(*) FILTER (label = 'human') AS hf, count(*) FILTER (label = 'ai') AS af FROM files), r AS (SELECT code, count(*) FILTER (label = 'human') / hf AS h, count(*) FILTER (label = 'ai') / af AS a, af FROM h, z GROUP BY code, hf, af) SELECT code, round(h, 6) AS human_rate, round(a, 6) AS ai_rate, round(CASE WHEN h + a > 0 THEN a / (h + a) END, 6) AS precision, CASE WHEN h > 0 THEN printf('%.2f', round(a / h, 2)) WHEN a > 0 THEN 'inf' ELSE 'n/a' END AS lift, CASE WHEN af < {C.LEAST_FILES} THEN 'nodata' WHEN h = 0 THEN CASE WHEN a >= {C.LEAST_RATE} THEN 'sep' ELSE 'chance' END WHEN a / h >= {C.STRONG} AND a >= {C.LEAST_RATE} THEN 'sep' WHEN a / h >= {C.WEAK} THEN 'weak' WHEN a / h < {C.INVERSE} THEN 'inv' ELSE 'chance' END AS verdict FROM r",
        "corpus_matrix": both_ + "SELECT code, count(*) FILTER (label = 'human') AS human, count(*) FILTER (label = 'ai') AS ai, count(*) FILTER (label = 'none') AS none FROM h GROUP BY code",
        "corpus_generators": both_ + f"SELECT dataset, count(*) AS files, count(p) AS hit_files, round(count(p) / count(*), 6) AS share FROM files LEFT JOIN (SELECT DISTINCT path AS p FROM f) ON p = path GROUP BY dataset HAVING count(*) >= {C.GENERATOR_FILES}",
        "corpus_paired": f"WITH {SEEDED_SQL}, {files} SELECT dataset, count(*) FILTER (label = 'human') AS human, count(*) FILTER (label = 'ai') AS ai FROM files GROUP BY dataset HAVING count(*) FILTER (label = 'human') > 0 AND count(*) FILTER (label = 'ai') > 0",
        "corpus_message_shapes": full + "SELECT code, regexp_replace(message, '[0-9]+', 'N', 'g') AS shape, count(*) AS n FROM g GROUP BY ALL",
        "corpus_spread_sample": "WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) SELECT doc_id, source FROM r, n WHERE k IN (SELECT (i * n.n) // 40 FROM range(40) t(i), n)",
        "corpus_phrases": f"WITH {SEEDED_SQL}, {files}, w AS (SELECT path, label, list_filter(string_split_regex(lower(text), '[^\\p{{L}}'']+'), lambda x: x <> '') AS w FROM files WHERE label <> 'none'), z AS (SELECT count(*) FILTER (label = 'human') AS hf, count(*) FILTER (label = 'ai') AS af FROM w), g AS ({grams}), c AS (SELECT phrase, n, count(*) FILTER (label = 'ai') AS ai_files, count(*) FILTER (label = 'human') AS human_files FROM g GROUP BY phrase, n HAVING count(*) FILTER (label = 'ai') >= {C.SUPPORT}) SELECT phrase, ai_files, human_files, CAST(n AS INTEGER) AS n, round(((ai_files + 1) / (af + 2)) / ((human_files + 1) / (hf + 2)), 6) AS ratio FROM c, z ORDER BY ratio DESC, phrase LIMIT 150",
        "corpus_candidates": f"WITH {SEEDED_SQL}, {files} " + cand,
    }
    return {name: re.sub(r"\b([a-z]) -> ", r"lambda \1: ", text) for name, text in out.items()}
