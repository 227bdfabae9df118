"""The compiler's tables in DuckDB SQL, written apart from the plans, for the queries' oracles."""

from __future__ import annotations

import re

from ..config import ADJACENT, DEBUG_TYPOS, TYPO_RULES, WORD_RULES, QUERY_CONFIG
from .engine import ORDERS, TARGET_ORDERS

C = QUERY_CONFIG


def values(rows) -> str:
    q = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)


def like(glob: str) -> str:
    return f"replace(replace(replace(replace({glob}, '!', '!!'), '%', '!%'), '_', '!_'), '*', '%')"


def core(p: str) -> str:
    return f"(CASE WHEN {p} = ':' THEN '' ELSE regexp_replace(regexp_replace({p}, '^:', ''), ':$', '') END)"


def scope(p: str) -> str:
    return f"(CASE WHEN {p} LIKE ':%' AND {p} LIKE '%:' THEN 'both' WHEN {p} LIKE ':%' THEN 'left' WHEN {p} LIKE '%:' THEN 'right' END)"


def qmk(t: str, b: str) -> str:
    return f"((CASE WHEN {b} IN ('left', 'both') THEN ':' ELSE '' END) || {t} || (CASE WHEN {b} IN ('right', 'both') THEN ':' ELSE '' END))"


def guard(t: str, w: str) -> str:
    return f"({t} IN ({w} || 's', {w} || 'ed', {w} || 'er', {w} || 'or') OR ({w} LIKE '%e' AND {t} IN ({w} || 'd', {w} || 'r')) OR ({w} LIKE '%o' AND {t} = {w} || 'r'))"


def first_spliced(long: str, short: str, by: str) -> str:
    return f"(CASE WHEN instr({long}, {short}) > 0 THEN left({long}, (instr({long}, {short}) - 1)::INT) || {by} || substring({long}, instr({long}, {short}) + length({short})) END)"


def last_at(long: str, short: str) -> str:
    return f"(CASE WHEN contains({long}, {short}) THEN length({long}) - length({short}) - instr(reverse({long}), reverse({short})) + 2 ELSE 0 END)"


def last_spliced(long: str, short: str, by: str) -> str:
    at = last_at(long, short)
    return f"(CASE WHEN {at} > 0 THEN left({long}, ({at} - 1)::INT) || {by} || substring({long}, {at} + length({short})) END)"


def place(t: str, w: str, which: str) -> str:
    return {"prefix": f"({t} <> {w} AND starts_with({w}, {t}))", "suffix": f"({t} <> {w} AND suffix({w}, {t}))", "middle": f"(length({w}) > length({t}) + 1 AND contains(substring({w}, 2, length({w}) - 2), {t}))"}[which]


def fires(b: str, t: str, w: str) -> str:
    p, s, m = (place(t, w, x) for x in ("prefix", "suffix", "middle"))
    return f"(CASE {b} WHEN 'none' THEN v_start OR s_start OR {p} OR v_end OR s_end OR {s} OR v_sub OR s_sub OR {m} WHEN 'left' THEN v_start OR s_start OR {p} WHEN 'right' THEN v_end OR s_end OR {s} ELSE false END)"


def _flags(typos: str) -> str:
    """Flags of typos by direct tests on the exploded substrings."""
    g = lambda words: f"(SELECT g AS typo, bool_or(i = 1) AS st, bool_or(i + n - 1 = length(word)) AS en FROM (SELECT word, i, n, substring(word, i, n) AS g FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM {words}), range(1, {C.max_ngram + 1}) r(n) WHERE n < length(word) AND i + n - 1 <= length(word)) GROUP BY g)"
    cols = ", ".join(f"coalesce({a}.{x}, false) AS {a}_{y}" for a in "vs" for x, y in (("st", "start"), ("en", "end")))
    return f"SELECT t.typo, {cols}, v.typo IS NOT NULL AS v_sub, s.typo IS NOT NULL AS s_sub FROM (SELECT DISTINCT typo FROM {typos}) t LEFT JOIN {g('valid')} v ON v.typo = t.typo LEFT JOIN {g('words')} s ON s.typo = t.typo"


def _kernel(name: str, nodes: str, edges: str, rounds: int = 9) -> dict[str, str]:
    """CTEs name_0 .. name_n of (id, state): true kept, false removed, null open."""
    out = {f"{name}_e": f"SELECT DISTINCT u, v FROM ({edges})", f"{name}_0": f"SELECT id, CASE WHEN id NOT IN (SELECT v FROM {name}_e) THEN true END AS state FROM (SELECT DISTINCT id FROM ({nodes}))"}
    for k in range(1, rounds + 1):
        p = f"{name}_{k - 1}"
        out[f"{name}_{k}"] = f"SELECT n.id, CASE WHEN n.state IS NOT NULL THEN n.state WHEN n.id IN (SELECT e.v FROM {name}_e e JOIN {p} k ON k.id = e.u WHERE k.state) THEN false WHEN n.id NOT IN (SELECT e.v FROM {name}_e e JOIN {p} k ON k.id = e.u WHERE k.state IS NULL) THEN true END AS state FROM {p} n"
    out[name] = f"SELECT id FROM {name}_{rounds} WHERE state"
    return out


_TYPO = {
    "transposition": ("left(word, i - 1) || word[i + 1] || word[i] || substring(word, i + 2)", "i < length(word)"),
    "omission": ("left(word, i - 1) || substring(word, i + 1)", "length(word) >= 4"),
    "duplication": ("left(word, i) || substring(word, i)", "true"),
}


def _typo(kind: str) -> str:
    places = "(SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM words)"
    if kind in _TYPO:
        e, where = _TYPO[kind]
        return f"SELECT {e} AS typo, word FROM {places} WHERE {where}"
    if kind == "insertion":
        return f"SELECT left(word, c) || neighbor || substring(word, c + 1) AS typo, word FROM (SELECT word, neighbor, unnest([i, i - 1]) AS c FROM {places} JOIN adj ON key = word[i])"
    return f"SELECT left(word, i - 1) || neighbor || substring(word, i + 1) AS typo, word FROM {places} JOIN adj ON key = word[i]"


def _extract(side: str) -> str:
    pick = {"suffix": ("right(typo, n)", "right(word, n)", "left(typo, length(typo) - n) = left(word, length(word) - n)", "right"), "prefix": ("left(typo, n)", "left(word, n)", "substring(typo, n + 1) = substring(word, n + 1)", "left")}[side]
    return f"SELECT {pick[0]} AS tp, {pick[1]} AS wp, boundary, typo, word FROM (SELECT *, unnest(range(2, length(typo) - 1))::INT AS n FROM corrections WHERE length(typo) = length(word) AND boundary IN ('none', '{pick[3]}')) WHERE {pick[2]} AND {pick[0]} <> {pick[1]}"


def _subs(rows: str, cols: str, text: str) -> str:
    """(cols, i, k, g): places, lengths and texts of the proper substrings of ``text``."""
    return f"(SELECT {cols}, i, k, substring(full_text, i, k) AS g FROM (SELECT {cols}, full_text, i, unnest(range(1, length(full_text) - i + 2))::INT AS k FROM (SELECT {cols}, {text} AS full_text, unnest(range(1, length({text}) + 1))::INT AS i FROM {rows})) WHERE k < length(full_text))"


_end = "left(typo, length(typo) - length(tp)) || wp"
_start = "wp || substring(typo, length(tp) + 1)"
_rank = "ORDER BY tier, score DESC, typo, word, boundary"

CTES: dict[str, str] = {
    "lex": "SELECT word, count(*)::BIGINT AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE lang = 'en') GROUP BY word",
    "usr": f"SELECT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) GROUP BY word HAVING count(*) >= {C.user_count} AND length(word) >= 2",
    "word_rules": f"SELECT * FROM (VALUES {values([(r,) for r in WORD_RULES])}) t(rule)",
    "typo_rules": f"SELECT rule, {core('l')} AS typo_glob, word_glob, {scope('l')} AS required FROM (SELECT rule, trim(split_part(rule, '->', 1)) AS l, trim(split_part(rule, '->', 2)) AS word_glob FROM (VALUES {values([(r,) for r in TYPO_RULES])}) t(rule))",
    "dictionary_words": f"SELECT word FROM lex WHERE freq >= {C.validation_count} UNION SELECT word FROM usr",
    "valid": f"SELECT word FROM dictionary_words w WHERE NOT EXISTS (SELECT 1 FROM word_rules WHERE w.word LIKE {like('rule')} ESCAPE '!')",
    "src": f"SELECT word, freq, row_number() OVER (ORDER BY freq DESC, word) AS rnk FROM (SELECT * FROM lex ORDER BY freq DESC, word LIMIT {3 * C.top_n}) WHERE length(word) BETWEEN {C.min_word_length} AND {C.max_word_length} QUALIFY rnk <= {C.top_n}",
    "words": "SELECT w.word, coalesce(freq, 0)::BIGINT AS freq, is_user FROM (SELECT word, bool_or(u) AS is_user FROM (SELECT word, false AS u FROM src UNION ALL SELECT word, true FROM usr) GROUP BY word) w LEFT JOIN lex USING (word)",
    "adj": f"SELECT * FROM (VALUES {values([(k, i, c) for k, near in ADJACENT.items() for i, c in enumerate(near)])}) t(key, pos, neighbor)",
    **{f"typo_{k}": _typo(k) for k in (*_TYPO, "insertion", "replacement")},
    "typos": " UNION ALL ".join(f"SELECT typo, word, '{k}' AS kind FROM typo_{k}" for k in (*_TYPO, "insertion", "replacement")),
    "reasons": f"SELECT p.typo, p.word, CASE WHEN p.typo IN (SELECT word FROM words) THEN 'source_word' WHEN p.typo IN (SELECT word FROM valid) THEN 'validation_word' WHEN coalesce(l.freq, 0) >= {C.typo_freq_threshold} AND NOT EXISTS (SELECT 1 FROM typo_rules WHERE p.typo LIKE {like('typo_glob')} ESCAPE '!') THEN 'too_frequent' WHEN {guard('p.typo', 'p.word')} THEN 'valid_suffix' END AS reason FROM (SELECT DISTINCT typo, word FROM typos WHERE typo <> word) p LEFT JOIN lex l ON l.word = p.typo",
    "pairs": "SELECT typo, word FROM reasons WHERE reason IS NULL",
    "flags": _flags("pairs"),
    "nat": "SELECT typo, CASE WHEN NOT (v_sub OR s_sub) THEN 'none' WHEN v_start AND v_end THEN 'both' WHEN v_end THEN 'left' WHEN v_start THEN 'right' ELSE 'both' END AS \"natural\" FROM flags",
    "rk": "SELECT typo, p.word, coalesce(freq, 0)::BIGINT AS freq, row_number() OVER (PARTITION BY typo ORDER BY coalesce(freq, 0) DESC, p.word) AS rk FROM pairs p LEFT JOIN lex l ON l.word = p.word",
    "coll": f"SELECT *, n_words = 1 OR f2 = 0 OR f1 > {C.freq_ratio} * f2 AS accepted FROM (SELECT typo, count(*)::BIGINT AS n_words, max(word) FILTER (rk = 1) AS word, max(freq) FILTER (rk = 1) AS f1, max(freq) FILTER (rk = 2) AS f2 FROM rk GROUP BY typo)",
    "amb": "SELECT typo, rk.word, \"natural\" AS boundary, f1, f2 FROM coll JOIN rk USING (typo) JOIN nat USING (typo) WHERE NOT accepted",
    "orders": f"SELECT * FROM (VALUES {values([(k, i + 1, b) for k, bs in ORDERS.items() for i, b in enumerate(bs)])}) t(\"natural\", ord, boundary)",
    "tries": f"SELECT typo, word, \"natural\", ord, boundary, CASE WHEN length(word) <= {C.min_typo_length} AND length(typo) < {C.min_typo_length} THEN 'too_short' WHEN EXISTS (SELECT 1 FROM typo_rules r WHERE typo LIKE {like('typo_glob')} ESCAPE '!' AND word LIKE {like('word_glob')} ESCAPE '!' AND (required IS NULL OR required = boundary)) THEN 'excluded_by_pattern' WHEN {fires('boundary', 'typo', 'word')} THEN 'false_trigger' END AS reason FROM coll JOIN flags USING (typo) JOIN nat USING (typo) JOIN orders USING (\"natural\") WHERE accepted",
    "corrections": "SELECT typo, word, arg_min(boundary, ord) AS boundary FROM tries WHERE reason IS NULL GROUP BY typo, word",
    "rejected": "SELECT t.typo, t.word, t.boundary, t.reason FROM tries t LEFT JOIN (SELECT typo, word, min(ord) AS o FROM tries WHERE reason IS NULL GROUP BY ALL) d ON d.typo = t.typo AND d.word = t.word WHERE t.reason IS NOT NULL AND t.ord < coalesce(d.o, 99) UNION ALL SELECT typo, word, boundary, 'ambiguous_collision' FROM amb",
    **{f"ext_{s}": _extract(s) for s in ("suffix", "prefix")},
    "occ": " UNION ".join(f"SELECT * FROM (SELECT DISTINCT * FROM ext_{s}) QUALIFY count(*) OVER (PARTITION BY tp, wp, boundary) >= 2" for s in ("suffix", "prefix")),
    "affix": "SELECT DISTINCT p.tp, p.wp, p.boundary, side, c.typo, c.word FROM (SELECT DISTINCT tp, wp, boundary FROM occ) p, (VALUES ('suffix'), ('prefix')) s(side), corrections c WHERE c.typo <> p.tp AND CASE side WHEN 'suffix' THEN suffix(c.typo, p.tp) ELSE starts_with(c.typo, p.tp) END AND NOT EXISTS (SELECT 1 FROM occ o WHERE o.tp = p.tp AND o.wp = p.wp AND o.boundary = p.boundary AND o.typo = c.typo AND o.word = c.word)",
    "mism": f"SELECT *, CASE side WHEN 'suffix' THEN {_end} || (CASE WHEN {last_at('word', 'tp')} > 0 THEN substring(word, {last_at('word', 'tp')} + length(tp)) ELSE '' END) ELSE {_start} END AS result FROM affix WHERE result <> word",
    "checks": f"SELECT tp, wp, boundary, n, CASE WHEN length(tp) < {C.min_typo_length} THEN 'too_short' WHEN NOT fine THEN 'wrong_result' WHEN tp IN (SELECT word FROM valid) OR (boundary IN ('right', 'none') AND EXISTS (SELECT 1 FROM valid w WHERE w.word <> tp AND suffix(w.word, tp))) OR (boundary IN ('left', 'none') AND EXISTS (SELECT 1 FROM valid w WHERE w.word <> tp AND starts_with(w.word, tp))) OR (boundary = 'none' AND EXISTS (SELECT 1 FROM valid w WHERE w.word <> tp AND contains(w.word, tp))) THEN 'validation_conflict' WHEN EXISTS (SELECT 1 FROM words w WHERE starts_with(w.word, tp)) THEN 'corrupts_source' WHEN EXISTS (SELECT 1 FROM mism m WHERE m.tp = p.tp AND m.wp = p.wp AND m.boundary = p.boundary) THEN 'incorrect_match' END AS reason FROM (SELECT tp, wp, boundary, count(*)::BIGINT AS n, bool_and(coalesce(word = CASE WHEN boundary = 'right' THEN CASE WHEN suffix(typo, tp) THEN {_end} END WHEN boundary = 'left' THEN CASE WHEN starts_with(typo, tp) THEN {_start} END WHEN suffix(typo, tp) THEN {_end} WHEN starts_with(typo, tp) THEN {_start} END, false)) AS fine FROM occ GROUP BY tp, wp, boundary) p",
    "red": f"SELECT DISTINCT s.boundary, s.tp, s.wp, l.tp AS long_tp, l.wp AS long_wp FROM {_subs('(SELECT * FROM checks WHERE reason IS NULL)', 'tp, wp, boundary', 'tp')} l JOIN (SELECT tp, wp, boundary FROM checks WHERE reason IS NULL) s ON s.boundary = l.boundary AND s.tp = l.g AND left(l.tp, l.i - 1) || s.wp || substring(l.tp, l.i + l.k) = l.wp",
    **_kernel("pk", "SELECT tp || chr(9) || wp || chr(9) || boundary AS id FROM checks WHERE reason IS NULL", "SELECT tp || chr(9) || wp || chr(9) || boundary AS u, long_tp || chr(9) || long_wp || chr(9) || boundary AS v FROM red", 5),
    "patterns": "SELECT tp AS typo, wp AS word, boundary, n FROM checks WHERE tp || chr(9) || wp || chr(9) || boundary IN (SELECT id FROM pk)",
    "pat_rejects": "SELECT c.tp, c.wp, c.boundary, c.n, coalesce(c.reason, 'redundant') AS reason FROM checks c WHERE NOT EXISTS (SELECT 1 FROM patterns p WHERE p.typo = c.tp AND p.word = c.wp AND p.boundary = c.boundary)",
    "repl": "SELECT o.tp AS pattern_typo, o.wp AS pattern_word, o.boundary, o.typo, o.word FROM occ o JOIN patterns p ON p.typo = o.tp AND p.word = o.wp AND p.boundary = o.boundary",
    "rules": "SELECT typo, word, boundary FROM corrections c WHERE NOT EXISTS (SELECT 1 FROM repl r WHERE r.typo = c.typo AND r.word = c.word AND r.boundary = c.boundary) UNION SELECT typo, word, boundary FROM patterns",
    "edges": f"SELECT DISTINCT s.typo, s.word, s.boundary, l.typo AS long_typo, l.word AS long_word FROM {_subs('rules', 'typo, word, boundary', 'typo')} l JOIN rules s ON s.boundary = l.boundary AND s.typo = l.g WHERE CASE WHEN s.boundary = 'right' THEN right(s.typo, 1) = right(l.typo, 1) AND {last_spliced('l.typo', 's.typo', 's.word')} = l.word ELSE left(s.typo, 1) = left(l.typo, 1) AND {first_spliced('l.typo', 's.typo', 's.word')} = l.word END",
    **_kernel("ck", "SELECT typo || chr(9) || word || chr(9) || boundary AS id FROM rules", "SELECT typo || chr(9) || word || chr(9) || boundary AS u, long_typo || chr(9) || long_word || chr(9) || boundary AS v FROM edges"),
    "unblocked": "SELECT * FROM rules WHERE typo || chr(9) || word || chr(9) || boundary IN (SELECT id FROM ck)",
    "blocked": "SELECT e.long_typo AS typo, e.long_word AS word, e.boundary, arg_min(e.typo || ' -> ' || e.word, {'n': length(e.typo), 't': e.typo, 'w': e.word}) AS blocker FROM edges e JOIN unblocked k ON k.typo = e.typo AND k.word = e.word AND k.boundary = e.boundary WHERE NOT EXISTS (SELECT 1 FROM unblocked u WHERE u.typo = e.long_typo AND u.word = e.long_word AND u.boundary = e.boundary) GROUP BY ALL",
    "fmt": f"SELECT *, {qmk('typo', 'boundary')} AS text FROM unblocked",
    "ppairs": f"SELECT DISTINCT s.typo AS short_typo, s.word AS short_word, s.boundary AS short_boundary, s.text AS short_text, l.typo AS long_typo, l.word AS long_word, l.boundary AS long_boundary, l.text AS long_text FROM {_subs('fmt', 'typo, word, boundary, text', 'text')} l JOIN fmt s ON s.text = l.g",
    "loose": "SELECT *, CASE short_boundary WHEN 'none' THEN 0 WHEN 'both' THEN 2 ELSE 1 END AS s, CASE long_boundary WHEN 'none' THEN 0 WHEN 'both' THEN 2 ELSE 1 END AS l, CASE WHEN s < l THEN short_typo ELSE long_typo END AS typo, CASE WHEN s < l THEN short_word ELSE long_word END AS word, CASE WHEN s < l THEN short_boundary ELSE long_boundary END AS boundary FROM ppairs",
    "lflags": _flags("loose"),
    "decisions": f"SELECT short_typo, short_word, short_boundary, short_text, long_typo, long_word, long_boundary, long_text, CASE WHEN s = l THEN false WHEN s < l THEN {fires('boundary', 'typo', 'word')} ELSE NOT {fires('boundary', 'typo', 'word')} END AS remove_shorter FROM loose JOIN lflags USING (typo)",
    # pairs in order: one counts if no earlier one that counts has removed a rule of it
    "pp": f"SELECT *, row_number() OVER (ORDER BY long_text, short_text, long_word, short_word, long_boundary, short_boundary)::VARCHAR AS id, row_number() OVER (ORDER BY long_text, short_text, long_word, short_word, long_boundary, short_boundary) AS k, CASE WHEN remove_shorter THEN sid ELSE lid END AS loser FROM (SELECT *, short_typo || chr(9) || short_word || chr(9) || short_boundary AS sid, long_typo || chr(9) || long_word || chr(9) || long_boundary AS lid FROM decisions)",
    **_kernel("plk", "SELECT id FROM pp", "SELECT j.id AS u, i.id AS v FROM pp j JOIN pp i ON i.sid = j.loser AND j.k < i.k UNION SELECT j.id, i.id FROM pp j JOIN pp i ON i.lid = j.loser AND j.k < i.k", 16),
    "premoved": "SELECT split_part(x, chr(9), 1) AS typo, split_part(x, chr(9), 2) AS word, split_part(x, chr(9), 3) AS boundary FROM (SELECT DISTINCT loser AS x FROM pp WHERE id IN (SELECT id FROM plk))",
    "pleft": "SELECT typo, word, boundary, CASE WHEN NOT (regexp_full_match(typo, '[a-z'']*') AND regexp_full_match(word, '[a-z'']*')) THEN 'Invalid characters' WHEN length(typo) > 62 THEN 'Typo too long (>62)' WHEN length(word) > 62 THEN 'Word too long (>62)' END AS reason FROM unblocked u WHERE NOT EXISTS (SELECT 1 FROM premoved p WHERE p.typo = u.typo AND p.word = u.word AND p.boundary = u.boundary)",
    "fin": "SELECT typo, word, boundary FROM pleft WHERE reason IS NULL",
    "target_orders": f"SELECT * FROM (VALUES {values([(k, i + 1, b) for k, bs in TARGET_ORDERS.items() for i, b in enumerate(bs)])}) t(place, ord, boundary)",
    "debug_rules": f"SELECT pattern, {core('pattern')} AS pat, {scope('pattern')} AS scope FROM (VALUES {values([(p,) for p in DEBUG_TYPOS])}) t(pattern)",
}


def with_tables(final: str) -> str:
    """``final`` behind the CTEs that it needs."""
    need, todo = set(), [final]
    while todo:
        for name in set(re.findall(r"\w+", todo.pop())) & CTES.keys() - need:
            need.add(name)
            todo.append(CTES[name])
    head = ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in CTES.items() if n in need)
    return f"WITH {head} {final}" if head else final
