"""Oracle SQL of the features, from the same pattern lists.

SQL's regular expressions lack look-around, so the text is marked first where a look-around would
look: runs of digits get marks at both ends, and parentheses that don't count are replaced.
"""

from __future__ import annotations

from ..functions import lexicon, text
from ..operators.features import FEATURES, RATES, SUMS
from .views import TURNS_SQL


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matches(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, {quoted(pattern)}))"


def count(col: str, name: str, profile: str = "general") -> str:
    if name == "enumeration":
        return _enumeration(col, profile)
    return matches(col, "(?im)" + "|".join(lexicon.profile(profile)[name]))


def _enumeration(col: str, profile: str) -> str:
    """Parentheses after a word, a bracket, or one of the words of the look-behinds become \\x01."""
    after_words = f"regexp_replace({col}, '(?i)(\\b(?:for|in|of|see|step) )\\(', '\\1' || chr(1), 'g')"
    marked = f"regexp_replace({after_words}, '([\\pL\\pN_\\])])\\(', '\\1' || chr(1), 'g')"
    patterns = []
    for p in lexicon.profile(profile)["enumeration"]:
        p = p.removeprefix(lexicon.NOT_A_BACK_REFERENCE).removeprefix(r"(?<![\w\])])").replace(r"(?=\s)", r"\s")
        patterns.append(p.replace(r"(?<=[:;,]\s)", r"[:;,]\s"))
    return matches(marked, "(?im)" + "|".join(patterns))


#: Identifiers with digits, in text whose runs of digits stand between chr(1) and chr(2).
_OF_DIGITS = {
    "phone": r"\x01(?:1(?:\x02[ .-]?\(?\x01)?)?\d{3}(?:\x02\)?[ .-]?\x01)?\d{3}(?:\x02[ .-]?\x01)?\d{4}\x02",
    "ssn_like": r"\x01\d{3}\x02-\x01\d{2}\x02-\x01\d{4}\x02",
    "dob_like": r"\x01(?:0?[1-9]|1[0-2])\x02/\x01(?:0?[1-9]|[12]\d|3[01])\x02/\x01(?:19|20)\d{2}\x02",
}


def identifiers(col: str) -> dict[str, str]:
    runs = f"regexp_replace({col}, '([0-9]+)', chr(1) || '\\1' || chr(2), 'g')"
    return {name: matches(runs, _OF_DIGITS[name]) if name in _OF_DIGITS else matches(col, p) for name, p in lexicon.PII.items()}


def context_sql(source: str) -> str:
    """CTEs from rows session_id, turn, content: ctx_rows with context_chars."""
    code = f"""CASE WHEN length(s) < 3 THEN s IN ('{{', '}}', '}};') ELSE regexp_matches(s, {quoted(text.PREPROCESSOR.removeprefix("(?d)"))}) OR regexp_matches(s, {quoted(text.CODE_END.removeprefix("(?d)"))})
      OR (length(s) >= 8 AND (length(s) - length(translate(s, {quoted(text.CODE_PUNCTUATION)}, ''))) / length(s) >= 0.12) END"""
    return rf"""ctx_text AS (
  SELECT session_id, turn, regexp_extract_all(content, {quoted(text.FENCE)}) AS blocks, regexp_replace(content, {quoted(text.FENCE)}, chr(10), 'g') AS rest FROM {source}
), ctx_paragraphs AS (
  SELECT session_id, turn, len(blocks) AS fences, generate_subscripts(string_split_regex(rest, '\n\s*\n'), 1) AS p, unnest(string_split_regex(rest, '\n\s*\n')) AS paragraph FROM ctx_text
), ctx_lines AS (
  SELECT session_id, turn, p, generate_subscripts(string_split_regex(paragraph, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85]'), 1) AS k, unnest(string_split_regex(paragraph, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85]')) AS line
  FROM ctx_paragraphs WHERE NOT (length(paragraph) > 300 AND fences = 0)
), ctx_code AS (
  SELECT *, {code} AS code FROM (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM ctx_lines)
), ctx_runs AS (
  SELECT session_id, turn, p, k - row_number() OVER (PARTITION BY session_id, turn, p ORDER BY k) AS run, line, s FROM ctx_code WHERE code
), ctx_bare AS (
  SELECT session_id, turn, sum(chars) AS chars FROM (SELECT session_id, turn, sum(length(line)) AS chars, count(*) AS n, max(length(s)) AS longest FROM ctx_runs GROUP BY session_id, turn, p, run) WHERE n >= 2 OR longest >= 40 GROUP BY 1, 2
), ctx_long AS (
  SELECT session_id, turn, sum(length(paragraph)) AS chars FROM ctx_paragraphs WHERE length(paragraph) > 300 AND fences = 0 GROUP BY 1, 2
), ctx_rows AS (
  SELECT t.session_id, t.turn, CAST(coalesce(list_sum(list_transform(blocks, lambda x: length(x))), 0) + coalesce(b.chars, 0) + coalesce(l.chars, 0) AS BIGINT) AS context_chars
  FROM ctx_text t LEFT JOIN ctx_bare b ON b.session_id = t.session_id AND b.turn = t.turn LEFT JOIN ctx_long l ON l.session_id = t.session_id AND l.turn = t.turn
)"""


def words(col: str) -> str:
    return f"regexp_extract_all({col}, '[A-Za-z][A-Za-z''-]*')"


def listed(xs: list[str]) -> str:
    return "[" + ", ".join(map(quoted, xs)) + "]"


def bigrams(toks: str) -> str:
    return f"list_transform(range(1, len({toks})), lambda k: {toks}[k] || ' ' || {toks}[k + 1])"


_FAMILIES = sorted({"privacy", *SUMS.values(), *RATES.values(), "revision", "request_head", "success_cond", "provenance", "hedge", "error_assert", "external_source", "recheck", "ethics"})

def rows_sql(profile: str = "general") -> str:
    """One row per live turn with counts and windows."""
    return f"""{TURNS_SQL}, counted AS (
  SELECT *, {", ".join(f"{count('content', f, profile)} AS c_{f}" for f in _FAMILIES)}, {" + ".join(identifiers("content").values())} AS leaks,
         {words("content")} AS raw, list_transform({words("content")}, lambda t: lower(t)) AS toks
  FROM live
), prepared AS (
  SELECT *, {bigrams("toks")} AS bi, list_distinct(list_filter(toks, lambda t: NOT list_contains({listed(lexicon.STOPWORDS)}, t))) AS words FROM counted
), rows_ AS (
  SELECT *,
    coalesce(max(CASE WHEN role = 'user' AND (c_recheck > 0 OR c_hedge > 0) THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 0) = 1 AS rechecked,
    coalesce(last_value(CASE WHEN role = 'assistant' THEN c_ethics > 0 END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS primed,
    lag(role) OVER w AS prev_role, lag(bi) OVER w AS prev_bi
  FROM prepared WINDOW w AS (PARTITION BY session_id ORDER BY turn)
), near AS (
  SELECT a.session_id, a.turn,
    max(CASE WHEN b.turn IS NOT NULL THEN 1 ELSE 0 END) AS later_user,
    max(CASE WHEN len(a.words) > 0 AND len(b.words) > 0 AND len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) > 0.4 THEN 1 ELSE 0 END) AS near
  FROM prepared a LEFT JOIN prepared b ON a.session_id = b.session_id AND b.turn < a.turn AND b.role = 'user'
  WHERE a.role = 'user' GROUP BY 1, 2
), overlap_rows AS (
  SELECT session_id, turn, CASE WHEN len(bi) = 0 OR len(prev_bi) = 0 THEN 0.0 ELSE len(list_filter(bi, lambda b: list_contains(prev_bi, b))) / len(bi) END AS overlap
  FROM rows_ WHERE role = 'user' AND prev_role = 'assistant' AND len(toks) >= 8
)"""


ROWS_SQL = rows_sql()

_U = "FILTER (WHERE role = 'user')"
_TOK = "greatest(n_tok, 1)"
_EXPR = (
    {name: f"CAST(s_{f} AS DOUBLE)" for name, f in SUMS.items()}
    | {name: f"s_{f} / n_stu" for name, f in RATES.items()}
    | {
        "refinement_ratio": "refined / n_stu",
        "specificity_index": f"telling / {_TOK} - 2.0 * (vague / {_TOK}) + 0.5 * CASE WHEN n_tok = 0 THEN 0.0 ELSE (caps - coalesce(first_cap, 0) + least(digits, n_tok)) / {_TOK} END",
        "framing_clarity": "least(framing / n_stu, 1.5)",
        "scrutiny_rate": "(s_provenance + s_hedge + s_error_assert + s_external_source) / n_ast",
        "recheck_rate": "CASE WHEN errors > 0 THEN rechecks / errors ELSE 0.0 END",
        "unprompted_ethics_rate": "unprompted / n_stu",
        "paraphrase_overlap": "coalesce(overlap, 0.0)",
        "privacy_handling": "s_privacy - 2.0 * leaks",
        "context_ratio": "ctx / greatest(chars + greatest(users - 1, 0), 1)",
    }
)

def sessions_sql(profile: str = "general") -> str:
    return f"""{rows_sql(profile)}, users_ AS (SELECT * FROM live WHERE role = 'user'), {context_sql("users_")}, summed AS (
  SELECT r.session_id, arg_min(student, r.turn) AS student, arg_min(discipline, r.turn) AS discipline,
    count(*) {_U} AS users, greatest(count(*) {_U}, 1) AS n_stu, greatest(count(*) FILTER (WHERE role = 'assistant'), 1) AS n_ast,
    {", ".join(f"coalesce(sum(c_{f}) {_U}, 0) AS s_{f}" for f in _FAMILIES)},
    coalesce(sum(CASE WHEN later_user = 1 AND (near = 1 OR c_revision > 0) THEN 1 ELSE 0 END) {_U}, 0) AS refined,
    coalesce(sum(len(toks)) {_U}, 0) AS n_tok,
    coalesce(sum(len(list_filter(toks, lambda t: length(t) > 3 AND NOT list_contains({listed(lexicon.STOPWORDS)}, t)))) {_U}, 0) AS telling,
    coalesce(sum(len(list_filter(toks, lambda t: list_contains({listed(lexicon.VAGUE)}, t)))) {_U}, 0) AS vague,
    coalesce(sum(len(list_filter(raw, lambda t: regexp_matches(t, '^[A-Z]')))) {_U}, 0) AS caps,
    arg_min(CAST(regexp_matches(raw[1], '^[A-Z]') AS INTEGER), r.turn) FILTER (WHERE role = 'user' AND len(raw) > 0) AS first_cap,
    coalesce(sum(len(regexp_extract_all(content, '[0-9]'))) {_U}, 0) AS digits,
    coalesce(sum(CASE WHEN c_request_head = 1 THEN 1.0 WHEN c_request_head > 1 THEN 0.5 ELSE 0.0 END + CASE WHEN c_success_cond > 0 THEN 0.5 ELSE 0.0 END) {_U}, 0) AS framing,
    count(*) FILTER (WHERE role = 'user' AND c_error_assert > 0) AS errors,
    count(*) FILTER (WHERE role = 'user' AND c_error_assert > 0 AND rechecked) AS rechecks,
    count(*) FILTER (WHERE role = 'user' AND c_ethics > 0 AND NOT primed) AS unprompted,
    avg(overlap) AS overlap,
    coalesce(sum(leaks) {_U}, 0) AS leaks, coalesce(sum(length(content)) {_U}, 0) AS chars, coalesce(sum(context_chars) {_U}, 0) AS ctx
  FROM rows_ r LEFT JOIN ctx_rows x ON r.session_id = x.session_id AND r.turn = x.turn LEFT JOIN near n ON r.session_id = n.session_id AND r.turn = n.turn LEFT JOIN overlap_rows o ON r.session_id = o.session_id AND r.turn = o.turn
  GROUP BY r.session_id
), sessions AS (
  SELECT session_id, student, discipline, users AS n_student_turns, {", ".join(f"CAST({_EXPR[f]} AS DOUBLE) AS {f}" for f in FEATURES)} FROM summed
)"""


SESSIONS_SQL = sessions_sql()
